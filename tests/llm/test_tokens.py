"""Token counts and BPE against the libraries they follow."""

import hashlib
import itertools
import struct

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lacuna.llm import bpe, token_counts

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOKENIZER = Tokenizer.from_file(WORDS)
COUNTER = token_counts.Counter(open(PIECES, "rb").read())
CODEC = bpe.Codec(open(WORDS, encoding="utf-8").read())
CHARS = st.characters(codec="utf-8", categories=("Lu", "Ll", "Nd", "Po", "Sc", "Sm", "Zs"), max_codepoint=0x24F)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_counts_of_odd_texts(odd):
    got = sorted(token_counts.count_tokens(odd, PIECES).collect(), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(LIBRARY.encode(r.text or "")), n > 4096) for r in odd.collect()), key=lambda x: f"Row(doc_id={x[0]}")
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(CHARS, max_size=60))
def test_counts_as_the_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(CHARS, max_size=60))
def test_ids_and_decoded_text_as_the_library(text):
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    packed = CODEC.encode(text)
    assert packed == struct.pack(f"<{len(ids)}I", *ids)
    assert CODEC.decode(packed) == TOKENIZER.decode(ids, skip_special_tokens=False)


def test_all_signs_as_the_library():
    planes = [*range(0, 0xD800), *range(0xE000, 0x34000), *range(0x3C000, 0x3FD00, 3), *range(0xE0000, 0xE0200), 0x10FFFF]
    for form in ("a{}b", "e{}\u0301{}1", "e\u0323{}\u0301!"):
        for at in range(0, len(planes), 4096):
            text = " | ".join(form.replace("{}", chr(c)) for c in planes[at : at + 4096])
            ids = TOKENIZER.encode(text, add_special_tokens=False).ids
            if CODEC.encode(text) != struct.pack(f"<{len(ids)}I", *ids):
                wrong = [hex(c) for c in planes[at : at + 4096] if CODEC.encode(x := form.replace("{}", chr(c))) != packed(TOKENIZER.encode(x, add_special_tokens=False).ids)]
                raise AssertionError((form, wrong[:50]))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=30))
def test_any_text_as_the_library(text):
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


def test_long_word_takes_the_same_merges():
    word = "abracadabra" * 60
    ids = TOKENIZER.encode(word, add_special_tokens=False).ids
    assert CODEC.encode(word) == struct.pack(f"<{len(ids)}I", *ids)


def test_special_tokens_survive_the_cache():
    small = bpe.Codec(open(WORDS, encoding="utf-8").read(), cache=900)
    for text in ("<|endoftext|> one two", "three four five six seven eight", "<|startoftext|>a<|endoftext|>"):
        ids = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert small.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_digests_of_odd_texts(odd, none):
    want = set()
    for r in odd.collect():
        ids = TOKENIZER.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in bpe.encode_digests(odd, WORDS).collect()} == want
    assert bpe.encode_digests(none, WORDS).collect() == [] and token_counts.count_tokens(none, PIECES).collect() == []


def test_a_worker_merges_a_large_vocabulary_once():
    counter, calls = token_counts.Counter(open(PIECES, "rb").read()), []
    merge = counter.merged
    counter.merged = lambda part: calls.append(part) or merge(part)
    syllables = ["er", "on", "th", "ing", "ble", "sh", "ou", "ly", "st", "ea", "re", "an", "ti", "es", "wh", "nd", "or", "at", "he", "ed"]
    text = " ".join(map("".join, itertools.product(syllables, syllables, syllables, syllables[:18])))
    first = counter.count(text)
    assert first == len(LIBRARY.encode(text)) and len(calls) > 100_000
    calls.clear()
    assert counter.count(text) == first and len(calls) < 1000


def test_each_new_chunk_is_cut_into_words_once():
    codec, calls = bpe.Codec(open(WORDS, encoding="utf-8").read()), []
    cut = codec.pieces
    codec.pieces = lambda chunk: calls.append(chunk) or cut(chunk)
    texts = ["the other's (cats), 42nd Größe!", "the CATS it's <|endoftext|>the"]
    assert [*codec.encode_many(texts)] == [packed(TOKENIZER.encode(x, add_special_tokens=False).ids) for x in texts]
    assert sorted(calls) == sorted({"the", "other's", "(cats),", "42nd", "Größe!", "CATS", "it's"})
