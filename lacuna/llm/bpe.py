"""BPE encoding and decoding over a contiguous rank array.

A word is held as the starts of its parts, their ids, and, for each part, the
rank of its merge with the next. The least rank is found by a scan, its
boundary is deleted, and the ranks of the two neighbours are refreshed. Words
longer than ``LONG_WORD`` parts take the same merges from a heap, since a scan
for each merge would cost the square of their length.

Cases: a null text counts as empty; an empty text has no ids and decodes to an
empty text; texts are encoded whole; strings of special tokens inside a text
become those tokens; repeated rows give repeated rows; further columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import TwoAgeCache, map_batches, slices

LONG_WORD = 256
#: Bytes of a worker's cache, of which there may be two; digests leave more room than ids and texts beside other stages.
CACHE, CACHE_OF_DIGESTS = 24 << 20, 64 << 20
NEVER = 1 << 60
SEPARATORS = regex.compile("[\x1c-\x1f]")
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"

# Where the Unicode versions of such tokenizers differ from those of Python and ``regex``.
#: Letters and numbers that they do not know as such.
UNKNOWN = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 "
    "1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 "
    "1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Marks that are starters to their normalisation, and signs that it does not compose.
STARTERS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A "
    "11930 11935 11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
#: Capitals (ranges) and the first's small letter.
CAPITALS = "1C89:1C8A A7CB:0264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:019B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def code_points(ranges: str) -> list[int]:
    return [c for x in ranges.split() for a, _, b in [x.partition("-")] for c in range(int(a, 16), int(b or a, 16) + 1)]


def any_of(ranges: str) -> str:
    """The inside of a set expression."""
    return "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split())


SMALL = {c: int(small, 16) + i for x in CAPITALS.split() for own, _, small in [x.partition(":")] for i, c in enumerate(code_points(own))}
RARE = regex.compile(f"[{any_of(UNKNOWN)}{any_of(STARTERS)}{any_of(' '.join(x.partition(':')[0] for x in CAPITALS.split()))}]")
BETWEEN = regex.compile(f"([{any_of(STARTERS)}])")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {}, 256
    for byte in range(256):
        if byte in own:
            letters[byte] = chr(byte)
        else:
            letters[byte], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


class Codec:
    """Encodes and decodes as the tokenizer file says."""

    def __init__(self, config: str, cache: int = CACHE):
        spec = json.loads(config)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or model["unk_token"] is not None:
            raise ValueError("not a lower-casing byte-level BPE file without a decoder")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        #: (left id, right id) in one number -> (rank and new id) in one number
        self.pairs = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.pairs[self.vocab[left] << 20 | self.vocab[right]] = rank << 20 | self.vocab[left + right]
        self.letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in self.letters], np.int64)
        self.final = np.array([self.vocab[c + self.suffix] for c in self.letters], np.int64)
        order = sorted(self.pairs)
        self.keys = np.array(order, np.int64)
        self.values = np.array([self.pairs[k] for k in order], np.int64)
        # White space never is in a word, so that replacing runs of it by one space changes no word.
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        known = lambda kind: f"[{kind}--[{any_of(UNKNOWN)}]]"
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if "[^\\s\\p{L}\\p{N}]" not in pattern or "[\\p{L}]+" not in pattern:
            raise ValueError("not the expected expression for words")
        #: The same for texts with signs of other Unicode versions.
        self.rare_word = regex.compile(pattern.replace("[^\\s\\p{L}\\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{any_of(UNKNOWN)}]]").replace("[\\p{L}]", known("\\p{L}")).replace("[\\p{N}]", known("\\p{N}")), regex.V1)
        self.marks = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: What stands between white space -> its packed ids
        self.chunks = TwoAgeCache(self.encode, cache)
        #: The same of the words in the chunks at hand
        self.words: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Words of one stretch without special tokens."""
        if text.isascii():
            # Letters alone are one word.
            return [text.lower()] if text.isalpha() else self.word.findall(text.lower())
        if not RARE.search(text):
            return self.word.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        text = "".join(unicodedata.normalize("NFC", x) for x in BETWEEN.split(text))
        return self.rare_word.findall(text.replace("Σ", "σ").translate(SMALL).lower())

    def prepare(self, words: Iterable[str]) -> None:
        """Merge distinct words, many at a time."""
        cache = self.words
        new = [w for w in {*words} if w not in self.special]
        short, data = [], []
        for word in new:
            raw = word.encode()
            if len(raw) <= LONG_WORD:
                short.append(word)
                data.append(raw)
        by_width: dict[int, list[int]] = {}
        for i, raw in enumerate(data):
            by_width.setdefault(max(8, 1 << (len(raw) - 1).bit_length()), []).append(i)
        for width, members in by_width.items():
            for at in range(0, len(members), 1 << 15):
                part = members[at : at + (1 << 15)]
                for i, ids in zip(part, self.merge_rows([data[i] for i in part], width)):
                    cache[short[i]] = ids

    def joined(self, words: list[str]) -> bytes:
        """The packed ids of a chunk's words."""
        look = self.words.get
        return b"".join([look(w) or self.packed(w) for w in words])

    def entry(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, word: str) -> bytes:
        if word in self.special:
            return self.entry([self.special[word]])
        raw = word.encode()
        if len(raw) <= LONG_WORD:
            return self.merge_rows([raw], max(8, len(raw)))[0]
        return self.entry(self.merge_long([*self.inner[[*raw[:-1]]].tolist(), int(self.final[raw[-1]])]))

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and new id of pairs, ``NEVER`` for those that don't merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NEVER)

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Each row of a matrix is a word's contiguous array; every step takes each row's least rank. Gives packed ids."""
        n = len(words)
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        ids = self.inner[raw]
        ids[np.arange(n), sizes - 1] = self.final[raw[np.arange(n), sizes - 1]]
        ranks = np.full((n, width), NEVER)
        ranks[:, :-1] = self.look(ids[:, :-1], ids[:, 1:])
        column = np.arange(width)
        ranks[column >= (sizes - 1)[:, None]] = NEVER
        out = [b""] * n
        names = np.arange(n)
        while len(names):
            rows = np.arange(len(names))
            spot = ranks.argmin(axis=1)
            least = ranks[rows, spot]
            done = least >= NEVER
            if done.any():
                # Of all rows at once, then cut: each has 4 * width bytes.
                flat = ids[done].astype("<u4").tobytes()
                for at, name, size in zip(range(0, len(flat), 4 * width), names[done].tolist(), sizes[done].tolist()):
                    out[name] = flat[at : at + 4 * size]
                keep = ~done
                names, ids, ranks, sizes, spot, least = names[keep], ids[keep], ranks[keep], sizes[keep], spot[keep], least[keep]
                rows = np.arange(len(names))
                if not len(names):
                    break
            ids[rows, spot] = least & 0xFFFFF
            # Delete the boundary after the part, and the rank across it.
            np.copyto(ids[:, :-1], ids[:, 1:], where=column[:-1] > spot[:, None])
            np.copyto(ranks[:, :-1], ranks[:, 1:], where=column[:-1] >= spot[:, None])
            sizes = sizes - 1
            has = spot < sizes - 1
            ranks[rows, spot] = NEVER
            ranks[rows[has], spot[has]] = self.look(ids[rows[has], spot[has]], ids[rows[has], spot[has] + 1])
            has = spot > 0
            ranks[rows[has], spot[has] - 1] = self.look(ids[rows[has], spot[has] - 1], ids[rows[has], spot[has]])
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges, lowest rank and then leftmost first, from a heap."""
        n, look = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i + 1]) for i in range(n - 1) if (r := look(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, was = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= n or look(ids[i] << 20 | ids[j]) != rank or ids[j] != was:
                continue
            ids[i], ids[j], after[i] = rank & 0xFFFFF, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := look(ids[i] << 20 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, ids[after[i]]))
            if before[i] >= 0 and (r := look(ids[before[i]] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, before[i], ids[i]))
        return [x for x in ids if x is not None]

    def split(self, text: str) -> list[str]:
        """Special tokens and what stands between white space, in order.

        Python's white space also has the separators 1C to 1F; a text with one of those is one chunk.
        """
        if self.marks is None or "<" not in text:
            return [text] if SEPARATORS.search(text) else text.split()
        return [w for part in (self.marks.split(text) if self.marks else [text]) for w in ([part] if part in self.special or SEPARATORS.search(part) else part.split())]

    def encode_many(self, texts: Sequence[str]) -> Iterable[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit numbers."""
        chunks, special, young = self.chunks, self.special, self.chunks.get
        for start, end in slices(texts):
            split = [self.split(x) for x in texts[start:end]]
            # All that the slice needs is held until its end, whatever the cache drops meanwhile.
            held = dict.fromkeys(chain.from_iterable(split))
            new: dict[str, list[str]] = {}
            for c in held:
                if (x := young(c) or chunks.find(c)) is None:
                    new[c] = [c] if c in special else self.pieces(c)
                else:
                    held[c] = x
            self.prepare(chain.from_iterable(new.values()))
            for c, words in new.items():
                held[c] = self.joined(words)
                chunks.put(c, held[c])
            for own in split:
                yield b"".join(map(held.__getitem__, own))
            self.words.clear()

    def encode(self, text: str) -> bytes:
        return next(iter(self.encode_many([text])))

    def decode(self, ids: bytes) -> str:
        """The tokens of packed ids joined by a space (such files have no decoder)."""
        return " ".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


@lru_cache(maxsize=2)
def codec(config: str, cache: int = CACHE) -> Codec:
    return Codec(config, cache)


def _config(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, the packed ids and the decoded text."""
    config = _config(docs, tokenizer_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        one = codec(config.value)
        out = list(one.encode_many([x or "" for x in batch.column(1).to_pylist()]))
        return pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary()), pa.array([one.decode(x) for x in out], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return map_batches(docs, [id_col, text_col], run, SCHEMA)


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests in place of ids and text, taken in the same pass."""
    config = _config(docs, tokenizer_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        one = codec(config.value, CACHE_OF_DIGESTS)
        sizes, ids, texts = [], [], []
        for packed in one.encode_many([x or "" for x in batch.column(1).to_pylist()]):
            sizes.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            texts.append(hashlib.sha256(one.decode(packed).encode()).hexdigest())
        return pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs, [id_col, text_col], run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
