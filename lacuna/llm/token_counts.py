"""Token counts: heap-and-linked-list byte-pair merging.

A word's characters are the nodes of a doubly linked list. Every adjacent pair
whose concatenation is in the vocabulary lies on a heap by its rank; the lowest
rank is popped, its two nodes become one and the new neighbours' pairs are
pushed. The number of tokens is the number of initial symbols less the merges;
no identifier is made. A symbol outside the vocabulary that is left counts its
UTF-8 bytes (byte fallback).

Merging never crosses a place where no vocabulary entry has the two characters
side by side, so a text is cut there first and each distinct cut is merged once
for each worker (a bounded cache holds the counts).

Cases: a null text counts as empty; an empty text has 0 tokens; texts of any
length are counted whole; repeated rows give repeated rows; further columns of
the input are not read, so their names cannot clash; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import re
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TwoAgeCache, map_batches

# Fixed values of the vocabulary file's format (a protocol buffer).
SPACE = "▁"
PIECES, NORMALIZER = 1, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
NORMAL = 1
UNUSED_OR_USER = (4, 5)
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA = 2, 3, 4

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            size = varint()
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Counter:
    """Counts tokens under one vocabulary."""

    def __init__(self, model: bytes, cache: int = 64 << 20):
        scored, norm = [], {}
        for number, value in fields(model):
            if number == PIECES:
                piece = dict(fields(value))
                kind = piece.get(PIECE_TYPE, NORMAL)
                if kind in UNUSED_OR_USER:
                    raise ValueError("vocabularies with unused or user-defined pieces are not supported")
                if kind == NORMAL:
                    scored.append((piece.get(PIECE_SCORE, 0.0), piece[PIECE_TEXT].decode()))
            elif number == NORMALIZER:
                norm = dict(fields(value))
        if norm.get(CHARSMAP) or norm.get(REMOVE_EXTRA, 1):
            raise ValueError("only identity normalisation that keeps white space is supported")
        self.prefix = SPACE if norm.get(DUMMY_PREFIX, 1) else ""
        scored.sort(key=lambda x: -x[0])
        self.rank = {piece: i for i, (_, piece) in enumerate(scored)}
        self.beside = {piece[i : i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        self.known = {piece for piece in self.rank if len(piece) == 1}
        self.cut = self.cutter()
        self.words, self.parts = TwoAgeCache(self.chunk, cache), TwoAgeCache(self.part, cache // 2)

    def cutter(self) -> re.Pattern | None:
        """An expression for stretches that no entry joins: signs apart from words, both after their spaces."""
        if any(pair[1] == SPACE != pair[0] for pair in self.beside):
            return None
        signs = {c for c in map(chr, range(9, 127)) if not c.isalnum() and c != " "}
        letters = {c for c in map(chr, range(65, 592)) if c.isalpha()}
        letters -= {c for pair in self.beside for c, d in (pair, pair[::-1]) if d in signs}
        signs, letters = (re.escape("".join(sorted(x))) for x in (signs, letters))
        # A run of either kind ends where the other kind or a space follows; whatever else stays whole up to the next space.
        return re.compile(f"{SPACE}*[{letters}]++(?![^{SPACE}{signs}])|{SPACE}*[{signs}]++(?![^{SPACE}{letters}])|{SPACE}*[^{SPACE}]+|{SPACE}+")

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.cut is None:
            return self.merged(self.prefix + text.replace(" ", SPACE))
        chunks = text.split(" ")
        if not self.prefix or "" in chunks or SPACE in text:
            return self.chunk((self.prefix + text.replace(" ", SPACE))[1:] if self.prefix else text.replace(" ", SPACE), self.prefix)
        return sum(map(self.words.__getitem__, chunks))

    def chunk(self, chunk: str, before: str = SPACE) -> int:
        """Tokens of what stands between two spaces, with the space before it."""
        return sum(map(self.parts.__getitem__, self.cut.findall(before + chunk)))

    def part(self, part: str) -> int:
        """Cut where no entry could hold both neighbours, then merge each piece."""
        total, start, beside = 0, 0, self.beside
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in beside:
                total += self.merged(part[start:i])
                start = i
        return total + self.merged(part[start:])

    def merged(self, part: str) -> int:
        """Initial symbols less merges, plus what byte fallback adds.

        A node is known by where it starts: ``end`` has where it ends, which is
        where the next one starts (0: the node is gone), ``before`` where the
        one before it starts. A heap entry packs rank, start and end of a pair.
        """
        n, get = len(part), self.rank.get
        bits = (n + 1).bit_length()
        mask = (1 << bits) - 1
        end, before = [*range(1, n + 1), 0], list(range(-1, n))
        heap = [((r << bits | i) << bits) | i + 2 for i in range(n - 1) if (r := get(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            key = pop(heap)
            e, s = key & mask, key >> bits & mask
            m = end[s]
            if not m or end[m] != e:  # stale: a node is gone or has grown since
                continue
            end[s], end[m] = e, 0
            merges += 1
            if e < n:
                before[e] = s
                far = end[e]
                r = get(part[s:far])
                if r is not None:
                    push(heap, ((r << bits | s) << bits) | far)
            p = before[s]
            if p >= 0:
                r = get(part[p:e])
                if r is not None:
                    push(heap, ((r << bits | p) << bits) | e)
        if self.known.issuperset(part):
            return n - merges
        return n - merges + sum(len(part[s].encode()) - 1 for s in range(n) if end[s] == s + 1 and part[s] not in self.known)


@lru_cache(maxsize=2)
def counter(model: bytes) -> Counter:
    return Counter(model)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: doc_id, UTF-8 bytes, tokens, and whether they exceed ``limit``.

    The vocabulary file (a few hundred kilobytes, read by the driver) is sent
    to the executors once.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(model.value).count
        texts = [x or "" for x in batch.column(1).to_pylist()]
        tokens = [count(x) for x in texts]
        return pa.record_batch(
            [batch.column(0).cast(pa.int64()), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_batches(docs, [id_col, text_col], run, SCHEMA)
