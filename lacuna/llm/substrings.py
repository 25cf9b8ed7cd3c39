"""Substring dedup: words covered by a window of words that an earlier document has too.

A window is ``WINDOW`` consecutive words. Which windows recur is decided in
shards, each with its own compressed FM-index, over which the windows of the
shard's texts are searched backwards; those whose suffix range holds a document
with a smaller id are reported.

So that a shard holds all that its windows can match and no more, a window goes
by its minimizer, the least hash of the ``GRAM``-word grams within it: equal
windows have equal minimizers, and neighbours mostly share one, so that a run
of them travels as one segment.

1. Documents are dealt to buckets. Each bucket sends every shard the distinct
   minimizers it has (eight bytes each), with whether two of its documents have it.
2. The shard answers which of them recur among documents: 0 no, 1 yes, 2 in so
   many buckets that its windows are dealt out by their own hash.
3. The bucket sends the segments of recurring minimizers, each distinct one once
   with the least document that has it.
4. The shard indexes the distinct segments, searches their windows and answers a
   bit for each window of each segment.
5. The bucket takes the covered words out.

All five steps read the documents from one shuffle. What a shard gets of a
passage is bounded by the number of buckets, not of documents. A bucket sends a
shard one piece, and none if it has nothing for it: the number of pieces grows
faster than the input, up to one for each distinct minimizer of a bucket.

The windows of the segments stream through their shard's index. A search goes on
backwards as long as more than the window's own place matches, and stops at
``WINDOW`` words: matching statistics up to the threshold, of which those that
reach it are reported.

Cases: a null text has no words; a text shorter than a window keeps all; null
ids come after all others and never make another document's words go; rows of
equal ids do not make each other's words go; repeated rows give repeated rows;
columns not named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released
from .fmindex import FMIndex

WINDOW, GRAM = 13, 5
NO_ID = np.int64(2**63 - 1)
#: Word hashes are cut to 48 bits.
WORD_BYTES = 6
#: A minimizer that more buckets have is dealt out window by window.
CROWD = 64
DOCS_PER_BUCKET, BYTES_PER_BUCKET, BYTES_PER_SHARD = 1024, 4 << 20, 12 << 20
POWERS = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64))
PIECES = "shard int, bucket int, data binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the runs that start where ``change`` is true."""
    first = np.flatnonzero(change)
    return first, np.diff(np.append(first, len(change)))


@dataclass
class Bucket:
    """The words of a bucket's documents, and their windows."""

    ids: np.ndarray
    split: list[list[bytes]]
    words: np.ndarray
    window: np.ndarray  # first word of each window
    owner: np.ndarray  # id of the document of each window
    key: np.ndarray  # minimizer of each window
    joint: np.ndarray  # whether a window goes on from the one before, with its minimizer

    @classmethod
    def read(cls, docs: pa.Table) -> Bucket:
        ids = docs.column("doc_id").fill_null(NO_ID).to_numpy()
        split = [(x or "").encode().split() for x in docs.column("text").to_pylist()]
        sizes = np.array([len(x) for x in split], np.int64)
        words = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, int(sizes.sum())) >> np.uint64(16)
        n = len(words) - WINDOW + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return cls(ids, split, words, none, none, np.zeros(0, np.uint64), np.zeros(0, bool))
        row = np.repeat(np.arange(len(ids)), sizes)
        gram = words[: len(words) - GRAM + 1].copy()
        for i in range(1, GRAM):
            gram += words[i : len(words) - GRAM + 1 + i] * POWERS[i]
        least = sliding_min(mix(gram), WINDOW - GRAM + 1)
        window = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
        key = mix(least[window])
        joint = np.zeros(len(window), bool)
        joint[1:] = (np.diff(window) == 1) & (row[window[1:]] == row[window[:-1]]) & (key[1:] == key[:-1])
        return cls(ids, split, words, window, ids[row[window]], key, joint)

    def keys(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct minimizers, their shards, whether two documents have it), by shard and minimizer."""
        order = np.lexsort((self.owner, self.key))
        key, owner = self.key[order], self.owner[order]
        first, length = runs(np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool))
        several = owner[first] != owner[first + length - 1]
        key = key[first]
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return key[order], shard[order], several[order]

    def segments(self, codes: np.ndarray, keys: np.ndarray, shards: int) -> Segments:
        """Runs of windows whose minimizer recurs; single windows where it is crowded."""
        order = np.argsort(keys)
        code = codes[order][np.searchsorted(keys[order], self.key)] if len(keys) else np.zeros(0, np.uint8)
        kept = np.flatnonzero(code)
        change = ~self.joint[kept] | (code[kept] == 2)
        at, count = runs(change)
        first = kept[at]
        length = count + WINDOW - 1
        start = self.window[first]
        shard = (self.key[first] % np.uint64(shards)).astype(np.int64)
        crowded = code[first] == 2
        own = np.zeros(int(crowded.sum()), np.uint64)
        for i in range(WINDOW):
            own += self.words[start[crowded] + i] * POWERS[i]
        shard[crowded] = (mix(own) % np.uint64(shards)).astype(np.int64)
        content = fold(self.words, start, length)
        order = np.lexsort((self.owner[first], content, shard))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (content[order][1:] != content[order][:-1]) | (shard[order][1:] != shard[order][:-1])
        distinct = order[fresh]  # of each content the instance of the least document
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        return Segments(first, count, start, length, shard[distinct], distinct, which)


@dataclass
class Segments:
    first: np.ndarray  # first window of each
    count: np.ndarray  # windows
    start: np.ndarray  # first word
    length: np.ndarray  # words
    shard: np.ndarray  # of the distinct ones, in their order
    distinct: np.ndarray  # an instance of each distinct one
    which: np.ndarray  # the distinct one of each


def stretch(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


def fold(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each range's words and length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    edge = np.cumsum(length) - length
    place = (np.arange(int(length.sum())) - np.repeat(edge, length)).astype(np.uint64)
    return mix(np.add.reduceat(mix(words[stretch(start, length)] + (place + np.uint64(1)) * POWERS[0]), edge) + length.astype(np.uint64))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each after its size in bytes."""
    parts = []
    for a in arrays:
        raw = a.tobytes()
        parts += [len(raw).to_bytes(4, "little"), raw]
    return b"".join(parts)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at + 4))
        at += 4 + size
    return out


def pieces(shard, bucket, data) -> pa.Table:
    return pa.table({"shard": pa.array(shard, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "data": pa.array(data, pa.binary())})


def send_keys(docs: pa.Table, shards: int) -> pa.Table:
    key, shard, several = Bucket.read(docs).keys(shards)
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, np.int64)
    parts = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
    return pieces([int(shard[a]) for a, _ in parts], [docs.column("bucket")[0].as_py()] * len(parts), [pack(key[a:b], np.packbits(several[a:b])) for a, b in parts])


def answer_keys(sent: pa.Table, crowd: int) -> pa.Table:
    got = [unpack(x, np.uint64, np.uint8) for x in sent.column("data").to_pylist()]
    key = np.concatenate([k for k, _ in got])
    several = np.concatenate([np.unpackbits(s, count=len(k)) for k, s in got])
    names, place, count = np.unique(key, return_inverse=True, return_counts=True)
    recurs = count > 1
    recurs[place[several == 1]] = True
    code = np.where(count > crowd, 2, recurs.astype(np.uint8)).astype(np.uint8)[place]
    edge = np.cumsum([0, *(len(k) for k, _ in got)])
    return pieces(sent.column("shard").to_pylist(), sent.column("bucket").to_pylist(), [pack(np.packbits(code[a:b] > 0), np.packbits(code[a:b] > 1)) for a, b in zip(edge, edge[1:])])


def codes_of(answers: dict[int, bytes], shard: np.ndarray) -> np.ndarray:
    """The code of each minimizer sent, in the order of ``Bucket.keys``."""
    out = np.zeros(len(shard), np.uint8)
    for name, a, b in spans(shard):
        yes, much = unpack(answers[name], np.uint8, np.uint8)
        out[a:b] = np.unpackbits(yes, count=b - a) + np.unpackbits(much, count=b - a)
    return out


def spans(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of a sorted array."""
    if not len(sorted_):
        return []
    cut = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]])).tolist()
    return [(int(sorted_[a]), a, b) for a, b in zip(cut, cut[1:])]


def send_segments(docs: pa.Table, answers: pa.Table, shards: int) -> pa.Table:
    bucket = Bucket.read(docs)
    key, shard, _ = bucket.keys(shards)
    found = bucket.segments(codes_of(dict(zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist())), shard), key, shards)
    out = []
    for name, a, b in spans(found.shard):
        pick = found.distinct[a:b]
        length = found.length[pick]
        words = bucket.words[stretch(found.start[pick], length)]
        raw = words.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
        out.append((name, pack(length.astype(np.uint32), bucket.owner[found.first[pick]], np.ascontiguousarray(raw))))
    return pieces([x[0] for x in out], [docs.column("bucket")[0].as_py()] * len(out) if out else [], [x[1] for x in out])


def answer_segments(sent: pa.Table) -> pa.Table:
    """Index the distinct segments and search their windows."""
    got = [unpack(x, np.uint32, np.int64, np.uint8) for x in sent.column("data").to_pylist()]
    length = np.concatenate([x[0] for x in got]).astype(np.int64)
    owner = np.concatenate([x[1] for x in got])
    raw = np.zeros((int(length.sum()), 8), np.uint8)
    raw[:, :WORD_BYTES] = np.concatenate([x[2] for x in got]).reshape(-1, WORD_BYTES)
    words = raw.view(np.uint64).ravel()
    start = np.cumsum(length) - length
    content = fold(words, start, length)
    _, pick, which = np.unique(content, return_index=True, return_inverse=True)
    least = np.full(len(pick), NO_ID)
    np.minimum.at(least, which, owner)
    # The index: distinct segments, each after a parting symbol.
    size = length[pick]
    names, symbol = np.unique(words[stretch(start[pick], size)], return_inverse=True)
    begin = np.cumsum(size + 1) - size
    text = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
    text[stretch(begin, size)] = symbol + 1
    index = FMIndex(text, len(names) + 1)
    windows = size - WINDOW + 1
    at = stretch(begin, windows)
    low, high = index.search(text, at, WINDOW)
    # The least document over each range that holds more than the window's own place.
    earliest = np.repeat(least, windows)
    wide = high - low > 1
    if wide.any():
        doc = np.empty(len(text) + 1, np.int64)
        holder = np.repeat(np.arange(len(size)), size + 1)
        doc[: len(text)] = np.append(least[holder], NO_ID)[index.places]
        doc[-1] = NO_ID
        left, same = np.unique(low[wide], return_inverse=True)
        right = np.zeros(len(left), np.int64)
        right[same] = high[wide]
        earliest[wide] = np.minimum.reduceat(doc, np.stack([left, right], axis=1).ravel())[::2][same]
    first = np.cumsum(windows) - windows
    covered = earliest[stretch(first[which], windows[which])] < np.repeat(owner, windows[which])
    edge = np.concatenate([[0], np.cumsum(windows[which])])[np.cumsum([0, *(len(x[0]) for x in got)])]
    return pieces(sent.column("shard").to_pylist(), sent.column("bucket").to_pylist(), [pack(np.packbits(covered[a:b])) for a, b in zip(edge, edge[1:])])


def covered_words(docs: pa.Table, answers: pa.Table, shards: int) -> tuple[Bucket, np.ndarray]:
    """The bucket and, for each of its words, whether it goes."""
    bucket = Bucket.read(docs)
    key, shard, _ = bucket.keys(shards)
    rows = list(zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column("data").to_pylist()))
    found = bucket.segments(codes_of({s: d for k, s, d in rows if k == 0}, shard), key, shards)
    masks = {s: d for k, s, d in rows if k == 1}
    count = found.count[found.distinct]
    mask = np.zeros(int(count.sum()), bool)
    edge = np.concatenate([[0], np.cumsum(count)])
    for name, a, b in spans(found.shard):
        (bits,) = unpack(masks[name], np.uint8)
        mask[edge[a] : edge[b]] = np.unpackbits(bits, count=int(edge[b] - edge[a]))
    owner = bucket.owner[found.first]
    later = owner > owner[found.distinct][found.which]
    goes = mask[stretch(edge[:-1][found.which], found.count)] | np.repeat(later, found.count)
    first = bucket.window[stretch(found.first, found.count)[goes]]
    step = np.zeros(len(bucket.words) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + WINDOW, -1)
    return bucket, np.cumsum(step[:-1]) > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), with_text: bool = False, crowd: int = CROWD, docs_per_bucket: int = DOCS_PER_BUCKET, bytes_per_shard: int = BYTES_PER_SHARD) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256.

    ``with_text`` adds what is left (text: as it was where nothing goes, else
    the words left, joined by one space), ``keep`` adds columns of ``docs``.
    """
    kept = [docs.schema[c] for c in keep]
    columns = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{f.name}`").alias(f"kept_{i}") for i, f in enumerate(kept)]]
    size = docs.select(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-size["n"] // docs_per_bucket), -(-size["b"] // BYTES_PER_BUCKET))
    shards = max(1, -(-size["b"] // bytes_per_shard))
    rows = docs.select(*columns).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))

    codes = (
        rows.groupBy("bucket").applyInArrow(lambda t: released(send_keys, t, shards), PIECES)
        .groupBy("shard").applyInArrow(lambda t: released(answer_keys, t, crowd), PIECES)
    )
    masks = (
        rows.groupBy("bucket").cogroup(codes.groupBy("bucket")).applyInArrow(lambda d, a: released(send_segments, d, a, shards), PIECES)
        .groupBy("shard").applyInArrow(lambda t: released(answer_segments, t), PIECES)
    )
    answers = codes.withColumn("kind", F.lit(0)).unionByName(masks.withColumn("kind", F.lit(1)))

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        bucket, goes = covered_words(table, answers, shards)
        edge = np.cumsum([0, *(len(x) for x in bucket.split)])
        left, gone, texts = [], [], []
        for own, a, b, text in zip(bucket.split, edge[:-1].tolist(), edge[1:].tolist(), table.column("text").to_pylist()):
            off = goes[a:b]
            n = int(off.sum())
            stays = own if not n else [w for w, g in zip(own, off.tolist()) if not g]
            data = b" ".join(stays)
            left.append(hashlib.sha256(data).hexdigest())
            gone.append(n)
            if with_text:
                texts.append(data.decode() if n else text)
        out = {"doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(edge), pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(left, pa.string())}
        if with_text:
            out["text"] = pa.array(texts, pa.string())
        return pa.table(out | {f"kept_{i}": table.column(f"kept_{i}") for i in range(len(kept))})

    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
    for i, f in enumerate(kept):
        schema.add(f"kept_{i}", f.dataType)
    done = rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(lambda d, a: released(finish, d, a), schema)
    return done.select(*done.columns[: 4 + with_text], *[F.col(f"kept_{i}").alias(f.name) for i, f in enumerate(kept)])


#: DuckDB SQL for the registered query.
ORACLE = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, hash(array_to_string(words[i : i + 12], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split)
), firsts AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
covered AS (
  SELECT DISTINCT w.doc_id, w.i + k AS i FROM windows w JOIN firsts USING (h), range(13) AS r(k) WHERE d < w.doc_id
), gone AS (SELECT doc_id, list(i) AS spots FROM covered GROUP BY doc_id)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: spots IS NULL OR NOT list_contains(spots, x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id
"""
