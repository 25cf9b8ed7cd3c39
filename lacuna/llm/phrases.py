"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up. On each level runs of one symbol become one symbol;
then deterministic coin tossing names every symbol by the lowest bit in which
it differs from the one before and that bit, again and again until few names
are left; a phrase starts where such a name is greater than both neighbours'.
Whether it does depends on a few symbols to either side only, so equal
substrings are cut alike inside, at whatever offset they stand. A phrase's name
is a hash of its symbols' names, and phrases are the symbols of the next level.

The fingerprint holds the least ``KEPT`` hashes of the distinct phrase names of
levels ``LOWEST`` and up. The likeness of two fingerprints estimates the share
of phrases in common (twice those in both, over those of either added up).

Cases: a null text counts as empty; empty texts have an empty fingerprint,
alike to each other and to nothing else; equal texts have equal fingerprints;
the document after another is the next by id, then text; null ids come last;
the next of the last is the first, of an only document itself; repeated rows
are documents of their own; further columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

KEPT, LOWEST, LEVELS = 64, 2, 12
SLICE = 600_000
BYTES_PER_PART, MOST_PARTS = 8 << 20, 20_000
LAST = 2**63 - 1
#: Lowest set bit of each number under 256.
LOW = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25)
    return x ^ x >> np.uint64(32)


def coin_toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels under 6 in which neighbours of a document differ, as they do in ``x``."""
    differ = np.empty_like(x)
    differ[1:] = x[1:] ^ x[:-1]
    differ[first] = 1
    low = np.bitwise_count((differ & (np.uint64(0) - differ)) - np.uint64(1))
    label = (low << np.uint8(1)) | (x >> low & np.uint64(1)).astype(np.uint8)
    for _ in range(3):
        differ8 = np.empty_like(label)
        differ8[1:] = label[1:] ^ label[:-1]
        differ8[first] = 1
        low = LOW[differ8]
        label = (low << np.uint8(1)) | (label >> low & np.uint8(1))
    return label


def parse_level(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and documents of the next level's symbols."""
    n = len(x)
    start = np.ones(n, bool)
    start[1:] = doc[1:] != doc[:-1]
    fresh = start.copy()
    fresh[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(fresh)
    if len(at) < n:
        length = np.diff(np.append(at, n))
        x, doc, start = x[at], doc[at], start[at]
        long = length > 1
        x[long] = mix(x[long] + length[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # Two runs of one symbol never touch, so that neighbours still differ (but for a clash of hashes).
        clash = np.zeros(len(x), bool)
        clash[1:] = (x[1:] == x[:-1]) & ~start[1:]
        if clash.any():
            x[clash] = ~x[clash]
        n = len(x)
    label = coin_toss(x, np.flatnonzero(start))
    cut = start.copy()
    if n > 2:
        cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~start[2:]
    at = np.flatnonzero(cut)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    name = np.add.reduceat(mix(x + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), at)
    return mix(name), doc[at]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The least hashes of each text's phrase names, ascending."""
    out: list[np.ndarray] = []
    for a, b in slices(texts, SLICE):
        out += _sketches(texts[a:b])
    return out


def _sketches(texts: list[str]) -> list[np.ndarray]:
    sizes = np.array([len(x) for x in texts])
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    names, owners = [], []
    for level in range(1, LEVELS + 1):
        if not len(x):
            break
        x, doc = parse_level(x, doc)
        if level >= LOWEST:
            names.append(x)
            owners.append(doc)
            alone = np.bincount(doc, minlength=len(texts))[doc] == 1
            if alone.all():
                break
            # A text that has become one phrase is done.
            x, doc = x[~alone], doc[~alone]
    if not names:
        return [np.zeros(0, np.uint32)] * len(texts)
    key = np.unique(np.concatenate(owners).astype(np.uint64) << np.uint64(32) | mix(np.concatenate(names)) >> np.uint64(32))
    owner = (key >> np.uint64(32)).astype(np.int64)
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    value = key.astype(np.uint32)
    return [value[i : min(j, i + KEPT)] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From the least hashes of either: the share in both j, and from it 2 j / (1 + j)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = np.flatnonzero(both[1:] == both[:-1])
    distinct = len(both) - len(twice)
    least = min(KEPT, distinct)
    # The number of common hashes among the least of the union.
    within = twice - np.arange(len(twice)) < least
    j = int(within.sum()) / least
    return 2 * j / (1 + j)


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, after: str) -> str:
    """The last quarter replaced by as much of the next text's beginning."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + after[:quarter]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its fingerprint, that of its edited text, and how like both and the next row's are.

    Rows are dealt out by ranges of ids whose first ids are known; the row that
    starts a range also goes, marked, to the end of the range before it (the
    first of all to the end of the last), so that each row meets its next one
    within a task, which reads its rows as a stream.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    size = rows.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.min("doc_id").alias("least")).first()
    parts = max(1, min(MOST_PARTS, -(-size["b"] // BYTES_PER_PART)))
    firsts = [size["least"] if size["least"] is not None else LAST]
    if parts > 1 and size["least"] is not None:
        # These are ids of the table, so that each starts its range.
        found = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("p")).first()["p"]
        firsts = sorted({*firsts, *found})
    heads = np.array(firsts, np.int64)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def targets(ids: pd.Series) -> pd.Series:
        value = ids.fillna(LAST).to_numpy(np.int64) if ids.dtype != np.int64 else ids.to_numpy()
        own = np.maximum(np.searchsorted(heads, value, side="right") - 1, 0)
        starts = heads[own] == value
        return pd.Series([[p, ~((p - 1) % len(heads))] if s else [p] for p, s in zip(own.tolist(), starts.tolist())])

    dealt = rows.select(F.explode(targets(F.coalesce("doc_id", F.lit(LAST)))).alias("t"), "doc_id", "text")
    dealt = dealt.select(F.when(F.col("t") < 0, F.bitwise_not("t")).otherwise(F.col("t")).alias("part"), (F.col("t") < 0).alias("extra"), "doc_id", "text")
    sorted_ = dealt.repartition(len(heads), "part").sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def results() -> pa.RecordBatch | None:
            """Of the rows held, those whose next one is there; the last stays."""
            nonlocal held
            done = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
            texts = [x[3] for x in held]
            changed = [edited(texts[i], texts[i + 1]) for i in done]
            needed = sorted({*done, *(i + 1 for i in done)})
            own = dict(zip(needed, sketches([texts[i] for i in needed])))
            new = sketches(changed)
            out = pa.record_batch(
                [
                    pa.array([held[i][2] for i in done], pa.int64()),
                    pa.array([len(texts[i]) for i in done], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                    pa.array([text_of(own[i]) for i in done], pa.string()),
                    pa.array([text_of(x) for x in new], pa.string()),
                    pa.array([likeness(own[i], x) for i, x in zip(done, new)], pa.float64()),
                    pa.array([likeness(own[i], own[i + 1]) for i in done], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            held = held[-1:]
            return out if done else None

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size > 4 * SLICE:
                    size = 0
                    if (out := results()) is not None:
                        yield out
        if held and (out := results()) is not None:
            yield out

    return sorted_.mapInArrow(run, SCHEMA)
