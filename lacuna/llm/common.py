"""What the operators share: Arrow row maps, bounded caches, text slices."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts handled together in numpy, in characters; only memory depends on it.
SLICE_CHARS = 1_000_000
#: Rows of an Arrow batch handled together; what is made of them is handed on before the next ones.
ROWS = 512


class TwoAgeCache(dict):
    """A dict that computes missing values and keeps about ``2 * most_bytes`` of keys and values.

    When the young half is full it becomes the old half; values found in the
    old half move back, so that frequent keys stay. Lookups of present keys run
    at the speed of a plain dict. Keys longer than ``longest`` are not kept.
    """

    #: What an entry takes besides the characters of its key and of what its value holds.
    ENTRY = 200

    def __init__(self, compute: Callable, most_bytes: int = 8 << 20, longest: int = 64):
        super().__init__()
        self.compute, self.most_bytes, self.longest, self.held, self.old = compute, most_bytes, longest, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def find(self, key):
        """The value if it is kept, else None; one from the old half moves back."""
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) > self.longest:
            return
        if self.held >= self.most_bytes:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)


def release() -> None:
    """Give memory that is free but held back to the system: workers live on from one task to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def released(fn: Callable[..., pa.Table], *given) -> pa.Table:
    """What ``fn`` makes of a group of rows; all else that it took is given back once its variables are gone."""
    try:
        return fn(*given)
    finally:
        release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, columns: Sequence[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """Apply ``fn`` to Arrow batches of just ``columns``; a narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the caches hold no cycles, and walking them again and again is slow
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    out = fn(batch.slice(at, ROWS))
                    if out is not None:
                        yield out
        finally:
            gc.enable()
            release()

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def slices(texts: Sequence[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``chars`` characters each."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
