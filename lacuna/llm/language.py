"""Language identification with a string kernel.

The kernel of two texts is the number of distinct 1- to 3-grams both have
(presence, blended spectrum), over the square root of the product of their own
numbers. Grams are over lower-case letters, with anything else as a word mark,
and share ``DIMENSIONS`` hashed places. Landmarks from the labelled sample give
a Nyström map, on which a one-versus-rest kernel ridge regression is solved.
Texts are scored in batches: presence rows times landmark columns gives their
kernel rows, and those times the coefficients give a score for each language.

The learning sample: about ``per_language`` labelled texts of each language
(those whose hashed id falls under a threshold set from the language's count),
of at most ``most_chars`` characters. These bounds do not touch prediction:
every text is scored whole.

Cases: a null text or one without a letter is ``und`` with score 0; with no
labelled text at all, so is every text; rows with a null id are never learned
from and count as held out; repeated rows give repeated rows; ties between
languages go to the first in alphabetical order; further columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

DIMENSIONS = 1 << 14
SHIFT = np.uint32(32 - 14)
# Odd multipliers for hashing grams.
M1, M2, M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
ROWS = 256
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 0/1 row for each text over the hashed grams, and whether it has a letter."""
    parts = [f" {x.lower()} " for x in texts]
    sizes = np.array([len(x) for x in parts])
    codes = letters()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(parts), dtype=np.int64) * DIMENSIONS, sizes)
    flags = np.zeros(len(parts) * DIMENSIONS, np.uint8)
    flags[row + (codes * M1 >> SHIFT)] = 1
    pair = codes[:-1] * M1 ^ codes[1:] * M2
    pair ^= pair >> np.uint32(15)
    flags[row[:-1] + (pair * M3 >> SHIFT)] = 1
    triple = pair[:-1] * M3 + codes[2:] * M1
    triple ^= triple >> np.uint32(13)
    # Grams over the end of a text count to it as word marks: the next text starts with one, and its first letter is shut out.
    ends = np.cumsum(sizes)[:-1]
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = False
    inside[np.maximum(ends - 2, 0)] = False
    flags[(row[:-2] + (triple * M2 >> SHIFT))[inside[:-2]]] = 1
    spoken = np.add.reduceat(codes > 0, np.concatenate([[0], ends])) > 0 if len(codes) else np.zeros(0, bool)
    return flags.reshape(len(parts), DIMENSIONS), spoken


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits
    norms: np.ndarray
    coefficients: np.ndarray
    sharpness: float

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        own = np.sqrt(np.maximum(x.sum(axis=1), 1))
        return x @ self.columns() / own[:, None] / self.norms

    def columns(self) -> np.ndarray:
        if not hasattr(self, "_columns"):
            self._columns = np.ascontiguousarray(np.unpackbits(self.landmarks, axis=1).astype(np.float32).T)
        return self._columns

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_columns"}

    def scores(self, rows: np.ndarray) -> np.ndarray:
        k = self.kernel(rows)
        return np.hstack([k, np.ones((len(k), 1), np.float32)]) @ self.coefficients

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, values = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, values
        whole = [x or "" for x in texts]
        for a, b in slices(whole):
            for start in range(a, b, ROWS):
                end = min(b, start + ROWS)
                rows, spoken = presence(whole[start:end])
                s = self.scores(rows).astype(np.float64) * self.sharpness
                s = np.exp(s - s.max(axis=1, keepdims=True))
                s /= s.sum(axis=1, keepdims=True)
                best = s.argmax(axis=1)
                for i, (j, ok) in enumerate(zip(best.tolist(), spoken.tolist())):
                    if ok:
                        names[start + i], values[start + i] = self.languages[j], float(s[i, j])
        return names, values


def fit(texts: list[str], langs: list[str], landmarks: int = 192, ridge: float = 1e-2, sharpness: float = 6.0) -> Model:
    """Nyström landmarks, the same number of each language, and ridge regression on all texts."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((0, 0), np.uint8), np.zeros(0), np.zeros((0, 0)), sharpness)
    rows = np.concatenate([presence(texts[i : i + ROWS])[0] for i in range(0, len(texts), ROWS)])
    each = max(1, landmarks // len(names))
    chosen = [i for name in names for i in [j for j, x in enumerate(langs) if x == name][:each]]
    marks = rows[chosen]
    model = Model(names, np.packbits(marks, axis=1), np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.float32), 1)), np.zeros((0, 0)), sharpness)
    k = np.concatenate([model.kernel(rows[i : i + ROWS]) for i in range(0, len(rows), ROWS)]).astype(np.float64)
    value, vector = np.linalg.eigh(k[chosen])
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    z = np.hstack([k @ root, np.ones((len(k), 1))])
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Each language weighs the same, however often it occurs in the sample.
    weight = np.array([1 / langs.count(x) for x in names])[[names.index(x) for x in langs]][:, None] * len(langs) / len(names)
    w = np.linalg.solve(z.T @ (z * weight) + ridge * np.eye(z.shape[1]), z.T @ (y * weight))
    model.coefficients = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == fold, F.lit(True))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, most_chars: int = 20_000) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where(~held_out("id") & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    sample = rows.where((place < share[F.col("lang")]) & F.col("text").isNotNull() & (F.length("text") <= most_chars))
    found = sorted((r["id"], r["lang"], r["text"]) for r in sample.collect())
    return fit([x[2] for x in found], [x[1] for x in found])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, and the columns of ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [docs.schema[c] for c in keep]
    carried = [i for i, f in enumerate(kept) if f.name != text_col]
    schema = SCHEMA + "".join(f", `kept_{i}` {f.dataType.simpleString()}" for i, f in enumerate(kept))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(batch.column(1).to_pylist())
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *[batch.column(1) if i not in carried else batch.column(3 + carried.index(i)) for i in range(len(kept))]], names=["doc_id", "held_out", "lang_pred", "score", *[f"kept_{i}" for i in range(len(kept))]])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held_out"), *[F.col(f"`{kept[i].name}`").alias(f"kept_{i}") for i in carried])
    out = map_batches(rows, rows.columns, run, schema)
    return out.select("doc_id", "held_out", "lang_pred", "score", *[F.col(f"kept_{i}").alias(f.name) for i, f in enumerate(kept)])
