"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are the shares of its
kinds of characters, its length, and the same shares of the lines before and
after it; a 2 x 2 matrix weighs the labels of adjacent lines. Forward-backward
gives each line's marginal probability of being good; their mean, weighted by
the lines' lengths, becomes the document's score through a logistic curve
fitted on the same sample.

The weights are fitted by gradient ascent on the likelihood of a bounded sample
of labelled documents (about ``per_class`` of each label, chosen by hashed id,
of at most ``most_chars`` characters), whose lines all carry the document's
label. Every document is scored whole.

Cases: a null text counts as empty; a text without lines gets the score of one
whose lines are undecided; with no labelled documents every score is 0.5 and
predicted is 1; rows with a null id are never learned from and count as held
out; repeated rows give repeated rows; further columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: lower case, upper case, other letters, digits, space, each sign, anything else
KINDS = 5 + len(SIGNS) + 1
LENGTHS = (5, 20, 60, 150, 400, 1000)
#: Of a line: the shares of its kinds and of words that repeat the word before.
SHARES = KINDS + 1
WIDTH = 3 * SHARES + len(LENGTHS) + 1 + 2 + 1
POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point."""
    table = np.full(0x110000, KINDS - 1, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = 0 if x.islower() else 1 if x.isupper() else 2
        elif x.isdigit():
            table[c] = 3
        elif x.isspace():
            table[c] = 4
    for i, x in enumerate(SIGNS):
        table[ord(x)] = 5 + i
    return table


def repeats(codes: np.ndarray, line: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The share of each line's words that equal the word before them in the line."""
    blank = kinds()[codes] == 4
    head = ~blank
    head[1:] &= blank[:-1] | starts[1:]
    at = np.flatnonzero(head)
    if not len(at):
        return np.zeros(n)
    place = np.arange(len(codes)) - np.repeat(at, np.diff(np.append(at, len(codes)))) if at[0] == 0 else np.concatenate([np.zeros(at[0], np.int64), np.arange(at[0], len(codes)) - np.repeat(at, np.diff(np.append(at, len(codes))))])
    value = np.where(blank, np.uint64(0), codes.astype(np.uint64) * POWERS[np.minimum(place, 255)])
    word = np.add.reduceat(value, at)
    own = line[at]
    same = np.zeros(len(at), bool)
    same[1:] = (word[1:] == word[:-1]) & (own[1:] == own[:-1])
    return np.bincount(own[same], minlength=n) / np.maximum(np.bincount(own, minlength=n), 1)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line that isn't empty, its length, its text's number)."""
    sizes = np.array([len(x) for x in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    feed = codes == 10
    starts = np.zeros(len(codes), bool)
    starts[0] = True
    starts[1:] = feed[:-1]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    starts[offsets[:-1][sizes > 0]] = True
    line = np.cumsum(starts) - 1
    n = int(line[-1]) + 1
    counts = np.bincount(line * KINDS + kinds()[codes], minlength=n * KINDS).reshape(n, KINDS)
    counts[:, 4] -= np.bincount(line[feed], minlength=n)  # the line feed itself is not counted
    length = counts.sum(axis=1)
    again = repeats(codes, line, starts, n)
    owner = np.searchsorted(offsets, np.flatnonzero(starts), side="right") - 1
    real = length > 0
    counts, length, owner = counts[real], length[real], owner[real]
    share = np.sqrt(np.hstack([counts / np.maximum(length, 1)[:, None], again[real][:, None]])).astype(np.float32)
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    last = np.ones(len(owner), bool)
    last[:-1] = first[1:]
    before = np.zeros_like(share)
    before[1:] = share[:-1]
    before[first] = 0
    after = np.zeros_like(share)
    after[:-1] = share[1:]
    after[last] = 0
    bins = np.searchsorted(LENGTHS, length, side="right")
    x = np.concatenate([share, before, after, np.eye(len(LENGTHS) + 1, dtype=np.float32)[bins], first[:, None], last[:, None], np.ones((len(share), 1))], axis=1, dtype=np.float32)
    return x, length, owner


def ragged(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, step) of each line when documents are ordered by their number of lines, longest first."""
    if not len(owner):
        return owner, owner
    names, start, count = np.unique(owner, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    step = np.arange(len(owner)) - np.repeat(start, count)
    return np.repeat(rank, count), step


def marginals(energy: np.ndarray, owner: np.ndarray, pairs: np.ndarray, both: bool = False):
    """P(good) of each line, from log-odds of good and the label pairs' weights.

    ``both``: also the expected number of each pair of adjacent labels. All
    documents take a step together; those with fewer lines leave earlier.
    """
    n = len(energy)
    row, step = ragged(owner)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    order = np.lexsort((row, step))
    width = np.bincount(step)
    edge = np.concatenate([[0], np.cumsum(width)])
    local = np.stack([np.zeros(n), energy], axis=1)[order]
    local = np.exp(local - local.max(axis=1, keepdims=True))
    move = np.exp(pairs - pairs.max())
    forward, backward = np.empty((n, 2)), np.empty((n, 2))
    a = None
    for t in range(len(width)):
        part = local[edge[t] : edge[t + 1]]
        a = part.copy() if t == 0 else (a[: width[t]] @ move) * part
        a /= a.sum(axis=1, keepdims=True)
        forward[edge[t] : edge[t + 1]] = a
    b = np.ones((width[-1], 2))
    backward[edge[-2] :] = b
    for t in range(len(width) - 2, -1, -1):
        part = local[edge[t + 1] : edge[t + 2]]
        new = np.ones((width[t], 2))
        new[: width[t + 1]] = (b * part) @ move.T
        new /= new.sum(axis=1, keepdims=True)
        b = new
        backward[edge[t] : edge[t + 1]] = b
    p = forward * backward
    p /= p.sum(axis=1, keepdims=True)
    good = np.empty(n)
    good[order] = p[:, 1]
    if not both:
        return good
    expected = np.zeros((2, 2))
    for t in range(len(width) - 1):
        a = forward[edge[t] : edge[t] + width[t + 1]]
        b = backward[edge[t + 1] : edge[t + 2]] * local[edge[t + 1] : edge[t + 2]]
        joint = a[:, :, None] * move[None] * b[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        expected += joint.sum(axis=0)
    return good, expected


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 0.0
    shift: float = 0.0

    def means(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean marginal of each text; 0.5 where there is no line."""
        x, length, owner = line_features(texts)
        good = marginals(x @ self.weights.astype(np.float32), owner, self.pairs)
        total = np.bincount(owner, length, minlength=len(texts))
        return np.where(total > 0, np.bincount(owner, length * good, minlength=len(texts)) / np.maximum(total, 1), 0.5)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in slices(texts):
            out[a:b] = 1 / (1 + np.exp(-(self.slope * (self.means(texts[a:b]) - 0.5) + self.shift)))
        return out


def climb(model: Model, x: np.ndarray, owner: np.ndarray, y: np.ndarray, rounds: int, rate: float, penalty: float) -> None:
    """Gradient ascent with moment-scaled steps on the likelihood of line labels; either label weighs the same."""
    weigh = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    inner = owner[1:] == owner[:-1] if len(owner) > 1 else np.zeros(0, bool)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
    m = np.zeros(WIDTH + 4)
    v = np.zeros(WIDTH + 4)
    for t in range(1, rounds + 1):
        good, expected = marginals(x @ model.weights.astype(np.float32), owner, model.pairs, True)
        g = np.concatenate([x.T @ ((y - good) * weigh) - penalty * model.weights, ((seen - expected) / max(1, len(y)) - penalty * model.pairs).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        model.weights = model.weights + step[:WIDTH]
        # Long stretches of one label would weigh pairs without end; they are bounded so that lines still count.
        model.pairs = np.clip(model.pairs + step[WIDTH:].reshape(2, 2), -1, 1)


def fit(texts: list[str], labels: list[int], rounds: int = 40, relabels: int = 2, rate: float = 0.3, penalty: float = 1e-4) -> Model:
    """Fit the field, then the logistic curve of the documents by Newton's method.

    A bad document may have good lines: after the first fit its lines that the
    model finds good are labelled so, all but its worst one, and it fits again.
    """
    model = Model()
    if not texts:
        return model
    labels = np.array(labels)
    x, length, owner = line_features(texts)
    y = labels[owner].astype(np.float64)
    for again in range(relabels + 1):
        climb(model, x, owner, y, rounds, rate, penalty)
        if again < relabels:
            good = marginals(x @ model.weights.astype(np.float32), owner, model.pairs)
            worst = np.full(len(texts), 2.0)
            np.minimum.at(worst, owner, good)
            y = np.where(labels[owner] == 1, 1.0, (good > 0.5) & (good > worst[owner]))
    z = np.stack([model.means(texts) - 0.5, np.ones(len(texts))], axis=1)
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-z @ w))
        h = z.T @ (z * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        w += np.linalg.solve(h, z.T @ (labels - p) - 1e-2 * w)
    model.slope, model.shift = w.tolist()
    return model


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == fold, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1200, most_chars: int = 20_000) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out.

    The ids are chosen from the labels alone (about ``per_class`` of each of
    two classes, so that joining them by broadcast is bounded).
    """
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(~held_out("id") & F.col("label").isin(0, 1))
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model()
    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, min(1.0, per_class / counts.get(1, 1))).otherwise(min(1.0, per_class / counts.get(0, 1)))
    chosen = marked.where(place < share)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text").between(1, most_chars))
    found = sorted((r["id"], r["label"], r["text"]) for r in rows.join(F.broadcast(chosen), "id").collect())
    # The curve is to give the labels' own odds back, so the commoner label is not thinned here beyond the sample.
    return fit([x[2] for x in found], [x[1] for x in found])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores([x or "" for x in batch.column(1).to_pylist()])
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held_out"))
    return map_batches(rows, rows.columns, run, SCHEMA)
