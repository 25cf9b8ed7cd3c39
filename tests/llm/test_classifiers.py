import itertools
import zlib

import numpy as np

from lacuna.llm import language, quality
from lacuna.llm.common import table


def test_language_on_held_out(spark, sf_dir, none):
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert language.identify(none, model).collect() == []


def test_language_of_odd_texts(odd, spark, sf_dir):
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd, language.learn(table(spark, sf_dir, "documents"))).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= got and all(0 <= s <= 1 for _, _, s in got)


def test_language_without_labels(odd):
    model = language.learn(odd.where("false"))
    assert {r.lang_pred for r in language.identify(odd, model).collect()} == {"und"}


def test_presence_is_of_a_text_alone():
    texts = ["the cat", "", "Ünder", "a"]
    together = language.presence(texts)[0]
    assert all((language.presence([t, "zzz"])[0][0] == row).all() for t, row in zip(texts, together))


def test_quality_on_held_out(spark, sf_dir, odd, none):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and sum(r.predicted == q for r, q in held) >= 0.93 * len(held)
    scores = [r.score for r in quality.score(odd, model).collect()]
    assert len(scores) == 12 and all(0 <= s <= 1 for s in scores)
    assert quality.score(none, model).collect() == []
    assert {r.score for r in quality.score(odd, quality.learn(docs, labels.limit(0))).collect()} == {0.5}


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(3)
    owner = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    energy, pairs = rng.normal(size=8), rng.normal(size=(2, 2))
    good, expected = quality.marginals(energy, owner, pairs, True)
    want, seen = np.zeros(8), np.zeros((2, 2))
    for doc in range(3):
        at = np.flatnonzero(owner == doc)
        weights, total = [], 0
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(energy[i] for i, v in zip(at, y) if v) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
            weights.append((y, w))
            total += w
        for y, w in weights:
            want[at] += np.array(y) * w / total
            for a, b in zip(y, y[1:]):
                seen[a, b] += w / total
    assert np.allclose(good, want) and np.allclose(expected, seen)


def naive_lines(text):
    """(features, length) of each line that isn't empty, character by character."""
    kinds = [lambda c: c.isalpha() and c.islower(), lambda c: c.isalpha() and c.isupper(), str.isalpha, str.isdigit, str.isspace]
    out, lines = [], [x for x in text.split("\n") if x]
    for line in lines:
        counts = np.zeros(quality.KINDS)
        for c in line:
            counts[5 + quality.SIGNS.index(c) if c in quality.SIGNS else next((i for i, k in enumerate(kinds) if k(c)), quality.KINDS - 1)] += 1
        words = line.split()
        again = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
        out.append(np.sqrt(np.append(counts / len(line), again)))
    none = np.zeros(quality.SHARES)
    rows = []
    for i, line in enumerate(lines):
        bins = np.zeros(len(quality.LENGTHS) + 1)
        bins[sum(len(line) >= x for x in quality.LENGTHS)] = 1
        rows.append(np.concatenate([out[i], out[i - 1] if i else none, out[i + 1] if i + 1 < len(out) else none, bins, [i == 0, i + 1 == len(out), 1]]))
    return rows, [len(x) for x in lines]


def test_quality_scores_against_all_labellings(spark):
    rng = np.random.default_rng(6)
    words = ["the", "Cat", "cat", "7", "3.5", "$$$", "日本", "é", "sat", "--", "x=1", "\t"]
    texts = ["\n".join(" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(rng.integers(1, 8))) for _ in range(30)] + ["", "\n\n", "one"]
    model = quality.Model(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)), 3.0, 0.4)
    want = []
    for text in texts:
        rows, sizes = naive_lines(text)
        mean = 0.5
        if rows:
            energy, total, good = [float(r @ model.weights) for r in rows], 0.0, np.zeros(len(rows))
            for y in itertools.product((0, 1), repeat=len(rows)):
                w = np.exp(sum(e for e, v in zip(energy, y) if v) + sum(model.pairs[a, b] for a, b in zip(y, y[1:])))
                good, total = good + np.array(y) * w, total + w
            mean = float(np.dot(good / total, sizes) / sum(sizes))
        want.append(1 / (1 + np.exp(-(3.0 * (mean - 0.5) + 0.4))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert np.allclose([got[i].score for i in range(len(texts))], want, atol=1e-4)
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())


def naive_grams(text):
    """The hashed places of a text's distinct 1- to 3-grams."""
    cut = lambda x: x & 0xFFFFFFFF
    m1, m2, m3 = int(language.M1), int(language.M2), int(language.M3)
    codes = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
    places = {cut(a * m1) >> 18 for a in codes}
    for a, b in zip(codes, codes[1:]):
        pair = cut(a * m1) ^ cut(b * m2)
        places.add(cut((pair ^ pair >> 15) * m3) >> 18)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        pair = cut(a * m1) ^ cut(b * m2)
        triple = cut(cut((pair ^ pair >> 15) * m3) + cut(c * m1))
        places.add(cut((triple ^ triple >> 13) * m2) >> 18)
    return places


def test_language_scores_against_plain_kernels(spark, sf_dir):
    rows = [r for r in table(spark, sf_dir, "documents").where("lang IS NOT NULL").orderBy("doc_id").limit(60).collect()]
    texts, langs = [r.text[:600] for r in rows], [r.lang for r in rows]
    names = sorted(set(langs))
    model = language.fit(texts, langs, landmarks=12)
    grams = [naive_grams(x) for x in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = [i for name in names for i in [j for j, x in enumerate(langs) if x == name][: 12 // len(names)]]
    k = np.array([[kernel(a, grams[j]) for j in marks] for a in grams])
    value, vector = np.linalg.eigh(k[marks])
    keep = value > 1e-6 * value.max()
    z = np.hstack([k @ (vector[:, keep] / np.sqrt(value[keep])), np.ones((len(k), 1))])
    scores = []
    for name in names:  # each language against the rest, all languages of equal weight
        y = np.array([1.0 if x == name else -1.0 for x in langs])
        weight = np.array([len(langs) / len(names) / langs.count(x) for x in langs])
        w = np.linalg.solve((z.T * weight) @ z + 1e-2 * np.eye(z.shape[1]), (z.T * weight) @ y)
        scores.append(z @ w)
    soft = np.exp(6.0 * np.array(scores).T)
    soft /= soft.sum(axis=1, keepdims=True)
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(len(texts))] == [names[i] for i in soft.argmax(axis=1)]
    assert np.allclose([got[i].score for i in range(len(texts))], soft.max(axis=1), atol=1e-3)
