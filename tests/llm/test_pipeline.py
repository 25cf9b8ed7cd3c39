import hashlib
import re

import corpus_pipeline
from lacuna.llm import queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "substrings", "benchmark", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.cut(stage(spark, frames[-1], sf_dir)))
    start, known, single, trimmed, clean, coded = frames
    for f in (known, single, trimmed, clean):
        assert f.columns == start.columns
    # Every text of this corpus has a language.
    assert known.count() == start.count()
    # Near copies: just the least id of each component stays.
    groups = {r.doc_id: r.component_id for r in queries.simhash.group_loose_copies(known).collect()}
    assert {r.doc_id for r in single.collect()} == set(groups.values())
    # Substrings: by definition, on what was kept.
    first, rows = {}, sorted((r.doc_id, WORDS.findall(r.text)) for r in single.collect())
    for i, w in rows:
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for (i, w), r in zip(rows, sorted(trimmed.collect(), key=lambda r: r.doc_id)):
        gone = {p + k for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for k in range(13)}
        assert WORDS.findall(r.text) == [x for p, x in enumerate(w) if p not in gone] and r.n_chars == len(r.text)
    # Benchmark: documents with a hit go, all others stay.
    hits = {r.doc_id for r in queries.decontaminate.find(trimmed, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert hits and {r.doc_id for r in clean.collect()} == {r.doc_id for r in trimmed.collect()} - hits
    want = {r.doc_id for r in clean.collect()}
    assert {r.doc_id for r in coded.collect()} == want
    ran = {r.doc_id: hashlib.sha256(r.ids).hexdigest() for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert ran == {r.doc_id: hashlib.sha256(r.ids).hexdigest() for r in coded.collect()}


def test_near_copies_keep_one_row_of_each_group(spark):
    t, o, z = (" ".join(f"{k}{i}" for i in range(60)) for k in "toz")
    rows = [(1, t), (5, t), (5, o), (6, o + " z"), (7, z), (7, z), (None, t), (None, "quite another text without an id"), (8, None), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(1, t), (5, o), (7, z), (None, "quite another text without an id"), (8, None)], key=str)
    assert left[0].asDict().keys() == {*corpus_pipeline.COLUMNS}


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(0, None, None, None, None), (None, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "x" * 50_000, "en", "s", 50_000), (4, "the cat sat on the mat and the dog ran off " * 3_000, "en", "s", 1), (4, "the cat sat on the mat and the dog ran off " * 3_000, "en", "s", 1), (None, "a text of no id with some words of its own to read", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, bucket int, score double"
    odd = spark.createDataFrame([(*r, "k", 1, 2, 0.5) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        # Language ID drops texts without letters; near-dedup keeps one empty text, one of the equal rows, and two others.
        known = {"language": None, "near_copies": 4}.get(name, 7)
        assert known in (None, stage(spark, odd, sf_dir).count())
        assert stage(spark, odd.limit(0), sf_dir).collect() == []
