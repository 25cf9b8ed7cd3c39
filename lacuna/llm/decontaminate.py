"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

The rule: tokens are runs of letters and digits, lower-cased. A document holds
an item if, laid along it at some place, 80 % or more of the tokens of some
stretch of 13 agree (of the whole item, if that is shorter). So two of 13
tokens may be substituted, two of 10 to 12, one of 5 to 9, and items of one to
four tokens have to stand there as they are.

The search: a mask picks some offsets and ignores the others, so that a hash of
what it picks survives substitutions between. Two masks pick 6 of 8 tokens; of
any 13 tokens of which 2 are substituted, one of them still finds an untouched
place (checked by a test for all 78 pairs). Items under 13 tokens have masks of
their own length: with s substitutions allowed, s + 1 masks share its offsets
out in turn, of which one is untouched. The hashes of the documents' places are
joined with those of the benchmark, and the tokens around each hit compared.

The benchmark's hashes are broadcast if they are few (their number is counted
first), else joined by a shuffle of hashes and places alone, whose large
partitions Spark may split; either way gives the same rows.

Cases: a null text has no tokens; texts and items of any length are searched
whole; an item without tokens is in no document; null ids are reported as null;
rows of one id but different texts are searched each for itself; repeated rows
are reported once; columns not named are not read; an empty table or benchmark
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Picked offsets of each mask.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW, SHARE = 13, (4, 5)
#: Tokens to either side of a place that the comparison may need.
REACH = SPAN + WINDOW
#: Tokens of a text whose places one row holds before they are spread.
CHUNK = 512
#: More benchmark hashes than this (some 40 bytes each, and the item's) are not broadcast.
MOST_BROADCAST = 200_000
PARTS = "[^\\p{L}\\p{N}]+"


def tokens(text: Column) -> Column:
    """Hashes of a text's tokens (an empty string at either end may stay; it equals no token)."""
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), PARTS), lambda x: F.xxhash64(x))


def least_equal(n: int) -> int:
    """Tokens that have to agree in a stretch of ``n``."""
    a, b = SHARE
    return -(-a * n // b)


def picks(lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(length of the items it is for, offsets) of every mask; length 0 stands for ``WINDOW`` and more."""
    out = [(0, mask) for mask in MASKS]
    for n in lengths:
        turns = n - least_equal(n) + 1
        out += [(n, tuple(range(i, n, turns))) for i in range(turns)]
    return out


def seed(place: Column, mask: Column, offsets: list[tuple[int, ...]]) -> Column:
    """The hash of what a mask picks at a place of ``part``."""
    hashes = [F.xxhash64(F.lit(i), *[F.get("part", place + o) for o in own]) for i, own in enumerate(offsets)]
    out = F.when(mask == 0, hashes[0])
    for i, value in enumerate(hashes[1:], 1):
        out = out.when(mask == i, value)
    return out.otherwise(F.lit(0))


def places(rows: DataFrame, offsets: list[tuple[int, ...]], overlap: int = REACH) -> DataFrame:
    """One row for each place and mask: where it is (place), which mask, and what it picks there (h).

    ``toks`` becomes ``part``, tokens from ``base`` on that reach ``overlap``
    past the places of a row to either side, so that no row carries more than
    ``CHUNK`` tokens and twice the overlap, however long a text is.
    """
    n = F.size("toks")
    piece = lambda s: F.struct(s.alias("first"), F.greatest(s - overlap, F.lit(0)).alias("base"))
    starts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(CHUNK)), piece)
    cut = rows.select("*", F.explode(starts).alias("c"), n.alias("n_toks"))
    cut = cut.select(*[c for c in rows.columns if c != "toks"], F.slice("toks", F.col("c.base") + 1, F.lit(CHUNK + 2 * overlap)).alias("part"), F.col("c.first").alias("first"), F.col("c.base").alias("base"), "n_toks")
    here = F.least(F.lit(CHUNK), F.col("n_toks") - F.col("first"))
    spread = cut.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(here * len(offsets) - 1, F.lit(0)))))
    spread = spread.withColumn("place", F.col("first") + F.expr(f"CAST(at DIV {len(offsets)} AS INT)"))
    return spread.withColumn("h", seed(F.col("place") - F.col("base"), F.col("at") % len(offsets), offsets)).withColumn("mask", (F.col("at") % len(offsets)).cast("int")).drop("at", "first")


def item_seeds(items: DataFrame, masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """h, item_id, item_hash, item, item_place and mask, of every mask at every place of an item where all it picks is there.

    The masks of shorter items have their place at the item's start only.
    """
    n, out = F.size("item"), None
    offsets = [own for _, own in masks]
    for i, (length, own) in enumerate(masks):
        fits = n == length if length else n >= WINDOW
        last = F.lit(0) if length else n - 1 - own[-1]
        spread = items.where(fits).select("item_id", "item_hash", "item", F.col("item").alias("part"), F.explode(F.sequence(F.lit(0), last)).alias("item_place"))
        seeds = spread.select(seed(F.col("item_place"), F.lit(i), offsets).alias("h"), "item_id", "item_hash", "item", "item_place", F.lit(i).alias("item_mask"))
        out = seeds if out is None else out.unionByName(seeds)
    return out.distinct()


def agreeing(part: Column, base: Column, place: Column, item: Column, item_place: Column, n_toks: Column) -> Column:
    """Most equal tokens in a stretch that reaches a hit, the document's tokens laid along the item's."""
    size = F.size(item)
    stretch = F.least(F.lit(WINDOW), size)
    # From how far before the hit to how far after it both have tokens.
    before = F.least(F.lit(WINDOW - 1), place, item_place)
    after = F.least(F.lit(REACH), n_toks - place, size - item_place)
    theirs = F.slice(part, place - before - base + 1, before + after)
    ours = F.slice(item, item_place - before + 1, before + after)
    same = F.zip_with(theirs, ours, lambda a, b: F.when(a == b, 1).otherwise(0))
    starts = F.when(before + after >= stretch, F.sequence(F.lit(0), before + after - stretch)).otherwise(F.array().cast("array<int>"))
    return F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice(same, i + 1, stretch), F.lit(0), lambda a, x: a + x)))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document text and benchmark item it holds.

    Columns: doc_id, item_id, text_hash (of the document's text), start (the
    token at which the item's first would stand; of the best stretches the
    first), matched (most equal tokens in a stretch), stretch (its length),
    n_hits (places and masks that led to it).
    """
    bare = F.regexp_replace(F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")), f"^{PARTS}|{PARTS}$", "")
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), bare.alias("bare")).where("bare <> ''").select("item_id", tokens(F.col("bare")).alias("item")).distinct()
    items = items.select("item_id", F.xxhash64("item").alias("item_hash"), "item")
    # At most WINDOW - 1 lengths of short items.
    short = items.agg(F.sort_array(F.collect_set(F.when(F.size("item") < WINDOW, F.size("item")))).alias("short")).first()["short"]
    masks = picks(short)
    offsets = [own for _, own in masks]
    seeds = item_seeds(items, masks)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), tokens(F.col("text")).alias("toks"))
    spread = places(rows, offsets)
    spot = (F.col("place") * len(offsets) + F.col("mask")).alias("spot")
    start = (F.col("place") - F.col("item_place")).alias("start")
    # An item's id may be null or have several texts: its hash is a key too.
    key = ["doc_id", "text_hash", "item_id", "item_hash"]
    if seeds.count() <= MOST_BROADCAST:
        hits = spread.join(F.broadcast(seeds), "h").where("mask = item_mask")
        judged = hits.select(*key, start, spot, F.size("item").alias("size"), agreeing(F.col("part"), F.col("base"), F.col("place"), F.col("item"), F.col("item_place"), F.col("n_toks")).alias("matched"))
    else:
        thin = seeds.drop("item")
        found = spread.select("doc_id", "text_hash", "place", "mask", "h").join(thin, "h").where("mask = item_mask").select(*key, "place", "item_place", "mask").distinct()
        again = rows.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), "toks").dropDuplicates(["id", "th"])
        met = found.join(again, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")))
        whole = items.select(F.col("item_id").alias("own_id"), F.col("item_hash").alias("own_hash"), "item")
        met = met.join(whole, F.col("item_id").eqNullSafe(F.col("own_id")) & (F.col("item_hash") == F.col("own_hash")))
        judged = met.select(*key, start, spot, F.size("item").alias("size"), agreeing(F.col("toks"), F.lit(0), F.col("place"), F.col("item"), F.col("item_place"), F.size("toks")).alias("matched"))
    # A pair has no more spots than its item has places and masks; repeated rows have the same ones.
    laid = judged.groupBy(*key, "start", "size").agg(F.max("matched").alias("matched"), F.size(F.collect_set("spot")).alias("n_hits"))
    laid = laid.withColumn("stretch", F.least(F.lit(WINDOW), F.col("size")))
    a, b = SHARE
    held = laid.where(F.col("matched") * b >= F.col("stretch") * a)
    best = F.max(F.struct("matched", F.negate("start").alias("start"), "n_hits", "stretch"))
    return held.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "text_hash", F.negate("b.start").alias("start"), F.col("b.matched").cast("int").alias("matched"), F.col("b.stretch").cast("int").alias("stretch"), F.col("b.n_hits").cast("long").alias("n_hits")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text holds no benchmark item, all columns as they were."""
    bad = find(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(docs[text_col]) == F.col("bad_hash")), "left_anti")


def oracle() -> str:
    """DuckDB SQL of the rule for the registered query, without masks.

    If enough tokens of a stretch agree, so does some run of them without a
    gap: with s gaps, a share of s + 1 of those that have to agree. Where such
    a run is common to both, the document is laid along the whole item.
    """
    run = "CASE " + " ".join(f"WHEN n = {n} THEN {-(-least_equal(n) // (n - least_equal(n) + 1))}" for n in range(1, WINDOW)) + f" ELSE {-(-least_equal(WINDOW) // (WINDOW - least_equal(WINDOW) + 1))} END"
    split = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    a, b = SHARE
    return f"""
WITH items AS (SELECT *, {run} AS run FROM (SELECT DISTINCT item_id, {split} AS toks, len({split}) AS n FROM benchmark) WHERE n > 0),
docs AS (SELECT DISTINCT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') AS toks FROM documents),
runs AS (SELECT DISTINCT run FROM items),
ours AS (SELECT item_id, toks AS item, run, i AS place, array_to_string(toks[i : i + run - 1], ' ') AS h FROM (SELECT *, unnest(range(1, n - run + 2)) AS i FROM items)),
theirs AS (SELECT doc_id, toks, run, i AS place, array_to_string(toks[i : i + run - 1], ' ') AS h FROM (SELECT *, unnest(range(1, len(toks) - run + 2)) AS i FROM docs, runs)),
hits AS (SELECT DISTINCT doc_id, toks, item_id, item, t.place - o.place AS start FROM theirs t JOIN ours o USING (run, h)),
laid AS (
  SELECT doc_id, item_id, start, least({WINDOW}, len(item)) AS stretch,
         [CASE WHEN toks[start + k] = item[k] THEN 1 ELSE 0 END FOR k IN range(greatest(1, 1 - start), least(len(item), len(toks) - start) + 1)] AS same
  FROM hits
), judged AS (
  SELECT *, list_max([list_sum(same[k : k + stretch - 1]) FOR k IN range(1, len(same) - stretch + 2)]) AS matched FROM laid WHERE len(same) >= stretch
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) AS r FROM judged WHERE matched * {b} >= stretch * {a}
)
SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(matched AS INT) AS matched, CAST(stretch AS INT) AS stretch FROM ranked WHERE r = 1
"""
