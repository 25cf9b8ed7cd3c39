"""SimHash near-duplicates by self-joins of binary tries.

A document's fingerprint has a bit set where over half of the hashes of its
shingles have it. Distinct fingerprints become the leaves of tries: since two
fingerprints that differ in at most 4 of 64 bits agree in one of five blocks,
five tries are built, each with another block rotated to the front, and each
pair of nodes agrees on the path to that block's end. Below it, pairs of nodes
are traversed together, from the root: the differing bits are added up, and a
pair is pruned when they exceed the budget, or when all leaves under both nodes
are known to be connected already.

The subtrees under a front block are independent tasks (a subtree with more
than ``most`` leaves is dealt to the tasks of all pairs of its chunks). A task
returns a star for each connected set of leaves, not its pairs; distributed
rounds then join stars that share a leaf.

Cases: a null text counts as empty and has fingerprint 0, linked like any
other; a text with fewer words than a shingle hashes them all as one; equal
texts have equal fingerprints; null ids get their component's least id, null if
it has none; repeated rows give repeated rows; further columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import Tables, components, cut
from .common import map_batches, release, released
from .fmindex import Bits

BITS, BUDGET = 64, 4
#: (left rotation, bits in front) of each trie: the five blocks of a fingerprint.
FRONTS = [(13 * i, 13) for i in range(4)] + [(52, 12)]
SEED = 42
PIECE = 1 << 16
#: Node pairs with at most this many leaf pairs are compared leaf by leaf.
FEW = 16
#: Node pairs taken on together.
FRONTIER = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit fingerprint of a text's words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        part = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + PIECE], stops[at : at + PIECE])), np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
        return pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs, [id_col, text_col], run, "doc_id long, fp long")


def rotate(values: np.ndarray, left: int) -> np.ndarray:
    return values << np.uint64(left) | values >> np.uint64(BITS - left) if left else values


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of every link, and all that hangs on them, the least label."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def distance(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of pairs of leaves, of one 64-bit word each or of several."""
    bits = np.bitwise_count(values[a] ^ values[b])
    return bits if values.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


def traverse(group: np.ndarray, values: np.ndarray, label: np.ndarray, front: int, budget: int, few: int = FEW):
    """Yield (a, b, differing bits) of leaves of one group within the budget of each other.

    Leaves are sorted by group and value, and agree on the first ``front`` bits
    of their group. A node is a range of leaves; its second child starts where
    the next bit turns to one. ``values`` has one 64-bit word for each leaf, or
    a row of several. Pairs of nodes whose leaves all have one label are left
    out; the caller may merge labels between two steps.
    """
    words = values.reshape(len(values), -1)
    total = BITS * words.shape[1]
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    lo, hi = edges[:-1], edges[1:]
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    stack = [(front, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    ones: dict[int, Bits] = {}  # by depth: a quarter of a byte a leaf, as there may be as many as bits in a value
    while stack:
        depth, alo, ahi, blo, bhi, spent = stack.pop()
        size = (ahi - alo) * (bhi - blo)
        small = size <= few
        if len(alo) > 1 and (len(alo) > FRONTIER or size[small].sum() > 2 * FRONTIER):
            half = len(alo) // 2
            stack += [(depth, *(x[:half] for x in (alo, ahi, blo, bhi, spent))), (depth, *(x[half:] for x in (alo, ahi, blo, bhi, spent)))]
            continue
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        open_ = (change[ahi - 1] != change[alo]) | (change[bhi - 1] != change[blo]) | (label[alo] != label[blo])
        alo, ahi, blo, bhi, spent, size, small = (x[open_] for x in (alo, ahi, blo, bhi, spent, size, small))
        if small.any():
            width, count = (bhi - blo)[small], size[small]
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            wide = np.repeat(width, count)
            a, b = np.repeat(alo[small], count) + place // wide, np.repeat(blo[small], count) + place % wide
            ahead = (a < b) & (label[a] != label[b])
            a, b = a[ahead], b[ahead]
            bits = distance(values, a, b)
            near = bits <= budget
            if near.any():
                yield a[near], b[near], bits[near]
            alo, ahi, blo, bhi, spent = (x[~small] for x in (alo, ahi, blo, bhi, spent))
        if depth >= total or not len(alo):
            continue
        if depth not in ones:
            ones[depth] = Bits((words[:, depth // BITS] >> np.uint64(BITS - 1 - depth % BITS) & np.uint64(1)).astype(np.uint8))
        one = ones[depth].rank1
        amid, bmid = ahi - (one(ahi) - one(alo)), bhi - (one(bhi) - one(blo))
        same = alo == blo
        parts = [
            (alo, amid, blo, bmid, spent),
            (amid, ahi, bmid, bhi, spent),
            (alo, amid, bmid, bhi, spent + 1),
            tuple(x[~same] for x in (amid, ahi, blo, bmid, spent + 1)),
        ]
        alo, ahi, blo, bhi, spent = (np.concatenate(x) for x in zip(*parts))
        left = (ahi > alo) & (bhi > blo) & (spent <= budget) & ~((alo == blo) & (ahi - alo == 1))
        if left.any():
            stack.append((depth + 1, *(x[left] for x in (alo, ahi, blo, bhi, spent))))


def trie_join(group: np.ndarray, values: np.ndarray, front: int, budget: int = BUDGET, few: int = FEW) -> np.ndarray:
    """Label (least index) of each leaf's connected set; for ``group``, ``values`` and ``front`` see ``traverse``."""
    label = np.arange(len(values))
    if len(values) < 2:
        return label
    # Neighbours in a few orders are linked first, so that crowded subtrees are known to be connected before they are traversed.
    for left in range(0, BITS, 8):
        order = np.lexsort((rotate(values, left), group))
        for gap in (1, 2):
            a, b = order[:-gap], order[gap:]
            near = (group[a] == group[b]) & (distance(values, a, b) <= budget)
            settle(label, a[near], b[near])
    for a, b, _ in traverse(group, values, label, front, budget, few):
        settle(label, a, b)
    return label


def links(fps: DataFrame, most: int = 250_000, leaves_per_task: int = 200_000) -> DataFrame:
    """(u, v): stars that connect all distinct fingerprints within the budget of each other."""
    turn = F.explode(F.array(*[F.struct(F.lit(i).alias("trie"), (F.shiftleft("fp", left) if left else F.col("fp")).bitwiseOR(F.shiftrightunsigned("fp", BITS - left) if left else F.lit(0).cast("long")).alias("value"), F.lit(bits).alias("bits")) for i, (left, bits) in enumerate(FRONTS)]))
    leaves = fps.select(turn.alias("x")).select(F.col("x.value").alias("value"), (F.col("x.trie") * (1 << 13) + F.when(F.col("x.bits") == 13, F.shiftrightunsigned("x.value", 51)).otherwise(F.shiftrightunsigned("x.value", 52))).cast("int").alias("front"))
    # At most five times 8,192 rows, whatever the input.
    sizes = leaves.groupBy("front").agg(F.count("*").alias("n"))
    chunks = F.broadcast(sizes.where(F.col("n") > most).select("front", F.ceil(F.col("n") / most).cast("int").alias("g")))
    tasks = max(1, -(-fps.count() * len(FRONTS) // leaves_per_task))
    own = F.pmod(F.xxhash64("value"), F.col("g")).cast("int")
    # A chunk meets every chunk of its subtree, itself included.
    cells = F.when(F.col("g").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1), lambda j: F.least(own, j) * 65536 + F.greatest(own, j)))
    dealt = leaves.join(chunks, "front", "left").select("value", "front", F.explode(cells).alias("cell"))
    spread = dealt.withColumn("task", F.pmod(F.xxhash64("front", "cell"), F.lit(tasks)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        value = table.column("value").to_numpy().view(np.uint64)
        group = table.column("front").to_numpy().astype(np.int64) << 33 | table.column("cell").to_numpy().astype(np.int64)
        order = np.lexsort((value, group))
        value, group = value[order], group[order]
        label = trie_join(group, value, min(bits for _, bits in FRONTS))
        joined = np.flatnonzero(label != np.arange(len(label)))
        left = np.array([x for x, _ in FRONTS], np.uint64)[group[joined] >> 46]
        back = lambda x: np.where(left > 0, x >> left | x << (np.uint64(BITS) - left) % np.uint64(BITS), x)
        return pa.table({"u": back(value[joined]).view(np.int64), "v": back(value[label[joined]]).view(np.int64)})

    return spread.groupBy("task").applyInArrow(lambda t: released(run, t), "u long, v long")


def group_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id."""
    tables = Tables(docs.sparkSession)
    prints = tables.keep(fingerprints(docs, id_col, text_col, shingle))
    leaves = tables.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    sets = components(links(leaves))
    named = sets.join(leaves.withColumnRenamed("fp", "node"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = named.select("node", "root").join(least, "root").select(F.col("node").alias("fp"), "component_id")
    # Written, so that the join below has a plain shuffle on either side and can be split where one fingerprint is most of the rows.
    by_print = tables.keep(leaves.join(by_node, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    found = cut(prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
    tables.remove()
    return found


# ---- near copies by similarity ----------------------------------------------
SHINGLE = 5
#: Near copies have at least this share (a / b) of their distinct shingles in common.
SHARE = (4, 5)
#: Words of a wide fingerprint, and the bits in which those of near copies may differ: 39 of 256 are to be expected at the share, with a deviation of 6.
WIDE, WIDE_BUDGET = 4, 72
TURNS = (np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
#: Texts in which shingles are counted, and how many of them a common one is in. Only the order of shingles, and so the time, depends on these.
SAMPLE, OFTEN, MOST_COMMON = 10_000, 3, 200_000
#: More keys than this of texts to be compared are not broadcast.
MOST_KEYS = 200_000
#: Sets of shingles a worker keeps, in shingles.
HELD = 2_000_000
#: Shingles of other sets that a set is compared with together.
TOGETHER = 1 << 18
#: Leaf pairs held before they are thinned to a forest.
PAIRS_HELD = 1 << 20


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 62-bit hashes of a text's distinct shingles; a text with fewer words is one, a text without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[: max(0, len(words) - shingle)] + 1]).tolist()
    digest = xxhash.xxh3_64_intdigest
    found = np.fromiter((digest(joined[a:b]) >> 2 for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist())), np.int64, len(starts))
    return np.unique(found)


def name_of(own: np.ndarray) -> int:
    """A set of shingles as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def wide_print(own: np.ndarray) -> np.ndarray:
    """A set's fingerprint of ``WIDE`` words: a bit is set where over half of the shingles' mixed hashes have it."""
    counts = np.zeros(BITS * WIDE, np.int64)
    for at in range(0, len(own), PIECE):
        x = own[at : at + PIECE].view(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93) + TURNS
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(own), bitorder="little").view(np.int64)


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of a set's shingles, common ones last by rank: two sets that are near copies share one of these at least."""
    order = own.copy()
    at = np.searchsorted(common, own)
    hit = np.flatnonzero(at < len(common))
    hit = hit[common[at[hit]] == own[hit]]
    order[hit] = (1 << 62) + rank[at[hit]]
    order = np.sort(order)
    a, b = SHARE
    return order[: len(own) - -(-a * len(own) // b) + 1] if len(own) else order


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that a sample of texts has often, and their ranks from the rarest on."""
    step = max(1, texts.count() // SAMPLE)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.concatenate([shingles(x) for x in batch.column(0).to_pylist()]))], names=["s"])

    sample = texts.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0)
    often = map_batches(sample, ["text"], run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = often.orderBy(F.desc("n"), "s").limit(MOST_COMMON).select("s").toArrow().column("s").to_numpy()
    order = np.argsort(found)
    return found[order], len(found) - 1 - order


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the lightest links that connect all that the links connect, besides what has one label already."""
    label, weight = label.copy(), bits.astype(np.int64) << 40 | np.arange(len(a))
    kept, open_ = [], np.arange(len(a))
    while True:
        x, y = label[a[open_]], label[b[open_]]
        differ = x != y
        open_, x, y = open_[differ], x[differ], y[differ]
        if not len(open_):
            return np.concatenate(kept) if kept else open_
        # Every set takes its lightest link to another one.
        least = np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(least, x, weight[open_])
        np.minimum.at(least, y, weight[open_])
        taken = np.unique(least[np.unique(np.concatenate([x, y]))]) & (1 << 40) - 1
        kept.append(taken)
        settle(label, a[taken], b[taken])


def leaves_of(table: pa.Table) -> tuple[np.ndarray, ...]:
    """cell, node, root, size and fingerprint words of a task's leaves, in the tries' order, and that order."""
    get = lambda c: table.column(c).to_numpy()
    values = np.stack([get(f"f{i}") for i in range(WIDE)], axis=1).view(np.uint64)
    order = np.lexsort((*values.T[::-1], get("cell")))
    return (*(get(c)[order] for c in ("cell", "node", "root", "size")), values[order], order)


def alike(size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be near copies."""
    a, b = SHARE
    return b * np.minimum(size[x], size[y]) >= a * np.maximum(size[x], size[y])


def links_table(node: np.ndarray, x: list, y: list) -> pa.Table:
    none = np.zeros(0, np.int64)
    us, vs = node[np.concatenate([none, *x])], node[np.concatenate([none, *y])]
    return pa.table({"u": np.minimum(us, vs), "v": np.maximum(us, vs)})


def closest(cells: DataFrame, tasks: int) -> DataFrame:
    """(u, v): of each task the closest pairs of sets that connect all whose sizes and wide fingerprints near copies may have."""

    def run(table: pa.Table) -> pa.Table:
        cell, node, root, size, values, _ = leaves_of(table)
        first, place = np.unique(root, return_index=True, return_inverse=True)[1:]
        label, held, count = first[place], [], 0

        def thin() -> None:
            x, y, bits = (np.concatenate(p) for p in zip(*held))
            stay = forest(label, x, y, bits)
            held[:] = [(x[stay], y[stay], bits[stay])]

        for x, y, bits in traverse(cell, values, label, 0, WIDE_BUDGET):
            ok = alike(size, x, y)
            held.append((x[ok], y[ok], bits[ok]))
            count += int(ok.sum())
            if count > PAIRS_HELD:
                thin()
                count = len(held[0][0])
        if held:
            thin()
        return links_table(node, [h[0] for h in held], [h[1] for h in held])

    dealt = cells.withColumn("task", F.pmod(F.xxhash64("cell"), F.lit(tasks)).cast("int"))
    return dealt.groupBy("task").applyInArrow(lambda t: released(run, t), "u long, v long").distinct()


def candidates(cells: DataFrame, tasks: int) -> DataFrame:
    """The rows of sets that have, in their cell, another of another root whose size and wide fingerprint a near copy may have.

    Each with the least such node of its cell (home): sets that share several
    shingles meet in as many cells, which mostly have one home.
    """
    names = cells.columns

    def run(table: pa.Table) -> pa.Table:
        cell, node, root, size, values, order = leaves_of(table)
        first, place = np.unique(root, return_index=True, return_inverse=True)[1:]
        near = np.zeros(len(order), bool)
        for x, y, _ in traverse(cell, values, first[place], 0, WIDE_BUDGET):
            ok = alike(size, x, y)
            near[x[ok]] = near[y[ok]] = True
        cell, node = cell[near], node[near]
        at, count = np.unique(cell, return_index=True, return_counts=True)[1:]
        home = np.repeat(np.minimum.reduceat(node, at), count) if len(at) else node
        found = table.select(names).take(order[near]).append_column("home", pa.array(home, pa.int64()))
        return found

    dealt = cells.withColumn("task", F.pmod(F.xxhash64("cell"), F.lit(tasks)).cast("int"))
    return dealt.groupBy("task").applyInArrow(lambda t: released(run, t), T.StructType([*cells.schema.fields, T.StructField("home", T.LongType())]))


def portions(which: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """Some sets, in order, in portions of about ``most`` shingles."""
    return np.split(which, np.flatnonzero(np.diff(np.cumsum(size[which], dtype=np.int64) // most)) + 1)


def in_common(own: list[np.ndarray], i: int, others: np.ndarray) -> np.ndarray:
    """How many shingles a set shares with each of some others."""
    theirs = np.concatenate([own[k] for k in others.tolist()])
    starts = np.cumsum([0, *(len(own[k]) for k in others[:-1].tolist())])
    at = np.minimum(np.searchsorted(own[i], theirs), len(own[i]) - 1)
    return np.add.reduceat((own[i][at] == theirs).astype(np.int64), starts)


def compared(cells: DataFrame, own: DataFrame, tasks: int) -> DataFrame:
    """(u, v): links that connect, with what is known already, all sets of a cell that are near copies.

    The sets come along (own: 32 bits of each shingle), once for all cells of a
    task, so that pairs within the budget are compared where they meet and none
    but links leave the task.
    """
    a, b = SHARE

    def run(table: pa.Table, sets: pa.Table) -> pa.Table:
        cell, node, root, size, values, _ = leaves_of(table)
        names, column = sets.column("name").to_numpy(), sets.column("own").combine_chunks()
        by_name = np.argsort(names)
        own = [np.frombuffer(column[i].as_buffer(), np.uint32) for i in by_name[np.searchsorted(names[by_name], node)].tolist()]
        first, place = np.unique(root, return_index=True, return_inverse=True)[1:]
        label, us, vs = first[place], [], []
        for x, y, _ in traverse(cell, values, label, 0, WIDE_BUDGET):
            ok = alike(size, x, y)
            x, y = x[ok], y[ok]
            by_x = np.argsort(x, kind="stable")
            x, y = x[by_x], y[by_x]
            edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                i, others = int(x[s]), y[s:e]
                others = others[label[others] != label[i]]
                for part in portions(others, size, TOGETHER):
                    part = part[label[part] != label[i]]
                    if not len(part):
                        continue
                    same = in_common(own, i, part)
                    near = part[b * same >= a * (size[i].astype(np.int64) + size[part] - same)]
                    if len(near):
                        one = near[np.unique(label[near], return_index=True)[1]]
                        us.append(np.full(len(one), i))
                        vs.append(one)
                        settle(label, np.full(len(near), i), near)
        return links_table(node, us, vs)

    dealt = cells.withColumn("task", F.pmod(F.xxhash64("home"), F.lit(tasks)).cast("int"))
    sets = dealt.select(F.col("task").alias("at"), F.col("node").alias("name")).distinct().join(own.withColumnRenamed("node", "name"), "name")
    return dealt.groupBy("task").cogroup(sets.groupBy("at")).applyInArrow(lambda t, s: released(run, t, s), "u long, v long").distinct()


def texts_of(keys: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """(key, text) of some keys, once each."""
    needed = tables.keep(keys.distinct())
    # Few keys are broadcast, so that the other texts stay where they are.
    needed = F.broadcast(needed) if needed.count() <= MOST_KEYS else needed
    return texts.join(needed, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))


def own_sets(nodes: DataFrame, leaves: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """(node, own): 32 bits of each shingle of some sets, ascending."""
    keyed = tables.keep(nodes.distinct().join(leaves.select("node", F.col("least.key").alias("key")), "node"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingles(x).astype(np.uint32)).tobytes() for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "own"])

    both = keyed.join(texts_of(keyed.select("key"), texts, tables), "key").select("node", "text")
    return map_batches(both, ["node", "text"], run, "node long, own binary")


def verified(pairs: DataFrame, leaves: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (u, v) of sets that have SHARE of their shingles in common, counted on whole texts."""
    a, b = SHARE
    side = lambda c: leaves.select(F.col("node").alias(c), F.col("least.key").alias(f"{c}k"))
    named = tables.keep(pairs.join(side("u"), "u").join(side("v"), "v"))
    own = texts_of(named.select(F.col("uk").alias("key")).unionByName(named.select(F.col("vk").alias("key"))), texts, tables)
    both = named.join(own.select(F.col("key").alias("uk"), F.col("text").alias("ut")), "uk").join(own.select(F.col("key").alias("vk"), F.col("text").alias("vt")), "vk")

    def run(batches):
        kept, size = {}, 0

        def of(key: str, text: pa.Scalar) -> np.ndarray:
            nonlocal size
            if key not in kept:
                if size > HELD:
                    kept.clear()
                    size = 0
                kept[key] = shingles(text.as_py())
                size += len(kept[key]) + 50
            return kept[key]

        for batch in batches:
            good = []
            for u, v, ut, vt in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                x, y = of(u, ut), of(v, vt)
                same = len(np.intersect1d(x, y, assume_unique=True))
                good.append(b * same >= a * (len(x) + len(y) - same))
            keep = pa.array(good, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])
        kept.clear()
        release()

    return both.select("u", "v", "uk", "vk", "ut", "vt").mapInArrow(run, "u long, v long")


def group_loose_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 512, leaves_per_task: int = 4_000, shingles_per_task: int = 2_000_000) -> DataFrame:
    """Near copies: texts with 0.8 of their distinct five-word shingles in common, and what these connect.

    Per distinct document (id and text): doc_id, key (its text's digest),
    component_id (least id of the component, null if none has one), n (equal
    rows) and first (true for one document of each component: the least id,
    then key).

    Shingles are put in one order, rare ones first; of a set of n, the first
    n - ceil(0.8 n) + 1 are its prefix, and two near copies always share a
    shingle there. Each shingle that several sets share is the front of a trie
    over the wide fingerprints of these sets, which is joined with itself under
    the Hamming budget. A pair found is a link if the texts, compared whole,
    have 0.8 in common. Shingles that the same sets share count once. A first
    round takes of each cell (at most about ``most`` sets that share a shingle)
    just the closest pairs that connect it; in the second, sets that are known
    to be connected are left out, and all others that share a shingle meet, in
    as many cells as that takes. Those with a pair within the budget meet once
    more, with their shingles. Pairs are compared there, and only links that
    connect something leave a cell.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts))
    words = [f"f{i}" for i in range(WIDE)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x) for x in batch.column(2).to_pylist()]
        prints = np.stack([wide_print(x) for x in sets])
        firsts = [prefix(x, *common.value) for x in sets]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([name_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), *[pa.array(x) for x in prints.T], pa.array(firsts, pa.list_(pa.int64()))], names=["id", "key", "node", "size", *words, "firsts"])

    tables = Tables(docs.sparkSession)
    prints = tables.keep(map_batches(texts, ["id", "key", "text"], run, f"id long, key string, node long, size int, {', '.join(f'{w} long' for w in words)}, firsts array<long>"))
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("least")
    leaves = tables.keep(prints.groupBy("node").agg(least, *[F.first(c).alias(c) for c in ("size", *words)]))
    # Just (s, node), dealt once by s: the counts below read the same shuffle.
    rows = prints.groupBy("node").agg(F.first("firsts").alias("firsts")).select("node", F.explode("firsts").alias("s")).repartition("s")
    members = rows.groupBy("s").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("of")).where("n > 1")
    once = members.groupBy("of", "n").agg(F.min("s").alias("s"))
    shared = tables.keep(rows.join(once, "s").select("s", "node", "n"))
    whole = shared.join(leaves.select("node", "size", *words), "node")
    tasks = max(1, -(-shared.count() // leaves_per_task))
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / most))
    cells = whole.withColumn("cell", F.xxhash64("s", chunk)).withColumn("root", F.col("node"))
    links = tables.keep(verified(closest(cells, tasks), leaves, texts, tables))
    roots = components(links)
    whole = tables.keep(whole.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    cells = tables.keep(meetings(whole, most))
    cells = tables.keep(candidates(cells, max(1, -(-cells.count() // leaves_per_task))))
    own = tables.keep(own_sets(cells.select("node"), leaves, texts, tables))
    held = cells.select("home", "node", "size").distinct().agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-held // shingles_per_task))
    links = links.unionByName(verified(compared(cells, own, tasks), leaves, texts, tables))
    sets = components(links)
    named = leaves.select("node", "least").join(sets, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("least").alias("head"))
    by_node = tables.keep(named.join(heads, "root").select("node", "head"))
    documents = prints.groupBy("id", "key").agg(F.first("node").alias("node"), F.count("*").alias("n"))
    out = documents.join(by_node, "node")
    found = cut(out.select(F.col("id").alias("doc_id"), "key", F.col("head.id").alias("component_id"), "n", (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))).alias("first")))
    tables.remove()
    return found


def meetings(whole: DataFrame, most: int) -> DataFrame:
    """Cells in which all sets that share a shingle meet, but for those of one root.

    Of each shingle the commonest root is the main one. Its sets meet the
    others of all its shingles at once; these meet each other shingle by
    shingle. Both are dealt to chunks, and each pair of chunks is a cell.
    """
    columns = ["node", "root", "size", *[f"f{i}" for i in range(WIDE)]]
    by_root = whole.groupBy("s", "root").agg(F.count("*").alias("k"))
    mains = by_root.groupBy("s").agg(F.max_by("root", F.struct("k", "root")).alias("main"), (F.sum("k") - F.max("k")).alias("rest"), F.count("*").alias("roots")).where("roots > 1")
    met = whole.select("s", *columns).join(mains, "s")
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda name, i, j: F.xxhash64(F.lit(name), F.col(name), i, j)
    with_main = met.dropDuplicates(["main", "node"])
    is_main = F.col("root") == F.col("main")
    crowds = with_main.groupBy("main").agg(F.ceil(F.count_if(is_main) / most).cast("int").alias("mains"), F.ceil(F.count_if(~is_main) / most).cast("int").alias("others"))
    with_main = with_main.join(crowds, "main").withColumn("cell", F.explode(F.when(is_main, F.transform(upto("others"), lambda j: cell("main", chunk("mains"), j))).otherwise(F.transform(upto("mains"), lambda i: cell("main", i, chunk("others"))))))
    rest = met.where((F.col("roots") > 2) & ~is_main).withColumn("others", F.ceil(F.col("rest") / most).cast("int"))
    rest = rest.withColumn("cell", F.explode(F.transform(upto("others"), lambda j: cell("s", F.least(chunk("others"), j), F.greatest(chunk("others"), j)))))
    return with_main.select(*columns, "cell").unionByName(rest.select(*columns, "cell"))
