"""SimHash, phrases, substrings and decontamination against brute force."""

import hashlib
import random
import re
import tracemalloc
import weakref
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lacuna.llm import common, decontaminate, phrases, simhash, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def crowd(spark):
    """Copies, near copies and shared passages, dealt out at random."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    base = rng.choices(vocabulary, k=120)
    rows = []
    for i in range(160):
        kind = rng.random()
        if kind < 0.3:
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.5:
            words = rng.choices(vocabulary, k=60) + passage + rng.choices(vocabulary, k=rng.randrange(40))
        elif kind < 0.6:
            words = ["again"] * rng.randrange(40)
        else:
            words = rng.choices(vocabulary, k=rng.randrange(80))
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def by_brute_force(prints: dict[int, int]) -> dict[int, int]:
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(ids, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_simhash(crowd):
    def print_of(text):
        words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {r.doc_id: print_of(r.text) for r in crowd.collect()}
    label = by_brute_force(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.group_near_copies(crowd).collect()}
    assert got == {i: (f"{p:016x}", label[i]) for i, p in prints.items()}
    assert len(set(label.values())) < len(label)


def test_trie_join_on_crowded_leaves():
    rng = np.random.default_rng(2)
    values = np.full(600, rng.integers(0, 1 << 63, dtype=np.uint64))
    for _ in range(6):
        values ^= np.uint64(1) << rng.integers(0, 64, len(values)).astype(np.uint64)
    values = np.unique(values)
    want = by_brute_force(dict(enumerate(values.tolist())))
    assert simhash.trie_join(np.zeros(len(values), np.int64), values, 0).tolist() == [want[i] for i in range(len(values))]


def test_simhash_chunks_and_tasks_do_not_matter(spark, crowd):
    leaves = simhash.fingerprints(crowd).select("fp").distinct()
    sets = [sorted(map(tuple, simhash.components(simhash.links(leaves, **k)).collect())) for k in ({}, {"most": 3, "leaves_per_task": 40})]
    assert sets[0] == sets[1]


def test_simhash_of_odd_texts(odd, none):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.group_near_copies(odd).collect()]
    assert len(got) == 12 and {(1, "0" * 16, 1), (2, "0" * 16, 1), (3, "0" * 16, 1)} <= set(got)
    assert got.count((7, got[[g[0] for g in got].index(7)][1], 7)) == 2
    assert simhash.group_near_copies(none).collect() == []


def test_near_copies_of_odd_texts(odd, none):
    found = simhash.group_loose_copies(odd).collect()
    assert {(r.doc_id, r.component_id, r.n, r.first) for r in found} >= {(1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (0, 0, 1, True), (4, 0, 1, False), (7, 7, 2, True), (None, None, 1, True)}
    assert simhash.group_loose_copies(none).collect() == []


def test_forest_takes_the_lightest_links():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 40, (2, 300))
    bits = rng.integers(0, 72, 300)
    stay = simhash.forest(np.arange(40), a, b, bits)
    label, weight = list(range(40)), 0
    for k in np.lexsort((np.arange(300), bits)):
        x, y = label[a[k]], label[b[k]]
        if x != y:
            weight += bits[k]
            label = [x if v == y else v for v in label]
    assert bits[stay].sum() == weight and len(stay) == 40 - len(set(label))


def shingle_sets(texts):
    return {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in texts.items()}


def lone_pairs(changed, n=250):
    """Unrelated pairs of texts of 200 words, of which so many are changed, each for itself."""
    rng, rows = random.Random(changed), []
    for i in range(n):
        words = [f"p{rng.randrange(10**9)}" for _ in range(200)]
        other = list(words)
        for k in rng.sample(range(10, 190, 10), changed):
            other[k] = f"q{rng.randrange(10**9)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    return rows


def test_near_copies_by_brute_force(spark, crowd):
    """All pairs at 0.8 or more are linked, and no others: 0.81 (176 of 216 shingles) is, 0.77 (171 of 221) is not."""
    texts = {r.doc_id: r.text for r in crowd.collect()}
    texts |= {1000 + i: t for i, t in lone_pairs(4)} | {2000 + i: t for i, t in lone_pairs(5, 60)}
    sets = shingle_sets(texts)
    label, tried = {i: i for i in texts}, 0
    for a, b in [*combinations(sorted(i for i in texts if i < 1000), 2), *((i, i + 1) for i in texts if i >= 1000 and i % 2 == 0)]:
        if label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            tried += 1
            label = {i: min(label[a], label[b]) if x in (label[a], label[b]) else x for i, x in label.items()}
    assert tried > 270 and all(label[2001 + 2 * i] != label[2000 + 2 * i] for i in range(60))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for more in ({}, {"most": 2, "leaves_per_task": 50}):
        assert {r.doc_id: r.component_id for r in simhash.group_loose_copies(docs, **more).collect()} == label


def expected_left(rows):
    """(n_words, n_removed, digest) of each row, by definition."""
    first = {}
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    for i, w in split:
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            first[key] = min(first.get(key, float("inf")), rank(i))
    out = []
    for i, w in split:
        gone = {p + k for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < rank(i) for k in range(13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_substrings(crowd):
    want = expected_left([(r.doc_id, r.text) for r in crowd.collect()])
    assert sum(x[2] for x in want) > 1000
    for more in ({}, {"docs_per_bucket": 9, "bytes_per_shard": 2000}, {"docs_per_bucket": 9, "bytes_per_shard": 2000, "crowd": 1}):
        assert sorted(map(tuple, substrings.dedup(crowd, **more).collect()), key=str) == want


def test_substrings_of_odd_texts(odd, none):
    want = expected_left([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(map(tuple, substrings.dedup(odd).collect()), key=str) == want
    assert substrings.dedup(none).collect() == []
    kept = substrings.dedup(odd, keep=["source"], with_text=True).collect()
    assert {r.source for r in kept} == {"src"} and {r.doc_id: r.text for r in kept}[3] == "   \n\t "


def test_fm_index_counts():
    from lacuna.llm.fmindex import FMIndex

    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 4, 300), 0)
    at = np.arange(290)
    low, high = FMIndex(text, 4).search(text, at, 8)
    for a in at:
        n = sum((text[i : i + 8] == text[a : a + 8]).all() for i in range(293))
        assert high[a] - low[a] == n or (n == 1 and high[a] - low[a] == 1)


def test_phrases(odd, none, spark):
    rows = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "", r.doc_id) for r in odd.collect())
    want = []
    for k, (_, text, i) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        want.append((i, len(text), hashlib.sha256(phrases.edited(text, after).encode()).hexdigest()))
    for size in (8 << 20, 300):
        phrases.BYTES_PER_PART, was = size, phrases.BYTES_PER_PART
        got = phrases.fingerprints(odd).collect()
        phrases.BYTES_PER_PART = was
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
        same = {r.doc_id: r.fingerprint for r in got}
        assert same[0] == same[4] and same[1] == same[2] == ""
    assert phrases.fingerprints(none).collect() == []


def naive_print(text):
    """A text's fingerprint, symbol by symbol."""
    top, gold = 2**64 - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & top
        x = (x ^ x >> 29) * 0x9FB21C651E98DF25 & top
        return x ^ x >> 32

    def toss(names):
        out = []
        for i, x in enumerate(names):
            differ = x ^ names[i - 1] if i else 1
            low = (differ & -differ).bit_length() - 1
            out.append(low << 1 | x >> low & 1)
        return out

    x, names = [ord(c) for c in text], set()
    for level in range(1, phrases.LEVELS + 1):
        if not x:
            break
        runs = []
        for c in x:
            if runs and runs[-1][0] == c:
                runs[-1][1] += 1
            else:
                runs.append([c, 1])
        x = [c if n == 1 else mix((c + n * gold) & top) for c, n in runs]
        label = x
        for _ in range(4):
            label = toss(label)
        cuts = [i for i in range(len(x)) if i == 0 or (i + 1 < len(x) and label[i] > label[i - 1] and label[i] > label[i + 1])]
        x = [mix(sum(mix((c + (p + 1) * gold) & top) for p, c in enumerate(x[a:b])) & top) for a, b in zip(cuts, [*cuts[1:], len(x)])]
        if level >= phrases.LOWEST:
            names.update(mix(n) >> 32 for n in x)
            if len(x) == 1:
                break
    return sorted(names)[: phrases.KEPT]


def naive_likeness(a, b):
    if not a or not b:
        return float(a == b)
    least = sorted({*a, *b})[: phrases.KEPT]
    j = len({*a} & {*b} & {*least}) / len(least)
    return 2 * j / (1 + j)


def test_phrases_against_single_symbols(spark):
    rng = random.Random(4)
    texts = ["", "a", "aaaa", "abab" * 30, "日本語 😀 " * 20, *(" ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat", "aa"], k=rng.randrange(1, 400))) for _ in range(25))]
    texts[20:22] = [texts[19], texts[19] + " and more of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [naive_print(t) for t in texts]
    for r in phrases.fingerprints(docs).collect():
        after = (r.doc_id + 1) % len(texts)
        new = naive_print(phrases.edited(texts[r.doc_id], texts[after]))
        assert [r.fingerprint, r.edited_fingerprint] == ["".join(f"{x:08x}" for x in p) for p in (own[r.doc_id], new)]
        assert (r.near_edited, r.near_next) == (pytest.approx(naive_likeness(own[r.doc_id], new)), pytest.approx(naive_likeness(own[r.doc_id], own[after])))


def test_phrases_do_not_depend_on_the_offset():
    rng = random.Random(1)
    core = "".join(rng.choices("abcdefgh ", k=4000))
    a, b, c = phrases.sketches([core, "zq" * 3 + core + "xx", "".join(rng.choices("abcdefgh ", k=4000))])
    assert phrases.likeness(a, b) > 0.9 and phrases.likeness(a, a) == 1 and phrases.likeness(a, c) < 0.3


def test_phrases_next_to_other_texts():
    texts = ["abcabcab" * 9, "", "q", "the cat sat on the mat " * 3]
    alone = [phrases.sketches([t])[0].tolist() for t in texts]
    assert [s.tolist() for s in phrases.sketches(texts)] == alone


def test_masks_survive_all_allowed_substitutions():
    for gone in combinations(range(decontaminate.WINDOW), 2):
        assert any(not {s + o for o in m} & set(gone) for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - decontaminate.SPAN + 1))
    for n in range(1, decontaminate.WINDOW):
        masks = [own for length, own in decontaminate.picks([n]) if length == n]
        for gone in combinations(range(n), n - decontaminate.least_equal(n)):
            assert any(not {*own} & {*gone} for own in masks)


def by_the_rule(text, item):
    """(start, matched, stretch) of the best place of an item in a text, or None."""
    toks, n = re.findall(r"[^\W_]+", text.lower()), len(item)
    stretch, best = min(13, n), None
    for start in range(-n, len(toks)):
        same = [toks[start + k] == item[k] for k in range(n) if 0 <= start + k < len(toks)]
        for i in range(len(same) - stretch + 1):
            got = sum(same[i : i + stretch])
            if 5 * got >= 4 * stretch and (best is None or got > best[1]):
                best = (start, got, stretch)
    return best


def test_items_of_every_length_by_the_rule(spark, monkeypatch):
    rng = random.Random(12)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(1, 21)}
    docs, want = {}, {}
    for i in range(240):
        n = 1 + i % 20
        own, most = list(items[n]), min(n, 13) - decontaminate.least_equal(min(n, 13))
        for p in rng.sample(range(n), min(n, rng.randrange(most + 2))):
            own[p] = "changed"
        before, after = ([f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 9))] for _ in "ab")
        docs[i] = " ".join([*before, *own, *after])
    docs[240] = " ".join(f"w{rng.randrange(50)}" for _ in range(30_000)) + " " + " ".join(items[20])
    for i, text in docs.items():
        want |= {(i, n): best for n, item in items.items() if (best := by_the_rule(text, item))}
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()] + [(30, "?!")], "item_id long, text string")
    frame = spark.createDataFrame([*docs.items(), *list(docs.items())[:40]], "doc_id long, text string")
    rows = []
    for most in (200_000, 0):
        monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
        rows.append(sorted(map(tuple, decontaminate.find(frame, bench).collect())))
    assert rows[0] == rows[1]
    assert {(r[0], r[1]): r[3:6] for r in rows[0]} == want and len(rows[0]) == len(want) > 150


def test_decontamination(spark, odd, none):
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(900)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate((30, 18, 13, 9, 6, 4))] + [(9, None), (10, "")]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, toks int")
    docs, want = [], set()
    for i in range(60):
        words = rng.choices(vocabulary, k=50)
        if i % 3 == 0:
            k = rng.randrange(6)
            item = items[k][1].upper().split()
            if len(item) >= 13:
                for p in rng.sample(range(0, len(item), 7), 2):
                    item[p] = "CHANGED"
            words[20:20] = [w + ("%%%" if rng.random() < 0.1 else "") for w in item]
            want.add((i, k))
        docs.append((i, "  ".join(words)))
    frame = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, h int")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(frame, bench).collect()} == want
    most, decontaminate.MOST_BROADCAST = decontaminate.MOST_BROADCAST, 0
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(frame, bench).collect()} == want
    decontaminate.MOST_BROADCAST = most
    left = {r.doc_id for r in decontaminate.drop_contaminated(frame, bench).collect()}
    assert left == set(range(60)) - {i for i, _ in want}
    assert decontaminate.find(odd, bench).collect() == [] == decontaminate.find(none, bench).collect()
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == 12
    orphan = spark.createDataFrame([(1, "text without any id that still has to be read like all")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.find(odd, orphan).collect()] == [None]


def test_decontamination_by_broadcast_and_shuffle(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(900)]
    texts = [rng.choices(vocabulary, k=n) for n in (30, 24, 20, 15, 15)]
    # Null ids, and two texts under one id.
    ids = (0, 1, None, 7, 7)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, texts)], "item_id long, text string")
    docs = [(k, " ".join(rng.choices(vocabulary, k=30) + texts[k % 5] + rng.choices(vocabulary, k=20 * (k % 3)))) for k in range(10)]
    frame = spark.createDataFrame([*docs, (None, docs[0][1])], "doc_id long, text string")
    paths = []
    for most in (200_000, 0):
        monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
        paths.append(sorted(map(tuple, decontaminate.find(frame, bench).collect()), key=str))
    assert paths[0] == paths[1]
    assert {(r[0], r[1]) for r in paths[0]} == {(k, ids[k % 5]) for k in range(10)} | {(None, 0)}
    # Every seed of an item found whole is a hit.
    hits = {r[0]: r[-1] for r in paths[0]}
    assert all(hits[k] >= 2 * (len(texts[k % 5]) - decontaminate.SPAN + 1) for k in range(10))


def test_traversal_memory_is_bounded():
    """Families of near copies in many groups; before, 48 MB for these leaves."""
    rng = np.random.default_rng(1)
    bits = lambda n: rng.integers(0, 2**63, (n, 4), dtype=np.int64).view(np.uint64)
    leaves, groups = 20_000, 67
    family = np.arange(leaves) % (4 * groups)
    values, group = bits(4 * groups)[family] ^ (bits(leaves) & bits(leaves) & bits(leaves)), family // 4
    order = np.lexsort((*values.T[::-1], group))
    tracemalloc.start()
    found = sum(len(a) for a, _, _ in simhash.traverse(group[order], values[order], np.arange(leaves), 0, 72))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > leaves
    assert peak < 24e6


def test_memory_is_released_after_a_group_is_gone(monkeypatch):
    """Variables of the function must not live when its memory is given back."""
    left = []

    def run(n):
        own = np.zeros(n)
        left.append(weakref.ref(own))
        return n

    monkeypatch.setattr(common, "release", lambda: left.append(left[0]() is None))
    assert common.released(run, 5) == 5
    assert left[1:] == [True]


def test_sets_are_compared_in_bounded_portions():
    size = np.array([5, 3, 9, 1, 1, 12, 2])
    parts = simhash.portions(np.array([6, 0, 1, 2, 3, 5]), size, 8)
    assert np.concatenate(parts).tolist() == [6, 0, 1, 2, 3, 5]
    assert max(size[p[1:]].sum() for p in parts) < 8 and min(map(len, parts)) > 0
    own = [np.array(x, np.uint32) for x in ([1, 2, 9], [2, 9, 11], [3], [1, 2, 9])]
    assert simhash.in_common(own, 0, np.array([1, 2, 3])).tolist() == [2, 0, 3]
