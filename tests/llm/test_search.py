"""Searches and joins against brute force, and fitted models on held-out rows."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.decontaminate import benchmark_hits, without_hits
from tidemark.llm.jaccard_join import Rule, in_units, jaccard_groups, near_enough, near_pairs, parities, parity_gap, region_keys, shingle_set, word_hashes
from tidemark.llm.language import predict_language, train_language_filter
from tidemark.llm.topk import build_tree, exact_top_k, search_tree
from tidemark.llm.toxicity import FEATURES, Weights, features_of, score_toxicity, train_toxicity

SF = "/root/testdata/sf0.001"


def plain_groups(rows, rule):
    """Components by comparing every pair."""
    sets = []
    for i, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
        sets.append((i, {tuple(words[j : j + rule.width]) for j in range(max(1, len(words) - rule.width + 1))} if words else set()))
    label = {i: i for i, _ in sets}
    moved = True
    linked = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and a is not None and b is not None and rule.den * len(x & y) >= rule.num * len(x | y)]
    while moved:
        moved = False
        for a, b in linked:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(((i, len(s), label[i]) for i, s in sets), key=str)


def mutated(seed, n_base, copies, rate):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for b in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 30, 60, 150]))]
        for _ in range(rng.randrange(1, copies)):
            rows.append(" ".join(w if rng.random() > rate else rng.choice(vocabulary) for w in base))
        if b % 5 == 0:
            rows.append(" ".join(base[: len(base) - len(base) // 15]))
    return rows


@pytest.mark.parametrize(("rule", "block"), [(Rule(3, 90, 100), 2048), (Rule(5, 80, 100), 4)])
def test_jaccard_groups_match_all_pairs(spark, rule, block):
    texts = mutated(rule.width, 25, 12, 0.012)
    odd = [None, "", " \n", "one", "ONE", "one two", "One\tTWO", "x y z", "a b c d", "é É", "Ünd so", "ünd so", "long " * 3000, "long " * 3001]
    rows = [(i * 3, t) for i, t in enumerate(texts + odd)] + [(None, "one"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, n int, node string")
    got = jaccard_groups(docs, rule, block=block).collect()
    expect = plain_groups([r for r in rows if r[0] is not None], rule) + [(None, 0, None), (None, 1, None)]
    assert sorted(map(tuple, got), key=str) == sorted(expect, key=str)


def test_jaccard_groups_of_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (2, "A b  c d"), (9, "q")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_groups(docs).collect())) == [(2, 2, 2), (4, 2, 2), (4, 2, 2), (9, 1, 9)]
    assert jaccard_groups(docs.limit(0)).collect() == []


@pytest.mark.parametrize("rule", [Rule(3, 90, 100), Rule(5, 80, 100), Rule(1, 1, 2)])
def test_linked_sets_share_a_region(rule):
    rng = random.Random(5)
    ends = rule.bands(5000)
    for n in [2, 3, 4, 5, 8, 9, 10, 11, 19, 40, 200] * 12:
        a = {rng.getrandbits(64) for _ in range(n)}
        kept, b, linked = list(a), set(a), set(a)
        # the hardest case: as many differences as a link allows, some added and some taken away
        while rule.den * len(a & b) >= rule.num * len(a | b):
            linked = set(b)
            if kept and rng.random() < 0.5:
                b.discard(kept.pop())
            else:
                b.add(rng.getrandbits(64))
        if a != linked:
            x, y = (region_keys(np.array(sorted(s), "u8"), rule, ends) for s in (a, linked))
            assert len(np.intersect1d(x, y)), (n, len(a ^ linked))


def test_metric_join_in_a_region_finds_every_near_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 4, (6, 256))
    counts = np.concatenate([np.maximum(0, b + rng.integers(-1, 2, (150, 256)) * (rng.random((150, 256)) < 0.03)) for b in base]).astype("u1")
    sizes = counts.sum(axis=1).astype("i8")
    rule = Rule()
    got = {tuple(sorted(p)) for p in near_pairs(counts, sizes, rule, leaf=20, pivots=4).tolist()}
    gap = np.abs(counts[:, None, :].astype("i4") - counts[None, :, :]).sum(axis=2)
    expect = {(i, j) for i, j in itertools.combinations(range(len(sizes)), 2) if gap[i, j] <= rule.differ(int(sizes[i]), int(sizes[j]))}
    assert got == expect and expect


def test_crowded_regions_are_cut_into_block_pairs_that_hold_all_pairs(spark):
    rows = spark.range(40).selectExpr("7L as region", "id as node")
    got = in_units(rows, spark.createDataFrame([(7, 4)], "region long, blocks int")).collect()
    units = {}
    for r in got:
        units.setdefault(r["unit"], []).append((r["node"], r["side"]))
    pairs = Counter()
    for members in units.values():
        for (a, s), (b, t) in itertools.combinations(sorted(members), 2):
            if s != t or s == 2:
                pairs[a, b] += 1
    assert pairs == Counter(itertools.combinations(range(40), 2))
    assert max(len(m) for m in units.values()) < 40


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(201, 200), (200, 202), (202, 201), (300, 300)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_benchmark_hits_find_planted_items_and_leave_others(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 60)))) for i in range(40)] + [(90, "tiny item"), (91, ""), (92, None), (None, "no id at all here now"), (93, "Solo")]
    rows = [(i, " ".join(word() for _ in range(80)) + (f". {items[i % 40][1].upper()}! " if i % 2 else " ") + " ".join(word() for _ in range(30))) for i in range(80)]
    edited = items[7][1].split()
    edited[len(edited) // 2] = "changed"
    part = " ".join(items[8][1].split()[: len(items[8][1].split()) // 3])
    rows += [(200, " ".join(edited)), (201, part), (202, None), (203, ""), (204, "has a tiny, item in it"), (205, "tiny words item"), (206, "x " * 50_000 + items[3][1]), (207, f"{items[0][1]} {items[0][1]} {items[1][1]}")]
    docs = spark.createDataFrame([(i, t, i, t) for i, t in rows], "doc_id long, text string, item_id long, similarity string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = benchmark_hits(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in hits}
    lost = len(edited) - 4
    expect = {(i, i % 40) for i in range(80) if i % 2} | {(204, 90), (206, 3), (207, 0), (207, 1)}
    if (lost - 5) / (lost + 5) >= 0.85:
        expect |= {(200, 7)}
    assert got - {(200, 7)} == expect - {(200, 7)} and expect <= got
    first = {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_words"]) for r in hits}
    assert first[206, 3] == (50_000, len(items[3][1].split())) and first[207, 0][0] == 0
    sliced = {(r["doc_id"], r["item_id"]) for r in benchmark_hits(docs, bench, slice_bytes=2000).collect()}
    assert sliced - {(200, 7)} == got - {(200, 7)}
    assert {r["doc_id"] for r in without_hits(docs, bench).collect()} == {r[0] for r in rows} - {d for d, _ in got}
    assert benchmark_hits(docs, bench.limit(0)).collect() == [] and benchmark_hits(docs.limit(0), bench).collect() == []


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "c") for i in range(300)]
    rows += [(1000 + i, [0.5] * 6, "c") for i in range(40)] + [(2000, None, "c"), (2001, [1.0, None], "c"), (2002, [float("nan")] * 6, "c"), (2003, [float("inf")] * 6, "c"), (None, [1.0] * 6, "c")]
    rows += [(2010, [9.0, 9.0], "c"), (1000, [0.5] * 6, "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted(map(tuple, exact_top_k(vectors, F.col("vec_id") % 50 == 0, shard_rows=60, block_rows=3, leaf=8).collect()))
    fine = {(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    expect = []
    for q, a in fine:
        if q % 50 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q))[:5]
            expect += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == sorted(expect)
    assert exact_top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_tree_prunes_and_keeps_ties_and_large_numbers():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.integers(-50, 50, (500, 4)) + 1000 * g for g in range(4)])
    ids = np.arange(len(rows))
    tree = build_tree(ids, rows, 16)
    queries, q_ids = np.array([[1.0, 2, 3, 4], [-1, 0, 0, 0]]), np.array([-1, -2])
    s, i = np.full((2, 3), -(2**63) + 1), np.full((2, 3), 2**63 - 1)
    search_tree(tree, q_ids, queries, s, i, np.full(2, -np.inf))
    for k in range(2):
        scores = rows @ queries[k].astype(int)
        best = sorted(zip(-scores, ids))[:3]
        assert [(-a, b) for a, b in best] == list(zip(s[k], i[k]))
    big = build_tree(np.array([1, 2]), np.array([[2.0**30, 1], [2.0**30, 2]]), 16)
    s, i = np.full((1, 1), -(2**63) + 1), np.full((1, 1), 2**63 - 1)
    search_tree(big, np.array([9]), np.array([[2.0**31, 1]]), s, i, np.full(1, -np.inf))
    assert (s[0, 0], i[0, 0]) == (2**61 + 2, 2)


def test_language_filter_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train_language_filter(docs.where("doc_id % 4 <> 2"))
    got = predict_language(docs, model, [F.col("doc_id"), F.col("lang")]).toDF("doc_id", "lang", "lang_pred", "score").where("doc_id % 4 = 2").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.9 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?!"), (4, "the and the"), (5, "the " * 40_000), (4, "the and the"), (None, "漢字")], "doc_id long, text string")
    out = predict_language(odd, model, [F.col("doc_id")]).collect()
    assert [r[1] for r in out[:3]] == ["und"] * 3 and [r[2] for r in out[:3]] == [0.0] * 3 and out[3][1:] == out[5][1:] and out[4][1] == "en" and out[6][1] in model.languages and out[6][2] == 0.0
    nothing = train_language_filter(docs.limit(0))
    assert {r[1] for r in predict_language(odd, nothing, [F.col("doc_id")]).collect()} == {"und"}


def test_toxicity_of_a_small_table_by_held_out_labels(spark):
    """A few hundred labels, some thirty of them toxic to learn from: all serve lexicon, trees and calibration."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    other = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = train_toxicity(docs, labels, ~other)
    rows = score_toxicity(docs.where(other), model, [F.col("doc_id")], ["doc_id"]).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    area = sum((x > y) + 0.5 * (x == y) for x in bad for y in good) / (len(bad) * len(good))
    assert area > 0.9 and sum(x >= 0.7 for x in bad) > len(bad) / 2 and sum(x >= 0.7 for x in good) <= 1


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    bad = ["moron", "trash", "scum"]
    rows, labels = [], []
    for i in range(900):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 40))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(i % 3 == 0)))
    labels += [(3, 0), (5, None), (7, 9), (None, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train_toxicity(docs, known, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, rounds=5)
    got = score_toxicity(docs, model, [F.col("doc_id"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1], ["doc_id", "held_out"]).where("held_out").collect()
    wrong = [r for r in got if r["predicted"] != int(r["doc_id"] % 3 == 0)]
    assert len(got) > 200 and len(wrong) <= 0.05 * len(got), wrong[:5]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "you MORON!!! m0ron"), (3, "you MORON!!! m0ron"), (4, "x " * 40_000)], "doc_id long, text string")
    out = [r["score"] for r in score_toxicity(odd, model, [F.col("doc_id")], ["doc_id"]).collect()]
    assert len(out) == 5 and all(0 <= s <= 1 for s in out) and out[0] == out[1] and out[2] == out[3] and out[2] > 0.7
    assert {r["score"] for r in score_toxicity(odd, train_toxicity(docs, known.limit(0), F.lit(True)), [F.col("doc_id")], ["doc_id"]).collect()} == {0.0}
    one = train_toxicity(docs, known.where("toxic = 1"), F.lit(True))
    assert {r["score"] for r in score_toxicity(odd, one, [F.col("doc_id")], ["doc_id"]).collect()} == {1.0}
    assert score_toxicity(odd.limit(0), model, [F.col("doc_id")], ["doc_id"]).collect() == []


def test_shingles_of_few_words():
    known = word_hashes()
    assert [len(shingle_set(t, 3, known)) for t in (None, "", "a", "a b", "a b c", "a b c a b c")] == [0, 0, 1, 1, 1, 3]
    assert shingle_set("A B", 3, known).tolist() == shingle_set("a  b", 3, known).tolist() != shingle_set("b a", 3, known).tolist()


def test_benchmark_slices_change_no_row(spark):
    """Weights count the whole benchmark, also for shingles that only items of other slices hold."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(12)]
    items = [(i, [word() for _ in range(40)] + (shared if i % 3 else []) + [word() for _ in range(10)]) for i in range(30)]
    rows = []
    for i, own in items:
        for k in range(1, 8):  # near the bar: some words changed, some taken from another item
            text = list(own)
            text[-k:] = items[(i + 1) % 30][1][:k] if k % 2 else [word() for _ in range(k)]
            rows.append((100 * i + k, " ".join([word(), *text, word()])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items] + [(90, "tiny item")], "item_id long, text string")
    whole = sorted(map(tuple, benchmark_hits(docs, bench, slice_bytes=1 << 30).collect()))
    assert 0 < len(whole) < len(rows) and any(s < 0.85 for *_, s in whole)
    assert whole == sorted(map(tuple, benchmark_hits(docs, bench, slice_bytes=4000).collect()))
    assert whole == sorted(map(tuple, benchmark_hits(docs, bench, part_rows=500).collect()))


def test_near_you_at_any_length():
    rng = random.Random(3)
    for size in (0, 1, 30, 5000):
        text = [rng.choice(["you", "bad", "u", *"abcdefghijkl"]) for _ in range(size)]
        you = [i for i, x in enumerate(text) if x in ("you", "u")]
        near = sum(x == "bad" and any(abs(i - j) <= 5 for j in you) for i, x in enumerate(text))
        assert features_of(" ".join(text), Weights({"bad": 2.0}))[FEATURES.index("near_you")] == (near / size if size else 0)
    text = " ".join(["you bad"] + ["x"] * 20 + ["you"] * 1000)
    assert features_of(text, Weights({"bad": 2.0}))[FEATURES.index("near_you")] == 1 / 1022


def test_parities_drop_long_sets_that_share_little_and_no_linked_ones(spark):
    rng, rule = np.random.default_rng(5), Rule(5, 80, 100)
    sets = {}
    for i, n in enumerate([1, 3, 40, 700, 7000, 16000]):
        base = rng.integers(0, 2**63, n).astype("u8")
        differ = rule.differ(n, n) // 2  # as far apart as two linked sets of one size can be
        sets[2 * i] = np.unique(base)
        sets[2 * i + 1] = np.unique(np.concatenate([base[differ:], rng.integers(0, 2**63, differ).astype("u8")]))
    sets[100] = np.unique(rng.integers(0, 2**63, 15000).astype("u8"))
    for i in range(0, 12, 2):
        a, b = sets[i], sets[i + 1]
        assert parity_gap(parities(a), parities(b)) <= len(np.setxor1d(a, b)) <= rule.differ(len(a), len(b))
    made = spark.createDataFrame([(i, len(s), parities(s)) for i, s in sets.items()], "doc_id long, n int, bits binary")
    linked = [(i, i + 1) for i in range(0, 12, 2)]
    pairs = spark.createDataFrame([*linked, (10, 100), (8, 10)], "a long, b long")
    assert sorted(map(tuple, near_enough(pairs, made, rule).collect())) == linked
