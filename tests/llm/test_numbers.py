import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import mixing, percentiles, splits
from tidemark.llm.tokens import TOKENIZERS, Counter

PS = [0.0, 0.25, 0.5, 0.9, 1.0]


def brute(rows):
    out = {}
    for k in {k for k, _ in rows}:
        v = [x for kk, x in rows if kk == k and x is not None and math.isfinite(x)]
        for p in PS if v else ():
            out[(k, p)] = (float(np.percentile(np.array(v), 100 * p)), len(v))
    return out


@pytest.mark.parametrize("kind", ["uniform", "ties", "tails", "odd"])
def test_percentiles_are_exact(spark, kind):
    rng = random.Random(5)
    make = {"uniform": lambda: rng.random(), "ties": lambda: float(rng.randrange(4)), "tails": lambda: rng.choice([1, -1]) * 10 ** rng.uniform(-8, 12), "odd": lambda: rng.choice([None, float("nan"), float("inf"), -0.0, 0.0, 1e308, -1e308, 5e-324])}[kind]
    rows = [(rng.choice(["hot", "hot", "a", None]), make()) for _ in range(500)] + [("none", None), ("one", 3.5)]
    got = {(r["k"], r["percentile"]): (r["value"], r["n"]) for r in percentiles.exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", PS).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, (v, n) in want.items():
        assert n == got[k][1] and (math.isclose(v, got[k][0], rel_tol=1e-9, abs_tol=1e-300) or abs(v) > 1e300), k


def test_percentiles_of_nothing_and_without_keys(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert [r["value"] for r in percentiles.exact_percentiles(df, [], "v", [0.5]).collect()] == [1.5]
    assert percentiles.exact_percentiles(df.limit(0), [], "v", [0.5]).count() == 0
    assert percentiles.exact_percentiles(df.selectExpr("cast(null as double) v", "'x' k"), ["k"], "v", [0.5]).count() == 0


def test_summaries_of_separate_days_combine_within_their_error(spark):
    rng = random.Random(2)
    rows = [("a", d, rng.choice([0.0, rng.lognormvariate(0, 2)])) for d in range(5) for _ in range(300)]
    df = spark.createDataFrame(rows, "arm string, day int, v double")
    parts = [percentiles.summaries(df.where(f"day = {d}"), ["arm", "day"], "v", 0.01) for d in range(5)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    v = np.sort([x for *_, x in rows])
    for r in percentiles.combine(whole, ["arm"], PS, 0.01).collect():
        true = v[math.ceil(r["percentile"] * (len(v) - 1))]
        assert abs(r["value"] - true) <= 0.01 * true + 1e-12 and r["n"] == len(v)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 4)), max_size=7, unique_by=lambda x: x[0]), st.integers(0, 300))
def test_the_knapsack_is_as_good_as_any_choice(items, budget):
    lens, counts = [n for n, _ in items], [c for _, c in items]
    took, used = mixing.fit(lens, counts, budget)
    reach = {0}
    for n, c in items:
        reach = {r + n * k for r in reach for k in range(c + 1)}
    assert used == sum(n * k for n, k in zip(lens, took)) == max(r for r in reach if r <= budget)
    assert all(0 <= k <= c for k, c in zip(took, counts))


def test_large_budgets_are_met_nearly_to_the_token():
    rng = random.Random(1)
    lens = list(range(50, 1500, 3))
    counts = [rng.randrange(1, 2000) for _ in lens]
    whole = sum(n * c for n, c in zip(lens, counts))
    for share in (0.1, 0.5, 0.99):
        took, used = mixing.fit(lens, counts, int(share * whole))
        assert 0 <= int(share * whole) - used <= 2 and all(k <= c for k, c in zip(took, counts))


def test_mix_gives_each_source_its_share_and_respects_the_cap(spark):
    pytest.importorskip("tiktoken")
    docs = [(i, ["big", "small", None, "big"][i % 4], None if i % 50 == 0 else "word " * (1 + i * 7 % 90)) for i in range(400)]
    n = mixing.lengths(spark.createDataFrame(docs, "d long, s string, t string"), "d", "s", "t")
    t = spark.createDataFrame([("big", 0.5, 2), ("small", 0.45, 1), ("absent", 0.05, 3), ("big", 0.5, 2)], "source string, target_share double, max_repeats int")
    shares, takes = mixing.plan(n, t)
    s = {r["source"]: r for r in shares.collect()}
    assert not s["big"]["out_of_reach"] and s["small"]["out_of_reach"] and s["absent"]["out_of_reach"]
    assert 0 <= s["big"]["target_tokens"] - s["big"]["actual_tokens"] < 2 and s["small"]["actual_tokens"] == s["small"]["tokens"]
    p = mixing.pick(n, takes, seed=3).collect()
    for k in ("big", "small"):
        assert sum(r["n_tokens"] * r["repeats"] for r in p if r["source"] == k) == s[k]["actual_tokens"]
    assert max(r["repeats"] for r in p) <= 2 and {(r["id"], r["repeats"]) for r in p} == {(r["id"], r["repeats"]) for r in mixing.pick(n.repartition(3), takes, seed=3).collect()}
    e, _ = mixing.plan(n.limit(0), t)
    assert e.where("out_of_reach").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_token_counts_equal_the_tokenizer_s_own(text):
    tiktoken = pytest.importorskip("tiktoken")
    import os

    at = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    if not os.path.exists(at):
        pytest.skip("no vocabulary here")
    c = Counter.at(at)
    assert isinstance(c._core, tiktoken.Encoding) and c.count(text) == len(c._core.encode_ordinary(text)) and c.count(None) == 0


def test_keys_of_people_and_pages(spark):
    from pyspark.sql import functions as F

    a = {"@Ann_Lee": "ann_lee", " ANN-LEE": "ann_lee", "ann.lee": "ann_lee", "Ann Lee": "ann_lee", "n/a": None, "Anonymous": None, "-": None, "": None, None: None}
    p = {"https://X.example/a/b": "x.example/a/b", "HTTP://www.x.example/a/b/#top": "x.example/a/b", "x.example/a/b?utm_source=f&ref=l": "x.example/a/b", "x.example/a/b?id=7&utm_id=1": "x.example/a/b?id=7", "https://x.example/": None, "https://x.example": None, "about:blank": None, "unknown": None, None: None}
    for want, key in ((a, splits.author_key), (p, splits.page_key)):
        df = spark.createDataFrame([(k,) for k in want], "k string").select("k", key(F.col("k")).alias("v"))
        assert {r["k"]: r["v"] for r in df.collect()} == want


def test_entities_and_conflicts(spark):
    r = spark.createDataFrame([("t1", "a", None), ("t2", "a", "p"), ("t3", None, "p"), ("t4", "b", None), ("t5", None, None), (None, "a", "p"), ("t1", "a", None)], "task string, author string, page string")
    e = splits.entities(r, "task", ["author", "page"])
    assert {tuple(x) for x in e.collect()} == {("t1", "t1"), ("t2", "t1"), ("t3", "t1")}
    g = spark.createDataFrame([("t1", "train"), ("t3", "test"), ("t2", None), ("t4", "val"), ("t5", "train"), ("t5", "val"), ("t9", "val"), (None, "val")], "task string, split string")
    assert {tuple(x) for x in splits.conflicts(e, g, "task", "split").collect()} == {("t1", "t1"), ("t1", "t3"), ("t5", "t5")}
    assert splits.conflicts(e, g.limit(0), "task", "split").count() == 0


@pytest.mark.parametrize("bundles", [splits.BUNDLES, 60])
def test_assigned_splits_keep_entities_whole_and_ratios(spark, monkeypatch, bundles):
    monkeypatch.setattr(splits, "BUNDLES", bundles)
    rng = random.Random(4)
    rows = [(f"e{int(rng.paretovariate(1.2)) % 150}" if i % 3 else "giant" if i % 30 == 0 else f"s{i}", rng.choice("xxy")) for i in range(3000)] + [(None, "x")]
    df = spark.createDataFrame(rows, "e string, l string")
    a = splits.assign(df, "e", "l", {"train": 0.6, "val": 0.2, "test": 0.2})
    got = [tuple(r) for r in a.collect()]
    assert len(got) == len({e for e, _ in got}) == len({e for e, _ in rows if e})
    for r in splits.shares(a, df, "e", "l").collect():
        assert abs(r["share"] - {"train": 0.6}.get(r["split"], 0.2)) < 0.03
    assert splits.assign(df.limit(0), "e", "l", {"train": 1.0}).count() == 0


@pytest.mark.parametrize("bundles", [splits.BUNDLES, 300])
def test_splits_are_balanced_by_weight_and_by_rare_labels(spark, monkeypatch, bundles):
    monkeypatch.setattr(splits, "BUNDLES", bundles)
    # More small entities than bundles, one entity in ninety with the rare label, and one task with a tenth of all rows.
    rows = [(f"e{i}", "rare" if i % 90 == 0 else "x", 1 + i % 4) for i in range(9000)] + [("giant", "x", 2500)]
    df = spark.createDataFrame(rows, "e string, l string, n long")
    ratios = {"train": 0.6, "val": 0.2, "test": 0.2}
    a = splits.assign(df, "e", "l", ratios, weight="n")
    assert a.count() == a.select("entity").distinct().count() == len(rows)
    got = {(r["label"], r["split"]): r for r in splits.shares(a, df, "e", "l", weight="n").collect()}
    assert sum(r["n"] for r in got.values()) == sum(n for *_, n in rows)
    for k in ("x", "rare"):
        for s, want in ratios.items():
            assert abs(got[k, s]["share"] - want) < 0.02


@pytest.mark.parametrize("n", [15_000, 45_000])
def test_splits_are_balanced_on_either_side_of_twenty_thousand_entities(spark, n):
    df = spark.range(n).selectExpr("concat('e', id) AS e", "CASE WHEN id % 500 = 0 THEN 'rare' WHEN id % 3 = 0 THEN 'y' ELSE 'x' END AS l", "1 + id % 7 AS n")
    ratios = {"train": 0.6, "val": 0.2, "test": 0.2}
    a = splits.assign(df, "e", "l", ratios, weight="n")
    assert a.count() == n
    for r in splits.shares(a, df, "e", "l", weight="n").collect():
        assert abs(r["share"] - ratios[r["split"]]) < (0.05 if r["label"] == "rare" else 0.002)


def _best(lens, counts, budget):
    """The greatest reachable sum, by brute force."""
    reach = {0}
    for n, c in zip(lens, counts):
        reach = {x + n * k for x in reach for k in range(c + 1) if x + n * k <= budget}
    return max(reach)


def test_long_texts_are_fitted_as_near_as_any_choice_can():
    assert mixing.fit([380_000, 500_000], [1, 10], 2_400_000)[1] == 2_380_000
    rng = random.Random(12)
    for _ in range(60):
        lens = rng.sample(range(1_000, 900_000), rng.randint(1, 5))
        counts = [rng.randint(1, 4) for _ in lens]
        budget = rng.randint(1, sum(n * c for n, c in zip(lens, counts)))
        took, used = mixing.fit(lens, counts, budget)
        assert used == sum(n * k for n, k in zip(lens, took)) == _best(lens, counts, budget) and all(k <= c for k, c in zip(took, counts))


def test_budgets_far_above_the_fitted_span_are_met_too():
    rng = random.Random(13)
    for top in (300, 40_000, 700_000):
        lens = rng.sample(range(10, top), 40)
        counts = [rng.randint(1, 3_000) for _ in lens]
        whole = sum(n * c for n, c in zip(lens, counts))
        for share in (0.2, 0.71, 0.99):
            budget = int(whole * share)
            took, used = mixing.fit(lens, counts, budget)
            assert 0 <= budget - used <= 2 and used == sum(n * k for n, k in zip(lens, took)) and all(0 <= k <= c for k, c in zip(took, counts))


def test_one_length_of_a_third_of_all_documents_is_cut_at_the_right_number(spark):
    docs = [(i, "hot", 7) for i in range(900)] + [(1000 + i, "hot", 3 + i % 5) for i in range(90)]
    n = spark.createDataFrame(docs, "id long, source string, n_tokens long")
    takes = spark.createDataFrame([("hot", 7, 1, 333), ("hot", 3, 0, 0)], "source string, n_tokens long, passes long, more long")
    got = [r["repeats"] for r in mixing.pick(n, takes, seed=1).where("n_tokens = 7").collect()]
    assert sorted(got) == [1] * (len(got) - 333) + [2] * 333 and len(got) >= 900
    assert mixing.pick(n, takes, seed=1).where("n_tokens = 3").count() == 0
    assert {r["id"] for r in mixing.pick(n, takes, seed=2).where("repeats = 2").collect()} != {r["id"] for r in mixing.pick(n, takes, seed=1).where("repeats = 2").collect()}


def test_very_long_tails_are_resolved_in_few_passes(spark, monkeypatch):
    """Values from the least to the greatest double on either side of zero."""
    rng = random.Random(3)
    vs = [s * 10.0 ** rng.uniform(-300, 300) for s in (-1, 1) for _ in range(800)] + [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] + [7.0] * 300
    passes = []
    was = percentiles.cut
    monkeypatch.setattr(percentiles, "cut", lambda df: passes.append(1) or was(df))
    df = spark.createDataFrame([("a", v) for v in vs], "k string, v double").repartition(4)
    got = {r["percentile"]: r["value"] for r in percentiles.exact_percentiles(df, ["k"], "v", [0.0, 0.1, 0.4, 0.5, 0.6, 0.9, 1.0]).collect()}
    s = sorted(vs)
    for p, v in got.items():
        lo, hi = s[math.floor(p * (len(s) - 1))], s[math.ceil(p * (len(s) - 1))]
        assert min(lo, hi) <= v <= max(lo, hi)
    # Two cuts a pass and two before the first.
    assert len(passes) <= 2 + 2 * 14
