import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import frontier, replay, stats


@pytest.fixture
def g(spark):
    # solved, visible, cost, latency of small, then of large
    rows = [("t1", 0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 6.0, 3.0), ("t2", 0, 0.0, 0.5, 1.0, 1.0, 1.0, 1.0, 6.0, 3.0), ("t3", 0, 0.0, None, 1.0, 1.0, 0.0, 0.0, 6.0, 3.0), ("t4", 0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 6.0, 3.0)]
    return spark.createDataFrame(rows, "task_id string, seed int, s_solved double, s_visible double, s_cost double, s_latency double, l_solved double, l_visible double, l_cost double, l_latency double")


def by_task(df):
    return {r["task_id"]: r for r in df.collect()}


def test_cascade_pays_both_and_goes_up_where_nothing_was_seen(g):
    c = by_task(replay.cascade(g, "small", "large"))
    assert (c["t1"]["cost"], c["t1"]["escalated"]) == (1.0, False)
    assert (c["t2"]["cost"], c["t2"]["latency"], c["t2"]["solved"]) == (7.0, 4.0, 1.0)
    assert c["t3"]["escalated"] and not c["t4"]["escalated"]


def test_oracle_is_the_ceiling_and_pays_for_one_arm(g):
    o = by_task(replay.oracle(g, "small", "large"))
    assert [o[t]["action"] for t in ("t1", "t2", "t3", "t4")] == ["small", "large", "small", "large"]
    acc = {r["policy"]: r["accuracy"] for r in replay.summary(replay.standard(g, "small", "large")).collect()}
    assert max(acc.values()) == acc["oracle_router"]


def test_confusion_counts_every_task_once(g):
    o = replay.standard(g, "small", "large")
    n = {}
    for r in replay.confusion(o, g).collect():
        n[r["policy"]] = n.get(r["policy"], 0) + r["tasks"]
    assert set(n.values()) == {4}
    h = replay.headroom(g).first()
    assert math.isclose(h["small_only"] + h["large_only"] + h["both"] + h["neither"], 1.0)


def test_decisions_must_cover_every_task(g, spark):
    d = spark.createDataFrame([("t1", "small")], "task_id string, action string")
    with pytest.raises(KeyError):
        replay.from_decisions(g, d, "d", "small", "large")
    assert replay.from_decisions(g, d, "d", "small", "large", strict=False).count() == 1
    with pytest.raises(KeyError):
        replay.always(g, "medium", "small", "large")


def test_best_of_charges_every_draw_up_to_the_first_pass(spark):
    rows = [("t", i, float(i == 2), 1.0 if i >= 1 else 0.0, 1.0, 1.0, 0.0, 0.0, 6.0, 3.0) for i in range(3)] + [("u", i, 0.0, None, 1.0, 1.0, 0.0, 0.0, 6.0, 3.0) for i in range(3)]
    x = spark.createDataFrame(rows, "task_id string, seed int, s_solved double, s_visible double, s_cost double, s_latency double, l_solved double, l_visible double, l_cost double, l_latency double")
    b = by_task(replay.best_of(x, 3))
    assert (b["t"]["cost"], b["t"]["solved"]) == (2.0, 0.0)
    assert b["u"]["cost"] == 3.0


def test_pareto_keeps_the_cheaper_of_equals_and_nothing_is_extrapolated(spark):
    p = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.5), ("c", 3.0, 0.7), ("d", 3.0, 0.6)], "policy string, cost double, accuracy double")
    assert sorted(r["policy"] for r in frontier.pareto(p).collect()) == ["a", "c"]
    c = spark.createDataFrame([("x", 1.0, 0.0), ("x", 3.0, 1.0), ("y", 2.0, 0.5)], "name string, cost double, accuracy double")
    q = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (3.0,), (3.5,)], "cost double")
    got = {(r["name"], r["cost"]): r["accuracy"] for r in frontier.at_cost(c, q).collect()}
    assert got == {("x", 1.0): 0.0, ("x", 2.0): 0.5, ("x", 3.0): 1.0, ("y", 2.0): 0.5}


def test_choice_breaks_ties_to_the_cheaper_arm(spark):
    s = spark.createDataFrame([(0.0, "t", "small", 0.5, 1.0), (0.0, "t", "large", 0.5, 6.0), (0.0, "u", "a", 0.5, 1.0), (0.0, "u", "b", 0.5, 1.0)], "lam double, task_id string, arm string, p double, cost double")
    assert {r["task_id"]: r["arm"] for r in frontier.choose(s).collect()} == {"t": "small", "u": "b"}


def test_auc_with_ties_equals_all_pairs(spark):
    data = [(float(i % 5), int((i * 7) % 3 == 0)) for i in range(60)] + [(None, 1), (float("nan"), 0)]
    pos, neg = [s for s, y in data[:60] if y], [s for s, y in data[:60] if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = stats.auc(spark.createDataFrame(data, "s double, y int"), "s", "y").first()
    assert math.isclose(got["auc"], want) and got["n"] == 60
    assert stats.auc(spark.createDataFrame([(1.0, 1)], "s double, y int"), "s", "y").first()["auc"] is None


def test_mcnemar_is_the_exact_binomial_tail():
    for b, c in ((0, 0), (1, 0), (3, 9), (40, 41), (500, 400)):
        n = b + c
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
        assert math.isclose(stats.mcnemar_p(b, c), want, rel_tol=1e-9)


def test_calibration_bins_take_edges_upward_and_skip_empty_bins(spark):
    df = spark.createDataFrame([(0.3, 1), (0.30000000000000004, 0), (1.0, 1), (0.0, 0)], "p double, y int")
    t = {r["bin"]: r["n"] for r in stats.reliability(df, "p", "y").collect()}
    assert sum(t.values()) == 4 and t[9] == 1 and t[0] == 1


def test_bootstrap_of_equal_arms_covers_zero_and_is_reproducible(spark):
    v = spark.createDataFrame([(f"t{i}", k, float((i + k) % 2), float((i + k) % 2)) for i in range(20) for k in range(3)], "task_id string, rep int, a double, b double")
    x, y = stats.paired_bootstrap(v, "a", "b", 20).first(), stats.paired_bootstrap(v.repartition(3), "a", "b", 20).first()
    assert x == y and x["low"] == x["high"] == 0.0


def test_bh_is_monotone(spark):
    ps = [0.01, 0.04, 0.03, 0.5, 0.2]
    got = {r["p"]: r["adjusted"] for r in stats.benjamini_hochberg(spark.createDataFrame([(p,) for p in ps], "p double"), "p").collect()}
    order = sorted(ps)
    want = {p: min(min(1.0, q * len(ps) / (order.index(q) + 1)) for q in order[order.index(p) :]) for p in ps}
    assert all(math.isclose(got[p], want[p]) for p in ps)


def test_the_isotonic_fit_is_exact_above_ten_thousand_scores_too(spark):
    import numpy as np

    from tidemark.operators import models

    for n in (300, 12_000):
        df = spark.range(n).selectExpr("pmod(xxhash64(id), 1000003) / 1000003D AS p", "CAST(pmod(xxhash64(id, 7), 100) < 30 + 40 * pmod(xxhash64(id), 1000003) / 1000003D AS int) AS y")
        rows = sorted((round(r["p"], 12), r["y"]) for r in df.collect())
        pools = []
        for p, y in rows:
            pools.append([float(y), 1, p, p])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                s, m, _, hi = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + m, pools[-1][2], hi]
        want = [k for s, m, lo, hi in pools for k in ([(lo, s / m)] if lo == hi else [(lo, s / m), (hi, s / m)])]
        knots = models.isotonic(df.repartition(5), "p", "y")
        assert np.allclose(knots, want) and len(knots) == len(want)
    got = {r["p"]: r["c"] for r in spark.createDataFrame([(None,), (-1.0,), (0.5,), (2.0,)], "p double").select("p", models.calibrated(F.col("p"), [(0.0, 0.2), (1.0, 0.4)]).alias("c")).collect()}
    assert got == {None: None, -1.0: 0.2, 0.5: pytest.approx(0.3), 2.0: 0.4}
    assert models.isotonic(df.limit(0), "p", "y") == []


def test_quantiles_without_a_buffer_per_group_equal_numpy(spark):
    import numpy as np

    from tidemark.operators.ordered import quantiles

    df = spark.range(4_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'a' ELSE 'b' END AS k", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 51 = 0 THEN double('nan') ELSE CAST(pmod(xxhash64(id), 700) AS double) END AS v")
    rows = df.where("v IS NOT NULL AND NOT isnan(v)").collect()
    got = {r["k"]: (r["low"], r["high"]) for r in quantiles(df.repartition(6), ["k"], "v", {"low": 0.1, "high": 0.95}).collect()}
    assert set(got) == {None, "a", "b"}
    for k, v in got.items():
        assert v == pytest.approx(tuple(np.quantile([r["v"] for r in rows if r["k"] == k], [0.1, 0.95])))
    assert quantiles(df.limit(0), ["k"], "v", {"x": 0.5}).count() == 0


def test_draws_of_tasks_have_the_spread_of_resampled_tasks(spark):
    """Against numpy's own drawing of tasks, then replicates, with replacement."""
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.random((60, 4)) + rng.normal(0, 0.7, (60, 1))
    df = spark.createDataFrame([(f"t{i}", k, float(v[i, k])) for i in range(60) for k in range(4)], "task_id string, rep int, a double")
    r = stats.bootstrap(df, ["a"], 4_000).first()
    t = rng.integers(0, 60, (4_000, 60))
    k = rng.integers(0, 4, (4_000, 60, 4))
    means = np.take_along_axis(v[t], k, axis=2).mean(axis=(1, 2))
    lo, hi = np.quantile(means, [0.025, 0.975])
    assert r["point"] == pytest.approx(v.mean()) and abs((r["high"] - r["low"]) / (hi - lo) - 1) < 0.1 and abs(r["low"] - lo) < 0.1 * (hi - lo)
    ratio = stats.bootstrap_of(df, {"s": F.col("a"), "q": F.col("a") * 2}, {"half": F.col("s") / F.col("q")}, 50).first()
    assert ratio["low"] == pytest.approx(0.5) == ratio["high"]
    assert stats.bootstrap(df.limit(0), ["a"], 50).first()["point"] is None


def test_drawn_aucs_equal_a_weighted_auc_of_each_draw(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [(f"t{i % 40}", f, float(rng.integers(0, 9 if f == "ties" else 10_000)), int(rng.random() < 0.4)) for i in range(300) for f in ("ties", "fine")]
    df = spark.createDataFrame([*rows, ("t0", "fine", None, 1), ("t1", "fine", float("nan"), 0)], "task_id string, f string, v double, y int")
    got = {(r["f"], r["draw"]): r["auc"] for r in stats.bootstrap_auc(df.repartition(5), 20).collect()}
    state = {r["task_id"]: (r["a"], r["c"]) for r in df.select("task_id", *[c.alias(k) for c, k in zip(stats._state("T", F.col("task_id")), "ac")]).distinct().collect()}
    for f in ("ties", "fine"):
        own = [r for r in rows if r[1] == f]
        v, y = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        a, c = (np.array([state[r[0]][i] for r in own], np.int64) for i in (0, 1))
        w = stats._times(stats._units(a, c, stats.steps(20))).astype(float)
        for b in range(20):
            p, n = w[:, b] * y, w[:, b] * (1 - y)
            won = sum(p[i] * (n[v < v[i]].sum() + n[v == v[i]].sum() / 2) for i in range(len(v)))
            assert got[f, b] == pytest.approx(won / (p.sum() * n.sum()))
