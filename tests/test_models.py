import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, cost, models, sweep
from tidemark.operators.validate import Refused


def newton(x, y, ridge=1.0):
    m, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    pen = np.array([0.0] + [ridge] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-m @ b))
        b = b + np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + np.diag(pen + 1e-10), m.T @ (y - p) - pen * b)
    return b


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(240):
        for arm, skill in (("small", -0.3), ("large", 0.6)):
            a, b = rng.normal(size=2)
            out.append((f"t{i}", arm, ("train", "train", "val", "test")[i % 4], float(a), float(b), int(rng.random() < 1 / (1 + np.exp(-(skill + a - 0.5 * b)))), int(40 + 9 * a), int(70 + 20 * b)))
    return spark.createDataFrame(out, "task_id string, arm string, split string, a double, b double, y int, prefill_tokens int, decode_tokens int")


def test_logistic_fits_of_all_groups_equal_numpy(spark, rows):
    got = models.logistic_by(rows.unionByName(rows.limit(1).withColumns({"a": F.lit(None).cast("double"), "y": F.lit(1)})).repartition(5), ["a", "b"], "y", ["arm"])
    pdf = rows.toPandas()
    for arm in ("small", "large"):
        d = pdf[pdf["arm"] == arm]
        assert list(got[(arm,)].values()) == pytest.approx(newton(d[["a", "b"]].to_numpy(), d["y"].to_numpy()), abs=1e-6)
    assert models.logistic(rows.where("y = 1"), ["a"], "y") is None and models.logistic_by(rows.limit(0), ["a"], "y", ["arm"]) == {}


def test_heads_read_no_test_row_and_price_predicted_tokens(spark, rows):
    poisoned = rows.withColumns({"a": F.when(F.col("split") == "test", 1e6).otherwise(F.col("a")), "decode_tokens": F.when(F.col("split") == "test", 10**6).otherwise(F.col("decode_tokens"))})
    h, g = models.fit_heads(rows, ["a", "b"]), models.fit_heads(poisoned, ["a", "b"])
    assert h == g and set(h["pass"]) == {"small", "large"}
    arms = spark.createDataFrame([("small", 0.5, 0.001, 0.01), ("large", 0.7, 0.002, 0.03), ("other", 1.0, 1.0, 1.0)], "arm string, intercept_s double, prefill_s_per_token double, decode_s_per_token double")
    tasks = rows.select("task_id", "a", "b").dropDuplicates(["task_id"])
    got = models.scores(tasks, h, arms).collect()
    assert len(got) == 2 * tasks.count()
    for r in got:
        k = {"small": (0.5, 0.001, 0.01), "large": (0.7, 0.002, 0.03)}[r["arm"]]
        assert 0 <= r["p_pass"] <= 1 and r["decode_tokens"] >= 0 and r["e_cost"] == pytest.approx(r["prefill_tokens"] * k[1] + r["decode_tokens"] * k[2]) and r["e_latency"] == pytest.approx(r["e_cost"] + k[0])


def test_the_ablation_that_costs_most_carries(spark, rows):
    x = rows.withColumn("c", F.pmod(F.xxhash64("task_id"), F.lit(97)).cast("double"))
    got = {(r["variant"], r["group"]): r for r in models.ablations(x, ["a", "b", "c"], "y", draws=300).collect()}
    assert got["without", "a"]["carries"] and sum(r["carries"] for r in got.values()) == 1
    assert got["without", "a"]["high"] < 0 and got["without", "c"]["low"] <= 0 <= got["without", "c"]["high"]


def test_holdouts_take_every_fourth_row_of_large_groups(spark):
    df = spark.range(120).selectExpr("CASE WHEN id < 100 THEN 'a' WHEN id < 110 THEN NULL ELSE 'b' END AS k", "lpad(CAST(id AS string), 4, '0') AS id")
    got = cost.holdout(df, ["k"], ["id"])
    assert got.count() == 120 and got.where("held").count() == 25 and got.where("held AND k <> 'a'").count() == 0


def test_the_fence_and_audits(spark, rows):
    with pytest.raises(Refused, match="locked"):
        audit.fence(rows, ["train", "test"])
    with pytest.raises(Refused, match="no such"):
        audit.fence(rows, ["dev"])
    assert audit.fence(rows, ["test"], unlocked=True).count() == 120 and audit.fence(rows, []).count() == 0
    long = spark.createDataFrame([("t", "a"), ("t", "_synth_difficulty"), ("u", None)], "task_id string, feature string")
    assert audit.canary(long, "feature").first()["found"] == 1 and audit.canary(rows).first()["passed"]
    bad = audit.normalization_scope(rows).unionByName(audit.canary(rows)).unionByName(audit.auc_within_bound(rows, "y", "a", "y"))
    assert [r["passed"] for r in bad.collect()] == [False, True, False]
    with pytest.raises(Refused, match="auc_within_bound.*normalization_scope"):
        audit.refuse_failed(bad)
    audit.refuse_failed(audit.seed_aggregation(rows.withColumn("seed_mean_x", F.lit(1))))
    assert audit.auc_within_bound(rows.limit(0), "y", "a", "y").first()["passed"]


def test_registered_arms(spark):
    t = {r["arm"]: r for r in sweep.arm_table(spark).collect()}
    assert len(t) == 7 and {a for a, r in t.items() if not r["sweepable"]} == {"repair_small", "repair_large"} and not t["direct_small_notests"]["shows_tests"]
