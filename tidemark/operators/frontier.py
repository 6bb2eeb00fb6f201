"""Cost and accuracy frontiers: sweeps over the cost weight, dominance, comparison at matched cost, tuned threshold rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def lam_grid(spark: SparkSession, lams: list[float]) -> DataFrame:
    """The weights as literals: computed once, compared exactly."""
    return spark.createDataFrame([(float(x),) for x in lams], "lam double")


def sweep(summary: DataFrame, lams: DataFrame) -> DataFrame:
    """A point for every policy and weight. The summaries are made once; weights only change the utility."""
    return summary.crossJoin(F.broadcast(lams)).select("policy", "lam", "accuracy", "cost", "latency_mean", "latency_p95", (F.col("accuracy") - F.col("lam") * F.col("cost")).alias("utility"))


def pareto(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Points that no cheaper or equally cheap point matches in accuracy. Points are few: policies times weights."""
    w = W.partitionBy(*(by or [F.lit(1)])).orderBy("cost", F.desc("accuracy"), "policy").rowsBetween(W.unboundedPreceding, -1)
    return points.withColumn("best__", F.coalesce(F.max("accuracy").over(w), F.lit(float("-inf")))).where(F.col("accuracy") > F.col("best__") + 1e-12).drop("best__")


def at_cost(curve: DataFrame, costs: DataFrame) -> DataFrame:
    """(name, cost, accuracy) of curves(name, cost, accuracy) at given costs(cost), interpolated between the two points around; a cost
    outside a curve's range has no row. A curve of one point is met within 1e-9."""
    c = curve.select("name", F.col("cost").alias("x"), F.col("accuracy").alias("y")).distinct()
    per = c.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    nxt = W.partitionBy("name").orderBy("x", "y")
    seg = c.withColumn("x2", F.lead("x").over(nxt)).withColumn("y2", F.lead("y").over(nxt)).join(F.broadcast(per), "name")
    q = costs.select(F.col("cost").alias("q"))
    one = seg.where("n = 1").crossJoin(F.broadcast(q)).where(F.abs(F.col("x") - F.col("q")) < 1e-9).select("name", F.col("q").alias("cost"), F.col("y").alias("accuracy"))
    inside = seg.where("n > 1").crossJoin(F.broadcast(q)).where("q >= lo AND q <= hi AND x <= q AND (x2 > q OR (x2 IS NULL AND q = hi) )")
    y = F.when(F.col("x2").isNull(), F.col("y")).otherwise(F.col("y") + (F.col("y2") - F.col("y")) * (F.col("q") - F.col("x")) / (F.col("x2") - F.col("x")))
    return one.unionByName(inside.select("name", F.col("q").alias("cost"), y.alias("accuracy")))


def matched(curve: DataFrame, a: str, b: str, n: int = 25) -> DataFrame:
    """(cost, accuracy_a, accuracy_b, difference) of two curves over the costs both reach, at n even steps; nothing is extrapolated."""
    two = curve.where(F.col("name").isin(a, b))
    r = two.groupBy("name").agg(F.min("cost").alias("lo"), F.max("cost").alias("hi")).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")).where("lo <= hi")
    steps = r.select(F.explode(F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, F.col("hi")).otherwise(F.col("lo") + i * ((F.col("hi") - F.col("lo")) / (n - 1)))))).alias("cost"))
    v = at_cost(two, steps).groupBy("cost").agg(*[F.max(F.when(F.col("name") == k, F.col("accuracy"))).alias(f"accuracy_{i}") for i, k in (("a", a), ("b", b))])
    return v.where("accuracy_a IS NOT NULL AND accuracy_b IS NOT NULL").withColumn("difference", F.col("accuracy_a") - F.col("accuracy_b"))


def dominates(m: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Whether a is at least as accurate as b at every matched cost; False where no cost matches."""
    return m.agg((F.coalesce(F.min("difference") >= -tolerance, F.lit(False))).alias("dominates"), F.count(F.lit(1)).alias("costs"))


def thresholds(features: DataFrame, n: int = 32) -> DataFrame:
    """(feature, threshold): distinct cuts at evenly spaced quantiles of each feature of features(feature, task_id, value)."""
    at = ", ".join(f"{i}D/{n - 1}D" for i in range(n))
    return features.groupBy("feature").agg(F.expr(f"percentile(value, array({at}))").alias("q")).select("feature", F.explode(F.array_distinct("q")).alias("threshold"))


def rules(features: DataFrame, cuts: DataFrame, task_values: DataFrame) -> DataFrame:
    """(feature, threshold, above, accuracy, cost) of every threshold rule in one aggregate.

    task_values(task_id, s_solved, s_cost, l_solved, l_cost) are per-task means. The cuts are few (features times quantiles) and are
    broadcast; every task meets each cut of a feature once. above: large where the value is over the threshold, else where it isn't.
    """
    x = features.join(F.broadcast(cuts), "feature").join(task_values, "task_id").withColumn("above", F.explode(F.array(F.lit(True), F.lit(False))))
    large = (F.col("value") > F.col("threshold")) == F.col("above")
    pick = lambda v: F.avg(F.when(large, F.col(f"l_{v}")).otherwise(F.col(f"s_{v}")))
    return x.groupBy("feature", "threshold", "above").agg(pick("solved").alias("accuracy"), pick("cost").alias("cost"))


def best_rule(rules_: DataFrame, lams: DataFrame) -> DataFrame:
    """The rule of greatest utility for each weight; ties to the first feature, the lowest threshold, then above."""
    u = rules_.crossJoin(F.broadcast(lams)).withColumn("utility", F.col("accuracy") - F.col("lam") * F.col("cost"))
    order = F.struct(F.round(-F.col("utility"), 9), "feature", "threshold", ~F.col("above"))
    return u.groupBy("lam").agg(F.min_by(F.struct("feature", "threshold", "above", "accuracy", "cost", "utility"), order).alias("r")).select("lam", "r.*")


def choose(scores: DataFrame) -> DataFrame:
    """The arm of greatest utility of scores(lam, task_id, arm, p, cost); ties to the cheaper, then to the greater name."""
    u = F.col("p") - F.col("lam") * F.col("cost")
    return scores.groupBy("lam", "task_id").agg(F.max_by("arm", F.struct(u, -F.col("cost"), F.col("arm"))).alias("arm"))


def verdict(low: Column, high: Column, threshold: float) -> Column:
    """PASS where the whole interval reaches the threshold, FAIL where none of it does, else INCONCLUSIVE."""
    return F.when(low >= threshold, "PASS").when(high < threshold, "FAIL").otherwise("INCONCLUSIVE")
