"""Repair ladders: chains of attempts under one root, their running costs, and whether repair pays against escalation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators import hierarchy


def chains(rows: DataFrame) -> DataFrame:
    """rows(rollout_id, parent_rollout_id, delivery_id, ...) with root and step: the root of each row's chain and its links from it.
    Rows whose way leads into a loop are left out; a row whose parent isn't there is its own root."""
    links, nodes = hierarchy.links_of(rows, "rollout_id", "parent_rollout_id", "delivery_id")
    r = hierarchy.resolve(links, nodes).select(F.col("node").alias("rollout_id"), "root", F.col("depth").alias("step"))
    x = rows.join(r, "rollout_id", "left")
    return x.withColumn("root", F.coalesce("root", "rollout_id")).withColumn("step", F.coalesce("step", F.lit(0).cast("long"))).where("step >= 0")


def upto(chain: DataFrame, step: int) -> DataFrame:
    """What was known at a step: later rows aren't there to be read."""
    return chain.where(F.col("step") <= step)


def cumulative(chain: DataFrame, column: str) -> DataFrame:
    """chain with the running sum of a cost along each chain; where several attempts share a step, each counts its own step's sum."""
    w = W.partitionBy("root").orderBy("step").rangeBetween(W.unboundedPreceding, 0)
    return chain.withColumn(f"{column}_so_far", F.sum(column).over(w))


def repair_gate(cells: DataFrame, chain: DataFrame, small: str, large: str) -> DataFrame:
    """(strategy, accuracy, cost, n, repairs): three ways to go on after small's attempt, for each task and seed that large ran too.

    cells(task_id, arm, seed, rollout_id, solved, cost) hold first attempts, chain(root, step, delivery_id, solved, cost) their
    repairs. All pay for the first attempt; a success costs no more. Repair takes the first attempt at step 1; without one, the
    failure stays. Rows without a grade or a cost are left out.
    """
    c = cells.where("solved IS NOT NULL AND cost IS NOT NULL")
    s = c.where(F.col("arm") == small).select("task_id", "seed", "rollout_id", F.col("solved").alias("s_solved"), F.col("cost").alias("s_cost"))
    b = c.where(F.col("arm") == large).select("task_id", "seed", F.col("solved").alias("l_solved"), F.col("cost").alias("l_cost"))
    r = chain.where("step = 1 AND solved IS NOT NULL AND cost IS NOT NULL").groupBy(F.col("root").alias("rollout_id")).agg(F.min_by(F.struct("solved", "cost"), "delivery_id").alias("r"))
    x = s.join(b, ["task_id", "seed"]).join(r, "rollout_id", "left").withColumn("won", F.col("s_solved") >= 1)
    more = lambda won, cost: (F.when(F.col("won"), 1.0).otherwise(won), F.col("s_cost") + F.when(F.col("won"), 0.0).otherwise(cost))
    ways = {"always_small": (F.col("s_solved"), F.col("s_cost")), "repair_on_failure": more(F.coalesce("r.solved", F.lit(0.0)), F.coalesce("r.cost", F.lit(0.0))), "escalate_on_failure": more(F.col("l_solved"), F.col("l_cost"))}
    long = x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), a.alias("solved"), c_.alias("cost")) for k, (a, c_) in ways.items()])).alias("w"), (~F.col("won") & F.col("r").isNotNull()).alias("repaired")).select("w.*", "repaired")
    return long.groupBy("strategy").agg(F.avg("solved").alias("accuracy"), F.avg("cost").alias("cost"), F.count(F.lit(1)).alias("n"), F.count_if("repaired").alias("repairs"))


def gate_verdict(strategies: DataFrame, lams: DataFrame) -> DataFrame:
    """One row: for how many cost weights repair beats escalation, and PASS, FAIL or NO REPAIRS, which is no pass."""
    at = lambda k, v: F.max(F.when(F.col("strategy") == k, F.col(v)))
    one = strategies.agg(at("repair_on_failure", "accuracy").alias("ra"), at("repair_on_failure", "cost").alias("rc"), at("escalate_on_failure", "accuracy").alias("ea"), at("escalate_on_failure", "cost").alias("ec"), F.max("repairs").alias("repairs"))
    x = one.crossJoin(F.broadcast(lams)).agg(F.count_if(F.col("ra") - F.col("lam") * F.col("rc") > F.col("ea") - F.col("lam") * F.col("ec")).alias("wins"), F.count(F.lit(1)).alias("lams"), F.max("repairs").alias("repairs"))
    return x.withColumn("verdict", F.when(F.coalesce("repairs", F.lit(0)) == 0, "NO REPAIRS").when(F.col("wins") > 0, "PASS").otherwise("FAIL"))
