"""Canonical views of the logged tables, for Spark and, as common table expressions, for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.normalize import norm_id, norm_split
from tidemark.session import load

SMALL, LARGE = "small", "large"


def amount(c: str) -> Column:
    """A cost that can be: not NaN, not infinite and not negative; NULL otherwise."""
    x = F.col(c)
    return F.when(~F.isnan(x) & (x >= 0) & (x < float("inf")), x)


_SPELLED = {"rollout_id": norm_id, "task_id": norm_id, "arm": norm_id, "parent_rollout_id": norm_id, "split": norm_split, "dataset": norm_id, "gpu_seconds": amount, "imputed_latency_s": amount}


def rollouts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per rollout, its first delivery, ids, arms and splits in one spelling and impossible costs NULL; `columns` and the key."""
    names = [c for c in dict.fromkeys(["delivery_id", *columns]) if c != "rollout_id"]
    g = load(spark, sf_dir, "generations")
    x = g.select(norm_id("rollout_id").alias("rollout_id"), *[_SPELLED[c](c).alias(c) if c in _SPELLED else F.col(c) for c in names]).where("rollout_id IS NOT NULL")
    first = x.groupBy("rollout_id").agg(F.min_by(F.struct(*names), "delivery_id").alias("r"))
    return first.select("rollout_id", "r.*")


def cells(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per (task_id, arm, seed): the first rollout that is no repair of another."""
    key = ["task_id", "arm", "seed"]
    names = [c for c in dict.fromkeys(["delivery_id", "rollout_id", *columns]) if c not in key]
    x = rollouts(spark, sf_dir, *key, *names, "parent_rollout_id").where("parent_rollout_id IS NULL AND task_id IS NOT NULL")
    return x.groupBy(*key).agg(F.min_by(F.struct(*names), "delivery_id").alias("r")).select(*key, "r.*")


def solved(passed: str = "hidden_passed", total: str = "hidden_total") -> Column:
    """1.0 where all hidden tests passed, 0.0 where not, NULL where the row isn't graded."""
    return F.when(F.col(total).isNotNull(), F.coalesce((F.col(total) > 0) & (F.col(passed) == F.col(total)), F.lit(False)).cast("double"))


def visible_frac() -> Column:
    """Share of visible tests passed, NULL without any."""
    return F.when(F.col("visible_total") > 0, F.col("visible_passed") / F.col("visible_total"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small and large side by side for each (task_id, seed) that both have: s_* and l_* of solved, visible, cost, latency.

    A conditional aggregate on the key takes the place of a self-join."""
    c = cells(spark, sf_dir, "split", "hidden_passed", "hidden_total", "visible_passed", "visible_total", "gpu_seconds", "imputed_latency_s").where(F.col("arm").isin(SMALL, LARGE))
    c = c.select("task_id", "seed", "arm", "split", solved().alias("solved"), visible_frac().alias("visible"), F.col("gpu_seconds").alias("cost"), F.col("imputed_latency_s").alias("latency"))
    per = [F.max(F.when(F.col("arm") == a, F.col(v))).alias(f"{a[0]}_{v}") for a in (SMALL, LARGE) for v in ("solved", "visible", "cost", "latency")]
    return c.groupBy("task_id", "seed").agg(F.min("split").alias("split"), F.count_distinct("arm").alias("arms"), *per).where("arms = 2").drop("arms")


def sql_id(c: str) -> str:
    return f"nullif(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))), '')"


def sql_split(c: str) -> str:
    i = sql_id(c)
    return f"CASE {i} WHEN 'validation' THEN 'val' WHEN 'training' THEN 'train' ELSE {i} END"


def sql_amount(c: str) -> str:
    return f"CASE WHEN {c}::VARCHAR NOT IN ('nan', '-nan', 'inf', '-inf') AND {c} >= 0 THEN {c} END"  # as text: isnan() is folded away by column statistics


_REPLACED = ", ".join(f"{f(c)} AS {c}" for c, f in {**dict.fromkeys(["rollout_id", "task_id", "arm", "parent_rollout_id", "dataset"], sql_id), "split": sql_split, "gpu_seconds": sql_amount, "imputed_latency_s": sql_amount}.items())
R = f"r0 AS (SELECT * REPLACE ({_REPLACED}) FROM generations), r AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY delivery_id) AS rn FROM r0 WHERE rollout_id IS NOT NULL) WHERE rn = 1)"
C = R + ", c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY task_id, arm, seed ORDER BY delivery_id) AS rn FROM r WHERE parent_rollout_id IS NULL AND task_id IS NOT NULL) WHERE rn = 1)"
SOLVED = "CASE WHEN hidden_total IS NOT NULL THEN CASE WHEN hidden_total > 0 AND hidden_passed = hidden_total THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END"
VISIBLE = "CASE WHEN visible_total > 0 THEN visible_passed::DOUBLE / visible_total END"
_PER = ", ".join(f"max({v}) FILTER (WHERE arm = '{a}') AS {a[0]}_{v}" for a in (SMALL, LARGE) for v in ("solved", "visible", "cost", "latency"))
G = (
    C
    + f", c1 AS (SELECT task_id, seed, arm, split, {SOLVED} AS solved, {VISIBLE} AS visible, gpu_seconds AS cost, imputed_latency_s AS latency FROM c WHERE arm IN ('small', 'large'))"
    + f", g AS (SELECT task_id, seed, min(split) AS split, {_PER} FROM c1 GROUP BY 1, 2 HAVING count(DISTINCT arm) = 2)"
)
