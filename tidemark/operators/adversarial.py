"""Corrupted rollout tables: each looks plausible, and each must be refused, skipped or marked by the reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import validate


def _some(share: int) -> Column:
    """Every share-th row, by a hash of its id."""
    return F.pmod(F.xxhash64("rollout_id"), F.lit(share)) == 0


def _set(df: DataFrame, where: Column, **values: object) -> DataFrame:
    return df.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


CASES = {
    "mixed_schema_versions": lambda d: _set(d, _some(3), schema_version=2),
    "duplicate_rollout_ids": lambda d: d.unionByName(d.where(_some(8))),
    "split_leakage": lambda d: _set(d, (F.col("task_id") == d.select(F.min("task_id")).first()[0]) & (F.col("seed") == 0), split="test"),
    "ungraded_rows_as_zero": lambda d: _set(d, _some(2), hidden_passed=None, hidden_total=None, visible_passed=None, visible_total=None),
    "half_graded_pair": lambda d: _set(d, _some(10), hidden_total=None),
    "orphan_ladder_step": lambda d: _set(d, _some(10), ladder_step=1),
    "serving_row_batched": lambda d: _set(d, _some(8), mode="serving", batch_size=32),
    "negative_and_impossible_counts": lambda d: _set(d, _some(8), hidden_passed=F.col("hidden_total") + 1, decode_tokens=-5),
    "unicode_and_nulls": lambda d: _set(d, _some(8), task_id=F.concat("task_id", F.lit("\x00"))),
    "single_arm_only": lambda d: d.where(F.col("arm") == d.select(F.min("arm")).first()[0]),
    "unsealed_run": lambda d: d.where(_some(2)),
    "dirty_run_id": lambda d: d.withColumn("run_id", F.concat("run_id", F.lit("-dirty"))),
}


def reaction(df: DataFrame) -> list[str]:
    """What a reader says of a table, sorted: issues of integrity, broken rules, versions, missing grades, runs that mayn't be shown."""
    out = {r["issue"] for r in validate.integrity(df).select("issue").collect()}
    out |= {r["error"] for r in validate.errors(df, "rollout_id").select("error").distinct().collect()}
    state = validate.version_state(df).first()["state"]
    if state != "ok":
        out.add(f"versions:{state}")
    if df.where("hidden_total IS NULL OR visible_total IS NULL").limit(1).count():
        out.add("ungraded")
    if df.where(F.endswith("run_id", F.lit("-dirty"))).limit(1).count():
        out.add("dirty")
    g = validate.grid_gaps(df).first()
    if not g["complete"]:
        out.add("incomplete_grid")
    return sorted(out)
