"""Leakage audits of feature tables, fits, scores and splits. Every check looks at what is really used: the columns of a built table, what
a registered feature declares, the splits of the rows that a fit has read, and the scores themselves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import features, stats, validate
from tidemark.operators.validate import Refused

# Planted columns that nothing legitimate reads, and parts of names that tell of a mean over seeds.
CANARIES = ["_synth_difficulty", "_synth_x_d0"]
SEED_MARKS = ["across_seed", "all_seed", "seed_mean", "mean_over_seed", "pooled_seed"]
#: How far an AUC may be over its ceiling by chance.
TOLERANCE = 0.03
SCHEMA = "check_name string, passed boolean, found long"


def _finding(table: DataFrame, name: str) -> DataFrame:
    """(check_name, passed, found) of a one-row table (found)."""
    return table.select(F.lit(name).alias("check_name"), (F.col("found") == 0).alias("passed"), F.col("found").cast("long").alias("found"))


def _counted(table: DataFrame, bad: Iterable[str], name: str) -> DataFrame:
    return table.sparkSession.createDataFrame([(name, not (n := len(list(bad))), n)], SCHEMA)


def canary(table: DataFrame, name_column: str | None = None) -> DataFrame:
    """Planted columns of a wide feature table, or planted names in a column of a long one."""
    if name_column is None:
        return _counted(table, [c for c in table.columns if c in CANARIES], "canary")
    return _finding(table.agg(F.count_distinct(F.when(F.col(name_column).isin(CANARIES), F.col(name_column))).alias("found")), "canary")


def column_allowlist(table: DataFrame, point: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Columns a feature set may not read at a decision point: those named, or else those that the table's registered features declare."""
    if columns is None:
        # A prompt's own columns are there before any generation.
        known = [features.REGISTRY[c] for c in table.columns if c in features.REGISTRY]
        columns = {c for f in known for c in f.columns if not (f.point == "D0" and c in ("prompt", "visible_tests", "entrypoint"))}
    return _counted(table, validate.allowlist(sorted(columns), point), f"column_allowlist[{point}]")


def normalization_scope(fitted: DataFrame, split: str = "split", reported: str = "test") -> DataFrame:
    """Rows of the reported split among those that a fit has read."""
    return _finding(fitted.agg(F.count_if(F.coalesce(F.col(split) == reported, F.lit(False))).alias("found")), "normalization_scope")


def seed_aggregation(table: DataFrame) -> DataFrame:
    """Columns whose name tells that they are means over seeds, which aren't there when one decides."""
    return _counted(table, [c for c in table.columns if any(m in c.lower() for m in SEED_MARKS)], "seed_aggregation")


def auc_within_bound(table: DataFrame, score: str, ceiling: str, label: str, point: str = "D0") -> DataFrame:
    """Whether a score tells labels apart better than what is knowable at the point, by more than TOLERANCE; found is 1 if so. `ceiling`
    is the score of all that is knowable, as planted."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in (("score", score), ("ceiling", ceiling))])).alias("s"), F.col(label).cast("int").alias("y")).select("s.*", "y")
    a = stats.auc(long, "v", "y", ["k"]).agg(F.max(F.when(F.col("k") == "score", F.col("auc"))).alias("a"), F.max(F.when(F.col("k") == "ceiling", F.col("auc"))).alias("b"))
    return _finding(a.select(F.coalesce((F.col("a") > F.col("b") + TOLERANCE).cast("long"), F.lit(0)).alias("found")), f"auc_within_bound[{point}]")


def split_disjointness(rows: DataFrame) -> DataFrame:
    """Tasks in more than one split."""
    return _finding(validate.split_span(rows).agg(F.count(F.lit(1)).alias("found")), "split_disjointness")


def ladder_causality(rows: DataFrame) -> DataFrame:
    """Rows with a step below 0."""
    return _finding(rows.agg(F.count_if(F.col("ladder_step") < 0).alias("found")), "ladder_causality")


def fence(rows: DataFrame, splits: Iterable[str], unlocked: bool = False, split: str = "split") -> DataFrame:
    """Rows of the splits asked for. `test` is refused without an unlock, before anything is read; so is a split that isn't one."""
    splits = list(splits)
    if strange := sorted(set(splits) - set(validate.SPLITS)):
        raise Refused(f"no such split: {', '.join(strange)}")
    if "test" in splits and not unlocked:
        raise Refused("the test split is locked")
    return rows.where(F.col(split).isin(*splits)) if splits else rows.limit(0)


def refuse_failed(findings: DataFrame, warn: tuple[str, ...] = ("seed_aggregation",)) -> None:
    """Raises with the names of all failed checks at once; those of `warn` never block."""
    bad = [r[0] for r in findings.where(~F.col("passed") & ~F.col("check_name").isin(*warn)).orderBy("check_name").collect()]
    if bad:
        raise Refused("; ".join(bad))
