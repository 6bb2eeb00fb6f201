"""Running sums and places over a whole order, without ever having it in one task.

Rows are range-partitioned and cut; each part is summed by itself, and what stands before a part is the sum of the parts before it, of
which there are as many as partitions. Spark's own window without a partition would sort everything in a single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.session import cut


def before(df: DataFrame, order: list[str], value: str | None = None, by: list[str] | None = None, out: str = "before") -> DataFrame:
    """df with the sum of `value` (or the number of rows) over all rows before it in `order`, within each group of `by`.

    `order` should tell rows apart; among equal ones the order is arbitrary. NULL is a group like any other.
    """
    by = by or []
    keys = [*by, *order]
    v = F.col(value) if value else F.lit(1).cast("long")
    x = cut(df.repartitionByRange(*keys).withColumn("p__", F.spark_partition_id()))
    part = x.groupBy("p__", *by).agg(F.sum(v).alias("s__"))
    upto = F.sum("s__").over(W.partitionBy(*(by or [F.lit(1)])).orderBy("p__").rowsBetween(W.unboundedPreceding, -1))
    part = part.select(F.col("p__").alias("q__"), *[F.col(b).alias(f"{b}__b") for b in by], F.coalesce(upto, F.lit(0)).alias("o__"))
    local = F.sum(v).over(W.partitionBy("p__", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn(out, F.coalesce(local, F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"{b}__b")) for b in by], F.col("p__") == F.col("q__"))
    return x.join(part, same).withColumn(out, F.col(out) + F.col("o__")).drop("p__", "q__", "o__", *[f"{b}__b" for b in by])


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(by..., names of `at`): exact quantiles of each group, linearly interpolated; NULL and NaN are left out.

    Values are counted first, and the counts summed up over a range-partitioned order, so no group is held in one buffer.
    """
    c = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("v__")).agg(F.count(F.lit(1)).alias("c__"))
    x = before(c, ["v__"], "c__", by, "b__")
    n = x.groupBy(*by).agg(F.max(F.col("b__") + F.col("c__")).alias("n__"))
    same = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"n.{k}")) for k in by], F.lit(True))
    x = x.alias("x").join(n.alias("n"), same).select(*[F.col(f"x.{k}").alias(k) for k in by], "v__", "c__", "b__", "n__")
    holds = lambda rank: (rank >= F.col("b__")) & (rank < F.col("b__") + F.col("c__"))
    pos = {k: (F.col("n__") - 1) * F.lit(q) for k, q in at.items()}
    ends = [F.max(F.when(holds(f(p)), F.col("v__"))).alias(f"{k}__{e}") for k, p in pos.items() for e, f in (("lo", F.floor), ("hi", F.ceil))]
    g = x.groupBy(*by).agg(F.max("n__").alias("n__"), *ends)
    lo, hi = (lambda k: F.col(f"{k}__lo")), (lambda k: F.col(f"{k}__hi"))
    return g.select(*by, *[(lo(k) + (hi(k) - lo(k)) * (p - F.floor(p))).alias(k) for k, p in pos.items()])
