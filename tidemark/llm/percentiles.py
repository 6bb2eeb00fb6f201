"""Exact percentiles per group by bisection, and summaries of bounded error that add up over days.

Bisection keeps, for each group and target rank, an interval of values. A pass cuts every interval at 63 points (six halvings at
once): evenly, or evenly in the logarithm where its ends are over four times apart or on either side of zero. So intervals of all
doubles are within a factor of four after three passes and resolved after some nine more, however long their tails. A pass counts the rows in each part as a plain aggregate, and keeps the parts that hold a target rank, narrowed to the
least and greatest value seen there. A part whose least and greatest value are the same is resolved. Rows outside the open parts
are dropped from later passes, so the passes together cost little more than the first. Counts of separate partitions or days simply
add, so nothing but counts and two extremes is ever moved, and no group is gathered anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.session import cut

#: Interval rows up to which they are broadcast (some 100 bytes each); beyond it the join is left to the planner.
BROADCAST_ROWS = 50_000


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"{k}__"]) for k in keys], F.lit(True))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float], sections: int = 64) -> DataFrame:
    """(keys..., percentile, value, n): linearly interpolated percentiles of each group, without error.

    NULL, NaN and infinite values are left out; a group without any other value gives no row. NULL is a key like any other. Ties
    and repeated rows count as often as they stand. `keys` may be empty. An empty table gives no rows.
    """
    keys = list(keys)
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*[F.col(f"`{k}`").alias(k) for k in keys], v.alias("v__")).where(F.col("v__").isNotNull() & ~F.isnan("v__") & (F.abs("v__") < float("inf")))
    rows = cut(rows.withColumn("v__", F.col("v__") + F.lit(0.0)))
    stats = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n__"), F.min("v__").alias("lo__"), F.max("v__").alias("hi__")).where("n__ > 0"))

    at = F.array(*[F.lit(float(p)) for p in percentiles])
    low = F.transform(at, lambda p: F.floor(p * (F.col("n__") - 1)))
    high = F.transform(at, lambda p: F.ceil(p * (F.col("n__") - 1)))
    parts = stats.select(*keys, "lo__", "hi__", F.lit(0).cast("long").alias("base__"), F.array_distinct(F.concat(low, high)).alias("ranks__"))
    solved: list[DataFrame] = []
    while True:
        parts = cut(parts)
        n, still = parts.agg(F.count(F.lit(1)), F.coalesce(F.count_if(F.col("lo__") < F.col("hi__")), F.lit(0))).first()
        if n:
            solved.append(parts.where("lo__ >= hi__").select(*keys, F.explode("ranks__").alias("rank__"), F.col("lo__").alias("v__")))
        if not still:
            break
        cuts = parts.where("lo__ < hi__").select(*[F.col(k).alias(f"{k}__") for k in keys], "lo__", "hi__", "base__", "ranks__")
        side = cuts.drop("ranks__")
        j = rows.join(F.broadcast(side) if n <= BROADCAST_ROWS else side, _same(rows, side, keys) & F.col("v__").between(F.col("lo__"), F.col("hi__")))
        lo, hi, v = F.col("lo__"), F.col("hi__"), F.col("v__")
        # Halved, so that the width of an interval can't overflow.
        wide = hi / 2 - lo / 2
        tailed = F.when(lo >= 0, hi / 4 > lo).when(hi <= 0, lo / 4 < hi).otherwise(True)
        log = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1_100))
        at_ = F.when(tailed, (log(v) - log(lo)) / (log(hi) - log(lo))).when(wide > 0, (v / 2 - lo / 2) / F.when(wide > 0, wide))
        part = F.when(at_.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(sections - 1), F.floor(at_ * sections).cast("int")))).otherwise((v > lo).cast("int"))
        j = cut(j.select(*keys, "v__", F.col("lo__").alias("from__"), part.alias("part__")))
        counts = j.groupBy(*keys, "from__", "part__").agg(F.count(F.lit(1)).alias("c__"), F.min("v__").alias("lo__"), F.max("v__").alias("hi__"))
        # At most `sections` rows a window.
        below = F.sum("c__").over(W.partitionBy(*keys, "from__").orderBy("part__").rowsBetween(W.unboundedPreceding, -1))
        counts = counts.withColumn("below__", F.coalesce(below, F.lit(0)))
        asked = cuts.select(*[f"{k}__" for k in keys], F.col("lo__").alias("at__"), "base__", "ranks__")
        found = counts.join(asked, _same(counts, asked, keys) & (F.col("from__") == F.col("at__")))
        found = found.withColumn("from_rank__", F.col("base__") + F.col("below__")).withColumn("to_rank__", F.col("from_rank__") + F.col("c__"))
        within = F.filter("ranks__", lambda r: (r >= F.col("from_rank__")) & (r < F.col("to_rank__")))
        parts = found.withColumn("ranks__", within).where(F.size("ranks__") > 0).select(*keys, "lo__", "hi__", F.col("from_rank__").alias("base__"), "ranks__")
        rows = j.select(*keys, "v__")
    if not solved:
        return stats.select(*keys, F.lit(0.0).alias("percentile"), F.lit(0.0).alias("value"), F.col("n__").alias("n")).limit(0)
    got = reduce(DataFrame.unionAll, solved).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank__", "v__"))).alias("at__"))
    s = stats.select(*[F.col(k).alias(f"{k}__") for k in keys], "n__")
    x = got.join(s, _same(got, s, keys)).select(*keys, "n__", "at__", F.explode(at).alias("percentile"))
    pos = F.col("percentile") * (F.col("n__") - 1)
    a, b = F.col("at__")[F.floor(pos)], F.col("at__")[F.ceil(pos)]
    f = pos - F.floor(pos)
    between = F.when(F.abs(b - a) < float("inf"), a + (b - a) * f).otherwise(a * (1 - f) + b * f)
    return x.select(*keys, "percentile", between.alias("value"), F.col("n__").alias("n"))


def summaries(df: DataFrame, keys: Sequence[str], value: str, error: float) -> DataFrame:
    """(keys..., bucket, n): counts of non-negative values in intervals whose ends differ by a fixed ratio.

    The interval `bucket` holds the values from g**bucket up to g**(bucket + 1), g = (1 + error) / (1 - error); bucket NULL holds the
    zeros. Summaries of separate days, runs or partitions are combined by adding the counts; see `combine`.
    """
    g = math.log((1 + error) / (1 - error))
    v = F.col(f"`{value}`").cast("double")
    x = df.where(v.isNotNull() & ~F.isnan(v) & (v < float("inf")) & (v >= 0))
    return x.groupBy(*keys, F.when(v > 0, F.floor(F.log(v) / g)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def combine(summary: DataFrame, keys: Sequence[str], percentiles: Sequence[float], error: float) -> DataFrame:
    """(keys..., percentile, value, n) of summaries that are combined over all columns but `keys`.

    Each value lies within `error`, relatively, of the value that has the rank ceil(percentile * (n - 1)) among all values.
    """
    keys = list(keys)
    g = (1 + error) / (1 - error)
    x = summary.groupBy(*keys, F.coalesce("bucket", F.lit(-(2**40))).alias("b__")).agg(F.sum("n").alias("c__"))
    # The rows of a window are the intervals in use: at most some 1,500 / error for all doubles.
    w = W.partitionBy(*keys)
    upto = F.sum("c__").over(w.orderBy("b__").rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("upto__", upto).withColumn("n__", F.sum("c__").over(w)).withColumn("percentile", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    rank = F.ceil(F.col("percentile") * (F.col("n__") - 1))
    x = x.where((rank >= F.col("upto__") - F.col("c__")) & (rank < F.col("upto__")))
    mid = F.when(F.col("b__") == -(2**40), F.lit(0.0)).otherwise(F.pow(F.lit(g), F.col("b__")) * (2 * g / (1 + g)))
    return x.select(*keys, "percentile", mid.alias("value"), F.col("n__").alias("n"))
