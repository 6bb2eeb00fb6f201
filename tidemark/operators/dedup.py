"""Exactly-once reading of at-least-once deliveries.

Ranking by arrival inside each identifier is done as an aggregate (the row of rank one is a minimum), so Spark combines on the map
side before it shuffles and an identifier that holds a third of all rows costs no more than any other. Nothing is sorted per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.normalize import norm_id


def _order(df: DataFrame, arrival: Sequence[str]) -> Column:
    """Arrival first, NULL arrivals last, then a hash of the whole row: the same winner whatever the partitioning."""
    rest = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(df.columns)])
    return F.struct(*[x for c in arrival for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))], rest)


def keep_first(df: DataFrame, key: str, arrival: Sequence[str]) -> DataFrame:
    """Exactly one row per identifier: the first to arrive, ties by a hash of the row.

    Identifiers are compared without regard to case and surrounding blanks. Rows whose identifier is NULL or blank can't be told
    to be copies and are all kept. Rows that are equal in every column leave one copy. An empty table gives an empty table with
    the same columns; columns may have any names.
    """
    names = df.columns
    x = df.select(norm_id(F.col(f"`{key}`")).alias("k__"), _order(df, arrival).alias("o__"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("r__"))
    first = x.where(F.col("k__").isNotNull()).groupBy("k__").agg(F.min_by("r__", "o__").alias("r__"))
    return first.select("r__").unionAll(x.where(F.col("k__").isNull()).select("r__")).select(*[F.col("r__")[c].alias(c) for c in names])


def repeated(df: DataFrame, key: str, arrival: str) -> DataFrame:
    """The rows that `keep_first` would drop, as `arrival` values, for an `arrival` column that is unique in the table.

    The rows of rank one are a minimum per identifier. They are taken out by an anti-join on the unique arrival number, where no
    value is hot even if one identifier holds a third of all rows. Rows without an identifier are never repeats.
    """
    x = df.select(F.col(f"`{arrival}`").alias(arrival), norm_id(F.col(f"`{key}`")).alias("k__")).where(F.col("k__").isNotNull())
    first = x.groupBy("k__").agg(F.min(arrival).alias(arrival)).select(arrival)
    return x.select(arrival).join(first, arrival, "left_anti")


def new_messages(batch: DataFrame, stored: DataFrame, key: str, arrival: Sequence[str]) -> DataFrame:
    """One copy of each message of a new batch that isn't stored yet: rank within the batch, then anti-join the stored identifiers.

    The batch is thinned to one row per identifier before the join, so no key of the join is hot on that side; the stored side
    is reduced to its distinct identifiers. Rows of the batch without an identifier are all kept.
    """
    one = keep_first(batch, key, arrival)
    seen = stored.select(norm_id(F.col(f"`{key}`")).alias("k__")).where(F.col("k__").isNotNull()).distinct()
    return one.withColumn("k__", norm_id(F.col(f"`{key}`"))).join(seen, "k__", "left_anti").select(*[F.col(f"`{c}`") for c in batch.columns])
