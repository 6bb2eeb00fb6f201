"""Canonical spellings of identifiers, splits, sources and days, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t\r\n\x0b\x0c "


def norm_id(c: Column | str) -> Column:
    """Lower case without surrounding blanks; a blank id is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.btrim(c.cast("string"), F.lit(BLANKS)))
    return F.when(t != "", t)


def norm_split(c: Column | str) -> Column:
    """`validation` is val and `training` is train; blank is NULL."""
    t = norm_id(c)
    return F.when(t == "validation", "val").when(t == "training", "train").otherwise(t)


def norm_source(c: Column | str) -> Column:
    """Blanks, "-" and "_" are the same and come out as "_"."""
    return F.regexp_replace(norm_id(c), r"[\s_-]+", "_")


def day_of(c: Column | str) -> Column:
    """The day, as yyyy-mm-dd text, of an ISO time stamp in text; NULL where it isn't one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
