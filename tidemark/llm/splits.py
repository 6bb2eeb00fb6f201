"""Splits that keep related records together: entities as connected components, conflicts, and grouped iterative stratification."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.graph import connected_components
from tidemark.session import cut

# What is written where an author or a source page isn't known.
PLACEHOLDERS = ["", "-", "_", "?", "n/a", "na", "n_a", "nil", "none", "null", "nan", "unknown", "anonymous", "anon", "unnamed", "undefined", "tbd", "todo", "redacted", "removed", "deleted", "about:blank", "localhost"]
# Parts of an address's query that say how a reader came, not which page it is.
TRACKING = r"^(utm_.*|ref|ref_src|referrer|source|src|fbclid|gclid|mc_cid|mc_eid|share|from)(=.*)?$"

#: Bundles into which the components of one rarest label are hashed, and the part of all rows from which a component is placed alone.
BUNDLES, LARGE = 4_096, 1 / 2_000


def author_key(c: Column) -> Column:
    """One spelling of a handle: lower case, without a leading "@", with blanks, ".", "-" and "_" alike. NULL for placeholders."""
    t = F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\r\n "))), r"^@+", "")
    t = F.btrim(F.regexp_replace(t, r"[\s._\-]+", "_"), F.lit("_"))
    return F.when(~t.isin(PLACEHOLDERS), t)


def page_key(c: Column) -> Column:
    """One spelling of a page's address: without scheme, "www.", port, fragment, tracking parts and a closing "/". NULL for
    placeholders and for the bare address of a site, which names no page."""
    t = F.lower(F.btrim(c, F.lit(" \t\r\n ")))
    t = F.regexp_replace(F.regexp_replace(t, r"#.*$", ""), r"^([a-z][a-z0-9+.\-]*:)?//", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^www\.", ""), r":(80|443)(?=/|\?|$)", "")
    path = F.regexp_replace(F.regexp_replace(F.split_part(t, F.lit("?"), F.lit(1)), r"/+", "/"), r"(/(index\.html?)?)$", "")
    asked = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(t, r"\?(.*)$", 1), "&"), lambda q: (q != "") & ~q.rlike(TRACKING))), "&")
    page = F.concat(path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))
    return F.when(~path.isin(PLACEHOLDERS) & (path.contains("/") | (asked != "")), page)


def entities(records: DataFrame, record: str, keys: Sequence[str]) -> DataFrame:
    """(record, entity): records that share a value of a key column, directly or through others; entity is the smallest record.

    A NULL key links nothing. Records that share nothing, and so stand alone, are left out: their entity is themselves. A record may
    stand in several rows. NULL records are left out.
    """
    r = F.col(f"`{record}`").cast("string")
    pairs = None
    for i, k in enumerate(keys):
        x = records.where(r.isNotNull() & F.col(f"`{k}`").isNotNull()).select(F.concat(F.lit("0"), r).alias("a"), F.concat(F.lit(f"1{i}:"), F.col(f"`{k}`")).alias("b"))
        pairs = x if pairs is None else pairs.unionAll(x)
    pairs = cut(pairs.distinct())
    # Keys of a single record link nothing.
    shared = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
    c = connected_components(pairs.join(shared, "b", "left_semi"))
    return c.where(F.col("node").startswith("0")).select(F.substring("node", 2, 1 << 30).alias(record), F.substring("component", 2, 1 << 30).alias("entity"))


def label_vectors(rows: DataFrame, entity: str, label: str, weight: str | None = None) -> DataFrame:
    """(entity, size, vec): for each entity how many rows it has, and how many of each label. A row counts as many as its `weight` says,
    or one. NULL entities are left out; a NULL label is a label. Rows are counted per entity and label before they are gathered, so an
    entity of a third of all rows is no hot key."""
    lab = F.coalesce(F.col(f"`{label}`").cast("string"), F.lit("\u0000null"))
    per = rows.where(F.col(f"`{entity}`").isNotNull()).groupBy(F.col(f"`{entity}`").cast("string").alias("entity"), lab.alias("label")).agg(_counted(weight).alias("n"))
    return per.groupBy("entity").agg(F.sum("n").alias("size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("vec"))


def conflicts(entity_of: DataFrame, rows: DataFrame, record: str, split: str) -> DataFrame:
    """(entity, record) of every record with a split whose entity's rows carry more than one split: the entity's label vector, over the
    splits its rows have now, has more than one. NULL splits count for nothing."""
    x = rows.where(F.col(f"`{split}`").isNotNull() & F.col(f"`{record}`").isNotNull()).groupBy(F.col(f"`{record}`").alias(record), F.col(f"`{split}`").alias("s__")).agg(F.count(F.lit(1)).alias("n__"))
    x = cut(x.join(entity_of, record, "left").select(record, "s__", "n__", F.coalesce("entity", record).alias("entity")))
    spans = label_vectors(x, "entity", "s__", "n__").where(F.size(F.map_keys("vec")) > 1).select("entity")
    return x.join(spans, "entity", "left_semi").select("entity", record).distinct()


def _place(comps: pd.DataFrame, labels: list[str], splits: list[str], need: dict[str, dict[str, float]]) -> list[tuple[str, str]]:
    """Iterative stratification: while records are left, take the rarest outstanding label, and give its largest component to the
    split that needs that label most, then the most rows, then the first in order. `need` is used up."""
    left = {n: {k: int(v) for k, v in dict(vec).items()} for n, vec in zip(comps["entity"], comps["vec"])}
    order = {k: [] for k in labels}
    for n, vec in sorted(left.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        for k in vec:
            order.setdefault(k, []).append(n)
    rest = {k: sum(left[n][k] for n in v) for k, v in order.items() if v}
    todo = set(left)
    at = dict.fromkeys(rest, 0)
    out = []
    while todo:
        k = min((x for x in rest if rest[x] > 0), key=lambda x: (rest[x], x), default=None)
        if k is None:
            out += [(n, splits[0]) for n in sorted(todo)]
            break
        while order[k][at[k]] not in todo:
            at[k] += 1
        n = order[k][at[k]]
        s = max(splits, key=lambda s: (need[s].get(k, 0.0), sum(need[s].values()), -splits.index(s)))
        for label, c in left[n].items():
            need[s][label] = need[s].get(label, 0.0) - c
            rest[label] -= c
        todo.discard(n)
        out.append((n, s))
    return out


def _counted(weight: str | None) -> Column:
    return F.sum(f"`{weight}`") if weight else F.count(F.lit(1))


def assign(rows: DataFrame, entity: str, label: str, ratios: dict[str, float], weight: str | None = None) -> DataFrame:
    """(entity, split): whole entities to splits, so that every split gets its ratio of the rows of each label.

    Entities are first aggregated to label vectors. One of over LARGE of all rows is a bundle alone, of which there are at most
    1 / LARGE; the others are hashed into BUNDLES bundles for each label that is the rarest of some, and a bundle's vector is the sum of
    its entities'. The bundles are placed by iterative stratification, the rarest outstanding label first. So tables of any size go one
    way, and what comes to the driver is bounded by the number of labels, of which there must be few (they are the classes to balance,
    not identifiers). NULL entities are left out, a NULL label is a label.
    """
    splits = list(ratios)
    comps = cut(label_vectors(rows, entity, label, weight))
    total = {r["label"]: r["n"] for r in comps.select(F.explode("vec").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n")).collect()}
    rarity = F.create_map(*[F.lit(x) for i, k in enumerate(sorted(total, key=lambda k: (total[k], k))) for x in (k, i)]) if total else F.lit(None).cast("map<string,int>")
    rarest = F.array_min(F.transform(F.map_keys("vec"), lambda k: rarity[k]))
    alone = F.col("size") > sum(total.values()) * LARGE
    hashed = F.concat_ws("|", F.lit("some"), rarest.cast("string"), F.pmod(F.xxhash64("entity"), F.lit(BUNDLES)).cast("string"))
    comps = comps.withColumn("bundle", F.when(alone, F.concat(F.lit("one|"), F.col("entity"))).otherwise(hashed))
    per = comps.select("bundle", F.explode("vec").alias("label", "n")).groupBy("bundle", "label").agg(F.sum("n").alias("n"))
    bundles = per.groupBy(F.col("bundle").alias("entity")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("vec")).toPandas()
    need = {s: {k: ratios[s] * v for k, v in total.items()} for s in splits}
    placed = rows.sparkSession.createDataFrame(_place(bundles, list(total), splits, need), "bundle string, split string")
    return comps.join(F.broadcast(placed), "bundle").select("entity", "split")


def shares(assigned: DataFrame, rows: DataFrame, entity: str, label: str, weight: str | None = None) -> DataFrame:
    """(label, split, n, share): what each split got of the rows of each label, counted as in `assign`. Aggregated per entity before
    it is joined."""
    per = rows.groupBy(F.col(f"`{entity}`").alias("entity"), F.col(f"`{label}`").alias("label")).agg(_counted(weight).alias("n"))
    x = per.join(assigned, "entity").groupBy("label", "split").agg(F.sum("n").alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("label")))
