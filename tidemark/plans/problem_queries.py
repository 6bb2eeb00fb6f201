"""Queries over the project's tables for the general data problems: hierarchies (p2) and repeated deliveries (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.normalize import norm_id
from tidemark.operators import dedup, hierarchy
from tidemark.session import cut, load


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, "generations").select("rollout_id", "parent_rollout_id", "delivery_id")
    links, nodes = hierarchy.links_of(g, "rollout_id", "parent_rollout_id", "delivery_id")
    return hierarchy.resolve(links, nodes).select(F.col("node").alias("rollout_id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repaired rollout with its full path and whether its logged ladder_step is its depth."""
    g = load(spark, sf_dir, "generations").select("rollout_id", "parent_rollout_id", "delivery_id", "ladder_step")
    links, nodes = hierarchy.links_of(g, "rollout_id", "parent_rollout_id", "delivery_id")
    steps = g.groupBy(norm_id("rollout_id").alias("node")).agg(F.min_by("ladder_step", "delivery_id").alias("ladder_step"))
    x = hierarchy.resolve(links, nodes, with_paths=True).join(steps, "node", "left")
    return x.select(F.col("node").alias("rollout_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", ">").alias("path"), "ladder_step", F.coalesce(F.col("ladder_step") == F.col("depth"), F.lit(False)).alias("step_is_depth"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rollout that was repaired with every rollout under it and the number of links between."""
    g = load(spark, sf_dir, "generations").select("rollout_id", "parent_rollout_id", "delivery_id")
    links, nodes = hierarchy.links_of(g, "rollout_id", "parent_rollout_id", "delivery_id")
    return hierarchy.descendants(hierarchy.resolve(links, nodes, with_paths=True)).select("ancestor", F.col("node").alias("descendant"), "links")


def p2_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rollout of a tree with its place in a walk and the place of the last one under it: all descendants, a row for each rollout."""
    g = load(spark, sf_dir, "generations").select("rollout_id", "parent_rollout_id", "delivery_id")
    links, nodes = hierarchy.links_of(g, "rollout_id", "parent_rollout_id", "delivery_id")
    return hierarchy.intervals(cut(hierarchy.resolve(links, nodes, with_paths=True))).select(F.col("node").alias("rollout_id"), F.col("root").alias("root_id"), "enter", "leave")


def p2_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rollout, roots and those on and under loops included, with its path; that of a loop starts at the loop's smallest rollout."""
    g = load(spark, sf_dir, "generations").select("rollout_id", "parent_rollout_id", "delivery_id")
    x = hierarchy.whole(*hierarchy.links_of(g, "rollout_id", "parent_rollout_id", "delivery_id"))
    return x.select(F.col("node").alias("rollout_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", ">").alias("path"))


def p2_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p2_descendants, with the pairs on and under loops."""
    g = load(spark, sf_dir, "generations").select("rollout_id", "parent_rollout_id", "delivery_id")
    x = hierarchy.whole(*hierarchy.links_of(g, "rollout_id", "parent_rollout_id", "delivery_id"))
    return hierarchy.all_descendants(x).select("ancestor", F.col("node").alias("descendant"), "links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeated(load(spark, sf_dir, "generations").select("delivery_id", "rollout_id"), "rollout_id", "delivery_id")


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row that remains of each rollout, whole texts included, by a digest of them."""
    g = load(spark, sf_dir, "generations").select("delivery_id", "rollout_id", "run_id", "task_id", "arm", "text", "code", "hidden_passed", "hidden_total")
    kept = dedup.keep_first(g, "rollout_id", ["delivery_id"])
    return kept.select("delivery_id", norm_id("rollout_id").alias("rollout_id"), "run_id", norm_id("task_id").alias("task_id"), norm_id("arm").alias("arm"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.md5(F.coalesce("code", F.lit(""))).alias("code_md5"), "hidden_passed", "hidden_total")


def p4_new_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest day's arrivals as a new batch against all earlier ones: the messages that are new, one copy each."""
    g = load(spark, sf_dir, "generations").select("delivery_id", "rollout_id", "run_id", F.to_date("ingested_at").alias("day"))
    last = g.agg(F.max("day").alias("last"))
    x = cut(g.crossJoin(F.broadcast(last)))  # one row, by an aggregate without keys
    new = dedup.new_messages(x.where("day = last"), x.where("day < last"), "rollout_id", ["delivery_id"])
    return new.select("delivery_id", norm_id("rollout_id").alias("rollout_id"), "run_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p2_intervals, p2_all_paths, p2_all_descendants, p4_found, p4_kept, p4_new_in_batch)}

_ID = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))), '')"


def sql_id(c: str) -> str:
    return _ID.format(c)


_WALK = f"""
WITH RECURSIVE per AS (
  SELECT {sql_id('rollout_id')} AS c, arg_min({sql_id('parent_rollout_id')}, delivery_id) FILTER (WHERE {sql_id('parent_rollout_id')} IS NOT NULL) AS p
  FROM generations GROUP BY 1),
links AS (SELECT a.c, CASE WHEN b.c IS NOT NULL THEN a.p END AS p FROM per a LEFT JOIN per b ON a.p = b.c WHERE a.p IS NOT NULL AND a.c IS NOT NULL),
walk AS (
  SELECT c AS node, c AS cur, p AS nxt, CAST(0 AS BIGINT) AS d, [c] AS seen, FALSE AS closed FROM links
  UNION ALL
  SELECT w.node, w.nxt, l.p, w.d + 1, list_append(w.seen, w.nxt), list_contains(w.seen, w.nxt)
  FROM walk w LEFT JOIN links l ON l.c = w.nxt WHERE w.nxt IS NOT NULL AND NOT w.closed),
ends AS (SELECT * FROM walk WHERE closed OR nxt IS NULL)
"""

ORACLE = {
    "p2_found": _WALK + "SELECT node AS rollout_id, CASE WHEN closed THEN list_min(list_slice(seen, list_position(seen, cur), len(seen))) ELSE cur END AS root_id, CASE WHEN closed THEN -1 ELSE d END AS depth FROM ends",
    "p2_paths": _WALK
    + f", steps AS (SELECT {sql_id('rollout_id')} AS node, arg_min(ladder_step, delivery_id) AS ladder_step FROM generations WHERE ladder_step IS NOT NULL GROUP BY 1)"
    + " SELECT e.node AS rollout_id, CASE WHEN closed THEN list_min(list_slice(seen, list_position(seen, cur), len(seen))) ELSE cur END AS root_id, CASE WHEN closed THEN -1 ELSE d END AS depth,"
    " CASE WHEN closed THEN NULL ELSE array_to_string(list_reverse(seen), '>') END AS path, s.ladder_step,"
    " coalesce(s.ladder_step = CASE WHEN closed THEN -1 ELSE d END, FALSE) AS step_is_depth FROM ends e LEFT JOIN steps s ON e.node = s.node",
    "p2_descendants": _WALK + "SELECT w.cur AS ancestor, w.node AS descendant, w.d AS links FROM walk w JOIN ends e ON e.node = w.node AND NOT e.closed WHERE w.d > 0",
    "p2_intervals": _WALK
    + ", t AS (SELECT node, cur AS root, list_reverse(seen) AS path FROM ends WHERE NOT closed UNION SELECT cur, cur, [cur] FROM ends WHERE NOT closed), sz AS (SELECT a, count(*) AS n FROM (SELECT unnest(path) AS a FROM t) GROUP BY 1)"
    " SELECT node AS rollout_id, root AS root_id, enter, enter + n - 1 AS leave FROM (SELECT *, row_number() OVER (ORDER BY path) - 1 AS enter FROM t) JOIN sz ON a = node",
    "p4_found": f"SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY {sql_id('rollout_id')} ORDER BY delivery_id) AS r FROM generations WHERE {sql_id('rollout_id')} IS NOT NULL) WHERE r > 1",
    "p4_kept": f"SELECT delivery_id, {sql_id('rollout_id')} AS rollout_id, run_id, {sql_id('task_id')} AS task_id, {sql_id('arm')} AS arm, md5(coalesce(text, '')) AS text_md5, md5(coalesce(code, '')) AS code_md5, hidden_passed, hidden_total"
    f" FROM (SELECT *, row_number() OVER (PARTITION BY {sql_id('rollout_id')} ORDER BY delivery_id) AS r FROM generations) WHERE r = 1 OR {sql_id('rollout_id')} IS NULL",
    "p4_new_in_batch": f"WITH g AS (SELECT delivery_id, {sql_id('rollout_id')} AS rollout_id, run_id, CAST(ingested_at AT TIME ZONE 'UTC' AS DATE) AS day, (SELECT max(CAST(ingested_at AT TIME ZONE 'UTC' AS DATE)) FROM generations) AS last FROM generations)"
    " SELECT delivery_id, rollout_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY delivery_id) AS r FROM g WHERE day = last) a"
    " WHERE (r = 1 OR rollout_id IS NULL) AND NOT EXISTS (SELECT 1 FROM g b WHERE b.day < b.last AND b.rollout_id = a.rollout_id)",
}
