"""Queries over the project's tables for the problems on training texts and records, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.normalize import day_of, norm_id, norm_source, norm_split
from tidemark.llm import leakage, mixing, overlap, pairs, percentiles, reading, splits
from tidemark.session import cut, load

PERCENTILES = [0.25, 0.5, 0.9, 0.95, 0.99]
#: Relative error of the summaries that are kept per day.
SUMMARY_ERROR = 0.005


# --- 1: broken pairs ----------------------------------------------------------------------------------------------------------


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, "generations").select(F.col("delivery_id").alias("id"), norm_id("task_id").alias("task"), "text", "code", F.col("finish_reason").alias("finish"))
    t = load(spark, sf_dir, "tasks").select(norm_id("task_id").alias("task"), "prompt")
    return pairs.defects(g, pairs.prompts_of(t, "task", "prompt")).select(F.col("id").alias("delivery_id"), "defect")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each arm have each defect."""
    g = load(spark, sf_dir, "generations").select("delivery_id", norm_id("arm").alias("arm"))
    return p1_found(spark, sf_dir).join(g, "delivery_id").groupBy("arm", "defect").agg(F.count(F.lit(1)).alias("rows"))


# --- 3: percentiles -----------------------------------------------------------------------------------------------------------


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, metric, arm, day, v): the possible values of both tables. A costing has the day of its rollout's first delivery."""
    g = load(spark, sf_dir, "generations").select(F.lit("generations").alias("source"), norm_id("rollout_id").alias("rollout_id"), norm_id("arm").alias("arm"), day_of("created_at").alias("day"), "delivery_id", "imputed_latency_s", "gpu_seconds")
    days = g.groupBy("rollout_id").agg(F.min_by("day", "delivery_id").alias("day"))
    c = load(spark, sf_dir, "cost_sidecar").select(F.lit("cost_sidecar").alias("source"), norm_id("rollout_id").alias("rollout_id"), norm_id("arm").alias("arm"), "imputed_latency_s", "gpu_seconds")
    names = ["source", "arm", "day", "imputed_latency_s", "gpu_seconds"]
    x = g.select(*names).unionAll(c.join(days, "rollout_id", "left").select(*names))
    x = x.select("source", "arm", "day", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("imputed_latency_s", "gpu_seconds")])).alias("m")).select("source", "m.metric", "arm", "day", "m.v")
    return x.where("v >= 0 AND NOT isnan(v) AND v < double('infinity')")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles for each arm (scope "arm") and for each arm and day ("arm_day")."""
    x = _costs(spark, sf_dir)
    both = x.withColumn("scope", F.explode(F.array(F.lit("arm"), F.lit("arm_day")))).withColumn("day", F.when(F.col("scope") == "arm_day", F.col("day")))
    out = percentiles.exact_percentiles(both, ["source", "metric", "scope", "arm", "day"], "v", PERCENTILES)
    return out.withColumn("value", F.round("value", 6))


def p3_day_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per value interval of each arm and day: what is stored to be combined later."""
    return percentiles.summaries(_costs(spark, sf_dir), ["source", "metric", "arm", "day"], "v", SUMMARY_ERROR)


def p3_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per arm from the days' summaries alone, each within SUMMARY_ERROR of the exact one."""
    out = percentiles.combine(p3_day_summaries(spark, sf_dir), ["source", "metric", "arm"], PERCENTILES, SUMMARY_ERROR)
    return out.select("source", "metric", "arm", "percentile", F.round("value", 6).alias("value"), "n", F.lit(SUMMARY_ERROR).alias("error"))


# --- 5: splits ----------------------------------------------------------------------------------------------------------------


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "tasks").select(norm_id("task_id").alias("task_id"), splits.author_key(F.get_json_object("metadata", "$.author")).alias("author"), splits.page_key(F.col("contamination.source_url")).alias("page"))
    return splits.entities(t, "task_id", ["author", "page"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, "generations").select(norm_id("task_id").alias("task_id"), norm_split("split").alias("split"))
    return splits.conflicts(_entities(spark, sf_dir), g, "task_id", "split").select(F.col("entity").alias("entity_id"), "task_id")


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    per = load(spark, sf_dir, "generations").groupBy(norm_id("task_id").alias("task_id"), norm_id("dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("n")).where("task_id IS NOT NULL")
    per = cut(per.join(_entities(spark, sf_dir), "task_id", "left").select("task_id", "dataset", "n", F.coalesce("entity", "task_id").alias("entity")))
    ratios = {"train": 0.6, "val": 0.2, "test": 0.2}
    return per, cut(splits.assign(per, "entity", "dataset", ratios, weight="n"))


def p5_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for every task of generations, whole entities together, its rows in the planned ratios for each dataset."""
    per, placed = _assigned(spark, sf_dir)
    return per.select("task_id", "entity").distinct().join(placed, "entity").select(F.col("entity").alias("entity_id"), "task_id", "split")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of each dataset's generations rows each split got."""
    per, placed = _assigned(spark, sf_dir)
    return splits.shares(placed, per, "entity", "dataset", weight="n").select(F.col("label").alias("dataset"), "split", F.col("n").alias("rows"), F.round("share", 6).alias("share"))


# --- 6: overlap ---------------------------------------------------------------------------------------------------------------


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, "generations").select(norm_id("task_id").alias("task_id"), norm_split("split").alias("split"))
    sides = g.where("task_id IS NOT NULL").groupBy("task_id").agg(F.coalesce(F.bool_or(F.col("split") == "train"), F.lit(False)).alias("left"), F.coalesce(F.bool_or(F.col("split").isin("val", "test")), F.lit(False)).alias("right"))
    t = load(spark, sf_dir, "tasks").select(norm_id("task_id").alias("task_id"), "prompt")
    return overlap.cross_split(t, "task_id", "prompt", sides).select(F.col("a").alias("task_id_a"), F.col("b").alias("task_id_b"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split and dataset, how many of its tasks overlap with the other side, and in how many pairs."""
    pairs = p6_found(spark, sf_dir)
    x = pairs.select("task_id_a", "task_id_b", F.explode(F.array("task_id_a", "task_id_b")).alias("task_id"))
    g = load(spark, sf_dir, "generations").select(norm_id("task_id").alias("task_id"), norm_split("split").alias("split"), norm_id("dataset").alias("dataset")).where("split IS NOT NULL").distinct()
    return x.join(g, "task_id").groupBy("split", "dataset").agg(F.count_distinct("task_id").alias("tasks"), F.count_distinct("task_id_a", "task_id_b").alias("pairs"))


# --- 7: leakage ---------------------------------------------------------------------------------------------------------------


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked, in how many documents and sources."""
    d = load(spark, sf_dir, "documents").select("doc_id", norm_source("source").alias("source"))
    x = p7_found(spark, sf_dir).join(d, "doc_id")
    return x.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("sources"))


# --- 8: mixing ----------------------------------------------------------------------------------------------------------------


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = load(spark, sf_dir, "documents").select("doc_id", norm_source("source").alias("source"), "text")
    n = cut(mixing.lengths(d, "doc_id", "source", "text"))
    t = load(spark, sf_dir, "mix_targets").select(norm_source("source").alias("source"), "target_share", "max_repeats")
    return n, *mixing.plan(n, t)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].where("out_of_reach").select("source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source of the mix, in tokens."""
    s = _mix(spark, sf_dir)[1]
    return s.select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", "docs", "tokens", F.round("target_tokens", 3).alias("target_tokens"), "actual_tokens", F.round("actual_share", 6).alias("actual_share"), "out_of_reach")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of the mix and how often it is used."""
    n, _, takes = _mix(spark, sf_dir)
    return mixing.pick(n, takes, seed=17).select(F.col("id").alias("doc_id"), "source", "n_tokens", "repeats")


# --- 9: reading levels --------------------------------------------------------------------------------------------------------


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.levels(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "reading_anchors"), "text", "reading_level")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents and words of prose of each source stand in each level."""
    d = load(spark, sf_dir, "documents").select("doc_id", norm_source("source").alias("source"))
    return _levels(spark, sf_dir).join(d, "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("documents"), F.sum("prose_words").alias("prose_words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p3_percentiles, p3_day_summaries, p3_combined, p5_found, p5_assigned, p5_shares, p6_found, p6_report, p7_found, p7_items, p8_found, p8_shares, p8_mix, p9_found, p9_profile)}

_TRIM = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))), '')"
_COSTS = f"""
WITH g AS (SELECT 'generations' AS source, {_TRIM.format('rollout_id')} AS rollout_id, {_TRIM.format('arm')} AS arm, nullif(regexp_extract(created_at, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS day, delivery_id, imputed_latency_s, gpu_seconds FROM generations),
days AS (SELECT rollout_id, arg_min(day, delivery_id) AS day FROM g GROUP BY 1),
c AS (SELECT 'cost_sidecar' AS source, {_TRIM.format('arm')} AS arm, d.day, imputed_latency_s, gpu_seconds FROM cost_sidecar s LEFT JOIN days d ON d.rollout_id = {_TRIM.format('s.rollout_id')}),
a AS (SELECT source, arm, day, imputed_latency_s, gpu_seconds FROM g UNION ALL SELECT * FROM c),
v AS (SELECT source, 'imputed_latency_s' AS metric, arm, day, imputed_latency_s AS v FROM a UNION ALL SELECT source, 'gpu_seconds', arm, day, gpu_seconds FROM a),
costs AS (SELECT * FROM v WHERE v >= 0 AND v::VARCHAR NOT IN ('nan', '-nan', 'inf', '-inf'))
"""
_WIDTH = "ln((1 + 0.005::DOUBLE) / (1 - 0.005::DOUBLE))"


# Keys of authors and pages, as in `splits`, and entities by reaching out over shared keys.
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_NONE = ", ".join(f"'{p}'" for p in splits.PLACEHOLDERS)
_AUTHOR = f"trim(regexp_replace(regexp_replace(lower(trim(json_extract_string(metadata, '$.author'), {_BLANKS})), '^@+', ''), '[\\s._\\-]+', '_', 'g'), '_')"
_PAGE = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(contamination.source_url, {_BLANKS})), '#.*$', ''), '^([a-z][a-z0-9+.\\-]*:)?//', ''), '^www\\.', ''), ':(80|443)(/|\\?|$)', '\\2', 'g')"
_ENTITY = (
    f"WITH RECURSIVE k0 AS (SELECT {_TRIM.format('task_id')} AS task_id, {_AUTHOR} AS author, {_PAGE} AS page FROM tasks),"
    " k1 AS (SELECT task_id, author, regexp_replace(regexp_replace(split_part(page, '?', 1), '/+', '/', 'g'), '(/(index\\.html?)?)$', '') AS path,"
    f" array_to_string(list_sort([q FOR q IN string_split(regexp_extract(page, '\\?(.*)$', 1), '&') IF q <> '' AND NOT regexp_matches(q, '{splits.TRACKING}')]), '&') AS asked FROM k0),"
    f" ky AS (SELECT task_id, 'a' || author AS k FROM k1 WHERE author NOT IN ({_NONE}) UNION SELECT task_id, 'p' || path || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END FROM k1 WHERE path NOT IN ({_NONE}) AND (contains(path, '/') OR asked <> '')),"
    " ln AS (SELECT DISTINCT x.task_id AS a, y.task_id AS b FROM ky x JOIN ky y USING (k) WHERE x.task_id IS NOT NULL AND y.task_id IS NOT NULL), re(a, b) AS (SELECT a, b FROM ln UNION SELECT re.a, ln.b FROM re JOIN ln ON re.b = ln.a),"
    f" en AS (SELECT a AS task_id, min(b) AS entity_id FROM re GROUP BY 1), sp AS (SELECT DISTINCT {_TRIM.format('task_id')} AS task_id, CASE {_TRIM.format('split')} WHEN 'validation' THEN 'val' WHEN 'training' THEN 'train' ELSE {_TRIM.format('split')} END AS split FROM generations),"
    " al AS (SELECT task_id, split, coalesce(entity_id, task_id) AS entity_id FROM sp LEFT JOIN en USING (task_id) WHERE split IS NOT NULL AND task_id IS NOT NULL)"
)

ORACLE = {
    "p3_percentiles": _COSTS
    + ", s AS (SELECT *, 'arm' AS scope, NULL::VARCHAR AS d FROM costs UNION ALL SELECT *, 'arm_day', day FROM costs),"
    " q AS (SELECT source, metric, scope, arm, d AS day, count(*) AS n, quantile_cont(v, [0.25, 0.5, 0.9, 0.95, 0.99]) AS qs FROM s GROUP BY 1, 2, 3, 4, 5)"
    " SELECT source, metric, scope, arm, day, unnest([0.25, 0.5, 0.9, 0.95, 0.99])::DOUBLE AS percentile, round(unnest(qs), 6) AS value, n FROM q",
    "p3_day_summaries": _COSTS + f" SELECT source, metric, arm, day, CASE WHEN v > 0 THEN floor(ln(v) / {_WIDTH})::BIGINT END AS bucket, count(*) AS n FROM costs GROUP BY ALL",
    "p3_combined": _COSTS
    + f", b AS (SELECT source, metric, arm, CASE WHEN v > 0 THEN floor(ln(v) / {_WIDTH})::BIGINT ELSE -1099511627776 END AS b, count(*) AS c FROM costs GROUP BY ALL),"
    " u AS (SELECT *, sum(c) OVER (PARTITION BY source, metric, arm ORDER BY b) AS upto, sum(c) OVER (PARTITION BY source, metric, arm) AS n FROM b), p AS (SELECT unnest([0.25, 0.5, 0.9, 0.95, 0.99])::DOUBLE AS percentile),"
    " gr AS (SELECT (1 + 0.005::DOUBLE) / (1 - 0.005::DOUBLE) AS g)"
    " SELECT source, metric, arm, percentile, round(CASE WHEN b = -1099511627776 THEN 0.0 ELSE pow(g, b) * (2 * g / (1 + g)) END, 6) AS value, n::BIGINT AS n, 0.005::DOUBLE AS error FROM u, p, gr WHERE ceil(percentile * (n - 1)) >= upto - c AND ceil(percentile * (n - 1)) < upto",
    "p5_found": _ENTITY + " SELECT entity_id, task_id FROM al WHERE entity_id IN (SELECT entity_id FROM al GROUP BY 1 HAVING count(DISTINCT split) > 1) GROUP BY ALL",
}
