"""Replay, aggregation, window, frontier, statistics and model queries over the logged rollouts, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions.normalize import norm_id, norm_split
from tidemark.operators import cost, features, frontier, ladder, models, replay, stats, validate
from tidemark.plans.tables import C, G, LARGE, R, SMALL, SOLVED, VISIBLE, amount, cells, grid, rollouts, solved, sql_amount, sql_id, sql_split, visible_frac
from tidemark.session import cut, load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
LAMS = [0.0, 0.001, 0.01, 0.05, 0.1, 0.5, 1.0]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, -0.0 as 0.0."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(cols: str, body: str) -> str:
    """SELECT with the named columns rounded."""
    return f"SELECT {', '.join(f'round({c[1:]}, 6) AS {c[1:]}' if c.startswith('~') else c for c in cols.split())} FROM ({body})"


# --- policies -----------------------------------------------------------------------------------------------------------------

_UNIT = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_PICK = "CASE WHEN {p} THEN l_solved ELSE s_solved END AS solved, CASE WHEN {p} THEN l_cost ELSE s_cost END AS cost, CASE WHEN {p} THEN l_latency ELSE s_latency END AS latency, CASE WHEN {p} THEN 'large' ELSE 'small' END AS action, {p} AS escalated"


def _sel(name: str, p: str, src: str = "g") -> str:
    return f"SELECT '{name}' AS policy, task_id, seed AS rep, {_PICK.format(p=p)} FROM {src}"


_ALWAYS_S, _ALWAYS_L = _sel("always_small", "FALSE"), _sel("always_large", "TRUE")
_RANDOM = _sel("random_route(0.5)", f"({_UNIT.format(chr(39) + 'R|0|' + chr(39) + ' || task_id || ' + chr(39) + '|' + chr(39) + ' || seed')} < 0.5)")
_ORACLE = _sel("oracle_router", "coalesce(s_solved < 1 AND l_solved >= 1, FALSE)")
_UP = "(NOT coalesce(s_visible >= 1.0, FALSE))"
_CASCADE = f"SELECT 'verifier_gated_cascade' AS policy, task_id, seed AS rep, CASE WHEN {_UP} THEN l_solved ELSE s_solved END AS solved, s_cost + CASE WHEN {_UP} THEN l_cost ELSE 0.0 END AS cost, s_latency + CASE WHEN {_UP} THEN l_latency ELSE 0.0 END AS latency, CASE WHEN {_UP} THEN 'small->large' ELSE 'small' END AS action, {_UP} AS escalated FROM g"
_BEST = (
    "SELECT 'best_of_3' AS policy, task_id, 0 AS rep, solved, cost, latency, 'best_of_3' AS action, FALSE AS escalated FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN ok THEN k END NULLS LAST, k DESC) AS pick FROM"
    " (SELECT task_id, k, s_solved AS solved, coalesce(s_visible >= 1.0, FALSE) AS ok, sum(s_cost) OVER (PARTITION BY task_id ORDER BY k) AS cost, sum(s_latency) OVER (PARTITION BY task_id ORDER BY k) AS latency FROM"
    " (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seed) AS k FROM g) WHERE k <= 3)) WHERE pick = 1"
)
OUT = G + f", o AS ({' UNION ALL '.join([_ALWAYS_S, _ALWAYS_L, _RANDOM, _BEST, _CASCADE, _ORACLE])})"
_COLS = "policy task_id rep ~solved ~cost ~latency action escalated"


def _policy(name: str, body: str, f) -> None:
    query(name, f"WITH {G} " + _r(_COLS, body))(lambda s, d: rounded(f(grid(s, d))))


_policy("pol_always", _ALWAYS_S + " UNION ALL " + _ALWAYS_L, lambda g: replay.always(g, SMALL, SMALL, LARGE).unionByName(replay.always(g, LARGE, SMALL, LARGE)))
_policy("pol_random", _RANDOM, lambda g: replay.random_route(g, 0.5, SMALL, LARGE))
_policy("pol_oracle", _ORACLE, lambda g: replay.oracle(g, SMALL, LARGE))
_policy("pol_cascade", _CASCADE, lambda g: replay.cascade(g, SMALL, LARGE))
_policy("pol_best_of_n", _BEST, lambda g: replay.best_of(g, 3))
_policy("pol_select", _sel("by_visible", "coalesce(s_visible < 0.5, FALSE)"), lambda g: replay._outcome(g, "by_visible", F.col("s_visible") < 0.5, SMALL, LARGE))
query("pol_standard", f"WITH {OUT} " + _r(_COLS, "SELECT * FROM o"))(lambda s, d: rounded(replay.standard(grid(s, d), SMALL, LARGE)))


def outcomes(s: SparkSession, d: str) -> DataFrame:
    """All baselines over one materialised grid: every query of several policies shares one scan."""
    return replay.standard(cut(grid(s, d)), SMALL, LARGE)


_DECIDED = f"dec AS (SELECT {sql_id('task_id')} AS task_id, max({sql_id('arm')}) AS action FROM decisions WHERE chosen AND lam = (SELECT min(lam) FROM decisions WHERE chosen) GROUP BY 1)"


@query("pol_from_decisions", f"WITH {G}, {_DECIDED} " + _r(_COLS, _sel("decided", "coalesce(action = 'large', FALSE)", "(SELECT g.*, action FROM g JOIN dec USING (task_id))")))
def pol_from_decisions(s, d):
    x = load(s, d, "decisions").where("chosen")
    low = x.agg(F.min("lam").alias("lam"))
    a = x.join(F.broadcast(low), "lam").groupBy(norm_id("task_id").alias("task_id")).agg(F.max(norm_id("arm")).alias("action"))
    return rounded(replay.from_decisions(grid(s, d), a, "decided", SMALL, LARGE, strict=False))


query("source_actions", "SELECT lam, lower(trim(task_id)) AS task_id, arm FROM decisions WHERE chosen AND lam = (SELECT max(lam) FROM decisions)")(
    lambda s, d: (lambda x: x.where("chosen").join(F.broadcast(x.agg(F.max("lam").alias("lam"))), "lam").select("lam", norm_id("task_id").alias("task_id"), "arm"))(load(s, d, "decisions")))

_SUM = "SELECT policy, avg(solved) AS accuracy, avg(cost) AS cost, avg(latency) AS latency_mean, quantile_cont(latency, 0.95) AS latency_p95, count(*) AS n FROM o GROUP BY 1"
query("agg_policy_summary", f"WITH {OUT} " + _r("policy ~accuracy ~cost ~latency_mean ~latency_p95 n", _SUM))(lambda s, d: rounded(replay.summary(outcomes(s, d))))
query("agg_per_task", f"WITH {OUT} " + _r("policy task_id ~solved ~cost ~latency escalated", "SELECT policy, task_id, avg(solved) AS solved, avg(cost) AS cost, avg(latency) AS latency, bool_or(escalated) AS escalated FROM o GROUP BY 1, 2"))(lambda s, d: rounded(replay.per_task(outcomes(s, d))))
_LAM = "lams AS (SELECT unnest([0.0, 0.001, 0.01, 0.05, 0.1, 0.5, 1.0])::DOUBLE AS lam)"
query("agg_utility", f"WITH {OUT}, {_LAM} " + _r("policy lam ~utility", "SELECT policy, lam, a - lam * c AS utility FROM (SELECT policy, avg(solved) FILTER (WHERE cost IS NOT NULL) AS a, avg(cost) FILTER (WHERE solved IS NOT NULL) AS c FROM o GROUP BY 1), lams"))(
    lambda s, d: rounded(replay.utility(outcomes(s, d), frontier.lam_grid(s, LAMS))))
_SWEEP = f"SELECT policy, lam, accuracy, cost, latency_mean, latency_p95, accuracy - lam * cost AS utility FROM ({_SUM}), lams"
query("cross_lambda", f"WITH {_LAM} SELECT l.lam, task_id, arm, count(*) AS n, round(max(p_pass - l.lam * e_cost), 6) AS utility FROM decisions d, lams l GROUP BY ALL")(
    lambda s, d: rounded(load(s, d, "decisions").drop("lam").crossJoin(F.broadcast(frontier.lam_grid(s, LAMS))).groupBy("lam", "task_id", "arm").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("p_pass") - F.col("lam") * F.col("e_cost")).alias("utility"))))
for _n in ("frontier_sweep",):
    query(_n, f"WITH {OUT}, {_LAM} " + _r("policy lam ~accuracy ~cost ~latency_mean ~latency_p95 ~utility", _SWEEP))(lambda s, d: rounded(frontier.sweep(replay.summary(outcomes(s, d)), frontier.lam_grid(s, LAMS))))

_CAN = "can AS (SELECT task_id, coalesce(max(s_solved), 0) >= 1 AS small_can, coalesce(max(l_solved), 0) >= 1 AS large_can FROM g GROUP BY 1)"
query("agg_headroom", f"WITH {G}, {_CAN} " + _r("n_tasks ~small_only ~large_only ~\"both\" ~neither ~escalation_helps ~escalation_wasteful", "SELECT count(*) AS n_tasks, avg((small_can AND NOT large_can)::INT) AS small_only, avg((NOT small_can AND large_can)::INT) AS large_only, avg((small_can AND large_can)::INT) AS \"both\", avg((NOT small_can AND NOT large_can)::INT) AS neither, avg((NOT small_can AND large_can)::INT) AS escalation_helps, avg(small_can::INT) AS escalation_wasteful FROM can"))(
    lambda s, d: rounded(replay.headroom(grid(s, d))))
_CONF = "SELECT policy, CASE WHEN NOT small_can AND NOT large_can THEN 'unsolvable' WHEN e AND NOT small_can THEN 'correct_escalation' WHEN e THEN 'false_escalation' WHEN small_can THEN 'correct_small' ELSE 'missed_escalation' END AS outcome, count(*) AS tasks FROM (SELECT policy, task_id, bool_or(escalated) AS e FROM o GROUP BY 1, 2) JOIN can USING (task_id) GROUP BY 1, 2"
query("agg_confusion", f"WITH {OUT}, {_CAN} {_CONF}")(lambda s, d: (lambda g: replay.confusion(replay.standard(g, SMALL, LARGE), g))(cut(grid(s, d))))
query("agg_confusion_regret", f"WITH {OUT}, {_CAN} SELECT policy, sum(tasks)::BIGINT AS tasks, sum(CASE WHEN outcome = 'unsolvable' THEN tasks ELSE 0 END)::BIGINT AS unsolvable, round(sum(CASE WHEN outcome IN ('missed_escalation', 'false_escalation') THEN tasks ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN outcome <> 'unsolvable' THEN tasks ELSE 0 END), 0), 6) AS regret FROM ({_CONF}) GROUP BY 1")(
    lambda s, d: (lambda g: rounded(replay.confusion_summary(replay.confusion(replay.standard(g, SMALL, LARGE), g))))(cut(grid(s, d))))

_HACKS = "['" + "', '".join(replay.HACKS) + "']"
_CATEGORY = (
    f"CASE WHEN list_has_any(coalesce(hack_flags, []), {_HACKS}) THEN 'reward_hack' WHEN error_class IN ('harness_error', 'timeout', 'empty_code', 'syntax_error') THEN error_class"
    " WHEN hidden_total > 0 AND hidden_passed = hidden_total THEN 'solved' WHEN finish_reason = 'length' THEN 'truncated' WHEN error_class = 'runtime_error' THEN 'runtime_error'"
    " WHEN visible_total > 0 AND coalesce(visible_passed, 0) >= visible_total THEN 'overfit_visible' ELSE 'wrong_answer' END"
)
_TAXCOLS = ["arm", "hack_flags", "error_class", "hidden_passed", "hidden_total", "visible_passed", "visible_total", "finish_reason"]
query("agg_taxonomy", f"WITH {R}, k AS (SELECT arm, {_CATEGORY} AS category FROM r) SELECT arm, FALSE AS overall, category, count(*) AS n FROM k GROUP BY 1, 3 UNION ALL SELECT NULL, TRUE, category, count(*) FROM k GROUP BY 3")(
    lambda s, d: replay.taxonomy(rollouts(s, d, *_TAXCOLS)))
query("agg_gap_attribution", f"WITH {R}, k AS (SELECT arm, {_CATEGORY} AS category FROM r WHERE arm IN ('small', 'large')), p AS (SELECT category, count(*) FILTER (WHERE arm = 'small') AS s, count(*) FILTER (WHERE arm = 'large') AS l FROM k GROUP BY 1), t AS (SELECT sum(s) AS ts, sum(l) AS tl FROM p) SELECT category, round(delta, 6) AS delta FROM (SELECT category, l::DOUBLE / tl - s::DOUBLE / ts AS delta FROM p, t) WHERE abs(delta) >= 0.005")(
    lambda s, d: rounded(replay.gap(rollouts(s, d, *_TAXCOLS), SMALL, LARGE)))

# --- plain aggregates ---------------------------------------------------------------------------------------------------------

query("agg_arm_accuracy", f"WITH {R} SELECT arm, round(avg({SOLVED}), 6) AS accuracy, count({SOLVED}) AS n FROM r GROUP BY 1")(
    lambda s, d: rounded(rollouts(s, d, "arm", "hidden_passed", "hidden_total").groupBy("arm").agg(F.avg(solved()).alias("accuracy"), F.count(solved()).alias("n"))))
query("chart_data", f"WITH {R} SELECT arm, round(avg({SOLVED}), 6) AS accuracy, round(avg(gpu_seconds), 6) AS cost FROM r GROUP BY 1")(
    lambda s, d: rounded(rollouts(s, d, "arm", "hidden_passed", "hidden_total", "gpu_seconds").groupBy("arm").agg(F.avg(solved()).alias("accuracy"), F.avg("gpu_seconds").alias("cost"))))
for _n in ("agg_arm_dataset",):
    query(_n, f"WITH {R} SELECT arm, dataset, round(avg({SOLVED}), 6) AS accuracy, round(avg(gpu_seconds), 6) AS cost, count(*) AS n FROM r GROUP BY CUBE (arm, dataset)")(
        lambda s, d: rounded(rollouts(s, d, "arm", "dataset", "hidden_passed", "hidden_total", "gpu_seconds").cube("arm", "dataset").agg(F.avg(solved()).alias("accuracy"), F.avg("gpu_seconds").alias("cost"), F.count(F.lit(1)).alias("n"))))
query("agg_manifest_counts", f"WITH {R} SELECT run_id, arm, finish_reason, extract_strategy, count(*) AS n, round(avg((finish_reason = 'length')::INT), 6) AS truncation_rate, round(avg((NOT tokens_exact)::INT), 6) AS approximate_rate, count(DISTINCT params_hash) AS params FROM r GROUP BY ROLLUP (run_id, arm, finish_reason, extract_strategy)")(
    lambda s, d: rounded(rollouts(s, d, "run_id", "arm", "finish_reason", "extract_strategy", "tokens_exact", "params_hash").rollup("run_id", "arm", "finish_reason", "extract_strategy").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("finish_reason") == "length").cast("double")).alias("truncation_rate"), F.avg((~F.col("tokens_exact")).cast("double")).alias("approximate_rate"), F.count_distinct("params_hash").alias("params"))))
query("agg_graded_counts", f"WITH {R} SELECT 'error_class' AS kind, error_class AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'hack_flag', f, count(*) FROM (SELECT unnest(hack_flags) AS f FROM r) GROUP BY 2 UNION ALL SELECT 'solved', CASE WHEN v IS NULL THEN NULL WHEN v = 1 THEN 'true' ELSE 'false' END, count(*) FROM (SELECT {SOLVED} AS v FROM r) GROUP BY 2")(
    lambda s, d: (lambda x: reduce(DataFrame.unionByName, [x.groupBy(F.lit("error_class").alias("kind"), F.col("error_class").alias("value")).agg(F.count(F.lit(1)).alias("n")), x.select(F.explode("hack_flags").alias("value")).groupBy(F.lit("hack_flag").alias("kind"), "value").agg(F.count(F.lit(1)).alias("n")), x.groupBy(F.lit("solved").alias("kind"), (solved() == 1).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))]))(rollouts(s, d, "error_class", "hack_flags", "hidden_passed", "hidden_total")))
query("agg_counts", f"WITH {R} SELECT split, arm, count(*) AS n FROM r GROUP BY GROUPING SETS ((split), (arm))")(
    lambda s, d: rollouts(s, d, "split", "arm").groupingSets([["split"], ["arm"]], "split", "arm").agg(F.count(F.lit(1)).alias("n")))
query("agg_distinct", f"WITH {R} SELECT count(DISTINCT task_id) AS tasks, count(DISTINCT arm) AS arms, count(DISTINCT seed) AS seeds, count(DISTINCT split) AS splits FROM r")(
    lambda s, d: rollouts(s, d, "task_id", "arm", "seed", "split").agg(F.count_distinct("task_id").alias("tasks"), F.count_distinct("arm").alias("arms"), F.count_distinct("seed").alias("seeds"), F.count_distinct("split").alias("splits")))
query("agg_split_counts", f"SELECT {sql_split('split')} AS split, count(*) AS n FROM split_manifest GROUP BY 1")(
    lambda s, d: load(s, d, "split_manifest").groupBy(norm_split("split").alias("split")).agg(F.count(F.lit(1)).alias("n")))
query("agg_cheap_arm", f"WITH {R} SELECT arg_min(arm, (c, arm)) AS arm, round(min(c), 6) AS mean_cost FROM (SELECT arm, avg(gpu_seconds) AS c FROM r GROUP BY 1 HAVING c IS NOT NULL)")(
    lambda s, d: rounded(rollouts(s, d, "arm", "gpu_seconds").groupBy("arm").agg(F.avg("gpu_seconds").alias("c")).where("c IS NOT NULL").agg(F.min_by("arm", F.struct("c", "arm")).alias("arm"), F.min("c").alias("mean_cost"))))
query("agg_arm_share", "SELECT lam, arm, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lam), 6) AS share FROM decisions WHERE chosen GROUP BY 1, 2")(
    lambda s, d: rounded(load(s, d, "decisions").where("chosen").groupBy("lam", "arm").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("lam")))))
query("agg_lambda_class", "SELECT lam, CASE WHEN count(DISTINCT arm) = 1 THEN 'degenerate' ELSE 'mixed' END AS kind FROM decisions WHERE chosen GROUP BY 1")(
    lambda s, d: load(s, d, "decisions").where("chosen").groupBy("lam").agg(F.when(F.count_distinct("arm") == 1, "degenerate").otherwise("mixed").alias("kind")))
query("agg_probe_cost", "SELECT round(avg(probe_cost), 6) AS probe_cost FROM (SELECT task_id, max(probe_cost) AS probe_cost FROM decisions WHERE lam = (SELECT min(lam) FROM decisions) GROUP BY 1)")(
    lambda s, d: (lambda x: rounded(x.join(F.broadcast(x.agg(F.min("lam").alias("lam"))), "lam").groupBy("task_id").agg(F.max("probe_cost").alias("probe_cost")).agg(F.avg("probe_cost").alias("probe_cost"))))(load(s, d, "decisions")))
query("agg_corpus_counts", f"SELECT coalesce(m.split, 'unassigned') AS split, count(*) AS n FROM (SELECT DISTINCT {sql_id('task_id')} AS task_id FROM tasks) t LEFT JOIN (SELECT {sql_id('task_id')} AS task_id, max({sql_split('split')}) AS split FROM split_manifest GROUP BY 1) m USING (task_id) GROUP BY 1")(
    lambda s, d: load(s, d, "tasks").select(norm_id("task_id").alias("task_id")).distinct().join(load(s, d, "split_manifest").groupBy(norm_id("task_id").alias("task_id")).agg(F.max(norm_split("split")).alias("split")), "task_id", "left").groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(F.count(F.lit(1)).alias("n")))
query("prereg_exclusions", f"WITH {R} SELECT rollout_id FROM r WHERE coalesce(finish_reason, '') <> 'error' AND coalesce(error_class, '') <> 'harness_error' AND run_id NOT LIKE '%-dirty'")(
    lambda s, d: rollouts(s, d, "finish_reason", "error_class", "run_id").where("coalesce(finish_reason, '') <> 'error' AND coalesce(error_class, '') <> 'harness_error' AND run_id NOT LIKE '%-dirty'").select("rollout_id"))
query("prereg_hack_rule", f"WITH {R} SELECT arm, round(avg(h), 6) AS flagged_rate, avg(h) > 0.02 AS report_both, round(avg(s), 6) AS accuracy, round(avg(CASE WHEN h = 1 AND s IS NOT NULL THEN 0.0 ELSE s END), 6) AS accuracy_strict FROM (SELECT arm, (len(coalesce(hack_flags, [])) > 0)::INT AS h, {SOLVED} AS s FROM r) GROUP BY 1")(
    lambda s, d: rounded(rollouts(s, d, "arm", "hack_flags", "hidden_passed", "hidden_total").select("arm", F.coalesce(F.size("hack_flags") > 0, F.lit(False)).alias("h"), solved().alias("s")).groupBy("arm").agg(F.avg(F.col("h").cast("double")).alias("flagged_rate"), (F.avg(F.col("h").cast("double")) > 0.02).alias("report_both"), F.avg("s").alias("accuracy"), F.avg(F.when(F.col("h") & F.col("s").isNotNull(), 0.0).otherwise(F.col("s"))).alias("accuracy_strict"))))
query("sweep_truncation_alarm", f"WITH {R} SELECT run_id, round(avg((finish_reason = 'length')::INT), 6) AS rate, avg((finish_reason = 'length')::INT) > 0.15 AS alarm FROM r GROUP BY 1")(
    lambda s, d: rounded(rollouts(s, d, "run_id", "finish_reason").groupBy("run_id").agg(F.avg((F.col("finish_reason") == "length").cast("double")).alias("rate"), (F.avg((F.col("finish_reason") == "length").cast("double")) > 0.15).alias("alarm"))))

# --- calibration and AUC over decisions ---------------------------------------------------------------------------------------

_SCORED = f"sc AS (SELECT d.p_pass AS p, c.y FROM (SELECT {sql_id('task_id')} AS task_id, {sql_id('arm')} AS arm, max(p_pass) AS p_pass FROM decisions GROUP BY 1, 2) d JOIN (SELECT task_id, arm, ({SOLVED})::INT AS y FROM c WHERE hidden_total IS NOT NULL) c USING (task_id, arm))"


def scored(s: SparkSession, d: str) -> DataFrame:
    """(p, y, task_id): predicted and observed success of each graded first attempt that has a prediction."""
    p = load(s, d, "decisions").groupBy(norm_id("task_id").alias("task_id"), norm_id("arm").alias("arm")).agg(F.max("p_pass").alias("p"))
    c = cells(s, d, "hidden_passed", "hidden_total").where("hidden_total IS NOT NULL").select("task_id", "arm", solved().cast("int").alias("y"))
    return c.join(p, ["task_id", "arm"]).select("task_id", "p", "y")


_BIN = " + ".join(f"(p >= {e!r}::DOUBLE)::INT" for e in stats.edges(10)[1:-1])
_REL = f"rel AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed, avg(p) - avg(y) AS gap FROM sc WHERE p IS NOT NULL GROUP BY 1)"
query("agg_reliability", f"WITH {C}, {_SCORED}, {_REL} " + _r("bin n ~predicted ~observed ~gap", "SELECT * FROM rel"))(lambda s, d: rounded(stats.reliability(scored(s, d), "p", "y")))
query("agg_ece", f"WITH {C}, {_SCORED}, {_REL} SELECT round(sum(n * abs(gap)) / sum(n), 6) AS ece FROM rel")(lambda s, d: rounded(stats.calibration(stats.reliability(scored(s, d), "p", "y")).select("ece")))
query("agg_mce", f"WITH {C}, {_SCORED}, {_REL} SELECT round(max(abs(gap)), 6) AS mce FROM rel")(lambda s, d: rounded(stats.calibration(stats.reliability(scored(s, d), "p", "y")).select("mce")))
query("agg_brier", f"WITH {C}, {_SCORED} SELECT round(avg(pow(p - y, 2)), 6) AS brier FROM sc")(lambda s, d: rounded(scored(s, d).agg(stats.brier("p", "y").alias("brier"))))
_RANK = "SELECT v, y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM {0}"
query("agg_auc", f"WITH {C}, {_SCORED} SELECT round((sum(rk) FILTER (WHERE y = 1) - p * (p + 1) / 2.0) / (p * q), 6) AS auc, (p + q)::BIGINT AS n FROM ({_RANK.format('(SELECT p AS v, y FROM sc WHERE p IS NOT NULL)')}), (SELECT sum(y) AS p, sum(1 - y) AS q FROM sc WHERE p IS NOT NULL) GROUP BY p, q")(lambda s, d: rounded(stats.auc(scored(s, d), "p", "y")))
query("win_rank_avg", f"WITH {R} SELECT rollout_id, decode_tokens, rank() OVER (ORDER BY decode_tokens) + (count(*) OVER (PARTITION BY decode_tokens) - 1) / 2.0 AS rank FROM r WHERE decode_tokens IS NOT NULL")(lambda s, d: stats.average_rank(rollouts(s, d, "decode_tokens").where("decode_tokens IS NOT NULL").select("rollout_id", "decode_tokens"), "decode_tokens"))

# --- windows ------------------------------------------------------------------------------------------------------------------

_K = "k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seed) AS k FROM g)"
query("win_first_pass", f"WITH {G}, {_K} SELECT task_id, coalesce(min(k) FILTER (WHERE coalesce(s_visible >= 1, FALSE)), max(k)) AS drawn FROM k GROUP BY 1")(
    lambda s, d: grid(s, d).withColumn("k", F.row_number().over(W.partitionBy("task_id").orderBy("seed"))).groupBy("task_id").agg(F.coalesce(F.min(F.when(F.col("s_visible") >= 1, F.col("k"))), F.max("k")).cast("long").alias("drawn")))
query("win_cum_cost", f"WITH {G} SELECT task_id, seed, round(sum(s_cost) OVER (PARTITION BY task_id ORDER BY seed), 6) AS cost, round(sum(s_latency) OVER (PARTITION BY task_id ORDER BY seed), 6) AS latency FROM g")(
    lambda s, d: (lambda w: rounded(grid(s, d).select("task_id", "seed", F.sum("s_cost").over(w).alias("cost"), F.sum("s_latency").over(w).alias("latency"))))(W.partitionBy("task_id").orderBy("seed").rowsBetween(W.unboundedPreceding, 0)))
query("win_first_row", f"WITH {C} SELECT task_id, arm, arg_min(rollout_id, (seed, delivery_id)) AS rollout_id FROM c WHERE seed IS NOT NULL GROUP BY 1, 2")(
    lambda s, d: cells(s, d).where("seed IS NOT NULL").groupBy("task_id", "arm").agg(F.min_by("rollout_id", F.struct("seed", "delivery_id")).alias("rollout_id")))
_RATE = "CASE WHEN visible_total > 0 THEN coalesce(visible_passed, 0)::DOUBLE / visible_total END"
query("join_siblings", f"WITH {C} SELECT rollout_id, count(*) OVER w - 1 AS others, count(visible_passed) OVER w - (visible_passed IS NOT NULL)::INT AS others_seen, (coalesce(sum(visible_passed) OVER w, 0) - coalesce(visible_passed, 0))::BIGINT AS others_passed FROM c WHERE arm IS NOT NULL WINDOW w AS (PARTITION BY task_id, arm)")(
    lambda s, d: features.others(cells(s, d, "visible_passed").where("arm IS NOT NULL"), ["task_id", "arm"], "visible_passed").select("rollout_id", "others", "others_seen", "others_passed"))
for _n in ("win_sibling",):
    query(_n, f"WITH {C}, q AS (SELECT rollout_id, {_RATE} AS v, sum({_RATE}) OVER w AS t, count({_RATE}) OVER w AS n, count(*) OVER w AS m FROM c WHERE arm IS NOT NULL WINDOW w AS (PARTITION BY task_id, arm)) SELECT rollout_id, round(CASE WHEN n - (v IS NOT NULL)::INT > 0 THEN (t - coalesce(v, 0)) / (n - (v IS NOT NULL)::INT) ELSE 0.5 END, 6) AS agreement, m - 1 AS siblings FROM q")(
        lambda s, d: rounded(features.siblings(cells(s, d, "visible_passed", "visible_total").where("arm IS NOT NULL")).select("rollout_id", F.col("sibling_visible_agreement").alias("agreement"), F.col("sibling_count").alias("siblings"))))
_PVALS = "SELECT policy, p FROM (SELECT policy, avg(abs(cost - latency)) AS x FROM o GROUP BY 1), LATERAL (SELECT exp(-x) AS p)"
_BHQ = "SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q, row_number() OVER (ORDER BY p) AS k FROM pv"
for _n in ("win_bh",):
    query(_n, f"WITH {OUT}, pv AS ({_PVALS}) SELECT policy, round(p, 6) AS p, round(least(1.0, min(q) OVER (ORDER BY k DESC)), 6) AS adjusted FROM ({_BHQ})")(
        lambda s, d: rounded(stats.benjamini_hochberg(outcomes(s, d).groupBy("policy").agg(F.exp(-F.avg(F.abs(F.col("cost") - F.col("latency")))).alias("p")), "p")))
_SPLITS3 = "SELECT split, count(*) FILTER (WHERE l_solved = 1 AND s_solved = 0) AS b, count(*) FILTER (WHERE l_solved = 0 AND s_solved = 1) AS c FROM g WHERE split IS NOT NULL GROUP BY 1"
_EXACT = "(SELECT CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))) END FROM (SELECT b + c AS n, unnest(range(least(b, c) + 1)) AS k))"


@query("stat_bh", f"WITH {G}, pv AS (SELECT split, {_EXACT} AS p FROM ({_SPLITS3})) SELECT split, round(p, 6) AS p, round(least(1.0, min(q) OVER (ORDER BY k DESC)), 6) AS adjusted FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, split) AS q, row_number() OVER (ORDER BY p, split) AS k FROM pv)")
def stat_bh(s, d):
    """The exact test of large against small within each split, adjusted for the family."""
    x = grid(s, d).where("split IS NOT NULL")
    l, m = F.col("l_solved") == 1, F.col("s_solved") == 1
    t = x.groupBy("split").agg(F.count_if(l & ~m).alias("b"), F.count_if(~l & m).alias("c")).collect()
    return rounded(stats.benjamini_hochberg(s.createDataFrame([(r["split"], stats.mcnemar_p(r["b"], r["c"])) for r in t], "split string, p double"), "p"))


query("win_pareto", f"WITH {OUT}, pt AS ({_SUM}) SELECT policy, round(accuracy, 6) AS accuracy, round(cost, 6) AS cost FROM (SELECT *, coalesce(max(accuracy) OVER (ORDER BY cost, accuracy DESC, policy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best FROM pt) WHERE accuracy > best + 1e-12")(
    lambda s, d: rounded(frontier.pareto(replay.summary(outcomes(s, d)).select("policy", "accuracy", "cost"))))
# Curves over the cascade's threshold and the random share.
_THRESH, _SHARES = [0.1, 0.4, 0.6, 1.0, 1.1], [0.0, 0.25, 0.5, 0.75, 1.0]


def curves(s: SparkSession, d: str) -> DataFrame:
    """(name, cost, accuracy): the cascade over thresholds and random routing over shares."""
    g = cut(grid(s, d))
    one = [replay.cascade(g, SMALL, LARGE, t).withColumn("name", F.lit("cascade")).withColumn("at", F.lit(t)) for t in _THRESH]
    one += [replay.random_route(g, p, SMALL, LARGE).withColumn("name", F.lit("random")).withColumn("at", F.lit(p)) for p in _SHARES]
    return reduce(DataFrame.unionByName, one).groupBy("name", "at").agg(F.avg("cost").alias("cost"), F.avg("solved").alias("accuracy")).select("name", "cost", "accuracy")


_CURVES = ("cv AS (" + " UNION ALL ".join(
    [f"SELECT 'cascade' AS name, avg(s_cost + CASE WHEN u THEN l_cost ELSE 0.0 END) AS cost, avg(CASE WHEN u THEN l_solved ELSE s_solved END) AS accuracy FROM (SELECT *, NOT coalesce(s_visible >= {t}, FALSE) AS u FROM g)" for t in _THRESH]
    + [f"SELECT 'random', avg(CASE WHEN u THEN l_cost ELSE s_cost END), avg(CASE WHEN u THEN l_solved ELSE s_solved END) FROM (SELECT *, {_UNIT.format(chr(39) + 'R|0|' + chr(39) + ' || task_id || ' + chr(39) + '|' + chr(39) + ' || seed')} < {p} AS u FROM g)" for p in _SHARES]) + ")")
_INTERP = "ip AS (SELECT DISTINCT c.name, q.cost, CASE WHEN x2 IS NULL OR q.cost = x THEN y ELSE y + (y2 - y) * (q.cost - x) / (x2 - x) END AS accuracy FROM (SELECT name, cost AS x, accuracy AS y, lead(cost) OVER w AS x2, lead(accuracy) OVER w AS y2 FROM (SELECT DISTINCT * FROM cv) WINDOW w AS (PARTITION BY name ORDER BY cost, accuracy)) c, qs q WHERE q.cost >= x AND (q.cost < x2 OR (x2 IS NULL AND q.cost = x)))"
_RANGE = "rg AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT name, min(cost) AS lo, max(cost) AS hi FROM cv GROUP BY 1))"
_QS = "qs AS (SELECT CASE WHEN i = 24 THEN hi ELSE lo + i * ((hi - lo) / 24) END AS cost FROM rg, range(25) t(i) WHERE lo <= hi)"
_MATCH = f"{_CURVES}, {_RANGE}, {_QS}, {_INTERP}, mt AS (SELECT cost, max(accuracy) FILTER (WHERE name = 'cascade') AS accuracy_a, max(accuracy) FILTER (WHERE name = 'random') AS accuracy_b FROM ip GROUP BY 1)"
query("win_interp", f"WITH {G}, {_CURVES}, {_RANGE}, {_QS}, {_INTERP} SELECT name, round(cost, 6) AS cost, round(accuracy, 6) AS accuracy FROM ip")(
    lambda s, d: (lambda c: rounded(frontier.at_cost(c, frontier.matched(c, "cascade", "random").select("cost"))))(cut(curves(s, d))))
query("frontier_matched", f"WITH {G}, {_MATCH} SELECT round(cost, 6) AS cost, round(accuracy_a, 6) AS accuracy_a, round(accuracy_b, 6) AS accuracy_b, round(accuracy_a - accuracy_b, 6) AS difference FROM mt WHERE accuracy_a IS NOT NULL AND accuracy_b IS NOT NULL")(
    lambda s, d: rounded(frontier.matched(cut(curves(s, d)), "cascade", "random")))
query("frontier_dominates", f"WITH {G}, {_MATCH} SELECT coalesce(min(accuracy_a - accuracy_b) >= 0, FALSE) AS dominates, count(*) AS costs FROM mt WHERE accuracy_a IS NOT NULL AND accuracy_b IS NOT NULL")(
    lambda s, d: frontier.dominates(frontier.matched(cut(curves(s, d)), "cascade", "random")))
_FOLD = "SELECT task_id, ((row_number() OVER (ORDER BY md5('F|0|' || task_id), task_id) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT task_id FROM c)"
query("win_fold", f"WITH {C} {_FOLD}")(lambda s, d: features.fold(cells(s, d).select("task_id").distinct(), "task_id", 5).select("task_id", F.col("fold").cast("int").alias("fold")))
_OBS = f"ob AS (SELECT rollout_id, model_id, batch_size AS batch, prefill_tokens, decode_tokens, wall_ms / 1000 AS seconds FROM r WHERE mode = 'serving' AND tokens_exact AND wall_ms > 0 AND prefill_tokens IS NOT NULL AND decode_tokens IS NOT NULL AND model_id IS NOT NULL)"


def observations(s: SparkSession, d: str) -> DataFrame:
    x = rollouts(s, d, "model_id", "batch_size", "prefill_tokens", "decode_tokens", "wall_ms", "mode", "tokens_exact")
    return x.where("mode = 'serving' AND tokens_exact AND wall_ms > 0 AND prefill_tokens IS NOT NULL AND decode_tokens IS NOT NULL AND model_id IS NOT NULL").select("rollout_id", "model_id", F.col("batch_size").alias("batch"), "prefill_tokens", "decode_tokens", (F.col("wall_ms") / 1000).alias("seconds"))


query("win_holdout", f"WITH {R}, {_OBS} SELECT rollout_id, (row_number() OVER (PARTITION BY model_id, batch ORDER BY rollout_id)) % 4 = 0 AND count(*) OVER (PARTITION BY model_id, batch) >= 24 AS held FROM ob")(
    lambda s, d: cost.holdout(observations(s, d), ["model_id", "batch"], ["rollout_id"]).select("rollout_id", "held"))
_TASKS = f"tk AS (SELECT {sql_id('task_id')} AS task_id, max(prompt) AS prompt, max(visible_tests) AS visible_tests, max(entrypoint) AS entrypoint FROM tasks GROUP BY 1)"


def task_rows(s: SparkSession, d: str) -> DataFrame:
    """One row per task; where rows of a task differ, the greatest values."""
    return load(s, d, "tasks").groupBy(norm_id("task_id").alias("task_id")).agg(*[F.max(c).alias(c) for c in ("prompt", "visible_tests", "entrypoint", "hidden_tests", "dataset")]).where("task_id IS NOT NULL")


_P, _V = "coalesce(prompt, '')", "coalesce(visible_tests, '')"
_HSQL = {
    "h_prompt_chars": f"length({_P})::DOUBLE", "h_prompt_words": f"len([x FOR x IN regexp_split_to_array({_P}, '\\s+') IF x <> ''])::DOUBLE", "h_prompt_lines": f"(length({_P}) - length(replace({_P}, chr(10), '')) + 1)::DOUBLE",
    "h_n_visible_tests": f"((length({_V}) - length(replace({_V}, 'assert', ''))) / 6)::DOUBLE", "h_control_keywords": f"len(regexp_extract_all({_P}, '\\b(for|while|if)\\b'))::DOUBLE", "h_algorithmic_terms": f"len(regexp_extract_all({_P}, '{features.ALGORITHMIC_PATTERN}'))::DOUBLE",
}
_LONG = "lf AS (" + " UNION ALL ".join(f"SELECT task_id, '{n}' AS feature, {e} AS value FROM tk WHERE task_id IS NOT NULL" for n, e in _HSQL.items()) + ")"


def _long(s, d):
    """(task_id, feature, value): all heuristic features of all tasks."""
    return features.long_form(features.build(task_rows(s, d), list(_HSQL), ["task_id"]), "task_id", list(_HSQL))


_QUANTS = "[" + ", ".join(f"{i}.0 / 7.0" for i in range(8)) + "]"
_CUTS = f"ct AS (SELECT DISTINCT feature, unnest(quantile_cont(value, [x::DOUBLE FOR x IN {_QUANTS}])) AS threshold FROM lf GROUP BY feature)".replace("[x::DOUBLE FOR x IN " + _QUANTS + "]", "[" + ", ".join(repr(i / 7) for i in range(8)) + "]")
query("win_quantile_cut", f"WITH {_TASKS}, {_LONG}, {_CUTS} SELECT feature, round(threshold, 6) AS threshold FROM ct")(lambda s, d: rounded(frontier.thresholds(_long(s, d), 8)))
_PT = "pt AS (SELECT task_id, avg(s_solved) AS s_solved, avg(s_cost) AS s_cost, avg(l_solved) AS l_solved, avg(l_cost) AS l_cost FROM g {0} GROUP BY 1)"


def task_values(g: DataFrame) -> DataFrame:
    return g.groupBy("task_id").agg(*[F.avg(c).alias(c) for c in ("s_solved", "s_cost", "l_solved", "l_cost")])


_RULES = "rl AS (SELECT feature, threshold, above, avg(CASE WHEN (value > threshold) = above THEN l_solved ELSE s_solved END) AS accuracy, avg(CASE WHEN (value > threshold) = above THEN l_cost ELSE s_cost END) AS cost FROM lf JOIN ct USING (feature) JOIN pt USING (task_id), (VALUES (TRUE), (FALSE)) b(above) GROUP BY 1, 2, 3)"
query("cross_thresholds", f"WITH {G}, {_TASKS}, {_LONG}, {_CUTS}, {_PT.format('')}, {_RULES} " + _r("feature ~threshold above ~accuracy ~cost", "SELECT * FROM rl"))(
    lambda s, d: rounded(frontier.rules(_long(s, d), frontier.thresholds(_long(s, d), 8), task_values(grid(s, d)))))
_BESTRULE = "SELECT lam, feature, threshold, above, accuracy, cost, utility FROM (SELECT *, row_number() OVER (PARTITION BY lam ORDER BY round(-utility, 9), feature, threshold, NOT above) AS k FROM (SELECT *, accuracy - lam * cost AS utility FROM rl, lams)) WHERE k = 1"
for _n in ("pol_heuristic_tune",):
    query(_n, f"WITH {G}, {_TASKS}, {_LONG}, {_CUTS}, {_PT.format(chr(87) + 'HERE split = ' + chr(39) + 'val' + chr(39))}, {_RULES}, {_LAM} " + _r("lam feature ~threshold above ~accuracy ~cost ~utility", _BESTRULE))(
        lambda s, d: rounded(frontier.best_rule(frontier.rules(_long(s, d), frontier.thresholds(_long(s, d), 8), task_values(grid(s, d).where("split = 'val'"))), frontier.lam_grid(s, LAMS))))
query("topk_rule", f"WITH {G}, {_TASKS}, {_LONG}, {_CUTS}, {_PT.format(chr(87) + 'HERE split = ' + chr(39) + 'val' + chr(39))}, {_RULES} " + _r("feature ~threshold above ~utility", "SELECT feature, threshold, above, utility FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(-utility, 9), threshold, NOT above) AS k FROM (SELECT *, accuracy - 0.05 * cost AS utility FROM rl)) WHERE k = 1"))(
    lambda s, d: rounded(frontier.rules(_long(s, d), frontier.thresholds(_long(s, d), 8), task_values(grid(s, d).where("split = 'val'"))).withColumn("utility", F.col("accuracy") - 0.05 * F.col("cost")).groupBy("feature").agg(F.min_by(F.struct("threshold", "above", "utility"), F.struct(F.round(-F.col("utility"), 9), "threshold", ~F.col("above"))).alias("r")).select("feature", "r.*")))
_PT2 = _PT.format("WHERE split = 'test'").replace("pt AS", "pe AS")
query("pol_heuristic_frontier", f"WITH {G}, {_TASKS}, {_LONG}, {_CUTS}, {_PT.format(chr(87) + 'HERE split = ' + chr(39) + 'val' + chr(39))}, {_PT2}, {_RULES}, {_LAM}, br AS ({_BESTRULE}) SELECT lam, round(avg(CASE WHEN (value > threshold) = above THEN l_solved ELSE s_solved END), 6) AS accuracy, round(avg(CASE WHEN (value > threshold) = above THEN l_cost ELSE s_cost END), 6) AS cost FROM br JOIN lf USING (feature) JOIN pe USING (task_id) GROUP BY 1")(
    lambda s, d: _heuristic_frontier(s, d))


def _heuristic_frontier(s, d):
    g, f = cut(grid(s, d)), _long(s, d)
    best = frontier.best_rule(frontier.rules(f, frontier.thresholds(f, 8), task_values(g.where("split = 'val'"))), frontier.lam_grid(s, LAMS)).select("lam", "feature", "threshold", "above")
    x = f.join(F.broadcast(best), "feature").join(task_values(g.where("split = 'test'")), "task_id")
    large = (F.col("value") > F.col("threshold")) == F.col("above")
    return rounded(x.groupBy("lam").agg(*[F.avg(F.when(large, F.col(f"l_{v}")).otherwise(F.col(f"s_{v}"))).alias(n) for v, n in (("solved", "accuracy"), ("cost", "cost"))]))


_HEUR = _sel("chars>600", "(length(prompt) > 600)", "(SELECT g.*, prompt FROM g JOIN tk USING (task_id))")
query("pol_heuristic", f"WITH {G}, {_TASKS} " + _r(_COLS, _HEUR))(
    lambda s, d: rounded(replay._outcome(grid(s, d).join(task_rows(s, d).select("task_id", F.length("prompt").alias("n")), "task_id"), "chars>600", F.col("n") > 600, SMALL, LARGE)))
query("pol_probe_surcharge", "SELECT lam, task_id, arm, round(p_pass - lam * (e_cost + 3 * cheap), 6) AS utility FROM (SELECT *, min(e_cost) OVER (PARTITION BY task_id, lam) AS cheap FROM decisions)")(
    lambda s, d: rounded(load(s, d, "decisions").withColumn("cheap", F.min("e_cost").over(W.partitionBy("task_id", "lam"))).select("lam", "task_id", "arm", (F.col("p_pass") - F.col("lam") * (F.col("e_cost") + 3 * F.col("cheap"))).alias("utility"))))
query("topk_arm", "SELECT lam, task_id, arm FROM (SELECT lam, task_id, arm, row_number() OVER (PARTITION BY lam, task_id ORDER BY p_pass - lam * e_cost DESC, e_cost, arm DESC) AS k FROM decisions) WHERE k = 1")(
    lambda s, d: frontier.choose(load(s, d, "decisions").select("lam", "task_id", "arm", F.col("p_pass").alias("p"), F.col("e_cost").alias("cost"))))

# --- statistics ---------------------------------------------------------------------------------------------------------------

def _state_sql(tag: str, parts: str) -> list[str]:
    return [f"(('0x' || substr(md5('{tag}|' || {parts}), {i}, 8))::BIGINT % {stats.MODULUS})" for i in (1, 9)]


def _over(u: str, mean: float) -> str:
    return " + ".join(f"({u} >= {e!r}::DOUBLE)::INT" for e in stats.poisson_edges(mean))


_UNIT_SQL = f"((({{0}} * x + {{1}}) % {stats.MODULUS})::DOUBLE / {stats.MODULUS}::DOUBLE)"
_STATES = ", ".join(f"{e} AS {n}" for e, n in zip([*_state_sql("T", "task_id"), *_state_sql("S", "task_id || '|' || rep")], ("ta", "tc", "ra", "rc")))
# ww: every row of `pv`(task_id, rep, ...) with its weight n in every draw.
_WEIGHED = (
    f"dx AS (SELECT i AS draw, (i + 1) * 16807 % {stats.MODULUS} AS x FROM range({stats.DRAWS}) t(i)), ks AS (SELECT *, {_STATES} FROM pv), "
    f"uu AS (SELECT ks.* EXCLUDE (ta, tc, ra, rc), draw, {_UNIT_SQL.format('ta', 'tc')} AS u, {_UNIT_SQL.format('ra', 'rc')} AS v FROM ks, dx), "
    f"wt AS (SELECT * EXCLUDE (u), least({stats.MOST}, {_over('u', 1.0)}) AS w FROM uu WHERE u >= {stats.poisson_edges(1.0)[0]!r}::DOUBLE), "
    f"ww AS (SELECT *, CASE w {' '.join(f'WHEN {k} THEN {_over(chr(118), float(k))}' for k in range(1, stats.MOST + 1))} END AS n FROM wt)"
)
_PAIR_SQL = "pv AS (SELECT task_id, seed AS rep, s_solved AS a, l_solved AS b FROM g)"
_MEANS = f"{_PAIR_SQL}, {_WEIGHED}, mb AS (SELECT draw, sum(n * a) / nullif(sum(CASE WHEN a IS NOT NULL THEN n END), 0) AS a, sum(n * b) / nullif(sum(CASE WHEN b IS NOT NULL THEN n END), 0) AS b FROM ww GROUP BY 1)"
query("stat_cluster_boot", f"WITH {G}, {_MEANS} SELECT 's_solved' AS measure, (SELECT round(avg(a), 6) FROM pv) AS point, round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high FROM mb UNION ALL SELECT 'l_solved', (SELECT round(avg(b), 6) FROM pv), round(quantile_cont(b, 0.025), 6), round(quantile_cont(b, 0.975), 6) FROM mb")(
    lambda s, d: rounded(stats.bootstrap(cut(grid(s, d).withColumnRenamed("seed", "rep")), ["s_solved", "l_solved"])))
query("stat_paired_boot", f"WITH {G}, {_MEANS} SELECT (SELECT round(avg(b) - avg(a), 6) FROM pv) AS point, round(quantile_cont(b - a, 0.025), 6) AS low, round(quantile_cont(b - a, 0.975), 6) AS high FROM mb")(
    lambda s, d: rounded(stats.paired_bootstrap(cut(grid(s, d).withColumnRenamed("seed", "rep")), "l_solved", "s_solved")))
_INTERVAL = f"WITH {G}, {_MEANS}, iv AS (SELECT quantile_cont(b - a, 0.025) AS low, quantile_cont(b - a, 0.975) AS high FROM mb) SELECT "


def _difference(s, d):
    return stats.paired_bootstrap(cut(grid(s, d).withColumnRenamed("seed", "rep")), "l_solved", "s_solved")


query("stat_verdict", _INTERVAL + "CASE WHEN low >= 0.05 THEN 'PASS' WHEN high < 0.05 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM iv")(lambda s, d: _difference(s, d).select(frontier.verdict(F.col("low"), F.col("high"), 0.05).alias("verdict")))
query("ci_excludes_zero", _INTERVAL + "low > 0 OR high < 0 AS excludes_zero FROM iv")(lambda s, d: _difference(s, d).select(stats.excludes_zero(F.col("low"), F.col("high")).alias("excludes_zero")))
query("abl_degenerate", _INTERVAL + "round(high - low, 6) AS width, low = 0 AND high = 0 AS degenerate FROM iv")(lambda s, d: rounded(_difference(s, d).select((F.col("high") - F.col("low")).alias("width"), ((F.col("low") == 0) & (F.col("high") == 0)).alias("degenerate"))))
query("stat_mcnemar_counts", f"WITH {G} SELECT count(*) FILTER (WHERE l_solved = 1 AND s_solved = 0) AS b, count(*) FILTER (WHERE l_solved = 0 AND s_solved = 1) AS c FROM g")(lambda s, d: stats.discordant(grid(s, d), "l_solved", "s_solved"))
_LG = "lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)"
query("stat_mcnemar", f"WITH {G}, bc AS (SELECT count(*) FILTER (WHERE l_solved = 1 AND s_solved = 0) AS b, count(*) FILTER (WHERE l_solved = 0 AND s_solved = 1) AS c FROM g) SELECT b, c, round(b::DOUBLE / nullif(c, 0), 6) AS odds_ratio, (SELECT round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp({_LG}))) END, 6) FROM (SELECT b + c AS n, unnest(range(least(b, c) + 1)) AS k)) AS p_value FROM bc")(lambda s, d: rounded(stats.mcnemar(grid(s, d), "l_solved", "s_solved")))
_WON = f"({SOLVED})::INT"
query("eval_gate", f"WITH {C}, {_TASKS}, lb AS (SELECT task_id, max({_WON}) AS y FROM c WHERE hidden_total IS NOT NULL GROUP BY 1), {_LONG}, fr AS (SELECT feature, value AS v, y FROM lf JOIN lb USING (task_id)) SELECT feature, round(greatest(a, 1 - a), 6) AS auc, n FROM (SELECT feature, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS a, count(*) AS n FROM (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rk FROM fr) GROUP BY 1)")(
    lambda s, d: (lambda lb: rounded(stats.auc(_long(s, d).join(lb, "task_id"), "value", "y", ["feature"]).select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"), "n")))(cells(s, d, "hidden_passed", "hidden_total").where("hidden_total IS NOT NULL").groupBy("task_id").agg(F.max(solved()).cast("int").alias("y"))))


# The baselines against the cascade.
_AGAINST = "verifier_gated_cascade"
_POLICIES = ["always_small", "always_large", "random_route(0.5)", "best_of_3", "oracle_router"]
_WIDE = "pv AS (SELECT task_id, rep, " + ", ".join(f"max(solved) FILTER (WHERE policy = '{p}') AS p{i}" for i, p in enumerate([*_POLICIES, _AGAINST])) + " FROM o GROUP BY 1, 2)"
_MEAN_P = lambda i: f"sum(n * p{i}) / nullif(sum(CASE WHEN p{i} IS NOT NULL THEN n END), 0)"
_R = len(_POLICIES)
_BC = lambda i: f"SELECT '{_POLICIES[i]}' AS policy, (SELECT avg(p{i}) - avg(p{_R}) FROM pv) AS difference, quantile_cont(p{i} - p{_R}, 0.025) AS low, quantile_cont(p{i} - p{_R}, 0.975) AS high, (SELECT count(*) FROM pv WHERE p{i} = 1 AND p{_R} = 0) AS b, (SELECT count(*) FROM pv WHERE p{i} = 0 AND p{_R} = 1) AS c FROM mp"
_REPORT = (
    f"{_WIDE}, {_WEIGHED}, mp AS (SELECT draw, {', '.join(f'{_MEAN_P(i)} AS p{i}' for i in range(_R + 1))} FROM ww GROUP BY 1), df AS ({' UNION ALL '.join(map(_BC, range(_R)))}), "
    "pq AS (SELECT *, (SELECT CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))) END FROM (SELECT b + c AS n, unnest(range(least(b, c) + 1)) AS k)) AS p_value FROM df), "
    "bh AS (SELECT *, least(1.0, min(q) OVER (ORDER BY rk DESC)) AS adjusted FROM (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, policy) AS q, row_number() OVER (ORDER BY p_value, policy) AS rk FROM pq))"
)


@query("stat_report", f"WITH {OUT}, {_REPORT} " + _r("policy ~accuracy ~cost ~latency_mean ~latency_p95 n ~difference ~low ~high ~p_value ~adjusted", f"SELECT s.*, difference, low, high, p_value, adjusted FROM ({_SUM}) s LEFT JOIN bh USING (policy)"))
def stat_report(s, d):
    """Per policy: its summary and, against the cascade, the clustered interval of its accuracy's difference, the exact test over tasks
    and replicates that both have, and its adjusted p. All policies share one set of draws; best_of_3 has one outcome a task."""
    o = cut(outcomes(s, d))
    names = {p: f"p{i}" for i, p in enumerate([*_POLICIES, _AGAINST])}
    v = cut(o.groupBy("task_id", "rep").agg(*[F.max(F.when(F.col("policy") == p, F.col("solved"))).alias(c) for p, c in names.items()]))
    sums, means = stats._mean_sums(list(names.values()))
    ref = names[_AGAINST]
    ci = stats.bootstrap_of(v, sums, {p: means[names[p]] - means[ref] for p in _POLICIES}).withColumnsRenamed({"measure": "policy", "point": "difference"})
    pairs = v.agg(*[F.count_if((F.col(names[p]) == a) & (F.col(ref) == 1 - a)).alias(f"{names[p]}_{a}") for p in _POLICIES for a in (1, 0)]).first()
    tests = s.createDataFrame([(p, stats.mcnemar_p(pairs[f"{names[p]}_1"], pairs[f"{names[p]}_0"])) for p in _POLICIES], "policy string, p_value double")
    return rounded(replay.summary(o).join(F.broadcast(ci.join(stats.benjamini_hochberg(tests, "p_value"), "policy")), "policy", "left"))


query("stat_boot_power")(lambda s, d: reduce(DataFrame.unionByName, [stats.simulated_power(s, n, 3, 0.5, 0.1, 0.3, 200) for n in (50, 200, 800)]))


# --- costs and ladders --------------------------------------------------------------------------------------------------------

_RES = "rs AS (SELECT model_id, arg_min(struct_pack(i := intercept_s, a := prefill_s_per_token, b := decode_s_per_token), CASE WHEN batch = 1 THEN -1 ELSE batch END) AS f FROM cost_coefficients GROUP BY 1)"
_IMP = f"im AS (SELECT r.*, CASE WHEN f IS NOT NULL THEN greatest(0.0, prefill_tokens * f.a + decode_tokens * f.b) END AS imputed_gpu_s, f.i + prefill_tokens * f.a + decode_tokens * f.b AS imputed_s FROM r LEFT JOIN rs USING (model_id))"
_PRICED = ["model_id", "prefill_tokens", "decode_tokens"]


def _imputed(s, d):
    return cost.impute(rollouts(s, d, *_PRICED), load(s, d, "cost_coefficients"))


query("cost_impute", f"WITH {R}, {_RES}, {_IMP} SELECT rollout_id, model_id, round(imputed_gpu_s, 6) AS imputed_gpu_s, round(imputed_s, 6) AS imputed_s, round(imputed_gpu_s / 3600.0, 9) AS imputed_usd FROM im")(
    lambda s, d: _imputed(s, d).select("rollout_id", "model_id", F.round("imputed_gpu_s", 6).alias("imputed_gpu_s"), F.round("imputed_s", 6).alias("imputed_s"), F.round("imputed_usd", 9).alias("imputed_usd")))
query("cost_gpu_seconds", f"WITH {R}, {_RES} SELECT rollout_id, round(greatest(0.0, prefill_tokens * f.a + decode_tokens * f.b), 6) AS gpu_s FROM r JOIN rs USING (model_id) WHERE prefill_tokens IS NOT NULL AND decode_tokens IS NOT NULL")(
    lambda s, d: rounded(_imputed(s, d).where("imputed_gpu_s IS NOT NULL AND prefill_tokens IS NOT NULL AND decode_tokens IS NOT NULL").select("rollout_id", F.col("imputed_gpu_s").alias("gpu_s"))))
query("cost_latency", f"WITH {R}, {_RES} SELECT rollout_id, round(f.i + prefill_tokens * f.a + decode_tokens * f.b, 6) AS latency_s FROM r LEFT JOIN rs USING (model_id)")(lambda s, d: rounded(_imputed(s, d).select("rollout_id", F.col("imputed_s").alias("latency_s"))))
query("cost_usd", f"WITH {R}, {_RES}, {_IMP} SELECT arm, round(sum(imputed_gpu_s) * 2.5 / 3600.0, 6) AS usd, count(imputed_gpu_s) AS priced FROM im GROUP BY 1")(
    lambda s, d: rounded(cost.impute(rollouts(s, d, "arm", *_PRICED), load(s, d, "cost_coefficients")).groupBy("arm").agg((F.sum("imputed_gpu_s") * 2.5 / 3600).alias("usd"), F.count("imputed_gpu_s").alias("priced"))))
query("join_coeff", f"WITH {R}, {_RES} SELECT rollout_id, model_id, round(f.i, 9) AS intercept_s, round(f.a, 9) AS prefill_s_per_token, round(f.b, 9) AS decode_s_per_token FROM r LEFT JOIN rs USING (model_id)")(
    lambda s, d: rounded(rollouts(s, d, "model_id").join(F.broadcast(cost.resolve(load(s, d, "cost_coefficients"))), "model_id", "left").select("rollout_id", "model_id", "intercept_s", "prefill_s_per_token", "decode_s_per_token"), 9))
query("agg_impute_report", f"WITH {R}, {_RES}, {_IMP} SELECT count(*) AS rows, count(imputed_gpu_s) AS imputed, count(*) - count(imputed_gpu_s) AS unpriced, round(count(imputed_gpu_s)::DOUBLE / count(*), 6) AS coverage, round(sum(imputed_gpu_s), 4) AS gpu_s, round(sum(imputed_gpu_s) / 3600.0, 4) AS usd, coalesce(string_agg(DISTINCT CASE WHEN imputed_gpu_s IS NULL THEN coalesce(model_id, '?') END, ',' ORDER BY CASE WHEN imputed_gpu_s IS NULL THEN coalesce(model_id, '?') END), '') AS unpriced_models FROM im")(
    lambda s, d: cost.report(cost.impute(rollouts(s, d, *_PRICED), load(s, d, "cost_coefficients"))).withColumns({"coverage": F.round("coverage", 6), "gpu_s": F.round("gpu_s", 4), "usd": F.round("usd", 4)}))
_VI = "vi AS (SELECT model_id, wall_ms / 1000 AS m, imputed_s AS p FROM im WHERE mode = 'serving' AND tokens_exact AND wall_ms > 0 AND imputed_s IS NOT NULL)"
for _n in ("agg_validate_imputation",):
    query(_n, f"WITH {R}, {_RES}, {_IMP}, {_VI} SELECT model_id, round(CASE WHEN tot > 0 THEN 1 - res / tot ELSE 0.0 END, 6) AS r2, round(sqrt(res / n), 6) AS rmse, n, round(mm, 6) AS mean_measured_s, round(mp, 6) AS mean_imputed_s, CASE WHEN tot > 0 THEN 1 - res / tot ELSE 0.0 END > 0.9 AS passed FROM (SELECT model_id, sum(pow(m - p, 2)) AS res, sum(pow(m - mm, 2)) AS tot, count(*) AS n, any_value(mm) AS mm, avg(p) AS mp FROM (SELECT *, avg(m) OVER (PARTITION BY model_id) AS mm FROM vi) GROUP BY 1)")(
        lambda s, d: rounded(cost.validate(rollouts(s, d, *_PRICED, "mode", "tokens_exact", "wall_ms"), load(s, d, "cost_coefficients"))))
query("agg_r2_rmse", f"WITH {C}, {_SCORED} SELECT round(CASE WHEN tot > 0 THEN 1 - res / tot ELSE 0.0 END, 6) AS r2, round(sqrt(res / n), 6) AS rmse, n FROM (SELECT sum(pow(y - p, 2)) AS res, sum(pow(y - m, 2)) AS tot, count(*) AS n FROM (SELECT p, y, avg(y) OVER () AS m FROM sc WHERE p IS NOT NULL AND y IS NOT NULL))")(lambda s, d: rounded(stats.r2_rmse(scored(s, d), "y", "p")))
# Least squares of two variables about their means, every fourth row held out.
_OLS = (
    f"{_OBS}, hd AS (SELECT *, (row_number() OVER (PARTITION BY model_id, batch ORDER BY rollout_id)) % 4 = 0 AND count(*) OVER (PARTITION BY model_id, batch) >= 24 AS held FROM ob),"
    " mu AS (SELECT model_id, batch, count(*) AS n, avg(prefill_tokens) AS ma, avg(decode_tokens) AS mb, avg(seconds) AS my FROM hd WHERE NOT held GROUP BY 1, 2),"
    " cv AS (SELECT model_id, batch, any_value(n) AS n, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my, sum((prefill_tokens - ma) * (prefill_tokens - ma)) AS aa, sum((decode_tokens - mb) * (decode_tokens - mb)) AS bb, sum((prefill_tokens - ma) * (decode_tokens - mb)) AS ab, sum((prefill_tokens - ma) * (seconds - my)) AS ay, sum((decode_tokens - mb) * (seconds - my)) AS yb FROM hd JOIN mu USING (model_id, batch) WHERE NOT held GROUP BY 1, 2),"
    " be AS (SELECT *, my - a * ma - b * mb AS i FROM (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS a, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b FROM cv WHERE n >= 12 AND aa * bb - ab * ab > 1e-9 * aa * bb)),"
    " rs AS (SELECT model_id, batch, held, seconds, i + a * prefill_tokens + b * decode_tokens AS yhat FROM hd JOIN be USING (model_id, batch)),"
    " ev AS (SELECT model_id, batch, held, count(*) AS n, sum(pow(seconds - yhat, 2)) AS res, sum(pow(seconds - m, 2)) AS tot FROM (SELECT *, avg(seconds) OVER (PARTITION BY model_id, batch, held) AS m FROM rs) GROUP BY 1, 2, 3)"
)
query("ml_ols_cost", f"WITH {R}, {_OLS} SELECT be.model_id, be.batch, round(i, 6) AS intercept_s, round(a, 6) AS prefill_s_per_token, round(b, 6) AS decode_s_per_token, o.n, round(CASE WHEN o.tot > 0 THEN 1 - o.res / o.tot ELSE 0.0 END, 6) AS r2, round(sqrt(o.res / o.n), 6) AS rmse_s, round(CASE WHEN h.tot > 0 THEN 1 - h.res / h.tot WHEN h.tot IS NOT NULL THEN 0.0 END, 6) AS holdout_r2, coalesce(h.n, 0) AS holdout_n FROM be JOIN ev o ON o.model_id = be.model_id AND o.batch = be.batch AND NOT o.held LEFT JOIN ev h ON h.model_id = be.model_id AND h.batch = be.batch AND h.held")(lambda s, d: rounded(cost.fit(observations(s, d), ["rollout_id"])))
_SIDE = f"sd AS (SELECT {sql_id('rollout_id')} AS rollout_id, min({sql_amount('gpu_seconds')}) AS g, min({sql_amount('imputed_latency_s')}) AS l, min({sql_amount('usd')}) AS usd FROM cost_sidecar GROUP BY 1)"
query("join_cost", f"WITH {R}, {_SIDE} SELECT r.rollout_id, round(coalesce(g, gpu_seconds), 6) AS gpu_seconds, round(coalesce(l, imputed_latency_s), 6) AS imputed_latency_s, round(usd, 9) AS usd FROM r LEFT JOIN sd USING (rollout_id)")(
    lambda s, d: cost.join_costing(rollouts(s, d, "gpu_seconds", "imputed_latency_s"), load(s, d, "cost_sidecar").select(norm_id("rollout_id").alias("rollout_id"), *[amount(c).alias(c) for c in ("gpu_seconds", "imputed_latency_s", "usd")])).select("rollout_id", F.round("gpu_seconds", 6).alias("gpu_seconds"), F.round("imputed_latency_s", 6).alias("imputed_latency_s"), F.round("usd", 9).alias("usd")))
query("source_cost_sidecar", f"WITH {_SIDE} SELECT rollout_id, round(g, 6) AS gpu_seconds, round(l, 6) AS imputed_latency_s FROM sd")(
    lambda s, d: rounded(load(s, d, "cost_sidecar").groupBy(norm_id("rollout_id").alias("rollout_id")).agg(F.min(amount("gpu_seconds")).alias("gpu_seconds"), F.min(amount("imputed_latency_s")).alias("imputed_latency_s"))))


def _chain(s: SparkSession, d: str) -> DataFrame:
    return ladder.chains(cut(rollouts(s, d, "parent_rollout_id", "task_id", "seed", "arm", "hidden_passed", "hidden_total", "gpu_seconds")))


from tidemark.plans.problem_queries import _WALK  # noqa: E402

_CHAIN = f"{_WALK}, {R.replace('r0 AS', 'q0 AS').replace('FROM r0', 'FROM q0')}, st AS (SELECT node, at_root, depth FROM (SELECT node, cur AS at_root, CASE WHEN closed THEN -1 ELSE d END AS depth FROM ends)), ch AS (SELECT r.*, coalesce(st.at_root, r.rollout_id) AS root, coalesce(st.depth, 0) AS step FROM r LEFT JOIN st ON st.node = r.rollout_id WHERE coalesce(st.depth, 0) >= 0)"
query("join_parent", f"{_CHAIN} SELECT rollout_id, root, step FROM ch")(lambda s, d: _chain(s, d).select("rollout_id", "root", "step"))
query("win_ladder_cum", f"{_CHAIN} SELECT rollout_id, root, step, round(sum(gpu_seconds) OVER (PARTITION BY root ORDER BY step), 6) AS so_far FROM ch")(
    lambda s, d: rounded(ladder.cumulative(_chain(s, d), "gpu_seconds").select("rollout_id", "root", "step", F.col("gpu_seconds_so_far").alias("so_far"))))
query("win_ladder_upto", f"{_CHAIN} SELECT rollout_id, root, step FROM ch WHERE step <= 1")(lambda s, d: ladder.upto(_chain(s, d), 1).select("rollout_id", "root", "step"))
_GATE = f"""{_CHAIN}, {C.partition(', c AS')[1][2:]}{C.partition(', c AS')[2]},
ca AS (SELECT task_id, seed, arm, rollout_id, {SOLVED} AS solved, gpu_seconds AS cost FROM c WHERE hidden_total IS NOT NULL AND gpu_seconds IS NOT NULL),
rp AS (SELECT root AS rollout_id, arg_min({SOLVED}, delivery_id) AS rs, arg_min(gpu_seconds, delivery_id) AS rc FROM ch WHERE step = 1 AND hidden_total IS NOT NULL AND gpu_seconds IS NOT NULL GROUP BY 1),
x AS (SELECT s.solved AS ss, s.cost AS sc, l.solved AS ls, l.cost AS lc, rs, rc, s.solved >= 1 AS won FROM ca s JOIN ca l USING (task_id, seed) LEFT JOIN rp ON rp.rollout_id = s.rollout_id WHERE s.arm = 'small' AND l.arm = 'large'),
sg AS (SELECT 'always_small' AS strategy, avg(ss) AS accuracy, avg(sc) AS cost, count(*) AS n, count(*) FILTER (WHERE NOT won AND rs IS NOT NULL) AS repairs FROM x
UNION ALL SELECT 'repair_on_failure', avg(CASE WHEN won THEN 1.0 ELSE coalesce(rs, 0.0) END), avg(sc + CASE WHEN won THEN 0.0 ELSE coalesce(rc, 0.0) END), count(*), count(*) FILTER (WHERE NOT won AND rs IS NOT NULL) FROM x
UNION ALL SELECT 'escalate_on_failure', avg(CASE WHEN won THEN 1.0 ELSE ls END), avg(sc + CASE WHEN won THEN 0.0 ELSE lc END), count(*), count(*) FILTER (WHERE NOT won AND rs IS NOT NULL) FROM x)"""


def _strategies(s, d):
    c = cells(s, d, "hidden_passed", "hidden_total", "gpu_seconds").select("task_id", "seed", "arm", "rollout_id", solved().alias("solved"), F.col("gpu_seconds").alias("cost"))
    ch = _chain(s, d).select("root", "step", "delivery_id", solved().alias("solved"), F.col("gpu_seconds").alias("cost"))
    return ladder.repair_gate(c, ch, SMALL, LARGE)


query("agg_strategy", f"{_GATE} SELECT strategy, round(accuracy, 6) AS accuracy, round(cost, 6) AS cost, n, repairs FROM sg")(lambda s, d: rounded(_strategies(s, d)))
query("ladder_repair_gate", f"{_GATE}, {_LAM}, o AS (SELECT max(accuracy) FILTER (WHERE strategy = 'repair_on_failure') AS ra, max(cost) FILTER (WHERE strategy = 'repair_on_failure') AS rc, max(accuracy) FILTER (WHERE strategy = 'escalate_on_failure') AS ea, max(cost) FILTER (WHERE strategy = 'escalate_on_failure') AS ec, max(repairs) AS repairs FROM sg), w AS (SELECT count(*) FILTER (WHERE ra - lam * rc > ea - lam * ec) AS wins, count(*) AS lams, max(repairs) AS repairs FROM o, lams) SELECT *, CASE WHEN repairs = 0 THEN 'NO REPAIRS' WHEN wins > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM w")(
    lambda s, d: ladder.gate_verdict(_strategies(s, d), frontier.lam_grid(s, LAMS)))

# --- models -------------------------------------------------------------------------------------------------------------------

_FEATURES = ["d1_visible_pass_rate", "d1_code_chars", "d1_code_lines", "d1_decode_tokens", "d1_prefill_tokens", "d1_finish_length"]


def labelled(s: SparkSession, d: str) -> DataFrame:
    """Features of each graded first attempt of small, with its split and label apart by name."""
    x = cells(s, d, "split", "hidden_passed", "hidden_total", "visible_passed", "visible_total", "code", "decode_tokens", "prefill_tokens", "finish_reason", "gpu_seconds").where((F.col("arm") == SMALL) & F.col("hidden_total").isNotNull() & F.col("split").isNotNull())
    y = x.select("rollout_id", "task_id", "split", solved().cast("int").alias("y"))
    return cut(features.build(x.drop("hidden_passed", "hidden_total"), _FEATURES, ["rollout_id"]).join(y, "rollout_id"))


query("ml_standardize", f"WITH {C}, x AS (SELECT coalesce(decode_tokens, 0)::DOUBLE AS v, split FROM c WHERE arm = 'small' AND hidden_total IS NOT NULL AND split IS NOT NULL), t AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM x WHERE split = 'train') SELECT split, count(*) AS n, round(avg((v - m) / s), 6) AS mean, round(stddev_pop((v - m) / s), 6) AS deviation FROM x, t GROUP BY 1")(
    lambda s, d: (lambda x: rounded(models.standardize(x, models.standardizer(x, ["d1_decode_tokens"])).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("d1_decode_tokens").alias("mean"), F.stddev_pop("d1_decode_tokens").alias("deviation"))))(labelled(s, d)))
query("ml_logreg")(lambda s, d: (lambda x: s.createDataFrame([(k, round(v, 6)) for k, v in (models.logistic(models.standardize(x, models.standardizer(x, _FEATURES)).where("split = 'train'"), _FEATURES, "y") or {}).items()], "feature string, weight double"))(labelled(s, d)))
_RIDGE = f"WITH {C}, x AS (SELECT coalesce(prefill_tokens, 0)::DOUBLE AS v, coalesce(decode_tokens, 0)::DOUBLE AS y FROM c WHERE arm = 'small' AND hidden_total IS NOT NULL AND split IS NOT NULL), t AS (SELECT avg(v) AS mv, avg(y) AS my FROM x) SELECT round(my - w * mv, 4) AS intercept, round(w, 6) AS weight FROM (SELECT any_value(mv) AS mv, any_value(my) AS my, sum((v - mv) * (y - my)) / (sum(pow(v - mv, 2)) + 1.0) AS w FROM x, t)"
query("ml_ridge", _RIDGE)(lambda s, d: (lambda c: s.createDataFrame([(round(c["intercept"], 4), round(c["d1_prefill_tokens"], 6))], "intercept double, weight double"))(models.ridge(labelled(s, d), ["d1_prefill_tokens"], "d1_decode_tokens")[()]))
# The best non-decreasing fit at place i is the greatest, over the places up to it, of the least mean of a stretch from there past i.
_ISO = (
    "pr AS (SELECT *, row_number() OVER (ORDER BY p) AS i FROM (SELECT round(p, 12) AS p, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n FROM sc WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY 1)), cs AS (SELECT *, sum(s) OVER (ORDER BY i) AS us, sum(n) OVER (ORDER BY i) AS un FROM pr),"
    " st AS (SELECT a.i AS j, b.i AS k, (b.us - a.us + a.s) / (b.un - a.un + a.n) AS m FROM cs a JOIN cs b ON b.i >= a.i), ms AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM st), ft AS (SELECT k AS i, max(m) AS fit FROM ms GROUP BY 1),"
    " po AS (SELECT fit, min(p) AS lo, max(p) AS hi FROM ft JOIN pr USING (i) GROUP BY 1), kn AS (SELECT DISTINCT x, fit AS observed FROM (SELECT lo AS x, fit FROM po UNION ALL SELECT hi, fit FROM po))"
)
query("ml_isotonic", f"WITH {C}, {_SCORED}, {_ISO} SELECT (row_number() OVER (ORDER BY x) - 1)::INT AS knot, round(x, 6) AS p, round(observed, 6) AS observed FROM kn")(lambda s, d: s.createDataFrame([(i, round(x, 6), round(y, 6)) for i, (x, y) in enumerate(models.isotonic(scored(s, d), "p", "y"))], "knot int, p double, observed double"))
_SCORED_T = _SCORED.replace("SELECT d.p_pass AS p, c.y", "SELECT c.task_id, d.p_pass AS p, c.y")
# The same fit for each fold on the rows of the other folds; a fold whose rest has one class keeps p.
_CROSS = (
    "fd AS (SELECT task_id, (row_number() OVER (ORDER BY md5('F|0|' || task_id), task_id) - 1) % 5 AS fold FROM (SELECT DISTINCT task_id FROM sc)), sf AS (SELECT sc.*, fold FROM sc JOIN fd USING (task_id)),"
    " tr AS (SELECT f.i AS f, p, y FROM sf, range(5) f(i) WHERE fold <> f.i), ok AS (SELECT f FROM tr GROUP BY 1 HAVING min(y) < max(y)),"
    " pr AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p) AS i FROM (SELECT f, round(p, 12) AS p, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n FROM tr WHERE p IS NOT NULL AND y IS NOT NULL AND f IN (SELECT f FROM ok) GROUP BY 1, 2)), cs AS (SELECT *, sum(s) OVER (PARTITION BY f ORDER BY i) AS us, sum(n) OVER (PARTITION BY f ORDER BY i) AS un FROM pr),"
    " st AS (SELECT a.f, a.i AS j, b.i AS k, (b.us - a.us + a.s) / (b.un - a.un + a.n) AS m FROM cs a JOIN cs b ON a.f = b.f AND b.i >= a.i), ms AS (SELECT f, j, k, min(m) OVER (PARTITION BY f, j ORDER BY k DESC) AS m FROM st), ft AS (SELECT f, k AS i, max(m) AS fit FROM ms GROUP BY 1, 2),"
    " po AS (SELECT f, fit, min(p) AS lo, max(p) AS hi FROM ft JOIN pr USING (f, i) GROUP BY 1, 2), kn AS (SELECT DISTINCT f, x, fit AS observed FROM (SELECT f, lo AS x, fit FROM po UNION ALL SELECT f, hi, fit FROM po)),"
    " kl AS (SELECT f, x, observed, lead(x) OVER w AS x2, lead(observed) OVER w AS o2 FROM kn WINDOW w AS (PARTITION BY f ORDER BY x)), k0 AS (SELECT f, arg_min(observed, x) AS lowest FROM kn GROUP BY 1),"
    " cx AS (SELECT sf.y, sf.p, CASE WHEN lowest IS NULL THEN sf.p ELSE least(1.0, greatest(0.0, CASE WHEN sf.p IS NULL THEN NULL WHEN x IS NULL THEN lowest WHEN x2 IS NULL THEN observed ELSE observed + (sf.p - x) * (o2 - observed) / (x2 - x) END)) END AS q FROM sf LEFT JOIN k0 ON k0.f = sf.fold ASOF LEFT JOIN kl ON kl.f = sf.fold AND sf.p >= kl.x)"
)
_ERR = lambda v, src: f"(SELECT n, abs(a) AS gap FROM (SELECT {_BIN.replace('(p >=', f'({v} >=')} AS bin, count(*) AS n, avg({v}) - avg(y) AS a FROM {src} WHERE {v} IS NOT NULL GROUP BY 1))"
query("ml_crossfit", f"WITH {C}, {_SCORED_T}, {_CROSS} SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM {_ERR('q', 'cx')}")(lambda s, d: rounded(stats.calibration(stats.reliability(models.crossfit(cut(scored(s, d)), "p", "y", "task_id"), "p_cross", "y"))))
query("ml_calibrate_apply", f"WITH {C}, {_SCORED_T}, {_ISO}, kl AS (SELECT x, observed, lead(x) OVER (ORDER BY x) AS x2, lead(observed) OVER (ORDER BY x) AS o2 FROM kn) SELECT task_id, round(p, 6) AS p, round(least(1.0, greatest(0.0, CASE WHEN p IS NULL THEN NULL WHEN x IS NULL THEN (SELECT arg_min(observed, x) FROM kn) WHEN x2 IS NULL THEN observed ELSE observed + (p - x) * (o2 - observed) / (x2 - x) END)), 6) AS calibrated FROM sc ASOF LEFT JOIN kl ON sc.p >= kl.x")(lambda s, d: (lambda x: rounded(x.select("task_id", "p", models.calibrated(F.col("p"), models.isotonic(x, "p", "y")).alias("calibrated"))))(cut(scored(s, d))))
_ISO2 = _ISO.replace("pr AS", "zr AS").replace("JOIN pr ", "JOIN zr ").replace("FROM pr)", "FROM zr)").replace("cs AS", "zs AS").replace("FROM cs a JOIN cs b", "FROM zs a JOIN zs b").replace("st AS", "zt AS").replace("FROM st)", "FROM zt)").replace("ms AS", "zm AS").replace("FROM ms ", "FROM zm ").replace("ft AS", "zf AS").replace("FROM ft ", "FROM zf ").replace("po AS", "zo AS").replace("FROM po", "FROM zo").replace("kn AS", "zk AS")
query("ml_calibrate_select", f"WITH {C}, {_SCORED_T}, {_CROSS}, {_ISO2}, ec AS (SELECT (SELECT sum(n * gap) / sum(n) FROM {_ERR('p', 'sc')}) AS raw, (SELECT sum(n * gap) / sum(n) FROM {_ERR('q', 'cx')}) AS crossed) SELECT round(raw, 6) AS raw_ece, round(crossed, 6) AS cross_ece, crossed < raw AS kept, CASE WHEN crossed < raw THEN (SELECT count(*) FROM zk) ELSE 0 END::INT AS knots FROM ec")(lambda s, d: (lambda r: s.createDataFrame([(round(r["raw_ece"], 6), round(r["cross_ece"], 6), r["kept"], len(r["knots"]))], "raw_ece double, cross_ece double, kept boolean, knots int"))(models.calibrate(cut(scored(s, d)), "p", "y", "task_id")))
query("ml_gate")(lambda s, d: rounded(models.gate(labelled(s, d), _FEATURES, "y")))


def _ablation(s, d):
    return models.ablations(labelled(s, d), _FEATURES, "y")


query("ml_ablation")(lambda s, d: rounded(_ablation(s, d)))
query("topk_impact")(lambda s, d: rounded(_ablation(s, d).where("variant = 'without'").orderBy("delta", "group").limit(3).select("group", "delta")))
query("abl_carries")(lambda s, d: _ablation(s, d).where("variant = 'without'").select("group", "carries"))
_D0 = [c for c in features.names("D0", "d0_")]


def _arms(s, d):
    """The coefficients of each arm: those of the model that most of its rollouts were made by."""
    r = rollouts(s, d, "arm", "model_id").where("arm IS NOT NULL AND model_id IS NOT NULL").groupBy("arm", "model_id").agg(F.count(F.lit(1)).alias("n"))
    of = r.groupBy("arm").agg(F.max_by("model_id", F.struct("n", "model_id")).alias("model_id"))
    return of.join(cost.resolve(load(s, d, "cost_coefficients")), "model_id").select("arm", "intercept_s", "prefill_s_per_token", "decode_s_per_token")


def _headed(s, d):
    """(features of all tasks, heads of all arms) over all registered prompt features."""
    f = cut(features.build(task_rows(s, d), _D0, ["task_id"]))
    x = cells(s, d, "split", "hidden_passed", "hidden_total", "decode_tokens", "prefill_tokens").where("hidden_total IS NOT NULL AND split IN ('train', 'val') AND arm IS NOT NULL")
    return f, models.fit_heads(cut(x.select("task_id", "arm", "split", "decode_tokens", "prefill_tokens", solved().cast("int").alias("y")).join(f, "task_id")), _D0)


@query("ml_fit_heads")
def ml_fit_heads(s, d):
    """Every weight of every head of every arm, and how many knots calibrate its success head."""
    _, h = _headed(s, d)
    rows = [(arm, head, k, round(v, 6)) for head in ("pass", "decode", "prefill") for arm, w in h[head].items() for k, v in w.items()] + [(arm, "knots", "count", float(len(k))) for arm, k in h["knots"].items()]
    return s.createDataFrame(rows, "arm string, head string, feature string, weight double")


@query("ml_score_cost")
def ml_score_cost(s, d):
    """For each task and arm the predicted success, tokens, cost and latency, from prompt features only."""
    f, h = _headed(s, d)
    return rounded(models.scores(f, h, _arms(s, d)), 4)


@query("pol_learned_d0")
def pol_learned_d0(s, d):
    """The arm of greatest predicted utility for each task and weight, from prompt features only."""
    f, h = _headed(s, d)
    x = cut(models.scores(f, h, _arms(s, d)).where(F.col("arm").isin(SMALL, LARGE)).select("task_id", "arm", F.col("p_pass").alias("p"), F.col("e_cost").alias("cost")))
    return frontier.choose(x.crossJoin(F.broadcast(frontier.lam_grid(s, LAMS))))


_LAB = f"lb AS (SELECT task_id, CASE WHEN visible_total > 0 THEN coalesce(visible_passed, 0)::DOUBLE / visible_total ELSE 0.0 END AS v, ({SOLVED})::INT AS y FROM c WHERE arm = 'small' AND hidden_total IS NOT NULL AND split IS NOT NULL)"
_AUCS = (
    f"dx AS (SELECT i AS draw, (i + 1) * 16807 % {stats.MODULUS} AS x FROM range({stats.DRAWS}) t(i)), ks AS (SELECT task_id, v, sum(y) AS p, sum(1 - y) AS n, {', '.join(f'any_value({e}) AS {n}' for e, n in zip(_state_sql('T', 'task_id'), ('ta', 'tc')))} FROM lb GROUP BY 1, 2), "
    f"uu AS (SELECT v, p, n, draw, {_UNIT_SQL.format('ta', 'tc')} AS u FROM ks, dx), sc AS (SELECT draw, v, sum(p * w) AS p, sum(n * w) AS n FROM (SELECT *, least({stats.MOST}, {_over('u', 1.0)}) AS w FROM uu) GROUP BY 1, 2), "
    "ac AS (SELECT draw, sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY draw ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc) GROUP BY 1)"
)


@query("stat_boot_auc", f"WITH {C}, {_LAB}, {_AUCS} SELECT round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.5), 6) AS middle, round(quantile_cont(auc, 0.975), 6) AS high FROM ac")
def stat_boot_auc(s, d):
    """A percentile interval of the AUC of the visible pass rate over draws of tasks."""
    x = labelled(s, d).select("task_id", F.lit("visible").alias("f"), F.col("d1_visible_pass_rate").alias("v"), "y")
    return rounded(stats.bootstrap_auc(x).agg(*[F.percentile("auc", q).alias(n) for q, n in ((0.025, "low"), (0.5, "middle"), (0.975, "high"))]))


@query("stat_boot_delta_auc")
def stat_boot_delta_auc(s, d):
    """Simultaneous intervals, by Bonferroni, of each feature's AUC less that of the pass rate, on the same draws of tasks."""
    rest = [c for c in _FEATURES if c != "d1_visible_pass_rate"]
    x = labelled(s, d)
    long = x.select("task_id", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in _FEATURES])).alias("x")).select("task_id", "y", "x.*")
    a = stats.bootstrap_auc(long).groupBy("draw").pivot("f", _FEATURES).agg(F.first("auc"))
    q = 0.05 / 2 / len(rest)
    return rounded(a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) - F.col("d1_visible_pass_rate")).alias("x")) for c in rest])).alias("e")).select("e.*").groupBy("feature").agg(F.percentile("x", q).alias("low"), F.percentile("x", 1 - q).alias("high")))
