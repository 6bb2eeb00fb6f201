"""Scan, validation, join, set, feature, sweep and grading queries over the logged rollouts, with their SQL."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.normalize import norm_id, norm_split
from tidemark.operators import audit, code, corpus, cost, features, sweep, validate
from tidemark.operators.ordered import before
from tidemark.plans.replay_queries import _HSQL, _LONG, _TASKS, _long, rounded, task_rows
from tidemark.plans.tables import C, G, R, SOLVED, VISIBLE, cells, grid, rollouts, solved, sql_id, sql_split, visible_frac
from tidemark.session import cut, load, shared_dir
from tidemark.sources import store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- scans and sources --------------------------------------------------------------------------------------------------------

DECISION = T.StructType().add("run_id", "string").add("policy_name", "string").add("decision_point", "string").add("lam", "double").add("task_id", "string").add("arm", "string").add("p_pass", "double").add("e_cost", "double").add("e_latency", "double").add("probe_cost", "double").add("utility", "double").add("chosen", "boolean")


def _written(s: SparkSession, d: str) -> str:
    """The decisions as JSON parts in the shared folder."""
    at = f"{shared_dir(s)}/decisions-{uuid.uuid4().hex}"
    load(s, d, "decisions").select(*DECISION.names).write.json(at)
    return at


_DEC = ", ".join(DECISION.names)
query("scan_jsonl_parts", f"SELECT {_DEC} FROM decisions")(lambda s, d: store.read_json(s, _written(s, d), DECISION))


@query("scan_torn_tail", "SELECT count(*) AS rows, 0::BIGINT AS damaged FROM decisions")
def scan_torn_tail(s, d):
    """The same parts and one more whose last line was torn: the torn line is left out, nothing else is."""
    at = _written(s, d)
    store.write_text(s, f"{at}/part-torn.json", '{"run_id": "torn", "policy_na')
    return store.read_json(s, at, DECISION).agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(store.damaged(s, at, DECISION).agg(F.count(F.lit(1)).alias("damaged"))))


query("scan_parity", "SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b")(lambda s, d: store.parity(store.read_json(s, _written(s, d), DECISION), load(s, d, "decisions").select(*DECISION.names)))
query("scan_parquet", "SELECT delivery_id, rollout_id, run_id, seed, wall_ms, finish_reason, created_at FROM generations WHERE decode_tokens >= 40")(lambda s, d: load(s, d, "generations").where("decode_tokens >= 40").select("delivery_id", "rollout_id", "run_id", "seed", "wall_ms", "finish_reason", "created_at"))
for _n in ("json_extra",):
    query(_n, "SELECT delivery_id, CASE WHEN json_valid(extra) THEN json_extract_string(extra, '$.node') END AS node, CASE WHEN json_valid(extra) THEN TRY_CAST(json_extract_string(extra, '$.attempt') AS INT) END AS attempt, extra IS NOT NULL AND NOT json_valid(extra) AS unparsed FROM generations")(
        lambda s, d: load(s, d, "generations").select("delivery_id", F.get_json_object("extra", "$.node").alias("node"), F.get_json_object("extra", "$.attempt").try_cast("int").alias("attempt"), F.coalesce(F.col("extra").isNotNull() & F.try_parse_json("extra").isNull(), F.lit(False)).alias("unparsed")))
query("source_corpus", f"SELECT {sql_id('task_id')} AS task_id, count(*) AS n, max(CASE WHEN trim(coalesce(prompt, '')) = '' THEN 'no prompt' END) AS error FROM tasks GROUP BY 1")(
    lambda s, d: corpus.read_tasks(load(s, d, "tasks").withColumn("task_id", norm_id("task_id"))).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("error")))
query("source_corpus_plain", f"SELECT {sql_id('task_id')} AS task_id, dataset, length(prompt) AS chars FROM tasks")(lambda s, d: load(s, d, "tasks").select(norm_id("task_id").alias("task_id"), "dataset", F.length("prompt").cast("long").alias("chars")))


@query("source_splits", f"SELECT {sql_id('task_id')} AS task_id, max({sql_split('split')}) AS split FROM split_manifest GROUP BY 1")
def source_splits(s, d):
    return load(s, d, "split_manifest").groupBy(norm_id("task_id").alias("task_id")).agg(F.max(norm_split("split")).alias("split"))


query("source_coefficients", "SELECT model_id, batch::INT AS batch, round(intercept_s, 9) AS intercept_s, round(prefill_s_per_token, 9) AS prefill_s_per_token, round(decode_s_per_token, 9) AS decode_s_per_token FROM cost_coefficients")(
    lambda s, d: load(s, d, "cost_coefficients").select("model_id", F.col("batch").cast("int").alias("batch"), *[F.round(c, 9).alias(c) for c in ("intercept_s", "prefill_s_per_token", "decode_s_per_token")]))

# --- run stores ---------------------------------------------------------------------------------------------------------------

_STORED = ["rollout_id", "run_id", "task_id", "arm", "split", "seed", "params_hash", "finish_reason", "extract_strategy", "tokens_exact", "text", "code", "hidden_passed", "hidden_total"]


def _stores(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A root of four runs of all rollouts: "a" appended in two parts and sealed, "b" never sealed, "c" with a sealed graded layer, "d"
    with a graded layer that isn't; and the rollouts."""
    root = f"{shared_dir(s)}/runs-{uuid.uuid4().hex}"
    r = cut(rollouts(s, d, *_STORED).select(*_STORED))
    store.append(r.where("pmod(xxhash64(rollout_id), 2) = 0"), root, "a")
    store.append(r.where("pmod(xxhash64(rollout_id), 2) = 1"), root, "a")
    plain, graded = r.drop("hidden_passed", "hidden_total"), r.select("rollout_id", "split", "hidden_passed", "hidden_total").where("hidden_total IS NOT NULL")
    for run in ("b", "c", "d"):
        store.append(plain, root, run)
    store.append(graded, root, "c", "rollouts")
    store.append(graded.where("split = 'train'"), root, "d", "rollouts")
    store.seal(s, root, "a")
    store.seal(s, root, "c")
    store.seal(s, root, "c", "rollouts")
    return root, r


@query("sink_append", f"WITH {R} SELECT rollout_id, arm, split, md5(coalesce(text, '')) AS text_md5 FROM r")
def sink_append(s, d):
    """What was appended in two parts, read back from the store's JSON, whole texts included."""
    root, _ = _stores(s, d)
    return store.read_json(s, f"{root}/a/generations").select("rollout_id", "arm", "split", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


@query("sink_seal", f"WITH {R} SELECT arm, count(*) AS rows, count(DISTINCT params_hash) AS params FROM r WHERE arm IS NOT NULL GROUP BY 1")
def sink_seal(s, d):
    """The counts by arm that the manifest of a sealed run states."""
    root, _ = _stores(s, d)
    m = json.loads(store.read_text(s, f"{root}/a/_MANIFEST_generations.json"))["counts"]
    return s.createDataFrame([(a, n, len(m["params"].get(a, []))) for a, n in m["by_arm"].items() if a != "None"], "arm string, rows long, params long")


@query("sink_graded_append", f"WITH {R} SELECT rollout_id, split, hidden_passed, hidden_total FROM r WHERE hidden_total IS NOT NULL AND split IN ('train', 'val')")
def sink_graded_append(s, d):
    """The graded layer of a run, as a reader of train and val gets it."""
    root, _ = _stores(s, d)
    return store.load_run(s, root, "c").select("rollout_id", "split", "hidden_passed", "hidden_total")


@query("seal_gate", f"WITH {R} SELECT 'a' AS run, FALSE AS refused, count(*) AS rows FROM r WHERE split IN ('train', 'val') UNION ALL SELECT 'b', TRUE, 0 FROM (SELECT 1)")
def seal_gate(s, d):
    """A sealed run is read, one without a seal is refused."""
    root, _ = _stores(s, d)
    out = []
    for run in ("a", "b"):
        try:
            got, refused = store.load_run(s, root, run), False
        except validate.Refused:
            got, refused = s.range(0), True
        out.append(got.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(run).alias("run"), F.lit(refused).alias("refused"), "rows"))
    return reduce(DataFrame.unionByName, out)


@query("layer_select", "SELECT * FROM (VALUES ('a', 'generations', FALSE), ('b', 'generations', FALSE), ('c', 'rollouts', FALSE), ('d', NULL, TRUE)) t(run, layer, refused)")
def layer_select(s, d):
    """The layer a reader gets of each run; a half graded run is refused."""
    root, _ = _stores(s, d)
    rows = []
    for run in "abcd":
        try:
            rows.append((run, store.select_layer(s, root, run), False))
        except validate.Refused:
            rows.append((run, None, True))
    return s.createDataFrame(rows, "run string, layer string, refused boolean")


query("list_runs", "SELECT * FROM (VALUES ('a', 'generations'), ('c', 'generations'), ('c', 'rollouts')) t(run, layer)")(
    lambda s, d: (lambda root: s.createDataFrame([(r, x) for x in ("generations", "rollouts") for r in store.list_runs(s, root, x)], "run string, layer string"))(_stores(s, d)[0]))


@query("sink_decisions", f"SELECT {_DEC} FROM decisions")
def sink_decisions(s, d):
    """Decisions written as JSON and Parquet, read back from the Parquet."""
    at = f"{shared_dir(s)}/decided-{uuid.uuid4().hex}"
    store.write_decisions(load(s, d, "decisions").select(*DECISION.names), at)
    return s.read.parquet(f"{at}/decisions.parquet").select(*DECISION.names)


_U = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_SYN = f"sy AS (SELECT task_id, arm, seed, cost, p, {_U.format(chr(39) + 'O|0|' + chr(39) + ' || task_id || ' + chr(39) + '|' + chr(39) + ' || arm || ' + chr(39) + '|' + chr(39) + ' || seed')} < p AS solved FROM (SELECT t.task_id, arm, seed, cost, 1 / (1 + exp(-4 * (skill - 4 * {_U.format(chr(39) + 'D|0|' + chr(39) + ' || t.task_id')}))) AS p FROM (SELECT 'synth/' || lpad(i::VARCHAR, 6, '0') AS task_id FROM range(400) r(i)) t, (VALUES ('small', 1.4::DOUBLE, 1.0::DOUBLE), ('large', 3.2, 6.0)) a(arm, skill, cost), (SELECT unnest([0, 1, 2]) AS seed)))"
_ARMS = {"small": (1.4, 1.0), "large": (3.2, 6.0)}
query("gen_synth", f"WITH {_SYN} SELECT task_id, arm, seed, cost, round(p, 6) AS p, solved FROM sy")(lambda s, d: rounded(sweep.synth(s, 400, _ARMS).select("task_id", "arm", "seed", "cost", "p", "solved")))
query("gen_synth_optimum", f"WITH {_SYN} SELECT task_id, arg_max(arm, (u, arm)) AS arm, round(max(u), 6) AS value FROM (SELECT DISTINCT task_id, arm, p - 0.05 * cost AS u FROM sy) GROUP BY 1")(lambda s, d: rounded(sweep.synth_optimum(sweep.synth(s, 400, _ARMS), 0.05)))


def _failed(s, d):
    return rollouts(s, d, "task_id", "arm", "seed", "hidden_passed", "hidden_total").select("rollout_id", "task_id", "arm", "seed", F.coalesce(solved() == 1, F.lit(False)).alias("solved"))


_LAD = f"b AS (SELECT rollout_id, task_id, arm, seed, coalesce(({SOLVED}) = 1, FALSE) AS solved FROM r), kd AS (SELECT substr(md5('repair|' || rollout_id), 1, 16) AS id, * FROM b WHERE arm = 'small' AND NOT solved)"
_LADQ = f"SELECT rollout_id, task_id, arm, seed, solved, NULL::VARCHAR AS parent_rollout_id, 0 AS ladder_step FROM b UNION ALL SELECT id, task_id, arm, seed, {_U.format(chr(39) + 'fix|' + chr(39) + ' || id')} < 0.35, rollout_id, 1 FROM kd"
query("set_union_ladder", f"WITH {R}, {_LAD} SELECT ladder_step, count(*) AS n, count(*) FILTER (WHERE solved) AS solved FROM ({_LADQ}) GROUP BY 1")(lambda s, d: sweep.with_ladder(_failed(s, d), "small", 0.35).groupBy("ladder_step").agg(F.count(F.lit(1)).alias("n"), F.count_if("solved").alias("solved")))
for _n in ("gen_ladder",):
    query(_n, f"WITH {R}, {_LAD} {_LADQ}")(lambda s, d: sweep.with_ladder(_failed(s, d), "small", 0.35))

# --- sweeps -------------------------------------------------------------------------------------------------------------------

_PLAN = f"pl AS (SELECT DISTINCT {sql_id('task_id')} AS task_id, arm, seed FROM tasks, (SELECT unnest(['small', 'large']) AS arm), (SELECT unnest([0, 1, 2, 3]) AS seed))"


def _planned(s, d):
    arms = s.createDataFrame([("small",), ("large",)], "arm string")
    return sweep.plan(load(s, d, "tasks").select(norm_id("task_id").alias("task_id")), arms, [0, 1, 2, 3])


query("sweep_plan", f"WITH {_PLAN} SELECT * FROM pl")(lambda s, d: _planned(s, d))
_DONE = "dn AS (SELECT task_id, arm, seed, max(params_hash) AS params_hash, coalesce(bool_or(finish_reason IN ('stop', 'length', 'refusal')), FALSE) AS terminal, coalesce(bool_or(finish_reason = 'error'), FALSE) AS err FROM r GROUP BY task_id, arm, seed, params_hash)"
_PH = "ph AS (SELECT arm, min(params_hash) AS params_hash FROM r GROUP BY 1)"


def _with_params(s, d):
    r = rollouts(s, d, "task_id", "arm", "seed", "params_hash", "finish_reason")
    return _planned(s, d).join(F.broadcast(r.groupBy("arm").agg(F.min("params_hash").alias("params_hash"))), "arm"), r


query("anti_resume", f"WITH {R}, {_PLAN}, {_DONE} SELECT task_id, arm, seed FROM pl WHERE NOT EXISTS (SELECT 1 FROM dn WHERE terminal AND dn.task_id = pl.task_id AND dn.arm = pl.arm AND dn.seed = pl.seed)")(
    lambda s, d: _planned(s, d).join(sweep.states(rollouts(s, d, "task_id", "arm", "seed", "params_hash", "finish_reason")).where("done").select("task_id", "arm", "seed").distinct(), ["task_id", "arm", "seed"], "left_anti").select("task_id", "arm", "seed"))
for _n in ("sweep_resume_pending",):
    query(_n, f"WITH {R}, {_PLAN}, {_DONE}, {_PH} SELECT pl.task_id, pl.arm, pl.seed, ph.params_hash FROM pl JOIN ph USING (arm) WHERE NOT EXISTS (SELECT 1 FROM dn WHERE terminal AND dn.task_id = pl.task_id AND dn.arm = pl.arm AND dn.seed = pl.seed AND dn.params_hash = ph.params_hash)")(
        lambda s, d: (lambda x: sweep.pending(x[0], x[1]).select("task_id", "arm", "seed", "params_hash"))(_with_params(s, d)))
query("resume_retryable", f"WITH {R}, {_DONE} SELECT task_id, arm, seed, params_hash FROM dn WHERE err AND NOT terminal")(lambda s, d: sweep.states(rollouts(s, d, "task_id", "arm", "seed", "params_hash", "finish_reason")).where("retryable").select(*sweep.CELL))
query("resume_summary", f"WITH {R}, {_PLAN}, {_DONE}, {_PH}, rm AS (SELECT count(*) AS n FROM pl JOIN ph USING (arm) WHERE NOT EXISTS (SELECT 1 FROM dn WHERE terminal AND dn.task_id = pl.task_id AND dn.arm = pl.arm AND dn.seed = pl.seed AND dn.params_hash = ph.params_hash)) SELECT (SELECT count(*) FROM r) AS rows, count(*) FILTER (WHERE terminal) AS complete, count(*) FILTER (WHERE err AND NOT terminal) AS retryable, (SELECT count(*) FROM pl) AS planned, (SELECT n FROM rm) AS remaining, 1::BIGINT AS torn FROM dn")(
    lambda s, d: _resume_summary(s, d))


def _resume_summary(s: SparkSession, d: str) -> DataFrame:
    """Rows there are, cells complete and to be tried again, planned and remaining, and torn lines: of the decisions' parts, one of which is torn."""
    p, r = _with_params(s, d)
    at = _written(s, d)
    store.write_text(s, f"{at}/part-torn.json", '{"run_id": "torn", "policy_na')
    one = lambda x, n: F.broadcast(x.agg(F.count(F.lit(1)).alias(n)))
    torn = s.read.text(at).where(F.from_json("value", DECISION, {"mode": "PERMISSIVE"}).isNull() | F.try_parse_json("value").isNull())
    x = sweep.states(r).agg(F.count_if("done").alias("complete"), F.count_if("retryable").alias("retryable"))
    return x.crossJoin(one(r, "rows")).crossJoin(one(_planned(s, d), "planned")).crossJoin(one(sweep.pending(p, r), "remaining")).crossJoin(one(torn, "torn")).select("rows", "complete", "retryable", "planned", "remaining", "torn")


query("guard_params_drift", f"WITH {R}, {_PH} SELECT r.arm, count(DISTINCT r.params_hash) AS stored, any_value(ph.params_hash) AS expected, count(DISTINCT r.params_hash) = 1 AS ok FROM r JOIN ph USING (arm) GROUP BY 1")(
    lambda s, d: (lambda r: sweep.drift(r, r.groupBy("arm").agg(F.min("params_hash").alias("expected"))))(rollouts(s, d, "arm", "params_hash")))
_MOCKU = lambda k: _U.format(f"'{k}|' || task_id || '|' || arm || '|' || seed || '|' || params_hash")
query("mock_generate", f"WITH {R}, {_PLAN}, {_PH}, m AS (SELECT pl.*, params_hash FROM pl JOIN ph USING (arm)), f AS (SELECT *, CASE WHEN {_MOCKU('error')} < 0.005 THEN 'error' WHEN {_MOCKU('refusal')} < 0.005 THEN 'refusal' WHEN {_MOCKU('trunc')} < 0.03 THEN 'length' ELSE 'stop' END AS finish_reason, CASE arm WHEN 'small' THEN 0.46 ELSE 0.60 END > {_U.format(chr(39) + 'difficulty|' + chr(39) + ' || task_id')} + ({_MOCKU('jitter')} - 0.5) * 2 * 0.1 AS won FROM m) SELECT task_id, arm, seed, params_hash, finish_reason, finish_reason = 'stop' AND won AS solved FROM f")(
    lambda s, d: sweep.mock(_with_params(s, d)[0], {"small": 0.46, "large": 0.60}).select("task_id", "arm", "seed", "params_hash", "finish_reason", "solved"))


_RES2 = "ck AS (SELECT DISTINCT model_id FROM cost_coefficients)"


@query("sweep_run")
def sweep_run(s, d):
    """Pending cells through the mock model, with rendered prompts and imputed costs: what a resumed sweep would append."""
    p, r = _with_params(s, d)
    x = sweep.mock(sweep.pending(p, r), {"small": 0.46, "large": 0.60}).join(task_rows(s, d), "task_id")
    x = x.withColumn("prompt", sweep.render(F.col("prompt"), F.col("visible_tests"))).withColumn("prefill_tokens", features.tokens_approx(F.col("prompt"))).withColumn("decode_tokens", F.lit(60)).withColumn("model_id", F.concat(F.lit("mock/coder-"), F.col("arm")))
    return cost.impute(x, load(s, d, "cost_coefficients")).select("task_id", "arm", "seed", "params_hash", "finish_reason", "solved", "prefill_tokens", F.round("imputed_s", 6).alias("imputed_s"))


query("source_models", f"WITH {R}, {_RES2} SELECT arm, model_id, backend, count(*) AS n, bool_or(priced) AS priced FROM (SELECT r.*, k.model_id IS NOT NULL AS priced FROM r LEFT JOIN ck k USING (model_id)) GROUP BY 1, 2, 3")(
    lambda s, d: rollouts(s, d, "arm", "model_id", "backend").join(F.broadcast(load(s, d, "cost_coefficients").select("model_id", F.lit(True).alias("k")).distinct()), "model_id", "left").groupBy("arm", "model_id", "backend").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("k", F.lit(False))).alias("priced")))
query("reg_arms", "SELECT arm, role, a.template_id, sampled, ladder_step, requires_parent, t.template_id <> 'direct_notests_v1' AS shows_tests, t.template_id = 'repair_v1' AS shows_prior, NOT requires_parent AS sweepable FROM (VALUES ('direct_small', 'small', 'direct_v1', FALSE, 0, FALSE), ('direct_large', 'large', 'direct_v1', FALSE, 0, FALSE), ('direct_small_notests', 'small', 'direct_notests_v1', FALSE, 0, FALSE), ('direct_large_notests', 'large', 'direct_notests_v1', FALSE, 0, FALSE), ('probe_small', 'small', 'direct_v1', TRUE, 0, FALSE), ('repair_small', 'small', 'repair_v1', FALSE, 1, TRUE), ('repair_large', 'large', 'repair_v1', FALSE, 1, TRUE)) a(arm, role, template_id, sampled, ladder_step, requires_parent) JOIN (VALUES ('direct_v1'), ('direct_notests_v1'), ('repair_v1')) t(template_id) USING (template_id)")(lambda s, d: sweep.arm_table(s))
_WS = "' ' || chr(10) || chr(13) || chr(9)"
query("prompt_render", f"WITH {_TASKS} SELECT task_id, md5('Write a Python solution to the following problem.' || chr(10) || chr(10) || trim(coalesce(prompt, ''), ' ') || CASE WHEN trim(coalesce(visible_tests, ''), ' ') <> '' THEN chr(10) || chr(10) || 'Your solution must satisfy these tests:' || chr(10) || chr(10) || '```python' || chr(10) || trim(visible_tests, ' ') || chr(10) || '```' ELSE '' END || chr(10) || chr(10) || 'Respond with one ```python code block containing the complete solution.') AS user_md5 FROM tk WHERE task_id IS NOT NULL")(
    lambda s, d: task_rows(s, d).select("task_id", F.md5(sweep.render(F.col("prompt"), F.col("visible_tests")).cast("binary")).alias("user_md5")))

# --- projections and predicates -----------------------------------------------------------------------------------------------

query("proj_normalize", f"SELECT delivery_id, {sql_id('rollout_id')} AS rollout_id, {sql_id('task_id')} AS task_id, {sql_id('arm')} AS arm, {sql_split('split')} AS split, seed, {sql_id('task_id')} IS NULL OR {sql_id('arm')} IS NULL OR {sql_split('split')} IS NULL AS bad FROM generations")(
    lambda s, d: load(s, d, "generations").select("delivery_id", *[norm_id(c).alias(c) for c in ("rollout_id", "task_id", "arm")], norm_split("split").alias("split"), "seed").withColumn("bad", F.col("task_id").isNull() | F.col("arm").isNull() | F.col("split").isNull()))
query("proj_solved", f"WITH {R} SELECT rollout_id, {SOLVED} AS solved, coalesce(hidden_total > 0 AND hidden_passed = hidden_total, FALSE) AS solved_strict FROM r")(
    lambda s, d: rollouts(s, d, "hidden_passed", "hidden_total").select("rollout_id", solved().alias("solved"), F.coalesce((F.col("hidden_total") > 0) & (F.col("hidden_passed") == F.col("hidden_total")), F.lit(False)).alias("solved_strict")))
query("proj_visible_frac", f"WITH {R} SELECT rollout_id, round({VISIBLE}, 6) AS visible_frac FROM r")(lambda s, d: rounded(rollouts(s, d, "visible_passed", "visible_total").select("rollout_id", visible_frac().alias("visible_frac"))))
query("proj_flags", f"WITH {R} SELECT rollout_id, coalesce(finish_reason = 'length', FALSE) AS truncated, coalesce(len(hack_flags) > 0, FALSE) AS hacked FROM r")(
    lambda s, d: rollouts(s, d, "finish_reason", "hack_flags").select("rollout_id", F.coalesce(F.col("finish_reason") == "length", F.lit(False)).alias("truncated"), F.coalesce(F.size("hack_flags") > 0, F.lit(False)).alias("hacked")))
query("proj_failed", f"WITH {R} SELECT rollout_id, coalesce(finish_reason IN ('error', 'refusal'), FALSE) OR regexp_replace(coalesce(code, ''), '\\s', '', 'g') = '' AS failed FROM r")(
    lambda s, d: rollouts(s, d, "finish_reason", "code").select("rollout_id", (F.coalesce(F.col("finish_reason").isin("error", "refusal"), F.lit(False)) | (F.regexp_replace(F.coalesce("code", F.lit("")), r"\s", "") == "")).alias("failed")))
query("proj_total_tokens", f"WITH {R} SELECT rollout_id, prefill_tokens + decode_tokens AS total_tokens FROM r")(lambda s, d: rollouts(s, d, "prefill_tokens", "decode_tokens").select("rollout_id", (F.col("prefill_tokens") + F.col("decode_tokens")).alias("total_tokens")))
_FIN = "CASE lower(trim(finish_reason)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in validate.FINISH.items()) + " ELSE 'unknown' END"
query("proj_finish_norm", f"WITH {R} SELECT rollout_id, {_FIN} AS finish_reason FROM r")(lambda s, d: rollouts(s, d, "finish_reason").select("rollout_id", validate.finish_reason("finish_reason").alias("finish_reason")))
query("proj_strip_labels", f"WITH {R} SELECT rollout_id, task_id, arm, visible_passed FROM r")(lambda s, d: validate.strip_labels(rollouts(s, d, "task_id", "arm", "visible_passed", "hidden_passed", "hidden_total").drop("delivery_id"))[0])
query("pred_graded", f"WITH {R} SELECT rollout_id FROM r WHERE hidden_total > 0 AND visible_total IS NOT NULL")(lambda s, d: rollouts(s, d, "hidden_total", "visible_total").where("hidden_total > 0 AND visible_total IS NOT NULL").select("rollout_id"))
_RUN = validate.RUN_ID.replace("\\d", "[0-9]")
query("pred_run_id", f"SELECT delivery_id, regexp_matches(run_id, '{_RUN}') AS valid FROM generations")(lambda s, d: load(s, d, "generations").select("delivery_id", F.col("run_id").rlike(validate.RUN_ID).alias("valid")))
for _n in ("pred_publishable",):
    query(_n, f"SELECT run_id, regexp_matches(run_id, '{_RUN}') AS valid, NOT suffix(run_id, '-dirty') AS publishable, count(*) AS n FROM generations GROUP BY 1")(
        lambda s, d: load(s, d, "generations").groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select("run_id", F.col("run_id").rlike(validate.RUN_ID).alias("valid"), (~F.endswith("run_id", F.lit("-dirty"))).alias("publishable"), "n"))
_ERRS = [
    *[(f"{x}: required", f"{x} IS NULL") for x in validate.REQUIRED],
    *[(f"{x}: empty", f"{x} = ''") for x in ("task_id", "arm", "params_hash")],
    ("rollout_id: pattern", "NOT regexp_matches(rollout_id, '^[0-9a-f]{16}$')"), ("run_id: pattern", f"NOT regexp_matches(run_id, '{_RUN}')"),
    ("split: enum", "split NOT IN ('train', 'val', 'test')"), ("mode: enum", "mode NOT IN ('sweep', 'serving')"), ("finish_reason: enum", "finish_reason NOT IN ('stop', 'length', 'refusal', 'error', 'unknown')"), ("schema_version: enum", "schema_version <> 1"),
    *[(f"{x}: minimum", f"{x} < {v}" + (f" OR {x}::VARCHAR IN ('nan', '-nan')" if x in ("wall_ms", "gpu_seconds", "imputed_latency_s", "grade_duration_s") else "")) for x, v in validate.FLOORS.items()],
    *[e for t in ("visible", "hidden") for e in ((f"{t}: passed and total together", f"({t}_passed IS NULL) <> ({t}_total IS NULL)"), (f"{t}: passed over total", f"{t}_passed > {t}_total"))],
    ("ladder: step without parent", "ladder_step > 0 AND parent_rollout_id IS NULL"), ("ladder: parent without step", "ladder_step = 0 AND parent_rollout_id IS NOT NULL"),
    ("serving: batched", "mode = 'serving' AND batch_size <> 1"),
]
_ALLERR = " UNION ALL ".join(f"SELECT delivery_id, '{m}' AS error FROM generations WHERE {c}" for m, c in _ERRS)
query("valid_errors", _ALLERR)(lambda s, d: validate.errors(load(s, d, "generations"), "delivery_id"))
query("valid_schema", f"SELECT error, count(*) AS n FROM ({_ALLERR}) WHERE error NOT LIKE 'ladder%' AND error NOT LIKE 'serving%' GROUP BY 1")(
    lambda s, d: validate.errors(load(s, d, "generations"), "delivery_id").where("error NOT LIKE 'ladder%' AND error NOT LIKE 'serving%'").groupBy("error").agg(F.count(F.lit(1)).alias("n")))
query("valid_crossfield", f"SELECT error, count(*) AS n FROM ({_ALLERR}) WHERE error LIKE 'ladder%' OR error LIKE 'serving%' OR error LIKE '%together' OR error LIKE '%over total' GROUP BY 1")(
    lambda s, d: validate.errors(load(s, d, "generations"), "delivery_id").where("error LIKE 'ladder%' OR error LIKE 'serving%' OR error LIKE '%together' OR error LIKE '%over total'").groupBy("error").agg(F.count(F.lit(1)).alias("n")))
query("valid_difficulty", "SELECT task_id, difficulty FROM tasks WHERE difficulty IS NOT NULL AND difficulty::VARCHAR NOT IN ('nan', '-nan') AND difficulty_provenance IS NULL")(lambda s, d: validate.difficulty_unsourced(load(s, d, "tasks")).select("task_id", "difficulty"))
query("valid_version", "SELECT string_agg(DISTINCT schema_version::VARCHAR, ',') AS versions, CASE WHEN count(DISTINCT schema_version) > 1 THEN 'mixed' WHEN count(schema_version) = 0 THEN 'empty' WHEN min(schema_version) = 1 THEN 'ok' ELSE 'unsupported' END AS state FROM generations")(lambda s, d: validate.version_state(load(s, d, "generations")))
query("single_run", "SELECT count(DISTINCT run_id) AS runs, count(DISTINCT run_id) = 1 AS single FROM generations")(lambda s, d: load(s, d, "generations").agg(F.count_distinct("run_id").alias("runs"), (F.count_distinct("run_id") == 1).alias("single")))

# --- integrity ----------------------------------------------------------------------------------------------------------------


def _rows(s, d):
    """Every delivery, ids and splits in one spelling."""
    g = load(s, d, "generations")
    return g.withColumns({**{c: norm_id(c) for c in ("task_id", "arm", "parent_rollout_id")}, "split": norm_split("split"), "rollout_id": norm_id("rollout_id")}).select("rollout_id", "run_id", "task_id", "arm", "params_hash", "split", "ladder_step", "parent_rollout_id", "visible_passed", "visible_total", "hidden_passed", "hidden_total", "prefill_tokens", "decode_tokens", "mode", "batch_size")


_CTRL = " OR ".join(f"coalesce(regexp_matches({c}, '[\\x00-\\x1f]'), FALSE)" for c in validate.IDENTITY)
_BADN = " OR ".join([f"coalesce({c} < 0, FALSE)" for c in ("visible_passed", "visible_total", "hidden_passed", "hidden_total", "decode_tokens", "prefill_tokens")] + [f"coalesce({t}_passed > {t}_total, FALSE)" for t in ("visible", "hidden")])
_ISSUES = {
    "integ_dup": "SELECT 'duplicate_rollout_id' AS issue, rollout_id AS example FROM r0 WHERE rollout_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1",
    "integ_split_span": "SELECT 'split_span' AS issue, task_id AS example FROM r0 GROUP BY 2 HAVING min(split) < max(split)",
    "integ_orphan": "SELECT 'orphan_ladder_step' AS issue, rollout_id AS example FROM r0 a WHERE (ladder_step > 0 OR parent_rollout_id IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM r0 b WHERE b.rollout_id = a.parent_rollout_id)",
    "integ_counts": f"SELECT 'impossible_counts' AS issue, rollout_id AS example FROM r0 WHERE {_BADN}",
    "integ_ctrl": f"SELECT 'control_characters' AS issue, regexp_replace(rollout_id, '[\\x00-\\x1f]', '?', 'g') AS example FROM r0 WHERE {_CTRL}",
    "integ_serving": "SELECT 'serving_batched' AS issue, rollout_id AS example FROM r0 WHERE mode = 'serving' AND batch_size > 1",
    "integ_single_arm": "SELECT 'single_arm' AS issue, count(DISTINCT arm)::VARCHAR AS example FROM r0 HAVING count(DISTINCT arm) < 2",
}
_R0 = R.split(", r AS")[0]
for (_n, _q), _f in zip(_ISSUES.items(), validate.CHECKS.values()):
    query(_n, f"WITH {_R0} {_q}")(lambda s, d, f=_f: f(_rows(s, d)))
_ALLISS = " UNION ALL ".join(f"({q})" for q in _ISSUES.values())
for _n in ("integ_all",):
    query(_n, f"WITH {_R0}, iss AS ({_ALLISS}), ex AS (SELECT issue, string_agg(example, ' ' ORDER BY example) AS examples FROM (SELECT issue, example, row_number() OVER (PARTITION BY issue ORDER BY example) AS k FROM (SELECT DISTINCT issue, example FROM iss WHERE example IS NOT NULL)) WHERE k <= 3 GROUP BY 1) SELECT issue, n, coalesce(examples, '') AS examples FROM (SELECT issue, count(*) AS n FROM iss GROUP BY 1) LEFT JOIN ex USING (issue)")(
        lambda s, d: validate.integrity(_rows(s, d)))
query("examples_3", f"WITH {R} SELECT task_id, string_agg(rollout_id, ' ' ORDER BY rollout_id) FILTER (WHERE k <= 3) AS examples, count(*) AS n FROM (SELECT task_id, rollout_id, row_number() OVER (PARTITION BY task_id ORDER BY rollout_id) AS k FROM r WHERE finish_reason = 'length') GROUP BY 1")(
    lambda s, d: validate.three_examples(rollouts(s, d, "task_id", "finish_reason").where("finish_reason = 'length'"), "task_id", "rollout_id").select("task_id", "examples", "n"))
query("grid_complete", f"WITH {C}, x AS (SELECT count(*) AS rows, count(DISTINCT task_id) AS tasks, count(DISTINCT arm) AS arms, count(DISTINCT seed) AS seeds, min(seed) AS lo, max(seed) AS hi FROM c) SELECT rows, tasks, arms, seeds, rows = tasks * arms * seeds AS complete, lo = 0 AND hi = seeds - 1 AS seeds_in_order FROM x")(lambda s, d: validate.grid_gaps(cells(s, d)))
query("load_warnings", f"WITH {R} SELECT round(avg((finish_reason = 'length')::INT), 6) AS truncation_rate, avg((finish_reason = 'length')::INT) > 0.02 AS warn_truncation, count(*) FILTER (WHERE len(hack_flags) > 0) AS hacked, count(*) FILTER (WHERE gpu_seconds IS NULL) AS cost_missing FROM r")(lambda s, d: validate.load_warnings(rollouts(s, d, "finish_reason", "hack_flags", "gpu_seconds")))
_D1COLS = ["visible_passed", "visible_total", "code", "code_parses", "finish_reason", "decode_tokens", "prefill_tokens", "extract_strategy", "error", "hack_flags"]
_D0F, _D1F = features.names("D0", "d0_"), [n for n in features.names("D1", "d1_") if n.startswith("d1_")]
_DECLARED = "de AS (SELECT * FROM (VALUES " + ", ".join(f"('{features.REGISTRY[n].point}', '{n}', '{c}')" for n in [*_D0F, *_D1F] for c in features.REGISTRY[n].columns) + ") t(point, feature, col))"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_ALLOWED = {"D0": f"col NOT IN {_IN([*validate.D0_COLUMNS, 'prompt', 'visible_tests', 'entrypoint'])}", "D1": f"col IN {_IN([*validate.LABELS, *validate.NEVER])}"}
_CHECK = lambda name, found: f"SELECT '{name}' AS check_name, ({found}) = 0 AS passed, ({found})::BIGINT AS found"
_LAB_ROWS = "fr AS (SELECT split FROM c WHERE arm = 'small' AND hidden_total IS NOT NULL AND split = 'train')"
_BOUND = lambda score: (
    f"SELECT (max(a) FILTER (WHERE k = 'score') > max(a) FILTER (WHERE k = 'ceiling') + {audit.TOLERANCE})::BIGINT FROM (SELECT k, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS a FROM"
    f" (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2.0 AS rk FROM (SELECT 'score' AS k, {score} AS v, solved::INT AS y FROM sy WHERE arm = 'small' UNION ALL SELECT 'ceiling', p, solved::INT FROM sy WHERE arm = 'small')) GROUP BY 1)"
)
_SPANS = f"SELECT count(*) FROM ({_ISSUES['integ_split_span']})"


def _synth_scores(s):
    """Synthetic first attempts of small: what is knowable of a task's success, and whether it was one."""
    return sweep.synth(s, 400, _ARMS).where("arm = 'small'").select("p", F.col("solved").cast("int").alias("y"))


@query("leak_audit", f"WITH {C}, {_LAB_ROWS}, {_DECLARED}, {_SYN} " + " UNION ALL ".join([
    _CHECK("split_disjointness", _SPANS), _CHECK("ladder_causality", "SELECT count(*) FROM r0 WHERE ladder_step < 0"), _CHECK("column_allowlist[D0]", f"SELECT count(DISTINCT col) FROM de WHERE point = 'D0' AND {_ALLOWED['D0']}"), _CHECK("column_allowlist[D1]", f"SELECT count(DISTINCT col) FROM de WHERE {_ALLOWED['D1']}"),
    _CHECK("canary", f"SELECT count(DISTINCT feature) FROM de WHERE feature IN {_IN(audit.CANARIES)}"), _CHECK("seed_aggregation", "SELECT count(DISTINCT feature) FROM de WHERE " + " OR ".join(f"contains(feature, '{m}')" for m in audit.SEED_MARKS)),
    _CHECK("normalization_scope", "SELECT count(*) FROM fr WHERE split = 'test'"), _CHECK("auc_within_bound[D0]", _BOUND("p")),
]))
def leak_audit(s: SparkSession, d: str) -> DataFrame:
    """All checks of an audit in one frame: of the splits and ladders of all rows, of the feature tables as built from the registry, of the
    rows that scaling is fitted on, and of a score against its planted ceiling."""
    r = _rows(s, d)
    d0 = features.build(task_rows(s, d), _D0F, ["task_id"])
    x = cells(s, d, "split", "hidden_total", *_D1COLS).where("arm = 'small' AND hidden_total IS NOT NULL")
    d1 = features.build(x, _D1F, ["rollout_id"])
    both = d0.join(x.select("task_id", "rollout_id"), "task_id").join(d1, "rollout_id")
    checks = [audit.split_disjointness(r), audit.ladder_causality(r), audit.column_allowlist(d0, "D0"), audit.column_allowlist(d1, "D1"), audit.canary(both), audit.seed_aggregation(both), audit.normalization_scope(audit.fence(x, ["train"])), audit.auc_within_bound(_synth_scores(s), "p", "p", "y")]
    return reduce(DataFrame.unionByName, checks)


_PLANT = ["task_id", "prompt_mean_over_seeds", "_synth_difficulty"]
_PLANT_READS = ["task_id", "code", "wall_ms", "hidden_passed"]
_LATE = {"D0": f"col NOT IN {_IN(validate.D0_COLUMNS)}", "D1": f"col IN {_IN([*validate.LABELS, *validate.NEVER])}"}


@query("leak_audit_planted", f"WITH {C}, {_SYN}, pf AS (SELECT unnest({_PLANT}) AS feature), pr AS (SELECT unnest({_PLANT_READS}) AS col), pt AS (SELECT split FROM r WHERE split IS NOT NULL), pl AS (SELECT task_id, split, ladder_step FROM r0 UNION ALL SELECT 'planted', split, -1 FROM r0 WHERE split IS NOT NULL) " + " UNION ALL ".join([
    _CHECK("split_disjointness", "SELECT count(*) FROM (SELECT task_id FROM pl GROUP BY 1 HAVING min(split) < max(split))"), _CHECK("ladder_causality", "SELECT count(*) FROM pl WHERE ladder_step < 0"), _CHECK("column_allowlist[D0]", f"SELECT count(*) FROM pr WHERE {_LATE['D0']}"), _CHECK("column_allowlist[D1]", f"SELECT count(*) FROM pr WHERE {_LATE['D1']}"),
    _CHECK("canary", f"SELECT count(*) FROM pf WHERE feature IN {_IN(audit.CANARIES)}"), _CHECK("seed_aggregation", "SELECT count(*) FROM pf WHERE " + " OR ".join(f"contains(feature, '{m}')" for m in audit.SEED_MARKS)),
    _CHECK("normalization_scope", "SELECT count(*) FROM pt WHERE split = 'test'"), _CHECK("auc_within_bound[D0]", _BOUND("solved::INT::DOUBLE")),
]))
def leak_audit_planted(s: SparkSession, d: str) -> DataFrame:
    """The same checks on tables with a planted leak each: a task in every split, a step below 0, columns read too early, a planted column,
    a mean over seeds, scaling over all splits, and a score made from the label. None of them may pass."""
    r = _rows(s, d)
    r = r.unionByName(r.where("split IS NOT NULL").withColumn("task_id", F.lit("planted")).withColumn("ladder_step", F.lit(-1)))
    wide = s.createDataFrame([("t", 1.0, 1.0)], f"`{_PLANT[0]}` string, `{_PLANT[1]}` double, `{_PLANT[2]}` double")
    x = rollouts(s, d, "split").where("split IS NOT NULL")
    checks = [audit.split_disjointness(r), audit.ladder_causality(r), audit.column_allowlist(wide, "D0", _PLANT_READS), audit.column_allowlist(wide, "D1", _PLANT_READS), audit.canary(wide), audit.seed_aggregation(wide), audit.normalization_scope(audit.fence(x, validate.SPLITS, unlocked=True)), audit.auc_within_bound(_synth_scores(s), "y", "p", "y")]
    return reduce(DataFrame.unionByName, checks)


@query("pred_split_fence", f"WITH {R} SELECT 'train,val' AS splits, FALSE AS unlocked, FALSE AS refused, count(*) FILTER (WHERE split IN ('train', 'val')) AS rows FROM r UNION ALL SELECT 'test', FALSE, TRUE, 0 FROM (SELECT 1) UNION ALL SELECT 'test', TRUE, FALSE, count(*) FILTER (WHERE split = 'test') FROM r")
def pred_split_fence(s: SparkSession, d: str) -> DataFrame:
    """What a reader of some splits gets, and that test is refused unless it was unlocked."""
    x, out = rollouts(s, d, "split"), []
    for splits, unlocked in ((["train", "val"], False), (["test"], False), (["test"], True)):
        try:
            got, refused = audit.fence(x, splits, unlocked), False
        except validate.Refused:
            got, refused = x.where(F.lit(False)), True
        out.append(got.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(",".join(splits)).alias("splits"), F.lit(unlocked).alias("unlocked"), F.lit(refused).alias("refused"), "rows"))
    return reduce(DataFrame.unionByName, out)


# --- joins and sets -----------------------------------------------------------------------------------------------------------

for _n in ("join_tasks",):
    query(_n, f"WITH {R}, {_TASKS} SELECT rollout_id, r.task_id, entrypoint, length(prompt) AS prompt_chars FROM r JOIN tk USING (task_id)")(
        lambda s, d: rollouts(s, d, "task_id").join(task_rows(s, d).select("task_id", "entrypoint", F.length("prompt").cast("long").alias("prompt_chars")), "task_id").select("rollout_id", "task_id", "entrypoint", "prompt_chars"))
query("join_grade_tasks", f"WITH {R}, {_TASKS} SELECT count(tk.task_id) AS joined, count(*) - count(tk.task_id) AS skipped, count(DISTINCT CASE WHEN tk.task_id IS NULL THEN r.task_id END) AS tasks_missing FROM r LEFT JOIN tk ON tk.task_id = r.task_id")(
    lambda s, d: rollouts(s, d, "task_id").join(task_rows(s, d).select("task_id", F.lit(True).alias("there")), "task_id", "left").agg(F.count("there").alias("joined"), F.count_if(F.col("there").isNull()).alias("skipped"), F.count_distinct(F.when(F.col("there").isNull(), F.col("task_id"))).alias("tasks_missing")))
_MAN = f"mn AS (SELECT {sql_id('task_id')} AS task_id, max({sql_split('split')}) AS planned FROM split_manifest GROUP BY 1)"
query("join_splits", f"WITH {R}, {_MAN} SELECT rollout_id, coalesce(planned, split) AS split, coalesce(planned <> split, FALSE) AS moved FROM r LEFT JOIN mn USING (task_id)")(
    lambda s, d: rollouts(s, d, "task_id", "split").join(source_splits(s, d).withColumnRenamed("split", "planned"), "task_id", "left").select("rollout_id", F.coalesce("planned", "split").alias("split"), F.coalesce(F.col("planned") != F.col("split"), F.lit(False)).alias("moved")))
query("join_arms", f"WITH {G} SELECT task_id, seed, s_solved, l_solved, round(s_cost, 6) AS s_cost, round(l_cost, 6) AS l_cost FROM g")(lambda s, d: rounded(grid(s, d).select("task_id", "seed", "s_solved", "l_solved", "s_cost", "l_cost")))
query("semi_tasks", f"WITH {C} SELECT task_id FROM c WHERE arm IS NOT NULL GROUP BY 1 HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM c)")(
    lambda s, d: (lambda c: c.groupBy("task_id").agg(F.count_distinct("arm").alias("n")).join(F.broadcast(c.agg(F.count_distinct("arm").alias("n"))), "n").select("task_id"))(cells(s, d).where("arm IS NOT NULL").select("task_id", "arm")))
query("set_common_tasks", f"WITH {C} SELECT task_id FROM c WHERE arm = 'small' INTERSECT SELECT task_id FROM c WHERE arm = 'large'")(
    lambda s, d: (lambda c: c.where("arm = 'small'").select("task_id").intersect(c.where("arm = 'large'").select("task_id")))(cells(s, d).select("task_id", "arm")))
query("anti_missing_action", f"WITH {R} SELECT DISTINCT task_id FROM r WHERE task_id IS NOT NULL AND task_id NOT IN (SELECT {sql_id('task_id')} FROM decisions WHERE chosen AND task_id IS NOT NULL)")(
    lambda s, d: rollouts(s, d, "task_id").select("task_id").where("task_id IS NOT NULL").distinct().join(load(s, d, "decisions").where("chosen").select(norm_id("task_id").alias("task_id")).distinct(), "task_id", "left_anti"))
query("sort_tasks", f"WITH {_TASKS} SELECT task_id, row_number() OVER (ORDER BY task_id) AS position FROM tk WHERE task_id IS NOT NULL")(lambda s, d: before(task_rows(s, d).select("task_id"), ["task_id"]).select("task_id", (F.col("before") + 1).alias("position")))


query("limit_first_n", f"WITH {_TASKS} SELECT task_id FROM tk WHERE task_id IS NOT NULL ORDER BY task_id LIMIT 25")(lambda s, d: task_rows(s, d).select("task_id").orderBy("task_id").limit(25))
_TD = f"td AS (SELECT {sql_id('task_id')} AS task_id, max(dataset) AS dataset, max(prompt) AS prompt FROM tasks GROUP BY 1)"
query("limit_per_dataset", f"WITH {_TD} SELECT dataset, task_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY task_id) AS k FROM td) WHERE k <= 20")(lambda s, d: corpus.first_per_group(task_rows(s, d).select("dataset", "task_id"), "dataset", "task_id", 20))
query("set_common_features", f"WITH {_TASKS}, {_LONG} SELECT feature FROM lf WHERE value > 0 GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM tk WHERE task_id IS NOT NULL)")(
    lambda s, d: (lambda f, n: f.where("value > 0").groupBy("feature").agg(F.count("value").alias("c")).crossJoin(F.broadcast(n)).where("c = n").select("feature"))(_long(s, d), task_rows(s, d).agg(F.count(F.lit(1)).alias("n"))))
query("set_allowlist", "SELECT unnest(['late:code', 'never:wall_ms', 'label:hidden_passed']) AS problem")(lambda s, d: s.createDataFrame([(p,) for p in validate.allowlist(["task_id", "code", "wall_ms", "hidden_passed"], "D0")], "problem string"))
query("set_merge_coeffs", "SELECT model_id, batch, round(CASE WHEN batch = 1 THEN intercept_s * 2 ELSE intercept_s END, 6) AS intercept_s FROM cost_coefficients WHERE batch = 1 OR model_id NOT IN (SELECT model_id FROM cost_coefficients WHERE batch = 1)")(lambda s, d: _merged(load(s, d, "cost_coefficients")))


def _merged(old: DataFrame) -> DataFrame:
    """A new pass over the models characterised at batch 1, and the models that it didn't touch."""
    new = old.where("batch = 1").withColumn("intercept_s", F.col("intercept_s") * 2)
    return rounded(new.unionByName(old.join(F.broadcast(new.select("model_id").distinct()), "model_id", "left_anti").select(*old.columns)).select("model_id", "batch", "intercept_s"))


_SQ = "trim(regexp_replace(coalesce(prompt, ''), '\\s+', ' ', 'g'))"
_FILT = f"ft AS (SELECT task_id, dataset, CASE WHEN length(sq) < 40 THEN 'degenerate_prompt' WHEN task_id <> min(CASE WHEN length(sq) >= 40 THEN task_id END) OVER (PARTITION BY sq) THEN 'duplicate_prompt_of:' || min(CASE WHEN length(sq) >= 40 THEN task_id END) OVER (PARTITION BY sq) END AS reason FROM (SELECT *, {_SQ} AS sq FROM td WHERE task_id IS NOT NULL))"
query("set_dedup_prompt", f"WITH {_TD}, {_FILT} SELECT * FROM ft")(lambda s, d: corpus.contamination_filter(task_rows(s, d)))
query("corpus_build", f"WITH {_TD}, {_FILT} SELECT dataset, task_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY task_id) AS k FROM ft WHERE reason IS NULL) WHERE k <= 50")(
    lambda s, d: corpus.first_per_group(corpus.contamination_filter(task_rows(s, d)).where("reason IS NULL").select("dataset", "task_id"), "dataset", "task_id", 50))
query("corpus_hash", f"WITH {_TASKS} SELECT sha256(string_agg(h, '' ORDER BY h)) AS corpus_hash, count(*) AS n FROM (SELECT sha256(task_id || '|' || prompt) AS h FROM tk WHERE task_id IS NOT NULL)")(
    lambda s, d: corpus.hash_of_all(task_rows(s, d).select(F.sha2(F.concat_ws("|", "task_id", "prompt").cast("binary"), 256).alias("h")), "h"))

# --- splits -------------------------------------------------------------------------------------------------------------------

# The first 16 hex digits as a number: two halves, as DuckDB has no unsigned cast of hex text.
_BUCKET = "((('0x' || substr({h}, 1, 8))::BIGINT::HUGEINT * 4294967296 + ('0x' || substr({h}, 9, 8))::BIGINT) % 1000000)"
_H = "sha256(coalesce(salt, '') || chr(0) || task_id)"
_AS = f"sa AS (SELECT task_id, split, {_BUCKET.format(h='h')}::INT AS bucket FROM (SELECT {sql_id('task_id')} AS task_id, max({sql_split('split')}) AS split, max(salt) AS salt FROM split_manifest GROUP BY 1) m, LATERAL (SELECT sha256(encode(salt) || '\\x00'::BLOB || encode(task_id)) AS h))"
_RULE = "CASE WHEN bucket / 1000000.0 < 0.6 THEN 'train' WHEN bucket / 1000000.0 < 0.8 THEN 'val' ELSE 'test' END"


def _manifest(s, d):
    return load(s, d, "split_manifest").groupBy(norm_id("task_id").alias("task_id")).agg(F.max(norm_split("split")).alias("split"), F.max("salt").alias("salt"))


for _n in ("split_assign",):
    query(_n, f"WITH {_AS} SELECT task_id, bucket, {_RULE} AS split FROM sa")(lambda s, d: _manifest(s, d).select("task_id", corpus.bucket(F.col("task_id"), F.col("salt")).alias("bucket"), corpus.assign(F.col("task_id"), F.col("salt")).alias("split")))
query("split_build", f"WITH {_AS} SELECT split, count(*) AS n, min(bucket) AS least, max(bucket) AS most FROM (SELECT bucket, {_RULE} AS split FROM sa) GROUP BY 1")(
    lambda s, d: _manifest(s, d).select(corpus.bucket(F.col("task_id"), F.col("salt")).alias("bucket"), corpus.assign(F.col("task_id"), F.col("salt")).alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("bucket").alias("least"), F.max("bucket").alias("most")))
query("split_verify", f"WITH {_AS}, {_TASKS} SELECT 'tampered' AS problem, task_id FROM sa WHERE split <> {_RULE} UNION ALL SELECT 'missing', task_id FROM tk WHERE task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM sa)")(
    lambda s, d: (lambda m: m.where(F.col("split") != corpus.assign(F.col("task_id"), F.col("salt"))).select(F.lit("tampered").alias("problem"), "task_id").unionByName(task_rows(s, d).select("task_id").join(m, "task_id", "left_anti").select(F.lit("missing").alias("problem"), "task_id")))(_manifest(s, d)))
query("split_tolerance", f"WITH m AS (SELECT {sql_id('task_id')} AS task_id, max({sql_split('split')}) AS split FROM split_manifest GROUP BY 1), t AS (SELECT count(*) AS total FROM m) SELECT w.split, count(m.split) AS n, round(count(m.split)::DOUBLE / total, 6) AS share, target, round(greatest(0.01, 3.5 * sqrt(target * (1 - target) / total)), 6) AS allowed, abs(count(m.split)::DOUBLE / total - target) <= greatest(0.01, 3.5 * sqrt(target * (1 - target) / total)) AS ok FROM (VALUES ('train', 0.6::DOUBLE), ('val', 0.2), ('test', 0.2)) w(split, target) CROSS JOIN t LEFT JOIN m USING (split) GROUP BY w.split, total, target")(
    lambda s, d: rounded(corpus.split_sizes(_manifest(s, d))))

# --- features -----------------------------------------------------------------------------------------------------------------

_CNT = lambda t, w: f"((length({t}) - length(replace({t}, '{w}', ''))) / {len(w)})::DOUBLE"
_P, _V, _E = "coalesce(prompt, '')", "coalesce(visible_tests, '')", "coalesce(entrypoint, '')"
_VL = f"len([x FOR x IN regexp_split_to_array({_V}, '\\n') IF trim(x) <> ''])::DOUBLE"
_WORDS = f"regexp_extract_all({_P}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')"
_FSQL = {
    **_HSQL,
    "d0_prompt_chars": f"length({_P})::DOUBLE", "d0_prompt_words": f"len({_WORDS})::DOUBLE", "d0_prompt_sentences": f"len([x FOR x IN regexp_split_to_array(trim(regexp_replace({_P}, '\\s', ' ', 'g')), '[.!?]+') IF trim(x) <> ''])::DOUBLE",
    "d0_prompt_mean_word_len": f"coalesce(list_sum([length(x) FOR x IN {_WORDS}])::DOUBLE / nullif(len({_WORDS}), 0), 0)", "d0_n_visible_tests": _VL, "d0_visible_test_chars": f"length({_V})::DOUBLE", "d0_visible_assert_density": f"coalesce({_CNT(_V, 'assert')} / nullif({_VL}, 0), 0)",
    "d0_algorithmic_keywords": " + ".join(_CNT(f"lower({_P})", w) for w in features.ALGORITHMIC_WORDS), "d0_loop_keywords": f"len([x FOR x IN {_WORDS} IF lower(x) IN ({', '.join(repr(w) for w in features.LOOP_WORDS)})])::DOUBLE", "d0_has_code_block": f"contains({_P}, '```')::INT::DOUBLE",
    "d0_digit_density": f"coalesce(len(regexp_extract_all({_P}, '\\p{{Nd}}'))::DOUBLE / nullif(length({_P}), 0), 0)", "d0_entrypoint_len": f"length({_E})::DOUBLE", "d0_entrypoint_words": f"len([x FOR x IN string_split({_E}, '_') IF x <> ''])::DOUBLE",
}


def _feature_query(name: str, cols: list[str]) -> None:
    body = ", ".join(f"round({_FSQL[c]}, 6) AS {c}" for c in cols)
    query(name, f"WITH {_TASKS} SELECT task_id, {body} FROM tk WHERE task_id IS NOT NULL")(lambda s, d: rounded(features.build(task_rows(s, d), cols, ["task_id"])))


_feature_query("h_prompt_features", [c for c in _FSQL if c.startswith("h_")])
for _c in [c for c in _FSQL if c.startswith("d0_")]:
    _feature_query(_c, [_c])
_LINES = "len([x FOR x IN regexp_split_to_array({0}, '\\n') IF trim(regexp_replace(x, '\\s', ' ', 'g')) <> ''])"
_CODE = "coalesce(code, '')"
_HAS, _VP = "coalesce(visible_total > 0, FALSE)", "coalesce(visible_passed, 0)"
_D1 = {
    "d1_visible_pass_rate": f"CASE WHEN {_HAS} THEN {_VP}::DOUBLE / visible_total ELSE 0.0 END", "d1_visible_all_passed": f"({_HAS} AND {_VP} = visible_total)::INT", "d1_visible_none_passed": f"({_HAS} AND {_VP} = 0)::INT", "d1_has_visible_tests": f"{_HAS}::INT", "d1_visible_failed_count": f"CASE WHEN {_HAS} THEN greatest(0, visible_total - {_VP}) ELSE 0 END",
    "d1_code_chars": f"length({_CODE})", "d1_code_lines": _LINES.format(_CODE), "d1_code_parses": "coalesce(code_parses, FALSE)::INT", "d1_code_has_todo": "(" + " OR ".join(f"contains(lower({_CODE}), '{m}')" for m in features.TODO_MARKS) + ")::INT",
    **{f"d1_finish_{r}": f"coalesce(finish_reason = '{r}', FALSE)::INT" for r in features.FINISH_REASONS}, "d1_decode_tokens": "coalesce(decode_tokens, 0)", "d1_prefill_tokens": "coalesce(prefill_tokens, 0)", "d1_extraction_was_bare": "starts_with(coalesce(extract_strategy, ''), 'bare')::INT", "d1_had_error": "(trim(coalesce(error, '')) <> '')::INT", "d1_hack_flag_count": "coalesce(len(hack_flags), 0)",
}
for _name, _cols in (("d1_visible", [c for c in _D1 if "visible" in c]), ("d1_code", [c for c in _D1 if "_code_" in c]), ("d1_generation", [c for c in _D1 if "visible" not in c and "_code_" not in c])):
    query(_name, f"WITH {R} SELECT rollout_id, " + ", ".join(f"round(({_D1[c]})::DOUBLE, 6) AS {c}" for c in _cols) + " FROM r")(lambda s, d, cols=_cols: rounded(features.build(rollouts(s, d, *_D1COLS), cols, ["rollout_id"])))
_D0S = [c for c in _FSQL if c.startswith("d0_")]
query("feat_constant", f"WITH {_TASKS}, x AS (SELECT " + ", ".join(f"{_FSQL[c]} AS {c}" for c in _D0S) + " FROM tk WHERE task_id IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(max({c}) - min({c}) = 0, TRUE) AS constant FROM x" for c in _D0S))(
    lambda s, d: features.constant_columns(features.build(task_rows(s, d), _D0S, ["task_id"]), _D0S))
_NUMBERS = ["wall_ms", "gpu_seconds", "imputed_latency_s", "grade_duration_s", "prefill_tokens", "decode_tokens", "visible_passed", "visible_total", "hidden_passed", "hidden_total", "ladder_step", "batch_size", "seed", "schema_version"]
query("feat_guard_finite", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL OR {c}::VARCHAR IN ('nan', '-nan', 'inf', '-inf')) AS bad FROM generations" for c in _NUMBERS))(
    lambda s, d: features.not_finite(load(s, d, "generations").select(*[F.col(c).cast("double").alias(c) for c in _NUMBERS]), _NUMBERS))
query("feat_groups", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{f.group}', '{f.point}')" for n, f in features.REGISTRY.items()) + ") t(feature, feature_group, point)")(
    lambda s, d: s.createDataFrame([(n, f.group, f.point) for n, f in features.REGISTRY.items()], "feature string, feature_group string, point string"))
query("tokens_approx", f"WITH {R} SELECT rollout_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, round_even(length(text) / 3.6::DOUBLE, 0)::INT) END AS tokens FROM r")(lambda s, d: rollouts(s, d, "text").select("rollout_id", features.tokens_approx(F.col("text")).alias("tokens")))
query("extract_fence_count", f"WITH {R} SELECT rollout_id, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '```', ''))) // 3 AS fences, ((length(coalesce(text, '')) - length(replace(coalesce(text, ''), '```', ''))) // 3) % 2 = 1 AS truncated FROM r")(
    lambda s, d: rollouts(s, d, "text").select("rollout_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("```")).cast("long").alias("fences")).withColumn("truncated", F.col("fences") % 2 == 1))
query("price_api", f"WITH {R} SELECT rollout_id, round((prefill_tokens * 3.0 + decode_tokens * 15.0) / 1e6, 9) AS usd FROM r")(lambda s, d: rollouts(s, d, "prefill_tokens", "decode_tokens").select("rollout_id", F.round(cost.price_api(F.col("prefill_tokens"), F.col("decode_tokens"), F.lit(0), 3.0, 15.0), 9).alias("usd")))
query("hack_flags_norm", f"WITH {R} SELECT rollout_id, array_to_string(list_sort(coalesce(hack_flags, [])), ',') AS flags FROM r")(
    lambda s, d: rollouts(s, d, "hack_flags").select("rollout_id", F.array_join(F.array_sort(F.coalesce(F.from_json(F.to_json("hack_flags"), "array<string>"), F.array().cast("array<string>"))), ",").alias("flags")))
query("float_close", f"WITH {R} SELECT rollout_id, abs(gpu_seconds - imputed_latency_s) <= greatest(1e-9 * greatest(abs(gpu_seconds), abs(imputed_latency_s)), 0.05) AS close FROM r")(
    lambda s, d: rollouts(s, d, "gpu_seconds", "imputed_latency_s").select("rollout_id", (F.abs(F.col("gpu_seconds") - F.col("imputed_latency_s")) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs("gpu_seconds"), F.abs("imputed_latency_s")), F.lit(0.05))).alias("close")))

# --- code and grading ---------------------------------------------------------------------------------------------------------


def _with_entry(s, d, *cols):
    return rollouts(s, d, "task_id", *cols).join(task_rows(s, d).select("task_id", "entrypoint", "visible_tests", "hidden_tests"), "task_id", "left")


query("topk_block")(lambda s, d: code.best_blocks(_with_entry(s, d, "text")))
for _n in ("extract_code",):
    query(_n)(lambda s, d: code.extracted(_with_entry(s, d, "text")).select("rollout_id", "strategy", "n_blocks", "parses", "defines_entrypoint", F.md5(F.col("code").cast("binary")).alias("code_md5")))
query("d1_code_ast_nodes")(lambda s, d: code.shapes(_with_entry(s, d, "code")))
query("count_asserts", f"WITH {_TASKS} SELECT task_id, len(regexp_extract_all(coalesce(visible_tests, ''), '(?m)^assert\\b'))::INT AS n_asserts FROM tk WHERE task_id IS NOT NULL")(lambda s, d: code.asserts(task_rows(s, d)))
query("hack_scan")(lambda s, d: code.hack_scan(_with_entry(s, d, "code")).select("rollout_id", F.array_join("flags", ",").alias("flags")))
def _grades(s, d):
    """The grade of every rollout whose task has tests. Rollouts of a task with equal code follow each other and are graded once. What
    needs a process of its own is spread over all cores again, since any of it may take all of its time."""
    n = max(int(s.conf.get("spark.sql.shuffle.partitions")), s.sparkContext.defaultParallelism)
    x = _with_entry(s, d, "code").where("visible_tests IS NOT NULL OR hidden_tests IS NOT NULL")
    order = ["task_id", F.xxhash64("code")]
    quick = cut(code.quickly_graded(x.repartitionByRange(n, *order).sortWithinPartitions(*order)))
    left = F.xxhash64("code", "visible_tests", "hidden_tests")
    slow = cut(code.graded(quick.where("error_class IS NULL").repartition(n, left).sortWithinPartitions(left)))
    return quick.where("error_class IS NOT NULL").select(*slow.columns).unionByName(slow)


query("grade_run")(_grades)


@query("grade_one")
def grade_one(s, d):
    """The grade of every rollout by tier."""
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(f"{t}_passed").alias("passed"), F.col(f"{t}_total").alias("total")) for t in ("visible", "hidden")])
    return _grades(s, d).select("rollout_id", "error_class", "tamper", F.explode(tiers).alias("t")).select("rollout_id", "t.*", "error_class", "tamper")


query("hack_tamper")(lambda s, d: _grades(s, d).groupBy("tamper").agg(F.count(F.lit(1)).alias("n")))
query("py_literal")(lambda s, d: code.literals(load(s, d, "decisions").select(F.concat_ws("|", "policy_name", "task_id", "arm", "lam").alias("k"), "p_pass"), "k", "p_pass"))


@query("corpus_convert")
def corpus_convert(s, d):
    """A suite for every task that some rollout solved, from what that solution gives for the calls of its visible tests."""
    won = rollouts(s, d, "task_id", "code", "hidden_passed", "hidden_total").where("hidden_total > 0 AND hidden_passed = hidden_total AND code IS NOT NULL")
    one = won.groupBy("task_id").agg(F.min_by("code", "rollout_id").alias("code"))
    return code.converted(one.join(task_rows(s, d).select("task_id", "visible_tests"), "task_id").repartition(F.xxhash64("task_id")))


_CELLS = "SELECT task_id, prompt FROM tk WHERE task_id IS NOT NULL UNION ALL SELECT task_id || '#blank', ' ' FROM tk WHERE task_id IS NOT NULL"
query("backend_contain", f"WITH {_TASKS} SELECT task_id AS cell, CASE WHEN trim(coalesce(prompt, '')) = '' THEN 'error' ELSE 'stop' END AS finish_reason, CASE WHEN trim(coalesce(prompt, '')) = '' THEN 'ValueError: an empty prompt' END AS error FROM ({_CELLS})")(
    lambda s, d: _contained(s, d))


def _contained(s: SparkSession, d: str) -> DataFrame:
    """Every task and a blank twin of each, asked of a backend that fails for blank ones: an answer or a failure for each request."""
    t = task_rows(s, d).select(F.col("task_id").alias("cell"), "prompt")
    return sweep.generate(t.unionByName(t.select(F.concat("cell", F.lit("#blank")).alias("cell"), F.lit(" ").alias("prompt"))), "echo", batch=1).select("cell", "finish_reason", "error")


query("grade_project", f"WITH {R} SELECT rollout_id, hidden_passed IS NOT NULL AS graded, coalesce(hidden_passed, 0) AS hidden_passed FROM r")(lambda s, d: rollouts(s, d, "hidden_passed").select("rollout_id", F.col("hidden_passed").isNotNull().alias("graded"), F.coalesce("hidden_passed", F.lit(0)).alias("hidden_passed")))


@query("ml_characterize")
def ml_characterize(s, d):
    """A grid of probes on a mock server, and the coefficients fitted to it."""
    p = s.range(48).select(F.lit("mock").alias("model_id"), F.lit(1).alias("batch"), (50 + (F.col("id") % 7) * 90).cast("int").alias("prefill_tokens"), (8 + (F.col("id") % 11) * 40).cast("int").alias("decode_tokens"), "id")
    return rounded(cost.fit(p.withColumn("seconds", 0.04 + F.col("prefill_tokens") * 0.00008 + F.col("decode_tokens") * 0.006), ["id"]))


@query("stream_first_deliveries", f"SELECT count(DISTINCT {sql_id('rollout_id')}) AS rollouts FROM generations")
def stream_first_deliveries(s, d):
    """Deliveries as a stream of files, each rollout once, into a folder, and what came of it."""
    from tidemark.streaming import ingest

    g = load(s, d, "generations").select("rollout_id", "ingested_at")
    src = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    g.write.parquet(f"{src}/in")
    x = ingest.follow(s, f"{src}/in", g.schema).withColumn("rollout_id", norm_id("rollout_id"))
    ingest.drain(ingest.once(x, "rollout_id", "ingested_at", "3650 days"), f"{src}/out", f"{src}/state")
    return s.read.parquet(f"{src}/out").agg(F.count(F.lit(1)).alias("rollouts"))

