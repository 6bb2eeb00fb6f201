"""The row contract: schema rules, cross-field rules, whole-table integrity, and refusal of what doesn't hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.normalize import norm_id

# The vocabulary of finish reasons, and what backends call them.
FINISH = {"error": "error", "unknown": "unknown", "stop": "stop", "length": "length", "abort": "error", "content_filter": "refusal", "tool_calls": "stop", "end_turn": "stop", "stop_sequence": "stop", "max_tokens": "length", "refusal": "refusal", "tool_use": "stop", "pause_turn": "stop", "model_context_window_exceeded": "length"}
# The grammar of run ids, the splits, the modes, and the schema version.
RUN_ID = r"^\d{4}-\d{2}-\d{2}-[0-9a-f]{7}-[0-9a-f]{6}(-dirty)?$"
SPLITS, MODES, VERSIONS = ["train", "val", "test"], ["sweep", "serving"], [1]
REQUIRED = ["schema_version", "rollout_id", "run_id", "task_id", "arm", "seed", "params_hash", "split", "finish_reason", "mode", "batch_size"]
FLOORS = {"prefill_tokens": 0, "decode_tokens": 0, "wall_ms": 0, "batch_size": 1, "ladder_step": 0, "gpu_seconds": 0, "imputed_latency_s": 0, "visible_passed": 0, "visible_total": 0, "hidden_passed": 0, "hidden_total": 0, "grade_duration_s": 0}
IDENTITY = ["rollout_id", "run_id", "task_id", "arm", "params_hash"]
CONTROL = "[\\x00-\\x1f]"

# Columns that are labels, that may be features at either decision point, and that never may.
LABELS = ["hidden_passed", "hidden_total", "_solved"]
D0_COLUMNS = ["task_id", "dataset", "split", "arm", "seed", "params_hash"]
D1_COLUMNS = [*D0_COLUMNS, "text", "code", "code_parses", "extract_strategy", "finish_reason", "prefill_tokens", "decode_tokens", "visible_passed", "visible_total", "_visible_frac"]
NEVER = ["wall_ms", "gpu_seconds", "imputed_latency_s", "grade_duration_s", "hack_flags", "error_class", "rollout_id", "run_id", "created_at"]


class Refused(ValueError):
    """A table that must not be read further."""


def finish_reason(c: Column | str) -> Column:
    """A backend's finish reason in the shared vocabulary; NULL and what isn't known are "unknown"."""
    c = F.col(c) if isinstance(c, str) else c
    table = F.create_map(*[F.lit(x) for kv in FINISH.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.lit("unknown"))


def _rules(columns: list[str]) -> list[tuple[str, Column]]:
    """(message, whether it is broken) of every schema rule and cross-field rule whose columns there are."""
    have = set(columns)
    c = F.col
    out = [(f"{x}: required", c(x).isNull()) for x in REQUIRED if x in have]
    out += [(f"{x}: empty", c(x) == "") for x in ("task_id", "arm", "params_hash") if x in have]
    if "rollout_id" in have:
        out.append(("rollout_id: pattern", ~c("rollout_id").rlike("^[0-9a-f]{16}$")))
    if "run_id" in have:
        out.append(("run_id: pattern", ~c("run_id").rlike(RUN_ID)))
    out += [(f"{x}: enum", ~c(x).isin(ok)) for x, ok in (("split", SPLITS), ("mode", MODES), ("finish_reason", ["stop", "length", "refusal", "error", "unknown"]), ("schema_version", VERSIONS)) if x in have]
    out += [(f"{x}: minimum", (c(x) < v) | (F.isnan(c(x)) if x in ("wall_ms", "gpu_seconds", "imputed_latency_s", "grade_duration_s") else F.lit(False))) for x, v in FLOORS.items() if x in have]
    for t in ("visible", "hidden"):
        if {f"{t}_passed", f"{t}_total"} <= have:
            out.append((f"{t}: passed and total together", c(f"{t}_passed").isNull() != c(f"{t}_total").isNull()))
            out.append((f"{t}: passed over total", c(f"{t}_passed") > c(f"{t}_total")))
    if {"ladder_step", "parent_rollout_id"} <= have:
        out.append(("ladder: step without parent", (c("ladder_step") > 0) & c("parent_rollout_id").isNull()))
        out.append(("ladder: parent without step", (c("ladder_step") == 0) & c("parent_rollout_id").isNotNull()))
    if {"mode", "batch_size"} <= have:
        out.append(("serving: batched", (c("mode") == "serving") & (c("batch_size") != 1)))
    return out


def violations(df: DataFrame) -> Column:
    """All broken rules of a row, in order; an empty array if it is valid."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(msg)) for msg, bad in _rules(df.columns)]))


def errors(df: DataFrame, key: str) -> DataFrame:
    """(key, error): every error of every row, not only the first."""
    return df.select(F.col(key).alias(key), F.explode(violations(df)).alias("error"))


def difficulty_unsourced(tasks: DataFrame) -> DataFrame:
    """Tasks with a difficulty and no word of where it comes from. NaN is no difficulty."""
    return tasks.where("difficulty IS NOT NULL AND NOT isnan(difficulty) AND difficulty_provenance IS NULL")


def version_state(df: DataFrame) -> DataFrame:
    """One row: distinct versions, whether they are mixed (told first), and whether they are supported."""
    v = F.array_sort(F.collect_set("schema_version"))
    return df.agg(v.alias("versions")).select(F.array_join(F.transform("versions", lambda x: x.cast("string")), ",").alias("versions"), F.when(F.size("versions") > 1, "mixed").when(F.size("versions") == 0, "empty").when(F.forall("versions", lambda x: x.isin(VERSIONS)), "ok").otherwise("unsupported").alias("state"))


# --- integrity: each is a frame (issue, example) ------------------------------------------------------------------------------


def _issue(df: DataFrame, name: str, example: Column) -> DataFrame:
    return df.select(F.lit(name).alias("issue"), example.cast("string").alias("example"))


def duplicate_ids(df: DataFrame) -> DataFrame:
    return _issue(df.groupBy(norm_id("rollout_id").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND k IS NOT NULL"), "duplicate_rollout_id", F.col("k"))


def split_span(df: DataFrame) -> DataFrame:
    """Tasks in more than one split, over all splits, before anything is filtered."""
    return _issue(df.groupBy("task_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a < b"), "split_span", F.col("task_id"))


def orphans(df: DataFrame) -> DataFrame:
    """Rows whose parent isn't in the table, or that are repairs without one."""
    ids = df.select(F.col("rollout_id").alias("parent_rollout_id")).distinct()
    kids = df.where("ladder_step > 0 OR parent_rollout_id IS NOT NULL")
    return _issue(kids.join(ids, "parent_rollout_id", "left_anti"), "orphan_ladder_step", F.col("rollout_id"))


def impossible_counts(df: DataFrame) -> DataFrame:
    c = F.col
    bad = reduce(lambda a, b: a | b, [F.coalesce(c(x) < 0, F.lit(False)) for x in ("visible_passed", "visible_total", "hidden_passed", "hidden_total", "decode_tokens", "prefill_tokens")] + [F.coalesce(c(f"{t}_passed") > c(f"{t}_total"), F.lit(False)) for t in ("visible", "hidden")])
    return _issue(df.where(bad), "impossible_counts", c("rollout_id"))


def control_characters(df: DataFrame) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.col(x).rlike(CONTROL), F.lit(False)) for x in IDENTITY])
    return _issue(df.where(bad), "control_characters", F.regexp_replace("rollout_id", CONTROL, "?"))


def serving_batched(df: DataFrame) -> DataFrame:
    return _issue(df.where("mode = 'serving' AND batch_size > 1"), "serving_batched", F.col("rollout_id"))


def single_arm(df: DataFrame) -> DataFrame:
    return _issue(df.agg(F.count_distinct("arm").alias("n")).where("n < 2"), "single_arm", F.col("n"))


CHECKS = {f.__name__: f for f in (duplicate_ids, split_span, orphans, impossible_counts, control_characters, serving_batched, single_arm)}


def integrity(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(issue, n, examples): all issues together, with up to three examples each, chosen by order and without gathering the others."""
    all_of = reduce(DataFrame.unionByName, [f(df) for k, f in CHECKS.items() if k not in skip])
    return three_examples(all_of, "issue", "example")


def three_examples(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, examples): the three least distinct values of each key, joined by blanks. Bounded: distinct first, then ranked within
    64 hashed parts, so a key with a third of all rows isn't sorted in one task."""
    from pyspark.sql import Window as W

    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    part = W.partitionBy(key, F.pmod(F.xxhash64(value), F.lit(64))).orderBy(value)
    few = df.select(key, value).distinct().withColumn("r", F.row_number().over(part)).where("r <= 3")
    ex = few.groupBy(key).agg(F.array_join(F.slice(F.array_sort(F.collect_list(value)), 1, 3), " ").alias("examples"))
    return n.join(ex, key, "left").select(key, "n", "examples")


def refuse_if_any(issues: DataFrame) -> None:
    """Raises with the names of all issues at once."""
    found = [r[0] for r in issues.select("issue").distinct().orderBy("issue").collect()]
    if found:
        raise Refused("; ".join(found))


def grid_gaps(df: DataFrame) -> DataFrame:
    """One row: whether rows are tasks times arms times seeds, and seeds are 0 .. k - 1."""
    x = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("task_id").alias("tasks"), F.count_distinct("arm").alias("arms"), F.count_distinct("seed").alias("seeds"), F.min("seed").alias("lo"), F.max("seed").alias("hi"))
    return x.select("rows", "tasks", "arms", "seeds", (F.col("rows") == F.col("tasks") * F.col("arms") * F.col("seeds")).alias("complete"), ((F.col("lo") == 0) & (F.col("hi") == F.col("seeds") - 1)).alias("seeds_in_order"))


def load_warnings(df: DataFrame) -> DataFrame:
    """What a reader should know: truncation over 2 %, any flagged row, any missing cost."""
    x = df.agg(F.avg((F.col("finish_reason") == "length").cast("double")).alias("t"), F.count_if(F.size("hack_flags") > 0).alias("h"), F.count_if(F.col("gpu_seconds").isNull()).alias("c"))
    return x.select(F.round("t", 6).alias("truncation_rate"), (F.col("t") > 0.02).alias("warn_truncation"), F.col("h").alias("hacked"), F.col("c").alias("cost_missing"))


def strip_labels(df: DataFrame, key: str = "rollout_id") -> tuple[DataFrame, DataFrame]:
    """Features without any label or planted column, and the labels apart, by key. The first frame never has the columns at all."""
    labels = [c for c in ("hidden_passed", "hidden_total") if c in df.columns]
    kept = [c for c in df.columns if c not in labels and not c.startswith("_synth_") and c != "_solved"]
    return df.select(*kept), df.select(key, *labels)


def allowlist(used: list[str], point: str, strict: bool = False) -> list[str]:
    """What is wrong with the columns a feature set reads at a decision point. Late columns are told at D0, at D1 only if strict."""
    allowed = set(D0_COLUMNS if point == "D0" else D1_COLUMNS)
    out = [f"label:{c}" for c in sorted(set(used) & set(LABELS))] + [f"never:{c}" for c in sorted(set(used) & set(NEVER))]
    if point == "D0" or strict:
        out += [f"late:{c}" for c in sorted(set(used) - allowed - set(LABELS) - set(NEVER))]
    return out
