import pytest
from pyspark.sql import functions as F

from tidemark.operators import corpus, cost, features, sweep, validate


def base(spark, n=24):
    rows = [(1, f"{i:016x}", "2026-02-02-ca8ca4f-a530e9", f"t{i // 6}", ["small", "large"][i % 2], i // 2 % 3, "h", "train", "stop", "sweep", 8, 0, None, 1, 2, 1, 2, 5, 9) for i in range(n)]
    return spark.createDataFrame(rows, "schema_version int, rollout_id string, run_id string, task_id string, arm string, seed int, params_hash string, split string, finish_reason string, mode string, batch_size int, ladder_step int, parent_rollout_id string, visible_passed int, visible_total int, hidden_passed int, hidden_total int, prefill_tokens int, decode_tokens int")


def one(c, bad, good):
    return F.when(F.col("rollout_id") == f"{3:016x}", bad).otherwise(good)


CORRUPT = {
    "duplicate_rollout_id": lambda d: d.unionByName(d.limit(2)),
    "split_span": lambda d: d.withColumn("split", one("split", F.lit("test"), F.col("split"))),
    "orphan_ladder_step": lambda d: d.withColumn("ladder_step", one("x", F.lit(1), F.col("ladder_step"))),
    "impossible_counts": lambda d: d.withColumn("hidden_passed", one("x", F.lit(9), F.col("hidden_passed"))),
    "control_characters": lambda d: d.withColumn("task_id", one("x", F.lit("a\x00b"), F.col("task_id"))),
    "serving_batched": lambda d: d.withColumn("mode", one("x", F.lit("serving"), F.col("mode"))),
    "single_arm": lambda d: d.where("arm = 'small'"),
}


def test_clean_rows_pass(spark):
    d = base(spark)
    assert validate.errors(d, "rollout_id").count() == 0 and validate.integrity(d).count() == 0
    assert validate.grid_gaps(d).first()["complete"]


@pytest.mark.parametrize("issue", CORRUPT)
def test_every_corruption_is_told_by_name_and_refused(spark, issue):
    d = CORRUPT[issue](base(spark))
    found = {r["issue"] for r in validate.integrity(d).collect()}
    assert issue in found
    with pytest.raises(validate.Refused, match=issue):
        validate.refuse_if_any(validate.integrity(d))


@pytest.mark.parametrize("change, message", [
    ({"hidden_total": None}, "hidden: passed and total together"), ({"split": "dev"}, "split: enum"), ({"run_id": "x"}, "run_id: pattern"), ({"decode_tokens": -5}, "decode_tokens: minimum"),
    ({"ladder_step": 1}, "ladder: step without parent"), ({"mode": "serving"}, "serving: batched"), ({"arm": None}, "arm: required"), ({"task_id": ""}, "task_id: empty"), ({"schema_version": 2}, "schema_version: enum"),
])
def test_each_rule_names_itself(spark, change, message):
    d = base(spark, 1)
    for c, v in change.items():
        d = d.withColumn(c, F.lit(v).cast(d.schema[c].dataType))
    assert message in [r["error"] for r in validate.errors(d, "rollout_id").collect()]


def test_versions_that_are_mixed_are_told_before_unsupported_ones(spark):
    d = spark.createDataFrame([(1,), (7,)], "schema_version int")
    assert validate.version_state(d).first()["state"] == "mixed"
    assert validate.version_state(d.where("schema_version = 7")).first()["state"] == "unsupported"
    assert validate.version_state(d.limit(0)).first()["state"] == "empty"


def test_labels_are_gone_from_features(spark):
    f, y = validate.strip_labels(base(spark).withColumn("_synth_x", F.lit(1)))
    assert not set(f.columns) & {"hidden_passed", "hidden_total", "_synth_x"} and y.columns == ["rollout_id", "hidden_passed", "hidden_total"]
    with pytest.raises(ValueError):
        features.feature("bad", "D1", "hidden_passed")
    with pytest.raises(KeyError):
        features.build(base(spark).select("rollout_id"), ["d1_code_chars"], ["rollout_id"])
    assert validate.allowlist(["code", "novel"], "D1") == [] and validate.allowlist(["novel"], "D1", strict=True) == ["late:novel"]


def test_splits_don_t_move_when_the_corpus_grows(spark):
    ids = spark.range(400).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("task_id"))
    a = {r[0]: r[1] for r in ids.select("task_id", corpus.assign(F.col("task_id"), F.lit("s"))).collect()}
    import hashlib

    for t, s in a.items():
        at = int.from_bytes(hashlib.sha256(f"s\0{t}".encode()).digest()[:8], "big") % 1_000_000 / 1_000_000
        assert s == ("train" if at < 0.6 else "val" if at < 0.8 else "test")
    m = spark.createDataFrame(list(a.items()), "task_id string, split string")
    assert corpus.verify(m, ids, "s").count() == 0 and all(r["ok"] for r in corpus.split_sizes(m).collect())
    tampered = m.withColumn("split", F.when(F.col("task_id") == "t7", F.lit("test" if a["t7"] != "test" else "val")).otherwise(F.col("split")))
    assert [r["task_id"] for r in corpus.verify(tampered, ids, "s").collect()] == ["t7"]


def test_corpus_hash_doesn_t_depend_on_order(spark):
    d = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "task_id string, prompt string")
    assert corpus.corpus_hash(d, "task_id", "prompt").first() == corpus.corpus_hash(d.orderBy(F.desc("task_id")), "task_id", "prompt").first()


def test_least_squares_gives_planted_coefficients_back_and_refuses_rank_two(spark):
    p = spark.range(60).select(F.lit("m").alias("model_id"), F.lit(1).alias("batch"), (F.col("id") % 7 * 10).cast("int").alias("prefill_tokens"), (F.col("id") % 11 * 5).cast("int").alias("decode_tokens"), "id")
    y = p.withColumn("seconds", 0.5 + F.col("prefill_tokens") * 0.25 + F.col("decode_tokens") * 0.125)
    f = cost.fit(y, ["id"]).first()
    assert abs(f["intercept_s"] - 0.5) < 1e-8 and abs(f["prefill_s_per_token"] - 0.25) < 1e-9 and f["holdout_n"] == 15 and f["holdout_r2"] > 0.999999
    assert cost.fit(y.withColumn("decode_tokens", F.col("prefill_tokens") * 2), ["id"]).count() == 0
    assert cost.fit(y.limit(5), ["id"]).count() == 0


def test_a_model_without_coefficients_is_left_unpriced(spark):
    c = spark.createDataFrame([("m", 8, 1.0, 0.1, 0.2), ("m", 32, 9.0, 9.0, 9.0)], "model_id string, batch int, intercept_s double, prefill_s_per_token double, decode_s_per_token double")
    x = {r["model_id"]: r for r in cost.impute(spark.createDataFrame([("m", 10, 10), ("other", 1, 1), (None, 1, 1)], "model_id string, prefill_tokens int, decode_tokens int"), c).collect()}
    assert abs(x["m"]["imputed_s"] - 4.0) < 1e-9 and abs(x["m"]["imputed_gpu_s"] - 3.0) < 1e-9 and x["other"]["imputed_s"] is None and x[None]["imputed_gpu_s"] is None


def test_resume_leaves_out_what_is_done(spark):
    planned = spark.createDataFrame([("t", "a", s, "h") for s in range(4)], "task_id string, arm string, seed int, params_hash string")
    rows = spark.createDataFrame([("t", "a", 0, "h", "stop"), ("t", "a", 1, "h", "error"), ("t", "a", 2, "h", "error"), ("t", "a", 2, "h", "length"), ("t", "a", 3, "other", "stop")], "task_id string, arm string, seed int, params_hash string, finish_reason string")
    assert sorted(r["seed"] for r in sweep.pending(planned, rows).collect()) == [1, 3]
    assert sorted(r["seed"] for r in sweep.pending(planned, rows, retry_errors=False).collect()) == [3]
    assert sweep.pending(planned, rows.limit(0)).count() == 4


def test_planted_optimum_is_the_best_value(spark):
    s = sweep.synth(spark, 50, {"small": (1.4, 1.0), "large": (3.2, 6.0)})
    best = sweep.synth_optimum(s, 0.05).agg(F.avg("value")).first()[0]
    for arm in ("small", "large"):
        assert best >= s.where(F.col("arm") == arm).agg(F.avg(F.col("p") - 0.05 * F.col("cost"))).first()[0] - 1e-9


def test_the_twelve_corruptions_are_all_noticed(spark):
    from tidemark.operators import adversarial

    clean = base(spark, 72).withColumn("params_hash", F.lit("h"))
    assert adversarial.reaction(clean) == []
    want = {
        "mixed_schema_versions": "versions:mixed", "duplicate_rollout_ids": "duplicate_rollout_id", "split_leakage": "split_span", "ungraded_rows_as_zero": "ungraded", "half_graded_pair": "hidden: passed and total together", "orphan_ladder_step": "orphan_ladder_step",
        "serving_row_batched": "serving_batched", "negative_and_impossible_counts": "impossible_counts", "unicode_and_nulls": "control_characters", "single_arm_only": "single_arm", "unsealed_run": "incomplete_grid", "dirty_run_id": "dirty",
    }
    assert want.keys() == adversarial.CASES.keys()
    for case, told in want.items():
        assert told in adversarial.reaction(adversarial.CASES[case](clean)), case
