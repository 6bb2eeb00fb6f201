"""Sweeps: planned cells, what is left of them, prompts, and a mock model with a planted outcome."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.replay import unit

# Outcomes that need no second attempt.
TERMINAL = ["stop", "length", "refusal"]
CELL = ["task_id", "arm", "seed", "params_hash"]
# The texts of a prompt, in order.
ASK = "Write a Python solution to the following problem."
TESTS, PRIOR = "Your solution must satisfy these tests:", "Your previous attempt:"
CLOSE = "Respond with one ```python code block containing the complete solution."


def plan(tasks: DataFrame, arms: DataFrame, seeds: list[int]) -> DataFrame:
    """(arm, task_id, seed): every cell of a sweep. Arms and seeds are few and come to the tasks, which aren't moved."""
    s = F.explode(F.array(*[F.lit(x) for x in seeds]))
    return tasks.select("task_id").distinct().crossJoin(F.broadcast(arms)).withColumn("seed", s)


def states(rows: DataFrame, retry_errors: bool = True) -> DataFrame:
    """(cell, done, retryable) of logged rows: a cell is done by any terminal row, and by an error too unless errors are retried."""
    t = F.col("finish_reason").isin(TERMINAL)
    x = rows.groupBy(*CELL).agg(F.max(F.coalesce(t, F.lit(False))).alias("terminal"), F.max(F.coalesce(F.col("finish_reason") == "error", F.lit(False))).alias("error"))
    return x.select(*CELL, (F.col("terminal") | (F.col("error") & (not retry_errors))).alias("done"), (F.col("error") & ~F.col("terminal")).alias("retryable"))


def pending(planned: DataFrame, rows: DataFrame, retry_errors: bool = True) -> DataFrame:
    """Planned cells without a done one. The logged side has one row per cell before it is joined."""
    return planned.join(states(rows, retry_errors).where("done").select(*CELL), CELL, "left_anti")


def drift(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(arm, stored, expected, ok): whether each arm's rows have one params_hash, the configured one."""
    s = rows.groupBy("arm").agg(F.min("params_hash").alias("lo"), F.max("params_hash").alias("hi"), F.count_distinct("params_hash").alias("n"))
    return s.join(F.broadcast(expected), "arm").select("arm", F.col("n").alias("stored"), "expected", ((F.col("n") == 1) & (F.col("lo") == F.col("expected"))).alias("ok"))


# The arms of a sweep (name, role of its model, template, whether sampled, step of the ladder, whether it repairs a parent),
# and the templates (id, whether visible tests are shown, whether an earlier attempt is).
ARMS = [
    ("direct_small", "small", "direct_v1", False, 0, False), ("direct_large", "large", "direct_v1", False, 0, False), ("direct_small_notests", "small", "direct_notests_v1", False, 0, False), ("direct_large_notests", "large", "direct_notests_v1", False, 0, False),
    ("probe_small", "small", "direct_v1", True, 0, False), ("repair_small", "small", "repair_v1", False, 1, True), ("repair_large", "large", "repair_v1", False, 1, True),
]
TEMPLATES = [("direct_v1", True, False), ("direct_notests_v1", False, False), ("repair_v1", True, True)]


def arm_table(spark: SparkSession) -> DataFrame:
    """The registered arms with what their templates show; an arm that repairs must be above step 0."""
    arms = spark.createDataFrame(ARMS, "arm string, role string, template_id string, sampled boolean, ladder_step int, requires_parent boolean")
    templates = spark.createDataFrame(TEMPLATES, "template_id string, shows_tests boolean, shows_prior boolean")
    return arms.join(F.broadcast(templates), "template_id").withColumn("sweepable", ~F.col("requires_parent"))


def render(prompt: Column, visible: Column, with_tests: bool = True, prior: Column | None = None) -> Column:
    """A user prompt: the task, its visible tests if shown, and an earlier attempt if there is one."""
    fence = lambda head, body: F.when(F.trim(F.coalesce(body, F.lit(""))) != "", F.concat(F.lit(f"\n\n{head}\n\n```python\n"), F.trim(body), F.lit("\n```"))).otherwise(F.lit(""))
    parts = [F.lit(f"{ASK}\n\n"), F.trim(F.coalesce(prompt, F.lit("")))]
    if with_tests:
        parts.append(fence(TESTS, visible))
    if prior is not None:
        parts.append(fence(PRIOR, prior))
    return F.concat(*parts, F.lit(f"\n\n{CLOSE}"))


def mock(cells: DataFrame, skills: dict[str, float], truncation: float = 0.03, refusal: float = 0.005, error: float = 0.005, jitter: float = 0.1) -> DataFrame:
    """cells(task_id, arm, seed, params_hash) with finish_reason and solved of a mock model: solved where the arm's skill is over the
    task's difficulty, all by hashed units, the same on any engine and in any order."""
    ident = [F.col("task_id"), F.col("arm"), F.col("seed").cast("string"), F.col("params_hash")]
    u = lambda k, *p: unit(F.lit(k), *(p or ident))
    skill = reduce(lambda c, kv: c.when(F.col("arm") == kv[0], kv[1]), skills.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    x = cells.withColumn("finish_reason", F.when(u("error") < error, "error").when(u("refusal") < refusal, "refusal").when(u("trunc") < truncation, "length").otherwise("stop"))
    won = skill > u("difficulty", F.col("task_id")) + (u("jitter") - 0.5) * 2 * jitter
    return x.withColumn("solved", (F.col("finish_reason") == "stop") & won)


def synth(spark: SparkSession, n_tasks: int, arms: dict[str, tuple[float, float]], n_seeds: int = 3, seed: int = 0) -> DataFrame:
    """(task_id, arm, seed, p, cost, solved) with a planted optimum: an arm of (skill, cost) solves a task of hashed difficulty d with
    probability 1 / (1 + exp(-4 (skill - 4 d)))."""
    t = spark.range(n_tasks).select(F.concat(F.lit("synth/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("task_id"))
    a = spark.createDataFrame([(k, *map(float, v)) for k, v in arms.items()], "arm string, skill double, cost double")
    x = t.crossJoin(F.broadcast(a)).withColumn("seed", F.explode(F.array(*[F.lit(i) for i in range(n_seeds)])))
    p = 1 / (1 + F.exp(-4 * (F.col("skill") - 4 * unit(F.lit(f"D|{seed}"), F.col("task_id")))))
    return x.withColumn("p", p).withColumn("solved", unit(F.lit(f"O|{seed}"), F.col("task_id"), F.col("arm"), F.col("seed").cast("string")) < F.col("p")).drop("skill")


def synth_optimum(synth_: DataFrame, lam: float) -> DataFrame:
    """(task_id, arm, value) of the arm with the greatest p - lam * cost; ties to the greater name."""
    u = F.col("p") - lam * F.col("cost")
    return synth_.select("task_id", "arm", u.alias("u")).distinct().groupBy("task_id").agg(F.max_by("arm", F.struct("u", "arm")).alias("arm"), F.max("u").alias("value"))


def with_ladder(rows: DataFrame, arm: str, fix_rate: float) -> DataFrame:
    """rows(rollout_id, task_id, arm, seed, solved, ...) and a repair of each failed row of an arm, solved at a hashed rate."""
    names = rows.columns
    kids = rows.where((F.col("arm") == arm) & ~F.col("solved")).withColumn("parent_rollout_id", F.col("rollout_id")).withColumn("rollout_id", F.substring(F.md5(F.concat(F.lit("repair|"), F.col("rollout_id")).cast("binary")), 1, 16))
    kids = kids.withColumn("solved", unit(F.lit("fix"), F.col("rollout_id")) < fix_rate).withColumn("ladder_step", F.lit(1))
    base = rows.withColumn("parent_rollout_id", F.lit(None).cast("string")).withColumn("ladder_step", F.lit(0))
    return base.unionByName(kids).select(*dict.fromkeys([*names, "parent_rollout_id", "ladder_step"]))


#: Backends by name: each takes a list of requests and gives as many answers, in order.
BACKENDS: dict[str, Callable[[list[dict]], list[dict]]] = {}


def backend(name: str) -> Callable:
    """Registers a backend. A name is taken once."""

    def add(f: Callable[[list[dict]], list[dict]]) -> Callable[[list[dict]], list[dict]]:
        if name in BACKENDS:
            raise ValueError(f"backend {name!r} is registered already")
        BACKENDS[name] = f
        return f

    return add


@backend("echo")
def _echo(requests: list[dict]) -> list[dict]:
    """Answers with the prompt; fails for a batch that holds an empty one."""
    if any(not (r["prompt"] or "").strip() for r in requests):
        raise ValueError("an empty prompt")
    return [{"text": r["prompt"], "finish_reason": "stop"} for r in requests]


def contained(f: Callable[[list[dict]], list[dict]], requests: list[dict]) -> list[dict]:
    """A backend's answers; one failure for each request if it raises or gives another number of answers."""
    try:
        got = f(requests)
        if len(got) != len(requests):
            raise ValueError(f"{len(got)} answers to {len(requests)} requests")
        return got
    except Exception as e:  # a batch never ends a sweep
        return [{"text": "", "finish_reason": "error", "error": f"{type(e).__name__}: {e}"[:200]} for _ in requests]


def generate(cells: DataFrame, name: str, batch: int = 8) -> DataFrame:
    """cells(cell, prompt) to (cell, text, finish_reason, error) by a backend, in chunks, failures held within their chunk."""
    f = BACKENDS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b.astype(object).where(b.notna(), None).to_dict("records")
            out = [{"cell": q["cell"], "error": None, **a} for i in range(0, len(rows), batch) for q, a in zip(rows[i : i + batch], contained(f, rows[i : i + batch]))]
            yield pd.DataFrame(out, columns=["cell", "text", "finish_reason", "error"])

    return cells.select("cell", "prompt").mapInPandas(run, "cell string, text string, finish_reason string, error string")


def preflight(arms: list[str], seeds: list[int], temperature: float, backend_uses_seed: bool, repair_arms: tuple[str, ...] = ("repair",)) -> list[str]:
    """Warnings of a planned sweep; a repair arm can't be swept and is refused."""
    if bad := sorted(set(arms) & set(repair_arms)):
        raise ValueError(f"repair arms can't be swept: {', '.join(bad)}")
    out = []
    if len(seeds) > 1 and temperature == 0:
        out.append("several seeds of a greedy arm give the same text")
    if len(seeds) > 1 and not backend_uses_seed:
        out.append("the backend ignores seeds")
    return out
