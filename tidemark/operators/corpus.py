"""Task corpora: reading with aliases, hashing, salted splits, duplicate prompts, selections."""

from __future__ import annotations

import math

import hashlib

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SPLITS, RATIOS = ("train", "val", "test"), (0.6, 0.2, 0.2)
#: Prompts of fewer characters pose nothing.
LEAST_PROMPT = 40


def task_hash(*parts: Column) -> Column:
    """Hex sha256 of parts, each followed by a NUL."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\x00"))]).cast("binary"), 256)


def rollout_hash(*parts: Column) -> Column:
    """A rollout's identity: the first 16 digits of the hash of its parts."""
    return F.substring(task_hash(*parts), 1, 16)


def hash_of_all(hashes: DataFrame, column: str) -> DataFrame:
    """(corpus_hash, n): one hash over a column of hex hashes in their order, NULLs left out.

    The rows are sorted over all tasks and pass the driver one partition at a time; the hash is sequential by its nature, but nothing
    is gathered in one place."""
    sha, n = hashlib.sha256(), 0
    for r in hashes.where(F.col(column).isNotNull()).select(column).orderBy(column).toLocalIterator():
        sha.update(r[0].encode())
        n += 1
    return hashes.sparkSession.createDataFrame([(sha.hexdigest(), n)], "corpus_hash string, n long")


def corpus_hash(tasks: DataFrame, *columns: str) -> DataFrame:
    """(corpus_hash, n): one hash over the sorted hashes of all tasks, whatever their order."""
    return hash_of_all(tasks.select(task_hash(*[F.col(c) for c in columns]).alias("h")), "h")


def bucket(task_id: Column, salt: Column) -> Column:
    """A number of a million for an id and a salt, from the first 64 bits of their hash."""
    h = F.sha2(F.concat(salt, F.lit("\x00"), task_id).cast("binary"), 256)
    return (F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)") % 1_000_000).cast("int")


def assign(task_id: Column, salt: Column, ratios: tuple[float, ...] = RATIOS) -> Column:
    """The split of an id: a function of id and salt alone, so growth moves nothing."""
    at, out, upto = bucket(task_id, salt) / 1_000_000, None, 0.0
    for name, r in zip(SPLITS, ratios):
        upto += r
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return out.otherwise(SPLITS[-1])


def tolerance(ratio: float, n: Column, sigmas: float = 3.5) -> Column:
    """How far a split of n hashed tasks may be off its ratio."""
    return F.when(n > 0, F.greatest(F.lit(0.01), F.lit(sigmas) * F.sqrt(F.lit(ratio * (1 - ratio)) / n))).otherwise(1.0)


def split_sizes(manifest: DataFrame, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """(split, n, share, target, allowed, ok) of a manifest(task_id, split)."""
    n = manifest.agg(F.count(F.lit(1)).alias("total"))
    per = manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    want = manifest.sparkSession.createDataFrame(list(zip(SPLITS, ratios)), "split string, target double")
    x = want.join(per, "split", "left").fillna(0, ["n"]).crossJoin(F.broadcast(n))
    allowed = None
    for name, r in zip(SPLITS, ratios):
        c = tolerance(r, F.col("total"))
        allowed = F.when(F.col("split") == name, c) if allowed is None else allowed.when(F.col("split") == name, c)
    x = x.withColumn("share", F.col("n") / F.greatest(F.col("total"), F.lit(1))).withColumn("allowed", allowed)
    return x.select("split", "n", "share", "target", "allowed", (F.abs(F.col("share") - F.col("target")) <= F.col("allowed")).alias("ok"))


def verify(manifest: DataFrame, tasks: DataFrame, salt: str) -> DataFrame:
    """(problem, task_id) of a manifest(task_id, split): stored splits that aren't what the rule gives, and tasks it lacks."""
    wrong = manifest.where(F.col("split") != assign(F.col("task_id"), F.lit(salt))).select(F.lit("tampered").alias("problem"), "task_id")
    missing = tasks.select("task_id").distinct().join(manifest, "task_id", "left_anti").select(F.lit("missing").alias("problem"), "task_id")
    return wrong.unionByName(missing)


def read_tasks(raw: DataFrame) -> DataFrame:
    """Tasks from rows with any of the usual column names; a NULL id or prompt is an error column, not a lost row."""
    have = set(raw.columns)
    pick = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(None).cast("string"))
    x = raw.select(pick("task_id", "id", "name").alias("task_id"), pick("prompt", "text", "question").alias("prompt"), pick("entrypoint", "entry_point", "function_name").alias("entrypoint"), pick("visible_tests", "tests", "test").alias("visible_tests"))
    bad = F.when(F.col("task_id").isNull(), "no task_id").when(F.trim(F.coalesce("prompt", F.lit(""))) == "", "no prompt")
    return x.withColumn("error", bad)


def duplicate_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def squeezed(prompt: Column) -> Column:
    """A prompt with its blanks and lines joined by single blanks."""
    return F.trim(F.regexp_replace(F.coalesce(prompt, F.lit("")), r"\s+", " "))


def contamination_filter(tasks: DataFrame) -> DataFrame:
    """(task_id, dataset, reason) of tasks(task_id, dataset, prompt): why a task is dropped, NULL where it is kept.

    The first task by id of equal squeezed prompts is kept, as an aggregate over the prompts' hashes that is joined back, so one prompt
    that a third of all tasks share isn't sorted in one task."""
    x = tasks.withColumn("squeezed", squeezed(F.col("prompt"))).withColumn("h", F.sha2(F.col("squeezed").cast("binary"), 256))
    first = x.where(F.length("squeezed") >= LEAST_PROMPT).groupBy("h").agg(F.min("task_id").alias("first"))
    x = x.join(first, "h", "left")
    reason = F.when(F.length("squeezed") < LEAST_PROMPT, "degenerate_prompt").when(F.col("task_id") != F.col("first"), F.concat(F.lit("duplicate_prompt_of:"), F.col("first")))
    return x.select("task_id", "dataset", reason.alias("reason"))


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group. Spark keeps only n rows per group and partition before it shuffles."""
    return df.withColumn("r__", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("r__") <= n).drop("r__")


def power_needed(n_pairs: int, n_tasks: int) -> str:
    return "enough" if n_tasks >= n_pairs else f"short by {math.ceil(n_pairs - n_tasks)}"


def guard(tasks: DataFrame, splits: DataFrame | None = None) -> None:
    """Refuses a corpus without tasks, with duplicate ids, without prompts, or whose splits name none of its tasks."""
    from tidemark.operators.validate import Refused

    n = tasks.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("task_id").isNull() | (squeezed(F.col("prompt")) == "")).alias("bad")).first()
    if not n["n"]:
        raise Refused("no tasks")
    if n["bad"]:
        raise Refused(f"{n['bad']} tasks without an id or a prompt")
    if duplicate_tasks(tasks).limit(1).count():
        raise Refused("duplicate task ids")
    if splits is not None and not tasks.join(splits, "task_id", "left_semi").limit(1).count():
        raise Refused("the splits name none of the tasks")
