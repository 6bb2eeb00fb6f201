"""Replay of routing policies over logged rollouts: what each would have solved, spent and waited for.

Every policy maps a grid, small and large side by side for each task and seed, to one outcome row per task and replicate, with the
columns policy, task_id, rep, solved, cost, latency, action, escalated. All are projections or aggregates of the same grid, so any
number of them costs one scan. A NULL measurement never counts as a pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.ordered import quantiles

COLUMNS = ["policy", "task_id", "rep", "solved", "cost", "latency", "action", "escalated"]


def unit(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) from the text of its parts, the same on any engine that has md5."""
    text = F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _outcome(g: DataFrame, policy: Column | str, pick_large: Column, small: str, large: str) -> DataFrame:
    p = F.coalesce(pick_large, F.lit(False))
    take = [F.when(p, F.col(f"l_{v}")).otherwise(F.col(f"s_{v}")).alias(v) for v in ("solved", "cost", "latency")]
    return g.select((F.lit(policy) if isinstance(policy, str) else policy).alias("policy"), "task_id", F.col("seed").alias("rep"), *take, F.when(p, F.lit(large)).otherwise(F.lit(small)).alias("action"), p.alias("escalated"))


def always(g: DataFrame, arm: str, small: str, large: str) -> DataFrame:
    """One arm for every task. The other arm's name is refused, not replaced."""
    if arm not in (small, large):
        raise KeyError(f"arm {arm!r} is not in the grid")
    return _outcome(g, f"always_{arm}", F.lit(arm == large), small, large)


def random_route(g: DataFrame, p: float, small: str, large: str, seed: int = 0) -> DataFrame:
    """Large with probability p, by a hash of seed, task and replicate."""
    return _outcome(g, f"random_route({p:g})", unit(F.lit(f"R|{seed}"), F.col("task_id"), F.col("seed").cast("string")) < p, small, large)


def oracle(g: DataFrame, small: str, large: str) -> DataFrame:
    """Large where only it solves the task: the head room of any router."""
    return _outcome(g, "oracle_router", (F.col("s_solved") < 1) & (F.col("l_solved") >= 1), small, large)


def cascade(g: DataFrame, small: str, large: str, threshold: float = 1.0) -> DataFrame:
    """Small first; where its visible tests don't reach the threshold, or weren't seen, large as well, and both are paid."""
    up = ~F.coalesce(F.col("s_visible") >= threshold, F.lit(False))
    both = [(F.col(f"s_{v}") + F.when(up, F.col(f"l_{v}")).otherwise(F.lit(0.0))).alias(v) for v in ("cost", "latency")]
    return g.select(F.lit("verifier_gated_cascade").alias("policy"), "task_id", F.col("seed").alias("rep"), F.when(up, F.col("l_solved")).otherwise(F.col("s_solved")).alias("solved"), *both, F.when(up, F.lit(f"{small}->{large}")).otherwise(F.lit(small)).alias("action"), up.alias("escalated"))


def best_of(g: DataFrame, n: int, threshold: float = 1.0) -> DataFrame:
    """Up to n draws of small, until one passes its visible tests, else the last; one replicate a task, which pays for all it drew."""
    w = W.partitionBy("task_id").orderBy("seed")
    x = g.select("task_id", "seed", "s_solved", "s_cost", "s_latency", F.coalesce(F.col("s_visible") >= threshold, F.lit(False)).alias("ok"), F.row_number().over(w).alias("k")).where(F.col("k") <= n)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("cost", F.sum("s_cost").over(run)).withColumn("latency", F.sum("s_latency").over(run))
    one = x.groupBy("task_id").agg(F.coalesce(F.min_by(F.struct("s_solved", "cost", "latency"), F.when(F.col("ok"), F.col("k"))), F.max_by(F.struct("s_solved", "cost", "latency"), "k")).alias("r"))
    return one.select(F.lit(f"best_of_{n}").alias("policy"), "task_id", F.lit(0).alias("rep"), F.col("r.s_solved").alias("solved"), "r.cost", "r.latency", F.lit(f"best_of_{n}").alias("action"), F.lit(False).alias("escalated"))


def from_decisions(g: DataFrame, decisions: DataFrame, name: str, small: str, large: str, strict: bool = True) -> DataFrame:
    """The arm a table (task_id, action) names for each task. A task without one is an error, or left out where strict is off."""
    d = decisions.select("task_id", "action").dropDuplicates(["task_id"])
    if strict and g.join(d, "task_id", "left_anti").limit(1).count():
        raise KeyError(f"{name}: a task has no action")
    return _outcome(g.join(d, "task_id"), name, F.col("action") == large, small, large)


def standard(g: DataFrame, small: str, large: str, p: float = 0.5, n: int = 3) -> DataFrame:
    """The six fixed baselines."""
    return reduce(DataFrame.unionByName, [always(g, small, small, large), always(g, large, small, large), random_route(g, p, small, large), best_of(g, n), cascade(g, small, large), oracle(g, small, large)])


def per_task(outcomes: DataFrame) -> DataFrame:
    """Replicates to their mean, NULLs left out."""
    return outcomes.groupBy("policy", "task_id").agg(*[F.avg(v).alias(v) for v in ("solved", "cost", "latency")], F.max("escalated").alias("escalated"))


def summary(outcomes: DataFrame) -> DataFrame:
    """Accuracy, cost, mean and 95th percentile of latency of each policy; the percentile is exact, interpolated."""
    means = outcomes.groupBy("policy").agg(F.avg("solved").alias("accuracy"), F.avg("cost").alias("cost"), F.avg("latency").alias("latency_mean"), F.count(F.lit(1)).alias("n"))
    # Policies are few.
    p95 = quantiles(outcomes, ["policy"], "latency", {"latency_p95": 0.95})
    return means.join(F.broadcast(p95), "policy", "left").select("policy", "accuracy", "cost", "latency_mean", "latency_p95", "n")


def utility(outcomes: DataFrame, lams: DataFrame) -> DataFrame:
    """Mean of solved less lam times cost, for each policy and each of a few lams."""
    s = outcomes.groupBy("policy").agg(F.avg(F.when(F.col("cost").isNotNull(), F.col("solved"))).alias("a"), F.avg(F.when(F.col("solved").isNotNull(), F.col("cost"))).alias("c"))
    return s.crossJoin(F.broadcast(lams)).select("policy", "lam", (F.col("a") - F.col("lam") * F.col("c")).alias("utility"))


def reachable(g: DataFrame) -> DataFrame:
    """(task_id, small_can, large_can): whether any seed of either arm solved the task."""
    return g.groupBy("task_id").agg((F.coalesce(F.max("s_solved"), F.lit(0.0)) >= 1).alias("small_can"), (F.coalesce(F.max("l_solved"), F.lit(0.0)) >= 1).alias("large_can"))


def headroom(g: DataFrame) -> DataFrame:
    """How much routing could gain: shares of tasks by which arms can solve them."""
    s, n = F.col("small_can"), F.col("large_can")
    share = lambda c: F.avg(c.cast("double"))
    return reachable(g).agg(F.count(F.lit(1)).alias("n_tasks"), share(s & ~n).alias("small_only"), share(~s & n).alias("large_only"), share(s & n).alias("both"), share(~s & ~n).alias("neither"), share(~s & n).alias("escalation_helps"), share(s).alias("escalation_wasteful"))


def confusion(outcomes: DataFrame, g: DataFrame) -> DataFrame:
    """For each policy, tasks by what it did and what could be done. It escalated where it did so in any replicate."""
    did = outcomes.groupBy("policy", "task_id").agg(F.max("escalated").alias("e")).join(reachable(g), "task_id")
    kind = F.when(~F.col("small_can") & ~F.col("large_can"), "unsolvable").when(F.col("e") & ~F.col("small_can"), "correct_escalation").when(F.col("e"), "false_escalation").when(F.col("small_can"), "correct_small").otherwise("missed_escalation")
    return did.groupBy("policy", kind.alias("outcome")).agg(F.count(F.lit(1)).alias("tasks"))


def confusion_summary(counts: DataFrame) -> DataFrame:
    """Escalation rate, routable tasks and regret (wrong choices among routable tasks) of each policy, from `confusion`."""
    k = lambda *names: F.sum(F.when(F.col("outcome").isin(*names), F.col("tasks")).otherwise(0))
    x = counts.groupBy("policy").agg(F.sum("tasks").alias("tasks"), k("unsolvable").alias("unsolvable"), k("missed_escalation", "false_escalation").alias("wrong"))
    return x.select("policy", "tasks", "unsolvable", (F.col("wrong") / F.when(F.col("tasks") > F.col("unsolvable"), F.col("tasks") - F.col("unsolvable"))).alias("regret"))


# Flags that show a solution defeated its tests.
HACKS = ["hardcoded_visible_case", "bare_except_pass", "reads_test_file", "sys_exit_or_skip", "test_file_deleted", "test_file_modified"]
# Categories, most severe first.
CATEGORIES = ["reward_hack", "harness_error", "timeout", "empty_code", "syntax_error", "truncated", "runtime_error", "wrong_answer", "overfit_visible", "solved"]


def category() -> Column:
    """The one category of a row, of its hack_flags, error_class, hidden and visible counts and finish_reason."""
    won = F.coalesce((F.col("hidden_total") > 0) & (F.col("hidden_passed") == F.col("hidden_total")), F.lit(False))
    seen = F.coalesce((F.col("visible_total") > 0) & (F.coalesce("visible_passed", F.lit(0)) >= F.col("visible_total")), F.lit(False))
    e = F.col("error_class")
    c = F.when(F.coalesce(F.arrays_overlap("hack_flags", F.array(*[F.lit(h) for h in HACKS])), F.lit(False)), "reward_hack")
    for k in ("harness_error", "timeout", "empty_code", "syntax_error"):
        c = c.when(e == k, k)
    return c.when(won, "solved").when(F.col("finish_reason") == "length", "truncated").when(e == "runtime_error", "runtime_error").when(seen, "overfit_visible").otherwise("wrong_answer")


def taxonomy(rows: DataFrame) -> DataFrame:
    """Rows by category, for each arm and for all together (arm NULL)."""
    return rows.select("arm", category().alias("category")).rollup("category", "arm").agg(F.count(F.lit(1)).alias("n"), F.grouping("arm").alias("a"), F.grouping("category").alias("c")).where("c = 0").select(F.when(F.col("a") == 0, F.col("arm")).alias("arm"), F.col("a").cast("boolean").alias("overall"), "category", "n")


def gap(rows: DataFrame, small: str, large: str, least: float = 0.005) -> DataFrame:
    """For each category the rate of large less that of small, where it is at least `least` either way."""
    x = rows.where(F.col("arm").isin(small, large)).select("arm", category().alias("category")).groupBy("category").agg(*[F.sum((F.col("arm") == a).cast("long")).alias(k) for a, k in ((small, "s"), (large, "l"))])
    t = x.agg(F.sum("s").alias("ts"), F.sum("l").alias("tl"))
    d = F.col("l") / F.col("tl") - F.col("s") / F.col("ts")
    return x.crossJoin(F.broadcast(t)).select("category", d.alias("delta")).where(F.abs("delta") >= least)
