"""Statistics of replayed policies and scores, as aggregates: rank AUC, calibration, clustered bootstraps, exact tests."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.operators.ordered import before


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """(by..., auc, n): rank AUC with ties averaged; NULL and NaN scores and NULL labels are left out; NULL where one class is missing.

    Rows are first counted per distinct score, so the running count is over distinct scores, not rows.
    """
    by = by or []
    x = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    x = x.groupBy(*by, F.col(score).alias("s__")).agg(F.sum(F.col(label).cast("long")).alias("p__"), F.sum((~F.col(label).cast("boolean")).cast("long")).alias("n__"))
    x = before(x.withColumnRenamed("p__", "pos__"), ["s__"], "n__", by, "below__")
    x = x.withColumn("won__", F.col("pos__") * (F.col("below__") + F.col("n__") / 2))
    t = x.groupBy(*by).agg(F.sum("won__").alias("w"), F.sum("pos__").alias("p"), F.sum("n__").alias("q"))
    return t.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p") * F.col("q"))).alias("auc"), (F.col("p") + F.col("q")).alias("n"))


def average_rank(df: DataFrame, score: str, out: str = "rank") -> DataFrame:
    """Each row with the mean rank of its ties. Ranks run over counted distinct scores."""
    per = df.groupBy(score).agg(F.count(F.lit(1)).alias("c__"))
    ranks = before(per, [score], "c__", out="b__").select(score, (F.col("b__") + (F.col("c__") + 1) / 2).alias(out))
    return df.join(ranks, score)


def edges(bins: int) -> list[float]:
    """Ends of equal bins of [0, 1], as evenly spaced doubles."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def reliability(df: DataFrame, p: str, y: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by..., bin, n, predicted, observed, gap) of the bins that have rows; a prediction on an edge falls in the upper bin, 1 in the
    last. The edges are compared as literals, not computed from the prediction."""
    by = by or []
    b = sum(((F.col(p) >= e).cast("int") for e in edges(bins)[1:-1]), F.lit(0))
    x = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))
    return x.withColumn("gap", F.col("predicted") - F.col("observed"))


def calibration(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Expected and greatest calibration error of a reliability table."""
    return table.groupBy(*(by or [])).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"), F.max(F.abs("gap")).alias("mce"))


def brier(p: str, y: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y).cast("double"), F.lit(2)))


def r2_rmse(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """(by..., r2, rmse, n) of predictions; r2 is 0 where y doesn't vary. Two passes, the mean first, against cancellation."""
    by = by or []
    x = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    m = x.groupBy(*by).agg(F.avg(y).alias("m__"))
    x = x.join(F.broadcast(m), by) if by else x.crossJoin(F.broadcast(m))
    t = x.groupBy(*by).agg(F.sum(F.pow(F.col(y) - F.col(yhat), F.lit(2))).alias("res"), F.sum(F.pow(F.col(y) - F.col("m__"), F.lit(2))).alias("tot"), F.count(F.lit(1)).alias("n"))
    return t.select(*by, F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(F.lit(0.0)).alias("r2"), F.sqrt(F.col("res") / F.col("n")).alias("rmse"), "n")


def benjamini_hochberg(df: DataFrame, p: str, out: str = "adjusted") -> DataFrame:
    """Adjusted p-values of a family of tests, which are few."""
    m = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    x = df.withColumn("k__", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(p))).withColumn("q__", F.col(p) * m / F.col("k__"))
    down = W.partitionBy(F.lit(1)).orderBy(F.desc("k__")).rowsBetween(W.unboundedPreceding, 0)
    return x.withColumn(out, F.least(F.lit(1.0), F.min("q__").over(down))).drop("k__", "q__")


#: Draws of a bootstrap; the modulus of its hashes; and the most often that a task is counted in a draw (more has a chance of 1e-6).
DRAWS, MODULUS, MOST = 10_000, 2**31 - 1, 8


def poisson_edges(mean: float) -> list[float]:
    """Chances of at most 0, 1, 2, ... events, up to all but 1e-10."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while total < 1 - 1e-10 and k < 60:
        total += term
        out.append(total)
        k += 1
        term *= mean / k
    return out


def _state(tag: str, *parts: Column) -> list[Column]:
    """Two whole numbers below MODULUS, from a hash; draw b's unit for them is (first * steps(b) + second) mod MODULUS over MODULUS."""
    h = F.md5(F.concat_ws("|", F.lit(tag), *[x.cast("string") for x in parts]).cast("binary"))
    return [F.conv(F.substring(h, i, 8), 16, 10).cast("long") % F.lit(MODULUS) for i in (1, 9)]


def steps(draws: int) -> np.ndarray:
    return (np.arange(draws, dtype=np.int64) + 1) * 16_807 % MODULUS


def _units(a: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (a[:, None] * at + c[:, None]) % MODULUS / MODULUS


def _times(u: np.ndarray) -> np.ndarray:
    """How often each task is in each draw."""
    return np.minimum(np.searchsorted(poisson_edges(1.0), u, "right"), MOST)


def drawn_sums(values: DataFrame, sums: dict[str, Column], draws: int = DRAWS) -> DataFrame:
    """(draw, sums...): weighted sums of values(task_id, rep, ...) in every draw of a clustered bootstrap.

    A task is in a draw a Poisson(1) number of times, and each of its replicates a Poisson number of times with that mean: what drawing
    tasks and then replicates with replacement comes to, without a draw of one row depending on another row. The numbers are hashes of
    the draw, the task and the replicate, so any engine and any partition draws alike. Nothing but a row of sums per draw and partition
    is moved. NULLs add nothing.
    """
    names = list(sums)
    x = values.select(*[c.alias(n) for n, c in zip(("ta", "tc", "ra", "rc"), [*_state("T", F.col("task_id")), *_state("S", F.col("task_id"), F.col("rep"))])], *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(sums.values())])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, edges = steps(draws), [poisson_edges(float(k)) for k in range(MOST + 1)]
        total = np.zeros((draws, len(names)))
        for b in batches:
            v = b[[f"v{i}" for i in range(len(names))]].to_numpy(float)
            ta, tc, ra, rc = (b[n].to_numpy(np.int64) for n in ("ta", "tc", "ra", "rc"))
            for lo in range(0, len(b), 64):
                part = slice(lo, lo + 64)
                w, u = _times(_units(ta[part], tc[part], at)), _units(ra[part], rc[part], at)
                n = np.zeros(w.shape)
                for k in range(1, MOST + 1):
                    on = w == k
                    n[on] = np.searchsorted(edges[k], u[on], "right")
                total += n.T @ v[part]
        yield pd.DataFrame({"draw": np.arange(draws), **{n: total[:, i] for i, n in enumerate(names)}})

    x = x.repartition(values.sparkSession.sparkContext.defaultParallelism)
    fields = ", ".join(["draw int", *[f"`{n}` double" for n in names]])
    return x.mapInPandas(draw, fields).groupBy("draw").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_of(values: DataFrame, sums: dict[str, Column], statistics: dict[str, Column], draws: int = DRAWS, level: float = 0.95, family: int = 1) -> DataFrame:
    """(measure, point, low, high) of any statistics of weighted sums: `statistics` are columns over the names of `sums`, so means, ratios,
    differences, rates and utilities are all told from one set of draws. `family` intervals hold together at `level` (Bonferroni)."""
    per = F.array(*[F.struct(F.lit(k).alias("measure"), c.cast("double").alias("v")) for k, c in statistics.items()])
    tail = (1 - level) / 2 / family
    at = lambda q: F.percentile("v", q)  # noqa: E731  (at most `draws` values a measure)
    ci = drawn_sums(values, sums, draws).select(F.explode(per).alias("x")).select("x.*").groupBy("measure").agg(at(tail).alias("low"), at(1 - tail).alias("high"))
    whole = values.agg(*[F.sum(F.coalesce(c.cast("double"), F.lit(0.0))).alias(k) for k, c in sums.items()])
    pt = whole.select(F.explode(per).alias("x")).select("x.measure", F.col("x.v").alias("point"))
    return pt.join(F.broadcast(ci), "measure", "left").select("measure", "point", "low", "high")


def _mean_sums(measures: list[str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Sums and statistics of the mean of each measure, its NULLs left out."""
    sums = {f"{k}_{m}": c for m in measures for k, c in (("sum", F.col(m)), ("n", F.col(m).isNotNull().cast("double")))}
    return sums, {m: F.try_divide(F.col(f"sum_{m}"), F.col(f"n_{m}")) for m in measures}


def bootstrap(values: DataFrame, measures: list[str], draws: int = DRAWS, level: float = 0.95) -> DataFrame:
    """(measure, point, low, high): percentile intervals of the mean of each measure of values(task_id, rep, measures...)."""
    return bootstrap_of(values, *_mean_sums(measures), draws, level)


def paired_bootstrap(values: DataFrame, a: str, b: str, draws: int = DRAWS, level: float = 0.95) -> DataFrame:
    """(point, low, high) of mean(a) - mean(b) over the same drawn tasks and replicates; each mean leaves out its own NULLs."""
    sums, means = _mean_sums([a, b])
    return bootstrap_of(values, sums, {"difference": means[a] - means[b]}, draws, level).drop("measure")


def bootstrap_auc(scores: DataFrame, draws: int = DRAWS) -> DataFrame:
    """(f, draw, auc) of scores(task_id, f, v, y): the AUC of each score f in each draw of tasks, ties averaged, on the same draws.

    Rows are sorted over range partitions, equal scores in one. A partition gives, for each draw, the weight of its positives and
    negatives and what its positives win within it; what they win over earlier partitions follows from those few sums.
    """
    x = scores.where("v IS NOT NULL AND NOT isnan(CAST(v AS double)) AND y IS NOT NULL")
    x = x.groupBy("f", F.col("v").cast("double").alias("v"), "task_id").agg(F.sum(F.col("y").cast("double")).alias("p"), F.sum(1 - F.col("y").cast("double")).alias("n"))
    x = x.select("f", "v", *[c.alias(k) for k, c in zip(("ta", "tc"), _state("T", F.col("task_id")))], "p", "n")
    x = x.repartitionByRange(scores.sparkSession.sparkContext.defaultParallelism, "f", "v").sortWithinPartitions("f", "v").withColumn("part", F.spark_partition_id())

    def won(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, key = steps(draws), None
        zero = np.zeros(draws)
        f = part = None

        def closed() -> pd.DataFrame:
            wins = out + p_open * (below + n_open / 2)
            return pd.DataFrame({"f": f, "part": part, "draw": np.arange(draws), "pos": pos + p_open, "neg": below + n_open, "won": wins})

        for b in batches:
            ps, ns, ta, tc = (b[k].to_numpy() for k in ("p", "n", "ta", "tc"))
            names, vs = b["f"].to_numpy(), b["v"].to_numpy(float)
            for lo in range(0, len(b), 64):
                hi = min(lo + 64, len(b))
                w = _times(_units(ta[lo:hi], tc[lo:hi], at)).astype(float)
                starts = [i for i in range(lo, hi) if i == lo or vs[i] != vs[i - 1] or names[i] != names[i - 1]]
                for s, e in zip(starts, [*starts[1:], hi]):
                    p, n = ps[s:e] @ w[s - lo : e - lo], ns[s:e] @ w[s - lo : e - lo]
                    if names[s] != f:
                        if f is not None:
                            yield closed()
                        f, part, key = names[s], int(b["part"].iloc[s]), vs[s]
                        out, pos, below, p_open, n_open = zero.copy(), zero.copy(), zero.copy(), p, n
                    elif vs[s] == key:
                        p_open, n_open = p_open + p, n_open + n
                    else:
                        out += p_open * (below + n_open / 2)
                        pos, below = pos + p_open, below + n_open
                        key, p_open, n_open = vs[s], p, n
        if f is not None:
            yield closed()

    g = x.mapInPandas(won, "f string, part int, draw int, pos double, neg double, won double")
    before_ = F.coalesce(F.sum("neg").over(W.partitionBy("f", "draw").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    t = g.withColumn("won", F.col("won") + F.col("pos") * before_).groupBy("f", "draw").agg(F.sum("won").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return t.select("f", "draw", F.try_divide(F.col("w"), F.col("p") * F.col("n")).alias("auc"))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided p of b and c discordant pairs; 1 where there are none. In logarithms, so that any count does."""
    n = b + c
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(min(b, c) + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def discordant(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(b, c): pairs where only a, and only b, is true; NULLs pair with nothing."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    return pairs.agg(F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(b, c, odds_ratio, p_value); the odds ratio is NULL where c is 0. Two counts come to the driver."""
    r = discordant(pairs, a, b).first()
    odds = r["b"] / r["c"] if r["c"] else None
    return pairs.sparkSession.createDataFrame([(r["b"], r["c"], odds, mcnemar_p(r["b"], r["c"]))], "b long, c long, odds_ratio double, p_value double")


def mcnemar_sample_size(p_ab: float, p_ba: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Pairs needed to see that p_ab and p_ba, the discordant shares, differ (Connor, 1987)."""
    d, s = abs(p_ab - p_ba), p_ab + p_ba
    if d == 0:
        raise ValueError("no difference to detect")
    za, zb = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power)
    return math.ceil((za * math.sqrt(s) + zb * math.sqrt(max(0.0, s - d * d))) ** 2 / (d * d))


def simulated_power(spark: SparkSession, n_tasks: int, n_seeds: int, p: float, lift: float, icc: float, trials: int = 500, draws: int = 400, seed: int = 0) -> DataFrame:
    """(tasks, trials, power): the share of simulated studies whose paired, clustered bootstrap interval of the difference excludes 0.

    In a study each task has a chance of success of its own, beta-distributed with the given correlation within a task; the better arm
    adds `lift` to it, on the same task. Studies are spread over the workers; each is drawn and bootstrapped by itself.
    """

    def study(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = (1 - icc) / icc if icc > 0 else 0.0
        for b in batches:
            hits = []
            for t in b["id"]:
                rng = np.random.default_rng([seed, n_tasks, int(t)])
                base = rng.beta(max(p * k, 1e-6), max((1 - p) * k, 1e-6), n_tasks) if icc > 0 else np.full(n_tasks, p)
                a, c = (rng.binomial(1, np.clip(q, 0, 1)[:, None], (n_tasks, n_seeds)) for q in (base + lift, base))
                drawn = rng.integers(0, n_tasks, (draws, n_tasks))
                reps = rng.integers(0, n_seeds, (draws, n_tasks, n_seeds))
                d = np.take_along_axis((a - c)[drawn], reps, axis=2).mean(axis=(1, 2))
                lo, hi = np.quantile(d, [0.025, 0.975])
                hits.append(bool(lo > 0 or hi < 0))
            yield pd.DataFrame({"hit": hits})

    x = spark.range(trials).repartition(min(trials, spark.sparkContext.defaultParallelism)).mapInPandas(study, "hit boolean")
    return x.agg(F.lit(n_tasks).alias("tasks"), F.count(F.lit(1)).alias("trials"), F.avg(F.col("hit").cast("double")).alias("power"))


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)
