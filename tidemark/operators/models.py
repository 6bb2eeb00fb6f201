"""Models fitted on replay features: train-only scaling, ridge and logistic heads, isotonic calibration, gates and ablations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import cost, features, stats
from tidemark.session import cut


def standardizer(df: DataFrame, cols: list[str], splits: tuple[str, ...] = ("train",)) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column on the named splits; `test` is refused. A constant column has scale 1."""
    if "test" in splits:
        raise ValueError("nothing is fitted on test")
    r = df.where(F.col("split").isin(*splits)).agg(*[x for c in cols for x in (F.avg(c), F.stddev_pop(c))]).first()
    return {c: (float(r[2 * i] or 0.0), float(r[2 * i + 1]) if r[2 * i + 1] else 1.0) for i, c in enumerate(cols)}


def standardize(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})


def ridge(df: DataFrame, cols: list[str], target: str, alpha: float = 1.0, by: list[str] | None = None) -> dict[tuple, dict[str, float]]:
    """Ridge with a free intercept, from sums of products, per group; NULL targets are left out, groups of fewer than two rows too."""
    by = by or []
    g = cost.gram(df.where(F.col(target).isNotNull()), [F.lit(1.0), *[F.col(c) for c in cols]], F.col(target), by)
    k, out = len(cols) + 1, {}
    for r in g.collect():
        if r["n"] >= 2:
            beta = cost.solve(r.asDict(), k, np.array([1e-12] + [alpha] * (k - 1)))
            out[tuple(r[b] for b in by)] = dict(zip(["intercept", *cols], map(float, beta)))
    return out


def logistic_by(df: DataFrame, cols: list[str], label: str, by: list[str], ridge_: float = 1.0, steps: int = 25) -> dict[tuple, dict[str, float]]:
    """L2-penalised logistic regressions of all groups at once, by Newton steps. A step is one pass in which every partition sums up the
    gradient and the second derivatives of each group; only these sums, whose number depends on the columns alone, come to the driver.
    Rows with a NULL feature or label are left out, and so are groups in which a class is missing."""
    k = len(cols) + 1
    x = df.select(*by, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(label).cast("double").alias("y__")).dropna(subset=[*[f"x{i}" for i in range(k - 1)], "y__"])
    x = cut(x)
    seen = {tuple(r[:-2]): (r[-2], r[-1]) for r in x.groupBy(*by).agg(F.count(F.lit(1)), F.sum("y__")).collect()}
    beta = {g: np.zeros(k) for g, (n, pos) in seen.items() if 0 < pos < n}
    pen, open_ = np.array([0.0] + [ridge_] * (k - 1)), set(beta)
    fields = ", ".join([*[f"`{c}` {t}" for c, t in x.dtypes if c in by], "g array<double>"])
    for _ in range(steps):
        if not open_:
            break
        now = {g: beta[g] for g in open_}

        def sums(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total: dict[tuple, np.ndarray] = {}
            for b in batches:
                for g, part in b.groupby(by, dropna=False) if by else [((), b)]:
                    g = tuple(None if pd.isna(v) else v for v in (g if isinstance(g, tuple) else (g,)))
                    if g in now:
                        m = np.column_stack([np.ones(len(part)), part[[f"x{i}" for i in range(k - 1)]].to_numpy(float)])
                        pr = 1 / (1 + np.exp(-np.clip(m @ now[g], -35, 35)))
                        part_sums = np.concatenate([m.T @ (part["y__"].to_numpy(float) - pr), (m.T @ (m * (pr * (1 - pr))[:, None])).ravel()])
                        total[g] = total.get(g, 0) + part_sums
            yield pd.DataFrame([(*g, v.tolist()) for g, v in total.items()], columns=[*by, "g"])

        got: dict[tuple, np.ndarray] = {}
        for r in x.mapInPandas(sums, fields).collect():
            got[tuple(r[:-1])] = got.get(tuple(r[:-1]), 0) + np.array(r["g"])
        for g, v in got.items():
            step = np.linalg.solve(v[k:].reshape(k, k) + np.diag(pen + 1e-10), v[:k] - pen * beta[g])
            beta[g] = beta[g] + step
            if np.abs(step).max() < 1e-9:
                open_.discard(g)
        open_ &= set(got)
    return {g: dict(zip(["intercept", *cols], map(float, v))) for g, v in beta.items()}


def logistic(df: DataFrame, cols: list[str], label: str, ridge_: float = 1.0, steps: int = 25) -> dict[str, float] | None:
    """`logistic_by` of all rows as one group; None where a class is missing."""
    return logistic_by(df, cols, label, [], ridge_, steps).get(())


def linear(coef: dict[str, float]):
    return sum((F.col(c) * b for c, b in coef.items() if c != "intercept"), F.lit(coef["intercept"]))


def probability(coef: dict[str, float]):
    return 1 / (1 + F.exp(-linear(coef)))


def _pool(pools: list[list[float]], new: list[float]) -> None:
    """Puts (sum, rows, first, last) behind its group's pools, joined with those whose mean isn't below its own."""
    while pools and pools[-1][0] / pools[-1][1] >= new[0] / new[1]:
        s, n, lo, _ = pools.pop()
        new = [s + new[0], n + new[1], lo, new[3]]
    pools.append(new)


def isotonic_by(df: DataFrame, p: str, y: str, by: list[str]) -> dict[tuple, list[tuple[float, float]]]:
    """For each group the knots of the best non-decreasing fit of y on p, the same exact fit at any size. Rows are counted per distinct p
    rounded to 12 digits and range-partitioned; violators are pooled within each partition, and the pools, far fewer than the values,
    on the driver: pooling in any order gives the same fit. NULLs are left out."""
    per = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.round(p, 12).alias("p__")).agg(F.sum(F.col(y).cast("double")).alias("s__"), F.count(F.lit(1)).alias("n__"))

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[tuple, list[list[float]]] = {}
        for b in batches:
            for *g, at, s, n in b[[*by, "p__", "s__", "n__"]].itertuples(index=False, name=None):
                _pool(groups.setdefault(tuple(None if pd.isna(v) else v for v in g), []), [s, float(n), at, at])
        yield pd.DataFrame([(*g, *q) for g, qs in groups.items() for q in qs], columns=[*by, "s", "n", "lo", "hi"])

    fields = ", ".join([*[f"`{c}` {t}" for c, t in per.dtypes if c in by], "s double, n double, lo double, hi double"])
    out: dict[tuple, list[list[float]]] = {}
    for r in per.repartitionByRange(*by, "p__").sortWithinPartitions(*by, "p__").mapInPandas(pool, fields).orderBy("lo").collect():
        _pool(out.setdefault(tuple(r[: len(by)]), []), list(r[len(by) :]))
    return {g: [k for s, n, lo, hi in qs for k in ([(lo, s / n)] if lo == hi else [(lo, s / n), (hi, s / n)])] for g, qs in out.items()}


def isotonic(df: DataFrame, p: str, y: str) -> list[tuple[float, float]]:
    """`isotonic_by` of all rows as one group; no knots for no rows."""
    return isotonic_by(df, p, y, []).get((), [])


def calibrated_by(group: Column, p: Column, knots: dict[object, list[tuple[float, float]]]) -> Column:
    """p through the knots of its group, linear between them, flat beyond, within [0, 1]; p itself in groups without knots."""
    lines = {g: tuple(np.array(v, float) for v in zip(*ks)) for g, ks in knots.items() if ks}

    @F.pandas_udf("double")
    def through(g: pd.Series, v: pd.Series) -> pd.Series:
        out = v.astype(float).to_numpy().copy()
        for k, (xs, ys) in lines.items():
            on = (g == k).to_numpy()
            out[on] = np.clip(np.interp(out[on], xs, ys), 0.0, 1.0)
        return pd.Series(out).where(v.notna().to_numpy(), None)

    return through(group, p)


def calibrated(p: Column, knots: list[tuple[float, float]]) -> Column:
    """`calibrated_by` of all rows as one group."""
    return calibrated_by(F.lit(0), p, {0: knots}) if knots else p


def crossfit(df: DataFrame, p: str, y: str, key: str, folds: int = 5) -> DataFrame:
    """df with `p_cross`: calibrated on the other folds, whole keys together; a fold whose rest has one class keeps p. All folds are
    fitted in one pass."""
    x = cut(features.fold(df, key, folds).withColumn("fold", F.col("fold").cast("int")))
    rest = x.withColumn("for__", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("for__ <> fold")
    both = {r["for__"] for r in rest.groupBy("for__").agg(F.min(F.col(y).cast("int")).alias("a"), F.max(F.col(y).cast("int")).alias("b")).where("a < b").collect()}
    knots = {g[0]: k for g, k in isotonic_by(rest, p, y, ["for__"]).items() if g[0] in both}
    return x.withColumn("p_cross", calibrated_by(F.col("fold"), F.col(p), knots))


def calibrate(df: DataFrame, p: str, y: str, key: str) -> dict:
    """Isotonic knots if they lower the cross-fitted calibration error, else none."""
    raw = stats.calibration(stats.reliability(df, p, y)).first()["ece"]
    cross = stats.calibration(stats.reliability(crossfit(df, p, y, key), "p_cross", y)).first()["ece"]
    keep = raw is not None and cross is not None and cross < raw
    return {"raw_ece": raw, "cross_ece": cross, "kept": keep, "knots": isotonic(df, p, y) if keep else []}


def gate(df: DataFrame, cols: list[str], label: str, fit_on: str = "train", score_on: str = "val") -> DataFrame:
    """(auc, n) of a logistic model fitted on one split and scored on another."""
    scale = standardizer(df, cols, (fit_on,))
    z = standardize(df, scale)
    coef = logistic(z.where(F.col("split") == fit_on), cols, label)
    if coef is None:
        return df.sparkSession.createDataFrame([], "auc double, n long")
    s = z.where(F.col("split") == score_on).select(probability(coef).alias("p"), F.col(label).cast("int").alias("y"))
    return stats.auc(s, "p", "y")


def ablations(df: DataFrame, cols: list[str], label: str, fit_on: str = "train", score_on: str = "val", draws: int = stats.DRAWS, level: float = 0.95) -> DataFrame:
    """(variant, group, auc, delta, low, high, carries): without each group of features, and with each alone, against all of them.

    Every variant is fitted anew on one split and scored on the other. The intervals of the differences hold together at `level`
    (Bonferroni), over draws of tasks(task_id) shared by all variants. `carries` marks the group whose absence costs most, if its
    interval is below 0.
    """
    groups: dict[str, list[str]] = {}
    for c in cols:
        groups.setdefault(features.REGISTRY[c].group if c in features.REGISTRY else c, []).append(c)
    variants = {("all", ""): cols} | {(kind, g): use for g, mine in groups.items() for kind, use in (("without", [c for c in cols if c not in mine]), ("only", mine)) if use}
    z = cut(standardize(df, standardizer(df, cols, (fit_on,))))
    train = z.where(F.col("split") == fit_on)
    fitted = {v: c for v, use in variants.items() if (c := logistic(train, use, label)) is not None}
    empty = "variant string, `group` string, auc double, delta double, low double, high double, carries boolean"
    if ("all", "") not in fitted:
        return df.sparkSession.createDataFrame([], empty)
    score = F.array(*[F.struct(F.lit("|".join(v)).alias("f"), linear(c).alias("v")) for v, c in fitted.items()])
    long = cut(z.where(F.col("split") == score_on).select("task_id", F.col(label).cast("int").alias("y"), F.explode(score).alias("s")).select("task_id", "y", "s.f", "s.v"))
    at = {r["f"]: r["auc"] for r in stats.auc(long, "v", "y", ["f"]).collect()}
    d = stats.bootstrap_auc(long, draws)
    base = d.where("f = 'all|'").select("draw", F.col("auc").alias("base"))
    tail = (1 - level) / 2 / max(1, len(fitted) - 1)
    ci = {r["f"]: (r["low"], r["high"]) for r in d.where("f <> 'all|'").join(base, "draw").withColumn("x", F.col("auc") - F.col("base")).groupBy("f").agg(F.percentile("x", tail).alias("low"), F.percentile("x", 1 - tail).alias("high")).collect()}
    rows = []
    for kind, g in fitted:
        f = f"{kind}|{g}"
        a, (lo, hi) = at.get(f), ci.get(f, (None, None))
        rows.append((kind, g, a, None if a is None or at.get("all|") is None or kind == "all" else a - at["all|"], lo, hi))
    lost = [r for r in rows if r[0] == "without" and r[5] is not None and r[5] < 0]
    worst = min(lost, key=lambda r: r[3])[1] if lost else None
    return df.sparkSession.createDataFrame([(*r, r[0] == "without" and r[1] == worst) for r in rows], empty)


def fit_heads(df: DataFrame, cols: list[str]) -> dict:
    """Heads of every arm of df(task_id, arm, split, y, prefill_tokens, decode_tokens, cols...): a success head, calibrated, and a head
    for either count of tokens. Scaling and weights are fitted on train only, calibration on val only; test is never read.

    {"scale", "pass": arm -> weights, "knots": arm -> knots, "decode" and "prefill": arm -> weights}; an arm without both classes in
    train has no success head.
    """
    scale = standardizer(df, cols)
    z = cut(standardize(df.where("split IN ('train', 'val')"), scale))
    train = z.where("split = 'train'")
    heads = {"scale": scale, "decode": ridge(train, cols, "decode_tokens", by=["arm"]), "prefill": ridge(train, cols, "prefill_tokens", by=["arm"]), "pass": logistic_by(train, cols, "y", ["arm"])}
    heads = {k: {g[0]: c for g, c in v.items()} if k != "scale" else v for k, v in heads.items()}
    p = cut(_by_arm(z.where("split = 'val'"), heads["pass"], probability, "p").where("p IS NOT NULL"))
    heads["knots"] = {arm: calibrate(p.where(F.col("arm") == arm), "p", "y", "task_id")["knots"] for arm in heads["pass"]}
    return heads


def _by_arm(df: DataFrame, heads: dict[str, dict[str, float]], f, out: str) -> DataFrame:
    """df with a function of each arm's own weights; arms are few."""
    c = F.lit(None).cast("double")
    for arm, w in heads.items():
        c = F.when(F.col("arm") == arm, f(w)).otherwise(c)
    return df.withColumn(out, c)


def scores(tasks: DataFrame, heads: dict, arms: DataFrame) -> DataFrame:
    """(task_id, arm, p_pass, prefill_tokens, decode_tokens, e_cost, e_latency) of tasks(task_id, cols...) for every arm that has heads.

    `arms` is (arm, intercept_s, prefill_s_per_token, decode_s_per_token), a row for each arm: costs are the predicted tokens priced by
    its coefficients. Counts below 0 are 0."""
    z = standardize(tasks, heads["scale"]).crossJoin(F.broadcast(arms.where(F.col("arm").isin(*heads["pass"]) if heads["pass"] else F.lit(False))))
    z = _by_arm(z, heads["pass"], probability, "p_raw")
    z = z.withColumn("p_pass", calibrated_by(F.col("arm"), F.col("p_raw"), heads["knots"]))
    for t in ("decode", "prefill"):
        z = _by_arm(z, heads[t], lambda w: F.greatest(F.lit(0.0), linear(w)), f"{t}_tokens")
    return z.select("task_id", "arm", "p_pass", "prefill_tokens", "decode_tokens", cost.gpu_seconds().alias("e_cost"), cost.latency().alias("e_latency"))
