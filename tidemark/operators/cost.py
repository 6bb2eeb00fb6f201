"""The serial cost model: coefficients per model and batch, imputed seconds and dollars, fits and their validation."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordered import before

#: The batch whose coefficients price a row by default, and the fewest observations to fit three numbers to.
REFERENCE_BATCH, LEAST_ROWS = 1, 12


def resolve(coefficients: DataFrame, batch: int | None = None) -> DataFrame:
    """One row of coefficients per model: the batch asked for, else the reference, else the smallest there is."""
    want = REFERENCE_BATCH if batch is None else batch
    order = F.struct(F.when(F.col("batch") == want, 0).when(F.col("batch") == REFERENCE_BATCH, 1).otherwise(2), F.col("batch"))
    names = [c for c in coefficients.columns if c != "model_id"]
    return coefficients.groupBy("model_id").agg(F.min_by(F.struct(*names), order).alias("f")).select("model_id", "f.*")


def gpu_seconds() -> Column:
    """Work without the fixed share of a request."""
    return F.greatest(F.lit(0.0), F.col("prefill_tokens") * F.col("prefill_s_per_token") + F.col("decode_tokens") * F.col("decode_s_per_token"))


def latency() -> Column:
    return F.col("intercept_s") + F.col("prefill_tokens") * F.col("prefill_s_per_token") + F.col("decode_tokens") * F.col("decode_s_per_token")


def usd(gpu_s: Column, rate_per_hour: float) -> Column:
    return gpu_s * F.lit(rate_per_hour / 3600.0)


def impute(rows: DataFrame, coefficients: DataFrame, rate_per_hour: float = 1.0) -> DataFrame:
    """rows with imputed_gpu_s, imputed_s and imputed_usd; NULL where the model has no coefficients. There are as many coefficients as
    models, which the join finds small by itself."""
    f = resolve(coefficients).select("model_id", "intercept_s", "prefill_s_per_token", "decode_s_per_token")
    x = rows.join(f, "model_id", "left").withColumn("imputed_gpu_s", F.when(F.col("intercept_s").isNotNull(), gpu_seconds())).withColumn("imputed_s", latency())
    return x.withColumn("imputed_usd", usd(F.col("imputed_gpu_s"), rate_per_hour)).drop("intercept_s", "prefill_s_per_token", "decode_s_per_token")


def report(imputed: DataFrame) -> DataFrame:
    """Rows, how many were priced, totals, and the models that weren't."""
    return imputed.agg(F.count(F.lit(1)).alias("rows"), F.count("imputed_gpu_s").alias("imputed"), F.count_if(F.col("imputed_gpu_s").isNull()).alias("unpriced"), (F.count("imputed_gpu_s") / F.count(F.lit(1))).alias("coverage"), F.sum("imputed_gpu_s").alias("gpu_s"), F.sum("imputed_usd").alias("usd"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("imputed_gpu_s").isNull(), F.coalesce("model_id", F.lit("?"))))), ",").alias("unpriced_models"))


def join_costing(rows: DataFrame, sidecar: DataFrame) -> DataFrame:
    """rows with the costs of a sidecar over their own, by rollout_id, and usd; rows without a costing keep theirs. The sidecar is
    reduced to one row per rollout first, the least values, so a repeated costing can't multiply rows."""
    c = sidecar.groupBy("rollout_id").agg(F.min("gpu_seconds").alias("c_gpu"), F.min("imputed_latency_s").alias("c_lat"), F.min("usd").alias("usd"))
    return rows.join(c, "rollout_id", "left").withColumn("gpu_seconds", F.coalesce("c_gpu", "gpu_seconds")).withColumn("imputed_latency_s", F.coalesce("c_lat", "imputed_latency_s")).drop("c_gpu", "c_lat")


def holdout(df: DataFrame, by: list[str], order: list[str], step: int = 4, least: int = 2 * LEAST_ROWS) -> DataFrame:
    """df with `held`: every step-th row of a group in order, for groups of at least `least` rows."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n__"))
    same = reduce(lambda a, c: a & c, [F.col(f"x.{k}").eqNullSafe(F.col(f"n.{k}")) for k in by], F.lit(True))
    x = before(df, order, by=by, out="before__").alias("x").join(n.alias("n"), same)
    return x.select("x.*", (((F.col("before__") + 1) % step == 0) & (F.col("n__") >= least)).alias("held")).drop("before__")


def gram(df: DataFrame, xs: list[Column], y: Column, by: list[str]) -> DataFrame:
    """(by..., n, the sums of all products of xs and y): all that least squares needs, in one aggregate."""
    k = len(xs)
    cols = [*xs, y]
    x = df.select(*by, *[c.cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def solve(row: dict, k: int, ridge: np.ndarray | None = None) -> np.ndarray | None:
    """Coefficients from one row of `gram`; None where the design has no full rank."""
    a, b = np.empty((k, k)), np.empty(k)
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"g{i}_{j}"]
        b[i] = row[f"g{i}_{k}"]
    if ridge is not None:
        return np.linalg.solve(a + np.diag(ridge), b)
    s = np.sqrt(np.maximum(np.diag(a), 1e-300))
    if row["n"] < LEAST_ROWS or np.linalg.matrix_rank(a / np.outer(s, s), tol=1e-10) < k:
        return None
    return np.linalg.solve(a / np.outer(s, s), b / s) / s


def fit(observations: DataFrame, order: list[str]) -> DataFrame:
    """(model_id, batch, intercept_s, prefill_s_per_token, decode_s_per_token, n, r2, rmse_s, holdout_r2, holdout_n) of
    observations(model_id, batch, prefill_tokens, decode_tokens, seconds): least squares with every fourth row held out. Groups of too
    few rows or of less than full rank give none. Only one row of sums per group comes to the driver."""
    from tidemark.operators.stats import r2_rmse

    spark = observations.sparkSession
    x = holdout(observations, ["model_id", "batch"], order)
    g = gram(x.where("NOT held"), [F.lit(1.0), F.col("prefill_tokens"), F.col("decode_tokens")], F.col("seconds"), ["model_id", "batch"])
    rows = []
    for r in g.collect():
        beta = solve(r.asDict(), 3)
        if beta is not None:
            rows.append((r["model_id"], r["batch"], *map(float, beta)))
    f = spark.createDataFrame(rows, "model_id string, batch int, intercept_s double, prefill_s_per_token double, decode_s_per_token double")
    p = x.join(F.broadcast(f), ["model_id", "batch"]).withColumn("yhat", latency())
    own = r2_rmse(p.where("NOT held"), "seconds", "yhat", ["model_id", "batch"]).withColumnRenamed("rmse", "rmse_s")
    out = r2_rmse(p.where("held"), "seconds", "yhat", ["model_id", "batch"]).select("model_id", "batch", F.col("r2").alias("holdout_r2"), F.col("n").alias("holdout_n"))
    return f.join(own, ["model_id", "batch"]).join(out, ["model_id", "batch"], "left").fillna(0, ["holdout_n"])


def validate(rows: DataFrame, coefficients: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Imputed against measured seconds of serving rows with exact token counts, per model."""
    from tidemark.operators.stats import r2_rmse

    x = impute(rows.where("mode = 'serving' AND tokens_exact AND wall_ms > 0"), coefficients).where("imputed_s IS NOT NULL").withColumn("measured", F.col("wall_ms") / 1000)
    m = x.groupBy("model_id").agg(F.avg("measured").alias("mean_measured_s"), F.avg("imputed_s").alias("mean_imputed_s"))
    return r2_rmse(x, "measured", "imputed_s", ["model_id"]).join(m, "model_id").withColumn("passed", F.col("r2") > threshold)


def price_api(prefill: Column, decode: Column, cached: Column, usd_in: float, usd_out: float, cached_share: float = 0.1) -> Column:
    """Dollars of a call by token prices per million; cached prefill tokens cost a share."""
    return ((prefill - cached) * usd_in + cached * (usd_in * cached_share) + decode * usd_out) / 1e6
