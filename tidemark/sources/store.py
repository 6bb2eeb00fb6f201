"""Run stores: append-only JSON parts with a manifest that seals them, layers, listings, sidecars, reports and frozen artifacts.

A run is a folder with `generations/`, `rollouts/` (graded) and `cost/`. Parts are written by Spark, whose commit protocol keeps half
written parts out of sight; the manifest comes last, so a run without one isn't read. All paths go through Spark's file systems, so
a store may lie on any of them; only manifests, reports and listings, which are small, pass through the driver.
"""

from __future__ import annotations

import hashlib
import html
import json
import math

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.validate import Refused

_t = {"int": T.IntegerType(), "str": T.StringType(), "float": T.DoubleType(), "bool": T.BooleanType(), "list": T.ArrayType(T.StringType())}
ROLLOUT = T.StructType([
    T.StructField(n, _t[k], True)
    for n, k in (x.split(":") for x in (
        "schema_version:int rollout_id:str run_id:str task_id:str arm:str seed:int params_hash:str split:str dataset:str code_version:str text:str code:str model_id:str prefill_tokens:int decode_tokens:int "
        "wall_ms:float finish_reason:str mode:str batch_size:int backend:str tokens_exact:bool extract_strategy:str code_parses:bool ladder_step:int parent_rollout_id:str gpu_seconds:float imputed_latency_s:float "
        "visible_passed:int visible_total:int hidden_passed:int hidden_total:int error_class:str hack_flags:list grade_duration_s:float created_at:str error:str extra:str").split())
])


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text. Manifests start with "_", so Spark's own readers pass over them."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed over it."""
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    tmp = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(tmp, p)


def append(df: DataFrame, root: str, run_id: str, layer: str = "generations") -> None:
    """Adds parts to a run. A graded layer needs rollout ids; a sealed run takes no more."""
    if layer == "rollouts" and "rollout_id" not in df.columns:
        raise Refused("graded rows need rollout_id")
    if exists(df.sparkSession, f"{root}/{run_id}/_MANIFEST_{layer}.json"):
        raise Refused(f"{run_id} is sealed")
    df.write.mode("append").json(f"{root}/{run_id}/{layer}")


def manifest_counts(df: DataFrame) -> dict:
    """What a manifest says of its rows: counts by arm, finish and strategy, rates, and parameters per arm. A few hundred values."""
    by = lambda c: {str(r[0]): r[1] for r in df.groupBy(c).count().collect()}
    one = df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("finish_reason") == "length").cast("double")).alias("t"), F.avg((~F.col("tokens_exact")).cast("double")).alias("a")).first()
    params = {r["arm"]: sorted(r["p"]) for r in df.groupBy("arm").agg(F.collect_set("params_hash").alias("p")).collect()}
    return {"rows": one["n"], "truncation_rate": one["t"], "approximate_rate": one["a"], "by_arm": by("arm"), "by_finish": by("finish_reason"), "by_strategy": by("extract_strategy"), "params": params}


def part_digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """sha256 of every part, computed where the parts are read."""
    return {r["path"].rpartition("/")[2]: r["h"] for r in spark.read.format("binaryFile").load(f"{folder}/part-*").select("path", F.sha2("content", 256).alias("h")).collect()}


def seal(spark: SparkSession, root: str, run_id: str, layer: str = "generations") -> dict:
    """Counts and digests from what is on disk, a Parquet copy, and the manifest last."""
    at = f"{root}/{run_id}/{layer}"
    df = read_json(spark, at)
    df.write.mode("overwrite").parquet(f"{root}/{run_id}/{layer}_parquet")
    m = {"run_id": run_id, "layer": layer, "publishable": not run_id.endswith("-dirty"), "counts": manifest_counts(df), "parts": part_digests(spark, at)}
    write_text(spark, f"{root}/{run_id}/_MANIFEST_{layer}.json", json.dumps(m, sort_keys=True, indent=1))
    return m


def _parsed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Lines with the path of their part and, parsed, their row; `_corrupt` holds a line that doesn't parse."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType(), True)])
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("path")).where(F.trim("value") != "")
    return lines.select("path", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("row"))


def read_json(spark: SparkSession, folder: str, schema: T.StructType = ROLLOUT) -> DataFrame:
    """Rows of all parts, with the schema stated and never inferred. A torn last line of a part is left out; any other line that
    doesn't parse is refused."""
    if damaged(spark, folder, schema).limit(1).count():
        raise Refused(f"{folder}: a line that isn't the last of its part is damaged")
    return _parsed(spark, folder, schema).where("row._corrupt IS NULL").select("row.*").drop("_corrupt")


def damaged(spark: SparkSession, folder: str, schema: T.StructType = ROLLOUT) -> DataFrame:
    """(path, line) of lines that don't parse and have another line after them in their part. Only the corrupt lines are compared with
    their file's end; whole files are read only where a part has one."""
    bad = _parsed(spark, folder, schema).where("row._corrupt IS NOT NULL").select("path", F.col("row._corrupt").alias("line"))
    files = [r[0] for r in bad.select("path").distinct().collect()]
    if not files:
        return spark.createDataFrame([], "path string, line string")
    ends = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.element_at(F.split(F.rtrim("value"), "\n"), -1).alias("last"))
    return bad.join(ends, "path").where("line <> last").select("path", "line")


def select_layer(spark: SparkSession, root: str, run_id: str) -> str:
    """The graded layer if it is sealed, else the generations; a graded layer without a seal is half graded and refused."""
    if exists(spark, f"{root}/{run_id}/_MANIFEST_rollouts.json"):
        return "rollouts"
    if exists(spark, f"{root}/{run_id}/rollouts"):
        raise Refused(f"{run_id} is half graded")
    return "generations"


def load_run(spark: SparkSession, root: str, run_id: str, splits: tuple[str, ...] = ("train", "val"), unlock: str | None = None) -> DataFrame:
    """Rows of a sealed run in the splits asked for. `test` needs the path of a file that says why it is unlocked."""
    if "test" in splits and not (unlock and exists(spark, unlock)):
        raise Refused("the test split is locked")
    layer = select_layer(spark, root, run_id)
    if not exists(spark, f"{root}/{run_id}/_MANIFEST_{layer}.json"):
        raise Refused(f"{run_id} isn't sealed")
    return read_json(spark, f"{root}/{run_id}/{layer}").where(F.col("split").isin(*splits))


def list_runs(spark: SparkSession, root: str, layer: str = "generations") -> list[str]:
    """Ids of the sealed runs under a root, in order. None is ever taken for the latest."""
    fs, p = _fs(spark, root)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(r for r in found if exists(spark, f"{root}/{r}/_MANIFEST_{layer}.json"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b): how many rows either copy has that the other lacks, repeats counted."""
    cols = a.columns
    h = lambda d: d.select(F.xxhash64(*[F.to_json(F.struct(c)) for c in cols]).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    x = h(a).withColumnRenamed("n", "na").join(h(b).withColumnRenamed("n", "nb"), "h", "full").fillna(0)
    return x.agg(F.coalesce(F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))), F.lit(0)).alias("only_b"))


def split_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """(task_id, split) of a manifest in any of its three shapes: {split: [ids]}, {id: split}, or either under splits or task_ids."""
    m = manifest.get("splits") or manifest.get("task_ids") or manifest
    rows = [(t, s) for s, ts in m.items() if isinstance(ts, list) for t in ts] + [(t, s) for t, s in m.items() if isinstance(s, str)]
    return spark.createDataFrame(rows, "task_id string, split string")


def coefficient_table(spark: SparkSession, text: str | None) -> DataFrame:
    """Coefficients from {models: {model: {batch: fit}}}; none where the file is missing, an error where it is damaged."""
    schema = "model_id string, batch int, intercept_s double, prefill_s_per_token double, decode_s_per_token double, r2 double, rmse_s double, holdout_r2 double, n int, holdout_n int"
    rows = []
    for model, fits in (json.loads(text)["models"] if text is not None else {}).items():
        rows += [(model, int(b), *[None if f.get(k) is None else float(f[k]) for k in ("intercept_s", "prefill_s_per_token", "decode_s_per_token", "r2", "rmse_s", "holdout_r2")], f.get("n"), f.get("holdout_n")) for b, f in fits.items()]
    return spark.createDataFrame(rows, schema)


def canonical(value: object) -> object:
    """A report's value with floats rounded to 6 digits and what isn't finite as null."""
    if isinstance(value, dict):
        return {str(k): canonical(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else None
    return value


def dumps(value: object) -> str:
    return json.dumps(canonical(value), sort_keys=True, indent=1) + "\n"


def leaves(report: object) -> dict[tuple, object]:
    """Every value of a report under its path of keys and places. An object or list stands under its own path too, as its kind."""
    out: dict[tuple, object] = {}
    todo: list[tuple[tuple, object]] = [((), report)]
    while todo:
        at, v = todo.pop()
        inner = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else None
        out[at] = v if inner is None else (type(v).__name__, len(v) if isinstance(v, list) else None)
        todo += [((*at, k), x) for k, x in inner or ()]
    return out


def diff(a: object, b: object) -> list[tuple[str, str]]:
    """(path, kind) of what differs between two reports: added, removed, type, length or value. Below a path that differs nothing more
    is told."""
    was, now = leaves(a), leaves(b)
    found: dict[tuple, str] = {}
    for at in sorted(was.keys() | now.keys(), key=lambda p: (len(p), [str(k) for k in p])):
        if any(at[:i] in found for i in range(len(at))):
            continue
        if at not in now:
            found[at] = "removed"
        elif at not in was:
            found[at] = "added"
        elif was[at] != now[at] or type(was[at]) is not type(now[at]):
            x, y = was[at], now[at]
            kinds = [v[0] if isinstance(v, tuple) else type(v).__name__ for v in (x, y)]
            found[at] = "type" if kinds[0] != kinds[1] else "length" if isinstance(x, tuple) else "value"
    # What came or went first, then what changed.
    order = sorted(found.items(), key=lambda x: (x[1] not in ("removed", "added"), [str(k) for k in x[0]]))
    return [("$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k}" for k in at), kind) for at, kind in order]


def render_html(title: str, rows: list[dict]) -> str:
    """One page, without any outside file: a row per policy with its interval as a bar on a common scale."""
    have = [r for r in rows if r.get("low") is not None and r.get("high") is not None]
    lo, hi = min((r["low"] for r in have), default=0.0), max((r["high"] for r in have), default=1.0)
    wide = (hi - lo) or 1.0
    body = []
    for r in rows:
        bar = ""
        if r.get("low") is not None and r.get("high") is not None:
            x, w = 200 * (r["low"] - lo) / wide, max(1.0, 200 * (r["high"] - r["low"]) / wide)
            bar = f'<svg width="204" height="12"><rect x="{x:.1f}" y="3" width="{w:.1f}" height="6"/></svg>'
        cells = "".join(f"<td>{html.escape(str(canonical(v)))}</td>" for k, v in r.items())
        body.append(f"<tr>{cells}<td>{bar}</td></tr>")
    head = "".join(f"<th>{html.escape(str(k))}</th>" for k in (rows[0] if rows else {}))
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}<th></th></tr>{''.join(body)}</table>"


def write_report(spark: SparkSession, folder: str, payload: dict, rows: list[dict]) -> dict:
    """results.json, report.html, and a manifest with the digest of each."""
    files = {"results.json": dumps(payload), "report.html": render_html("report", rows)}
    for name, text in files.items():
        write_text(spark, f"{folder}/{name}", text)
    m = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in files.items()}
    write_text(spark, f"{folder}/_MANIFEST.json", dumps(m))
    return m


def write_decisions(df: DataFrame, folder: str) -> dict:
    """Decisions as JSON, which counts, and Parquet, and the manifest last."""
    df.write.mode("overwrite").json(f"{folder}/decisions.jsonl")
    df.write.mode("overwrite").parquet(f"{folder}/decisions.parquet")
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("lam").alias("lams"), F.count_distinct("task_id").alias("tasks")).first().asDict()
    write_text(df.sparkSession, f"{folder}/_MANIFEST.json", dumps(n))
    return n


def save_policy(spark: SparkSession, folder: str, heads: dict, feature_names: list[str]) -> None:
    """Coefficients and the features they are for, as text that can be read by eye."""
    write_text(spark, f"{folder}/policy.json", json.dumps({"features": feature_names, "heads": heads}, sort_keys=True, indent=1))


def load_policy(spark: SparkSession, folder: str, feature_names: list[str]) -> dict:
    """The coefficients; refused if the features have moved since."""
    p = json.loads(read_text(spark, f"{folder}/policy.json"))
    if p["features"] != list(feature_names):
        raise Refused("the feature set has moved since the policy was fitted")
    return p["heads"]


def freeze(files: dict[str, bytes], constants: dict) -> dict:
    """What is submitted: the digest of every file, and the constants."""
    return {"files": {n: hashlib.sha256(b).hexdigest() for n, b in sorted(files.items())}, "constants": canonical(constants)}


def thawed(frozen: dict, files: dict[str, bytes], constants: dict) -> list[str]:
    """What has changed since: files changed, missing or new, and constants."""
    now = freeze(files, constants)
    a, b = frozen["files"], now["files"]
    out = [f"missing:{n}" for n in a.keys() - b.keys()] + [f"appeared:{n}" for n in b.keys() - a.keys()] + [f"changed:{n}" for n in a.keys() & b.keys() if a[n] != b[n]]
    return sorted(out) + [f"constant:{p}" for p, _ in diff(frozen["constants"], now["constants"])]
