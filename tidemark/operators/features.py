"""Prompt and code features as column builders. A feature is given only the columns it declares, so it can't read a label.

Names carry their family: h_ features split words at blanks and count the text "assert"; d0_ features take words as runs of letters,
digits and "_" and count test lines; d1_ features need a generation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordered import before

# Words and patterns that the features count.
ALGORITHMIC_PATTERN = r"(?i)\b(graph|dynamic|recursi\w*|optimi[sz]\w*|permutation|combinat\w*|backtrack\w*|matrix|modulo|prime|binary search|dijkstra|knapsack)\b"
ALGORITHMIC_WORDS = ["graph", "tree", "dynamic", "recursive", "recursion", "optimize", "optimal", "minimum", "maximum", "shortest", "permutation", "combination", "matrix", "prime", "sort", "search"]
LOOP_WORDS = ["for", "while", "each", "every", "iterate", "repeat"]
TODO_MARKS = ["todo", "fixme", "not implemented", "notimplemented", "pass  #", "..."]
FINISH_REASONS = ["stop", "length", "refusal", "error"]


@dataclass(frozen=True)
class Feature:
    name: str
    point: str
    columns: tuple[str, ...]
    build: Callable[..., Column]
    group: str = ""


REGISTRY: dict[str, Feature] = {}


def feature(name: str, point: str, *columns: str, group: str = "") -> Callable:
    """Registers a builder. Labels are refused where the feature is declared, not where it is used."""

    from tidemark.operators.validate import LABELS

    if set(columns) & {*LABELS, "wall_ms"}:
        raise ValueError(f"{name} reads what a feature may never read")
    if point not in ("D0", "D1"):
        raise ValueError(f"{name}: {point!r} is no decision point")

    def add(build: Callable[..., Column]) -> Callable[..., Column]:
        REGISTRY[name] = Feature(name, point, columns, build, group)
        return build

    return add


def build(df: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """key and the named features, each from its declared columns. Missing columns are an error that names them all."""
    need = {c for n in names for c in REGISTRY[n].columns}
    if missing := sorted(need - set(df.columns)):
        raise KeyError(f"features need columns that aren't there: {', '.join(missing)}")
    return df.select(*key, *[REGISTRY[n].build(*[F.col(c) for c in REGISTRY[n].columns]).cast("double").alias(n) for n in names])


def names(point: str, prefix: str = "") -> list[str]:
    """Registered features readable at a decision point, D0's at D1 too."""
    return [n for n, f in REGISTRY.items() if (f.point == "D0" or point == "D1") and n.startswith(prefix)]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _count(c: Column, part: str) -> Column:
    """How often a text stands in another, without overlaps."""
    return (F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)


def _lines(c: Column) -> Column:
    return F.size(F.filter(F.split(_text(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != ""))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(r"((?U)\w+)"), 1)


feature("h_prompt_chars", "D0", "prompt", group="size")(lambda p: F.length(_text(p)))
feature("h_prompt_words", "D0", "prompt", group="size")(lambda p: F.size(F.filter(F.split(_text(p), r"\s+"), lambda x: x != "")))
feature("h_prompt_lines", "D0", "prompt", group="size")(lambda p: _count(_text(p), "\n") + 1)
feature("h_n_visible_tests", "D0", "visible_tests", group="tests")(lambda v: _count(_text(v), "assert"))
feature("h_control_keywords", "D0", "prompt", group="words")(lambda p: F.regexp_count(_text(p), F.lit(r"\b(for|while|if)\b")))
feature("h_algorithmic_terms", "D0", "prompt", group="words")(lambda p: F.regexp_count(_text(p), F.lit(ALGORITHMIC_PATTERN)))
feature("d0_prompt_chars", "D0", "prompt", group="size")(lambda p: F.length(_text(p)))
feature("d0_prompt_words", "D0", "prompt", group="size")(lambda p: F.size(_words(p)))
feature("d0_prompt_sentences", "D0", "prompt", group="size")(lambda p: F.size(F.filter(F.split(F.trim(F.regexp_replace(_text(p), r"\s", " ")), r"[.!?]+"), lambda x: F.trim(x) != "")))
feature("d0_prompt_mean_word_len", "D0", "prompt", group="size")(lambda p: F.coalesce(F.aggregate(_words(p), F.lit(0), lambda a, x: a + F.length(x)) / F.when(F.size(_words(p)) > 0, F.size(_words(p))), F.lit(0.0)))
feature("d0_n_visible_tests", "D0", "visible_tests", group="tests")(_lines)
feature("d0_visible_test_chars", "D0", "visible_tests", group="tests")(lambda v: F.length(_text(v)))
feature("d0_visible_assert_density", "D0", "visible_tests", group="tests")(lambda v: F.coalesce(_count(_text(v), "assert") / F.when(_lines(v) > 0, _lines(v)), F.lit(0.0)))
feature("d0_algorithmic_keywords", "D0", "prompt", group="words")(lambda p: sum((_count(F.lower(_text(p)), w) for w in ALGORITHMIC_WORDS), F.lit(0)))
feature("d0_loop_keywords", "D0", "prompt", group="words")(lambda p: F.size(F.filter(_words(p), lambda x: F.lower(x).isin(LOOP_WORDS))))
feature("d0_has_code_block", "D0", "prompt", group="surface")(lambda p: F.contains(_text(p), F.lit("```")).cast("int"))
feature("d0_digit_density", "D0", "prompt", group="surface")(lambda p: F.coalesce(F.regexp_count(_text(p), F.lit(r"\p{Nd}")) / F.when(F.length(_text(p)) > 0, F.length(_text(p))), F.lit(0.0)))
feature("d0_entrypoint_len", "D0", "entrypoint", group="surface")(lambda e: F.length(_text(e)))
feature("d0_entrypoint_words", "D0", "entrypoint", group="surface")(lambda e: F.size(F.filter(F.split(_text(e), "_"), lambda x: x != "")))

_V = ("visible_passed", "visible_total")
_has = lambda t: F.coalesce(t > 0, F.lit(False))
_zero = lambda p: F.coalesce(p, F.lit(0))
feature("d1_visible_pass_rate", "D1", *_V, group="visible_outcome")(lambda p, t: F.when(_has(t), _zero(p) / t).otherwise(0.0))
feature("d1_visible_all_passed", "D1", *_V, group="visible_outcome")(lambda p, t: (_has(t) & (_zero(p) == t)).cast("int"))
feature("d1_visible_none_passed", "D1", *_V, group="visible_outcome")(lambda p, t: (_has(t) & (_zero(p) == 0)).cast("int"))
feature("d1_has_visible_tests", "D1", "visible_total", group="visible_outcome")(lambda t: _has(t).cast("int"))
feature("d1_visible_failed_count", "D1", *_V, group="visible_outcome")(lambda p, t: F.when(_has(t), F.greatest(F.lit(0), t - _zero(p))).otherwise(0))
feature("d1_code_chars", "D1", "code", group="code")(lambda c: F.length(_text(c)))
feature("d1_code_lines", "D1", "code", group="code")(_lines)
feature("d1_code_parses", "D1", "code_parses", group="code")(lambda c: F.coalesce(c, F.lit(False)).cast("int"))
feature("d1_code_has_todo", "D1", "code", group="code")(lambda c: sum((F.contains(F.lower(_text(c)), F.lit(m)).cast("int") for m in TODO_MARKS), F.lit(0)) > 0)
for _r in FINISH_REASONS:
    feature(f"d1_finish_{_r}", "D1", "finish_reason", group="generation")(lambda f, r=_r: F.coalesce(f == r, F.lit(False)).cast("int"))
feature("d1_decode_tokens", "D1", "decode_tokens", group="generation")(_zero)
feature("d1_prefill_tokens", "D1", "prefill_tokens", group="generation")(_zero)
feature("d1_extraction_was_bare", "D1", "extract_strategy", group="generation")(lambda s: F.startswith(_text(s), F.lit("bare")).cast("int"))
feature("d1_had_error", "D1", "error", group="generation")(lambda e: (F.trim(_text(e)) != "").cast("int"))
feature("d1_hack_flag_count", "D1", "hack_flags", group="generation")(lambda h: F.greatest(F.lit(0), F.coalesce(F.size(h), F.lit(0))))


def siblings(df: DataFrame) -> DataFrame:
    """df(rollout_id, task_id, arm, visible_passed, visible_total) with the mean visible pass rate of the other draws of the same task
    and arm, 0.5 where there are none to see, and their number. Sums per (task, arm) are joined back instead of a window, so a task
    with a third of all rows isn't gathered."""
    rate = F.when(F.col("visible_total") > 0, F.coalesce("visible_passed", F.lit(0)) / F.col("visible_total"))
    x = df.withColumn("r__", rate)
    s = x.groupBy("task_id", "arm").agg(F.sum("r__").alias("s__"), F.count("r__").alias("n__"), F.count(F.lit(1)).alias("c__"))
    x = x.join(s, ["task_id", "arm"])
    others = F.col("n__") - F.col("r__").isNotNull().cast("int")
    mean = F.when(others > 0, (F.col("s__") - F.coalesce("r__", F.lit(0.0))) / others).otherwise(0.5)
    return x.withColumn("sibling_visible_agreement", mean).withColumn("sibling_count", (F.col("c__") - 1)).drop("r__", "s__", "n__", "c__")


def tokens_approx(c: Column) -> Column:
    """About 3.6 characters a token, at least one for any text, rounded half to even."""
    return F.when(F.length(_text(c)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(F.length(_text(c)) / F.lit(3.6), 0).cast("int")))


def constant_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, constant) for each column: whether its range is 0. One pass."""
    one = df.agg(*[F.coalesce(F.max(c) - F.min(c) == 0, F.lit(True)).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("constant")) for c in cols])).alias("x")).select("x.*")


def not_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, bad): how many values of each column are NULL, NaN or infinite. One pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("bad")) for c in cols])).alias("x")).select("x.*")


def long_form(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, feature, value) of wide features."""
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select(F.col(key).alias("task_id"), "x.*")


def fold(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """df with a fold of 0 .. k - 1 that is the same for all rows of a key, by the order of the keys' hashes."""
    h = F.md5(F.concat(F.lit(f"F|{seed}|"), F.col(key)).cast("binary"))
    keys = before(df.select(key).distinct().withColumn("h__", h), ["h__", key], out="at__").select(key, (F.col("at__") % k).alias("fold"))
    return df.join(keys, key)


def others(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with, of the other rows of its group, how many there are (others), have a value (others_seen) and its sum (others_passed). A row
    is left out by itself, not by its value. Groups are summed up first and joined back, so none is sorted or held in one task."""
    v = F.col(value)
    per = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n__"), F.count(v).alias("c__"), F.coalesce(F.sum(v), F.lit(0)).alias("s__"))
    x = df.join(per, by)
    return x.withColumns({"others": F.col("n__") - 1, "others_seen": F.col("c__") - v.isNotNull().cast("long"), "others_passed": F.col("s__") - F.coalesce(v, F.lit(0)).cast("long")}).drop("n__", "c__", "s__")
