import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.normalize import norm_id
from tidemark.llm import pairs as P
from tidemark.session import load

PROMPT = "Write a function `total` taking `rows`. Each row holds a price and a count. Sum the price of every row whose count exceeds three. Return the sum as an integer. An empty input yields zero."
CODE = "```python\ndef total(rows):\n    s = 0\n    for r in rows:\n        if r['count'] > 3:\n            s += r['price']\n    return s\n```"


def answers(scale):
    from pathlib import Path

    at = Path(f"/root/testdata/sf{scale}")
    if not at.is_dir():
        pytest.skip("no test data here")
    g, t = pd.read_parquet(at / "generations.parquet", columns=["task_id", "text", "code", "finish_reason"]), pd.read_parquet(at / "tasks.parquet", columns=["task_id", "prompt"])
    key = lambda s: s.str.strip().str.lower()
    g["prompt"] = key(g["task_id"]).map(dict(zip(key(t["task_id"]), t["prompt"])))
    g["answer"] = g["text"].where(g["text"].fillna("").str.strip() != "", g["code"])
    g = g.rename(columns={"finish_reason": "finish"}).astype(object)
    return g.where(g.notna(), None)


@pytest.fixture(scope="module")
def crf():
    return P.train(answers(0.01))


CASES = [
    (CODE, None), ("Here is a version that walks the list once.\n\n" + CODE + "\n\nTies keep their first place.", None), ("I can't use recursion here, so this loops.\n\n" + CODE, None), ("total = lambda rows: sum(r['price'] for r in rows)", None),
    ("def total(rows):\n    return 0", None), (CODE + "\nAnd so on ...", None), ("> " + PROMPT.replace("\n", "\n> ") + "\n\n" + CODE, None), ("class Box:\n    def __init__(self):\n        self.x = 1", None),
    ("def total(rows):\n    rows.sort()\n", None), ("def total(rows):\n    for r in rows:\n        if r:\n            return r\n", None),
    (None, "empty"), ("  \n ", "empty"), ("None", "empty"), ("...", "empty"), ("```python\n\n```", "empty"), ("<answer></answer>", "empty"), ("def total(rows):\n    pass", "empty"), ("```python\ndef total(rows):\n    ...\n```", "empty"), ("```python\n# your code here\n```", "empty"), ("Two variables are all we need.\n\n```python\n```", "empty"),
    ("```python\ndef total(rows):\n    s = 0\n    for r in ro", "truncated"), ("def total(rows):\n    if not rows:\n        return 0\n    s = 0", "truncated"), ("The helper below keeps the price as it goes. I tried the", "truncated"), ("```python\ndef total(rows):\n    acc = []\n    for r in rows:\n        acc.append(r)\n```", "truncated"),
    ("I'm sorry, but I can't help with this function.", "refusal"), ("Unfortunately I must decline this task. Please ask your instructor.", "refusal"), ("```python\n# I am unable to write this function.\n```", "refusal"), ('def total(rows):\n    raise NotImplementedError("I won\'t be providing this function.")', "refusal"),
    (PROMPT, "copied_prompt"), ("Restated: " + PROMPT.upper(), "copied_prompt"), ("Task:\n" + PROMPT[:150], "copied_prompt"),
    ("```\nfunction total(rows) {\n  return rows.filter(r => r.count > 3).length;\n}\n```", "other_language"), ("func total(rows []int) int {\n\treturn len(rows)\n}", "other_language"), ("```ruby\ndef total(rows)\n  rows.select { |r| r > 3 }.sum\nend\n```", "other_language"),
    ("Zuerst wird die leere Eingabe behandelt. Die Grenze wird vor dem Ende geprüft.\n\n" + CODE, "other_language"), ("首先处理空输入的情况。 时间只随列表长度增长。", "other_language"), ("Prima si gestisce il caso della lista vuota. Il limite viene controllato prima della fine.\n\n" + CODE, "other_language"),
]


@pytest.mark.parametrize("answer, want", CASES)
def test_defects(crf, answer, want):
    a, tags = P.tagged(P.Clauses(), crf, [answer], [PROMPT], ["stop"])[0]
    assert P.defect(a, tags) == want


def test_the_tags_decide(crf):
    """With every clause tagged as answer no answer is defective."""
    for answer, want in CASES:
        a, tags = P.tagged(P.Clauses(), crf, [answer], [PROMPT], ["stop"])[0]
        assert len(tags) == len(a["clauses"]) > 0 and P.defect(a, [P.ANSWER] * len(tags)) is None


def test_the_language_is_judged_against_the_prompt(crf):
    de = "Schreibe eine Funktion `total` mit dem Parameter `rows`. Die Summe wird für jede Zeile gebildet und nicht gerundet."
    a, tags = P.tagged(P.Clauses(), crf, ["Zuerst wird die leere Eingabe behandelt.\n\n" + CODE], [de], ["stop"])[0]
    assert P.defect(a, tags) is None


def test_very_long_odd_and_absent_inputs(crf):
    for answer in ("x " * 200_000, "```" * 5_000, "(" * 3_000, "\ud800 broken", "a\x00b", "def f():\n" + "    x = 1\n" * 20_000 + "    return x"):
        for prompt in (None, "", PROMPT):
            P.tagged(P.Clauses(), crf, [answer], [prompt], [None])


def test_operator_on_nulls_empty_tables_and_repeats(spark):
    rows = spark.createDataFrame([(1, "t", CODE, None, "stop"), (2, "t", None, None, None), (3, None, " ", "def f():\n    pass", "stop"), (4, "gone", CODE, None, "stop"), (5, "t", PROMPT, "x", "stop"), (6, "t", PROMPT, "x", "stop")], "id long, task string, text string, code string, finish string")
    prompts = P.prompts_of(spark.createDataFrame([("t", PROMPT), ("t", PROMPT), (None, "x")], "task string, prompt string"), "task", "prompt")
    got = {r["id"]: r["defect"] for r in P.defects(rows, prompts).collect()}
    assert got == {2: "empty", 3: "empty", 5: "copied_prompt", 6: "copied_prompt"}
    assert P.defects(rows.limit(0), prompts).count() == 0


def test_held_out_refusals_are_found_without_their_log(spark, sf):
    """Rows logged as refused, with the log struck out, are mostly found by the field alone."""
    at = sf.replace("0.001", "0.01")
    g = load(spark, at, "generations").select(F.col("delivery_id").alias("id"), norm_id("task_id").alias("task"), "text", "code", F.col("finish_reason").alias("finish"))
    logged = {r["id"] for r in g.where("finish = 'refusal' AND NOT coalesce(text, '') LIKE '%def %' AND length(trim(text)) BETWEEN 10 AND 150").collect()}
    t = load(spark, at, "tasks").select(norm_id("task_id").alias("task"), "prompt")
    blind = g.withColumn("finish", F.when(F.pmod("id", F.lit(2)) == 0, "stop").otherwise(F.col("finish")))
    got = {r["id"]: r["defect"] for r in P.defects(blind, P.prompts_of(t, "task", "prompt")).collect()}
    held = [i for i in logged if i % 2 == 0]
    assert held and sum(got.get(i) == "refusal" for i in held) >= 0.85 * len(held)


def test_most_held_out_refusals_are_found_on_more_rows():
    """As above on ten times as many rows, without Spark."""
    g = answers(0.1)
    said = g["answer"].fillna("")
    logged = (g["finish"] == "refusal") & ~said.str.contains("def |lambda") & said.str.strip().str.len().between(10, 150)
    held = logged & (g.index % 2 == 0)
    g.loc[g.index % 2 == 0, "finish"] = "stop"
    field = P.train(g[~said.str.contains(P.GIVES) | (g.index % 8 == 0)])
    h = g[held]
    got = [P.defect(a, t) for a, t in P.tagged(P.Clauses(), field, h["answer"].tolist(), h["prompt"].tolist(), h["finish"].tolist())]
    assert len(h) > 50 and sum(x == "refusal" for x in got) >= 0.95 * len(h)


def test_the_field_learns_a_chain(spark):
    """A label that only its neighbour tells is learned through the pair weights."""
    import numpy as np

    from tidemark.llm.crf import Crf

    rng = np.random.default_rng(1)
    feats, rows, y = [], [], []
    for r in range(200):
        kind = rng.integers(2)
        feats += [kind, 2]
        rows += [r, r]
        y += [kind, kind]
    c = Crf(2, 4)
    f, e, rr = np.array(feats), np.arange(1, len(feats) + 1), np.array(rows)
    c.fit(f, e, rr, np.array(y), steps=80)
    assert (c.tag(f, e, rr) == np.array(y)).mean() > 0.99


def test_a_fit_costs_by_the_features_that_occur():
    """Weights that no row has take no memory and no steps; they stay as they were."""
    import tracemalloc

    import numpy as np

    from tidemark.llm.crf import Crf

    c = Crf(2, 1 << 20)
    c.w[7] = 0.5
    f = np.array([3, 900_000] * 50)
    tracemalloc.start()
    c.fit(f, np.arange(1, 101), np.arange(100), np.array([0, 1] * 50), steps=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    assert c.w[3, 0] > c.w[3, 1] and c.w[900_000, 1] > c.w[900_000, 0] and (c.w[7] == 0.5).all() and np.flatnonzero(c.w.any(axis=1)).tolist() == [3, 7, 900_000]


def test_an_answer_takes_few_calls(crf):
    """Features of a clause's place are looked up as one, so an answer costs little beside its parsing."""
    import cProfile
    import pstats

    g, p = answers(0.01), cProfile.Profile()
    rows = [g[c].tolist() for c in ("answer", "prompt", "finish")]
    p.runcall(P.tagged, P.Clauses(), crf, *rows)
    assert pstats.Stats(p).total_calls < 210 * len(g)
