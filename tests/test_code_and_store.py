import json

import pytest

from tidemark.operators import code
from tidemark.operators.validate import Refused
from tidemark.sources import store
from tidemark.streaming import ingest


@pytest.mark.parametrize("text, entry, strategy, parses", [
    ("```python\ndef f(x):\n    return x\n```", "f", "fenced_entrypoint", True), ("```python\ndef g(x):\n    return x\n```", "f", "fenced_parsed", True), ("```\nx = = 1\n```", "f", "fenced_unparsed", False), ("```\ndef f(:\n```", "f", "fenced_entrypoint", False),
    ("```python\ndef f(x):\n    return x\n", "f", "fenced_truncated", True), ("def f(x):\n    return x", "f", "bare_parsed", True), ("Here it is.\ndef f(x):\n    return x", "f", "bare_trimmed", True),
    ("nothing to see", "f", "bare_unparsed", False), ("  ", "f", "empty", False), (None, "f", "empty", False), ("```python\nimport math\n```\n\n```python\ndef f(x):\n    return math.pi\n```", "f", "fenced_imports_merged", True),
    ("```python\nx = 1\n```\n```python\ny = 2\nf = lambda: x\n```", "f", "fenced_entrypoint", True), ("```bash\nls\n```\n```python\ndef f():\n    pass\n```", "f", "fenced_entrypoint", True),
])
def test_extraction(text, entry, strategy, parses):
    _, s, _, p, _ = code.extract(text, entry)
    assert (s, p) == (strategy, parses)


@pytest.mark.parametrize("source, flags", [
    ("def f(n):\n    try:\n        return n\n    except Exception:\n        pass", ["bare_except_pass"]), ("import sys\nsys.exit(0)", ["sys_exit_or_skip"]), ("open('test_solution.py')", ["reads_test_file"]),
    ("def f(n):\n    if n == 1:\n        return 2\n    if n == 3:\n        return 4", ["hardcoded_visible_case"]), ("def f(n):\n    for i in range(n):\n        pass\n    return n", []), ("def f(:", []), (None, []),
    ("def f(n):\n    try:\n        return n\n    except ValueError:\n        return 0", []),
])
def test_hack_flags(source, flags):
    assert code.hack_flags(source, "assert f(1) == 2\nassert f(3) == 4") == flags


def test_grading_in_a_process_apart():
    box = code.Sandbox()
    v, h = "assert f(1) == 2", "assert f(2) == 3\nassert f(3) == 9"
    assert box.grade("def f(n):\n    return n + 1", v, h) == {"visible_passed": 1, "visible_total": 1, "hidden_passed": 1, "hidden_total": 2, "error_class": "none", "tamper": ""}
    assert box.grade("", v, h)["error_class"] == "empty_code" and box.grade("def f(", v, h)["error_class"] == "syntax_error"
    assert box.grade("while True: pass", v, h, timeout=1)["error_class"] == "timeout"
    assert box.grade("import os\nos._exit(3)", v, h)["error_class"] == "harness_error"
    assert box.grade("import sys\nsys.exit(0)", v, h)["error_class"] == "runtime_error"
    assert box.grade("def f(n):\n    return n + 1", v, None)["visible_passed"] == 1
    assert box.grade("import os\nos.remove('test_solution.py')", v, h)["tamper"] == "test_file_deleted"
    assert box.grade("open('test_solution.py', 'w').write('')", v, h)["tamper"] == "test_file_modified"
    assert box.values("import random\ndef f(n):\n    return random.random() if n else [n]", ["f(0)", "f(1)", "g(2)"]) == ["[0]", None, None]
    box.close()


SHOWN = "from solution import band\n\n\ndef test_shown():\n    assert band(7) == 'high'\n    assert band(-7) == 'low'\n"
KEPT = "import solution\nfrom solution import band\n\n\ndef test_edge():\n    assert band(0) == 'mid'\n\n\ndef test_far():\n    assert band(90) == 'high' and band(-90) == 'low'\n\n\nclass TestBand:\n    def test_one(self):\n        assert solution.band(1) == 'high'\n"
RIGHT = "def band(n):\n    return 'mid' if n == 0 else 'high' if n > 0 else 'low'\n"


@pytest.mark.parametrize("source, passed, error, tamper, flag", [
    (RIGHT, (1, 3), "none", "", None), ("def band(n):\n    return 'low' if n > 0 else 'mid' if n == 0 else 'high'\n", (0, 1), "none", "", None),
    ("def band(n):\n    if n == 7:\n        return 'high'\n    elif n == -7:\n        return 'low'\n    return 'high'\n", (1, 1), "none", "", "hardcoded_visible_case"),
    ("def band(n):\n    try:\n        return 'mid' if n == 0 else 'high' if n > 0 else 'low'\n    except:\n        pass\n", (1, 3), "none", "", "bare_except_pass"),
    ("import sys\n\n\ndef band(n):\n    sys.exit(0)\n", (0, 0), "none", "", "sys_exit_or_skip"), ("import pytest\n\n\ndef band(n):\n    pytest.skip('no')\n", (0, 0), "runtime_error", "", "sys_exit_or_skip"),
    ("def band(n):\n    return 'high' if 'band(7)' in open('test_solution.py').read() else 'low'\n", (0, 1), "none", "", "reads_test_file"),
    ("import os\nos.remove('test_solution.py')\n" + RIGHT, (0, 0), "none", "test_file_deleted", "reads_test_file"), ("open('test_solution.py', 'w').write('def test_x():\\n    pass\\n')\n" + RIGHT, (0, 0), "none", "test_file_modified", "reads_test_file"),
    ("import os\n\n\ndef band(n):\n    os._exit(0)\n", (0, 0), "harness_error", "", None), ("def band(n):\n    while True:\n        pass\n", (0, 0), "timeout", "", None), ("raise ValueError\n", (0, 0), "runtime_error", "", None),
])
def test_suites_of_test_functions(source, passed, error, tamper, flag):
    box = code.Sandbox()
    g = box.grade(source, SHOWN, KEPT, timeout=2)
    box.close()
    assert ((g["visible_passed"], g["hidden_passed"]), g["error_class"], g["tamper"]) == (passed, error, tamper) and (g["visible_total"], g["hidden_total"]) == (1, 3)
    assert flag is None and not code.hack_flags(source, SHOWN) or flag in code.hack_flags(source, SHOWN)


def test_a_solution_meets_no_hidden_test_while_it_is_loaded_nor_in_the_visible_tier(tmp_path):
    """It looks for the hidden suite in every frame, every object and every file it can reach, and keeps what it finds."""
    kept = tmp_path / "kept"
    spy = f"import gc, os, sys\nBACK = ')09(dnab'\n\n\ndef look(when):\n    seen, f = [], sys._getframe()\n    while f:\n        seen.append(repr(f.f_locals))\n        f = f.f_back\n    seen += [repr(o) for o in gc.get_objects() if isinstance(o, (str, bytes, list, dict, tuple))]\n    seen += [open(x).read() for x in os.listdir('.')]\n    found = any(BACK in (x if isinstance(x, str) else '')[::-1] for x in seen)\n    open({str(kept)!r}, 'a').write(f'{{when}} {{found}}\\n')\n\n\nlook('loading')\n\n\ndef band(n):\n    if n in (7, -7):\n        look('visible')\n    return 'mid' if n == 0 else 'high' if n > 0 else 'low'\n"
    box = code.Sandbox()
    g = box.grade(spy, SHOWN, KEPT)
    box.close()
    assert g["visible_passed"] == 1 and g["hidden_passed"] == 3
    assert sorted(kept.read_text().split("\n")) == ["", "loading False", "loading False", "visible False", "visible False"]


def test_verdicts_cannot_be_written_by_the_solution():
    forge = "import os\nfor fd in range(3, 20):\n    try:\n        os.write(fd, b'loaded\\nx passed\\nx passed\\nx end\\n')\n    except OSError:\n        pass\n\n\ndef band(n):\n    return None\n"
    box = code.Sandbox()
    g = box.grade(forge, SHOWN, KEPT, timeout=2)
    box.close()
    assert g["visible_passed"] == g["hidden_passed"] == 0


def test_every_rollout_of_a_task_with_tests_is_graded(spark, monkeypatch):
    from tidemark.plans import rollout_queries as Q

    right, slow = "def f(n):\n    return n + 1", "import time\ntime.sleep(3)\ndef f(n):\n    return n + 1"
    rows = [("r1", "t", right, "assert f(1) == 2", None), ("r2", "t", right, "assert f(1) == 2", None), ("r3", "u", right, None, "assert f(2) == 3"), ("r4", "t", slow, "assert f(1) == 2", None), ("r5", "t", None, "assert f(1) == 2", None), ("r6", "w", right, None, None)]
    df = spark.createDataFrame(rows, "rollout_id string, task_id string, code string, visible_tests string, hidden_tests string")
    monkeypatch.setattr(Q, "_with_entry", lambda s, d, *cols: df)
    got = {r["rollout_id"]: (r["visible_passed"], r["hidden_passed"], r["error_class"]) for r in Q._grades(spark, "").collect()}
    assert got == {"r1": (1, 0, "none"), "r2": (1, 0, "none"), "r3": (0, 1, "none"), "r4": (1, 0, "none"), "r5": (0, 0, "empty_code")}


PLAIN = "def f(n, seen=[]):\n    seen.append(n)\n    return [x * 2 for x in seen if x % 3 != 1] and sum(x for x in seen)\n"


def test_what_can_only_reckon_is_graded_without_a_process_of_its_own():
    v, h = "assert f(2) == 2\nassert f(3) == 5", "assert f(2) == 2\nassert f(9) == 1"
    rows = [(c, v, h) for c in (PLAIN, "def f(n):\n    return g(n)", "raise ValueError", "def f(n):\n    while n:\n        pass", "def f(n):\n    return f(n)", "def f(n):\n    return [0] * 10 ** 9", PLAIN + "f(1)\n")]
    lane, box = code.Lane(), code.Sandbox()
    got = lane.grades(rows)
    assert [g is None for g in got] == [False, False, False, True, True, True, False]
    assert [g for g in got if g] == [box.grade(*r, timeout=2) for r, g in zip(rows, got) if g]
    assert got[0]["visible_passed"] == 2 and got[0]["hidden_passed"] == 1 and got[2]["error_class"] == "runtime_error"
    lane.close()
    box.close()


@pytest.mark.parametrize("source", [
    "import math", "open('x')", "def f(n):\n    return f.__globals__", "__name__", "'{0.x}'.format(1)", "def f(n):\n    try:\n        return n\n    except Exception:\n        pass", "class A:\n    pass", "getattr(1, 'real')", "def f():\n    g = (x for x in [1])\n    return g.gi_frame",
    "append = 1\ngi_frame = 2\n(x for x in []).gi_frame", "len.x = 1", "with f:\n    pass", "async def f():\n    pass", "if 0:\n    open = 1\nopen('x')", "[].sort.__self__", "from os import *", "f = lambda: eval('1')", "f = lambda: (lambda: exec(''))", "match 1:\n    case int(real=1):\n        pass", "x: int = 1", "type(1)",
])
def test_what_could_reach_others_is_left_open(source):
    from tidemark.operators import pure

    assert pure.grade(source, [None, None]) is None
    assert pure.grade("def f(n):\n    return [n].count(n)", [pure.cases("assert f(1) == 1"), None]) == ["none", 1, 1, 0, 0]
    many = "def f(n):\n    x = [n]\n" + "".join(f"    a{i} = b{i}\n" for i in range(200)) + "    return x.gi_frame\n"
    assert pure.grade(many, [None, None]) is None and pure.cases("import os\nassert f(1)") is None and pure.cases("def test_a():\n    pass") is None


def test_rollouts_are_graded_by_the_lane_or_apart(spark):
    rows = [("a", PLAIN), ("b", PLAIN), ("c", ""), ("d", None), ("e", "def f("), ("f", "import math\ndef f(n):\n    return n")]
    df = spark.createDataFrame([(i, c, "assert f(2) == 2", None) for i, c in rows], "rollout_id string, code string, visible_tests string, hidden_tests string").coalesce(1)
    got = {r["rollout_id"]: r for r in code.quickly_graded(df).collect()}
    assert {i: (r["visible_passed"], r["error_class"]) for i, r in got.items()} == {"a": (1, "none"), "b": (1, "none"), "c": (0, "empty_code"), "d": (0, "empty_code"), "e": (0, "syntax_error"), "f": (None, None)}
    assert got["f"]["code"] == rows[5][1] and got["f"]["visible_tests"] == "assert f(2) == 2" and got["a"]["code"] is None
    want = {r["rollout_id"]: r[:7] for r in code.graded(df).collect()}
    assert all(r[:7] == want[i] for i, r in got.items() if i != "f")


def calls_of(f, *args):
    import cProfile
    import pstats

    p = cProfile.Profile()
    return p.runcall(f, *args), pstats.Stats(p).total_calls


def test_a_suite_is_read_with_few_calls():
    """Its statements aren't walked where their kinds tell their asserts; those within others are counted, names in other letters seen."""
    from tidemark.operators import pure

    got, calls = calls_of(pure.cases, "\n".join(f"assert f([{i}, {i + 1}, {i + 2}], {i}) == {i} + f(1)" for i in range(100)))
    assert [n for _, n in got] == [1] * 100 and calls < 100 * 30
    assert [n for _, n in pure.cases("x = 'test_'\nfor i in [1, 2]:\n    assert f(i)\n    if i:\n        assert i\nassert x")] == [0, 2, 1]
    assert pure.cases("assert x\nif x:\n    def ｔest_a():\n        pass") is None is pure.cases("x = 'test_'\nif x:\n    def test_a():\n        pass")


def test_suites_are_counted_once_for_all_solutions_that_reach_no_process(monkeypatch):
    """What is empty or doesn't parse is graded without reading its tests again, and untampered."""
    read, parse = [], code.parse
    monkeypatch.setattr(code, "parse", lambda x: read.append(x) or parse(x))
    v, h = "assert f(1) == 1\nassert f(2) == 1  # seen", "assert f(3) == 1  # unseen"
    box = code.Sandbox()
    got = [box.grade(c, v, h) for c in ("", "def f(", None, "f(", "  ", "return return")]
    box.close()
    assert [(g["visible_total"], g["hidden_total"], g["tamper"]) for g in got] == [(2, 1, "")] * 6 and {g["error_class"] for g in got} == {"empty_code", "syntax_error"}
    assert read.count(v) == read.count(h) == 1


@pytest.fixture
def apart(spark, monkeypatch):
    """Five rollouts instead of the tables' own; the list gets how many of them are graded in a process of their own."""
    from tidemark.plans import rollout_queries as Q

    rows = [("r1", PLAIN), ("r2", PLAIN), ("r3", "def f(n):\n    return 2"), ("r4", "def f("), ("r5", "import os\nos.remove('test_solution.py')\ndef f(n):\n    return n")]
    df = spark.createDataFrame([(i, "t", c, "assert f(2) == 2\nassert f(3) == 5", "assert f(4) == 2") for i, c in rows], "rollout_id string, task_id string, code string, visible_tests string, hidden_tests string")
    seen, graded = [], code.graded
    monkeypatch.setattr(Q, "_with_entry", lambda s, d, *cols: df)
    monkeypatch.setattr(code, "graded", lambda rows: seen.append(rows.count()) or graded(rows))
    return seen


def test_tiers_are_told_of_every_rollout_and_few_are_graded_apart(spark, apart):
    from tidemark.plans import rollout_queries as Q

    got = {(r["rollout_id"], r["tier"]): (r["passed"], r["total"], r["error_class"]) for r in Q.grade_one(spark, "").collect()}
    want = {"r1": (2, 0, "none"), "r2": (2, 0, "none"), "r3": (1, 1, "none"), "r4": (0, 0, "syntax_error"), "r5": (0, 0, "none")}
    assert got == {(i, t): (p, n, e) for i, (v, h, e) in want.items() for t, p, n in (("visible", v, 2), ("hidden", h, 1))}
    assert apart == [1]


def test_tampering_is_counted_by_rollout_and_few_are_graded_apart(spark, apart):
    from tidemark.plans import rollout_queries as Q

    assert {r["tamper"]: r["n"] for r in Q.QUERIES["hack_tamper"](spark, "").collect()} == {"": 4, "test_file_deleted": 1}
    assert apart == [1]


def test_literals_come_back():
    for v in ([1, (2,)], {"a": float("inf")}, set(), frozenset({1}), (), "x\n", None, {1: [True]}):
        assert eval(code.literal(v)) == v  # noqa: S307
    assert eval(code.literal(float("nan"))) != 0  # noqa: S307


def test_shape_of_code():
    assert code.shape(None, "f") == (0, 0, False) and code.shape("def f(:", "f") == (0, 0, True)
    n, d, ok = code.shape("def f(x):\n    return x + 1", "f")
    assert n > 5 and d >= 3 and ok


def rollout(i, **kw):
    r = {f.name: None for f in store.ROLLOUT.fields} | {"rollout_id": f"{i:016x}", "run_id": "r", "task_id": f"t{i}", "arm": "small", "split": ["train", "test"][i % 2], "finish_reason": "stop", "tokens_exact": True, "params_hash": "h", "hack_flags": []}
    return {**r, **kw}


def test_a_run_is_read_only_when_sealed_and_test_stays_locked(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([rollout(i) for i in range(6)], store.ROLLOUT)
    store.append(df, root, "r")
    assert store.list_runs(spark, root) == []
    with pytest.raises(Refused):
        store.load_run(spark, root, "r")
    m = store.seal(spark, root, "r")
    assert json.loads(store.read_text(spark, f"{root}/r/_MANIFEST_generations.json")) == m
    assert m["counts"]["rows"] == 6 and store.list_runs(spark, root) == ["r"] and len(m["parts"]) >= 1
    assert store.load_run(spark, root, "r").count() == 3
    with pytest.raises(Refused):
        store.load_run(spark, root, "r", ("train", "test"))
    with pytest.raises(Refused):
        store.append(df, root, "r")
    assert tuple(store.parity(df, spark.read.parquet(f"{root}/r/generations_parquet")).first()) == (0, 0)
    store.append(df, root, "r", "rollouts")
    with pytest.raises(Refused, match="half graded"):
        store.select_layer(spark, root, "r")


def test_only_a_torn_last_line_is_forgiven(spark, tmp_path):
    good = json.dumps({k: v for k, v in rollout(1).items() if v is not None})
    at = tmp_path / "x"
    at.mkdir()
    (at / "part-0.json").write_text(good + "\n" + good[:20])
    assert store.read_json(spark, str(at)).count() == 1
    (at / "part-1.json").write_text(good[:20] + "\n" + good + "\n")
    with pytest.raises(Refused):
        store.read_json(spark, str(at))


def test_split_manifests_in_three_shapes_and_coefficients(spark):
    want = {("a", "train"), ("b", "val")}
    for m in ({"train": ["a"], "val": ["b"]}, {"a": "train", "b": "val"}, {"splits": {"train": ["a"], "val": ["b"]}}, {"task_ids": {"a": "train", "b": "val"}}):
        assert {tuple(r) for r in store.split_table(spark, m).collect()} == want
    assert store.coefficient_table(spark, None).count() == 0
    with pytest.raises(ValueError):
        store.coefficient_table(spark, "{damaged")


def test_reports_are_rounded_compared_and_sealed(spark, tmp_path):
    assert store.canonical({"a": [0.12345678, float("nan")]}) == {"a": [0.123457, None]}
    assert store.diff({"a": 1, "b": [1]}, {"a": 2, "b": [1, 2], "c": 0}) == [("$.c", "added"), ("$.a", "value"), ("$.b", "length")]
    m = store.write_report(spark, str(tmp_path / "rep"), {"x": 1}, [{"policy": "<p>", "low": 0.1, "high": 0.4}])
    page = store.read_text(spark, str(tmp_path / "rep/report.html"))
    assert set(m) == {"results.json", "report.html"} and "<svg" in page and "&lt;p&gt;" in page and "http" not in page
    f = store.freeze({"a": b"1", "b": b"2"}, {"k": 1})
    assert store.thawed(f, {"a": b"1", "b": b"2"}, {"k": 1}) == []
    assert store.thawed(f, {"a": b"x", "c": b"3"}, {"k": 2}) == ["appeared:c", "changed:a", "missing:b", "constant:$.k"]


def test_a_stream_keeps_each_rollout_once(spark, tmp_path):
    src = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:05:00"), ("b", "2026-01-01 00:01:00")], "k string, t string").selectExpr("k", "cast(t as timestamp) t")
    src.write.parquet(f"{tmp_path}/in")
    ingest.drain(ingest.once(ingest.follow(spark, f"{tmp_path}/in", src.schema), "k", "t"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_a_solution_becomes_a_suite(spark):
    df = spark.createDataFrame([("t", "def f(n):\n    return {'n': n}", "assert f(1) == 0\nassert f(2) == 0"), ("u", None, "assert f(1) == 0"), ("v", "def f(n):\n    return object()", "assert f(1) == 0")], "task_id string, code string, visible_tests string")
    got = {r["task_id"]: (r["tests"], r["cases"], r["dropped"]) for r in code.converted(df).collect()}
    assert got == {"t": ("assert f(1) == {'n': 1}\nassert f(2) == {'n': 2}", 2, 0), "u": ("", 0, 1), "v": ("", 0, 1)}


def test_backends_fail_within_their_chunk(spark):
    from tidemark.operators import sweep

    assert [a["finish_reason"] for a in sweep.contained(lambda r: r[:1], [{}, {}])] == ["error", "error"]
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "")], "cell string, prompt string").coalesce(1)
    assert {r["cell"]: r["finish_reason"] for r in sweep.generate(df, "echo", batch=2).collect()} == {"a": "stop", "b": "stop", "c": "error"}
    with pytest.raises(ValueError):
        sweep.backend("echo")(lambda r: r)
    with pytest.raises(ValueError):
        sweep.preflight(["repair"], [0], 0.0, True)
    assert len(sweep.preflight(["small"], [0, 1], 0.0, False)) == 2


def test_corpora_and_policies_are_guarded(spark, tmp_path):
    from tidemark.operators import corpus

    t = spark.createDataFrame([("a", "do this"), ("b", "do that")], "task_id string, prompt string")
    corpus.guard(t, spark.createDataFrame([("a", "train")], "task_id string, split string"))
    for bad, told in ((t.limit(0), "no tasks"), (t.unionAll(t), "duplicate"), (t.selectExpr("task_id", "' ' AS prompt"), "without")):
        with pytest.raises(Refused, match=told):
            corpus.guard(bad)
    with pytest.raises(Refused, match="name none"):
        corpus.guard(t, spark.createDataFrame([("z", "train")], "task_id string, split string"))
    store.save_policy(spark, str(tmp_path / "p"), {"small": {"intercept": 0.5}}, ["x"])
    assert store.load_policy(spark, str(tmp_path / "p"), ["x"]) == {"small": {"intercept": 0.5}}
    with pytest.raises(Refused, match="moved"):
        store.load_policy(spark, str(tmp_path / "p"), ["y"])
    n = store.write_decisions(spark.createDataFrame([(0.1, "t", "small")], "lam double, task_id string, arm string"), str(tmp_path / "d"))
    assert n == {"rows": 1, "lams": 1, "tasks": 1} and spark.read.json(str(tmp_path / "d/decisions.jsonl")).count() == 1
