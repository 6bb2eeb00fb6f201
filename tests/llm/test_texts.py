import random

import numpy as np
import pytest

from tidemark.llm import leakage as L, overlap as V, reading as R, text as T

WORDS = [f"{a}{b}" for a in "bal cor den fir gal hem jor kir lan mel".split() for b in "a en or im ul ax et os yn ip".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_words_are_the_same_in_any_dress():
    want = ["the", "old", "queue", "keeps", "42", "naive", "cafes"]
    for s in ("The old queue keeps 42 naive cafes.", "THE OLD QUEUE\nKEEPS -- 42 naïve cafés", "<p>The&nbsp;old&nbsp;queue keeps 42 naive cafes</p>", "Th\u200be old queue keeps 42 na\u0456ve c\u0430fes", "> The old\n> queue keeps\n> 42 naive cafes", "The old queue keeps 42 na\\u00efve caf\\u00e9s", "Ｔｈｅ old queue keeps 42 naive cafes"):
        assert T.words(s) == want
    assert T.words(None) == T.words("") == T.words(" \n-- ") == []


def test_hashes_and_shingles():
    h = T.Hashes(bound=10)
    a = h.of("a b c d".split())
    for _ in range(5):
        h.of([f"w{random.random()}" for _ in range(9)])
    assert (h.of("a b c d".split()) == a).all() and len(T.shingles(a, 5)) == 0 and len(set(T.shingles(a, 2).tolist())) == 3


# --- leakage ------------------------------------------------------------------------------------------------------------------


def docs_and_items(seed=3):
    rng = random.Random(seed)
    shared = ". " + prose(rng, 24).capitalize() + ". "
    items = {i: prose(rng, 30).capitalize() + ". " + prose(rng, 40).capitalize() + (shared if i % 3 == 0 else ". ") + prose(rng, 45).capitalize() + "." for i in range(40)}
    docs, want = {}, set()
    for d in range(150):
        body = [prose(rng, 60) for _ in range(4)]
        i = rng.randrange(40)
        w = items[i].split()
        kind = d % 6
        if kind == 0:  # whole
            body.insert(2, items[i].upper())
        elif kind == 1:  # a part with single words altered
            at = rng.randrange(0, 25)
            part = w[at : at + 45]
            for k in range(4, len(part), 11):
                part[k] = "zzz"
            body.insert(1, " ".join(part))
        elif kind == 2:  # interrupted once
            body.insert(1, " ".join(w[:18]))
            body.insert(2, prose(rng, 15))
            body.insert(3, " ".join(w[18:40]))
        elif kind == 3:  # too short
            body.insert(1, " ".join(w[5:17]))
        elif kind == 4:  # only a shared sentence
            body.insert(1, shared)
        if kind < 3:
            want.add((d, i))
        docs[d] = "\n\n".join(body)
    return docs, items, want


def test_passages_are_found_and_nothing_else(spark):
    docs, items, want = docs_and_items()
    d = spark.createDataFrame([*docs.items(), (900, None), (901, ""), (902, "x " * 300_000)], "doc_id long, text string")
    i = spark.createDataFrame([*items.items(), (0, items[0]), (800, None), (None, "x")], "item_id long, text string")
    assert {tuple(r) for r in L.leaks(d, "doc_id", "text", i, "item_id", "text").collect()} == want
    assert L.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == L.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_blocks_of_items_give_the_same_and_candidates_miss_nothing(spark, monkeypatch):
    docs, items, want = docs_and_items(7)
    monkeypatch.setattr(L, "ITEMS", 15)
    got = L.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(list(items.items()), "item_id long, text string"), "item_id", "text")
    assert {tuple(r) for r in got.collect()} == want


def test_the_weights_of_items_that_share_phrases_do_not_depend_on_the_blocks(spark, sf, monkeypatch):
    from tidemark.session import load

    at = sf.replace("0.001", "0.01")
    ask = lambda: {tuple(r) for r in L.leaks(load(spark, at, "documents"), "doc_id", "text", load(spark, at, "eval_items"), "item_id", "text").collect()}
    whole = ask()
    monkeypatch.setattr(L, "ITEMS", 40)
    monkeypatch.setattr(L, "GROUP", 2)
    assert ask() == whole and len(whole) > 30


def test_an_unbroken_passage_counts_though_its_shingles_stand_in_many_items(spark):
    """Own words of one item, every three of which in a row stand in nine others too."""
    rng = random.Random(5)
    told = prose(rng, 24).replace(".", "").split()
    items = {0: " ".join(told)}
    for i in range(1, 10):
        items[i] = f"word{i}. " + ". ".join(" ".join([*told[k : k + 3], f"end{i}x{k}"]) for k in range(len(told) - 2)) + "."
    d = spark.createDataFrame([(1, prose(rng, 40) + " " + " ".join(told) + " " + prose(rng, 40)), (2, prose(rng, 90))], "doc_id long, text string")
    got = L.leaks(d, "doc_id", "text", spark.createDataFrame(list(items.items()), "item_id long, text string"), "item_id", "text")
    assert {tuple(r) for r in got.collect()} == {(1, 0)}


def test_candidates_have_a_recall_of_099_against_brute_force():
    docs, items, _ = docs_and_items(9)
    hs, all_of, met = T.Hashes(), 0, 0
    own = {k: [w for s in L.sentences(t) for w in s] for k, t in items.items()}
    sh = {k: T.shingles(hs.of(w), L.K) for k, w in own.items()}
    every, n = np.unique(np.concatenate([np.unique(x) for x in sh.values()]), return_counts=True)
    n_of = dict(zip(every.tolist(), n.tolist()))
    sizes = np.unique([len(np.unique(x)) for x in sh.values()], return_counts=True)
    cat = L.Catalogue(len(items), every >> np.uint64(64 - L.BITS), dict(zip(*(x.tolist() for x in sizes))))
    ix = L.Index({k: (w, [True] * len(w), list(range(len(sh[k]))), sh[k].tolist(), [n_of[x] for x in sh[k].tolist()]) for k, w in own.items()}, cat)
    for t in docs.values():
        _, hit = cat.hits(hs.of(T.words(t)))
        if len(hit) < L.LEAST:
            continue
        near = {n for n in range(len(ix.ids)) if len(ix.at[n].keys() & set(hit.tolist())) >= L.WINDOW * L.CONTAINED}
        all_of, met = all_of + len(near), met + len(near & ix.candidates(cat.keys(hit)))
    assert met >= 0.99 * all_of > 0


# --- overlap ------------------------------------------------------------------------------------------------------------------


def restated(rng, p):
    w = p.split()
    for _ in range(max(1, len(w) // 14)):
        k = rng.randrange(len(w))
        w[k] = w[k][:1] + w[k][2:] + w[k][1:2]
    return "Problem: " + " ".join(w).upper() + "\n\n>>> f(3)\n4"


def test_cross_split_pairs(spark):
    rng = random.Random(8)
    prompts = {f"t{i:03d}": prose(rng, 70) for i in range(120)}
    near = {}
    for i in range(0, 40, 2):
        near[f"u{i:03d}"] = (restated(rng, prompts[f"t{i:03d}"]), f"t{i:03d}")
    same = {"v001": prompts["t001"] + "\n\n>>> f(1)\n2", "v003": "  " + prompts["t003"].title()}
    rows = [*prompts.items(), *((k, p) for k, (p, _) in near.items()), *same.items(), ("n1", None), ("n2", ""), (None, "x"), ("t000", prompts["t000"])]
    left = set(prompts)
    sides = [(k, k in left, k not in left) for k in {r[0] for r in rows if r[0]}]
    got = V.cross_split(spark.createDataFrame(rows, "task string, prompt string, extra string".replace(", extra string", "")), "task", "prompt", spark.createDataFrame(sides, "task string, left boolean, right boolean"))
    want = {(t, k) for k, (_, t) in near.items()} | {("t001", "v001"), ("t003", "v003")}
    assert {tuple(r) for r in got.collect()} == want
    both = spark.createDataFrame([(k, True, True) for k in ("t001", "v001")], "task string, left boolean, right boolean")
    assert {tuple(r) for r in V.cross_split(spark.createDataFrame(rows, "task string, prompt string"), "task", "prompt", both).collect()} == {("t001", "v001")}
    assert V.cross_split(spark.createDataFrame(rows, "task string, prompt string").limit(0), "task", "prompt", both).count() == 0


@pytest.mark.parametrize("tile", [8_192, 300])
def test_every_pair_at_the_radius_is_met_whatever_the_number_of_classes(spark, monkeypatch, tile):
    """Planted pairs that differ in RADIUS bits among unrelated fingerprints; the words of all are alike, so all met pairs come out."""
    rng = np.random.default_rng(3)
    n, planted = 2_000, 300
    bits = rng.integers(0, 2, (n, V.BITS), dtype=np.uint8)
    for i in range(planted):
        bits[n - 1 - i] = bits[i]
        bits[n - 1 - i, rng.permutation(V.BITS)[: V.RADIUS]] ^= 1
    longs = np.packbits(bits, axis=1).view(np.int64)
    fp = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(longs)], "class long, b0 long, b1 long, b2 long, b3 long")
    monkeypatch.setattr(V, "TILE", tile)
    monkeypatch.setattr(V, "fingerprints", lambda texts: fp)
    texts = spark.createDataFrame([(i, "a b c d", i < n // 2, i >= n // 2) for i in range(n)], "class long, words string, left boolean, right boolean")
    got = {tuple(r) for r in V.similar_classes(texts).collect()}
    apart = np.stack([(bits[i] ^ bits[n // 2 :]).sum(axis=1, dtype=np.int64) for i in range(n // 2)])
    assert got == {(int(a), int(b) + n // 2) for a, b in zip(*np.nonzero(apart <= V.RADIUS))} and len(got) >= planted


def test_fingerprints_have_a_recall_of_09_against_brute_force(spark, sf):
    """All restated pairs of the test data at sf0.01, by comparing every pair, against the operator."""
    import pandas as pd

    t = pd.read_parquet(sf.replace("0.001", "0.01") + "/tasks.parquet", columns=["task_id", "prompt"])
    t["task_id"] = t["task_id"].str.strip().str.lower()
    t = t.drop_duplicates()
    hs = T.Hashes()
    s = [set(T.shingles(hs.of(V.problem_words(p)), V.K).tolist()) for p in t["prompt"]]
    ids = t["task_id"].tolist()
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(len(s)) for j in range(i) if ids[i] != ids[j] and len(s[i] & s[j]) >= V.SIMILAR * len(s[i] | s[j])}
    sides = spark.createDataFrame([(i, True, True) for i in sorted(set(ids))], "task_id string, left boolean, right boolean")
    got = {tuple(r) for r in V.cross_split(spark.createDataFrame(t), "task_id", "prompt", sides).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 0


# --- reading ------------------------------------------------------------------------------------------------------------------

EASY = "Look at the list. Put the key in the box. We ran it once more. It is safe to stop now. The log is old. Ask him first."
MIDDLE = "The router compares the results with the stored baseline and writes a short report. Because prompts differ in length, the reader estimates the answers separately for every model. Our team measured several answers and found that the larger model solved more tasks."
HARD = "Multidimensional autoregressive approximations engender combinatorial proliferation, rendering exhaustive verification computationally prohibitive. Notwithstanding heteroscedasticity, idiosyncratic aggregates facilitate parsimonious interpretation of uncertainties."


def test_prose_leaves_everything_else_out():
    t = "# Head of it\n\n```python\nx = 1\n```\n\n21:28:12 ERROR worker-7 a=1\n\n| a | b |\n|---|---|\n\nretries: 5\nmode = fast\n\ndef f(x):\n    return x\n\n- It is here.\n- So are we; They know.\n\nThis one\nis wrapped. And this."
    assert [s for b in R.prose(t) for s in b] == ["It is here.", "So are we", "They know.", "This one is wrapped.", "And this."]
    assert R.prose(None) == R.prose("") == R.prose("```\nnever closed") == []


def test_levels(spark, sf):
    docs = [(1, EASY), (2, MIDDLE), (3, HARD), (4, EASY + "\n\n" + HARD + " " + HARD), (5, "Wir speichern jede Antwort zusammen mit ihren Kosten. Die Prüfung der Antworten dauert länger als gedacht."), (6, "```\nx = 1\n```"), (7, None), (8, ""), (9, EASY.replace(". ", " and ")), (10, f"{MIDDLE} " * 3_000), (10, MIDDLE)]
    a = spark.read.parquet(f"{sf}/reading_anchors.parquet").selectExpr("anchor_id", "text", "reading_level AS level")
    a = a.unionAll(spark.createDataFrame([(99, None, 1), (98, EASY, None)], "anchor_id long, text string, level int"))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS level", "1 AS n")
    got = sorted((r["doc_id"], r["reading_level"]) for r in R.levels(d, "doc_id", "text", a, "text", "level").collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 3), (9, 1), (10, 2), (10, 2)]
    assert R.levels(d.limit(0), "doc_id", "text", a, "text", "level").count() == 0
    with pytest.raises(ValueError):
        R.levels(d, "doc_id", "text", a.limit(0), "text", "level")


def test_held_out_anchors_come_out_right(sf):
    import pandas as pd

    a = pd.read_parquet(f"{sf}/reading_anchors.parquet")
    counts = np.zeros(1 << R.TABLE)
    for t in a["text"]:
        for w in R.words(t):
            counts[R.bucket(w)] += 1
    lex, lv, right = R.Lexicon(counts), a["reading_level"].to_numpy(), 0
    for k in range(5):
        te = np.arange(len(a)) % 5 == k
        got = [R.english(list(a["text"][~te]), lex, j) for j in R.JOINED]
        m = R.Ordinal(np.concatenate([g[0] for g in got]), np.concatenate([lv[~te][g[1]] for g in got]))
        x, of, size, _ = R.english(list(a["text"][te]), lex)
        p = m.predict(x)
        right += sum(np.bincount(p[of == i], weights=size[of == i], minlength=4).argmax() == lv[te][i] for i in range(te.sum()))
    assert right >= 0.95 * len(a)


def test_polish_and_russian_prose_has_no_level():
    lex = R.Lexicon(np.ones(1 << R.TABLE))
    for t in ("Funkcja zapamiętuje pole podczas przejścia przez listę. Przy remisie zostaje tylko pierwszy element, który jest na początku.", "Сначала проверяется пустой список. Затем функция возвращает первое значение.", "Per ogni caso la lista non viene ordinata. Il limite viene controllato prima della fine."):
        x, _, _, other = R.english([t], lex)
        assert len(x) == 0 and other[0] > 8
    assert len(R.english(["The list is read once. Ties keep their first place."], lex)[0]) == 2
