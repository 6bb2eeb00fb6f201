import random

import pytest

from tidemark.operators import hierarchy
from tidemark.operators.graph import connected_components


def brute(pairs, nodes):
    up = {c: p for c, p in pairs if p in nodes}
    out = {}
    for c, _ in pairs:
        seen, at = [c], c
        while at in up and up[at] not in seen:
            at = up[at]
            seen.append(at)
        if at in up:
            out[c] = (min(seen[seen.index(up[at]) :]), -1, None)
        else:
            out[c] = (at, len(seen) - 1, tuple(reversed(seen)))
    return out


def resolved(spark, pairs, nodes):
    links = spark.createDataFrame(pairs, "c string, p string")
    df = hierarchy.resolve(links, spark.createDataFrame([(n,) for n in nodes], "node string"), with_paths=True)
    return {r["node"]: (r["root"], r["depth"], tuple(r["path"]) if r["path"] is not None else None) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_forests_with_chains_stars_loops_and_lost_parents(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(160)]
    pairs = [(names[i], names[rng.randrange(i)]) for i in range(1, 60) if rng.random() < 0.9]
    pairs += [(names[i], names[i - 1]) for i in range(61, 100)]  # a chain
    pairs += [(names[i], names[100]) for i in range(101, 120)]  # a star
    pairs += [(names[120], names[122]), (names[121], names[120]), (names[122], names[121]), (names[123], names[122]), (names[124], names[123])]  # a loop with a tail
    pairs += [(names[125], names[125]), (names[126], "gone"), (names[127], names[126]), (names[128], names[129]), (names[129], names[128])]
    assert resolved(spark, pairs, set(names)) == brute(pairs, set(names))


def test_links_of_takes_the_first_named_parent_in_any_spelling(spark):
    df = spark.createDataFrame([(" B ", None, 1), ("b", "A\t", 2), ("B", "c", 3), ("a", "", 4), (None, "a", 5)], "r string, p string, d long")
    links, nodes = hierarchy.links_of(df, "r", "p", "d")
    assert [tuple(r) for r in links.collect()] == [("b", "a")]
    assert sorted(r[0] for r in nodes.collect()) == ["a", "b"]


def test_no_links_and_no_rows(spark):
    df = spark.createDataFrame([("a", None, 1)], "r string, p string, d long")
    for x in (df, df.limit(0)):
        assert hierarchy.resolve(*hierarchy.links_of(x, "r", "p", "d")).count() == 0


def test_descendants_are_all_pairs_of_ancestor_and_node(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("x", "x")], "c string, p string")
    r = hierarchy.resolve(links, spark.createDataFrame([(n,) for n in "abcdx"], "node string"), with_paths=True)
    assert sorted(map(tuple, hierarchy.descendants(r).collect())) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 330)] + [(None, 1), (5, 5)]
    label = {}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    for a, b in real:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in real:
            label[a] = label[b] = min(label[a], label[b])
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_node_has_a_path_and_loops_have_descendants(spark):
    # b > c > d > b is a loop with the tail d > e > f, x a loop of its own with y under it, p > q a plain link, r alone, s's parent lost.
    up = {"c": "b", "d": "c", "b": "d", "e": "d", "f": "e", "x": "x", "y": "x", "q": "p", "s": "gone"}
    nodes = "bcdefxypqrs"
    links = spark.createDataFrame(list(up.items()), "c string, p string")
    w = hierarchy.whole(links, spark.createDataFrame([(n,) for n in nodes], "node string")).collect()
    got = {r["node"]: (r["root"], r["depth"], "".join(r["path"]), "".join(r["loop"] or [])) for r in w}
    tops = {n: (n, 0, n, "") for n in "prs"}
    assert len(w) == len(nodes) and got == tops | {"q": ("p", 1, "pq", ""), "b": ("b", -1, "b", "bcd"), "c": ("b", -1, "bc", "bcd"), "d": ("b", -1, "bcd", "bcd"), "e": ("b", -1, "bcde", "bcd"), "f": ("b", -1, "bcdef", "bcd"), "x": ("x", -1, "x", "x"), "y": ("x", -1, "xy", "x")}
    want = set()
    for n in nodes:
        at, k, seen = up.get(n), 1, {n}
        while at and at in nodes and at not in seen:
            want.add((at, n, k))
            seen.add(at)
            at, k = up.get(at), k + 1
    pairs = [tuple(r) for r in hierarchy.all_descendants(spark.createDataFrame(w)).collect()]
    assert len(pairs) == len(want) and set(pairs) == want


def test_intervals_tell_the_same_pairs_as_the_descendants(spark):
    rng = random.Random(11)
    up = {f"n{i:03d}": f"n{rng.randrange(max(0, i - 9), i):03d}" for i in range(1, 90) if i % 11} | {"n200": "n201", "n201": "n200", "n202": "n201", "n300": "gone"}
    links = spark.createDataFrame(list(up.items()), "c string, p string")
    nodes = spark.createDataFrame([(n,) for n in {*up, *up.values()} - {"gone"}], "node string")
    r = hierarchy.resolve(links, nodes, with_paths=True)
    at = {x["node"]: (x["enter"], x["leave"]) for x in hierarchy.intervals(r).collect()}
    pairs = {(a, n) for a, (i, j) in at.items() for n, (k, _) in at.items() if i < k <= j}
    assert pairs == {(x["ancestor"], x["node"]) for x in hierarchy.descendants(r).collect()}
    assert sorted(e for e, _ in at.values()) == list(range(len(at))) and not {"n200", "n201", "n202"} & set(at) and at["n300"][0] == at["n300"][1]
    assert hierarchy.intervals(r.limit(0)).count() == 0
