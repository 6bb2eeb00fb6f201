"""Parent-child links to full hierarchies by parallel tree contraction.

Each round rakes every leaf and splices out an independent set of the nodes that have one child; both are recorded. A forest of n
nodes shrinks by a constant factor a round whatever its depth, so a chain of a million links needs some forty rounds, not a
million. What can't shrink away is a loop: it closes on itself as a single node that is its own parent. The recorded contractions
are then undone from the last to the first, each taking root, depth and path from its parent.

All joins of the forward rounds are on the child, which is unique; a parent with a third of all rows as children is only ever an
aggregate's key. In the reverse rounds such a parent is the hot key of a sort-merge join whose other side is unique, which adaptive
execution splits. Every round is written to the checkpoint folder; sizes fall geometrically, so these writes are a small multiple
of the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.normalize import norm_id
from tidemark.operators.ordered import before
from tidemark.session import cut


def links_of(df: DataFrame, node: str, parent: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Distinct (c, p) links and, apart, the distinct nodes of a table in which a node may stand several times.

    Spellings are made canonical. A node that names several parents keeps the one of its first row by `order`.
    """
    x = df.select(norm_id(F.col(f"`{node}`")).alias("c"), norm_id(F.col(f"`{parent}`")).alias("p"), F.col(f"`{order}`").alias("o")).where(F.col("c").isNotNull())
    per = x.groupBy("c").agg(F.min_by("p", F.when(F.col("p").isNotNull(), F.struct(F.col("o").isNull(), "o", "p"))).alias("p"))
    per = cut(per)
    return per.where(F.col("p").isNotNull()), per.select(F.col("c").alias("node"))


def resolve(links: DataFrame, nodes: DataFrame, with_paths: bool = False) -> DataFrame:
    """(node, root, depth[, path]) for each child of `links`(c, p); `nodes`(node) are the nodes that exist.

    A child whose parent doesn't exist is its own root with depth 0. On a loop, and on a way that leads into one, root is the
    smallest node on the loop and depth is -1; its path, where asked for, is NULL. A node that is its own parent is a loop of one.
    `path` lists the nodes from the root down to the node itself. `c` must be unique, without NULLs (see `links_of`).
    """
    real = links.select("p").distinct().join(nodes.select(F.col("node").alias("p")), "p", "left_semi").withColumn("real", F.lit(True))
    e = links.join(real, "p", "left")
    none = F.array().cast("array<string>")
    first = e.select("c", F.when(F.col("real"), F.col("p")).alias("p"), F.lit(1).cast("long").alias("w"), F.col("c").cast("string").alias("mn"), none.alias("via"))
    first = cut(first if with_paths else first.drop("via"))
    more = ["via"] if with_paths else []

    orphans = first.where(F.col("p").isNull()).select(F.col("c").alias("node"))
    alive = first.where(F.col("p").isNotNull())
    records: list[DataFrame] = []
    loops: list[DataFrame] = []
    while True:
        # One aggregate gives each parent's number of children and, where it is one, that child.
        kids = alive.where("c <> p").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("only")).withColumnRenamed("p", "c")
        h = lambda c: F.xxhash64(F.lit(len(records)), c)  # noqa: E731  another order each round
        todo = F.when(F.col("c") == F.col("p"), "loop").when(F.col("n").isNull(), "rake").when((F.col("n") == 1) & (h(F.col("c")) < h(F.col("only"))) & (h(F.col("c")) < h(F.col("p"))), "splice").otherwise("keep")
        state = cut(alive.join(kids, "c", "left").select("c", "p", "w", "mn", *more, "only", todo.alias("todo")))
        n = {r["todo"]: r["count"] for r in state.groupBy("todo").count().collect()}
        if not n:
            break
        records.append(state)
        if n.get("loop"):
            loops.append(state.where("todo = 'loop'"))
        if not n.get("keep"):
            break
        # A spliced node hands its own parent to its only child.
        handed = state.where("todo = 'splice'").select(F.col("only").alias("c"), F.col("p").alias("np"), F.col("w").alias("nw"), F.col("mn").alias("nm"), *([F.concat("via", F.array("c")).alias("nvia")] if with_paths else []))
        alive = (
            state.where("todo = 'keep'")
            .join(handed, "c", "left")
            .select("c", F.coalesce("np", "p").alias("p"), (F.col("w") + F.coalesce("nw", F.lit(0))).alias("w"), F.least("mn", "nm").alias("mn"), *([F.when(F.col("np").isNotNull(), F.concat("nvia", "via")).otherwise(F.col("via")).alias("via")] if with_paths else []))
        )

    # What is known before the first step back: lost parents, roots proper, and loops.
    def rows(df: DataFrame, node: str, root: str, depth: int) -> DataFrame:
        return df.select(F.col(node).alias("node"), F.col(root).alias("root"), F.lit(depth).cast("long").alias("depth"), *([F.when(F.lit(depth) == 0, F.split(node, "(?!)")).alias("path")] if with_paths else []))

    tops = real.select(F.col("p").alias("node")).join(links.select(F.col("c").alias("node")), "node", "left_anti")
    known = rows(tops.unionByName(orphans), "node", "node", 0)
    for x in loops:
        known = known.unionByName(rows(x, "c", "mn", -1))
    # Unions add up partitions; a merge without a shuffle keeps their number.
    width = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = cut(known.coalesce(width))
    def attach(back: DataFrame, to: DataFrame) -> DataFrame:
        depth = F.when(F.col("depth") < 0, F.lit(-1).cast("long")).otherwise(F.col("depth") + F.col("w")).alias("depth")
        path = [F.concat("path", "via", F.array("c")).alias("path")] if with_paths else []
        return back.select("c", F.col("p").alias("node"), "w", *more).join(to, "node").select(F.col("c").alias("node"), "root", depth, *path)

    for state in reversed(records):
        both = known.unionByName(attach(state.where("todo = 'splice'"), known))
        # A raked leaf may hang on a node spliced in the same round, so the spliced ones come back first.
        known = cut(both.unionByName(attach(state.where("todo = 'rake'"), both)).coalesce(width))
    return known.join(links.select(F.col("c").alias("node")), "node", "left_semi")


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, node, links): every pair of an ancestor and a node under it, from the paths of `resolve(with_paths=True)`.

    Its size is the sum of all depths, which is what was asked for. Nodes on or under a loop have no path and give no pairs.
    """
    x = resolved.where(F.col("depth") > 0).select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return x.where(F.col("at") < F.col("depth")).select("ancestor", "node", (F.col("depth") - F.col("at")).alias("links"))


def intervals(resolved: DataFrame) -> DataFrame:
    """(node, root, enter, leave): places of every node of the trees in a walk that goes down first, roots included, from
    `resolve(with_paths=True)`. The nodes under one are those that enter after it and not after it leaves, so all pairs of ancestors
    and descendants stand in one row per node. Nodes on or under a loop have no place.

    The walk is the order of the paths, range-partitioned and never in one task; what hangs below a node is counted by partial sums.
    """
    open_ = resolved.where("depth >= 0").select("node", "root", "path")
    tops = open_.select(F.col("root").alias("node")).distinct().join(open_, "node", "left_anti")
    x = cut(open_.unionByName(tops.select("node", F.col("node").alias("root"), F.array("node").alias("path"))))
    size = x.select(F.explode("path").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    walk = before(x, ["path"], out="enter").select("node", "root", "enter")
    return walk.join(size, "node").select("node", "root", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def whole(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root, depth, path, loop) for every node: as `resolve`, with a row for roots too and a path for each node.

    A loop is opened at its smallest node, its root: paths of nodes on and under it lead from there, and their depth stays -1. `loop`
    lists the loop's nodes from the smallest on, each the parent of the next; NULL where there is none.
    """
    r = cut(resolve(links, nodes, with_paths=True))
    none = F.lit(None).cast("array<string>")
    alone = nodes.join(links.select(F.col("c").alias("node")), "node", "left_anti")
    top = lambda c, depth: (c.alias("node"), c.alias("root"), F.lit(depth).cast("long").alias("depth"), F.array(c).alias("path"))
    open_ = r.where("depth >= 0").unionByName(alone.select(*top(F.col("node"), 0))).withColumn("loop", none)
    bad = r.where("depth < 0").select("node", "root")
    under = cut(links.join(bad.withColumnRenamed("node", "c"), "c"))
    below = resolve(under.where("c <> root").select("c", "p"), bad.select("node"), with_paths=True)
    below = cut(below.withColumn("depth", F.lit(-1).cast("long")).unionByName(under.where("c = root").select(*top(F.col("c"), -1))))
    # The parent of the smallest node ends the loop, so its path is the loop.
    loops = under.where("c = root").select(F.col("p").alias("node")).join(below, "node").select("root", F.col("path").alias("loop"))
    return open_.unionByName(below.join(loops, "root"))


def all_descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, node, links): every pair of two nodes of which one is above the other, from `whole`, loops included.

    links is the least number of links from the node up to the ancestor; on a loop each node is above all others and their descendants.
    """
    x = resolved.select("node", "path", F.coalesce("loop", F.array()).alias("loop"), (F.size("path") - 1).cast("long").alias("deep"))
    up = x.select("node", "deep", F.posexplode("path").alias("at", "ancestor")).where("at < deep").select("ancestor", "node", (F.col("deep") - F.col("at")).alias("links"))
    # What of the loop isn't on the path is reached by going round it.
    round_ = x.where("size(loop) > 0").select("node", "path", "deep", F.size("loop").alias("k"), F.posexplode("loop").alias("at", "ancestor"))
    round_ = round_.where(~F.array_contains("path", F.col("ancestor"))).select("ancestor", "node", (F.col("deep") + F.col("k") - F.col("at")).alias("links"))
    return up.unionByName(round_)
