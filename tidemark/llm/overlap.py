"""Same or nearly the same records on both sides of a split: similarity-hash fingerprints, all compared across the split.

Texts are first brought to canonical words, and equal ones become one class. A class gets a fingerprint of BITS bits: the signs of a
weighted sum over its words and pairs of neighbouring words, each weighted by how few classes have it. Two classes that share most of
that differ in few bits. Every class of one side is compared with every class of the other, in tiles of TILE classes a side; what
lies within RADIUS is verified on the words themselves. So no pair within RADIUS is missed at any size. The comparisons grow with the
square of the classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.text import Hashes, mix, shingles, words
from tidemark.session import cut

BITS = 256
#: Classes of either side that one task compares, at most about; and those compared at a time, which keeps its arrays in the cache.
TILE, STRIP = 8_192, 16
#: Bits in which two fingerprints may differ; unrelated ones differ in some 120, other tasks in the same phrases in 70 and more.
RADIUS = 78
#: Least share of common triples of words. Restated prompts keep 0.39 and more, other tasks in the same phrases 0.27 at most.
K, SIMILAR = 3, 0.32
#: Bits of the table that counts in how many classes a feature stands. Its size is fixed; features that fall together count together.
TABLE = 20

_EXAMPLE = re.compile(r"^[ \t]*>>>.*(?:\n(?![ \t]*(?:\n|>>>|\"\"\")).*)*", re.M)


def problem_words(prompt: str | None) -> list[str]:
    """The words of a prompt that pose its problem: without the examples that show calls and their values."""
    return words(_EXAMPLE.sub(" ", prompt or ""))


def _features(h: np.ndarray) -> np.ndarray:
    """Distinct features of a text by its word hashes: words and pairs of neighbours."""
    return np.unique(np.concatenate([h, shingles(h, 2)]))


def classes(records: DataFrame, record: str, text: str) -> DataFrame:
    """(record, class, words): canonical words of each record, and a class that equal ones share. Records without a word are left out,
    as are NULL records; a record with several texts is in several classes."""

    def canonical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = [" ".join(problem_words(t)) for t in b["text"]]
            yield pd.DataFrame({"record": b["record"], "words": w})

    x = records.select(F.col(f"`{record}`").cast("string").alias("record"), F.col(f"`{text}`").cast("string").alias("text")).where("record IS NOT NULL AND text IS NOT NULL")
    x = x.mapInPandas(canonical, "record string, words string").where("words <> ''")
    return x.groupBy("record", F.xxhash64("words").alias("class")).agg(F.first("words").alias("words"))


def fingerprints(texts: DataFrame) -> DataFrame:
    """(class, b0..b3): the fingerprint of each row of `texts`(class, words), in four 64-bit parts."""
    spark = texts.sparkSession
    n = texts.count()

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hs, c = Hashes(), np.zeros(1 << TABLE, np.int64)
        for b in batches:
            for w in b["words"]:
                np.add.at(c, np.unique(mix(_features(hs.of(w.split()))) >> np.uint64(64 - TABLE)), 1)
        at = np.flatnonzero(c)
        yield pd.DataFrame({"at": at, "n": c[at]})

    table = np.ones(1 << TABLE, np.float64)
    # At most 2**TABLE rows.
    df = texts.select("words").mapInPandas(counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table[df["at"].to_numpy()] = df["n"].to_numpy()
    weight = np.sqrt(np.maximum(np.log((n + 1) / table), 0.05))
    weight[table <= 1] = 0.8  # a word that no other class has, most often a slip, tells nothing
    weights = spark.sparkContext.broadcast(weight.astype(np.float32))

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hs, w = Hashes(), weights.value
        for b in batches:
            bits = np.zeros((len(b), BITS), bool)
            for r, t in enumerate(b["words"]):
                f = mix(_features(hs.of(t.split())))
                by = w[f >> np.uint64(64 - TABLE)]
                with np.errstate(over="ignore"):
                    parts = np.stack([mix(f + np.uint64(i) * np.uint64(0x9E3779B97F4A7C15)) for i in range(1, BITS // 64 + 1)], axis=1)
                signs = np.unpackbits(parts.view(np.uint8).reshape(len(f), -1), axis=1)
                bits[r] = by @ signs.astype(np.float32) > by.sum() / 2
            longs = np.packbits(bits, axis=1).view(np.int64)
            yield pd.DataFrame({"class": b["class"], **{f"b{i}": longs[:, i] for i in range(4)}})

    return texts.mapInPandas(prints, "class long, b0 long, b1 long, b2 long, b3 long")


def within(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y, both of four 64-bit columns, of all pairs that differ in at most `radius` bits."""
    xs, ys = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    at, of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(0, len(x), STRIP):
        apart = np.zeros((len(x[i : i + STRIP]), len(y)), np.uint16)
        for p, q in zip(xs, ys):
            apart += np.bitwise_count(p[i : i + STRIP, None] ^ q)
        a, b = np.nonzero(apart <= radius)
        at.append(a + i)
        of.append(b)
    return np.concatenate(at), np.concatenate(of)


def similar_classes(texts: DataFrame) -> DataFrame:
    """(a, b): classes a with `left` and b with `right` whose texts are much the same, of `texts`(class, words, left, right); a <> b.

    Either side is hashed into tiles, and each tile of one meets each of the other in a task of its own, so no task holds more than two.
    """
    fp = cut(fingerprints(texts).join(texts.select("class", "left", "right"), "class"))
    n = fp.agg(F.count_if("left").alias("left"), F.count_if("right").alias("right")).first()
    tiles = {side: max(1, -(-n[side] // TILE)) for side in ("left", "right")}
    f = ["b0", "b1", "b2", "b3"]

    def tiled(side: str, other: str) -> DataFrame:
        own, met = F.pmod(F.xxhash64("class"), F.lit(tiles[side])), F.explode(F.sequence(F.lit(0), F.lit(tiles[other] - 1)))
        return fp.where(side).select(own.cast("int").alias(side), met.alias(other), "class", *f).groupBy("left", "right")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = within(x[f].to_numpy(np.int64).view(np.uint64), y[f].to_numpy(np.int64).view(np.uint64), RADIUS)
        pairs = pd.DataFrame({"a": x["class"].to_numpy()[a], "b": y["class"].to_numpy()[b]})
        return pairs[pairs["a"] != pairs["b"]]

    near = tiled("left", "right").cogroup(tiled("right", "left")).applyInPandas(meet, "a long, b long")
    w = texts.select("class", "words")
    near = near.join(w.select(F.col("class").alias("a"), F.col("words").alias("wa")), "a").join(w.select(F.col("class").alias("b"), F.col("words").alias("wb")), "b")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hs = Hashes()
        for p in batches:
            keep = [_alike(hs.of(x.split()), hs.of(y.split())) >= SIMILAR for x, y in zip(p["wa"], p["wb"])]
            yield p.loc[keep, ["a", "b"]]

    return near.mapInPandas(verified, "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    """Share of common among all triples of words; texts of fewer words count as one shingle."""
    a, b = (np.unique(shingles(h, K)) if len(h) >= K else np.array([mix(h).sum()], np.uint64) for h in (x, y))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def cross_split(records: DataFrame, record: str, text: str, sides: DataFrame) -> DataFrame:
    """(a, b): all pairs of records of which one is on the left and the other on the right, and whose texts are the same or much the
    same; a < b. `sides`(record, left, right) holds each record once; a record may be on both sides. Others are left out.
    """
    c = classes(records, record, text)
    c = cut(c.join(sides.select(F.col(f"`{record}`").alias("record"), "left", "right").where("left OR right"), "record"))
    per = c.groupBy("class").agg(F.first("words").alias("words"), F.bool_or("left").alias("left"), F.bool_or("right").alias("right"))
    per = cut(per)
    both = per.where("left AND right").select(F.col("class").alias("a"), F.col("class").alias("b"))
    met = similar_classes(per).unionAll(both)
    left, right = c.where("left").select(F.col("class").alias("a"), F.col("record").alias("x")), c.where("right").select(F.col("class").alias("b"), F.col("record").alias("y"))
    pairs = met.join(left, "a").join(right, "b").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
