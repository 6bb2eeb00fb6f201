"""Evaluation passages inside training texts: size-partitioned MinHash containment search, verified on exact shingles.

What holds for all test items together, namely how many of them own a shingle and how large their sets are, is one aggregate. The items
themselves become indexes of bounded size that are sent to all workers, and every document is read whole against them: once for
GROUP indexes. An item is found or not whatever index it is in. No document is shuffled or leaves its task.

In a document only shingles that some item owns matter for containment, so the others are struck out by a bit table; what is left is
cut into windows of WINDOW shingles. That also closes the gap where a passage is interrupted. A window is looked up in the index: the
items' shingle sets are partitioned by size, and each partition has its own number of bands and rows, chosen so that a set of the
partition's largest size which contains the share CONTAINED of a window is found with probability FOUND or more (LSH Ensemble, Zhu
et al., 2016). What is found is verified by aligning the exact shingles of document and item.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.text import Hashes, mix, plain, shingles, words
from tidemark.session import cut

#: Words of a shingle: short, since single words of a passage may be altered.
K = 3
#: Own words of an item that a document must hold, by the statement of the problem.
PASSAGE = 20
#: Shingles of a window (of 20 words with three altered some 9 are left), its step, the share to be found, and with what probability.
WINDOW, STEP, CONTAINED, FOUND = 14, 4, 0.5, 0.995
#: Fewest exact shingles in common with an item before it is aligned.
LEAST = 7
HASHES, SIZE_PARTS = 128, 6
#: Items of an index, about; indexes searched in one pass over the documents; and bits of the table of all items' shingles.
ITEMS, GROUP, BITS = 4_000, 4, 22
#: Words that may be altered or left out in a row, between two runs of a passage.
SLIP = 5
#: A shingle's weight is the squared log of how many items there are for each that has it, 1 for a shingle of a single item. What
#: shingles slipped over count against a chain, of their weight; and the least weight per word of a passage that isn't unbroken. Texts
#: that only tell other things in the same phrases stay under 0.3, altered copies above 0.35.
SLIPPED, DENSE = 0.7, 0.32
#: Words at the ends of a passage that an altered word may hide.
ENDS = 2

_STOP = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text, as canonical words."""
    return [w for s in _STOP.split(plain(text or "")) if (w := words(s))]


def item_sentences(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(id, at, words, shared): every sentence of every item and whether it stands in several items. Rows of the same item count as one."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, at, " ".join(w)) for i, t in zip(b["id"], b["text"]) for at, w in enumerate(sentences(t))]
            yield pd.DataFrame(rows, columns=["id", "at", "words"])

    x = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("id IS NOT NULL")
    s = x.groupBy("id").agg(F.max("text").alias("text")).mapInPandas(cut_up, "id long, at int, words string")
    per = s.groupBy("words").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    return s.join(per, "words").select("id", "at", "words", (F.col("a") < F.col("b")).alias("shared"))


_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, HASHES, np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, np.uint64)


def _hashed(s: np.ndarray) -> np.ndarray:
    """(shingles, HASHES): every hash of every shingle."""
    with np.errstate(over="ignore"):
        return mix(s[:, None] * _A[None, :] + _B[None, :])


def _keys(m: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) keys of minima (sets, HASHES); a key tells its band apart."""
    n = HASHES // rows
    m = m[:, : rows * n].reshape(len(m), n, rows)
    out = m[:, :, 0] + np.arange(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + m[:, :, i])
    return out


class Catalogue:
    """What holds for all items together: how many there are, the table of their shingles, and their partitions by size of set, each
    with its own number of rows and bands."""

    def __init__(self, n: int, bits: np.ndarray, sizes: dict[int, int]):
        """n: items; bits: places of the table in use; sizes: for each size of a set, how many items have it."""
        self.n = n
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[bits] = True
        by, at = sorted(sizes), np.cumsum([sizes[k] for k in sorted(sizes)])
        largest = {by[int(np.searchsorted(at, i * at[-1] / SIZE_PARTS))] for i in range(1, SIZE_PARTS + 1)} if by else set()
        self.parts = []
        for size in sorted(largest):
            common = CONTAINED * WINDOW
            j = common / (size + WINDOW - common)
            rows = next((r for r in (4, 3, 2) if 1 - (1 - j**r) ** (HASHES // r) >= FOUND), 1)
            bands = next((n for n in range(1, HASHES // rows) if 1 - (1 - j**rows) ** n >= FOUND), HASHES // rows)
            self.parts.append((size, rows, bands))

    def part(self, size: int) -> tuple[int, int]:
        """(rows, bands) of a set of that size."""
        return next((r, b) for most, r, b in self.parts if size <= most)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of those shingles of a document, as word hashes, that some item owns."""
        sh = shingles(h, K)
        pos = np.flatnonzero(self.bits[sh >> np.uint64(64 - BITS)])
        return pos, sh[pos]

    def keys(self, hit: np.ndarray) -> dict[int, np.ndarray]:
        """For each number of rows, the band keys of all windows of the hits."""
        h, n = _hashed(hit), len(hit)
        if n <= WINDOW:
            m = h.min(axis=0)[None, :]
        else:
            m = np.stack([h[x : x + WINDOW].min(axis=0) for x in [*range(0, n - WINDOW, STEP), n - WINDOW]])
        return {rows: np.unique(_keys(m, rows)) for rows in {r for _, r, _ in self.parts}}


class Index:
    """Some items, searchable for windows of document shingles."""

    def __init__(self, items: dict[int, tuple[list[str], list[bool], list[int], list[int], list[int]]], cat: Catalogue):
        """items: for each id its words, whether each is in an unshared sentence, and its own shingles: positions, hashes, and how
        many of all items have them."""
        hs = Hashes()
        self.ids = sorted(items)
        self.word, self.own, self.weight, self.at, self.worth = [], [], [], [], []
        tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n, i in enumerate(self.ids):
            ws, own, ps, xs, others = items[i]
            at: dict[int, list[int]] = {}
            w, worth = np.zeros(len(ws) + 1), {}
            for p, x, c in zip(ps, xs, others):
                x &= 0xFFFFFFFFFFFFFFFF
                at.setdefault(x, []).append(p)
                w[p + 1] = (math.log((1 + cat.n) / c) / math.log(1 + cat.n)) ** 2
                # What a shingle weighs in an item, over all the places where it stands there.
                worth[x] = worth.get(x, 0.0) + float(w[p + 1])
            self.word.append(hs.of(ws))
            self.own.append(np.concatenate([[0], np.cumsum(np.array(own, bool))]))
            self.weight.append(np.cumsum(w))
            self.at.append(at)
            self.worth.append(worth)
            if at:
                rows, bands = cat.part(len(at))
                keys = _keys(_hashed(np.array(sorted(at), np.uint64)).min(axis=0)[None, :], rows)[0, :bands]
                tables.setdefault(rows, []).append((keys, np.full(len(keys), n)))
        self.tables = {}
        for rows, both in tables.items():
            keys, item = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])
            by = np.argsort(keys, kind="stable")
            self.tables[rows] = (keys[by], item[by])

    def candidates(self, keys: dict[int, np.ndarray]) -> set[int]:
        """Items (by number) that share a band with some window."""
        out: set[int] = set()
        for rows, (have, item) in self.tables.items():
            k = keys[rows]
            lo, hi = np.searchsorted(have, k, "left"), np.searchsorted(have, k, "right")
            on = np.flatnonzero(hi > lo)
            for x, y in zip(lo[on].tolist(), hi[on].tolist()):
                out.update(item[x:y].tolist())
        return out

    def verified(self, h: np.ndarray, pos: list[int], at: list[int], seen: set[int], keys: dict[int, np.ndarray]) -> list[int]:
        """Ids of the items of which a document, as word hashes with its hits, holds a passage."""
        found = []
        for n in self.candidates(keys):
            have = self.at[n]
            both = have.keys() & seen
            # No chain can weigh more than all that is common.
            if len(both) < LEAST or len(both) < PASSAGE - K + 1 and sum(map(self.worth[n].__getitem__, both)) < DENSE * (PASSAGE - ENDS):
                continue
            pairs = [(j, i) for j, s in zip(pos, at) if s in have for i in have[s]]
            if held(pairs, h, self.word[n], self.own[n], self.weight[n]) >= PASSAGE - ENDS:
                found.append(self.ids[n])
        return found


def search(cat: Catalogue, indexes: list[Index], h: np.ndarray) -> list[int]:
    """Ids of all items of some indexes of which a document, as word hashes, holds a passage."""
    pos, hit = cat.hits(h)
    if len(pos) < LEAST:
        return []
    keys, at = cat.keys(hit), hit.tolist()
    p, seen = pos.tolist(), set(at)
    return [i for ix in indexes for i in ix.verified(h, p, at, seen, keys)]


def held(pairs: list[tuple[int, int]], doc: np.ndarray, item: np.ndarray, own: np.ndarray, weight: np.ndarray) -> int:
    """Own words of the passage of an item that a document holds, in order and interrupted at most once; 0 if there is none.

    pairs: (position in the document, position in the item) of equal shingles. They are joined to runs without a gap, and runs are
    chained over slips, where up to SLIP own words are altered, left out or put in, and over one interruption of any length. What
    the runs weigh counts for a chain, what the item's shingles slipped over weigh counts against it (by SLIPPED), so runs are only
    chained where the words between were altered, not where two tasks merely tell other things in the same phrases. Words of shared
    sentences may be there or not; they neither count nor weigh. Words slipped over belong to the passage. A run of PASSAGE own words
    without any slip is a passage whatever it weighs.
    """
    runs: dict[int, list[list[int]]] = {}
    for j, i in sorted(pairs):
        r = runs.setdefault(j - i, [])
        if r and j <= r[-1][1] + 1:
            r[-1][1] = j
        else:
            r.append([j, j])
    segs = sorted((a, b + K - 1, a - d, b + K - 1 - d) for d, rs in runs.items() for a, b in rs)
    best: list[list[tuple[float, int, float]]] = []
    top = 0
    for n, (ja, jb, ia, ib) in enumerate(segs):
        # A single altered word near an end of the passage hides up to two equal ones beyond it.
        a = ia
        while a >= 2 and ja - ia + a >= 2 and doc[ja - ia + a - 2] == item[a - 2]:
            a -= 2
        z = ib
        while z + 2 < len(item) and jb - ib + z + 2 < len(doc) and doc[jb - ib + z + 2] == item[z + 2]:
            z += 2
        w = float(weight[ib - K + 2] - weight[ia])
        start = (w, int(own[ib + 1] - own[a]), w)
        mine = [start, start]
        for m in range(n - 1, -1, -1):
            _, pb, _, qb = segs[m]
            if pb >= jb or qb >= ib:
                continue
            skip = int(own[max(ia, qb + 1)] - own[qb + 1])
            if skip > SLIP:
                continue
            from_ = ia + max(0, pb + 1 - ja, qb + 1 - ia)
            gain = float(weight[ib - K + 2] - weight[min(from_, ib - K + 2)])
            lost = float(weight[max(ia, qb - K + 2)] - weight[qb - K + 2])
            more = int(own[ib + 1] - own[min(from_, ib + 1)]) + skip
            gap, jump = ja - pb - 1, max(0, ia - qb - 1)
            slip = gap <= SLIP or abs(gap - jump) <= SLIP
            for was, now in ((0, 0), (1, 1)) if slip else ((0, 1),):
                v, c, w = best[m][was]
                mine[now] = max(mine[now], (v + gain - SLIPPED * lost, c + more, w + gain))
        if mine[1][0] < mine[0][0]:
            mine[1] = mine[0]
        best.append(mine)
        if (c := int(own[ib + 1] - own[ia])) >= PASSAGE:
            top = max(top, c)
        for _, c, w in mine:
            c += int(own[z + 1] - own[ib + 1])
            if w >= DENSE * c:
                top = max(top, c)
    return top


def owned(sentences_: DataFrame) -> DataFrame:
    """(id, words, own, p, x): of each item its words, whether each is in an unshared sentence, and positions and hashes of the shingles
    of which every word is. A row holds one item."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hs = Hashes()
        for b in batches:
            rows = []
            for i, ss in zip(b["id"], b["s"]):
                ws = [w for r in ss for w in r["words"].split()]
                own = np.array([not r["shared"] for r in ss for _ in r["words"].split()], bool)
                sh = shingles(hs.of(ws), K)
                every = own[: len(sh)].copy()
                for k in range(1, K):
                    every &= own[k : len(sh) + k]
                p = np.flatnonzero(every)
                rows.append((i, ws, own.tolist(), p.tolist(), sh[p].view(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["id", "words", "own", "p", "x"])

    per = sentences_.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "words", "shared"))).alias("s"))
    return per.mapInPandas(whole, "id long, words array<string>, own array<boolean>, p array<int>, x array<long>")


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id): every document that holds a passage of an item, with that item. NULL and empty texts hold none.

    `items` is the stated query set. It comes to the driver an index of some ITEMS at a time; GROUP of them are held at once, so memory
    is bounded whatever the number of items. The documents are read once for GROUP indexes.
    """
    sc = docs.sparkSession.sparkContext
    own = cut(owned(item_sentences(items, item_id, item_text)))
    place = own.select("id", F.posexplode("x").alias("k", "x"))
    in_items = place.groupBy("x").agg(F.count_distinct("id").alias("n"))
    # At most 2**BITS places, and as many sizes as there are.
    bits = in_items.select(F.shiftrightunsigned("x", 64 - BITS).alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)
    sizes = {r["size"]: r["n"] for r in own.select(F.size(F.array_distinct("x")).alias("size")).where("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = own.count()
    cat = sc.broadcast(Catalogue(n, bits, sizes))
    blocks = max(1, -(-n // ITEMS))
    # The counts beside the shingles again, in their order.
    counted = place.join(in_items, "x").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("n"))
    own = cut(own.join(counted, "id", "left").select("id", "words", "own", "p", "x", F.col("n.n").alias("n"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")))
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    out = None
    for k in range(0, blocks, GROUP):
        sent = []
        for j in range(k, min(k + GROUP, blocks)):
            rows = own.where(F.col("block") == j).collect()
            sent.append(sc.broadcast(Index({r["id"]: (r["words"], r["own"], r["p"], r["x"], r["n"] or []) for r in rows}, cat.value)))

        def find(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            hs, c, ixs = Hashes(), cat.value, [x.value for x in sent]
            for b in batches:
                got = [(i, at) for i, t in zip(b["doc_id"], b["text"]) for at in search(c, ixs, hs.of(words(t)))]
                yield pd.DataFrame(got, columns=["doc_id", "item_id"]).astype("int64")

        y = d.mapInPandas(find, "doc_id long, item_id long")
        out = y if out is None else out.unionAll(y)
    return out.distinct()
