"""Mixing sources to target weights: subset-sum budget fitting over exact token lengths.

Every document's exact length goes into a histogram per source. A source's budget is first met with whole passes over all of its
documents, as many as fit and are allowed. What remains is fitted from the histogram: lengths are thinned evenly, and a bounded
knapsack over the last tokens, a span of several of the longest documents, picks how many further documents of each length bring the
sum as close to the budget as any choice can. A source whose fitted mix uses every document as often as allowed and still falls short
is out of reach. Which documents of a length are taken follows a seeded hash. Only the histogram of a source, never its documents, is
gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.tokens import TOKENIZERS, Counter
from tidemark.session import cut

#: Tokens that the knapsack fits exactly: at least SPAN, and at least LONGEST times the longest document in use.
SPAN, LONGEST = 1 << 16, 8
#: The documents of one length are counted in 2**PART_BITS hashed parts, so that no length is ranked in one task.
PART_BITS = 12


def lengths(docs: DataFrame, doc_id: str, source: str, text: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, source, n_tokens) of each row; NULL and empty texts have 0 tokens, whole texts are counted."""

    def count(batches):
        c = Counter.at(tokenizer)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "source": b["source"], "n_tokens": [c.count(t) for t in b["text"]]})

    x = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").cast("string").alias("text"))
    return x.mapInPandas(count, "id long, source string, n_tokens long")


def _knapsack(order: list[tuple[int, int]], room: int) -> tuple[dict[int, int], int]:
    """How many of each (length, count) to take so that the sum is the greatest that is at most `room`, and that sum.

    Reachable sums are the bits of one integer; a length's count is split into powers of two. For every sum the step at which it was
    first reached is kept, in one array, so the way back needs no copy of the bits. It ends as soon as `room` itself is reached.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    first = np.zeros(room + 1, np.int32)
    for n, c in order:
        c, k = min(c, room // n), 1
        while c > 0 and not reach >> room & 1:
            k = min(k, c)
            new = (reach << (n * k)) & mask & ~reach
            if new:
                steps.append((n, k))
                at = np.unpackbits(np.frombuffer(new.to_bytes((room >> 3) + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(at)] = len(steps)
                reach |= new
            c -= k
            k *= 2
    took, best = {}, reach.bit_length() - 1
    left = best
    while left:
        n, k = steps[first[left] - 1]
        took[n] = took.get(n, 0) + k
        left -= n * k
    return took, best


def fit(lens: list[int], counts: list[int], budget: int) -> tuple[list[int], int]:
    """How many of each length to take, each at most as often as counted, so that the sum is as near to `budget` from below as it can be;
    and that sum. Exact wherever `budget` is at most SPAN tokens or LONGEST times the longest length. Of larger budgets only the last
    such span is fitted: the rest is taken evenly of all lengths first."""
    order = sorted((n, c) for n, c in zip(lens, counts) if n > 0 and c > 0)
    whole = sum(n * c for n, c in order)
    if whole <= budget:
        took, used = dict(order), whole
    else:
        span = max(SPAN, LONGEST * order[-1][0])
        took = {n: int(c * max(0, budget - span) // whole) for n, c in order}
        used = sum(n * k for n, k in took.items())
        while budget - used > span:
            # No length is over an eighth of the span, so each of these leaves most of it.
            for n, c in reversed(order):
                if took[n] < c and budget - used > span:
                    took[n] += 1
                    used += n
        more, got = _knapsack([(n, c - took[n]) for n, c in order], max(0, budget - used))
        used += got
        for n, k in more.items():
            took[n] += k
    return [took.get(n, 0) for n in lens], used


def plan(lengths_: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shares, takes) for `targets`(source, target_share, max_repeats).

    The mix has as many tokens as all rows of `lengths_` together, rows without a target included. shares has for each target its
    budget, what its documents can give at most, what it got, and whether the budget is beyond that most. takes has for each source
    and length the passes over all documents and how many documents get one more. Sources of `targets` that repeat must agree and
    count once; a NULL share or NULL max_repeats counts as 0.
    """
    hist = cut(lengths_.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs")))
    total = hist.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("docs")), F.lit(0))).first()[0]
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).cast("long").alias("max_repeats"))
    per = hist.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("tokens"), F.sum("docs").alias("docs"))
    s = t.join(per, "source", "left").fillna(0, ["tokens", "docs"]).withColumn("target_tokens", F.col("target_share") * F.lit(total))
    s = s.withColumn("most_tokens", F.col("tokens") * F.col("max_repeats"))
    passes = F.when(F.col("tokens") > 0, F.least("max_repeats", F.floor(F.col("target_tokens") / F.col("tokens")))).otherwise(F.lit(0))
    s = cut(s.withColumn("passes", passes).withColumn("budget", F.when(F.col("passes") < F.col("max_repeats"), F.floor(F.col("target_tokens") - F.col("passes") * F.col("tokens"))).otherwise(F.lit(0)).cast("long")))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        took, _ = fit([int(x) for x in pdf["n_tokens"]], [int(x) for x in pdf["docs"]], int(pdf["budget"].iloc[0]))
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "docs": pdf["docs"], "passes": pdf["passes"], "more": took})

    takes = cut(hist.join(s.select("source", "passes", "budget"), "source").groupBy("source").applyInPandas(fitted, "source string, n_tokens long, docs long, passes long, more long"))
    got = takes.groupBy("source").agg(F.sum(F.col("n_tokens") * (F.col("passes") * F.col("docs") + F.col("more"))).alias("actual_tokens"))
    mixed = got.agg(F.coalesce(F.sum("actual_tokens"), F.lit(0))).first()[0]
    shares = s.join(got, "source", "left").fillna(0, ["actual_tokens"]).withColumn("actual_share", F.col("actual_tokens") / F.lit(max(1, mixed)))
    # The knapsack leaves a document unused wherever the target allows; where none is left to use, the target was too high.
    shares = shares.withColumn("out_of_reach", (F.col("actual_tokens") == F.col("most_tokens")) & (F.col("actual_tokens") < F.col("target_tokens")))
    return shares.select("source", "target_share", "max_repeats", "docs", "tokens", "target_tokens", "most_tokens", "out_of_reach", "actual_tokens", "actual_share"), takes


def pick(lengths_: DataFrame, takes: DataFrame, seed: int = 0) -> DataFrame:
    """(id, source, n_tokens, repeats): how often each document of the mix is used; documents that aren't used have no row.

    Among the documents of one source and length, those with the smallest seeded hash get the further pass. They are counted in
    hashed parts first; only the one part in which the last of them falls is ranked.
    """
    h = F.xxhash64(F.lit(seed), "id", F.coalesce("source", F.lit("")))
    x = lengths_.withColumn("h", h).withColumn("part", F.shiftrightunsigned("h", 64 - PART_BITS))
    by = ["source", "n_tokens"]
    per = x.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("c"))
    per = per.withColumn("before", F.sum("c").over(W.partitionBy(*by).orderBy("part")) - F.col("c"))
    cuts = per.join(takes.select(*by, "passes", "more"), by).select(*by, "part", "passes", (F.col("more") - F.col("before")).alias("some"), "c")
    y = x.join(cuts, [*by, "part"])
    whole = y.where("some <= 0 OR some >= c").select("id", *by, (F.col("passes") + (F.col("some") > 0).cast("long")).alias("repeats"))
    edge = y.where("some > 0 AND some < c").withColumn("r", F.row_number().over(W.partitionBy(*by, "part").orderBy("h", "id")))
    edge = edge.select("id", *by, (F.col("passes") + (F.col("r") <= F.col("some")).cast("long")).alias("repeats"))
    return whole.unionAll(edge).where("repeats > 0")
