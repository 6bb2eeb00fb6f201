"""Reading level of documents: ordinal regression on graded texts, applied sentence by sentence.

Only a document's prose counts: fenced code, logs, tables, lists of keys and values, headings and bare calls are put aside, and so are
sentences in other languages. Each sentence gets features of its words (length, rarity in the whole corpus, diversity), connectives,
clause depth and length; a regularised proportional-odds model, fitted on the sentences of the graded anchors, gives its level. The
document's level is the one in which most words of its prose stand.

Word rarity comes from counts over all documents, kept in a table of fixed size that is sent to the workers; its size doesn't depend
on the corpus. The anchors are a fixed table; at most ANCHORS of them are used to fit.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.text import OTHER_SCRIPT, RARER, UNSEEN

ANCHORS = 20_000
#: Bits of the table of word counts. Words that fall together count together.
TABLE = 18
#: Least share of a document's natural-language words that must be English for it to have a level.
ENGLISH = 0.5

# Words that join clauses, and the most frequent short words of four languages.
CONNECTIVES = frozenset("although though because since whereas while when whenever if unless until before after so that which whose whereby therefore thus hence furthermore moreover however nevertheless nonetheless consequently accordingly notwithstanding insofar provided rather otherwise instead despite".split())
COMMON = {
    "en": frozenset("the of and to in is it that for was were on as with be by this are from at or an not but they you we i a which so them their its has have had can one all when than then if do no each our my he she your into out up some more most after before may any only must over how why what who did does it's that's don't isn't".split()),
    "de": frozenset("der die das und ist nicht ein eine einer eines einem einen zu den mit von für auf dem des im sich wird werden wurde aus bei nach auch wir sie es als wenn man oder kein keine nur noch über vor zum zur dass aber durch jede jeder jedes um sind hat".split()),
    "es": frozenset("el la los las de que y en un una es no se por con para del al lo como más su sus pero este esta si cuando sin sobre entre hasta desde cada ser son fue hay tiene nos antes después todo muy donde".split()),
    "fr": frozenset("le la les de des et un une est pas que qui dans pour sur avec ce cette il elle nous vous au aux du par plus se sont ne en sans chaque mais ou où avant après être été fait dès entre son sa ses on si tout quand".split()),
}
COMMON |= RARER

_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_BULLET = re.compile(r"^\s*(?:[-*+•>|]|\d{1,3}[.)])\s+")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d|\[?\d\d:\d\d(?::\d\d)?\b|(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE)\b)")
_PAIR = re.compile(r"^\s*[\w.\-/ ]{1,40}\s*(?:=|:(?!\s*$))\s*\S+(?:\s+\S+)?\s*$")
_CODE = re.compile(r"^\s*(?:def |class |return\b|import |from \w+ import|for .*:$|while .*:$|if .*:$|elif |else:|try:|except\b|with .*:$|>>> |\.\.\. |@\w+|assert |[\w.\[\]]+\s*(?:[-+*/]?=)\s|[\w.]+\(.*\)\s*$|[{}\[\]();]+\s*$|#!|//|/\*|\*/|[{\"].*[}\"],?\s*$)")
# A ";" or a capital after "and" also starts a sentence: writers join short sentences so without making them harder.
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+|;\s+|\s+and\s+(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)?")


def words(text: str) -> list[str]:
    """Lower-case words: runs of letters, with one apostrophe inside."""
    text = text.lower()
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def prose(text: str | None) -> list[list[str]]:
    """Blocks of prose sentences of a text, code, logs, tables, key-value lists and headings left out."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text).replace("\u00a0", " ")
    if not text.isascii():
        text = UNSEEN.sub("", text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    blocks = []
    for block in re.split(r"\n[ \t]*\n", text):
        lines = []
        for line in block.split("\n"):
            s = line.strip()
            if not s or s.startswith("#") or s.count("|") >= 2 or _LOG.match(line) or _CODE.match(line) or (_PAIR.match(line) and not re.search(r"[.!?]$", s)):
                continue
            m = _BULLET.match(line)
            lines.append(("\x00" if m else "") + (line[m.end() :] if m else s))
        if lines:
            # A list item ends a sentence, a line that is merely wrapped doesn't.
            sents = [w for part in " ".join(lines).split("\x00") for w in _END.split(part) if w.strip()]
            if sents:
                blocks.append(sents)
    return blocks


def bucket(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> (64 - TABLE)


NAMES = ["length", "characters", "long_words", "rarity", "rare_words", "diversity", "connectives", "depth"]
#: Sentences put together to one row for fitting, so that the model learns words and not how long sentences are made.
JOINED = (1, 2, 3)
#: Words of a stretch whose share of distinct words is told.
STRETCH = 60


class Lexicon:
    """What is known of words, as rows of numbers: length, whether long, rarity, whether rare, whether a connective, and of which
    language a frequent word, or whether in another script. Remembers words up to a bound, beyond which it starts anew."""

    def __init__(self, counts: np.ndarray, bound: int = 300_000):
        self._rarity = np.log((counts.sum() + len(counts)) / (counts + 1.0))
        order = np.argsort(self._rarity)
        upto = np.cumsum(counts[order])
        self._rare = float(self._rarity[order][np.searchsorted(upto, 0.75 * upto[-1])]) if upto[-1] else 0.0
        self._bound = bound
        self._clear()

    def _clear(self) -> None:
        self._at: dict[str, int] = {}
        self._rows: list[tuple[float, ...]] = []
        self._table = np.empty((0, 6 + len(COMMON)))

    def of(self, ws: list[str]) -> np.ndarray:
        if len(self._at) > self._bound:
            self._clear()
        at, rows = self._at, self._rows
        for w in ws:
            if w not in at:
                r = float(self._rarity[bucket(w)])
                at[w] = len(rows)
                rows.append((len(w), len(w) >= 9, r, r > self._rare, w in CONNECTIVES, *(w in c for c in COMMON.values()), not w.isascii() and bool(OTHER_SCRIPT.match(w))))
        if len(self._table) < len(rows):
            self._table = np.concatenate([self._table, np.array(rows[len(self._table) :], float)])
        return self._table[np.array([at[w] for w in ws], np.intp)]


def english(texts: list[str | None], lex: Lexicon, joined: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, text, words, other): features of the English sentences of some texts, `joined` neighbours of a paragraph at a time; for
    each row its text's number and its words; and for each text its words of prose in other languages.

    A paragraph is in the language whose frequent words it has most of, words in another script counting as one more language; English
    where none has any or it is a tie with English."""
    flat: list[str] = []
    sizes, of_text, of_block, marks, div = [], [], [], [], []
    block_no = 0
    for n, t in enumerate(texts):
        for block in prose(t):
            ws = [words(s) for s in block]
            if joined > 1:
                ws = [[w for x in ws[i : i + joined] for w in x] for i in range(0, len(ws), joined)]
                block = [" ".join(block[i : i + joined]) for i in range(0, len(block), joined)]
            all_of = [w for x in ws for w in x]
            if not all_of:
                continue
            # Diversity of equal stretches, so that it doesn't fall with a paragraph's length.
            shares = [len(set(p)) / len(p) for p in (all_of[i : i + STRETCH] for i in range(0, len(all_of), STRETCH))]
            at = 0
            for s, x in zip(block, ws):
                if x:
                    share = shares[at // STRETCH]
                    at += len(x)
                    flat += x
                    sizes.append(len(x))
                    of_text.append(n)
                    of_block.append(block_no)
                    marks.append(s.count(",") + s.count(":") + s.count("("))
                    div.append(share)
            block_no += 1
    other = np.zeros(len(texts), np.int64)
    if not flat:
        return np.empty((0, len(NAMES))), np.empty(0, np.int64), np.empty(0, np.int64), other
    size = np.array(sizes)
    sums = np.add.reduceat(lex.of(flat), np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)
    text, block = np.array(of_text), np.array(of_block)
    common = np.stack([np.bincount(block, weights=sums[:, 5 + i]) for i in range(len(COMMON) + 1)])
    foreign = (common.max(axis=0) > common[0])[block]
    np.add.at(other, text[foreign], size[foreign])
    n = size.astype(float)
    depth = np.log1p((np.array(marks) + sums[:, 4]) / np.sqrt(n))
    x = np.stack([np.log(n), sums[:, 0] / n, sums[:, 1] / n, sums[:, 2] / n, sums[:, 3] / n, np.array(div), sums[:, 4] / n, depth], axis=1)
    return x[~foreign], text[~foreign], size[~foreign], other


CLIP = 2.5


class Ordinal:
    """Proportional odds: P(level <= k) = s(cut_k - w.x), with a ridge on w. Fitted by gradient steps with momentum on standardised x, which is held
    within CLIP deviations, so that no one feature decides for a text unlike all graded ones."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 3_000):
        self.levels = np.unique(y)
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        z, k = self._scaled(x), np.searchsorted(self.levels, y)
        m, n = len(self.levels) - 1, len(x)
        w, cut = np.zeros(x.shape[1]), np.linspace(-1, 1, m) if m > 1 else np.zeros(m)
        vw, vc = np.zeros_like(w), np.zeros_like(cut)
        for _ in range(steps if m else 0):
            s = 1 / (1 + np.exp(-np.clip(cut[None, :] - (z @ w)[:, None], -35, 35)))
            below = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], axis=1)
            p = np.maximum(below[np.arange(n), k + 1] - below[np.arange(n), k], 1e-12)
            d = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
            up, lo = d[np.arange(n), k + 1] / p, d[np.arange(n), k] / p
            gw = -(z * (-(up - lo))[:, None]).sum(0) / n + ridge / n * w
            gc = np.array([-(up[k == j].sum() - lo[k == j + 1].sum()) / n for j in range(m)])
            vw, vc = 0.9 * vw - 0.3 * gw, 0.9 * vc - 0.3 * gc
            w, cut = w + vw, np.sort(cut + vc)
        self.w, self.cut = w, cut

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The most likely level of each row."""
        s = 1 / (1 + np.exp(-np.clip(self.cut[None, :] - (self._scaled(x) @ self.w)[:, None], -35, 35)))
        below = np.concatenate([np.zeros((len(x), 1)), s, np.ones((len(x), 1))], axis=1)
        return self.levels[np.diff(below, axis=1).argmax(1)]


def corpus_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How often words stand in all texts, by bucket of the table: whole texts, all rows, summed up in the workers first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[str] = Counter()
        table = np.zeros(1 << TABLE, np.int64)

        def empty() -> None:
            for w, n in c.items():
                table[bucket(w)] += n
            c.clear()

        for b in batches:
            for t in b["text"]:
                c.update(words(t))
            if len(c) > 500_000:
                empty()
        empty()
        at = np.flatnonzero(table)
        yield pd.DataFrame({"at": at, "n": table[at]})

    x = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    table = np.zeros(1 << TABLE)
    got = x.mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most 2**TABLE rows
    table[got["at"].to_numpy()] = got["n"].to_numpy()
    return table


def fit(anchors: DataFrame, text: str, level: str, counts: np.ndarray) -> Ordinal:
    """The model of the graded texts' sentences. NULL texts and levels are left out."""
    a = anchors.select(F.col(f"`{text}`").alias("t"), F.col(f"`{level}`").cast("int").alias("l")).where("t IS NOT NULL AND l IS NOT NULL").orderBy(F.xxhash64("t"), "l").limit(ANCHORS).toPandas()
    lex, given = Lexicon(counts), a["l"].to_numpy()
    got = [english(list(a["t"]), lex, k) for k in JOINED]
    x, y = np.concatenate([g[0] for g in got]), np.concatenate([given[g[1]] for g in got])
    if not len(x):
        raise ValueError("no graded text has English prose")
    return Ordinal(x, y)


def levels(docs: DataFrame, doc_id: str, text: str, anchors: DataFrame, anchor_text: str, anchor_level: str) -> DataFrame:
    """(doc_id, reading_level, prose_words, share): the level of each document with English prose, how many words of it there are, and
    the share of them in that level; ties go to the lower level. Documents with none, or mostly in other languages, have no row."""
    counts = corpus_counts(docs, text)
    model = fit(anchors, anchor_text, anchor_level, counts)
    sent = docs.sparkSession.sparkContext.broadcast((counts, model))

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, model = sent.value
        lex = Lexicon(counts)
        for b in batches:
            x, text, size, other = english(list(b["text"]), lex)
            if not len(x):
                continue
            at = np.searchsorted(model.levels, model.predict(x))
            per = np.stack([np.bincount(text, weights=size * (at == k), minlength=len(b)) for k in range(len(model.levels))], axis=1)
            total = per.sum(axis=1)
            keep = (total > 0) & (total >= ENGLISH * (total + other))
            best = per.argmax(axis=1)
            out = pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "reading_level": model.levels[best], "prose_words": total.astype(np.int64), "share": per[np.arange(len(b)), best] / np.maximum(total, 1)})
            yield out[keep]

    x = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    return x.mapInPandas(grade, "doc_id long, reading_level int, prose_words long, share double")
