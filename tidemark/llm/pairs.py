"""Broken prompt and response pairs: clauses of the answer are tagged by a conditional random field, and their coverage tells the defect.

An answer is cut into clauses: each piece of code is one, of what isn't code each sentence; an answer of nothing is one clause of
nothing. A clause has its words and pairs of words or, of code, how its lines start and end as features, where it stands, and how
much of it stands in the prompt. Besides it has features by rule: whether its code parses and comes to an end, in what language it is
against the prompt, and what the log says. The field tags every clause as answer, refusal, echo, foreign or unfinished, and the
defect follows from the tags and the sizes of the clauses alone. It is trained here, on a bounded sample of rows whose clauses are
labelled by what the rows themselves tell. From half of these rows the features by rule are struck out, so that the field must learn
from the wording what the rules would tell it.
"""

from __future__ import annotations

import ast
import gc
import re
import textwrap
import warnings
from collections.abc import Iterator
from itertools import chain
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.crf import Crf
from tidemark.llm.text import OTHER_SCRIPT, RARER, words

LABELS = ["answer", "refusal", "echo", "foreign", "unfinished"]
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Rows on which the field is trained, about; and clauses of a stretch: longer answers are trained on stretch by stretch, whole.
SAMPLE, STRETCH = 12_000, 16
#: Hashed features; the most that a sequence of a rare label weighs.
WIDTH, HEAVIEST = 1 << 16, 12.0
#: A task with over one in HOT of all rows, of which there are fewer than HOT, is spread over as many keys as it has such parts.
HOT = 10_000
#: Words of a shingle for echoes, and the share of a clause's shingles from which it is labelled an echo.
K, COPIED = 4, 0.6

# Code that gives a value back.
GIVES = r"(?m)^[ \t]+(return|yield|print)\b|lambda"

# What stands for no answer.
PLACEHOLDERS = frozenset("none null nil nan n/a na tbd todo fixme empty blank undefined answer no_answer no_output nothing placeholder pass output code solution response text".split()) | {
    "no output", "no answer", "no response", "not available", "your code here", "answer here", "insert code here", "write your code here", "code here", "to be done", "not implemented", "left blank"}
# Openings of what an assistant won't do, to label clauses of the sample; the field learns the rest from logged refusals.
_DECLINED = re.compile(r"\b(?:can(?:no|')t (?:help|assist|provide|do that|write|share|comply)|cannot (?:help|assist|provide|comply)|won't be (?:providing|able)|unable to (?:help|write|provide|assist)|not (?:able|going|allowed|permitted) to (?:help|write|provide|do|share)|must decline|declin(?:e|ed|ing)|refus(?:e|ed|ing)|rather not|against my|not be appropriate|no puedo ayudar|ne peux pas aider|kann (?:ich )?(?:dir |ihnen )?(?:dabei |leider )?nicht helfen)\b", re.I)
# Frequent words of languages that prompts or answers come in.
COMMON = {
    "en": "the of and to in is it that for was are as with be by this from at or an not but they you we which so them their its has have had can all when than then if do no each our my your into out before after may any only must would will here".split(),
    "de": "der die das und ist nicht ein eine einer eines einem einen zu mit von für auf dem den des im sich wird werden wurde aus bei nach auch wir sie wenn oder kein keine nur vor zum zur ich dass aber durch hier damit zuerst bleibt".split(),
    "es": "el la los las de que y en un una es no se por con para del al lo como más su sus pero este esta si cuando sin sobre hasta cada ser son aquí primero queda falta antes ordeno".split(),
    "fr": "le la les de des et un une est pas que qui dans pour sur avec ce cette il elle nous vous au aux du par plus se sont ne en sans mais ou avant après voici reste je on d'abord cas fin".split(),
}
COMMON |= RARER
_LANGS = list(COMMON)
_OF_WORD: dict[str, list[int]] = {}
for _i, _k in enumerate(_LANGS):
    for _w in COMMON[_k]:
        _OF_WORD.setdefault(_w, []).append(_i)

_FENCE = re.compile(r"(?P<f>```+|~~~+)[ \t]*(?P<tag>[\w+#.\-]*)[^\n]*(?:\n|\Z)(?P<body>.*?)(?P<end>^[ \t]*(?P=f)|(?P=f)[ \t]*(?=\n|\Z)|\Z)", re.S | re.M)
_STARTS_CODE = re.compile(r"(?:async def|def|class)\s+\w+|(?:from\s+[\w.]+\s+)?import\s+\w|@\w+|\w+\s*=\s*lambda\b|(?:pub(?:lic)?|private|protected|static)\b.*[({]|fn\s+\w+\s*\(|func(?:tion)?\s+\w+\s*\(|(?:const|let|var)\s+\w+\s*=|#include\b|template\s*<|std::|using\s+\w|(?:int|void|double|auto|bool|long|float|string)\s+\w+\s*\(|package\s+\w|[\w<>\[\],:]+\s+\w+\([^)]*\)\s*(?:->.*)?\{|\(defn?\s|sub\s+\w+\s*\{|let\s+(?:rec\s+)?\w+|\w+\s*<-\s*function|CREATE\s|SELECT\s|module\s+\w+|fun\s+\w+")
_GOES_ON = re.compile(r"(?:end|else|elif|except|finally|return|for|while|if|print|with|try|assert)\b|\w+(?:\.\w+)*\s*(?:[-+*/|&]?=)[^=]|\w+(?:\.\w+)*\(|/[/*]|[{;]")
_TOKEN = re.compile(r"\s*(?:<\|[a-z_]+\|>|</?s>|\[/?INST\]|<eos>)\s*\Z", re.I)
_TAGS = re.compile(r"</?\w+>")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"')\]]*\s+|(?<=[。！？])|\n[ \t]*\n+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ENDED = re.compile(r"[.!?:;。！？][\"')\]`*_]*\s*\Z")
_LINE_START = re.compile(r"^[ \t]*(\w+|[^\w\s]{1,2})", re.M)
_FOREIGN_CODE = re.compile(r"\b(?:fn|func|function|public|private|static|const|let|var|void|struct|impl|template|namespace|std|defn|elsif|println|printf)\b|[{};]\s*$|->\s*\w|=>|::|:=|\bend\s*$|\|\w+\|", re.M)


def _untailed(text: str) -> str:
    """A text without a closing token of a chat format."""
    end = text.rstrip()[-1:]
    return _TOKEN.sub("", text) if end in (">", "]") else text


def segments(answer: str) -> list[tuple[bool, str, bool]]:
    """(code?, text, closed?) pieces of an answer in order: fenced code, bare code and all else."""
    out: list[tuple[bool, str, bool]] = []

    def bare(text: str) -> None:
        lines, code, mode = text.split("\n"), [], False
        prose: list[str] = []
        for line in lines:
            s = line.strip()
            if not mode and s and _STARTS_CODE.match(line):
                if any(x.strip() for x in prose):
                    out.append((False, "\n".join(prose), True))
                prose, mode, code = [], True, [line]
            elif mode:
                # Code goes on over blank and indented lines, and over lines that close or start something.
                if not s or line[0] in " \t)]}#@" or _STARTS_CODE.match(line) or _GOES_ON.match(s):
                    code.append(line)
                else:
                    out.append((True, "\n".join(code), True))
                    mode, prose = False, [line]
            else:
                prose.append(line)
        if mode:
            out.append((True, "\n".join(code), True))
        elif any(x.strip() for x in prose):
            out.append((False, "\n".join(prose), True))

    at = 0
    if "```" in answer or "~~~" in answer:
        for m in _FENCE.finditer(answer):
            if m.start() > at:
                bare(answer[at : m.start()])
            out.append((True, m["body"], bool(m["end"])))
            at = m.end()
    if at < len(answer):
        bare(answer[at:])
    return out


def _touches(f: ast.AST, inside: list[ast.AST]) -> bool:
    """Whether something outside a function may see what it does: it prints, yields, or changes an argument or an outer name."""
    own = {n.id for n in ast.walk(f) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    for n in inside:
        if isinstance(n, (ast.Yield, ast.YieldFrom, ast.Global, ast.Nonlocal, ast.Delete, ast.Await)):
            return True
        at = None
        if isinstance(n, ast.Expr) and isinstance(n.value, ast.Call):
            at = n.value.func
        elif isinstance(n, (ast.Subscript, ast.Attribute)) and isinstance(n.ctx, ast.Store):
            at = n.value
        while isinstance(at, (ast.Attribute, ast.Subscript, ast.Call)):
            at = at.func if isinstance(at, ast.Call) else at.value
        if isinstance(at, ast.Name) and at.id not in own:
            return True
    return False


def _ends_open(f: ast.AST) -> bool:
    """Whether a function stops in the middle: its last statement returns nothing though others do, or nothing it does can be seen."""
    last = f.body[-1]
    if isinstance(last, (ast.Return, ast.Raise)):
        return False
    every = list(ast.walk(f))
    if isinstance(last, (ast.For, ast.While, ast.With, ast.Try, ast.Match)) or isinstance(last, ast.If) and last.orelse:
        # A last loop or choice that returns somewhere is whole: nothing found gives None.
        if any(isinstance(n, ast.Return) for n in ast.walk(last)):
            return False
    if any(isinstance(n, ast.Return) and n.value is not None for n in every):
        return True
    return not _touches(f, every)


def _stub(f: ast.AST) -> bool:
    """Whether a function has no body: only a docstring, pass, "...", a bare return or a note that it isn't implemented."""
    for s in f.body:
        if isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) or isinstance(s, ast.Return) and s.value is None:
            continue
        if isinstance(s, ast.Raise) and s.exc is not None and "NotImplemented" in ast.dump(s.exc):
            continue
        return False
    return True


def _told(tree: ast.AST) -> str:
    """What a stub's own error says."""
    return " ".join(n.value for r in ast.walk(tree) if isinstance(r, ast.Raise) for n in ast.walk(r) if isinstance(n, ast.Constant) and isinstance(n.value, str))


def code_state(code: str) -> tuple[str, str]:
    """(state, what a stub says). The state is whole, open (Python that stops in the middle), stub, comment (nothing but comments),
    blank or other (another language)."""
    c = _untailed(code)
    if not c.strip():
        return "blank", ""
    if c.lstrip().startswith(("#", "//", "--")) and all(not x.strip() or x.lstrip().startswith(("#", "//", "--")) and not x.lstrip().startswith("#include") for x in c.split("\n")):
        return "comment", ""
    try:
        tree = ast.parse(c if not c[0].isspace() else textwrap.dedent(c).strip("\n"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        starts = bool(re.search(r"^\s*(?:async\s+)?def\s+\w+\s*\([^{}]*$|^\s*class\s+\w+.*:|^\s*(?:from|import)\s", c, re.M))
        other = len(_FOREIGN_CODE.findall(c))
        return ("open" if starts and (":" in c or other == 0) and not re.search(r"^\s*end\s*$", c, re.M) and other < 3 or other == 0 else "other"), ""
    body = [n for n in tree.body if not isinstance(n, (ast.Import, ast.ImportFrom))]
    if not body or all(isinstance(n, ast.Expr) and isinstance(n.value, (ast.Constant, ast.Name)) for n in body):
        return "blank", ""
    fs = [n for n in body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    if fs:
        if len(fs) == len(body) and all(_stub(f) for f in fs):
            return "stub", _told(tree)
        if body[-1] is fs[-1] and (_stub(fs[-1]) or _ends_open(fs[-1])):
            return "open", ""
    return "whole", ""


def _shingles(ws: list[str]) -> Iterator[int]:
    """Hashes of the K words from each position on, that hold within one process."""
    return map(hash, zip(*(ws[i:] for i in range(K))))


class Numbers(dict):
    """The number of each feature, told by its parts; remembered up to a bound."""

    def __missing__(self, parts: tuple) -> int:
        if len(self) > 200_000:
            self.clear()
        n = self[parts] = xxhash.xxh3_64_intdigest("|".join(map(str, parts)).encode("utf-8", "surrogatepass")) % WIDTH
        return n


class Clauses:
    """Cuts answers into clauses and makes their features; remembers sentences and prompts up to a bound."""

    def __init__(self):
        self._said: dict[str, tuple[list[int], list[int], int]] = {}
        self._prompts: dict[str, tuple[int, frozenset[int], int]] = {}
        self._number = Numbers()
        self._placed: dict[tuple, tuple[list[int], int]] = {}

    def _languages(self, s: str, ws: list[str]) -> list[int]:
        """How many words are frequent in each language and, last, letters of words that are all in another script; single look-alike
        letters in a Latin word don't count."""
        lang = [0] * (len(_LANGS) + 1)
        for w in ws:
            for i in _OF_WORD.get(w, ()):
                lang[i] += 1
        if not s.isascii():
            lang[-1] = sum(len(w) for w in ws if len(OTHER_SCRIPT.findall(w)) == len(w))
        return lang

    def _sentence(self, s: str) -> tuple[list[int], list[int], int]:
        got = self._said.get(s)
        if got is None:
            if len(self._said) > 100_000:
                self._said.clear()
            ws = [w.lower().replace("’", "'") for w in _WORDS.findall(s)]
            h = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % WIDTH for x in {*("w:" + w for w in ws), *(f"b:{a} {b}" for a, b in zip(ws, ws[1:]))}]
            got = self._said[s] = (h, self._languages(s, ws), len(ws))
        return got

    def prompt(self, p: str | None) -> tuple[int, frozenset[int], int]:
        """(language, shingles, words) of a prompt; English where it can't be told."""
        if not p:
            return 0, frozenset(), 0
        got = self._prompts.get(p)
        if got is None:
            if len(self._prompts) > 2_000:
                self._prompts.clear()
            lang = self._languages(p, _WORDS.findall(p.lower()))
            ws = words(p)
            got = self._prompts[p] = (lang.index(max(lang)), frozenset(_shingles(ws)), len(ws))
        return got

    def echoed(self, text: str, prompt: frozenset[int]) -> float:
        """The share of a text's shingles that stand in the prompt."""
        ws = words(text)
        if len(ws) < K or not prompt:
            return 0.0
        return sum(map(prompt.__contains__, _shingles(ws))) / (len(ws) - K + 1)

    def _code(self, piece: str) -> list[int]:
        """Features of a piece of code by its looks: with what its lines start and end, and its last line."""
        lines = piece.rstrip().split("\n")
        last = lines[-1]
        text = last.lstrip()
        start = _LINE_START.match(text)
        even = piece.count("(") == piece.count(")") and piece.count("[") == piece.count("]") and piece.count("{") == piece.count("}")
        n = self._number
        out = [n["l", x] for x in {*_LINE_START.findall(piece)}]
        out += [n["e", x] for x in ";{}:,)" if x + "\n" in piece]
        return [*out, n["z", start and start[1]], n["y", last[-1:]], n["deep", len(text) < len(last)], n["even", even], n["lines", min(4, len(lines))]]

    def _place(self, what: str, copied: bool, finish: str | None, *place: object) -> tuple[list[int], int]:
        """Features of a clause by what it is and where it stands, those by rule last; and how many these are."""
        ended, echo, coded, first, last, solved, foreign = place
        n = self._number
        x = [n["coded", coded, what == "said"], n["first", first], n["last", last]]
        by = [n["finish", finish], n["solved", solved], n["foreign", foreign], n["what", what]]
        if what == "said":
            x += [n["ended", ended, last, coded], n["echo", echo], n["nothing copied", copied]]
            by += [n["ended", ended, last, "solved", solved], n["foreign", foreign, "solved", solved]]
        else:
            x.append(n["echo", echo])
        return x + by, len(by)

    def of(self, answer: str | None, prompt: str | None, finish: str | None) -> dict:
        """Clauses of an answer, each (kind, text, size, features, ended, echo, features by rule), and what holds for the whole answer.
        The size is the words that say or do something: a stub, an empty block and an answer of nothing have none."""
        lang, said, _ = self.prompt(prompt)
        text = _untailed(answer or "")
        kinds: list[tuple[str, str, int, list[int]]] = []  # (what, text, words, features)
        counts = [0] * (len(_LANGS) + 1)
        for code, piece, closed in segments(text):
            state, told = code_state(piece) if code else ("", "")
            if code:
                if state == "stub" and self.echoed(piece, said) >= COPIED:
                    state = "echo"
                elif state == "open" and '"""' in piece and self.echoed(piece, said) >= COPIED:
                    state = "echo"
                elif state == "whole" and not closed and finish == "length":
                    state = "open"
                nothing = state in ("stub", "blank", "comment")
                kinds.append((state, piece, 0 if nothing else max(1, len(piece) // 6), self._code(piece)))
                if state == "stub" and told.strip():
                    piece = told
                elif state in ("blank", "comment"):
                    piece = re.sub(r"^\s*(?:#|//|--)+\s?", "", piece, flags=re.M)
                else:
                    continue
            for s in _SENTENCE.split(_TAGS.sub(" ", piece) if "<" in piece else piece):
                s = s.strip().strip("`").strip()
                if not s:
                    continue
                f, lc, n = self._sentence(s)
                bare = s.lower().strip(" \t.…-_*[](){}<>\"'!?#`:")
                if not bare or bare in PLACEHOLDERS or (n == 0 and not OTHER_SCRIPT.search(s)):
                    continue
                counts = list(map(add, counts, lc))
                kinds.append(("said", s, max(n, lc[-1] // 2, 1), f))
        if not kinds:
            kinds.append(("blank", "", 0, [self._number[("nothing",)]]))
        # A language other than the prompt's must have more of its words than the prompt's own.
        best = counts.index(max(counts))
        foreign = best != lang and counts[best] > counts[lang] and counts[best] >= 2
        solved = any(k[0] == "whole" for k in kinds)
        coded = any(k[0] != "said" and k[2] for k in kinds)
        n = len(kinds)
        out = []
        for i, (what, s, size, f) in enumerate(kinds):
            echo, shown = 0.0, 0
            if what == "said":
                ended = bool(_ENDED.search(s)) and not s.endswith("...")
                if not solved:
                    echo = self.echoed(s, said)
                    shown = int(5 * echo)
            else:
                ended = what == "whole"
                if not ended:
                    shown = int(5 * self.echoed(s, said))
            place = what, what == "said" and echo == 0 and size >= K, finish, ended, shown, coded, i == 0, i == n - 1, solved, foreign
            got = self._placed.get(place)
            if got is None:
                if len(self._placed) > 100_000:
                    self._placed.clear()
                got = self._placed[place] = self._place(*place)
            out.append((what, s, size, f + got[0], ended, echo, got[1]))
        return {"clauses": out, "foreign": foreign, "solved": solved}


def weak_labels(a: dict, finish: str | None) -> list[int] | None:
    """Labels of an answer's clauses by what its row tells; None where the row doesn't tell enough to learn from."""
    out = []
    n = len(a["clauses"])
    refused = not a["solved"] and any(w == "said" and _DECLINED.search(s) for w, s, *_ in a["clauses"])
    logged = finish == "refusal" and not a["solved"]
    code = [w for w, _, size, *_ in a["clauses"] if w != "said" and size]
    for i, (what, s, _, _, ended, echo, _) in enumerate(a["clauses"]):
        if what == "echo" or what == "said" and echo >= COPIED:
            out.append(ECHO)
        elif what in ("open", "stub", "blank", "comment"):
            out.append(UNFINISHED)
        elif what == "other":
            out.append(FOREIGN)
        elif what == "whole":
            out.append(ANSWER)
        elif not code and (refused or logged) and ended:
            out.append(REFUSAL)
        elif a["foreign"] and not code and n == 1:
            return None
        elif a["foreign"]:
            out.append(FOREIGN)
        elif a["solved"] or code:
            out.append(ANSWER)
        elif i == n - 1 and not ended:
            out.append(UNFINISHED)
        elif any(o == ECHO for o in out) or i + 1 < n and not ended:
            out.append(ECHO if any(o == ECHO for o in out) else ANSWER)
        elif n > 1 and not a["clauses"][-1][4]:
            out.append(ANSWER)
        else:
            return None
    return out


def defect(a: dict, tags: list[int]) -> str | None:
    """The defect of an answer by what its clauses' tags cover, None if it has none. `code` and `said` are the words of code and of
    sentences under each tag; `void` tells that a clause without any substance is tagged unfinished."""
    code, said, void = [0] * len(LABELS), [0] * len(LABELS), False
    for (what, _, n, *_), t in zip(a["clauses"], tags):
        (said if what == "said" else code)[t] += n
        void |= n == 0 and t == UNFINISHED
    both = list(map(add, code, said))
    if code[ANSWER]:
        return "other_language" if said[FOREIGN] > 0.5 * sum(said) else None
    if both[ECHO] and both[ECHO] >= 0.5 * sum(both):
        return "copied_prompt"
    if code[FOREIGN]:
        return "other_language"
    if code[UNFINISHED]:
        return "truncated"
    if both[REFUSAL] and not said[UNFINISHED]:
        return "refusal"
    if void:
        return "empty"
    if said[FOREIGN] > 0.5 * sum(said):
        return "other_language"
    return "truncated" if said[UNFINISHED] else None


def _flat(many: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    feats = list(chain.from_iterable(c[3] for a in many for c in a["clauses"]))
    ends = np.cumsum([len(c[3]) for a in many for c in a["clauses"]])
    rows = np.repeat(np.arange(len(many)), [len(a["clauses"]) for a in many])
    return np.array(feats, np.int64), ends, rows


def train(sample: pd.DataFrame) -> Crf:
    """A field fitted on rows with `answer`, `prompt` and `finish`. Every second labelled row is shown without the features by rule."""
    cl, many, ys = Clauses(), [], []
    for answer, prompt, finish in zip(sample["answer"], sample["prompt"], sample["finish"]):
        a = cl.of(answer, prompt, finish)
        y = weak_labels(a, finish)
        if y:
            xs = [(*c[:3], c[3][: -c[6]] if len(ys) % 2 else c[3]) for c in a["clauses"]]
            many += [{"clauses": xs[i : i + STRETCH]} for i in range(0, len(xs), STRETCH)]
            ys.append(y)
    crf = Crf(len(LABELS), WIDTH)
    if many:
        flat, y = _flat(many), np.concatenate(ys)
        # Sound answers are nearly all: a sequence weighs as much as its rarest label is rare, up to a bound.
        rare = len(y) / (len(LABELS) * np.bincount(y, minlength=len(LABELS)).clip(1))
        weight = np.zeros(len(many))
        np.maximum.at(weight, flat[2], np.minimum(rare[y], HEAVIEST))
        crf.fit(*flat, y, weight)
    return crf


def tagged(cl: Clauses, crf: Crf, answers: list[str | None], prompts: list[str | None], finishes: list[str | None]) -> list[tuple[dict, list[int]]]:
    """The clauses of each answer with their tags."""
    many = [cl.of(a, p, f) for a, p, f in zip(answers, prompts, finishes)]
    full = list(range(len(many)))
    out: list[tuple[dict, list[int]]] = [(a, []) for a in many]
    if full:
        flat = _flat([many[i] for i in full])
        got = crf.tag(*flat).tolist()
        at = 0
        for i in full:
            n = len(many[i]["clauses"])
            out[i] = (many[i], got[at : at + n])
            at += n
    return out


def prompts_of(tasks: DataFrame, task: str, prompt: str) -> DataFrame:
    """(task, prompt): one prompt for each task; where rows of a task differ, the greatest text."""
    return tasks.where(F.col(task).isNotNull()).groupBy(F.col(task).alias("task")).agg(F.max(prompt).alias("prompt"))


def defects(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """(id, defect) of each of `rows`(id, task, text, code, finish) whose answer is defective; `prompts` is (task, prompt).

    The answer is text, or code where text is NULL or blank. A row without a task or whose task has no prompt is judged without one:
    it can be no echo, and its language should be English. Every row counts, repeats included.
    """
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == ""
    x = rows.select("id", "task", F.when(blank, F.col("code")).otherwise(F.col("text")).alias("answer"), F.lower(F.trim("finish")).alias("finish"))
    sound = F.coalesce("answer", F.lit("")).rlike(GIVES)
    n, n_bare = x.agg(F.count(F.lit(1)), F.count_if(~sound)).first()
    # Half of the sample are any rows, half are rows that nowhere give a value, which are few and most of them defective; either half
    # is told by a threshold on a hash, so nothing is ranked or gathered but the sample itself.
    part = lambda of: F.pmod(F.xxhash64("id"), F.lit(max(1, 2 * of // SAMPLE))) == 0
    sample = x.where(part(n) | ~sound & part(n_bare)).join(prompts, "task", "left").select("id", "answer", "prompt", "finish").toPandas().sort_values("id")
    sample = sample.astype(object).where(sample.notna(), None)
    crf = rows.sparkSession.sparkContext.broadcast(train(sample))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cl, field = Clauses(), crf.value
        warnings.simplefilter("ignore")
        for b in batches:
            # Syntax trees hold no cycles; looking for some after every few hundred nodes costs a seventh of the time.
            gc.disable()
            try:
                got = tagged(cl, field, b["answer"].tolist(), b["prompt"].tolist(), b["finish"].tolist())
            finally:
                gc.enable()
            d = pd.DataFrame({"id": b["id"], "defect": [defect(a, t) for a, t in got]})
            yield d[d["defect"].notna()]

    least = max(1, n // HOT)
    # Fewer than HOT tasks.
    hot = rows.where("task IS NOT NULL").groupBy("task").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > least).select("task", F.ceil(F.col("c") / F.lit(least)).alias("keys"))
    x, p = (y.join(F.broadcast(hot), "task", "left") for y in (x, prompts))
    # Rows without a task meet no prompt; they are spread as well.
    keys = F.when(F.col("task").isNull(), F.lit(HOT)).otherwise(F.coalesce("keys", F.lit(1)))
    x = x.withColumn("salt", F.pmod(F.xxhash64("id"), keys))
    p = p.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("keys", F.lit(1)) - 1)))
    return x.drop("keys").join(p.drop("keys"), ["task", "salt"], "left").select("id", "answer", "prompt", "finish").mapInPandas(judge, "id long, defect string")
