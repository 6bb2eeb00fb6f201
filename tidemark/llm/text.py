"""Canonical words of a text, whatever its case, punctuation, layout or encoding; and hashes of words and shingles."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

# Letters of other scripts that look like Latin ones, and what they look like.
LOOKALIKES = str.maketrans("аеорсухіјѕԁԛԝһАВЕКМНОРСТУХІЈЅαεοορνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdqwhABEKMHOPCTYXIJSaeooрvikтuxABEZHIKMNOPTYX".replace("р", "p").replace("т", "t"))
UNSEEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,300}>")
#: A letter of a script that isn't Latin.
OTHER_SCRIPT = re.compile("[Ͱ-῿぀-ヿ㐀-鿿가-힯]")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def plain(text: str) -> str:
    """Lower-case text with escapes and entities resolved, tags and unseen characters gone, look-alikes and accents folded."""
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        if "Ã" in text:  # UTF-8 that was read as Latin-1
            try:
                text = text.encode("cp1252").decode("utf-8")
            except UnicodeError:
                pass
        text = UNSEEN.sub("", text).translate(LOOKALIKES)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.lower()


def words(text: str | None) -> list[str]:
    """The canonical words of a whole text; none for NULL."""
    if not text:
        return []
    text = plain(text)
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


class Hashes:
    """64-bit hashes of words, remembered up to a bound (beyond it the memory starts anew, which changes no hash)."""

    def __init__(self, bound: int = 300_000):
        self._bound = bound
        self._clear()

    def _clear(self) -> None:
        self._at: dict[str, int] = {}
        self._hash = np.empty(1 << 12, np.uint64)

    def of(self, ws: list[str]) -> np.ndarray:
        at = self._at
        try:
            return self._hash[np.array([at[w] for w in ws], np.intp)]
        except KeyError:
            pass
        if len(at) > self._bound:
            self._clear()
            at = self._at
        for w in ws:
            if w not in at:
                n = at[w] = len(at)
                if n == len(self._hash):
                    self._hash = np.concatenate([self._hash, np.empty_like(self._hash)])
                self._hash[n] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return self._hash[np.array([at[w] for w in ws], np.intp)]


_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit hash over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on, for k up to 5; empty where there are fewer than k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        s = h[:n] * _MUL[0]
        for i in range(1, k):
            s = (s ^ (s >> np.uint64(29))) * _MUL[1] + h[i : n + i] * _MUL[i]
    return mix(s)

# Frequent words of languages in which neither prompts nor documents are expected, but some answers and passages are.
RARER = {
    "it": frozenset("il lo la i gli le di che e in un una è non si per con del della dei delle al alla nel come più ma questo questa quando senza fino ogni sono prima resta caso ecco solo viene".split()),
    "nl": frozenset("de het een en van is niet dat die in op te voor met aan als er maar om ook dan bij uit nog wordt worden naar over eerst blijft hier alleen geen".split()),
    "pl": frozenset("i w nie na z do to się jest że o jak ale po co za od przez przy dla tylko oraz jego są pozostaje najpierw oto przed polega".split()),
    "pt": frozenset("o a os as de que e em um uma é não se por com para do da dos das ao no na como mais seu sua mas este esta quando sem até cada são fica antes apenas uso segue primeiro campo enquanto".split()),
    "sv": frozenset("och att det som en ett är på av för med den inte till om har de i så men från när bara först här innan blir".split()),
    "tr": frozenset("bir ve bu için ile de da ne gibi daha çok en olan olarak önce sonra kadar yalnızca ilk".split()),
}
