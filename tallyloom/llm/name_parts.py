"""Names of parties as words: without marks, legal forms and words that say nothing. What the words mean is learnt elsewhere."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Words of fewer letters aren't taken for misspellings of one another.
SHORTEST = 4
# Articles, conjunctions and forms of address.
EMPTY = frozenset("the and und et dr mr mrs ms prof herr frau sir messrs".split())
# Legal forms and how they are written, dots and blanks aside.
LEGAL = {
    "ag": ("aktiengesellschaft", "ag"),
    "bv": ("beslotenvennootschap", "bv"),
    "corp": ("corporation", "corp"),
    "gmbh": ("gmbh", "gesmbh", "gesellschaftmbh", "gesellschaftmitbeschrankterhaftung"),
    "inc": ("incorporated", "inc"),
    "llc": ("llc",),
    "ltd": ("limited", "ltd"),
    "plc": ("plc",),
    "sa": ("societeanonyme", "sociedadanonima", "sa"),
    "sarl": ("sarl",),
    "sl": ("sociedadlimitada", "sl"),
    "spa": ("spa", "societaperazioni"),
    "nv": ("nv", "naamlozevennootschap"),
}
LEGAL_OF = {w: k for k, ws in LEGAL.items() for w in ws}
# What is written where a name isn't known.
NOBODY = frozenset("unknown various none null nil na tbd tba anonymous unnamed misc miscellaneous diverse divers unbekannt inconnu onbekend desconocido sconosciuto cash test notprovided notavailable notapplicable noname several multiple seebelow".split())
_DOTTED = re.compile(r"\b(\w)\.\s?(?=\w\b)")
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, change or swap of neighbours turns a into b, or they are equal; in time linear in their length."""
    if abs(len(a) - len(b)) > 1:
        return False
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    j = 0
    while j < most - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return max(len(x), len(y)) <= 1 or (len(x) == 2 and x == y[::-1])


@lru_cache(50_000)
def legal_form(token: str) -> str | None:
    if token in LEGAL_OF:
        return LEGAL_OF[token]
    if len(token) >= 6:
        return next((k for w, k in LEGAL_OF.items() if len(w) >= 6 and one_edit(token, w)), None)
    return None


def name_words(text: str | None) -> tuple[list[str], list[str], str] | None:
    """(words, initials, legal form) of a name in order, without accents and case, each word once; '' for no legal form.

    Dots between letters close up (S.A. is sa), apostrophes go, so do words that say nothing; a single letter is an
    initial. None for fill-in values that name nobody and for texts without letters.
    """
    if not text:
        return None
    plain = _DOTTED.sub(r"\1", folded(text).replace("'", "").replace("’", "").replace("&", " and ").replace("+", " and "))
    tokens = _WORD.findall(plain)
    if "".join(tokens) in NOBODY or not any(t.isalpha() for t in tokens):
        return None
    legal, i, rest = "", 0, []
    while i < len(tokens):
        for n in (4, 3, 2, 1):
            joined = "".join(tokens[i : i + n])
            if i + n <= len(tokens) and (k := (legal_form(joined) if n < 3 else LEGAL_OF.get(joined))) and not (n == 1 and len(tokens) == 1):
                legal, i = k, i + n
                break
        else:
            rest.append(tokens[i])
            i += 1
    kept = [t for t in dict.fromkeys(rest) if t not in EMPTY]
    words = [t for t in kept if len(t) > 1]
    if not words:
        return (kept or tokens, [], legal)
    return words, [t for t in kept if len(t) == 1], legal


def abbreviates(short: str, word: str) -> bool:
    """Whether short may stand for word: same first letter and its letters in order, two thirds of it at most if they are its beginning."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return 3 * len(short) <= 2 * len(word)
    rest = iter(word)
    return len(short) > 2 and all(c in rest for c in short)


def resembles(short: str, word: str) -> bool:
    """abbreviates, or four letters in a row in common."""
    return abbreviates(short, word) or any(short[i : i + 4] in word for i in range(len(short) - 3))


def similarity(a: str, b: str) -> float:
    """1 for equal words, less for words of SHORTEST letters or more (and nothing but letters) one edit apart, the less the shorter they are, else 0."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) < SHORTEST or not one_edit(a, b) or not (a + b).isalpha():
        return 0.0
    return 1.0 - 1.0 / max(len(a), len(b))
