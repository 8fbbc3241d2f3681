"""The Porter stemming algorithm (1980) in the form full-text engines use: words of up to two letters stay."""

from __future__ import annotations

import re

def _shape(w: str) -> str:
    """v for vowels, c for consonants; y counts as a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _m(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
    """Replace the first ending that fits, if the stem before it has a measure above `least`."""
    for end, new in rules:
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            return stem + new if _m(stem) > least else w
    return w


# The suffix tables of the published algorithm.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(word: str) -> str:
    """The stem of a word in lower case. Lengths count bytes, and every byte that is no vowel is a consonant."""
    raw = word.encode()
    return word if not 3 <= len(raw) <= 64 else _stem(raw.decode("latin-1")).encode("latin-1").decode(errors="replace")


def _stem(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, sorted(STEP2, key=lambda r: -len(r[0])), 0)
    w = _swap(w, sorted(STEP3, key=lambda r: -len(r[0])), 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            s = w[: -len(end)]
            if _m(s) > 1 and (end != "ion" or s[-1:] in ("s", "t")):
                w = s
            break
    if w.endswith("e"):
        s = w[:-1]
        if _m(s) > 1 or _m(s) == 1 and not _cvc(s):
            w = s
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w
