"""Porter's stemmer (1980) with the departures its author and later libraries added; words in lower case.

A memo holds the stems of the words a task has seen, so that a word is stemmed once.
"""

from __future__ import annotations

import re

# Forms with stems of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes and what stands for them after a stem with a vowel and a consonant behind it.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# Stems as runs of consonants and vowels; y is a vowel behind a consonant, and a first y is written Y.
C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME, MORE, ONE = f"^({C})?{V}{C}", f"^({C})?{V}{C}{V}{C}", f"^({C})?{V}{C}({V})?$"
VOWEL = f"^({C})?[aeiouy]"
SHORT = f"^{C}[aeiouy][^aeiouwxy]$|^[aeiou][^aeiou]$"
OPEN = "[aeiou]$|[^aeiouy]y$|^y$"  # ends in a vowel


def _has(pattern: str, stem: str) -> bool:
    return re.search(pattern, stem) is not None


def _first(word: str, rules, least: str) -> str:
    """The word by the first rule whose suffix it has."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _has(least, stem) else word
    return word


def _past(w: str) -> str:
    """Without -ed and -ing."""
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _has(SOME, w[:-3]) else w
    stem = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and _has(VOWEL, w[: -len(s)])), None)
    if stem is None:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and not _has(OPEN, stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _has(ONE, stem) and _has(SHORT, stem) else stem


def _adverb(w: str) -> str:
    if w.endswith("alli") and _has(SOME, w[:-4]):
        return _adverb(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _has(SOME, w[:-3]) else w
    return _first(w, STEP2, SOME)


REMEMBERED = 1 << 17
_known: dict[str, str] = {}


def stem(word: str) -> str:
    """The stem of a word."""
    found = _known.get(word)
    if found is None:
        if len(_known) >= REMEMBERED:
            _known.clear()
        found = _known[word] = _stem(word)
    return found


def _stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    w = _past(w)
    if w.endswith("y") and len(w) > 2 and not _has(OPEN, w[:-1]):
        w = w[:-1] + "i"
    w = _first(_adverb(w), STEP3, SOME)
    for suffix in STEP4:
        if w.endswith(suffix):
            base = w[: len(w) - len(suffix)]
            w = base if _has(MORE, base) and (suffix != "ion" or base[-1:] in ("s", "t")) else w
            break
    if w.endswith("e") and (_has(MORE, w[:-1]) or (_has(ONE, w[:-1]) and not _has(SHORT, w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _has(MORE, w[:-1]):
        w = w[:-1]
    return w.replace("Y", "y")
