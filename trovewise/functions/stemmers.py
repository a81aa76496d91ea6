"""Stemmers over arrays of tokens, as Arrow pandas UDFs that stem each different token of a batch once."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWEL = "aeiouy"
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile(f"[{_VOWEL}][^{_VOWEL}]").search(w, start)
        return m.end() if m else len(w)

    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if first is None else first
    return r1, after(r1)


def _short(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(rf"(^[{_VOWEL}][^{_VOWEL}]$)|([^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]$)", w))


def porter2_stem(word: str) -> str:
    """The second English stemmer of Porter's, of a lower-case word; words of other letters stay as they are."""
    w = word[1:] if word.startswith("'") else word
    if len(w) < 3:
        return word
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w[0] == "y":
        w = "Y" + w[1:]
    w = re.sub(rf"([{_VOWEL}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWEL}]", w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    m = re.search(r"(eedly|ingly|edly|eed|ing|ed)$", w)
    if m:
        base = w[: m.start()]
        if m[0] in ("eed", "eedly"):
            w = base + "ee" if len(base) >= r1 else w
        elif re.search(f"[{_VOWEL}]", base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLE):
                w = w[:-1]
            elif r1 >= len(w) and _short(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for suffix, to in _STEP2:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if len(base) >= r1 and (suffix != "ogi" or base.endswith("l")) and (suffix != "li" or base[-1:] in set("cdeghkmnrt")):
                w = base + to
            break
    for suffix, to in _STEP3:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if len(base) >= (r2 if suffix == "ative" else r1):
                w = base + to
            break
    for suffix in _STEP4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if len(base) >= r2 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def krovetz_stem(word: str) -> str:
    """Inflectional endings only, by rules: the dictionary of the published stemmer is not available, so this is partial.

    Lower-cases; plurals lose their ending; -ed and -ing go only where a doubled consonant or a long stem shows a verb.
    """
    w = word.lower()
    if len(w) < 4 or not w.isalpha():
        return w
    if w.endswith("ies"):
        return w[:-3] + "y"
    if w.endswith("es") and w[:-2].endswith(("s", "x", "z", "ch", "sh")):
        return w[:-2]
    if w.endswith("s") and not w.endswith(("ss", "us", "is")):
        return w[:-1]
    for suffix in ("ing", "ed"):
        base = w[: -len(suffix)]
        if w.endswith(suffix) and len(base) >= 4 and re.search(f"[{_VOWEL}]", base):
            return base[:-1] if base.endswith(_DOUBLE) else base
    return w


def _over_arrays(stem):
    @F.pandas_udf("array<string>")
    def run(tokens: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return tokens.map(lambda own: None if own is None else [known[t] if t in known else known.setdefault(t, stem(t)) for t in own])

    return run


def porter2(tokens: Column) -> Column:
    return _over_arrays(porter2_stem)(tokens)


def krovetz(tokens: Column) -> Column:
    return _over_arrays(krovetz_stem)(tokens)


STEMMERS = {"porter2": porter2_stem, "krovetz": krovetz_stem}


def stemmer(name: str):
    if name not in STEMMERS:
        raise ValueError(f"unknown stemmer: {name}")
    return STEMMERS[name]
