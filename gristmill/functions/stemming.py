"""English suffix stripping by Porter's published algorithm (Program 14(3), 1980)."""

from __future__ import annotations

from functools import lru_cache

# Suffix rules of steps 2, 3 and 4 of the published algorithm.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """Word as a string of c (consonant) and v (vowel)."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).replace("cc", "c").count("vc") if stem else 0


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _short(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replace(word: str, rules) -> str:
    """Apply the rule with the longest matching suffix if its stem has measure above 0."""
    hits = [(s, r) for s, r in rules if word.endswith(s)]
    if not hits:
        return word
    suffix, put = max(hits, key=lambda h: len(h[0]))
    stem = word[: len(word) - len(suffix)]
    return stem + put if _measure(stem) > 0 else word


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    # plurals and participles
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            word = cut[:-1]
        elif _measure(cut) == 1 and _short(cut):
            word = cut + "e"
        else:
            word = cut
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2), STEP3)
    # remaining suffixes after a long enough stem
    hits = [s for s in STEP4 if word.endswith(s)]
    if hits:
        suffix = max(hits, key=len)
        stem = word[: len(word) - len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
            word = stem
    # final e and double l
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
