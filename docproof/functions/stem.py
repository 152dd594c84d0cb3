"""English stems by the published Porter2 rules, for single lower-case words (a small helper that is
applied to distinct words only)."""

from __future__ import annotations

import re

# Words with stems of their own, and those that stay after their plural is off.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Endings and what replaces them, the longest that fits first.
SECOND = [
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
THIRD = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
FOURTH = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]

VOWEL = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), "")
    r1 = len(prefix) or _after(w, 0)
    r2 = _after(w, r1)
    vowel = lambda x: any(c in VOWEL for c in x)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel(w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w

    for end in ("eedly", "eed"):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                        w = w[:-1]
                    elif r1 >= len(w) and _SHORT_END.search(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"

    for end, to in SECOND:
        if w.endswith(end):
            cut = len(w) - len(end)
            if cut >= r1 and (end != "ogi" or w[cut - 1] == "l") and (end != "li" or w[cut - 1] in "cdeghkmnrt"):
                w = w[:cut] + to
            break
    for end, to in THIRD:
        if w.endswith(end):
            cut = len(w) - len(end)
            if cut >= r1 and (end != "ative" or cut >= r2):
                w = w[:cut] + to
            break
    for end in FOURTH:
        if w.endswith(end):
            cut = len(w) - len(end)
            if cut >= r2 and (end != "ion" or w[cut - 1] in "st"):
                w = w[:cut]
            break
    if w.endswith("e"):
        cut = len(w) - 1
        if cut >= r2 or (cut >= r1 and not _SHORT_END.search(w[:cut])):
            w = w[:cut]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
