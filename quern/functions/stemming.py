"""The English stemmer known as Porter2 [snowballstem.org/algorithms/english].

Words are taken as they are: capitals are consonants.
"""

from __future__ import annotations

import re

# The algorithm's word lists, suffixes and letters.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
VOWELS = "aeiouy"
DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())
#: Suffixes of the second and third step with what stands for them.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")

REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")
START = re.compile("gener|commun|arsen")
SHORT = re.compile(f"(?:[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$")
VOWEL = re.compile(f"[{VOWELS}]")
CONSONANT_Y = re.compile(f"(^|[{VOWELS}])y")


def _after(word: str, at: int) -> int:
    """Where the region begins that follows the first consonant after a vowel from ``at`` on."""
    m = REGION.search(word, at)
    return m.end() if m else len(word)


def _ends(table) -> tuple[str, ...]:
    return tuple(sorted(table, key=len, reverse=True))


SECOND_ENDS, THIRD_ENDS, FOURTH_ENDS = _ends(SECOND), _ends(THIRD), _ends(FOURTH)
PAST_ENDS = ("eedly", "ingly", "edly", "eed", "ing", "ed")


def _longest(word: str, ends: tuple[str, ...]) -> str | None:
    """The first of some ends, the longest first; most words have none, which one call tells."""
    return next(e for e in ends if word.endswith(e)) if word.endswith(ends) else None


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.removeprefix("'")
    w, marked = CONSONANT_Y.subn(r"\1Y", w) if "y" in w else (w, 0)
    start = START.match(w)
    r1 = start.end() if start else _after(w, 0)
    r2 = _after(w, r1)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    w = _plural(w)
    if w in KEPT:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    end = _longest(w, SECOND_ENDS)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if not (end == "ogi" and not before.endswith("l") or end == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            w = before + SECOND[end]
    end = _longest(w, THIRD_ENDS)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + THIRD[end]
    end = _longest(w, FOURTH_ENDS)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not SHORT.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y") if marked else w


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _longest(w, PAST_ENDS)
    if end is None:
        return w
    before = w[: -len(end)]
    if end in ("eed", "eedly"):
        return before + "ee" if len(before) >= r1 else w
    if not VOWEL.search(before):
        return w
    if before.endswith(("at", "bl", "iz")):
        return before + "e"
    if before[-2:] in DOUBLES:
        return before[:-1]
    return before + "e" if len(before) <= r1 and SHORT.search(before) else before
