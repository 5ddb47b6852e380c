"""The Porter stemmer (M. F. Porter, 1980), for the lexical index."""

from __future__ import annotations

from functools import lru_cache

# Fixed values of the published algorithm: suffixes and what replaces them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous",
    "ive", "ize", "ion",
)


def _consonants(word: str) -> str:
    """The word's letters as c or v."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel stretch is followed by a consonant stretch."""
    return _consonants(stem).replace("cc", "c").count("vc") if stem else 0


def _has_vowel(stem: str) -> bool:
    return "v" in _consonants(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return len(word) > 2 and _consonants(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    """The longest suffix in the table is replaced if enough stem is left."""
    for n in range(min(7, len(word) - 1), 1, -1):
        suffix = word[-n:]
        if suffix in table:
            stem = word[:-n]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word; words of one or two letters and others than a-z stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    # 1a: plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: -ed and -ing
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    # 1c
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2), STEP_3)
    # 4: remaining suffixes
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    # 5: final e and double l
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short_end(base):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
