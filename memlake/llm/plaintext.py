"""Texts as plain words, a batch at a time: Arrow's string kernels for the texts, one look per distinct word.

Veiled words are read as what they stand for: invisible characters, compatibility and
look-alike letters, digits for letters, dotted, spaced, stretched and starred words.
Texts are read whole; a sentence longer than ``WINDOW`` words is looked at in
overlapping windows, so no text makes a segment without bound.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash

from memlake.llm.lexicon import HARSH, OF, VEILABLE

#: Longest segment in words, and the words that neighbouring windows share.
WINDOW, OVERLAP = 48, 12
#: Distinct words remembered by a task before it starts anew.
REMEMBERED = 500_000

_INVISIBLE = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]+"
_ENDS = r"[.!?;\x{2026}]+[\"'\x{201D}\x{00BB}\x{2019})\]]*\s+|[\x{3002}]+|[\n\r\x{85}\x{2028}\x{2029}]+|\s\|\s"
_BETWEEN = r"[^\pL\pN@$\x{20AC}*+'!\x{02}]+"  # \x02 marks a word that was put together
_APART = r"(?:^|[^\pL\pN])(?:(?:\pL[.\-_*\x{B7}\x{2022}]){2,}\pL|(?:\pL ){3,}\pL)(?:[^\pL\pN]|$)"
_APART_IN = regex.compile(r"(?<![\p{L}\p{N}])((?:\p{L}[.\-_*·•]){2,}\p{L}|(?:\p{L} ){3,}\p{L})(?![\p{L}\p{N}])")
_IDEOGRAPH = r"([\p{Han}\p{Hiragana}\p{Katakana}])"
#: Letters of other alphabets that look like these Latin ones, and signs that stand for letters (fixed values).
_LOOKS = str.maketrans("аеорсухіѕјһԁɡԛԝкмтвноαενρτυκι", "aeopcyxisjhdgqwkmtbhoaevptuki")
_SIGNS = tuple(str.maketrans("013457@$!€+", x) for x in ("oieastasiet", "oleastaslet"))
_LATIN, _ELSE = regex.compile(r"[a-z]"), regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_STRETCH = regex.compile(r"(\p{L})\1{2,}")
_ODD = regex.compile(r"\p{L}[@$!€+*0-9]|[@$!€+*0-9]\p{L}")
_STARRED: dict[tuple[str, str, int], str] = {}
for _w in sorted(VEILABLE, key=lambda w: (w in HARSH, w)):
    _STARRED[(_w[0], _w[-1], len(_w))] = _w


def plain_word(token: str) -> tuple[str, bool]:
    """A lower-case token as the word it stands for, and whether it was veiled."""
    word = token.strip("'!+")
    if not word.isascii() and _LATIN.search(word) and _ELSE.search(word):
        word = word.translate(_LOOKS)
        if word in VEILABLE:
            return word, True
    if word in OF or word.isascii() and word.isalpha() and not _STRETCH.search(word):
        return word, False
    if "*" in word.strip("*"):
        guess = _STARRED.get((word[0], word[-1], len(word)))
        return (guess, True) if guess else (word.replace("*", ""), False)
    word = word.strip("*")
    if _ODD.search(word):
        for signs in _SIGNS:
            guess = word.translate(signs)
            for form in (guess, _STRETCH.sub(r"\1", guess)):
                if form in VEILABLE:
                    return form, True
    if word.isdigit():
        return "0", False
    for to in (r"\1", r"\1\1"):
        guess = _STRETCH.sub(to, word)
        if guess != word and guess in VEILABLE:
            return guess, True
    return word, False


def _together(m: regex.Match) -> str:
    """Letters set apart, put together; what stands before a known word stays apart from it."""
    letters = regex.sub(r"[^\p{L}]", "", m.group(1))
    for k in range(max(0, min(3, len(letters) - 2))):
        if letters[k:] in VEILABLE:
            return " ".join([*letters[:k], letters[k:] + "\x02"])
    return letters


def _every(pattern: str, form: str, strings: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(strings, pattern=pattern, replacement=form)


def cleaned(texts: pa.Array) -> pa.Array:
    """Lower case, compatibility forms plain, accents and invisible characters gone, letters set apart put together."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.string()), "")
    odd = pc.invert(pc.string_is_ascii(texts))
    if pc.any(odd).as_py():
        some = _every(_INVISIBLE, "", texts.filter(odd))
        some = pc.utf8_lower(pc.utf8_normalize(some, form="NFKC"))
        some = pc.utf8_normalize(_every(r"\p{Mn}+", "", pc.utf8_normalize(some, form="NFD")), form="NFC")
        some = _every(_IDEOGRAPH, r" \1 ", _every("ß", "ss", _every("’", "'", some)))
        texts = pc.replace_with_mask(pc.utf8_lower(texts), odd, some)
    else:
        texts = pc.utf8_lower(texts)
    apart = pc.match_substring_regex(texts, _APART)
    if pc.any(apart).as_py():
        fixed = [_APART_IN.sub(_together, s) for s in texts.filter(apart).to_pylist()]
        texts = pc.replace_with_mask(texts, apart, pa.array(fixed, pa.string()))
    return texts


class Words:
    """Distinct words seen by a task: hash, classes, whether veiled."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.plain: list[str] = []
        self.hash = np.zeros(1024, np.uint32)
        self.classes = np.zeros(1024, np.int64)
        self.veiled = np.zeros(1024, bool)

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.at) > REMEMBERED:
            self.__init__()
        at = self.at
        for t in tokens:
            if t not in at:
                self._add(t)
        return np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))

    def _add(self, token: str) -> None:
        i = len(self.plain)
        if i == len(self.hash):
            self.hash, self.classes, self.veiled = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.classes, self.veiled))
        word, veiled = plain_word(token.replace("\x02", ""))
        self.at[token] = i
        self.plain.append(word)
        self.hash[i], self.classes[i], self.veiled[i] = xxhash.xxh32_intdigest(word), OF.get(word, 0), veiled or "\x02" in token


@dataclass
class Segments:
    """The segments of a batch: token arrays, the first token of each segment (and the end), the row each belongs to."""

    hash: np.ndarray
    classes: np.ndarray
    veiled: np.ndarray
    start: np.ndarray
    row: np.ndarray
    text: pa.Array

    @property
    def of(self) -> np.ndarray:
        """The segment of each token."""
        return np.repeat(np.arange(len(self.row)), np.diff(self.start))


def _offsets(lists: pa.Array) -> np.ndarray:
    o = lists.offsets.to_numpy()
    return o - o[0]


def segments(texts: pa.Array, words: Words) -> Segments:
    """The texts cut into segments of plain words; rows without words have none."""
    parts = pc.split_pattern_regex(cleaned(texts), _ENDS)
    row = np.repeat(np.arange(len(parts)), np.diff(_offsets(parts)))
    lines = parts.flatten()
    tokens = pc.split_pattern_regex(lines, _BETWEEN)
    line = np.repeat(np.arange(len(tokens)), np.diff(_offsets(tokens)))
    coded = tokens.flatten().dictionary_encode()
    known = words.ids(coded.dictionary.to_pylist())
    w = known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    empty = np.fromiter((not p for p in words.plain), bool, len(words.plain))
    keep = ~empty[w]
    w, line = w[keep], line[keep]
    count = np.bincount(line, minlength=len(lines))
    first = np.cumsum(count) - count
    some = np.flatnonzero(count)
    count, first = count[some], first[some]
    # windows of long segments
    step = WINDOW - OVERLAP
    pieces = 1 + np.maximum(0, -(-(count - WINDOW) // step))
    seg = np.repeat(np.arange(len(some)), pieces)
    k = np.arange(len(seg)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[seg] + k * step
    size = np.minimum(WINDOW, first[seg] + count[seg] - begin)
    start = np.r_[0, np.cumsum(size)]
    take = np.repeat(begin - start[:-1], size) + np.arange(start[-1])
    w = w[take]
    shown, place = np.unique(w, return_inverse=True)
    plain = pa.array([words.plain[i] for i in shown.tolist()], pa.string()).take(pa.array(place.reshape(-1)))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(start, pa.int32()), plain), " ")
    return Segments(words.hash[w], words.classes[w], words.veiled[w], start, row[some][seg], text)


def bare(word: str) -> str:
    """One word as lexicons hold it."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)).replace("ß", "ss")
