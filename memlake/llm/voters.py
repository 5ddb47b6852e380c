"""Voters on abusive content: word classes and how they stand to each other in a segment.

Each voter says yes or abstains; those of ``AGAINST`` speak for harmless text.  None of
them knows a phrase: they look for classes of words (``lexicon``), for one class
following another within a few words, and for chains of three.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

from memlake.llm.lexicon import BIT, UNSPACED
from memlake.llm.plaintext import Segments


def _bits(names: str) -> int:
    return sum(BIT[n] for n in names.split("|"))


ABUSIVE = "INSULT|SLUR|FOREIGN"
LEXICAL = {
    "insult": "INSULT", "slur": "SLUR", "foreign insult": "FOREIGN", "profanity": "PROFANE", "sexual body part": "SEXPART",
    "sexual act": "SEXACT", "nudity": "NUDE",
}
#: One class after another: name -> steps of (classes, words until it at most).
CHAINS = {
    "you are belittled": ("YOU", ("BELITTLE", 4)),
    "you are lowly": ("YOU", ("LOWLY", 5)),
    "belittled, you": ("BELITTLE", ("YOU", 3)),
    "they are belittled": ("THEY", ("SAYS", 2), ("BELITTLE", 4)),
    "they are lowly": ("THEY", ("SAYS", 2), ("LOWLY", 4)),
    "belittled and lowly": ("BELITTLE", ("LOWLY", 2)),
    "belittled and insulted": ("BELITTLE", (ABUSIVE, 3)),
    "belittled twice": ("BELITTLE", ("BELITTLE", 3)),
    "insulted, you": (ABUSIVE, ("YOU", 4)),
    "you insult": ("YOU", (ABUSIVE, 5)),
    "they insult": ("THEY", (ABUSIVE, 5)),
    "group is lowly": ("GROUP", ("LOWLY", 6)),
    "group is belittled": ("GROUP", ("BELITTLE", 5)),
    "belittled group": ("BELITTLE", ("GROUP", 2)),
    "all are lowly": ("QUANTITY", ("SAYS", 4), ("LOWLY|BELITTLE", 4)),
    "group driven out": ("GROUP", ("EXPEL", 6)),
    "drive out group": ("EXPEL", ("GROUP", 4)),
    "ought to be driven out": ("OUGHT", ("EXPEL", 4)),
    "ought to suffer": ("OUGHT", ("DIE|HARM", 4)),
    "group without worth": ("GROUP", ("DENY", 4), ("WORTH", 5)),
    "all without worth": ("QUANTITY", ("DENY", 5), ("WORTH", 5)),
    "I harm someone": ("ME", ("HARM", 6), ("YOU|THEY", 4)),
    "harm to a body": ("HARM", ("YOU|THEY", 2), ("BODY", 3)),
    "harm you": ("HARM", ("YOU", 2)),
    "wish of harm": ("HOPE", ("YOU|THEY|GROUP", 4), ("DIE|HARM", 6)),
    "you die": ("YOU", ("DIE", 4)),
    "menace to you": ("ME", ("MENACE", 5), ("YOU", 4)),
    "you will see": ("YOU", ("MENACE", 3)),
    "sent off": ("SHUT", ("OFF", 3)),
    "swearing at you": ("PROFANE", ("YOU", 3)),
    "you, swearing": ("YOU", ("PROFANE", 3)),
    "undressing": ("UNDO", ("CLOTHES", 4)),
    "show a body": ("SHOW", ("SEXPART|NUDE", 5)),
    "naked person": ("YOU|THEY|ME", ("NUDE", 4)),
    "person naked": ("NUDE", ("YOU|THEY|ME", 4)),
    "sex with person": ("SEXACT|SEXPART", ("YOU|THEY|ME", 4)),
    "person and sex": ("YOU|THEY|ME", ("SEXACT|SEXPART", 4)),
    "intimate": ("INTIMATE", ("NUDE|SEXPART|SEXACT|CLOTHES", 6)),
}
AGAINST = ("report", "technical", "of nobody", "calm")
VOTERS = (*LEXICAL, "unspaced term", "veiled word", *CHAINS, *AGAINST)
#: Voters that the classifier doesn't see, so that it has to learn from words what they say: those against, and the
#: chains that only say of a listed word whom it is said to.
HIDDEN = frozenset(AGAINST) | {v for v, (first, *steps) in CHAINS.items() if {first, steps[-1][0]} & {ABUSIVE, "PROFANE", "SEXACT|SEXPART"}}
SHOWN = tuple(i for i, v in enumerate(VOTERS) if v not in HIDDEN)

_HARMFUL = _bits("INSULT|SLUR|FOREIGN|PROFANE|SEXPART|SEXACT|NUDE|BELITTLE|LOWLY|HARM|DIE")
_PEOPLE = _bits("YOU|THEY|ME|GROUP")


def votes(s: Segments) -> np.ndarray:
    """A bit mask of the voters that say yes, for each segment."""
    n = len(s.row)
    of = s.of
    some = np.flatnonzero(s.classes)
    mask, where = s.classes[some], of[some]
    places: dict[str, np.ndarray] = {}

    def at(names: str) -> np.ndarray:
        if names not in places:
            places[names] = some[(mask & _bits(names)) != 0]
        return places[names]

    def any_of(tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(n, bool)
        out[of[tokens]] = True
        return out

    def then(a: np.ndarray, b: np.ndarray, within: int) -> np.ndarray:
        """The places of ``b`` that come first after a place of ``a``, in its segment and not too far."""
        if not len(a) or not len(b):
            return a[:0]
        k = np.searchsorted(b, a, "right")
        inside = k < len(b)
        a, j = a[inside], b[k[inside]]
        return np.unique(j[(j - a <= within) & (of[j] == of[a])])

    found = {v: any_of(at(c)) for v, c in LEXICAL.items()}
    found["unspaced term"] = np.zeros(n, bool)
    if n:
        wide = pc.invert(pc.string_is_ascii(s.text)).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(wide):
            text = s.text[int(i)].as_py()
            found["unspaced term"][i] = any(t in text for t in UNSPACED)
    found["veiled word"] = any_of(np.flatnonzero(s.veiled))
    for v, (first, *steps) in CHAINS.items():
        place = at(first)
        for names, within in steps:
            place = then(place, at(names), within)
        found[v] = any_of(place)

    def count(names: int) -> np.ndarray:
        return np.bincount(where[(mask & names) != 0], minlength=n)

    harmful = count(_HARMFUL) > 0
    found["report"] = count(_bits("REPORT")) >= 2
    found["technical"] = count(_bits("TECHNICAL")) >= 2
    found["of nobody"] = count(_PEOPLE) == 0
    found["calm"] = ~harmful & ~found["veiled word"] & ~found["unspaced term"]
    out = np.zeros(n, np.int64)
    for i, v in enumerate(VOTERS):
        out |= found[v].astype(np.int64) << i
    return out
