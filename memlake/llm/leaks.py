"""Evaluation texts in training text, by a generalised suffix automaton of the test items.

The states and edges of the automaton (over words) are linear in the items; beside them
each state lists the items that share it.  Each document streams through it once; the state and the length of the longest
passage that ends at the current word are all that is kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.spread import spread

#: Words of a passage that count as a leak.
MIN_WORDS = 12
#: Items go into automata of at most so many words; more items make more blocks, each streamed over the documents.
BLOCK_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_ABSENT = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ]+")
_CLUSTER = regex.compile(r".\p{M}*", regex.S)


def normalise(text: str) -> str:
    """Lower-cased compatibility form without invisible characters."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", _ABSENT.sub("", text)).casefold())


def words(text: str) -> list[str]:
    """Runs of letters and digits, whatever their dress."""
    return _WORD.findall(normalise(text))


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """As ``words``, with the place of each in the text as it stands."""
    chars, place = [], []
    for m in _CLUSTER.finditer(_ABSENT.sub(lambda m: "\x00" * len(m.group()), text)):
        piece = m.group().replace("\x00", "")
        if piece:
            shown = normalise(piece)
            chars.append(shown)
            place += [(m.start(), m.end())] * len(shown)
    return [(m.group(), place[m.start()][0], place[m.end() - 1][1]) for m in _WORD.finditer("".join(chars))]


class ItemAutomaton:
    """Generalised suffix automaton of (item_id, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int = MIN_WORDS):
        self.least = least
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, item in items:
            last = 0
            for w in item:
                last = self._add(last, w)
        self._attach(items)

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _clone(self, p: int, w: str, q: int) -> int:
        """A state for the passages of q that are as short as p's extended by w."""
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _add(self, last: int, w: str) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier item has this passage
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _attach(self, items: list[tuple[int, list[str]]]) -> None:
        n = len(self.length)
        holders: list[list[int]] = [[] for _ in range(n)]  # items that hold a state's passages
        whole: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (words, item) of short items that end here
        mark = [-1] * n
        for k, (item_id, item) in enumerate(items):
            s = 0
            for w in item:
                s = self.next[s][w]
                p = s
                while p > 0 and mark[p] != k:
                    mark[p] = k
                    holders[p].append(item_id)
                    p = self.link[p]
            if len(item) < self.least:
                whole[s].append((len(item), item_id))
        self.holders = holders
        # short items that end at a state or at one of its suffixes
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            self.short[s] = tuple(whole[s]) + self.short[self.link[s]]

    def matches(self, document: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) wherever a passage of an item ends, with the longest such passage."""
        s, length = 0, 0
        edges, links, lengths = self.next, self.link, self.length
        for end, w in enumerate(document):
            t = edges[s].get(w)
            while t is None and s:
                s = links[s]
                length = lengths[s]
                t = edges[s].get(w)
            if t is None:
                continue
            s = t
            length += 1
            if length >= self.least or self.short[s]:
                yield end, length, s

    def found(self, document: list[str]) -> dict[int, int]:
        """item -> words of its longest passage in the document (of a short item, all its words)."""
        out: dict[int, int] = {}
        for _, seen, s in self.matches(document):
            p, length = s, seen
            while length >= self.least:  # shorter passages that end here may be in more items
                for item in self.holders[p]:
                    out[item] = max(out.get(item, 0), length)
                p = self.link[p]
                length = self.length[p]
            for n, item in self.short[s]:
                if n <= seen:
                    out[item] = max(out.get(item, 0), n)
        return out

    def spans(self, document: list[str]) -> list[tuple[int, int]]:
        """Stretches of words [start, end) that belong to leaked passages or whole short items."""
        out: list[tuple[int, int]] = []
        for end, length, s in self.matches(document):
            n = length if length >= self.least else max((k for k, _ in self.short[s] if k <= length), default=0)
            if n:
                start = end + 1 - n
                while out and out[-1][1] >= start:
                    start = min(start, out.pop()[0])
                out.append((start, end + 1))
        return out


@lru_cache(maxsize=8)
def _automaton(items: tuple, least: int) -> ItemAutomaton:
    return ItemAutomaton([(i, list(w)) for i, w in items], least)


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> list[tuple]:
    """The test items as word lists, in blocks of bounded size (at least one block)."""
    blocks, now, size = [], [], 0
    for row in items.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        w = tuple(words(row["text"])) if row["text"] and row["item_id"] is not None else ()
        if w:
            if now and size + len(w) > block_words:
                blocks.append(tuple(now))
                now, size = [], 0
            now.append((row["item_id"], w))
            size += len(w)
    return [*blocks, tuple(now)]


def find_leaks(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, words): every document with ``least`` consecutive words of an item, or all words of a shorter one.

    ``words`` is the length of the longest passage.  Null and empty texts and items
    leak nothing; texts are read whole; a document or item given twice is one.  The
    test items travel to the workers in blocks of bounded size; documents are
    scanned once a block, without a shuffle but the one that unites repeats.
    """

    def scan(block: tuple):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = _automaton(block, least)
            for b in batches:
                docs, found, longest = [], [], []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    for item, n in a.found(words(text)).items():
                        docs.append(doc)
                        found.append(item)
                        longest.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(found, pa.int64()), pa.array(longest, pa.int32())],
                    ["doc_id", "item_id", "words"],
                )

        return run

    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    texts = spread(texts)
    parts = [texts.mapInArrow(scan(block), "doc_id bigint, item_id bigint, words int") for block in item_blocks(items)]
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def scrub(
    documents: DataFrame, items: DataFrame, least: int = MIN_WORDS, max_words: int = 12, max_coverage: float = 0.5
) -> DataFrame:
    """(doc_id, n_spans, leaked_words, coverage, action, text): the leaking documents without their leaks.

    Spans of at least ``max_words`` words (short items as a whole) are cut out
    (``trimmed``); a document of whose words more than ``max_coverage`` leak is left
    out whole (``dropped``, null text).  Documents without a leak give no row.
    """
    blocks = item_blocks(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [_automaton(block, least) for block in blocks]
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                plain = words(text)
                if not any(True for a in automata for _ in a.spans(plain)):
                    continue
                placed = word_spans(text)
                document = [w for w, _, _ in placed]
                spans: list[tuple[int, int]] = []
                for s, e in sorted(x for a in automata for x in a.spans(document)):
                    if spans and s <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
                    else:
                        spans.append((s, e))
                n = sum(e - s for s, e in spans)
                cover = n / max(1, len(document))
                kept, at = [], 0
                for s, e in spans:
                    if e - s >= max_words or e - s < least:
                        kept.append(text[at : placed[s][1]])
                        at = placed[e - 1][2]
                kept.append(text[at:])
                drop = cover > max_coverage
                out.append((doc, len(spans), n, cover, "dropped" if drop else "trimmed", None if drop else "".join(kept)))
            cols = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                ["doc_id", "n_spans", "leaked_words", "coverage", "action", "text"],
            )

    return (
        documents.select("doc_id", "text")
        .where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .mapInArrow(
            run, "doc_id bigint, n_spans int, leaked_words int, coverage double, action string, text string"
        )
    )
