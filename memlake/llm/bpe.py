"""Byte-pair encoding as a streaming transducer with bounded lookahead.

The merges of a rank file decide, for every prefix of the input, one last token: the
token that ends there and is compatible with the last token before it (two tokens are
compatible if encoding their joined bytes gives just these two).  So the encoder keeps
one back pointer a byte.  A later token can only start at a live position, one from
which the bytes so far begin some token; where the back pointers of all live positions
meet, everything before is stable and is emitted.  The buffer therefore never holds
more than the lookahead that the merge list needs, however long the text is.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.spread import spread

#: Pretokens up to this length are remembered, at most so many of them a worker.
CACHE_CHARS, CACHE_SIZE = 48, 400_000


class Transducer:
    """Encodes and decodes by a rank file (lines of base64 token and rank)."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.prefixes = {t[:k] for t in self.ranks for k in range(1, len(t) + 1)}
        self.suffixes = {t[k:] for t in self.ranks for k in range(len(t))}
        self.split_words = regex.compile(pattern)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._cache: dict[str, tuple[int, ...]] = {}
        self._lookahead = 0

    def merged(self, data: bytes, below: int | None = None) -> list[bytes]:
        """The parts of short ``data`` when the merges are applied in rank order (those below a rank)."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best) and (below is None or r < below):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            x, y = self.bytes_of[a], self.bytes_of[b]
            known = self._pairs[(a, b)] = self.merged(x + y) == [x, y]
        return known

    @property
    def lookahead(self) -> int:
        """Bytes after which a token is sure to be stable, from the merge list.

        What follows can only undo a merge (a, b) through a merge (b, c) of higher
        priority that takes b away, that one only through a merge of still higher
        priority on c, and so on: the longest such chain bounds the lookahead.
        """
        if not self._lookahead:
            reach: dict[bytes, int] = {}  # by left part: bytes to its right that a chain of the merges so far spans
            longest = max(map(len, self.ranks))
            for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
                if len(token) == 1:
                    continue
                parts = self.merged(token, rank)
                if len(parts) != 2:
                    continue
                left, right = parts
                span = len(right) + reach.get(right, 0)
                if span > reach.get(left, 0):
                    reach[left] = span
            self._lookahead = longest + max(reach.values(), default=0)
        return self._lookahead

    def stream(self, chunks: Iterable[bytes], every: int) -> Iterator[int]:
        """Token ids of one pretoken that comes in pieces; looks for stable ones whenever ``every`` bytes came."""
        buf = bytearray()  # bytes after the last stable border
        last: list[int] = []  # last[i]: last token of the encoding that ends after byte i of buf
        live: list[int] = []  # borders in buf from which the bytes so far begin a token
        fed = 0
        before: int | None = None  # token before the border
        ranks, prefixes, suffixes = self.ranks, self.prefixes, self.suffixes
        for chunk in chunks:
            for byte in chunk:
                buf.append(byte)
                i = len(buf)
                live = [j for j in live if bytes(buf[j:i]) in prefixes]
                if bytes(buf[i - 1 : i]) in prefixes:
                    live.append(i - 1)
                found = -1
                k = i - 1
                while k >= 0:
                    piece = bytes(buf[k:i])
                    if piece not in suffixes:
                        break
                    token = ranks.get(piece)
                    if token is not None:
                        prior = last[k - 1] if k else before
                        if prior is None or self.compatible(prior, token):
                            found = token
                            break
                    k -= 1
                if found < 0:
                    raise ValueError("the rank file doesn't cover all bytes")
                last.append(found)
                fed += 1
                if fed % every == 0:
                    border = self._stable(last, {*live, i})
                    if border:
                        out = self._back(last, border)
                        yield from out
                        before = out[-1]
                        del buf[:border], last[:border]
                        live = [j - border for j in live]
        yield from self._back(last, len(last))

    def _stable(self, last: list[int], live: set[int]) -> int:
        """The last border that the encodings ending at all live borders share."""
        heads = sorted(live)
        while len(heads) > 1:
            top = heads.pop()
            if not top:
                return 0
            down = top - len(self.bytes_of[last[top - 1]])
            if down not in heads:
                heads.append(down)
                heads.sort()
        return heads[0] if heads else 0

    def _back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        out.reverse()
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one pretoken."""
        ids = self._cache.get(word)
        if ids is None:
            if len(word) > CACHE_CHARS:
                step = 4096
                pieces = (word[i : i + step].encode() for i in range(0, len(word), step))
                return tuple(self.stream(pieces, self.lookahead))
            data = word.encode()
            whole = self.ranks.get(data)
            ids = (whole,) if whole is not None and self.merged(data) == [data] else tuple(self.stream([data], len(data) + 1))
            if len(self._cache) >= CACHE_SIZE:
                self._cache.clear()
            self._cache[word] = ids
        return ids

    def encode(self, text: str | None) -> Iterator[int]:
        """Ids of a text, without special tokens; none for an empty or null text."""
        cache = self._cache
        for m in self.split_words.finditer(text or ""):
            w = m.group()
            yield from cache.get(w) or self.word(w)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text in pieces, by a byte-to-text state machine that holds at most one unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            piece = machine.decode(self.bytes_of[i])
            if piece:
                yield piece
        rest = machine.decode(b"", True)
        if rest:
            yield rest


@lru_cache(maxsize=2)
def transducer(rank_file: bytes, pattern: str) -> Transducer:
    """One a worker process, so that what it remembers serves all batches."""
    return Transducer(rank_file, pattern)


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """The rank file (by default the byte-level one of 50k ranks) and the pretoken pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document, in one pass without a shuffle.

    Null and empty texts have an empty list; any script, blank or very long texts are
    encoded whole; repeated rows give repeated results.  The vocabulary (under 1 MB)
    travels with the task, so executors need no file.
    """
    rank_file, pattern = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(rank_file, pattern)
        for b in batches:
            values, offsets = array("i"), array("i", [0])
            for text in b.column("text").to_pylist():
                if text:
                    values.extend(t.encode(text))
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    return spread(texts).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of every list of ids; a null or empty list is the empty text."""
    rank_file, pattern = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(rank_file, pattern)
        for b in batches:
            texts = ["".join(t.decode(ids or ())) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
