"""Frequencies of all n-grams by a distributed suffix array with common-prefix intervals.

1. Equal records collapse to one with a weight, so a value that a third of all rows
   repeat is one record.
2. Each record yields its suffixes (term sequences, whole unless ``max_n`` cuts them).  In the
   record's own suffix order, the common prefix of a suffix with the one before it is
   what the record has already shown: n-grams no longer than that are duplicates within
   the record.  This depth travels with the suffix, so record counts need no second look.
3. The suffixes are range-sorted over the cluster.  One scan of each range with a stack
   of open common-prefix intervals gives, for each interval, the occurrences and, less
   the duplicates, the records of all n-grams in it.
4. Counts are sums, so an n-gram whose interval crosses a range border is simply the sum
   of its parts; one aggregation joins them.

A record of L different terms has about L * L / 2 n-grams, and all of them are counted: without
``max_n`` the result of long texts grows with the square of their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Suffixes are handed on in batches of about so many characters.
BATCH_CHARS = 4_000_000

_TERM = re.compile(r"[^\W_]+")
#: Parts the terms of a suffix; sorts before every term character.
_SEP = " "


def terms(text: str) -> list[str]:
    """The longest runs of letters and digits in the lower-cased text."""
    return _TERM.findall(text.lower())


def record_suffixes(words: list[str], max_n: int | None = None) -> list[tuple[str, int]]:
    """(suffix, depth): n-grams at its start no longer than depth stand elsewhere in the record too."""
    order = sorted(words[i : None if max_n is None else i + max_n] for i in range(len(words)))
    out, before = [], []
    for s in order:
        depth = 0
        for a, b in zip(before, s):
            if a != b:
                break
            depth += 1
        out.append((_SEP.join(s), depth))
        before = s
    return out


def _split(max_n: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights = b.column("w").to_pylist()
            suffix, depth, weight, held = [], [], [], 0

            def flush():
                return pa.RecordBatch.from_arrays(
                    [pa.array(suffix, pa.string()), pa.array(depth, pa.int32()), pa.array(weight, pa.int64())],
                    ["suffix", "depth", "w"],
                )

            for value, w in zip(b.column("value").to_pylist(), weights):
                for s, d in record_suffixes(terms(value), max_n):
                    suffix.append(s)
                    depth.append(d)
                    weight.append(w)
                    held += len(s) + 16
                    if held > BATCH_CHARS:
                        yield flush()
                        suffix, depth, weight, held = [], [], [], 0
            yield flush()

    return run


def _intervals():
    """Sorted (suffix, depth, w) -> (ngram, n, occurrences, records), in parts at range borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngram, size, occ, rec = [], [], [], []
        held = 0
        words: list[str] = []  # the current suffix; entry k of the stacks is the interval of its first k + 1 terms
        seen: list[int] = []
        fresh: list[int] = []

        def close(to: int) -> None:
            """Close the intervals longer than ``to`` terms and hand their sums to the shorter ones."""
            nonlocal held
            while len(words) > to:
                k = len(words)
                n, m = seen.pop(), fresh.pop()
                ngram.append(_SEP.join(words))
                held += len(ngram[-1]) + 32
                size.append(k)
                occ.append(n)
                rec.append(n - m)
                words.pop()
                if k > 1:
                    seen[-1] += n
                    # duplicates at depth k are duplicates at k - 1 too
                    fresh[-1] += m

        def flush():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ngram, pa.string()),
                    pa.array(size, pa.int32()),
                    pa.array(occ, pa.int64()),
                    pa.array(rec, pa.int64()),
                ],
                ["ngram", "n", "occurrences", "records"],
            )

        for b in batches:
            for s, d, w in zip(b.column("suffix").to_pylist(), b.column("depth").to_pylist(), b.column("w").to_pylist()):
                new = s.split(_SEP)
                common = 0
                for x, y in zip(words, new):
                    if x != y:
                        break
                    common += 1
                close(common)
                for x in new[common:]:
                    words.append(x)
                    seen.append(0)
                    fresh.append(0)
                seen[-1] += w
                if d:
                    fresh[d - 1] += w
                if held > BATCH_CHARS:
                    yield flush()
                    ngram, size, occ, rec, held = [], [], [], [], 0
        close(0)
        yield flush()

    return run


def term_records(observations: DataFrame, column: str = "predicate") -> DataFrame:
    """(value, w): the distinct values with the number of observations that hold them."""
    from memlake.operators.dedupe import once

    return once(observations.where(F.col(column).isNotNull()), column).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("w")
    )


def ngram_counts(records: DataFrame, max_n: int | None = None) -> DataFrame:
    """(ngram, n, occurrences, records) of all n-grams, or of those of at most ``max_n`` terms.

    ``records`` has ``value`` and weight ``w``.  Null, empty and term-less values give
    nothing; an empty table gives no rows; a value given twice counts with both weights.
    """
    suffixes = (
        records.where(F.col("value").isNotNull())
        .select(F.col("value").cast("string").alias("value"), F.col("w").cast("bigint").alias("w"))
        .mapInArrow(_split(max_n), "suffix string, depth int, w bigint")
        .groupBy("suffix", "depth")
        .agg(F.sum("w").alias("w"))
    )
    return (
        suffixes.repartitionByRange("suffix", "depth")
        .sortWithinPartitions("suffix", "depth")
        .mapInArrow(_intervals(), "ngram string, n int, occurrences bigint, records bigint")
        .groupBy("ngram", "n")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )


def with_mark(counts: DataFrame, records: DataFrame, rare_below: int = 5, common_above: float = 0.1) -> DataFrame:
    """``counts`` with ``mark``: rare, common or null.

    Rare: in fewer than ``rare_below`` records.  Common: in more than ``common_above``
    of the records that have any term.
    """
    some = F.col("value").rlike(r"[\p{L}\p{N}]")
    total = records.agg(F.sum(F.when(some, F.col("w"))).alias("total")).scalar()
    return counts.withColumn(
        "mark",
        F.when(F.col("records") < rare_below, "rare").when(F.col("records") > total * common_above, "common"),
    )
