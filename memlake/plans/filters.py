"""Hard filters of an observation scan, as one predicate that reaches the Parquet reader.

None means no filter; an empty list matches nothing, an empty exclusion excludes
nothing; windows include both ends; words are matched literally and without case.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Names = Sequence[str] | None


def among(column: str, values: Names) -> Column | None:
    """Membership; None lifts the filter and an empty list matches nothing."""
    if values is None:
        return None
    return F.col(column).isin(list(values)) if values else F.lit(False)


def none_of(column: str, values: Names) -> Column | None:
    """Exclusion; a null value isn't one of the excluded."""
    return ~F.coalesce(F.col(column).isin(list(values)), F.lit(False)) if values else None


def starts_with(column: str, prefixes: Names) -> Column | None:
    if prefixes is None:
        return None
    low = F.lower(column)
    return reduce(or_, (low.startswith(p.lower()) for p in prefixes), F.lit(False))


def contains(column: str, words: str | None) -> Column | None:
    return F.lower(column).contains(words.lower()) if words else None


def every(conditions: Sequence[Column | None]) -> Column:
    return reduce(and_, (c for c in conditions if c is not None), F.lit(True))


@dataclass(frozen=True)
class Filters:
    """The filters of ``observations``; all hold together, but ``match_any`` joins words and ids by or."""

    since: float | None = None
    until: float | None = None
    subject: str | None = None
    location_ids: Names = None
    camera_ids: Names = None
    entity_ids: Names = None
    exclude_entity_ids: Names = None
    observation_ids: Names = None
    predicate_contains: str | None = None
    predicate_prefixes: Names = None
    exclude_predicates: Names = None
    origins: Names = None
    min_confidence: float | None = None
    user_id: str | None = None
    match_any: bool = False

    def hard(self) -> Column:
        """Everything but words and ids."""
        return every(
            [
                None if self.since is None else F.col("ts") >= self.since,
                None if self.until is None else F.col("ts") <= self.until,
                None if self.subject is None else F.col("subject_entity_id") == self.subject,
                None if self.min_confidence is None else F.col("confidence") >= self.min_confidence,
                None if self.user_id is None else owned_by(self.user_id),
                among("location_id", self.location_ids),
                among("camera_id", self.camera_ids),
                among("subject_entity_id", self.entity_ids),
                none_of("subject_entity_id", self.exclude_entity_ids),
                among("origin", self.origins),
                starts_with("predicate", self.predicate_prefixes),
                none_of("predicate", self.exclude_predicates),
            ]
        )

    def column(self) -> Column:
        words, ids = contains("predicate", self.predicate_contains), among("observation_id", self.observation_ids)
        if self.match_any and words is not None and ids is not None:
            return self.hard() & (words | ids)
        return every([self.hard(), words, ids])


def owned_by(user_id: str | None) -> Column:
    """Rows without owner belong to all; without a user all rows show."""
    if user_id is None:
        return F.lit(True)
    return F.col("user_id").isNull() | (F.col("user_id") == user_id)


def scan(observations: DataFrame, filters: Filters, order: str | None = None, limit: int | None = None) -> DataFrame:
    """The observations that pass, each once; ordered by (ts, seq) if asked.

    Filters come before the union of redelivered rows: deliveries are alike, so both
    orders give the same rows, and this one reads and shuffles less.
    """
    if order not in (None, "asc", "desc"):
        raise ValueError("order is asc or desc")
    rows = observations.where(filters.column()).dropDuplicates(["observation_id"])
    if order:
        rows = rows.orderBy(*(F.col(c).asc() if order == "asc" else F.col(c).desc() for c in ("ts", "seq", "observation_id")))
    return rows if limit is None else rows.limit(limit)
