"""Groups of records from pairwise links: alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.scratch import materialized, remove


def merge_links(entities: DataFrame) -> DataFrame:
    """Links (a, b) that the statuses state: ``merged_into:`` and an id, in any case and spacing.

    Ids are compared in lower case.  Every row of an id counts; statuses that are null
    or say anything else give no link; an id that names itself gives none either.
    """
    said = F.lower(F.col("status"))
    target = F.regexp_extract(said, r"(?U)^\s*merged_into:\s*(\S+)\s*$", 1)
    return (
        entities.select(F.lower("entity_id").alias("a"), target.alias("b"))
        .where(F.col("a").isNotNull() & (F.col("b") != "") & (F.col("a") != F.col("b")))
        .distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, group_id): every linked record with the smallest id of its component.

    ``links`` has string columns ``a`` and ``b``.  Edges run from the larger to the
    smaller id.  Large-star hands every larger neighbour of a record the smallest of
    its neighbourhood, small-star does so for the smaller neighbours; both are one
    aggregation and one join, a neighbourhood is never gathered in one place, and a
    record linked to a third of all others is split by adaptive skew joins.  Rounds
    end when the edge set no longer changes (its count and hash sum); after that every
    record points straight at its component's minimum.  Each round is a table in the
    shared folder, so no lineage grows and a lost executor costs one round.

    Null ids and links of an id to itself are left out; repeated links count once; an
    empty table gives no rows.
    """
    edges = (
        links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges, path = materialized(edges, "links")
    before = _fingerprint(edges)
    for _ in range(max_rounds):
        starred = _small_star(_large_star(edges))
        starred, new = materialized(starred, "links")
        after = _fingerprint(starred)
        remove(edges.sparkSession, path)
        edges, path = starred, new
        if after == before:
            return _labels(edges)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _labels(edges: DataFrame) -> DataFrame:
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("group_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(roots).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a record is linked to the smallest of the record and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The record and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def merge_groups(entities: DataFrame) -> DataFrame:
    """(entity_id, group_id) of every id that a merge links, directly or through others."""
    return connected(merge_links(entities)).select(F.col("id").alias("entity_id"), "group_id")
