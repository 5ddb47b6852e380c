"""Keeping the memory right: merging, splitting and deleting entities over immutable tables.

Each correction is a projection of a table to its next version; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.scratch import materialized, remove

#: Columns that refer to an entity, by table.
REFERENCES = {
    "signatures": ["entity_id"],
    "observations": ["subject_entity_id", "object_entity_id"],
    "relations": ["subject_entity_id", "object_entity_id"],
}


def repoint(df: DataFrame, columns: list[str], moves: DataFrame) -> DataFrame:
    """``df`` with every reference (src) replaced by its target (dst).

    ``moves`` (src, dst) has one row a source; any number of merges is one pass.
    """
    for c in columns:
        way = moves.select(F.col("src").alias(f"_s_{c}"), F.col("dst").alias(f"_d_{c}"))
        df = df.join(way, F.col(c) == F.col(f"_s_{c}"), "left").withColumn(c, F.coalesce(f"_d_{c}", c)).drop(f"_s_{c}", f"_d_{c}")
    return df


def repoint_snapshots(snapshots: DataFrame, moves: DataFrame) -> DataFrame:
    """Inventories with merged members replaced, sorted and without repeats."""
    members = snapshots.select("snapshot_id", F.explode("present_entity_ids").alias("id"))
    touched = members.join(moves.select(F.col("src").alias("id")), "id", "left_semi").select("snapshot_id").distinct()
    moved = repoint(members.join(touched, "snapshot_id", "left_semi"), ["id"], moves.select("src", "dst"))
    fresh = moved.groupBy("snapshot_id").agg(F.array_sort(F.collect_set("id")).alias("_new"))
    out = snapshots.join(fresh, "snapshot_id", "left")
    return out.withColumn("present_entity_ids", F.coalesce("_new", "present_entity_ids")).drop("_new")


def tombstone(entities: DataFrame, moves: DataFrame) -> DataFrame:
    """Merged entities say what they became."""
    out = entities.join(moves.select(F.col("src").alias("entity_id"), "dst"), "entity_id", "left")
    return out.withColumn("status", F.when(F.col("dst").isNotNull(), F.concat(F.lit("merged_into:"), "dst")).otherwise(F.col("status"))).drop("dst")


def merge(tables: dict[str, DataFrame], moves: DataFrame, keep_faces: int = 12) -> dict[str, DataFrame]:
    """The next version of the tables after merging every ``src`` into its ``dst``."""
    out = dict(tables)
    for name, columns in REFERENCES.items():
        if name in out:
            out[name] = repoint(out[name], columns, moves)
    if "scene_snapshots" in out:
        out["scene_snapshots"] = repoint_snapshots(out["scene_snapshots"], moves)
    if "entities" in out:
        out["entities"] = tombstone(out["entities"], moves)
    if "signatures" in out:
        w = Window.partitionBy("entity_id", "kind").orderBy(F.desc("created_at"), F.desc("sig_id"))
        ranked = out["signatures"].withColumn("_k", F.row_number().over(w))
        target = moves.select(F.col("dst").alias("entity_id"), F.lit(True).alias("_t")).distinct()
        ranked = ranked.join(target, "entity_id", "left")
        over = F.coalesce("_t", F.lit(False)) & (F.col("kind") == "face") & (F.col("_k") > keep_faces)
        out["signatures"] = ranked.where(~over).drop("_k", "_t")
    return out


def coalesce_edges(relations: DataFrame) -> DataFrame:
    """Edges that a merge made alike as one: weights add up to the cap, evidence is united."""
    key = ["kind", "subject_entity_id", "predicate", "object_entity_id", "location_id"]
    first = F.struct("created_at", "relation_id")
    return relations.groupBy(*key).agg(
        F.min_by("relation_id", first).alias("relation_id"),
        F.least(F.lit(1.0), F.sum("weight")).alias("weight"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("supporting_observation_ids")))).alias("supporting_observation_ids"),
        F.sum("n_evidence").alias("n_evidence"),
        F.max("last_reinforced_at").alias("last_reinforced_at"),
        F.min("created_at").alias("created_at"),
        F.max_by("status", "weight").alias("status"),
    )


def split(signatures: DataFrame, observations: DataFrame, entities: DataFrame, entity_id: str, new_id: str, sig_ids: list[str], observation_ids: list[str], now: float):
    """The three tables after carving the given signatures and observations into a new entity of the same type."""

    def move(df: DataFrame, key: str, ids: list[str], column: str) -> DataFrame:
        hit = F.col(key).isin(ids) if ids else F.lit(False)
        return df.withColumn(column, F.when(hit, F.lit(new_id)).otherwise(F.col(column)))

    born = entities.where(F.col("entity_id") == entity_id).limit(1).select(
        *(
            {"entity_id": F.lit(new_id), "label": F.lit(None).cast("string"), "created_at": F.lit(now), "status": F.lit("active")}
            .get(c, F.col(c))
            .alias(c)
            for c in entities.columns
        )
    )
    return (
        move(signatures, "sig_id", sig_ids, "entity_id"),
        move(observations, "observation_id", observation_ids, "subject_entity_id"),
        entities.unionByName(born),
    )


def _about(entity_id: str, columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).eqNullSafe(entity_id)
    return out


def cascade_delete(tables: dict[str, DataFrame], entity_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without an entity and everything derived from it, and (table, n) of what went.

    Vectors of both kinds go with the rows they describe.
    """
    out, counts = dict(tables), []
    gone = tables["observations"].where(_about(entity_id, REFERENCES["observations"])).select("observation_id").distinct()
    if "text_embeddings" in out:
        refs = gone.select(F.col("observation_id").alias("ref_id"))
        counts.append(out["text_embeddings"].join(refs, "ref_id", "left_semi").agg(F.lit("embeddings").alias("table"), F.count(F.lit(1)).alias("n")))
        out["text_embeddings"] = out["text_embeddings"].join(refs, "ref_id", "left_anti")
    for name, columns in REFERENCES.items():
        if name in out:
            about = _about(entity_id, columns)
            counts.append(out[name].agg(F.lit(name).alias("table"), F.count_if(about).alias("n")))
            out[name] = out[name].where(~about)
    if "scene_snapshots" in out:
        out["scene_snapshots"] = out["scene_snapshots"].withColumn(
            "present_entity_ids", F.array_remove("present_entity_ids", entity_id)
        )
    if "entities" in out:
        hit = F.col("entity_id") == entity_id
        out["entities"] = out["entities"].withColumns(
            {
                "status": F.when(hit, "deleted").otherwise(F.col("status")),
                "label": F.when(hit, F.lit(None)).otherwise(F.col("label")),
            }
        )
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return out, total


def least_labels(pairs: DataFrame, most: int = 60) -> DataFrame:
    """(id, root): the least id that each linked id reaches.

    Each round an id takes the least label of its neighbours' labels, passes it to the
    id that it was labelled with, and labels are followed one step, so long chains
    shrink by half.  Rounds end when no label changes; each is a table in the shared
    folder.  Null ids and links of an id to itself don't count.
    """
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x != y")
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    both, links = materialized(both, "merge-links")
    labels, path = materialized(both.groupBy(F.col("x").alias("id")).agg(F.least("id", F.min("y")).alias("root")), "merge-labels")
    before = None
    for _ in range(most):
        now = labels.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "root").cast("decimal(38,0)"))).first()
        if now == before:
            remove(pairs.sparkSession, links)
            return labels
        before = now
        followed = labels.join(labels.select(F.col("id").alias("root"), F.col("root").alias("g")), "root")
        heard = both.join(followed.select(F.col("id").alias("y"), "g"), "y").groupBy(F.col("x").alias("id")).agg(F.min("g").alias("heard"))
        told = followed.join(heard, "id").select(
            F.explode(F.array(F.struct("id", F.least("g", "heard").alias("root")), F.struct(F.col("root").alias("id"), F.col("heard").alias("root")))).alias("l")
        )
        fresh, new = materialized(told.groupBy("l.id").agg(F.min("l.root").alias("root")), "merge-labels")
        remove(pairs.sparkSession, path)
        labels, path = fresh, new
    raise RuntimeError("labels did not settle")


def told_moves(entities: DataFrame) -> DataFrame:
    """(src, dst) of the merges that the statuses tell: every id of a group moves to the group's least id.

    All rows of an id count; case and white space of a status don't matter; chains and
    circles are followed to their end, ids without a row are members too.
    """
    said = F.regexp_extract(F.lower("status"), r"^\s*merged_into:\s*(\S+)\s*$", 1)
    links = entities.select(F.lower("entity_id").alias("a"), said.alias("b")).where("a IS NOT NULL AND b != '' AND a != b")
    return least_labels(links).where("id != root").select(F.col("id").alias("src"), F.col("root").alias("dst"))


def merge_moves(pairs: DataFrame, entities: DataFrame, observations: DataFrame) -> DataFrame:
    """(src, dst) of an automatic merge: each group keeps its labelled, else its most observed member; ties go to the least id."""
    seen = observations.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    who = (
        least_labels(pairs)
        .select(F.col("id").alias("entity_id"), "root")
        .join(entities.select("entity_id", "label"), "entity_id", "left")
        .join(seen, "entity_id", "left")
    )
    rank = Window.partitionBy("root").orderBy(
        F.desc(F.coalesce(F.col("label") != "", F.lit(False))), F.desc(F.coalesce("n", F.lit(0))), "entity_id"
    )
    w = Window.partitionBy("root")
    ranked = who.withColumn("k", F.row_number().over(rank))
    ranked = ranked.withColumn("dst", F.max(F.when(F.col("k") == 1, F.col("entity_id"))).over(w))
    return ranked.where("k > 1").select(F.col("entity_id").alias("src"), "dst")
