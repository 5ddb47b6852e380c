"""Word questions: lexical and semantic search under a plan's filters, fused, re-ranked, and asked through the ladder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import lexical, ranking, semantic
from memlake.plans import ladder
from memlake.plans.answer import Answer, answer, restrict_subjects
from memlake.plans.filters import Filters
from memlake.plans.query_plan import QueryPlan
from memlake.sources.memory import Memory


@dataclass
class SearchIndex:
    """What a word question is asked of; parts that are missing find nothing.

    ``postings`` with ``stats`` is a stored full-text index, without it one is built for
    the question; ``embeddings`` are text vectors (kind ``observation``) and picture
    vectors (kind ``keyframe``) by observation, each with the encoder of its model.
    """

    postings: lexical.Postings | None = None
    embeddings: DataFrame | None = None
    encoder: semantic.Encoder | None = None
    model: str | None = None
    picture_encoder: semantic.Encoder | None = None
    picture_model: str | None = None
    stemmed: bool = True


def retrieve(mem: Memory, plan: QueryPlan, index: SearchIndex, meaning_only: bool = False) -> DataFrame:
    """(observation_id, score, reason, reranked): the fused ranks of the rows that pass the plan's filters.

    ``text`` is asked of both searches, ``predicate_contains`` of the lexical one alone;
    ``meaning_only`` leaves the lexical search out.  Filters come before each shortlist
    is cut.  Pictures reorder what was found, they never add to it.
    """
    filters = Filters(since=plan.start, until=plan.end, location_ids=mem.zone_ids(plan.zones), camera_ids=plan.cameras or None)
    rows = mem.scan()
    kept = restrict_subjects(mem, plan, rows.where(filters.hard()))
    lists = {}
    words = plan.text or plan.predicate_contains
    if words and not meaning_only:
        found = lexical.search(rows, "observation_id", words, limit=None, stemmed=index.stemmed, postings=index.postings)
        found = found.join(kept.select("observation_id"), "observation_id", "left_semi")
        lists["lexical"] = ranking.ranked(found.orderBy(F.desc("score"), "observation_id").limit(500))
    if plan.text and index.embeddings is not None and index.encoder is not None:
        query = semantic.query_vector(index.encoder, plan.text)
        near = index.embeddings.join(kept.select(F.col("observation_id").alias("ref_id")), "ref_id", "left_semi")
        lists["semantic"] = ranking.ranked(semantic.search(rows, near, query, model=index.model))
    if not lists:
        form = "observation_id string, score double, reason string, reranked boolean"
        return mem.spark.createDataFrame([], form)
    fused = ranking.fuse(**lists)
    if plan.text and index.embeddings is not None and index.picture_encoder is not None:
        pictures = index.embeddings.where(F.col("kind") == "keyframe")
        pictures = pictures if index.picture_model is None else pictures.where(F.col("model") == index.picture_model)
        pictures = pictures.withColumnRenamed("ref_id", "observation_id")
        seen = semantic.cosine_topk(
            pictures.join(fused.select("observation_id"), "observation_id", "left_semi"),
            semantic.query_vector(index.picture_encoder, plan.text), k=1_000, floor=-1.0, key="observation_id",
        )
        return ranking.rerank(fused, seen.withColumnRenamed("score", "similarity"))
    return fused.withColumn("reranked", F.lit(False))


def trace(found: DataFrame, index: SearchIndex) -> DataFrame:
    """One row telling what was consulted: rows by reason, rows re-ranked, and how many vectors the index holds."""
    told = found.agg(
        F.count_if(F.col("reason").isin("lexical", "both")).alias("lexical"), F.count_if(F.col("reason").isin("semantic", "both")).alias("semantic"),
        F.count(F.lit(1)).alias("fused"), F.count_if("reranked").alias("reranked"),
    )
    for name, kind, model in (("semantic_index", "observation", index.model), ("visual_index", "keyframe", index.picture_model)):
        if index.embeddings is None or model is None:
            told = told.withColumn(name, F.lit(0).cast("bigint"))
        else:
            told = told.withColumn(name, semantic.embedded_count(index.embeddings, kind, model).scalar())
    return told


def ask(mem: Memory, plan: QueryPlan, index: SearchIndex, relations: DataFrame | None = None, habits: DataFrame | None = None) -> Answer:
    """The answer to any plan, loosened step by step if nothing is found."""

    def run(one: QueryPlan, meaning_only: bool) -> Answer:
        scores = retrieve(mem, one, index, meaning_only) if one.text or one.predicate_contains else None
        return answer(mem, one, scores=scores, relations=relations, habits=habits)

    return ladder.execute(mem, plan, run)
