"""Search by meaning over stored vectors; encoders are plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.columns import dot, literal_vector, unit

FLOOR, SHORTLIST = 0.30, 200

Encoder = Callable[[Sequence[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic encoder of word hashes, for tests and as a stand-in."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        return out

    return encode


def query_vector(encoder: Encoder, text: str) -> list[float]:
    """The unit vector of a question."""
    v = np.asarray(encoder([text])[0], np.float64)
    size = float(np.linalg.norm(v))
    return (v / size if size else v).tolist()


def cached(encoder: Encoder, size: int = 256) -> Callable[[str], tuple[float, ...]]:
    """Remembers the last questions' vectors; a new encoder needs a new cache."""
    return lru_cache(maxsize=size)(lambda text: tuple(query_vector(encoder, text)))


def encode_texts(texts: DataFrame, encoder: Encoder, kind: str, model: str, now: float, key: str = "ref_id", text: str = "text") -> DataFrame:
    """Embedding rows of texts, a batch at a time; null and blank texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = np.asarray(encoder(b.column("text").to_pylist()), np.float64).reshape(b.num_rows, -1)
            size = np.linalg.norm(vecs, axis=1, keepdims=True)
            vecs = np.divide(vecs, size, out=vecs, where=size > 0).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [b.column("ref_id"), pa.array(list(vecs), pa.list_(pa.float32()))], ["ref_id", "vec"]
            )

    rows = texts.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    found = rows.select(F.col(key).alias("ref_id"), F.col(text).alias("text")).mapInArrow(run, "ref_id string, vec array<float>")
    return found.select(
        F.lit(kind).alias("kind"), "ref_id", F.lit(model).alias("model"), F.size("vec").alias("dim"), "vec",
        F.lit(now).alias("created_at"),
    )


def backlog(rows: DataFrame, embeddings: DataFrame, kind: str, model: str, key: str, limit: int | None = None) -> DataFrame:
    """Rows without a vector of this kind and model, newest first."""
    have = embeddings.where((F.col("kind") == kind) & (F.col("model") == model)).select(F.col("ref_id").alias(key))
    left = rows.join(have, key, "left_anti").orderBy(F.desc("ts"), F.desc(key))
    return left if limit is None else left.limit(limit)


def backfill_frames(frames: DataFrame, encoder: Encoder, model: str, now: float, key: str = "observation_id", file: str = "source_ref") -> DataFrame:
    """Vectors of pictures: each file is encoded once and fanned out to the rows that cite it."""
    files = frames.where(F.col(file).isNotNull()).select(F.col(file).alias("ref_id")).distinct()
    once = encode_texts(files, encoder, "keyframe", model, now, text="ref_id")
    return (
        frames.select(key, F.col(file).alias("ref_id"))
        .join(once, "ref_id")
        .select("kind", F.col(key).alias("ref_id"), "model", "dim", "vec", "created_at")
    )


def cosine_topk(embeddings: DataFrame, query: Sequence[float], k: int = SHORTLIST, floor: float = FLOOR, key: str = "ref_id") -> DataFrame:
    """(key, score): the ``k`` vectors nearest to the query and at least ``floor`` alike; ties by key.

    Vectors of another length than the query's are of another model and don't match.
    """
    score = dot(unit(F.col("vec")), literal_vector(query))
    near = embeddings.where(F.size("vec") == len(query)).select(key, score.alias("score")).where(F.col("score") >= floor)
    return near.orderBy(F.desc("score"), key).limit(k)


def search(observations: DataFrame, embeddings: DataFrame, query: Sequence[float], hard=None, model: str | None = None, k: int = SHORTLIST, floor: float = FLOOR) -> DataFrame:
    """(observation_id, score): hard filters narrow the rows before the cut to ``k``."""
    rows = embeddings.where(F.col("kind") == "observation")
    rows = rows if model is None else rows.where(F.col("model") == model)
    rows = rows.withColumnRenamed("ref_id", "observation_id")
    if hard is not None:
        rows = rows.join(observations.where(hard).select("observation_id"), "observation_id", "left_semi")
    return cosine_topk(rows, query, k, floor, "observation_id")


def embedded_count(embeddings: DataFrame, kind: str, model: str) -> DataFrame:
    return embeddings.where((F.col("kind") == kind) & (F.col("model") == model)).agg(F.count(F.lit(1)).alias("n"))
