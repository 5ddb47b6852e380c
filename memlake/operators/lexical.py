"""Full-text search: postings with positions, BM25 and phrases.

The index is two derived tables: postings (term, doc_id, tf, positions, dl) and the
documents it holds with their lengths.  Stored (``Postings``), the former lies in
folders by hash of the term, so that a query reads its terms' folders only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.porter import stem

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
# Words that a query leaves out unless nothing else remains.
STOPWORDS = frozenset(
    "a an and the of to in on at is was were are be been it its with for by any anyone anything there that this".split()
)
_TOKEN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def tokens(text: str, stemmed: bool = True) -> list[str]:
    found = _TOKEN.findall(fold(text))
    return [stem(w) for w in found] if stemmed else found


def parse_query(text: str, stemmed: bool = True) -> list[list[str]]:
    """The phrases that must all occur: each word of the query, split where it has an underscore.

    Stop words are left out unless nothing remains.
    """
    said = [w.lower() for w in re.findall(r"\w+", text or "")]
    kept = [w for w in said if w not in STOPWORDS] or said
    return [p for p in (tokens(w, stemmed) for w in kept) if p]


def build_postings(docs: DataFrame, key: str, text: str = "text", stemmed: bool = True) -> DataFrame:
    """(term, doc_id, tf, positions, dl) of every text; null texts have no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, said in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                words = tokens(said or "", stemmed)
                at: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    at.setdefault(w, []).append(i)
                for w, places in at.items():
                    for c, v in zip(cols, (w, doc, len(places), places, len(words))):
                        c.append(v)
            types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], ["term", "doc_id", "tf", "positions", "dl"]
            )

    return docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "term string, doc_id string, tf int, positions array<int>, dl int"
    )


class Postings:
    """A stored index: ``append`` adds documents that it doesn't hold yet, ``rows`` reads those of some terms."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, stemmed: bool = True):
        self.spark, self.path, self.buckets, self.stemmed = spark, path.rstrip("/"), buckets, stemmed

    def _table(self, name: str, form: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], form)
        return self.spark.read.schema(form).parquet(f"{self.path}/{name}")

    def documents(self) -> DataFrame:
        """(doc_id, dl) of every document held, those without text too."""
        return self._table("documents", "doc_id string, dl int")

    def append(self, docs: DataFrame, key: str, text: str = "text") -> None:
        """Add the documents of which the index has none; a document is never changed in place.

        Postings are written before the list of documents: what a failed append leaves
        behind is made harmless as only listed documents count.
        """
        rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
        rows = rows.dropDuplicates(["doc_id"]).join(self.documents().select("doc_id"), "doc_id", "left_anti")
        found = build_postings(rows, "doc_id", stemmed=self.stemmed)
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        found = found.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term")
        found.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        held = self._postings().groupBy("doc_id").agg(F.max("dl").alias("dl"))
        rows.select("doc_id").join(held, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl")).write.mode("append").parquet(f"{self.path}/documents")

    def _postings(self) -> DataFrame:
        return self._table("postings", "term string, doc_id string, tf int, positions array<int>, dl int, bucket int")

    def rows(self, terms: list[str]) -> DataFrame:
        """The postings of the terms; a redelivered one counts once."""
        if not terms:
            return self._postings().limit(0).drop("bucket")
        own = self.spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        buckets = [r[0] for r in own.distinct().collect()]
        found = self._postings().where(F.col("bucket").isin(buckets) & F.col("term").isin(sorted(set(terms))))
        return found.drop("bucket").dropDuplicates(["term", "doc_id"]).join(self.documents().select("doc_id"), "doc_id", "left_semi")

    def stats(self) -> DataFrame:
        """One row (n_docs, n_tokens)."""
        return self.documents().agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))


def corpus_stats(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row (n_docs, n_tokens): documents count whether or not they have text."""
    tokens_ = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n")).scalar()
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).withColumn("n_tokens", tokens_)


def bm25(postings: DataFrame, stats: DataFrame, query: str, stemmed: bool = True) -> DataFrame:
    """(doc_id, score) of the documents that hold every phrase of the query; a query without words finds nothing."""
    phrases = parse_query(query, stemmed)
    if not phrases:
        return postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    parts = []
    for i, phrase in enumerate(phrases):
        if len(phrase) == 1:
            part = postings.where(F.col("term") == phrase[0]).select("doc_id", "tf", "dl")
        else:
            steps = F.array(*(F.lit(w) for w in phrase))
            starts = F.transform("positions", lambda p: p - F.array_position(steps, F.col("term")).cast("int") + 1)
            held = postings.where(F.col("term").isin(phrase)).select("doc_id", "dl", "term", F.explode(starts).alias("start"))
            whole = held.groupBy("doc_id", "dl", "start").agg(F.count_distinct("term").alias("k"))
            part = whole.where(F.col("k") == len(set(phrase))).groupBy("doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
            part = part.select("doc_id", "tf", "dl")
        parts.append(part.withColumn("phrase", F.lit(i)))
    matched = parts[0]
    for p in parts[1:]:
        matched = matched.unionByName(p)
    frequency = matched.groupBy("phrase").agg(F.count(F.lit(1)).cast("double").alias("df"))
    n, total = stats.select("n_docs").scalar(), stats.select("n_tokens").scalar()
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    length = F.col("dl") / (total / n)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    return (
        matched.join(F.broadcast(frequency), "phrase")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("k"), F.sum(weight).alias("score"))
        .where(F.col("k") == len(phrases))
        .select("doc_id", "score")
    )


def search(docs: DataFrame, key: str, query: str, hard=None, limit: int | None = 500, stemmed: bool = True, postings: DataFrame | Postings | None = None) -> DataFrame:
    """(key, score): the best documents among those that pass the hard filters, which come before the cut; all of them if ``limit`` is None."""
    if isinstance(postings, Postings):
        stats, postings = postings.stats(), postings.rows([t for p in parse_query(query, postings.stemmed) for t in p])
    else:
        postings = build_postings(docs, key, stemmed=stemmed) if postings is None else postings
        stats = corpus_stats(docs, postings)
    scored = bm25(postings, stats, query, stemmed).withColumnRenamed("doc_id", key)
    if hard is not None:
        scored = scored.join(docs.where(hard).select(key), key, "left_semi")
    return scored if limit is None else scored.orderBy(F.desc("score"), key).limit(limit)


def stem_column(words: pd.Series) -> pd.Series:
    """For a pandas UDF over distinct terms."""
    return words.map(stem, na_action="ignore")
