"""The llm queries over the whole tables, with the SQL they equal where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import ann, bpe, leaks, toxicity
from memlake.llm.components import merge_groups
from memlake.llm.ngrams import ngram_counts, term_records, with_mark
from memlake.llm.runs import collapse_runs
from memlake.scratch import materialize
from memlake.sources.tables import load


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = collapse_runs(load(spark, folder, "observations"))
    return runs.where("n_events >= 2").select("subject_entity_id", "first_observation_id", "last_observation_id")


def p1_runs(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_runs(load(spark, folder, "observations"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return ann.similar_pairs(load(spark, folder, "signatures"))


def p2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest of every signature whose id hash is divisible by 20, asked against all rows, without a floor."""
    asked = F.pmod(F.conv(F.substring("sig_id", 5, 8), 16, 10).cast("bigint"), F.lit(20)) == 0
    return ann.nearest_of(load(spark, folder, "signatures"), asked)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return merge_groups(load(spark, folder, "entities"))


def _p7(spark: SparkSession, folder: str) -> DataFrame:
    records = materialize(term_records(load(spark, folder, "observations")), "terms")  # read twice below
    return with_mark(ngram_counts(records), records)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p7(spark, folder).where("n = 1 AND mark IS NOT NULL").select(F.col("ngram").alias("term"), "mark")


def p7_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _p7(spark, folder).where("n = 1").select(F.col("ngram").alias("term"), "occurrences", "records", "mark")


def p7_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return _p7(spark, folder)


def p7_values(spark: SparkSession, folder: str) -> DataFrame:
    records = term_records(load(spark, folder, "observations"))
    counts = records.select("value", F.col("w").alias("occurrences"), F.col("w").alias("records"))
    return with_mark(counts, records)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(load(spark, folder, "documents"))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's ids decoded again: whether the text comes back, byte for byte."""
    documents = load(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("before"))
    ids = bpe.encode(documents.withColumnRenamed("before", "text"))
    back = bpe.decode(ids).select("doc_id", F.xxhash64("text").alias("after"))
    return documents.join(back, "doc_id").select("doc_id", (F.xxhash64("before") == F.col("after")).alias("same"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.find_leaks(load(spark, folder, "documents"), load(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id")


def p9_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which test items leaked, into how many documents."""
    found = leaks.find_leaks(load(spark, folder, "documents"), load(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("words").alias("longest"))


def p9_scrubbed(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.scrub(load(spark, folder, "documents"), load(spark, folder, "eval_items"))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(load(spark, folder, "documents"), load(spark, folder, "doc_labels"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_scores(spark, folder).where("score >= 0.5").select("doc_id").distinct()


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rates(p10_scores(spark, folder))


def p10_held_out(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall on the labels that fitting never sees."""
    return toxicity.held_out_accuracy(p10_scores(spark, folder), load(spark, folder, "doc_labels"))


QUERIES = {
    "p1_found": p1_found,
    "p1_runs": p1_runs,
    "p2_found": p2_found,
    "p2_nearest": p2_nearest,
    "p4_found": p4_found,
    "p7_found": p7_found,
    "p7_terms": p7_terms,
    "p7_ngrams": p7_ngrams,
    "p7_values": p7_values,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_found": p9_found,
    "p9_leaked_items": p9_leaked_items,
    "p9_scrubbed": p9_scrubbed,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
    "p10_held_out": p10_held_out,
}

_ONCE = "o AS (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY received_at) = 1)"

_RUNS = f"""
WITH {_ONCE},
k AS (SELECT *, regexp_replace(lower(predicate), '\\P{{{{L}}}}+', '', 'g') AS k FROM o
      WHERE subject_entity_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 120 AND k = lag(k) OVER w THEN 0 ELSE 1 END AS brk
      FROM k WHERE k <> '' WINDOW w AS (PARTITION BY subject_entity_id ORDER BY ts, seq, observation_id)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY subject_entity_id ORDER BY ts, seq, observation_id
      ROWS UNBOUNDED PRECEDING) AS isl FROM s)
SELECT subject_entity_id, arg_min(observation_id, (ts, seq, observation_id)) AS first_observation_id,
       arg_max(observation_id, (ts, seq, observation_id)) AS last_observation_id{{more}}
FROM i GROUP BY subject_entity_id, isl {{having}}"""

_TERMS = f"""
WITH {_ONCE},
r AS (SELECT observation_id, regexp_extract_all(lower(predicate), '[\\p{{{{L}}}}\\p{{{{N}}}}]+') AS t FROM o
      WHERE predicate IS NOT NULL),
x AS (SELECT observation_id, unnest(t) AS term FROM r),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT observation_id) AS records FROM x GROUP BY term),
m AS (SELECT *, CASE WHEN records < 5 THEN 'rare'
                     WHEN records > 0.1 * (SELECT count(*) FROM r WHERE len(t) > 0) THEN 'common' END AS mark FROM c)
SELECT {{what}} FROM m {{where}}"""

_VECTORS = """
WITH u AS (SELECT sig_id, kind, dim, CAST(any_value(vec) AS DOUBLE[]) AS v FROM signatures
           WHERE len(vec) = dim AND dim > 0 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY 1, 2, 3),
p AS (SELECT a.sig_id AS a, b.sig_id AS b, list_cosine_similarity(a.v, b.v) AS s
      FROM u a JOIN u b ON a.kind = b.kind AND a.dim = b.dim AND a.sig_id <> b.sig_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM p WHERE s >= 0.8)
"""

#: The words of a text.  Of the compatibility forms DuckDB can only be told the full-width ones, so documents with others may differ.
_PLAIN = """regexp_extract_all(lower(translate(regexp_replace(text, '[\\x{00AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]', '', 'g'),
  (SELECT string_agg(chr(CAST(65248 + i AS INT)), '' ORDER BY i) FROM range(33, 127) t(i)), (SELECT string_agg(chr(CAST(i AS INT)), '' ORDER BY i) FROM range(33, 127) t(i)))),
  '[\\p{L}\\p{N}]+')"""
_LEAKS = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_PLAIN} AS w FROM eval_items WHERE text IS NOT NULL),
iw AS (SELECT item_id, w, least(12, len(w)) AS n FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM iw)),
sizes AS (SELECT DISTINCT n FROM iw),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, CAST(len(w) AS BIGINT) - n + 2)) AS k FROM d CROSS JOIN sizes WHERE len(w) >= n)),
f AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g))
"""

ORACLE = {
    "p1_found": _RUNS.format(more="", having="HAVING count(*) >= 2"),
    "p1_runs": _RUNS.format(
        more=(
            ", any_value(k) AS predicate_letters, min(ts) AS start_ts, max(ts) AS end_ts,"
            " max(ts) - min(ts) AS duration_s, count(*) AS n_events"
        ),
        having="",
    ),
    "p4_found": """
WITH RECURSIVE e AS (SELECT lower(entity_id) AS a,
                            regexp_extract(lower(status), '^\\s*merged_into:\\s*(\\S+)\\s*$', 1) AS b FROM entities),
b AS (SELECT a AS u, b AS v FROM e WHERE b <> '' AND a <> b UNION SELECT b, a FROM e WHERE b <> '' AND a <> b),
r AS (SELECT u AS id, u AS g FROM b UNION SELECT b.u, r.g FROM r JOIN b ON b.v = r.id)
SELECT id AS entity_id, min(g) AS group_id FROM r GROUP BY id""",
    "p7_found": _TERMS.format(what="term, mark", where="WHERE mark IS NOT NULL"),
    "p2_found": _VECTORS + "SELECT DISTINCT least(a, b) AS sig_id_a, greatest(a, b) AS sig_id_b FROM r WHERE k <= 10",
    "p7_ngrams": f"""
WITH {_ONCE},
v AS (SELECT predicate, regexp_extract_all(lower(predicate), '[\\p{{L}}\\p{{N}}]+') AS t, count(*) AS w FROM o
      WHERE predicate IS NOT NULL GROUP BY predicate),
i AS (SELECT *, unnest(range(1, CAST(len(t) AS BIGINT) + 1)) AS i FROM v),
g AS (SELECT *, unnest(range(1, CAST(len(t) AS BIGINT) - i + 2)) AS n FROM i),
c AS (SELECT predicate, w, n, array_to_string(t[i:i + n - 1], ' ') AS ngram, count(*) AS c FROM g GROUP BY 1, 2, 3, 4),
m AS (SELECT ngram, CAST(n AS INT) AS n, CAST(sum(c * w) AS BIGINT) AS occurrences, CAST(sum(w) AS BIGINT) AS records FROM c GROUP BY 1, 2)
SELECT *, CASE WHEN records < 5 THEN 'rare'
               WHEN records > 0.1 * (SELECT sum(w) FROM v WHERE len(t) > 0) THEN 'common' END AS mark FROM m""",
    "p9_found": _LEAKS + "SELECT doc_id, item_id FROM f",
    "p9_leaked_items": _LEAKS
    + """,
x AS (SELECT doc_id, item_id, unnest(d.w) AS word, unnest(range(len(d.w))) AS p FROM f JOIN d USING (doc_id)),
y AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS q FROM iw),
z AS (SELECT DISTINCT doc_id, item_id, p, p - q AS diagonal FROM x JOIN y USING (item_id, word)),
s AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS island FROM z),
l AS (SELECT doc_id, item_id, diagonal, island, count(*) AS n FROM s GROUP BY 1, 2, 3, 4)
SELECT item_id, count(DISTINCT doc_id) AS n_documents, CAST(max(n) AS INT) AS longest FROM l GROUP BY 1""",
    "p7_terms": _TERMS.format(what="term, occurrences, records, mark", where=""),
    "p7_values": f"""
WITH {_ONCE},
c AS (SELECT predicate AS value, count(*) AS records FROM o WHERE predicate IS NOT NULL GROUP BY 1)
SELECT value, records AS occurrences, records,
       CASE WHEN records < 5 THEN 'rare'
            WHEN records > 0.1 * (SELECT sum(records) FROM c WHERE regexp_matches(value, '[\\p{{L}}\\p{{N}}]')) THEN 'common' END AS mark
FROM c""",
}
