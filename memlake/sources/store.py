"""Writable tables as versions of Parquet folders with one writer a table.

``root/<table>/v<N>`` holds a version and an empty file ``root/<table>/_versions/<N>``
says that it is whole; the highest so marked is in force.  Appends add files to the
version in force; upserts, updates and deletes write the next version beside it and
then add its mark, which is one atomic step: a reader finds the old version or the new
one.  Old versions stay until ``vacuum``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.columns import event_time, title_from_question
from memlake.schema import DDL, schema

#: Tables cut by day, so that a time window reads only its days.
BY_DAY = ("observations", "scene_descriptions", "scene_snapshots")
KEYS = {
    "entities": ["entity_id"],
    "signatures": ["sig_id"],
    "locations": ["location_id"],
    "observations": ["observation_id"],
    "scene_descriptions": ["description_id"],
    "scene_snapshots": ["snapshot_id"],
    "relations": ["relation_id"],
    "predicate_schema": ["predicate", "subject_type", "object_type"],
    "text_embeddings": ["kind", "ref_id", "model"],
    "conversations": ["conversation_id"],
    "chat_turns": ["turn_id"],
    "cases": ["case_id"],
    "case_items": ["case_id", "kind", "ref_id"],
    "reports": ["report_id"],
}
# Fixed values that a column may take; writes of others are refused.
ALLOWED = {
    ("entities", "type"): ("person", "object"),
    ("relations", "kind"): ("relation", "habit", "event"),
    ("relations", "status"): ("candidate", "confirmed", "suppressed"),
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- files ---------------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def version(self, table: str) -> int:
        fs, path = self._fs(f"{self.root}/{table}/_versions")
        return max((int(s.getPath().getName()) for s in fs.listStatus(path)), default=0) if fs.exists(path) else 0

    def _switch(self, table: str, version: int) -> None:
        fs, path = self._fs(f"{self.root}/{table}/_versions/{version}")
        fs.create(path, False).close()

    def path(self, table: str, version: int | None = None) -> str:
        return f"{self.root}/{table}/v{self.version(table) if version is None else version}"

    # --- reading -------------------------------------------------------------
    def read(self, table: str) -> DataFrame:
        """The version in force; columns that an older version lacks are null."""
        fs, path = self._fs(self.path(table))
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema(table))
        found = self.spark.read.option("mergeSchema", "true").parquet(self.path(table))
        have = set(found.columns)
        return found.select(
            *(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(table).fields),
            *([F.col("event_date")] if "event_date" in have else []),
        )

    # --- writing -------------------------------------------------------------
    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        """Canonical columns; alerts start as new; values outside the fixed ones fail the write."""
        have = set(rows.columns)
        cols = {
            f.name: F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
            for f in schema(table).fields
        }
        for (t, c), values in ALLOWED.items():
            if t == table:
                bad = F.raise_error(F.concat(F.lit(f"{table}.{c}: "), F.coalesce(cols[c], F.lit("null"))))
                cols[c] = F.when(cols[c].isin(*values), cols[c]).otherwise(bad.cast("string"))
        if table == "observations":
            cols["status"] = F.coalesce(cols["status"], F.when(cols["origin"] == "rule", F.lit("new")))
        return rows.select(*(c.alias(n) for n, c in cols.items()))

    def _write(self, table: str, rows: DataFrame, version: int, mode: str) -> None:
        if table in BY_DAY:
            # a day's rows go to files of even size, as many as the day needs
            rows = rows.withColumn("event_date", F.to_date(event_time(F.col("ts")))).hint("rebalance", F.col("event_date"))
            rows.write.mode(mode).partitionBy("event_date").parquet(self.path(table, version))
        else:
            rows.write.mode(mode).parquet(self.path(table, version))

    def append(self, table: str, rows: DataFrame) -> None:
        if table not in DDL:
            raise KeyError(table)
        version = self.version(table)
        self._write(table, self._shaped(table, rows), version, "append")
        fs, mark = self._fs(f"{self.root}/{table}/_versions/{version}")
        if not fs.exists(mark):
            self._switch(table, version)

    def replace(self, table: str, rows: DataFrame) -> int:
        """The next version; the one before stays until ``vacuum``."""
        version = self.version(table) + 1
        self._write(table, self._shaped(table, rows), version, "overwrite")
        self._switch(table, version)
        return version

    def upsert(self, table: str, rows: DataFrame, newest: str | None = None) -> int:
        """Rows with a known key replace it; of several with one key the newest counts."""
        keys = KEYS[table]
        w = Window.partitionBy(*keys).orderBy(F.desc(newest) if newest else F.monotonically_increasing_id().desc())
        fresh = self._shaped(table, rows).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
        kept = self._shaped(table, self.read(table)).join(fresh.select(*keys), keys, "left_anti")
        return self.replace(table, kept.unionByName(fresh))

    def attach(self, table: str, rows: DataFrame) -> None:
        """Append what isn't there yet; a known key is left as it is."""
        keys = KEYS[table]
        fresh = self._shaped(table, rows).dropDuplicates(keys).join(self.read(table).select(*keys), keys, "left_anti")
        self.append(table, fresh)

    def update(self, table: str, where: Column, **values: Column) -> int:
        """Columns of the rows that match, changed; others as they are."""
        rows = self.read(table)
        return self.replace(table, rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, table: str, where: Column) -> int:
        return self.replace(table, self.read(table).where(~F.coalesce(where, F.lit(False))))

    def append_turn(self, turn: DataFrame) -> None:
        """One turn of a thread: it is stored, the thread is brought up to date and named after its first question."""
        self.attach("chat_turns", turn)
        said = turn.select("conversation_id", F.col("asked_at").alias("_at"), title_from_question(F.col("question")).alias("_title"))
        threads = self.read("conversations").join(said, "conversation_id")
        self.upsert(
            "conversations",
            threads.withColumns({"updated_at": F.greatest("updated_at", "_at"), "title": F.coalesce(F.nullif("title", F.lit("")), "_title")}),
            newest="updated_at",
        )

    def delete_conversation(self, conversation_id: str) -> None:
        """A thread goes with its turns."""
        for table in ("chat_turns", "conversations"):
            self.delete(table, F.col("conversation_id") == conversation_id)

    def rewrite(self, table: str, change: Callable[[DataFrame], DataFrame]) -> int:
        return self.replace(table, change(self.read(table)))

    def export(self, folder: str) -> None:
        """A copy of every table in force."""
        for table in DDL:
            fs, path = self._fs(self.path(table))
            if fs.exists(path):
                self.read(table).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")

    def vacuum(self, table: str) -> None:
        """Drop the versions that are no longer in force, so that deleted rows are gone from disk."""
        now = self.version(table)
        fs, base = self._fs(f"{self.root}/{table}")
        for s in fs.listStatus(base):
            name = s.getPath().getName()
            if name.startswith("v") and name != f"v{now}":
                fs.delete(s.getPath(), True)
        for v in range(now):
            fs.delete(self._fs(f"{self.root}/{table}/_versions/{v}")[1], False)
