"""Scans of bureaus' lists as a stream: failures with one retry a run, what stays open, what is drained into notices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.urls import canonical_url
from ..operators import reextract
from .buckets import Buckets, folder_of

OUTCOME = "bureau string, run long, id long, at string, action string, retry_count long, last_success string, open boolean"
_STATE = "run long, tries long, failures long, last_success string, open boolean"


class Outcomes(StatefulProcessor):
    """Per bureau what each outcome of a scan leads to: ok, recovered, retry (the run's first failure) or failed (a later one).

    The state is five values a bureau, kept in the checkpoint. Success alone moves last_success; failures are counted and leave it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("scan", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, tries, failures, success, open_ = self.state.get() if self.state.exists() else (None, 0, 0, None, False)
        out = []
        for r in pd.concat(list(rows), ignore_index=True).sort_values(["at", "id"], kind="stable").itertuples(index=False):
            tries = tries if r.run == run else 0
            run = int(r.run)
            if r.ok:
                action, success, open_ = ("recovered" if open_ else "ok"), r.at, False
            else:
                tries, failures, open_ = tries + 1, failures + 1, True
                action = "retry" if tries == 1 else "failed"
            out.append((key[0], run, int(r.id), r.at, action, max(0, failures - 1), success, open_))
        self.state.update((run, tries, failures, success, open_))
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in OUTCOME.split(", ")])

    def close(self) -> None:
        pass


def outcomes(scans: DataFrame) -> DataFrame:
    """OUTCOME of a stream of scans: bureau, run, id, at (ISO text), ok. A bureau's scans come in the order of at and id.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return scans.groupBy("bureau").transformWithStateInPandas(Outcomes(), OUTCOME, "append", "none")


def outcomes_of_table(scans: DataFrame) -> DataFrame:
    """The same of a table, by windows."""
    order = Window.partitionBy("bureau").orderBy("at", "id")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = Window.partitionBy("bureau", "run").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fails = (~F.col("ok")).cast("long")
    rows = scans.withColumns({"_open": F.coalesce(F.last(~F.col("ok")).over(before), F.lit(False)), "_try": F.sum(fails).over(run), "_failures": F.sum(fails).over(upto), "last_success": F.last(F.when(F.col("ok"), F.col("at")), ignorenulls=True).over(upto)})
    action = F.when(F.col("ok"), F.when(F.col("_open"), "recovered").otherwise("ok")).when(F.col("_try") == 1, "retry").otherwise("failed")
    return rows.select("bureau", "run", "id", "at", action.alias("action"), F.greatest(F.col("_failures") - 1, F.lit(0)).alias("retry_count"), "last_success", (~F.col("ok")).alias("open"))


def open_failures(told: DataFrame) -> DataFrame:
    """Of outcomes the bureaus whose last one is a failure, with what is known of it."""
    last = told.groupBy("bureau").agg(F.max_by(F.struct("at", "run", "action", "retry_count", "last_success", "open"), F.struct("at", "id")).alias("x"))
    return last.select("bureau", "x.*").where("open").drop("open")


# ---------------------------------------------------------------- waiting updates into notices
def ready(waiting: DataFrame, pages: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of waiting updates (bureau, url, title, day) those whose page (url, text) has landed, as notices, and those that wait on.

    An address is taken once, however it is written; what is known already (key) neither becomes a notice nor waits.
    """
    rows = waiting.withColumn("key", canonical_url(F.col("url"))).groupBy("key").agg(F.min_by(F.struct("bureau", "url", "title", "day"), F.struct("bureau", "url")).alias("u")).select("key", "u.*")
    rows = rows.join(known.select("key").distinct(), "key", "left_anti")
    texts = pages.select(canonical_url(F.col("url")).alias("key"), "text").groupBy("key").agg(F.max_by("text", F.length(F.coalesce("text", F.lit("")))).alias("text"), F.lit(True).alias("landed"))
    joined = rows.join(texts, "key", "left")
    return joined.where("landed").select("key", "bureau", "url", "title", "day", "text"), joined.where("landed IS NULL").select("bureau", "url", "title", "day")


def drain(spark: SparkSession, updates: DataFrame, pages, folder: str, checkpoint: str):
    """Drains a stream of updates (bureau, url, title, day) into ``folder/notices``: a batch's notices, then its marks, then what waits on.

    pages: a function that gives the landed pages (url, text). A batch's notices count once its marks are written; a batch
    that runs again begins at the marks and the queue of the one before, so it writes the same notices, not more. Returns the running query.
    """

    def write(batch: DataFrame, number: int) -> None:
        shape = batch.select("bureau", "url", "title", "day").schema
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}") if _there(spark, f"{folder}/{name}") else spark.createDataFrame([], schema)
        queue = read(f"queue/v={number}", shape).unionByName(batch.select(*shape.names))
        marks = [p for p in _folders(spark, f"{folder}/marks/batch=*") if int(p.rsplit("=", 1)[1]) < number]
        known = spark.read.parquet(*marks).select("key") if marks else spark.createDataFrame([], "key string")
        notices, waits = ready(queue, pages(), known)
        notices.write.mode("overwrite").parquet(f"{folder}/notices/batch={number}")
        written = spark.read.schema(notices.schema).parquet(f"{folder}/notices/batch={number}")
        # Pages may land meanwhile: what waits on is what was not written.
        waits = queue.withColumn("key", canonical_url(F.col("url"))).join(written.select("key").union(known), "key", "left_anti").select(*shape.names).dropDuplicates()
        waits.write.mode("overwrite").parquet(f"{folder}/queue/v={number + 1}")
        written.select("key").write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(spark: SparkSession, folder: str, schema: str = "key string, bureau string, url string, title string, day string, text string") -> DataFrame:
    """The notices of batches that have their marks."""
    done = [p.rsplit("=", 1)[1] for p in _folders(spark, f"{folder}/marks/batch=*")]
    return spark.read.schema(schema).parquet(*[f"{folder}/notices/batch={b}" for b in done]) if done else spark.createDataFrame([], schema)


def _there(spark: SparkSession, where: str) -> bool:
    path, fs = folder_of(spark, where)
    return fs.exists(path)


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    path, fs = folder_of(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(path) or [])


# ---------------------------------------------------------------- bodies that changed
def resync(spark: SparkSession, notices: DataFrame, folder: str, checkpoint: str, buckets: int = 64):
    """Keeps ``folder/events`` up to date with a stream of notices' bodies (source, text): each batch's bodies are read again, stored
    events of their sources that they no longer have are deleted and told in ``folder/gone``.

    Events lie in buckets by source, and only those that a batch touches are read and written. Ids are kept; a new event's
    id is a hash of its key. Returns the running query.
    """
    table = Buckets(spark, f"{folder}/events", ["source"], buckets)
    shape = StructType.fromDDL("id long, source string, person string, action string, clause string, unit string, dept string, title string, probation_years int")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.groupBy("source").agg(F.max_by("text", F.length(F.coalesce("text", F.lit("")))).alias("text")).persist()
        try:
            touched = table.touched(batch)
            stored = table.read(shape, number, touched)
            rows = reextract.compared(stored, reextract.found_events(batch), batch).withColumn("id", F.coalesce("id", F.xxhash64(*reextract.KEY))).persist()
            table.write(reextract.applied(stored, rows), number, touched)
            rows.where("state = 'deleted'").drop("state").write.mode("overwrite").parquet(f"{folder}/gone/batch={number}")
            rows.unpersist()
        finally:
            batch.unpersist()

    return notices.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

