"""Incremental forms: new notices against known ones, list heads, digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.urls import canonical_url
from ..operators import history, watching
from ..operators.tables import merge, seed
from .buckets import Buckets, folder_of


def new_notices(landed: DataFrame, delay: str = "30 days") -> DataFrame:
    """A stream's notices, each canonical address once within the watermark. landed: ts, url, ..."""
    return landed.withColumn("key", canonical_url(F.col("url"))).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])


def merge_batches(spark: SparkSession, updates: DataFrame, table: str, keys: list[str], checkpoint: str, longest: tuple[str, ...] = ()):
    """Upserts a stream into versioned Parquet folders below ``table``: a batch writes the next version whole, so small tables only.

    A batch that runs again writes the same version again, so a restart changes nothing. ``merge_touched`` rewrites only
    what a batch touches. Returns the running query.
    """

    def write(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{table}/v={number}") if number else batch.limit(0)
        merge(old, batch.dropDuplicates(keys), keys, longest).drop("state").write.mode("overwrite").parquet(f"{table}/v={number + 1}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_changes(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Numbers of events per day and kind of a stream: ts, kind."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "kind", "n")


def merge_touched(spark: SparkSession, updates: DataFrame, table: str, keys: list[str], checkpoint: str, longest: tuple[str, ...] = (), buckets: int = 64):
    """Upserts a stream into a table dealt into buckets by key: a batch rewrites only the buckets that its keys touch.

    Returns the running query; ``latest`` reads the table.
    """
    table_ = Buckets(spark, table, keys, buckets)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates(keys).persist()
        try:
            touched = table_.touched(batch)
            old = table_.read(batch.schema, number, touched)
            table_.write(merge(old, batch, keys, longest).drop("state"), number, touched)
        finally:
            batch.unpersist()

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The rows of a table of buckets as they are now."""
    return Buckets(spark, table, []).read(schema)


def recompute_touched(spark: SparkSession, updates: DataFrame, duties: DataFrame, folder: str, checkpoint: str, head: str | int = "sta", buckets: int = 64):
    """Keeps people's current posts up to date with a stream of events: id, bureau, person, action, title, dept, day (and unit).

    Events lie in ``folder/events``, people in ``folder/people``, both dealt into buckets by person. A batch brings its
    events in by id (a changed one replaces the stored one), reads the buckets of the people it names, works out these
    people from all their events and their duties, and rewrites those buckets alone. A batch that runs again gives the same. Returns the running
    query; ``latest`` reads both tables.
    """
    events, people = Buckets(spark, f"{folder}/events", history.PERSON, buckets), Buckets(spark, f"{folder}/people", history.PERSON, buckets)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates(["id"]).persist()
        try:
            touched = events.touched(batch)
            stored = events.read(batch.schema, number, touched)
            events.write(stored.join(batch.select("id"), "id", "left_anti").select(*batch.columns).unionByName(batch), number, touched)
            names = batch.select(*history.PERSON).distinct()
            known = events.read(batch.schema, number + 1, touched).join(names, history.PERSON, "left_semi")
            now = history.people_now(known, duties.join(names, history.PERSON, "left_semi"), head)
            before = people.read(now.schema, number, touched)
            people.write(before.join(names, history.PERSON, "left_anti").select(*now.columns).unionByName(now), number, touched)
        finally:
            batch.unpersist()

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_heads(items: DataFrame) -> DataFrame:
    """Of a stream of lists' items (bureau, url, day) those above their bureau's baseline: its newest item of the batch before.

    A list's items of a batch go newest day first, undated ones last. Nothing is new where the newest is the baseline or
    older; else all down to the baseline's address or an older day. Then the newest is the baseline. The state is two
    texts a bureau; a bureau's items of one batch are one list, which sites keep to a few hundred.
    """

    def above(key: tuple, frames, state):
        rows = pd.concat(list(frames), ignore_index=True)
        rows["_day"] = rows["day"].fillna("").str.slice(0, 10)
        rows = rows.sort_values(["_day", "url"], ascending=False, kind="stable")
        url, day = state.get if state.exists else (None, None)
        stop = (rows["url"] == url) | ((rows["_day"] != "") & (rows["_day"] < (day or "")))
        fresh = rows[~stop.cummax()]
        if not len(fresh) and len(rows) and rows["url"].iloc[0] != url:
            yield fresh[["bureau", "url", "day"]]
            return
        state.update((rows["url"].iloc[0], rows["_day"].iloc[0]))
        yield fresh[["bureau", "url", "day"]]

    return items.groupBy("bureau").applyInPandasWithState(above, "bureau string, url string, day string", "url string, day string", "append", GroupStateTimeout.NoTimeout)


def digests(spark: SparkSession, events: DataFrame, watches: DataFrame, folder: str, checkpoint: str):
    """A digest for each user and batch of a stream of events: user, n, first_id, last_id, below ``folder/digests``.

    A user's cursor is the id of their last matched event; what is not beyond it is not told again. A watch that is new
    begins at the greatest id of the batches before, so that old events aren't told, whenever they come. A batch reads the cursors
    that the one before left and writes the next, so one that runs again gives the same; older ones are deleted. watches as in match_watches.
    """

    def send(batch: DataFrame, number: int) -> None:
        empty = spark.createDataFrame([], StructType([watches.schema["user"], batch.schema["id"]])).withColumnRenamed("id", "last_id")
        stored = spark.read.schema(empty.schema).parquet(f"{folder}/cursors/v={number}") if number else empty
        cursors = seed(stored.where("user IS NOT NULL"), watches, stored.where("user IS NULL").agg(F.max("last_id")).first()[0] or 0)
        fresh = watching.digests(batch, watches, cursors)
        fresh.write.mode("overwrite").parquet(f"{folder}/digests/batch={number}")
        told = spark.read.schema(fresh.schema).parquet(f"{folder}/digests/batch={number}")
        newest = stored.where("user IS NULL").select("last_id").union(batch.select("id")).agg(F.max("last_id").alias("last_id"))  # the row without a user: the greatest id of all
        rows = cursors.unionByName(told.select("user", "last_id")).groupBy("user").agg(F.max("last_id").alias("last_id"))
        rows.unionByName(newest.select(F.lit(None).cast(watches.schema["user"].dataType).alias("user"), "last_id")).write.mode("overwrite").parquet(f"{folder}/cursors/v={number + 1}")
        path, fs = folder_of(spark, f"{folder}/cursors/v={number - 1}")
        fs.delete(path, True)

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
