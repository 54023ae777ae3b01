"""What watches answer to, per user, without a row for each pair of an event and a watch.

Users who watch the same are an audience, which goes by its smallest user; that user's watches are matched for all of
them. So an event makes a row for each different watch that it answers, however many users have it. Totals
are taken of events folded by what watches ask for; digests place each user's cursor among the ids of their audience's events.
Watches are as in ``tables.match_watches`` and have a user; ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import match_watches

BLOCK = 16  # bits of an id within a block: an audience's ids are ordered block by block, not in one task


def audiences(watches: DataFrame) -> DataFrame:
    """user and audience of all users of watches."""
    kind = F.col("kind")
    asked = F.struct(
        "kind", "bureau", F.when(kind == "person", F.col("person")).alias("person"), F.when(kind.isin("department", "post"), F.col("dept")).alias("dept"), F.when(kind == "post", F.col("title")).alias("title"))
    lists = watches.groupBy("user").agg(F.sort_array(F.collect_list(asked)).alias("_list"))
    return lists.select("user", F.min("user").over(Window.partitionBy("_list")).alias("audience"))


def _of_heads(watches: DataFrame, members: DataFrame) -> DataFrame:
    return watches.join(members.where(F.col("user") == F.col("audience")).select("user"), "user", "left_semi")


def totals(events: DataFrame, watches: DataFrame) -> DataFrame:
    """user, kind, n, newest: the number of matches of a user's watches of a kind and their greatest id."""
    members = audiences(watches)
    heads = _of_heads(watches, members)
    folded = lambda *keys: events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("newest"))
    missing = lambda c: F.lit(None).cast(events.schema[c].dataType).alias(c)
    places = folded("bureau", "dept", "title").select("bureau", missing("person"), "dept", "title", "n", "newest")
    people = folded("bureau", "person").select("bureau", "person", missing("dept"), missing("title"), "n", "newest")
    found = match_watches(places, heads.where("kind <> 'person'")).unionByName(match_watches(people, heads.where("kind = 'person'")))
    found = found.groupBy(F.col("user").alias("audience"), "kind").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))
    return members.join(found, "audience").select("user", "kind", "n", "newest")


def _placed(events: DataFrame, watches: DataFrame, points: DataFrame) -> DataFrame:
    """Per user of points (user, at): n, first_id, last_id of their matches' ids beyond at, and upto, the greatest that isn't beyond."""
    members = audiences(watches)
    told = match_watches(events, _of_heads(watches, members)).select(F.col("user").alias("audience"), "id")
    readers = members.join(points, "user").select("audience", F.col("at").cast(events.schema["id"].dataType).alias("id"), F.struct("user").alias("reader"))
    rows = told.withColumn("reader", F.lit(None).cast(readers.schema["reader"].dataType)).unionByName(readers)
    # Both the windows and the blocks' totals read this one shuffle.
    key = ["audience", "block"]
    rows = rows.withColumn("block", F.shiftright(F.col("id").cast("long"), BLOCK)).repartition(*key).dropDuplicates([*key, "id", "reader"])
    event = F.col("reader").isNull()
    id_ = F.when(event, F.col("id"))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*key).orderBy(F.desc("id"), event.asc()).rowsBetween(*so_far)  # at one id the cursor comes first
    up = Window.partitionBy(*key).orderBy(F.asc("id"), event.desc()).rowsBetween(*so_far)
    own = rows.select(*key, "reader", F.sum(event.cast("long")).over(down).alias("n"), F.min(id_).over(down).alias("first"), F.max(id_).over(down).alias("last"), F.max(id_).over(up).alias("upto"))
    blocks = rows.groupBy(*key).agg(F.sum(event.cast("long")).alias("k"), F.min(id_).alias("lo"), F.max(id_).alias("hi"))
    later = Window.partitionBy("audience").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("audience").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*key, F.sum("k").over(later).alias("k"), F.min("lo").over(later).alias("lo"), F.max("hi").over(later).alias("hi"), F.max("hi").over(earlier).alias("below"))
    return own.where("reader IS NOT NULL").join(blocks, key).select(
        "reader.user", (F.col("n") + F.coalesce("k", F.lit(0))).alias("n"), F.coalesce("first", "lo").alias("first_id"), F.coalesce("hi", "last").alias("last_id"), F.coalesce("upto", "below").alias("upto"))


def digests(events: DataFrame, watches: DataFrame, cursors: DataFrame) -> DataFrame:
    """user, n, first_id, last_id of each user's different matches beyond their cursor (user, last_id); without one that is 0.

    Users who have none are left out.
    """
    at = watches.select("user").distinct().join(cursors.select("user", F.col("last_id").alias("at")), "user", "left").withColumn("at", F.coalesce("at", F.lit(0)))
    return _placed(events, watches, at).where("n > 0").select("user", "n", "first_id", "last_id")


def last_before(events: DataFrame, watches: DataFrame, bounds: DataFrame) -> DataFrame:
    """user, last_id: the greatest id of a user's matches below their bound (user, bound), where there is one."""
    found = _placed(events, watches, bounds.select("user", (F.col("bound") - 1).alias("at")))
    return found.where("upto IS NOT NULL").select("user", F.col("upto").alias("last_id"))
