"""Steps whose work must not grow faster than their input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from officium.operators import extract, tables, watching
from officium.plans import registry
from officium.sources import discovery, elements

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["post_tenures", "post_incumbents", "post_multi_incumbent_audit", "zero_day_audit", "multi_current_people", "person_history_spans", "post_archives", "post_archive_of_department"])
def test_no_frame_is_read_anew_for_each_row(spark, name):
    """A frame from a row to its group's end costs the square of the group."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "unboundedfollowing" not in plan.replace("unboundedpreceding$(), unboundedfollowing$()", "")


@pytest.mark.parametrize("name", ["post_tenures", "post_multi_incumbent_audit"])
def test_posts_are_sorted_once(spark, name):
    """Each sort of a post's events in one task holds them all in memory; what a holder's own events tell is dealt by holder."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    sorts = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Sort \[bureau[^]]*", plan)]
    assert len([x for x in sorts if ", person ASC" not in x]) == 1, sorts


@pytest.mark.parametrize("name", ["people_now_by_leader", "person_current", "people_current_known", "people_newest_known_is_leave"])
def test_people_now_are_told_without_sorting_their_histories(spark, name):
    """Windows over people's events hold a person's whole history, sorted four times in one task; posts are folded before they meet."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "RowFrame" not in plan.replace("RowFrame, unboundedpreceding$(), unboundedfollowing$()", "")


def most_joined(df):
    """The most rows that a join of an executed query made."""
    def rows(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return rows(node.executedPlan())
        below = [node.plan()] if hasattr(node, "plan") and "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get("numOutputRows").get().value() if "Join" in name and node.metrics().contains("numOutputRows") else 0
        return max([own, *map(rows, below)])

    return rows(df._jdf.queryExecution().executedPlan())


SHAPE = "user long, kind string, bureau long, person long, dept string, title string"


@pytest.mark.parametrize("name", ["totals", "digests", "last_before"])
def test_watchers_and_events_make_no_pairs(spark, name):
    """600 users who watch one bureau and its 500 events: no join makes more rows than there are users and events."""
    events = spark.range(500).select("id", F.lit(1).cast("long").alias("bureau"), F.col("id").alias("person"), F.lit("d").alias("dept"), F.lit("t").alias("title"))
    watches = spark.range(600).select(F.col("id").alias("user"), F.lit("bureau").alias("kind"), F.lit(1).cast("long").alias("bureau"), F.lit(None).cast("long").alias("person"), F.lit("").alias("dept"), F.lit("").alias("title"))
    more = {"totals": [], "digests": [watches.select("user", F.lit(7).alias("last_id"))], "last_before": [watches.select("user", F.lit(7).alias("bound"))]}[name]
    found = getattr(watching, name)(events, watches, *more)
    assert len(found.collect()) == 600 and most_joined(found) <= 1100


def test_watchers_without_pairs_are_told_what_pairs_tell(spark):
    """Several watches a user, over one another and alike, ids on both sides of blocks' bounds, cursors on, between and beyond ids."""
    r = random.Random(5)
    ids = r.sample([i + k * 2**watching.BLOCK for k in range(4) for i in (-3, -2, -1, 0, 1, 2, 9)], 26)
    events = spark.createDataFrame([(i, r.randrange(3), r.randrange(4), r.choice(["ab", "a", None]), r.choice(["x1", "2", ""])) for i in ids], "id long, bureau long, person long, dept string, title string")
    watches = spark.createDataFrame([(u % 40, r.choice(["bureau", "person", "department", "post"]), r.choice([0, 1, 2, None]), r.randrange(4), r.choice(["a", "b", "", None]), r.choice(["1", "2", ""])) for u in range(75)], SHAPE)
    cursors = spark.createDataFrame([(u, r.choice(ids) + r.randrange(-1, 2)) for u in range(0, 40, 2)], "user long, last_id long")
    pairs = tables.match_watches(events, watches)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []
    assert same(watching.totals(events, watches), pairs.groupBy("user", "kind").agg(F.count("*"), F.max("id")))
    assert same(watching.digests(events, watches, cursors), tables.since(pairs, cursors).groupBy("user").agg(F.count_distinct("id"), F.min("id"), F.max("id")))
    bounds = cursors.withColumnRenamed("last_id", "bound")
    assert same(watching.last_before(events, watches, bounds), pairs.join(bounds, "user").where("id < bound").groupBy("user").agg(F.max("id")))


def test_pages_of_a_common_word_are_not_paired(spark, tmp_path):
    """300 pages that link to one word, which 300 pages go by: a round writes what it finds, not 90,000 links."""
    words = spark.createDataFrame([(p, "w") for p in range(300)] + [(300, "v")], "page long, word string")
    named = spark.createDataFrame([(p, "w") for p in range(1, 301)] + [(400, "v")], "target long, word string")
    written, plain = [], discovery.staged
    discovery.staged = lambda rows, name: written.append(plain(rows, name)) or written[-1]
    try:
        found = sorted(map(tuple, discovery.discovered_by_words(words, named, spark.createDataFrame([(0,)], "page long")).collect()))
    finally:
        discovery.staged = plain
    assert found == [(0, 0), *[(p, 1) for p in range(1, 301)], (400, 2)]
    assert max(w.count() for w in written) <= 301
    links = words.join(named, "word").where("page <> target").select("page", "target")
    assert found == sorted(map(tuple, discovery.discovered(links, spark.createDataFrame([(0,)], "page long")).collect()))


def test_notices_are_shuffled_once_over_all_cores(spark):
    """By its size alone a shuffle of short texts would be read by one task, and windows over what is found would shuffle it again."""
    notices = spark.range(50).select(F.col("id").alias("notice_id"), F.lit("经研究决定：任命王明为甲市税务局法制科科长；").alias("text"))
    plan = extract.appointment_events(notices)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_links_to_follow_read_pages_once(spark):
    plan = elements.link_targets(elements.elements(spark.createDataFrame([("p", "<a href='/ldjj/1.html'>王明健</a>")], "path string, html string")))._jdf.queryExecution()
    assert "MapInArrow" not in plan.optimizedPlan().toString()  # it ran before, and what counts was written down


def test_layouts_send_few_rows_to_the_driver(spark):
    """Small sides of joins within pages grow with the pages; dozens of them, sent at once, fill the driver."""
    rows = elements.elements(spark.createDataFrame([("p", "<a href='/ldjj/1.html'>王明健</a>")], "path string, html string"))
    plan = elements.leaders_in_elements(rows)._jdf.queryExecution().executedPlan().toString()
    sent, merged = plan.count("BroadcastExchange"), plan.count("SortMergeJoin")
    assert (sent, merged > 20) == (0, True), (sent, merged)
