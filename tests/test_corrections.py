"""Renames in chains and circles, patches and deletions with their audits, discovery, cursors and the report's edges."""

from pyspark.sql import functions as F

from officium.operators import corrections, reextract, report, search, tables
from officium.sources import discovery


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_renames_follow_one_another(spark):
    people = spark.createDataFrame([("x", p, i) for i, p in enumerate(["王一甲", "王二甲", "王三甲", "李明甲", "赵六", "钱七", "王九"])] + [("y", "王一甲", 9)], "bureau string, person string, n int")
    renames = spark.createDataFrame([
        (1, "x", "王一甲", "王二甲"), (2, "x", "王二甲", "王三甲"), (3, "x", "王三甲", "李明甲"),  # a chain into a name that is there
        (4, "x", "赵六", "钱七"), (5, "x", "钱七", "赵六"),  # a circle
        (6, "x", "王九", "通知"), (7, "x", "王八", "王九")], "seq long, bureau string, old string, new string")
    steps = corrections.rename_steps(people, renames)
    ends = {(r["bureau"], r["person"]): (r["full"], r["taken"]) for r in corrections.final_names(steps).collect()}
    assert ends == {("x", "王一甲"): ("李明甲", [3, 2, 1]), ("x", "王二甲"): ("李明甲", [3, 2]), ("x", "王三甲"): ("李明甲", [3]), ("x", "赵六"): ("赵六", [5, 4]), ("x", "钱七"): ("赵六", [5])}
    kept = rows_of(corrections.renamed_people(people, corrections.final_names(steps)), "bureau", "person", "n")
    assert kept == [("x", "李明甲", 3), ("x", "王九", 6), ("x", "赵六", 5), ("y", "王一甲", 9)]
    audit = rows_of(corrections.rename_audit(renames, steps, people), "seq", "n_rows")
    assert audit == [(1, 1), (2, 2), (3, 3), (4, 1), (5, 2), (6, 0), (7, 0)]
    assert corrections.rename_steps(people, renames.limit(0)).count() == 0


def test_patches_in_order_with_null_and_deletion(spark):
    rows = spark.createDataFrame([(1, "a", None, 5), (2, "b", "d", None)], "id long, title string, dept string, years int")
    patches = spark.createDataFrame([(1, 1, "title", "t1"), (2, 1, "title", None), (3, 1, "years", "7"), (4, 1, "id", "9"), (5, 2, "dept", "e"), (6, 2, "__deleted__", None), (7, 2, "dept", "late"), (8, 3, "title", "nobody")], "seq long, target_id long, field string, value string")
    out, audit = corrections.patched(rows, patches, ["title", "dept", "years"])
    assert [tuple(r) for r in out.collect()] == [(1, None, None, 7)]
    assert rows_of(audit, "seq", "target_id", "field", "old_value", "new_value") == [
        (1, 1, "title", "a", "t1"), (2, 1, "title", "t1", None), (3, 1, "years", "5", "7"), (5, 2, "dept", "d", "e"), (6, 2, "__deleted__", '{"target_id":2,"title":"b","dept":"e"}', None)]
    found = spark.createDataFrame([("appointment_event", "2", "open", "warn", 1), ("appointment_event", "2", "ignored", "error", 2), ("leader_duty", "2", "open", "error", 3), ("appointment_event", "9", "open", "info", 4)], "target_type string, target_id string, status string, severity string, id int")
    left = corrections.resolved(found, audit, "appointment_event")
    assert [(r["id"], r["status"]) for r in left.orderBy(*corrections.severity_order()).collect()] == [(3, "open"), (2, "ignored"), (1, "resolved"), (4, "open")]


def test_events_of_unread_sources_stay(spark):
    stored = spark.createDataFrame([(1, "s", "王一", "appoint", None, "u", "d", "t", None), (2, "z", "王二", "appoint", "", "u", "d", "t", 1)], "id long, source string, person string, action string, clause string, unit string, dept string, title string, probation_years int")
    found = spark.createDataFrame([("s", "王一", "appoint", "", "u", "d", None, None)], "source string, person string, action string, clause string, unit string, dept string, title string, probation_years int")
    rows = reextract.compared(stored, found, spark.createDataFrame([("s",), ("empty",)], "source string"))
    assert rows_of(rows, "id", "state") == [(1, "updated")]
    assert rows_of(reextract.applied(stored, rows), "id", "title") == [(1, None), (2, "t")]


def test_equal_scores_keep_the_first_address(spark):
    item = "<a href='/x/t20240101_1.html'>{}</a>"
    pages = spark.createDataFrame([("a", item.format("关于任免的通知") + item.format("招聘公告")), ("b", item.format("人事任免") * 2), ("c", item.format("<b>任命</b>通知") * 2), ("d", item.format("采购"))], "url string, html string")
    candidates = spark.createDataFrame([("k", "a", 1), ("k", "c", 3), ("k", "b", 2), ("m", "d", 1), ("m", "gone", 0)], "code string, url string, place int")
    assert rows_of(discovery.best_address(candidates, pages), "code", "url", "score") == [("k", "b", 2), ("m", None, 0)]


def test_links_in_a_circle_end(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1), (4, 4)], "page int, target int")
    assert rows_of(discovery.discovered(links, spark.createDataFrame([(1,)], "page int")), "page", "depth") == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_addresses_of_links(spark):
    rows = spark.createDataFrame([("https://H.org/a/b.html?x=1", h) for h in ("c.html", "./c.html", "/d", "//other.net/e", "http://z.org/")], "base string, href string")
    got = [r[0] for r in rows.select(discovery.resolved(F.col("base"), F.col("href"))).collect()]
    assert got == ["https://h.org/a/c.html", "https://h.org/a/c.html", "https://h.org/d", "https://other.net/e", "http://z.org/"]
    lists = spark.createDataFrame([("https://h.org/x/rsrm/",), ("https://h.org/x/t1.html",), ("https://h.org",)], "u string")
    assert [r[0] for r in lists.select(discovery.list_address(F.col("u"))).collect()] == [True, False, True]


def test_watches_stay_once_and_cursors_where_they_are(spark):
    shape = "user string, kind string, target string, label string"
    there = spark.createDataFrame([("u", "person", "a", "old"), ("u", "person", "b", "kept")], shape)
    made = tables.add_watches(there, spark.createDataFrame([("u", "person", "a", "new"), ("u", "person", "b", None), ("v", "post", "c", None)], shape))
    assert rows_of(made, "user", "target", "label") == [("u", "a", "new"), ("u", "b", "kept"), ("v", "c", None)]
    cursors = tables.seed(spark.createDataFrame([("u", 3)], "user string, last_id long"), made, spark.createDataFrame([(7,), (5,)], "id long"))
    assert rows_of(cursors, "user", "last_id") == [("u", 3), ("v", 7)]


def test_a_page_of_nothing_and_all(spark):
    rows = spark.range(7).withColumn("day", F.lit(None).cast("string"))
    assert search.page(rows.where("id > 99"), [F.col("id")], 0, 5).collect() == []
    some = search.page(rows, [F.desc("id")], 2, 3, {"even": F.count_if(F.col("id") % 2 == 0)}).collect()
    assert [tuple(r) for r in some] == [(4, None, 7, 4), (3, None, 7, 4), (2, None, 7, 4)]
    assert search.page(rows, [F.col("id")], 5, 0).count() == 2 and search.changes_page(rows, 0, 0).count() == 7


def test_report_of_empty_tables(spark):
    empty = lambda shape: spark.createDataFrame([], shape)
    made = report.integrity_report(
        empty("id long, bureau string, person string, action string, title string, dept string, day string, notice_id long"), empty("id long, bureau string, person string, departments_json string, duty_summary string"),
        empty("id long, bureau string, person string"), empty("id long, url string"), empty("code string"), "2024-01-01").collect()
    assert [(r["counter"], r["n"], r["samples"]) for r in made] == [(c, 0, []) for c in report.COUNTERS]
