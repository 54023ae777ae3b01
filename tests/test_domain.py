"""Behaviour of histories, posts, parsers and merges on small hand-made rows."""

import random

from pyspark.sql import functions as F

from officium.functions import titles, urls
from officium.operators import history, tables
from officium.plans import registry
from officium.sources import notices
from officium.streaming import feeds

EVENT = "id long, bureau string, person string, action string, title string, dept string, day string"


def events(spark, *rows):
    return spark.createDataFrame([(i + 1, "u", *r) for i, r in enumerate(rows)], EVENT)


def test_promotion_then_deputy_dismissed(spark):
    ev = events(spark, ("A", "appoint", "副处长", "D", "2023-01-01"), ("A", "appoint", "处长", "D", "2024-06-01"), ("B", "appoint", "副处长", "D", "2024-07-01"), ("B", "dismiss", "副处长", "D", "2025-01-01"))
    now = {r["person"]: r["title"] for r in history.current_posts(ev).collect()}
    assert now == {"A": "处长"}
    t = history.tenures(ev, titles.several_holders(F.col("title"))).collect()
    assert {(r["person"], r["title"]) for r in t if r["is_current"]} == {("A", "副处长"), ("A", "处长")}
    assert [(r["ended_on"], r["end_change_type"]) for r in t if r["person"] == "B"] == [("2025-01-01", "dismiss")]


def test_successor_closes_a_single_post(spark):
    ev = events(spark, ("A", "appoint", "局长", "D", "2023-01-01"), ("B", "appoint", "局长", "D", "2025-01-01"))
    got = {r["person"]: (r["is_current"], r["end_change_type"]) for r in history.tenures(ev, titles.several_holders(F.col("title"))).collect()}
    assert got == {"A": (False, "succeeded"), "B": (True, None)}


def test_deputies_coexist(spark):
    ev = events(spark, *[(p, "appoint", "副所长", "D", "2023-01-01") for p in "ABC"])
    row = history.incumbents(history.tenures(ev, titles.several_holders(F.col("title")))).first()
    assert (row["incumbents"], row["past"], row["names"]) == (3, 0, "A、B、C")


def test_a_newer_leave_blocks_an_older_appointment(spark):
    ev = events(spark, ("A", "appoint", "处长", "D", "2023-01-01"), ("A", "dismiss", None, None, "2024-01-01"))
    assert history.current_posts(ev).count() == 0
    assert history.spans(ev).first()["ended_on"] == "2024-01-01"


def fold(rows):
    """One pass over a post's events in order, as a plain loop."""
    out = []
    for post in sorted({(r[4], r[5]) for r in rows}):
        single, open_, seen = post[0] == "局长", {}, set()
        for i, _, person, action, title, dept, day in sorted((r for r in rows if (r[4], r[5]) == post), key=lambda r: (r[6], r[0])):
            if action == "dismiss":
                if person in open_:
                    out.append((*open_.pop(person), day, "dismiss"))
                continue
            if (person, day) in seen:
                continue
            seen.add((person, day))
            if single:
                for other in [p for p in open_ if p != person]:
                    out.append((*open_.pop(other), day, "succeeded"))
            if person in open_:
                out.append((*open_.pop(person), day, "replaced"))
            open_[person] = (person, i)
        out += [(*v, None, None) for v in open_.values()]
    return sorted(map(repr, out))


def test_tenures_equal_a_fold(spark):
    rng = random.Random(3)
    rows = [(i, "u", rng.choice("ABCD"), rng.choice(["appoint", "appoint", "dismiss"]), rng.choice(["局长", "副局长"]), rng.choice("XY"), f"2024-01-{rng.randint(1, 28):02d}") for i in range(200)]
    got = history.tenures(spark.createDataFrame(rows, EVENT), titles.several_holders(F.col("title"))).collect()
    assert sorted(repr((r["person"], r["id"], r["ended_on"], r["end_change_type"])) for r in got) == fold(rows)


def test_change_types(spark):
    cases = [("dismiss", "处长", "D", None, None, None, "dismiss"), ("appoint", "处长", "D", "试用期满转正", None, None, "probation_confirm"), ("appoint", "处长", "D", None, "副处长", "D", "promote"), ("appoint", "处长", "E", None, "处长", "D", "transfer"), ("appoint", "科员", "D", None, None, None, "appoint"), ("", "科员", None, None, None, None, "unknown"), ("appoint", "处长", "D", "到龄退休", None, None, "retire")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, t string, d string, c string, pt string, pd string, want string")
    c = F.col
    got = rows.select("want", titles.classify_change(c("a"), c("t"), c("d"), F.lit(None).cast("string"), c("c"), c("pt"), c("pd")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got


def test_addresses_and_days(spark):
    row = spark.range(1).select(urls.canonical_url(F.lit("http://Ex.CN/a/b/?x=1#y")).alias("u"), urls.title_date(F.lit("任免（2025年12月1日）")).alias("d"), urls.title_date(F.lit("2025年13月1日")).alias("bad"), urls.is_day(F.lit("2025-02-30")).alias("no"), urls.json_list(F.lit("{")).alias("j")).first()
    assert tuple(row) == ("https://ex.cn/a/b/?x=1", "2025-12-01", None, False, [])


def test_addresses_keep_their_query(spark):
    given = ["http://A.cn/x?id=1&xxgkhide=1", "https://a.cn/x?XXGKHIDE=1&id=2#t", "HTTP://a.cn/X", "a.cn/x", "", " ", None, "http://a.cn?xxgkhide=1", "https://a.cn/x/?id="]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, u string").orderBy("i").select(urls.canonical_url(F.col("u")).alias("c"), urls.source_key(F.col("u")).alias("k")).collect()
    assert [r["c"] for r in rows] == ["https://a.cn/x?id=1", "https://a.cn/x?id=2", "https://a.cn/X", "https://a.cn/x", None, None, None, "https://a.cn", "https://a.cn/x/?id="]
    assert [r["k"] for r in rows] == ["a.cn/x", "a.cn/x", "a.cn/X", "a.cn/x", None, None, None, "a.cn", "a.cn/x"]


def test_leaves_close_posts_without_titles_and_by_text(spark):
    ev = events(spark, ("A", "appoint", None, "D", "2023-01-01"), ("A", "dismiss", None, "D", "2024-01-01"), ("B", "appoint", "处长", "D", "2023-01-01"), ("B", "dismiss", "处长", None, "2024-02-01"), ("C", "appoint", "处长", "D", "2023-01-01"), ("C", "dismiss", "科长", None, "2024-02-01"))
    assert {r["person"]: r["ended_on"] for r in history.spans(ev).collect()} == {"A": "2024-01-01", "B": "2024-02-01", "C": None}
    told = ev.where("person = 'C'").withColumn("clause", F.when(F.col("action") == "dismiss", "到龄退休")).withColumn("action", F.lit("appoint")).withColumn("title", F.lit("处长")).withColumn("dept", F.lit("D"))
    assert history.spans(told).first()["ended_on"] == "2024-02-01"
    assert {r["person"]: r["newest_is_leave"] for r in history.newest_is_leave(ev).collect()} == {"A": True, "B": True, "C": True}


def test_the_highest_title_of_a_day_is_current(spark):
    ev = events(spark, ("A", "appoint", "副局长", "D", "2023-01-01"), ("A", "appoint", "科长", "D", "2023-01-01"), (None, "appoint", "科长", "D", "2023-01-01"), (None, "dismiss", "科长", "D", "2023-05-01"))
    assert {r["person"]: r["title"] for r in history.current_posts(ev).collect()} == {"A": "副局长"}


def test_spans_and_current_posts_equal_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, "u", rng.choice("ABC"), rng.choice(["appoint", "appoint", "dismiss"]), rng.choice(["局长", "科长", None, ""]), rng.choice(["X", "Y", None]), f"2024-01-{rng.randint(1, 28):02d}") for i in range(150)]
    ev = spark.createDataFrame(rows, EVENT)
    rank = {"局长": 20, "科长": 140}
    text = lambda r: (r[4] or "", r[5] or "")
    closes = lambda l, a: text(l) == text(a) or text(l) == ("", "") or (text(l)[1] == "" and text(l)[0] != "" and text(l)[0] == text(a)[0])
    ended, now = {}, {}
    for p in "ABC":
        mine = sorted((r for r in rows if r[2] == p), key=lambda r: (r[6], r[0]))
        for k, r in enumerate(mine):
            if r[3] == "appoint":
                ended[r[0]] = next((x[6] for x in mine[k + 1 :] if x[3] == "dismiss" and closes(x, r)), None)
        mine = sorted(mine, key=lambda r: -r[0])
        mine.sort(key=lambda r: rank.get(r[4], 900))
        mine.sort(key=lambda r: r[6], reverse=True)
        for k, r in enumerate(mine):
            if r[3] == "appoint" and not any(x[3] == "dismiss" and closes(x, r) for x in mine[:k]):
                now[p] = (r[4], r[5], r[6])
                break
    assert {r["id"]: r["ended_on"] for r in history.spans(ev).collect()} == ended
    assert {r["person"]: (r["title"], r["dept"], r["since"]) for r in history.current_posts(ev).collect()} == now


def test_merge_keeps_ids_and_longer_text(spark):
    old = spark.createDataFrame([(1, "a", "long body"), (2, "b", "x")], "id long, k string, body string")
    new = spark.createDataFrame([(9, "a", "short"), (3, "c", None)], "id long, k string, body string")
    assert {tuple(r) for r in tables.merge(old, new, ["k"], ("body",)).select("k", "id", "body", "state").collect()} == {("a", 1, "long body", "updated"), ("b", 2, "x", "kept"), ("c", 3, None, "inserted")}


def test_merge_takes_rows_without_ids(spark):
    old = spark.createDataFrame([(1, "a", "x"), (None, "b", "y")], "id long, k string, body string")
    new = spark.createDataFrame([(None, "a", "longer"), (None, "b", "z"), (None, "c", "w")], "id long, k string, body string")
    assert {tuple(r) for r in tables.merge(old, new, ["k"], ("body",)).select("k", "id", "body", "state").collect()} == {("a", 1, "longer", "updated"), ("b", None, "y", "updated"), ("c", None, "w", "inserted")}


def test_cursors_and_baselines_are_each_ones_own(spark):
    matches = spark.createDataFrame([(u, i) for u in (1, 2, 3) for i in (1, 2, 3)], "user long, id long")
    cursors = spark.createDataFrame([(1, 2), (2, 3)], "user long, last_id long")
    assert sorted(tuple(r) for r in tables.since(matches, cursors).collect()) == [(1, 3), (3, 1), (3, 2), (3, 3)]
    rows = spark.createDataFrame([(b, i, f"2020-01-0{i}") for b in ("p", "q", "r") for i in (1, 2, 3)], "bureau string, id long, day string")
    baseline = spark.createDataFrame([("p", "2020-01-02", 2), ("q", "2020-01-03", 3)], "bureau string, last_day string, last_id long")
    assert sorted(tuple(r)[:2] for r in tables.new_heads(rows, baseline).collect()) == [("p", 3), ("r", 1), ("r", 2), ("r", 3)]


def test_digest_merge_and_watch_reach_everyone(spark):
    sf, got = "/root/testdata/sf0.001", registry.queries()
    people = spark.read.parquet(f"{sf}/customer.parquet")
    assert got["notify_digest_by_cursor"](spark, sf).count() > 0
    assert got["upsert_everyone_merge"](spark, sf).count() == people.count()
    watched = {r["user"] for r in got["watch_match_everyone"](spark, sf).where("kind = 'bureau'").collect()}
    assert {r["c_custkey"] for r in people.where("c_custkey % 4 = 0").collect()} >= watched and len(watched) > people.where("c_custkey % 4 = 0 AND c_acctbal > 9900").count()


def test_list_items(spark):
    page = '<ul><li><a href="/n/2.html">关于 甲 任职&amp;</a><span>2025-01-02</span></li><li><a href="/n/2.html">again</a></li><li><a href="/n/2025-01-01-1.html">乙</a></li></ul>'
    got = [tuple(r) for r in notices.list_items(spark.createDataFrame([("p", page)], "path string, html string")).orderBy("at").collect()]
    assert got == [("p", "/n/2.html", 0, "关于甲任职&", "2025-01-02"), ("p", "/n/2025-01-01-1.html", 2, "乙", "2025-01-01")]


def test_payloads_and_pages(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"bureau": "u", "notices": [{"title": "t", "source_url": "s"}], "events": [{"person_name": "A", "action": "appoint", "source_url": "s"}]}]')
    ns, es = notices.read_payloads(spark, str(tmp_path / "x.json"))
    assert (ns.first()["title"], es.first()["person_name"]) == ("t", "A")
    (tmp_path / "a.html").write_bytes("<title>中文</title>".encode("gb18030"))
    assert notices.read_pages(spark, str(tmp_path)).select(notices.page_title(F.col("html"))).first()[0] == "中文"


def test_batches_merge_into_versions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "id long, k string, body string"
    for i, rows in enumerate(([(1, "a", "x")], [(2, "a", "longer"), (3, "b", "y")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        feeds.merge_batches(spark, stream, str(tmp_path / "t"), ["k"], str(tmp_path / "cp"), ("body",)).awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "v=2")).select("k", "id", "body").collect()} == {("a", 1, "longer"), ("b", 3, "y")}
