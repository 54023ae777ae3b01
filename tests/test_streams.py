"""Incremental tables and list heads over several runs; details of pages."""

from pathlib import Path

from officium.operators import extract, history
from officium.sources import notices
from officium.streaming import feeds


def test_batches_rewrite_only_touched_buckets(spark, tmp_path):
    schema = "id long, k string, body string"
    batches = [[(i, f"k{i}", "x") for i in range(40)], [(100, "k3", "longer"), (101, "new", "y")], [(102, "k3", "longest one")]]
    want, table = {}, str(tmp_path / "t")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = {p for p in Path(table).glob("bucket=*/v=*")}
        feeds.merge_touched(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, ["k"], str(tmp_path / "cp"), ("body",), 16).awaitTermination(120)
        made = {p for p in Path(table).glob("bucket=*/v=*")} - before
        assert len(made) <= len(rows)
        for i, k, body in rows:
            old = want.get(k, (i, ""))
            want[k] = (old[0], body if len(body) > len(old[1]) else old[1])
    got = feeds.latest(spark, table, spark.createDataFrame([], schema).schema).collect()
    assert {r["k"]: (r["id"], r["body"]) for r in got} == want and len(got) == len(want)
    assert max(len(list(p.glob("v=*"))) for p in Path(table).glob("bucket=*")) <= 2


def test_new_heads_are_those_above_the_baseline(spark, tmp_path):
    schema = "bureau string, url string, day string"
    batches = [[("a", "u1", "2024-01-01"), ("a", "u2", "2024-01-05")], [("a", "u2", "2024-01-05"), ("a", "u3", "2024-02-01"), ("a", "u1", "2024-01-01"), ("b", "w", None)], [("a", "u3", "2024-02-01"), ("b", "w", None)], [("a", "u4", "2024-01-20"), ("b", "x", "2024-01-01")]]
    want = [{"u1", "u2"}, {"u3", "w"}, set(), {"x"}]
    seen, out = set(), str(tmp_path / "out")
    for rows, new in zip(batches, want):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        heads = feeds.new_heads(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        heads.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        got = [r["url"] for r in spark.read.schema(schema).parquet(out).collect()]
        assert set(got) - seen == new and len(got) == len(seen | new)
        seen |= new


def test_pages_become_events(spark):
    page = '<html><head><meta name="ArticleTitle" content="甲市税务局任免工作人员&lt;br/&gt;（2026年2月25日）"><meta name="PubDate" content="2026-03-01 10:00"></head><body><p>发文日期：2026-02-26 沪税任〔2026〕117号 字号</p><div>经研究决定：任命张小三为甲市税务局办公室主任；</div></body></html>'
    other = "<html><head><title>通知</title></head><body>发布日期：2025/1/2</body></html>"
    rows = notices.details(spark.createDataFrame([("p", page), ("q", other), ("r", None)], "path string, html string")).orderBy("path").collect()
    assert [(r["title"], r["issued_on"], r["doc_no"]) for r in rows] == [("甲市税务局任免工作人员", "2026-02-25", "沪税任〔2026〕117号"), ("通知", "2025-01-02", None), (None, None, None)]
    made = extract.appointment_events(spark.createDataFrame([(r["path"], r["text"]) for r in rows], "notice_id string, text string")).collect()
    assert [(r["notice_id"], r["person"], r["unit"], r["dept"], r["title"]) for r in made] == [("p", "张小三", "甲市税务局", "办公室", "主任")]


def test_digests_tell_each_event_once(spark, tmp_path):
    schema = "id long, bureau string, person string, dept string, title string"
    watches = spark.createDataFrame([("u", "bureau", "a", None, None, None), ("u", "person", None, "王甲", None, None), ("v", "post", "b", None, "法制", "局长")], "user string, kind string, bureau string, person string, dept string, title string")
    batches = [[(1, "a", "王甲", "x", "y"), (2, "b", "王乙", "法制科", "副局长")], [(1, "a", "王甲", "x", "y"), (3, "b", "王甲", "z", "y")], [(4, "c", "王丙", "x", "y")]]
    got = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feeds.digests(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), watches, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got.append(sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / f"out/digests/batch={i}")).collect()))
    assert got == [[("u", 1, 1, 1), ("v", 1, 2, 2)], [("u", 1, 3, 3)], []]


def test_a_later_watch_is_not_told_old_events(spark, tmp_path):
    schema = "id long, bureau string, person string, dept string, title string"
    shape = "user string, kind string, bureau string, person string, dept string, title string"
    first, both = [("u", "bureau", "a", None, None, None)], [("u", "bureau", "a", None, None, None), ("v", "bureau", "a", None, None, None)]
    batches = [([(5, "a", "x", "", "")], first), ([(3, "a", "x", "", ""), (6, "a", "x", "", "")], both), ([(4, "a", "x", "", ""), (7, "a", "y", "", "")], both)]
    got = []
    for i, (rows, watches) in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feeds.digests(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), spark.createDataFrame(watches, shape), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got.append(sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / f"out/digests/batch={i}")).collect()))
    assert got == [[("u", 1, 5, 5)], [("u", 1, 6, 6), ("v", 1, 6, 6)], [("u", 1, 7, 7), ("v", 1, 7, 7)]]
    assert sorted(p.name for p in (tmp_path / "out/cursors").glob("v=*")) == ["v=2", "v=3"]


def test_people_follow_their_events_bucket_by_bucket(spark, tmp_path):
    """Only the buckets of people whom a batch names are rewritten, and the table is what a full rebuild gives."""
    schema = "id long, bureau string, person string, action string, title string, dept string, day string, unit string"
    duties = spark.createDataFrame([(1, "b", "王九", "局长", ["征管处"], "男"), (2, "a", "王三", "副局长", [], None)], "id long, bureau string, person string, title string, departments array<string>, gender string")
    row = lambda i, p, action, title, day: (i, "ab"[p % 2], f"王{'一二三四五六七八九'[p]}", action, title, "法制科", day, "国家税务总局" if p == 8 else "")
    batches = [[row(i, i % 9, "appoint", "科长", f"2020-01-{i + 1:02}") for i in range(18)], [row(30, 2, "dismiss", "科长", "2021-01-01"), row(31, 4, "appoint", "处长", "2021-02-01")], [row(31, 4, "dismiss", "科长", "2021-02-01"), row(5, 5, "appoint", "局长", "2022-01-01")]]
    events, folder = {}, tmp_path / "people"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = {p for p in folder.glob("*/bucket=*/v=*")}
        feeds.recompute_touched(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), duties, str(folder), str(tmp_path / "cp"), buckets=32).awaitTermination(120)
        made = {p for p in folder.glob("people/bucket=*/v=*")} - before
        assert len(made) <= len({(r[1], r[2]) for r in rows})
        events |= {r[0]: r for r in rows}
    whole = history.people_now(spark.createDataFrame(list(events.values()), schema), duties)
    got = feeds.latest(spark, str(folder / "people"), whole.schema).collect()
    named = {(r[1], r[2]) for r in events.values()}
    assert sorted(map(repr, got)) == sorted(repr(r) for r in whole.collect() if (r["bureau"], r["person"]) in named) and len(got) == len(named)
