"""Anomalies, repairs and search predicates on small tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from officium.operators import repair, search


def test_leaders_anomalies(spark):
    rows = [(1, "u", "赵健健", '["法制科"]', "分管工作"), (2, "u", "赵健健", "[]", "分管"), (3, "u", "赵健健", "{", "分管工作"), (4, "u", "首页法规", None, "主持"), (5, "u", None, "", "分管")]
    got = repair.leader_anomalies(spark.createDataFrame(rows, "id long, bureau string, person string, departments_json string, duty_summary string")).collect()
    assert sorted((r["target_id"], r["kind"]) for r in got) == [("2", "missing_fields"), ("3", "missing_fields"), ("3", "parse_noise"), ("4", "implausible_name"), ("5", "implausible_name"), ("5", "missing_fields")]


def test_handled_anomalies_stay(spark):
    columns = "kind string, target_type string, target_id string, severity string"
    stored = spark.createDataFrame([("a", "e", "1", "warn", "open"), ("a", "e", "2", "warn", "ignored"), ("b", "e", "3", "warn", "open")], columns + ", status string")
    found = spark.createDataFrame([("a", "e", "1", "error"), ("a", "e", "2", "error"), ("c", "e", "9", "info"), ("c", "e", "9", "info")], columns)
    got = repair.upsert_anomalies(stored, found).collect()
    assert sorted(map(tuple, got)) == [("a", "e", "1", "error", "open"), ("a", "e", "2", "warn", "ignored"), ("b", "e", "3", "warn", "open"), ("c", "e", "9", "info", "open")]


def test_notices_of_one_address_merge_and_take_events_along(spark):
    notices = spark.createDataFrame([(1, "http://A.cn/x?xxgkhide=1", "short"), (2, "https://a.cn/x", "a longer body"), (3, "https://a.cn/x?id=3", None), (4, None, "p"), (5, None, "q")], "notice_id long, url string, body string")
    events = spark.createDataFrame([(10, 1, "A", "appoint", "t", "d"), (11, 1, "B", "appoint", "t", None), (12, 2, "A", "appoint", "t", "d"), (13, 3, "A", "appoint", "t", "d"), (14, 2, "C", "dismiss", None, None), (15, 4, "D", "appoint", "t", "d"), (16, 1, "B", "appoint", "t", "")], "id long, notice_id long, person string, action string, title string, dept string")
    kept, moved = repair.merge_notices(notices, events)
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[0]) == [(1, "https://a.cn/x", "a longer body", 2), (3, "https://a.cn/x?id=3", None, 1), (4, None, "p", 1), (5, None, "q", 1)]
    assert sorted((r["id"], r["notice_id"]) for r in moved.collect()) == [(10, 1), (11, 1), (13, 3), (14, 1), (15, 4)]


@pytest.mark.parametrize(("start", "end", "want"), [(None, None, "abcd"), ("2024-01-01", None, "bc"), (None, "2024-01-01", "abd"), ("2024-01-01", "2024-01-01", "b")])
def test_undated_rows_need_no_lower_bound(spark, start, end, want):
    rows = spark.createDataFrame([("a", "2023-05-01"), ("b", "2024-01-01 10:00"), ("c", "2025-01-01"), ("d", None)], "k string, day string")
    assert "".join(sorted(r["k"] for r in rows.where(search.within_days(F.col("day"), start, end)).collect())) == want


def test_titles_that_are_not_a_deputys(spark):
    rows = spark.createDataFrame([(t,) for t in ("局长", "常务副局长", "副局长", "局长、一级主办", None)], "title string")
    assert {r[0] for r in rows.where(search.title_not_deputy(F.col("title"), "局长")).collect()} == {"局长", "局长、一级主办"}


def test_longest_match_equals_a_loop(spark):
    names = [("ab", 1, 1), ("abc", 2, 2), ("cd", 3, 3), ("bcd", 4, 4), ("bcd", 5, 0), ("x", 6, 6)]
    texts = ["".join(t) for n in range(5) for t in itertools.product("abcd", repeat=n)] + [None]
    got = {r["text"]: r["key"] for r in search.longest_match(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(names, "name string, key long, place long")).collect()}
    best = lambda t: max(((len(n), -p, k) for n, k, p in names if len(n) > 1 and t and n in t), default=(0, 0, None))[2]
    assert got == {t: best(t) for t in texts}


def test_a_page_has_the_total_of_all(spark):
    rows = search.page(spark.range(30).toDF("k"), [F.desc("k")], 5, 3).collect()
    assert sorted((r["k"], r["total"]) for r in rows) == [(22, 30), (23, 30), (24, 30)]
    assert search.page(spark.range(30).toDF("k"), [F.desc("k")], 0, 0).count() == 30
