"""Audits of the registry of sites on small tables."""

from officium.operators import sites


def test_failures(spark):
    rows = [("a", "u", 1, 0, 0), ("b", None, 0, 0, 3), ("c", "", 0, 0, 0), ("d", "u", 0, 0, 0), ("e", "u", 0, 0, 2), ("f", None, 0, 1, 0), ("k", "u", 5, 5, 5)]
    known = spark.createDataFrame([("k",), ("k",), (None,)], "code string")
    found = sites.failures(spark.createDataFrame(rows, "code string, list_url string, events long, notices long, heads long"), known)
    assert {r["code"]: (r["failure"], r["monitoring"]) for r in found.collect()} == {
        "a": ("real_failure", "monitor"), "b": ("no_url_no_data", "no_url"), "c": ("no_url_no_data", "no_url"), "d": ("zero_appt_data", "zero_data"),
        "e": ("real_failure", "zero_data"), "f": ("real_failure", "no_url"), "k": ("known_no_appt", "known")}
    assert found.count() == len(rows)


def test_counts_without_rows(spark):
    events = spark.createDataFrame([("a",), ("a",), (None,)], "bureau string")
    found = sites.counted(spark.createDataFrame([("a",), ("b",), (None,)], "code string"), {"events": (events, "bureau"), "notices": (events.limit(0), "bureau")})
    assert sorted(map(tuple, found.collect()), key=str) == [("a", 2, 0), ("b", 0, 0), (None, 0, 0)]


def test_pruned(spark):
    rows = [("a", "甲市税务局", "u", None, 1), ("b", "下载中心", "u", None, 2), ("c", None, "u", ["x"], 3), ("d", "丁市税务局", "u", ["NO_APPT", "栏目无发文"], 4), ("e", "戊县税务局", "u", ["x", None], 5), ("j", "己市税务局", "u", None, 6), (None, None, None, None, 7)]
    entries = spark.createDataFrame(rows, "code string, name string, list_url string, notes array<string>, extra int")
    empty = spark.createDataFrame([("a", "站点无人事任免栏目"), ("d", "栏目无发文"), ("b", "栏目无发文")], "code string, reason string")
    got = {r["extra"]: (r["list_url"], r["notes"]) for r in sites.pruned(entries, empty, {"戊县": "站点无此项"}, ["j"]).collect()}
    assert got == {1: (None, ["NO_APPT", "站点无人事任免栏目"]), 3: ("u", ["x"]), 4: ("u", ["NO_APPT", "栏目无发文"]), 5: (None, ["x", None, "NO_APPT", "站点无此项"]), 7: (None, [])}
    assert sites.pruned(entries.limit(0), empty).collect() == []


def test_by_hand(spark):
    files = spark.createDataFrame([("a", "x.html"), ("b", "sub/x.html"), ("c", "sub/manifest.json"), ("d", "manifest.json"), ("e", "ingest_report.json"), ("z", "x.html"), ("a", "y.html"), (None, "x.html")], "parent string, path string")
    parents = spark.createDataFrame([(c,) for c in "abcdez"], "code string")
    assert {r["code"] for r in sites.by_hand(parents, files, list("abcde")).collect() if r["skipped"]} == {"a", "c", "e"}
