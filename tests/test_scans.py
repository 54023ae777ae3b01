"""Failures and retries with a restart between, updates drained once, bodies read again."""

from pathlib import Path

from officium.streaming import feeds, scans
from officium.streaming.buckets import Buckets

SCANS = "bureau string, run long, id long, at string, ok boolean"


def one_by_one(rows):
    """The side table in plain Python."""
    out, state = [], {}
    for bureau, run, i, at, ok in sorted(rows, key=lambda r: (r[3], r[2])):
        s = state.setdefault(bureau, {"run": None, "tries": 0, "failures": 0, "success": None, "open": False})
        if run != s["run"]:
            s["run"], s["tries"] = run, 0
        if ok:
            action, s["success"], s["open"] = "recovered" if s["open"] else "ok", at, False
        else:
            s["tries"] += 1
            s["failures"] += 1
            s["open"], action = True, "retry" if s["tries"] == 1 else "failed"
        out.append((bureau, run, i, at, action, max(0, s["failures"] - 1), s["success"], s["open"]))
    return sorted(out, key=repr)


ROWS = [(b, day // 2, i * 100 + day, f"2024-01-{day + 1:02}", (i * 7 + day * 3) % 4 > 1) for i, b in enumerate("abcde") for day in range(8)]


def test_a_restart_gives_the_same_side_table(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for days in ((0, 3), (3, 4), (4, 8)):  # the second stops in the middle of a run
            rows = [r for r in ROWS if days[0] <= int(r[3][-2:]) - 1 < days[1]]
            spark.createDataFrame(rows, SCANS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            told = scans.outcomes(spark.readStream.schema(SCANS).parquet(str(tmp_path / "in")))
            told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = one_by_one(ROWS)
    assert sorted(map(tuple, spark.read.schema(scans.OUTCOME).parquet(str(tmp_path / "out")).collect()), key=repr) == want
    table = scans.outcomes_of_table(spark.createDataFrame(ROWS, SCANS))
    assert sorted(map(tuple, table.collect()), key=repr) == want
    assert {r["bureau"] for r in scans.open_failures(table).collect()} == {b for b in "abcde" if [w for w in want if w[0] == b and w[3] == "2024-01-08"][0][7]}


UPDATES = "bureau string, url string, title string, day string"


def test_updates_become_notices_once(spark, tmp_path):
    landed = [("https://a.org/1", "one")]
    pages = lambda: spark.createDataFrame(landed, "url string, text string")
    folder = str(tmp_path / "out")

    def run(rows, checkpoint="cp"):
        if rows:
            spark.createDataFrame(rows, UPDATES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        scans.drain(spark, spark.readStream.schema(UPDATES).parquet(str(tmp_path / "in")), pages, folder, str(tmp_path / checkpoint)).awaitTermination(120)
        return sorted((r["key"], r["title"], r["text"]) for r in scans.drained(spark, folder).collect())

    first = run([("b", "http://A.org/1#x", "t1", "2024-01-01"), ("b", "https://a.org/2", "t2", None)])
    assert first == [("https://a.org/1", "t1", "one")]
    landed += [("https://a.org/2", "two"), ("https://a.org/3", "three")]
    second = run([("b", "https://a.org/1", "again", None), ("c", "https://a.org/3", "t3", None)])
    assert second == [("https://a.org/1", "t1", "one"), ("https://a.org/2", "t2", "two"), ("https://a.org/3", "t3", "three")]
    # The last batch's commit is lost: it runs again, with more pages there than before, and changes nothing that is known.
    last = max((tmp_path / "cp/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (tmp_path / "cp/commits" / f".{last.name}.crc").unlink(missing_ok=True)
    assert run([]) == second
    assert len(list(Path(folder).glob("notices/batch=*"))) == 2


def test_bodies_read_again_keep_ids_and_leave_tombstones(spark, tmp_path):
    say = lambda *names: "经研究决定：" + "".join(f"任命{n}为甲市税务局法制科科长；" for n in names)
    batches = [[("n1", say("王小明", "李敏")), ("n2", say("赵大力"))], [("n1", say("钱文", "李敏"))], [("n2", None)]]
    seen, folder = [], str(tmp_path / "e")
    for rows in batches:
        spark.createDataFrame(rows, "source string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        scans.resync(spark, spark.readStream.schema("source string, text string").parquet(str(tmp_path / "in")), folder, str(tmp_path / "cp"), 16).awaitTermination(120)
        shape = spark.read.parquet(f"{folder}/gone/batch={len(seen)}").schema
        seen.append({(r["source"], r["person"]): r["id"] for r in feeds.latest(spark, f"{folder}/events", shape).collect()})
    gone = [{(r["source"], r["person"]) for r in spark.read.parquet(f"{folder}/gone/batch={i}").collect()} for i in range(3)]
    assert [set(s) for s in seen] == [{("n1", "王小明"), ("n1", "李敏"), ("n2", "赵大力")}, {("n1", "李敏"), ("n1", "钱文"), ("n2", "赵大力")}, {("n1", "李敏"), ("n1", "钱文")}]
    assert seen[0]["n1", "李敏"] == seen[1]["n1", "李敏"] == seen[2]["n1", "李敏"]
    assert gone == [set(), {("n1", "王小明")}, {("n2", "赵大力")}]
    assert len(Buckets(spark, f"{folder}/events", ["source"]).versions()) <= 2
