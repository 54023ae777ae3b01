"""Units, departments, names, registries and leaders' pages on small tables."""

import pytest
from pyspark.sql import functions as F

from officium.functions import units as fu
from officium.operators import repair, units
from officium.sources import adapters, leaders

SITES = [("sta", "国家税务总局", "headquarters", None, 0), ("ya", "国家税务总局甲省税务局", "province", None, 1), ("yb", "国家税务总局乙市税务局", "city", "ya", 2), ("yc", "国家税务总局乙市丙区税务局", "district", "yb", 3)]


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(SITES, "code string, name string, level string, parent string, place int").cache()


def values(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i")
    return [r["v"] for r in rows.collect()]


def test_units_out_of_noise(spark):
    texts = ["国家税务总局甲市税务局法制科副科长，同时免去乙", "甲市税务局第一税务分局局长", " 甲 市稽查局（ ）", "副局长", "", None, "长" * 41, "某单位"]
    assert values(spark, fu.posting_unit, texts) == ["国家税务总局甲市税务局", "甲市税务局第一税务分局", "甲市稽查局", "", "", "", "", "某单位"]
    assert values(spark, fu.department_label, ["法制科、二级高级主办", "法制科职级", "征管科，免去甲", None]) == ["法制科", "法制科", "征管科", ""]
    assert values(spark, fu.primary_bureau, ["国家税务总局甲市税务局法制科，乙县税务局", "法制科", None]) == ["国家税务总局甲市税务局", "法制科", ""]


def test_levels_of_units(spark):
    texts = ["国家税务总局", "国家税务总局征管司", "国家税务总局甲省税务局", "甲自治州税务局", "甲县税务局", "甲市税务局第一税务分局", "国家税务总局五家渠税务局", "某处", None]
    assert values(spark, fu.level_of_unit, texts) == ["headquarters", "headquarters", "province", "city", "district", "district", "city", None, None]


def test_short_names(spark):
    assert values(spark, fu.short_name, ["国家税务总局甲市税务局", "税务局", "", None]) == ["甲市", "税务局", "—", "—"]
    assert values(spark, lambda t: fu.short_name(t, F.lit("甲市税务局")), ["甲市乙区税务局", "乙区税务局", "甲市税务局"]) == ["乙区", "乙区", "甲市税务局"]
    key = lambda t: fu.post_department(F.lit("法制科"), t, F.lit("甲市税务局"))
    assert values(spark, key, ["甲市乙区税务局", "甲市税务局", None, "法制科"]) == ["乙区 · 法制科", "法制科", "法制科", "法制科"]
    assert values(spark, lambda t: fu.post_department(t, F.lit(None).cast("string"), F.lit("甲市税务局")), ["", None]) == ["本局", "本局"]


def test_targets_and_labels(spark):
    rows = [("bureau", "a"), ("person", "a:王甲"), ("person", "王甲"), ("department", "a::法制::x"), ("post", "a::法制::局长::x"), ("post", "a"), ("other", "a")]
    got = spark.createDataFrame(rows, "k string, t string").select(fu.watch_target(F.col("k"), F.col("t")).alias("w")).select("w.*").collect()
    assert [tuple(r) for r in got] == [("a", None, None, None), ("a", None, None, "王甲"), (None, None, None, "王甲"), ("a", "法制", None, None), ("a", "法制", "局长::x", None), ("a", None, None, None), (None,) * 4]
    assert fu.title_query("副所长（区县）") == ("副所长", "district") and fu.title_query(" 局长 ") == ("局长", None) and fu.title_query(None) == ("", None)


def test_display_follows_where_people_work(spark, sites):
    rows = [(1, "sta", "国家税务总局甲省税务局", "", "局长"), (2, "sta", None, "征管司", "司长（正厅级）"), (3, "sta", "国家税务总局", "教育中心", "主任"), (4, "sta", "丁县税务局", "", "局长"), (5, "yc", None, "", "科长"), (6, "zz", None, None, None), (7, "sta", "国家税务总局驻甲省特派办", "", "")]
    got = {r["id"]: r for r in units.displayed(spark.createDataFrame(rows, "id int, bureau string, unit string, dept string, title string"), sites).collect()}
    show = lambda i: tuple(got[i][c] for c in ("org_level", "posting_bureau", "category", "unit_display", "region_display", "head_bucket"))
    assert show(1) == ("province", "ya", "province", "甲省", "国家税务总局甲省", 0)
    assert show(2) == ("headquarters", "sta", "internal", "国家税务总局", "国家税务总局", 1)
    assert show(3)[2] == "direct" and show(3)[5] == 2 and show(4)[:2] == ("district", "sta") and show(4)[3] == "丁县"
    assert show(5) == ("district", "yc", "", "乙市丙区", "乙市", 0) and show(6)[:2] == (None, "zz") and show(7)[2] == "dispatched"
    assert got[2]["title_display"] == "司长（正厅级）" and got[6]["title_display"] == "—"


def test_posts_of_a_bureau_itself(spark, sites):
    texts = ["国家税务总局乙市税务局第一税务分局", "乙市第一税务分局", "乙市丙区税务局", "丁市税务局", None, "法制科"]
    rows = spark.createDataFrame([(t,) for t in texts], "unit string")
    assert {r["unit"] for r in units.own_only(rows, sites, "yb").collect()} == {texts[0], texts[1], None, "法制科"}
    assert units.own_only(rows, sites, "ya").count() == len(texts)
    assert sorted(r[0] for r in units.codes_of_category(sites, "province").collect()) == ["ya", "yb"]
    assert [r[0] for r in units.codes_of_category(sites, "internal").collect()] == ["sta"] and not units.codes_of_category(sites, "direct", "city").count()


def test_departments_and_their_leaders(spark, sites):
    duties = spark.createDataFrame([(1, "yb", "王甲", "局长", None, ["旧科"], "u"), (2, "yb", "王甲", "局长", "分管工作", ["法制", "征收管理科"], "u"), (3, "yc", "王乙", "副局长", None, ["税政一科"], "u"), (4, "ya", "王丙", None, None, None, None)], "id int, bureau string, person string, title string, duty_summary string, departments array<string>, url string")
    people = spark.createDataFrame([("yb", "王丁", "科长", "法制科"), ("yb", "王甲", "局长", None), ("yc", "王戊", "科员", " ")], "bureau string, person string, title string, dept string")
    found = units.supervisors(duties, sites, "法制").collect()
    assert [(r["id"], r["matched"], r["parent"], r["level"], r["region"]) for r in found] == [(2, ["法制"], "ya", "city", "乙市")]
    assert [r["person"] for r in units.supervisors(duties, sites, "征收管理", ["city"]).collect()] == ["王甲"]
    assert [(r["departments"], r["source"]) for r in units.overseen(duties, people, "王甲", or_tenure=True).collect()] == [(["法制", "征收管理科"], "leader_duties")]
    assert [(r["departments"], r["source"]) for r in units.overseen(duties, people, "王丁", or_tenure=True).collect()] == [(["法制科"], "person_tenure")]
    assert not units.overseen(duties, people, "王丁").count()
    assert {r["person"] for r in units.staff(people, duties, sites, "法制").collect()} == {"王丁"}
    assert {(r["person"], tuple(r["roles"])) for r in units.staff(people, duties, sites, "税政一").collect()} == {("王乙", ("leader",))}
    assert units.staff(people, duties, sites).count() == 5


def test_profiles_fall_back_to_namesakes_of_the_level(spark, sites):
    more = sites.unionByName(spark.createDataFrame([("yd", "丁市税务局", "city", None, 9)], sites.schema))
    events = spark.createDataFrame([(1, "yd", "王甲", "appoint", "科长", "法制科", "2020-01-01"), (2, "yc", "王甲", "appoint", "科长", "x", "2021-01-01"), (3, "yb", "王乙", "appoint", "局长", "y", "2021-01-01"), (4, "yb", "王乙", "dismiss", "局长", "y", "2022-01-01"), (5, "yb", "王乙", "appoint", "处长", "z", "2022-02-01")], "id int, bureau string, person string, action string, title string, dept string, day string")
    assert [r["id"] for r in units.profile_events(events, more, "yb", "王甲").collect()] == [1]
    rows = sorted(units.profile_history(units.profile_events(events, more, "yb", "王乙")).collect(), key=lambda r: r["n"])
    assert [(r["id"], r["ended_on"], r["current"]) for r in rows] == [(5, None, True), (4, None, False), (3, "2022-01-01", False)]


def test_names_are_repaired_and_people_follow(spark, sites):
    clause = "任命周立渊同志为甲省税务局局长"
    events = spark.createDataFrame([(1, "sta", "立渊", "甲省税务局", clause), (2, "sta", "任命周", None, "任命李明为法制科科长"), (3, "yb", " 王 甲", None, None), (4, "junk", "王乙", None, None), (5, "yb", None, None, None)], "id int, bureau string, person string, unit string, clause string")
    duties = spark.createDataFrame([(1, "ya", "立渊"), (2, "yb", "王丙")], "id int, bureau string, person string")
    people = spark.createDataFrame([("ya", "立渊", None), ("ya", "周立渊", None), ("yb", "王甲", "one"), ("yb", "无人", None), ("junk", "王乙", None)], "bureau string, person string, identity_id string")
    e, d, p = repair.clean(events, duties, people, sites, spark.createDataFrame([("junk",)], "code string"))
    assert {(r["id"], r["bureau"], r["person"]) for r in e.collect()} == {(1, "ya", "周立渊"), (2, "sta", "李明"), (3, "yb", "王甲")}
    assert {tuple(r) for r in d.select("bureau", "person").collect()} == {("ya", "周立渊"), ("yb", "王丙")}
    assert {tuple(r) for r in p.select("bureau", "person", "identity_id").collect()} == {("ya", "周立渊", "ya:周立渊"), ("yb", "王甲", "one")}
    lost = repair.unregistered({"events": (events, "bureau"), "people": (people, "bureau")}, sites).collect()
    assert sorted(map(tuple, lost)) == [("events", "junk", 1), ("people", "junk", 1)]


def test_lists_in_other_forms(spark):
    xml = "<RECS><PAGECOUNT>1</PAGECOUNT><REC><TITLE><![CDATA[任免]]></TITLE><URL>http://a/1</URL><DOCRELTIME>2026-01-02 10:00</DOCRELTIME></REC><REC><TITLE>x</TITLE><URL>http://a/1</URL></REC><REC><TITLE/><URL>u</URL></REC></RECS>"
    got = adapters.xml_items(spark.createDataFrame([("p", xml), ("q", "<broken"), ("r", None)], "path string, text string")).collect()
    assert [tuple(r) for r in got] == [("p", 0, "任免", "https://a/1", "2026-01-02")]
    good = "{\"py\": '###1###', \"docs\": [{\"title\": \"甲\", \"url\": \"http://a/2\", \"time\": \"2026.1.3\"}]}"
    bad = '{"docs": [{"title": "乙", "x": 1, "url": "u3", "time": "2026-01-04"}, oops'
    got = adapters.json_items(spark.createDataFrame([("p", good), ("q", bad), ("r", None), ("s", "")], "path string, text string")).collect()
    assert sorted(map(tuple, got)) == [("p", 0, "甲", "https://a/2", "2026-01-03"), ("q", 0, "乙", "u3", "2026-01-04")]
    assert values(spark, adapters.unwrapped, ["a<![CDATA[x]]>b<![CDATA[y\nz]]>", "plain", None]) == ["x\ny\nz", "plain", None]
    pages = [("l", 0, "a"), ("l", 0, "b"), ("l", 1, "b"), ("l", 1, "c"), ("l", 2, "d"), ("l", 3, "e"), ("m", 0, "z"), ("m", 1, "y")]
    assert sorted(map(tuple, adapters.whole_list(spark.createDataFrame(pages, "list string, page int, url string"), 2).collect())) == [("l", 0, "a"), ("l", 0, "b"), ("l", 1, "c"), ("l", 2, "d"), ("m", 0, "z")]


def test_registry_of_sites(spark):
    schema = ", ".join(f"{c} string" for c in adapters.SITE)
    rows = [("a", "甲", "province", None, None, "https://a.cn/xxgk/rsrm", "", "r"), ("b", "", "district", "a", "h", "https://b.cn/list.html", "https://b.cn/l", None), ("", "x", None, None, None, "u", None, None), ("c", "丙", None, None, None, "", None, None)]
    got = {r["code"]: r for r in adapters.sites(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"a", "b"}
    assert tuple(got["a"])[2:7] == ("city", None, "https://a.cn/", "https://a.cn/xxgk/rsrm/", "https://a.cn/xxgk/ldjj/")
    assert tuple(got["b"])[1:7] == ("b", "district", "a", "h", "https://b.cn/list.html", "https://b.cn/l/")
    new = spark.createDataFrame([("b", "乙", None, None, None, None, None, None), ("d", "丁", None, None, None, "u", None, None)], schema)
    assert {(r["code"], r["name"], r["level"]) for r in adapters.merge_sites(spark.createDataFrame(rows, schema), new).collect()} == {("a", "甲", "province"), ("b", "乙", "district"), ("c", "丙", None), ("d", "丁", None)}


def fold(cands):
    """The merge of candidates one after the other, as brute force."""
    out = {}
    for code, _, name, listed, leader, notes in cands:
        if code not in out:
            out[code] = [name, listed or None, leader or None, list(dict.fromkeys(notes))]
            continue
        p = out[code]
        unsure = any("guessed" in n or "missing" in n for n in p[3])
        p[1] = listed if listed and (not p[1] or unsure) else p[1]
        p[2] = leader if leader and (not p[2] or unsure) else p[2]
        p[0] = name if name and name != code and len(name) >= len(p[0] or "") else p[0]
        p[3] += [n for n in dict.fromkeys(notes) if n not in p[3]]
    return out


def test_candidates_merge_as_one_after_the_other(spark):
    import random

    rng = random.Random(5)
    cands = [(rng.choice("abcdefgh"), i, rng.choice(["a", "b", "甲", "甲市", "乙市", "甲市税务局", ""]), rng.choice([None, "", f"u{i}"]), rng.choice([None, f"v{i}"]), rng.choices(["x", "guessed list", "missing", "y", "z"], weights=[5, 1, 1, 5, 5], k=rng.randint(0, 3))) for i in range(200)]
    got = adapters.merge_candidates(spark.createDataFrame(cands, "code string, at int, name string, list_url string, leader_url string, notes array<string>")).collect()
    assert {r["code"]: [r["name"] or "", r["list_url"], r["leader_url"], r["notes"]] for r in got} == {k: [v[0] or "", *v[1:]] for k, v in fold(cands).items()}


def test_first_address_that_is_a_list(spark):
    cands = spark.createDataFrame([("a", "u1", 1), ("a", "u2", 2), ("a", "u3", 3), ("a", "u1", 4), ("b", "u4", 1), ("c", "", 1)], "code string, url string, place int")
    pages = spark.createDataFrame([("u1", 0, "x"), ("u2", 0, "任免" + "x" * 2000), ("u3", 5, "y")], "url string, n_items int, text string")
    got = {r["code"]: tuple(r)[1:] for r in adapters.first_valid(cands, pages).collect()}
    assert got == {"a": ("u2", 0, ["u1"], False), "b": (None, None, ["u4"], True), "c": (None, None, [], True)}


def test_leaders_of_pages(spark):
    pages = [
        ("bio", "<p>王健，男，汉族，党委书记、局长，主持局全面工作。</p><p>李敏，女，回族，副局长，分管工作：法制科、征管科，联系甲县税务局。</p><p>网站地图 赵强，男，汉族，局长</p>"),
        ("bracket", "<div>王健（男，汉族，1970年生）现任副局长，分管收入核算科。</div>"), ("pairs", "<li>王健（局长）</li><li>李敏（副局长）</li>"), ("one", "<li>王健（局长）</li>"),
        ("colon", "<p>局长：王健</p>"), ("turns", "<p>王 健</p><p>局长</p><p>李敏</p><p>总会计师</p>"), ("none", "<p>关于通知</p>"), ("null", None)]
    got = {(r["path"], r["person"]): tuple(r)[2:] for r in leaders.leaders(spark.createDataFrame(pages, "path string, html string")).collect()}
    assert got == {
        ("bio", "王健"): ("党委书记、局长", "男", "汉族", "主持全面工作", []), ("bio", "李敏"): ("副局长", "女", "回族", "分管工作", ["法制科", "征管科"]),
        ("bracket", "王健"): ("副局长", "男", "汉族", "分管工作", ["收入核算科"]), ("pairs", "王健"): ("局长", None, None, None, []), ("pairs", "李敏"): ("副局长", None, None, None, []),
        ("colon", "王健"): ("局长", None, None, None, []), ("turns", "王健"): ("局长", None, None, None, []), ("turns", "李敏"): ("总会计师", None, None, None, [])}


def test_richest_duties_and_identities(spark):
    duties = spark.createDataFrame([(1, "b", "x", None, ["d"], "t"), (2, "b", "x", "s", ["d"], "t"), (3, "b", "x", None, None, "longer"), (4, "b", None, None, [], None)], "id int, bureau string, person string, duty_summary string, departments array<string>, title string")
    assert {r["id"] for r in repair.richest_duties(duties).collect()} == {2, 4}
    people = repair.identities(spark.createDataFrame([("b", "x", "i"), ("c", "x", "i"), ("d", "x", " ")], "bureau string, person string, identity_id string"))
    assert sorted(tuple(r)[1:] for r in repair.appearances(people).collect()) == [("b", "x", "c", "x"), ("c", "x", "b", "x")]
