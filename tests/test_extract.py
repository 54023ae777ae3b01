"""Events of notices' texts."""

from pyspark.sql import functions as F

from officium.functions import persons
from officium.operators import extract


def found(spark, *texts):
    rows = extract.appointment_events(spark.createDataFrame(list(enumerate(texts)), "notice_id long, text string")).orderBy("notice_id", "n").collect()
    return [(r["notice_id"], r["person"], r["action"], r["unit"], r["dept"], r["title"], r["probation_years"]) for r in rows]


def test_appointments_and_leaves(spark):
    got = found(
        spark,
        "首页 通知 经研究决定：任命赵健健为国家税务总局甲市税务局办公室主任，任职试用期为一年；免去钱一二的乙区税务局法制科副科长职务。",
        "赵健健任保税区税务分局法制科副科长。任职试用期为二年。",
        "免去 孙小明 同志国家税务总局丙市税务局副局长、二级高级主办职务；李大同不再担任丁县税务局局长；周全同志担任戊市税务局纪检组组长",
        "免去吴凡国家税务总局己市税务局副局长职务。免去郑和职务。", None, "", "关于张三丰的通知",
        "王一任职试用期满，考核合格，按期转正，任庚区税务局征收管理科科长。", "沪税宝任〔2026〕2号 发文单位：某局")
    assert got == [
        (0, "赵健健", "appoint", "国家税务总局甲市税务局", "办公室", "主任", 1),
        (0, "钱一二", "dismiss", "乙区税务局", "法制科", "副科长", None),
        (1, "赵健健", "appoint", "保税区税务分局", "法制科", "副科长", 2),
        (2, "孙小明", "dismiss", "国家税务总局丙市税务局", None, "副局长、二级高级主办", None),
        (2, "李大同", "dismiss", "丁县税务局", None, "局长", None), (2, "周全", "appoint", "戊市税务局", None, "纪检组组长", None),
        (3, "吴凡", "dismiss", "国家税务总局己市税务局", None, "副局长", None), (3, "郑和", "dismiss", None, None, None, None),
        (7, "王一", "appoint", "庚区税务局", "征收管理科", "科长", None)]


def test_rosters_only_without_other_events(spark):
    text = "肖锋国家税务总局甲市税务局办公室主任（试用期一年）陈光才国家税务总局乙区税务局科长"
    assert [(r[1], r[3], r[5]) for r in found(spark, text)] == [("肖锋", "国家税务总局甲市税务局", "主任"), ("陈光才", "国家税务总局乙区税务局", "科长")]
    assert [r[1] for r in found(spark, text + "。赵健健任丙科科长")] == ["赵健健"]


def test_an_event_said_twice_counts_once(spark):
    assert len(found(spark, "任命赵健健为甲科科长；任命赵健健为甲科科长")) == 1


def test_posts(spark):
    posts = ["保税区税务分局法制科副科长", "国家税务总局人事司司长", "甲市税务局副局长、二级高级主办", "一级主办", "乙局（副处长级）所长职务", "", "丙市税务局（装备和采购处）处长"]
    rows = extract.split_posts(spark.createDataFrame(list(enumerate(posts)), "i int, p string"), "p").orderBy("i").collect()
    assert [(r["unit"], r["dept"], r["title"]) for r in rows] == [
        ("保税区税务分局", "法制科", "副科长"), ("国家税务总局", "人事司", "司长"), ("甲市税务局", None, "副局长、二级高级主办"), (None, None, "一级主办"), (None, "乙局", "所长"), (None, None, None), ("丙市税务局", "装备和采购处", "处长")]


def test_names(spark):
    names = ["赵健健", "欧阳·明", "任命", "关于某", "法制科", "沪税宝", "税小明", "甲", "一二三四五", None, "Li"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(persons.plausible_name(F.col("n"))).collect()]
    assert got == [True, True, False, False, False, False, True, False, False, False, False]
