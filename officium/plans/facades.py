"""Queries of extraction, search, anomalies and repair, on the driver's tables in the domain's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import titles
from ..operators import extract, history, repair, search
from .bindings import table
from .registry import query

_TITLES = {"1-URGENT": "局长", "2-HIGH": "副局长", "3-MEDIUM": "处长", "4-NOT SPECIFIED": "科长", "5-LOW": "科员"}
_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TITLES.items()) + " END"
_LETTERS = "甲乙丙丁戊己庚辛壬癸"

ZH = f"""zh AS (SELECT o_orderkey AS id, c_nationkey AS bureau, '王' || substr('{_LETTERS}', c_custkey % 10 + 1, 1) || substr('{_LETTERS}', (c_custkey // 10) % 10 + 1, 1) AS person,
  CASE WHEN o_orderstatus = 'F' THEN 'dismiss' ELSE 'appoint' END AS action, {_CASE} AS title, CASE WHEN o_orderkey % 3 = 0 THEN '法制科' ELSE '征管科' END AS dept, strftime(o_orderdate, '%Y-%m-%d') AS day
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def zh_events(spark, d):
    """Orders as appointment events with Chinese names, titles and departments."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    rows = orders.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    letter = lambda n: F.substring(F.lit(_LETTERS), (n % 10 + 1).cast("int"), F.lit(1))
    title = F.create_map(*[F.lit(x) for kv in _TITLES.items() for x in kv])[F.col("o_orderpriority")]
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("bureau"), F.concat(F.lit("王"), letter(F.col("c_custkey")), letter(F.floor(F.col("c_custkey") / 10))).alias("person"),
        F.when(F.col("o_orderstatus") == "F", "dismiss").otherwise("appoint").alias("action"), title.alias("title"), F.when(F.col("o_orderkey") % 3 == 0, "法制科").otherwise("征管科").alias("dept"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


# ---------------------------------------------------------------- events out of texts
@query(f"""WITH {ZH} SELECT id AS notice_id, 1 AS n, person, action, CASE WHEN action = 'appoint' THEN '甲市税务局' ELSE '乙区税务局' END AS unit, dept, CASE WHEN title = '科员' THEN NULL WHEN title = '副局长' AND action = 'appoint' THEN '副局长、二级高级主办' ELSE title END AS title,
CASE WHEN action = 'appoint' AND id % 2 = 0 THEN 1 END AS probation_years FROM zh WHERE title <> '科员'""")
def notice_events_extracted(spark, d):
    """Notices' texts made from events, and the events found in them again. A text about 科员, which is no known title, is left out."""
    ev = zh_events(spark, d).where("title <> '科员'")
    rank = F.when(F.col("title") == "副局长", "、二级高级主办").otherwise("")
    named = F.concat(F.lit("首页 公告。经研究决定：任命"), "person", F.lit("为甲市税务局"), "dept", "title", rank, F.when(F.col("id") % 2 == 0, "，任职试用期为一年。").otherwise("；"))
    left = F.concat(F.lit("经研究决定：免去"), "person", F.lit("同志的乙区 税务局"), "dept", "title", F.lit("职务。任命决定"))
    notices = ev.select(F.col("id").alias("notice_id"), F.when(F.col("action") == "appoint", named).otherwise(left).alias("text"))
    return extract.appointment_events(notices).drop("clause")


@query(f"""WITH {ZH} SELECT id AS notice_id, person, action, CASE WHEN action = 'appoint' THEN '甲市税务局' ELSE '乙区税务局' END AS unit, CASE WHEN title = '科员' THEN dept || title ELSE dept END AS dept, CASE WHEN title <> '科员' THEN title END AS title FROM zh""")
def notice_events_of_all(spark, d):
    """The same of all events: 科员 is no known title, so it stays at the end of the department, and the event has none."""
    ev = zh_events(spark, d)
    named = F.concat(F.lit("经研究决定：任命"), "person", F.lit("为甲市税务局"), "dept", "title", F.lit("；"))
    left = F.concat(F.lit("经研究决定：免去"), "person", F.lit("同志的乙区税务局"), "dept", "title", F.lit("职务。"))
    notices = ev.select(F.col("id").alias("notice_id"), F.when(F.col("action") == "appoint", named).otherwise(left).alias("text"))
    return extract.appointment_events(notices).select("notice_id", "person", "action", "unit", "dept", "title")


# ---------------------------------------------------------------- changes and people
_LADDER = "CASE {} WHEN '局长' THEN 10 WHEN '副局长' THEN 10 WHEN '处长' THEN 6 WHEN '科长' THEN 2 WHEN '科员' THEN 0 END"
_CHANGES = f"""{ZH}, p AS (SELECT *, last_value(CASE WHEN action <> 'dismiss' THEN title END IGNORE NULLS) OVER w AS prev_title, last_value(CASE WHEN action <> 'dismiss' THEN dept END IGNORE NULLS) OVER w AS prev_dept FROM zh
  WINDOW w AS (PARTITION BY bureau, person ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ch AS (SELECT *, CASE WHEN action = 'dismiss' THEN 'dismiss' WHEN prev_title IS NOT NULL AND {_LADDER.format('title')} > {_LADDER.format('prev_title')} THEN 'promote' WHEN prev_dept <> dept THEN 'transfer' WHEN prev_title <> title AND prev_dept = dept THEN 'promote' ELSE 'appoint' END AS change_type FROM p)"""


@query(f"WITH {_CHANGES} SELECT change_type, count(*) AS n, min(id) AS first_id FROM ch GROUP BY 1")
def change_types_classified(spark, d):
    return search.changes(zh_events(spark, d)).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(f"""WITH {_CHANGES}, f AS (SELECT * FROM ch WHERE change_type IN ('promote', 'transfer') AND day BETWEEN '1994-01-01' AND '1997-12-31' AND bureau IN (1, 2, 3, 5, 8) AND (contains(person, '甲') OR contains(dept, '甲') OR contains(title, '甲')))
SELECT id, person, change_type, prev_title, title, day, (SELECT count(*) FROM f) AS total FROM f ORDER BY day DESC, id DESC LIMIT 50 OFFSET 10""")
def change_feed_page(spark, d):
    rows = search.changes(zh_events(spark, d), ["promote", "transfer"], [1, 2, 3, 5, 8], "1994-01-01", "1997-12-31", "甲")
    found = search.page(rows, [F.desc("day"), F.desc("id")], 10, 50)  # the page is the feature
    return found.select("id", "person", "change_type", "prev_title", "title", "day", "total")


_RANK = "CASE title WHEN '局长' THEN 20 WHEN '副局长' THEN 50 WHEN '处长' THEN 90 WHEN '科长' THEN 140 ELSE 800 END"
_NOW = f"""{ZH}, n AS (SELECT *, row_number() OVER (PARTITION BY bureau, person ORDER BY day DESC, {_RANK}, id DESC) AS n FROM zh),
o AS (SELECT * FROM (SELECT *, max(CASE WHEN action = 'dismiss' THEN n END) OVER (PARTITION BY bureau, person, title, dept ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM n) WHERE action = 'appoint' AND closed IS NULL),
now AS (SELECT bureau, person, arg_min(title, n) AS title, arg_min(dept, n) AS dept, arg_min(day, n) AS since FROM o GROUP BY 1, 2)"""
_UNITS = "u AS (SELECT n_nationkey AS bureau, n_name AS unit, ['headquarters', 'province', 'city', 'district'][1 + n_nationkey % 4] AS level FROM nation)"


def _units(spark, d):
    level = F.element_at(F.array(*[F.lit(x) for x in ("headquarters", "province", "city", "district")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("bureau"), F.col("n_name").alias("unit"), level.alias("level"))


@query(f"WITH {_NOW} SELECT * FROM now")
def people_current_by_rank(spark, d):
    return history.current_posts(zh_events(spark, d))


@query(f"""WITH {_NOW}, {_UNITS}, f AS (SELECT person, bureau, unit, level, title, dept, since FROM now JOIN u USING (bureau) WHERE (title = '局长' OR (contains(title, '局长') AND NOT contains(title, '副局长'))) AND contains(dept, '征管') AND level IN ('province', 'city', 'district'))
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY CASE level WHEN 'province' THEN 1 WHEN 'city' THEN 2 ELSE 3 END, unit, person, bureau LIMIT 40""")
def people_search_page(spark, d):
    rows = search.people(zh_events(spark, d), _units(spark, d), "局长", "征管", None, ["province", "city", "district"])
    found = search.page(rows, [F.col("rank_level"), F.col("unit"), F.col("rank_title"), F.col("person"), F.col("bureau")], 0, 40)  # the page is the feature
    return found.select("person", "bureau", "unit", "level", "title", "dept", "since", "total")


@query(f"WITH {ZH}, n AS (SELECT *, row_number() OVER (PARTITION BY bureau, person ORDER BY day DESC, {_RANK}, id DESC) AS n FROM zh) SELECT bureau, person, action = 'dismiss' AS newest_is_leave FROM n WHERE n = 1")
def people_newest_is_leave(spark, d):
    return history.newest_is_leave(zh_events(spark, d))


_DAY = "coalesce(CASE WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderkey % 5 < 4 THEN substr(strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d 08:00'), 1, 10) END, '')"


@query(f"SELECT o_orderkey, {_DAY} AS day FROM orders WHERE (contains(o_orderpriority, '3') OR contains(coalesce(o_orderstatus, ''), '3')) AND CASE WHEN {_DAY} = '' THEN true ELSE {_DAY} <= '1995-06-30' END")
def notices_searched(spark, d):
    """By any of two columns and an upper day alone, so that undated ones stay."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate").where(search.any_contains(["o_orderpriority", "o_orderstatus"], "3"))
    issued, published = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.expr("o_orderdate + INTERVAL 1 DAY"), "yyyy-MM-dd 08:00")
    day = search.issued_day(F.when(F.col("o_orderkey") % 5 == 1, issued), F.when(F.col("o_orderkey") % 5 < 4, published))
    return rows.select("o_orderkey", day.alias("day")).where(search.within_days(F.col("day"), None, "1995-06-30"))


@query(f"WITH {ZH}, m AS (SELECT *, CASE WHEN title = '局长' AND dept = '法制科' THEN 2 WHEN title = '局长' THEN 1 ELSE 0 END AS q FROM zh WHERE bureau = 7 AND (title = '局长' OR contains(title, '局长')) AND replace(replace(dept, ' ', ''), '　', '') LIKE '%科%') SELECT id, person, title, dept FROM m WHERE q = (SELECT max(q) FROM m)")
def posts_prefer_exact(spark, d):
    rows = zh_events(spark, d).where((F.col("bureau") == 7) & F.col("title").contains("局长") & search.same_compact(F.col("dept"), " 科　", inside=True))
    return search.prefer_exact(rows, "局长", "法制科").select("id", "person", "title", "dept")


@query("""WITH names AS (SELECT n_name AS name, n_nationkey AS key, n_nationkey AS place FROM nation UNION ALL SELECT split_part(n_name, ' ', 1), n_nationkey, n_nationkey + 100 FROM nation WHERE n_name LIKE '% %'),
t AS (SELECT c_custkey, 'HEAD ' || n_name || ' OFFICE ' || c_mktsegment AS text FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'UNITED ' || c_mktsegment FROM customer WHERE c_custkey % 2 = 1)
SELECT c_custkey, arg_max(key, (length(name), -place)) AS key FROM t LEFT JOIN names ON contains(text, name) GROUP BY 1""")
def unit_longest_match(spark, d):
    nation = table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("n"))
    short = nation.where(F.col("n_name").contains(" ")).select(F.split_part("n_name", F.lit(" "), F.lit(1)), "n", F.col("n") + 100)
    names = nation.select("n_name", "n", "n").union(short).toDF("name", "key", "place")
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n"))
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("HEAD "), "n_name", F.lit(" OFFICE "), "c_mktsegment")).otherwise(F.concat(F.lit("UNITED "), "c_mktsegment"))
    return search.longest_match(rows.select("c_custkey", text.alias("text")), names).select("c_custkey", "key")


@query(f"WITH {ZH} SELECT title AS title, count(*) AS n FROM zh WHERE length(title) <= 60 GROUP BY 1")
def title_catalog(spark, d):
    named = zh_events(spark, d).select(titles.normalize_title(F.concat(F.col("title"), F.lit("（正处级）")))["canonical"].alias("title"))
    return named.where(F.length("title") <= 60).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- anomalies and repair
_BAD = f"""{ZH}, b AS (SELECT id, bureau, CASE WHEN id % 7 = 0 THEN '关于任免' WHEN id % 11 = 0 THEN NULL ELSE person END AS person, action, CASE WHEN id % 5 = 0 THEN '' ELSE title END AS title, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 13 = 0 THEN '任命通知' ELSE dept END AS dept,
  CASE WHEN id % 17 = 0 THEN '' WHEN id % 19 = 0 THEN '1995-02-30' ELSE day END AS day FROM zh)"""


def _bad(spark, d):
    i = F.col("id")
    return zh_events(spark, d).withColumns({
        "person": F.when(i % 7 == 0, "关于任免").when(i % 11 == 0, None).otherwise(F.col("person")), "title": F.when(i % 5 == 0, "").otherwise(F.col("title")),
        "dept": F.when(i % 10 == 0, None).when(i % 13 == 0, "任命通知").otherwise(F.col("dept")), "day": F.when(i % 17 == 0, "").when(i % 19 == 0, "1995-02-30").otherwise(F.col("day"))})


@query(f"""WITH {_BAD}, a AS (SELECT id, bureau, person, unnest([CASE WHEN id % 7 = 0 OR person IS NULL THEN ['implausible_name', 'error'] END, CASE WHEN title = '' AND dept IS NULL THEN ['missing_fields', 'warn'] END, CASE WHEN day = '' THEN ['missing_date', 'warn'] END,
CASE WHEN day = '1995-02-30' THEN ['bad_date', 'warn'] END, CASE WHEN day NOT IN ('', '1995-02-30') AND (day < '1994-01-01' OR day > '1998-06-01') THEN ['date_anomaly', 'warn'] END, CASE WHEN dept = '任命通知' THEN ['parse_noise', 'warn'] END]) AS x FROM b)
SELECT x[1] AS kind, x[2] AS severity, 'appointment_event' AS target_type, CAST(id AS VARCHAR) AS target_id, bureau, person FROM a WHERE x IS NOT NULL""")
def event_anomalies_scan(spark, d):
    return repair.event_anomalies(_bad(spark, d), "1997-06-01")


@query(f"""WITH {ZH} SELECT bureau, person, day, min(id) AS first_id, count(*) AS n FROM (SELECT bureau, person, substr(day, 1, 7) AS day, id, action, title, dept FROM zh) GROUP BY 1, 2, 3
HAVING bool_or(action = 'appoint') AND bool_or(action = 'dismiss') AND count(DISTINCT (title, dept)) <= 2""")
def event_conflicts(spark, d):
    """By month, as the driver's days seldom hold two events of a person."""
    return repair.conflicts(zh_events(spark, d).withColumn("day", F.substring("day", 1, 7)))


@query(f"""WITH {ZH} SELECT bureau, person, day, min(id) AS first_id, count(*) AS n FROM (SELECT bureau, person, substr(day, 1, 7) || '-01' AS day, id, action, title, dept FROM zh) GROUP BY 1, 2, 3
HAVING bool_or(action = 'appoint') AND bool_or(action = 'dismiss') AND count(DISTINCT (title, dept)) <= 2""")
def event_conflicts_on_days(spark, d):
    """Events of a month on its first day, with times after some days, and some without a day."""
    day = F.concat(F.substring("day", 1, 7), F.lit("-01"), F.when(F.col("id") % 2 == 0, " 08:00").otherwise(""))
    rows = zh_events(spark, d).withColumn("day", day)
    return repair.conflicts(rows.unionByName(rows.withColumn("day", F.when(F.col("id") % 2 == 0, ""))))


@query(f"""WITH {ZH}, s AS (SELECT id, bureau, person, action, dept, title, substr(day, 1, 4) AS day, CASE WHEN id % 4 = 1 THEN 'unit' || id % 8 ELSE ' ' END AS unit, repeat('x', CAST(id % 9 AS INTEGER)) AS clause FROM zh),
n AS (SELECT *, row_number() OVER (k ORDER BY trim(unit) <> '' DESC, length(clause) DESC, id) AS n, arg_min(CASE WHEN trim(unit) <> '' THEN unit END, CASE WHEN trim(unit) <> '' THEN id END) OVER (k) AS first_unit FROM s WINDOW k AS (PARTITION BY bureau, person, action, dept, title, day))
SELECT id, bureau, person, action, dept, title, day, CASE WHEN trim(unit) <> '' THEN unit ELSE first_unit END AS unit, clause FROM n WHERE n = 1""")
def event_semantic_dedupe(spark, d):
    rows = zh_events(spark, d).select(
        "id", "bureau", "person", "action", "dept", "title", F.substring("day", 1, 4).alias("day"), F.when(F.col("id") % 4 == 1, F.concat(F.lit("unit"), F.col("id") % 8)).otherwise(" ").alias("unit"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("clause"))
    return repair.dedupe_events(rows)
