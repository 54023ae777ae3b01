"""Queries of people, changes and their pages over events and leaders' duties, rows with gaps and bad names among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive, history, search
from .bindings import table
from .facades import _BAD, _LADDER, _LETTERS, _RANK, _UNITS, ZH, _bad, _units, zh_events
from .registry import query

# Leaders' duties out of suppliers: some without a title, with no, one or two departments.
DZ = f"""dz AS (SELECT s_suppkey AS id, s_nationkey AS bureau, '王' || substr('{_LETTERS}', s_suppkey % 10 + 1, 1) || substr('{_LETTERS}', (s_suppkey // 10) % 10 + 1, 1) AS person,
  CASE WHEN s_acctbal > 5000 THEN '局长' WHEN s_acctbal > 0 THEN '副局长' ELSE '' END AS title, CASE s_suppkey % 3 WHEN 0 THEN ['征管科', '法制科'] WHEN 1 THEN ['法制科'] ELSE [] END AS departments,
  CASE WHEN s_suppkey % 2 = 0 THEN '男' ELSE '女' END AS gender FROM supplier)"""


def zh_duties(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    letter = lambda n: F.substring(F.lit(_LETTERS), (n % 10 + 1).cast("int"), F.lit(1))
    i = F.col("s_suppkey")
    lists = F.when(i % 3 == 0, F.array(F.lit("征管科"), F.lit("法制科"))).when(i % 3 == 1, F.array(F.lit("法制科"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        i.alias("id"), F.col("s_nationkey").alias("bureau"), F.concat(F.lit("王"), letter(i), letter(F.floor(i / 10))).alias("person"),
        F.when(F.col("s_acctbal") > 5000, "局长").when(F.col("s_acctbal") > 0, "副局长").otherwise("").alias("title"), lists.alias("departments"), F.when(i % 2 == 0, "男").otherwise("女").alias("gender"))


# ---------------------------------------------------------------- changes
_GAPS = f"""{_BAD}, g AS (SELECT * REPLACE (CASE WHEN id % 23 = 0 THEN NULL ELSE day END AS day) FROM b WHERE person IS NOT NULL AND person <> '关于任免'),
gp AS (SELECT *, last_value(CASE WHEN action <> 'dismiss' AND title <> '' THEN title END IGNORE NULLS) OVER w AS prev_title, last_value(CASE WHEN action <> 'dismiss' THEN dept END IGNORE NULLS) OVER w AS prev_dept FROM g
  WINDOW w AS (PARTITION BY bureau, person ORDER BY day NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gc AS (SELECT *, CASE WHEN action = 'dismiss' THEN 'dismiss' WHEN prev_title IS NOT NULL AND coalesce({_LADDER.format('title')}, -1) > {_LADDER.format('prev_title')} THEN 'promote'
  WHEN prev_title IS NOT NULL AND prev_dept <> dept THEN 'transfer' WHEN prev_title <> title AND prev_dept = dept THEN 'promote' ELSE 'appoint' END AS change_type FROM gp)"""


def _gaps(spark, d):
    """Events with names that can't be, without names, titles, departments, or days (null, empty, no real day)."""
    return _bad(spark, d).withColumn("day", F.when(F.col("id") % 23 != 0, F.col("day")))


@query(f"WITH {_GAPS} SELECT id, bureau, person, change_type, prev_title, prev_dept, day FROM gc WHERE day IS NOT NULL AND day <= '1995-06-30'")
def changes_until_day(spark, d):
    """An upper day alone: rows without a day don't answer it."""
    return search.changes(_gaps(spark, d), end="1995-06-30").select("id", "bureau", "person", "change_type", "prev_title", "prev_dept", "day")


@query(f"WITH {_GAPS}, f AS (SELECT * FROM gc WHERE change_type IN ('promote', 'transfer', 'dismiss')) SELECT id, person, change_type, day, (SELECT count(*) FROM f) AS total FROM f ORDER BY coalesce(day, '') DESC, id DESC LIMIT 500")
def changes_all_bounded(spark, d):
    """Limit 0: all changes, but at most 500; rows without a day come last. The bound is the feature."""
    rows = search.changes(_gaps(spark, d), ["promote", "transfer", "dismiss"])
    return search.changes_page(rows, 0, 0).select("id", "person", "change_type", "day", "total")


_KNOWN = f"""{ZH}, k AS (SELECT * REPLACE (CASE WHEN id % 3 = 1 THEN 'noted' ELSE action END AS action) FROM zh), kn AS (SELECT *, row_number() OVER (PARTITION BY bureau, person ORDER BY day DESC, {_RANK}, id DESC) AS n FROM k),
kp AS (SELECT bureau, person, arg_min(action, n) FILTER (action <> 'noted') AS newest FROM kn GROUP BY 1, 2)"""


def _noted(spark, d):
    """Events a third of which are of no known type."""
    return zh_events(spark, d).withColumn("action", F.when(F.col("id") % 3 == 1, "noted").otherwise(F.col("action")))


@query(f"WITH {_KNOWN} SELECT bureau, person, coalesce(newest = 'dismiss', false) AS newest_is_leave FROM kp")
def people_newest_known_is_leave(spark, d):
    """Rows of no known type say nothing of a leave."""
    return history.newest_is_leave(_noted(spark, d))


@query(f"""WITH {_KNOWN}, o AS (SELECT * FROM (SELECT *, max(CASE WHEN action = 'dismiss' THEN n END) OVER (PARTITION BY bureau, person, title, dept ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM kn) WHERE action = 'appoint' AND closed IS NULL)
SELECT bureau, person, arg_min(title, n) AS title, arg_min(dept, n) AS dept, arg_min(day, n) AS since FROM o GROUP BY 1, 2""")
def people_current_known(spark, d):
    return history.current_posts(_noted(spark, d))


# ---------------------------------------------------------------- people by events and leaders' pages
_BY_BOTH = f"""{DZ}, led AS (SELECT bureau, person, arg_max(title, id) AS l_title, arg_max(departments, id) AS l_deps, arg_max(gender, id) AS gender FROM dz GROUP BY 1, 2),
pn AS (SELECT *, row_number() OVER (PARTITION BY bureau, person ORDER BY day DESC, {_RANK}, id DESC) AS n FROM zh),
pc AS (SELECT *, max(CASE WHEN action = 'dismiss' THEN n END) OVER (PARTITION BY bureau, person, title, dept ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM pn),
po AS (SELECT bureau, person, min(n) FILTER (action = 'appoint' AND closed IS NULL) AS o, min(n) FILTER (action = 'dismiss') AS l FROM pc GROUP BY 1, 2),
pp AS (SELECT po.bureau, po.person, o, l, title, dept, day, id FROM po LEFT JOIN pn ON pn.bureau = po.bureau AND pn.person = po.person AND pn.n = po.o),
pb AS (SELECT coalesce(pp.bureau, led.bureau) AS bureau, coalesce(pp.person, led.person) AS person, pp.* EXCLUDE (bureau, person), led.* EXCLUDE (bureau, person), led.person IS NOT NULL AS has_led, o IS NOT NULL AND NOT ({{bare}} AND coalesce(l_title, '') <> '') AS by_post,
  l IS NOT NULL AND (o IS NULL OR l < o) AS gone FROM pp FULL JOIN led ON led.bureau = pp.bureau AND led.person = pp.person),
now AS (SELECT bureau, person, CASE WHEN by_post THEN coalesce(title, l_title) ELSE l_title END AS title, CASE WHEN by_post THEN coalesce(dept, l_deps[1]) ELSE l_deps[1] END AS dept, coalesce(l_deps, []) AS departments,
  by_post OR (has_led AND NOT gone) AS is_current, CASE WHEN by_post THEN day END AS since, gender FROM pb)"""


@query(f"WITH {ZH}, {_BY_BOTH.format(bare='(pp.bureau <> 0 AND pp.id % 4 = 0)')} SELECT bureau, person, title, dept, array_to_string(departments, '、') AS departments, is_current, since, gender FROM now")
def people_now_by_leader(spark, d):
    """Leaders' pages win over appointments whose unit is only the head office, and tell of those who have no open appointment."""
    unit = F.when(F.col("id") % 4 == 0, " 国家税务总局").otherwise("甲市税务局")
    rows = history.people_now(zh_events(spark, d).withColumn("unit", unit), zh_duties(spark, d), head=0)
    return rows.withColumn("departments", F.array_join("departments", "、"))


_FOUND = f"""{ZH}, {_BY_BOTH.format(bare='false')}, {_UNITS},
h AS (SELECT bureau, person, 'leader_title:' || title AS reason, 'leader' AS source, NULL AS role FROM dz WHERE title = '局长' UNION ALL SELECT bureau, person, 'supervises:法制科', 'leader', 'supervisor' FROM dz WHERE list_contains(departments, '法制科')
  UNION ALL SELECT bureau, person, 'event_title:' || title, 'event', NULL FROM zh WHERE title = '局长' UNION ALL SELECT bureau, person, 'event_dept:' || dept, 'event', 'appointee' FROM zh WHERE dept = '法制科'),
g AS (SELECT bureau, person, list_sort(list(DISTINCT reason)) AS reasons, list_sort(list(DISTINCT source)) AS sources, coalesce(list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)), []) AS roles FROM h WHERE contains(person, '甲') GROUP BY 1, 2),
f AS (SELECT g.*, unit, level, title, dept, coalesce(is_current, false) AS is_current, since FROM g LEFT JOIN u USING (bureau) LEFT JOIN now USING (bureau, person)
  WHERE level = 'province' AND list_contains(roles, '{{role}}') AND (list_contains(roles, 'supervisor') OR EXISTS (SELECT 1 FROM zh WHERE zh.bureau = g.bureau AND zh.person = g.person AND zh.day BETWEEN '1996-01-01' AND '1996-03-31')))
SELECT person, bureau, unit, title, dept, is_current, since, array_to_string(reasons, ',') AS reasons, array_to_string(sources, ',') AS sources, array_to_string(roles, ',') AS roles, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f WHERE is_current) AS current_count
FROM f ORDER BY unit, CASE title WHEN '局长' THEN 20 WHEN '副局长' THEN 50 WHEN '处长' THEN 90 WHEN '科长' THEN 140 WHEN '科员' THEN 800 ELSE 900 END, person, bureau LIMIT 30 OFFSET 5"""


def _found(spark, d, role):
    rows = search.people_found(zh_events(spark, d), zh_duties(spark, d), _units(spark, d), "局长", "法制科", "甲", "province", None, "1996-01-01", "1996-03-31", role)
    found = search.people_page(rows, 5, 30)  # the page is the feature
    lists = {c: F.array_join(c, ",") for c in ("reasons", "sources", "roles")}
    return found.withColumns(lists).select("person", "bureau", "unit", "title", "dept", "is_current", "since", "reasons", "sources", "roles", "total", "current_count")


@query("WITH " + _FOUND.format(role="appointee"))
def people_page_of_appointees(spark, d):
    """Title, department, name, level, days and role at once."""
    return _found(spark, d, "appointee")


@query("WITH " + _FOUND.format(role="supervisor"))
def people_page_of_supervisors(spark, d):
    return _found(spark, d, "supervisor")


@query(f"""WITH {ZH}, {_BY_BOTH.format(bare='false')}, {_UNITS}, f AS (SELECT bureau, person, title, is_current, unit, level FROM now JOIN u USING (bureau) WHERE bureau IN (1, 5, 7, 9, 13))
SELECT *, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f WHERE is_current) AS current_count FROM f""")
def people_browsed(spark, d):
    """Everyone of some bureaus, without texts to look for."""
    rows = search.people_found(zh_events(spark, d), zh_duties(spark, d), _units(spark, d), bureaus=[1, 5, 7, 9, 13])
    return search.people_page(rows, 0, None).select("bureau", "person", "title", "is_current", "unit", "level", "total", "current_count")


# ---------------------------------------------------------------- archives
_TERMS = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bureau, dept, person, action, title, day ORDER BY id) AS again FROM {rows}) WHERE again = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY day, id) AS n FROM d),
w AS (SELECT *, lead(n) OVER p AS own, lead(day) OVER p AS own_day, lead(action) OVER p AS own_act, CASE WHEN NOT contains(title, '副') THEN min(CASE WHEN action = 'appoint' THEN n END) OVER (PARTITION BY {keys}, dept, title ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS nxt
  FROM n WINDOW p AS (PARTITION BY {keys}, person ORDER BY n)),
t AS (SELECT w.bureau, w.dept AS post_dept, w.person, w.title, w.id, w.day AS since, CASE WHEN nxt < coalesce(own, 9223372036854775807) THEN x.day ELSE own_day END AS ended_on,
  CASE WHEN nxt < coalesce(own, 9223372036854775807) THEN 'succeeded' WHEN own_act = 'dismiss' THEN 'dismiss' WHEN own IS NOT NULL THEN 'replaced' END AS end_change_type, nxt IS NULL AND own IS NULL AS is_current,
  coalesce(own < coalesce(nxt, 9223372036854775807) OR own = nxt, false) AND own_act = 'appoint' AND own_day = w.day AS hidden FROM w LEFT JOIN n x ON {same} AND x.n = w.nxt WHERE w.action = 'appoint')"""
_ALL_TERMS = _TERMS.format(rows="zh", keys="bureau, dept", same="x.bureau = w.bureau AND x.dept = w.dept")
_ONE = _TERMS.format(rows="(SELECT * FROM zh WHERE bureau = 7 AND contains(title, '局长') AND dept = '法制科')", keys="bureau", same="x.bureau = w.bureau")


@query(f"WITH {ZH}, {_ALL_TERMS} SELECT * EXCLUDE (hidden) FROM t WHERE NOT hidden")
def post_archives(spark, d):
    """The terms of every bureau's every department, straight from events."""
    return archive.archives(zh_events(spark, d))


@query(f"WITH {ZH}, {_ONE} SELECT * EXCLUDE (hidden) FROM t WHERE NOT hidden")
def post_archive_of_department(spark, d):
    """One bureau's department, its chiefs and their deputies; the name is written with blanks."""
    return archive.post_archive(zh_events(spark, d), 7, "法 制科", "局长")
