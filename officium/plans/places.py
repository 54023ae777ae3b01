"""Queries of units, departments, names, registries and pages, on the driver's tables in the domain's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, repair, units
from ..operators import sites as audits
from ..sources import adapters, leaders
from .bindings import table
from .facades import _LETTERS, _NOW, ZH, zh_events
from .registry import query

_AT = f"substr('{_LETTERS}', n_nationkey % 10 + 1, 1) || substr('{_LETTERS}', n_nationkey // 10 + 1, 1)"
_SITES = f"""sites AS (SELECT n_nationkey AS code, CASE WHEN n_nationkey = 0 THEN '国家税务总局' ELSE '国家税务总局' || {_AT} || ['省', '市', '区'][1 + n_nationkey % 3] || '税务局' END AS name,
  CASE WHEN n_nationkey = 0 THEN 'headquarters' ELSE ['province', 'city', 'district'][1 + n_nationkey % 3] END AS level, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey - 1 END AS parent FROM nation)"""
_SHORT = "replace(replace({}, '国家税务总局', ''), '税务局', '')"


def _sites(spark, d):
    n = F.col("n_nationkey").cast("int")
    letter = lambda k: F.substring(F.lit(_LETTERS), k + 1, F.lit(1))
    of = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), n % 3 + 1)
    name = F.concat(F.lit("国家税务总局"), letter(n % 10), letter(F.floor(n / 10).cast("int")), of("省", "市", "区"), F.lit("税务局"))
    return table(spark, d, "nation").select(
        n.alias("code"), F.when(n == 0, "国家税务总局").otherwise(name).alias("name"), F.when(n == 0, "headquarters").otherwise(of("province", "city", "district")).alias("level"), F.when(n % 3 > 0, n - 1).alias("parent"), n.alias("place"))


# Units as events name them: none, the bureau's own, a branch, with debris, the head, not registered, a title alone.
_UNIT = """CASE id % 7 WHEN 1 THEN name WHEN 2 THEN name || '第一税务分局' WHEN 3 THEN name || '法制科副局长，同时免去甲' WHEN 4 THEN '国家税务总局' WHEN 5 THEN '丑寅县税务局' WHEN 6 THEN '局长' END"""
_HITS = f"{ZH}, {_SITES}, hits AS (SELECT id, (bureau + id) % 25 AS bureau, person, title, CASE id % 5 WHEN 0 THEN '驻外处' WHEN 1 THEN '教育中心' WHEN 2 THEN '' ELSE dept END AS dept, {_UNIT} AS unit FROM zh JOIN sites ON bureau = code)"


def _hits(spark, d):
    name, i = F.col("name"), F.col("id") % 7
    rows = zh_events(spark, d).join(F.broadcast(_sites(spark, d)), F.col("bureau") == F.col("code"))
    unit = (F.when(i == 1, name).when(i == 2, F.concat(name, F.lit("第一税务分局"))).when(i == 3, F.concat(name, F.lit("法制科副局长，同时免去甲"))).when(i == 4, "国家税务总局").when(i == 5, "丑寅县税务局").when(i == 6, "局长"))
    k = F.col("id") % 5
    dept = F.when(k == 0, "驻外处").when(k == 1, "教育中心").when(k == 2, "").otherwise(F.col("dept"))
    return rows.select("id", ((F.col("bureau") + F.col("id")) % 25).cast("int").alias("bureau"), "person", "title", dept.alias("dept"), unit.alias("unit"))


_NAMED = f"""{_HITS}, names AS (SELECT unnest([name, {_SHORT.format('name')} || '税务局', {_SHORT.format('name')}]) AS form, code FROM sites WHERE level <> 'headquarters'),
texts AS (SELECT DISTINCT unit FROM hits WHERE unit IS NOT NULL), best AS (SELECT unit, arg_max(code, (length(form), -code)) AS named FROM texts JOIN names ON contains(unit, form) GROUP BY 1),
nd AS (SELECT h.*, coalesce(b.named, CASE WHEN h.unit LIKE '国家税务总局%' AND NOT regexp_matches(substr(h.unit, 7), '税务局|税务分局|稽查局|省|市|区|县') THEN 0 END) AS named FROM hits h LEFT JOIN best b ON h.unit = b.unit)"""


@query(f"""WITH {_NAMED}, l AS (SELECT nd.*, coalesce(a.level, CASE WHEN unit LIKE '%税务分局%' THEN 'district' WHEN unit LIKE '%县税务局%' THEN 'district' END, o.level) AS org_level,
  CASE WHEN named IS NOT NULL THEN a.name WHEN NOT (bureau = 0 AND unit IS NOT NULL) THEN o.name END AS nm, o.name AS own FROM nd LEFT JOIN sites a ON a.code = named JOIN sites o ON o.code = bureau)
SELECT id, coalesce(named, bureau) AS posting_bureau, org_level, CASE WHEN contains(dept, '驻') THEN 'dispatched' WHEN org_level = 'headquarters' THEN CASE WHEN contains(dept, '中心') THEN 'direct' ELSE 'internal' END WHEN org_level = 'province' THEN 'province' ELSE '' END AS category,
CASE id % 7 WHEN 0 THEN CASE bureau WHEN 0 THEN '国家税务总局' ELSE {_SHORT.format('own')} END WHEN 2 THEN {_SHORT.format('unit')} WHEN 4 THEN '国家税务总局' WHEN 5 THEN '丑寅县' WHEN 6 THEN CASE bureau WHEN 0 THEN '国家税务总局' ELSE {_SHORT.format('own')} END
  ELSE CASE named WHEN 0 THEN '国家税务总局' ELSE {_SHORT.format('nm')} END END AS unit_display FROM l WHERE NOT (id % 7 IN (2, 3) AND named = 0) AND NOT (id % 7 IN (1, 2, 3) AND unit LIKE '国家税务总局第一%') AND NOT (id % 7 = 3 AND unit LIKE '国家税务总局法制%')""")
def posting_units_displayed(spark, d):
    """Where people work, out of the units that events name. Branches and debris of the head itself, which no rule reads, are left out."""
    rows = units.displayed(_hits(spark, d), _sites(spark, d)).where("NOT (id % 7 IN (1, 2, 3) AND (unit LIKE '国家税务总局第一%' OR unit LIKE '国家税务总局法制%'))")
    return rows.select("id", "posting_bureau", "org_level", "category", "unit_display")


@query(f"""WITH {_SITES}, o AS (SELECT code, parent, level, CASE level WHEN 'headquarters' THEN 'internal' WHEN 'province' THEN 'province' ELSE '' END AS cat FROM sites)
SELECT o.code FROM o LEFT JOIN o p ON p.code = o.parent WHERE o.level <> 'headquarters' AND (o.cat = 'province' OR p.cat = 'province')""")
def bureaus_of_category(spark, d):
    return units.codes_of_category(_sites(spark, d), "province")


# ---------------------------------------------------------------- departments
_DUTIES = """duties AS (SELECT s_suppkey AS id, s_nationkey AS bureau, '李' || s_suppkey % 40 AS person, ['法制科', '征管科', '所得税处'][1 + s_suppkey % 3] AS d1, ['税政科', '法制', '收入核算处'][1 + (s_suppkey // 3) % 3] AS d2 FROM supplier)"""


def _duties(spark, d):
    i = F.col("s_suppkey")
    of = lambda k, *words: F.element_at(F.array(*[F.lit(w) for w in words]), (k % 3 + 1).cast("int"))
    return table(spark, d, "supplier").select(
        i.alias("id"), F.col("s_nationkey").cast("int").alias("bureau"), F.concat(F.lit("李"), i % 40).alias("person"), F.lit("副局长").alias("title"), F.lit("分管工作").alias("duty_summary"),
        F.array(of(i, "法制科", "征管科", "所得税处"), of(F.floor(i / 3), "税政科", "法制", "收入核算处")).alias("departments"), F.lit(None).cast("string").alias("url"))


@query(f"""WITH {_SITES}, {_DUTIES} SELECT id, bureau, person, (CASE WHEN contains(d1, '法制') THEN d1 ELSE '' END) || (CASE WHEN contains(d2, '法制') THEN d2 ELSE '' END) AS matched, level, parent FROM duties JOIN sites ON code = bureau WHERE contains(d1, '法制') OR contains(d2, '法制')""")
def department_supervisors(spark, d):
    rows = units.supervisors(_duties(spark, d), _sites(spark, d), "法制")
    return rows.select("id", "bureau", "person", F.array_join("matched", "").alias("matched"), "level", "parent")


@query(f"""WITH {_NOW}, {_DUTIES}, lt AS (SELECT bureau, person, arg_max(d1, id) AS d1, arg_max(d2, id) AS d2 FROM duties GROUP BY 1, 2)
SELECT now.bureau, now.person, title, dept, CASE WHEN lt.person IS NULL THEN 'appointee' ELSE 'appointee,leader' END AS roles FROM now LEFT JOIN lt ON lt.bureau = now.bureau AND lt.person = now.person WHERE contains(dept, '征管')""")
def department_staff(spark, d):
    people = history.current_posts(zh_events(spark, d)).withColumn("bureau", F.col("bureau").cast("int"))
    return units.staff(people, _duties(spark, d), _sites(spark, d), "征管").select("bureau", "person", "title", "dept", F.array_join("roles", ",").alias("roles"))


@query(f"WITH {_DUTIES} SELECT bureau, person, '副局长' AS title, arg_max(d1, id) || '、' || arg_max(d2, id) AS departments, 'leader_duties' AS source FROM duties WHERE person = '李7' GROUP BY 1, 2")
def leader_departments(spark, d):
    found = units.overseen(_duties(spark, d), history.current_posts(zh_events(spark, d)).withColumn("bureau", F.col("bureau").cast("int")), "李7", or_tenure=True)
    return found.withColumn("departments", F.array_join("departments", "、"))


@query(f"WITH {_NOW} SELECT bureau, person, title, dept AS departments, 'person_tenure' AS source FROM now WHERE person = '王甲乙'")
def leader_departments_by_tenure(spark, d):
    found = units.overseen(_duties(spark, d), history.current_posts(zh_events(spark, d)).withColumn("bureau", F.col("bureau").cast("int")), "王甲乙", or_tenure=True)
    return found.withColumn("departments", F.array_join("departments", "、"))


@query(f"WITH {ZH}, {_SITES}, m AS (SELECT zh.* FROM zh JOIN sites ON code = bureau WHERE person = '王乙甲' AND bureau <> 4 AND level = 'city') SELECT id, bureau, action, title, day FROM m")
def profile_of_namesakes(spark, d):
    """A person whose own bureau, 4, has no event of theirs."""
    return units.profile_events(zh_events(spark, d).where("bureau <> 4"), _sites(spark, d), 4, "王乙甲").select("id", "bureau", "action", "title", "day")


# ---------------------------------------------------------------- names and codes
_CUT = f"{ZH}, c AS (SELECT id, bureau, CASE WHEN id % 3 = 0 THEN substr(person, 2) WHEN id % 3 = 1 THEN '任命' || substr(person, 2) ELSE person END AS person, '任命' || person || CASE WHEN id % 3 = 0 THEN '同志' ELSE '' END || '为法制科' || title AS clause FROM zh)"


def _cut(spark, d):
    rest, k = F.substring("person", 2, 9), F.col("id") % 3
    clause = F.concat(F.lit("任命"), F.col("person"), F.when(k == 0, "同志").otherwise(""), F.lit("为法制科"), F.col("title"))
    return zh_events(spark, d).select("id", "bureau", F.when(k == 0, rest).when(k == 1, F.concat(F.lit("任命"), rest)).otherwise(F.col("person")).alias("person"), clause.alias("clause"))


@query(f"WITH {_CUT} SELECT id, bureau, substr(clause, 3, 3) AS person FROM c")
def names_repaired(spark, d):
    """Names that the clause completes, and those that aren't names and are found in it again."""
    rows = repair.full_names(repair.misnamed(_cut(spark, d)))
    return rows.select("id", "bureau", F.coalesce("full", "person").alias("person"))


@query(f"WITH {_NAMED} SELECT id, CASE WHEN bureau = 0 AND named IS NOT NULL THEN named ELSE bureau END AS bureau FROM nd WHERE NOT coalesce(unit LIKE '国家税务总局第一%' OR unit LIKE '国家税务总局法制%', false)")
def events_remapped(spark, d):
    rows = _hits(spark, d).where("NOT coalesce(unit LIKE '国家税务总局第一%' OR unit LIKE '国家税务总局法制%', false)")
    return repair.remap_local(rows, _sites(spark, d)).select("id", "bureau")


@query("SELECT 'customer' AS source, c_nationkey AS code, count(*) AS n FROM customer WHERE c_nationkey >= 15 GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier WHERE s_nationkey >= 15 GROUP BY 2")
def codes_unregistered(spark, d):
    kept = table(spark, d, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("code"))
    return repair.unregistered({"customer": (table(spark, d, "customer"), "c_nationkey"), "supplier": (table(spark, d, "supplier"), "s_nationkey")}, kept)


@query("""WITH p AS (SELECT c_nationkey AS bureau, c_custkey AS person, CASE WHEN c_custkey % 4 = 0 THEN 'i' || c_custkey // 12 ELSE c_nationkey || ':' || c_custkey END AS identity_id FROM customer)
SELECT a.identity_id, a.bureau, a.person, b.bureau AS other_bureau, b.person AS other_person FROM p a JOIN p b ON a.identity_id = b.identity_id AND (a.bureau, a.person) <> (b.bureau, b.person)""")
def identity_appearances(spark, d):
    known = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("i"), F.floor(F.col("c_custkey") / 12))).when(F.col("c_custkey") % 4 == 1, " ")
    people = table(spark, d, "customer").select(F.col("c_nationkey").alias("bureau"), F.col("c_custkey").alias("person"), known.alias("identity_id"))
    return repair.appearances(repair.identities(people))


# ---------------------------------------------------------------- lists, registries, pages
_ITEMS = "SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderstatus || o_orderkey AS title, 'https://a/' || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"


def _lists(spark, d, item, before, between, after):
    """Each customer's orders as a list's text."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), "o_orderstatus", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("t"))
    return rows.groupBy("path").agg(F.concat(F.lit(before), F.array_join(F.collect_list(F.format_string(item, "o_orderstatus", "o_orderkey", "o_orderkey", "t")), between), F.lit(after)).alias("text"))


@query(_ITEMS)
def list_items_xml(spark, d):
    lists = _lists(spark, d, "<REC><TITLE><![CDATA[%s%d]]></TITLE><URL>http://a/%d</URL><DOCRELTIME>%s</DOCRELTIME></REC>", "<RECS>", "", "</RECS>")
    return adapters.xml_items(lists).select("path", "title", "url", "day")


@query(_ITEMS)
def list_items_json(spark, d):
    """Every other list is cut off at its end, and is no JSON."""
    lists = _lists(spark, d, '{"title": "%s%d", "url": "http://a/%d", "time": "%s"}', "{\"py\": '###0###', \"docs\": [", ", ", "]}")
    cut = F.when(F.col("path").cast("int") % 2 == 1, F.expr("left(text, length(text) - 2)")).otherwise(F.col("text"))
    return adapters.json_items(lists.withColumn("text", cut)).select("path", "title", "url", "day")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS code, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'new' || c_custkey END, CASE WHEN c_custkey % 3 <> 0 THEN c_name END, CAST(c_custkey AS VARCHAR)) AS name, CASE WHEN c_custkey % 5 = 1 THEN 'district' ELSE 'city' END AS level,
'https://a.cn/' || c_custkey || '/' AS home_url, 'https://a.cn/' || c_custkey || '/xxgk/rsrm/' AS list_url, 'https://a.cn/' || c_custkey || '/xxgk/ldjj/' AS leader_url FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""")
def site_registry_merged(spark, d):
    """Registry entries merged with newer ones, then read as sites."""
    people, none = table(spark, d, "customer"), F.lit(None).cast("string")
    code = F.col("c_custkey").cast("string")
    level = F.when(F.col("c_custkey") % 5 == 1, "district").when(F.col("c_custkey") % 5 == 2, "province")

    def entries(rows, name):
        return rows.select(code.alias("code"), name.alias("name"), level.alias("level"), none.alias("parent"), none.alias("home_url"), F.concat(F.lit("https://a.cn/"), code, F.lit("/xxgk/rsrm")).alias("list_url"), none.alias("leader_url"), none.alias("region"))

    old, new = entries(people.where("c_custkey % 3 <> 0"), F.col("c_name")), entries(people.where("c_custkey % 2 = 0"), F.concat(F.lit("new"), code))
    return adapters.sites(adapters.merge_sites(old, new)).select("code", "name", "level", "home_url", "list_url", "leader_url")


@query("""WITH f AS (SELECT o_custkey AS code, o_orderkey AS seq, CASE WHEN o_orderkey % 4 > 0 THEN 'u' || o_orderkey END AS u, o_orderstatus = 'P' AS unsure, o_orderpriority AS note FROM orders),
o AS (SELECT *, coalesce(bool_or(unsure) OVER (PARTITION BY code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS op FROM f),
n AS (SELECT code, string_agg(note, ',' ORDER BY seq) AS notes FROM (SELECT code, note, min(seq) AS seq FROM (SELECT code, CASE WHEN unsure THEN 'guessed' ELSE note END AS note, seq FROM f) GROUP BY 1, 2) GROUP BY 1)
SELECT CAST(code AS VARCHAR) AS code, coalesce(arg_max(u, seq) FILTER (op AND u IS NOT NULL), arg_min(u, seq) FILTER (u IS NOT NULL)) AS list_url, any_value(notes) AS notes FROM o JOIN n USING (code) GROUP BY 1""")
def site_candidates_merged(spark, d):
    rows = table(spark, d, "orders")
    note = F.when(F.col("o_orderstatus") == "P", "guessed").otherwise(F.col("o_orderpriority"))
    found = rows.select(F.col("o_custkey").cast("string").alias("code"), F.col("o_orderkey").alias("at"), F.lit("x").alias("name"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("u"), "o_orderkey")).alias("list_url"), F.lit("").alias("leader_url"), F.array(note).alias("notes"))
    return adapters.merge_candidates(found).select("code", "list_url", F.array_join("notes", ",").alias("notes"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS code, 'u' || arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'P') AS url, count(*) FILTER (o_orderstatus = 'P') = 0 AS needs_user, count(*) FILTER (o_orderkey < coalesce(m, 1000000000000)) AS rejected
FROM orders JOIN (SELECT o_custkey AS k, min(o_orderkey) FILTER (o_orderstatus = 'P') AS m FROM orders GROUP BY 1) ON o_custkey = k GROUP BY 1""")
def site_first_valid(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("code"), F.concat(F.lit("u"), "o_orderkey").alias("url"), F.col("o_orderkey").alias("place"), "o_orderstatus")
    pages = rows.select("url", F.when(F.col("o_orderstatus") == "P", 3).otherwise(0).alias("n_items"), F.lit("").alias("text"))
    return adapters.first_valid(rows.select("code", "url", "place"), pages).select("code", "url", "needs_user", F.size("rejected").alias("rejected"))


@query(f"""WITH {_SITES}, p AS (SELECT c_custkey AS path, '王' || substr('{_LETTERS}', c_custkey % 10 + 1, 1) || '健' AS a FROM customer)
SELECT path, a AS person, CASE WHEN path % 4 = 3 THEN '局长' ELSE '党委书记、局长' END AS title, CASE WHEN path % 4 < 2 THEN '男' END AS gender, CASE WHEN path % 4 < 2 THEN '主持全面工作' END AS duty_summary, '' AS departments FROM p WHERE path % 4 <> 3
UNION ALL SELECT path, '李敏', '副局长', CASE WHEN path % 4 < 2 THEN '女' END, CASE WHEN path % 4 < 2 THEN '分管工作' END, CASE WHEN path % 4 < 2 THEN '法制科,征管科' ELSE '' END FROM p""")
def leaders_read(spark, d):
    """Leaders of pages in four layouts."""
    k = F.col("c_custkey") % 4
    a = F.concat(F.lit("王"), F.substring(F.lit(_LETTERS), (F.col("c_custkey") % 10 + 1).cast("int"), F.lit(1)), F.lit("健"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    html = (
        F.when(k == 0, say("<p>", a, "，男，汉族，党委书记、局长，主持局全面工作。</p><p>李敏，女，汉族，副局长，分管法制科、征管科，联系甲县。</p>"))
        .when(k == 1, say("<p>", a, "（男，汉族，1970年生），党委书记、局长，主持全面工作</p><div>李敏（女，汉族）现任副局长，分管工作：法制科、征管科。</div>"))
        .when(k == 2, say("<li>", a, "（党委书记、局长）</li><li>李敏（副局长）</li>")).otherwise("<p>副局长：李敏</p>"))
    rows = leaders.leaders(table(spark, d, "customer").select(F.col("c_custkey").alias("path"), html.alias("html")))
    return rows.select("path", "person", "title", "gender", "duty_summary", F.array_join("departments", ",").alias("departments"))


# ---------------------------------------------------------------- audits of the registry
@query("""WITH c AS (SELECT c_custkey AS code, CASE WHEN c_custkey % 4 > 0 THEN 'u' END AS url, count(*) FILTER (o_orderstatus = 'F') AS events, count(*) FILTER (o_orderstatus = 'P') AS notices, count(*) FILTER (o_orderkey % 2 = 0) AS heads
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT code, events, notices, heads, CASE WHEN code % 11 = 0 THEN 'known_no_appt' WHEN events + notices = 0 AND url IS NULL THEN 'no_url_no_data' WHEN events + notices + heads = 0 THEN 'zero_appt_data' ELSE 'real_failure' END AS failure,
CASE WHEN code % 11 = 0 THEN 'known' WHEN url IS NULL THEN 'no_url' WHEN events + notices = 0 THEN 'zero_data' ELSE 'monitor' END AS monitoring FROM c""")
def site_failures(spark, d):
    """Why sites (customers) have no data, by their events, notices and heads of lists (orders)."""
    orders, code = table(spark, d, "orders"), F.col("c_custkey").alias("code")
    sites = table(spark, d, "customer").select(code, F.when(F.col("c_custkey") % 4 > 0, "u").alias("list_url"))
    of = lambda kind: (orders.where(kind), "o_custkey")
    found = audits.counted(sites, {"events": of("o_orderstatus = 'F'"), "notices": of("o_orderstatus = 'P'"), "heads": of("o_orderkey % 2 = 0")})
    return audits.failures(found, table(spark, d, "customer").where("c_custkey % 11 = 0").select(code)).drop("list_url")


@query("""SELECT c_custkey AS code, CASE WHEN c_custkey % 5 <> 0 AND (c_custkey % 5 = 1 OR c_nationkey <> 7) THEN 'u' || c_custkey END AS list_url,
CASE c_custkey % 5 WHEN 0 THEN 'NO_APPT,站点无栏目' WHEN 1 THEN 'old,NO_APPT,栏目无发文' ELSE CASE c_custkey % 3 WHEN 0 THEN 'NO_APPT' ELSE 'old' END || CASE WHEN c_nationkey = 7 THEN CASE c_custkey % 3 WHEN 0 THEN '' ELSE ',NO_APPT' END || ',站点无此项' ELSE '' END END AS notes
FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey NOT IN (1, 2) AND (c_custkey % 5 > 1 OR c_custkey % 3 = CASE c_custkey % 5 WHEN 0 THEN 0 ELSE 1 END)""")
def site_registry_pruned(spark, d):
    """Entries (customers) without link labels; of those without posts, reasons as notes."""
    c, text = F.col("c_custkey"), lambda n: n.cast("string")
    rows = table(spark, d, "customer").where("c_custkey % 5 > 1 OR c_custkey % 3 = CASE c_custkey % 5 WHEN 0 THEN 0 ELSE 1 END")
    name = F.when(c % 7 == 0, "某市通知公告").otherwise(F.concat(F.lit("地"), F.col("c_nationkey").cast("string"), F.lit("市税务局")))
    entries = rows.select(c.alias("code"), name.alias("name"), F.concat(F.lit("u"), text(c)).alias("list_url"), F.array(F.when(c % 3 == 0, audits.NO_POSTS).otherwise("old")).alias("notes"))
    empty = rows.where("c_custkey % 5 < 2").select(c.alias("code"), F.when(c % 5 == 0, "站点无栏目").otherwise("栏目无发文").alias("reason"))
    return audits.pruned(entries, empty, {"地7市": "站点无此项"}, [1, 2]).select("code", "list_url", F.array_join("notes", ",").alias("notes"))


@query("""SELECT n_nationkey AS code, n_nationkey < 12 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 40 IN (0, 1, 2)) AS skipped FROM nation""")
def parents_by_hand(spark, d):
    k = F.col("s_suppkey") % 40
    path = F.when(k == 0, "ingest_report.json").when(k == 1, "a.html").when(k == 2, "b/manifest.json").when(k == 3, "b/a.html").when(k == 4, "manifest.json").otherwise("notes.txt")
    files = table(spark, d, "supplier").select(F.col("s_nationkey").alias("parent"), path.alias("path"))
    return audits.by_hand(table(spark, d, "nation").select(F.col("n_nationkey").alias("code")), files, list(range(12)))
