"""Queries of scans' failures, of waiting updates, of discovery over links, and the integrity report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report
from ..sources import discovery
from ..streaming import scans
from .bindings import table
from .facades import _BAD, _LETTERS, _bad
from .registry import _CANON, query

# Scans out of orders: customers' lists scanned once a month of a year (the run); half of the scans fail.
_SCANS = """sc AS (SELECT o_custkey AS bureau, CAST(year(o_orderdate) AS BIGINT) AS run, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS "at", o_orderstatus <> 'F' AS ok FROM orders),
st AS (SELECT *, coalesce(lag(NOT ok) OVER b, false) AS was, sum(CAST(NOT ok AS BIGINT)) OVER (PARTITION BY bureau, run ORDER BY "at", id) AS tried, sum(CAST(NOT ok AS BIGINT)) OVER b AS fails, max(CASE WHEN ok THEN "at" END) OVER b AS last_success FROM sc WINDOW b AS (PARTITION BY bureau ORDER BY "at", id)),
told AS (SELECT bureau, run, id, "at", CASE WHEN ok AND was THEN 'recovered' WHEN ok THEN 'ok' WHEN tried = 1 THEN 'retry' ELSE 'failed' END AS action, CAST(greatest(fails - 1, 0) AS BIGINT) AS retry_count, last_success, NOT ok AS open FROM st)"""


def _scans(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("bureau"), F.year("o_orderdate").cast("long").alias("run"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), (F.col("o_orderstatus") != "F").alias("ok"))


@query(f"WITH {_SCANS} SELECT * FROM told")
def scan_outcomes(spark, d):
    return scans.outcomes_of_table(_scans(spark, d))


@query(f"""WITH {_SCANS}, l AS (SELECT *, row_number() OVER (PARTITION BY bureau ORDER BY "at" DESC, id DESC) AS n FROM told) SELECT bureau, "at", run, action, retry_count, last_success FROM l WHERE n = 1 AND open""")
def scan_failures_open(spark, d):
    return scans.open_failures(scans.outcomes_of_table(_scans(spark, d)))


@query(f"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '\\?utm_source=feed$', ''), '#.*$', '') AS u FROM pages), w AS (SELECT page_id, {_CANON} AS key FROM c),
k AS (SELECT key, min(page_id) AS page_id FROM w GROUP BY 1) SELECT page_id, page_id % 3 = 0 AS landed FROM k WHERE key NOT IN (SELECT key FROM w WHERE page_id % 7 = 0)""")
def updates_ready(spark, d):
    """Waiting updates whose pages have landed, and those that wait on; addresses that are known neither."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"\?utm_source=feed$", "").alias("url"))
    waiting = pages.select(F.lpad(F.col("page_id").cast("string"), 12, "0").alias("bureau"), "url", F.lit("t").alias("title"), F.lit(None).cast("string").alias("day"))
    first = pages.groupBy(scans.canonical_url(F.col("url")).alias("key")).agg(F.min("page_id").alias("page_id"))
    landed = first.where("page_id % 3 = 0").select(F.col("key").alias("url"), F.lit("x").alias("text"))
    known = pages.where("page_id % 7 = 0").select(scans.canonical_url(F.col("url")).alias("key"))
    notices, waits = scans.ready(waiting, landed, known)
    state = lambda df, done: df.select(F.col("bureau").cast("long").alias("page_id"), F.lit(done).alias("landed"))
    return state(notices, True).unionByName(state(waits, False))


# ---------------------------------------------------------------- discovery
@query("""WITH o AS (SELECT o_custkey AS path, o_orderkey AS n, o_orderstatus AS st, o_orderdate + INTERVAL 10 YEAR AS t FROM orders)
SELECT path, 'https://a.org/rsrm/' || CASE n % 3 WHEN 0 THEN 't' || strftime(t, '%Y%m%d') || '_' || n || '.html' WHEN 1 THEN 'x' || n || '.html' ELSE 'art/' || year(t) || '/' || month(t) || '/' || day(t) || '/art_' || n || '.html' END AS url,
CASE WHEN n % 4 = 0 THEN '人事任免' ELSE '关于任免的通知' || n END AS title, strftime(t, '%Y-%m-%d') AS day FROM o WHERE CASE WHEN n % 4 = 0 THEN n % 3 = 0 ELSE st <> 'P' END""")
def list_rows_read(spark, d):
    """Rows of lists of appointments: titles tested, addresses resolved, days out of the address or the text beside."""
    n, day = F.col("o_orderkey"), F.expr("o_orderdate + INTERVAL 10 YEAR")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    href = F.when(n % 3 == 0, say("/rsrm/t", F.date_format(day, "yyyyMMdd"), "_", n, ".html")).when(n % 3 == 1, say("x", n, ".html")).otherwise(say("./art/", F.year(day), "/", F.month(day), "/", F.dayofmonth(day), "/art_", n, ".html"))
    title = F.when(n % 4 == 0, "人事 任免").when(F.col("o_orderstatus") == "P", say("任职前公示", n)).otherwise(say("<i>关于</i>任免的通知", n))
    beside = F.when(n % 3 == 1, F.when(n % 2 == 0, F.date_format(day, " yyyy-MM-dd")).otherwise(F.concat(F.lit("<span>"), F.date_format(day, "yyyy年M月d日"), F.lit("</span>")))).otherwise("")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.concat(F.lit('<li><a class="x" href="'), href, F.lit('">'), title, F.lit("</a>"), beside, F.lit("</li>")).alias("item"))
    pages = rows.groupBy("path").agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list("item"), ""), F.lit("</ul>")).alias("html"), F.lit("https://a.org/rsrm/index.html").alias("base"))
    return discovery.appointment_rows(pages).select("path", "url", "title", "day")


_LINKS = """a AS (SELECT page_id AS page, unnest(regexp_extract_all(html, '<li><a href="/([^"]*)">', 1)) AS word FROM pages), f AS (SELECT page_id AS page, regexp_extract(html, '<li><a href="/([^"]*)">', 1) AS word FROM pages),
e AS (SELECT DISTINCT a.page, f.page AS target FROM a JOIN f ON f.word = a.word AND f.word <> '' AND f.page <> a.page)"""


def _links(spark, d):
    """Links between pages by words: page to word, and word to target. A page goes by its first link's word, and leads to all pages whose words it links to."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("page"), F.regexp_extract_all("html", F.lit('<li><a href="/([^"]*)">'), F.lit(1)).alias("words"))
    named = pages.select(F.col("page").alias("target"), F.get("words", F.lit(0)).alias("word")).where("word <> ''")
    return pages.select("page", F.explode(F.array_distinct("words")).alias("word")), named


@query(f"""WITH RECURSIVE {_LINKS}, r AS (SELECT page_id AS page, 0 AS depth FROM pages WHERE page_id < 2 UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.page = r.page WHERE r.depth < 40)
SELECT page, min(depth) AS depth FROM r GROUP BY 1""")
def pages_discovered(spark, d):
    """Pages that two seeds lead to, and by how many steps."""
    seeds = table(spark, d, "pages").where("page_id < 2").select(F.col("page_id").alias("page"))
    return discovery.discovered_by_words(*_links(spark, d), seeds)


@query("""WITH c AS (SELECT c_custkey AS n, 'c' || c_custkey % 400 AS code FROM customer WHERE c_custkey % 5 < 3 AND c_custkey % 400 > 0), g AS (SELECT code, arg_min(n % 5, n) = 0 AS named, bool_or(n % 5 < 2) AS list_found, bool_or(n % 5 = 2) AS leader_found FROM c GROUP BY 1)
SELECT code, CASE WHEN named THEN '甲' || substr(code, 2) || '区税务局' ELSE code END AS name, CASE WHEN named THEN 'district' ELSE 'city' END AS level, 'https://a.example.org/' || code || '/' AS home_url, 'https://a.example.org/' || code || '/xxgk/rsrm/' AS list_url, list_found, leader_found,
array_to_string(list_filter([CASE WHEN NOT list_found THEN 'appointment_url_guessed' END, CASE WHEN NOT leader_found THEN 'leader_url_guessed' END], lambda x: x IS NOT NULL), ',') AS notes FROM g""")
def child_sites_found(spark, d):
    """Bureaus out of a portal's links: by the first part of their path, with the lists and leaders' pages that links name."""
    n = F.col("c_custkey")
    code = F.concat(F.lit("c"), (n % 400).cast("string"))
    link = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    href = F.when(n % 5 == 0, link("/", code, "/xxgk/rsxx/")).when(n % 5 == 1, link("https://a.example.org/", code, "/xxgk/rsrm/")).when(n % 5 == 2, link("/", code, "/xxgk/ldjj/index.html")).when(n % 5 == 3, link("https://b.other.net/", code, "/xxgk/")).otherwise("javascript:x()")
    text = F.when(n % 5 == 0, link("甲", (n % 400).cast("string"), "区税务局")).otherwise("链接")
    links = table(spark, d, "customer").where("c_custkey % 400 > 0").select(F.lit("https://a.example.org/index.html").alias("page_url"), href.alias("href"), text.alias("text"), n.alias("place"))
    return discovery.child_sites(links).select("code", "name", "level", "home_url", "list_url", "list_found", "leader_found", F.array_join("notes", ",").alias("notes"))


@query("""WITH s AS (SELECT o_custkey AS code, o_orderkey AS place, o_orderkey % 4 AS score FROM orders), b AS (SELECT code, max(score) AS score FROM s GROUP BY 1)
SELECT b.code, CASE WHEN b.score > 0 THEN 'u' || min(place) FILTER (s.score = b.score) END AS url, b.score AS score FROM b JOIN s ON s.code = b.code GROUP BY b.code, b.score""")
def best_address_by_score(spark, d):
    """Of a bureau's candidates the one whose page has most rows of a list; of equal ones the first."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.concat(F.lit("u"), "o_orderkey").alias("url"), F.col("o_orderkey").alias("place"))
    item = F.lit('<li><a href="/art/1.html">关于任免的通知</a><span>2024-01-02</span></li>')
    pages = rows.select("url", F.concat(F.lit("<ul>"), F.repeat(item, (F.col("place") % 4).cast("int")), F.lit("</ul>")).alias("html"))
    return discovery.best_address(rows, pages)


# ---------------------------------------------------------------- the report
_NAMES = ", ".join(f"('{c}')" for c in report.COUNTERS[:-1])


@query(f"""WITH {_BAD}, e AS (SELECT *, CASE WHEN id % 29 = 0 THEN NULL ELSE id // 3 END AS notice_id FROM b), u AS (SELECT s_suppkey AS id, s_nationkey + CASE WHEN s_suppkey % 10 = 0 THEN 100 ELSE 0 END AS bureau, CASE WHEN s_suppkey % 9 = 0 THEN '通知' ELSE '王' || substr('{_LETTERS}', s_suppkey % 10 + 1, 1) || '甲' END AS person,
  CASE s_suppkey % 3 WHEN 0 THEN '["a"]' WHEN 1 THEN '[broken' ELSE '' END AS js FROM supplier), p AS (SELECT c_custkey AS id, c_nationkey AS bureau, '王' || substr('{_LETTERS}', c_custkey % 10 + 1, 1) || substr('{_LETTERS}', c_custkey // 10 % 10 + 1, 1) AS person FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT o_orderkey AS id, 'https://h.org/' || o_orderkey // 2 AS url FROM orders WHERE o_orderkey % 5 > 0), s AS (SELECT n_nationkey AS code FROM nation WHERE n_nationkey <> 4),
f AS (SELECT 1 AS i, 'events: implausible name' AS counter, id FROM e WHERE person IS NULL OR person = '关于任免' UNION ALL SELECT 2, 'events: no title or department', id FROM e WHERE title = '' AND dept IS NULL UNION ALL SELECT 3, 'events: no day', id FROM e WHERE day = '' UNION ALL SELECT 4, 'events: bad day', id FROM e WHERE day = '1995-02-30'
  UNION ALL SELECT 5, 'events: day out of range', id FROM e WHERE day NOT IN ('', '1995-02-30') AND (day < '1994-01-01' OR day > '1998-06-01') UNION ALL SELECT 6, 'events: noise in department', id FROM e WHERE dept = '任命通知' UNION ALL SELECT 7, 'events: unregistered code', id FROM e WHERE bureau = 4
  UNION ALL SELECT 8, 'events: no notice', id FROM e WHERE notice_id IS NULL UNION ALL SELECT 8, 'events: no notice', NULL FROM e WHERE notice_id IS NOT NULL AND notice_id NOT IN (SELECT id FROM n)
  UNION ALL SELECT 9, 'duties: implausible name', id FROM u WHERE person = '通知' UNION ALL SELECT 10, 'duties: broken departments', id FROM u WHERE js = '[broken' UNION ALL SELECT 11, 'duties: nothing in charge', id FROM u WHERE js <> '["a"]' UNION ALL SELECT 12, 'duties: unregistered code', id FROM u WHERE bureau = 4 OR bureau >= 100
  UNION ALL SELECT 13, 'people: no source', id FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.bureau = p.bureau AND e.person = p.person) AND NOT EXISTS (SELECT 1 FROM u WHERE u.bureau = p.bureau AND u.person = p.person) UNION ALL SELECT 14, 'people: unregistered code', id FROM p WHERE bureau = 4
  UNION ALL SELECT 15, 'notices: no events', id FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.notice_id = n.id)),
d AS (SELECT url, count(*) AS k FROM n GROUP BY 1 HAVING count(*) > 1), r AS (SELECT counter, count(*) AS n, array_to_string(list_sort(list_filter([min(id) FILTER (id % 3 = 0), min(id) FILTER (id % 3 = 1), min(id) FILTER (id % 3 = 2)], lambda x: x IS NOT NULL)), ',') AS samples FROM f GROUP BY 1)
SELECT name AS counter, coalesce(n, 0) AS n, coalesce(samples, '') AS samples FROM (VALUES {_NAMES}) v(name) LEFT JOIN r ON counter = name UNION ALL SELECT 'notices: address again', CAST(coalesce(sum(k - 1), 0) AS BIGINT), (SELECT array_to_string(list_sort(list_filter([min(id) FILTER (id % 3 = 0), min(id) FILTER (id % 3 = 1), min(id) FILTER (id % 3 = 2)], lambda x: x IS NOT NULL)), ',') FROM n JOIN d USING (url)) FROM d""")
def integrity_report(spark, d):
    """Sixteen counters with samples over four tables, each read once."""
    letter = lambda c: F.substring(F.lit(_LETTERS), (c % 10 + 1).cast("int"), F.lit(1))
    i, c, o = F.col("s_suppkey"), F.col("c_custkey"), F.col("o_orderkey")
    events = _bad(spark, d).withColumn("notice_id", F.when(F.col("id") % 29 != 0, F.floor(F.col("id") / 3)))
    duties = table(spark, d, "supplier").select(
        i.alias("id"), (F.col("s_nationkey") + F.when(i % 10 == 0, 100).otherwise(0)).alias("bureau"), F.when(i % 9 == 0, "通知").otherwise(F.concat(F.lit("王"), letter(i), F.lit("甲"))).alias("person"),
        F.when(i % 3 == 0, '["a"]').when(i % 3 == 1, "[broken").otherwise("").alias("departments_json"), F.lit("分管工作").alias("duty_summary"))
    people = table(spark, d, "customer").where("c_custkey % 2 = 0").select(c.alias("id"), F.col("c_nationkey").alias("bureau"), F.concat(F.lit("王"), letter(c), letter(F.floor(c / 10))).alias("person"))
    notices = table(spark, d, "orders").where("o_orderkey % 5 > 0").select(o.alias("id"), F.concat(F.lit("https://h.org/"), F.floor(o / 2)).alias("url"))
    sites = table(spark, d, "nation").where("n_nationkey <> 4").select(F.col("n_nationkey").alias("code"))
    found = report.integrity_report(events, duties, people, notices, sites, "1997-06-01")
    return found.withColumn("samples", F.array_join("samples", ","))
