"""Queries over pages' elements: what pages hold, leaders' layouts, links to follow, shells and their trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import elements, leaders, trees
from ..sources.staging import dealt
from .bindings import table
from .facades import _LETTERS
from .registry import query


def _say(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("""WITH c AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '<script></script>', 'gs'), '<style[^>]*>.*?</style>', '<style></style>', 'gs'), '<!--.*?-->', '', 'gs') AS h FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(h, '<[a-zA-Z][^>]*>')) AS BIGINT) AS n_elements, CAST(len(regexp_extract_all(h, '<li><a ')) AS BIGINT) AS links_in_items, CAST(len(list_filter(list_zip(regexp_extract_all(h, '<li><a href="/([^"]*)">[^<]*</a>', 1), regexp_extract_all(h, '<li><a href="/[^"]*">([^<]*)</a>', 1)), lambda x: x[1] = x[2])) AS BIGINT) AS links_named_alike,
CAST(len(regexp_extract_all(regexp_extract(h, '<article>.*', 0, 's'), '<p>')) AS BIGINT) AS paragraphs, CAST(len(string_split(regexp_extract(h, '<h1>([^<]*)', 1), ' ')) AS BIGINT) AS heading FROM c""")
def page_elements(spark, d):
    """Pages' elements: links within list items by their parents, paragraphs within articles by their places."""
    rows = elements.elements(table(spark, d, "pages").select(F.col("page_id").alias("path"), "html"))
    tags = rows.groupBy("path").agg(F.count_if(F.col("tag") != "#text").alias("n_elements"), F.coalesce(F.max(F.when(F.col("tag") == "h1", F.size(F.split("text", " ")))), F.lit(0)).cast("long").alias("heading"))
    items = rows.where("tag = 'li'").select("path", F.col("element").alias("parent"))
    links = rows.where("tag = 'a'").join(items, ["path", "parent"]).groupBy("path").agg(F.count(F.lit(1)).alias("links_in_items"), F.count_if(F.col("href") == F.concat(F.lit("/"), "text")).alias("links_named_alike"))
    inside = elements.within(rows.where("tag = 'p'").select("path", "element"), rows.where("tag = 'article'"), "article").groupBy("path").agg(F.count(F.lit(1)).alias("paragraphs"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return tags.join(links, "path", "left").join(inside, "path", "left").select(F.col("path").cast("long").alias("page_id"), "n_elements", n("links_in_items"), n("links_named_alike"), n("paragraphs"), "heading")


# ---------------------------------------------------------------- leaders
_A = f"'王' || substr('{_LETTERS}', c_custkey % 10 + 1, 1) || '健'"


def _leader_pages(spark, d):
    """A page for each customer, in one of six layouts: two leaders, but for the pane's one."""
    k, i = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    a = F.concat(F.lit("王"), F.substring(F.lit(_LETTERS), (F.col("c_custkey") % 10 + 1).cast("int"), F.lit(1)), F.lit("健"))
    html = (
        F.when(k == 0, _say("<html><ul class='xxgkleaderlists'><li><script>document.write('", a, "，男，汉族，党委书记、局长'.replace('x', ''))</script><div class='leaderarticle'><div class='group1'><h2>主持工作</h2><div class='jj'>主持全面工作</div></div></div></li>"
                              "<li><script>document.write('李敏，女，汉族，党委委员、副局长'.replace('x', ''))</script><div class='leaderarticle'><div class='group1'><h2>分管工作</h2><div class='jj'>法制科、征管科</div></div><div class='group1'><h2>联系单位</h2><div class='jj'>甲县税务局</div></div></div></li></ul>"))
        .when(k == 1, _say("<div><div class='ldjjjj'><p>", a, "，男，汉族，党委书记、局长</p></div><div class='x ldjjgroup'><h2>分管工作</h2><div class='jj'>法制科、<b>征管科</b></div></div></div>"))
        .when(k == 2, _say("<div class='tit'><a href='/art/2024/1/2/art_873_", i, ".html'>", a, " 党委书记、局长</a></div><div class='zhaiyao'>", a, "，男，汉族</div><div class='tit'><a href='/art/2024/1/2/art_9_", i, ".html'>李敏（党委委员、副局长）</a></div><div class='zhaiyao'>李敏，<i>女</i>，汉族</div>"))
        .when(k == 3, _say("<ul class='list_lefnavLdjj'><li><a href='/ldjj/", i, ".html'><span>", a, "</span><p>党委书记、局长</p></a></li><li><a href='/ldjj/2.html'><span>李 敏</span><p>副局长</p></a><li><a href='/'><span>首页</span></a></ul>"))
        .when(k == 4, _say("<a href='/x/", i, "'>局长：</a><p><a href='/y/2'>李敏</a><br><a href='/x/", i, "'>", a, "</a><a href='/y/2'>副局长</a> <a href='/y/3'>政策法规</a><a href='javascript:x()'>局长</a>"))
        .otherwise(_say("<div><div><h3>领导专栏</h3></div><p><a href='/ldjj/", i, ".html'>", a, "</a> <a href='/ldjj/2.html?t=1'>李　敏</a> <a href='/ldjj/2.html?t=2'>李敏</a><a href='/zcfg/1.html'>王东健</a></p></div>")))
    return dealt(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("path"), html.alias("html"))


@query(f"""WITH p AS (SELECT c_custkey AS path, c_custkey % 6 AS k, {_A} AS a FROM customer), n AS (SELECT ['written', 'pane', 'cards', 'span and p', 'paired', 'side'] AS names)
SELECT path, names[k + 1] AS layout, a AS person, CASE WHEN k < 5 THEN '党委书记、局长' END AS title, CASE WHEN k < 3 THEN '男' END AS gender, CASE WHEN k < 3 THEN '汉族' END AS people,
CASE k WHEN 2 THEN '/art/2024/1/2/art_873_' || path || '.html' WHEN 3 THEN '/ldjj/' || path || '.html' WHEN 4 THEN '/x/' || path WHEN 5 THEN '/ldjj/' || path || '.html' END AS href,
CASE k WHEN 0 THEN '主持全面工作' WHEN 1 THEN '分管工作' END AS duty_summary, CASE WHEN k = 1 THEN '法制科,征管科' ELSE '' END AS departments FROM p, n
UNION ALL SELECT path, names[k + 1], '李敏', CASE WHEN k IN (0, 2, 4) THEN '党委委员、副局长' WHEN k = 3 THEN '副局长' END, CASE WHEN k IN (0, 2) THEN '女' END, CASE WHEN k IN (0, 2) THEN '汉族' END,
CASE k WHEN 2 THEN '/art/2024/1/2/art_9_' || path || '.html' WHEN 3 THEN '/ldjj/2.html' WHEN 4 THEN '/y/2' WHEN 5 THEN '/ldjj/2.html?t=1' END, CASE WHEN k = 0 THEN '分管工作' END, CASE WHEN k = 0 THEN '法制科,征管科' ELSE '' END FROM p, n WHERE k <> 1""")
def leaders_in_elements_read(spark, d):
    rows = elements.leaders_in_elements(elements.elements(_leader_pages(spark, d)))
    return rows.select(F.col("path").cast("long").alias("path"), "layout", "person", "title", "gender", "people", "href", "duty_summary", F.array_join("departments", ",").alias("departments"))


@query("""WITH p AS (SELECT c_custkey AS path, c_custkey % 6 AS k FROM customer)
SELECT path, CASE WHEN k = 2 THEN '/art/2024/1/2/art_873_' || path || '.html' ELSE '/ldjj/' || path || '.html' END AS href FROM p WHERE k IN (3, 5)
UNION ALL SELECT path, CASE WHEN k = 3 THEN '/ldjj/2.html' ELSE '/ldjj/2.html?t=1' END FROM p WHERE k IN (3, 5)""")
def leader_links_to_follow(spark, d):
    """Of the layouts' links those that are named like a person, or stand in a page's side, and lead to leaders' pages."""
    rows = elements.link_targets(elements.elements(_leader_pages(spark, d)))
    return rows.select(F.col("path").cast("long").alias("path"), "href")


@query(f"""WITH p AS (SELECT c_custkey AS path, c_custkey % 3 AS k, {_A} AS a FROM customer)
SELECT path, a AS person, '党委书记、局长' AS title, CASE WHEN k = 0 THEN '男' END AS gender, CASE WHEN k = 0 THEN '汉族' END AS people, CASE WHEN k = 2 THEN '主持全面工作' END AS duty_summary, '' AS departments FROM p
UNION ALL SELECT path, '李敏', CASE k WHEN 1 THEN '副局长' ELSE '党委委员、副局长' END, CASE WHEN k = 0 THEN '女' END, CASE WHEN k = 0 THEN '满族' END, CASE WHEN k = 2 THEN '分管工作' END, CASE WHEN k = 2 THEN '法制科,征管科' ELSE '' END FROM p""")
def leaders_read_in_prose(spark, d):
    """Leaders of texts: name, title and gender; name, bureau and title; title, name and duty in a sentence."""
    k = F.col("c_custkey") % 3
    a = F.concat(F.lit("王"), F.substring(F.lit(_LETTERS), (F.col("c_custkey") % 10 + 1).cast("int"), F.lit(1)), F.lit("健"))
    html = (F.when(k == 0, _say("<p>", a, "（党委书记、局长）男，汉族，1970年生。</p><p>李敏（党委委员、副局长） 女，满族。</p>"))
            .when(k == 1, _say("<p>", a, " 国家税务总局甲市税务局党委书记、局长</p><p>李敏 国家税务总局乙市税务局副局长</p>"))
            .otherwise(_say("<p>党委书记、局长", a, "主持全面工作。党委委员、副局长李敏分管法制科、征管科，联系甲县税务局。</p>")))
    rows = leaders.leaders(dealt(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("path"), html.alias("html")))
    return rows.select("path", "person", "title", "gender", "people", "duty_summary", F.array_join("departments", ",").alias("departments"))


# ---------------------------------------------------------------- shells
def _shell_pages(spark, d):
    i = F.col("s_suppkey").cast("string")
    k = F.col("s_suppkey") % 5
    url = F.when(k == 0, _say("https://a.example.org/col/x.html?vc_xxgkarea=U", i)).otherwise("https://a.example.org/col/x.html")
    html = (F.when(k == 1, _say('<iframe src="/module/xxgk/tree.jsp?standardXxgk=1&amp;area=F', i, '&amp;divid=div7"></iframe>'))
            .when(k == 2, _say("loadDynamic('/module/xxgk/search.jsp?standardXxgk=1&infotypeId='+a+'&area=L", i, "', 'div9', 'x', 'y', 'z', '3')"))
            .when(k == 3, "<p>no shell</p>").otherwise(_say("<a href='?vc_xxgkarea=T", i, "'>x</a>")))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), url.alias("url"), html.alias("html"))


@query("""WITH s AS (SELECT s_suppkey AS path, s_suppkey % 5 AS k, ['U', 'F', 'L', '', 'T'][1 + s_suppkey % 5] || s_suppkey AS area, CASE s_suppkey % 5 WHEN 1 THEN 'div7' WHEN 2 THEN 'div9' ELSE 'div4' END AS block FROM supplier)
SELECT path, area, block, CASE WHEN k = 2 THEN '3' ELSE '1' END AS webid, 'https://a.example.org/module/xxgk/tree.jsp?standardXxgk=1&area=' || area || '&divid=' || block AS tree_url FROM s WHERE k <> 3""")
def page_shells(spark, d):
    return trees.shells(_shell_pages(spark, d))


@query("""SELECT s_suppkey AS path, CASE s_suppkey % 4 WHEN 0 THEN 'k1' WHEN 1 THEN 'k2' WHEN 2 THEN 'k3' END AS appointment, CASE WHEN s_suppkey % 3 < 2 THEN 'k' || (5 + s_suppkey % 3) END AS leader FROM supplier WHERE s_suppkey % 4 < 3 OR s_suppkey % 3 < 2""")
def tree_kinds(spark, d):
    """The kinds of lists that trees' nodes name; labels in turn, then by a part."""
    k, m = F.col("s_suppkey") % 4, F.col("s_suppkey") % 3
    node = lambda kind, label: f"<a onclick=\"funclick('{kind}','x');\">{label}</a>"
    html = _say("<div>", node("k0", "机构设置"), F.when(k == 0, node("k2", "干部任免") + node("k1", "人事 任免")).when(k == 1, node("k3", "其他任免") + node("k2", "干部任免")).when(k == 2, node("k3", "人员任免")).otherwise(""),
                F.when(m == 0, node("k5", "领导介绍") + node("k9", "现任领导")).when(m == 1, node("k6", "局领导")).otherwise(""), "</div>")
    labels = trees.tree_labels(table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), html.alias("html")))
    kinds = [trees.wanted_kind(labels, w).withColumnRenamed("kind", w) for w in ("appointment", "leader")]
    return kinds[0].join(kinds[1], "path", "full").select("path", "appointment", "leader")
