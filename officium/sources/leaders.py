"""Leaders and their duties out of bureaus' pages, by patterns of layouts as DataFrame steps.

A page's text is matched against each layout; matches become rows, names are tested, and a page's rows of one name become one
leader. Layouts that could be chance count where a page has two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.persons import plausible_name
from ..operators.extract import TITLES
from .notices import unescape, visible_text

_NAME = r"[一-龥·](?: ?[一-龥·]){1,3}"
_TITLE = f"(?:{'|'.join(TITLES)})"
_POST = f"(?:[一-龥]{{0,6}}、)*?[一-龥]{{0,4}}?{_TITLE}(?:、{_TITLE})*"
_PEOPLE = "[一-龥]{1,5}族"
# Titles that prose puts before a name.
_ROLES = "党委书记、局长|党委副书记、局长|党委委员、(?:纪检组组长|总会计师|总经济师|总审计师|副局长|副书记)|(?:[一二三]级)?高级主办"
# Layouts by order of trust: pattern, numbers of its groups of name, title, gender, people and text, and how many a page needs.
LAYOUTS = {
    "bio": (rf"(?s)(?<![一-龥])({_NAME})[，,]\s*(男|女)[，,]\s*({_PEOPLE})(.*?)(?=(?<![一-龥]){_NAME}[，,]\s*[男女][，,]|$)", (1, 0, 2, 3, 4), 1),
    "bracketed bio": (rf"(?s)(?<![一-龥])({_NAME})\s*[（(](男|女)[，,]\s*({_PEOPLE})(.*?)(?=(?<![一-龥]){_NAME}\s*[（(][男女][，,]|$)", (1, 0, 2, 3, 4), 1),
    "name and title": (rf"(?m)^\s*({_NAME})\s*(?:[（(]|[ \t]+)({_POST})[）)]?\s*$", (1, 2, 0, 0, 0), 2),
    "title: name": (rf"(?m)^\s*({_POST})\s*[：:]\s*({_NAME})\s*$", (2, 1, 0, 0, 0), 1),
    "name, title, gender": (rf"(?<![一-龥])({_NAME})\s*[（(]({_POST})[）)]\s*(男|女)[，,]\s*({_PEOPLE})", (1, 2, 3, 4, 0), 1),
    "name and bureau": (rf"(?<![一-龥·])({_NAME})[ \t]+国家税务总局[一-龥]{{2,20}}?税务局({_POST})", (1, 2, 0, 0, 0), 1),
    "prose": (rf"({_ROLES})([一-龥·]{{2,4}}?)((?:主持|分管|负责|协助)[^。\n]*)", (2, 1, 0, 0, 3), 1),
    "lines in turn": (rf"(?m)^\s*({_NAME})\s*\n\s*({_POST})\s*$", (1, 2, 0, 0, 0), 2),
}
_EDGES = r"^[\s：:，,。；;]+|[\s：:，,。；;]+$"


def duty(text: Column) -> Column:
    """STRUCT(summary, departments) of what a leader's text says of their work; the departments end where contacts begin."""
    text = F.coalesce(text, F.lit(""))
    leads = text.rlike("主持.{0,12}全面工作")
    after = F.when(text.contains("分管工作"), F.regexp_extract(text, "(?s)分管工作(.*)$", 1)).otherwise(F.regexp_extract(text, "(?s)分管(.*)$", 1))
    listed = F.regexp_replace(F.regexp_replace(after, "(?s)(?<=.)联系.*$", ""), r"^[\s：:，,]*分管", "")
    parts = F.transform(F.split(F.regexp_replace(listed, _EDGES, ""), "、"), lambda p: F.regexp_replace(F.split(p, "联系")[0], _EDGES, ""))
    parts = F.filter(parts, lambda p: (p != "") & ~p.isin("分管工作", "主持全面工作"))
    none = F.array().cast("array<string>")
    return F.when(leads, F.struct(F.lit("主持全面工作").alias("summary"), none.alias("departments"))).when(
        text.contains("分管"), F.struct(F.lit("分管工作").alias("summary"), parts.alias("departments"))).otherwise(F.struct(F.lit(None).cast("string").alias("summary"), none.alias("departments")))


def _found(layout: str, order: int) -> Column:
    pattern, groups, _ = LAYOUTS[layout]

    def one(m: Column, i: Column) -> Column:
        part = lambda g: F.nullif(F.trim(F.regexp_extract(m, pattern, g)), F.lit("")) if g else F.lit(None).cast("string")
        return F.struct(F.lit(order).alias("layout"), i.alias("at"), *[part(g).alias(n) for g, n in zip(groups, ("person", "title", "gender", "people", "block"))])

    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), one)


def leaders(pages: DataFrame) -> DataFrame:
    """path, person, title, gender, people, duty_summary, departments of pages (path, html); one row for each name of a page.

    Of what several layouts say the first that says something counts.
    """
    # A page's chrome after its content isn't any leader's text.
    text = F.split(unescape(visible_text(F.col("html"))), "网站地图|网站声明|联系我们|主办单位|网站标识码|扫一扫")[0]
    rows = pages.select("path", text.alias("text"))
    rows = rows.select("path", F.explode(F.concat(*[_found(n, i) for i, n in enumerate(LAYOUTS)])).alias("m")).select("path", "m.*")
    rows = rows.withColumn("person", F.regexp_replace("person", " ", "")).where(plausible_name(F.col("person")))
    need = F.element_at(F.array(*[F.lit(n) for _, _, n in LAYOUTS.values()]), F.col("layout") + 1)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("path", "layout"))).where(F.col("_n") >= need)
    post = F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce("block", F.lit("")), _POST, 0), "^(?:现任|担任|任)", ""), F.lit(""))
    rows = rows.withColumns({"title": F.coalesce("title", post), "duty": duty(F.col("block"))})
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.struct("layout", "at")))
    said = F.when(F.col("duty.summary").isNotNull(), F.col("duty"))
    rows = rows.groupBy("path", "person").agg(*[first(F.col(c)).alias(c) for c in ("title", "gender", "people")], first(said).alias("d"))
    return rows.select("path", "person", "title", "gender", "people", F.col("d.summary").alias("duty_summary"), F.coalesce("d.departments", F.array().cast("array<string>")).alias("departments"))


def overlaid(listed: DataFrame, told: DataFrame) -> DataFrame:
    """Leaders of a list (path, person, title, ...) with what their own pages tell, which counts first, and those whom only pages name."""
    fields = [c for c in listed.columns if c not in ("bureau", "person")]
    a, b = listed.alias("a"), told.alias("b")
    value = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c == "path" else F.coalesce(F.when(F.col(f"b.{c}").cast("string") != "[]", F.col(f"b.{c}")), F.col(f"a.{c}"), F.col(f"b.{c}"))
    return a.join(b, ["bureau", "person"], "full").select("bureau", "person", *[value(c).alias(c) for c in fields])
