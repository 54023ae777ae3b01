"""Pages' elements as rows, and leaders' layouts as joins over them.

A row of ``elements`` is an element or a text: path, element (its place in the page), parent, last (the place of the last one within
it), tag, id, classes, href, title, text. So an element's descendants are the rows of its page from element + 1 to last,
its children those whose parent it is. Texts have the tag ``#text``; inline elements have their whole text too (``INLINE``), of
other elements ``whole_text`` gathers it. Reading pages' tags is the one step outside Spark's expressions: pages are no
regular language, and a stack of open elements must be followed through each.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.persons import clean_name, plausible_name
from .leaders import duty
from .staging import staged

ELEMENTS = "path string, element int, parent int, last int, tag string, id string, classes array<string>, href string, title string, text string"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a b em h1 h2 h3 h4 h5 h6 i label option p script span strong title u".split())
BATCH = 20_000

# Containers of leaders' links in pages' sides; headings of such lists; paths that leaders' pages have.
SIDES = ("left-box", "ldxx-r", "ldxx-l", "list_lefnavLdjj", "submenu", "mainbox_left", "swxw_left", "ldjj_left", "leader-list", "leaderlist")
HEADINGS = "领导专栏|领导简介"
ARTICLE = r"(?i)(?:20\d{4}/t\d+|t\d+)\.s?html|/ld_\d+|content_[a-f0-9]+\.shtml|/art/\d{4}/\d{1,2}/\d{1,2}/art_\d+|ldjianjie\.shtml|ldjs\.shtml|/leaderlist/\d+|/010002\d{2}/\d+\.shtml"
LEADERISH = ARTICLE + r"|/(?:ldjj|ldzl|ldjs|ldxx\w*|leaderlist|010002)/|/ld_[a-z]+\.s?html"
COLUMN = r"(?i)/col/col\d+/"
# Titles that stand alone, the party's rank that is left out before them, and words one of which every leader's title has.
ROLES = ("局长", "副局长", "纪检组组长", "纪检组长", "总会计师", "总审计师", "总经济师", "党委书记、局长", "党委委员、副局长")
PARTY_RANKS = {"局长": "党委书记、局长", "副局长": "党委委员、副局长", "纪检组组长": "党委委员、纪检组组长", "总会计师": "党委委员、总会计师", "总审计师": "党委委员、总审计师", "总经济师": "党委委员、总经济师"}
LEADERS_WORDS = "党委|局长|纪检|总会计|总审计|总经济|副书记|书记|巡视员"
# Labels of links that look like names.
NO_PEOPLE = "首页 信息公开 网站地图 返回 打印 网站声明 网站管理 联系我们 新闻动态 政策文件 纳税服务 互动交流 政策法规 政策解读 新闻宣传 权责清单 行政检查 政府采购 抖音 微博 微信 客户端 简体 繁体 繁體 关怀版 合规经营 隐私声明 个税 发票 小微企业 减税降费 数电票 税费优惠 房产税 印花税 市局频道".split()
_BLANKS = r"[\s\u3000\u2002\u2003]+"
_NAME = "[一-龥·]{2,8}"
_PROFILE = rf"(?s)^\s*({_NAME})\s*[,，：:]\s*(男|女)\s*[,，]?\s*(?:([一-龥]+族)\s*[,，]\s*)?(.+?)\s*(?:。|分管工作|$)"
_WRITTEN = r"(?i)document\.write\s*\(\s*['\"]([^'\"\\]*)['\"]"


class _Tags(HTMLParser):
    """Rows of one page in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        self._row(tag, a.get("id"), (a.get("class") or "").split(), a.get("href"), a.get("title"), "" if tag in INLINE else None)
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][2] == tag:
                self._close(k)
                break  # an end without a beginning says nothing

    def handle_data(self, data: str) -> None:
        self._row("#text", None, None, None, None, data)
        for k in self.open:
            if self.rows[k][2] in INLINE:
                self.rows[k][7] += data

    def _row(self, tag: str, *rest) -> None:
        self.rows.append([self.open[-1] if self.open else None, len(self.rows), tag, *rest])

    def _close(self, k: int) -> None:
        for i in self.open[k:]:
            self.rows[i][1] = len(self.rows) - 1
        del self.open[k:]

    def page(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        self._close(0)
        return self.rows


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]
    names = [f.split(" ")[0] for f in ELEMENTS.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    out: list[tuple] = []
    for batch in batches:
        for path, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for i, (parent, last, *rest) in enumerate(_Tags().page(html or "")):
                out.append((path, i, parent, last, *rest))
                if len(out) == BATCH:
                    yield made(out)
                    out = []
    yield made(out)


def elements(pages: DataFrame) -> DataFrame:
    """The elements and texts of pages (path, html). A null page has none."""
    return pages.select(F.col("path").cast("string"), "html").mapInArrow(_read, ELEMENTS)


# ---------------------------------------------------------------- helpers of the layouts
def has_class(*names: str) -> Column:
    return F.coalesce(F.arrays_overlap("classes", F.array(*[F.lit(n) for n in names])), F.lit(False))


def bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, "")


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " "))


def within(inner: DataFrame, outer: DataFrame, name: str) -> DataFrame:
    """inner's rows with the place (``name``) of each of outer's elements that they stand in."""
    o = outer.select(F.col("path").alias("_path"), F.col("element").alias(name), F.col("last").alias("_last"))
    on = (F.col("path") == F.col("_path")) & (F.col("element") > F.col(name)) & (F.col("element") <= F.col("_last"))
    return inner.join(o.hint("merge"), on).drop("_path", "_last")


def whole_text(rows: DataFrame, of: DataFrame) -> DataFrame:
    """path, element and whole: the texts within each of the elements, in order, with blanks between."""
    texts = within(rows.where("tag = '#text'").select("path", "element", "text"), of, "outer")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("element", "text"))), lambda x: F.trim(x["text"])), " ")
    return texts.where(F.trim("text") != "").groupBy("path", F.col("outer").alias("element")).agg(spaced(joined).alias("whole")).hint("merge")


def _person(label: Column) -> Column:
    """A label that is a person's name alone; else null."""
    name = clean_name(label)
    return F.when(label.rlike(f"^{_NAME}$") & plausible_name(name) & ~label.isin(*NO_PEOPLE), name)


def _leader(rows: DataFrame, layout: str, **values: Column) -> DataFrame:
    """Rows of the layouts' result; a title must be a leader's."""
    none = {"title": F.lit(None).cast("string"), "gender": F.lit(None).cast("string"), "people": F.lit(None).cast("string"), "href": F.lit(None).cast("string"), "duty_summary": F.lit(None).cast("string"), "departments": F.array().cast("array<string>")}
    return rows.select("path", F.lit(layout).alias("layout"), F.col("element").alias("at"), *[v.alias(c) for c, v in ({"person": None} | none | values).items()])


def _profile(text: Column) -> dict[str, Column]:
    part = lambda g: F.nullif(F.trim(F.regexp_extract(text, _PROFILE, g)), F.lit(""))
    return {"person": clean_name(part(1)), "gender": part(2), "people": part(3), "title": part(4)}


def _groups(rows: DataFrame, roots: DataFrame, group: str) -> DataFrame:
    """Of each root (path, element) what its groups, each a heading h2 and a block jj, say of duties: summary, departments."""
    groups = within(rows.where(has_class(group)).select("path", "element", "last"), roots, "root")
    heads = within(rows.where("tag = 'h2'").select("path", "element", "text"), groups, "group").groupBy("path", "group").agg(F.min_by(spaced(F.col("text")), "element").alias("head"))
    blocks = within(rows.where(has_class("jj")).select("path", "element", "last"), groups, "group")
    said = blocks.join(whole_text(rows, blocks.select("path", "element", "last").distinct()), ["path", "element"]).groupBy("path", "group").agg(F.min_by("whole", "element").alias("body"))
    told = groups.select("path", "root", F.col("element").alias("group")).join(heads.hint("merge"), ["path", "group"]).join(said.hint("merge"), ["path", "group"])
    all_ = F.col("head").contains("主持") | (F.col("body").contains("主持") & F.col("body").contains("全面")) | F.col("body").contains("负责全面工作")
    liaison = ~all_ & F.col("head").contains("联系")
    listed = duty(F.concat(F.lit("分管工作："), F.col("body")))["departments"]
    leads = ~all_ & ~liaison & F.col("head").contains("分管")
    none = F.array().cast("array<string>")
    sums = told.groupBy("path", F.col("root").alias("element")).agg(
        F.bool_or(all_).alias("all"), F.bool_or(leads).alias("leads"), F.max_by(F.when(leads, listed), F.when(leads, F.col("group"))).alias("own"), F.max_by(F.when(liaison, listed), F.when(liaison, F.col("group"))).alias("other"))
    return sums.select(
        "path", "element", F.when(F.col("all"), "主持全面工作").when(F.col("leads"), "分管工作").when(F.size(F.coalesce("other", none)) > 0, "主持全面工作").alias("duty_summary"),
        F.when(F.size(F.coalesce("own", none)) > 0, F.col("own")).otherwise(F.coalesce("other", none)).alias("departments"))


# ---------------------------------------------------------------- layouts
def side_links(rows: DataFrame) -> DataFrame:
    """Names linked in a page's side: of its containers (by class, or around a heading) the one with most names, two at least."""
    links = rows.where("tag = 'a' AND href IS NOT NULL AND href NOT LIKE 'javascript:%'").withColumn("person", _person(bare(F.col("text")))).where(F.col("person").isNotNull() & F.col("href").rlike(LEADERISH))
    heads = rows.where((F.col("tag") == "#text") & F.col("text").rlike(HEADINGS)).select("path", F.col("parent").alias("element"))
    around, step = None, heads
    for _ in range(8):  # a heading's container is at most so far above
        around = step if around is None else around.unionByName(step)
        step = step.join(rows.select("path", "element", "parent"), ["path", "element"]).select("path", F.col("parent").alias("element")).where("element IS NOT NULL")
    boxes = rows.where(has_class(*SIDES)).select("path", "element", "last").unionByName(around.join(rows.select("path", "element", "last"), ["path", "element"])).distinct()
    inside = within(links, boxes, "box").groupBy("path", "box", "person").agg(F.min_by(F.struct("element", "href"), "element").alias("x"))
    best = inside.groupBy("path", "box").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("path").agg(F.max_by("box", F.struct("n", -F.col("box"))).alias("box"))
    found = inside.join(best.hint("merge"), ["path", "box"]).select("path", "person", "x.*")
    return _leader(found, "side", person=F.col("person"), href=F.col("href"))


def written(rows: DataFrame) -> DataFrame:
    """Profiles that scripts write, with the duties of the list item they stand in."""
    scripts = rows.where("tag = 'script'").select("path", "element", F.regexp_extract("text", _WRITTEN, 1).alias("said"))
    profile = _profile(F.col("said"))
    scripts = scripts.withColumns(profile).where(plausible_name(F.col("person")) & F.col("gender").isNotNull() & F.col("title").rlike(LEADERS_WORDS))
    lists = rows.where((F.col("tag") == "ul") & has_class("xxgkleaderlists")).select("path", F.col("element").alias("parent"))
    items = rows.where("tag = 'li'").join(lists, ["path", "parent"]).select("path", "element", "last")
    of_item = within(scripts.select("path", "element"), items, "item")
    told = _groups(rows, items, "group1").withColumnRenamed("element", "item")
    found = scripts.join(of_item, ["path", "element"], "left").join(told.hint("merge"), ["path", "item"], "left")
    by_title = F.when(F.col("title").contains("书记") & F.col("title").contains("局长"), "主持全面工作").when(F.col("title").rlike("副局长|总会计师|总审计师|总经济师|纪检|副书记|巡视员"), "分管工作")
    return _leader(found, "written", **{c: F.col(c) for c in profile}, duty_summary=F.coalesce("duty_summary", by_title), departments=F.coalesce("departments", F.array().cast("array<string>")))


def name_and_title_in_link(rows: DataFrame) -> DataFrame:
    """Links of a list that hold the name in a span and the title in a p."""
    lists = rows.where((F.col("tag") == "ul") & has_class("list_lefnavLdjj"))
    links = within(rows.where("tag = 'a'").select("path", "element", "last", "href"), lists, "list").drop("list").distinct()
    part = lambda tag, name: within(rows.where(F.col("tag") == tag).select("path", "element", "text"), links, "link").groupBy("path", F.col("link").alias("element")).agg(F.min_by(bare(F.col("text")), "element").alias(name)).hint("merge")
    found = links.join(part("span", "name"), ["path", "element"]).join(part("p", "post"), ["path", "element"]).withColumn("name", clean_name(F.col("name")))
    found = found.where(plausible_name(F.col("name")) & F.col("post").rlike(LEADERS_WORDS))
    return _leader(found, "span and p", person=F.col("name"), title=F.col("post"), href=F.col("href"))


def cards(rows: DataFrame) -> DataFrame:
    """Cards: a link "name title" in a block tit, and gender and people in the block zhaiyao that follows it; two a page at least."""
    tits = rows.where((F.col("tag") == "div") & has_class("tit")).select("path", "element", "last", F.coalesce("parent", F.lit(-1)).alias("parent"))
    links = within(rows.where((F.col("tag") == "a") & F.col("href").contains("/art/")).select("path", "element", "href", "text"), tits, "tit")
    links = links.groupBy("path", F.col("tit").alias("element")).agg(F.min_by(F.struct("href", spaced(F.col("text")).alias("label")), "element").alias("x")).select("path", "element", "x.*")
    abouts = rows.where((F.col("tag") == "div") & has_class("zhaiyao")).select("path", "element", "last", F.coalesce("parent", F.lit(-1)).alias("parent"))
    following = abouts.select("path", "parent", F.col("element").alias("about")).join(tits.select("path", "parent", "element"), ["path", "parent"]).where("about > element").groupBy("path", "element").agg(F.min("about").alias("about"))
    texts = whole_text(rows, abouts).withColumnRenamed("element", "about")
    found = links.join(following.hint("merge"), ["path", "element"], "left").join(texts, ["path", "about"], "left")
    label = rf"^({_NAME})\s*(?:[（(]\s*|\s)([^（()）]+?)[）)]?$"
    # In a summary the name stands before gender and people.
    found = found.withColumns({
        "person": clean_name(F.regexp_extract("label", label, 1)), "post": bare(F.regexp_extract("label", label, 2)),
        "gender": F.nullif(F.regexp_extract("whole", rf"{_NAME}\s*[,，：:（(]\s*(男|女)", 1), F.lit("")), "people": F.nullif(F.regexp_extract("whole", r"(?:男|女)\s*[,，]\s*([一-龥]+族)", 1), F.lit(""))})
    found = found.where(plausible_name(F.col("person")) & F.col("post").rlike(LEADERS_WORDS))
    found = found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("path"))).where("_n >= 2")
    return _leader(found, "cards", person=F.col("person"), title=F.col("post"), gender=F.col("gender"), people=F.col("people"), href=F.col("href"))


def paired_links(rows: DataFrame) -> DataFrame:
    """A title and a name that link to one address, in either order: links grouped by address, the last of each counts."""
    links = rows.where("tag = 'a' AND href IS NOT NULL AND href NOT LIKE 'javascript:%'").select("path", "element", "href", bare(F.col("text")).alias("label"))
    role = F.regexp_replace("label", "[：:]+$", "")
    is_role = role.isin(*ROLES) | (F.col("label").rlike(f"^(?:{'|'.join(ROLES)})|[：:]$") & role.rlike(LEADERS_WORDS))
    both = r"^([^：:]+)[：:]([一-龥·]{2,8})$"
    one = ~is_role & F.col("label").rlike(both) & F.regexp_extract("label", both, 1).rlike(LEADERS_WORDS)
    title = F.when(is_role, role).when(one, F.regexp_extract("label", both, 1))
    name = F.when(one, clean_name(F.regexp_extract("label", both, 2))).when(~is_role, _person(F.col("label")))
    found = links.withColumns({"post": title, "name": name}).groupBy("path", "href").agg(
        F.max_by("post", F.when(F.col("post").isNotNull(), F.col("element"))).alias("post"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("element"))).alias("name"), F.min("element").alias("element"))
    found = found.where(F.col("post").isNotNull() & plausible_name(F.col("name")))
    ranks = F.create_map(*[F.lit(x) for kv in PARTY_RANKS.items() for x in kv])
    return _leader(found, "paired", person=F.col("name"), title=F.coalesce(F.try_element_at(ranks, F.col("post")), F.col("post")), href=F.col("href"))


def profile_pane(rows: DataFrame) -> DataFrame:
    """A pane ldjjjj with one profile, and the page's groups ldjjgroup with what the person is in charge of."""
    panes = rows.where(has_class("ldjjjj")).select("path", "element", "last")
    texts = whole_text(rows, panes)
    profile = _profile(F.col("whole"))
    found = texts.withColumns(profile).where(plausible_name(F.col("person")) & F.col("gender").isNotNull())
    roots = rows.where("parent IS NULL AND tag <> '#text'").select("path", "element", "last")
    told = _groups(rows, roots, "ldjjgroup").groupBy("path").agg(F.min_by(F.struct("duty_summary", "departments"), "element").alias("d"))
    found = found.join(told.hint("merge"), "path", "left")
    by_title = F.when(F.col("title").contains("书记") & F.col("title").contains("局长"), "主持全面工作")
    return _leader(found, "pane", **{c: F.col(c) for c in profile}, duty_summary=F.coalesce("d.duty_summary", by_title), departments=F.coalesce("d.departments", F.array().cast("array<string>")))


LAYOUTS = (written, profile_pane, cards, name_and_title_in_link, paired_links, side_links)


def leaders_in_elements(rows: DataFrame) -> DataFrame:
    """The leaders that the layouts find, a row for each name of a page: of what several say, the first of LAYOUTS counts.

    Every layout reads the elements several times, so they are written down first. Joins within pages are merged: the driver
    would hold the smaller sides of all of them at once if they were sent to it.
    """
    rows, found = staged(rows, "elements").hint("merge"), None
    for place, layout in enumerate(LAYOUTS):
        part = layout(rows).withColumn("place", F.lit(place))
        found = part if found is None else found.unionByName(part)
    order = F.struct("place", "at")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    lists = F.when(F.size("departments") > 0, order)
    return found.groupBy("path", "person").agg(
        F.min_by("layout", order).alias("layout"), *[first(c) for c in ("title", "gender", "people", "href", "duty_summary")], F.coalesce(F.min_by("departments", lists), F.array().cast("array<string>")).alias("departments"))


def link_targets(rows: DataFrame) -> DataFrame:
    """Links to follow from a page of leaders: path, href, at; each address (without its query) once, in order.

    Links in a page's side count if they are named like a person or lead to leaders' paths, others if they do both, or lead to
    an article below such a path.
    """
    link = F.coalesce((F.col("tag") == "a") & (F.col("href") != "") & ~F.col("href").like("javascript:%"), F.lit(False))
    person = lambda c: F.when(link, _person(bare(F.col(c))).isNotNull()).alias(f"by_{c}")
    # Pages are read once: what counts of them is written down, with the tests of names.
    rows = staged(rows.where(link | has_class(*SIDES)).select("path", "element", "last", F.when(link, F.col("href")).alias("href"), has_class(*SIDES).alias("box"), person("text"), person("title")), "links").hint("merge")
    links, boxes = rows.where("href IS NOT NULL"), rows.where("box").select("path", "element", "last")
    beside = within(links.select("path", "element"), boxes, "box").select("path", "element").distinct().withColumn("side", F.lit(True))
    links = links.join(beside, ["path", "element"], "left")
    named = F.col("by_text") | F.col("by_title")
    detail = F.col("href").rlike(r"(?i)/(?:ldzl|ldjj|ldjs)/.+/content_")
    by_side = F.coalesce("side", F.lit(False)) & (F.col("by_text") | F.col("href").rlike("ldjj|ldjs|ldjianjie|010002"))
    found = links.where(by_side | detail | (named & F.col("href").rlike(f"{LEADERISH}|{COLUMN}")))
    key = F.regexp_replace(F.split_part("href", F.lit("?"), F.lit(1)), "/+$", "")
    return found.groupBy("path", key.alias("_key")).agg(F.min_by(F.struct("href", F.col("element").alias("at")), F.struct(~by_side, F.col("element"))).alias("x")).select("path", "x.href", "x.at")
