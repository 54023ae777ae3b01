"""Pages as rows of elements, and the layouts' edges."""

from pyspark.sql import functions as F

from officium.sources import elements, trees


def rows_of(spark, *pages):
    return elements.elements(spark.createDataFrame(list(enumerate(pages)), "path long, html string"))


def test_elements_know_their_places(spark):
    rows = rows_of(spark, "<div id=a class='x  y'><p>One <b>two</b><br/>three<p>four</div></i>five &amp; six<script>var a = '</p>';</script>", None, "", "plain")
    got = {(r["path"], r["element"]): r for r in rows.collect()}
    page = [got["0", i] for i in range(len([k for k in got if k[0] == "0"]))]
    assert [r["tag"] for r in page] == ["div", "p", "#text", "b", "#text", "br", "#text", "p", "#text", "#text", "script", "#text"]
    assert [(r["parent"], r["last"]) for r in page[:4]] == [(None, 8), (0, 8), (1, 2), (1, 4)]
    assert page[0]["classes"] == ["x", "y"] and page[0]["id"] == "a" and page[0]["text"] is None
    assert page[1]["text"] == "One twothreefour" and page[9]["text"] == "five & six" and page[10]["text"] == "var a = '</p>';"
    assert {k for k in got if k[0] != "0"} == {("3", 0)} and got["3", 0]["text"] == "plain"
    whole = elements.whole_text(rows, rows.where("tag = 'div'")).collect()
    assert [(r["element"], r["whole"]) for r in whole] == [(0, "One two three four")]


def test_a_side_needs_two_names_and_the_fullest_counts(spark):
    side = "<ul class=submenu>{}</ul><div class=left-box>{}</div>"
    link = "<a href='/ldjj/{0}.html'>{0}</a>"
    names = lambda *n: "".join(link.format(x) for x in n)
    rows = rows_of(spark, side.format(names("王小明", "李敏"), names("赵大力", "钱文", "孙健")), side.format(names("王小明"), names("李敏")), side.format(names("王小明", "李敏"), names("赵大力", "钱文")), names("王小明", "李敏"))
    got = {}
    for r in elements.side_links(rows).collect():
        got.setdefault(r["path"], set()).add(r["person"])
    assert got == {"0": {"赵大力", "钱文", "孙健"}, "2": {"王小明", "李敏"}}


def test_layouts_of_a_page_are_one_list(spark):
    """A pane and links in pairs of one page: the pane's title counts, the links' addresses are kept."""
    page = "<div class=ldjjjj>王小明，男，汉族，党委书记、局长。</div><a href='/a/1'>王小明</a><a href='/a/1'>局长</a><a href='/a/2'>李敏</a><a href='/a/2'>总会计师：</a><a href='/a/3'>赵大力</a>"
    got = {r["person"]: r.asDict() for r in elements.leaders_in_elements(rows_of(spark, page)).collect()}
    assert set(got) == {"王小明", "李敏"}
    assert (got["王小明"]["title"], got["王小明"]["href"], got["王小明"]["layout"], got["王小明"]["duty_summary"]) == ("党委书记、局长", "/a/1", "pane", "主持全面工作")
    assert got["李敏"]["title"] == "党委委员、总会计师"
    assert elements.leaders_in_elements(rows_of(spark, "")).count() == 0


def test_one_card_is_none(spark):
    card = "<div class=tit><a href='/art/2024/1/2/art_1_{0}.html'>{1} 局长</a></div>"
    rows = rows_of(spark, card.format(1, "王小明"), card.format(1, "王小明") + card.format(2, "李敏") + "<div class=zhaiyao>李敏，女，汉族</div>")
    got = {(r["path"], r["person"]): r["gender"] for r in elements.cards(rows).collect()}
    assert got == {("1", "王小明"): "女", ("1", "李敏"): "女"}  # the summary that follows a card is the next one


def test_shells_take_the_address_first(spark):
    rows = spark.createDataFrame([(1, "https://h.org/a/b.html?area=X1", '<iframe src="../xxgk/tree.jsp?area=Y2&amp;divid=div3">'), (2, "https://h.org/a", "no"), (3, None, None)], "path long, url string, html string")
    got = [tuple(r) for r in trees.shells(rows).collect()]
    assert got == [(1, "X1", "div3", "1", "https://h.org/a/../xxgk/tree.jsp?area=Y2&divid=div3")]
    assert trees.tree_labels(rows.withColumn("html", F.lit(""))).count() == 0
