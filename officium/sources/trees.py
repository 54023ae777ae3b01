"""Shells that load a bureau's lists into a page: where the list and its tree of kinds are, and which kind is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the shells' calls, and labels by kind, the first that a tree has.
TREE = r"""(?i)src\s*=\s*['"]([^'"]*xxgk/tree\.jsp\?[^'"]+)['"]"""
AREA, BLOCK = r"(?i)(?:[?&]|&amp;)area=([0-9A-Za-z]+)", r"(?i)(?:[?&]|&amp;)divid=(div\d+)"
LOADED = r"""(?is)loadDynamic\(\s*['"][^'"]*xxgk/search\.jsp.*?area=([0-9A-Za-z]+)['"](?:\s*\+\s*[^,]+)*\s*,\s*['"]([^'"]+)['"]((?:\s*,\s*['"][^'"]*['"]){0,4})"""
NODE = r"""(?i)funclick\(\s*\\?['"]([A-Za-z0-9]+)\\?['"][^)]*\)[^<>]{0,80}>\s*([^<]{1,40})"""
WANTED = {"appointment": ("人事任免", "干部任免"), "leader": ("领导简介", "领导介绍", "现任领导")}
PART = {"appointment": "任免", "leader": "领导"}


def _got(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def shells(pages: DataFrame) -> DataFrame:
    """area, block, webid and tree_url of pages (path, url, html) that are shells.

    The area of the address counts before that of the tree's frame, this before that of a loading call, then any in the
    text. A shell without a block has ``div4``; one without a frame has the tree's usual address.
    """
    html, url = F.col("html"), F.col("url")
    of_url = F.coalesce(_got(url, r"[?&]vc_xxgkarea=([^&#]+)"), _got(url, r"[?&]area=([^&#]+)"))
    frame = _got(html, TREE)
    area = F.coalesce(of_url, _got(frame, AREA), _got(html, LOADED), _got(html, "(?i)vc_xxgkarea=([0-9A-Za-z]+)"))
    block = F.coalesce(_got(frame, BLOCK), _got(html, LOADED, 2), F.lit("div4"))
    # The call's sixth argument, where it has so many.
    webid = F.coalesce(_got(_got(html, LOADED, 3), r"""(?:,\s*['"][^'"]*['"]\s*){3},\s*['"]([^'"]+)['"]"""), F.lit("1"))
    site = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+", 0)
    plain = F.regexp_replace(frame, "&amp;", "&")
    folder = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "[^/]*$", "")
    tree = F.when(plain.rlike("^[a-zA-Z]+://"), plain).when(plain.startswith("/"), F.concat(site, plain)).when(plain.isNotNull(), F.concat(folder, plain)).otherwise(
        F.concat(site, F.lit("/module/xxgk/tree.jsp?standardXxgk=1&area="), area, F.lit("&divid="), block))
    return pages.select("path", area.alias("area"), block.alias("block"), webid.alias("webid"), tree.alias("tree_url")).where("area IS NOT NULL")


def tree_labels(trees: DataFrame) -> DataFrame:
    """path, label, kind, at: the nodes of trees (path, html), each label once, in order."""
    found = F.transform(F.regexp_extract_all("html", F.lit(NODE), F.lit(0)), lambda m, i: F.struct(F.regexp_replace(F.regexp_extract(m, NODE, 2), r"\s+", "").alias("label"), F.regexp_extract(m, NODE, 1).alias("kind"), i.alias("at")))
    rows = trees.select("path", F.explode(found).alias("x")).select("path", "x.*").where("label <> ''")
    return rows.groupBy("path", "label").agg(F.min_by(F.struct("kind", "at"), "at").alias("x")).select("path", "label", "x.kind", "x.at")


def wanted_kind(labels: DataFrame, want: str) -> DataFrame:
    """path and kind: a tree's node for ``want`` (appointment or leader): by its usual labels in turn, else by a part of one."""
    usual = F.array_position(F.array(*[F.lit(x) for x in WANTED[want]]), F.col("label"))
    rank = F.when(usual > 0, usual).when(F.col("label").contains(PART[want]), len(WANTED[want]) + 1)
    return labels.where(rank.isNotNull()).groupBy("path").agg(F.min_by("kind", F.struct(rank.cast("long"), "at")).alias("kind"))
