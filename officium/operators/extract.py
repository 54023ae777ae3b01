"""Appointment events out of notices' texts: patterns of clauses as DataFrame steps, no Python per row.

A text is cut at the decision and into clauses; each pattern gives its matches of a clause; matches become rows, which are
cleaned, tested and split into unit, department and title. Only the last step, which keeps a notice's first event of each
kind, needs a notice's rows together: so notices are dealt out first, and what is made of them is not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.persons import clean_name, plausible_name
from ..functions.titles import once
from ..sources.staging import dealt

# Endings that are titles, longest of a kind first.
TITLES = (
    "常务副局长 副局长 局长 副司长 司长 副科长 科长 副所长 所长 副处长 处长 副主任 主任 副校长 校长 纪检组组长 副组长 组长 党委书记 党委委员 总法律顾问 总会计师 总经济师 总审计师 "
    "一级巡视员 二级巡视员 巡视员 一级高级主办 二级高级主办 三级高级主办 四级高级主办 一级主办 二级主办 三级主办 四级主办 高级主办 主办 一级调研员 二级调研员 三级调研员 四级调研员 调研员"
).split()
# Where a decision begins; what shows a post; words that a department doesn't hold.
MARKERS = "决定，任命 决定:任命 决定：任命 决定，免去 决定：免去 任命： 任命:".split()
POST_WORDS = "税务|处|科|所|局|办公室|中心|纪检|党委|分局"
RESIDUE = "试用期|任命|免去|通知"
RANK = "(?:[一二三四]级)?(?:高级)?(?:主办|调研员|巡视员)"
UNITS = ("税务分局", "税务局", "干部学校", "稽查局")
HEAD = "国家税务总局"
PROBATION = "(?:任职)?试用期为?(一|二|1|2)年"
_NAME, _REST, _LINE = "([一-龥·]{2,4})", "([^；。;，,]+)", "([^；。;]+?)"
# Patterns by order of trial: name first, then post.
DISMISS = (
    f"{_NAME}不再(?:担任|兼任)([^；。;]+)", f"{_NAME}不再聘任(?:为)?([^；。;]+)", f"免去{_NAME}同志(?:的)?{_LINE}(?:职务|职级)", f"免去{_NAME}的{_LINE}(?:职务|职级)",
    f"免去{_NAME}()(?:职务|职级)", f"免去{_NAME}({HEAD}[^；。;]+?)(?:职务|职级)")
AS = f"(?:(?:任命|聘任)[:：]?)?{_NAME}(?:同志)?(?<![行无以])为{_REST}"
APPOINT = (f"{_NAME}正式任用为{_REST}", f"{_NAME}任用为{_REST}", f"{_NAME}挂职任{_REST}", f"(?:任命[:：]?)?{_NAME}同志担任{_REST}", AS, f"{_NAME}任职试用期满[^。；;]{{0,40}}按期转正，任{_REST}")
BARE = f"{_NAME}任([^；。;]+)"
ROSTER = f"(?<!免){_NAME}({HEAD}[一-龥、]{{2,80}}?(?:{'|'.join(TITLES)}))(?=(?:[（(]|[一-龥]{{2,4}}{HEAD}|$))"
_NO_ACT = "^[〔﹝\\[【]"


def join_cjk(text: Column) -> Column:
    """Without the white space between two Chinese letters."""
    return F.regexp_replace(text, r"(?U)(?<=[一-龥])\s+(?=[一-龥])", "")


def decision(text: Column) -> Column:
    """The text from the first marker of a decision on; all of it without one."""
    places = [F.when(F.locate(m, text) > 0, F.locate(m, text)) for m in MARKERS]
    return F.coalesce(F.substring(text, F.least(*places), F.length(text)), text)


def clauses(text: Column) -> Column:
    """Trimmed clauses; one that begins with a probation stays with the clause before it."""
    joined = F.regexp_replace(text, r"(?U)(?<=[^。；;\s])\s*[。；;][。；;\s]*(?=(?:任职)?试用期)", "，")
    return F.filter(F.transform(F.split(joined, "[。；;]"), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), lambda c: c != "")


def probation_years(clause: Column) -> Column:
    years = F.regexp_extract(clause, PROBATION, 1)
    return F.when(years == "", F.lit(None).cast("int")).when(years.isin("二", "2"), 2).otherwise(1)


def looks_like_post(post: Column) -> Column:
    bare = F.regexp_replace(post, "[（(][^）)]*级[）)]", "")
    bad = post.rlike(r"^(?:免|职|用期|[〔﹝\[【]|[0-9]{4}[〕﹞\]])|^.{0,4}通知|^.{0,16}发文单位|^.{0,27}索引号")
    return (post != "") & ~bad & (bare.rlike(f"(?:{'|'.join(TITLES)})$") | post.rlike(POST_WORDS))


def _strip(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def split_posts(rows: DataFrame, post: str) -> DataFrame:
    """rows with unit, dept and title of a post such as 保税区税务分局法制科副科长; null for what it lacks.

    Ranks that go with a title stay with it; a rank alone is the title. Each step is a column of its own, so that no
    expression is computed twice.
    """
    null = lambda c: F.nullif(c, F.lit(""))
    rows = rows.withColumn("_p", _strip(F.regexp_replace(F.regexp_replace(F.coalesce(post, F.lit("")), r"(?U)\s+", ""), "职务", ""), "的"))
    rows = rows.withColumn("_p", _strip(F.split(_strip(F.regexp_replace("_p", PROBATION, ""), "，, 、"), "[，,]?(?:任职)?试用期")[0], "，, "))
    rows = rows.withColumn("_p", _strip(F.regexp_replace(F.regexp_replace("_p", "[（(][^）)]*级[）)]", ""), "、+", "、"), "、"))
    with_ranks = f"^(.*?)((?:、{RANK})*)$"
    rows = rows.withColumns({"_main": F.regexp_extract("_p", with_ranks, 1), "_ranks": F.regexp_extract("_p", with_ranks, 2)})
    rows = rows.withColumn("_title", F.regexp_extract("_main", f"(?:{'|'.join(TITLES)})$", 0))
    alone = (F.col("_title") == "") & (F.col("_ranks") != "")
    rows = rows.withColumn("title", null(F.when(alone, F.substring("_ranks", 2, 200)).otherwise(F.concat("_title", "_ranks"))))
    rest = F.when(alone, "").otherwise(F.expr("substring(_main, 1, length(_main) - length(_title))"))
    rows = rows.withColumn("_rest", _strip(rest, "（）() 、"))
    unit, dept = F.when(F.col("_rest").startswith(HEAD), HEAD), F.when(F.col("_rest").startswith(HEAD), F.substring("_rest", len(HEAD) + 1, 200)).otherwise(F.col("_rest"))
    for u in reversed(UNITS):
        has = F.col("_rest").contains(u)
        unit, dept = F.when(has, F.regexp_extract("_rest", f"^(.*{u})", 1)).otherwise(unit), F.when(has, F.regexp_extract("_rest", f"^.*{u}(.*)$", 1)).otherwise(dept)
    rows = rows.withColumns({"unit": unit, "_dept": _strip(dept, "（）() ，,、")})
    bad = (F.col("_dept") == "") | F.col("_dept").rlike(RESIDUE) | F.col("_dept").rlike(f"^{RANK}$")
    return rows.withColumn("dept", F.when(~bad, F.col("_dept"))).drop("_p", "_main", "_ranks", "_title", "_rest", "_dept")


def _matches(text: Column, pattern: str, action: str, order: int) -> Column:
    """The pattern's matches: action, order of trial, name and post."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m, i: F.struct(F.lit(action).alias("action"), F.lit(order).alias("trial"), i.alias("at"), m.alias("match"), F.regexp_extract(m, pattern, 1).alias("raw"), F.regexp_extract(m, pattern, 2).alias("post")))


def appointment_events(notices: DataFrame) -> DataFrame:
    """Events (notice_id, n, person, action, unit, dept, title, probation_years, clause) of notices (notice_id, text).

    n numbers a notice's events in the order of its text. Null text has none. notice_id must be unique.
    """
    bodies = dealt(notices, "notice_id").select("notice_id", once(join_cjk(F.coalesce("text", F.lit(""))), decision).alias("body"))  # looked at for each marker
    rows = bodies.select("notice_id", "body", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), clauses(F.col("body")))).alias("clause_no", "clause"))
    patterns = [*[(p, "dismiss") for p in DISMISS], *[(p, "appoint") for p in APPOINT], (BARE, "appoint")]
    bare, roster = len(patterns) - 1, len(patterns)
    found = F.concat(*[_matches(F.col("clause"), p, act, i) for i, (p, act) in enumerate(patterns)])
    listed = _matches(F.col("body"), ROSTER, "appoint", roster)
    rows = rows.withColumn("m", F.explode(F.when(F.col("clause_no") == 0, listed).otherwise(found))).select("notice_id", "clause_no", "clause", "body", "m.*")
    rows = rows.withColumn("person", clean_name(F.col("raw")))
    dismissed, is_bare, is_listed = F.col("action") == "dismiss", F.col("trial") == bare, F.col("trial") == roster
    after_leave = F.col("clause").contains(F.concat(F.lit("免去"), "match")) | F.col("match").startswith("免去") | (F.col("match").startswith("去") & F.col("clause").contains(F.concat(F.lit("免"), "match")))
    good = looks_like_post(F.col("post")) & ~((F.col("trial") == len(DISMISS) + APPOINT.index(AS)) & F.col("post").startswith("任"))
    good &= ~(is_bare & (F.coalesce(after_leave, F.lit(False)) | F.col("raw").rlike("[担兼聘]$") | F.col("post").startswith("职试用期") | F.col("post").rlike(_NO_ACT)))
    # What fails a test is only marked until the end: a filter here would be moved below the steps and repeat them all.
    rows = split_posts(rows.withColumn("ok", plausible_name(F.col("person")) & (dismissed | good)), "post")
    rows = rows.withColumn("ok", F.col("ok") & (dismissed | F.coalesce("title", "dept").isNotNull()))
    years = F.when(~dismissed, probation_years(F.when(is_listed, F.expr("substring(body, locate(match, body) + length(match), 24)")).otherwise(F.col("clause"))))
    said = F.substring(F.when(is_listed, F.col("match")).otherwise(F.col("clause")), 1, 500)
    # Texts stay behind: the windows sort and hold the rest.
    order = ["clause_no", "trial", "at"]
    rows = rows.select("notice_id", *order, "person", "action", "unit", "dept", "title", years.alias("probation_years"), said.alias("clause"), "ok")
    clause, notice = Window.partitionBy("notice_id", "clause_no"), Window.partitionBy("notice_id")
    rows = rows.withColumn("sure", F.max(F.col("ok") & ~dismissed & ~is_bare & ~is_listed).over(clause))
    rows = rows.withColumn("ok", F.col("ok") & ~(is_bare & F.col("sure")))
    rows = rows.withColumn("read", F.max(F.col("ok") & ~is_listed).over(notice))
    rows = rows.withColumn("ok", F.col("ok") & ~(is_listed & F.col("read")))
    key = ["notice_id", "person", "action", F.coalesce("title", F.lit("")), F.coalesce("dept", F.lit(""))]
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ok"), *order))).where("again = 1 AND ok")
    return rows.select("notice_id", F.row_number().over(notice.orderBy(*order)).cast("long").alias("n"), "person", "action", "unit", "dept", "title", "probation_years", "clause")
