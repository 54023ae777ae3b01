"""Titles, departments and change types as Column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sort rank by title ending, in listing order.
TITLE_RANKS = {
    "党委书记": 10, "局长": 20, "常务副局长": 30, "纪检组组长": 40, "总法律顾问": 45, "总会计师": 46, "总经济师": 47, "总审计师": 48,
    "副局长": 50, "党委副书记": 55, "党委委员": 60, "司长": 65, "副司长": 68, "一级巡视员": 70, "二级巡视员": 75, "巡视员": 80,
    "处长": 90, "主任": 95, "一级高级主办": 100, "二级高级主办": 105, "三级高级主办": 110, "四级高级主办": 115, "副处长": 120,
    "副主任": 125, "调研员": 130, "科长": 140, "所长": 145, "一级主办": 150, "二级主办": 155, "三级主办": 160, "四级主办": 165,
    "副科长": 170, "副所长": 175, "组长": 180, "副组长": 185, "主办": 190, "专员": 200,
}
# Title ladder, lowest first.
LADDER = ("科员", "副科长", "科长", "副所长", "所长", "副处长", "处长", "副主任", "主任", "副局长", "局长", "总会计师", "总经济师", "总审计师", "一级巡视员", "二级巡视员", "党委书记")
# Kind by unit word, first that is contained.
KINDS = {"税务分局": "branch", "稽查局": "branch", "风险管理局": "branch", "税务所": "suo", "办公室": "office", "办公厅": "office", "处": "chu", "科": "ke", "司": "si", "中心": "other", "局": "other"}
# Words that a department is not, patterns it doesn't have, unit words, stems of cut names.
NOT_DEPARTMENTS = ("全面工作", "主持全面工作", "分管工作", "负责全面工作", "党委委员", "国家税务总局")
CLAUSE_WORDS = "任命|免去|同志|欢迎|经研究|决定|请大家"
TITLE_WORDS = "试用期|主办|调研员|巡视员|总会计师|总经济师|总审计师|书记|局长|处长|科长|所长|主任|任职|免职|转正"
UNIT_WORDS = "处|科|司|所|局|办公室|办公厅|中心|分局"
STEMS = {"货物": "货物和劳务税", "财产": "财产和行为税", "社保": "社会保险费", "社会保险费": "社会保险费", "收入核算": "收入核算", "征管": "征收管理", "收科": "税收科"}
RANK_HINT = "（[^）]+级）|\\([^)]+级\\)"
HOSTING = "主持[^，。；;]*工作"
SEVERAL_HOLDERS = "副|主办|调研员|巡视员|委员|成员|助理"


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def _first(cases: list[tuple[Column, object]], otherwise) -> Column:
    return reduce(lambda rest, case: F.when(case[0], F.lit(case[1]) if not isinstance(case[1], Column) else case[1]).otherwise(rest), reversed(cases), F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(compact(c), RANK_HINT, ""), HOSTING, "")


def normalize_title(raw: Column) -> Column:
    """STRUCT(canonical, rank_hint); null for an empty title."""
    hint = F.nullif(F.regexp_extract(compact(raw), "[（(]([^）)]+级)[）)]", 1), F.lit(""))
    canonical = F.regexp_replace(_bare(raw), "^[、，,；; ]+|[、，,；; ]+$", "")
    named = F.struct(F.when(canonical != "", canonical).otherwise(raw).alias("canonical"), hint.alias("rank_hint"))
    return F.when(F.coalesce(raw, F.lit("")) != "", named)


def title_sort_rank(raw: Column) -> Column:
    """Rank of the first of concurrent titles by its longest known ending; 800 unknown, 900 missing."""
    ranks = F.create_map(*[F.lit(x) for kv in TITLE_RANKS.items() for x in kv])
    lasts = sorted({t[-1] for t in TITLE_RANKS})

    def rank(head: Column) -> Column:
        ending = F.regexp_extract(head, f"(?:{'|'.join(TITLE_RANKS)})$", 0)  # the leftmost match is the longest ending
        return F.when(F.substring(head, -1, 1).isin(*lasts), F.coalesce(F.try_element_at(ranks, ending), F.lit(800))).otherwise(800)

    def first(text: Column) -> Column:
        head = F.regexp_replace(F.split_part(text, F.lit("、"), F.lit(1)), "^[，,；; ]+|[，,；; ]+$", "")
        return F.coalesce(F.nullif(head, F.lit("")), text)

    plain = ~raw.rlike(r"(?U)[\s、，,；;]|级|主持")  # most titles: nothing to take out, and one title alone
    known = F.when(plain, rank(raw)).otherwise(once(_bare(raw), lambda text: once(first(text), rank)))
    return F.when(F.coalesce(raw, F.lit("")) == "", 900).otherwise(known)


def level_rank(level: Column) -> Column:
    return _first([(level == n, i) for i, n in enumerate(("headquarters", "province", "city", "district"))], 9)


def ladder(title: Column) -> Column:
    """Highest step whose word the title contains, -1 if none."""
    return F.greatest(*[F.when(F.trim(F.coalesce(title, F.lit(""))).contains(t), i).otherwise(-1) for i, t in enumerate(LADDER)])


def several_holders(title: Column) -> Column:
    """Whether more than one person may hold a title at a time."""
    return F.split_part(F.trim(F.coalesce(title, F.lit(""))), F.lit("、"), F.lit(1)).rlike(SEVERAL_HOLDERS)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a lambda's parameter is no copy of the expression, which each use would be otherwise."""
    return F.get(F.transform(F.array(value), use), 0)


def clean_department(raw: Column) -> Column:
    """A department's name, or null for what isn't one."""
    text = F.regexp_replace(compact(raw), "^[、，,；;。的：:]+|[、，,；;。的：:]+$", "")
    text = F.regexp_replace(F.regexp_replace(text, "^国家税务总局", ""), r"^[（）()【】\[\]]+|[（）()【】\[\]]+$", "")

    def named(text: Column) -> Column:
        bad = (text == "") | text.isin(*NOT_DEPARTMENTS) | text.rlike(CLAUSE_WORDS) | text.rlike(TITLE_WORDS) | ~F.length(text).between(2, 24)
        return F.when(~bad, F.when(text.rlike(UNIT_WORDS), text).otherwise(_first([(text.startswith(s), full) for s, full in STEMS.items()], None)))

    return once(text, named)


def split_departments(raw: Column) -> Column:
    """Distinct cleaned departments of a glued field, in order; empty if there are none."""
    text = F.split(compact(raw), "联系单位|负责全面|分管工作|主持")[0]
    parts = F.transform(F.split(text, "[、，,；;。/｜|]"), clean_department)
    return F.coalesce(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def department_from_title(title: Column) -> Column:
    found = F.regexp_extract(compact(title), "([一-龥·（）()]{2,30}?(?:处|科|司|所|分局|办公室|办公厅|中心|局))", 1)
    return clean_department(F.nullif(found, F.lit("")))


def department_name(raw: Column, level: Column) -> Column:
    """A department's cleaned name; one without a unit word gets the level's."""
    unit = F.when(level.isin("headquarters", "province", "city"), "处").otherwise("科")
    return once(clean_department(raw), lambda text: F.when(text.rlike("处|科|司|所|局|办公室|中心|分局"), text).otherwise(F.concat(text, unit)))


def normalize_department(raw: Column, level: Column) -> Column:
    """STRUCT(name, kind): department_name and the kind of unit that it says, else that of the level."""
    default = _first([(level == "headquarters", "si"), (level.isin("province", "city"), "chu"), (level == "district", "ke")], "other")
    kind = lambda full: _first([(full.contains(w), k) for w, k in KINDS.items()], default)
    return once(department_name(raw, level), lambda full: F.when(full.isNotNull(), F.struct(full.alias("name"), kind(full).alias("kind"))))


RETIRES, CONFIRMS = "退休|离休|到龄", "试用期(?:已?满|期满)?.*转正|转正任职|期满转正"
MOVES, RISES = "调任|交流|挂职|兼任", "提任|晋升|提拔"


def leaves_post(action: Column, *texts: Column) -> Column:
    """Whether a change ends a post, that is whether classify_change gives retire or dismiss; earlier posts don't matter.

    texts as there: notice title, clause, title, department.
    """
    blob = F.concat(*[F.coalesce(t, F.lit("")) for t in texts])
    act = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    return blob.rlike(RETIRES) | (~blob.rlike(CONFIRMS) & ((act == "dismiss") | F.substring(blob, 1, 20).contains("免去")))


def takes_post(action: Column, *texts: Column) -> Column:
    """Whether a change gives a post: neither a leave nor of an unknown type."""
    blob = F.concat(*[F.coalesce(t, F.lit("")) for t in texts])
    act = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    return ~leaves_post(action, *texts) & ((act == "appoint") | blob.rlike(f"{CONFIRMS}|{MOVES}|{RISES}"))


def classify_change(action: Column, title: Column, dept: Column, notice_title: Column, clause: Column, prev_title: Column, prev_dept: Column) -> Column:
    """retire, probation_confirm, dismiss, transfer, promote, appoint or unknown; the order of the tests counts."""
    text = lambda c: F.coalesce(c, F.lit(""))
    blob = F.concat(text(notice_title), text(clause), text(title), text(dept))
    act = F.lower(F.trim(text(action)))
    cur, prev = F.trim(text(dept)), F.trim(text(prev_dept))
    known = (act == "appoint") & (text(prev_title) != "")
    return _first([
        (blob.rlike(RETIRES), "retire"),
        (blob.rlike(CONFIRMS), "probation_confirm"),
        ((act == "dismiss") | F.substring(blob, 1, 20).contains("免去"), "dismiss"),
        (blob.rlike(MOVES), "transfer"),
        (blob.rlike(RISES), "promote"),
        (known & (ladder(title) > ladder(prev_title)), "promote"),
        (known & (prev != "") & (cur != "") & (prev != cur), "transfer"),
        (known & (prev_title != text(title)) & (cur != "") & (prev == cur), "promote"),
        (act == "appoint", "appoint")], "unknown")
