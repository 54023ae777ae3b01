"""Units that posts are in: their names, levels and categories as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .titles import compact, normalize_title

# Words of units that are sent out or attached; labels of categories; marks of levels in a title's label.
SENT_OUT = ("特派", "纪检组", "派出", "驻")
ATTACHED = ("中心", "学院", "研究所", "培训", "党校", "杂志社", "报社", "出版社")
CATEGORIES = {"internal": "内设", "direct": "直属", "dispatched": "派出", "headquarters": "总局", "municipality": "直辖市", "province": "省份", "autonomous": "自治区"}
LEVEL_MARKS = {"总局": "headquarters", "省级": "province", "市局": "city", "区县": "district"}
# The head's name, what ends a bureau's name, words of places and of titles, the post at the bureau itself.
HEAD = "国家税务总局"
BUREAU = "税务局|税务分局|稽查局"
PLACES = "省|市|州|盟|旗|区|县|自治区|自治州|生态城|新区|开发区"
TITLE_WORDS = "副?局长|副?科长|副?处长|主任|主办|调研员|巡视员|职级"
OWN = "本局"
EDGES = "，,；;、 "


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _strip(c: Column, chars: str = EDGES) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def _before_leave(raw: Column) -> Column:
    return F.regexp_replace(F.split(compact(_text(raw)), "[，,；;。]?(?:同时)?免去")[0], "[（(][）)]", "")


def level(text: Column) -> Column:
    """A known level, district for anything else."""
    return F.when(text.isin(*LEVEL_MARKS.values()), text).otherwise("district")


def short_name(name: Column, parent: Column | None = None) -> Column:
    """A bureau's name without the words all have and without its parent's; the name where nothing is left, — for none."""
    bare = lambda x: F.trim(F.regexp_replace(_text(x), f"{HEAD}|税务局", ""))
    text = bare(name)
    if parent is not None:
        above = short_name(parent)
        text = F.when(text.startswith(above), F.trim(F.substring(text, F.length(above) + 1, F.length(text)))).otherwise(text)
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(name, F.lit("")), F.lit("—"))


def posting_unit(raw: Column) -> Column:
    """The bureau of a noisy unit, without department, title and what it leaves; '' where there is none."""
    text = _strip(_before_leave(raw))
    # One pattern, as each further use of the text would compute it again: a bureau, else what is no title and not too long.
    return F.regexp_extract(text, f"^(?:.*税务分局|.*税务局|.*稽查局|(?!.*(?:{TITLE_WORDS})).{{1,40}}$)", 0)


def department_label(raw: Column) -> Column:
    """A department without ranks at its end and what follows a leave; '' for none."""
    text = F.regexp_replace(_before_leave(raw), "、?(?:[一二三四五六七八九十百]+级)?(?:高级)?主办(?:职级)?$", "")
    return _strip(F.regexp_replace(text, "职级$", ""))


def title_display(raw: Column, canonical: Column) -> Column:
    """The title with its rank in brackets; — for none."""
    named = normalize_title(F.coalesce(F.nullif(raw, F.lit("")), canonical))
    return F.coalesce(F.concat(named["canonical"], F.coalesce(F.concat(F.lit("（"), named["rank_hint"], F.lit("）")), F.lit(""))), F.lit("—"))


def is_head(unit: Column) -> Column:
    """Whether a unit is the head office or within it, not a bureau below that has its name in front."""
    text = F.trim(_text(unit))
    rest = _strip(F.regexp_extract(text, f"{HEAD}(.*)$", 1), " （()）")
    return text.contains(HEAD) & ((rest == "") | ~rest.rlike(f"{BUREAU}|{PLACES}"))


def level_of_unit(unit: Column) -> Column:
    """The level that a unit's wording shows; null for none."""
    text = F.trim(_text(unit))
    return (
        F.when(is_head(text), "headquarters").when(text.rlike("税务分局|稽查局|税务所(?:$|[（(])"), "district").when(text.rlike("(?:省|自治区).{0,12}税务局"), "province")
        .when(text.rlike("(?:市|州|盟).{0,12}税务局"), "city").when(text.rlike("(?:区|县|旗|生态城|保税).{0,12}税务局"), "district").when(text.startswith(HEAD) & text.contains("税务局"), "city"))


def primary_bureau(unit: Column) -> Column:
    """The first bureau that a unit's text names, before any clause; the text before it where it names none."""
    head = F.split(F.trim(_text(unit)), "[，,；;。]|免去|同时免去")[0]
    named = F.regexp_extract(head, f"(?:{HEAD})?[一-龥A-Za-z0-9（）()]{{2,40}}?(?:税务分局|稽查局|税务局)", 0)
    return F.trim(F.coalesce(F.nullif(named, F.lit("")), head))


def category(dept: Column, title: Column, unit: Column, at_level: Column, name: Column) -> Column:
    """internal, direct or dispatched at the head office, else what the bureau's name says; '' for none."""
    words = F.concat(_text(dept), _text(title), _text(unit))
    name = _text(F.coalesce(name, unit))
    at_head = F.when(_text(dept).rlike("|".join(ATTACHED)), "direct").otherwise("internal")
    return (
        F.when(words.rlike("|".join(SENT_OUT)), "dispatched").when(at_level == "headquarters", at_head).when(name.rlike("北京市|天津市|上海市|重庆市"), "municipality")
        .when(name.contains("自治区"), "autonomous").when(at_level == "province", "province").otherwise(""))


def category_label(of: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, of), of)


def head_bucket(cat: Column, dept: Column, shown: Column, unit: Column) -> Column:
    """Place within the head office: 0 its leaders, 1 departments, 2 attached, 3 sent out. shown: the unit as displayed."""
    dept, shown, unit = F.trim(_text(dept)), F.trim(_text(shown)), F.trim(_text(unit))
    bare = (dept == "") & (shown.isin("", HEAD, "总局", "—") | unit.isin("", HEAD, "总局"))
    return (
        F.when((cat == "dispatched") | F.concat(dept, shown, unit).rlike("|".join(SENT_OUT)), 3).when((cat == "direct") | F.concat(dept, shown).rlike("|".join(ATTACHED)), 2)
        .when(bare, 0).when((cat == "internal") | (dept != ""), 1).otherwise(0))


def post_department(dept: Column, unit: Column, bureau: Column) -> Column:
    """A post's department: with the unit in front where that is one below its bureau, 本局 where neither is given."""
    unit = F.trim(_text(unit))
    short = short_name(unit, bureau)
    below = unit.contains("税务局") & (unit != _text(bureau)) & (short != short_name(bureau))
    return F.coalesce(F.nullif(F.concat_ws(" · ", F.when(below, short), F.nullif(F.trim(_text(dept)), F.lit(""))), F.lit("")), F.lit(OWN))


def after_bureau(primary: Column, short: Column) -> Column:
    """What a unit's first bureau (primary_bureau) has beside a bureau's short name."""
    rest = F.regexp_replace(primary, f"^{HEAD}", "")
    return _strip(F.regexp_replace(rest, F.concat(F.lit("^(.*?)\\Q"), short, F.lit("\\E")), F.lit("$1")), " （()）")


def in_bureau_itself(primary: Column, rest: Column, name: Column, short: Column, at_level: Column, named_code: Column, code: Column) -> Column:
    """Whether a unit is a city's or district's own and not another's below it; true for other levels and without a unit.

    primary and rest: primary_bureau and after_bureau of the unit. named_code: the bureau that the unit names, null for none.
    """
    below = F.when(rest.rlike("^.{0,12}?(?:区|县|旗).{0,12}?税务"), False).when((rest == "") | rest.startswith("第") | rest.contains("税务分局") | rest.rlike("(?:科|处|室|所|中心)$"), True).otherwise(~rest.rlike(BUREAU))
    return F.when(~F.coalesce(at_level.isin("city", "district"), F.lit(False)) | (primary == ""), True).when(primary.contains(name), True).when(
        (F.length(short) >= 2) & primary.contains(short), below).when(named_code.isNotNull(), named_code == code).otherwise(~primary.rlike(BUREAU))


def watch_target(kind: Column, target: Column) -> Column:
    """STRUCT(bureau, dept, title, person) of a watch's target: a code, code:name, code::dept or code::dept::title."""
    kind, target = F.trim(kind), F.trim(target)
    part = lambda n: F.get(F.split(target, "::", 3), n)
    none = F.lit(None).cast("string")
    of_post = kind.isin("department", "post")
    named = (kind == "person") & target.contains(":")
    return F.struct(
        F.when(kind == "bureau", target).when(of_post, part(0)).when(named, F.nullif(F.regexp_extract(target, "^([^:]*):", 1), F.lit(""))).otherwise(none).alias("bureau"),
        F.when(of_post, part(1)).alias("dept"), F.when(kind == "post", part(2)).alias("title"),
        F.when(kind == "person", F.when(named, F.regexp_extract(target, "^[^:]*:(.*)$", 1)).otherwise(target)).alias("person"))


def title_query(label: str | None) -> tuple[str, str | None]:
    """Title and level of a label such as 副所长（区县）, which a user gives as a parameter."""
    text = (label or "").strip()
    found = re.fullmatch(f"(.+?)（({'|'.join(LEVEL_MARKS)})）", text)
    return (found[1].strip(), LEVEL_MARKS[found[2]]) if found else (text, None)
