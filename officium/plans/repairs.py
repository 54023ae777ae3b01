"""Queries of corrections, of events read again, and of units that clauses name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrections, reextract, tables, watching
from .bindings import appointments, table
from .facades import _LETTERS, ZH, zh_events
from .registry import _WATCH_ALL, _watches, query

# Renames out of nations: in each bureau chains, a cycle, a name that can't be one, and one onto itself.
_PAIRS = [("王甲甲", "王乙甲"), ("王乙甲", "王丙甲"), ("王丙甲", "李明甲"), ("王丁甲", "王戊甲"), ("王戊甲", "王丁甲"), ("王己甲", "通知"), ("王庚甲", "王庚甲"), ("王辛甲", "王甲甲"), ("李明甲", "赵明")]
_RENAMES = f"""ren AS (SELECT n_nationkey * 100 + i AS seq, n_nationkey AS bureau, old, new FROM nation, (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_PAIRS))}) v(i, old, new)),
act AS (SELECT * FROM ren WHERE old <> new AND new <> '通知'), nx AS (SELECT *, (SELECT min(l.seq) FROM act l WHERE l.bureau = act.bureau AND l.old = act.new AND l.seq > act.seq) AS nxt FROM act),
steps AS (SELECT p.bureau, p.person, nx.seq, nx.new AS name, nx.nxt FROM (SELECT DISTINCT bureau, person FROM zh) p JOIN nx ON nx.bureau = p.bureau AND nx.seq = (SELECT min(seq) FROM act a WHERE a.bureau = p.bureau AND a.old = p.person)
  UNION ALL SELECT s.bureau, s.person, nx.seq, nx.new, nx.nxt FROM steps s JOIN nx ON nx.bureau = s.bureau AND nx.seq = s.nxt)"""


def _renames(spark, d):
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("old"), F.lit(b).alias("new")) for i, (a, b) in enumerate(_PAIRS)]))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("bureau"), pairs.alias("x"))
    return rows.select((F.col("bureau") * 100 + F.col("x.i")).cast("long").alias("seq"), F.col("bureau"), "x.old", "x.new")


@query(f"""WITH RECURSIVE {ZH}, {_RENAMES}, fin AS (SELECT bureau, person, arg_max(name, seq) AS name FROM steps GROUP BY 1, 2)
SELECT z.bureau, coalesce(fin.name, z.person) AS person, count(*) AS n, min(id) AS first_id FROM zh z LEFT JOIN fin ON fin.bureau = z.bureau AND fin.person = z.person GROUP BY 1, 2""")
def corrections_renamed(spark, d):
    """Events by person after renames that follow one another, over each other and in a circle."""
    events = zh_events(spark, d)
    ends = corrections.final_names(corrections.rename_steps(events, _renames(spark, d)))
    return corrections.renamed(events, ends).groupBy("bureau", "person").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(f"""WITH RECURSIVE {ZH}, {_RENAMES}, c AS (SELECT bureau, person, count(*) AS n FROM zh GROUP BY 1, 2), m AS (SELECT seq, sum(n) AS n FROM steps JOIN c USING (bureau, person) GROUP BY 1)
SELECT seq, 'person' AS field, old AS old_value, new AS new_value, CAST(coalesce(n, 0) AS BIGINT) AS n_rows FROM ren LEFT JOIN m USING (seq)""")
def corrections_rename_audit(spark, d):
    events, renames = zh_events(spark, d), _renames(spark, d)
    return corrections.rename_audit(renames, corrections.rename_steps(events, renames), events)


# Patches out of the stream's events: titles and departments in turn, some of fields that can't be patched; a few delete the row.
_PATCHES = f"""{ZH}, pat AS (SELECT event_id AS seq, user_id * 4 AS target_id, CASE WHEN event_id % 10 = 0 THEN '__deleted__' WHEN event_id % 10 < 4 THEN 'id' WHEN event_id % 10 < 7 THEN 'title' ELSE 'dept' END AS field, event_type AS value FROM events),
ok AS (SELECT * FROM pat JOIN zh ON zh.id = target_id WHERE field <> 'id' AND seq <= coalesce((SELECT min(seq) FROM pat g WHERE g.target_id = pat.target_id AND g.field = '__deleted__'), 9223372036854775807))"""


def _patches(spark, d):
    k = F.col("event_id") % 10
    field = F.when(k == 0, corrections.DELETED).when(k < 4, "id").when(k < 7, "title").otherwise("dept")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") * 4).alias("target_id"), field.alias("field"), F.col("event_type").alias("value"))


@query(f"""WITH {_PATCHES}, f AS (SELECT target_id AS id, bool_or(field = '__deleted__') AS gone, arg_max(value, seq) FILTER (field = 'title') AS t, arg_max(value, seq) FILTER (field = 'dept') AS p FROM ok GROUP BY 1)
SELECT id, bureau, person, action, coalesce(t, title) AS title, coalesce(p, dept) AS dept, day FROM zh LEFT JOIN f USING (id) WHERE NOT coalesce(gone, false)""")
def corrections_patched(spark, d):
    return corrections.patched(zh_events(spark, d), _patches(spark, d), ["title", "dept"])[0]


@query(f"""WITH {_PATCHES}, l AS (SELECT *, last_value(CASE WHEN field = 'title' THEN value END IGNORE NULLS) OVER w AS lt, last_value(CASE WHEN field = 'dept' THEN value END IGNORE NULLS) OVER w AS lp FROM ok WINDOW w AS (PARTITION BY target_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, target_id, field, CASE field WHEN 'title' THEN coalesce(lt, title) WHEN 'dept' THEN coalesce(lp, dept) ELSE '{{"target_id":' || target_id || ',"title":"' || coalesce(lt, title) || '","dept":"' || coalesce(lp, dept) || '"}}' END AS old_value, CASE WHEN field <> '__deleted__' THEN value END AS new_value FROM l""")
def corrections_patch_audit(spark, d):
    return corrections.patched(zh_events(spark, d), _patches(spark, d), ["title", "dept"])[1]


# ---------------------------------------------------------------- events read again
_AGAIN = f"""{ZH}, text_ AS (SELECT id, person, action, CASE WHEN action = 'appoint' THEN '甲市税务局' ELSE '乙区税务局' END AS unit, dept, title FROM zh WHERE title <> '科员' AND id % 3 < 2),
old_ AS (SELECT id, person, action, id % 5 = 1 AS other FROM text_ WHERE id % 7 <> 0 UNION ALL SELECT -id, '赵' || substr(person, 2), 'appoint', false FROM text_ WHERE id % 11 = 0 UNION ALL SELECT id, person, action, false FROM zh WHERE id % 3 = 2)"""


def _again(spark, d):
    """Texts of two thirds of the events, and stored events: some lacking, some with another unit, some that no text has."""
    ev = zh_events(spark, d)
    told = ev.where("title <> '科员' AND id % 3 < 2")
    text = F.when(F.col("action") == "appoint", F.concat(F.lit("经研究决定：任命"), "person", F.lit("为甲市税务局"), "dept", "title", F.lit("；"))).otherwise(F.concat(F.lit("经研究决定：免去"), "person", F.lit("同志的乙区税务局"), "dept", "title", F.lit("职务。")))
    notices = told.select(F.col("id").cast("string").alias("source"), text.alias("text"))
    unit = F.when(F.col("id") % 5 == 1, "丙县税务局").when(F.col("action") == "appoint", "甲市税务局").otherwise("乙区税务局")
    none = F.lit(None).cast("int").alias("probation_years")
    source = F.col("id").cast("string").alias("source")
    stored = told.where("id % 7 <> 0").select("id", source, "person", "action", F.lit("").alias("clause"), unit.alias("unit"), "dept", "title", none)
    stored = stored.unionByName(told.where("id % 11 = 0").select((-F.col("id")).alias("id"), source, F.concat(F.lit("赵"), F.substring("person", 2, 9)).alias("person"), F.lit("appoint").alias("action"), F.lit("").alias("clause"), unit.alias("unit"), "dept", "title", none))
    stored = stored.unionByName(ev.where("id % 3 = 2").select("id", source, "person", "action", F.lit(None).cast("string").alias("clause"), F.lit("x").alias("unit"), "dept", "title", none))
    found = reextract.found_events(notices).withColumn("clause", F.lit(""))  # one event a text: its clause says no more
    return stored, found, notices


@query(f"""WITH {_AGAIN} SELECT CAST(t.id AS VARCHAR) AS source, CAST(t.id % 7 = 0 AS BIGINT) AS inserted, CAST(t.id % 7 <> 0 AND t.id % 5 = 1 AS BIGINT) AS updated, CAST(t.id % 7 <> 0 AND t.id % 5 <> 1 AS BIGINT) AS kept, CAST(t.id % 11 = 0 AS BIGINT) AS deleted FROM text_ t""")
def events_reextracted_counts(spark, d):
    return reextract.counts(reextract.compared(*_again(spark, d)))


@query(f"""WITH {_AGAIN} SELECT CASE WHEN id % 7 <> 0 THEN id END AS id, CAST(id AS VARCHAR) AS source, person, action, unit FROM text_ UNION ALL SELECT id, CAST(id AS VARCHAR), person, action, 'x' FROM zh WHERE id % 3 = 2""")
def events_reextracted(spark, d):
    """Stored events after their bodies were read again: ids kept, vanished ones gone, other sources as they were."""
    stored, found, notices = _again(spark, d)
    return reextract.applied(stored, reextract.compared(stored, found, notices)).select("id", "source", "person", "action", "unit")


@query(f"""WITH {ZH} SELECT id, CASE id % 4 WHEN 0 THEN '丙县税务局' WHEN 1 THEN '甲市税务局' WHEN 2 THEN '国家税务总局乙区税务局' ELSE ' ' END AS unit FROM zh""")
def units_from_clauses(spark, d):
    """Units that events lack, out of their clauses: by the person's post, by a bureau of the head office, or not at all."""
    k = F.col("id") % 4
    clause = F.when(k == 1, F.concat(F.lit("任命李敏为丁县税务局科长，"), "person", F.lit("为甲市税务局法制科科长"))).when(k == 2, F.lit("在国家税务总局乙区税务局任职，见国家税务总局丙县税务局")).otherwise("免去职务")
    rows = zh_events(spark, d).select("id", "person", F.when(k == 0, "丙县税务局").otherwise(" ").alias("unit"), clause.alias("clause"))
    return reextract.with_units(rows).select("id", "unit")


# ---------------------------------------------------------------- cursors
@query(f"""WITH {_WATCH_ALL}, c AS (SELECT "user", max(id) AS last_id FROM m WHERE id < 2 * "user" AND "user" % 3 = 0 GROUP BY 1), s AS (SELECT max(o_orderkey) AS newest FROM orders WHERE o_orderkey < 5 * o_custkey)
SELECT m."user" AS "user", count(DISTINCT id) AS n, min(id) AS first_id FROM m LEFT JOIN c ON c."user" = m."user", s WHERE id > coalesce(last_id, newest) GROUP BY 1""")
def notify_digest_seeded(spark, d):
    """Users without a cursor begin at the greatest id that was there when their watch was made, not at the beginning."""
    ev, watches = appointments(spark, d), _watches(spark, d, "true")
    cursors = watching.last_before(ev, watches, watches.where("user % 3 = 0").select("user", (2 * F.col("user")).alias("bound")))
    there = table(spark, d, "orders").where("o_orderkey < 5 * o_custkey").select(F.col("o_orderkey").alias("id"))
    seeded = tables.seed(cursors, table(spark, d, "customer").select(F.col("c_custkey").alias("user")), there)
    return watching.digests(ev, watches, seeded).drop("last_id")


@query("""WITH w AS (SELECT c_nationkey AS "user", 'person' AS kind, CAST(c_custkey % 50 AS VARCHAR) AS target, max(CASE WHEN c_acctbal > 0 THEN c_mktsegment END) AS label FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1, 2, 3),
a AS (SELECT c_nationkey AS "user", 'person' AS kind, CAST(c_custkey % 50 AS VARCHAR) AS target, max(CASE WHEN c_acctbal > 5000 THEN 'new ' || c_mktsegment END) AS label FROM customer WHERE c_custkey % 3 = 1 GROUP BY 1, 2, 3),
b AS (SELECT coalesce(w."user", a."user") AS "user", coalesce(w.kind, a.kind) AS kind, coalesce(w.target, a.target) AS target, coalesce(a.label, w.label) AS label FROM w FULL JOIN a ON w."user" = a."user" AND w.kind = a.kind AND w.target = a.target)
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = b."user" AND CAST(s_suppkey % 50 AS VARCHAR) = b.target)""")
def watches_added_and_removed(spark, d):
    people = table(spark, d, "customer").select(F.col("c_nationkey").alias("user"), F.lit("person").alias("kind"), (F.col("c_custkey") % 50).cast("string").alias("target"), "c_custkey", "c_acctbal", "c_mktsegment")
    there = people.where("c_custkey % 3 = 0").groupBy("user", "kind", "target").agg(F.max(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))).alias("label"))
    new = people.where("c_custkey % 3 = 1").select("user", "kind", "target", F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("new "), "c_mktsegment")).alias("label"))
    gone = table(spark, d, "supplier").select(F.col("s_nationkey").alias("user"), F.lit("person").alias("kind"), (F.col("s_suppkey") % 50).cast("string").alias("target"))
    return tables.remove_watches(tables.add_watches(there, new), gone)
