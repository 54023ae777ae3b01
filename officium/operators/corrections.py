"""Manual corrections: fields patched, rows deleted, people renamed, each with its audit row.

Corrections come in order (seq). A patch of a name renames the person everywhere in the bureau: renames follow one
another as they were made, so a chain ends at its last name, and a cycle at the name it came back to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.persons import plausible_name
from ..sources.staging import staged

DELETED = "__deleted__"
SEVERITIES = ("error", "warn", "info")


def rename_steps(names: DataFrame, renames: DataFrame) -> DataFrame:
    """Every rename that each of names (bureau, person) goes through: bureau, person, seq, name (the new one).

    renames: seq, bureau, old, new. A rename to the same name, or to one that can't be a name, renames nobody. From a
    name the first rename leads on that was made after the one that gave it. Each round takes all names a step further, until none has one.
    """
    real = renames.where(plausible_name(F.col("new")) & (F.col("old") != F.col("new"))).select("seq", "bureau", "old", "new")
    later = real.select(F.col("seq").alias("_later"), "bureau", F.col("old").alias("new"))
    onward = real.join(later, ["bureau", "new"]).where("_later > seq").groupBy("bureau", "seq").agg(F.min("_later").alias("next"))
    steps = staged(real.join(onward, ["bureau", "seq"], "left"), "renames")
    first = steps.groupBy("bureau", "old").agg(F.min_by(F.struct("seq", "new", "next"), "seq").alias("s"))
    at = names.select("bureau", "person").distinct().join(first.withColumnRenamed("old", "person"), ["bureau", "person"]).select("bureau", "person", "s.*")
    out = None
    while True:
        at = staged(at, "renamed")
        step = at.select("bureau", "person", "seq", F.col("new").alias("name"))
        out = step if out is None else out.unionByName(step)
        at = at.where("next IS NOT NULL").select("bureau", "person", F.col("next").alias("seq")).join(steps, ["bureau", "seq"]).select("bureau", "person", "seq", "new", "next")
        if not at.limit(1).count():
            return out


def final_names(steps: DataFrame) -> DataFrame:
    """bureau, person, full: where each renamed person's name ends; taken: the renames on the way, the last first."""
    ends = steps.groupBy("bureau", "person").agg(F.max_by("name", "seq").alias("full"), F.sort_array(F.collect_list("seq"), asc=False).alias("taken"))
    return ends


def renamed(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """rows (bureau, person) under their last names."""
    return rows.join(ends.select("bureau", "person", "full"), ["bureau", "person"], "left").withColumn("person", F.coalesce("full", "person")).select(*rows.columns)


def renamed_people(people: DataFrame, ends: DataFrame) -> DataFrame:
    """people (bureau, person) under their last names, one row a name: who had it first stays.

    That is who was never renamed, else whose last rename came first; of those that went on together from some name, who
    had that name first.
    """
    rows = people.join(ends, ["bureau", "person"], "left").withColumns({"_old": F.col("person"), "person": F.coalesce("full", "person"), "taken": F.coalesce("taken", F.array().cast("array<long>"))})
    rest = [c for c in people.columns if c not in ("bureau", "person")]
    kept = rows.groupBy("bureau", "person").agg(F.min_by(F.struct(F.col("_old").alias("_old"), *rest), F.struct("taken", "_old")).alias("x"))
    return kept.select("bureau", "person", *[F.col(f"x.{c}").alias(c) for c in rest])


def rename_audit(renames: DataFrame, steps: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each rename: seq, field, old_value, new_value and how many rows (bureau, person) it moved."""
    counts = rows.groupBy("bureau", "person").agg(F.count(F.lit(1)).alias("n"))
    moved = steps.join(counts, ["bureau", "person"]).groupBy("seq").agg(F.sum("n").alias("n_rows"))
    return renames.join(moved, "seq", "left").select("seq", F.lit("person").alias("field"), F.col("old").alias("old_value"), F.col("new").alias("new_value"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def patched(rows: DataFrame, patches: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (id, fields) with patches (seq, target_id, field, value) applied in order, and the audit: seq, target_id, field, old_value, new_value.

    Only ``fields`` may be patched; other patches and those of rows that aren't there are left out of both. A patch of
    ``__deleted__`` deletes the row: later patches of it do nothing, and its audit row holds the row as JSON as it was then.
    """
    text = lambda c: F.col(c).cast("string")
    known = patches.where(F.col("field").isin(*fields, DELETED))
    by_target = Window.partitionBy("target_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.max((F.col("field") == DELETED).cast("int")).over(by_target)
    known = known.withColumn("_gone", F.coalesce(gone, F.lit(0))).where("_gone = 0").drop("_gone")
    last = {f: F.last(F.when(F.col("field") == f, F.struct("value")), ignorenulls=True).over(by_target) for f in fields}
    known = known.withColumns({f"_{f}": c for f, c in last.items()})
    stored = rows.select(F.col("id").alias("target_id"), *[text(f).alias(f) for f in fields])
    joined = known.join(stored, "target_id")
    before = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f)) for f in fields}
    old = F.when(F.col("field") == DELETED, F.to_json(F.struct("target_id", *[c.alias(f) for f, c in before.items()])))
    for f, c in before.items():
        old = old.when(F.col("field") == f, c)
    audit = joined.select("seq", "target_id", "field", old.alias("old_value"), F.when(F.col("field") != DELETED, F.col("value")).alias("new_value"))
    ends = known.groupBy(F.col("target_id").alias("id")).agg(
        F.bool_or(F.col("field") == DELETED).alias("_deleted"), *[F.max_by(F.struct("value"), F.when(F.col("field") == f, F.col("seq"))).alias(f"_{f}") for f in fields])
    out = rows.join(ends, "id", "left").where("NOT coalesce(_deleted, false)")
    value = lambda f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value").cast(rows.schema[f].dataType)).otherwise(F.col(f))
    return out.select(*[value(c).alias(c) if c in fields else F.col(c) for c in rows.columns]), audit


def resolved(anomalies: DataFrame, audit: DataFrame, target_type: str) -> DataFrame:
    """Anomalies (target_type, target_id, status): the open ones of rows that were corrected are resolved."""
    done = audit.select(F.col("target_id").cast("string").alias("target_id")).distinct().withColumn("_done", F.lit(True))
    rows = anomalies.join(done, "target_id", "left")
    closes = (F.col("target_type") == target_type) & (F.col("status") == "open") & F.coalesce("_done", F.lit(False))
    return rows.withColumn("status", F.when(closes, "resolved").otherwise(F.col("status"))).select(*anomalies.columns)


def severity_order() -> list[Column]:
    """Errors first, then warnings, then the rest; the newest first in each."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, i) for i, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))
    return [rank, F.desc("id")]
