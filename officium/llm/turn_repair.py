r"""Repair of conversations' structure, each distinct signature of roles and faults solved once.

A conversation's rows are taken by turn, nulls first; rows of one turn by the sha256 of role and text. A row's first
fault counts: blank (no ``[^\x20\x09-\x0D]``), duplicate (role and text seen earlier), truncated (the last such
character is none of ``.!?``). Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate
rows), Insert a row with empty text for user or assistant 5; truncated rows that stay cost 5 more. The cheapest edits whose
roles' initials are ``(s?(ua)+)?`` are chosen; of those that cost the same, the ones whose initials are least in ASCII.

Rows without their texts are sorted by ranges, so that a conversation of any length is split, and its rows become letters in
blocks of bounded length. Each distinct block is solved once, from and to each state of the pattern, by memoised
recursion; the solutions are joined back and chained, which loses nothing, as of two ways through a block with the same ends
and cost neither is the beginning of the other. The texts then stream past the audits in order: a task keeps one
conversation's audit and the state of its sha256, never its rows. (A digest over a conversation's text can't be split, so the
rows of one conversation pass through one task, a row at a time.)

Null role and null text count as one space; null conv_ids are one conversation, null turns come first and no gap counts them.
A role's initial is its first character; an empty role has none of s, u and a. Repeated rows are duplicates of each other. Columns
beyond conv_id, turn, role and text are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

BLOCK = 100  # a block has fewer than twice as many letters
HOT = 1000  # at most so many signatures are sent to all tasks: those with at least one in HOT of all blocks
START, SYSTEM, USER, ASSISTANT = range(4)  # what came last; the pattern ends well at START and ASSISTANT
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)  # whose turn it is: what a rerole or an insert gives
ROLE = {USER: "user", ASSISTANT: "assistant"}
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"
_WORDY, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


# ---------------------------------------------------------------- one block
Ways = tuple["tuple[int, str] | None", ...]


@lru_cache(maxsize=100_000)
def ways(letters: str, state: int, inserts: int = 2) -> Ways:
    """For each state to end in, the least (cost, edits) from ``state`` through a block's letters.

    Letters: x must go; s, u, a and o (another role) may stay, capitals truncated. More than two inserts in a row never pay.
    """
    best: list[tuple[int, str] | None] = [None] * 4

    def offer(edit: str, cost: int, rest: Ways) -> None:
        for end, way in enumerate(rest):
            if way is not None:
                made = (cost + way[0], edit + way[1])
                if best[end] is None or made < best[end]:
                    best[end] = made

    if not letters:
        best[state] = (0, "")
    else:
        letter, rest = letters[0], letters[1:]
        offer("D", 2, ways(rest, state))
        if letter != "x":
            late = 5 * letter.isupper()
            if letter.lower() in KEPT[state]:
                offer("K", late, ways(rest, KEPT[state][letter.lower()]))
            offer("R", 1 + late, ways(rest, NEXT[state]))
    if inserts:
        offer("I", 5, ways(letters, NEXT[state], inserts - 1))
    return tuple(best)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signatures = batch.column("signature").to_pylist()
        all_ways = [[w for state in range(4) for w in ways(s, state)] for s in signatures]
        yield pa.RecordBatch.from_arrays(
            [pa.array(signatures, pa.string()), batch.column("blocks"), pa.array([[w and w[0] for w in x] for x in all_ways], pa.list_(pa.int32())), pa.array([[w and w[1] for w in x] for x in all_ways], pa.list_(pa.string()))],
            names=["signature", "blocks", "costs", "edits"])


# ---------------------------------------------------------------- rows, blocks
def _keyed(rows: DataFrame, times: Column) -> DataFrame:
    """Rows with the columns they are ordered by; no column is null but conv_id."""
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("at"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), times.cast("long").alias("times"))
    return rows.select(
        F.col("conv_id").isNull().alias("null_id"), F.coalesce("conv_id", F.lit(0)).alias("id"), F.col("at").isNotNull().alias("has_turn"), F.coalesce("at", F.lit(0)).alias("turn"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"), "role", "text", "times")


def _letters(rows: DataFrame) -> DataFrame:
    """A row per distinct row of a conversation, cut where it stands very often: its letters, the first fault of each, in order.

    Rows that must go are 1 to 4 for s, u, a and another role.
    """
    conv, turn = ["null_id", "id"], ["has_turn", "turn"]
    initial = F.substring("role", 1, 1)
    facts = rows.where("times > 0").select(
        *conv, *turn, "digest", "times", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (~F.col("text").rlike(_WORDY)).alias("blank"), (~F.col("text").rlike(_ENDED)).alias("truncated"))
    facts = stage(facts.groupBy(*conv, *turn, "digest", "initial", "blank", "truncated").agg(F.sum("times").alias("n")), "facts")
    first = facts.where("NOT blank").groupBy(*conv, "digest").agg(F.min(F.struct(*turn)).alias("first")).select(*conv, "digest", "first.*", F.lit(True).alias("new"))
    facts = facts.join(first, [*conv, "digest", *turn], "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {BLOCK}"))))
    head = F.coalesce("new", F.lit(False)) & (F.col("piece") == 0)
    size = F.least(F.lit(BLOCK), F.col("n") - F.col("piece") * BLOCK).cast("int")
    own = F.when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    gone = F.translate("initial", "suao", "1234")
    rest = size - head.cast("int")
    return facts.select(
        *conv, *turn, "digest", "piece", F.concat(F.when(head, own).otherwise(""), F.repeat(gone, rest)).alias("letters"),
        F.when(F.col("blank"), size).otherwise(0).alias("blank"), F.when(F.col("blank"), 0).otherwise(rest).alias("duplicate"), (head & F.col("truncated")).cast("int").alias("truncated"))


def _blocks(letters: DataFrame) -> DataFrame:
    """Blocks of letters of one conversation, in the order of (part, block), with what is counted in each."""
    conv, order = ["null_id", "id"], ["has_turn", "turn", "digest", "piece"]
    letters = stage(letters, "letters")
    parts = stage(letters.repartitionByRange(*conv, *order).withColumn("part", F.spark_partition_id()), "parts")
    so_far = Window.partitionBy("part", *conv).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("block", F.floor(F.coalesce(F.sum(F.length("letters")).over(so_far), F.lit(0)) / BLOCK))
    blocks = rows.groupBy("part", *conv, "block").agg(
        F.sort_array(F.collect_list(F.struct(*order, "letters"))).alias("rows"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"))
    blocks = blocks.withColumn("letters", F.array_join("rows.letters", "")).withColumn("turns", F.array_sort(F.array_distinct(F.transform(F.filter("rows", lambda r: r["has_turn"]), lambda r: r["turn"]))))
    initials = F.translate(F.lower("letters"), "1234", "suao")
    legal = F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    return stage(blocks.select(
        *conv, F.col("part").cast("long"), F.col("block").cast("long"), F.translate("letters", "1234", "xxxx").alias("signature"),
        F.array("blank", "duplicate", "truncated", (F.length("letters") - 1 - legal).cast("long")).alias("counts"), F.concat(F.substring(initials, 1, 1), F.substring(initials, -1, 1)).alias("ends"),
        F.array(F.size("turns").cast("long"), F.try_element_at("turns", F.lit(1)), F.try_element_at("turns", F.lit(-1))).alias("turns")), "blocks")


def _audited(blocks: DataFrame) -> DataFrame:
    """The blocks with their signatures' solutions. Signatures of many blocks go to all tasks: there are at most HOT of them."""
    signatures = stage(blocks.groupBy("signature").agg(F.count(F.lit(1)).alias("blocks")).repartition("signature").mapInArrow(_solved, "signature string, blocks long, costs array<int>, edits array<string>"), "signatures")
    many = F.lit(max(HOT, -(-blocks.count() // HOT)))
    hot = F.broadcast(signatures.where(F.col("blocks") >= many).select("signature", F.col("costs").alias("hot_costs"), F.col("edits").alias("hot_edits")))
    joined = stage(blocks.join(hot, "signature", "left"), "hot")
    done = joined.where("hot_costs IS NOT NULL").withColumnsRenamed({"hot_costs": "costs", "hot_edits": "edits"})
    rest = joined.where("hot_costs IS NULL").drop("hot_costs", "hot_edits").join(signatures.where(F.col("blocks") < many).drop("blocks"), "signature")
    return done.unionByName(rest)


# ---------------------------------------------------------------- conversations
@dataclass
class Conversation:
    """One conversation while its blocks, then its rows stream by."""

    conv_id: int | None
    settled: list[str] = field(default_factory=list)  # edits that all ways share
    best: dict[int, tuple[int, str]] = field(default_factory=lambda: {START: (0, "")})
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    last: str = ""
    turns: tuple = (0, None, None)
    audit: str | None = None
    cost: int = 0
    at: int = 0
    state: int = START

    def block(self, costs: list, edits: list, counts: list[int], ends: str, turns: list) -> None:
        best: dict[int, tuple[int, str]] = {}
        for start, (cost, done) in self.best.items():
            for end in range(4):
                more = costs[4 * start + end]
                if more is not None:
                    way = (cost + more, done + edits[4 * start + end])
                    if end not in best or way < best[end]:
                        best[end] = way
        shared = commonprefix([w[1] for w in best.values()])
        self.settled.append(shared)
        self.best = {end: (cost, done[len(shared) :]) for end, (cost, done) in best.items()}
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        self.counts[3] += bool(self.last) and self.last + ends[0] not in ("su", "ua", "au")
        self.last = ends[1]
        if turns[0]:
            n, lo, hi = self.turns
            self.turns = (n + turns[0] - (hi == turns[1]), turns[1] if lo is None else lo, turns[2])

    def finish(self) -> None:
        self.cost, rest = min(way for end, way in self.best.items() if end in (START, ASSISTANT))
        self.audit = "".join(self.settled) + rest

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield "I", ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What stands before this row and for it: (edit, role, text)."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state][role[0]]
            yield edit, role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield edit, ROLE[self.state], text

    @property
    def gaps(self) -> int:
        n, lo, hi = self.turns
        return min(hi - lo + 1 - n, 2**63 - 1) if n else 0


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, str | None, str, str]]:
    """(conversation, edit, role, text) for each row of the repaired ones; edit None where a conversation ends."""
    now = None
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("null_id", "id", "kind", "times", "role", "text", "costs", "edits", "counts", "ends", "turns")]
        for null_id, i, kind, times, role, text, *block in zip(*cols):
            conv_id = None if null_id else i
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield from ((now, *x) for x in now.inserted())
                    yield now, None, "", ""
                now = Conversation(conv_id)
            if kind == 0:
                now.block(*block)
                continue
            if now.audit is None:
                now.finish()
            for _ in range(times):
                yield from ((now, *x) for x in now.row(role, text))
    if now is not None:
        yield from ((now, *x) for x in now.inserted())
        yield now, None, "", ""


def _batched(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")])
    out, digest, some = [], hashlib.sha256(), False
    for conv, edit, role, text in _conversations(batches):
        if edit is not None:
            digest.update((f"\n{role}:{text}" if some else f"{role}:{text}").encode("utf-8", "surrogatepass"))
            some = True
            continue
        out.append((conv.conv_id, conv.gaps, *conv.counts, conv.cost, conv.audit, digest.hexdigest()))
        digest, some = hashlib.sha256(), False
        if len(out) >= 4096:
            yield _batched(out, schema)
            out = []
    yield _batched(out, schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    out, place = [], 0
    for conv, edit, role, text in _conversations(batches):
        if edit is None:
            place = 0
            continue
        out.append((conv.conv_id, place, edit, role, text))
        place += 1
        if len(out) >= 4096:
            yield _batched(out, schema)
            out = []
    yield _batched(out, schema)


def _streamed(rows: DataFrame, times: Column | None) -> DataFrame:
    """Each conversation's solved blocks, then its rows, in order."""
    rows = _keyed(rows, F.lit(1) if times is None else times)
    blocks = _audited(_blocks(_letters(rows)))
    none = lambda kind: F.lit(None).cast(kind)
    payload = {"costs": "array<int>", "edits": "array<string>", "counts": "array<long>", "ends": "string", "turns": "array<long>"}
    heads = blocks.select("null_id", "id", F.lit(0).alias("kind"), F.lit(True).alias("has_turn"), F.col("part").alias("o1"), F.col("block").alias("o2"), none("binary").alias("digest"), F.lit(1).cast("long").alias("times"), none("string").alias("role"), none("string").alias("text"), *payload)
    texts = rows.select("null_id", "id", F.lit(1).alias("kind"), "has_turn", F.col("turn").alias("o1"), F.lit(0).cast("long").alias("o2"), "digest", "times", "role", "text", *[none(k).alias(c) for c, k in payload.items()])
    conv = ["null_id", "id"]
    return heads.unionByName(texts).repartition(*conv).sortWithinPartitions(*conv, "kind", "has_turn", "o1", "o2", "digest")


def repair(rows: DataFrame, times: Column | None = None) -> DataFrame:
    """A row per conversation of rows (conv_id, turn, role, text): what is wrong in it, the cheapest edits and their cost.

    times: how often each row stands (1); conversations of rows that all stand 0 times have an empty audit.
    """
    return _streamed(rows, times).mapInArrow(_summaries, SUMMARY)


def repaired(rows: DataFrame, times: Column | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), the edit that gave the row, role, text."""
    return _streamed(rows, times).mapInArrow(_turns, TURNS)


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with seeded faults, by crc32 of conv_id:turn modulo 20, and how often each stands: dropped, emptied, cut, repeated, made user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("damage"))
    of = lambda k: F.col("damage") == k
    rows = rows.select(
        "conv_id", "turn", F.when(of(4), F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(of(1), F.lit("")).when(of(2), F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(of(0), 0).when(of(3), 2).otherwise(1).alias("times"))
    return rows, F.col("times")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(*damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
