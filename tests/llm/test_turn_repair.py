"""Conversation repair against every sequence of edits, and against a search in plain Python over whole tables."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from officium.llm import queries, turn_repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
BLANK, ENDED = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def enumerated(letters):
    """The least (cost, audit) of all sequences of edits with at most two inserts in a row."""
    best = None
    inserts = ["", "I", "II"]
    kinds = ["D" if x == "x" else "DKR" for x in letters]
    for edits in itertools.product(*kinds):
        for gaps in itertools.product(inserts, repeat=len(letters) + 1):
            audit = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:]))
            out, cost, rows = "", 0, iter(letters)
            for e in audit:
                x = next(rows) if e != "I" else ""
                cost += {"D": 2, "K": 0, "R": 1, "I": 5}[e] + 5 * (e in "KR" and x.isupper())
                out += {"D": "", "K": x.lower()}.get(e, "?")
            if len(out) % 2 and out[0] == "s":
                want = "s" + "ua" * (len(out) // 2)
            elif not len(out) % 2:
                want = "ua" * (len(out) // 2)
            else:
                continue
            if len(want) > 0 and want == "s":
                continue
            if all(a in ("?", b) for a, b in zip(out, want)) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def searched(letters):
    """The least (cost, audit), by a search from the cheapest on."""
    step = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    turn, seen, heap = [2, 2, 3, 2], set(), [(0, "", 0, 0)]
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(letters) and state in (0, 3):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        heapq.heappush(heap, (cost + 5, audit + "I", i, turn[state]))
        if i < len(letters):
            x = letters[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if x != "x":
                late = 5 * x.isupper()
                heapq.heappush(heap, (cost + 1 + late, audit + "R", i + 1, turn[state]))
                if x.lower() in step[state]:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, step[state][x.lower()]))


def expected(conversations):
    """Summary and repaired rows of each {conv_id: [(turn, role, text)]}, rows in order."""
    out = {}
    for conv, rows in conversations.items():
        seen, letters, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if not ENDED.search(text) else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letters += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        initials = [r[:1] if r[:1] in ("s", "u", "a") else "o" for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = searched(letters)
        done, left = [], iter(rows)
        for e in audit:
            odd = len([r for r, _ in done if not (r[:1] == "s" and r is done[0][0])]) % 2
            whose = "assistant" if odd else "user"
            if e == "I":
                done.append((whose, ""))
                continue
            _, role, text = next(left)
            if e != "D":
                done.append((role if e == "K" else whose, text))
        assert LEGAL.fullmatch("".join(r[:1] for r, _ in done))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()), done
    return out


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    tied = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {c: sorted(v, key=tied) for c, v in out.items()}


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_ways_are_the_cheapest_of_all_edits():
    rng = random.Random(1)
    for _ in range(250):
        letters = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(0, 3)))
        made = turn_repair.ways(letters, turn_repair.START)
        assert min(w for end, w in enumerate(made) if w and end in (turn_repair.START, turn_repair.ASSISTANT)) == enumerated(letters) == searched(letters)


def test_chained_blocks_are_the_cheapest_too():
    rng = random.Random(2)
    for _ in range(400):
        letters = "".join(rng.choice("xxsuuaaoSUAO") for _ in range(rng.randint(1, 40)))
        conv = turn_repair.Conversation(1)
        at = 0
        while at < len(letters):
            n = rng.randint(1, 7)
            solved = [w for s in range(4) for w in turn_repair.ways(letters[at : at + n], s)]
            conv.block([w and w[0] for w in solved], [w and w[1] for w in solved], [0] * 4, "ss", [0, None, None])
            at += n
        conv.finish()
        assert (conv.cost, conv.audit) == searched(letters)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_the_search(spark, sf):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '/root/testdata/{sf}/conversations.parquet'").fetchall()
    assert got(queries.QUERIES["op11_turn_repair"](spark, f"/root/testdata/{sf}")) == {c: x for c, (x, _) in expected(damaged(rows)).items()}


AWKWARD = [
    (None, None, None, None), (None, 3, "user", "Hi."), (1, None, "system", "Be good."), (1, 1, "user", "a b"), (1, 1, "user", "a b"), (1, 1, "user", "a b"), (1, 9, "", "Yes!"), (2, 5, "tool", " "), (2, 5, "tool", ""),
    (3, -4, "assistant", "é?\n"), (3, 2**40, "user", "Why?"), (4, 0, "USER", "x."), (5, 0, "user", "z" * 200_000), (5, 1, "assistant", "w. " * 50_000), (6, None, None, None), (6, None, None, None),
]


def test_awkward_rows(spark):
    rows = spark.createDataFrame(AWKWARD, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "times", "kind", "damage", "part", "digest", "letters", "n")}).repartition(3)
    want = expected(damaged(AWKWARD))
    assert got(turn_repair.repair(*turn_repair.damaged(rows))) == {c: x for c, (x, _) in want.items()}
    made = {}
    for r in turn_repair.repaired(*turn_repair.damaged(rows)).orderBy("conv_id", "place").collect():
        made.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert made == {c: d for c, (_, d) in want.items() if d}


def test_empty_table_and_conversations_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(*turn_repair.damaged(none)).count() == 0 and turn_repair.repaired(none).count() == 0
    gone = turn_repair.repair(spark.createDataFrame([(1, 0, "user", "Hi.")], SCHEMA), F.lit(0))
    assert got(gone) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_conversation_with_most_of_the_rows(spark, monkeypatch):
    """One conversation over many blocks and ranges, with a row that stands in it a thousand times."""
    rng = random.Random(3)
    rows = [(7, t if t % 50 else None, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Same.", f"Turn {t}.", f"cut {t}", " "])) for t in range(3000)]
    rows += [(7, 10, "user", "Again.")] * 1000 + [(i + 10, t, "user" if t % 2 else "assistant", f"T {t}.") for i in range(50) for t in range(4)]
    monkeypatch.setattr(turn_repair, "BLOCK", 20)
    want = expected(damaged(rows))
    assert got(turn_repair.repair(*turn_repair.damaged(spark.createDataFrame(rows, SCHEMA).repartition(8)))) == {c: x for c, (x, _) in want.items()}
