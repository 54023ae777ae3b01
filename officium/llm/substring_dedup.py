"""Substring dedup by relative Lempel-Ziv parsing against all documents' blocks.

Every document is a reference for every other and for itself. The index is made in two steps. Of each 35-word window the
8-word block with the smallest hash is its reference block; equal windows have equal blocks, so only windows whose block
stands elsewhere too can be found. Blocks are counted over the whole table; then every window with such a block is
indexed at its first two places (doc_id and word number, in that order), each compared by 96 bits of hash over all its words.

Each document is parsed greedily, left to right: at the first word whose window the index has at another place, a factor
copies from that place and goes on as long as the next window stands next there too. Where it ends, the windows across its
boundary have been looked up as well: the next factor begins at the first word after its start whose window is
found, and may overlap it. So the words within factors are exactly those of all windows that start anywhere else, and they
are what is removed. Windows are judged on the input, not on what is left. ``parse`` gives the factors.

Texts are dealt into chunks of about 2 MB once (one shuffle, reused by the three passes that read it); blocks and windows travel
as packed hashes, each once a chunk however often it stands there, so that a passage in a third of all documents is a
few rows. A chunk sends a row to each bucket it has keys for, so never more rows than keys; the buckets' number follows the
input.

Words are unchanged runs of ``[^\\x20\\x09-\\x0D]``. Null text counts as empty: no words, kept_sha256 of the empty
string. Repeated rows and repeated or null doc_ids are documents of their own (and so copies of each other).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Texts, Words, mix, run_hashes, shuffle_parts, slices, window_hashes, words_of

WINDOW, BLOCK = 35, 8


def _reach(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each x[i:i+n]."""
    width, out = 1, x
    while 2 * width <= n:
        out = pick(out[: len(out) - width], out[width:])
        width *= 2
    if width < n:
        out = pick(out[: len(out) - (n - width)], out[n - width :])
    return out


def _measure(t: Texts, window: int, block: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words; block hashes; of each window within one text (by first word): its smallest block hash."""
    w = words_of(t)
    h = run_hashes(t.data, w.starts, w.ends)
    if len(h) < window:
        return w, h, np.zeros(0, np.int64), np.zeros(0, U64)
    g = window_hashes(h, block)
    least = _reach(g, window - block + 1, np.minimum)
    inside = np.flatnonzero(w.doc[: len(h) - window + 1] == w.doc[window - 1 :])
    return w, h, inside, least


def _blocks(t: Texts, window: int, block: int) -> np.ndarray:
    """The hash at each place that is the reference block of some window (a hash as often as it stands)."""
    w, h, inside, least = _measure(t, window, block)
    if not len(inside):
        return np.zeros(0, U64)
    span = window - block + 1
    seen = np.zeros(len(least) + 2 * (span - 1), U64)  # 0 where the window crosses texts
    seen[span - 1 + inside] = least[inside]
    g = window_hashes(h, block)
    return g[g == _reach(seen, span, np.maximum)]


NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id in the index
CHECK = U64(0x9E6C63D0876A9A99)
BLOCKS = {"keys": U64, "times": np.uint8}
PLACES = {"keys": U64, "checks": np.uint32, "ids": np.int64, "at": np.int32}
INDEX = {"keys": U64, "checks": np.uint32, "ids": np.int64, "at": np.int32, "ids2": np.int64, "at2": np.int32}


def _fields(kinds: dict, key: str) -> str:
    return f"{key} long, " + ", ".join(f"`{c}` binary" for c in kinds)


def _packed(chunk: int, cols: dict[str, np.ndarray], kinds: dict, buckets: int) -> pa.Table:
    """A row per bucket with the chunk's entries, which are sorted by keys."""
    bucket = ((cols["keys"] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    some, cut = np.unique(bucket, return_index=True)
    cut = np.append(cut, len(bucket))
    out = {"bucket": pa.array(some, pa.int64()), "chunk": pa.array(np.full(len(some), chunk), pa.int64())}
    return pa.table(out | {c: pa.array([cols[c][i:j].astype(k, copy=False).tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()) for c, k in kinds.items()})


def _unpacked(table: pa.Table, kinds: dict) -> dict[str, np.ndarray]:
    return {c: np.concatenate([np.zeros(0, k), *[np.frombuffer(x, k) for x in table.column(c).to_pylist()]]) for c, k in kinds.items()}


def _first_two(cols: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of each key (with its check) the first two places, in order, and whether an entry is a key's second."""
    order = np.lexsort((cols["at"], cols["ids"], cols["checks"], cols["keys"]))
    cols = {c: x[order] for c, x in cols.items()}
    new = np.append(True, (cols["keys"][1:] != cols["keys"][:-1]) | (cols["checks"][1:] != cols["checks"][:-1]))[: len(order)]
    second = np.append(False, new[:-1])[: len(order)] & ~new
    keep = new | second
    return {c: x[keep] for c, x in cols.items()}, second[keep]


def _texts(table: pa.Table) -> Iterator[tuple[Texts, pa.Array]]:
    for batch in table.to_batches():
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for t in slices(batch.column(batch.schema.get_field_index("text"))):
            yield t, ids.slice(t.lo, t.n)


def _found_twice(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one bucket's hashes, for each chunk those that stand twice or more in the whole table."""
    keys = [np.frombuffer(k, U64) for k in table.column("keys").to_pylist()]
    times = np.concatenate([np.frombuffer(n, np.uint8) for n in table.column("times").to_pylist()])
    words, back = np.unique(np.concatenate(keys), return_inverse=True)
    twice = (np.bincount(back, weights=times) >= 2)[back]
    out, at = [], 0
    for k in keys:
        out.append(k[twice[at : at + len(k)]].tobytes())
        at += len(k)
    full = [i for i, k in enumerate(out) if k]
    return pa.table({"chunk": table.column("chunk").take(pa.array(full, pa.int64())), "keys": pa.array([out[i] for i in full], pa.binary())})


def _indexed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one bucket's windows, for each chunk those that stand twice or more in the whole table, with their first two places."""
    cols = _unpacked(table, PLACES)
    chunk = np.repeat(np.asarray(table.column("chunk")), [len(k) // 8 for k in table.column("keys").to_pylist()])
    _, back, times = np.unique(cols["keys"], return_inverse=True, return_counts=True)
    twice = (times > 1)[back]
    cols, chunk = {c: x[twice] for c, x in cols.items()}, chunk[twice]
    two, second = _first_two(cols)
    b = np.flatnonzero(second)
    found = {"keys": two["keys"][b], "checks": two["checks"][b], "ids": two["ids"][b - 1], "at": two["at"][b - 1], "ids2": two["ids"][b], "at2": two["at"][b]}
    lo, hi = (np.searchsorted(found["keys"], cols["keys"], side=side) for side in ("left", "right"))
    entry = np.repeat(np.arange(len(lo)), hi - lo)
    entry, which = chunk[entry], np.arange(len(entry)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
    order = np.lexsort((which, entry))
    entry, which = entry[order], which[order]
    new = np.append(True, (entry[1:] != entry[:-1]) | (which[1:] != which[:-1]))[: len(order)]
    entry, which = entry[new], which[new]
    some, cut = np.unique(entry, return_index=True)
    cut = np.append(cut, len(entry))
    parts = {c: pa.array([found[c][which[i:j]].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()) for c in INDEX}
    return pa.table({"chunk": pa.array(some, pa.int64()), **parts})


def _joined(table: pa.Table) -> np.ndarray:
    return np.sort(_unpacked(table, {"keys": U64})["keys"])


def _among(x: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys) or not len(x):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def factors(place: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """One text's greedy factors (first word, words, reference, word there) from its found windows.

    place: their sorted places; ref and ref_at: where the index has them. A factor goes on while the next word's window
    is found at the next word of the same reference.
    """
    goes_on = (np.diff(place) == 1) & (ref[1:] == ref[:-1]) & (np.diff(ref_at) == 1)
    first = np.flatnonzero(np.append(True, ~goes_on))[: len(place)]
    run = np.diff(np.append(first, len(place)))
    return place[first], run + window - 1, ref[first], ref_at[first]


def _parsed(t: Texts, ids: np.ndarray, index: dict[str, np.ndarray], window: int, block: int):
    """The slice's words, and factors (text, first word in it, words, reference, word there)."""
    w, h, inside, _ = _measure(t, window, block)
    none = np.zeros(0, np.int64)
    if not len(inside) or not len(index["keys"]):
        return w, (none,) * 5
    key = window_hashes(h, window)[inside]
    at = np.minimum(np.searchsorted(index["keys"], key), len(index["keys"]) - 1)
    hit = index["keys"][at] == key
    inside, at = inside[hit], at[hit]
    check, last = _checks(h, inside, window), len(index["keys"]) - 1
    while True:  # once, but for keys that clash
        wrong = index["checks"][at] != check
        goes = wrong & (at < last) & (index["keys"][np.minimum(at + 1, last)] == index["keys"][at])
        if not goes.any():
            break
        at = at + goes
    inside, at = inside[~wrong], at[~wrong]
    doc = w.doc[inside]
    place = inside - w.first[:-1][doc]
    own = (index["ids"][at] == ids[doc]) & (index["at"][at] == place)
    ref, ref_at = np.where(own, index["ids2"][at], index["ids"][at]), np.where(own, index["at2"][at], index["at"][at]).astype(np.int64)
    out = [[] for _ in range(5)]
    cut = np.searchsorted(doc, np.arange(t.n + 1))
    for i in np.flatnonzero(np.diff(cut)):
        a, b = cut[i], cut[i + 1]
        made = factors(place[a:b], ref[a:b], ref_at[a:b], window)
        for col, x in zip(out, (np.full(len(made[0]), i), *made)):
            col.append(x)
    return w, tuple(np.concatenate([none, *col]) for col in out)


def _checks(h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """32 more bits of hash of the windows that start there."""
    return (window_hashes(mix(h ^ CHECK), window)[starts] >> U64(32)).astype(np.uint32)


def _id_numbers(ids: pa.Array) -> np.ndarray:
    return np.asarray(ids.fill_null(NO_ID))


def _passes(docs: DataFrame, window: int, block: int, last, schema: str) -> DataFrame:
    """last(texts, index) for each chunk, once blocks are counted and windows indexed."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    scans = docs.rdd.getNumPartitions()
    chunks, buckets = max(48, 8 * scans), max(24, 2 * scans)
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long")).repartition(shuffle_parts(spark), "chunk")

    def blocks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [_blocks(t, window, block) for t, _ in _texts(table)]
        keys, times = np.unique(np.concatenate(found) if found else np.zeros(0, U64), return_counts=True)
        return _packed(key[0].as_py(), {"keys": keys, "times": np.minimum(times, 2)}, BLOCKS, buckets)

    def windows(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        known_keys, found = _joined(known), {c: [np.zeros(0, k)] for c, k in PLACES.items()}
        for t, ids in _texts(table):
            w, h, inside, least = _measure(t, window, block)
            some = inside[_among(least[inside], known_keys)]
            if len(some):
                doc = w.doc[some]
                found["keys"].append(window_hashes(h, window)[some])
                found["checks"].append(_checks(h, some, window))
                found["ids"].append(_id_numbers(ids)[doc])
                found["at"].append((some - w.first[:-1][doc]).astype(np.int32))
        cols, _ = _first_two({c: np.concatenate(x) for c, x in found.items()})
        return _packed(key[0].as_py(), cols, PLACES, buckets)

    def parsed(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        index = _unpacked(found, INDEX)
        order = np.argsort(index["keys"], kind="stable")
        return last(table, {c: x[order] for c, x in index.items()})

    by_chunk = dealt.groupBy("chunk")
    twice = by_chunk.applyInArrow(blocks, "bucket long, " + _fields(BLOCKS, "chunk")).groupBy("bucket").applyInArrow(_found_twice, "chunk long, keys binary")
    tested = by_chunk.cogroup(twice.groupBy("chunk")).applyInArrow(windows, "bucket long, " + _fields(PLACES, "chunk"))
    found = tested.groupBy("bucket").applyInArrow(_indexed, _fields(INDEX, "chunk"))
    return by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(parsed, schema)


def parse(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The factors: doc_id, start, length (in words), and where they are copied from: ref_doc_id, ref_start."""

    def last(table: pa.Table, index: dict[str, np.ndarray]) -> pa.Table:
        out = []
        for t, ids in _texts(table):
            _, (doc, start, length, ref, at) = _parsed(t, _id_numbers(ids), index, window, block)
            refs = pa.array(ref, pa.int64(), mask=ref == NO_ID)
            out.append(pa.table([ids.take(pa.array(doc)), pa.array(start), pa.array(length), refs, pa.array(at)], names=["doc_id", "start", "length", "ref_doc_id", "ref_start"]))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("doc_id", "start", "length", "ref_doc_id", "ref_start")})

    return _passes(docs, window, block, last, "doc_id long, start long, length long, ref_doc_id long, ref_start long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for each row of docs (doc_id, text)."""

    def last(table: pa.Table, index: dict[str, np.ndarray]) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")}
        for t, ids in _texts(table):
            w, (doc, start, length, _, _) = _parsed(t, _id_numbers(ids), index, window, block)
            gone = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(gone, w.first[doc] + start, 1)
            np.add.at(gone, w.first[doc] + start + length, -1)
            keep = np.cumsum(gone)[:-1] == 0
            raw = t.data.tobytes()
            for i in range(t.n):
                words = raw[t.offsets[i] : t.offsets[i + 1]].split()
                own = keep[w.first[i] : w.first[i + 1]]
                if not own.all():
                    words = [words[j] for j in np.flatnonzero(own)]
                left = b" ".join(words)
                out["n_removed"].append(len(own) - len(words))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    out["kept_text"].append(left.decode("utf-8", "replace"))
            out["doc_id"] += ids.to_pylist()
            out["n_words"] += w.counts.tolist()
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}
        return pa.table({n: pa.array(v, kinds[n]) for n, v in out.items() if keep_text or n != "kept_text"})

    return _passes(docs, window, block, last, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def op8_lz_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
