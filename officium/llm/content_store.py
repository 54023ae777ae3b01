"""Token ids in a content-addressed store.

Layout of a store folder (all Parquet, written by Spark):

* ``blocks/kind=chunk``: ``digest`` (SHA-256 of the payload), ``payload`` (ids as little-endian unsigned integers
  of ``id_bytes`` bytes), ``n_ids``. Each distinct chunk is stored once.
* ``recipes``: a row per document in ascending ``doc_id`` order (nulls first, then by root; part files and rows both
  ascend): ``doc_id``, ``start``, ``n_tokens``, ``digests``, ``after`` (how many ids follow each chunk), ``root`` (SHA-256
  of the digests as hexadecimal text) and ``place``, the number of documents before it.
* ``manifest``: the Merkle tree above the roots. A node stands for ``FANOUT`` documents next to each other or, above level 0,
  as many nodes: ``level``, ``node``, ``documents``, ``root``. Nodes are cut by place, so the tree follows from the table
  alone, whatever the partitions; it ends in one node, ``root_of``.

A chunk ends where a rolling hash of the last ``WINDOW`` ids is 0 modulo the wanted mean size, so equal passages
give equal chunks wherever they stand. Null text counts as empty: its ids are the end id alone. Repeated rows and
repeated or null doc_ids are documents of their own. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, new_folder, shuffle_parts, slices, stage, text_column, window_hashes, with_running_totals
from .tokens import encoder

WINDOW = 8
FANOUT = 1024
PIECES = 1 << 21  # pieces whose ids a worker keeps: more than in packing, since the store works with nothing else in memory
RECIPES = "doc_id long, start long, n_tokens long, digests array<binary>, after array<long>, root binary, place long"
MANIFEST = "level int, node long, documents long, root binary"
BLOCKS = "digest binary, payload binary, n_ids int, doc_id long, n_tokens long, digests array<binary>, after array<long>, root binary, kind string"
ROWS = "kind string, key long, digest binary, payload binary, n_ids int, doc_id long, n_tokens long, digests array<binary>, after array<long>, root binary"
_ARROW = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("digest", pa.binary()), ("payload", pa.binary()), ("n_ids", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("after", pa.list_(pa.int64())), ("root", pa.binary())])
_SEEN = 200_000  # digests a task remembers, so that a passage in many documents is sent once a task


def chunk_ends(ids: np.ndarray, first: np.ndarray, mean: int) -> list[list[int]]:
    """For each document the ends of its chunks; none shorter than mean/4 but the last, none longer than 4*mean."""
    least, most = max(WINDOW, mean // 4), mean * 4
    h = window_hashes(ids.astype(U64), WINDOW)
    cuts = np.flatnonzero(h % U64(mean) == 0) + WINDOW
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        ends, at = [], a
        for c in cuts[np.searchsorted(cuts, a + least) : np.searchsorted(cuts, b)].tolist():
            while c - at > most:
                at += most
                ends.append(at)
            if c - at >= least:
                at = c
                ends.append(at)
        while b - at > most:
            at += most
            ends.append(at)
        if b > at:
            ends.append(b)
        out.append(ends)
    return out


def _chunks(path: str, keeps_space: bool, end_id: int, mean: int, id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path, keeps_space, PIECES), set()
        for batch in batches:
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for t in slices(text_column(batch)):
                ids, first = enc.encode(t, end_id)
                raw = ids.astype(id_type)
                cols: dict[str, list] = {n: [] for n in _ARROW.names}

                def row(**values):
                    for n, col in cols.items():
                        col.append(values.get(n))

                for i, ends in enumerate(chunk_ends(ids, first, mean)):
                    at, last, digests, after = int(first[i]), int(first[i + 1]), [], []
                    for end in ends:
                        payload = raw[at:end].tobytes()
                        digest = hashlib.sha256(payload).digest()
                        digests.append(digest)
                        after.append(last - end)
                        if digest not in seen:
                            if len(seen) >= _SEEN:
                                seen.clear()
                            seen.add(digest)
                            row(kind="chunk", key=int.from_bytes(digest[:7], "big"), digest=digest, payload=payload, n_ids=end - at)
                        at = end
                    root = hashlib.sha256(b"".join(digests).hex().upper().encode()).digest()
                    row(kind="recipe", key=int.from_bytes(root[:7], "big") ^ t.lo + i, doc_id=doc_ids[t.lo + i], n_tokens=last - int(first[i]), digests=digests, after=after, root=root)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols.values(), _ARROW)], schema=_ARROW)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, the first of each digest; recipes have none."""
    last = None
    for batch in batches:
        keep = []
        for d in batch.column(batch.schema.get_field_index("digest")).to_pylist():
            keep.append(d is None or d != last)
            last = d
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, keeps_space: bool = True, mean_chunk: int = 1024, id_bytes: int = 2) -> None:
    """Tokenize ``docs`` (doc_id, text) once and write the store."""
    spark = docs.sparkSession
    id_type = {2: "<u2", 4: "<u4"}[id_bytes]
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_chunks(tokenizer, keeps_space, end_id, mean_chunk, id_type), ROWS)
    parts = shuffle_parts(spark)
    (rows.repartition(parts, "key").sortWithinPartitions("kind", "digest").mapInArrow(_once, ROWS).drop("key")
     .write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/blocks"))
    recipes = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where("kind = 'recipe'").select("doc_id", "n_tokens", "digests", "after", "root")
    order, sums = [F.col("doc_id").asc_nulls_first(), F.col("root")], {"start": F.col("n_tokens"), "place": F.lit(1)}
    placed = stage(with_running_totals(recipes, order, sums, "recipes"), "placed")
    (placed.repartitionByRange("start").sortWithinPartitions("start").select(*[c.split()[0] for c in RECIPES.split(", ")])
     .write.option("compression", "zstd").parquet(f"{folder}/recipes"))
    _write_tree(spark.read.schema(RECIPES).parquet(f"{folder}/recipes").select("place", F.lit(1).alias("documents"), "root"), folder)


def _hashed(digests: Column) -> Column:
    """SHA-256 of an array of digests as hexadecimal text."""
    return F.unhex(F.sha2(F.array_join(F.transform(digests, F.hex), ""), 256))


def _nodes(rows: DataFrame) -> DataFrame:
    """The nodes (node, documents, root) above rows (place, documents, root): FANOUT rows each at most."""
    within = F.array_sort(F.collect_list(F.struct("place", "root")))["root"]
    return rows.groupBy(F.expr(f"place DIV {FANOUT}").alias("node")).agg(F.sum("documents").cast("long").alias("documents"), _hashed(within).alias("root"))


def _write_tree(rows: DataFrame, folder: str) -> None:
    spark, level = rows.sparkSession, 0
    while True:
        _nodes(rows).select(F.lit(level).alias("level"), "node", "documents", "root").write.mode("append").parquet(f"{folder}/manifest")
        nodes = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where(f"level = {level}")
        if nodes.count() <= 1:
            return
        rows, level = nodes.select(F.col("node").alias("place"), "documents", "root"), level + 1


def root_of(spark: SparkSession, folder: str) -> str:
    """The store's Merkle root; of an empty store the hash of nothing."""
    top = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy(F.desc("level")).select("root").first()
    return (bytes(top["root"]) if top else hashlib.sha256(b"").digest()).hex()


def verify_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest's nodes (level, node) that the recipes, or the nodes below, do not give, or that the manifest lacks.

    No rows: no recipe is lost or more, none has another root, and the root of the store follows from them.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    recipes = spark.read.schema(RECIPES).parquet(f"{folder}/recipes").select("place", F.lit(1).alias("documents"), "root")
    levels = manifest.agg(F.max("level")).first()[0]
    bad = None
    for level in range(1 + (levels or 0)):
        below = recipes if not level else manifest.where(F.col("level") == level - 1).select(F.col("node").alias("place"), "documents", "root")
        given = manifest.where(F.col("level") == level).select("node", F.struct("documents", "root").alias("given"))
        made = _nodes(below).select("node", F.struct("documents", "root").alias("made"))
        wrong = given.join(made, "node", "full").where(~F.col("given").eqNullSafe(F.col("made"))).select(F.lit(level).alias("level"), "node")
        bad = wrong if bad is None else bad.unionByName(wrong)
    return bad


_POLY = 0xEDB88320


def _zero_operators() -> np.ndarray:
    """[k][bit]: what one set bit of a CRC-32 becomes after 2**k zero bytes."""
    one = [_POLY] + [1 << (i - 1) for i in range(1, 32)]  # one zero bit

    def apply(m, v):
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= m[i]
        return out

    for _ in range(3):
        one = [apply(one, v) for v in one]
    ops = []
    for _ in range(44):
        ops.append(one)
        one = [apply(one, v) for v in one]
    return np.array(ops, np.uint32)


_ZEROS = _zero_operators()


def crc_shift(crc: np.ndarray, zero_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of a run as it counts in a longer run that goes on for zero_bytes: XOR of these is the whole's CRC."""
    crc = crc.astype(np.uint32)
    for k in range(int(zero_bytes.max(initial=0)).bit_length()):
        on = (zero_bytes >> k & 1).astype(bool)
        if on.any():
            v, out = crc[on], np.zeros(int(on.sum()), np.uint32)
            for bit in range(32):
                out ^= np.where(v >> np.uint32(bit) & np.uint32(1), _ZEROS[k, bit], np.uint32(0)).astype(np.uint32)
            crc[on] = out
    return crc


def _chunk_facts(id_type: str):
    def run(batches):
        for batch in batches:
            crc, ok, n = [], [], []
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(payload, id_type)
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                ok.append(hashlib.sha256(payload).digest() == digest)
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_()), pa.array(n, pa.int64())], names=["digest", "crc", "ok", "n"])

    return run


def _shifted(batches):
    for batch in batches:
        col = lambda n: batch.column(batch.schema.get_field_index(n))
        crc = np.asarray(col("crc").fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        moved = crc_shift(crc, 4 * np.asarray(col("after").to_numpy(zero_copy_only=False), np.int64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([col("start"), col("n"), col("ok"), pa.array(moved)], names=["start", "n", "ok", "crc"])


def read_store(spark: SparkSession, folder: str, id_bytes: int = 2) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, verified.

    Every chunk is read once and checked against its digest; documents then join their chunks' facts, not the
    payloads. verified: all chunks are there and whole, their ids number what the recipe says, the recipe's root follows
    from its digests, and the Merkle node over the document from the roots of all its documents and, up to the store's root,
    the nodes above from those below.
    """
    chunks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where("kind = 'chunk'").select("digest", "payload")
    facts = chunks.mapInArrow(_chunk_facts({2: "<u2", 4: "<u4"}[id_bytes]), "digest binary, crc long, ok boolean, n long")
    recipes = spark.read.schema(RECIPES).parquet(f"{folder}/recipes")
    parts = recipes.select("start", F.explode(F.arrays_zip("digests", "after")).alias("part")).select("start", F.col("part.digests").alias("digest"), F.col("part.after").alias("after"))
    crcs = (parts.join(facts, "digest", "left").select("start", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ok", F.lit(False)).alias("ok"), "crc", "after")
            .mapInArrow(_shifted, "start long, n long, ok boolean, crc long")
            .groupBy("start").agg(F.sum("n").alias("read"), F.bool_and("ok").alias("ok"), F.bit_xor("crc").alias("ids_crc32")))
    # A node above level 0 that does not follow spoils the documents below it: node / FANOUT ** level, brought down by a range.
    bad = stage(verify_tree(spark, folder).select((F.col("node") * F.pow(F.lit(FANOUT), F.col("level") + 1)).cast("long").alias("lo"), F.pow(F.lit(FANOUT), F.col("level") + 1).cast("long").alias("width")), "bad")
    own = recipes.select("doc_id", "start", "n_tokens", "place", (F.col("root") == _hashed(F.col("digests"))).alias("own"))
    if bad.limit(1).count():  # a store without damage, the usual one, needs no join
        widths = [r["width"] for r in bad.select("width").distinct().collect()]  # one for each level
        for width in widths:
            spoilt = bad.where(F.col("width") == width).select(F.expr(f"lo DIV {width}").alias("at"), F.lit(True).alias("spoilt")).distinct()
            own = own.withColumn("at", F.expr(f"place DIV {width}")).join(spoilt, "at", "left").withColumn("own", F.col("own") & F.col("spoilt").isNull()).drop("at", "spoilt")
    return own.join(crcs, "start").select(
        "doc_id", "start", F.col("read").alias("n_tokens"), "ids_crc32", (F.col("ok") & F.col("own") & (F.col("read") == F.col("n_tokens"))).alias("verified"))


def read_ids(spark: SparkSession, folder: str, id_bytes: int = 2) -> DataFrame:
    """The ids themselves: doc_id, start, ids array<int>, put together from the chunks."""
    chunks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where("kind = 'chunk'").select("digest", "payload")

    def ids(batches):
        for batch in batches:
            out = [np.frombuffer(p, {2: "<u2", 4: "<u4"}[id_bytes]).astype(np.int32) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array(out, pa.list_(pa.int32()))], names=["digest", "ids"])

    parts = spark.read.schema(RECIPES).parquet(f"{folder}/recipes").select("doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    return (parts.join(chunks.mapInArrow(ids, "digest binary, ids array<int>"), "digest").groupBy("doc_id", "start")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts")).select("doc_id", "start", F.flatten("parts.ids").alias("ids")))


def op1_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_store(spark, folder)
