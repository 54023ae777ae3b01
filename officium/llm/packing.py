"""Packing by shortest-pack-first over the histogram of lengths.

Documents longer than a sequence are cut into full pieces and a rest. The driver sees only the histogram (at most
``length`` counts) and makes from it groups of equal packs; pieces find their place by their rank among the
pieces of their length. Null text counts as empty (the end id alone); repeated rows and repeated or null
doc_ids are documents of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stage, text_column, with_running_totals
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, keeps_space: bool, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keeps_space)
        for batch in batches:
            doc_ids = batch.column(batch.schema.get_field_index("doc_id"))
            for t in slices(text_column(batch)):
                ids, first = enc.encode(t, end_id)
                raw = ids.astype("<u4").tobytes()
                doc, starts, sizes, crcs = [], [], [], []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    for s in range(a, b, length):
                        e = min(b, s + length)
                        doc.append(i)
                        starts.append(s - a)
                        sizes.append(e - s)
                        crcs.append(zlib.crc32(raw[4 * s : 4 * e]))
                tokens = np.diff(first)[np.array(doc, np.int64)] if doc else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(np.array(doc, np.int64) + t.lo)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(tokens, pa.int64())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack_histogram(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (piece length, first rank, number, first sequence, offset), lengths longest first.

    A group is (filled, first sequence, number): packs of one pattern. A length goes to the shortest packs; where
    it doesn't fit the shortest, it fits none and opens new ones.
    """
    groups: list[tuple[int, int, int]] = []
    slots, sequences = [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            if groups and groups[0][0] + size <= length:
                filled, sequence, number = heapq.heappop(groups)
                take = min(left, number)
                if take < number:
                    heapq.heappush(groups, (filled, sequence + take, number - take))
            else:
                filled, sequence, take = 0, sequences, -(-left // (length // size))
                sequences += take
            slots.append((size, rank, take, sequence, filled))
            heapq.heappush(groups, (filled + size, sequence, take))
            left -= take
            rank += take
    return slots


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, keeps_space: bool = False, length: int = 2048) -> DataFrame:
    """A row per piece: PIECES, sequence_id, offset."""
    pieces = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, keeps_space, end_id, length), PIECES), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `length` rows
    slots = pack_histogram(counts, length)
    before, total = {}, 0
    for size in sorted(counts, reverse=True):
        before[size], total = total, total + counts[size]
    at = np.array([before[s] + r for s, r, *_ in slots], np.int64)
    sequence = np.array([s[3] for s in slots], np.int64)
    offset = np.array([s[4] for s in slots], np.int64)
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("start"), F.col("ids_crc32")]
    ranked = with_running_totals(pieces, order, {"_rank": F.lit(1)}, "ranked")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.asarray(batch.column(batch.schema.get_field_index("_rank")))
            k = np.searchsorted(at, rank, side="right") - 1
            cols = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence[k] + rank - at[k]), pa.array(offset[k])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
