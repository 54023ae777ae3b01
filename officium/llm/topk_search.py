"""Exact top-k by inner product, with a pivot-distance index.

Vectors are made integer, floor(SCALE * x), and lie on a sphere of radius M, the longest vector's length, once each has one more
coordinate sqrt(M**2 - |v|**2). A query q gets 0 there, and then |q - v|**2 = |q|**2 + M**2 - 2 <q, v>: the largest inner products are
the nearest vectors, and distances obey the triangle inequality.

Index: pivots are taken farthest first from a sample of at most ``SAMPLE`` vectors; every vector is keyed by its nearest pivot
and its distance r from it, sorted by both, and written in blocks of ``BLOCK``, each an annulus least r to largest r. Cells, a pivot's
rings at the sample's quantiles, are at most ``PIVOTS * RINGS``, whatever the table; their exact bounds and sizes go
through the driver.

Search: query vectors go in packs of ``PACK``. A pack names the cells it needs, nearest first, and gets their blocks in that
order; a block is read for the queries only whose k-th score so far (at first that among the sample) it can still reach: no vector of it is nearer than
|d(q, pivot) - r|. When no query can be reached any more the pack stops. Each pack works in as many parts as there are
shuffle partitions, each with its share of every cell's blocks, and the parts' best rows are merged.

Equal vectors are one, with the k + 1 smallest ids: more can't be among the best k of a query. A query's own row is no candidate; other rows
with its vec_id are. Repeated rows (vec_id and vector) count once. Vectors that are null or hold null or non-finite components, and rows without vec_id,
take no part. Shorter vectors count as filled up with zeros; components beyond 64-bit integers as the largest, scores too, and tie there. Other
columns are not read. Without vectors there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, shuffle_parts, stage

SCALE = 64
SAMPLE, PIVOTS, RINGS = 8192, 256, 32
BLOCK, PACK = 512, 4096
SEED = 13
EXACT = 2**53  # below it, sums of products of integers are exact in float64
LARGEST = 2**63 - 1


# ---------------------------------------------------------------- integer vectors
def _integers(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows with a finite vector, and their integer components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out, rows = [], []
    values = np.asarray(column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(values * scale) if scale else values
    offsets, null = np.asarray(column.offsets), np.asarray(column.is_null())
    for i in np.flatnonzero(~null):
        v = values[offsets[i] : offsets[i + 1]]
        if np.isfinite(v).all():
            rows.append(i)
            out.append(np.where(v >= 2.0**63, LARGEST, np.clip(v, -(2.0**63), 2.0**63 - 1024).astype(np.int64)))
    return np.array(rows, np.int64), out


def _measured(column: str, scale: int):
    """Of a task's vectors: their number, most components, largest component and largest squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, dim, top, square = 0, 0, 0, 0.0
        for batch in batches:
            _, vectors = _integers(batch.column(batch.schema.get_field_index(column)), scale)
            for v in vectors:
                n, dim, top = n + 1, max(dim, len(v)), max(top, int(np.abs(v.astype(np.float64)).max(initial=0)))
                square = max(square, float((v.astype(np.float64) ** 2).sum()))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([dim]), pa.array([float(top)]), pa.array([square])], names=["n", "dim", "top", "square"])

    return run


def _packed(id_column: str, column: str, scale: int, dim: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = _integers(batch.column(batch.schema.get_field_index(column)), scale)
            filled = [np.append(v, np.zeros(dim - len(v), np.int64)).astype(kind).tobytes() for v in vectors]
            ids = batch.column(batch.schema.get_field_index(id_column)).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(filled, pa.binary())], names=["vec_id", "vec"])

    return run


class Space:
    """How vectors are stored, and the sphere they lie on."""

    def __init__(self, dim: int, top: float, square: float):
        self.dim = dim
        self.kind = "<i2" if top < 2**15 else "<i8"
        self.exact = top * top * max(1, dim) < EXACT
        self.square = square

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * (self.square**0.5 + 1)

    def matrix(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.dim) if self.dim else np.zeros((len(data), 0), self.kind)

    def scores(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Inner products; where they may be beyond 2**53 in Python's integers, as far as 64 bits hold them."""
        if self.exact:
            return q.astype(np.float64) @ v.astype(np.float64).T
        return np.minimum(LARGEST, np.maximum(-LARGEST - 1, q.astype(object) @ v.astype(object).T))

    def distances(self, v: np.ndarray, pivots: np.ndarray, queries: bool) -> np.ndarray:
        """From each vector to each pivot, both on the sphere; queries have 0 for the last coordinate."""
        v, pivots = v.astype(np.float64), pivots.astype(np.float64)
        own, far = (v * v).sum(axis=1), (pivots * pivots).sum(axis=1)
        up = np.sqrt(np.maximum(0, self.square - far))
        last = np.zeros(len(v)) if queries else np.sqrt(np.maximum(0, self.square - own))
        between = own[:, None] + far[None, :] - 2 * (v @ pivots.T) + (last[:, None] - up[None, :]) ** 2
        return np.sqrt(np.maximum(0, between))


# ---------------------------------------------------------------- index
def _farthest(space: Space, sample: np.ndarray, n: int) -> np.ndarray:
    """n of the sample, each the farthest from those before it."""
    chosen, near = [0], space.distances(sample, sample[:1], False)[:, 0]
    while len(chosen) < min(n, len(sample)):
        at = int(near.argmax())
        if near[at] <= space.slack:
            break
        chosen.append(at)
        near = np.minimum(near, space.distances(sample, sample[at : at + 1], False)[:, 0])
    return sample[chosen]


class Cells:
    """Pivots and the edges of each one's rings, from the sample."""

    def __init__(self, space: Space, sample: np.ndarray, pivots: int, rings: int):
        self.space, self.rings = space, rings
        self.pivots = _farthest(space, sample, pivots)
        far = space.distances(sample, self.pivots, False)
        nearest = far.argmin(axis=1)
        cuts = np.arange(1, rings) / rings
        self.edges = [np.quantile(far[nearest == p, p], cuts) for p in range(len(self.pivots))]

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell and its distance from the cell's pivot."""
        far = self.space.distances(v, self.pivots, False)
        pivot = far.argmin(axis=1)
        r = far[np.arange(len(v)), pivot]
        ring = np.zeros(len(v), np.int64)
        for p in np.unique(pivot):
            ring[pivot == p] = np.searchsorted(self.edges[p], r[pivot == p], side="right")
        return pivot * self.rings + ring, r


def _keyed(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, r = cells.of(cells.space.matrix(b"".join(batch.column("vec").to_pylist())) if cells.space.dim else np.zeros((batch.num_rows, 0), "<i2"))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(r), *[batch.column(c) for c in ("cls", "vec", "ids")]], names=["cell", "r", "cls", "vec", "ids"])

    return run


BLOCKS = "cell long, block long, lo double, hi double, vecs binary, cls array<long>, ids array<array<long>>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one cell's vectors, in the order of their distances; rows come sorted by cell and r."""
    now, rows, n = None, [], 0

    def block() -> pa.RecordBatch:
        r, cls, vec, ids = zip(*rows)
        values = [now, n, r[0], r[-1], b"".join(vec), list(cls), list(ids)]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["cell", "block", "lo", "hi", "vecs", "cls", "ids"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("cell", "r", "cls", "vec", "ids")]
        for cell, *row in zip(*cols):
            if rows and (cell != now or len(rows) == BLOCK):
                yield block()
                rows, n = [], n + 1
            now = cell
            rows.append(row)
    if rows:
        yield block()


# ---------------------------------------------------------------- search
class Pack:
    """Queries with their k best candidates so far."""

    def __init__(self, cells: Cells, vectors: np.ndarray, cls: np.ndarray, floor: np.ndarray, k: int):
        self.cells, self.vectors, self.cls, self.k = cells, vectors, cls, k
        self.far = cells.space.distances(vectors, cells.pivots, True)
        v = vectors.astype(np.float64)
        self.square = (v * v).sum(axis=1) + cells.space.square
        self.floor = floor  # the score a candidate must reach
        none = np.zeros(0, np.int64)
        self.best = (none, np.zeros(0, object if not cells.space.exact else np.float64), none, none)

    def reached(self, pivot: int, lo: float, hi: float) -> np.ndarray:
        """Queries that a vector between lo and hi from the pivot may still serve: the largest score it can have."""
        d = self.far[:, pivot]
        least = np.maximum(0, np.maximum(d - hi, lo - d) - self.cells.space.slack)
        most = (self.square - least**2) / 2
        return np.flatnonzero(most + self.cells.space.slack**2 + 1 + 1e-9 * np.abs(most) >= self.floor)

    def look(self, cell: int, lo: float, hi: float, vecs: bytes, cls: list[int], ids: list[list[int]]) -> None:
        some = self.reached(cell // self.cells.rings, lo, hi)
        if not len(some):
            return
        scores = self.cells.space.scores(self.vectors[some], self.cells.space.matrix(vecs) if self.cells.space.dim else np.zeros((len(cls), 0), "<i2"))
        i, j = np.nonzero(scores >= self.floor[some, None])
        if not len(i):
            return
        times = np.fromiter((len(x) for x in ids), np.int64, len(ids))
        start = np.cumsum(times) - times
        n = times[j]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[j], n)
        new = (np.repeat(some[i], n), np.repeat(scores[i, j], n), np.concatenate([np.asarray(x, np.int64) for x in ids])[at], np.repeat(np.asarray(cls, np.int64)[j], n))
        query, score, vec_id, other = (np.concatenate(x) for x in zip(self.best, new))
        order = np.lexsort((vec_id, -np.unique(score, return_inverse=True)[1], query))
        query = query[order]
        first = np.searchsorted(query, query, side="left")
        kept = order[np.arange(len(order)) - first < self.k]
        self.best = tuple(x[kept] for x in (np.concatenate([self.best[0], new[0]]), score, vec_id, other))
        query, score = self.best[0], self.best[1]
        last = np.flatnonzero(np.bincount(query, minlength=len(self.cls)) == self.k)
        end = np.searchsorted(query, last, side="right") - 1
        self.floor[last] = np.maximum(self.floor[last], score[end].astype(np.float64) if self.cells.space.exact else _below(score[end]))


def _below(scores: np.ndarray) -> np.ndarray:
    """Floats that are no larger than the integers."""
    return np.array([np.nextafter(float(s), -np.inf) for s in scores], np.float64)


def _floors(cells: Cells, sample: np.ndarray, k: int, q: np.ndarray) -> np.ndarray:
    """Each query's k-th score in the sample, of distinct vectors; minus infinity where the sample is smaller."""
    if len(sample) < k:
        return np.full(len(q), -np.inf)
    scores = cells.space.scores(q, sample)
    if cells.space.exact:
        return np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k].astype(np.float64)
    return _below(np.sort(scores, axis=1)[:, len(sample) - k])


PACKS = "pack long, part long, step long, cell long, lo double, hi double, vecs binary, cls array<long>, ids array<array<long>>, floor array<double>"


def _packs(cells: Cells, bounds: dict[int, tuple[float, float]], sample: np.ndarray, k: int):
    """Packs of queries, with the cells each needs, nearest first."""

    def made(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        cls, data = np.array([c for c, _ in rows], np.int64), b"".join(v for _, v in rows)
        q = cells.space.matrix(data) if cells.space.dim else np.zeros((len(rows), 0), "<i2")
        floor = np.concatenate([_floors(cells, sample, k, q[a : a + 256]) for a in range(0, len(q), 256)])
        pack = Pack(cells, q, cls, floor, k)
        need = []
        for cell, (lo, hi) in bounds.items():
            some = pack.reached(cell // cells.rings, lo, hi)
            if len(some):
                d = pack.far[some, cell // cells.rings]
                need.append((float(np.maximum(0, np.maximum(d - hi, lo - d)).mean()), cell))
        values = [int(cls[0]), data, cls.tolist(), floor.tolist(), [c for _, c in sorted(need)]]
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["pack", "vecs", "cls", "floor", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for row in zip(batch.column("cls").to_pylist(), batch.column("vec").to_pylist()):
                rows.append(row)
                if len(rows) == PACK:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    return run


def _best(cells: Cells, k: int):
    """The best rows of each pack and part. Its queries come first, then blocks, nearest cells first."""

    def out(pack: Pack) -> pa.RecordBatch:
        query, score, vec_id, other = pack.best
        return pa.RecordBatch.from_arrays([pa.array(pack.cls[query]), pa.array(score.astype(np.int64)), pa.array(vec_id), pa.array(pack.cls[query] == other)], names=["query", "score", "vec_id", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = None
        for batch in batches:
            for i in range(batch.num_rows):
                step, cell, lo, hi, vecs, cls, ids, floor = (batch.column(c)[i].as_py() for c in ("step", "cell", "lo", "hi", "vecs", "cls", "ids", "floor"))
                if step < 0:
                    if pack is not None:
                        yield out(pack)
                    q = cells.space.matrix(vecs) if cells.space.dim else np.zeros((len(cls), 0), "<i2")
                    pack = Pack(cells, q, np.array(cls, np.int64), np.array(floor), k)
                else:
                    pack.look(cell, lo, hi, vecs, cls, ids)
        if pack is not None:
            yield out(pack)

    return run


def write_index(rows: DataFrame, folder: str, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE, keep: int = 21) -> Cells | None:
    """Write the index of all vectors: ``classes`` (cls, vec, ids), ``blocks``; None if there are no vectors.

    keep: how many ids of equal vectors are kept, the smallest.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vec")).where(F.col("vec_id").isNotNull())
    sums = rows.mapInArrow(_measured("vec", scale), "n long, dim long, top double, square double").agg(F.sum("n"), F.max("dim"), F.max("top"), F.max("square")).first()
    if not sums[0]:
        return None
    space = Space(*sums[1:])
    rows = stage(rows.mapInArrow(_packed("vec_id", "vec", scale, space.dim, space.kind), "vec_id long, vec binary").distinct(), "vectors")
    rows.write.parquet(f"{folder}/rows")
    order = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    classes = rows.withColumn("rank", order).where(F.col("rank") <= keep).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes.withColumn("cls", F.monotonically_increasing_id()).write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    n = classes.count()
    taken = classes.orderBy(F.xxhash64(F.lit(SEED), "vec"), "vec").select("vec").limit(SAMPLE).collect()
    sample = space.matrix(b"".join(r["vec"] for r in taken)) if space.dim else np.zeros((len(taken), 0), "<i2")
    pivots = int(min(PIVOTS, max(1, n**0.5 / 4)))
    cells = Cells(space, sample, pivots, int(min(RINGS, max(1, n // (pivots * BLOCK)))))
    cells.sample = sample
    keyed = stage(classes.mapInArrow(_keyed(cells), "cell long, r double, cls long, vec binary, ids array<long>"), "keyed")
    keyed.repartitionByRange("cell", "r", "cls").sortWithinPartitions("cell", "r", "cls").mapInArrow(_blocks, BLOCKS).write.parquet(f"{folder}/blocks")
    return cells


def search(folder: str, cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row of queries (vec_id, vec), which are rows of the index."""
    spark = queries.sparkSession
    classes, blocks = spark.read.parquet(f"{folder}/classes"), spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    asked = stage(queries.select(F.col("vec_id").alias("query_id"), "vec").join(classes.select("vec", "cls"), "vec").select("query_id", "cls", "vec"), "asked")
    bounds = {r["cell"]: (r["lo"], r["hi"]) for r in blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}  # at most PIVOTS * RINGS
    vectors = asked.select("cls", "vec").distinct()
    packs = stage(vectors.mapInArrow(_packs(cells, bounds, cells.sample, k + 1), "pack long, vecs binary, cls array<long>, floor array<double>, cells array<long>"), "packs")
    parts = max(1, min(shuffle_parts(spark), blocks.count() // 4))
    none = lambda kind: F.lit(None).cast(kind)
    heads = packs.select("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(-1).cast("long").alias("step"), none("long").alias("cell"), none("double").alias("lo"), none("double").alias("hi"), "vecs", "cls", none("array<array<long>>").alias("ids"), "floor")
    needs = packs.select("pack", F.posexplode("cells").alias("step", "cell"))
    dealt = blocks.join(needs, "cell").select("pack", F.pmod(F.xxhash64("cell", "block", "lo", "hi"), F.lit(parts)).alias("part"), F.col("step").cast("long").alias("step"), "cell", "lo", "hi", "vecs", "cls", "ids", none("array<double>").alias("floor"))
    work = heads.unionByName(dealt).repartition(max(parts, shuffle_parts(spark)), "pack", "part").sortWithinPartitions("pack", "part", "step")
    found = work.mapInArrow(_best(cells, k + 1), "query long, score long, vec_id long, own boolean")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k + 1)
    best = ranked.groupBy(F.col("query").alias("cls")).agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id", "own"))).alias("best"))
    others = F.filter("best", lambda h: ~(h["own"] & (h["vec_id"] == F.col("query_id"))))
    rows = asked.select("query_id", "cls").join(stage(best, "best"), "cls").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def top_k(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k best other rows for each row of rows (vec_id, embedding) whose vec_id ``every`` divides."""
    spark = rows.sparkSession
    folder = new_folder(spark, "pivots")
    cells = write_index(rows, folder, keep=k + 1)
    if cells is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = spark.read.parquet(f"{folder}/rows").where(F.col("vec_id") % every == 0)
    return search(folder, cells, queries, k)


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id OR q.e <> v.e WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
