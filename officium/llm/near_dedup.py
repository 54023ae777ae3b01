"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct shingles of ``words`` lower-cased (A-Z) words, with fewer words the whole sequence as
one; without words it is empty and linked with nothing. Documents with equal sets are one class, and the join is of
classes: a number stands for each, the text of its smallest doc_id for its texts. In each of ``TREES`` independent trees a node of the tree branches on minwise tokens
chosen by a hash of the path to it; the first ``DEPTH`` choices are taken in one step, as the nodes above hold nearly
everything. Nodes of at most ``SMALL`` documents are compared exhaustively, larger ones with at most ``REST`` documents
outside their main component too, in tiles; others branch on, twice at each node, and what is still large at
``DEEPEST`` is compared in tiles, so no document is left out. A pair at the threshold meets in a tree with probability
0.8**DEPTH at least, so TREES trees miss one in 10**7; the test of sketches below misses one in 10**5 at the threshold.

Links are confirmed on full sets (100 * intersection >= percent * union). First each node's members are tried against
its smallest document, which then leaves the node, and joined to components. Then only pairs across components are compared: by sketch, each pair in
the first tree in which it meets; the documents of pairs that are alike are sent with their texts to their node, which
compares the full sets and gives links between components only. A large group of near copies costs a few rows a
document instead of all pairs, and no link between components is lost.

Rows without a doc_id take no part: component_id is null and kept true. Rows that share a doc_id are one document with
all their texts' links, hence one component. Null text counts as empty. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Texts, _P, lower_ascii, mix, run_hashes, slices, stage, text_column, unstage, window_hashes, words_of

WORDS, PERCENT = 5, 80
FUNCTIONS = 128
TREES, DEPTH, DEEPEST = 32, 4, 10
SMALL, REST = 256, 1024
SLACK = 0.15  # four standard deviations of the sketch's estimate
ROW = ("node", "rep", "n", "root", "comp")
_A = mix(np.arange(1, FUNCTIONS + 1).astype(U64) * _P) | U64(1)
_SALT = U64(0x2545F4914F6CDD1D)


def shingle_sets(t: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text by text in ascending order, and where each text's start."""
    t = Texts(t.lo, lower_ascii(t.data), t.offsets)
    w = words_of(t)
    h = run_hashes(t.data, w.starts, w.ends)
    inside = np.flatnonzero(w.doc[: max(0, len(h) - words + 1)] == w.doc[words - 1 :]) if len(h) >= words else np.zeros(0, np.int64)
    few = np.flatnonzero((w.counts > 0) & (w.counts < words))
    g = np.append(window_hashes(h, words)[inside], run_hashes(h, w.first[few], w.first[few + 1]))
    doc = np.append(w.doc[inside], few)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])) if len(g) else np.zeros(0, bool)
    return g[new], np.searchsorted(doc[new], np.arange(t.n + 1))


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(text_column(batch)):
                g, first = shingle_sets(t, words)
                size = np.diff(first)
                full = np.flatnonzero(size)
                a, b = np.zeros(t.n, U64), np.zeros(t.n, U64)
                sketch = np.zeros((t.n, FUNCTIONS), np.uint16)
                if len(full):
                    at = first[:-1][full]
                    a[full], b[full] = np.add.reduceat(mix(g), at), np.add.reduceat(mix(g ^ _SALT), at)
                    for j in range(FUNCTIONS):
                        sketch[full, j] = (mix(np.minimum.reduceat(g * _A[j], at)) & U64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.get_field_index(c)).slice(t.lo, t.n) for c in ("doc_id", "text_hash")], pa.array(size, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([s.tobytes() for s in sketch], pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "sig_a", "sig_b", "sketch"])

    return run


def _sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, FUNCTIONS)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)))


def _step(path: np.ndarray, sketch: np.ndarray, branch: int) -> np.ndarray:
    """The paths one choice further: the token at the coordinate that the path and branch choose."""
    chosen = (mix(path + U64(branch) * _SALT) % U64(FUNCTIONS)).astype(np.int64)
    token = sketch[np.arange(len(sketch)), chosen].astype(U64)
    return mix(path * _P + token + U64(branch + 1))


def _root(tree: int, sketch: np.ndarray) -> np.ndarray:
    """The nodes of a tree after the first DEPTH choices."""
    path = np.full(len(sketch), mix(np.array([tree + 1], U64))[0])
    for _ in range(DEPTH):
        path = _step(path, sketch, 0)
    return path


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch = _sketch_matrix(batch.column(batch.schema.get_field_index("sketch")))
        rep, n = _column(batch, "rep"), _column(batch, "n")
        for tree in range(TREES):
            yield pa.RecordBatch.from_arrays([pa.array(_root(tree, sketch).view(np.int64)), pa.array(rep), pa.array(n)], names=["node", "rep", "n"])


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch = _sketch_matrix(batch.column(batch.schema.get_field_index("sketch")))
        path = _column(batch, "node").view(U64)
        for branch in (0, 1):
            node = pa.array(_step(path, sketch, branch).view(np.int64))
            root = pa.array(np.zeros(batch.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([node, *[batch.column(batch.schema.get_field_index(c)) for c in ("rep", "n")], root, batch.column(batch.schema.get_field_index("comp"))], names=["node", "rep", "n", "root", "comp"])


def _like(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sketches are alike enough for the threshold."""
    return (sketch[i] == sketch[j]).mean(axis=1) >= percent / 100 - SLACK


def _by_node(batches: Iterator[pa.RecordBatch], columns) -> Iterator[list[np.ndarray]]:
    """columns(batch), the node first, joined and cut so that no node (rows come sorted by node) is split."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns(batch)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        others = np.flatnonzero(cols[0] != cols[0][-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield [x[:cut] for x in cols]
        held = [x[cut:] for x in cols]
    if held is not None:
        yield held


def _row_columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [_column(batch, c) for c in ("node", "rep", "n", "root", "comp", "tile")] + [_sketch_matrix(batch.column(batch.schema.get_field_index("sketch")))]


def _alike(percent: int, node, n, root, comp, tile, sketch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within nodes, across components, with sketches alike enough.

    A pair that meets at the roots of several trees is given in the first one only; rows with root 0 give all theirs.
    """
    roots = np.stack([_root(tree, sketch) for tree in range(TREES)], axis=1).view(np.int64)
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, len(node)):
        i = np.flatnonzero(node[:-d] == node[d:])
        if not len(i):
            break
        j = i + d
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (comp[i] != comp[j]) & (100 * small >= percent * large) & ((tile[i] != tile[j]) | (tile[i] < 0))
        i, j = i[ok], j[ok]
        meet = (roots[i] == roots[j]).argmax(axis=1)
        ok = (root[i] == 0) | (root[j] == 0) | (roots[i, meet] == root[i])
        i, j = i[ok], j[ok]
        ok = _like(sketch, i, j, percent)
        first.append(i[ok])
        second.append(j[ok])
    return np.concatenate(first), np.concatenate(second)


def _candidates(percent: int):
    """The rows that have a partner in their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, rep, n, root, comp, tile, sketch in _by_node(batches, _row_columns):
            at = np.unique(np.concatenate(_alike(percent, node, n, root, comp, tile, sketch)))
            if len(at):
                cols = [pa.array(x[at]) for x in (node, rep, n, root, comp, tile)] + [pa.array([x.tobytes() for x in sketch[at]], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "rep", "n", "root", "comp", "tile", "sketch"])

    return run


def _links(words: int, percent: int):
    """Links (a, b) between components, confirmed on full sets, in rows with their texts sorted by node."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        sets = np.empty(batch.num_rows, object)
        for t in slices(text_column(batch)):
            g, first = shingle_sets(t, words)
            for k in range(t.n):
                sets[t.lo + k] = g[first[k] : first[k + 1]]
        return [*_row_columns(batch), sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, rep, n, root, comp, tile, sketch, sets in _by_node(batches, columns):
            i, j = _alike(percent, node, n, root, comp, tile, sketch)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            ends = np.searchsorted(node, node, side="right")
            comp, links = comp.copy(), ([], [])
            for x, partners in zip(np.unique(i), np.split(j, np.flatnonzero(np.diff(i)) + 1)):
                partners = partners[comp[partners] != comp[x]]
                mine = sets[x]
                if not len(partners) or not len(mine):
                    continue
                theirs = [sets[y] for y in partners]
                sizes = np.array([len(y) for y in theirs])
                every = np.concatenate(theirs)
                total = np.append(0, np.cumsum(mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every))
                upto = np.append(0, np.cumsum(sizes))
                both = total[upto[1:]] - total[upto[:-1]]
                for y in partners[(both > 0) & (100 * both >= percent * (len(mine) + sizes - both))]:
                    if comp[x] != comp[y]:
                        links[0].append(max(rep[x], rep[y]))
                        links[1].append(min(rep[x], rep[y]))
                        own = slice(np.searchsorted(node, node[x]), ends[x])
                        comp[own][comp[own] == comp[y]] = comp[x]
            if links[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])

    return run


def _alike_pairs(pairs: DataFrame, sketch_of: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate([_sketch_matrix(batch.column(batch.schema.get_field_index(c))) for c in ("sketch_a", "sketch_b")])
            at = np.arange(batch.num_rows)
            yield batch.filter(pa.array(_like(both, at, at + batch.num_rows, percent), pa.bool_())).select(["a", "b"])

    rows = pairs.join(sketch_of.toDF("a", "sketch_a"), "a").join(sketch_of.toDF("b", "sketch_b"), "b")
    return rows.mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough. texts: doc_id, text, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = []
                for name in ("text_a", "text_b"):
                    own = []
                    for t in slices(text_column(part, name)):
                        g, first = shingle_sets(t, words)
                        own += np.split(g, first[1:-1])
                    sets.append(own)
                linked = []
                for x, y in zip(*sets):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and comp, the smallest id reachable, for each id on an edge (a, b): least labels with pointer jumping."""
    links = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    label = stage(links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = links.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        lower = stage(label.join(near, label["id"] == near["a"]).select("id", F.least("comp", "near").alias("comp"), F.col("comp").alias("was")), "labels")
        jump = lower.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        new = stage(lower.join(jump, "comp").select("id", F.least("comp", "further").alias("comp"), "was"), "labels")
        unstage(label, lower)
        label = new
        if not new.where("comp <> was").limit(1).count():
            unstage(links)
            return label.select("id", "comp")


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    sketches = stage(docs.mapInArrow(_sketches(words), "doc_id long, text_hash long, n_shingles long, sig_a long, sig_b long, sketch binary"), "sketches")
    sets = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["sig_a", "sig_b", "n_shingles"]
    row = ["doc_id", "text_hash"]
    classes = sets.groupBy(*same).agg(F.min(F.struct(*row)).alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.select(*same, "least.*", "copies", F.monotonically_increasing_id().alias("rep")), "classes")
    # Of equal rows of a doc_id any one will do: their texts have one hash, hence one sketch.
    first = classes.select(*row, "rep", F.col("n_shingles").alias("n"))
    reps = stage(first.join(sketches.select(*row, "sketch"), row).dropDuplicates(["rep"]).select("rep", "n", "sketch"), "reps")

    nodes = stage(reps.mapInArrow(_roots, "node long, rep long, n long"), "nodes")
    shared = stage(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("rep", "n")).alias("least")).where("size > 1"), "shared")
    roots, nodes = nodes, stage(nodes.join(shared, "node").select("node", "rep", "n", F.col("least.rep").alias("b"), F.col("least.n").alias("bn")), "members")
    unstage(roots, shared)
    involved = first.join(nodes.select("rep"), "rep", "left_semi").select(*row, "rep")
    texts = stage(docs.join(involved, row).select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")

    ratio = F.least("n", "bn") * 100 >= F.greatest("n", "bn") * percent
    sketch_of = reps.select("rep", "sketch")
    stars = stage(nodes.where((F.col("rep") != F.col("b")) & ratio).select(F.col("rep").alias("a"), "b").distinct(), "stars")
    tried = stage(_alike_pairs(stars, sketch_of, percent), "tried")
    edges = stage(confirm(tried, texts, words, percent), "edges")
    unstage(stars, tried)
    nodes = nodes.where(F.col("rep") != F.col("b")).select("node", "rep", "n", F.col("node").alias("root"))
    mixed, leaves, branched = _mixed(nodes, components(edges)), [], None
    for depth in range(DEPTH, DEEPEST + 1):
        whole = F.array(F.struct("node", F.lit(-1).cast("long").alias("tile")))
        leaves.append(mixed.where(F.col("size") <= SMALL).select(*ROW, whole.alias("places")))
        large = mixed.where(F.col("size") > SMALL)
        if not large.limit(1).count():
            break
        large = stage(large, "large")
        ends = F.lit(True) if depth == DEEPEST else F.col("rest") <= REST
        leaves.append(_tiles(large.where(ends)))
        large = large.where(~ends).select(*ROW)
        if not large.limit(1).count():
            break
        if branched is None:  # below the roots a pair may part, so these documents' pairs are taken from every tree
            branched = large.select("rep").distinct().withColumn("deep", F.lit(True))
        mixed = _mixed(large.join(sketch_of, "rep").mapInArrow(_deeper, "node long, rep long, n long, root long, comp long"), None)
    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    if branched is not None:
        rows = rows.join(branched, "rep", "left").withColumn("root", F.when(F.col("deep"), F.lit(0)).otherwise(F.col("root"))).drop("deep")
    rows = rows.join(sketch_of, "rep").select("rep", "n", "root", "comp", "sketch", F.inline("places"))  # sketches are looked up by node, not by tile
    rows = rows.select(*ROW, "tile", "sketch").repartition("node").sortWithinPartitions("node")
    rows = stage(rows.mapInArrow(_candidates(percent), "node long, rep long, n long, root long, comp long, tile long, sketch binary"), "candidates")
    if rows.limit(1).count():
        full = rows.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select(*rows.columns, "text").repartition("node").sortWithinPartitions("node")
        edges = stage(edges.unionByName(full.mapInArrow(_links(words, percent), "a long, b long")), "edges")

    # Rows of one doc_id with different sets are one document: only such rows, not the groups of copies, join their classes.
    kinds = sets.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi"))
    several = sets.join(kinds.where("lo <> hi").select("doc_id"), "doc_id", "left_semi").select("doc_id", *same).distinct()
    several = stage(several.join(classes.select(*same, "rep"), same).select("doc_id", "rep"), "several")
    split = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    label = components(edges.unionByName(split))
    # A component goes by the smallest doc_id of its classes. Large classes meet their rows by broadcast: of classes with
    # at least one document in a thousand there are at most a thousand.
    named = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select(*same, "copies", "doc_id", F.coalesce("comp", "rep").alias("comp"))
    named = stage(named, "named")
    smallest = stage(named.groupBy("comp").agg(F.min("doc_id").alias("c")), "smallest")  # written, so that a hub's join can be split
    by_comp, named = named, stage(named.join(smallest, "comp").select(*same, "copies", "c"), "named")
    unstage(by_comp, smallest)
    least = max(1000, sketches.count() // 1000)
    big = F.broadcast(named.where(F.col("copies") >= least).select(*same, F.col("c").alias("c1")))
    rest = named.where(F.col("copies") < least).select(*same, F.col("c").alias("c2"))
    out = stage(sketches.select("doc_id", *same).join(big, same, "left"), "out")
    crowded = out.where("c1 IS NOT NULL").select("doc_id", "n_shingles", F.col("c1").alias("component_id"))
    others = out.where("c1 IS NULL").drop("c1").join(rest, same, "left").select("doc_id", "n_shingles", F.coalesce("c2", "doc_id").alias("component_id"))
    every = crowded.unionByName(others).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _mixed(nodes: DataFrame, label: DataFrame | None) -> DataFrame:
    """Members of the nodes that hold more than one component: ROW, size, main (the component with most members), rest (the members outside it)."""
    if label is not None:
        nodes = nodes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("node", "rep", "n", "root", F.coalesce("comp", "rep").alias("comp"))
    nodes = stage(nodes, "nodes")
    counts = nodes.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("k"))
    sizes = counts.groupBy("node").agg(F.sum("k").alias("size"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("k", "comp")).alias("m")).where("comps > 1")
    sizes = stage(sizes.select("node", "size", F.col("m.comp").alias("main"), (F.col("size") - F.col("m.k")).alias("rest")), "sizes")
    mixed = stage(nodes.join(sizes, "node"), "mixed")
    unstage(nodes, sizes)
    return mixed


def _tiles(large: DataFrame) -> DataFrame:
    """ROW and places (node, tile): every pair of members of different components meets in one tile of blocks, which is a node of its own.

    Pairs within the main component need no look, so its blocks meet only blocks of the rest, and those each other.
    """
    blocks = lambda n: F.ceil(n / SMALL).cast("int")
    is_main, own = F.col("comp") == F.col("main"), F.col("own")
    rows = large.withColumns({"mains": blocks(F.col("size") - F.col("rest")), "rests": blocks(F.col("rest"))})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(is_main, F.col("mains")).otherwise(F.col("rests")).cast("long")).cast("int"))
    place = lambda node, tile: F.struct(node.alias("node"), tile.cast("long").alias("tile"))
    others = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    of_main = others("rests", lambda other: place(F.xxhash64("node", F.lit(1), own, other), F.lit(1)))
    of_rest = others("mains", lambda other: place(F.xxhash64("node", F.lit(1), other, own), F.lit(0)))
    within = others("rests", lambda other: place(F.xxhash64("node", F.lit(2), F.least(own, other), F.greatest(own, other)), F.when(own == other, F.lit(-1)).otherwise(own)))
    return rows.select(*ROW, F.when(is_main, of_main).otherwise(F.concat(of_rest, within)).alias("places"))


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
