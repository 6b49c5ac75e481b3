"""Product codes of vectors: Lloyd rounds over cover trees.

Components become integers floor(256 * x), vectors are cut into PARTS equal parts, and each
part position has a codebook of at most ENTRIES entries. All sums and distances are integers, so
results do not depend on how rows are dealt.

Rows are dealt in blocks; a block has one cover tree for each part position (`_tree`): the members
of a node lie within its radius of its centre, children's centres are more than half the scale
apart, the scale halves from level to level. Members of a node are neighbours in the tree's order,
so cumulative sums over that order give the sum of any node. Trees are built once, written, and read
by every pass. A pass (`_assigned`) starts at the roots: where the nearest entry of a node's centre
is nearer than the next one by more than twice the radius, the triangle inequality gives the whole
subtree to it; other nodes descend, and members of ambiguous leaves are compared exactly.
A round's sums are added up in Spark; the driver gets PARTS * ENTRIES rows.

Left out, besides null vectors and vectors with null or non-finite components: vectors of
another length than that of the least vec_id kept, and all where that length is no multiple of
PARTS (they have no parts). Components beyond 2**28 / 256 in size are an error (squares would
overflow). Null ids come last; equal ids are ordered by their vectors. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, small_batches, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK, LEAF, MOST = 4096, 8, 1 << 28
#: Labels are broadcast with their sums where they are counted and at most so many.
LABELS = 10_000
SALTS = 16


def _tree(x: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """x: members, part: the tree of each (ascending). (order of members, levels); a level has for its
    nodes: first member, one past the last (places in the order), centre (a member), squared radius, whether a leaf."""
    order = np.arange(len(x))
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(x) else order
    node = np.cumsum(np.concatenate(([0], part[1:] != part[:-1]))) if len(x) else order
    centre = first.copy()
    levels = []
    scale = None
    while len(order):
        # order, node: members that are still below the open nodes; nodes are numbered in order
        away = ((x[order] - x[centre[node]]) ** 2).sum(1)
        begins = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        size = np.diff(np.append(begins, len(order)))
        radius = np.maximum.reduceat(away, begins)
        leaf = (size <= LEAF) | (radius == 0)
        levels.append((order, begins, begins + size, centre, radius, leaf))
        inner = ~leaf[node]
        if not inner.any():
            break
        if scale is None:
            scale = float(radius.max())
        scale /= 4  # squared: half the distance
        order, node = order[inner], node[inner]
        # children: in all nodes at once, the first member that none covers becomes a centre
        child = np.full(len(order), -1)
        open_ = np.arange(len(order))
        made: list[np.ndarray] = []
        count = 0
        while len(open_):
            n = node[open_]
            begins = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
            c = order[open_[begins]]
            which = np.cumsum(np.concatenate(([0], n[1:] != n[:-1])))
            near = ((x[order[open_]] - x[c[which]]) ** 2).sum(1) <= scale
            child[open_[near]] = count + which[near]
            made.append(c)
            count += len(c)
            open_ = open_[~near]
        move = np.lexsort((child, node))
        order, child = order[move], child[move]
        node = np.cumsum(np.concatenate(([0], child[1:] != child[:-1])))
        centre = np.concatenate(made)[child[np.flatnonzero(np.concatenate(([True], child[1:] != child[:-1])))]]
    return levels


class _Forest:
    """The trees of a block; x: rows x parts * width integers."""

    def __init__(self, x: np.ndarray, parts: int, levels: list | None = None) -> None:
        self.x, self.parts = x, parts
        n, self.width = len(x), x.shape[1] // parts
        self.members = x.reshape(n, parts, self.width).swapaxes(0, 1).reshape(n * parts, self.width)
        self.n = n
        self.levels = levels if levels is not None else _tree(self.members, np.repeat(np.arange(parts), n))

    def bytes(self) -> bytes:
        out = [len(self.levels).to_bytes(4, "little")]
        for level in self.levels:
            for a in level:
                raw = a.astype("<i8" if a is level[4] else "<i4").tobytes()
                out += [len(raw).to_bytes(4, "little"), raw]
        return b"".join(out)

    @classmethod
    def read(cls, x: np.ndarray, parts: int, raw: bytes) -> _Forest:
        levels, at = [], 4
        for _ in range(int.from_bytes(raw[:4], "little")):
            level = []
            for i in range(6):
                size = int.from_bytes(raw[at : at + 4], "little")
                level.append(np.frombuffer(raw, "<i8" if i == 4 else "<i4", size // (8 if i == 4 else 4), at + 4).astype(np.int64))
                at += 4 + size
            level[5] = level[5].astype(bool)
            levels.append(tuple(level))
        return cls(x, parts, levels)


def _distances(x: np.ndarray, part: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each part: (which of x are of it, their squared distances to its entries)."""
    for p in range(len(books)):
        at = np.flatnonzero(part == p)
        for k in range(0, len(at), 8192):
            some = at[k : k + 8192]
            a, b = x[some], books[p]
            most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
            if 4 * max(1, a.shape[1]) * most * most < 1 << 52:  # exact in floating point
                f, g = a.astype(np.float64), b.astype(np.float64)
                yield some, (f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)
            else:
                yield some, ((a[:, None] - b[None]) ** 2).sum(2)


def _assigned(forest: _Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """books: parts x entries x width. (nearest entry of every member, counts and sums of every entry,
    share of members that whole subtrees decide)."""
    parts, entries, width = books.shape
    n = forest.n
    entry = np.zeros(len(forest.members), np.int64)
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    whole = 0
    live = None  # which nodes of the level are still undecided
    for depth, (order, lo, hi, centre, radius, leaf) in enumerate(forest.levels):
        live = np.ones(len(lo), bool) if live is None else live
        at = np.flatnonzero(live)
        if not len(at):
            break
        part = centre[at] // max(n, 1)
        best, sure = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        for some, d in _distances(forest.members[centre[at]], part, books):
            b = d.argmin(1)  # the least index among ties
            first = d[np.arange(len(b)), b].astype(np.float64)
            d[np.arange(len(b)), b] = np.iinfo(np.int64).max if d.dtype == np.int64 else np.inf
            second = d.min(1).astype(np.float64) if entries > 1 else np.full(len(b), np.inf)
            r = radius[at[some]]
            sure[some] = (r == 0) | (np.sqrt(second) * (1 - 1e-9) > (np.sqrt(first) + 2 * np.sqrt(r.astype(np.float64))) * (1 + 1e-9))
            best[some] = b
        # whole subtrees: their sums are differences of cumulative sums over the level's order
        got = at[sure]
        if len(got):
            total = np.concatenate((np.zeros((1, width), np.int64), np.cumsum(forest.members[order], axis=0)))
            slot = part[sure] * entries + best[sure]
            np.add.at(sums.reshape(-1, width), slot, total[hi[got]] - total[lo[got]])
            np.add.at(counts.reshape(-1), slot, hi[got] - lo[got])
            size = hi[got] - lo[got]
            where = np.repeat(lo[got] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            entry[order[where]] = np.repeat(best[sure], size)
            whole += int(size.sum())
        # ambiguous leaves: exact comparisons of their members
        got = at[~sure & leaf[at]]
        if len(got):
            size = hi[got] - lo[got]
            where = np.repeat(lo[got] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            m = order[where]
            for some, d in _distances(forest.members[m], m // n, books):
                entry[m[some]] = d.argmin(1)
            slot = m // n * entries + entry[m]
            np.add.at(sums.reshape(-1, width), slot, forest.members[m])
            np.add.at(counts.reshape(-1), slot, 1)
        # ambiguous inner nodes descend: the next level holds the members of all inner nodes
        if depth + 1 < len(forest.levels):
            below_order, below_lo = forest.levels[depth + 1][0], forest.levels[depth + 1][1]
            open_ = np.zeros(len(forest.members), bool)
            got = at[~sure & ~leaf[at]]
            size = hi[got] - lo[got]
            where = np.repeat(lo[got] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            open_[order[where]] = True
            live = open_[below_order[below_lo]]
    return entry.reshape(forest.parts, n).T, counts, sums, whole / max(1, len(forest.members))


def _grow(parts: int):
    """batches: id, label, integer vector. A row a block: its ids, labels, vectors and trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def give() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x = rows.column(2).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            if np.abs(x).max(initial=0) > MOST:
                raise ValueError(f"components beyond {MOST // SCALE} cannot be coded")
            offsets = pa.array([0, rows.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, rows.column(i)) for i in (0, 1)]
            return pa.record_batch([*lists, pa.array([x.astype("<i4").tobytes()]), pa.array([_Forest(x, parts).bytes()])], ["ids", "labels", "vectors", "trees"])

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                if n and n + some.num_rows > BLOCK:
                    yield give()
                    held, n = [], 0
                held.append(some)
                n += some.num_rows
        if n:
            yield give()

    return run


def _forests(batches: Iterator[pa.RecordBatch], parts: int, at: int) -> Iterator[tuple[pa.RecordBatch, int, _Forest]]:
    for batch in batches:
        for i in range(batch.num_rows):
            raw = batch.column(at)[i].as_py()
            n = len(raw) // 4
            width = batch.column(at + 2)[i].as_py()
            yield batch, i, _Forest.read(np.frombuffer(raw, "<i4", n).astype(np.int64).reshape(-1, width), parts, batch.column(at + 1)[i].as_py())


def _round(books: np.ndarray):
    """batches: vectors, trees, dim. (slot, count, sums) of what a task assigned."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, _, forest in _forests(batches, parts, 0):
            _, c, s, _ = _assigned(forest, books)
            counts += c
            sums += s
        slot = np.flatnonzero(counts.ravel())
        yield pa.record_batch([pa.array(slot, pa.int32()), pa.array(counts.ravel()[slot]), pa.array(list(sums.reshape(-1, width)[slot]), pa.list_(pa.int64()))], ["slot", "n", "sums"])

    return run


def _coded(books: np.ndarray):
    """batches: ids, labels, vectors, trees, dim. (id, label, code, error, share of the block that whole subtrees decided)."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, forest in _forests(batches, parts, 2):
            entry, _, _, whole = _assigned(forest, books)
            x = forest.x.reshape(forest.n, parts, width)
            error = ((x - books[np.arange(parts)[None], entry]) ** 2).sum((1, 2))
            code = [e.tobytes().hex() for e in entry.astype(np.uint8)]
            ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
            yield pa.record_batch([ids, labels, pa.array(code, pa.string()), pa.array(error), pa.array(np.full(forest.n, whole))], ["id", "label", "code", "error", "whole"])

    return run


def _first_books(ints: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """parts x entries x width: the parts of the vectors of the least ids; None where no vector has parts."""
    least = ints.orderBy(F.col("id").asc_nulls_last(), F.col("v").asc(), F.col("label").asc()).limit(1).collect()
    dim = len(least[0]["v"]) if least else 0
    if not dim or dim % parts:
        return None
    rows = ints.where(F.size("v") == dim).orderBy(F.col("id").asc_nulls_last(), F.col("v").asc(), F.col("label").asc()).limit(entries).collect()
    books = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), parts, dim // parts).swapaxes(0, 1)
    return np.ascontiguousarray(books)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v): floor(256 * x) of every usable vector."""
    v = column(vector_col).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(usable).select(column(id_col).alias("id"), column(label_col).alias("label"), F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def product_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """((id_col, label_col, code, error, whole), codebooks of parts x entries x width).

    code: two hex digits a part; error: squared distances summed; whole: share of the row's block that whole
    subtrees decided in the last pass. entries: 256 at most."""
    spark = vectors.sparkSession
    kinds = dict(vectors.select(column(id_col).alias("id"), column(label_col).alias("label")).dtypes)
    out = lambda df: df.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "whole")
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error long, whole double"
    ints = integer_vectors(vectors, id_col, vector_col, label_col)
    books = _first_books(ints, parts, entries)
    if books is None:
        return out(spark.createDataFrame([], schema)), np.zeros((parts, 0, 0), np.int64)
    width = books.shape[2]
    dim = parts * width
    with small_batches(spark, BLOCK):
        grown = ints.where(F.size("v") == dim).mapInArrow(_grow(parts), f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, vectors binary, trees binary")
    forests = written(grown, "trees").withColumn("dim", F.lit(dim))
    with small_batches(spark, 16):
        for _ in range(rounds):
            slots = forests.select("vectors", "trees", "dim").mapInArrow(_round(books), "slot int, n long, sums array<long>")
            total = slots.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect()  # parts * entries rows at most
            flat = books.reshape(-1, width).copy()
            for r in total:
                flat[r["slot"]] = [s // r["n"] for s in r["sums"]]
            books = flat.reshape(books.shape)
        coded = forests.select("ids", "labels", "vectors", "trees", "dim").mapInArrow(_coded(books), schema)
        return out(written(coded, "codes")), books


def codes_digest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of all usable vectors."""
    coded, books = product_codes(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = coded.select(column(id_col).alias("id"), column(label_col).alias("label"), "code", "error")
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").select(F.col("label").alias("of"), "label_error")
    if sums.count() <= LABELS:
        joined = rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")), "left")
    else:  # a label may hold most rows
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        copies = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("copy"))
        joined = dealt.join(copies.hint("shuffle_hash"), F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("copy")), "left")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
