"""Joins by keys, full rows, partners and nearest vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .profile import apart


def row_key(cols: list[str], df: DataFrame):
    """A 128-bit digest of whole rows: every value with its length, so that no value can run into the next.

    NULL and the empty string differ; 0.0 and -0.0 are the same, as are all NaN."""
    kinds = dict(df.dtypes)

    def part(c: str):
        x = F.col(f"`{c}`")
        if kinds[c] in ("double", "float"):
            x = F.when(x == 0, F.lit(0.0).cast(kinds[c])).otherwise(x)  # NaN prints alike whatever its bits
        text = x.cast("string") if not kinds[c].startswith(("array", "map", "struct")) else F.to_json(F.struct(x.alias("v")))
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat(*[part(c) for c in cols]))


def anti_join_rows(df: DataFrame, other: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows of df, copies included, that do not occur in other (NULLs equal). Columns are compared as those of df."""
    cols = cols or df.columns
    (k,) = apart([*df.columns, *other.columns], "key")
    kinds = dict(df.dtypes)
    same = other.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in cols])
    held = same.select(row_key(cols, same).alias(k)).distinct()
    return df.withColumn(k, row_key(cols, df)).join(held.hint("shuffle_hash"), k, "left_anti").drop(k)


def prefer_new(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """All new rows, and the old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(key).hint("shuffle_hash"), key, "left_anti"))


def left_collect(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """left with the sorted values of right by key; empty where there is none."""
    lists = right.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))
    return left.join(lists.hint("shuffle_hash"), key, "left").withColumn("values", F.coalesce("values", F.array().cast(f"array<{dict(right.dtypes)[value]}>")))


def class_table(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Union of the keys of several tables, one column of values a table, NULL where missing.

    One union and one aggregation instead of a chain of outer joins.
    """
    parts = [df.select(key, F.lit(n).alias("_t"), F.col(value).alias("_v")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(*[F.max(F.when(F.col("_t") == n, F.col("_v"))).alias(n) for n in tables])


#: Rows and reference vectors whose distances one matrix holds, so that it stays in a core's cache; distances worked out at once.
TILE, COLUMNS, EXACT = 256, 1_024, 1 << 16


def _least(s: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
    """Of each row k values that are no less than the k least of s and of best, close to them: of many values those of pairs of pairs."""
    if k == 1:
        return np.minimum(best, s.min(axis=1, keepdims=True))
    while s.shape[1] >= 16 * k:
        half = s.shape[1] // 2
        s = np.minimum(s[:, :half], s[:, half : 2 * half])
    some = np.flatnonzero(s.min(axis=1) < best.max(axis=1))
    best[some] = np.partition(np.hstack([best[some], s[some]]), k - 1, axis=1)[:, :k]
    return best


def _true(hit: np.ndarray) -> np.ndarray:
    """Flat places of the few that are true: eight at a time first."""
    flat = hit.ravel()
    flat = np.concatenate([flat, np.zeros(-len(flat) % 8, bool)]) if len(flat) % 8 else flat
    at = np.flatnonzero(flat.view(np.uint64))
    place = (8 * at[:, None] + np.arange(8)).ravel()
    return place[flat[place]]


def _candidates(left: np.ndarray, right: list[np.ndarray], k: int, limit: np.ndarray, error: np.ndarray, most: int) -> np.ndarray | None:
    """Flat places (row times all columns, plus column) of the products that may be among the k least of their row and within its limit; None
    where there are more than `most`. right: the columns in pieces. A piece is held against the least of those so far, and what it leaves against the least of all."""
    n, columns = len(left), sum(r.shape[1] for r in right)
    room, mask = np.empty(n * right[0].shape[1], left.dtype), np.empty(n * right[0].shape[1], bool)
    best = np.full((n, k), np.inf, left.dtype)
    places, values = [np.zeros(0, np.int64)], [np.zeros(0, left.dtype)]
    held, first = 0, 0
    for r in right:
        w = r.shape[1]
        s = np.matmul(left, r, out=room[: n * w].reshape(n, w))
        best = _least(s, best, k)
        bound = (np.minimum(best.max(axis=1), limit) + error).astype(left.dtype)
        at = _true(np.less_equal(s, bound[:, None], out=mask[: n * w].reshape(n, w)))
        places.append(at // w * columns + first + at % w)
        values.append(s.ravel()[at])
        held, first = held + len(at), first + w
        if held > most or first == columns:
            p, v = np.concatenate(places), np.concatenate(values)
            keep = v <= bound[p // columns]
            places, values = [p[keep]], [v[keep]]
            held = len(places[0])
            if held > most:
                return None
    return places[0]


def _nearest(k: int, own: bool):
    """Of a block of rows (far: what is farther away is not wanted) and a block of reference vectors: the k nearest of each row.

    One matrix product gives |p|^2 - 2 x p of all pairs in single precision. Whatever its error could hide among the k nearest is a candidate,
    and distances of candidates are worked out coordinate by coordinate, so that equal vectors are equally far."""

    def run(rows: pa.Table, reference: pa.Table) -> pa.Table:
        vectors = lambda t: _vectors(t["v"].combine_chunks())
        points, ids, x, mine = vectors(reference), reference["id"].to_numpy(), vectors(rows), rows["id"].to_numpy()
        far = np.nan_to_num(rows["far"].to_numpy().astype(float), nan=np.inf)
        out = {"id": [mine[:0]], "nearest": [ids[:0]], "distance": [far[:0]]}
        if len(x) and len(points):
            some = min(k + own, len(points))
            centre = points.mean(axis=0)
            about = points - centre
            unit = float(np.sqrt((about**2).sum(axis=1).max())) or 1.0
            about /= unit
            double = np.vstack([about.T, (about**2).sum(axis=1)])
            kinds = [np.float32, np.float64]
            pieces = [[double[:, c : c + COLUMNS].astype(t, copy=t != np.float64) for c in range(0, len(points), COLUMNS)] for t in kinds]
            for a in range(0, len(x), TILE):
                y = (x[a : a + TILE] - centre) / unit
                size = (y**2).sum(axis=1)
                left = np.hstack([-2 * y, np.ones((len(y), 1))])
                # in the unit of the widest point: what lies beyond `far`, with room for its own rounding
                limit = (far[a : a + TILE] / unit * (1 + 1e-9) + 1e-9) ** 2 - size
                for kind, right in zip(kinds, pieces, strict=True):
                    if kind == np.float32 and not size.max() < 1e12:
                        continue
                    error = 4 * (len(double) + 8) * np.finfo(kind).eps * (1 + 2 * np.sqrt(size) + size)
                    most = 64 * len(y) if kind == np.float32 else len(y) * len(points)
                    at = _candidates(left.astype(kind), right, some, limit, error, most)
                    if at is not None:
                        break
                row, col = np.divmod(at, len(points))
                row += a
                if own:
                    other = mine[row] != ids[col]
                    row, col = row[other], col[other]
                d = np.concatenate([np.zeros(0), *[np.sqrt(((x[row[i : i + EXACT]] - points[col[i : i + EXACT]]) ** 2).sum(axis=1)) for i in range(0, len(row), EXACT)]])
                order = np.lexsort((ids[col], d, row))
                row, col, d = row[order], col[order], d[order]
                first = np.searchsorted(row, row)
                keep = (np.arange(len(row)) - first < k) & np.isfinite(d)
                out["id"].append(mine[row[keep]])
                out["nearest"].append(ids[col[keep]])
                out["distance"].append(d[keep])
        return pa.table({c: np.concatenate(v) for c, v in out.items()})

    return run


#: Vectors that others are placed by, a bounded sample of the reference; rows of a block that meet a block of the reference in one task.
PIVOTS, ROWS = 64, 32_000


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances, coordinate by coordinate: bounds must not suffer from cancellation."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], axis=1)) if len(x) else np.zeros((0, len(pivots)))


def _placed(pivots: np.ndarray):
    """(id, v) with the nearest pivot and the distance to it."""

    def run(batches):
        for b in batches:
            d = _apart(_vectors(b.column(1)), pivots)
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, int)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "r"])

    return run


def _blocks_of(pivots: np.ndarray, table: np.ndarray, home: bool):
    """(id, v, far) to (id, v, far, blocks): its own block, or all others that may hold a vector at most `far` away, if any.

    table: cell, least and largest distance to the pivot, a row a block. A vector of a block is at least the larger of
    (distance to the pivot - largest) and (least - distance to the pivot) away."""
    cell, low, high = table[:, 0].astype(int), table[:, 1], table[:, 2]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                d = _apart(_vectors(part.column(1)), pivots)[:, cell]
                bound = np.maximum(0, np.maximum(d - high, low - d))
                own = (bound + 1e-9 * d).argmin(axis=1)
                if home:
                    n, block = np.ones(len(own), int), own
                else:
                    far = np.nan_to_num(part.column(2).to_numpy(zero_copy_only=False), nan=np.inf)
                    may = bound <= (far + 1e-6 * (1 + far))[:, None]
                    may[np.arange(len(own)), own] = False
                    n, block = may.sum(axis=1), np.nonzero(may)[1]
                blocks = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(block.astype(np.int32)))
                yield pa.record_batch([*[part.column(c) for c in range(3)], blocks], ["id", "v", "far", "blocks"]).filter(pa.array(n > 0))

    return run


def _met(rows: DataFrame, points: DataFrame, k: int, own: bool) -> DataFrame:
    """(id, nearest, distance) of rows (id, v, far, blocks) among the points of their blocks. Many rows of a block are dealt to several tasks."""
    rows = rows.select("id", "v", "far", F.explode("blocks").alias("block"))
    chunks = rows.groupBy("block").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("chunks"))  # a row a block
    dealt = rows.join(F.broadcast(chunks), "block").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    copies = points.join(F.broadcast(chunks), "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return dealt.groupBy("block", "chunk").cogroup(copies.groupBy("block", "chunk")).applyInArrow(_nearest(k, own), "id long, nearest long, distance double")


def nearest(df: DataFrame, reference: DataFrame, id_col: str, vec_col: str, k: int = 1, leave_self: bool = False, block: int = 64_000) -> DataFrame:
    """(id, nearest): the k closest reference vectors of each row as an array of (distance, nearest), exact; ties go to the smaller id.

    Ids are unique and not null; without other reference vectors a row is absent."""
    return nearest_pruned(df, reference, id_col, vec_col, k, leave_self, block)[0]


def nearest_pruned(df: DataFrame, reference: DataFrame, id_col: str, vec_col: str, k: int = 1, leave_self: bool = False, block: int = 64_000) -> tuple[DataFrame, dict[str, int]]:
    """nearest, and how many pairs of a row and a block of the reference there are and how many were looked at.

    Reference vectors go to the cell of their nearest pivot and, by rings of the distance to it, to blocks of about `block`.
    A row first meets the block that it lies in or nearest to; the k-th distance found there rules out, by the triangle
    inequality, blocks that can hold nothing nearer, before any vector moves; only the others are met. Each row moves once a block that it
    meets, so blocks are large. Of equal reference vectors only the k + 1 smallest ids can be among anybody's k nearest; vectors that are not finite are near nothing.
    """
    spark = df.sparkSession
    kind = "array<float>" if {dict(df.dtypes)[vec_col], dict(reference.dtypes)[vec_col]} == {"array<float>"} else "array<double>"
    pick = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"))
    finite = pick(reference).where(F.forall("v", lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))))
    place = F.row_number().over(W.partitionBy(F.xxhash64("v"), "v").orderBy("id"))
    points = written(finite.withColumn("place", place).where(F.col("place") <= k + 1).select("id", "v"), "reference")
    wanted = min(PIVOTS, max(1, -(-4 * points.count() // block)))
    some = points.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    if not some:
        return spark.createDataFrame([], "id long, nearest array<struct<distance: double, nearest: long>>"), {"pairs": 0, "met": 0}
    pivots = np.asarray([r["v"] for r in some])
    placed = written(points.mapInArrow(_placed(pivots), f"id long, v {kind}, cell int, r double"), "placed")
    # rings of a cell end at quantiles of the distance; a ring that equal distances overfill is dealt by hash
    n = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("r", F.array(*[F.lit(i / 256) for i in range(1, 256)]), 10_000).alias("q"))  # a row a pivot
    rings = F.ceil(F.col("n") / block)
    step = F.greatest(F.lit(1), F.floor(256 / rings))
    ends = n.select("cell", F.array_distinct(F.filter("q", lambda x, i: (i + 1) % step == 0)).alias("ends"))
    ringed = placed.join(F.broadcast(ends), "cell").withColumn("ring", F.size(F.filter("ends", lambda e: e < F.col("r")))).drop("ends")
    sizes = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("subs"))
    dealt = ringed.join(F.broadcast(sizes), ["cell", "ring"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))
    made = dealt.groupBy("cell", "ring", "sub").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).orderBy("cell", "ring", "sub").collect()  # a row for `block` vectors
    table = np.asarray([(r["cell"], r["low"], r["high"]) for r in made])
    names = spark.createDataFrame([(i, r["cell"], r["ring"], r["sub"]) for i, r in enumerate(made)], "block int, cell int, ring int, sub int")
    points = written(dealt.join(F.broadcast(names), ["cell", "ring", "sub"]).select("id", "v", "block"), "points")

    rows, fields = pick(df), f"id long, v {kind}, far double, blocks array<int>"
    first = written(_met(written(rows.withColumn("far", F.lit(None).cast("double")).mapInArrow(_blocks_of(pivots, table, True), fields), "rows"), points, k, leave_self), "near")
    kth = first.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("far"))
    known = rows.join(kth.hint("merge"), "id", "left").select("id", "v", "far")
    more = written(known.mapInArrow(_blocks_of(pivots, table, False), fields), "others")
    both = first.unionByName(_met(more, points, k, leave_self))
    best = F.sort_array(F.collect_list(F.struct("distance", "nearest")))  # k for each block met
    total = rows.count()
    counts = {"pairs": total * len(made), "met": total + (more.agg(F.sum(F.size("blocks"))).first()[0] or 0)}
    return both.groupBy("id").agg(F.slice(best, 1, k).alias("nearest")), counts


def nearest_distance(df: DataFrame, reference: DataFrame, id_col: str, vec_col: str, leave_self: bool = False) -> DataFrame:
    """(id, nearest, distance): the closest reference vector of each row."""
    return nearest(df, reference, id_col, vec_col, 1, leave_self).select("id", F.col("nearest")[0]["nearest"].alias("nearest"), F.col("nearest")[0]["distance"].alias("distance"))
