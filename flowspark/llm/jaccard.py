"""Exact near-duplicate join of texts by the Jaccard distance of their word-shingle sets.

The distance d = 1 - |X & Y| / |X | Y| is a metric, and two texts link when it is at most
0.25. The join works on classes of texts with equal sets, so copies are never expanded:

1. The document frequency of every shingle is counted over all texts (sorted 32-bit hashes
   in key ranges, counted per range). Only the order of shingles depends on it.
2. Two linked sets share a shingle among the rarest quarter of either (prefix filter), so a
   set none of whose prefix shingles occurs elsewhere has no link and leaves here. Shingles that
   the counts know to be single are not even shuffled.
3. The least set that holds a prefix shingle is the pivot of all sets that hold it. A
   pivot's region is the sets it leads: both ends of a link share a region. Distances to
   the pivot are exact.
4. A region of at most `block` sets is joined in one task. There the triangle inequality
   keeps pairs in a window: |d(x,p) - d(y,p)| <= 0.25. In a larger region the sets are dealt
   to blocks that each hold a copy of the pivot. Sets within 0.25 of it are linked to it and
   so to each other; the rest, with the boundary sets whose window reaches into them, form
   the next region, around another pivot. What is still large after `rounds` such steps
   is joined block against block. No pair is dropped and no group is emitted as pairs.
5. Links between classes (a spanning forest of each region) give the components.

Null or wordless texts have no shingles and no links. Repeated rows and copies share a
class. Sets are identified by 64-bit hashes of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Sieve, column, connected_components, shuffle_partitions, union_all, written
from .words import mix, shingle_sets, sliced

SHINGLE, PERCENT, BLOCK, ROUNDS = 5, 75, 256, 3
#: Shingles that occur FREQUENT times or more are known by their count, at most FREQUENT_MOST
#: of them; all that occur twice or more, by a bit in a map of 2**SHARED_BITS bits.
FREQUENT, FREQUENT_MOST, SHARED_BITS = 8, 2_000_000, 28
#: Hashes are counted in RANGES ranges to a shuffle partition; HELD of them are sorted at a time.
RANGES, HELD = 16, 2_000_000
#: Regions above `block` sets are told to all tasks where they are at most so many; beyond, their sizes are joined.
LARGE_REGIONS = 100_000
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _ranged_counts(size: int, ranges: int):
    """For each few million shingle occurrences: (range, their 32-bit hashes that fall into it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def give() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            at = np.searchsorted(h, (np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges))
            rows = [(k, h[at[k] : at[k + 1]].astype("<u4").tobytes()) for k in range(ranges) if at[k] < at[k + 1]]
            return pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["range", "hashes"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), size):
                held.append((s >> np.uint64(32)).astype(np.uint32))
                n += len(s)
                if n >= HELD:
                    yield give()
                    held, n = [], 0
        if n:
            yield give()

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From hashes in order of their range: those that occur FREQUENT times or more with log2 of
    the count, and (as level -1) the bytes of the map of those that occur twice or more. One range
    is held at a time."""

    def ranges() -> Iterator[np.ndarray]:
        held, last = [], None
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and k != last:
                    yield np.concatenate(held)
                    held = []
                last = k
                held.append(np.frombuffer(b.as_py(), "<u4"))
        if held:
            yield np.concatenate(held)

    for part in ranges():
        h, n = np.unique(part, return_counts=True)
        many = n >= FREQUENT
        yield pa.record_batch([pa.array(h[many].astype(np.int64)), pa.array(np.log2(n[many]).astype(np.int32)), pa.nulls(int(many.sum()), pa.binary())], ["hash", "level", "bits"])
        slot = np.unique(h[n >= 2] >> np.uint32(32 - SHARED_BITS))
        if len(slot):
            first = int(slot[0]) & ~7
            bits = np.zeros((int(slot[-1]) | 7) + 1 - first, bool)
            bits[slot - first] = True
            yield pa.record_batch([pa.array([first >> 3]), pa.array([-1], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["hash", "level", "bits"])


class ShingleLevels:
    """Ranks shingles by how often they occur in all texts: 0 once, 1 a few times, then log2 of the count."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray, shared: np.ndarray) -> None:
        self.hashes, self.levels, self.shared = hashes, levels, shared

    def ranks(self, s: np.ndarray) -> np.ndarray:
        h = (s >> np.uint64(32)).astype(np.uint32)
        slot = h >> np.uint32(32 - SHARED_BITS)
        rank = (self.shared[slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8)) & np.uint8(1)
        if len(self.hashes) and rank.any():
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            rank = np.where(self.hashes[at] == h, self.levels[at], rank)
        return rank


def shingle_levels(texts: DataFrame, size: int = SHINGLE, most: int = FREQUENT_MOST) -> ShingleLevels:
    """Counts of all shingles of all texts, as what ranks them.

    The driver gets the map (32 MB) and at most `most` of the most frequent hashes, whatever
    the input; what these cannot tell apart ranks alike, which changes the cost, never the result.
    """
    spark = texts.sparkSession
    parts = shuffle_partitions(spark)
    ranges = texts.mapInArrow(_ranged_counts(size, RANGES * parts), "range int, hashes binary").repartition(parts, "range").sortWithinPartitions("range")
    counts = written(ranges.mapInArrow(_frequent, "hash long, level int, bits binary"), "frequent")
    per = {r["level"]: r["n"] for r in counts.where("level >= 0").groupBy("level").agg(F.count("*").alias("n")).collect()}
    least, total = 99, 0
    for level in sorted(per, reverse=True):
        if (total := total + per[level]) > most:
            break
        least = level
    got = counts.where(F.col("level") >= least).select("hash", "level").toArrow()
    h, level = got["hash"].to_numpy().astype(np.uint32), got["level"].to_numpy().astype(np.uint8)
    order = np.argsort(h)
    shared = np.zeros(1 << (SHARED_BITS - 3), np.uint8)
    for row in counts.where("level = -1").select("hash", "bits").toLocalIterator():
        shared[row["hash"] : row["hash"] + len(row["bits"])] |= np.frombuffer(row["bits"], np.uint8)
    return ShingleLevels(h[order], level[order], shared)


def node_of(s: np.ndarray) -> int:
    """The hash of a set of shingles."""
    parts = np.asarray([[np.bitwise_xor.reduce(mix(s * _ODD))], [s.sum(dtype=np.uint64)], [len(s)]], np.uint64)
    return int(mix(parts[0] + parts[1] + parts[2]).astype(np.int64)[0])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=at[1:])
    flat = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def _prefixes(size: int, percent: int, levels):
    """(id, set size, set hash, prefix shingles); the prefix only with the first copy that the task meets.

    Shingles that occur once in all texts count as places of the prefix, but find nobody: they are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = levels.value
        seen: set[int] = set()
        for batch in sliced(batches, 1):
            n, node, prefix = [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                if not len(s) or node[-1] in seen:
                    prefix.append(s[:0])
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node[-1])
                rank = ranked.ranks(s)
                keep = len(s) - (percent * len(s) + 99) // 100 + 1
                first = np.argsort(rank, kind="stable")[:keep]
                prefix.append(s[first[rank[first] > 0]])
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), _lists(prefix)], ["id", "n_shingles", "node", "prefix"])

    return run


def _chosen_sets(size: int, sieve):
    """(id, set hash, shingles) of the rows whose id passes the sieve; a null id passes. Copies that the task has met do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int | None, int]] = set()
        for batch in sliced(batches, 1):
            ids = batch.column(0)
            keep = sieve.value.passes(ids.fill_null(0).to_numpy(zero_copy_only=False))
            keep |= ids.is_null().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(keep))
            rows = []
            for name, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size)):
                if len(s) and (key := (name, node_of(s))) not in seen:
                    if len(seen) < 200_000:
                        seen.add(key)
                    rows.append((*key, s))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), _lists([r[2] for r in rows])], ["id", "node", "shingles"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (region, block), which lie together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        r, b = batch.column("region").to_numpy(), batch.column("block").to_numpy()
        cut = [0, *(np.flatnonzero((r[1:] != r[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(r)]
        for i, j in zip(cut, cut[1:]):
            if i == j:
                continue
            if held and (r[i], b[i]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = (r[i], b[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _joined(percent: int):
    """Links of each block (kind 0), and where the region is large only the distances to its pivot (kind 1)."""
    eps = 1 - percent / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int, float]] = []
        for t in _groups(batches):
            region, pivot, large = (t.column(c)[0].as_py() for c in ("region", "pivot", "large"))
            sets: dict[int, np.ndarray] = {}
            for node, s in zip(t.column("node").to_pylist(), t.column("shingles")):
                if node not in sets:
                    sets[node] = s.values.to_numpy()
            nodes = list(sets)
            p = sets.get(pivot)
            d = {}
            for x in nodes:
                if p is None or x == pivot:
                    d[x] = 0.0 if x == pivot else 1.0
                    continue
                common = _shared(p, sets[x])
                union = len(p) + len(sets[x]) - common
                d[x] = 1 - common / union
                if 100 * common >= percent * union:
                    out.append((region, pivot, x, 0, d[x]))
                if large == 1:
                    out.append((region, pivot, x, 1, d[x]))
            if large != 1:
                root = {x: x for x in nodes}

                def find(x: int, root: dict[int, int] = root) -> int:
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                if p is not None:
                    for x in nodes:
                        if d[x] <= eps and 100 * _shared(p, sets[x]) >= percent * (len(p) + len(sets[x]) - _shared(p, sets[x])):
                            root[find(x)] = find(pivot)
                line = sorted(nodes, key=d.get)
                for i, x in enumerate(line):
                    for y in line[i + 1 :]:
                        if p is not None and d[y] - d[x] > eps:
                            break
                        a, b = len(sets[x]), len(sets[y])
                        if 100 * min(a, b) < percent * max(a, b) or find(x) == find(y):
                            continue
                        common = _shared(sets[x], sets[y])
                        if 100 * common >= percent * (a + b - common):
                            root[find(y)] = find(x)
                            out.append((region, x, y, 0, 0.0))
            if len(out) >= 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    return run


def _links(rows: list[tuple[int, int, int, int, float]]) -> pa.RecordBatch:
    kinds = {"region": pa.int64(), "a": pa.int64(), "b": pa.int64(), "kind": pa.int32(), "d": pa.float64()}
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def _region_links(members: DataFrame, sets: DataFrame, percent: int, block: int, rounds: int) -> list[DataFrame]:
    """Links (a, b) that connect whatever is linked within each region. members: region, pivot, node."""
    parts, eps = [], 1 - percent / 100 + 1e-9
    deal = shuffle_partitions(members.sparkSession)
    for k in range(rounds + 1):
        # only large regions need their size; the rows of a region are not gathered to learn it
        sized = written(members.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > block), "sizes")
        sized = sized.hint("broadcast") if sized.count() <= LARGE_REGIONS else sized.hint("merge")
        large = F.when(F.col("n").isNull(), 0).otherwise(2 if k == rounds else 1)
        cells = F.ceil(F.col("n") / (max(2, block // 2) if k == rounds else block)).cast("int")
        m = members.join(sized, "region", "left").select("region", "pivot", "node", large.alias("large"), cells.alias("cells"))
        own = F.pmod(F.xxhash64("node", F.lit(k)), F.col("cells")).cast("int")
        every = F.sequence(F.lit(0), F.col("cells") - 1)
        blocks = (
            F.when(F.col("large") == 0, F.array(F.lit(0)))
            .when((F.col("large") == 1) & (F.col("node") == F.col("pivot")), every)
            .when(F.col("large") == 1, F.array(own))
            .otherwise(F.transform(every, lambda o: F.least(o, own) * F.col("cells") + F.greatest(o, own)))
        )
        m = m.select("region", "pivot", "node", "large", F.explode(blocks).alias("block"))
        got = m.join(sets.hint("merge"), "node").repartition(deal, "region", "block").sortWithinPartitions("region", "block")
        found = written(got.mapInArrow(_joined(percent), "region long, a long, b long, kind int, d double"), "links")
        parts.append(found.where("kind = 0").select("a", "b"))
        if k == rounds:
            break
        far = found.where("kind = 1")
        out = far.where(F.col("d") > eps).groupBy("region").agg(F.min("d").alias("least"), F.min(F.struct(F.xxhash64("b", F.lit(k)).alias("h"), F.col("b").alias("pivot"))).alias("first"))
        members = written(
            far.join(out.hint("shuffle_hash"), "region").where(F.col("d") >= F.when(F.col("d") > eps, F.lit(0.0)).otherwise(F.col("least") - eps))
            .select("region", F.col("first.pivot").alias("pivot"), F.col("b").alias("node")),
            "regions",
        )
        if members.isEmpty():
            break
    return parts


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the least id reachable by links).

    Rows with a null id keep it and count for links; a component of null ids only has a null
    component_id. Rows without shingles are their own component. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(shingle_levels(texts.select("text"), size))
    rows = written(texts.mapInArrow(_prefixes(size, percent, levels), "id long, n_shingles long, node long, prefix array<long>"), "prefixes")

    deal = shuffle_partitions(spark)
    tokens = rows.select(F.explode("prefix").alias("token"), "node").repartition(deal, "token")
    shared = tokens.groupBy("token").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot <> other").select("token", "pivot")
    members = tokens.join(shared.hint("shuffle_hash"), "token").select("pivot", "node").distinct()
    members = written(members.select(F.col("pivot").alias("region"), "pivot", "node"), "regions")

    chosen = members.select("node").distinct()
    holders = written(rows.where(F.size("prefix") > 0).groupBy("node").agg(F.min("id").alias("id")).join(chosen.hint("shuffle_hash"), "node", "left_semi"), "holders")
    sieve = spark.sparkContext.broadcast(Sieve(holders.where("id is not null").select("id")))
    # of the copies of a set only the holder's rows go on, so that no task gets them all
    sets = texts.mapInArrow(_chosen_sets(size, sieve), "id long, node long, shingles array<long>").alias("s")
    own = (F.col("s.node") == F.col("h.node")) & F.col("s.id").eqNullSafe(F.col("h.id"))
    sets = written(sets.join(holders.alias("h").hint("shuffle_hash"), own, "left_semi").select("node", "shingles"), "sets")

    roots = connected_components(union_all(_region_links(members, sets, percent, block, rounds)))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    classes = classes.join(roots.hint("shuffle_hash"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    component = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(component.hint("shuffle_hash"), "root").select("node", "component_id")
    out = rows.select("id", "n_shingles", "node").join(classes.hint("merge"), "node", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, but of each component only the row with the least id.

    Of repeated ids one row stays. Rows with a null id stay. Texts are not shuffled, but for
    rows whose id passes a sieve of the ids that are concerned.
    """
    found = ngram_jaccard_join(docs, id_col, text_col).toDF("id", "n_shingles", "component").where("id IS NOT NULL")
    concerned = found.groupBy("id").agg(F.min("component").alias("component"), F.count("*").alias("n"))
    concerned = written(concerned.where("id <> component OR n > 1").select("id", "component"), "concerned")
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve(concerned.select("id")))

    @F.arrow_udf("boolean")
    def may(ids: pa.Array) -> pa.Array:
        return pa.array(sieve.value.passes(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False))

    # the rows travel as one struct, so that no column name can clash
    key = column(id_col).cast("long")
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("row"), key.alias("key"), may(key).alias("may"))
    hit = rows.where("may").join(concerned.hint("merge"), F.col("key") == F.col("id"), "left")
    # the least of the rows with an id stays, where rows repeat it
    kept = hit.where("id = component").dropDuplicates(["key"])
    return union_all([part.select("row.*") for part in (rows.where("NOT may"), hit.where("id IS NULL"), kept)])
