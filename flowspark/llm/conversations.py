"""Prefix trie of conversations by ROLLUP over columns of turns.

Turns of a conversation become hashes of (role, text, place); a row holds `width` of them, one
column each, for one block of a conversation's places, and the hash of all turns before the
block: the node where the block before it ends. One GROUP BY block, node, ROLLUP(t1, ... ) therefore
aggregates all prefixes of all blocks together; grouping_id() tells how many columns a group
keeps, and so its depth. Blocks need no loop, because the hash of a path is the exclusive or of
its turns' hashes, which are made of the place too, and running values come from windows, in two steps
(blocks of a conversation by thousands), so that a very long conversation is not one task's.

A first ROLLUP gives members and smallest members. From it follow, without looking at texts again,
children, leaves and the tokens that sharing a prefix saves: each node's own value belongs to
its smallest member, at that depth, so sums over a subtree are sums over the members of
what belongs to them further on, which a second ROLLUP of the same rows gives.

Ids of conversations that end at a node are written in ascending order by ranges, strung together by
range, and hashed string after string, so that a node where most end needs no memory for them.

Rows without conv_id are left out; null role or text is empty. Turns are ordered by turn (null
first), then role, then text; rows that are equal in all are turns of their own. Extra columns are
ignored. No conversations: no nodes. Two texts are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, shuffle_partitions, written

WIDTH, HEADS, EVERY = 4, 6, 100
STEP = 1024
#: Characters of ids in one string.
STRUNG = 1 << 16


def _path_hash(turn: Column, place: Column) -> list[Column]:
    """Two 64-bit hashes of a turn at its place."""
    return [F.xxhash64(F.lit(seed), place.cast("long"), turn) for seed in (1, 2)]


def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, digest, size): turns of every conversation, numbered from 0; digest of role and text, code points of the text.

    The order is cut into ranges, so that a conversation of any length is numbered by many tasks."""
    parts = shuffle_partitions(turns.sparkSession)
    full = lambda name: F.coalesce(column(name).cast("string"), F.lit(""))
    rows = turns.where(column(conv).isNotNull()).select(column(conv).cast("long").alias("c"), column(turn).alias("turn"), full(role).alias("role"), full(text).alias("text"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    rows = rows.select("*", digest.alias("digest"), F.length("text").cast("long").alias("size"))
    order = [F.col("c").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "turns")
    within = dealt.withColumn("k", F.row_number().over(Window.partitionBy("c", "part").orderBy(*order[1:])))
    ahead = dealt.groupBy("c", "part").count().withColumn(
        "before", F.coalesce(F.sum("count").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    placed = within.join(ahead.select("c", "part", "before").hint("merge"), ["c", "part"])
    return written(placed.select("c", (F.col("k") + F.col("before") - 1).cast("long").alias("pos"), "digest", "size"), "numbered")


def rebuilt_turns(numbered: DataFrame, heads: int = HEADS, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): the first h turns of conversation c - c % every, then c's own from its h-th on;
    h is crc32 of c's decimal form modulo `heads`. conversations: c and n, its rebuilt turns (0 too)."""
    convs = numbered.groupBy("c").agg(F.count("*").alias("own"))
    convs = convs.select("c", "own", (F.col("c") - F.col("c") % every).alias("base"), (F.crc32(F.col("c").cast("string").cast("binary")) % heads).cast("long").alias("h"))
    first = numbered.where((F.col("c") % every == 0) & (F.col("pos") < heads - 1))
    first = first.groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("head"))  # heads - 1 turns at most
    convs = convs.join(first.hint("shuffle_hash"), "base", "left")
    convs = convs.withColumn("head", F.expr("coalesce(slice(head, 1, cast(h as int)), array())"))
    convs = written(convs.select("c", "h", "head", F.size("head").cast("long").alias("m"), (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("n")), "rebuilt")
    own = numbered.join(convs.select("c", "h", "m").hint("merge"), "c").where("pos >= h").select("c", (F.col("m") + F.col("pos") - F.col("h")).alias("pos"), "digest", "size")
    head = convs.select("c", F.explode("head").alias("t")).select("c", "t.pos", "t.digest", "t.size")
    return own.unionByName(head), convs.select("c", "n")


def _running(rows: DataFrame, value: dict[str, Column], ahead: bool) -> DataFrame:
    """rows (c, block, ...) with, for each name, the aggregate over the blocks before (ahead: behind) each row's in its conversation."""
    order = F.col("block").asc() if ahead else F.col("block").desc()
    step = rows.withColumn("step", F.floor(F.col("block") / STEP))
    fine = Window.partitionBy("c", "step").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    coarse = Window.partitionBy("c").orderBy(F.col("step").asc() if ahead else F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = step.groupBy("c", "step").agg(*[v.alias(k) for k, v in value.items()])
    sums = sums.select("c", "step", *[F.coalesce(_again(k, v).over(coarse), F.lit(0)).alias(f"{k}_far") for k, v in value.items()])
    near = step.select("*", *[F.coalesce(v.over(fine), F.lit(0)).alias(f"{k}_near") for k, v in value.items()])
    joined = near.join(sums.hint("merge"), ["c", "step"])
    both = {k: (F.col(f"{k}_near").bitwiseXOR(F.col(f"{k}_far")) if ahead else F.col(f"{k}_near") + F.col(f"{k}_far")).alias(k) for k in value}
    return joined.select(*rows.columns, *both.values())


def _again(name: str, value: Column) -> Column:
    return F.bit_xor(name) if name.startswith("x") else F.sum(name)


def _xor(columns: list[Column]) -> Column:
    """Exclusive or of all columns that are not null."""
    out = F.lit(0).cast("long")
    for c in columns:
        out = out.bitwiseXOR(F.coalesce(c, F.lit(0)))
    return out


def _wide(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """(c, block, x1, x2: hash of the turns before the block, t1 ... , l1 ...): turns and sizes by column."""
    rows = turns.select("c", F.expr(f"pos div {width}").alias("block"), (F.col("pos") % width + 1).alias("j"), F.struct(*[h.alias(n) for h, n in zip(_path_hash(F.col("digest"), F.col("pos")), ("a", "b"), strict=True)]).alias("t"), "size")
    pick = lambda j, what, name: F.max(F.when(F.col("j") == j, F.col(what))).alias(f"{name}{j}")
    wide = rows.groupBy("c", "block").agg(*[pick(j, "t", "t") for j in range(1, width + 1)], *[pick(j, "size", "l") for j in range(1, width + 1)])
    # conversations without turns are members of the root
    bare = convs.where("n = 0").select("c", F.lit(0).cast("long").alias("block"))
    wide = wide.unionByName(bare, allowMissingColumns=True)
    over = lambda half: F.bit_xor(_xor([F.col(f"t{j}")[half] for j in range(1, width + 1)]))
    return written(_running(wide, {"x1": over("a"), "x2": over("b")}, ahead=True), "blocks")


def _rollup(wide: DataFrame, width: int, aggregates: list[str]) -> DataFrame:
    """All prefixes of all blocks: depth, k1, k2 (hash of the path), p1, p2 (of the parent's) and the aggregates; `kept` columns of a group are its own."""
    turns = ", ".join(f"t{j}" for j in range(1, width + 1))
    statement = f"SELECT block, x1, x2, {turns}, {width} - bit_count(grouping_id()) AS kept, {', '.join(aggregates)} FROM {{blocks}} GROUP BY block, x1, x2, ROLLUP({turns})"
    grouped = wide.sparkSession.sql(statement, blocks=wide)
    # a column that is kept but null: the conversation ended before it. The empty prefix of a later block is the node before it.
    own = F.expr("CASE kept " + " ".join(f"WHEN {j} THEN t{j} IS NOT NULL" for j in range(1, width + 1)) + " ELSE block = 0 END")
    path = lambda x, half, upto: F.col(x).bitwiseXOR(_xor([F.when(F.lit(j) <= upto, F.col(f"t{j}")[half]) for j in range(1, width + 1)]))
    kept = F.col("kept")
    return grouped.where(own).select(
        (F.col("block") * width + kept).cast("long").alias("depth"), "kept",
        path("x1", "a", kept).alias("k1"), path("x2", "b", kept).alias("k2"), path("x1", "a", kept - 1).alias("p1"), path("x2", "b", kept - 1).alias("p2"),
        *[a.rpartition(" AS ")[2] for a in aggregates],
    )


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: k1, k2, c in order. Ids of a key strung together, with the first of them."""
    key, first, held, size = None, None, [], 0

    def give() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key[0]]), pa.array([key[1]]), pa.array([first]), pa.array([",".join(held)])], ["k1", "k2", "first", "ids"])

    for batch in batches:
        for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and ((a, b) != key or size > STRUNG):
                yield give()
                held, size = [], 0
            if not held:
                key, first = (a, b), c
            held.append(str(c))
            size += len(held[-1]) + 1
    if held:
        yield give()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: k1, k2, first, ids in order. The hash of all ids of a key."""
    key, state, done = None, None, []

    def give() -> pa.RecordBatch:
        rows, done[:] = list(done), []
        return pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)] + [pa.array([r[2] for r in rows], pa.string())], ["k1", "k2", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (a, b) != key:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield give()
    if key:
        done.append((*key, state.hexdigest()))
    yield give()


def _ends(wide: DataFrame, width: int) -> DataFrame:
    """(k1, k2, ends_sha256): the conversations that end at each node."""
    parts = shuffle_partitions(wide.sparkSession)
    ends = wide.groupBy("c").agg(*[F.bit_xor(_xor([F.col(f"t{j}")[half] for j in range(1, width + 1)])).alias(k) for k, half in (("k1", "a"), ("k2", "b"))])
    strung = ends.select("k1", "k2", "c").repartitionByRange(parts, "k1", "k2", "c").sortWithinPartitions("k1", "k2", "c").mapInArrow(_strung, "k1 long, k2 long, first long, ids string")
    strung = written(strung, "ends")
    return strung.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, width: int = WIDTH, heads: int = HEADS, every: int = EVERY, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt_turns(numbered_turns(turns, conv, turn, role, text), heads, every)
    wide = _wide(rows, convs, width)
    size = "CASE bit_count(grouping_id()) " + " ".join(f"WHEN {width - j} THEN max(l{j})" for j in range(1, width + 1)) + " ELSE 0 END AS size"
    nodes = written(_rollup(wide, width, ["min(c) AS conv_id", "count(*) AS n_convs", size]), "nodes")
    key = ["k1", "k2", "depth"]
    parents = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(parents.hint("merge"), key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    # what belongs to the smallest member of each node: one leaf, and the tokens saved at each depth
    saved = nodes.where("n_convs > 1 AND depth > 0").select(F.col("conv_id").alias("c"), F.expr(f"(depth - 1) div {width}").alias("block"), ((F.col("depth") - 1) % width + 1).alias("j"), ((F.col("n_convs") - 1) * F.col("size")).alias("v"))
    saved = saved.groupBy("c", "block").agg(*[F.coalesce(F.max(F.when(F.col("j") == j, F.col("v"))), F.lit(0)).alias(f"v{j}") for j in range(1, width + 1)])
    leaves = nodes.where("n_children = 0").select(F.col("conv_id").alias("c"), F.lit(1).cast("long").alias("leaf"))
    filled = wide.join(saved.hint("merge"), ["c", "block"], "left").join(leaves.hint("merge"), "c", "left").na.fill(0, ["leaf", *[f"v{j}" for j in range(1, width + 1)]])
    filled = _running(filled, {"later": F.sum(sum((F.col(f"v{j}") for j in range(2, width + 1)), F.col("v1")))}, ahead=False)
    for j in range(width, 0, -1):  # from column j of the block to the conversation's end
        filled = filled.withColumn(f"s{j}", F.col(f"v{j}") + F.col(f"s{j + 1}" if j < width else "later"))
    tail = "CASE bit_count(grouping_id()) " + " ".join(f"WHEN {width - j} THEN sum(s{j})" for j in range(1, width + 1)) + " ELSE sum(s1) END AS saved_tokens"
    below = _rollup(filled, width, ["sum(leaf) AS n_leaves", tail]).select(*key, "n_leaves", "saved_tokens")

    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    # a node's parent may have most nodes as its children: the join splits such partitions
    out = nodes.join(above.hint("merge"), ["p1", "p2", "depth"], "left").join(below.hint("merge"), key).join(_ends(wide, width).hint("merge"), ["k1", "k2"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
