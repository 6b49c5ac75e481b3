"""Shards of bounded size by extendible hashing.

The directory is indexed by the leading bits of a row's hash. It starts as one bucket; a
bucket above the byte limit splits on one more bit, and only such buckets do, so a shard is
the shortest prefix whose rows fit. The bytes of all prefixes come from sums over the rows
(a few bits deeper in each round, only for rows still in oversized buckets); the directory
is a table, joined to the rows on their prefix. Nothing is collected.

The hash covers the id and the text, so a hot id splits like any other. Rows that are equal
in both share all BITS bits; where such a group alone is above the limit, its bucket
overflows into pages of as many rows as fit. A single row above the limit is a shard of its
own. Null ids and null texts are hashed as such; a null text has no bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import union_all, written

LIMIT_BYTES, BITS, STEP = 1 << 20, 60, 10


def _bits(deep: int):
    return F.substring("bits", 1, deep)


def extendible_shards(docs: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, shard, depth, page, shard_bytes.

    shard: the prefix of the hash ('' where one bucket holds all), depth: its bits, page: 0 but
    for groups of equal rows above the limit, shard_bytes: of the whole shard (prefix and page).
    """
    text = F.col(text_col).cast("string")
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.md5(text.cast("binary")), F.lit("null"))))
    # 15 hex digits are BITS bits; conv gives them without leading zeros
    bits = F.lpad(F.conv(F.substring(digest, 1, BITS // 4), 16, 2), BITS, "0")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), bits.alias("bits"))
    # equal rows are counted before anything is joined: a group of any size is one row from here on
    groups = written(rows.groupBy("id", "n_bytes", "bits").agg(F.count("*").alias("n")), "rows")
    sizes = written(groups.groupBy("bits").agg(F.sum(F.col("n_bytes") * F.col("n")).alias("bytes"), F.sum("n").alias("n")), "hashes")

    leaves: list[DataFrame] = []
    open_rows, depth = sizes, 0
    while depth <= BITS:
        last = min(depth + STEP, BITS)
        levels = range(depth, last + 1)
        fine = open_rows.groupBy(_bits(last).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        sums = fine.select(F.explode(F.array(*[F.substring("prefix", 1, d) for d in levels])).alias("prefix"), "bytes").groupBy("prefix").agg(F.sum("bytes").alias("bytes"))
        # a prefix is a shard if it fits and its parent does not
        over = sums.where(F.col("bytes") > limit).select(F.col("prefix").alias("parent"))
        fits = sums.where((F.col("bytes") <= limit) | (F.length("prefix") == BITS))
        inner = fits.where(F.length("prefix") > depth).withColumn("parent", F.expr("substring(prefix, 1, length(prefix) - 1)"))
        found = inner.join(over.hint("shuffle_hash"), "parent", "left_semi").select("prefix", "bytes")
        if depth == 0:
            found = found.unionByName(fits.where(F.length("prefix") == 0).select("prefix", "bytes"))
        leaves.append(written(found, "directory"))
        if last == BITS:
            break
        still = over.where(F.length("parent") == last)
        open_rows = written(open_rows.join(still.hint("shuffle_hash"), _bits(last) == F.col("parent"), "left_semi"), "open")
        depth = last
        if open_rows.isEmpty():
            break
    directory = union_all([d.withColumn("depth", F.length("prefix")) for d in leaves])
    depths = sorted(r["depth"] for r in directory.select("depth").distinct().collect())  # at most BITS + 1
    # each hash looks its prefix up at the depths that occur; one of them is in the directory
    tried = sizes.select("bits", "bytes", "n", F.explode(F.array(*[F.substring("bits", 1, d) for d in depths])).alias("prefix")) if depths else sizes.withColumn("prefix", F.lit(""))
    named = tried.join(directory.select("prefix", "depth", F.col("bytes").alias("shard_bytes")).hint("shuffle_hash"), "prefix")
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes") / F.col("n"), F.lit(1)))).cast("long")
    named = named.withColumn("per_page", F.when((F.col("shard_bytes") > limit) & (F.col("n") > 1), per_page))
    plain = groups.join(named.where("per_page IS NULL").select("bits", "prefix", "depth", "shard_bytes").hint("merge"), "bits")
    plain = plain.select("id", "n_bytes", F.col("prefix").alias("shard"), "depth", F.lit(0).cast("long").alias("page"), "shard_bytes", "n")
    # equal rows are interchangeable: those of a group are dealt to pages by number
    paged = groups.join(named.where("per_page IS NOT NULL").select("bits", "prefix", "depth", "per_page").hint("merge"), "bits")
    paged = paged.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div per_page"))).alias("page"))
    held = F.least(F.col("per_page"), F.col("n") - F.col("page") * F.col("per_page"))
    paged = paged.select("id", "n_bytes", F.col("prefix").alias("shard"), "depth", "page", (held * F.col("n_bytes")).alias("shard_bytes"), held.alias("n"))
    # and every row of a group again, a thousand at a time
    thousands = plain.unionByName(paged).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 1000"))).alias("part"))
    copies = F.least(F.lit(1000), F.col("n") - F.col("part") * 1000).cast("int")
    out = thousands.select("id", "n_bytes", "shard", "depth", "page", "shard_bytes", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")
    return out.withColumnRenamed("id", id_col)
