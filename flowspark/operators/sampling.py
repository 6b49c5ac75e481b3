"""Splits, samples and injections that follow hashes of row ids instead of a random order.

They are deterministic, independent of partitioning, and need no global sort: where places in
an order are needed, they come from prefix sums over ranges of the hash.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash32
from ..spec import POOL_ROWS
from .joins import row_key
from .profile import apart, prefix_sum


def places(df: DataFrame, key: str, salt: str, keys: list[str] | None = None, place: str = "place") -> DataFrame:
    """df with a 1-based place in the order of (hash of key, key), overall or within each group of keys.

    The key must be unique. Ranges of the hash are numbered within, and shifted by a prefix sum of
    their sizes.
    """
    keys = keys or []
    hashed, n, before = apart([*df.columns, place], "hash", "n", "before")
    h = df.withColumn(hashed, hash32(F.col(key), salt))
    per = prefix_sum(h.groupBy(*keys, hashed).agg(F.count("*").alias(n)), hashed, {n: before}, keys).drop(n)
    inside = F.row_number().over(W.partitionBy(*keys, hashed).orderBy(key))
    return h.join(per.hint("shuffle_hash"), [*keys, hashed]).select(*df.columns, (F.col(before) + inside).cast("long").alias(place))


def cumulative_cut(groups: DataFrame, key: str, size: str, salt: str, cuts: list[tuple[str, float]], rest: str) -> DataFrame:
    """Groups in hash order assigned by the running size before each: below the first share of the
    total to the first name, and so on. key must be unique; sizes are rows."""
    order, part, before, total = apart([*groups.columns, "split"], "order", "part", "before", "total")
    # groups with equal hashes follow each other by key
    flat = groups.withColumn(order, hash32(F.col(key), salt))
    per = prefix_sum(flat.groupBy(order).agg(F.sum(size).alias(part)), order, {part: before}, whole={part: total}).drop(part)
    inner = F.coalesce(F.sum(size).over(W.partitionBy(order).orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    got = flat.join(per.hint("shuffle_hash"), order)
    out = F.lit(rest)
    for name, share in reversed(cuts):
        out = F.when(F.col(before) + inner < share * F.col(total), name).otherwise(out)
    return got.select(*groups.columns, out.alias("split"))


def stratified_half(df: DataFrame, key: str, cls: str, salt: str, names: tuple[str, str] = ("val", "test")) -> DataFrame:
    """Of each class the first floor(n / 2) rows in hash order to the first name, the others to the second."""
    at, n = apart([*df.columns, "split"], "place", "n")
    per = df.groupBy(cls).agg(F.count("*").alias(n))  # one row a class
    got = places(df, key, salt, [cls], at).join(F.broadcast(per), cls)
    return got.select(*df.columns, F.when(F.col(at) <= F.floor(F.col(n) / 2), names[0]).otherwise(names[1]).alias("split"))


def stratified_sample(df: DataFrame, key: str, cls: str, salt: str, share: float) -> DataFrame:
    """Of each class max(1, round(n * share)) rows."""
    at, n = apart(df.columns, "place", "n")
    per = df.groupBy(cls).agg(F.count("*").alias(n))  # one row a class
    got = places(df, key, salt, [cls], at).join(F.broadcast(per), cls)
    return got.where(F.col(at) <= F.greatest(F.lit(1), F.round(F.col(n) * share))).select(df.columns)


def balanced_sample(df: DataFrame, key: str, label: str, salt: str, most: int) -> DataFrame:
    """At most most / 2 rows of each label."""
    (at,) = apart(df.columns, "place")
    return places(df, key, salt, [label], at).where(F.col(at) <= most // 2).select(df.columns)


def sample_cap(df: DataFrame, key: str, salt: str, most: int) -> DataFrame:
    """At most so many rows, those with the least hashes: a sampling operator, as a top-n over all rows."""
    return df.orderBy(hash32(F.col(key), salt), key).limit(most)


def hash_fraction(key: Column, salt: str, share: float) -> Column:
    """Whether the row belongs to this share: decided from its own hash, without any shuffle."""
    return hash32(key, salt) < int(share * 2**32)


def pool_sizes(n: int) -> tuple[int, int]:
    """Rows of the selection and monitor pools out of n; the rest must suffice to learn from."""
    (share, least, most), (share2, least2, most2) = POOL_ROWS["select"], POOL_ROWS["monitor"]
    select, monitor = min(max(int(share * n), least), most), min(max(int(share2 * n), least2), most2)
    if n - select - monitor < max(1000, n // 10):
        raise ValueError(f"{n} rows are too few for three pools")
    return select, monitor


def three_pools(df: DataFrame, key: str, salt: str, select: int, monitor: int) -> DataFrame:
    """pool: select for the first rows in hash order, then monitor, then gradient."""
    cuts = zip(("select", "monitor"), first_places(df, key, salt, [select, select + monitor]), strict=True)
    pool = F.lit("gradient")
    for name, within in reversed(list(cuts)):
        pool = F.when(within, name).otherwise(pool)
    return df.select(*df.columns, pool.alias("pool"))


def first_places(df: DataFrame, key: str, salt: str, most: list[int]) -> list[Column]:
    """For each number whether a row is among the first so many in the order of (hash of key, key): no row is moved.

    Rows are counted by the upper half of the hash, at most 65,536 counts. Those that share the upper half with the row at a place are put in
    order, and that row is what others are compared with. The key must be unique.
    """
    part, h = apart([key], "part", "hash")
    hashed = df.select(key, hash32(F.col(key), salt).alias(h)).withColumn(part, F.shiftright(h, 16))
    counts = sorted((r[0], r[1]) for r in hashed.where(F.col(part).isNotNull()).groupBy(part).agg(F.count("*")).collect())
    ends = list(accumulate(n for _, n in counts))
    wanted = {m: bisect_left(ends, m) for m in most if 0 < m <= (ends[-1] if ends else 0)}
    at = {m: (counts[i][0], m - ends[i] + counts[i][1]) for m, i in wanted.items()}
    found: dict[tuple[int, int], tuple] = {}
    if at:
        (place,) = apart([key, part, h], "place")
        inside = hashed.where(F.col(part).isin(*{p for p, _ in at.values()})).withColumn(place, F.row_number().over(W.partitionBy(part).orderBy(h, key)))
        rows = inside.where(F.concat_ws(" ", part, place).isin(*[f"{p} {k}" for p, k in at.values()])).select(part, place, h, key).collect()  # a row a number
        found = {(r[0], r[1]): (r[2], r[3]) for r in rows}
    own = hash32(F.col(key), salt)

    def within(m: int) -> Column:
        if m not in at:
            return F.lit(m > 0)
        last, k = found[at[m]]
        return (own < last) | ((own == last) & (F.col(key) <= F.lit(k)))

    return [within(m) for m in most]


def replicate(df: DataFrame, copies: int) -> DataFrame:
    """df and so many further copies of each row."""
    if copies <= 0:
        return df
    (k,) = apart(df.columns, "copy")
    extra = df.withColumn(k, F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop(k)
    return df.unionByName(extra)


def contaminate(benign: DataFrame, attacks: DataFrame, key: str, salt: str, rate: float) -> DataFrame:
    """benign and as many attacks, in hash order, as make the prevalence `rate` (all, if there are fewer)."""
    at, n = apart(attacks.columns, "place", "n")
    size = benign.agg(F.count("*").alias(n))  # one row
    most = F.round(F.col(n) * (rate / (1 - rate)))
    return benign.unionByName(places(attacks, key, salt, place=at).crossJoin(F.broadcast(size)).where(F.col(at) <= most).select(attacks.columns))


def inject_evenly(rows: DataFrame, attacks: DataFrame, key: str, salt: str, rate: float) -> DataFrame:
    """rows with round(rate * n) evenly spaced places (in hash order) taken by attacks, cyclically reused.

    columns: those of rows, and injected. One equi-join on the place.
    """
    n, m = rows.count(), attacks.count()
    k = round(n * rate) if m else 0
    at, nth, hit, donor, packed = apart([*rows.columns, *attacks.columns, "injected"], "place", "nth", "hit", "donor", "packed")
    placed = places(rows, key, salt, place=at)
    # place p holds the i-th injection if floor(i * n / k) = p - 1 for an i in [0, k)
    p = F.col(at) - 1
    i = F.floor((p * k + n - 1) / n) if k else F.lit(-1)
    slot = placed.withColumn(nth, i.cast("long")).withColumn(hit, (F.col(nth) < k) & (F.floor(F.col(nth) * n / max(k, 1)) == p) & (F.col(nth) >= 0))
    donors = places(attacks, key, salt + ":a", place=at).select((F.col(at) - 1).alias(donor), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(packed))
    keyed = slot.withColumn(donor, F.when(F.col(hit), F.col(nth) % max(m, 1)))
    got = keyed.join(donors.hint("shuffle_hash"), donor, "left")
    return got.select(*[F.when(F.col(hit), F.col(packed)[c]).otherwise(F.col(f"`{c}`")).alias(c) for c in rows.columns], F.col(hit).alias("injected"))


def partner_join(df: DataFrame, key: str, salt: str, cols: list[str]) -> DataFrame:
    """df with partner_<c> of another row: rows are numbered by hash, the partner is a hashed shift away.

    Needs two rows at least; nothing is its own partner.
    """
    n = df.count()
    if n < 2:
        raise ValueError("a partner needs two rows")
    at, to = apart([*df.columns, *[f"partner_{c}" for c in cols]], "place", "to")
    placed = places(df, key, salt, place=at)
    shift = 1 + hash32(F.col(key), salt + ":s") % (n - 1)
    other = placed.select(F.col(at).alias(to), *[F.col(c).alias(f"partner_{c}") for c in cols])
    return placed.withColumn(to, (F.col(at) - 1 + shift) % n + 1).join(other.hint("merge"), to).select(*df.columns, *[f"partner_{c}" for c in cols])


def column_permute(df: DataFrame, key: str, cols: list[str], salt: str) -> DataFrame:
    """(key, cols): each column permuted on its own. A join per column on places in two hash orders."""
    (at,) = apart(df.columns, "place")
    out = places(df.select(key), key, salt + ":to", place=at)
    for i, c in enumerate(cols):
        own = places(df.select(key, c), key, f"{salt}:{i}", place=at).select(at, F.col(c))
        out = out.join(own.hint("merge"), at)
    return out.select(key, *cols)


def leak_report(df: DataFrame, split: str, key: list[str]) -> DataFrame:
    """One row: how many keys occur in more than one split; 0 when nothing leaks."""
    (n,) = apart(key, "n")
    per = df.groupBy(*key).agg(F.count_distinct(split).alias(n))
    return per.agg(F.count_if(F.col(n) > 1).alias("n_shared"), F.count("*").alias("n_keys"))


def cluster_split(df: DataFrame, features: list[str], key: str, label: str, cls: str, salt: str) -> DataFrame:
    """(key, split): equal rows go together; purely benign groups 80/10/10 by rows, all others half to
    val and half to test, by majority class. Equal rows are those with the same 128-bit digest of all features."""
    keyed = df.select(F.col(key).alias("k"), F.col(label).cast("long").alias("bad"), F.col(cls).alias("cls"), row_key(features, df).alias("g"))
    per = keyed.groupBy("g", "cls").agg(F.count("*").alias("m"), F.sum("bad").alias("bad"), F.min("k").alias("gid"))
    majority = F.min(F.struct((-F.col("m")).alias("m"), F.col("cls").alias("v")))["v"]
    groups = per.groupBy("g").agg(F.sum("m").alias("n"), F.sum("bad").alias("bad"), F.min("gid").alias("gid"), majority.alias("majority"))
    benign = cumulative_cut(groups.where("bad = 0").select("g", "gid", "n"), "gid", "n", salt, [("train", 0.80), ("val", 0.90)], "test")
    others = stratified_half(groups.where("bad > 0").select("g", "gid", "majority"), "gid", "majority", salt)
    named = benign.select("g", "split").unionByName(others.select("g", "split"))
    return keyed.select("k", "g").join(named.hint("merge"), "g").select(F.col("k").alias(key), "split")
