"""Profiles, dispersion and distribution statistics of columns; counts over groups.

Each operator is one aggregation, then at most a projection or a window over its small result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


def apart(taken: list[str], *names: str) -> list[str]:
    """Names for helper columns: these, with underscores before those that are taken."""
    own = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in own:
            n = "_" + n
        own.add(n.lower())
        out.append(n)
    return out


def long_form(df: DataFrame, cols: list[str], keep: list[str] | None = None, value: str = "value") -> DataFrame:
    """(keep..., feature, value): one row per row and column, as doubles."""
    keep = keep or []
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keep, cols, "feature", value)


def by_feature(df: DataFrame, cols: list[str], measures: dict[str, object], keep: list[str] | None = None) -> DataFrame:
    """One row per column with the measures of it: a single aggregation over all columns.

    measures: name -> function from a column to an aggregate. keep: grouping columns.
    """
    keep = keep or []
    packed = [F.struct(F.lit(c).alias("feature"), *[m(F.col(c).cast("double")).alias(n) for n, m in measures.items()]) for c in cols]
    return df.groupBy(*keep).agg(F.array(*packed).alias("_all")).select(*keep, F.explode("_all").alias("_one")).select(*keep, "_one.*")


def profile_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts of zeros and others, and the range of the others."""
    other = lambda x: F.when(x != 0, x)
    return by_feature(df, cols, {"n_zero": lambda x: F.count_if(x == 0), "n_nonzero": lambda x: F.count(other(x)), "min_nonzero": lambda x: F.min(other(x)), "max_nonzero": lambda x: F.max(other(x))})


def skewness_adjusted(x: Column) -> Column:
    """The Fisher-Pearson adjusted skewness; NULL below three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


STATS = {
    "n_null": lambda x: F.count_if(x.isNull()), "n_inf": lambda x: F.count_if(F.abs(x) == float("inf")), "n_zero": lambda x: F.count_if(x == 0),
    "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp, "skew": F.skewness, "kurtosis": F.kurtosis,
}


def feature_stats(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Exact statistics of columns, or by the values of one column only mean, std and median.

    Moments are one aggregation. Distinct values and medians come from one table of counts per value.
    """
    keys = [by] if by else []
    plain = by_feature(df, cols, {k: STATS[k] for k in (("mean", "std") if by else STATS)}, keys)
    counts = counts_of_values(df, cols, keys)
    middle = quantiles_of_counts(counts, [0.5], [*keys, "feature"]).select(*keys, "feature", F.col("q")[0].alias("median"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in (*keys, "feature")]
    got = plain.alias("p").join(middle.alias("m").hint("shuffle_hash"), same("p", "m"), "left").select("p.*", "m.median")
    if by:
        return got
    distinct = counts.groupBy("feature").agg(F.count("*").alias("n_uniq"))
    return got.join(distinct.hint("shuffle_hash"), "feature", "left").withColumn("n_uniq", F.coalesce("n_uniq", F.lit(0)))


def dedup_rows(df: DataFrame, cols: list[str], order: str) -> DataFrame:
    """One row of each group of equal rows (NULLs equal): that with the least `order`.

    An aggregation with a partial step, so that a huge group of copies stays cheap.
    """
    others = [c for c in df.columns if c not in cols]
    (one,) = apart(df.columns, "first")
    first = F.min(F.struct(order, *[c for c in others if c != order])).alias(one)
    return df.groupBy(*cols).agg(first).select(*[F.col(c) if c in cols else F.col(one)[c].alias(c) for c in df.columns])


def group_label_stats(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, n, n_malicious, kind) of each group of equal features."""
    n, bad = F.count("*"), F.sum(F.col(label).cast("long"))
    kind = F.when(bad == 0, "PURE_BENIGN").when(bad == n, "PURE_MALICIOUS").otherwise("MIXED")
    return df.groupBy(*keys).agg(n.alias("n"), bad.alias("n_malicious"), kind.alias("kind"))


def majority_class(df: DataFrame, keys: list[str], col: str = "attack") -> DataFrame:
    """The most frequent value per group; ties go to the smaller one."""
    (n,) = apart([*keys, col], "n")
    per = df.groupBy(*keys, col).agg(F.count("*").alias(n))
    return per.groupBy(*keys).agg(F.min(F.struct((-F.col(n)).alias("m"), F.col(col).alias("v")))["v"].alias("majority"))


def duplicate_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: rows, distinct rows, rows in groups of two or more, such groups."""
    sizes = df.groupBy(*cols).agg(F.count("*").alias("n"))
    many = F.col("n") >= 2
    return sizes.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("n_duplicate_rows"), F.count_if(many).alias("n_groups"))


def fit_scaler(df: DataFrame, cols: list[str], nonzero_only: tuple[str, ...] = ()) -> DataFrame:
    """(feature, mean, std, non_zero_only), std with divisor n; over non-zero values only for some."""
    every = by_feature(df, [c for c in cols if c not in nonzero_only], {"mean": F.avg, "std": F.stddev_pop}).withColumn("non_zero_only", F.lit(False))
    if not nonzero_only:
        return every
    other = lambda x: F.when(x != 0, x)
    some = by_feature(df, list(nonzero_only), {"mean": lambda x: F.avg(other(x)), "std": lambda x: F.stddev_pop(other(x))}).withColumn("non_zero_only", F.lit(True))
    return every.unionByName(some)


def checked_scaler(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """The scaler as a mapping; refuses a std of 0 and a feature without values. One row a feature."""
    rows = scaler.collect()
    bad = [r["feature"] for r in rows if not r["std"]]
    if bad:
        raise ValueError(f"no spread in {bad}")
    return {r["feature"]: (r["mean"], r["std"]) for r in rows}


def truncation_counts(df: DataFrame, cols: list[str], low: float, high: float, split: str) -> DataFrame:
    """Cells outside [low, high] for each split, and per thousand."""
    out = [F.count_if(~F.col(c).between(low, high)) for c in cols]
    total = out[0]
    for x in out[1:]:
        total = total + x
    return df.groupBy(split).agg(total.alias("n_outside"), (total * 1000.0 / (F.count("*") * len(cols))).alias("permille"))


def split_summary(df: DataFrame, split: str, cls: str, splits: list[str]) -> DataFrame:
    """Rows of each class in each split (0 where none)."""
    return df.groupBy(cls).pivot(split, splits).count().na.fill(0, splits)


def confusion_counts(label: Column, hit: Column) -> list[Column]:
    """Aggregates tp, fp, tn, fn; a missing decision counts as no alarm."""
    hit = F.coalesce(hit, F.lit(False))
    return [F.count_if((label == 1) & hit).alias("tp"), F.count_if((label == 0) & hit).alias("fp"), F.count_if((label == 0) & ~hit).alias("tn"), F.count_if((label == 1) & ~hit).alias("fn")]


def loss_entropy(v: Column) -> Column:
    """Entropy (nats) of values as shares of their sum, in one pass; 0 where the sum is not positive."""
    s = F.sum(v)
    return F.when(s > 0, F.ln(s) - F.sum(F.when(v > 0, v * F.ln(v)).otherwise(0.0)) / s).otherwise(0.0)


def average_rank(df: DataFrame, value: str, keys: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """(keys, value, n, rank): the average rank of each distinct value.

    Distinct values first. Their prefix sums go over ranges of values: each range sums within
    itself (a window per range), and the totals of the ranges before it are added, so that
    no task sorts all values.
    """
    keys = keys or []
    n, before = apart([*keys, value], "n", "before")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias(n))
    out = prefix_sum(counts, value, {n: before}, keys)
    return out.select(*keys, value, F.col(n).alias("n"), (F.col(before) + (F.col(n) + 1) / 2.0).alias(rank))


def range_number(df: DataFrame) -> int:
    """How many ranges of an order to sum apart: as many as shuffle partitions, 64 at least and 1,024 at most."""
    return max(64, min(1024, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def beside(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of a small table by keys, NULL keys equal."""
    own = apart([*df.columns, *small.columns], *[f"of_{k}" for k in keys])
    same = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`{o}`"))
    return df.join(F.broadcast(small.withColumnsRenamed(dict(zip(keys, own, strict=True)))), same).drop(*own)


def in_ranges(df: DataFrame, order: str, keys: list[str], ranges: int, name: str) -> DataFrame:
    """df with the range (0 to ranges - 1) that the order column falls into, per key.

    Cuts are approximate quantiles: they only balance the tasks. They are broadcast, a row per key
    (feature names and the like). A row looks its range up among every step-th cut, then among the step after it.
    """
    step = max(1, round(ranges**0.5))
    coarse, fine = apart(df.columns, "coarse", "fine")
    cuts = df.groupBy(*keys).agg(F.percentile_approx(F.col(order).cast("double"), F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10 * ranges)).alias(fine))
    cuts = cuts.withColumn(coarse, F.filter(fine, lambda q, i: i % step == step - 1))
    cut = beside(df, cuts, keys) if keys else df.crossJoin(F.broadcast(cuts))
    below = lambda c: F.size(F.filter(c, lambda q: q < F.col(order)))
    near = step * below(F.col(coarse))
    return cut.withColumn(name, near + below(F.slice(fine, near + 1, F.lit(step)))).drop(coarse, fine)


def prefix_sum(df: DataFrame, order: str, sums: dict[str, str], keys: list[str] | None = None, ranges: int | None = None, before: bool = True, whole: dict[str, str] | None = None) -> DataFrame:
    """df with running sums in the order of a numeric column, exclusive of the row itself.

    Rows are cut into ranges of the order column; sums of whole ranges are carried over through a
    table of keys x ranges rows. whole: column -> name of its sum over all rows of the key. The
    order column must be unique per key for a defined result.
    """
    keys, whole = keys or [], whole or {}
    taken = [*df.columns, *sums.values(), *whole.values()]
    at, *names = apart(taken, "range", *[f"t{i}" for i in range(len(sums))], *[f"o{i}" for i in range(len(sums))], *[f"w{i}" for i in range(len(whole))])
    t, o, w = names[: len(sums)], names[len(sums) : 2 * len(sums)], names[2 * len(sums) :]
    part = [F.col(k) for k in keys] or [F.lit(0)]
    cut = in_ranges(df, order, keys, ranges or range_number(df), at)
    inner = W.partitionBy(*part, at).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, at).agg(*[F.sum(c).alias(n) for c, n in zip(sums, t)], *[F.sum(c).alias(n) for c, n in zip(whole, w)])
    outer = W.partitionBy(*part).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, at, *[F.coalesce(F.sum(x).over(outer), F.lit(0)).alias(y) for x, y in zip(t, o)], *[F.sum(x).over(W.partitionBy(*part)).alias(x) for x in w])
    got = beside(cut, totals, [*keys, at])
    made = [(F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(x) + (F.lit(0) if before else F.col(c))).alias(new) for (c, new), x in zip(sums.items(), o)]
    return got.select(*df.columns, *made, *[F.col(x).alias(new) for x, new in zip(w, whole.values())])


def counts_of_values(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, value, n): rows of each distinct value of each column, NULL and NaN apart."""
    if clash := {"feature", "value", "n", "before", "total"} & set(keys or []):
        raise ValueError(f"rename the keys {sorted(clash)}")
    long = long_form(df, cols, keys)
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*(keys or []), "feature", "value").agg(F.count("*").alias("n"))


#: Quantiles are looked up at once where a table of counts has at most so many rows (it is counted); same results either way.
FEW_VALUES = 1_000_000


def _few_quantiles(counts: DataFrame, shares: list[float], keys: list[str], value: str, n: str, name: str) -> DataFrame:
    """quantiles_of_counts of a counted, small table."""
    held = counts.select(*keys, F.col(value).cast("double").alias(value), F.col(n).cast("long").alias(n)).toArrow()
    v, m = held[value].to_numpy(), held[n].to_numpy()
    rows = list(zip(*(held[k].to_pylist() for k in keys), strict=True)) if keys else [()] * len(v)
    groups: dict[tuple, list[int]] = {} if keys else {(): []}
    for i, k in enumerate(rows):
        groups.setdefault(k, []).append(i)
    out = []
    for k, at in groups.items():
        order = np.asarray(at, int)[np.argsort(v[at], kind="stable")]
        x, ends = v[order], np.cumsum(m[order])
        q: list[float | None] = []
        for s in shares:
            if not len(x):
                q.append(None)
                continue
            place = (int(ends[-1]) - 1) * min(1.0, max(0.0, float(s)))
            low, high = math.floor(place), math.ceil(place)
            a, b = (float(x[np.searchsorted(ends, p, side="right")]) for p in (low, high))
            q.append(a if a == b else a * (1 - (place - low)) + b * (place - low))
        out.append((*k, q))
    kinds = dict(counts.dtypes)
    return counts.sparkSession.createDataFrame(out, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"`{name}` array<double>"]))


def quantiles_of_counts(counts: DataFrame, shares: list[float | Column], keys: list[str], value: str = "value", n: str = "n", name: str = "q") -> DataFrame:
    """(keys, q): quantiles with linear interpolation, one array per key, from distinct values and their counts.

    The places come from prefix sums: no task and no aggregate holds all distinct values, but where these are written,
    counted and few. Without keys there is one row, of NULLs where there are no values. A share may be an expression over
    the total, column `total`.
    """
    if not any(isinstance(s, Column) for s in shares) and dict(counts.dtypes)[value] in ("double", "float", "int", "bigint", "smallint", "tinyint"):
        counts = written(counts.select(*keys, value, n), "counts")
        if counts.count() <= FEW_VALUES:
            return _few_quantiles(counts, shares, keys, value, n, name)
    run = prefix_sum(counts, value, {n: "before"}, keys, whole={n: "total"})
    clamp = lambda s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), s if isinstance(s, Column) else F.lit(float(s))))
    out = []
    for s in shares:
        place = (F.col("total") - 1) * clamp(s)
        low, high = F.floor(place), F.ceil(place)
        holds = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col(n))
        a, b = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(high), F.col(value)))
        part = F.max(place - low)
        out.append(F.when(a == b, a).otherwise(a * (1 - part) + b * part))
    return run.groupBy(*keys).agg(F.array(*out).alias(name))


def quantiles(df: DataFrame, cols: list[str], shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, q) for several columns at once; columns without values have no row."""
    return quantiles_of_counts(counts_of_values(df, cols, keys), shares, [*(keys or []), "feature"])


def column_quantiles(df: DataFrame, col: str, shares: list[float]) -> DataFrame:
    """One row q: the quantiles of one column."""
    return quantiles_of_counts(counts_of_values(df, [col]), shares, [])


def group_quantiles(df: DataFrame, keys: list[str], value: Column | str, shares: list[float]) -> DataFrame:
    """(keys, q): the quantiles of a column or expression per group."""
    (v,) = apart(keys, "value")
    value = F.col(value) if isinstance(value, str) else value
    counts = df.select(*keys, value.cast("double").alias(v)).where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count("*").alias("n"))
    return quantiles_of_counts(counts, shares, keys, v)
