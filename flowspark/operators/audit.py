"""Statistical audit of features: rank correlation, information, drift, variance shares.

Distinct values are counted first; ranks, distribution functions and bins then follow from
prefix sums over values, never from a sort of all rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from ..sources.scratch import written
from ..spec import RHO_LABEL_LIMIT, RHO_LIMIT, VARIANCE_LIMIT
from .metrics import score_counts
from .profile import apart, average_rank, by_feature, group_quantiles, in_ranges, long_form, prefix_sum, quantiles, range_number


#: Ranks are looked up in a broadcast table where columns have at most so many distinct values together (64 MB).
RANK_VALUES = 4_000_000
#: Values that one row in so many has, or more, are ranked by a broadcast table as well: no task gets all rows of such a value.
HOT_SHARE = 10_000


def ranked(df: DataFrame, col: str, counts: DataFrame) -> DataFrame:
    """df with a column replaced by its average ranks about their mean. counts: (value, n) of its values.

    Frequent values are looked up; all others are joined by value, whole rows once a column. Rows that the join is not for
    (frequent values, NULL) have no key and go to tasks by their number."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    value, hot, at, cold, none = apart(df.columns, "value", "hot", "key", "cold", "none")
    ranks = written(prefix_sum(counts, "value", {"n": "before"}).select("value", "n", (F.col("before") + (F.col("n") + 1) / 2.0 - (total + 1) / 2.0).alias("rank"), F.lit(0).cast("long").alias("none")), "ranks")  # none is read back: a join on a literal would be a join on the value alone
    often = F.col("n") >= total / HOT_SHARE
    few = ranks.where(often).select(F.col("value").alias(value), F.col("rank").alias(hot))  # at most HOT_SHARE rows
    many = ranks.where(~often).select(F.col("value").alias(value), F.col("none").alias(none), F.col("rank").alias(cold))
    rows = df.withColumn(value, F.col(f"`{col}`")).join(F.broadcast(few), value, "left")
    rows = rows.withColumn(at, F.when(F.col(hot).isNull(), F.col(value))).withColumn(none, F.when(F.col(at).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.lit(0).cast("long")))
    got = rows.drop(value).withColumnRenamed(at, value).join(many.hint("merge"), [value, none], "left")
    return got.select(*[F.coalesce(hot, cold).alias(c) if c == col else F.col(f"`{c}`") for c in df.columns])


def _pair_sums(shared, width: int):
    """Of wide rows: n, sum x, sum x * x and sum x * y of the centred ranks of all pairs of columns, over rows that have both. A column without steps holds ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, total = shared.value, np.zeros((4, width, width))
        for b in batches:
            r, there = np.zeros((b.num_rows, width)), np.zeros((b.num_rows, width))
            for i, of in enumerate(steps):
                x = b.column(i)
                held = x.is_valid().to_numpy(zero_copy_only=False)
                v = x.to_numpy(zero_copy_only=False)[held].astype(float)
                if len(v):
                    r[held, i] = v if of is None else of[1][np.searchsorted(of[0], v)]
                    there[held, i] = 1
            total += there.T @ there, r.T @ there, (r * r).T @ there, r.T @ r
        yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["k", "v"])

    return run


def rank_correlations(df: DataFrame, cols: list[str], key: str | None = None) -> dict[tuple[str, str], float | None]:
    """Spearman's rho of all pairs of columns, None where one of them is constant.

    Ranks are step functions of the values. Where distinct values are counted and few enough, the steps go to all tasks and one pass over
    the rows adds up products of ranks: no row is joined, pivoted or shuffled. A column with too many of them has its ranks joined to
    the rows by value before that pass. key is not needed."""
    counts = written(long_form(df, cols).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n")), "counts")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    distinct = {r["feature"]: r["count"] for r in counts.groupBy("feature").count().collect()}  # a row a column
    few, left = [], RANK_VALUES
    for c in sorted(cols, key=lambda c: (distinct.get(c, 0), c)):
        if distinct.get(c, 0) <= left:
            few.append(c)
            left -= distinct.get(c, 0)
    held = counts.where(F.col("feature").isin(few)).toArrow()
    feature, value, n = np.asarray(held["feature"].to_pylist(), object), held["value"].to_numpy(), held["n"].to_numpy()
    steps = []
    for c in cols:
        if c not in few:
            steps.append(None)
            continue
        own = feature == c
        order = np.argsort(value[own], kind="stable")
        v, m = value[own][order], n[own][order].astype(float)
        rank = np.cumsum(m) - m + (m + 1) / 2
        steps.append((v, rank - (m.sum() + 1) / 2))  # about their mean, so that sums of products keep their digits
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    for c in cols:
        if c not in few:
            rows = ranked(rows, c, counts.where(F.col("feature") == c).select("value", "n"))
    sums = rows.mapInArrow(_pair_sums(df.sparkSession.sparkContext.broadcast(steps), len(cols)), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(4 * len(cols) ** 2)
    for r in sums:
        flat[r["k"]] = r["v"]
    count, one, two, both = flat.reshape(4, len(cols), len(cols))
    out: dict[tuple[str, str], float | None] = {}
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            m = max(count[i, j], 1.0)
            vx, vy = two[i, j] - one[i, j] ** 2 / m, two[j, i] - one[j, i] ** 2 / m
            cov = both[i, j] - one[i, j] * one[j, i] / m
            out[a, cols[j]] = float(cov / np.sqrt(vx * vy)) if count[i, j] and vx > 1e-9 and vy > 1e-9 else None
    return out


def spearman_pairs(df: DataFrame, cols: list[str], key: str | None = None, least: float = RHO_LIMIT) -> DataFrame:
    """(a, b, rho) of pairs of columns with |rho| >= least; constant columns have none."""
    got = [(a, b, rho) for (a, b), rho in rank_correlations(df, cols, key).items() if rho is not None and abs(rho) >= least]
    return df.sparkSession.createDataFrame(got, "a string, b string, rho double")


#: Labels with at most so many values are ranked in a broadcast table.
LABEL_VALUES = 100_000


def spearman_label(df: DataFrame, cols: list[str], key: str | None, label: str, least: float = RHO_LABEL_LIMIT) -> DataFrame:
    """(feature, rho) with |rho| >= least; constant features have none.

    Rows are counted by feature and value, together with the ranks of their labels: sums of products of ranks follow from that table,
    and no rank returns to the rows. A label of more than LABEL_VALUES values is ranked like any other column (rank_correlations)."""
    y, n, k, sy, syy, before, total = apart(["feature", "value", label], "y", "n", "k", "sy", "syy", "before", "total")
    labels = written(average_rank(df.select(F.col(f"`{label}`").cast("double").alias(label)), label), "labels")
    if labels.count() > LABEL_VALUES:
        every = rank_correlations(df, [*cols, label], key)
        got = [(c, every[c, label]) for c in cols if every[c, label] is not None and abs(every[c, label]) >= least]
        return df.sparkSession.createDataFrame(got, "feature string, rho double")
    own, held = apart([label, "n", "rank"], "of", "rows")
    middle = labels.agg((F.sum("n") + 1) / 2).first()[0]  # one number
    # about their mean, so that sums of products keep their digits; a row without a label counts for the ranks of its value only
    ranks = labels.select(F.col(label).alias(own), (F.col("rank") - F.lit(middle)).alias(y)).withColumn(held, F.lit(1))
    long = long_form(df.withColumn(label, F.col(f"`{label}`").cast("double")), cols, [label]).where("value IS NOT NULL")
    sums = long.join(F.broadcast(ranks), F.col(label) == F.col(own), "left").groupBy("feature", "value").agg(F.count("*").alias(n), F.count(held).alias(k), F.coalesce(F.sum(y), F.lit(0.0)).alias(sy), F.coalesce(F.sum(F.col(y) * F.col(y)), F.lit(0.0)).alias(syy))
    run = prefix_sum(written(sums, "sums"), "value", {n: before}, ["feature"], whole={n: total})
    x = F.col(before) + (F.col(n) + 1) / 2.0 - (F.col(total) + 1) / 2.0
    per = run.withColumn("x", x).groupBy("feature").agg(
        F.sum(k).alias("m"), F.sum(F.col(k) * F.col("x")).alias("a"), F.sum(F.col(k) * F.col("x") * F.col("x")).alias("aa"), F.sum(sy).alias("b"), F.sum(syy).alias("bb"), F.sum(F.col("x") * F.col(sy)).alias("ab")
    )
    vx, vy = F.col("aa") - F.col("a") * F.col("a") / F.col("m"), F.col("bb") - F.col("b") * F.col("b") / F.col("m")
    rho = (F.col("ab") - F.col("a") * F.col("b") / F.col("m")) / F.sqrt(vx * vy)
    return per.where((F.col("m") > 0) & (vx > 1e-9) & (vy > 1e-9)).select("feature", rho.alias("rho")).where(F.abs("rho") >= least)


def bin_edges(df: DataFrame, cols: list[str], bins: int) -> dict[str, list[float]]:
    """Edges of equal-count bins by linear interpolation, repeated edges once: bins + 1 numbers a column."""
    got = {r["feature"]: r["q"] for r in quantiles(df, cols, [i / bins for i in range(bins + 1)]).collect()}  # a row a column
    return {c: list(dict.fromkeys(got.get(c, []))) for c in cols}


def bin_index(c: Column, edges: list[float]) -> Column:
    """The right-closed bin of a value, the lowest value in bin 0."""
    inner = edges[1:-1]
    return F.when(c.isNotNull(), F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e < c)) if inner else F.lit(0))


def binned(df: DataFrame, cols: list[str], bins: int, keep: list[str]) -> DataFrame:
    edges = bin_edges(df, cols, bins)
    return df.select(*keep, *[bin_index(F.col(c).cast("double"), edges[c]).alias(c) for c in cols])


def pair_information(counts: DataFrame, keys: list[str], x: str, y: str, n: str = "n") -> DataFrame:
    """(keys, hx, hy, mi) in nats from (keys, x, y, n), one row per cell."""
    w = lambda *c: W.partitionBy(*keys, *c)  # noqa: E731  cells of a pair: bins x bins
    cells = counts.select(*keys, n, F.sum(n).over(w(x)).alias("_x"), F.sum(n).over(w(y)).alias("_y"), F.sum(n).over(w()).alias("_t"))
    p = F.col(n) / F.col("_t")
    mi = F.sum(p * F.ln(F.col(n) * F.col("_t") / (F.col("_x").cast("double") * F.col("_y"))))
    # every cell carries its share of the entropy of its row and column
    hx, hy = -F.sum(p * F.ln(F.col("_x") / F.col("_t"))), -F.sum(p * F.ln(F.col("_y") / F.col("_t")))
    return cells.groupBy(*keys).agg(hx.alias("hx"), hy.alias("hy"), mi.alias("mi"))


def label_information(df: DataFrame, cols: list[str], label: str, bins: int) -> DataFrame:
    """(feature, hx, hy, mi, nmi): binned features against the label; nmi by the mean of the entropies."""
    b = binned(df, cols, bins, [label]).unpivot([label], cols, "feature", "bin")
    counts = b.groupBy("feature", "bin", label).agg(F.count("*").alias("n"))
    got = pair_information(counts, ["feature"], "bin", label)
    return got.withColumn("nmi", F.coalesce(safe_div(F.col("mi"), (F.col("hx") + F.col("hy")) / 2), F.lit(0.0)))


def conditional_entropy(df: DataFrame, pairs: list[tuple[str, str]], bins: int) -> DataFrame:
    """(a, b, ha, hb, mi, ha_b, hb_a, keep): keep the member with the higher entropy. One pass over binned rows."""
    cols = sorted({c for p in pairs for c in p})
    b = binned(df, cols, bins, [])
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).alias("ba"), F.col(y).alias("bb")) for x, y in pairs])).alias("c")
    counts = b.select(cells).groupBy("c.a", "c.b", "c.ba", "c.bb").agg(F.count("*").alias("n"))
    i = pair_information(counts, ["a", "b"], "ba", "bb")
    return i.select("a", "b", F.col("hx").alias("ha"), F.col("hy").alias("hb"), "mi", (F.col("hx") - F.col("mi")).alias("ha_b"), (F.col("hy") - F.col("mi")).alias("hb_a"), F.when(F.col("hx") >= F.col("hy"), F.col("a")).otherwise(F.col("b")).alias("keep"))


def information_cost(df: DataFrame, target: str, others: list[str], bins: int) -> DataFrame:
    """(feature, share, unique_pct): how much of the target's entropy each other column holds; unique_pct is what no column holds."""
    i = conditional_entropy(df, [(target, c) for c in others], bins)
    share = i.select(F.col("b").alias("feature"), safe_div(F.col("mi"), F.col("ha")).alias("share"))
    return share.withColumn("unique_pct", 100 * (1 - F.max("share").over(W.partitionBy(F.lit(0)))))  # a row a column


def distribution_shift(df: DataFrame, cols: list[str], group: str) -> DataFrame:
    """(feature, ks, w1): largest and integrated difference of the distribution functions of group 0 and group 1."""
    long = long_form(df, cols, [group])
    counts = written(score_counts(long, "value", group, ["feature"]), "counts")  # read several times: cuts, totals and rows
    run = prefix_sum(counts, "value", {"pos": "a", "neg": "b"}, ["feature"], before=False)
    total = counts.groupBy("feature").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    got = run.join(F.broadcast(total), "feature")  # a row a feature
    gap = F.abs(F.col("a") / F.col("_p") - F.col("b") / F.col("_q"))
    # the next distinct value: within ranges of values, the first of the next range from a small table
    nxt = next_value(written(got.withColumn("gap", gap), "gaps"), "value", ["feature"], "next")
    return nxt.groupBy("feature").agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * F.coalesce(F.col("next") - F.col("value"), F.lit(0.0))).alias("w1"))


def next_value(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """df with the next greater value of the same keys; values must be distinct per key."""
    at, first, after, inside = apart([*df.columns, name], "range", "first", "after", "inside")
    cut = in_ranges(df, value, keys, range_number(df), at)
    firsts = cut.groupBy(*keys, at).agg(F.min(value).alias(first))
    firsts = firsts.select(*keys, at, F.lead(first).over(W.partitionBy(*keys).orderBy(at)).alias(after))
    inner = F.lead(value).over(W.partitionBy(*keys, at).orderBy(value))
    got = cut.withColumn(inside, inner).join(F.broadcast(firsts), [*keys, at])  # keys x ranges rows
    return got.select(*df.columns, F.coalesce(inside, after).alias(name))


def variance_decomposition(df: DataFrame, cols: list[str], limit: float = VARIANCE_LIMIT) -> DataFrame:
    """(feature, p_zero, ratio, split): the share of variance that presence alone explains."""
    some = lambda x: F.when(x != 0, x)
    s = by_feature(df, cols, {"p_zero": lambda x: F.avg((x == 0).cast("double")), "mu": lambda x: F.avg(some(x)), "v": F.var_samp})
    ratio = F.coalesce(safe_div(F.col("p_zero") * (1 - F.col("p_zero")) * F.col("mu") * F.col("mu"), F.col("v")), F.lit(0.0))
    return s.select("feature", "p_zero", ratio.alias("ratio"), (ratio > limit).alias("split"))


def pearson_safe(x: Column, y: Column, worst: float = 1.0) -> Column:
    """Aggregate: Pearson over rows where both are finite; `worst` below three of them or without spread."""
    ok = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) != float("inf")) & (F.abs(y) != float("inf"))
    a, b = F.when(ok, x), F.when(ok, y)
    return F.when((F.count(a) >= 3) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b)).otherwise(F.lit(float(worst)))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row w: Levene's statistic around medians."""
    med = group_quantiles(df, [group], value, [0.5])
    z = df.select(group, F.col(value).alias("v")).join(F.broadcast(med), group).select(group, F.abs(F.col("v") - F.col("q")[0]).alias("z"))  # a row a group
    per = z.groupBy(group).agg(F.count("*").alias("n"), F.avg("z").alias("m"), (F.var_pop("z") * F.count("*")).alias("ss"))
    t = per.agg(F.sum("n").alias("n_all"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    between = F.col("sq") - F.col("n_all") * F.col("grand") * F.col("grand")
    return t.select(safe_div((F.col("n_all") - F.col("k")) * between, (F.col("k") - 1) * F.col("within")).alias("w"))


def vector_moments(df: DataFrame, vec: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance with divisor n) of an array column; width x width sums, one aggregation."""
    pairs = df.select(F.posexplode(vec).alias("i", "x"), F.col(vec).alias("v")).groupBy("i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.array(*[F.sum(F.col("x") * F.element_at("v", j + 1)) for j in range(width)]).alias("p"))
    rows = sorted(pairs.collect())
    n = rows[0]["n"] if rows else 0
    mean = np.asarray([r["s"] for r in rows]) / max(n, 1)
    return n, mean, np.asarray([r["p"] for r in rows]) / max(n, 1) - np.outer(mean, mean)


def participation_ratio(cov: np.ndarray) -> tuple[float, dict[int, int]]:
    """(sum of eigenvalues)**2 / sum of squares, and how many components hold 90, 95 and 99 % of the variance."""
    e = np.sort(np.maximum(np.linalg.eigvalsh(cov), 0))[::-1]
    share = np.cumsum(e) / e.sum()
    return float(e.sum() ** 2 / (e**2).sum()), {p: int(np.searchsorted(share, p / 100) + 1) for p in (90, 95, 99)}
