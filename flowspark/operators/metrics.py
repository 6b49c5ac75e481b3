"""Thresholds, curves and rates of scores; everything follows from counts per distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mcc_balanced, mcc_from_counts, safe_div
from ..spec import PERCENTILE_GRID
from .profile import apart, average_rank, column_quantiles, confusion_counts, counts_of_values, prefix_sum, quantiles_of_counts


def above(score: Column, tau: Column | float, strict: bool = True) -> Column:
    """Strictly above the threshold, or at it too."""
    return score > tau if strict else score >= tau


def confusion_metrics(df: DataFrame, label: str, hit: Column, keys: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall, F1, FPR and MCC of decisions; NULL where undefined, MCC then 0."""
    c = df.groupBy(*(keys or [])).agg(*confusion_counts(F.col(label), hit))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(*(keys or []), "tp", "fp", "tn", "fn", safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"), safe_div(fp, fp + tn).alias("fpr"), mcc_from_counts(tp, fp, tn, fn).alias("mcc"))


def percentile_threshold(df: DataFrame, score: str, fpr: float, name: str = "tau") -> DataFrame:
    """One row: the score that this share of rows exceeds, by linear interpolation."""
    return column_quantiles(df, score, [1 - fpr]).select(F.col("q")[0].alias(name))


def interpolated_quantile(df: DataFrame, value: str, at: Column | float, name: str) -> DataFrame:
    """One row: the quantile of a column at a share: a number, or an expression over `total`, the number of values."""
    return quantiles_of_counts(counts_of_values(df, [value]), [at], []).select(F.col("q")[0].alias(name))


def score_counts(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, score, pos, neg): rows of either label per distinct score."""
    return df.where(F.col(score).isNotNull()).groupBy(*(keys or []), score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the Mann-Whitney form with average ranks; NULL with one class."""
    ranks = average_rank(df, score)
    per = score_counts(df, score, label).join(ranks.select(score, "rank").hint("shuffle_hash"), score)
    s = per.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select(safe_div(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * F.col("n")).alias("auc"))


def curves(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, tp, fp, precision, recall, fpr) for the rule score >= threshold at every distinct score."""
    down, p, q = apart([score, "pos", "neg", "tp", "fp", "precision", "recall", "fpr", "gain"], "down", "p", "q")
    per = score_counts(df, score, label).withColumn(down, -F.col(score))
    run = prefix_sum(per, down, {"pos": "tp", "neg": "fp"}, before=False)
    total = per.agg(F.sum("pos").alias(p), F.sum("neg").alias(q))
    got = run.crossJoin(F.broadcast(total))  # one row
    return got.select(score, "pos", "tp", "fp", safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe_div(F.col("tp"), F.col(p)).alias("recall"), safe_div(F.col("fp"), F.col(q)).alias("fpr"), safe_div(F.col("pos"), F.col(p)).alias("gain"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the sum of precision times gain in recall; NULL without positive or without negative rows."""
    c = curves(df, score, label)
    return c.agg(F.when(F.max("fp") > 0, F.sum(F.col("precision") * F.col("gain"))).alias("ap"))


def rates_at(df: DataFrame, label: str, hits: dict[str, Column]) -> DataFrame:
    """(name, fpr, recall) for several rules at once, in one pass."""
    b, a = F.col(label) == 0, F.col(label) == 1
    packed = [F.struct(F.lit(n).alias("name"), F.avg(F.when(b, h.cast("double"))).alias("fpr"), F.avg(F.when(a, h.cast("double"))).alias("recall")) for n, h in hits.items()]
    return df.agg(F.array(*packed).alias("_all")).select(F.explode("_all").alias("_x")).select("_x.*")


def grid_rates(df: DataFrame, score: str, label: str, taus: DataFrame, tau: str = "tau", strict: bool = False) -> DataFrame:
    """taus with fpr, recall, n_benign, n_attacks of each threshold.

    Counts per (place among the thresholds) once, then running sums over the thresholds: the rows
    are read once, whatever the number of thresholds. taus come to the driver: a grid.
    """
    grid = sorted({r[0] for r in taus.select(tau).distinct().collect()})
    passed = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: above(F.col(score), t, strict)))  # thresholds that the score clears
    per = df.groupBy(passed.alias("_k")).agg(F.count_if(F.col(label) == 0).alias("_b"), F.count_if(F.col(label) == 1).alias("_a")).collect()
    b, a = sum(r["_b"] for r in per), sum(r["_a"] for r in per)
    rows = [(t, sum(r["_b"] for r in per if r["_k"] > i) / b if b else None, sum(r["_a"] for r in per if r["_k"] > i) / a if a else None, b, a) for i, t in enumerate(grid)]
    made = df.sparkSession.createDataFrame(rows, f"{tau} double, fpr double, recall double, n_benign long, n_attacks long")
    return taus.join(F.broadcast(made), tau)


def percentile_grid(df: DataFrame, score: str, grid: list[float], name: str = "p") -> DataFrame:
    """(p, tau): percentiles of a score."""
    got = column_quantiles(df, score, [p / 100 for p in grid])
    return got.select(F.explode(F.arrays_zip(F.array(*map(F.lit, grid)).alias("p"), F.col("q").alias("tau"))).alias("z")).select(F.col("z.p").alias(name), F.col("z.tau").alias("tau"))


def best_mcc_percentile(df: DataFrame, score: str, label: str, grid: list[float] = PERCENTILE_GRID) -> DataFrame:
    """One row: the benign percentile with the highest balanced MCC, the first of equals."""
    taus = percentile_grid(df.where(F.col(label) == 0), score, grid)
    got = grid_rates(df, score, label, taus).withColumn("mcc_bal", mcc_balanced(F.col("fpr"), F.col("recall")))
    best = got.agg(F.max(F.struct("mcc_bal", (-F.col("p")).alias("back"), "tau", "fpr", "recall")).alias("b"))
    return best.select((-F.col("b.back")).alias("p"), "b.tau", "b.fpr", "b.recall", "b.mcc_bal")


def mcc_at_fpr(df: DataFrame, score: str, label: str, targets: list[float]) -> DataFrame:
    """(target, tau, fpr, recall, mcc) with the native numbers of rows."""
    taus = percentile_grid(df.where(F.col(label) == 0), score, [100 * (1 - t) for t in targets]).withColumn("target", F.round(1 - F.col("p") / 100, 9))
    got = grid_rates(df, score, label, taus)
    return got.select("target", "tau", "fpr", "recall", mcc_balanced(F.col("fpr"), F.col("recall"), F.col("n_benign").cast("double"), F.col("n_attacks").cast("double")).alias("mcc"))


def cohens_d(df: DataFrame, value: str, group: str, base: str) -> DataFrame:
    """(group, d): the standardised difference of each group's mean to the base group's; NULL below two rows or without spread."""
    s = df.groupBy(group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    b = s.where(F.col(group) == base).select(F.col("m").alias("bm"), F.col("v").alias("bv"), F.col("n").alias("bn"))  # one row
    g = s.where(F.col(group) != base).crossJoin(F.broadcast(b))
    pooled = F.sqrt(((F.col("n") - 1) * F.col("v") + (F.col("bn") - 1) * F.col("bv")) / (F.col("n") + F.col("bn") - 2))
    return g.select(group, F.when((F.col("n") > 1) & (F.col("bn") > 1), safe_div(F.col("m") - F.col("bm"), pooled)).alias("d"))


