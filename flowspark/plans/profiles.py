"""Queries of profiles, groups, seeds and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import profile as P
from ..operators.audit import next_value
from .flow_view import flows, table, with_flows
from .registry import query

R = lambda c, n=6: F.round(c, n)


def _union(template: str, cols: list[str]) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in cols)


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a01_dedup_rows", with_flows("SELECT min(flow_id) AS flow_id, PROTOCOL, L4_DST_PORT, L7_PROTO, MAX_TTL FROM flows GROUP BY PROTOCOL, L4_DST_PORT, L7_PROTO, MAX_TTL"))
def a01(spark: SparkSession, d: str) -> DataFrame:
    cols = ["PROTOCOL", "L4_DST_PORT", "L7_PROTO", "MAX_TTL"]
    return P.dedup_rows(flows(spark, d).select("flow_id", *cols), cols, "flow_id")


@query("a02_profile_columns", _union("SELECT '{c}' AS feature, count(*) FILTER ({c} = 0) AS n_zero, count(*) FILTER ({c} <> 0) AS n_nonzero, min({c}) FILTER ({c} <> 0) AS min_nonzero, max({c}) FILTER ({c} <> 0) AS max_nonzero FROM lineitem", _NUM))
def a02(spark: SparkSession, d: str) -> DataFrame:
    return P.profile_columns(table(spark, d, "lineitem"), _NUM)


@query("a03_feature_stats", _union("""SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_uniq, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (isinf({c})) AS n_inf, count(*) FILTER ({c} = 0) AS n_zero,
 min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(median({c}), 4) AS median,
 round(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * CAST(count({c}) - 1 AS DOUBLE)), 4) AS skew, round(kurtosis_pop({c}), 4) AS kurtosis FROM lineitem""", _NUM))  # fmt: skip
def a03(spark: SparkSession, d: str) -> DataFrame:
    got = P.feature_stats(table(spark, d, "lineitem"), _NUM)
    return got.select("feature", "n_uniq", "n_null", "n_inf", "n_zero", "min", "max", *[R(F.col(c), 4).alias(c) for c in ("mean", "std", "median", "skew", "kurtosis")])


@query("a03_feature_stats_by_label", with_flows(_union("SELECT label, '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(median({c}), 6) AS median FROM flows GROUP BY label", ["IN_BYTES", "OUT_BYTES"])))
def a03b(spark: SparkSession, d: str) -> DataFrame:
    got = P.feature_stats(flows(spark, d), ["IN_BYTES", "OUT_BYTES"], "label")
    return got.select("label", "feature", *[R(F.col(c)).alias(c) for c in ("mean", "std", "median")])


@query("a04_cluster_label_stats", with_flows("SELECT kind, count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(bad) AS BIGINT) AS n_malicious FROM (SELECT count(*) AS n, sum(label) AS bad, CASE WHEN sum(label) = 0 THEN 'PURE_BENIGN' WHEN sum(label) = count(*) THEN 'PURE_MALICIOUS' ELSE 'MIXED' END AS kind FROM flows GROUP BY PROTOCOL, L4_DST_PORT, L7_PROTO, MAX_TTL) GROUP BY kind"))
def a04(spark: SparkSession, d: str) -> DataFrame:
    per = P.group_label_stats(flows(spark, d), ["PROTOCOL", "L4_DST_PORT", "L7_PROTO", "MAX_TTL"])
    return per.groupBy("kind").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_rows"), F.sum("n_malicious").alias("n_malicious"))


@query("a05_majority_class", with_flows("SELECT PROTOCOL, L4_DST_PORT, attack AS majority FROM (SELECT *, row_number() OVER (PARTITION BY PROTOCOL, L4_DST_PORT ORDER BY n DESC, attack) AS r FROM (SELECT PROTOCOL, L4_DST_PORT, attack, count(*) AS n FROM flows GROUP BY ALL)) WHERE r = 1"))
def a05(spark: SparkSession, d: str) -> DataFrame:
    return P.majority_class(flows(spark, d), ["PROTOCOL", "L4_DST_PORT"])


@query("a06_duplicate_stats", with_flows("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS n_duplicate_rows, count(*) FILTER (n >= 2) AS n_groups FROM (SELECT count(*) AS n FROM flows GROUP BY PROTOCOL, L4_DST_PORT, L7_PROTO, CLIENT_TCP_FLAGS)"))
def a06(spark: SparkSession, d: str) -> DataFrame:
    return P.duplicate_stats(flows(spark, d), ["PROTOCOL", "L4_DST_PORT", "L7_PROTO", "CLIENT_TCP_FLAGS"])


@query("a07_dup_pct_by_filter", with_flows("SELECT round(100.0 * (1 - count(DISTINCT (PROTOCOL, L4_DST_PORT, L7_PROTO)) / CAST(count(*) AS DOUBLE)), 6) AS dup_pct FROM flows WHERE label = 0"))
def a07(spark: SparkSession, d: str) -> DataFrame:
    s = P.duplicate_stats(flows(spark, d).where("label = 0"), ["PROTOCOL", "L4_DST_PORT", "L7_PROTO"])
    return s.select(R(100.0 * (1 - F.col("n_unique") / F.col("n_rows"))).alias("dup_pct"))


@query("a08_skew_adjusted", _union("SELECT '{c}' AS feature, round(skewness({c}), 6) AS skew FROM lineitem", _NUM))
def a08(spark: SparkSession, d: str) -> DataFrame:
    return P.by_feature(table(spark, d, "lineitem"), _NUM, {"skew": P.skewness_adjusted}).select("feature", R(F.col("skew")).alias("skew"))


_SKEWED = ["value", "cubed"]


@query("a09_select_log_features", "SELECT feature, round(s, 6) AS skew FROM (SELECT 'value' AS feature, skewness(value) AS s FROM events UNION ALL SELECT 'cubed', skewness(value * value * value) FROM events) WHERE abs(s) > 1")
def a09(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("value", (F.col("value") * F.col("value") * F.col("value")).alias("cubed"))
    return P.by_feature(e, _SKEWED, {"skew": P.skewness_adjusted}).where(F.abs("skew") > 1).select("feature", R(F.col("skew")).alias("skew"))


@query("a10_fit_scaler", with_flows("SELECT 'IN_BYTES' AS feature, round(avg(IN_BYTES), 6) AS mean, round(stddev_pop(IN_BYTES), 6) AS std, false AS non_zero_only FROM flows WHERE label = 0 AND pool = 'train' UNION ALL SELECT 'MAX_TTL', round(avg(nullif(TCP_WIN_MAX_OUT, 0)), 6), round(stddev_pop(nullif(TCP_WIN_MAX_OUT, 0)), 6), true FROM flows WHERE label = 0 AND pool = 'train'".replace("'MAX_TTL'", "'TCP_WIN_MAX_OUT'")))
def a10(spark: SparkSession, d: str) -> DataFrame:
    s = P.fit_scaler(flows(spark, d).where("label = 0 AND pool = 'train'"), ["IN_BYTES", "TCP_WIN_MAX_OUT"], ("TCP_WIN_MAX_OUT",))
    return s.select("feature", R(F.col("mean")).alias("mean"), R(F.col("std")).alias("std"), "non_zero_only")


@query("a11_truncation_counts", with_flows("SELECT pool, count(*) FILTER (logit NOT BETWEEN -5 AND 3) + count(*) FILTER (IN_BYTES NOT BETWEEN -5 AND 3) AS n_outside, round((count(*) FILTER (logit NOT BETWEEN -5 AND 3) + count(*) FILTER (IN_BYTES NOT BETWEEN -5 AND 3)) * 1000.0 / (count(*) * 2), 6) AS permille FROM flows GROUP BY pool"))
def a11(spark: SparkSession, d: str) -> DataFrame:
    t = P.truncation_counts(flows(spark, d), ["logit", "IN_BYTES"], -5, 3, "pool")
    return t.select("pool", "n_outside", R(F.col("permille")).alias("permille"))


@query("a12_split_summary", with_flows("SELECT attack, count(*) FILTER (pool = 'train') AS train, count(*) FILTER (pool = 'select') AS \"select\", count(*) FILTER (pool = 'test') AS test FROM flows GROUP BY attack"))
def a12(spark: SparkSession, d: str) -> DataFrame:
    return P.split_summary(flows(spark, d), "pool", "attack", ["train", "select", "test"])


@query("a13_confusion_counts", with_flows("SELECT count(*) FILTER (label = 1 AND logit > 0) AS tp, count(*) FILTER (label = 0 AND logit > 0) AS fp, count(*) FILTER (label = 0 AND logit <= 0) AS tn, count(*) FILTER (label = 1 AND logit <= 0) AS fn FROM flows"))
def a13(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).agg(*P.confusion_counts(F.col("label"), F.col("logit") > 0))


@query("a14_per_class_dr", with_flows("SELECT attack, round(avg(CASE WHEN logit > 0 THEN 1.0 ELSE 0.0 END), 6) AS dr, count(*) AS support FROM flows WHERE attack <> 'Benign' GROUP BY attack"))
def a14(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("logit") > 0).cast("double")
    return flows(spark, d).where("attack <> 'Benign'").groupBy("attack").agg(R(F.avg(hit)).alias("dr"), F.count("*").alias("support"))


@query("a15_flow_volume", with_flows("SELECT count(*) AS n_flows, count(*) FILTER (logit > 0) AS n_alerts, CAST(sum(IN_BYTES + OUT_BYTES) AS BIGINT) AS bytes, round(sum(IN_BYTES + OUT_BYTES) * 8 / 1e9, 6) AS gbit, round(sum(IN_BYTES + OUT_BYTES) / CAST(count(*) AS DOUBLE), 6) AS mean_bytes FROM flows"))
def a15(spark: SparkSession, d: str) -> DataFrame:
    b = F.sum(F.col("IN_BYTES") + F.col("OUT_BYTES"))
    return flows(spark, d).agg(F.count("*").alias("n_flows"), F.count_if(F.col("logit") > 0).alias("n_alerts"), b.alias("bytes"), R(b * 8 / F.lit(1e9)).alias("gbit"), R(b.cast("double") / F.count("*")).alias("mean_bytes"))


# Trials and seeds: a supplier is a trial, the month of an order line is a seed, its price a metric.
_TRIALS = "trials AS (SELECT l_suppkey AS trial, CAST(month(l_shipdate) AS INTEGER) AS seed, avg(l_extendedprice) / 100000 AS metric FROM lineitem GROUP BY 1, 2)"


def trials(spark: SparkSession, d: str) -> DataFrame:
    """(trial, seed, metric) derived from lineitem."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("trial"), F.month("l_shipdate").alias("seed"))
    return t.agg((F.avg("l_extendedprice") / 100000).alias("metric"))


@query("a16_seed_aggregate", f"WITH {_TRIALS} SELECT trial, round(coalesce(avg(metric) FILTER (metric < 0.45) - 0.5 * stddev_pop(metric) FILTER (metric < 0.45), -1), 6) AS objective, count(*) FILTER (metric < 0.45) AS n FROM trials GROUP BY trial")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return seed_objective(trials(spark, d), F.when(F.col("metric") < 0.45, F.col("metric")), 0.5)


def seed_objective(df: DataFrame, valid, k: float) -> DataFrame:
    """mean - k * std over the valid seeds of each trial; -1 where there is none."""
    return df.groupBy("trial").agg(R(F.coalesce(F.avg(valid) - k * F.stddev_pop(valid), F.lit(-1.0))).alias("objective"), F.count(valid).alias("n"))


@query("a17_es_aggregate", f"WITH {_TRIALS} SELECT seed, round(median(metric), 6) AS median_delta, round(min(metric), 6) AS min_delta, round(median(trial), 6) AS median_stop, round(stddev_pop(trial), 6) AS std_stop, count(*) FILTER (metric > 0.4) AS n_censored FROM trials GROUP BY seed")
def a17(spark: SparkSession, d: str) -> DataFrame:
    m, t = F.col("metric"), F.col("trial")
    df = trials(spark, d)
    middle = P.quantiles(df, ["metric", "trial"], [0.5], ["seed"]).groupBy("seed").pivot("feature", ["metric", "trial"]).agg(F.max(F.col("q")[0]))
    middle = middle.select("seed", R(F.col("metric")).alias("median_delta"), R(F.col("trial")).alias("median_stop"))
    return middle.join(df.groupBy("seed").agg(R(F.min(m)).alias("min_delta"), R(F.stddev_pop(t)).alias("std_stop"), F.count_if(m > 0.4).alias("n_censored")).hint("shuffle_hash"), "seed")


@query("a18_loao_over_seeds", f"WITH {_TRIALS} SELECT seed, round(avg(metric), 6) AS mean, round(stddev_pop(metric), 6) AS std, round(median(metric), 6) AS median, round(avg(CASE WHEN metric >= 0.35 THEN 1.0 ELSE 0.0 END), 6) AS covered FROM trials GROUP BY seed")
def a18(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metric")
    df = trials(spark, d)
    middle = P.group_quantiles(df, ["seed"], "metric", [0.5]).select("seed", R(F.col("q")[0]).alias("median"))
    return middle.join(df.groupBy("seed").agg(R(F.avg(m)).alias("mean"), R(F.stddev_pop(m)).alias("std"), R(F.avg((m >= 0.35).cast("double"))).alias("covered")).hint("shuffle_hash"), "seed")


@query("a19_micro_macro_dr", with_flows(", c AS (SELECT attack, avg(CASE WHEN logit > 0 THEN 1.0 ELSE 0.0 END) AS dr, count(*) AS n FROM flows WHERE label = 1 GROUP BY attack) SELECT round(sum(dr * n) / sum(n), 6) AS micro, round(avg(dr), 6) AS macro FROM c"))
def a19(spark: SparkSession, d: str) -> DataFrame:
    c = flows(spark, d).where("label = 1").groupBy("attack").agg(F.avg((F.col("logit") > 0).cast("double")).alias("dr"), F.count("*").alias("n"))
    return c.agg(R(F.sum(F.col("dr") * F.col("n")) / F.sum("n")).alias("micro"), R(F.avg("dr")).alias("macro"))


@query("a20_merge_seed_metrics", f"WITH {_TRIALS} SELECT trial, round(avg(metric), 6) AS mean, round(stddev_pop(metric), 6) AS std, count(*) AS n FROM (SELECT * FROM trials WHERE seed <= 6 UNION ALL SELECT trial, seed + 12, metric FROM trials WHERE seed > 6) GROUP BY trial")
def a20(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d)
    both = t.where("seed <= 6").unionByName(t.where("seed > 6").withColumn("seed", F.col("seed") + 12))
    return both.groupBy("trial").agg(R(F.avg("metric")).alias("mean"), R(F.stddev_pop("metric")).alias("std"), F.count("*").alias("n"))


@query("a21_pooled_sigma", f"WITH {_TRIALS}, s AS (SELECT trial, stddev_pop(metric) AS sd, count(*) AS n FROM trials GROUP BY trial) SELECT round(sqrt(avg(sd * sd) * (avg(n) / (avg(n) - 1))), 6) AS sigma, CAST(sum(n - 1) AS BIGINT) AS dof FROM s")
def a21(spark: SparkSession, d: str) -> DataFrame:
    s = trials(spark, d).groupBy("trial").agg(F.stddev_pop("metric").alias("sd"), F.count("*").alias("n"))
    return s.agg(R(F.sqrt(F.avg(F.col("sd") * F.col("sd")) * (F.avg("n") / (F.avg("n") - 1)))).alias("sigma"), F.sum(F.col("n") - 1).alias("dof"))


@query("a22_bench_summary", """WITH q AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY ALL)
SELECT l.l_returnflag, l.l_linestatus, round(avg(l_quantity), 6) AS mean, round((max(l_quantity) - min(l_quantity)) / 2, 6) AS half_range, round(max(l_extendedprice) FILTER (l_extendedprice <= q3 + 1.5 * (q3 - q1)), 6) AS whisker
FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag AND l.l_linestatus = q.l_linestatus GROUP BY ALL""")  # fmt: skip
def a22(spark: SparkSession, d: str) -> DataFrame:
    df, keys = table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]
    q = P.group_quantiles(df, keys, "l_extendedprice", [0.25, 0.75])
    top = F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])
    got = df.join(F.broadcast(q), keys)  # one row per pair of flags
    x = F.col("l_extendedprice")
    return got.groupBy(*keys).agg(R(F.avg("l_quantity")).alias("mean"), R((F.max("l_quantity") - F.min("l_quantity")) / 2).alias("half_range"), R(F.max(F.when(x <= top, x))).alias("whisker"))


@query("a23_loss_entropy", "SELECT l_returnflag, round(CASE WHEN sum(l_quantity) > 0 THEN ln(sum(l_quantity)) - sum(CASE WHEN l_quantity > 0 THEN l_quantity * ln(l_quantity) ELSE 0 END) / sum(l_quantity) ELSE 0 END, 6) AS entropy FROM lineitem GROUP BY 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(R(P.loss_entropy(F.col("l_quantity"))).alias("entropy"))


@query("a24_distinct_classes", with_flows("SELECT attack, count(*) AS support FROM flows GROUP BY attack"))
def a24(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).groupBy("attack").agg(F.count("*").alias("support"))


@query("a25_stratified_coverage", with_flows("SELECT attack, count(*) AS n_full, count(*) FILTER (pool = 'test') AS n_sample, count(*) FILTER (pool = 'test') = 0 AS missing FROM flows GROUP BY attack"))
def a25(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d)
    full, some = df.groupBy("attack").agg(F.count("*").alias("n_full")), df.where("pool = 'test'").groupBy("attack").agg(F.count("*").alias("n_sample"))
    got = full.join(some.hint("shuffle_hash"), "attack", "full_outer").na.fill(0, ["n_full", "n_sample"])
    return got.select("attack", "n_full", "n_sample", (F.col("n_sample") == 0).alias("missing"))


# --- orderings of trial tables ------------------------------------------------------------
@query("k02_topk_by_abs", with_flows("SELECT flow_id, round(logit, 6) AS logit FROM flows WHERE abs(logit) > 6 ORDER BY abs(logit) DESC, flow_id LIMIT 50"))
def k02(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    return flows(spark, d).where(F.abs("logit") > 6).orderBy(F.desc(F.abs("logit")), "flow_id").limit(50).select("flow_id", R(F.col("logit")).alias("logit"))


@query("k04_best_trial", f"WITH {_TRIALS}, t AS (SELECT trial, count(*) AS n, avg(metric) AS m FROM trials GROUP BY trial) SELECT trial, round(m, 6) AS objective FROM t WHERE n = (SELECT max(n) FROM t) ORDER BY m DESC, trial LIMIT 1")
def k04(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d).groupBy("trial").agg(F.count("*").alias("n"), F.avg("metric").alias("m"))
    # the most complete first, then the best: one aggregate over all trials
    best = t.agg(F.max(F.struct("n", "m", (-F.col("trial")).alias("back"))).alias("b"))
    return best.select((-F.col("b.back")).alias("trial"), R(F.col("b.m")).alias("objective"))


@query("k05_precull", f"WITH {_TRIALS} SELECT trial, round(avg(metric), 6) AS m FROM trials GROUP BY trial HAVING count(*) >= 10 AND avg(metric) >= 0.38")
def k05(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d).groupBy("trial").agg(F.count("*").alias("n"), F.avg("metric").alias("m"))
    return t.where("n >= 10 AND m >= 0.38").orderBy(F.desc("m"), "trial").select("trial", R(F.col("m")).alias("m"))


@query("k06_min_fpr_seed", f"WITH {_TRIALS} SELECT seed, round(avg(metric), 6) AS a, round(max(metric), 6) AS b FROM trials GROUP BY seed ORDER BY avg(metric), max(metric), seed LIMIT 1")
def k06(spark: SparkSession, d: str) -> DataFrame:
    s = trials(spark, d).groupBy("seed").agg(F.avg("metric").alias("a"), F.max("metric").alias("b"))
    return s.agg(F.min(F.struct("a", "b", "seed")).alias("m")).select("m.seed", R(F.col("m.a")).alias("a"), R(F.col("m.b")).alias("b"))


@query("k07_ranked_intersection", f"WITH {_TRIALS}, t AS (SELECT trial, avg(metric) AS m, stddev_pop(metric) AS s FROM trials GROUP BY trial), a AS (SELECT trial FROM t ORDER BY m DESC, trial LIMIT 20), b AS (SELECT trial FROM t ORDER BY s, trial LIMIT 60) SELECT trial FROM a INTERSECT SELECT trial FROM b")
def k07(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d).groupBy("trial").agg(F.avg("metric").alias("m"), F.stddev_pop("metric").alias("s"))
    return t.orderBy(F.desc("m"), "trial").limit(20).select("trial").intersect(t.orderBy("s", "trial").limit(60).select("trial"))


@query("k08_dedupe_configs", "SELECT min(l_orderkey * 10 + l_linenumber) AS first_id, round(l_discount, 9) AS discount, round(l_tax, 9) AS tax FROM lineitem GROUP BY 2, 3")
def k08(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_id"), F.round("l_discount", 9).alias("discount"), F.round("l_tax", 9).alias("tax"))
    return P.dedup_rows(df, ["discount", "tax"], "first_id")


# --- windows over trial tables -----------------------------------------------------------
_T2 = f"{_TRIALS}, t AS (SELECT trial, avg(metric) AS m, stddev_pop(metric) AS s FROM trials GROUP BY trial)"


# ranks must not hang on the order in which doubles were added up: means and deviations that agree to eight decimals are ties
_T2_RANKED = _T2.replace("avg(metric) AS m, stddev_pop(metric) AS s", "round(avg(metric), 8) AS m, round(stddev_pop(metric), 8) AS s")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return _per_trial(spark, d).select("trial", R(F.col("m"), 8).alias("m"), R(F.col("s"), 8).alias("s"))


def _per_trial(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).groupBy("trial").agg(F.avg("metric").alias("m"), F.stddev_pop("metric").alias("s"))


@query("w03_rank_metrics", f"WITH {_T2_RANKED}, r AS (SELECT trial, row_number() OVER (ORDER BY m DESC, trial) AS rank_m, row_number() OVER (ORDER BY s DESC, trial) AS rank_s FROM t) SELECT trial, rank_m + rank_s AS rank_sum, CAST((rank_m <= 3) AS INTEGER) + CAST((rank_s <= 3) AS INTEGER) AS n_top3 FROM r")
def w03(spark: SparkSession, d: str) -> DataFrame:
    """Places by mean and by deviation, both rounded to eight decimals; ties go to the smaller trial."""
    t = exact_ranks(exact_ranks(_ranked(spark, d), "m", "trial", "rank_m"), "s", "trial", "rank_s")
    return t.select("trial", (F.col("rank_m") + F.col("rank_s")).alias("rank_sum"), ((F.col("rank_m") <= 3).cast("int") + (F.col("rank_s") <= 3).cast("int")).alias("n_top3"))


def exact_ranks(df: DataFrame, value: str, tie: str, rank: str, descending: bool = True, keys: list[str] | None = None) -> DataFrame:
    """df with the 1-based place in the order of value, ties by `tie` ascending.

    Rows before the row's value come from a prefix sum over the distinct values (in ranges), places
    among equal values from a window over those.
    """
    keys = keys or []
    key = -F.col(value) if descending else F.col(value)
    k, n, before = P.apart([*df.columns, rank], "key", "n", "before")
    keyed = df.withColumn(k, key)
    counts = P.prefix_sum(keyed.groupBy(*keys, k).agg(F.count("*").alias(n)), k, {n: before}, keys).drop(n)
    place = F.row_number().over(W.partitionBy(*keys, k).orderBy(tie))
    return keyed.join(counts.hint("shuffle_hash"), [*keys, k]).select(*df.columns, (F.col(before) + place).cast("long").alias(rank))


@query("w04_rank_movement", f"WITH {_T2_RANKED} SELECT trial, row_number() OVER (ORDER BY m DESC, trial) - row_number() OVER (ORDER BY s, trial) AS movement FROM t")
def w04(spark: SparkSession, d: str) -> DataFrame:
    """Place by mean less place by deviation, both rounded to eight decimals; ties go to the smaller trial."""
    t = exact_ranks(exact_ranks(_ranked(spark, d), "m", "trial", "a"), "s", "trial", "b", descending=False)
    return t.select("trial", (F.col("a") - F.col("b")).alias("movement"))


@query("w05_minmax_composite_rank", f"WITH {_T2}, c AS (SELECT trial, (m - min(m) OVER ()) / nullif(max(m) OVER () - min(m) OVER (), 0) AS a, (s - min(s) OVER ()) / nullif(max(s) OVER () - min(s) OVER (), 0) AS b FROM t) SELECT trial, round(coalesce(a, 0) + coalesce(b, 0), 6) AS composite FROM c")
def w05(spark: SparkSession, d: str) -> DataFrame:
    t = _per_trial(spark, d)
    r = t.agg(F.min("m").alias("a"), F.max("m").alias("b"), F.min("s").alias("c"), F.max("s").alias("e"))  # one row
    got = t.crossJoin(F.broadcast(r))
    scaled = lambda x, lo, hi: F.coalesce(S.safe_div(F.col(x) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0))
    return got.select("trial", R(scaled("m", "a", "b") + scaled("s", "c", "e")).alias("composite"))


@query("w06_per_seed_from_running_mean", f"WITH {_TRIALS}, r AS (SELECT trial, seed, metric, row_number() OVER w AS n, avg(metric) OVER (PARTITION BY trial ORDER BY seed ROWS UNBOUNDED PRECEDING) AS m FROM trials WINDOW w AS (PARTITION BY trial ORDER BY seed)) SELECT trial, n, round(metric, 6) AS value FROM r")
def w06(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("trial").orderBy("seed")  # at most twelve seeds a trial
    running = trials(spark, d).select("trial", F.row_number().over(w).cast("long").alias("n"), F.avg("metric").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("m"))
    return undo_running_mean(running).select("trial", "n", R(F.col("value")).alias("value"))


def undo_running_mean(df: DataFrame) -> DataFrame:
    """(trial, n, value, clean) from (trial, n, running mean m); clean: n goes up by one in all rows of the trial."""
    w = W.partitionBy("trial").orderBy("n")
    before, last = F.coalesce(F.lag("n").over(w), F.lit(0)), F.coalesce(F.lag("m").over(w), F.lit(0.0))
    made = df.select("trial", "n", (F.col("n") * F.col("m") - before * last).alias("value"), (F.col("n") - before == 1).alias("_step"))
    return made.select("trial", "n", "value", F.min("_step").over(W.partitionBy("trial")).alias("clean"))


@query("w09_is_non_learning", f"WITH {_TRIALS} SELECT trial, max(metric) <= 0.5 * 1.05 AS non_learning FROM trials WHERE seed >= 3 GROUP BY trial HAVING count(*) >= 5")
def w09(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d).where("seed >= 3").groupBy("trial").agg(F.count("*").alias("n"), F.max("metric").alias("best"))
    return t.where("n >= 5").select("trial", (F.col("best") <= F.lit(0.5) * 1.05).alias("non_learning"))


@query("w11_tv_over_range", f"WITH {_TRIALS}, g AS (SELECT trial, metric, abs(metric - lag(metric) OVER (PARTITION BY trial ORDER BY seed)) AS step FROM trials) SELECT trial, round(sum(step) / nullif(max(metric) - min(metric), 0), 6) AS tv FROM g GROUP BY trial")
def w11(spark: SparkSession, d: str) -> DataFrame:
    step = F.abs(F.col("metric") - F.lag("metric").over(W.partitionBy("trial").orderBy("seed")))
    g = trials(spark, d).select("trial", "metric", step.alias("step"))
    return g.groupBy("trial").agg(R(S.safe_div(F.sum("step"), F.max("metric") - F.min("metric"))).alias("tv"))


@query("w12_mean_std_by_epoch", f"WITH {_TRIALS}, e AS (SELECT trial, row_number() OVER (PARTITION BY trial ORDER BY seed) - 1 AS epoch, metric FROM trials) SELECT CAST(epoch AS INTEGER) AS epoch, round(avg(metric), 6) AS mean, round(stddev_pop(metric), 6) AS std, count(*) AS n FROM e GROUP BY epoch")
def w12(spark: SparkSession, d: str) -> DataFrame:
    curves = trials(spark, d).groupBy("trial").agg(F.transform(F.sort_array(F.collect_list(F.struct("seed", "metric"))), lambda s: s["metric"]).alias("curve"))
    return curves.select(F.posexplode("curve").alias("epoch", "v")).groupBy("epoch").agg(R(F.avg("v")).alias("mean"), R(F.stddev_pop("v")).alias("std"), F.count("*").alias("n"))


@query("w14_widest_gap_threshold", f"WITH {_T2}, g AS (SELECT m, lead(m) OVER (ORDER BY m) AS next FROM (SELECT DISTINCT round(m, 4) AS m FROM t)) SELECT round((m + next) / 2, 6) AS threshold FROM g WHERE next IS NOT NULL ORDER BY round(next - m, 9) DESC, m LIMIT 1")
def w14(spark: SparkSession, d: str) -> DataFrame:
    v = _per_trial(spark, d).select(F.round("m", 4).alias("m")).distinct()
    g = next_value(v, "m", [], "next").where("next IS NOT NULL")
    best = g.agg(F.max(F.struct(F.round(F.col("next") - F.col("m"), 9).alias("gap"), (-F.col("m")).alias("back"), "next")).alias("b"))
    return best.select(R((F.col("b.next") - F.col("b.back")) / 2).alias("threshold"))


@query("w15_graded_holes", f"WITH {_TRIALS}, c AS (SELECT trial % 7 AS model, seed AS class, median(metric) AS dr FROM trials GROUP BY 1, 2), x AS (SELECT *, max(dr) OVER (PARTITION BY class) AS best FROM c) SELECT model, count(*) FILTER (dr < 0.375) AS holes, count(*) FILTER (dr >= 0.375) AS covered FROM x WHERE best >= 0.375 GROUP BY model")
def w15(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d).select((F.col("trial") % 7).alias("model"), F.col("seed").alias("class"), "metric")
    c = P.group_quantiles(t, ["model", "class"], "metric", [0.5]).select("model", "class", F.col("q")[0].alias("dr"))
    x = c.withColumn("best", F.max("dr").over(W.partitionBy("class"))).where("best >= 0.375")
    return x.groupBy("model").agg(F.count_if(F.col("dr") < 0.375).alias("holes"), F.count_if(F.col("dr") >= 0.375).alias("covered"))


@query("w16_trapezoid_area", f"WITH {_TRIALS}, g AS (SELECT trial, seed, metric, lag(metric) OVER w AS m0, lag(seed) OVER w AS s0 FROM trials WINDOW w AS (PARTITION BY trial ORDER BY seed)) SELECT trial, round(sum((metric + m0) / 2 * (seed - s0)) / nullif(max(seed) - min(seed), 0), 6) AS area FROM g GROUP BY trial")
def w16(spark: SparkSession, d: str) -> DataFrame:
    return trapezoid_area(trials(spark, d), ["trial"], "seed", "metric").select("trial", R(F.col("area")).alias("area"))


def trapezoid_area(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, area): the mean height of the curve of each key between its ends; NULL for a point."""
    w = W.partitionBy(*keys).orderBy(x)
    g = df.select(*keys, x, ((F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))).alias("_a"))
    return g.groupBy(*keys).agg(S.safe_div(F.sum("_a"), F.max(x) - F.min(x)).alias("area"))


@query("w17_interpolate_at", f"WITH {_TRIALS}, g AS (SELECT trial, seed AS x, metric AS y, lead(seed) OVER w AS x1, lead(metric) OVER w AS y1 FROM trials WINDOW w AS (PARTITION BY trial ORDER BY seed)) SELECT trial, round(y + (y1 - y) * (5.5 - x) / (x1 - x), 6) AS y FROM g WHERE x <= 5.5 AND x1 > 5.5")
def w17(spark: SparkSession, d: str) -> DataFrame:
    return interpolate_at(trials(spark, d), ["trial"], "seed", "metric", 5.5).select("trial", R(F.col("y")).alias("y"))


def interpolate_at(df: DataFrame, keys: list[str], x: str, y: str, at: float) -> DataFrame:
    """(keys, y): linear interpolation between the neighbours of `at`; no row where it lies outside the curve.

    Of points with equal x the first by y counts.
    """
    one = df.groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.min(y).alias("_y"))
    w = W.partitionBy(*keys).orderBy("_x")
    g = one.select(*keys, "_x", "_y", F.lead("_x").over(w).alias("_x1"), F.lead("_y").over(w).alias("_y1"))
    hit = ((F.col("_x") <= at) & (F.col("_x1") > at)) | ((F.col("_x") == at) & F.col("_x1").isNull())
    slope = S.safe_div(F.col("_y1") - F.col("_y"), F.col("_x1") - F.col("_x"))
    return g.where(hit).select(*keys, (F.col("_y") + F.coalesce(slope * (at - F.col("_x")), F.lit(0.0))).alias("y"))
