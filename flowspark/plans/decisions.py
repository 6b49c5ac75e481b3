"""Queries of metrics and of the decision rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fusion as X
from ..operators import metrics as M
from ..operators.profile import confusion_counts, quantiles
from ..spec import PERCENTILE_GRID, REFERENCE_ATTACKS, REFERENCE_BENIGN
from .flow_view import flows, with_flows
from .profiles import interpolate_at, trapezoid_area
from .registry import query

R = lambda c, n=6: F.round(c, n)
_D = lambda x: f"CAST({x} AS DOUBLE)"


def _mcc(tp: str, fp: str, tn: str, fn: str) -> str:
    den = f"sqrt(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
    return f"CASE WHEN {den} > 0 THEN ({tp} * {tn} - {fp} * {fn}) / {den} ELSE 0 END"


def _bal(fpr: str, rec: str, b: str = _D(REFERENCE_BENIGN), a: str = _D(REFERENCE_ATTACKS)) -> str:
    return _mcc(f"({rec} * {a})", f"({fpr} * {b})", f"((1 - {fpr}) * {b})", f"((1 - {rec}) * {a})")


_COUNTS = "SELECT CAST(count(*) FILTER (label = 1 AND logit > 0) AS DOUBLE) AS tp, CAST(count(*) FILTER (label = 0 AND logit > 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (label = 0 AND logit <= 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (label = 1 AND logit <= 0) AS DOUBLE) AS fn FROM flows"


@query("e01_confusion_metrics", with_flows(f", c AS ({_COUNTS}) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 6) AS \"precision\", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr, round({_mcc('tp', 'fp', 'tn', 'fn')}, 6) AS mcc FROM c"))
def e01(spark: SparkSession, d: str) -> DataFrame:
    m = M.confusion_metrics(flows(spark, d), "label", F.col("logit") > 0)
    return m.select("tp", "fp", "tn", "fn", *[R(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "fpr", "mcc")])


@query("e02_roc_auc", with_flows(", f AS (SELECT label, round(logit, 1) AS s FROM flows), r AS (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM f) SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)), 6) AS auc FROM r"))
def e02(spark: SparkSession, d: str) -> DataFrame:
    return M.roc_auc(flows(spark, d).select("label", F.round("logit", 1).alias("s")), "s", "label").select(R(F.col("auc")).alias("auc"))


_CURVE = ", f AS (SELECT label, round(logit, 1) AS s FROM flows), g AS (SELECT s, sum(label) AS pos, sum(1 - label) AS neg FROM f GROUP BY s), c AS (SELECT s, pos, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp, CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(neg) OVER () AS DOUBLE) AS q FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"


@query("e03_average_precision", with_flows(f"{_CURVE} SELECT round(sum(tp / (tp + fp) * pos / p), 6) AS ap FROM c"))
def e03(spark: SparkSession, d: str) -> DataFrame:
    return M.average_precision(flows(spark, d).select("label", F.round("logit", 1).alias("s")), "s", "label").select(R(F.col("ap")).alias("ap"))


@query("e04_percentile_threshold", with_flows("SELECT round(quantile_cont(s_dae, 0.99), 9) AS tau FROM flows WHERE label = 0 AND pool = 'select'"))
def e04(spark: SparkSession, d: str) -> DataFrame:
    return M.percentile_threshold(flows(spark, d).where("label = 0 AND pool = 'select'"), "s_dae", 0.01).select(R(F.col("tau"), 9).alias("tau"))


@query("e05_pr_roc_curves", with_flows(f"{_CURVE} SELECT s, round(tp / (tp + fp), 6) AS \"precision\", round(tp / p, 6) AS recall, round(fp / q, 6) AS fpr FROM c"))
def e05(spark: SparkSession, d: str) -> DataFrame:
    c = M.curves(flows(spark, d).select("label", F.round("logit", 1).alias("s")), "s", "label")
    return c.select("s", *[R(F.col(x)).alias(x) for x in ("precision", "recall", "fpr")])


def _grid_sql(ps: list[float], measure: str) -> str:
    taus = " UNION ALL ".join(f"SELECT {_D(p)} AS p, quantile_cont(logit, {_D(p)} / 100) AS tau FROM flows WHERE label = 0" for p in ps)
    return f", t AS ({taus}), r AS (SELECT p, tau, avg(CASE WHEN logit >= tau THEN 1.0 ELSE 0.0 END) FILTER (label = 0) AS fpr, avg(CASE WHEN logit >= tau THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS rec, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS b, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS a FROM flows, t GROUP BY p, tau), m AS (SELECT *, {measure} AS mcc FROM r)"


@query("e06_best_mcc_percentile", with_flows(_grid_sql(PERCENTILE_GRID, _bal("fpr", "rec")) + " SELECT p, round(tau, 6) AS tau, round(fpr, 6) AS fpr, round(rec, 6) AS recall, round(mcc, 6) AS mcc_bal FROM m ORDER BY mcc DESC, p LIMIT 1"))
def e06(spark: SparkSession, d: str) -> DataFrame:
    b = M.best_mcc_percentile(flows(spark, d), "logit", "label")
    return b.select("p", *[R(F.col(c)).alias(c) for c in ("tau", "fpr", "recall", "mcc_bal")])


_TARGETS = [0.005, 0.01, 0.02, 0.05]


@query("e07_mcc_at_fpr", with_flows(_grid_sql([100 * (1 - t) for t in _TARGETS], _bal("fpr", "rec", "b", "a")) + " SELECT round(1 - p / 100, 6) AS target, round(tau, 6) AS tau, round(fpr, 6) AS fpr, round(rec, 6) AS recall, round(mcc, 6) AS mcc FROM m"))
def e07(spark: SparkSession, d: str) -> DataFrame:
    m = M.mcc_at_fpr(flows(spark, d), "logit", "label", _TARGETS)
    return m.select(*[R(F.col(c)).alias(c) for c in ("target", "tau", "fpr", "recall", "mcc")])


_BAND = [0.005 + i * 0.001 for i in range(11)]


@query("e07_partial_auc_mcc", with_flows(_grid_sql([100 * (1 - t) for t in _BAND], _bal("fpr", "rec", "b", "a")) + ", g AS (SELECT 1 - p / 100 AS x, mcc, lag(mcc) OVER (ORDER BY p DESC) AS m0, lag(1 - p / 100) OVER (ORDER BY p DESC) AS x0 FROM m) SELECT round(sum((mcc + m0) / 2 * (x - x0)) / (max(x) - min(x)), 6) AS area FROM g"))
def e07b(spark: SparkSession, d: str) -> DataFrame:
    m = M.mcc_at_fpr(flows(spark, d), "logit", "label", _BAND).withColumn("k", F.lit(1))
    return trapezoid_area(m, ["k"], "target", "mcc").select(R(F.col("area")).alias("area"))


@query("e08_and_at_oppoint", with_flows("SELECT round(avg(CASE WHEN s_dae >= 0.006 AND logit >= 0 THEN 1.0 ELSE 0.0 END) FILTER (label = 0), 6) AS fpr, round(avg(CASE WHEN s_dae >= 0.006 AND logit >= 0 THEN 1.0 ELSE 0.0 END) FILTER (label = 1), 6) AS recall FROM flows"))
def e08(spark: SparkSession, d: str) -> DataFrame:
    r = M.rates_at(flows(spark, d), "label", {"and": (F.col("s_dae") >= 0.006) & (F.col("logit") >= 0)})
    return r.select(R(F.col("fpr")).alias("fpr"), R(F.col("recall")).alias("recall"))


@query("e09_mcc_bal", with_flows(f", r AS (SELECT avg(CASE WHEN logit > 0 THEN 1.0 ELSE 0.0 END) FILTER (label = 0) AS fpr, avg(CASE WHEN logit > 0 THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS rec FROM flows) SELECT round({_bal('fpr', 'rec')}, 6) AS mcc_ref, round({_bal('fpr', 'rec', _D('0.99'), _D('0.01'))}, 6) AS mcc_one_percent FROM r"))
def e09(spark: SparkSession, d: str) -> DataFrame:
    r = M.rates_at(flows(spark, d), "label", {"x": F.col("logit") > 0})
    f, c = F.col("fpr"), F.col("recall")
    return r.select(R(S.mcc_balanced(f, c)).alias("mcc_ref"), R(S.mcc_balanced(f, c, 0.99, 0.01)).alias("mcc_one_percent"))


_LOAO = ", t AS (SELECT quantile_cont(s_dae, 0.99) AS tau FROM flows WHERE label = 0 AND pool = 'select'), s AS (SELECT attack, avg(s_dae) AS m, var_samp(s_dae) AS v, CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN s_dae > tau THEN 1.0 ELSE 0.0 END) AS dr FROM flows, t WHERE pool = 'test' GROUP BY attack), b AS (SELECT m AS bm, v AS bv, n AS bn FROM s WHERE attack = 'Benign')"


@query("e10_loao_detection", with_flows(_LOAO + " SELECT attack, round(dr, 6) AS dr, round((m - bm) / sqrt(((n - 1) * v + (bn - 1) * bv) / (n + bn - 2)), 6) AS d FROM s, b WHERE attack <> 'Benign'"))
def e10(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).select("attack", "label", "pool", "s_dae")
    tau = M.percentile_threshold(df.where("label = 0 AND pool = 'select'"), "s_dae", 0.01)
    test = df.where("pool = 'test'")
    dr = test.where("label = 1").crossJoin(F.broadcast(tau)).groupBy("attack").agg(F.avg((F.col("s_dae") > F.col("tau")).cast("double")).alias("dr"))
    dd = M.cohens_d(test, "s_dae", "attack", "Benign")
    return dr.join(dd.hint("shuffle_hash"), "attack").select("attack", R(F.col("dr")).alias("dr"), R(F.col("d")).alias("d"))


@query("e11_score_table", with_flows(" UNION ALL ".join(f"{'' if i else ', u AS (SELECT 1 AS one)'} SELECT '{c}' AS score, round(quantile_cont({c}, 0.95) FILTER (label = 0), 6) AS tau, count(*) FILTER (label = 1) AS n_attacks FROM flows" for i, c in enumerate(("s_dae", "logit")))))
def e11(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d)
    tau = quantiles(df.where("label = 0"), ["s_dae", "logit"], [0.95])
    n = df.agg(F.count_if(F.col("label") == 1).alias("n_attacks"))
    return tau.crossJoin(F.broadcast(n)).select(F.col("feature").alias("score"), R(F.col("q")[0]).alias("tau"), "n_attacks")  # one row


@query("e12_confirm_on_test", with_flows(", t AS (SELECT quantile_cont(logit, 0.99) AS tau FROM flows WHERE label = 0 AND pool = 'select') SELECT count(*) FILTER (label = 1 AND logit >= tau) AS tp, count(*) FILTER (label = 0 AND logit >= tau) AS fp, count(*) FILTER (label = 0 AND logit < tau) AS tn, count(*) FILTER (label = 1 AND logit < tau) AS fn FROM flows, t WHERE pool = 'test'"))
def e12(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).select("label", "pool", "logit")
    tau = M.percentile_threshold(df.where("label = 0 AND pool = 'select'"), "logit", 0.01)
    got = df.where("pool = 'test'").crossJoin(F.broadcast(tau))

    return got.agg(*confusion_counts(F.col("label"), F.col("logit") >= F.col("tau")))


# --- the decision rule --------------------------------------------------------------------
_STD = ", st AS (SELECT avg(log10(greatest(s_dae, 1e-12))) AS mu0, stddev_pop(log10(greatest(s_dae, 1e-12))) AS sd0, avg(logit) AS mu1, stddev_pop(logit) AS sd1 FROM flows WHERE label = 0 AND pool = 'train'), z AS (SELECT f.*, (log10(greatest(s_dae, 1e-12)) - mu0) / sd0 AS z0, (logit - mu1) / sd1 AS z1 FROM flows f, st)"


def _mode_sql(m: str, pct: float, alpha: float, target: float | None, hi: float) -> str:
    """Common tables that end in p_<mode>: the parameters of a mode."""
    union = f", fr_{m} AS (SELECT z1 FROM z, tt_{m} WHERE label = 0 AND pool = 'select' AND NOT (z0 > tau_z AND z1 > theta_z)), un_{m} AS (SELECT {_D(target)} * (SELECT count(*) FROM z WHERE label = 0 AND pool = 'select') - ((SELECT count(*) FROM z WHERE label = 0 AND pool = 'select') - (SELECT count(*) FROM fr_{m})) AS k, count(*) AS n FROM fr_{m}), ro_{m} AS (SELECT z1, row_number() OVER (ORDER BY z1) - 1 AS i FROM fr_{m}), po_{m} AS (SELECT (n - 1) * greatest(0, least(1, 1 - k / n)) AS p, k FROM un_{m}), qu_{m} AS (SELECT a.z1 + (b.z1 - a.z1) * (p - floor(p)) AS q, k FROM po_{m} JOIN ro_{m} a ON a.i = floor(p) JOIN ro_{m} b ON b.i = ceil(p))" if target is not None else ""
    tu = f"(SELECT CASE WHEN k > 0 THEN q END FROM qu_{m})" if target is not None else "CAST(NULL AS DOUBLE)"
    return f""", ta_{m} AS (SELECT (log10(quantile_cont(s_dae, {pct / 100})) - (SELECT mu0 FROM st)) / (SELECT sd0 FROM st) AS tau_z, (log10(quantile_cont(s_dae, {hi / 100})) - (SELECT mu0 FROM st)) / (SELECT sd0 FROM st) AS tau_hi_z FROM flows WHERE label = 0 AND pool = 'select'),
 ga_{m} AS (SELECT z1, row_number() OVER (ORDER BY z1) - 1 AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM z, ta_{m} WHERE label = 0 AND pool = 'select' AND z0 > tau_z),
 pp_{m} AS (SELECT (max(n) - 1) * (1 - {_D(alpha)} * (SELECT count(*) FROM z WHERE label = 0 AND pool = 'select') / max(n)) AS p FROM ga_{m}),
 tt_{m} AS (SELECT a.z1 + (b.z1 - a.z1) * (p - floor(p)) AS theta_z, tau_z, tau_hi_z FROM pp_{m} JOIN ga_{m} a ON a.i = floor(p) JOIN ga_{m} b ON b.i = ceil(p), ta_{m}){union},
 p_{m} AS (SELECT '{m}' AS mode, tau_z, theta_z, {tu} AS theta_union, tau_hi_z FROM tt_{m})"""


_MODES = _STD + _mode_sql("A", 97.0, 0.003, None, 99.8) + _mode_sql("B", 99.0, 0.005, 0.01, 99.8) + ", params AS (SELECT * FROM p_A UNION ALL SELECT * FROM p_B)"
_HIT = "((z0 > tau_z AND z1 > theta_z) OR z1 > coalesce(theta_union, CAST('Infinity' AS DOUBLE)) OR z0 > tau_hi_z)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).select("flow_id", "label", "attack", "pool", "s_dae", "logit")


@query("f01_to_plane", with_flows(_STD + " SELECT flow_id, round(z0, 6) AS z0, round(z1, 6) AS z1 FROM z"))
def f01(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    z = X.to_plane(s, X.standardiser(s.where("label = 0 AND pool = 'train'")))
    return z.select("flow_id", R(F.col("z0")).alias("z0"), R(F.col("z1")).alias("z1"))


@query("f02_tau_to_plane", with_flows(_STD + " SELECT round((log10(0.006) - mu0) / sd0, 6) AS tau_z FROM st"))
def f02(spark: SparkSession, d: str) -> DataFrame:
    return X.standardiser(_scores(spark, d).where("label = 0 AND pool = 'train'")).select(R(X.tau_to_plane(F.lit(0.006))).alias("tau_z"))


@query("f03_and_theta", with_flows(_MODES + " SELECT mode, round(theta_z, 6) AS theta_z FROM params"))
def f03(spark: SparkSession, d: str) -> DataFrame:
    return X.fusion_modes(_scores(spark, d)).select("mode", R(F.col("theta_z")).alias("theta_z"))


@query("f04_union_theta", with_flows(_MODES + " SELECT round(theta_union, 6) AS theta_union FROM params WHERE mode = 'B'"))
def f04(spark: SparkSession, d: str) -> DataFrame:
    return X.fusion_modes(_scores(spark, d)).where("mode = 'B'").select(R(F.col("theta_union")).alias("theta_union"))


@query("f05_fuse_predict", with_flows(_MODES + f" SELECT flow_id, mode, coalesce({_HIT}, false) AS alarm FROM z, params WHERE pool = 'test'"))
def f05(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return X.apply_modes(s.where("pool = 'test'"), X.fusion_modes(s)).select("flow_id", "mode", "alarm")


@query("f06_build_fusion_modes", with_flows(_MODES + " SELECT mode, round(tau_z, 6) AS tau_z, round(theta_z, 6) AS theta_z, round(theta_union, 6) AS theta_union, round(tau_hi_z, 6) AS tau_hi_z FROM params"))
def f06(spark: SparkSession, d: str) -> DataFrame:
    return X.fusion_modes(_scores(spark, d)).select("mode", *[R(F.col(c)).alias(c) for c in ("tau_z", "theta_z", "theta_union", "tau_hi_z")])


_PRESETS = _STD + _mode_sql("andonly", 99.0, 0.005, None, 99.8) + _mode_sql("rec", 99.0, 0.005, 0.01, 99.8) + _mode_sql("high", 99.0, 0.005, 0.015, 99.8) + ", params AS (SELECT * FROM p_andonly UNION ALL SELECT * FROM p_rec UNION ALL SELECT * FROM p_high)"


def _presets(spark: SparkSession, d: str) -> DataFrame:
    """The older presets: no high branch, three total budgets."""
    from ..spec import FUSION_PRESETS

    ben = _scores(spark, d).where("label = 0").select("pool", "s_dae", "logit").persist()
    modes = {name: (99.0, 0.005, target, None) for name, target in FUSION_PRESETS.items()}
    out = X.calibrate_modes(ben.where("pool = 'train'"), ben.where("pool = 'select'"), modes)
    ben.unpersist()
    return out


@query("f07_fusion_presets_v1", with_flows(_PRESETS + " SELECT mode, round(theta_z, 6) AS theta_z, round(theta_union, 6) AS theta_union, round(avg(CASE WHEN (z0 > tau_z AND z1 > theta_z) OR z1 > coalesce(theta_union, CAST('Infinity' AS DOUBLE)) THEN 1.0 ELSE 0.0 END) FILTER (label = 0), 6) AS fpr FROM z, params WHERE pool = 'test' GROUP BY ALL"))
def f07(spark: SparkSession, d: str) -> DataFrame:
    p = _presets(spark, d)
    hit = X.apply_modes(_scores(spark, d).where("pool = 'test' AND label = 0"), p).groupBy("mode").agg(R(F.avg(F.col("alarm").cast("double"))).alias("fpr"))
    return p.select("mode", R(F.col("theta_z")).alias("theta_z"), R(F.col("theta_union")).alias("theta_union")).join(hit.hint("shuffle_hash"), "mode")


@query("f08_fired_branch", with_flows(_MODES + " SELECT mode, CASE WHEN z0 > tau_z AND z1 > theta_z THEN 'consensus' WHEN z1 > coalesce(theta_union, CAST('Infinity' AS DOUBLE)) THEN 'logit' WHEN z0 > tau_hi_z THEN 'first stage' ELSE '' END AS branch, count(*) AS n FROM z, params WHERE pool = 'test' GROUP BY ALL"))
def f08(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return X.apply_modes(s.where("pool = 'test'"), X.fusion_modes(s)).groupBy("mode", "branch").agg(F.count("*").alias("n"))


@query("f09_evaluate_fusion", with_flows(_MODES + f", h AS (SELECT mode, attack, label, CASE WHEN {_HIT} THEN 1.0 ELSE 0.0 END AS hit FROM z, params WHERE pool = 'test'), r AS (SELECT mode, avg(hit) FILTER (label = 0) AS fpr, avg(hit) FILTER (label = 1) AS rec FROM h GROUP BY mode) SELECT h.mode, h.attack, round(avg(hit), 6) AS dr, round(max(fpr), 6) AS fpr, round(max(rec), 6) AS recall, round(max({_bal('fpr', 'rec')}), 6) AS mcc_bal FROM h JOIN r ON r.mode = h.mode WHERE label = 1 GROUP BY ALL"))
def f09(spark: SparkSession, d: str) -> DataFrame:
    return evaluated(_scores(spark, d))


def evaluated(scores: DataFrame) -> DataFrame:
    """Rates of both modes on the test rows, with the detection rate of every class: one pass, then a window of a few rows."""
    from pyspark.sql import Window as W

    hit = F.col("alarm").cast("double")
    per = X.apply_modes(scores.where("pool = 'test'"), X.fusion_modes(scores)).groupBy("mode", "attack", "label").agg(F.sum(hit).alias("h"), F.count("*").alias("n"))
    w = W.partitionBy("mode")
    rate = lambda v: F.sum(F.when(F.col("label") == v, F.col("h"))).over(w) / F.sum(F.when(F.col("label") == v, F.col("n"))).over(w)
    got = per.select("mode", "attack", "label", (F.col("h") / F.col("n")).alias("dr"), rate(0).alias("fpr"), rate(1).alias("recall")).where("label = 1")
    return got.select("mode", "attack", R(F.col("dr")).alias("dr"), R(F.col("fpr")).alias("fpr"), R(F.col("recall")).alias("recall"), R(S.mcc_balanced(F.col("fpr"), F.col("recall"))).alias("mcc_bal"))


_SWEEP = [0.005, 0.01, 0.02, 0.05]


@query("f10_rule_sweep", with_flows(_STD + ", g AS (" + " UNION ALL ".join(f"SELECT {_D(t)} AS target, quantile_cont(z0, {_D(1 - t)}) AS t0, quantile_cont(z1, {_D(1 - t)}) AS t1 FROM z WHERE label = 0 AND pool = 'select'" for t in _SWEEP) + ") SELECT target, round(avg(CASE WHEN z0 > t0 THEN 1.0 ELSE 0.0 END) FILTER (label = 0), 6) AS fpr_first, round(avg(CASE WHEN z0 > t0 THEN 1.0 ELSE 0.0 END) FILTER (label = 1), 6) AS recall_first, round(avg(CASE WHEN z1 > t1 THEN 1.0 ELSE 0.0 END) FILTER (label = 0), 6) AS fpr_logit, round(avg(CASE WHEN z1 > t1 THEN 1.0 ELSE 0.0 END) FILTER (label = 1), 6) AS recall_logit FROM z, g WHERE pool = 'test' GROUP BY target"))
def f10(spark: SparkSession, d: str) -> DataFrame:
    sweep = rule_sweep(_scores(spark, d), _SWEEP, ("first", "logit"))
    out = sweep.groupBy("target").pivot("rule", ["first", "logit"]).agg(F.max("fpr").alias("fpr"), F.max("recall").alias("recall"))
    return out.select("target", *[R(F.col(f"{r}_{m}")).alias(f"{m}_{r}") for r in ("first", "logit") for m in ("fpr", "recall")])


def rule_sweep(scores: DataFrame, grid: list[float], rules: tuple[str, ...] = ("first", "logit", "and", "and_or_logit"), tau_pct: float = 99.0, alpha: float = 0.005) -> DataFrame:
    """(rule, target, theta, fpr, recall): rules calibrated on benign selection rows at each share, measured on test rows.

    Thresholds are a table of rules x grid rows; the test rows are read once for all of them.
    """
    ben = scores.where("label = 0")
    p = X.calibrate(ben.where("pool = 'train'"), ben.where("pool = 'select'"), tau_pct, alpha, None, None)
    one = p.first()
    sel = X.to_plane(ben.where("pool = 'select'").select("s_dae", "logit"), p).select("z0", "z1").persist()
    theta: dict[str, list[float]] = {}
    q = {r["feature"]: r["q"] for r in quantiles(sel, ["z0", "z1"], [1 - t for t in grid]).collect()}  # two rows
    theta["first"], theta["logit"] = q["z0"], q["z1"]
    if "and" in rules:
        theta["and"] = [t for t, _ in X.and_thetas(sel, one["tau_z"], grid)]
    if "and_or_logit" in rules:
        theta["and_or_logit"] = X.union_thetas(sel, one["tau_z"], one["theta_z"], grid)
    sel.unpersist()
    z = X.to_plane(scores.where("pool = 'test'").select("label", "s_dae", "logit"), p)
    z0, z1, tau, th = F.col("z0"), F.col("z1"), F.lit(one["tau_z"]), F.lit(one["theta_z"])
    make = {"first": lambda t: z0 > t, "logit": lambda t: z1 > t, "and": lambda t: (z0 > tau) & (z1 > t), "and_or_logit": lambda t: ((z0 > tau) & (z1 > th)) | (z1 > t)}
    hits = {f"{r}|{g}": make[r](F.lit(t)) for r in rules for g, t in zip(grid, theta[r])}
    got = M.rates_at(z, "label", hits)
    named = scores.sparkSession.createDataFrame([(f"{r}|{g}", r, g, float(t)) for r in rules for g, t in zip(grid, theta[r])], "name string, rule string, target double, theta double")
    return got.join(F.broadcast(named), "name").select("rule", "target", "theta", "fpr", "recall")


@query("f11_structural_bounds", with_flows(_STD + ", m AS (SELECT max(z1) AS top, max(z0) AS top0 FROM z WHERE label = 0 AND pool = 'select') SELECT round(avg(CASE WHEN z1 > top THEN 1.0 ELSE 0.0 END) FILTER (label = 1), 6) AS logit_floor, round(avg(CASE WHEN z0 > top0 THEN 1.0 ELSE 0.0 END) FILTER (label = 1), 6) AS first_floor FROM z, m WHERE pool = 'test'"))
def f11(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    st = X.standardiser(s.where("label = 0 AND pool = 'train'"))
    z = X.to_plane(s, st)
    top = z.where("label = 0 AND pool = 'select'").agg(F.max("z1").alias("top"), F.max("z0").alias("top0"))  # one row
    got = z.where("label = 1 AND pool = 'test'").crossJoin(F.broadcast(top))
    return got.agg(R(F.avg((F.col("z1") > F.col("top")).cast("double"))).alias("logit_floor"), R(F.avg((F.col("z0") > F.col("top0")).cast("double"))).alias("first_floor"))


@query("f12_ablation_report")
def f12(spark: SparkSession, d: str) -> DataFrame:
    """Rules at a matched false alarm rate: the sweep of each rule, interpolated at 1 %, with Wilson bounds."""
    s = _scores(spark, d)
    sweep = rule_sweep(s, [0.002, 0.005, 0.01, 0.02, 0.05])
    at = interpolate_at(sweep.where("abs(theta) <> double('Infinity')"), ["rule"], "fpr", "recall", 0.01)
    n = s.where("pool = 'test' AND label = 1").count()
    lo, hi = S.wilson(F.col("y"), F.lit(n))
    return at.select("rule", R(F.col("y")).alias("recall"), R(lo).alias("low"), R(hi).alias("high"))


@query("m21_forward_loao", with_flows(_LOAO + " SELECT attack, round(dr, 6) AS dr, CAST(n AS BIGINT) AS n FROM s WHERE attack <> 'Benign'"))
def m21(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).select("attack", "label", "pool", "s_dae")
    tau = M.percentile_threshold(df.where("label = 0 AND pool = 'select'"), "s_dae", 0.01)
    hit = df.where("pool = 'test' AND label = 1").crossJoin(F.broadcast(tau))
    return hit.groupBy("attack").agg(R(F.avg((F.col("s_dae") > F.col("tau")).cast("double"))).alias("dr"), F.count("*").alias("n"))
