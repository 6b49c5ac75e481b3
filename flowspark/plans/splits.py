"""Queries of joins, splits, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import sampling as U
from .flow_view import flows, table, with_flows
from .profiles import trials
from .registry import query

R = lambda c, n=6: F.round(c, n)


def _h(key: str, salt: str) -> str:
    return f"CAST('0x' || substr(md5(concat(CAST({key} AS VARCHAR), ':{salt}')), 1, 8) AS BIGINT)"


_PLACE = lambda salt, by="": f"row_number() OVER ({by} ORDER BY {_h('flow_id', salt)}, flow_id)"
_TRIALS = "WITH trials AS (SELECT l_suppkey AS trial, CAST(month(l_shipdate) AS INTEGER) AS seed, avg(l_extendedprice) / 100000 AS metric FROM lineitem GROUP BY 1, 2)"


@query("j01_semi_join_keys", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def j01(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


_KEY6 = ["PROTOCOL", "L4_DST_PORT", "L7_PROTO", "MAX_TTL", "DNS_QUERY_TYPE", "ICMP_IPV4_TYPE"]


@query("j02_anti_join_key6", with_flows("SELECT flow_id FROM flows f WHERE label = 1 AND NOT EXISTS (SELECT 1 FROM flows t WHERE t.pool = 'test' AND t.label = 1 AND " + " AND ".join(f"t.{c} = f.{c}" for c in _KEY6) + ")"))
def j02(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).where("label = 1").select("flow_id", "pool", *_KEY6)
    return df.join(df.where("pool = 'test'").select(*_KEY6).distinct().hint("shuffle_hash"), _KEY6, "left_anti").select("flow_id")


@query("j03_anti_join_fullrow", with_flows("SELECT PROTOCOL, L4_DST_PORT, L7_PROTO, SRC_TO_DST_SECOND_BYTES FROM flows f WHERE pool <> 'test' AND NOT EXISTS (SELECT 1 FROM flows t WHERE t.pool = 'test' AND t.PROTOCOL = f.PROTOCOL AND t.L4_DST_PORT = f.L4_DST_PORT AND t.L7_PROTO = f.L7_PROTO AND t.SRC_TO_DST_SECOND_BYTES IS NOT DISTINCT FROM f.SRC_TO_DST_SECOND_BYTES)"))
def j03(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).select("pool", "PROTOCOL", "L4_DST_PORT", "L7_PROTO", "SRC_TO_DST_SECOND_BYTES")
    return J.anti_join_rows(df.where("pool <> 'test'").drop("pool"), df.where("pool = 'test'").drop("pool"))


@query("j04_prefer_new_union", _TRIALS + " SELECT trial, round(avg(metric), 6) AS m, 'new' AS origin FROM trials WHERE seed > 9 GROUP BY trial UNION ALL SELECT trial, round(avg(metric), 6), 'old' FROM trials WHERE trial NOT IN (SELECT trial FROM trials WHERE seed > 9) GROUP BY trial")
def j04(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d)
    make = lambda x, o: x.groupBy("trial").agg(R(F.avg("metric")).alias("m")).withColumn("origin", F.lit(o))
    return J.prefer_new(make(t.where("seed > 9"), "new"), make(t, "old"), "trial")


@query("j05_left_join_collect", "SELECT s_suppkey, coalesce(list(l_quantity ORDER BY l_quantity) FILTER (l_quantity IS NOT NULL), []) AS \"values\" FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_discount = 0.1 AND l_tax = 0.08) ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def j05(spark: SparkSession, d: str) -> DataFrame:
    right = table(spark, d, "lineitem").where("l_discount = 0.1 AND l_tax = 0.08").select(F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    return J.left_collect(table(spark, d, "supplier").select("s_suppkey"), right, "s_suppkey", "l_quantity")


@query("j06_full_outer_3way", _TRIALS + ", a AS (SELECT trial, avg(metric) AS m FROM trials WHERE seed <= 2 GROUP BY trial), b AS (SELECT trial, avg(metric) AS m FROM trials WHERE seed BETWEEN 5 AND 6 GROUP BY trial), c AS (SELECT trial, avg(metric) AS m FROM trials WHERE seed = 12 GROUP BY trial) SELECT trial, round(a.m, 6) AS a, round(b.m, 6) AS b, round(c.m, 6) AS c, round(b.m - a.m, 6) AS delta FROM a FULL JOIN b USING (trial) FULL JOIN c USING (trial)")
def j06(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d)
    part = lambda test: t.where(test).groupBy("trial").agg(F.avg("metric").alias("m"))
    got = J.class_table({"a": part("seed <= 2"), "b": part("seed BETWEEN 5 AND 6"), "c": part("seed = 12")}, "trial", "m")
    return got.select("trial", *[R(F.col(c)).alias(c) for c in "abc"], R(F.col("b") - F.col("a")).alias("delta"))


@query("j07_inner_3way_lookup", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j07(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: a fixed table
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "n_name")


@query("j08_coalesce_join", _TRIALS + ", base AS (SELECT trial, seed, metric AS m FROM trials WHERE seed % 2 = 0), extra AS (SELECT trial, seed, metric + 1 AS m FROM trials), j AS (SELECT trial, seed, coalesce(b.m, e.m) AS m FROM extra e LEFT JOIN base b USING (trial, seed)) SELECT trial, round(avg(m), 6) AS m, count(*) AS n FROM j GROUP BY trial HAVING count(*) = 12")
def j08(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d)
    base = t.where("seed % 2 = 0").select("trial", "seed", F.col("metric").alias("b"))
    got = t.join(base.hint("shuffle_hash"), ["trial", "seed"], "left").select("trial", F.coalesce("b", F.col("metric") + 1).alias("m"))
    return got.groupBy("trial").agg(R(F.avg("m")).alias("m"), F.count("*").alias("n")).where("n = 12")


@query("j09_incremental_anti_join", _TRIALS + " SELECT trial, seed FROM trials t WHERE NOT EXISTS (SELECT 1 FROM trials x WHERE x.trial = t.trial AND x.seed = t.seed AND x.metric > 0.4)")
def j09(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d)
    return t.select("trial", "seed").join(t.where("metric > 0.4").select("trial", "seed").hint("shuffle_hash"), ["trial", "seed"], "left_anti")


@query("j10_cross_jobs", "SELECT s_suppkey AS trial, r_regionkey AS seed FROM supplier, region")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """A grid is the feature: every finalist with every seed of a fixed list."""
    seeds = [r[0] for r in table(spark, d, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("trial"), F.explode(F.array(*map(F.lit, seeds))).alias("seed"))


@query("j11_swap_partner_join", with_flows(f", p AS (SELECT flow_id, logit, {_PLACE('swap')} AS p, count(*) OVER () AS n FROM flows) SELECT a.flow_id, round(a.logit, 6) AS logit, b.flow_id AS partner_flow_id, round(b.logit, 6) AS partner_logit FROM p a JOIN p b ON b.p = (a.p + {_h('a.flow_id', 'swap:s')} % (a.n - 1)) % a.n + 1"))
def j11(spark: SparkSession, d: str) -> DataFrame:
    got = U.partner_join(flows(spark, d).select("flow_id", "logit"), "flow_id", "swap", ["flow_id", "logit"])
    return got.select("flow_id", R(F.col("logit")).alias("logit"), "partner_flow_id", R(F.col("partner_logit")).alias("partner_logit"))


@query("j12_nn_distance_join", "SELECT a.vec_id AS id, round(min(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 4) AS distance FROM embeddings a, embeddings b WHERE b.label % 5 <> 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id")
def j12(spark: SparkSession, d: str) -> DataFrame:
    """All vectors against the benign ones (classes that are no multiple of five)."""
    e = table(spark, d, "embeddings")
    return J.nearest_distance(e, e.where("label % 5 <> 0"), "vec_id", "embedding", leave_self=True).select("id", R(F.col("distance"), 4).alias("distance"))


@query("j13_broadcast_params", with_flows(", p AS (SELECT avg(logit) AS mu, stddev_pop(logit) AS sd FROM flows WHERE label = 0 AND pool = 'train') SELECT flow_id, round((logit - mu) / sd, 6) AS z FROM flows, p"))
def j13(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).select("flow_id", "logit", "label", "pool")
    p = df.where("label = 0 AND pool = 'train'").agg(F.avg("logit").alias("mu"), F.stddev_pop("logit").alias("sd"))  # one row
    return df.crossJoin(F.broadcast(p)).select("flow_id", R((F.col("logit") - F.col("mu")) / F.col("sd")).alias("z"))


_NEAR = "SELECT a.vec_id AS id, b.vec_id AS partner, b.label AS partner_label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS place FROM embeddings a JOIN embeddings b ON b.label % 5 <> 0 AND a.vec_id <> b.vec_id"


@query("j14_knn_swap_pool", f"SELECT id, partner, partner_label FROM ({_NEAR}) WHERE place = 1 + {_h('id', 'knn')} % 5")
def j14(spark: SparkSession, d: str) -> DataFrame:
    """Each vector swaps with one of its five nearest benign ones, picked by a hash."""
    from ..functions.scalars import hash32

    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    near = J.nearest(e, e.where("label % 5 <> 0"), "vec_id", "embedding", 5, leave_self=True)
    pick = near.select("id", F.element_at("nearest", (1 + hash32(F.col("id"), "knn") % 5).cast("int"))["nearest"].alias("partner"))
    labels = e.select(F.col("vec_id").alias("partner"), F.col("label").alias("partner_label"))
    return pick.join(labels.hint("merge"), "partner").select("id", "partner", "partner_label")


@query("j15_seed_map_join", _TRIALS + f", p AS (SELECT trial, seed, row_number() OVER (PARTITION BY trial ORDER BY {_h('(trial * 100 + seed)', 'perm')}) AS place FROM trials), e AS (SELECT trial, metric, row_number() OVER (PARTITION BY trial ORDER BY seed) AS place FROM trials) SELECT trial, p.seed, round(metric, 6) AS metric FROM e JOIN p USING (trial, place)")
def j15(spark: SparkSession, d: str) -> DataFrame:
    """Runs in execution order meet the seeds that a permutation by hash gives their place."""
    from pyspark.sql import Window as W

    from ..functions.scalars import hash32

    t = trials(spark, d)
    w = W.partitionBy("trial")
    p = t.select("trial", "seed", F.row_number().over(w.orderBy(hash32(F.col("trial") * 100 + F.col("seed"), "perm"))).alias("place"))
    e = t.select("trial", R(F.col("metric")).alias("metric"), F.row_number().over(w.orderBy("seed")).alias("place"))
    return e.join(p.hint("merge"), ["trial", "place"]).select("trial", "seed", "metric")


@query("j16_census_missing", _TRIALS + " SELECT s_suppkey AS trial, count(*) AS n_missing FROM supplier, (SELECT unnest(range(1, 13)) AS seed) WHERE (s_suppkey, seed) NOT IN (SELECT trial, seed FROM trials) GROUP BY 1")
def j16(spark: SparkSession, d: str) -> DataFrame:
    grid = table(spark, d, "supplier").select(F.col("s_suppkey").alias("trial"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("seed"))
    return grid.join(trials(spark, d).select("trial", "seed").hint("merge"), ["trial", "seed"], "left_anti").groupBy("trial").agg(F.count("*").alias("n_missing"))


# --- splits ---------------------------------------------------------------------------------
_GROUPS = ", g AS (SELECT min(flow_id) AS gid, count(*) AS n FROM flows WHERE label = 0 GROUP BY PROTOCOL, L4_DST_PORT, L7_PROTO)"


@query("w01_cumulative_cut", with_flows(_GROUPS + f", c AS (SELECT gid, n, coalesce(sum(n) OVER (ORDER BY {_h('gid', 'cut')}, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, sum(n) OVER () AS total FROM g) SELECT gid, n, CASE WHEN run < CAST(0.8 AS DOUBLE) * total THEN 'train' WHEN run < CAST(0.9 AS DOUBLE) * total THEN 'val' ELSE 'test' END AS split FROM c"))
def w01(spark: SparkSession, d: str) -> DataFrame:
    g = flows(spark, d).where("label = 0").groupBy("PROTOCOL", "L4_DST_PORT", "L7_PROTO").agg(F.min("flow_id").alias("gid"), F.count("*").alias("n")).select("gid", "n")
    return U.cumulative_cut(g, "gid", "n", "cut", [("train", 0.8), ("val", 0.9)], "test")


@query("w02_stratified_half", with_flows(f"SELECT flow_id, CASE WHEN {_PLACE('half', 'PARTITION BY attack')} <= floor(count(*) OVER (PARTITION BY attack) / 2) THEN 'val' ELSE 'test' END AS split FROM flows WHERE label = 1"))
def w02(spark: SparkSession, d: str) -> DataFrame:
    return U.stratified_half(flows(spark, d).where("label = 1").select("flow_id", "attack"), "flow_id", "attack", "half").select("flow_id", "split")


@query("u01_union_pool", with_flows("SELECT flow_id FROM flows WHERE logit > 3 UNION SELECT flow_id FROM flows WHERE s_dae > 0.008"))
def u01(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d)
    return df.where("logit > 3").select("flow_id").union(df.where("s_dae > 0.008").select("flow_id")).distinct()


@query("u02_except_split", with_flows(f"SELECT flow_id FROM flows WHERE pool = 'train' EXCEPT SELECT flow_id FROM flows WHERE pool = 'train' AND {_h('flow_id', 'mon')} < 429496729"))
def u02(spark: SparkSession, d: str) -> DataFrame:
    """The rule decides each row by itself: what is not monitored is left to learn from."""
    return flows(spark, d).where("pool = 'train'").where(~U.hash_fraction(F.col("flow_id"), "mon", 0.1)).select("flow_id")


@query("u03_leak_check", with_flows("SELECT count(*) FILTER (n > 1) AS n_shared, count(*) AS n_keys FROM (SELECT count(DISTINCT pool) AS n FROM flows GROUP BY flow_id)"))
def u03(spark: SparkSession, d: str) -> DataFrame:
    return U.leak_report(flows(spark, d), "pool", ["flow_id"])


@query("u04_replicate_rows", with_flows("SELECT flow_id, count(*) AS n FROM (SELECT flow_id FROM flows WHERE logit > 5 UNION ALL SELECT flow_id FROM flows, range(4) WHERE logit > 5) GROUP BY flow_id"))
def u04(spark: SparkSession, d: str) -> DataFrame:
    return U.replicate(flows(spark, d).where("logit > 5").select("flow_id"), 4).groupBy("flow_id").agg(F.count("*").alias("n"))


_F3 = ["PROTOCOL", "L4_DST_PORT", "L7_PROTO", "SRC_TO_DST_SECOND_BYTES"]


@query("u05_cluster_split", with_flows(f"""
, g AS (SELECT {', '.join(_F3)}, min(flow_id) AS gid, count(*) AS n, sum(label) AS bad FROM flows GROUP BY {', '.join(_F3)}),
m AS (SELECT {', '.join(_F3)}, attack, row_number() OVER (PARTITION BY {', '.join(_F3)} ORDER BY count(*) DESC, attack) AS r FROM flows GROUP BY {', '.join(_F3)}, attack),
k AS (SELECT g.*, m.attack AS majority FROM g JOIN m ON r = 1 AND {' AND '.join(f'g.{c} IS NOT DISTINCT FROM m.{c}' for c in _F3)}),
b AS (SELECT gid, coalesce(sum(n) OVER (ORDER BY {_h('gid', 'cl')}, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, sum(n) OVER () AS total FROM k WHERE bad = 0),
s AS (SELECT gid, CASE WHEN run < CAST(0.8 AS DOUBLE) * total THEN 'train' WHEN run < CAST(0.9 AS DOUBLE) * total THEN 'val' ELSE 'test' END AS split FROM b
  UNION ALL SELECT gid, CASE WHEN row_number() OVER (PARTITION BY majority ORDER BY {_h('gid', 'cl')}, gid) <= floor(count(*) OVER (PARTITION BY majority) / 2) THEN 'val' ELSE 'test' END FROM k WHERE bad > 0)
SELECT f.flow_id, s.split FROM flows f JOIN g ON {' AND '.join(f'g.{c} IS NOT DISTINCT FROM f.{c}' for c in _F3)} JOIN s ON s.gid = g.gid"""))  # fmt: skip
def u05(spark: SparkSession, d: str) -> DataFrame:
    return U.cluster_split(flows(spark, d).select("flow_id", "label", "attack", *_F3), _F3, "flow_id", "label", "attack", "cl")


@query("u06_benign_80_20", with_flows(f"SELECT flow_id, CASE WHEN {_PLACE('b82')} <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'select' END AS part FROM flows WHERE label = 0"))
def u06(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).where("label = 0").select("flow_id")
    n = df.agg(F.count("*").alias("n"))  # one row
    return U.places(df, "flow_id", "b82").crossJoin(F.broadcast(n)).select("flow_id", F.when(F.col("place") <= F.floor(F.col("n") * 0.8), "train").otherwise("select").alias("part"))


@query("u07_three_pool_partition", with_flows(f"SELECT flow_id, CASE WHEN {_PLACE('pools')} <= 2000 THEN 'select' WHEN {_PLACE('pools')} <= 3100 THEN 'monitor' ELSE 'gradient' END AS pool FROM flows"))
def u07(spark: SparkSession, d: str) -> DataFrame:
    return U.three_pools(flows(spark, d).select("flow_id"), "flow_id", "pools", 2000, 1100)


@query("u08_random_sample_cap", with_flows(f"SELECT flow_id FROM flows ORDER BY {_h('flow_id', 'cap')}, flow_id LIMIT 500"))
def u08(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the cap is the feature."""
    return U.sample_cap(flows(spark, d).select("flow_id"), "flow_id", "cap", 500)


@query("u09_stratified_sample", with_flows(f"SELECT flow_id FROM (SELECT flow_id, {_PLACE('strat', 'PARTITION BY attack')} AS r, count(*) OVER (PARTITION BY attack) AS n FROM flows) WHERE r <= greatest(1, round(n * CAST(0.1 AS DOUBLE)))"))
def u09(spark: SparkSession, d: str) -> DataFrame:
    return U.stratified_sample(flows(spark, d).select("flow_id", "attack"), "flow_id", "attack", "strat", 0.1).select("flow_id")


@query("u10_balanced_sample", with_flows(f"SELECT flow_id FROM (SELECT flow_id, {_PLACE('bal', 'PARTITION BY label')} AS r FROM flows) WHERE r <= 200"))
def u10(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the cap is the feature."""
    return U.balanced_sample(flows(spark, d).select("flow_id", "label"), "flow_id", "label", "bal", 400).select("flow_id")


@query("u11_contaminate_rate", with_flows(f", k AS (SELECT CAST(round(count(*) * CAST(0.02 AS DOUBLE) / CAST(0.98 AS DOUBLE)) AS BIGINT) AS k FROM flows WHERE label = 0 AND pool = 'train') SELECT flow_id, 0 AS label FROM flows WHERE label = 0 AND pool = 'train' UNION ALL SELECT flow_id, 1 FROM (SELECT flow_id, {_PLACE('con')} AS r FROM flows WHERE label = 1), k WHERE r <= k"))
def u11(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).select("flow_id", "label", "pool")
    return U.contaminate(df.where("label = 0 AND pool = 'train'").drop("pool"), df.where("label = 1").drop("pool"), "flow_id", "con", 0.02)


@query("u12_contaminate_replace", with_flows("SELECT count(*) AS n, CAST(round(count(*) * CAST(0.05 AS DOUBLE)) AS BIGINT) AS n_injected FROM flows WHERE label = 0"))
def u12(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).select("flow_id", "label")
    got = U.inject_evenly(df.where("label = 0"), df.where("label = 1"), "flow_id", "rep", 0.05)
    return got.agg(F.count("*").alias("n"), F.sum("label").alias("n_injected"))


@query("u13_three_way_attack_pools", with_flows(f"SELECT flow_id, CASE WHEN {_PLACE('atk')} <= floor(count(*) OVER () * CAST(0.5 AS DOUBLE)) THEN 'pool' WHEN {_PLACE('atk')} <= floor(count(*) OVER () * CAST(0.75 AS DOUBLE)) THEN 'eval' ELSE 'oracle' END AS part FROM flows WHERE label = 1"))
def u13(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).where("label = 1").select("flow_id")
    n = df.count()
    p = F.col("place")
    return U.places(df, "flow_id", "atk").select("flow_id", F.when(p <= int(n * 0.5), "pool").when(p <= int(n * 0.75), "eval").otherwise("oracle").alias("part"))


@query("u14_exclude_class", with_flows(", c AS (SELECT DISTINCT attack AS excluded FROM flows WHERE label = 1) SELECT excluded, count(*) AS n, round(avg(label), 6) AS prevalence FROM flows, c WHERE attack <> excluded GROUP BY excluded"))
def u14(spark: SparkSession, d: str) -> DataFrame:
    """All folds at once from totals: what a fold leaves out is subtracted, no row is repeated."""
    df = flows(spark, d)
    per = df.groupBy("attack").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    total = per.agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    fold = per.where("bad > 0").crossJoin(F.broadcast(total))
    return fold.select(F.col("attack").alias("excluded"), (F.col("all_n") - F.col("n")).alias("n"), R((F.col("all_bad") - F.col("bad")) / (F.col("all_n") - F.col("n"))).alias("prevalence"))


@query("u15_column_permute", with_flows("SELECT count(*) AS n, CAST(sum(IN_BYTES) AS BIGINT) AS a, CAST(sum(OUT_BYTES) AS BIGINT) AS b FROM flows"))
def u15(spark: SparkSession, d: str) -> DataFrame:
    """Permuting keeps each column's total."""
    got = U.column_permute(flows(spark, d).select("flow_id", "IN_BYTES", "OUT_BYTES"), "flow_id", ["IN_BYTES", "OUT_BYTES"], "perm")
    return got.agg(F.count("*").alias("n"), F.sum("IN_BYTES").alias("a"), F.sum("OUT_BYTES").alias("b"))
