"""Queries of the row-local encoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import encode as E
from ..operators.metrics import percentile_threshold
from ..spec import EXPECTED_INPUTS, FEATURES, FLAG_BITS, ICMP_BUCKETS, ICMP_VALID_CODES, L7_VALUES, PORT_BUCKETS, PORT_FEATURES, SERVER_FLAG_BITS
from .flow_view import flows, table, with_flows
from .registry import query


def _with(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.select("flow_id", *[c.alias(n) for n, c in cols.items()])


def _b(test: str, name: str) -> str:
    return f"CAST(CASE WHEN {test} THEN 1 ELSE 0 END AS TINYINT) AS {name}"


def _in(values: list) -> str:
    return "(" + ", ".join(map(str, values)) + ")"


_KNOWN = _in([p for ports in PORT_BUCKETS.values() for p in ports])
_PROTO_SQL = ", ".join([_b("PROTOCOL = 6", "proto_tcp"), _b("PROTOCOL = 17", "proto_udp"), _b("PROTOCOL NOT IN (6, 17)", "proto_other")])
_PORT_SQL = ", ".join([*[_b(f"L4_DST_PORT IN {_in(p)}", n) for n, p in PORT_BUCKETS.items()], _b(f"L4_DST_PORT < 1024 AND L4_DST_PORT NOT IN {_KNOWN}", "port_other_low"), _b(f"L4_DST_PORT >= 1024 AND L4_DST_PORT NOT IN {_KNOWN}", "port_high")])
_L7_SQL = ", ".join([*[_b(f"L7_PROTO = {v}", f"l7_{v}") for v in L7_VALUES], _b(f"L7_PROTO NOT IN {_in(L7_VALUES)}", "l7_other")])
_VALID = " OR ".join(f"(t = {k} AND c IN {_in(v)})" for k, v in ICMP_VALID_CODES.items())
_BUCKET_SQL = f"""CASE WHEN PROTOCOL <> 1 THEN NULL WHEN t IN (0, 8) AND c = 0 THEN 'icmp_echo' WHEN t = 3 AND c = 3 THEN 'icmp_unreach_port'
  WHEN t = 3 AND c IN (9, 10, 13) THEN 'icmp_unreach_admin' WHEN t = 3 AND c BETWEEN 0 AND 15 THEN 'icmp_unreach_other' WHEN t = 11 AND c IN (0, 1) THEN 'icmp_time_exceeded'
  WHEN t IN {_in(list(ICMP_VALID_CODES))} AND NOT ({_VALID}) THEN 'icmp_nonstandard' ELSE 'icmp_other' END"""


@query("p01_drop_columns", with_flows("SELECT flow_id, label, attack FROM flows"))
def p01(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d)
    return E.drop_columns(df, [c for c in df.columns if c not in ("flow_id", "label", "attack")] + ["ABSENT"])


@query("p02_filter_dirty_dns", with_flows("SELECT flow_id, DNS_QUERY_TYPE FROM flows WHERE NOT coalesce(DNS_QUERY_TYPE > 255, false)"))
def p02(spark: SparkSession, d: str) -> DataFrame:
    return E.filter_dirty(flows(spark, d)).select("flow_id", "DNS_QUERY_TYPE")


@query("p03_onehot_protocol", with_flows(f"SELECT flow_id, {_PROTO_SQL} FROM flows"))
def p03(spark: SparkSession, d: str) -> DataFrame:
    return _with(flows(spark, d), E.protocol_onehot(F.col("PROTOCOL")))


@query("p04_bucket_ports", with_flows(f"SELECT flow_id, {_PORT_SQL} FROM flows"))
def p04(spark: SparkSession, d: str) -> DataFrame:
    return _with(flows(spark, d), E.port_buckets(F.col("L4_DST_PORT")))


@query("p05_topk_onehot", with_flows("""
, top AS (SELECT l_quantity AS v FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15)
SELECT CASE WHEN l_quantity IN (SELECT v FROM top) THEN 'kept' ELSE 'other' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1"""))
def p05(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_quantity")
    hot = E.value_onehot(F.col("l_quantity"), E.most_frequent(df, "l_quantity"), "q")
    return df.select(hot["q_other"].alias("other")).groupBy(F.when(F.col("other") == 1, "other").otherwise("kept").alias("bucket")).agg(F.count("*").alias("n"))


@query("p06_schema_onehot", with_flows(f"SELECT flow_id, {_L7_SQL} FROM flows"))
def p06(spark: SparkSession, d: str) -> DataFrame:
    return _with(flows(spark, d), E.value_onehot(F.col("L7_PROTO"), L7_VALUES))


@query("p07_dns_type_flags", with_flows("SELECT flow_id, " + ", ".join([_b("DNS_QUERY_TYPE > 0", "is_dns_flow"), _b("DNS_QUERY_TYPE = 1", "dns_type_a"), _b("DNS_QUERY_TYPE = 28", "dns_type_aaaa"), _b("DNS_QUERY_TYPE > 0 AND DNS_QUERY_TYPE NOT IN (1, 28)", "dns_type_other")]) + " FROM flows"))
def p07(spark: SparkSession, d: str) -> DataFrame:
    return _with(flows(spark, d), E.dns_flags(F.col("DNS_QUERY_TYPE")))


@query("p08_bit_flags_auto", with_flows(", n AS (SELECT count(*) AS n FROM flows), s AS (" + " UNION ALL ".join(f"SELECT 'client_{b}' AS bit, sum((CLIENT_TCP_FLAGS >> {i}) & 1) AS n_set FROM flows" for b, i in FLAG_BITS.items()) + ") SELECT bit, CAST(n_set AS BIGINT) AS n_set FROM s, n WHERE n_set BETWEEN 100 AND n - 100"))
def p08(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d)
    bits = E.informative_bits(df, {"client": "CLIENT_TCP_FLAGS"})["client"]
    made = E.bit_flags(F.col("CLIENT_TCP_FLAGS"), "client", bits)
    return df.agg(*[F.sum(x.cast("long")).alias(n) for n, x in made.items()]).unpivot([], list(made), "bit", "n_set") if made else spark.createDataFrame([], "bit string, n_set long")


@query("p09_bit_flags_schema", with_flows("SELECT flow_id, " + ", ".join(_b(f"(SERVER_TCP_FLAGS >> {FLAG_BITS[b]}) & 1 = 1", f"server_{b}") for b in SERVER_FLAG_BITS) + " FROM flows"))
def p09(spark: SparkSession, d: str) -> DataFrame:
    return _with(flows(spark, d), E.bit_flags(F.col("SERVER_TCP_FLAGS"), "server", SERVER_FLAG_BITS, guard=True))


@query("p10_icmp_buckets", with_flows(f", b AS (SELECT flow_id, {_BUCKET_SQL} AS bucket FROM (SELECT *, ICMP_IPV4_TYPE AS t, ICMP_TYPE - 256 * ICMP_IPV4_TYPE AS c FROM flows)) SELECT flow_id, " + ", ".join(_b(f"bucket = '{n}'", n) for n in ICMP_BUCKETS) + " FROM b"))
def p10(spark: SparkSession, d: str) -> DataFrame:
    return _with(flows(spark, d), E.icmp_buckets(F.col("PROTOCOL") == 1, F.col("ICMP_IPV4_TYPE"), F.col("ICMP_TYPE")))


@query("p11_cap_nonfinite", with_flows("SELECT flow_id, CASE WHEN isinf(SRC_TO_DST_SECOND_BYTES) THEN 46938 ELSE coalesce(SRC_TO_DST_SECOND_BYTES, 0) END AS v FROM flows"))
def p11(spark: SparkSession, d: str) -> DataFrame:
    return _with(flows(spark, d), {"v": E.cap_nonfinite(F.col("SRC_TO_DST_SECOND_BYTES"), 46938)})


@query("p12_nan_to_zero", with_flows("SELECT flow_id, CASE WHEN isinf(SRC_TO_DST_SECOND_BYTES) THEN 0 ELSE coalesce(SRC_TO_DST_SECOND_BYTES, 0) END AS v FROM flows"))
def p12(spark: SparkSession, d: str) -> DataFrame:
    return _with(flows(spark, d), {"v": E.nonfinite_to_zero(F.col("SRC_TO_DST_SECOND_BYTES"))})


@query("p13_presence_flag", with_flows("SELECT flow_id, " + ", ".join([_b("MAX_TTL > 0", "has_ttl"), _b("TCP_WIN_MAX_OUT > 0", "has_tcp_win_out")]) + " FROM flows"))
def p13(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d)
    return _with(df, {"has_ttl": E.presence_flag(df, "MAX_TTL"), "has_tcp_win_out": E.presence_flag(df, "TCP_WIN_MAX_OUT")})


_NUMERIC = [
    "flow_id", "start_ms", "PROTOCOL", "L4_DST_PORT", "L4_SRC_PORT", "L7_PROTO", "DNS_QUERY_TYPE", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS", "ICMP_IPV4_TYPE",
    "ICMP_TYPE", "IN_BYTES", "OUT_BYTES", "MAX_TTL", "TCP_WIN_MAX_OUT", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES", "s_dae", "logit",
]
KINDS_SQL = with_flows(" UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS ord, '{c}' AS feature, 'continuous' AS kind, count({c}) AS n FROM flows" for i, c in enumerate(_NUMERIC)))


@query("p14_tag_feature_kinds", KINDS_SQL)
def p14(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d)
    counts = df.agg(*[F.count(c).alias(c) for _, c, _ in E.feature_kinds(df)]).unpivot([], [c for _, c, _ in E.feature_kinds(df)], "feature", "n")
    return counts.join(F.broadcast(spark.createDataFrame(E.feature_kinds(df), "ord int, feature string, kind string")), "feature")


_KINDS = [(0, "IN_BYTES", "continuous"), (1, "ABSENT", "continuous"), (2, "port_dns", "binary"), (3, "absent_flag", "binary")]


@query("p15_align_to_schema", with_flows(f"SELECT IN_BYTES, CAST(NULL AS DOUBLE) AS ABSENT, {_b('L4_DST_PORT = 53', 'port_dns')}, CAST(0 AS TINYINT) AS absent_flag, label AS Label, attack AS Attack FROM flows"))
def p15(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d)
    made = df.select("IN_BYTES", "OUT_BYTES", E.port_buckets(F.col("L4_DST_PORT"))["port_dns"].alias("port_dns"), F.col("label").alias("Label"), F.col("attack").alias("Attack"))
    return E.align(made, _KINDS)


@query("p16_reduce_features", with_flows("SELECT IN_BYTES, MAX_TTL, TCP_WIN_MAX_OUT, " + ", ".join([_b("MAX_TTL > 0", "has_ttl"), _b("TCP_WIN_MAX_OUT > 0", "has_tcp_win_out")]) + ", label AS Label FROM flows"))
def p16(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).select("IN_BYTES", "MAX_TTL", "TCP_WIN_MAX_OUT", F.lit(0).alias("TCP_FLAGS"), F.lit(0).alias("MIN_TTL"), F.col("label").alias("Label"))
    return E.reduce_features(df)


@query("p17_lenient_cast_float", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN 'x' ELSE CAST(event_id AS VARCHAR) || '.5' END AS DOUBLE), 0) AS v FROM events")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.lenient_double(_messy(".5")).alias("v"))


@query("p18_lenient_cast_int", "SELECT event_id, CAST(trunc(coalesce(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN 'x' ELSE CAST(event_id AS VARCHAR) || '.7' END AS DOUBLE), 0)) AS BIGINT) AS v FROM events")
def p18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.lenient_long(_messy(".7")).alias("v"))


def _messy(tail: str) -> Column:
    i = F.col("event_id")
    return F.when(i % 7 == 0, "").when(i % 7 == 1, "x").otherwise(F.concat(i.cast("string"), F.lit(tail)))


@query("p19_log1p_columns", with_flows("SELECT flow_id, round(ln(1 + greatest(CAST(IN_BYTES AS DOUBLE), 0)), 6) AS v FROM flows"))
def p19(spark: SparkSession, d: str) -> DataFrame:
    return _with(flows(spark, d), {"v": F.round(E.log1p(F.col("IN_BYTES"), f32=False), 6)})


@query("p20_zscore_columns", with_flows("SELECT flow_id, round((IN_BYTES - 2500) / CAST(1200 AS DOUBLE), 6) AS v FROM flows"))
def p20(spark: SparkSession, d: str) -> DataFrame:
    return _with(flows(spark, d), {"v": F.round(E.zscore(F.col("IN_BYTES"), 2500.0, 1200.0), 6)})


@query("p21_clip_columns", with_flows("SELECT flow_id, round(greatest(-10, least(10, (IN_BYTES - 2500) / CAST(100 AS DOUBLE))), 6) AS v FROM flows"))
def p21(spark: SparkSession, d: str) -> DataFrame:
    return _with(flows(spark, d), {"v": F.round(E.clip(E.zscore(F.col("IN_BYTES"), 2500.0, 100.0)), 6)})


@query("p22_assemble_vector", with_flows("SELECT flow_id, [CAST(IN_BYTES AS FLOAT), CAST(0 AS FLOAT), CAST(MAX_TTL AS FLOAT)] AS x FROM flows"))
def p22(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d)
    return df.select("flow_id", E.assemble(df, ["IN_BYTES", "ABSENT", "MAX_TTL"]).alias("x"))


_ENCODED = {"IN_BYTES": "ln(1 + greatest(CAST(IN_BYTES AS DOUBLE), 0))", "SRC_TO_DST_SECOND_BYTES": "ln(1 + CASE WHEN isinf(SRC_TO_DST_SECOND_BYTES) THEN 46938 ELSE coalesce(SRC_TO_DST_SECOND_BYTES, 0) END)", "proto_tcp": "CASE WHEN PROTOCOL = 6 THEN 1 ELSE 0 END", "has_ttl": "CASE WHEN MAX_TTL > 0 THEN 1 ELSE 0 END", "IN_PKTS": "0"}


@query("p23_flow_encode", with_flows("SELECT flow_id, CAST(91 AS INTEGER) AS width, " + ", ".join(f"round(CAST({x} AS DOUBLE), 3) AS {c}" for c, x in _ENCODED.items()) + " FROM flows"))
def p23(spark: SparkSession, d: str) -> DataFrame:
    x = E.flow_encode(flows(spark, d), keep=("flow_id",))
    return x.select("flow_id", F.size("x").alias("width"), *[F.round(F.element_at("x", FEATURES.index(c) + 1).cast("double"), 3).alias(c) for c in _ENCODED])


@query("p24_flow_encode_fit")
def p24(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).drop("flow_id", "start_ms", "s_dae", "logit", "pool").withColumnsRenamed({"label": "Label", "attack": "Attack"})
    coded, kinds = E.flow_encode_fit(df)
    return coded.agg(*[F.sum(F.col(c).cast("double")).alias(c) for _, c, _ in kinds]).unpivot([], [c for _, c, _ in kinds], "feature", "total")


@query("p25_missing_input_columns", with_flows(f"SELECT count(*) AS rows, unnest({[c for c in EXPECTED_INPUTS if c not in _NUMERIC]}) AS missing FROM flows"))
def p25(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d)
    missing = E.missing_inputs(df.columns)
    return df.agg(F.count("*").alias("rows")).select("rows", F.explode(F.array(*map(F.lit, missing))).alias("missing"))


@query("p26_filter_label", with_flows("SELECT flow_id FROM flows WHERE label = 0 AND L4_SRC_PORT NOT IN (2048, 4096) AND L4_DST_PORT NOT IN (2048, 80)"))
def p26(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).where("label = 0")
    return df.where(~F.col("L4_SRC_PORT").isin(2048, 4096) & ~F.col("L4_DST_PORT").isin(2048, 80)).select("flow_id")


@query("p27_nan_report", with_flows("SELECT 'SRC_TO_DST_SECOND_BYTES' AS feature, count(*) FILTER (SRC_TO_DST_SECOND_BYTES IS NULL) AS n_null FROM flows UNION ALL SELECT 'IN_BYTES', count(*) FILTER (IN_BYTES IS NULL) FROM flows"))
def p27(spark: SparkSession, d: str) -> DataFrame:
    return column_counts(flows(spark, d), ["SRC_TO_DST_SECOND_BYTES", "IN_BYTES"], lambda c: c.isNull(), "n_null")


@query("p28_negative_report", with_flows("SELECT 'logit' AS feature, count(*) FILTER (logit < 0) AS n_negative FROM flows UNION ALL SELECT 'IN_BYTES', count(*) FILTER (IN_BYTES < 0) FROM flows"))
def p28(spark: SparkSession, d: str) -> DataFrame:
    return column_counts(flows(spark, d), ["logit", "IN_BYTES"], lambda c: c < 0, "n_negative")


def column_counts(df: DataFrame, cols: list[str], test, name: str) -> DataFrame:
    """How often the test holds in each column: one aggregation, then one row per column."""
    return df.agg(*[F.count_if(test(F.col(c))).alias(c) for c in cols]).unpivot([], cols, "feature", name)


@query("p29_feature_family", with_flows("SELECT pool, 'port' AS family, count(*) AS n FROM flows GROUP BY pool UNION ALL SELECT pool, 'volume', count(*) FROM flows GROUP BY pool"))
def p29(spark: SparkSession, d: str) -> DataFrame:
    long = flows(spark, d).select("pool", F.explode(F.array(F.lit("L4_DST_PORT"), F.lit("OUT_BYTES"))).alias("feature"))
    return long.groupBy("pool", E.feature_family(F.col("feature")).alias("family")).agg(F.count("*").alias("n"))


@query("phase1_detection_rate", with_flows(", t AS (SELECT quantile_cont(s_dae, 0.99) AS tau FROM flows WHERE label = 0 AND pool = 'select') SELECT attack, round(avg(CASE WHEN s_dae > tau THEN 1.0 ELSE 0.0 END), 6) AS dr, count(*) AS n FROM flows, t WHERE pool = 'test' GROUP BY attack"))
def detection_rate(spark: SparkSession, d: str) -> DataFrame:
    """Detection rate of every class at 1 % false alarms on held-out benign rows."""
    df = flows(spark, d).select("attack", "label", "pool", "s_dae")
    tau = percentile_threshold(df.where("label = 0 AND pool = 'select'"), "s_dae", 0.01)
    hit = df.where("pool = 'test'").crossJoin(F.broadcast(tau)).withColumn("hit", (F.col("s_dae") > F.col("tau")).cast("double"))
    return hit.groupBy("attack").agg(F.round(F.avg("hit"), 6).alias("dr"), F.count("*").alias("n"))



@query("k01_topk_values", with_flows("SELECT L4_DST_PORT AS port, count(*) AS n FROM flows GROUP BY 1 ORDER BY n DESC, port LIMIT 20"))
def k01(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    return flows(spark, d).groupBy(F.col("L4_DST_PORT").alias("port")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "port").limit(20)


assert len(PORT_FEATURES) == 10
