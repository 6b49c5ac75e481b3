"""A flow table over the `events` table: every event is a flow, its fields follow from hashes of its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash32, uniform
from ..spec import L7_VALUES

_PORTS = [53, 443, 80, 22, 445, 3389, 25, 8080, 21, 8443, 123, 999, 5000, 49152, 60000, 3306]
_L7 = [*map(float, L7_VALUES), 7.37, 200.0, 201.0, 91.126, 5.0]
_DNS, _ICMP = [1, 28, 15, 300], [8, 0, 3, 3, 3, 11, 5, 13, 99]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow table; columns are pruned, so a query pays for the fields it uses only."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    # every hash once, as a column that the fields below refer to
    salts = ("p", "dp", "sp", "l7", "dq", "cf", "sf", "it", "ic", "ob", "tt", "tw", "sb", "db", "pool")
    e = e.select("*", *[hash32(F.col("event_id"), s).alias(f"h_{s}") for s in salts], *[uniform(F.col("event_id"), s).alias(f"u_{s}") for s in ("s", "s2", "lg")])
    h = lambda s: F.col(f"h_{s}")
    u = lambda s: F.col(f"u_{s}")

    def pick(values: list, salt: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (h(salt) % len(values) + 1).cast("int"))

    label = F.when(F.col("event_type") == "error", 1).otherwise(0)
    p = h("p") % 100
    base = e.select(
        F.col("event_id").alias("flow_id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("start_ms"), label.alias("label"),
        F.when(label == 1, F.concat(F.lit("class_"), (F.col("user_id") % 3).cast("string"))).otherwise("Benign").alias("attack"),
        F.when(p < 60, 6).when(p < 90, 17).when(p < 97, 1).otherwise(47).alias("PROTOCOL"),
        pick(_PORTS, "dp").alias("L4_DST_PORT"), (1024 + h("sp") % 64512).alias("L4_SRC_PORT"), pick(_L7, "l7").alias("L7_PROTO"),
        pick(_DNS, "dq").alias("dq"), (h("cf") % 256).alias("cf"), (h("sf") % 256).alias("sf"), pick(_ICMP, "it").alias("it"), (h("ic") % 18).alias("ic"),
        F.floor(F.col("value") * 100).cast("long").alias("IN_BYTES"), (h("ob") % 100000).alias("OUT_BYTES"),
        F.when(h("tt") % 4 == 0, 0).otherwise(64).alias("MAX_TTL"), F.when(h("tw") % 3 == 0, 0).otherwise(h("tw") % 65536).alias("TCP_WIN_MAX_OUT"),
        F.when(h("sb") % 50 == 0, F.lit(float("inf"))).when(h("sb") % 50 != 1, (h("sb") % 5000).cast("double")).alias("SRC_TO_DST_SECOND_BYTES"),
        (h("db") % 2000).cast("double").alias("DST_TO_SRC_SECOND_BYTES"),
        (F.lit(0.01) * (u("s") * u("s") + F.lit(0.5) * label * u("s2"))).alias("s_dae"), (F.lit(12.0) * u("lg") - F.lit(8.0) + F.lit(3.0) * label).alias("logit"),
        F.when(h("pool") % 10 < 6, "train").when(h("pool") % 10 < 8, "select").otherwise("test").alias("pool"),
    )
    return base.select(
        "flow_id", "start_ms", "label", "attack", "PROTOCOL", "L4_DST_PORT", "L4_SRC_PORT", "L7_PROTO",
        F.when(F.col("L4_DST_PORT") == 53, F.col("dq")).otherwise(0).alias("DNS_QUERY_TYPE"),
        F.when(F.col("PROTOCOL") == 6, F.col("cf")).otherwise(0).alias("CLIENT_TCP_FLAGS"), F.when(F.col("PROTOCOL") == 6, F.col("sf")).otherwise(0).alias("SERVER_TCP_FLAGS"),
        F.when(F.col("PROTOCOL") == 1, F.col("it")).otherwise(0).alias("ICMP_IPV4_TYPE"), F.when(F.col("PROTOCOL") == 1, F.col("it") * 256 + F.col("ic")).otherwise(0).alias("ICMP_TYPE"),
        "IN_BYTES", "OUT_BYTES", "MAX_TTL", "TCP_WIN_MAX_OUT", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES", "s_dae", "logit", "pool",
    )


def _h(salt: str) -> str:
    return f"CAST('0x' || substr(md5(concat(CAST(event_id AS VARCHAR), ':{salt}')), 1, 8) AS BIGINT)"


def _pick(values: list, salt: str) -> str:
    return f"[{', '.join(map(str, values))}][{_h(salt)} % {len(values)} + 1]"


_U = lambda s: f"({_h(s)} / CAST(4294967296.0 AS DOUBLE))"
_D = lambda x: f"CAST({x} AS DOUBLE)"

FLOWS_SQL = f"""
raw_flows AS (
  SELECT event_id AS flow_id, epoch_us(ts) // 1000 AS start_ms, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, user_id,
    {_h("p")} % 100 AS p, {_pick(_PORTS, "dp")} AS L4_DST_PORT, 1024 + {_h("sp")} % 64512 AS L4_SRC_PORT,
    [{", ".join(_D(v) for v in _L7)}][{_h("l7")} % {len(_L7)} + 1] AS L7_PROTO, {_pick(_DNS, "dq")} AS dq, {_h("cf")} % 256 AS cf, {_h("sf")} % 256 AS sf,
    {_pick(_ICMP, "it")} AS it, {_h("ic")} % 18 AS ic, CAST(floor(value * 100) AS BIGINT) AS IN_BYTES, {_h("ob")} % 100000 AS OUT_BYTES,
    CASE WHEN {_h("tt")} % 4 = 0 THEN 0 ELSE 64 END AS MAX_TTL, CASE WHEN {_h("tw")} % 3 = 0 THEN 0 ELSE {_h("tw")} % 65536 END AS TCP_WIN_MAX_OUT,
    CASE WHEN {_h("sb")} % 50 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN {_h("sb")} % 50 <> 1 THEN CAST({_h("sb")} % 5000 AS DOUBLE) END AS SRC_TO_DST_SECOND_BYTES,
    CAST({_h("db")} % 2000 AS DOUBLE) AS DST_TO_SRC_SECOND_BYTES, {_U("s")} AS us, {_U("s2")} AS us2, {_U("lg")} AS ulg, {_h("pool")} % 10 AS hp
  FROM events
), flows AS (
  SELECT flow_id, start_ms, label, CASE WHEN label = 1 THEN 'class_' || (user_id % 3) ELSE 'Benign' END AS attack,
    PROTOCOL, L4_DST_PORT, L4_SRC_PORT, L7_PROTO, CASE WHEN L4_DST_PORT = 53 THEN dq ELSE 0 END AS DNS_QUERY_TYPE,
    CASE WHEN PROTOCOL = 6 THEN cf ELSE 0 END AS CLIENT_TCP_FLAGS, CASE WHEN PROTOCOL = 6 THEN sf ELSE 0 END AS SERVER_TCP_FLAGS,
    CASE WHEN PROTOCOL = 1 THEN it ELSE 0 END AS ICMP_IPV4_TYPE, CASE WHEN PROTOCOL = 1 THEN it * 256 + ic ELSE 0 END AS ICMP_TYPE,
    IN_BYTES, OUT_BYTES, MAX_TTL, TCP_WIN_MAX_OUT, SRC_TO_DST_SECOND_BYTES, DST_TO_SRC_SECOND_BYTES,
    {_D("0.01")} * (us * us + {_D("0.5")} * label * us2) AS s_dae, {_D("12.0")} * ulg - {_D("8.0")} + {_D("3.0")} * label AS logit,
    CASE WHEN hp < 6 THEN 'train' WHEN hp < 8 THEN 'select' ELSE 'test' END AS pool
  FROM (SELECT *, CASE WHEN p < 60 THEN 6 WHEN p < 90 THEN 17 WHEN p < 97 THEN 1 ELSE 47 END AS PROTOCOL FROM raw_flows)
)"""


def with_flows(sql: str, recursive: bool = False) -> str:
    """DuckDB SQL over `flows`; sql starts with SELECT or with further common tables (`, name AS (...) SELECT`)."""
    return f"WITH {'RECURSIVE ' * recursive}{FLOWS_SQL} {sql}"
