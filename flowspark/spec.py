"""Fixed values of the flow feature contract, and the schema of raw flow tables.

The lists below must equal those that existing models and files were made with.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------------
APRIORI_DROPS = ["FTP_COMMAND_RET_CODE", "FLOW_START_MILLISECONDS", "FLOW_END_MILLISECONDS", "DNS_QUERY_ID"]
ADDRESS_COLUMNS = ["IPV4_SRC_ADDR", "IPV4_DST_ADDR"]
AUDIT_DROPS = ["MAX_IP_PKT_LEN", "RETRANSMITTED_OUT_PKTS", "RETRANSMITTED_IN_PKTS", "MIN_TTL", "TCP_WIN_MAX_IN", "TCP_FLAGS"]
PORT_BUCKETS = {
    "port_dns": [53],
    "port_rdp": [3389],
    "port_https": [443, 8443],
    "port_http": [80, 8080, 8000, 8888],
    "port_smb": [445],
    "port_ftp": [20, 21],
    "port_ssh": [22],
    "port_smtp": [25, 465, 587],
}
FLAG_BITS = {"fin": 0, "syn": 1, "rst": 2, "psh": 3, "ack": 4, "urg": 5, "ece": 6, "cwr": 7}
SERVER_FLAG_BITS = ["fin", "syn", "rst", "psh", "ack", "ece", "cwr"]
L7_VALUES = [5, 88, 91, 7, 10, 0, 41, 1, 92, 77, 154, 131, 103, 9, 100]
ICMP_VALID_CODES = {0: [0], 3: list(range(16)), 5: [0, 1, 2, 3], 8: [0], 11: [0, 1], 12: [0, 1, 2], 13: [0], 17: [0]}
ICMP_BUCKETS = ["icmp_echo", "icmp_unreach_port", "icmp_unreach_admin", "icmp_unreach_other", "icmp_time_exceeded", "icmp_nonstandard", "icmp_other"]
SECOND_BYTES_CAPS = {"SRC_TO_DST_SECOND_BYTES": 46938.0, "DST_TO_SRC_SECOND_BYTES": 2015.0}
PRESENCE_FLAGS = {"MAX_TTL": "has_ttl", "TCP_WIN_MAX_OUT": "has_tcp_win_out"}
CONTINUOUS = [
    "L4_SRC_PORT", "L4_DST_PORT", "IN_BYTES", "IN_PKTS", "OUT_BYTES", "OUT_PKTS", "FLOW_DURATION_MILLISECONDS",
    "DURATION_IN", "DURATION_OUT", "MAX_TTL", "LONGEST_FLOW_PKT", "SHORTEST_FLOW_PKT", "MIN_IP_PKT_LEN",
    "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES", "RETRANSMITTED_IN_BYTES", "RETRANSMITTED_OUT_BYTES",
    "SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT", "NUM_PKTS_UP_TO_128_BYTES", "NUM_PKTS_128_TO_256_BYTES",
    "NUM_PKTS_256_TO_512_BYTES", "NUM_PKTS_512_TO_1024_BYTES", "NUM_PKTS_1024_TO_1514_BYTES", "TCP_WIN_MAX_OUT",
    "DNS_TTL_ANSWER", "SRC_TO_DST_IAT_MIN", "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_AVG", "SRC_TO_DST_IAT_STDDEV",
    "DST_TO_SRC_IAT_MIN", "DST_TO_SRC_IAT_MAX", "DST_TO_SRC_IAT_AVG", "DST_TO_SRC_IAT_STDDEV",
]
LOG_FEATURES = [
    "DNS_TTL_ANSWER", "DST_TO_SRC_AVG_THROUGHPUT", "DST_TO_SRC_IAT_AVG", "DST_TO_SRC_IAT_MIN", "DST_TO_SRC_SECOND_BYTES",
    "IN_BYTES", "IN_PKTS", "NUM_PKTS_1024_TO_1514_BYTES", "NUM_PKTS_128_TO_256_BYTES", "NUM_PKTS_256_TO_512_BYTES",
    "NUM_PKTS_512_TO_1024_BYTES", "NUM_PKTS_UP_TO_128_BYTES", "OUT_BYTES", "OUT_PKTS", "RETRANSMITTED_IN_BYTES",
    "RETRANSMITTED_OUT_BYTES", "SHORTEST_FLOW_PKT", "SRC_TO_DST_AVG_THROUGHPUT", "SRC_TO_DST_IAT_AVG",
    "SRC_TO_DST_IAT_MIN", "SRC_TO_DST_SECOND_BYTES",
]
#: (mode) -> percentile of the first score, budget of the AND branch, total budget, percentile of the high branch
FUSION_MODES = {"A": (97.0, 0.003, None, 99.8), "B": (99.0, 0.005, 0.01, 99.8)}
RETRAIN_ENTROPY, RETRAIN_WATCHED = (5, 0.01), 262_144
RETRAIN_RATES, RETRAIN_NOISE, RETRAIN_L2 = {"first": 0.002071, "second": 0.0008975201332140938}, 0.15834, 1e-6
#: chance of a radial pseudo-anomaly, least and largest factor
RETRAIN_FAKES = {"train": (0.09261080547245101, 1.9481223527402847, 3.079948793054766), "monitor": (0.19786238154311037, 1.3269568638840954, 3.21621)}
REPLAY_SIZES = [
    464, 53, 164, 75, 297, 103, 137, 260, 166, 118, 129, 303, 88, 278, 147, 233, 219, 45, 341, 180, 428, 245, 203, 328, 225,
    227, 109, 142, 256, 22, 195, 287, 246, 152, 121, 213, 1291, 157, 393, 31, 12, 313, 187, 174, 5, 65, 372, 178, 200, 269,
]
FUSION_PRESETS = {"andonly": None, "rec": 0.01, "high": 0.015}
REFERENCE_BENIGN, REFERENCE_ATTACKS = 1_775_098, 1_046_755
PERCENTILE_GRID = [90.0, 92.0, 94.0, 95.0, 96.0, 97.0, 98.0, 99.0, 99.3, 99.5, 99.7, 99.9]
CLIP = (-10.0, 10.0)
SKEW_LIMIT, RHO_LIMIT, RHO_LABEL_LIMIT, VARIANCE_LIMIT = 5.0, 0.90, 0.10, 0.5
# the columns of a capture, in the order in which they are exported
RAW_COLUMNS = [
    "IPV4_SRC_ADDR", "IPV4_DST_ADDR", "L4_SRC_PORT", "L4_DST_PORT", "PROTOCOL", "L7_PROTO", "IN_BYTES", "OUT_BYTES", "IN_PKTS",
    "OUT_PKTS", "FLOW_DURATION_MILLISECONDS", "TCP_FLAGS", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS", "DURATION_IN", "DURATION_OUT",
    "MIN_TTL", "MAX_TTL", "LONGEST_FLOW_PKT", "SHORTEST_FLOW_PKT", "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN", "SRC_TO_DST_SECOND_BYTES",
    "DST_TO_SRC_SECOND_BYTES", "RETRANSMITTED_IN_BYTES", "RETRANSMITTED_IN_PKTS", "RETRANSMITTED_OUT_BYTES", "RETRANSMITTED_OUT_PKTS",
    "SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT", "NUM_PKTS_UP_TO_128_BYTES", "NUM_PKTS_128_TO_256_BYTES",
    "NUM_PKTS_256_TO_512_BYTES", "NUM_PKTS_512_TO_1024_BYTES", "NUM_PKTS_1024_TO_1514_BYTES", "TCP_WIN_MAX_IN", "TCP_WIN_MAX_OUT",
    "ICMP_TYPE", "ICMP_IPV4_TYPE", "DNS_QUERY_ID", "DNS_QUERY_TYPE", "DNS_TTL_ANSWER", "FTP_COMMAND_RET_CODE",
    "FLOW_START_MILLISECONDS", "FLOW_END_MILLISECONDS", "SRC_TO_DST_IAT_MIN", "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_AVG",
    "SRC_TO_DST_IAT_STDDEV", "DST_TO_SRC_IAT_MIN", "DST_TO_SRC_IAT_MAX", "DST_TO_SRC_IAT_AVG", "DST_TO_SRC_IAT_STDDEV",
]
LABELS = ["Label", "Attack"]
# pool -> share of the rows, and at least and at most so many
POOL_ROWS = {"select": (0.20, 50_000, 355_000), "monitor": (0.11, 30_000, 200_000)}
DNS_TYPES = {"dns_type_a": 1, "dns_type_aaaa": 28}
# ------------------------------------------------------------------------------------------

PORT_FEATURES = [*PORT_BUCKETS, "port_other_low", "port_high"]
#: what each encoder makes, by the family that it is reported under; the order is that of the models' inputs
BINARY_FAMILIES = {
    "protocol": ["proto_tcp", "proto_udp", "proto_other"], "port": PORT_FEATURES, "application": [*[f"l7_{v}" for v in L7_VALUES], "l7_other"],
    "DNS": ["is_dns_flow", *DNS_TYPES, "dns_type_other"], "client TCP flags": [f"client_{b}" for b in FLAG_BITS],
    "server TCP flags": [f"server_{b}" for b in SERVER_FLAG_BITS], "ICMP": ICMP_BUCKETS, "field presence": [*PRESENCE_FLAGS.values()],
}
BINARY = [name for names in BINARY_FAMILIES.values() for name in names]
_BOTH = lambda *names: [f"{side}_{n}" for side in ("SRC_TO_DST", "DST_TO_SRC") for n in names]
RAW_FAMILIES = {
    "port": ["L4_SRC_PORT", "L4_DST_PORT"],
    "volume": ["IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS", *[f"RETRANSMITTED_{s}_{u}" for s in ("IN", "OUT") for u in ("BYTES", "PKTS")], *[c for c in RAW_COLUMNS if c.startswith("NUM_PKTS")]],
    "duration": ["FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT"],
    "throughput": _BOTH("SECOND_BYTES", "AVG_THROUGHPUT"),
    "inter-arrival": _BOTH("IAT_MIN", "IAT_MAX", "IAT_AVG", "IAT_STDDEV"),
    "packet size": ["LONGEST_FLOW_PKT", "SHORTEST_FLOW_PKT", "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN"],
    "TTL": ["MIN_TTL", "MAX_TTL"], "TCP window": ["TCP_WIN_MAX_IN", "TCP_WIN_MAX_OUT"], "DNS": ["DNS_TTL_ANSWER"],
}
FAMILY = {name: family for table in (RAW_FAMILIES, BINARY_FAMILIES) for family, names in table.items() for name in names}
FEATURES = [*CONTINUOUS, *BINARY]

_STRINGS = ("IPV4_SRC_ADDR", "IPV4_DST_ADDR", "Attack")
_INTS = ("L4_SRC_PORT", "L4_DST_PORT", "PROTOCOL")
_DOUBLES = ("L7_PROTO", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES")
EXPECTED_INPUTS = sorted({*CONTINUOUS, "PROTOCOL", "L7_PROTO", "DNS_QUERY_TYPE", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS", "ICMP_TYPE", "ICMP_IPV4_TYPE"})


def raw_schema(labelled: bool = True) -> T.StructType:
    """Schema of a raw flow table: the exported columns, with Label and Attack where labelled."""
    def kind(c: str) -> T.DataType:
        return T.StringType() if c in _STRINGS else T.IntegerType() if c in _INTS else T.DoubleType() if c in _DOUBLES else T.LongType()

    return T.StructType([T.StructField(c, T.ByteType() if c == "Label" else kind(c)) for c in [*RAW_COLUMNS, *(LABELS if labelled else [])]])
