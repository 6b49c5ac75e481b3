"""Column expressions: deterministic hashes, guarded maths, rates, lenient casts.

Everything here stays inside code generation; nothing is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import REFERENCE_ATTACKS, REFERENCE_BENIGN


def hash32(key: Column, salt: str) -> Column:
    """A 32-bit hash of the key under a salt, the same in any SQL engine: hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 8), 16, 10).cast("long")


def uniform(key: Column, salt: str) -> Column:
    """hash32 / 2**32: uniform in [0, 1)."""
    return hash32(key, salt) / F.lit(4294967296.0)


def null_nan(c: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(c), c)


def log10_floor(c: Column, floor: float = 1e-12) -> Column:
    return F.log10(F.greatest(c.cast("double"), F.lit(floor)))


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(q / (1 - q))


def sigmoid(x: Column, bound: float = 80.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), x))))


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double, NULL where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def mcc_from_counts(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Matthews correlation; 0 where a margin is empty."""
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0)


def mcc_balanced(fpr: Column, recall: Column, benign: float | Column = REFERENCE_BENIGN, attacks: float | Column = REFERENCE_ATTACKS) -> Column:
    """MCC of the confusion matrix that these rates give at a reference population."""
    b = benign if isinstance(benign, Column) else F.lit(float(benign))
    a = attacks if isinstance(attacks, Column) else F.lit(float(attacks))
    return mcc_from_counts(recall * a, fpr * b, (1 - fpr) * b, (1 - recall) * a)


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval; NULL for n <= 0."""
    n = F.when(n > 0, n.cast("double"))
    d = 1 + z * z / n
    c = (p + z * z / (2 * n)) / d
    h = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return c - h, c + h


def attacks_for_rate(n: Column, rate: float) -> Column:
    """How many attacks beside n benign rows make this prevalence."""
    return F.round(n * rate / (1 - rate)).cast("long")


def lenient_double(c: Column) -> Column:
    """Numbers as double; empty and unreadable strings as 0. Empty ones are told apart first: a failed cast is dear."""
    return F.coalesce(F.when(c != "", c.try_cast("double")), F.lit(0.0))


def lenient_long(c: Column) -> Column:
    """Numbers truncated to whole ones, clamped to 64 bits; empty, unreadable and NaN as 0."""
    return whole_number(lenient_double(c))


def whole_number(d: Column) -> Column:
    """A double truncated to a whole number, clamped to 64 bits; NaN as 0. It is used several times: better a column than an expression."""
    d = F.when(F.isnan(d), F.lit(0.0)).otherwise(d)
    top = float(2**63)
    return F.when(d >= top, F.lit(2**63 - 1)).when(d <= -top, F.lit(-(2**63))).otherwise(d.try_cast("long"))


def iso_utc(millis: Column) -> Column:
    """Epoch milliseconds as ISO-8601 in UTC with milliseconds; the current time where missing or <= 0."""
    t = F.when(millis > 0, F.timestamp_millis(millis))
    return F.date_format(F.coalesce(t, F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def protocol_name(number: Column) -> Column:
    known = {1: "ICMP", 6: "TCP", 17: "UDP"}
    out = F.concat(F.lit("P"), number.cast("string"))
    for k, v in known.items():
        out = F.when(number == k, v).otherwise(out)
    return out

