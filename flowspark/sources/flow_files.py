"""Readers and writers of flow files, run records and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import apart
from ..spec import raw_schema

FIRST, SECOND = "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES"
ANCHORS = ("IN_BYTES", "OUT_BYTES")


def read_flows_csv(spark: SparkSession, path: str, columns: list[str] | None = None, labelled: bool = True, spread: int | None = None) -> DataFrame:
    """A CSV file, folder or glob with a header; gzip by its suffix, bad bytes replaced.

    Columns are taken by the names of the header, in whatever order, and come in the order of the
    contract. A header with unknown or repeated names, or without a column of the contract, is an
    error; so is a folder whose files have different headers (Spark compares each with the first).
    Asking for columns prunes the parse. spread: rows are dealt to so many tasks as they are read, round robin: a gzip file
    is decompressed and parsed by one task, whatever follows need not be.
    """
    known = {f.name: f for f in raw_schema(labelled)}
    header = spark.read.option("header", True).csv(path).columns  # the first line of one file
    unknown, missing = sorted(set(header) - set(known)), [c for c in known if c not in header]
    if unknown or missing or len(header) != len(known):
        raise ValueError(f"header of {path}: unknown columns {unknown}, missing columns {missing}")
    schema = T.StructType([known[c] for c in header])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path)
    rows = df.select(*(columns or known))
    return rows.repartition(spread) if spread else rows


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column; call it once, at the source."""
    real = (T.DoubleType, T.FloatType)
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, real) else F.col(f.name) for f in df.schema])


def csv_to_parquet(spark: SparkSession, path: str, out: str, labelled: bool = True) -> None:
    read_flows_csv(spark, path, labelled=labelled).write.mode("overwrite").option("compression", "snappy").parquet(out)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def repaired_lines(lines: DataFrame, header: list[str], line: str = "value") -> DataFrame:
    """Columns of the header as strings and row_status, from lines of unquoted fields.

    A line with as many fields as the header is taken as it is (ok). A longer one, where the two
    series columns stand together, keeps its head and tail and gets the directional totals
    for the series (repaired). Another longer one is read by place (unrepairable), a shorter
    one has what it has (short). The header line itself must not be among the lines.
    """
    n = len(header)
    i1 = header.index(FIRST) if FIRST in header else -1
    i2 = header.index(SECOND) if SECOND in header else -1
    can = i1 >= 1 and i2 == i1 + 1 and all(a in header for a in ANCHORS)
    tail = n - i2 - 1
    f = F.split(F.col(line), ",", -1)
    size = F.size(f)
    fits = (size > n) & F.lit(can)
    if can:
        anchors = F.array(*[F.element_at(f, header.index(a) + 1) for a in ANCHORS])
        # a start counted from the end is defined for short lines too
        ends = F.slice(f, -tail, tail) if tail else F.array().cast("array<string>")
        mended = F.concat(F.slice(f, 1, i1), anchors, ends)
        fields = F.when(fits, mended).otherwise(f)
    else:
        fields = f
    status = F.when(size == n, "ok").when(fits, "repaired").when(size < n, "short").otherwise("unrepairable")
    out = lines.select(fields.alias("_f"), status.alias("row_status"))
    return out.select(*[F.try_element_at("_f", F.lit(i + 1)).alias(c) for i, c in enumerate(header)], "row_status")


def read_flows_repair(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """repaired_lines of text files (gzip by suffix) that begin with the header."""
    text = spark.read.text(path)
    if header is None:
        header = text.first()[0].split(",")
    first = ",".join(header)
    return repaired_lines(text.where(F.col("value") != first), header)


#: Files are told their header by a broadcast table where there are at most so many.
FILES = 100_000


def capture_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): lines of text files with the file of each."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def captured_flows(lines: DataFrame, labelled: bool = True, files: list[str] | None = None) -> DataFrame:
    """Flows of captured lines (value, file): the raw columns as strings, in the order of the contract, and row_status.

    Every file has its own header line, which names its columns in any order, with the label columns or without;
    those that a file lacks are NULL where they are labels and an error elsewhere. So are unknown
    or repeated names, and a file without a header (files: all there should be). Lines are repaired by the header of their file.
    """
    raw = [f.name for f in raw_schema(False)]
    labels = [f.name for f in raw_schema(True) if f.name not in raw]
    known = {*raw, *labels}
    # every header names the column that repairs count on; no line of data does
    is_header = F.col("value").contains(ANCHORS[0])
    per_file = lines.where(is_header).groupBy("file").agg(F.min("value").alias("header"), F.count_distinct("value").alias("n"))
    found = per_file.groupBy("header").agg(F.count("*").alias("files"), F.max("n").alias("n")).limit(65).collect()
    if len(found) > 64:
        raise ValueError("more than 64 different headers")
    for r in found:
        header = r["header"].split(",")
        unknown, missing = sorted(set(header) - known), [c for c in raw if c not in header]
        if unknown or missing or len(set(header)) != len(header) or r["n"] > 1:
            raise ValueError(f"header of a capture: unknown columns {unknown}, missing columns {missing}, {r['n']} headers in a file")
    if files is not None and sum(r["files"] for r in found) != len(files):
        raise ValueError(f"{len(files) - sum(r['files'] for r in found)} files have no header of known columns")
    parts = []
    plain = lines.where(~is_header)
    which = None if len(found) < 2 else per_file.select("file", "header")
    if which is not None:
        plain = plain.join(F.broadcast(which) if sum(r["files"] for r in found) <= FILES else which.hint("shuffle_hash"), "file")
    for r in found:
        header = r["header"].split(",")
        own = plain if which is None else plain.where(F.col("header") == r["header"])
        got = repaired_lines(own, header)
        parts.append(got.select(*[F.col(c) if c in header else F.lit(None).cast("string").alias(c) for c in (*raw, *(labels if labelled else ()))], "row_status"))
    if not parts:
        return repaired_lines(lines.where("false"), [*raw, *(labels if labelled else ())])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def malformed_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("row_status").agg(F.count("*").alias("n"))


def read_trial_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last record (most seeds completed) of each JSON-lines file; unreadable lines are skipped. columns: trial, schema."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    trial = F.element_at(F.split(F.input_file_name(), "/"), -2)
    cols = rows.columns
    return rows.withColumn("trial", trial).groupBy("trial").agg(F.max_by(F.struct(*cols), "seeds_completed").alias("r")).select("trial", "r.*")


def read_partial_csvs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files of a glob, typed, as one table."""
    return spark.read.schema(schema).option("header", True).csv(path)


def run_parts(path: Column) -> list[Column]:
    """rate, lr and seed from .../rate_<x>/lr_<y>/seed_<n>.json, or folders rate=<x> and so on, as the strings that the path has."""
    return [F.regexp_extract(path, rf"/{k}[_=]([^/]+?)(?:/|\.json$)", 1).alias(k) for k in ("rate", "lr", "seed")]


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON runs below path with rate, lr and seed from their paths."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).json(path)
    return rows.select(*run_parts(F.input_file_name()), "*")


def write_split(df: DataFrame, path: str, split: str = "split", label: str = "label", cls: str = "attack") -> None:
    """Rows by split; refuses rows whose label and class disagree."""
    bad = df.where((F.col(label) == 1) != (F.col(cls) != "Benign")).limit(1).count()
    if bad:
        raise ValueError("label and class disagree")
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_schema_sidecar(spark: SparkSession, kinds: list[tuple[int, str, str]], path: str) -> None:
    spark.createDataFrame(kinds, "ord int, feature string, kind string").coalesce(1).write.mode("overwrite").json(path)


def read_schema_sidecar(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    return [tuple(r) for r in spark.read.schema("ord int, feature string, kind string").json(path).orderBy("ord").collect()]


def write_report_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; NaN as null. Reports are small: one file."""
    without_nan(df).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_table_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A small result table as one CSV file in order."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def checksum(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row n, lane0 ... lane3: an order-free checksum of a multiset of rows.

    The four 32-bit lanes of an MD5 of each row are summed, so that parts add up to the whole. NULL
    counts as the text \\N.
    """
    cols = cols or df.columns
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]))
    lanes = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"lane{i}") for i in range(4)]
    return df.select(h.alias("_h")).agg(F.count("*").alias("n"), *lanes)


def compare_frames(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(column, n_different, max_gap): cell by cell over the union of keys, NULLs equal."""
    cols = [c for c in a.columns if c not in keys and c in b.columns]
    numeric = {f.name for f in a.schema if isinstance(f.dataType, T.NumericType)}
    one, two = apart(keys, "one", "two")
    side = lambda df, name: df.select(*keys, F.struct(*[F.col(f"`{c}`") for c in cols]).alias(name))
    both = side(a, one).join(side(b, two).hint("merge"), keys, "full_outer")
    x, y = F.col(one), F.col(two)
    whole = x.isNotNull() & y.isNotNull()
    gap = lambda c: F.max(F.abs(x[c].cast("double") - y[c])) if c in numeric else F.lit(None).cast("double")
    packed = [F.struct(F.lit(c).alias("column"), F.count_if(~(whole & x[c].eqNullSafe(y[c]))).alias("n_different"), gap(c).alias("max_gap")) for c in cols]
    return both.agg(F.array(*packed).alias("x")).select(F.explode("x").alias("y")).select("y.*")


def write_alerts(alerts: DataFrame, path: str, batch: str, day: str = "day") -> DataFrame:
    """Alerts of one run (batch) by day; a run that is repeated replaces its own. Returns what was written."""
    own = f"{path.rstrip('/')}/batch={batch}"
    alerts.write.mode("overwrite").partitionBy(day).parquet(own)
    kind = alerts.select([c for c in alerts.columns if c != day] + [day]).schema
    return alerts.sparkSession.read.schema(kind).parquet(own)


def alert_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(batch, day, files, bytes) of a sink, from the names and sizes of its files; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    part = lambda k: F.regexp_extract("path", f"/{k}=([^/]*)/", 1)
    return files.groupBy(part("batch").alias("batch"), part("day").alias("day")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def keep_newest_days(spark: SparkSession, path: str, most_bytes: int) -> list[str]:
    """Removes the oldest days of a sink until the rest has at most `most_bytes`; the newest day stays. Returns the days removed."""
    rows = alert_manifest(spark, path).collect()  # one row a batch and day
    size: dict[str, int] = {}
    for r in rows:
        size[r["day"]] = size.get(r["day"], 0) + r["bytes"]
    gone, total = [], sum(size.values())
    for d in sorted(size)[:-1]:
        if total <= most_bytes:
            break
        gone.append(d)
        total -= size[d]
    if gone:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for r in rows:
            if r["day"] in gone:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch={r['batch']}/day={r['day']}"), True)
    return gone
