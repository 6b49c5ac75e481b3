"""The whole serving job: captured lines in, repaired, encoded, scored in two stages, decided, alerts out."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import mcc_from_counts
from ..operators import chain
from ..operators.encode import flow_encode
from ..operators.fusion import alarms_of_scores, apply_modes
from ..operators.scoring import Autoencoder, Dense, Whitening, pack, score_flows
from ..sources import flow_files as S
from ..sources.model_files import Model, read_model, write_model
from ..sources.scratch import scratch, written
from ..spec import CONTINUOUS, FAMILY, FEATURES, RAW_COLUMNS
from ..streaming import live
from .files import _raw
from .registry import query

LATENT = 16
KEEP = ("FLOW_START_MILLISECONDS", "IPV4_SRC_ADDR", "IPV4_DST_ADDR", "L4_DST_PORT", "PROTOCOL", "row_status")


def untrained_model() -> Model:
    """Weights from fixed seeds, a plausible scaler and decision parameters: what a file of a trained model would hold."""
    n, k = len(FEATURES), len(CONTINUOUS)
    ae = Autoencoder(Dense.random([n, 64, 32, LATENT], 11), Dense.random([LATENT, 32, 64, n], 12), k)
    wh = Whitening(np.zeros(n), np.eye(n), np.ones(n), 0.0)
    scaler = {c: (6.0, 4.0) for c in CONTINUOUS} | {"L4_SRC_PORT": (33000.0, 18000.0), "L4_DST_PORT": (8000.0, 16000.0)}
    mode = {"mu": [-0.408, 2.913], "sd": [0.0615, 0.974], "tau_z": 1.0, "theta_z": 0.9, "theta_union": None, "tau_hi_z": 1.3}
    return Model(ae, wh, np.zeros(LATENT), np.ones(LATENT), Dense.random([LATENT + n, 48, 24, 1], 13), scaler, decision={"A": mode, "B": mode | {"theta_union": 1.2}})


def scored_flows(flows: DataFrame, model: Model, keep: tuple[str, ...] = KEEP, explain: bool = False) -> DataFrame:
    """(keep, s_dae, logit, s_pa) of captured flows (raw columns as strings): encoded and scored in one pass, without a shuffle.
    explain: alarms of any mode get their standardised residuals, zr."""
    x = flow_encode(flows, model.scaler, model.log_features, keep=keep)
    modes = [{"mu0": p["mu"][0], "mu1": p["mu"][1], "sd0": p["sd"][0], "sd1": p["sd"][1], "theta_union": None, "tau_hi_z": None} | {k: p[k] for k in ("tau_z", "theta_z")} | {k: p.get(k) for k in ("theta_union", "tau_hi_z")} for p in model.decision.values()]

    def alarm(s: np.ndarray, logit: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(s), bool)
        for p in modes:
            # a hair wider, so that every row that is an alarm in the plan has an explanation
            hit |= alarms_of_scores(s * (1 + 1e-5), logit + 1e-4, p)
        return hit

    return score_flows(x, model.ae, model.whitening, model.z_mean, model.z_std, model.clf, keep[0], keep=keep[1:], explain=alarm if explain else None)


def alerts(scored: DataFrame, model: Model, mode: str | None = None) -> DataFrame:
    """Flagged rows under one mode or all, with the branch that fired and the day of the flow; if explained, also
    `why` (features beyond the limit) and `families` (the largest deviation in each family), zr is dropped."""
    params = model.parameters(scored.sparkSession)
    got = apply_modes(scored, params.where(F.col("mode") == mode) if mode else params).where("alarm")
    got = got.withColumn("day", F.to_date(F.timestamp_millis(F.col("FLOW_START_MILLISECONDS").try_cast("long"))))
    if "zr" not in scored.columns:
        return got
    rows = live.alert_rows(got, F.lit(True), "zr", model.features, 3.0, [c for c in got.columns])
    names = sorted({FAMILY.get(f, "other") for f in model.features})
    of = F.array(*[F.lit(names.index(FAMILY.get(f, "other"))) for f in model.features])
    most = lambda i: F.array_max(F.zip_with("zr", of, lambda z, k: F.when(k == i, F.abs(z))))
    families = F.transform(F.array(*map(F.lit, names)), lambda n, i: F.struct(n.alias("family"), most(i).alias("z")))
    return rows.withColumn("families", families).drop("zr")


def run(spark: SparkSession, captured: str, model_folder: str, sink: str, mode: str | None = None, batch: str | None = None) -> DataFrame:
    """Text files of captured flows, each with its header, to explained alerts by day; returns this run's.

    batch names the run in the sink: a run that is repeated replaces its own alerts. Without a name it is a digest of the files' names."""
    model = read_model(spark, model_folder)
    lines = S.capture_lines(spark, captured)
    files = lines.inputFiles()
    batch = batch or hashlib.md5("\n".join(sorted(files)).encode()).hexdigest()
    return S.write_alerts(alerts(scored_flows(S.captured_flows(lines, files=files), model, explain=True), model, mode), sink, batch)


def detection_report(scored: DataFrame, model: Model, attack: str = "Attack", benign: str = "Benign") -> DataFrame:
    """(mode, attack, n, alarms, first_stage): by class, what each mode flags and what the first stage alone would flag at its threshold;
    benign rows give the false alarms."""
    params = model.parameters(scored.sparkSession)
    tau = params.select("mode", F.col("tau_z").alias("tau"))
    got = apply_modes(scored, params).join(F.broadcast(tau), "mode")  # one row a mode
    of = F.coalesce(F.col(attack), F.lit(benign))
    return got.groupBy("mode", of.alias("attack")).agg(F.count("*").alias("n"), F.count_if("alarm").alias("alarms"), F.count_if(F.col("z0") > F.col("tau")).alias("first_stage"))


def rates_of_report(report: DataFrame, benign: str = "Benign") -> DataFrame:
    """(mode, stage, tp, fp, tn, fn, mcc) of the fused decision and of the first stage alone, from detection_report."""
    both = [report.select("mode", F.lit(s).alias("stage"), (F.col("attack") != benign).alias("bad"), "n", F.col(c).alias("hit")) for s, c in (("fused", "alarms"), ("first stage", "first_stage"))]
    total = lambda of, x: F.coalesce(F.sum(F.when(of, x)), F.lit(0))
    bad = F.col("bad")
    got = both[0].unionByName(both[1]).groupBy("mode", "stage").agg(
        total(bad, F.col("hit")).alias("tp"), total(~bad, F.col("hit")).alias("fp"), total(~bad, F.col("n") - F.col("hit")).alias("tn"), total(bad, F.col("n") - F.col("hit")).alias("fn")
    )
    return got.withColumn("mcc", mcc_from_counts(*[F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn")]))


def captured_lines(spark: SparkSession, d: str, header: list[str] = RAW_COLUMNS) -> DataFrame:
    """The flows as captured lines in the order of a header; every seventh has its two series written out, one value a second, and runs over."""
    raw = _raw(spark, d)
    first, second = header.index(S.FIRST), header.index(S.SECOND)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in header]
    if second == first + 1:
        series = F.col("IN_BYTES") % 7 == 0
        text[first] = F.when(series, F.lit("5,6,7")).otherwise(text[first])
        text[second] = F.when(series, F.lit("1,2")).otherwise(text[second])
    return raw.select(F.concat_ws(",", *text).alias("value"))


def write_captures(lines: DataFrame, header: list[str], path: str, mode: str = "errorifexists") -> None:
    """Lines as text files, each of which begins with the header."""
    first = ",".join(header)

    def with_header(batches):
        yield pa.record_batch([pa.array([first])], ["value"])
        for b in batches:
            yield pa.record_batch([b.column(0)], ["value"])

    lines.mapInArrow(with_header, "value string").write.mode(mode).text(path)


LABELLED = [*RAW_COLUMNS, "Label", "Attack"]


@query("serve_flow_alerts")
def serve_flow_alerts(spark: SparkSession, d: str) -> DataFrame:
    """(mode, branch, row_status, n, explained): alerts of all flows, from captured text files and a model folder to the alert sink."""
    captured, folder, sink = (scratch(spark, n) for n in ("captured", "model", "alerts"))
    write_captures(captured_lines(spark, d), RAW_COLUMNS, captured)
    write_model(spark, untrained_model(), folder)
    got = run(spark, captured, folder, sink)
    return got.groupBy("mode", "branch", "row_status").agg(F.count("*").alias("n"), F.count_if(F.size("why") > 0).alias("explained"))


@query("serve_detection_report")
def serve_detection_report(spark: SparkSession, d: str) -> DataFrame:
    """(mode, attack, n, alarms, first_stage): rates by class of labelled captures, the first stage alone beside the fused decision."""
    captured = scratch(spark, "captured")
    write_captures(captured_lines(spark, d, LABELLED), LABELLED, captured)
    model = untrained_model()
    flows = S.captured_flows(S.capture_lines(spark, captured))
    return detection_report(scored_flows(flows, model, keep=(*KEEP, "Attack")), model)


@query("serve_flow_stream")
def serve_flow_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same alerts from a stream of captured files that are removed once they are done."""
    captured, sink, state = (scratch(spark, n) for n in ("captured", "alerts", "stream"))
    write_captures(captured_lines(spark, d), RAW_COLUMNS, captured)
    model = untrained_model()
    stream = live.stream_flows(spark, captured, "value string", "text", files=4, clean="delete").select("value", F.col("_metadata.file_path").alias("file"))
    score = lambda batch: alerts(scored_flows(S.captured_flows(batch), model, explain=True), model)
    live.keep_running(lambda: live.score_to_alerts(stream, score, sink, state))
    return live.read_alerts(spark, sink).groupBy("mode", "branch", "row_status").agg(F.count("*").alias("n"), F.count_if(F.size("why") > 0).alias("explained"))


def distinct_vectors(x: DataFrame) -> DataFrame:
    """(id, x): a packed row for each id, the least of its copies; written, because every pass over it would parse and encode the lines again."""
    rows = pack(x, "x", keep=("id",))
    # in the order of the ids, so that copies follow each other and whole rows are sorted once
    return written(rows.repartition("id").sortWithinPartitions("id").groupBy("id").agg(F.min("x").alias("x")), "vectors")


@query("serve_trained_alerts")
def serve_trained_alerts(spark: SparkSession, d: str) -> DataFrame:
    """(mode, branch, n): the whole circle: captured flows train a model without labels, its folder serves the same captures."""
    captured, folder, sink = (scratch(spark, n) for n in ("captured", "model", "alerts"))
    write_captures(captured_lines(spark, d), RAW_COLUMNS, captured)
    base = untrained_model()
    rows = S.captured_flows(S.capture_lines(spark, captured)).withColumn("id", F.xxhash64(*RAW_COLUMNS))
    x = distinct_vectors(flow_encode(rows, base.scaler, base.log_features, keep=("id",)))
    n = x.count()
    recipe = chain.Recipe([len(FEATURES), 64, 32, LATENT], len(CONTINUOUS), [48, 24], epochs=3, entropy=(2, 0.0), measure="score", cap=2, patience=1, rounds=1, lr=3e-3, second_lr=3e-3, warn_rows=0, least_rows=0, pools=(n // 5, n // 9))
    got = chain.retrain(spark, x, scratch(spark, "chain"), recipe)
    write_model(spark, Model(got.ae, got.whitening, got.z_mean, got.z_std, got.clf, base.scaler, decision=got.decision), folder)
    return run(spark, captured, folder, sink).groupBy("mode", "branch").agg(F.count("*").alias("n"))
