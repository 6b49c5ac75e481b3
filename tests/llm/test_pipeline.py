"""The pipeline against its stages in plain Python, and the driver contract of its queries."""

from __future__ import annotations

import pytest

pytest.importorskip("sentencepiece")
import public_tokenizers as P  # noqa: E402
import sentencepiece  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline as pipeline  # noqa: E402
from flowspark.llm import pii, quality  # noqa: E402
from tests.llm.test_text_operators import brute_components  # noqa: E402


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    scores = quality.quality_scores(docs, spark.read.parquet(f"{data}/labels.parquet"))
    kept = {r["doc_id"]: rows[r["doc_id"]]["text"] for r in scores.collect() if r["predicted"] == 1}
    kept = {k: kept[k] for k, (_, c) in brute_components(kept).items() if k == c}

    def shingles(t):
        w = t.lower().split()
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]

    parts = []
    for t in items:
        s = shingles(t)
        half = (len(s) + 1) // 2
        parts.append((set(s[:half]), set(s[half:])))
    for k in list(kept):
        own = set(shingles(kept[k]))
        for q, a in parts:
            both = (len(q & own) + len(a & own)) / (len(q) + len(a))
            if both >= 0.6 and len(q & own) >= 0.3 * len(q) and len(a & own) >= 0.3 * len(a):
                del kept[k]
                break
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {}
    for k, t in kept.items():
        ids = sp.encode(pii.redacted(t, pii.find_spans(t)), add_bos=True, add_eos=True)
        want[k] = (ids, len(ids), sp.decode(ids))
    got = {r["doc_id"]: (r["ids"], r["n_tokens"], r["text"]) for r in pipeline.run(spark, data).collect()}
    assert got == want and 0 < len(got) < len(rows)


def test_stages_keep_columns_on_an_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert pipeline.STAGES[-1][1](spark, docs, data).count() == 0


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_on_odd_rows(spark, data):
    """Nulls in every column, empty and very long texts, repeated rows and extra columns with names that helpers use."""
    long = " ".join(f"w{i % 1013}" for i in range(20_000))
    prose = "A quiet harbour town lay under the winter sky, and its people went about their work as they had always done."
    rows = [(1, prose, "en", "s", 1, 1, 2, 3, "x"), (1, prose, "en", "s", 1, 1, 2, 3, "x"), (2, prose, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None),
            (3, "", "", "", 0, 0, 0, 0, ""), (4, long, "en", "s", 9, 9, 9, 9, "y"), (5, long + " tail", "en", "s", 9, 9, 9, 9, "y"), (None, prose + " mail a@b.cd", "en", "s", 1, 1, 1, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id int, may int, c0 int, `clean.text` string")
    columns = docs.columns
    for name, stage in pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns, name
    got = sorted(((r["doc_id"] or 0, r["text"], r["clean.text"]) for r in docs.collect()), key=str)
    # of 1, 1 and 2 the first stays; of the long two the lesser id; null ids stay
    assert [g[0] for g in got] == [0, 0, 1, 3, 4] and got[1][1] is None or got[0][1] is None
    assert any(t and t.endswith("mail [EMAIL]") for _, t, _ in got)
    assert pipeline.STAGES[-1][1](spark, docs, data).count() == 5
    assert pipeline.STAGES[0][1](spark, spark.createDataFrame(rows, docs.schema), data).columns == columns
