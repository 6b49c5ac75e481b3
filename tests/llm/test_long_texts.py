"""All operators on texts longer than a slice (1 MB): what stands at their ends is found, and whole results equal those of the libraries."""

from __future__ import annotations

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
import public_tokenizers as P  # noqa: E402

from flowspark.llm import coder, decontaminate, fingerprint, jaccard, pieces, pii, quality, shards, token_counts, toxicity  # noqa: E402

ITEM = "the quick harbour of stone keeps forty lamps alight through every winter storm until morning comes"
MAIL = "someone@example.org"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("red", "stone", "quick", "lamp", "été") for b in ("", "s", "worth", "ing") for c in range(60)]
    long = " ".join(rnd.choice(words) for _ in range(210_000))
    assert len(long.encode()) > 1_400_000
    return {1: long, 2: f"{long} {MAIL} {ITEM}", 3: long, 4: "short and plain", 5: ITEM}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sets_and_components(docs, texts):
    got = by_id(jaccard.ngram_jaccard_join(docs))
    for i, t in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in t).split(" ")
        want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
        assert got[i]["n_shingles"] == len(want)
    assert [got[i]["component_id"] for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 4, 5]


def test_ids_and_counts(docs, texts):
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
    assert {i: r["n_tokens"] for i, r in by_id(token_counts.token_counts(docs, P.path("byte_bpe_50k.json"))).items()} == n
    coded = by_id(coder.round_trip(docs, P.path("byte_bpe_50k.json")))
    assert {i: r["n_tokens"] - 1 for i, r in coded.items()} == n and [coded[i]["start"] for i in (1, 2, 3)] == [0, n[1] + 1, n[1] + n[2] + 2] and coded[1]["ids_crc32"] == coded[3]["ids_crc32"]
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in pieces.encode_and_decode(docs, P.path("piece_bpe_32k.model")).collect()}
    for i, x in texts.items():
        assert list(got[i]["ids"]) == sp.encode(x, add_bos=True, add_eos=True)


def test_what_stands_at_the_end_is_found(spark, docs):
    spans = {r["doc_id"]: r for r in pii.personal_data_digest(pii.find_personal_data(docs)).collect()}
    assert [spans[i]["n_email"] for i in (1, 2, 3, 4, 5)] == [0, 1, 0, 0, 0]
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert {r["doc_id"]: r["items"] for r in decontaminate.leaked_documents(docs, items).collect()} == {2: [7], 5: [7]}


def test_scores_and_fingerprints(spark, docs, texts):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 3, 4, 5)], "doc_id long, quality int, toxic int")
    for got in (by_id(quality.quality_scores(docs, labels)), by_id(toxicity.toxicity_scores(docs, labels))):
        assert set(got) == set(texts) and all(0 <= r["score"] <= 1 for r in got.values()) and got[1]["score"] == got[3]["score"]
    prints = by_id(fingerprint.edit_fingerprints(docs))
    assert prints[1]["fingerprint"] == prints[3]["fingerprint"] and prints[1]["near_next"] > 0.99 and prints[4]["near_next"] < 0.5
    assert prints[2]["n_chars"] == len(texts[2])
    size = {r["doc_id"]: r["n_bytes"] for r in shards.extendible_shards(docs).collect()}
    assert size == {i: len(t.encode()) for i, t in texts.items()}
