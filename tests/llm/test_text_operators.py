"""The ten operators against their libraries, brute force, SQL or held-out labels, and edge cases of their inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
import public_tokenizers as P  # noqa: E402

from flowspark.llm import chunks, coder, decontaminate, fingerprint, jaccard, pieces, pii, quality, shards, sql, token_counts, toxicity, words  # noqa: E402

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, id string"


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, clashing column names, a long text."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "a b c d e f", "en", "s", 11, "x", "y"), (1, "a b c d e f", "en", "s", 11, "x", "y"), (2, None, None, None, None, None, None), (3, "", "", "", 0, "", ""),
            (4, " \n\t ", "en", "s", 3, "x", "y"), (None, "a b c d e f", "en", "s", 11, "x", "y"), (5, long, "en", "s", len(long), "x", "y"), (6, long + " tail", "en", "s", 0, "x", "y"), (7, "one", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(data, query, order="doc_id"):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c.execute(f"SELECT * FROM ({query}) ORDER BY {order}").df()


def same(df, want, order="doc_id"):
    got = df.toPandas().sort_values(order)[list(want.columns)].reset_index(drop=True)
    assert len(got) == len(want)
    for c in want.columns:
        assert [x.tolist() if isinstance(x, np.ndarray) else x for x in got[c]] == [x.tolist() if isinstance(x, np.ndarray) else x for x in want[c]], c


# --- 1 ---------------------------------------------------------------------------------------
def test_shards_equal_sql(docs, data):
    same(shards.extendible_shards(docs, 20_000), duck(data, sql.EXTENDIBLE_SHARDS.replace("1048576", "20000")))


def test_shards_of_edge_cases(spark, edge, none):
    got = shards.extendible_shards(edge, 8).collect()
    assert len(got) == 9 and all(r["shard_bytes"] <= 8 or r["n_bytes"] > 8 for r in got)
    hot = spark.range(50).select(F.lit(1).cast("long").alias("doc_id"), F.lit("abcd").alias("text"))
    pages = shards.extendible_shards(hot, 16).collect()
    assert len(pages) == 50 and max(r["shard_bytes"] for r in pages) <= 16 and len({r["page"] for r in pages}) == 13
    assert shards.extendible_shards(none).count() == 0


# --- 2 ---------------------------------------------------------------------------------------
def test_jaccard_equals_sql(docs, data):
    same(jaccard.ngram_jaccard_join(docs), duck(data, sql.NGRAM_JACCARD_JOIN))


def brute_components(texts):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("block,rounds", [(256, 3), (8, 3), (4, 1), (6, 0)])
def test_large_regions_are_joined_exactly(spark, block, rounds):
    """A large group of near copies around the threshold: regions recurse, then join block against block."""
    rng = random.Random(block)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"x{i}_{rng.randrange(1000)}"
        texts[i] = " ".join(w)
    texts |= {100 + i: " ".join([*base[:20], *[f"u{i}_{j}" for j in range(30)]]) for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard_join(df, block=block, rounds=rounds).collect()}
    assert got == brute_components(texts)


def test_jaccard_edge_cases(edge, none):
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard_join(edge).collect()))
    assert [g for g in got if g[0] <= 1] == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]
    assert [g for g in got if g[0] in (2, 3, 4)] == [(2, 0, 2), (3, 0, 3), (4, 0, 4)]
    assert [g[2] for g in got if g[0] in (5, 6)] == [5, 5] and (7, 1, 7) in got
    assert jaccard.ngram_jaccard_join(none).count() == 0
    kept = jaccard.without_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert jaccard.without_near_duplicates(none).count() == 0


# --- 3 ---------------------------------------------------------------------------------------
def brute_ids(rows):
    tok = tokenizers.Tokenizer.from_file(BPE)
    out, start = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((k, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_id_file_round_trip(docs, texts, edge, none):
    for df, rows in ((docs, list(texts.items())), (edge, [(r["doc_id"], r["text"]) for r in edge.collect()])):
        got = coder.round_trip(df, BPE).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == brute_ids(rows)
    assert coder.round_trip(none, BPE).count() == 0


def test_blocks_round_trip_and_damage():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, 3000), rng.zipf(1.3, 4096) % 50_000, np.zeros(0, int), np.asarray([65535]), np.full(4096, 7), np.tile([1, 2, 3], 700)]
    made = coder.encode_blocks(blocks)
    assert all((x == y).all() for x, y in zip(blocks, coder.decode_blocks(made, [len(b) for b in blocks])))
    assert len(made[4]) < 400 and len(made[5]) < 300


def test_damage_of_any_part_of_a_file_is_refused(spark, tmp_path):
    """Blocks dropped, repeated, swapped and changed byte by byte; frames and parts that are missing."""
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["stone", "lamp", "red", "winter", "x1"]) for _ in range(n)) for n in (9000, 3, 0, 7000, 1)]
    rows = pa.RecordBatch.from_pydict({"part": pa.array([0] * 5, pa.int32()), "id": pa.array(range(5), pa.int64()), "text": texts})
    made = [r for b in coder._written_blocks(BPE, 2)(iter([rows])) for r in b.to_pylist()]
    schema = next(coder._written_blocks(BPE, 2)(iter([rows]))).schema
    read = lambda got: [r for b in coder._read_blocks(iter([pa.RecordBatch.from_pylist(got, schema=schema)])) for r in b.to_pylist()]
    assert len(made) > 3 and [r["id"] for r in read(made)] == [0, 1, 2, 3, 4]
    cases = [made[:1] + made[2:], made[:-1], made[1:], [*made[:2], made[1], *made[2:]], [made[0], made[2], made[1], *made[3:]]]
    for k in (0, 1, len(made) - 1):
        for name, value in made[k].items():
            if value is None or name == "row_crc":
                continue
            changes = [value + 1] if isinstance(value, int) else [bytes([value[0] ^ 1]) + value[1:], value[:-1] + bytes([value[-1] ^ 128]), value[:-1], value + b"\0"] if value else [b"x"]
            cases += [[*made[:k], made[k] | {name: v}, *made[k + 1 :]] for v in changes]
        cases.append([*made[:k], made[k] | {"row_crc": made[k]["row_crc"] ^ 1}, *made[k + 1 :]])
    for case in cases:
        with pytest.raises(ValueError, match="damaged|lacks|follow|long"):
            read(case)
    # a checksum that fits does not help: lengths and places must
    def signed(row):
        return row | {"row_crc": coder.row_crc(row)}

    for change in ({"lengths": made[0]["lengths"][:8] + made[0]["lengths"][:32]}, {"n_blocks": len(made) + 1}, {"first": 7}):
        with pytest.raises(ValueError, match="lacks|follow|long"):
            read([signed(made[0] | change), *made[1:]])

    docs = spark.createDataFrame(list(enumerate(texts * 8)), "doc_id long, text string")
    path = f"file://{tmp_path}/ids"
    coder.write_ids(docs, BPE, path)
    assert coder.read_documents(spark, path).count() == 40
    blocks = spark.read.schema(coder.FIELDS).parquet(path)
    parts = sorted(r[0] for r in blocks.select("part").distinct().collect())
    assert len(parts) > 1
    blocks.where(F.col("part") != parts[-1]).write.parquet(f"{path}.less")
    spark.read.parquet(f"{path}.parts").write.parquet(f"{path}.less.parts")
    with pytest.raises(ValueError, match="not whole"):
        coder.read_documents(spark, f"{path}.less")


def test_frequent_pairs_are_coded_as_one_symbol():
    """Fewer symbols than ids are coded; runs, where pairs overlap, and pairs that share a hash come back whole."""
    rng = np.random.default_rng(3)
    cases = [rng.zipf(1.4, 60_000) % 3000, np.full(9001, 5), np.tile([1, 2, 1], 5000), rng.integers(0, 60_000, 20_000), np.zeros(0, int), np.asarray([7]), np.repeat([3, 4, 3], [100, 1, 101])]
    for ids in (np.asarray(c, np.int32) for c in cases):
        pairs, symbols = coder.Pairs.joined(ids)
        back = coder.Pairs.unpacked(pairs.packed())
        assert (back.ids(symbols) == ids).all() and back.sizes(symbols).sum() == len(ids)
    assert len(coder.Pairs.joined(cases[1].astype(np.int32))[1]) == 4501
    rows = pa.RecordBatch.from_pydict({"part": pa.array([0] * 40, pa.int32()), "id": pa.array(range(40), pa.int64()), "text": ["stone lamp red winter x1 " * 300] * 40})
    made = [r for b in coder._written_blocks(BPE, 2)(iter([rows])) for r in b.to_pylist()]
    assert len(made) > 3 and sum(r["n_symbols"] for r in made) < 0.6 * sum(r["n_ids"] for r in made)
    assert max(r["n_ids"] for r in made) <= coder.BLOCK_IDS


def test_chunks_of_the_coder_are_those_of_the_library_and_known_to_the_next_task():
    rng = np.random.default_rng(4)
    for k in range(60):
        cls = np.append(rng.choice(11, int(rng.integers(0, 900)), p=rng.dirichlet(np.ones(11) / 2)), token_counts.END).astype(np.uint8)
        assert (chunks.starts(cls) == (token_counts.chunk_starts(cls) & (cls != token_counts.END))).all()
    library = tokenizers.Tokenizer.from_file(BPE)
    alphabet = ["'s", "'ll", "'", " ", "  ", "\n", "\u00a0", "\0", "a", "ve", "\u00e9", "\u4e2d", "\U0001f600", "7", "\u0664", "--", "<|endoftext|>", " zq"]
    texts = ["", *("".join(rng.choice(alphabet, int(rng.integers(1, 40)))) for _ in range(400))]
    table = chunks.chunk_table(BPE)
    for _ in range(2):
        held = table.held
        assert [x.tolist() for x in table.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert table.held == held and chunks.chunk_table(BPE) is table
    small = chunks.ChunkTable(BPE)
    words = [f"{a}{b}{c} w{a}x{b} {c}" for a in range(60) for b in range(60) for c in range(12)]  # the table grows
    assert [x.tolist() for x in small.encode(words)] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


# --- 4 ---------------------------------------------------------------------------------------
def test_sentencepiece_equals_library(docs, texts, edge, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (docs, edge):
        rows = sorted(((r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
        want = []
        for k, t in rows:
            ids = sp.encode(t, add_bos=True, add_eos=True)
            want.append((k, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
        got = sorted((r[0] or 0, *r[1:]) for r in pieces.round_trip_digest(df, PIECES).collect())
        assert got == sorted(want)
    both = pieces.decode(pieces.encode(docs, PIECES), PIECES)
    assert {r["doc_id"]: r["text"] for r in both.collect()} == {k: sp.decode(sp.encode(t)) for k, t in texts.items()}
    assert pieces.round_trip_digest(none, PIECES).count() == 0


def test_sentencepiece_odd_spaces():
    sp, table = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.ChunkTable(PIECES)
    rng = random.Random(0)
    odd = ["", " ", "  ", " a", "a ", "a  b", "▁", " ▁ a▁b", "\n \n"] + ["".join(rng.choice("  ab▁é\n😀") for _ in range(rng.randrange(30))) for _ in range(500)]
    assert [x.tolist() for x in pieces.encoded_texts(table, odd)] == sp.encode(odd, add_bos=True, add_eos=True)


# --- 5 ---------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert all((zlib.crc32(str(k).encode()) % 5 == 0) == h for k, h in zip(got.doc_id, got.held_out))
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.97


def test_quality_edge_cases(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (99, 0)], "doc_id long, quality int")
    got = quality.quality_scores(edge, labels).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(none, labels).count() == 0
    assert quality.good_documents(edge, labels).columns == edge.columns


def test_discriminant_equals_direct_density():
    rng = np.random.default_rng(0)
    x = {c: rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)) + c for c in (0, 1)}
    sums = {c: np.column_stack([np.ones(200), v]).T @ np.column_stack([np.ones(200), v]) for c, v in x.items()}
    model = quality.Discriminant(sums, 0.0, 0.0)
    point = rng.normal(size=(5, 3))

    def log(c):
        cov = np.cov(x[c].T, bias=True) + 1e-6 * np.eye(3)
        e = point - x[c].mean(axis=0)
        return -0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(cov), e) + np.log(np.linalg.det(cov)))

    assert np.allclose(model.scores(point), 1 / (1 + np.exp(log(0) - log(1))))


# --- 6 ---------------------------------------------------------------------------------------
def test_token_counts_equal_library(docs, edge, none):
    tok = tokenizers.Tokenizer.from_file(BPE)
    for df in (docs, edge):
        want = sorted((r["doc_id"] or 0, len((r["text"] or "").encode()), len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect())
        got = token_counts.token_counts(df, BPE).collect()
        assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_counts.token_counts(none, BPE).count() == 0


def test_splitting_rule():
    rng = random.Random(1)
    odd = ["it's we're I'll '' 's 'rx 've'd 'l 'll ''s  's\n's \n 're x", "x<|endoftext|>y<|endoftext|>", "\x00a\x00 b", " a b c\t\td", "a'r", "  \n  \n x"]
    odd += ["".join(rng.choice(" '  \nabrevslltmd12.é!\t ") for _ in range(rng.randrange(80))) for _ in range(2000)]
    tok = tokenizers.Tokenizer.from_file(BPE)
    assert token_counts.ChunkCounts(BPE).count(odd).tolist() == [len(e.ids) for e in tok.encode_batch(odd, add_special_tokens=False)]


# --- 7 ---------------------------------------------------------------------------------------
def test_decontamination_equals_sql(spark, docs, data):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    want = duck(data, sql.DECONTAMINATE)
    assert len(want)
    same(decontaminate.leaked_documents(docs, items), want)
    clean = decontaminate.clean_documents(docs, items)
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()} == set(want.doc_id)


def test_candidates_equal_full_scores():
    rng = random.Random(0)
    items = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    index = decontaminate.ItemIndex(list(range(150)), items)
    weights = np.zeros((len(index.words), 150))
    for t, (a, e) in enumerate(zip(index.begin[:-1], index.begin[1:])):
        weights[t, index.item[a:e]] = index.impact[a:e]
    for _ in range(200):
        terms = np.unique(np.asarray([rng.randrange(len(index.words)) for _ in range(rng.randrange(1, 40))]))
        score = weights[terms].sum(axis=0)
        assert index.candidates(terms) == set(np.flatnonzero((score >= index.enough) & (score > 0)).tolist())


def test_decontamination_edge_cases(spark, edge, none):
    items = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (None, "a b c d e f"), (4, "one")], "item_id long, text string")
    got = decontaminate.leaked_documents(edge, items).collect()
    assert sorted((r["doc_id"] or 0, r["items"]) for r in got) == [(0, [1]), (1, [1]), (7, [4])]
    assert decontaminate.leaked_documents(none, items).count() == 0
    assert decontaminate.leaked_documents(edge, items.limit(0)).count() == 0
    assert decontaminate.clean_documents(edge, items).count() == 5


# --- 8 ---------------------------------------------------------------------------------------
EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_personal_data_equals_patterns(texts):
    rng = random.Random(3)
    odd = ["".join(rng.choice("@@..a1-+ 1234567890%()") for _ in range(rng.randrange(80))) for _ in range(20_000)]
    odd += ["4111 1111 1111 1111 a 4111111111111111 +49 (30) 1234.567 1.2.3.4.5.6.7.8 256.1.1.1 a@b.c@d.ef 001.002.003.004"]
    for t in [*odd, *texts.values()]:
        assert [s for s in pii.find_spans(t) if s[0] in pii.BASE] == base_spans(t)


def test_added_spans_and_redaction(spark):
    t = "see https://a.example/x?y=1. Account no: 12345678, IBAN DE89 3704 0044 0532 0130 00 mail é@x.y a@b.cd"
    found = {(k, t[a:b]) for k, a, b in pii.find_spans(t)}
    assert {("url", "https://a.example/x?y=1"), ("account", "12345678"), ("account", "DE89 3704 0044 0532 0130 00"), ("email", "a@b.cd")} <= found
    assert pii.redacted(t, pii.find_spans(t)) == "see [URL]. Account no: [ACCOUNT], IBAN [ACCOUNT] mail é@x.y [EMAIL]"
    df = spark.createDataFrame([(1, t, "c0", None), (2, None, "x", "text")], "doc_id long, text string, c0 string, spans string")
    got = {r["doc_id"]: tuple(r) for r in pii.redact(df).collect()}
    assert got[2] == (2, None, "x", "text") and "@" not in got[1][1].replace("é@x.y", "")


def test_personal_data_digest(docs, texts, edge, none):
    got = {r["doc_id"]: r for r in pii.personal_data_digest(pii.find_personal_data(docs)).collect()}
    for k, t in texts.items():
        spans = base_spans(t)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in spans).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in pii.BASE] == [sum(s[0] == x for s in spans) for x in pii.BASE]
    assert pii.personal_data_digest(pii.find_personal_data(edge)).count() == 9
    assert pii.personal_data_digest(pii.find_personal_data(none)).count() == 0


# --- 9 ---------------------------------------------------------------------------------------
def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels, "doc_id", "left_semi")
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    hit = held[held.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.8 and held[held.toxic == 1].predicted.mean() > 0.75


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(0)
    vocabulary = np.sort(rng.integers(1, 2**63, 60).astype(np.uint64))
    at = tuple(np.asarray(x) for x in zip(*[(t, e, int(rng.integers(1, 4))) for e in range(500) for t in rng.choice(60, rng.integers(1, 8), replace=False)]))
    index = toxicity.NearestExamples(vocabulary, rng.random(60) + 0.5, np.arange(500), rng.integers(0, 2, 500), at, 0.1, k=9)
    for _ in range(100):
        t = np.sort(rng.choice(60, rng.integers(1, 6), replace=False))
        c = rng.integers(1, 5, len(t))
        cos, places = index.nearest(vocabulary[t], c)
        q = (1 + np.log(c)) * index.idf[t]
        full = ((q / np.sqrt((q**2).sum())) @ index.weights[t])[:500]
        best = np.sort(full)[::-1][:9]
        assert np.allclose(np.sort(cos)[::-1], best[best > 0], atol=1e-5) and np.allclose(full[places], cos, atol=1e-5)


def test_toxicity_edge_cases(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(edge, labels).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity_scores(edge, labels.limit(0)).collect()} == {0.0}


# --- 10 --------------------------------------------------------------------------------------
def test_fingerprints(docs, texts):
    got = {r["doc_id"]: r for r in fingerprint.edit_fingerprints(docs).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    prints = dict(zip(order, fingerprint.fingerprints([texts[k] for k in order])))
    for k, n in zip(order, order[1:] + order[:1]):
        e = fingerprint.edited(texts[k], texts[n])
        assert got[k]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[k]["n_chars"] == len(texts[k]) and got[k]["fingerprint"] == prints[k]
        assert got[k]["edited_fingerprint"] == fingerprint.fingerprints([e])[0]
        assert got[k]["near_next"] == fingerprint.likeness(prints[k], prints[n])
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.97


def test_likeness_falls_with_edits():
    rng = random.Random(0)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000))
    near = []
    for share in (0.0, 0.002, 0.01, 0.05, 0.5):
        t = list(base)
        for _ in range(int(share * len(t))):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], ["#"], ["#", "#"]])
        near.append(fingerprint.likeness(*fingerprint.fingerprints([base, "".join(t)])))
    assert near[0] == 1.0 and near == sorted(near, reverse=True) and near[1] > 0.6 and near[4] < 0.1


def test_fingerprint_edge_cases(spark, edge, none):
    got = fingerprint.edit_fingerprints(edge).collect()
    assert len(got) == 9 and fingerprint.edit_fingerprints(none).count() == 0
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 11}) == 1
    assert [r["fingerprint"] for r in got if r["n_chars"] == 0] == ["", ""]
    pairs = fingerprint.likely_pairs(edge).collect()
    assert (5, 6) in {(r["leader"], r["id"]) for r in pairs}


def test_word_hashes_equal_words():
    t = ["", "A b\tC\n", "é ü", "x" * 50 + " y", None, " lead", "trail "]
    buf, off = words.text_buffers(pa.array(t))
    h, a, b, at = words.word_hashes(buf, off)
    got = [[bytes(buf[a[k] : b[k]]).decode() for k in range(at[i], at[i + 1])] for i in range(len(t))]
    assert got == [(x or "").split() for x in t]
    x, y = (words.word_hashes(*words.text_buffers(pa.array([s])))[0] for s in ("q AbC r", "abc"))
    assert x[1] == y[0]
