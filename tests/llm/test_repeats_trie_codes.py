"""Operators 11 to 13 against brute force and their SQL, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import codes, conversations, queries, repeats


def canonical(rows):
    return sorted(tuple(r) for r in rows)


def against_sql(spark, data, name, table, order):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, data), c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda rows: sorted(tuple("" if x is None else str(x) for x in r) for r in rows)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name, table, order", [("op11_repeated_bytes", "documents", "doc_id"), ("op12_prefix_trie", "conversations", "conv_id"), ("op13_vector_codes", "embeddings", "vec_id")])
def test_whole_tables_against_sql(spark, data, name, table, order):
    against_sql(spark, data, name, table, order)


# --- 11


def removed(rows, length):
    """By a dictionary of all windows, in order of ids."""
    first, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in first:
                gone[p : p + length] = b"\1" * length
            first.add(b[p : p + length])
        runs = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, core, hot, letters", [(12, 4, 10**9, "abc"), (12, 4, 3, "abc"), (20, 7, 20, "ab é"), (12, 11, 9, "ab"), (3, 1, 5, "abcdé")])
def test_repeats_by_brute_force(spark, length, core, hot, letters):
    rnd = random.Random(length * 31 + core)
    rows = []
    for i in range(100):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(80)))
        if rows and rnd.random() < 0.5:
            s = rnd.choice(rows)[1] or ""
            a = rnd.randrange(len(s) + 1)
            t = t[:20] + s[a : a + rnd.randrange(60)] + t[20:]
        if rows and rnd.random() < 0.1:
            t = rnd.choice(rows)[1]
        if rnd.random() < 0.1:
            t = "a" * rnd.randrange(60)
        rows.append((i, t if rnd.random() < 0.95 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for piece in (repeats.PIECE, 17):  # whole texts, and texts in pieces
        got = repeats.repeats_digest(repeats.remove_repeats(docs, length, core, hot, piece=piece)).collect()
        assert sorted((tuple(r) for r in got), key=str) == removed(rows, length)


def test_intervals_of_one_group():
    """Windows of 6 around anchors of 2: bytes before, anchor, bytes behind."""
    rows = np.array([list(b"abcdXYefgh"), list(b"abcdXYefgz"), list(b"zbcdXYefgh"), list(b"\xff\xff\xffdXYe\xff\xff\xff")], np.uint8)
    got = repeats.repeated_windows(rows, np.array([0, 1, 2, 3]), 6, 2)
    want = np.zeros((4, 5), bool)
    want[1] = [False, True, True, True, True]  # XYefgz is new, dXYefg ... abcdXY are not
    want[2] = [True, True, True, True, False]  # zbcdXY is new
    assert (got == want).all()


def test_repeats_of_odd_rows(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(1_300_000))  # above one slice
    rows = [(3, long, 1), (1, "x" * 99, 1), (2, "x" * 100, 1), (4, "new " + long[1000:], 1), (5, None, None), (6, "", 2), (None, "y" * 150, 3), (7, "y" * 100, 3),
            (8, "same " * 30, 4), (8, "same " * 30, 4), (8, "same " * 30, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(3)
    got = {(r["doc_id"], i): r for i, r in enumerate(repeats.remove_repeats(docs).collect())}
    of = defaultdict(list)
    for (i, _), r in got.items():
        of[i].append(r)
    assert len(got) == len(rows)
    assert bytes(of[3][0]["kept"]).decode() == long and of[3][0]["spans"] == []
    assert [(s["start"], s["stop"]) for s in of[4][0]["spans"]] == [(4, len(long) - 996)] and bytes(of[4][0]["kept"]) == b"new "
    assert [len(of[i][0]["kept"]) for i in (1, 2, 5, 6)] == [99, 100, 0, 0]
    assert [(s["start"], s["stop"]) for s in of[None][0]["spans"]] == [(1, 150)] and of[7][0]["spans"][0]["stop"] == 100  # null ids come first
    # of equal rows one is the first: it repeats itself only; the others are copies
    assert sorted(len(r["kept"]) for r in of[8]) == [0, 0, 5]
    empty = repeats.repeats_digest(repeats.remove_repeats(docs.where("false")))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


# --- 12


def trie(rows):
    """rows of (conv_id, turn, role, text), by dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h]) + tuple(own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    out = []
    for node, cs in members.items():
        below = [u for u in members if u[: len(node)] == node]
        leaf = lambda u: not any(len(w) == len(u) + 1 and w[: len(u)] == u for w in members)
        out.append((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(u) == len(node) + 1 for u in below),
            sum(map(leaf, below)), sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u), hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [1, 3, 4])
def test_trie_by_brute_force(spark, width):
    rnd = random.Random(width)
    rows = []
    for c in range(0, 330, 3):
        for t in range(rnd.choice([1, 2, 3, 9, 14])):
            rows.append((c, t, rnd.choice(["user", None]) if t else "user", rnd.choice(["a", "bé", None, "c" * 40])))
    rows += [(600, None, "user", "first"), (600, 0, "user", "second"), (600, 0, "user", "second"), (None, 1, "user", "lost"), (701, 1, None, None), (5, 1, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k1", F.lit(1)).withColumn("c", F.lit("x")).repartition(5)
    got = conversations.prefix_trie(turns, width)
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie(rows)


def test_long_conversations_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "STEP", 2)
    monkeypatch.setattr(conversations, "STRUNG", 5)
    rows = [(c, t, "user", f"t{t}") for c in (100, 201, 302, 403) for t in range(60)] + [(c, 0, "user", "hello") for c in range(1000, 1040)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in conversations.prefix_trie(turns).collect()), key=str) == trie(rows)
    assert conversations.prefix_trie(turns.where("false")).collect() == []


# --- 13


def lloyd(rows, parts, entries=64, rounds=2):
    """(ids, codes, errors, codebooks) by plain integers."""
    keep = sorted((i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows)
    w = len(keep[0][1]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(v)[p] for _, v in keep[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, s: min((away(s, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        got = [[near(p, s)[1] for p, s in enumerate(cut(v))] for _, v in keep]
        for p in range(parts):
            new = []
            for k, e in enumerate(books[p]):
                mine = [cut(v)[p] for (_, v), g in zip(keep, got, strict=True) if g[p] == k]
                new.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else e)
            books[p] = new
    out = [(i, "".join(f"{near(p, s)[1]:02x}" for p, s in enumerate(cut(v))), sum(near(p, s)[0] for p, s in enumerate(cut(v)))) for i, v in keep]
    return out, books


@pytest.mark.parametrize("kind", ["normal", "ties", "clusters", "hot"])
def test_codes_by_plain_integers(spark, kind):
    rng = np.random.default_rng(7)
    n, dim = 250, 32
    x = {"normal": rng.normal(0, 0.3, (n, dim)), "ties": rng.integers(-2, 2, (n, dim)) / 256, "clusters": rng.normal(0, 1, (5, dim))[rng.integers(0, 5, n)] + rng.normal(0, 0.01, (n, dim)), "hot": rng.normal(0, 0.3, (n, dim))}[kind]
    if kind == "hot":
        x[::2] = x[0]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    vectors = spark.createDataFrame([(i, v, i % 3 or None) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    coded, books = codes.product_codes(vectors)
    want, plain = lloyd(rows, 16)
    assert canonical(coded.select("vec_id", "code", "error").collect()) == want
    assert books.tolist() == plain
    digest = codes.codes_digest(vectors).collect()
    sums = defaultdict(int)
    for i, _, e in want:
        sums[i % 3 or None] += e
    assert {(r["vec_id"], r["label_error"]) for r in digest} == {(i, sums[i % 3 or None]) for i, _, _ in want}


def test_trees_decide_whole_subtrees():
    """Members lie within the radius; clusters are given to an entry without looking at members."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(-3000, 3000, (20, 16)), 50, axis=0) + rng.integers(-3, 4, (1000, 16))
    forest = codes._Forest(x, 4)
    for order, lo, hi, centre, radius, _ in forest.levels:
        for a, b, c, r in zip(lo, hi, centre, radius, strict=True):
            assert ((forest.members[order[a:b]] - forest.members[c]) ** 2).sum(1).max() == r
    books = np.ascontiguousarray(x[::50].reshape(20, 4, 4).swapaxes(0, 1))
    entry, counts, sums, whole = codes._assigned(forest, books)
    away = ((x.reshape(1000, 4, 1, 4) - books[None]) ** 2).sum(3)
    assert (entry == away.argmin(2)).all() and whole > 0.9
    assert counts.sum() == 4000 and (sums.sum(1) == x.reshape(1000, 4, 4).sum(0)).all()


def test_codes_of_odd_rows(spark, monkeypatch):
    v = lambda *x: [float(a) for a in (list(x) * 16)[:16]]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v(0.5), "a"), (1, v(0.5), "a"), (2, None, "a"), (3, v(nan), "a"), (4, v(-inf), "a"), (5, [None] + v(1)[1:], "a"), (6, v(-0.001), None), (None, v(3), None), (7, [1.0], "b"), (8, [], "b")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("error", F.lit(9)).withColumn("id", F.lit(9))
    got = canonical((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in codes.codes_digest(vectors).collect())
    # vectors of another length than the first usable one are left out; ties go to the lower entry
    assert got == [(False, 1, "00" * 16, 0, 0), (False, 1, "00" * 16, 0, 0), (False, 6, "02" * 16, 0, 0), (True, 0, "03" * 16, 0, 0)]
    monkeypatch.setattr(codes, "LABELS", 1)
    assert canonical((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in codes.codes_digest(vectors).collect()) == got
    assert codes.codes_digest(vectors.where("false")).collect() == []
    assert codes.codes_digest(vectors.where("vec_id = 7")).collect() == []
