"""Operators on embeddings and token ids: brute force, exact round trips, odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwatch.llm import bpe, lemp, whitening
from bandwatch.llm.queries import QUERIES, vocabulary_path
from bandwatch.llm.vectors import packed, unpacked, whole_numbers

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def test_packed_vectors_come_back():
    rows = np.array([[0, 0, 0], [1, 0, 0], [127, -128, 0], [128, 0, -1], [2**31, 0, 0], [2**63 - 1, -(2**63), 5], [0, 0, 9]], np.int64)
    kept = packed(rows)
    assert kept[0] == b"" and len(set(kept)) == len(rows)
    assert (unpacked(kept, 3) == rows).all() and (unpacked(kept, 5)[:, 3:] == 0).all()
    assert packed(np.pad(rows, ((0, 0), (0, 2)))) == kept
    assert whole_numbers(np.array([-0.0, 1.0, -1e-9, 1e30, -1e300, 1e308])).tolist() == [0, 256, -1, 2**63 - 1, -(2**63), 2**63 - 1]


def whitening_by_hand(rows, components):
    """Plain numpy over collected rows, in Python's whole numbers where it must be exact."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    x = [[math.floor(256.0 * c) for c in v] + [0] * (d - len(v)) for _, v in good]
    listed = sorted(set(map(tuple, x)))
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in listed])
    matrix = centred.T @ centred / n
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = {}
    for (i, _), r in zip(good, x):
        deviation = sum((n * a - s) ** 2 for a, s in zip(r, sums))
        z = np.array([(n * a - s) / n for a, s in zip(r, sums)])
        for k, e in enumerate(values):
            out.setdefault((i, k + 1), []).append((n, deviation, z @ axes[:, k] / math.sqrt(e), e / np.trace(matrix)))
    return out


def agrees(got, want):
    found, sign = {}, {}
    for r in got:
        found.setdefault((r["vec_id"], r["component"]), []).append((r["n"], int(r["deviation"]), r["whitened"], r["explained"]))
    assert found.keys() == want.keys()
    for key in want:
        a, b = sorted(found[key]), sorted(want[key])
        assert [v[:2] for v in a] == [v[:2] for v in b]
        if abs(b[0][2]) > 0.5:
            sign.setdefault(key[1], math.copysign(1, a[0][2] * b[0][2]))
    for key in want:
        for a, b in zip(sorted(found[key]), sorted(want[key])):
            assert a[2] * sign[key[1]] == pytest.approx(b[2], abs=1e-6) and a[3] == pytest.approx(b[3], rel=1e-9)


def test_whitening_query_equals_plain_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op11_whitening"](spark, SF).collect()
    agrees(got, whitening_by_hand(rows, 4))
    assert {r["identity_error"] for r in got}.pop() < 1e-9


def test_whitening_of_odd_rows(spark):
    """Nulls, non-finite entries, repeats, other lengths, wide entries, extra columns with clashing names."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * 10 ** (4 * k) for k in range(3)], i % 2) for i in range(40)]
    rows += [(7, rows[3][1], None), (None, rows[3][1], 1), (50, [0.5], 1), (51, [0.5, 0.0, 0.0, 0.0], 1)]
    bad = [(60, None, 1), (61, [None, 1.0], 1), (62, [float("nan")], 1), (63, [float("inf"), 1.0], 1)]
    table = spark.createDataFrame([*rows, *bad], SCHEMA).withColumn("component", F.lit("x")).withColumn("x", F.lit(1)).withColumn("vector", F.lit(2))
    stored = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    agrees(whitening.whiten(table, 2).collect(), whitening_by_hand(stored, 2))


def test_whitening_without_variance(spark):
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [], 0), (2, None, 0)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0], 0), (2, [-1e30, 0.0], 0), (3, [0.0, 0.0], 0)], SCHEMA)).collect()
    assert sorted(round(r["whitened"], 3) for r in line) == [-1.225, 0, 1.225] and {r["component"] for r in line} == {1}
    assert all(r["deviation"] is None or r["deviation"] <= 1 for r in line)  # beyond 38 digits: null


@pytest.mark.parametrize("scale", [1, 1 << 20, 1 << 40])
def test_polarisation_is_exact(spark, scale):
    """Sums of any size are exact, and agree with products of centred numbers."""
    rng = random.Random(scale)
    rows = [(i, [float(rng.randrange(-99, 99) * scale) for _ in range(4)], 0) for i in range(30)]
    listed = whitening.fit_list(spark.createDataFrame(rows, SCHEMA), "embedding")
    x = [[int(256 * c) for c in v] for v in {tuple(v) for _, v, _ in rows}]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    assert whitening.exact_sums(listed, 4, 4, whitening.plain_sums) == sums
    own = whitening.Whitener(n, sums, np.zeros((4, 4)), 0)
    pairs = np.triu_indices(4, 1)
    squares = whitening.exact_sums(listed, 4, 10, lambda b: whitening.sums_of_squares(own.centred(b), pairs))
    z = [[a - m for a, m in zip(r, own.middle)] for r in x]
    assert squares == [sum(r[i] ** 2 for r in z) for i in range(4)] + [sum((r[i] + r[j]) ** 2 for r in z) for i, j in zip(*pairs)]
    want = [[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) / n**3 for j in range(4)] for i in range(4)]
    assert np.allclose(whitening.covariance(squares, own.left, n), want, rtol=1e-15 * n)


BYTE_LEVEL = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_LEVEL)


def ids_of(encoder, texts):
    return [np.frombuffer(i, "<u4").tolist() for i in encoder.encode([t.encode() for t in texts])]


def test_bpe_equals_the_library(library):
    """Random mixtures of words, white space of every kind, special tokens, letters of many scripts, long words."""
    rng = random.Random(1)
    parts = [
        "a", "the", "'s", "'re", " ", "  ", "\n", "\t", "1", "23", "\xe9", "\u4e2d", "\xa0", "\u2003", "\u3000", "\x85", "\x1c", "!", "====",
        "<|endoftext|>", "\U0001f600", "ing", "\r\n", "\u0301", "\u200b", "\uff41", "\u2460", "\u2168", "\x00",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(rng.randrange(12))) for _ in range(4000)]
    texts += ["a" * 1000, "=" * 700, "ab" * 500, " " * 500, "x" * 3000 + " y", "the" * 4000, "", "<|endoftext|>"]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    encoder = bpe.Encoder(BYTE_LEVEL)
    assert ids_of(encoder, texts) == want
    assert ids_of(encoder, texts[::-1]) == want[::-1]  # with full caches
    flat, ends = np.array([i for w in want for i in w], np.int64), np.cumsum([len(w) for w in want])
    assert [t.decode() for t in bpe.Decoder(BYTE_LEVEL).decode(flat, ends)] == [library.decode(w, skip_special_tokens=False) for w in want] == texts


def test_bpe_with_small_caches(library, monkeypatch):
    monkeypatch.setattr(bpe, "UNITS", 50)
    monkeypatch.setattr(bpe, "UNIT_BYTES", 4)
    monkeypatch.setattr(bpe, "WORD_BYTES", 6)
    rng, encoder = random.Random(2), bpe.Encoder(BYTE_LEVEL)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcde\n") for _ in range(rng.randrange(9))) for _ in range(20)) for _ in range(5)]
        assert ids_of(encoder, texts) == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_last_tokens_are_plain_encodings(library):
    """Every prefix's state is the last token of the library's encoding of that prefix."""
    trie, words = bpe.Encoder(BYTE_LEVEL).trie, [b"internationalization", b"internal", b"aaaaaaaaaaaa"]
    found = trie.encode([w[:n] for w in words for n in range(1, len(w) + 1)])
    for word, tokens in found.items():
        assert tokens == library.encode(word.decode(), add_special_tokens=False).ids
    assert len(trie.state) - 1 == len(found)  # shared prefixes once


def test_bpe_query_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = bpe.decode(bpe.encode(docs, BYTE_LEVEL), BYTE_LEVEL)
    assert both.exceptAll(bpe.round_trip(docs, BYTE_LEVEL)).isEmpty()
    got = QUERIES["op12_bpe"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(decoded))


def test_decoding_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, [0, None, -5, 10**9], "k"), (2, None, None), (None, [], "k"), (4, [50256, 94], "k")], "doc_id long, ids array<int>, text string")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(rows, BYTE_LEVEL).collect()}
    assert got == {1: "!", 2: "", None: "", 4: "<|endoftext|>\ufffd"}  # id 94 is a lone byte
    empty = bpe.encode(spark.createDataFrame([(None, None), (5, "")], "doc_id long, text string"), BYTE_LEVEL).collect()
    assert {r["doc_id"]: r["ids"] for r in empty} == {None: [], 5: []}


def mined_by_hand(rows, step=50):
    """Plain loops over (vec_id, vector, label), labels as they are."""
    x = [(i, [max(-(2**63), min(2**63 - 1, math.floor(256.0 * c))) for c in v], label) for i, v, label in rows
         if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    low = -(2**63)
    out = []
    for k, (i, v, label) in enumerate(x):
        if i is None or i % step:
            continue
        scored = [(max(low, min(~low, sum(a * b for a, b in zip(v, w)))), low if j is None else j, other == label) for m, (j, w, other) in enumerate(x) if m != k]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for score, j, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and 50 * score <= 100 * s[0] <= 95 * score][:3]
            out += [(i, None if j == low else j, r, None if n == low else n, score, s) for r, (s, n, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def vectors_in_groups(n, d, noise, seed, wide=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    group = rng.integers(0, 6, n)
    v = (centres[group] + noise * rng.normal(size=(n, d))) * rng.uniform(0.2, 3, (n, 1)) * wide
    return [(int(i), [float(np.float32(c)) for c in r], int(g if rng.random() < 0.6 else rng.integers(0, 6))) for i, (r, g) in enumerate(zip(v, group))]


@pytest.mark.parametrize(("noise", "wide"), [(0.02, 1.0), (0.5, 1.0), (0.1, 1e6), (0.1, 1e17)])
def test_hard_negatives_equal_plain_loops(spark, monkeypatch, noise, wide):
    """Many small buckets, stripes and groups; tight groups prune by coordinates, loose ones do not."""
    for name, value in {"BUCKET": 40, "ANCHORS": 6, "DEPTH": 2, "SPAN": 2}.items():
        monkeypatch.setattr(lemp, name, value)
    rows = vectors_in_groups(300, 7, noise, 4, wide)
    got = lemp.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0, F.col("label")).collect()
    want = mined_by_hand(rows, 10)
    assert sorted((tuple(r) for r in got), key=str) == want and (len(want) > 20) == (wide < 1e8)  # all scores beyond longs are ties


def test_coordinates_prune(monkeypatch):
    """On tight groups few rows are verified, and none that reaches the bound is lost."""
    rows = vectors_in_groups(2000, 8, 0.02, 9)
    x = np.array([np.array(v) / np.linalg.norm(v) for _, v, _ in rows])
    x = whole_numbers(x * np.linspace(4, 3.8, 2000)[:, None])  # a length bucket
    nothing = np.zeros(2000, np.int64).tobytes()
    block = lambda part: lemp.Block.of(nothing, nothing, list(range(len(part))), packed(part), orders_of(part))
    anchors, bucket = block(x[:50]), block(x)
    least = (0.95 * anchors.norm * bucket.longest).astype(np.int64)
    seen, plain = [], lemp.Block.products
    monkeypatch.setattr(lemp.Block, "products", lambda self, other, own, others: seen.append(len(own) * len(others)) or plain(self, other, own, others))
    found = lemp.reaching(anchors, bucket, least, np.ones(50, bool))
    scores = x[:50] @ x.T
    assert sorted(zip(*(c.tolist() for c in found))) == [(a, r, int(scores[a, r])) for a in range(50) for r in range(2000) if scores[a, r] >= least[a]]
    assert 0 < len(found[0]) <= sum(seen) < 0.5 * scores.size


def orders_of(x):
    norm = np.sqrt((x.astype(float) ** 2).sum(1))
    return np.argsort(x / np.where(norm > 0, norm, 1)[:, None], axis=0, kind="stable").T.astype("<u2").tobytes()


def test_hard_negatives_of_odd_rows(spark):
    """Nulls, non-finite numbers, repeats, ties, other lengths, zero vectors, clashing columns."""
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0], 1), (2, [0.8, 0.1], 2), (3, [0.8, 0.1], 2), (None, [0.8], 2), (None, [0.9], 1), (4, [0.0, 0.0], 3), (5, [], 1)]
    bad = [(50, None, 1), (100, [None], 1), (150, [float("nan")], 1), (200, [float("-inf")], 2), (250, [1.0], None)]
    table = spark.createDataFrame(rows + bad, SCHEMA).withColumn("id", F.lit("x")).withColumn("stripe", F.lit(1)).withColumn("row", F.lit(2))
    got = lemp.mine(table, F.col("id") % 50 == 0, F.col("label")).collect()
    assert sorted((tuple(r) for r in got), key=str) == mined_by_hand([(i, [float(np.float32(c)) for c in v], g) for i, v, g in rows])
    assert lemp.mine(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0, F.col("label")).count() == 0
    assert lemp.mine(spark.createDataFrame(bad, SCHEMA), F.col("id") % 50 == 0, F.col("label")).count() == 0
