"""Operators over many documents: components, packing, URL filter, pipeline; brute force and odd rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bandwatch.llm import decontaminate, jaccard, packing, quality, simhash, urls
from bandwatch.llm.common import components, remainder
from bandwatch.llm.queries import QUERIES, URL_RULES, vocabulary_path

from .test_texts import ODD, SF, odd_docs

VOCABULARY = vocabulary_path("word_bpe_49k.json")


def roots_by_hand(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {
        "path": [(i, i + 1) for i in range(40)], "star": [(99, i) for i in range(30)],
        "random": [(i, (i + rng.randrange(1, 79)) % 80) for i in range(0, 80, 2)] + [(5, 5)], "none": [],
    }[shape]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots_by_hand({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    assert got == want


@pytest.mark.parametrize("crowd", [64, 3])
def test_links_lose_no_pair(spark, crowd):
    """With a small bound on crowds, the path without pairs gives the same components."""
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(25)} | {0, 1, 7, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(fps, crowd=crowd)).collect()}
    want = roots_by_hand(signed, edges)
    assert {n: got.get(n, n) for n in signed} == want


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert len(rows) == len(ODD)
    by_id = {r[0]: r for r in rows}
    assert by_id[1][1:] == by_id[2][1:] == ("0" * 16, 1) and by_id[None][2] is None
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and ids.count(3) == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_simhash_query_equals_brute_force(spark):
    rows = QUERIES["op1_simhash"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in texts.items()}
    want = roots_by_hand(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_rows_are_kept_by_their_places(spark, monkeypatch):
    from bandwatch.llm import common

    docs = spark.range(0, 70_000, 1, 2).select(F.col("id").alias("place"), F.col("id").cast("string").alias("text"), F.lit("x").alias("slice"))
    stored = common.Numbered(docs, "text", "size int", lambda: lambda t: (len(t),), "numbered")
    keep = stored.narrow(F.col("text")).where("text % 7 = 3 or place = 32768").select("slice", "place")
    want = {i for i in range(70_000) if i % 7 == 3 or i % 35_000 == 32_768}
    for bound in (1 << 14, 1):
        monkeypatch.setattr(common, "BITMAPS", bound)
        out = stored.only(keep)
        assert out.columns == docs.columns and {r["place"] for r in out.collect()} == want
    assert stored.only(keep.limit(0)).count() == 0


def laid_out(entries, counts):
    """Sequence, offset and length of every piece that a plan places."""
    entries, out = sorted(entries), []
    for n, k in counts.items():
        own = [e for e in entries if e[0] == n]
        for rank in range(k):
            _, first, bin_, each, offset = [e for e in own if e[1] <= rank][-1]
            i = rank - first
            out.append((bin_ + i // each, offset + i % each * n, n))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25))
def test_plans_place_every_piece(counts):
    entries, bins = packing.plan(counts, 60)
    at, used = -1, 0
    for b, offset, n in laid_out(entries, counts):
        used = used if b == at else 0
        assert offset == used and used + n <= 60
        at, used = b, used + n
    assert len({b for b, *_ in laid_out(entries, counts)}) == bins >= -(-sum(n * k for n, k in counts.items()) // 60)


def test_large_pieces_pair_with_the_longest_that_fits():
    entries, bins = packing.plan({70: 1, 60: 1, 40: 1, 35: 1, 30: 2}, 100)
    got = laid_out(entries, {70: 1, 60: 1, 40: 1, 35: 1, 30: 2})
    assert bins == 3 and {frozenset(n for b, _, n in got if b == k) for k in range(3)} >= {frozenset({60, 40})}


def test_packing_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer
    import zlib

    docs = odd_docs(spark, ODD + [(20, "it's <|endoftext|> Ünïcode\u00a0space 'll 123 \u0130"), (21, "word " * 5000)])
    rows = packing.pack(docs, VOCABULARY).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want.append((r["doc_id"], k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (a, o, n), (b, p, _) in zip(places, places[1:]):
        assert p == (o + n if a == b else 0)
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
    encoder = packing.WordEncoder(VOCABULARY)
    texts = [b"one two three", b"two four five six", b"one one seven"]
    want = [np.array(encoder.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [encoder.encode([t])[0] for t in texts] == want == encoder.encode(texts)


def host_and_path_by_hand(url):
    import re

    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_rules_and_regression(spark):
    addresses = [
        "http://EXAMPLE.com/en/1", "https://a.example.com/en/x?q=/", "http://www.example.com/en/2", "http://com/", "http://x.com", "http://x.com?a",
        "http://b.net/es/1", "http://notexample.com/en/", "http://net/fr/#x", "ftp://h.org/p?q#f", "no scheme", "", None, "http://casino-win.example.org/",
        "http://library.example.org/en/1", "http://É.example.org/ü", "a://b://c/d", "http://",
    ]
    pages = spark.createDataFrame(list(enumerate(addresses)) + [(None, "http://x.com/"), (1, addresses[1])], "page_id long, url string")
    pages = pages.withColumn("host", F.lit("mine")).withColumn("model", F.lit(1))
    rows = urls.judge(pages, URL_RULES, urls.train(urls.labelled(spark))).collect()
    assert len(rows) == len(addresses) + 2
    for r in rows:
        if r["page_id"] is None:
            continue
        host, path = host_and_path_by_hand(addresses[r["page_id"]])
        fits = []
        for verdict, rule in URL_RULES:
            own, _, rest = rule.partition("/")
            if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
                fits.append((len(rule), rule, verdict))
        assert (r["host"], r["path"]) == (host, path) and r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else "block" if r["probability"] >= 0.5 else "allow")
    by_id = {r["page_id"]: r for r in rows}
    assert by_id[13]["verdict"] == "block" and by_id[14]["verdict"] == "allow"
    assert urls.judge(pages.limit(0), [], urls.train(urls.labelled(spark).limit(0))).count() == 0


def test_the_regression_equals_numpy(spark):
    examples = urls.labelled(spark).orderBy("address").limit(60)
    got = urls.train(examples).first()
    rows = examples.select("label", urls.slots(F.col("address")).alias("x")).collect()
    x = np.zeros((len(rows), urls.SLOTS))
    for i, r in enumerate(rows):
        x[i, r["x"]] = 1
    y, w, b = np.array([r["label"] for r in rows]), np.zeros(urls.SLOTS), 0.0
    for _ in range(urls.STEPS):
        g = y - 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w + urls.RATE * ((x.T @ g) / np.maximum(1, x.sum(0)) - urls.SHRINK * w), b + urls.RATE * g.mean()
    assert np.allclose(got["weights"], w) and got["bias"] == pytest.approx(b)


def test_known_spam_hosts_are_blocked(spark):
    rows = [r for r in QUERIES["op6_urls"](spark, "/root/testdata/sf0.01").collect() if r["rule"] is None]
    spam = [r for r in rows if any(w in r["host"] for w in ("casino", "bets", "pills", "adult", "spam", "ads"))]
    others = [r for r in rows if r not in spam]
    assert all(r["verdict"] == "block" for r in spam) and sum(r["verdict"] == "allow" for r in others) >= 0.95 * len(others)


def test_remainders_are_those_of_crc32(spark):
    import zlib

    rows = spark.createDataFrame([(1,), (1234567,), (-5,), (None,)], "doc_id long").withColumn("m", remainder(F.col("doc_id"), 3)).collect()
    assert all(r["m"] == zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 for r in rows)


def near_classes(texts):
    """The least id of each text's class, by brute force over sets of five words."""

    def shingled(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingled(t) for i, t in texts.items()}
    alike = lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0
    return roots_by_hand(sets, [(a, b) for a in sets for b in sets if a < b and alike(a, b)])


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, held, SF)
        assert kept.columns == docs.columns
        sizes[name] = (held.count(), kept.count())
        held = spark.createDataFrame(kept.toArrow(), docs.schema)
    assert sizes["language"][1] >= 0.95 * sizes["language"][0]
    final = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert {r["doc_id"] for r in final.select("doc_id").collect()} == {r["doc_id"] for r in held.select("doc_id").collect()}
    # Each stage by hand, on its own input.
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    voters = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    good = {i for i, t in texts.items() if voters.scores([t.encode()])[0] >= 0.5}
    roots = near_classes({i: texts[i] for i in good})
    items = decontaminate.Items([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 5, 0.8, decontaminate.RADIUS)
    want = {i for i, r in roots.items() if i == r and not items.matches(texts[i].encode())}
    assert {r["doc_id"] for r in held.collect()} == want
    again = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, final.select(columns).collect()))


def test_near_dedup_stage_equals_brute_force(spark, monkeypatch):
    """Classes of exact five-word Jaccard similarity, also with a crowd of copies and with common shingles put last."""
    import corpus_pipeline

    rng = random.Random(7)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    for i in range(150):  # copies at all distances from the base, with more or fewer edits
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(copy)))
    rows += [(20_000 + i, " ".join([*base[:30], *(f"y{i}_{j}" for j in range(i % 20))])) for i in range(60)]
    rows += [(30_000, "a b c"), (30_001, "A  b\nc"), (30_002, "a b"), (30_003, ""), (30_004, None)]

    roots = near_classes(dict(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(i for i, r in roots.items() if i == r)
    for common in (jaccard.COMMON, 10**9):
        monkeypatch.setattr(jaccard, "COMMON", common)
        assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()) == want


def test_near_dedup_stage_by_fingerprints_and_by_shingles(spark, monkeypatch):
    """Fingerprints alone find pairs within their radius; shingles find all pairs, counted in small groups or met in large ones."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(400)}" for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join(b[:-1] + ["end"])) for i, b in enumerate(base)]
    rows += [(200 + i, " ".join(b[: 150 + 2 * i] + ["x"] * 10 + b[150 + 2 * i :])) for i, b in enumerate(base[:20])]
    found = {i: jaccard.hashes(t.encode()) for i, t in rows}
    bits = {i: [2 * sum(h >> b & 1 for h in f.tolist()) > len(f) for b in range(64)] for i, f in found.items()}
    assert all(jaccard.fingerprint(f) % 2**64 == sum(x << b for b, x in enumerate(bits[i])) for i, f in found.items())
    assert jaccard.fingerprint(jaccard.hashes(b"")) == 0
    roots = near_classes(dict(rows))
    close = [(a, b) for a in found for b in found if a < b and roots[a] == roots[b] and sum(x != y for x, y in zip(bits[a], bits[b])) <= jaccard.RADIUS]
    by_print = roots_by_hand(dict(rows), close)
    assert close and by_print != roots
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def kept():
        return sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect())

    for small in (1, jaccard.SMALL):
        monkeypatch.setattr(jaccard, "SMALL", small)
        assert kept() == sorted(i for i, r in roots.items() if i == r)
    monkeypatch.setattr(jaccard, "prefix", lambda found, common: found[:0])
    assert kept() == sorted(i for i, r in by_print.items() if i == r)


def test_near_dedup_stage_tries_pairs_that_meet_often_enough(spark, monkeypatch):
    """Texts that share a line alone meet in its large groups; such pairs are not tried, and those that meet LEAST times are."""
    rng = random.Random(12)
    line = [f"line{j}" for j in range(jaccard.WIDTH + jaccard.LEAST - 2)]  # one shingle fewer than similar texts share
    rows = [(i, " ".join([*line, *(f"w{rng.randrange(10**9)}" for _ in range(1500))])) for i in range(30)]
    copy = rows[0][1].split()
    rows.append((100, " ".join([*copy[:700], "other", *copy[701:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, plain = {}, jaccard.written

    def counted(df, purpose):
        out = plain(df, purpose)
        made[purpose] = out[0].count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    monkeypatch.setattr(jaccard, "RADIUS", 0)
    monkeypatch.setattr(jaccard, "COMMON", 10**9)
    monkeypatch.setattr(jaccard, "prefix", lambda found, common: np.unique(np.concatenate([found[:200], jaccard.hashes(" ".join(line).encode())])))
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect()) == list(range(30))
    assert made["apart"] >= 30 * (jaccard.LEAST - 1) and made["met"] == 0


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
            out = stage(spark, docs, SF)
            assert out.count() <= len(ODD) + 60 and (name == "packing" or out.columns == docs.columns)
