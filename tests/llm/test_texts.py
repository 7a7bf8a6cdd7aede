"""Operators that judge or rewrite each text: brute force, round trips, odd rows."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bandwatch.llm import decontaminate, language, ppm, quality, simhash, tiff, toxicity
from bandwatch.llm.queries import QUERIES
from bandwatch.llm.templates import main_text

SF = "/root/testdata/sf0.001"
ODD = [(1, ""), (2, None), (3, "one"), (3, "one"), (None, "two words"), (4, "x" * 70_000), (5, "a b " * 60_000), (6, "&&& ### \n\t")]


def odd_docs(spark, rows=ODD):
    """Documents with nulls, repeats, long texts, and columns whose names operators use themselves."""
    data = [(i, t, "en", None if i == 1 else "src1", len(t or ""), 0.5, "k") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, key string")


def fingerprint_by_hand(text):
    import xxhash

    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB c\né　\x0b", max_size=60))
def test_fingerprints_follow_their_definition(text):
    assert simhash.fingerprint(text.encode()) == fingerprint_by_hand(text)


def test_fingerprint_of_a_text_longer_than_a_block(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(text.encode()) == whole == fingerprint_by_hand(text)


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tile", [0, 16])
def test_images_come_back(compression, tile):
    rng = np.random.default_rng(7)
    for shape in ((1, 64), (300, 64), (70, 33, 3)):
        for kind in (np.uint8, np.uint16):
            for image in (rng.integers(0, 256, shape).astype(kind), rng.integers(0, 2, shape).astype(kind)):
                for predictor in (1, 2):
                    found = list(tiff.pages(tiff.encode([image, image[::-1]], compression, predictor, 50, tile)))
                    assert [p.number for p in found] == [0, 1]
                    assert (found[0].samples.reshape(shape) == image).all() and (found[1].samples.reshape(shape) == image[::-1]).all()


@given(st.binary(max_size=400))
@settings(max_examples=80, deadline=None)
def test_byte_codes_come_back(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_big_endian_big_and_broken_files(spark):
    # A big-endian BigTIFF of floats with the floating-point predictor, built by hand.
    image = np.array([[0.5, -2.0, 3.25]], ">f4")
    planes = image.view(np.uint8).reshape(3, 4).T.reshape(1, -1).astype(np.uint8)
    strip = np.diff(planes, axis=1, prepend=np.zeros((1, 1), np.uint8)).astype(np.uint8).tobytes()
    fields = [(256, 3), (257, 1), (258, 32), (259, 1), (273, 16), (277, 1), (278, 1), (279, len(strip)), (317, 3), (339, 3)]
    body = struct.pack(">Q", len(fields)) + b"".join(struct.pack(">HHQHHI", t, 3, 1, v, 0, 0) for t, v in fields) + struct.pack(">Q", 0)
    data = b"MM" + struct.pack(">HHHQ", 43, 8, 0, 16 + len(strip)) + strip + body
    assert list(tiff.pages(data))[0].samples.ravel().tolist() == [0.5, -2.0, 3.25]
    files = spark.createDataFrame([(1, data), (2, b"II*\0"), (3, None), (4, b""), (1, data)], "id long, file binary")
    rows = sorted((r["id"], r["page"], r["error"] is None) for r in tiff.read_pages(files, "id", "file").collect())
    assert rows == [(1, 0, True), (1, 0, True), (2, -1, False)]


def test_stored_texts_are_read_back():
    for text in (b"", b"a", b"x" * 64, "é".encode() * 9000):
        payload = b"".join(p.samples.tobytes() for p in tiff.pages(tiff.store_text(text)))
        assert payload == text + b"\0" * (len(payload) - len(text)) and len(payload) % 64 == 0 and len(payload) >= 64


def test_tiff_query_equals_its_definition(spark):
    got = {r["doc_id"]: r for r in QUERIES["op4_tiff"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs[:50]:
        raw = (d["text"] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])


def test_articles_are_cut_out_of_pages():
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><header>Site</header><nav><a>Home</a></nav>"
        "<div class='cookie-notice'>We use</div><article><header><h1>Big\n news</h1></header><p>One <b>two</b>&amp;three<br>four<p>five"
        "<form><input>Name</form><aside>More</aside><ul><li>six<li>seven</ul><!-- no --><div id=comments>hi</div></article><footer>End</footer>"
    )
    assert main_text(page) == "Big news\nOne two&three four\nfive\nsix\nseven"
    assert main_text("") == "" and main_text("just <i>te</i>xt") == "just text"
    assert main_text("<p>" * 3000 + "deep") == "deep" and main_text('<a title="x > y">z</a>') == "z"


def test_templates_are_deduced_where_nothing_names_them(spark):
    from bandwatch.llm.templates import extract

    rows = [(i, f"http://h.example/{i}", f"<body><div>Daily Post</div><div>By our staff</div><p>Story number {i} tells {i * i} things of {i * 7}</p><div>All rights kept</div>") for i in range(12)]
    rows += [(50, None, None), (51, "no host", "<p>Kept</p>"), (None, "http://one.example/", "<p>Alone</p>"), (51, "no host", "<p>Kept</p>")]
    got = {(r["page_id"], r["text"]) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (50, "") in got and (51, "Kept") in got and (None, "Alone") in got
    assert all((i, f"Story number {i} tells {i * i} things of {i * 7}") in got for i in range(12))


def test_copies_of_a_page_are_no_template(spark):
    from bandwatch.llm.templates import extract

    story = "<p>A long story that every copy of this page tells in the same eleven words</p><p>Short end</p>"
    want = "A long story that every copy of this page tells in the same eleven words\nShort end"
    rows = [(i, f"http://copies.example/{i}", f"<body><nav>Menu</nav><article>{story}</article></body>") for i in range(12)]
    rows += [(100 + i, f"http://bare.example/{i}", f"<body>{story}</body>") for i in range(3)]
    rows += [(200 + i, f"http://same.example/{i}", f"<body><article>{story}<p>Page {i}</p></article></body>") for i in range(12)]
    rows += [(300 + i, f"http://half.example/{i}", f"<body><div>Our Site</div><p>Own text {i} of {i * i} words</p><p>One long sentence that half of the pages of this host have</p></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == want for i in [*range(12), 100, 101, 102])
    assert all(got[200 + i] == f"{want}\nPage {i}" for i in range(12))
    assert all(got[300 + i] == f"Own text {i} of {i * i} words\nOne long sentence that half of the pages of this host have" for i in range(6))


def test_classes_find_the_slot_of_the_article(spark):
    from bandwatch.llm.templates import extract

    story = [f"<h2>Title {i}</h2><p>{' '.join(f'word{i}x{j}' for j in range(60))}</p>" for i in range(6)]
    want = [f"Title {i}\n{' '.join(f'word{i}x{j}' for j in range(60))}" for i in range(6)]
    beside = "<div class=a><a>Read {0} too</a></div>"
    page = "<body>" + beside + "<div class=b>{1}</div><div>All rights kept</div></body>"
    rows = [(i, f"http://bare.example/{i}", page.format(i * 7, story[i])) for i in range(6)]
    # An article element elsewhere on the page is not the article.
    rows += [(10 + i, f"http://odd.example/{i}", page.replace("div class=a", "article", 1).replace("</div>", "</article>", 1).format(i * 7, story[i])) for i in range(6)]
    rows += [(20 + i, f"http://marked.example/{i}", f"<body><p>Out {i}</p><article><div>In {i}</div><section>{story[i]}</section></article></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == want and [got[10 + i] for i in range(6)] == want
    assert [got[20 + i] for i in range(6)] == [f"In {i}\n{w}" for i, w in enumerate(want)]


def test_decontamination_of_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(30))
    worse = item.replace("w3 ", "x ")  # an early word: 26 of 26 shingles minus 4
    docs = odd_docs(spark, ODD + [(10, f"pre {item} post"), (11, item.upper()), (12, " ".join(item.split()[:29])), (13, worse), (14, item[: len(item) // 2])])
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (None, "two words")], "item_id long, text string")
    rows = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(rows) == {(10, 7), (11, 7), (12, 7), (None, None)}
    assert rows[10, 7]["start"] == 1 and rows[10, 7]["similarity"] == 1.0 and rows[12, 7]["similarity"] == pytest.approx(25 / 26)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def windows_by_hand(text, item, width=5):
    a, b = text.encode().lower().split(), item.encode().lower().split()
    k, best = min(width, len(b)), 0.0
    for s in range(max(1, len(a) - len(b) + 1)):
        w = a[s : s + len(b)]
        if len(w) >= k:
            best = max(best, decontaminate.similarity(decontaminate.shingles(w, k), decontaminate.shingles(b, k)))
    return best


@settings(max_examples=40, deadline=None)
@given(st.integers(6, 40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 2)), max_size=3), st.integers(0, 12), st.integers(0, 12))
def test_windows_miss_no_match(n, edits, before, after):
    words = [f"w{i}" for i in range(n)]
    item, text = " ".join(words), list(words)
    for at, kind in edits:
        at %= len(text)
        text[at : at + 1] = [[], ["new"], [text[at], "more"]][kind]
        text = text or ["x"]
    text = " ".join(["p"] * before + text + ["q"] * after)
    found = decontaminate.Items([(1, item)], 5, 0.8, decontaminate.RADIUS).matches(text.encode())
    best = windows_by_hand(text, item)
    assert bool(found) == (best >= 0.8) and (not found or found[0][4] == best)


def test_quality_on_held_out_rows_and_odd_rows(spark):
    got = QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = [r for r in got.collect() if r["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    from pyspark.sql import functions as F

    docs = odd_docs(spark)
    none = quality.fit(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"), F.lit(True))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    some = quality.fit(docs, spark.createDataFrame([(3, 1), (3, 0), (6, 0), (5, 1)], "doc_id long, quality int"), F.lit(True))
    assert quality.score(docs, some).count() == len(ODD) and quality.score(docs.limit(0), some).count() == 0
    assert quality.keep_good(docs, some, 0.0).columns == docs.columns


def test_toxic_spans(spark):
    from pyspark.sql import functions as F

    words = [f"{a}{b}" for a in ("sun", "moor", "calm", "river") for b in range(300)]
    rng = np.random.default_rng(3)
    clean = [(200 + i, " ".join(rng.permutation(words)[:14])) for i in range(90)]
    toxic = [(100 + i, " ".join([*rng.permutation(words)[:7], "blorg", *rng.permutation(words)[:7]])) for i in range(40)]
    docs = odd_docs(spark, clean + toxic + ODD)
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic] + [(None, 1), (100, None)], "doc_id long, toxic int")
    tagger = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 0)
    rows = {r["doc_id"]: r for r in toxicity.tag(docs, tagger).collect()}
    assert all(rows[i]["score"] < 0.5 for i, _ in clean)
    for i, text in toxic:
        assert rows[i]["score"] >= 0.5 and [(s["token"], text.encode()[s["begin"] : s["end"]]) for s in rows[i]["spans"]] == [("blorg", b"blorg")]
    assert rows[1]["score"] == rows[2]["score"] == 0.0
    assert {r["score"] for r in toxicity.tag(docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}


def test_chain_marginals_equal_enumeration():
    from itertools import product

    tagger = toxicity.Tagger()
    tagger.moves, tagger.start = np.array([[0.3, -0.7], [0.1, 0.9]]), -0.4
    e = np.array([0.5, -1.0, 2.0, 0.1])
    weight = {y: np.exp(tagger.start * y[0] + (e * y).sum() + sum(tagger.moves[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=4)}
    total = sum(weight.values())
    want = [sum(w for y, w in weight.items() if y[i]) / total for i in range(4)]
    assert tagger.chain(e)[2] == pytest.approx(want)


def test_languages_on_held_out_rows(spark):
    got = QUERIES["op10_language"](spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(docs[r["doc_id"]] == r["lang"] for r in held) >= 0.98 * len(held) and len(got) == len(docs) + 250


def test_language_evidence_and_odd_rows(spark):
    from pyspark.sql import functions as F

    texts = [(i, "the cat and the dog went to the house with the others", "en") for i in range(30)] + [(100 + i, "der hund und die katze sind nicht im haus bei den anderen", "de") for i in range(30)]
    docs = spark.createDataFrame([(i, t, lang, lang + "-host") for i, t, lang in texts], "doc_id long, text string, lang string, source string")
    model = language.fit(docs, F.lit(True))
    assert model.languages == ["de", "en"] and model.of(b"123 !!") is None and model.of("Привет ".encode() * 20) is None
    # A text that says little follows its host.
    more = docs.select("doc_id", "text", "source").union(spark.createDataFrame([(900, "in", "de-host"), (901, "in", "en-host"), (None, None, None)], "doc_id long, text string, source string"))
    rows = {r["doc_id"]: r for r in language.identify(language.of_documents(more, model), model.languages).collect()}
    assert rows[900]["lang"] == "de" and rows[901]["lang"] == "en" and not rows[None]["accepted"]
    pages = spark.createDataFrame([(1, "http://a.example.de/x", '<html lang="de"><p>in</p>'), (2, None, None)], "page_id long, url string, html string")
    assert language.identify(language.of_pages(pages, model), model.languages).count() == 2
    odd = odd_docs(spark)
    kept = language.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    nothing = language.fit(odd.limit(0), F.lit(True))
    assert language.keep_identified(odd, nothing).count() == 0


def test_every_labelled_language_is_learnt(spark):
    from pyspark.sql import functions as F

    rows = []
    for k in range(70):
        words = [bytes([97 + k % 26, 97 + k // 26, 97 + (7 * k + j) % 26, 97 + (k * j + 3) % 26]).decode() for j in range(12)]
        rows += [(1000 * k + i, " ".join(words[(i + j) % 12] for j in range(40)), f"l{k:02}", None) for i in range(3 if k < 64 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit(docs, F.lit(True))
    assert model.languages == [f"l{k:02}" for k in range(70)]
    got = {r["doc_id"]: r for r in language.identify(language.of_documents(docs, model), model.languages).collect()}
    assert all(got[i]["lang"] == lang and got[i]["accepted"] for i, _, lang, _ in rows)
    assert language.keep_identified(docs, model).count() == len(rows)


def test_partial_matching_equals_a_plain_coder(spark):
    import math
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    k = ppm.ORDER
    rows = [(i, t) for i, t in enumerate(["abracadabra", "abra cadabra abra", "the cat", "the hat sat", None, "", "été", "abracadabra"])] + [(None, "Cat CAT")]
    docs = odd_docs(spark, rows)
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 2
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["score"], r["base_score"], r["n_known"], r["train_tokens"]) for r in ppm.score(docs, train).collect()), key=str)
    learnt = [(t or "").encode() for i, t in rows if (i or 0) % 3 != 2]
    counts = [defaultdict(Counter) for _ in range(k + 1)]
    for t in learnt:
        b = bytes([ppm.BEFORE]) * k + t + bytes([ppm.END])
        for i in range(k, len(b)):
            for j in range(k + 1):
                counts[j][b[i - j : i]][b[i]] += 1
    words = Counter(w for t in learnt for w in [*t.lower().split(), None])

    def code(context, symbol):
        gone, log = set(), 0.0
        for j in range(k, -1, -1):
            c = {s: n for s, n in counts[j][context[k - j :]].items() if s not in gone}
            n, q = sum(c.values()), len(c)
            if symbol in c:
                return log + math.log10(c[symbol] / (n + q))
            log += math.log10(q / (n + q)) if q else 0.0
            gone |= set(c)
        return log - math.log10(ppm.SYMBOLS - len(gone))

    want = []
    for i, t in rows:
        raw = (t or "").encode()
        b = bytes([ppm.BEFORE]) * k + raw + bytes([ppm.END])
        own = [*raw.lower().split(), None]
        n, v = sum(words.values()), len(words)
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((i is None, i, sum(code(b[p - k : p], b[p]) for p in range(k, len(b))), base, sum(words[w] > 0 for w in own), n))
    want.sort(key=str)
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want]) and [g[3] for g in got] == pytest.approx([w[3] for w in want])
    seen = b"abrac"[-k:]
    total = sum(10 ** code(bytes([ppm.BEFORE]) * (k - len(seen)) + seen, s) for s in range(256) if s != ppm.BEFORE)
    assert total == pytest.approx(1.0)
    assert ppm.score(docs.limit(0), train).count() == 0
    none = ppm.score(docs.where("doc_id = 6"), F.lit(False)).first()
    assert none["score"] == pytest.approx(-6 * math.log10(ppm.SYMBOLS)) and none["train_tokens"] == 0


def test_long_texts_are_keyed_in_blocks(monkeypatch):
    text = bytes(range(97, 123)) * 40
    whole = ppm.grams(text)
    monkeypatch.setattr(ppm, "SORT_BLOCK", 64)
    assert (np.concatenate(list(ppm.blocks(text))) == whole).all()
    assert (np.concatenate(list(ppm.blocks(text[: 64 * 3 - 1]))) == ppm.grams(text[: 64 * 3 - 1])).all()
