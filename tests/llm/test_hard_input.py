"""Inputs that once crashed an operator, hung it, or lost rows."""

import hashlib
import struct
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bandwatch.llm import decontaminate, language, templates, tiff, toxicity, urls
from bandwatch.llm.queries import QUERIES, URL_RULES

from .test_texts import SF, windows_by_hand


def test_addresses_beyond_the_basic_plane(spark):
    rows = [(1, "http://x.example/" + "\U0002a6df" * 4), (2, "http://x.example/\U000e0067"), (3, "http://é.example")]
    judged = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES, urls.train(urls.labelled(spark))).collect()
    assert len(judged) == 3 and all(0 <= r["probability"] <= 1 for r in judged)


def seconds(f, *args):
    begin = time.perf_counter()
    f(*args)
    return time.perf_counter() - begin


@pytest.mark.parametrize("page", ["<div>{0}</b>{0}", "<p><b>{0}<div>{0}", "<b>{0}<p>{0}</i>{0}"])
def test_open_and_stray_tags_take_linear_time(page):
    first, *others = page.split("{0}")[:-1]
    assert seconds(templates.main_text, "".join(t * 30_000 for t in (first, *others))) < 10


@pytest.mark.parametrize("part", ["<script>", "<!--", "<", "<html ", "<script></script ", "<html lang", "</script", "&"])
def test_unclosed_markup_takes_linear_time(part):
    assert seconds(language.visible, part.encode() * 60_000) < 10


def test_unclosed_elements_hide_the_rest():
    assert language.visible(b"<html lang='de'><p>a<script>b") == (b"  a ", "de")
    assert language.visible(b"a < b <i>c</i> 1 < 2")[0] == b"a  c  1 < 2"


@pytest.mark.parametrize("pair", [("x", "y"), ("one", "two"), ("é", "z"), ("a", "a1"), ("p", "q")])
def test_items_with_repeated_shingles_are_found(pair):
    x, y = pair
    item, text = " ".join((x, y)[i % 2] for i in range(13)), " ".join((y, x)[i % 2] for i in range(13))
    found = decontaminate.Items([(1, item)], 5, 0.8, decontaminate.RADIUS).matches(text.encode())
    assert [(m[1], m[2], m[4]) for m in found] == [(0, 13, 0.8)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("ab"), min_size=6, max_size=24), st.lists(st.sampled_from("abc"), max_size=40))
def test_windows_of_few_words_miss_no_match(item, text):
    item, text = " ".join(item), " ".join(text)
    found = decontaminate.Items([(1, item)], 5, 0.8, decontaminate.RADIUS).matches(text.encode())
    best = windows_by_hand(text, item)
    assert bool(found) == (best >= 0.8) and (not found or found[0][4] == best)


def test_blocks_of_items_add_up(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    kept = sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", -(-bench.count() // 3))
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == kept


def test_pages_behind_a_broken_one_are_read(spark):
    images = [np.full((3, 4), v, np.uint8) for v in (1, 2, 3)]
    data = bytearray(tiff.encode(images, tiff.DEFLATE, 1))
    first = next(tiff.directories(bytes(data)))[1][273][0]
    data[first : first + 2] = b"\xff\xff"
    rows = tiff.read_pages(spark.createDataFrame([(1, bytes(data))], "id long, file binary"), "id", "file").collect()
    assert [(r["page"], r["error"] is None, r["pixels"] and set(r["pixels"])) for r in rows] == [(0, False, None), (1, True, {2}), (2, True, {3})]
    cut = bytearray(tiff.encode(images, tiff.PLAIN, 1))
    struct.pack_into("<I", cut, 4, len(cut) + 9)
    assert [r["page"] for r in tiff.read_pages(spark.createDataFrame([(1, bytes(cut))], "id long, file binary"), "id", "file").collect()] == [-1]


def test_stored_texts_use_every_decoder(spark):
    stored = tiff.store_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    pages = tiff.read_pages(stored, "doc_id", "file")
    seen = {(r["compression"], r["tiled"], r["predictor"]) for r in pages.select("compression", "tiled", "predictor").distinct().collect()}
    assert {c for c, *_ in seen} == {tiff.PLAIN, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE} and {t for _, t, _ in seen} == {True, False} and {p for *_, p in seen} == {1, 2}
    assert pages.where("error IS NOT NULL").isEmpty() and pages.agg(F.max("page")).first()[0] == 2
    one = {r["doc_id"]: r for r in QUERIES["op4_tiff"](spark, "/root/testdata/sf0.01").collect()}
    for r in stored.collect():
        got = one[r["doc_id"]]
        assert (got["media_bytes"], got["media_sha256"]) == (len(r["file"]), hashlib.sha256(r["file"]).hexdigest())
        samples = np.concatenate([p.samples[:, :, 0] for p in tiff.pages(r["file"])])
        assert got["feature"] == tiff.feature(samples) and got["payload_sha256"] == hashlib.sha256(samples.tobytes()).hexdigest()


def test_an_id_with_both_labels_is_no_toxic_witness(spark):
    """The lowest of labels that contradict each other counts."""
    toxic = [(i, f"vile{i} scum words here today number{i} and more") for i in range(30)]
    clean = [(100 + i, f"calm{i} river stone light paper{i} and more") for i in range(60)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    both = [(i, 1) for i, _ in toxic] + [(i, 0) for i, _ in toxic + clean]
    none = toxicity.fit(docs, spark.createDataFrame(both, "doc_id long, toxic int"), F.lit(True))
    assert not none.trained
