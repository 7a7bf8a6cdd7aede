"""Model queries against plain computations over collected rows."""

import math
import zlib

import numpy as np
import pytest

from bandwatch.llm import quality
from bandwatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_query_equals_a_plain_vote(spark):
    """Every document's cosine with every labelled vector, one pair at a time; the nearest fifteen vote with its fourth power."""
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels: dict[int, int] = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r["doc_id"] in texts and r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            labels[r["doc_id"]] = min(labels.get(r["doc_id"], 1), r["quality"])
    assert 0 < len(labels) <= quality.SAMPLE  # nothing is left out of the sample
    known = sorted(labels)
    raw = np.array([quality.counts(texts[i]) for i in known], np.float64)
    idf = np.log((1 + len(known)) / (1 + (raw > 0).sum(0))) + 1

    def weighted(x):
        x = np.log1p(x) * idf
        for a, b in ((0, quality.TRIGRAMS), (quality.TRIGRAMS, quality.SLOTS)):
            x[a:b] /= max(math.sqrt((x[a:b] ** 2).sum()), 1e-12)
        return x

    rows = np.array([weighted(x) for x in raw])
    space = np.linalg.svd(rows, full_matrices=False)[2][: quality.RANK].T
    voters = [(v / np.linalg.norm(v), labels[i]) for v, i in zip(rows @ space, known)]
    got = {r["doc_id"]: r for r in QUERIES["op2_quality"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[::3]:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not texts[i].strip():
            assert r["score"] == pytest.approx(np.mean([y for _, y in voters]), abs=1e-6)
            continue
        x = weighted(quality.counts(texts[i]).astype(np.float64)) @ space
        x /= max(np.linalg.norm(x), 1e-12)
        near = sorted(((max(float(v @ x), 0.0), y) for v, y in voters), reverse=True)[: quality.VOTERS + 1]
        if len(near) > quality.VOTERS and near[-2][0] - near[-1][0] < 1e-5:
            continue  # a tie at the border: either may vote
        near = near[: quality.VOTERS]
        want = sum(c**4 * y for c, y in near) / max(sum(c**4 for c, _ in near), 1e-12)
        assert r["score"] == pytest.approx(want, abs=2e-3), i
        assert r["predicted"] == int(r["score"] >= 0.5)


def test_language_fusion_equals_plain_sums(spark):
    """Text likelihoods, host and domain priors, markup and suffix fused record by record in Python; the likelihoods by plain counts."""
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    from bandwatch.llm import language
    from bandwatch.llm.common import remainder

    docs, pages = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "pages"))
    model = language.fit(docs, remainder(F.col("doc_id"), 5) != 0)
    records = [r.asDict() for r in language.of_documents(docs, model).union(language.of_pages(pages, model)).collect()]
    n = len(model.languages)
    # The sample of the fit holds every training text here, so the trigram table is that of plain counts.
    train = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] and r["text"] is not None]
    assert max(Counter(r["lang"] for r in train).values()) <= language.PER_LANGUAGE
    counts = {x: np.zeros(language.SLOTS) for x in model.languages}
    for r in train:
        counts[r["lang"]] += language.gram_counts(language.as_bytes(language.plain(r["text"].encode())), 3, language.SLOTS)
    table = np.log([(counts[x] + 0.5) / (counts[x] + 0.5).sum() for x in model.languages])
    assert np.allclose(model.table, table)

    def domain(host):
        return None if host is None else ".".join(host.split(".")[-2:])

    sums = defaultdict(lambda: [0.0] * n)
    owns = []
    for r in records:
        own = [math.exp(x) / sum(math.exp(y) for y in r["ll"]) for x in r["ll"]] if r["ll"] else None
        owns.append(own)
        for key in (("all", ""), ("host", r["host"]), ("domain", domain(r["host"])), ("declared", r["declared"]), ("suffix", r["suffix"])):
            if own and key[1] is not None:
                sums[key] = [a + round(b * 1e6) / 1e6 for a, b in zip(sums[key], own)]
    known = Counter(kind for kind, _ in sums)
    got = {(r["doc_id"], r["page_id"]): r for r in QUERIES["op10_language"](spark, SF).collect()}
    assert len(got) == len(records)
    for r, own in zip(records, owns):
        less = lambda key: [max(a - b, 0.0) for a, b in zip(sums[key], own or [0.0] * n)] if key in sums else [0.0] * n
        every, host, dom = less(("all", "")), less(("host", r["host"])), less(("domain", domain(r["host"])))
        logs = []
        for k in range(n):
            everywhere = (every[k] + 1) / (sum(every) + n)
            prior = (dom[k] + language.DOMAIN_WEIGHT * everywhere) / (sum(dom) + language.DOMAIN_WEIGHT)
            x = math.log((host[k] + language.HOST_WEIGHT * prior) / (sum(host) + language.HOST_WEIGHT)) + (r["ll"][k] if r["ll"] else 0.0)
            for kind in ("declared", "suffix"):
                if r[kind] is not None:
                    x += math.log((less((kind, r[kind]))[k] + language.VALUE_WEIGHT) / (every[k] + language.VALUE_WEIGHT * (known[kind] + 1)))
            logs.append(x)
        post = [math.exp(x - max(logs)) for x in logs]
        post = [p / sum(post) for p in post]
        row = got[r["doc_id"], r["page_id"]]
        assert row["probability"] == pytest.approx(max(post), abs=1e-4)
        if sorted(post)[-1] - sorted(post)[-2] > 1e-3:
            assert row["lang"] == model.languages[post.index(max(post))]
        assert row["accepted"] == (bool(r["ll"]) and max(post) >= language.LEAST) or abs(max(post) - language.LEAST) < 1e-3
