"""Language identification by Bayesian fusion of evidence.

Records come from texts with a host (a document's source) or from web pages. Four kinds
of evidence meet in one posterior over the languages of the training texts:

* the text: a naive Bayes likelihood of its byte trigrams, tempered so that no text
  counts for more than ``EVIDENCE`` trigrams;
* the declared markup language and the address suffix: likelihoods of the value given
  the language;
* the host: a prior, smoothed towards its domain's, which is smoothed towards that of
  the whole collection.

The last three are estimated from all records: the text posteriors are summed by value
in one grouped aggregation with partial sums, and each record's own share is taken out
again before its posterior is formed. The sums are written once; their true size lets
Spark choose between broadcast and (skew-splitting) shuffle joins.

Nulls and odd rows: a missing value of any kind is no evidence; a text without letters
has no likelihood, is judged by the rest and never accepted, like one far from all
languages learnt; null ids are kept; repeated
rows are judged each; without training texts no language is known and nothing accepted;
empty tables give no rows; other columns are ignored, and kept by ``keep_identified``.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwatch.llm.common import Numbered, byte_values, sent, written
from bandwatch.llm.grams import as_bytes, gram_counts

#: Training texts of each language, hashed trigram slots, and the trigrams that a text counts for at most.
PER_LANGUAGE, SLOTS, EVIDENCE = 500, 1 << 13, 120
#: Weights of smoothing, in records.
HOST_WEIGHT, DOMAIN_WEIGHT, VALUE_WEIGHT = 20.0, 20.0, 1.0
#: Least posterior of an accepted language.
LEAST = 0.5
#: A text of at least so many trigrams that falls so far (nats a trigram) below its best language's mean is in none of them.
FOREIGN_SIZE, FOREIGN_MARGIN = 40, 4.0

#: What an element or comment hides ends with the page if nothing closes it. No pattern reads a byte many times.
_HIDDEN = re.compile(rb"(?is)<(script|style|template|noscript)\b.*?(?:</\1\s*+>|\Z)|<!--.*?(?:-->|\Z)")
_TAGS = re.compile(rb"<[^>]*>")
_DECLARED = re.compile(rb"(?is)<html\b[^<>]*?\slang\s*+=\s*[\"']?([a-z]{2,3})\b")
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
_MARKS = bytes.maketrans(b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\r\x0b\x0c", b" " * 47)


class Likelihood:
    """Log probabilities of hashed trigrams in each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(1, keepdims=True)) if len(languages) else np.zeros((0, SLOTS))
        self.mean = (self.table * counts).sum(1) / np.maximum(1, counts.sum(1))

    def of(self, text: bytes) -> list[float] | None:
        """Tempered log likelihood in each language; None without letters or in a language that was not learnt."""
        raw = as_bytes(plain(text))
        if not _LETTERS[raw].any():
            return None
        c = gram_counts(raw, 3, SLOTS)
        ll, n = self.table @ c, int(c.sum())
        if len(ll) and n >= FOREIGN_SIZE and (ll / n - self.mean).max() < -FOREIGN_MARGIN:
            return None
        ll *= min(1.0, EVIDENCE / max(1, n))
        return (ll - ll.max()).tolist() if len(ll) else []


def plain(text: bytes) -> bytes:
    """Lower case (A-Z), signs and digits as spaces, a space at both ends."""
    return b" " + b" ".join(text.lower().translate(_MARKS).split()) + b" "


def visible(page: bytes) -> tuple[bytes, str | None]:
    """What a page shows, and the language that its markup declares."""
    found = _DECLARED.search(page)
    shown = _HIDDEN.sub(b" ", page)
    end = shown.rfind(b">") + 1  # no tag closes behind it
    shown = _TAGS.sub(b" ", shown[:end]) + shown[end:]
    if b"&" in shown:
        shown = html.unescape(shown.decode("utf-8", "replace")).encode("utf-8", "replace")
    return shown, found[1].decode().lower() if found else None


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Likelihood:
    """The likelihood of every labelled language, from at most ``per_language`` texts of each, chosen by a hash of the id."""
    labelled = docs.where(train).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    named = F.col(lang_col).cast("string").alias("lang")
    languages = sorted(r["lang"] for r in labelled.select(named).distinct().collect())
    if not languages:
        return Likelihood([], np.zeros((0, SLOTS)))
    ids = [F.col(id_col).cast("long").alias("doc_id"), named]
    # A bounded top-n of each language, cut in the tasks before any group meets.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = labelled.select(*ids).withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank")
    rows = labelled.select(*ids, F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                sums[lang] = sums.get(lang, 0) + gram_counts(as_bytes(plain(text)), 3, SLOTS).astype(np.int64)
        some = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([sums[x].tobytes() for x in some], pa.binary())], names=["lang", "sums"])

    # As many partial sums as tasks hold sampled texts: bounded by the sample.
    counts = {lang: np.zeros(SLOTS, np.int64) for lang in languages}
    for r in rows.select("lang", "text").repartition(4).mapInArrow(run, "lang string, sums binary").collect():
        counts[r["lang"]] += np.frombuffer(r["sums"], np.int64)
    return Likelihood(languages, np.stack([counts[lang] for lang in languages]))


RECORD = "doc_id long, page_id long, host string, declared string, suffix string, ll array<double>"


def of_documents(docs: DataFrame, model: Likelihood, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Records of texts, with their source as host."""
    load = sent(docs.sparkSession, model)

    def run(batches):
        likelihood = load()
        for b in batches:
            nothing = pa.nulls(b.num_rows, pa.string())
            ll = pa.array([likelihood.of(t) for t in byte_values(b.column(1))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.int64()), b.column(2), nothing, nothing, ll], names=_NAMES)

    host = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"))
    return host.mapInArrow(run, RECORD)


_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def of_pages(pages: DataFrame, model: Likelihood, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records of web pages, with host and suffix of the address and the declared language."""
    load = sent(pages.sparkSession, model)

    def run(batches):
        likelihood = load()
        for b in batches:
            seen = [visible(t) for t in byte_values(b.column(1))]
            ll = pa.array([likelihood.of(t) for t, _ in seen], pa.list_(pa.float64()))
            declared = pa.array([d for _, d in seen], pa.string())
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(0), b.column(2), declared, b.column(3), ll], names=_NAMES)

    host = F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.when(host != "", host)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    return rows.withColumn("suffix", F.substring_index("host", ".", -1)).mapInArrow(run, RECORD)


def _softmax(logs: Column) -> Column:
    return F.transform(logs, lambda x: F.exp(x) / F.aggregate(logs, F.lit(0.0), lambda a, y: a + F.exp(y)))


def evidence(records: DataFrame, languages: list[str]) -> DataFrame:
    """(kind, value, sums): text posteriors summed by host, domain, declared language, suffix, and over all."""
    own = _softmax(F.col("ll"))
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), value.alias("value"))
            for kind, value in (
                ("all", F.lit("")), ("host", F.col("host")), ("domain", domain(F.col("host"))),
                ("declared", F.col("declared")), ("suffix", F.col("suffix")),
            )
        ]
    )
    rows = records.where("ll is not null").select(own.alias("own"), F.explode(kinds).alias("k")).where("k.value is not null")
    # Rounded to whole micro-records, so that sums do not depend on their order.
    sums = [F.sum(F.round(F.col("own")[i] * 1_000_000).cast("long")) for i in range(len(languages))]
    return rows.groupBy(F.col("k.kind").alias("kind"), F.col("k.value").alias("value")).agg(
        F.transform(F.array(*sums) if sums else F.lit([]).cast("array<bigint>"), lambda x: x / 1_000_000).alias("sums")
    )


def domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def posterior(records: DataFrame, sums: DataFrame, languages: list[str]) -> DataFrame:
    """``records`` with ``post``: the posterior probability of each language.

    ``sums`` is a written table; the joins keep every record and every other column.
    """
    n = len(languages)
    total = sums.where("kind = 'all'").select(F.col("sums").alias("_all")).scalar()
    out = records.withColumn("_all", total).withColumn("_domain_key", domain(F.col("host")))
    for kind, key in (("host", "host"), ("domain", "_domain_key"), ("declared", "declared"), ("suffix", "suffix")):
        part = sums.where(F.col("kind") == kind).select(F.col("value").alias(f"_{kind}_value"), F.col("sums").alias(f"_{kind}"))
        out = out.join(part, F.col(key) == F.col(f"_{kind}_value"), "left").drop(f"_{kind}_value")
    for kind in ("declared", "suffix"):
        out = out.withColumn(f"_{kind}_known", sums.where(F.col("kind") == kind).agg(F.count("*")).scalar())
    schema = T.StructType([*records.schema.fields, T.StructField("post", T.ArrayType(T.DoubleType()))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for b in batches:
            kept = [b.column(f.name).cast(f.type) for f in list(target)[:-1]]
            post = _posteriors(b, n).tolist() if n else [[]] * b.num_rows
            yield pa.RecordBatch.from_arrays([*kept, pa.array(post, target.field("post").type)], schema=target)

    return out.mapInArrow(run, schema)


def _posteriors(b: pa.RecordBatch, n: int) -> np.ndarray:
    """A row of posterior probabilities for each joined record."""

    def matrix(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = b.column(name)
        valid, out = column.is_valid().to_numpy(zero_copy_only=False), np.zeros((b.num_rows, n))
        out[valid] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        return out, valid[:, None]

    def softmax(logs: np.ndarray) -> np.ndarray:
        e = np.exp(logs - logs.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    ll, judged = matrix("ll")
    own = np.where(judged, softmax(ll), 0.0)

    def less(kind: str) -> tuple[np.ndarray, np.ndarray]:  # sums of the other records
        sums, known = matrix(f"_{kind}")
        x = np.where(known, np.maximum(sums - own, 0.0), 0.0)
        return x, x.sum(1, keepdims=True)

    (every, every_n), (by_host, host_n), (by_domain, domain_n) = less("all"), less("host"), less("domain")
    everywhere = (every + 1.0) / (every_n + n)
    prior = (by_domain + DOMAIN_WEIGHT * everywhere) / (domain_n + DOMAIN_WEIGHT)
    logs = np.log((by_host + HOST_WEIGHT * prior) / (host_n + HOST_WEIGHT)) + ll
    for kind in ("declared", "suffix"):
        known = b.column(f"_{kind}_known").to_numpy(zero_copy_only=False)[:, None]
        given = (less(kind)[0] + VALUE_WEIGHT) / (every + VALUE_WEIGHT * (known + 1))
        logs += np.where(b.column(kind).is_valid().to_numpy(zero_copy_only=False)[:, None], np.log(given), 0.0)
    return softmax(logs)


def decide(judged: DataFrame, languages: list[str], least: float = LEAST) -> DataFrame:
    """Adds lang (the likeliest, the first of equals), probability and accepted."""
    names = F.array(*[F.lit(x) for x in languages]) if languages else F.lit([]).cast("array<string>")
    best = F.array_max("post")
    lang = F.when(F.size("post") > 0, F.get(names, (F.array_position("post", best) - 1).cast("int")))
    accepted = F.col("ll").isNotNull() & lang.isNotNull() & (best >= least)
    return judged.withColumns({"lang": lang, "probability": best, "accepted": accepted})


def identify(records: DataFrame, languages: list[str], least: float = LEAST) -> DataFrame:
    """(doc_id, page_id, lang, probability, accepted): one row per record."""
    kept, _ = written(records, "language")
    sums, _ = written(evidence(kept, languages), "evidence")
    return decide(posterior(kept, sums, languages), languages, least).select("doc_id", "page_id", "lang", "probability", "accepted")


def keep_identified(docs: DataFrame, model: Likelihood, least: float = LEAST, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose language is accepted; hosts count, addresses and markup do not exist here.

    Decisions are made on a narrow table and applied to the rows by their places.
    """
    load = sent(docs.sparkSession, model)

    def make():
        likelihood = load()
        return lambda text: (likelihood.of(text),)

    stored = Numbered(docs, text_col, "ll array<double>", make, "language")
    nothing = F.lit(None).cast("string")
    records = stored.narrow(F.col(f"`{host_col}`").cast("string").alias("host"), nothing.alias("declared"), nothing.alias("suffix"))
    sums, _ = written(evidence(records, model.languages), "evidence")
    judged = decide(posterior(records, sums, model.languages), model.languages, least)
    return stored.only(judged.where("accepted").select("slice", "place"))
