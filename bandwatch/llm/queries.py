"""The registered queries of the training-data operators: thin digests of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bandwatch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("op1_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwatch.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwatch.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_tiff")
def tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is stored as a TIFF; all else is computed from the pages read back from it."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from bandwatch.llm.tiff import read_pages, store_texts

    stored = store_texts(table(spark, sf_dir, "documents"))
    media = F.struct("doc_id", "n_bytes", F.octet_length("file").cast("long").alias("media_bytes"), F.sha2("file", 256).alias("media_sha256"))
    pages = read_pages(stored.select(media.alias("stored"), "file"), "stored", "file").select("stored", "page", "pixels")

    def run(batches):
        """One row per file: its pages follow each other, from page 0 on."""
        import hashlib
        import zlib

        import numpy as np

        from bandwatch.llm.tiff import ROW, feature

        def digest(key, parts):
            payload = b"".join(parts)
            return key | {
                "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
                "feature": feature(np.frombuffer(payload, np.uint8).reshape(-1, ROW)),
            }

        key, parts = None, []
        for batch in batches:
            rows = []
            for k, page, pixels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if page == 0 and key is not None:
                    rows.append(digest(key, parts))
                    parts = []
                key = k
                parts.append(pixels)
            yield pa.RecordBatch.from_pylist(rows, schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([digest(key, parts)], schema)

    long = pa.int64()
    schema = pa.schema([
        ("doc_id", long), ("n_bytes", long), ("payload_bytes", long), ("payload_sha256", pa.string()), ("tail_crc32", long),
        ("media_bytes", long), ("media_sha256", pa.string()), ("feature", pa.string()),
    ])
    types = {long: "long", pa.string(): "string"}
    return pages.mapInArrow(run, ", ".join(f"{f.name} {types[f.type]}" for f in schema))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT item_id, len(w) AS n, least(5, len(w)) AS k, w FROM b WHERE len(w) > 0),
item_shingles AS (
  SELECT item_id, k, s, count(*) AS c FROM (
    SELECT item_id, k, unnest(list_transform(range(1, n - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM items)
  GROUP BY ALL),
doc_shingles AS (
  SELECT r, doc_id, k, len(w) AS words, unnest(range(len(w) - k + 1)) AS p,
    unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT k FROM items) WHERE len(w) >= k),
starts AS (
  SELECT DISTINCT r, doc_id, words, item_id, n, k,
    unnest(range(greatest(0, least(p - (n - k), words - n)), greatest(0, least(p, words - n)) + 1)) AS a
  FROM doc_shingles JOIN item_shingles USING (k, s) JOIN (SELECT item_id, n FROM items) USING (item_id)),
inside AS (
  SELECT r, x.doc_id, item_id, a, n, x.k, x.words, y.s, count(*) AS c FROM starts x JOIN doc_shingles y USING (r)
  WHERE y.k = x.k AND p BETWEEN a AND a + n - x.k GROUP BY ALL),
scored AS (
  SELECT r, doc_id, item_id, a, least(n, words) AS n_words, n - k + 1 AS own, least(n, words) - k + 1 AS there,
    sum(least(i.c, coalesce(j.c, 0))) AS common
  FROM inside i LEFT JOIN item_shingles j USING (item_id, k, s) GROUP BY ALL),
rated AS (SELECT *, common::DOUBLE / (own + there - common)::DOUBLE AS similarity FROM scored)
SELECT doc_id, item_id, a::BIGINT AS start, n_words::BIGINT AS n_words, similarity FROM rated WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY r, item_id ORDER BY similarity DESC, a) = 1
"""


@query("op9_decontamination", OP9_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwatch.llm.decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


@query("op2_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from bandwatch.llm.common import remainder
    from bandwatch.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    voters = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, voters).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (doc_id) and every page (page_id); the model is learnt from four fifths of the documents."""
    from pyspark.sql import functions as F

    from bandwatch.llm.common import remainder
    from bandwatch.llm.language import fit, identify, of_documents, of_pages

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, remainder(F.col("doc_id"), 5) != 0)
    records = of_documents(docs, model).union(of_pages(table(spark, sf_dir, "pages"), model))
    return identify(records, model.languages)


@query("op8_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from bandwatch.llm.common import remainder
    from bandwatch.llm.toxicity import fit, tag

    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    tagger = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return tag(docs, tagger).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.to_json("spans").alias("spans")
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op6_urls")
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwatch.llm.urls import judge, labelled, train

    judged = judge(table(spark, sf_dir, "pages"), URL_RULES, train(labelled(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op7_ppm")
def ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from bandwatch.llm.common import remainder
    from bandwatch.llm.ppm import score

    return score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) != 0)


@query("op5_templates")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from bandwatch.llm.templates import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op11_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it is no long."""
    from pyspark.sql import functions as F

    from bandwatch.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


@query("op12_bpe")
def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from bandwatch.llm.bpe import round_trip

    both = round_trip(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


OP13_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (
  SELECT r, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) AS n
  FROM s WHERE same QUALIFY n <= 5),
h AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.r, n ORDER BY score DESC, other_id) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from bandwatch.llm.lemp import mine

    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, shifted)
