"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents is turned into hashed counts (byte trigrams of
the lower-cased text, 4-grams of its shape, word repeats), weighted by inverse
document frequency and reduced by a truncated singular value decomposition. These
vectors and their labels are the model: at most ``SAMPLE`` vectors of ``RANK`` numbers,
whatever the corpus, so they can be sent to every task. Each document of the corpus is
mapped into the same space, multiplied with all labelled vectors in blocks, and its
nearest ones vote with their cosine as weight.

Nulls and odd rows: null and empty texts get the share of label 1 among the labelled;
null ids are kept; rows of ``labels`` without id or label are left out, of repeated or
contradicting labels of an id the lowest counts; repeated rows are scored each; without
any labelled document every score is 0.5; empty tables give no rows; other columns are
ignored, and kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwatch.llm.common import byte_values, per_row, sent, texts
from bandwatch.llm.grams import as_bytes, collapsed, gram_counts, repeats

#: The bound of the labelled sample, the size of the space, and the voters.
SAMPLE, RANK, VOTERS = 4096, 64, 15
TRIGRAMS, SHAPE_GRAMS = 1024, 512
SLOTS = TRIGRAMS + SHAPE_GRAMS + 2
#: Documents multiplied with the labelled vectors at a time.
BLOCK = 512


def counts(text: bytes) -> np.ndarray:
    raw = as_bytes(text.lower())
    return np.concatenate([gram_counts(raw, 3, TRIGRAMS), gram_counts(collapsed(as_bytes(text)), 4, SHAPE_GRAMS), repeats(text)])


class Voters:
    """The labelled vectors, and what maps a text next to them."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.share = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        if not len(rows):
            return
        self.idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))).astype(np.float32) + 1
        # In blocks, so that the driver holds no second copy of the sample.
        x, products = np.empty((len(rows), SLOTS), np.float32), np.zeros((SLOTS, SLOTS))
        for begin in range(0, len(rows), BLOCK):
            part = x[begin : begin + BLOCK] = self.weighted(rows[begin : begin + BLOCK])
            products += part.T.astype(np.float64) @ part
        values, vectors = np.linalg.eigh(products)
        self.space = np.ascontiguousarray(vectors[:, np.argsort(values)[::-1][: min(rank, len(rows))]].astype(np.float32))
        self.vectors = self.unit(x @ self.space)

    def weighted(self, rows: np.ndarray) -> np.ndarray:
        x = np.log1p(rows.astype(np.float32)) * self.idf
        for a, b in ((0, TRIGRAMS), (TRIGRAMS, SLOTS)):
            x[:, a:b] = self.unit(x[:, a:b])
        return x

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, batch: list[bytes]) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, by cosine."""
        out = np.full(len(batch), self.share)
        for begin in range(0, len(batch) if len(self.labels) else 0, BLOCK):
            part = batch[begin : begin + BLOCK]
            cosine = self.unit(self.weighted(np.stack([counts(t) for t in part])) @ self.space) @ self.vectors.T
            k = min(VOTERS, cosine.shape[1])
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 4
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
            some = np.array([bool(t.strip()) for t in part]) & (total > 0)
            out[begin : begin + BLOCK][some] = np.clip(vote[some], 0, 1)
        return out


def sample_of(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, label, text) of at most ``size`` labelled training documents, chosen by a hash of the id.

    Their ids are few enough to reach every task, so that no text is shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        "doc_id is not null and label is not null"
    )
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).where(train)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    return rows


def fit(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Voters:
    """The voters, from at most ``size`` labelled rows for which ``train`` holds."""
    rows = sample_of(docs, labels, label_col, train, size, id_col, text_col)
    made = per_row(rows, "counts binary", lambda: lambda t: (counts(t).astype(np.float32).tobytes(),), carry=2)
    got = made.orderBy("doc_id", "counts").limit(size).toArrow()
    x = np.empty((got.num_rows, SLOTS), np.float32)
    for i, value in enumerate(v for chunk in got["counts"].chunks for v in chunk):
        x[i] = np.frombuffer(value.as_buffer(), np.float32)
    return Voters(x, got["label"].to_numpy())


def score(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per row of ``docs``."""
    load = sent(docs.sparkSession, voters)

    def run(batches):
        model = load()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.scores(list(byte_values(batch.column(1)))))], names=["doc_id", "score"]
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, voters: Voters, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose score is at least ``least``."""
    load, at = sent(docs.sparkSession, voters), docs.columns.index(text_col)

    def run(batches):
        model = load()
        for batch in batches:
            yield batch.filter(pa.array(model.scores(list(byte_values(batch.column(at)))) >= least))

    return docs.mapInArrow(run, docs.schema)
