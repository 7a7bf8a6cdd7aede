"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are given for documents; the tagger needs them for tokens. A bounded sample of
labelled documents is read, and the words whose presence tells its toxic documents from
the others are found by a likelihood-ratio test. Tokens with these words in toxic
documents are labelled 1, all others 0.

A two-state chain is then trained on these token labels, with hashed features of a word
(itself, its affixes, its shape) and of its neighbours, by gradient descent on the
likelihood. Every document of the corpus is tagged over its whole length by
forward-backward. Marginals aggregate to the offsets of the offending tokens and to a
score: a logistic function, fitted on the sample, of the expected number of toxic tokens,
how many different ones there are, the largest marginal and the length of the text.

Nulls and odd rows: null and empty texts score 0 without spans; null ids are kept; rows
of ``labels`` without id or label are left out, of repeated or contradicting labels of
an id the lowest counts; repeated rows are scored each; without a labelled toxic document
every score is 0; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwatch.llm.common import byte_values, sent, texts
from bandwatch.llm.quality import sample_of

#: Bounds of the sample: documents, and bytes of one.
TOXIC, OTHER, SAMPLE_BYTES = 1500, 3000, 16_384
#: Training tokens kept of a document without a toxic token, and around each toxic one.
CLEAN_TOKENS, AROUND = 80, 10
SLOTS, EPOCHS, RATE, SHRINK = 1 << 16, 25, 0.5, 1e-5
#: Words that a task remembers.
KNOWN = 1 << 19
#: Least documents and lift of a word that tells toxicity, and least marginal that counts.
SUPPORT, LIFT, SOME = 3, 6.0, 0.1

_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def features(word: bytes) -> tuple[int, ...]:
    """Slots of a token: its own four (word, two beginnings, ending), then what it says about the one after and the one before it."""
    core = word.strip(_EDGES)
    h, hashed = xxhash.xxh64_intdigest(core), xxhash.xxh32_intdigest
    return h % SLOTS, hashed(core[:5], 1) % SLOTS, hashed(core[:7], 2) % SLOTS, hashed(core[-3:], 3) % SLOTS, (h >> 20) % SLOTS, (h >> 40) % SLOTS


def independent(found: list[bytes]) -> list[bytes]:
    """The texts without those that share much of their vocabulary with an earlier one.

    Copies of one document would pass for many witnesses of its words. Eight minima
    over hashed words stand for a vocabulary; two in common with one text are much.
    """
    holders: dict[tuple[int, int], int] = {}
    kept = []
    odd = (np.arange(8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for text in found:
        words = {xxhash.xxh64_intdigest(w) for w in tokens(text)}
        if not words:
            continue
        h = np.fromiter(words, np.uint64, len(words))
        keys = list(enumerate(((h[:, None] * odd) ^ (h[:, None] >> np.uint64(31))).min(0).tolist()))
        if max(Counter(holders[k] for k in keys if k in holders).values(), default=0) < 2:
            for k in keys:
                holders.setdefault(k, len(kept))
            kept.append(text)
    return kept


def telling(toxic: list[set[bytes]], other: list[set[bytes]]) -> set[bytes]:
    """The words whose presence tells toxic documents from others, by a likelihood-ratio test."""
    m, n = len(toxic), len(other)
    clean = Counter(w for d in other for w in d)

    def fit(k: int, total: int, x: float) -> float:
        return (k * math.log(x) if k else 0.0) + ((total - k) * math.log(1 - x) if total > k else 0.0)

    count = Counter(w for d in toxic for w in d)
    least = 2 * math.log(len(count) or 1)  # the ratio that one of so many words reaches by chance
    found = set()
    for word, k in count.items():
        c = clean[word]
        p, q, r = k / m, c / n if n else 0.0, (k + c) / (m + n)
        if k >= SUPPORT and p > LIFT * q and 2 * (fit(k, m, p) + fit(c, n, q) - fit(k, m, r) - fit(c, n, r)) >= least:
            found.add(word)
    return found


class Tagger:
    """Weights of a two-state chain; state 1 is toxic."""

    def __init__(self):
        self.weights, self.moves, self.start = np.zeros(SLOTS), np.zeros((2, 2)), -3.0
        self.trained, self.blend = False, np.zeros(5)

    def settle(self, x: np.ndarray, y: np.ndarray, rounds: int = 30) -> None:
        """Fit the document score to labels by Newton's method."""
        b = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            w = p * (1 - p) + 1e-9
            hessian = (x * w[:, None]).T @ x + 0.1 * np.eye(len(b))
            b += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * b)
        self.blend = b

    def chain(self, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward ratios, backward ratios times emissions, and marginals of state 1."""
        (a00, a01), (a10, a11) = np.exp(self.moves).tolist()
        e = np.exp(np.clip(emissions, -30, 30)).tolist()
        first = e[0] * math.exp(self.start)
        forward = np.array(list(accumulate(e[1:], lambda r, x: x * (a01 + a11 * r) / (a00 + a10 * r), initial=first)))
        back = np.array(list(accumulate(e[:0:-1], lambda s, x: (a10 + a11 * x * s) / (a00 + a01 * x * s), initial=1.0))[::-1])
        odds = forward * back
        return forward, back * np.array(e), odds / (1 + odds)

    def train(self, sequences: list[tuple[list[bytes], np.ndarray]]) -> None:
        """``sequences``: tokens and their labels."""
        words = {w for ws, _ in sequences for w in ws}
        index = {w: i for i, w in enumerate(sorted(words))}
        slots = np.array([features(w) for w in index])
        own, beside = slots[:, :4], slots[:, 4:]
        rows, sizes = [np.array([index[w] for w in ws]) for ws, _ in sequences], [len(ws) for ws, _ in sequences]
        gold, total = [y for _, y in sequences], sum(sizes)
        edges = Counter()
        for y in gold:
            edges.update(zip(y[:-1].tolist(), y[1:].tolist()))
        seen = np.array([[edges[a, b] for b in (0, 1)] for a in (0, 1)], float)
        square, square_moves = np.full(SLOTS, 1e-8), np.full((2, 2), 1e-8)
        for _ in range(EPOCHS):
            mine, after, before = self.weights[own].sum(1), self.weights[beside[:, 0]], self.weights[beside[:, 1]]
            gap_own, gap_after, gap_before = (np.zeros(len(index)) for _ in range(3))
            expected = np.zeros((2, 2))
            grow = np.exp(self.moves)
            for row, y in zip(rows, gold):
                forward, ahead, p = self.chain(_emissions(row, mine, after, before))
                d = y - p
                np.add.at(gap_own, row, d)
                np.add.at(gap_after, row[:-1], d[1:])
                np.add.at(gap_before, row[1:], d[:-1])
                if len(row) > 1:
                    r, x = forward[:-1], ahead[1:]
                    joint = np.stack([np.full(len(r), grow[0, 0]), grow[0, 1] * x, grow[1, 0] * r, grow[1, 1] * r * x])
                    expected += (joint / joint.sum(0)).sum(1).reshape(2, 2)
            g = -SHRINK * total * self.weights
            np.add.at(g, own.ravel(), np.repeat(gap_own, own.shape[1]))
            np.add.at(g, beside[:, 0], gap_after)
            np.add.at(g, beside[:, 1], gap_before)
            square += g * g
            self.weights += RATE * g / np.sqrt(square)
            moved = seen - expected
            square_moves += moved * moved
            self.moves += 0.2 * moved / np.sqrt(square_moves)
        self.trained = True


def _emissions(row: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    e = own[row].copy()
    e[1:] += after[row[:-1]]
    e[:-1] += before[row[1:]]
    return e


class Lexicon:
    """The emission parts of the words met so far, up to ``KNOWN`` of them."""

    def __init__(self, tagger: Tagger):
        self.tagger, self.weights = tagger, tagger.weights.tolist()
        self._empty()

    def _empty(self) -> None:
        self.index: dict[bytes, int] = {}
        self.parts = np.zeros((1024, 3))

    def marginals(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > KNOWN:
            self._empty()
        index, w = self.index, self.weights
        for word in words:
            if word not in index:
                i = index[word] = len(index)
                if i == len(self.parts):
                    self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
                a, b, c, d, after, before = features(word)
                self.parts[i] = w[a] + w[b] + w[c] + w[d], w[after], w[before]
        row = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        return self.tagger.chain(_emissions(row, self.parts[:, 0], self.parts[:, 1], self.parts[:, 2]))[2]

    def summary(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """What the document's score depends on, and the marginals of its tokens."""
        words = tokens(text)
        p = self.marginals(words) if words else np.zeros(0)
        some = np.flatnonzero(p >= SOME)
        kinds: dict[bytes, float] = {}
        for i in some.tolist():
            core = words[i].strip(_EDGES)
            kinds[core] = max(kinds.get(core, 0.0), p[i])
        most = p.max() if len(p) else 0.0
        return np.array([1.0, math.log1p(p[some].sum()), math.log1p(sum(kinds.values())), most, math.log1p(len(words))]), p

    def score(self, text: bytes) -> tuple[float, list[int]]:
        """The document's score, and the numbers of its offending tokens."""
        if not self.tagger.trained or not text.strip():
            return 0.0, []
        x, p = self.summary(text)
        return float(1 / (1 + math.exp(-np.clip(x @ self.tagger.blend, -30, 30)))), np.flatnonzero(p >= 0.5).tolist()


def fit(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """A tagger from at most ``TOXIC`` and ``OTHER`` labelled rows of each kind for which ``train`` holds."""
    tagger, parts = Tagger(), {}
    lowest = labels.groupBy("doc_id").agg(F.min(label_col).alias(label_col))  # of labels that contradict each other
    for label, size in ((1, TOXIC), (0, OTHER)):
        rows = sample_of(docs, lowest.where(F.col(label_col) == label), label_col, train, size, id_col, text_col)
        rows = rows.where(F.octet_length("text") <= SAMPLE_BYTES).select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(size)
        parts[label] = sorted({t.encode() for t in rows.toArrow()["text"].to_pylist()})
    return train_on(tagger, parts)


def train_on(tagger: Tagger, parts: dict[int, list[bytes]]) -> Tagger:
    """Train a tagger on the texts of either label."""
    if not parts[1]:
        return tagger
    parts = {label: independent(found) for label, found in parts.items()}
    cores = {label: [[w.strip(_EDGES) for w in tokens(t)] for t in ts] for label, ts in parts.items()}
    told = telling([set(c) for c in cores[1]], [set(c) for c in cores[0]])
    sequences = []
    for label, ts in parts.items():
        for text, core in zip(ts, cores[label]):
            words = tokens(text)
            y = np.array([label == 1 and c in told for c in core], float)
            at = np.flatnonzero(y)
            if not len(words) or label == 1 and not len(at):
                continue
            if not len(at):
                begin = xxhash.xxh32_intdigest(text) % max(1, len(words) - CLEAN_TOKENS)
                at = np.array([begin + CLEAN_TOKENS // 2])
            reach = AROUND if label else CLEAN_TOKENS // 2
            for run in np.split(at, np.flatnonzero(np.diff(at) > 2 * reach) + 1):
                a, b = max(0, int(run[0]) - reach), int(run[-1]) + reach + 1
                sequences.append((words[a:b], y[a:b]))
    if any(y.any() for _, y in sequences):
        tagger.train(sequences)
        lexicon = Lexicon(tagger)
        x = np.stack([lexicon.summary(t)[0] for label in (0, 1) for t in parts[label]])
        tagger.settle(x, np.repeat([0.0, 1.0], [len(parts[0]), len(parts[1])]))
    return tagger


def tag(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans): one row per row of ``docs``; a span is the byte offset, end and token of an offending token."""
    load = sent(docs.sparkSession, tagger)

    def run(batches):
        lexicon = Lexicon(load())
        for batch in batches:
            scores, spans = [], []
            for text in byte_values(batch.column(1)):
                score, hits = lexicon.score(text)
                scores.append(score)
                wanted = set(hits)
                found = (m for i, m in enumerate(_WORDS.finditer(text)) if i in wanted) if hits else ()
                spans.append([{"begin": m.start(), "end": m.end(), "token": m[0].decode("utf-8", "replace")} for m in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, _SPANS)], names=["doc_id", "score", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, spans array<struct<begin: long, end: long, token: string>>")


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("token", pa.string())]))
