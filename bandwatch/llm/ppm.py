"""Language-model scores: prediction by partial matching over bytes, trained on the corpus.

The model is the trie of all byte contexts of up to ``ORDER`` bytes in the training
texts. A byte is coded in its longest context; a context that has not seen it escapes to
the next shorter one (method C: the escape has the weight of the number of different
bytes seen), where the bytes that the longer one would have coded are excluded; below
the empty context all bytes left are equally likely. A text ends with a byte that UTF-8
does not have. The trie is static, so excluding follows from counts: what a context has
seen, all its shorter ones have seen, and the totals without excluded bytes depend on
the longer context alone.

The trie may be of any size, so it is never gathered or broadcast. It lives as a table
of grams (context and byte) with counts:

1. Texts are cut into chunks of bounded bytes. A task writes the texts with their chunk,
   and each chunk's different words and grams with their training counts.
2. Words and grams are added up over the chunks by a shuffle each. The code length of
   each gram is computed in groups by the last two context bytes, where all longer
   contexts of a gram live; only the counts of contexts of at most one byte
   (65,536 numbers) are sent to every task.
3. Totals and code lengths go back to the chunks that hold the words and grams, meet the
   texts there, and each text's codes are summed.

Nulls and odd rows: a null text is empty and has its end alone; a null id hashes as the
empty text; repeated rows count and are scored each; without training texts all bytes
are equally likely; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwatch.llm.common import byte_values, written

ORDER = 4
#: Bytes of text in a chunk, and keys sorted at a time.
CHUNK_BYTES, SORT_BLOCK = 16 << 20, 1 << 20
#: Bytes that no UTF-8 text has: before the text, and its end.
BEFORE, END = 0xFE, 0xFF
#: Codes: all bytes but the one that only stands before texts.
SYMBOLS = 255

STORED = "kind int, chunk long, doc_id long, held_out boolean, text binary, word binary, gram long, n long"
_STORED = pa.schema([
    ("kind", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.binary()),
    ("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64()),
])
TEXT, WORD, GRAM = 0, 1, 2


def grams(text: bytes, order: int = ORDER) -> np.ndarray:
    """The key of each coded byte: its context's bytes and itself, the byte lowest."""
    raw = np.frombuffer(bytes([BEFORE]) * order + text + bytes([END]), np.uint8)
    n = len(text) + 1
    out = np.zeros(n, np.int64)
    for i in range(order + 1):
        out = (out << 8) | raw[i : i + n]
    return out


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, and the end as the empty word."""
    words = text.lower().split()
    words.append(b"")
    return words


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


class Chunk:
    """The words and grams of one chunk, with their counts in training texts."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.words: Counter = Counter()
        self.held: set[bytes] = set()
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: dict[bool, list[np.ndarray]] = {False: [], True: []}
        self.size = 0

    def add(self, text: bytes, held_out: bool) -> None:
        self.bytes += len(text) + 64
        if held_out:
            self.held.update(tokens(text))
        else:
            self.words.update(tokens(text))
        for keys in blocks(text):
            self.waiting[held_out].append(keys)
            self.size += len(keys)
            if self.size >= SORT_BLOCK:
                self.flush()

    def flush(self) -> None:
        for held_out, arrays in self.waiting.items():
            if arrays:
                keys = np.sort(np.concatenate(arrays))
                begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                counts = np.diff(np.append(begin, len(keys)))
                self.sums.append((keys[begin], counts * (not held_out)))
        self.waiting, self.size = {False: [], True: []}, 0
        if sum(len(k) for k, _ in self.sums) > SORT_BLOCK:
            self.merge()

    def merge(self) -> None:
        self.sums = [_summed(*(np.concatenate(x) for x in zip(*self.sums)))] if self.sums else []

    def batches(self):
        self.flush()
        self.merge()
        for w in self.held:
            self.words.setdefault(w, 0)
        words, n = pa.array(self.words.keys(), pa.binary()), pa.array(self.words.values(), pa.int64())
        self.words, self.held = Counter(), set()
        yield from _rows(WORD, self.number, len(words), word=words, n=n)
        keys, counts = self.sums[0] if self.sums else (np.zeros(0, np.int64),) * 2
        yield from _rows(GRAM, self.number, len(keys), gram=pa.array(keys), n=pa.array(counts.astype(np.int64)))


def _part(text: bytes, begin: int) -> np.ndarray:
    """The keys of the bytes from ``begin`` on, up to a block of them."""
    stop = min(begin + SORT_BLOCK, len(text) + 1)
    raw = (bytes([BEFORE]) * ORDER + text[:SORT_BLOCK])[: SORT_BLOCK + ORDER] if begin == 0 else text[begin - ORDER : stop]
    raw = np.frombuffer(raw + (bytes([END]) if stop == len(text) + 1 else b""), np.uint8)[: stop - begin + ORDER]
    out = np.zeros(stop - begin, np.int64)
    for i in range(ORDER + 1):
        out = (out << 8) | raw[i : i + stop - begin]
    return out


def blocks(text: bytes):
    """The keys of a text, a very long one in pieces that overlap by a context."""
    if len(text) < SORT_BLOCK:
        yield grams(text)
    else:
        for begin in range(0, len(text) + 1, SORT_BLOCK):
            yield _part(text, begin)


def _rows(kind: int, chunk: int, rows: int, **columns):
    """Record batches of at most 65,536 rows of the stored table."""
    for begin in range(0, rows, 1 << 16):
        size = min(rows - begin, 1 << 16)
        fixed = {"kind": pa.repeat(pa.scalar(kind, pa.int32()), size), "chunk": pa.repeat(pa.scalar(chunk, pa.int64()), size)}
        made = fixed | {k: v.slice(begin, size) for k, v in columns.items()}
        yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(size, f.type)) for f in _STORED], schema=_STORED)


def stored(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Step 1: texts with their chunk, and each chunk's words and grams with training counts."""

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        chunk = Chunk(base)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                raw = list(byte_values(part.column(2)))
                for text, held in zip(raw, part.column(1).to_pylist()):
                    chunk.add(text, held)
                yield from _rows(TEXT, chunk.number, len(raw), doc_id=part.column(0), held_out=part.column(1), text=pa.array(raw, pa.binary()))
                if chunk.bytes >= CHUNK_BYTES:
                    yield from chunk.batches()
                    chunk = Chunk(chunk.number + 1)
        yield from chunk.batches()

    held_out = (~F.coalesce(train, F.lit(False))).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out, F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, STORED)


def code_lengths(keys: np.ndarray, counts: np.ndarray, singles: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 of the probability of each gram.

    ``keys`` and ``counts``: all grams whose contexts end in the same two bytes (or
    several such groups), sorted; ``singles[c, s]``: training counts after one byte.
    """
    seen = counts > 0
    levels = {}  # by order: grams, counts; contexts, totals, different bytes
    for j in range(2, order + 1):
        k, n = _summed(keys[seen] & ((1 << 8 * (j + 1)) - 1), counts[seen])
        c, begin = np.unique(k >> 8, return_index=True)
        total = np.add.reduceat(n, begin) if len(begin) else np.zeros(0, np.int64)
        levels[j] = k, n, c, total, np.diff(np.append(begin, len(k)))
    empty = singles.sum(0)

    def count(j: int, k: np.ndarray) -> np.ndarray:
        if j == 0:
            return empty[k & 255]
        if j == 1:
            return singles[(k >> 8) & 255, k & 255]
        return _found(levels[j][0], levels[j][1], k & ((1 << 8 * (j + 1)) - 1))

    def context(j: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total and different bytes of the order-j context of grams."""
        if j == 0:
            return np.full(len(k), empty.sum()), np.full(len(k), np.count_nonzero(empty))
        if j == 1:
            rows = (k >> 8) & 255
            return singles.sum(1)[rows], np.count_nonzero(singles, axis=1)[rows]
        c = (k >> 8) & ((1 << 8 * j) - 1)
        return _found(levels[j][2], levels[j][3], c), _found(levels[j][2], levels[j][4], c)

    def excluded(j: int, k: np.ndarray) -> np.ndarray:
        """Counts, in the order-j context, of the bytes that the order-(j+1) context has seen."""
        if j == 0:
            return np.where(singles > 0, empty, 0).sum(1)[(k >> 8) & 255]
        above, _, contexts, _, different = levels[j + 1]
        begin = np.cumsum(different) - different
        sums = np.add.reduceat(count(j, above), begin) if len(begin) else np.zeros(0, np.int64)
        return _found(contexts, sums, (k >> 8) & ((1 << 8 * (j + 1)) - 1))

    out, going = np.zeros(len(keys)), np.arange(len(keys))
    above = np.zeros(len(keys), np.int64)  # different bytes of the longer context
    for j in range(order, -1, -1):
        k = keys[going]
        total, different = context(j, k)
        total = total - (excluded(j, k) if j < order else 0)
        fresh = different - above
        n = count(j, k)
        weight = np.where(n > 0, n, np.where(total + fresh > 0, fresh, 1)) / np.maximum(total + fresh, 1)
        out[going] += np.log10(weight)
        going, above = going[n == 0], different[n == 0]
    out[going] -= np.log10(max(1, SYMBOLS - np.count_nonzero(empty)))
    return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``values`` at the places of ``wanted`` in the sorted ``keys``; 0 where absent."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``.

    base_score: the smoothed unigram model's log10 probability of the tokens; score:
    that of the text's bytes.
    """
    rows, _ = written(stored(docs, train, id_col, text_col), "texts")
    by_word = Window.partitionBy("word")
    words = rows.where(F.col("kind") == WORD).select(
        "chunk", "word", F.sum("n").over(by_word).alias("n"), (F.row_number().over(by_word.orderBy("chunk")) == 1).alias("first")
    )
    words, _ = written(words, "words")
    total, different = words.where("first and n > 0").agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    below = total + 0.1 * (different + 1)

    held_grams = rows.where(F.col("kind") == GRAM).select("chunk", "gram", "n")
    summed, _ = written(held_grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    ends = summed.where("n > 0").groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect()  # at most 65,536
    singles = np.zeros((256, 256), np.int64)
    for r in ends:
        singles[r["pair"] >> 8, r["pair"] & 255] = r["n"]

    def coded(group: pa.Table) -> pa.Table:
        group = group.sort_by("gram")
        keys, counts = group["gram"].to_numpy(), group["n"].to_numpy()
        return pa.table({"gram": pa.array(keys), "code": pa.array(code_lengths(keys, counts, singles))})

    last_two = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    codes = summed.groupBy(F.pmod(last_two, F.lit(1021)).alias("group")).applyInArrow(coded, "gram long, code double")

    facts = held_grams.select("chunk", "gram").join(codes, "gram").select("chunk", F.lit(None).cast("binary").alias("word"), "gram", "code")
    unigram = F.log10((F.col("n") + 0.1) / F.lit(float(below)))
    known = words.where("n > 0").select("chunk", "word", F.lit(None).cast("long").alias("gram"), unigram.alias("code"))
    facts = facts.unionByName(known).withColumnRenamed("chunk", "holder")
    unseen = math.log10(0.1 / below)

    def summed_up(texts: pa.Table, facts: pa.Table) -> pa.Table:
        gram = facts.filter(pa.compute.is_valid(facts["gram"])).sort_by("gram")
        keys, codes = gram["gram"].to_numpy(), gram["code"].to_numpy()
        word = facts.filter(pa.compute.is_valid(facts["word"]))
        table = dict(zip(word["word"].to_pylist(), word["code"].to_pylist()))
        sizes, hits, base, full = [], [], [], []
        for text in texts["text"]:
            text = text.as_py()
            words = tokens(text)
            found, n = [c for c in map(table.get, words) if c is not None], len(words)
            sizes.append(n)
            hits.append(len(found))
            base.append(math.fsum(found) + (n - len(found)) * unseen)
            full.append(sum(float(codes[np.searchsorted(keys, k)].sum()) for k in blocks(text)))
        return pa.table({
            "doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(hits, pa.int64()),
            "train_tokens": pa.array([total] * len(sizes), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(full, pa.float64()),
        })

    texts = rows.where(F.col("kind") == TEXT).select("chunk", "doc_id", "held_out", "text")
    return texts.groupBy("chunk").cogroup(facts.groupBy("holder")).applyInArrow(
        summed_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
