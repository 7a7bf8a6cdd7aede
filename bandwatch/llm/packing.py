"""Packing token sequences: large items matched in pairs, small ones best-fit.

Documents are tokenized and cut into pieces of at most the capacity. Piece lengths
are integers up to the capacity, so the whole packing is decided on a histogram of
at most ``capacity`` counts, whatever the number of documents:

* pieces over a third of the capacity meet at most in pairs: from the longest down,
  each takes the longest other one that still fits;
* shorter pieces, from the longest down, go to the tightest gap that holds them, and
  open a new sequence only if no gap does.

Equal lengths are handled in bulk, so the plan has a bounded number of entries. Each
piece then finds its place from its rank among the pieces of its length. Ranks come
from a running count inside each task plus an offset for each task and length; no
window or group holds the pieces of one length.

Nulls and odd rows: a null text is empty and gives one piece with the end token; null
ids are kept; repeated rows are packed once each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import sys
import types
import zlib
from array import array
from collections import defaultdict
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwatch.llm.common import byte_values, texts, written

#: Words whose ids a worker remembers: about so many, and as many used before them, of at most so many bytes.
KNOWN_WORDS, WORD_BYTES = 1 << 20, 48
#: Texts encoded at a time.
STEP = 1024


class WordEncoder:
    """Token ids of texts, as little-endian uint32 bytes, for a vocabulary that never
    merges across ASCII white space: each word is encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def of_worker(cls, path: str) -> WordEncoder:
        """The encoder of this Python worker, kept from task to task."""
        store = sys.modules.setdefault("_bandwatch_encoders", types.ModuleType("_bandwatch_encoders"))
        if path not in vars(store):
            vars(store)[path] = cls(path)
        return vars(store)[path]

    def encode(self, batch: list[bytes]) -> list[bytes]:
        words = [t.split() for t in batch]
        here = set().union(*words)
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        missing = list(filterfalse(self.known.__contains__, here))
        if self.older:
            self.known.update((w, self.older[w]) for w in filter(self.older.__contains__, missing))
            missing = list(filterfalse(self.known.__contains__, missing))
        self.known.update(zip(missing, self._plain(missing)))
        ids = self.known.__getitem__
        out = [b"".join(map(ids, ws)) for ws in words]
        for word in missing:
            if len(word) > WORD_BYTES:
                del self.known[word]
        return out

    def _plain(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its task (``slice``) and its rank among equal lengths there."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, own = WordEncoder.of_worker(vocabulary), TaskContext.get().partitionId()
        ranks = [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(list(byte_values(part.column(1))))):
                    ids += end
                    for k, begin in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[begin : begin + 4 * capacity]
                        n = len(piece) // 4
                        rows.append((doc, k, begin // 4, n, zlib.crc32(piece), own, ranks[n]))
                        ranks[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=NAMES)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, slice int, rank long")


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "slice", "rank"]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where the pieces of each length go, and the number of sequences.

    An entry (length, rank, bin, each, offset) places the pieces of that length from
    that rank on, ``each`` to a sequence, from sequence ``bin`` on, behind ``offset``.
    """
    left = {n: c for n, c in counts.items() if c}
    placed: dict[int, int] = defaultdict(int)  # pieces of a length that have their place
    entries: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # ascending
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: first, number
    bins = 0

    def place(length: int, first: int, number: int, each: int, offset: int) -> None:
        entries.append((length, placed[length], first, each, offset))
        placed[length] += number * each

    def offer(gap: int, first: int, number: int) -> None:
        if gap and number:
            if not open_bins[gap]:
                bisect.insort(gaps, gap)
            open_bins[gap].append((first, number))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        spare = bisect.bisect_right(large, capacity - a) - 1
        if spare >= 0 and large[spare] == a and left[a] == 1:
            spare -= 1
        if spare < 0:
            number, b = left[a], 0
            place(a, bins, number, 1, 0)
        elif large[spare] == a:
            number, b = left[a] // 2, a
            place(a, bins, number, 2, 0)
        else:
            b = large[spare]
            number = min(left[a], left[b])
            place(a, bins, number, 1, 0)
            place(b, bins, number, 1, a)
        offer(capacity - a - b, bins, number)
        bins += number
        for n in (a, b) if b else (a,):
            left[n] -= number
            if not left[n]:
                large.remove(n)

    for n in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        k = left[n]
        while k:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                for number, share in ((k // each, each), (1, k % each)):
                    if number and share:
                        place(n, bins, number, share, 0)
                        offer(capacity - share * n, bins, number)
                        bins += number
                break
            gap = gaps[at]
            first, number = open_bins[gap].pop()
            if not open_bins[gap]:
                gaps.pop(at)
            each = min(k, gap // n)
            taken = min(number, k // each)
            place(n, first, taken, each, capacity - gap)
            k -= taken * each
            offer(gap, first + taken, number - taken)
            offer(gap - each * n, first, taken)
    return entries, bins


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece."""
    cut, _ = written(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    by_slice = cut.groupBy("slice", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_slice.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    entries, _ = plan(counts, capacity)
    e = np.array(sorted(entries), np.int64).reshape(-1, 5)
    keys = (e[:, 0] << 48) | e[:, 1]

    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_slice.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = cut.join(offsets, ["slice", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )

    def locate(batches):
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            found = e[np.searchsorted(keys, (length << 48) | rank, "right") - 1]
            i = rank - found[:, 1]
            places = [pa.array(found[:, 2] + i // found[:, 3]), pa.array(found[:, 4] + i % found[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(5)] + places, names=[*NAMES[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(locate, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
