"""Benchmark decontamination: item-sized windows, SimHash, multi-index hashing.

Texts are lower-cased (A-Z) and cut at ASCII white space; shingles are runs of five
words (an item of fewer words is one shingle). A document matches an item if one of
its windows of as many words as the item (the whole text, if it has fewer) has a
weighted Jaccard similarity of shingles of at least ``threshold``.

For each text:

1. Positions whose shingle occurs in any item are found with one hash per word and a
   rolling combination. A window without such a position has similarity zero with
   every item, so the windows over these positions are all that can match.
2. Each such window of an item's size gets a SimHash, from running sums of the
   shingles' bits.
3. The fingerprint's 8 segments look up the items filed under values within
   ``radius // 8`` bits: every item within ``radius`` of the window is found. The whole
   distance is then compared.
4. Counts of whole shingles give the exact similarity of what remains.

At similarity 0.8 the expected distance of windows without repeated shingles is below
10 of 64 bits with a deviation of about 3, so a radius of 24 leaves out no real match in
practice. Repeated shingles outvote the others in a fingerprint, so items that have them
are compared with every window that holds enough of their shingles, whatever its
fingerprint.

Items are sent to the tasks in blocks of bounded number and size. Over one block, each
block's matches are written before the next is collected.

Nulls and odd rows: null or empty texts match nothing; items without words match
nothing; a null item_id or doc_id is carried as null; repeated rows match each (a
repeated item once); empty tables give no rows; other columns are ignored, and kept by
``clean``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.llm.common import byte_values, texts, written

WIDTH, THRESHOLD, RADIUS, SEGMENTS = 5, 0.8, 24, 8
#: Bounds of one block of items.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
# Fixed odd multipliers of the 64-bit mixing steps.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def _roll(values: np.ndarray, width: int) -> np.ndarray:
    """One mixed hash for each run of ``width`` values."""
    n = len(values) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * MIX[0] + values[i : i + n]
    return _mix(out)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)


def shingles(words: list[bytes], width: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(width))))


def similarity(a: Counter, b: Counter) -> float:
    common = (a & b).total()
    return common / (a.total() + b.total() - common) if common else 0.0


class Items:
    """A block of benchmark items, indexed for lookups from windows."""

    def __init__(self, rows: list[tuple], width: int, threshold: float, radius: int):
        self.threshold, self.radius = threshold, radius
        self.words: dict[bytes, int] = {}
        self.items: list[tuple] = []  # id, words, shingle width, shingle counts
        for item_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            words = text.encode().lower().split()
            if words:
                self.items.append((item_id, len(words), min(width, len(words)), shingles(words, min(width, len(words))), words))
                for w in words:
                    self.words.setdefault(w, len(self.words) + 1)
        #: By shingle width: sorted hashes of the items' shingles, and the items that have each.
        self.known: dict[int, tuple[np.ndarray, list[list[int]], np.ndarray]] = {}
        for k in {it[2] for it in self.items}:
            owners: dict[int, set[int]] = {}
            for i, it in enumerate(self.items):
                if it[2] == k:
                    for h in _roll(np.array([self.words[w] for w in it[4]], np.uint64), k).tolist():
                        owners.setdefault(h, set()).add(i)
            hashes = np.array(sorted(owners), np.uint64)
            present = np.zeros(1 << 20, bool)
            present[hashes >> np.uint64(44)] = True
            self.known[k] = hashes, [sorted(owners[h]) for h in hashes.tolist()], present
        #: Items with repeated shingles, and the places of their shingles among the hashes of their width.
        self.repeating: dict[int, np.ndarray] = {}
        for i, it in enumerate(self.items):
            if max(it[3].values()) > 1:
                rolled = _roll(np.array([self.words[w] for w in it[4]], np.uint64), it[2])
                self.repeating[i] = np.unique(np.searchsorted(self.known[it[2]][0], rolled))
        #: By item size: the items, their fingerprints, and the segment tables.
        self.sized: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        reach = radius // SEGMENTS
        distance = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        for n in {it[1] for it in self.items}:
            own = [i for i, it in enumerate(self.items) if it[1] == n]
            prints = np.concatenate([self.prints(self.items[i][4], [0], n, self.items[i][2]) for i in own])
            parts = prints.astype(">u8").view(np.uint8).reshape(-1, SEGMENTS)
            self.sized[n] = np.array(own), prints, np.stack([distance[:, parts[:, s]] <= reach for s in range(SEGMENTS)])

    @staticmethod
    def prints(words: list[bytes], starts, size: int, width: int) -> np.ndarray:
        """Fingerprints of the windows of ``size`` words at ``starts``."""
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(_roll(hashes, width)), axis=0, dtype=np.int32)])
        starts = np.asarray(starts)
        ends = np.minimum(starts + size - width + 1, len(sums) - 1)
        ones = sums[ends] - sums[starts]
        return np.packbits(2 * ones > (ends - starts)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)

    def matches(self, text: bytes) -> list[tuple]:
        """(item_id, start, words, distance, similarity) of the best window for each matching item; start counts words."""
        words = text.lower().split()
        if not words:
            return []
        ids = np.fromiter(map(self.words.get, words, repeat(0)), np.uint64, len(words))
        best: dict[int, tuple] = {}
        for k, (hashes, owners, present) in self.known.items():
            if len(words) < k:
                continue
            rolled = _roll(ids, k)
            at = np.flatnonzero(present[rolled >> np.uint64(44)])
            place = np.minimum(np.searchsorted(hashes, rolled[at]), len(hashes) - 1)
            hit = hashes[place] == rolled[at]
            at, place = at[hit], place[hit]
            if not len(at):
                continue
            touched: dict[int, set[int]] = {}
            for p in set(place.tolist()):
                for i in owners[p]:
                    touched.setdefault(self.items[i][1], set()).add(i)
            for n, wanted in touched.items():
                self._windows(words, at, n, k, wanted, best)
                for i in wanted & self.repeating.keys():
                    self._repeats(words, at[np.isin(place, self.repeating[i])], n, k, i, best)
        return [(self.items[i][0], s, n, d, sim) for i, (sim, s, n, d) in sorted(best.items())]

    def _windows(self, words: list[bytes], at: np.ndarray, n: int, k: int, wanted: set[int], best: dict[int, tuple]) -> None:
        last = max(0, len(words) - n)
        own, prints, tables = self.sized[n]
        keep = np.isin(own, list(wanted))
        # Runs of positions whose windows meet are treated at once.
        for run in np.split(at, np.flatnonzero(np.diff(at) > n) + 1):
            low, high = min(last, max(0, int(run[0]) - (n - k))), min(last, int(run[-1]))
            starts = np.arange(low, high + 1)
            # A window matters if a known shingle begins in it.
            starts = starts[np.searchsorted(run, starts + max(0, n - k), "right") > np.searchsorted(run, starts, "left")]
            if not len(starts):
                continue
            part = words[low : high + n]
            fps = self.prints(part, starts - low, n, k)
            segments = fps.astype(">u8").view(np.uint8).reshape(-1, SEGMENTS)
            found = np.zeros((len(fps), len(own)), bool)
            for s in range(SEGMENTS):
                found |= tables[s][segments[:, s]]
            w, i = np.nonzero(found & keep)
            away = np.bitwise_count(fps[w] ^ prints[i])
            near = away <= self.radius
            for a, b, d in zip(starts[w[near]].tolist(), own[i[near]].tolist(), away[near].tolist()):
                self._compare(words[a : a + n], a, b, k, lambda d=d: d, best)

    def _repeats(self, words: list[bytes], at: np.ndarray, n: int, k: int, i: int, best: dict[int, tuple]) -> None:
        """Every window that holds as many of the item's shingles (at ``at``) as a match needs."""
        last, reach = max(0, len(words) - n), max(0, n - k)
        starts = np.unique(np.concatenate([np.clip(at - back, 0, last) for back in range(reach + 1)]))
        there = np.searchsorted(at, starts + reach, "right") - np.searchsorted(at, starts, "left")
        both = n - k + 1 + min(n, len(words)) - k + 1
        starts = starts[there * (1 + self.threshold) >= self.threshold * both * (1 - 1e-12)]
        own, prints, _ = self.sized[n]
        mine = prints[own == i][0]
        for a in starts.tolist():
            window = words[a : a + n]
            self._compare(window, a, i, k, lambda w=window: int(np.bitwise_count(self.prints(w, [0], n, k)[0] ^ mine)), best)

    def _compare(self, window: list[bytes], start: int, i: int, k: int, distance: Callable[[], int], best: dict[int, tuple]) -> None:
        sim = similarity(shingles(window, k), self.items[i][3])
        if sim >= self.threshold and (i not in best or (sim, -start) > (best[i][0], -best[i][1])):
            best[i] = (sim, start, len(window), distance())


class blocks:
    """The items in blocks of bounded number and bytes, by a hash of the item; each is collected when it is reached."""

    def __init__(self, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text"):
        items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
        n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        self.items, self.parts = items, max(1, -(-n // BLOCK_ITEMS), -(-(size or 0) // BLOCK_BYTES))

    def __iter__(self):
        for part in range(self.parts):
            yield [tuple(r) for r in self.items.where(F.pmod(F.xxhash64("id", "text"), F.lit(self.parts)) == part).collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    width: int = WIDTH, threshold: float = THRESHOLD, radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): the best window of each document and matching item."""
    out, listed = None, blocks(benchmark)
    for rows in listed:
        items = Items(rows, width, threshold, radius)

        def run(batches, items=items):
            for batch in batches:
                found = [(doc, *m) for doc, t in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))) for m in items.matches(t)]
                columns = list(zip(*found)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        part = texts(docs, id_col, text_col).mapInArrow(
            run, "doc_id long, item_id long, start long, n_words long, distance int, similarity double"
        )
        if listed.parts > 1:
            part, _ = written(part, "matches")
        out = part if out is None else out.union(part)
    return out


kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
names = ["doc_id", "item_id", "start", "n_words", "distance", "similarity"]


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns kept, that match no item."""
    at, listed = docs.columns.index(text_col), blocks(benchmark)
    for rows in listed:
        items = Items(rows, how.get("width", WIDTH), how.get("threshold", THRESHOLD), how.get("radius", RADIUS))

        def run(batches, items=items):
            for batch in batches:
                yield batch.filter(pa.array([not items.matches(t) for t in byte_values(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if listed.parts > 1:
            docs, _ = written(docs, "clean")  # the next block's items take this one's place
    return docs
