"""Hard-negative mining by coordinate pruning over length buckets (after LEMP).

All rows are sorted by label and falling length and cut into buckets of at most ``BUCKET``
rows. A bucket keeps its longest length and, per coordinate, its rows in the order of
that coordinate of the unit vector. An anchor q meets a bucket with a threshold t on the
inner product. If t > |q| * longest, the bucket is skipped. Otherwise a row that reaches
t has a cosine of at least t / (|q| * longest), an angle of at most d; then for every
coordinate f its angle to axis f differs from the anchor's by at most d, so its value
lies between cos(a + d) and cos(a - d). For the anchor's ``FOCUS`` largest coordinates
these ranges are looked up in the sorted lists, the shortest list gives candidates, the
others intersect them, and what is left is verified with exact whole-number products.
Anchors whose ranges hold most of a bucket are verified together, by one matrix product.

Thresholds: for positives, the k-th best of the same label so far; for negatives, the
least score that some positive still admits (half its score, or its third best so far).
They rise while a block of anchors meets the buckets of a stripe; every bound is one that
the final lists reach, and equal scores are kept for ties, so nothing is lost.

On Spark: buckets and blocks of anchors are rows of bounded size. Buckets are dealt to
stripes of about ``DEPTH``, blocks to groups of about ``SPAN``; each pair of stripe and group
is one co-group of bounded size (for positives, only stripes with a label of the block).
Co-groups give out their best, which windows merge. No label, hot or not, comes together
in one task, and the driver sees counts only. Products are exact: in doubles while they
stay under 2^53, else in Python's whole numbers; a score that is no long counts as the
nearest long. Building the result writes vectors, buckets, anchors and positives.

Nulls and odd rows: rows with a null label, a null vector, or a null or non-finite
component take no part; a null id sorts before all others and is no anchor; repeated rows
count each, and an anchor's copy under the same id is another row; shorter vectors end in
zeros; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwatch.llm.common import NULL_ID, written
from bandwatch.llm.vectors import matrices, packed, unpacked

BUCKET, ANCHORS, FOCUS = 4096, 512, 4
#: Buckets of a stripe and blocks of a group, as a rule.
DEPTH, SPAN = 8, 256
#: Share of a bucket above which ranges do not prune.
DENSE = 0.5
#: Slack on angles, for the rounding of lengths and cosines.
SLACK = 1e-9

BUCKETS = "bucket long, label_list array<long>, ids binary, labels binary, row_list array<long>, vectors array<binary>, orders binary"
LEAST = np.iinfo(np.int64).min


def numbered(embeddings: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, x, norm, row): the rows that take part, with their vectors packed; written."""
    rows = embeddings.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector")
    ).where("label IS NOT NULL")

    def run(batches):
        for batch in batches:
            for part, numbers in matrices(batch, 2):
                norm = np.sqrt((numbers.astype(np.float64) ** 2).sum(1))
                columns = [part.column(0), part.column(1), pa.array(packed(numbers), pa.binary()), pa.array(norm)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "x", "norm"])

    listed = rows.mapInArrow(run, "id long, label long, x binary, norm double").withColumn("row", F.monotonically_increasing_id())
    return written(listed, "vectors")[0]


def width(vectors: list[bytes]) -> int:
    return max(((len(v) - 1) // v[0] for v in vectors if v), default=0)


def buckets(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` in order of label and falling length, cut into buckets with their sorted coordinate lists; written."""
    tasks = max(1, -(-rows.count() // (4 * size)))
    names = [c.split()[0] for c in BUCKETS.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]

    def bucket(number: int, t: pa.Table) -> pa.RecordBatch:
        ids, labels, vectors = t.column("id").to_numpy(), t.column("label").to_numpy(), t.column("x").to_pylist()
        norm = t.column("norm").to_numpy()
        unit = unpacked(vectors, width(vectors)) / np.where(norm > 0, norm, 1.0)[:, None]
        orders = np.argsort(unit, axis=0, kind="stable").T.astype("<u2")
        values = [number, np.unique(labels).tolist(), ids.tobytes(), labels.tobytes(), t.column("row").to_pylist(), vectors, orders.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId(), None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows >= size:
                yield bucket(number, held.slice(0, size))
                held, number = held.slice(size), number + tasks
        if held is not None and held.num_rows:
            yield bucket(number, held)

    ordered = rows.repartitionByRange("label", F.desc("norm"), "id", "row").sortWithinPartitions("label", F.desc("norm"), "id", "row")
    return written(ordered.coalesce(tasks).mapInArrow(run, BUCKETS), "buckets")[0]


@dataclass
class Block:
    """Vectors of a bucket or of anchors, with exact numbers."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    longest: float
    orders: np.ndarray

    @classmethod
    def listed(cls, table: pa.Table) -> list[Block]:
        return [cls.of(*(table.column(n)[i].as_py() for n in ("ids", "labels", "row_list", "vectors", "orders"))) for i in range(table.num_rows)]

    @classmethod
    def of(cls, ids: bytes, labels: bytes, rows: list[int], vectors: list[bytes], orders: bytes) -> Block:
        x = unpacked(vectors, width(vectors))
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        lists = np.frombuffer(orders, "<u2").reshape(-1, len(vectors))
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.array(rows), x, norm, float(norm.max()), lists)

    def products(self, other: Block, own, others) -> np.ndarray:
        """Exact inner products of some rows with some rows of ``other``."""
        d = min(self.x.shape[1], other.x.shape[1])
        a, b = self.x[own, :d], other.x[others, :d]
        if self.longest * other.longest < 2.0**52:  # partial sums too, by Cauchy and Schwarz
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return np.clip(a.astype(object) @ b.astype(object).T, LEAST, ~LEAST).astype(np.int64)


def reaching(anchors: Block, bucket: Block, least: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs of ``asked`` anchors with a score of at least ``least[anchor]``, by coordinate pruning."""
    nothing = np.zeros(0, np.int64)
    found = [(nothing, nothing, nothing)]
    n, every = len(bucket.ids), np.arange(len(bucket.ids))
    reach = anchors.norm * bucket.longest
    alive = np.flatnonzero(asked & (least <= reach * (1 + SLACK)))
    cosine = np.divide(least[alive], reach[alive], out=np.full(len(alive), -1.0), where=(least[alive] > 0) & (reach[alive] > 0))
    delta = np.where(cosine > 0, np.arccos(np.clip(cosine, -1, 1)) + SLACK, np.pi)
    d = min(anchors.x.shape[1], bucket.x.shape[1])  # an anchor's coordinates beyond the bucket's are not looked at
    dense = delta >= np.pi / 2 - SLACK  # any row may be within reach
    unit = anchors.x[alive, :d] / np.maximum(anchors.norm[alive], 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    begins, ends = (np.zeros(focus.shape, np.int64) for _ in range(2))
    lows, highs = (np.zeros(focus.shape) for _ in range(2))
    values = bucket.x / np.where(bucket.norm > 0, bucket.norm, 1.0)[:, None]
    for f in np.unique(focus[~dense]):
        who, at = np.nonzero((focus == f) & ~dense[:, None])
        angle = np.arccos(np.clip(unit[who, f], -1, 1))
        low, high = np.cos(np.minimum(np.pi, angle + delta[who])) - SLACK, np.cos(np.maximum(0, angle - delta[who])) + SLACK
        line = values[bucket.orders[f], f]
        lows[who, at], highs[who, at] = low, high
        begins[who, at], ends[who, at] = np.searchsorted(line, low, "left"), np.searchsorted(line, high, "right")
    held = ends - begins
    dense |= held.min(1, initial=n) > DENSE * n if focus.shape[1] else True
    for i in np.flatnonzero(~dense):
        shortest = int(np.argmin(held[i]))
        f = focus[i, shortest]
        rows = bucket.orders[f][begins[i, shortest] : ends[i, shortest]].astype(np.int64)
        for k, g in enumerate(focus[i]):
            if k != shortest:
                v = values[rows, g]
                rows = rows[(v >= lows[i, k]) & (v <= highs[i, k])]
        if len(rows):
            a = alive[i]
            score = anchors.products(bucket, [a], rows)[0]
            good = score >= least[a]
            found.append((np.full(int(good.sum()), a), rows[good], score[good]))
    together = alive[dense]
    if len(together):
        scores = anchors.products(bucket, together, every)
        i, rows = np.nonzero(scores >= least[together][:, None])
        found.append((together[i], rows, scores[i, rows]))
    anchor, row, score = (np.concatenate(c) for c in zip(*found))
    return anchor, row, score


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, by falling score, then id."""
    order = np.lexsort((ids, ~score, group))
    g = group[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < k]


class Kept:
    """The best pairs of one block of anchors so far: a group (an anchor, or one of its positives) holds k at most."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, LEAST)
        self.group, self.score, self.ids, self.anchor = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, anchor: np.ndarray) -> None:
        merged = [np.concatenate(c) for c in ((self.group, group), (self.score, score), (self.ids, ids), (self.anchor, anchor))]
        chosen = best(*merged[:3], self.k)
        self.group, self.score, self.ids, self.anchor = (c[chosen] for c in merged)
        full = np.bincount(self.group, minlength=len(self.floor)) == self.k
        lowest = np.full(len(self.floor), ~LEAST)
        np.minimum.at(lowest, self.group, self.score)
        self.floor[full] = lowest[full]


def positives_of(block: Block, stripe: list[Block], k: int) -> tuple:
    kept = Kept(len(block.ids), k)
    for bucket in stripe:
        shared = np.isin(block.labels, bucket.labels)
        if shared.any():
            anchor, row, score = reaching(block, bucket, kept.floor, shared)
            same = (block.labels[anchor] == bucket.labels[row]) & (block.rows[anchor] != bucket.rows[row])
            kept.add(anchor[same], score[same], bucket.ids[row[same]], anchor[same])
    return block.rows[kept.anchor], block.ids[kept.anchor], kept.ids, kept.score


def negatives_of(block: Block, known: dict[str, np.ndarray], stripe: list[Block], low: int, high: int, k: int) -> tuple:
    """``known`` has the positives of the block's anchors: ``row`` of the anchor, ``n``, ``positive_id``, ``positive_score``."""
    order = np.argsort(block.rows)
    place = order[np.searchsorted(block.rows, known["row"], sorter=order)]
    known = {name: column[by] for by in [np.argsort(place, kind="stable")] for name, column in (known | {"place": place}).items()}
    place, scores = known["place"], known["positive_score"].tolist()
    starts = np.searchsorted(place, np.arange(len(block.ids) + 1))
    least, most = np.array([-(-low * s // 100) for s in scores], np.int64), np.array([high * s // 100 for s in scores], np.int64)
    possible, kept = least <= most, Kept(len(place), k)
    for bucket in stripe:
        floor = np.where(possible, np.maximum(least, kept.floor), ~LEAST)
        lowest, asked = np.full(len(block.ids), ~LEAST), np.zeros(len(block.ids), bool)
        np.minimum.at(lowest, place, floor)
        asked[place[possible]] = True
        anchor, row, score = reaching(block, bucket, lowest, asked)
        other = block.labels[anchor] != bucket.labels[row]
        anchor, row, score = anchor[other], row[other], score[other]
        # Each pair found meets the positives of its anchor.
        counts = starts[anchor + 1] - starts[anchor]
        pair = np.repeat(np.arange(len(anchor)), counts)
        group = np.arange(len(pair)) + np.repeat(starts[anchor] - np.cumsum(counts) + counts, counts)
        inside = possible[group] & (score[pair] >= floor[group]) & (score[pair] <= most[group])
        pair, group = pair[inside], group[inside]
        kept.add(group, score[pair], bucket.ids[row[pair]], anchor[pair])
    g = kept.group
    return block.rows[kept.anchor], block.ids[kept.anchor], known["positive_id"][g], known["positive_score"][g], known["n"][g], kept.ids, kept.score


def met(blocks: DataFrame, listed: DataFrame, groups: int, search, out: str) -> DataFrame:
    """Blocks of anchors (with ``stripe`` and ``part``) against the buckets of their stripe; ``search`` gives the columns of ``out``."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in out.split(", ")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        stripe = Block.listed(right) if left.num_rows else []
        found = [search(block, row, stripe) for block, row in zip(Block.listed(left), left.to_pylist())] if stripe else []
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(schema)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    everywhere = listed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    own = blocks.toDF(*blocks.columns)  # its stripes may come from ``listed``
    return own.groupBy("stripe", "part").cogroup(everywhere.groupBy("stripe", "part")).applyInArrow(run, out)


def mine(
    embeddings: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on the column ``id``; ``label`` an expression over ``embeddings``. A negative
    has another label and a score of ``low`` to ``high`` per cent of the positive's.
    """
    rows = numbered(embeddings, id_col, vector_col, label)
    listed, blocks = buckets(rows, BUCKET), buckets(rows.where(anchor & (F.col("id") != NULL_ID)), ANCHORS)
    count, parts = listed.count(), -(-max(1, blocks.count()) // SPAN)
    stripes = max(1, min(count, max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // DEPTH))))
    listed = listed.withColumn("stripe", F.pmod("bucket", F.lit(stripes)))
    blocks = blocks.withColumn("part", F.pmod("bucket", F.lit(parts)))

    own = blocks.select("bucket", F.explode("label_list").alias("label"))
    there = listed.select("stripe", F.explode("label_list").alias("label")).distinct()
    sent = blocks.join(own.join(there, "label").select("bucket", "stripe").distinct(), "bucket")
    near = met(
        sent, listed, parts, lambda block, _, stripe: positives_of(block, stripe, positives), "row long, anchor_id long, positive_id long, positive_score long"
    )
    first = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    near, _ = written(near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives), "positives")

    place = blocks.select("bucket", F.explode("row_list").alias("row"))
    columns = ("row", "n", "positive_id", "positive_score")
    known = place.join(near, "row").groupBy("bucket").agg(F.collect_list(F.struct(*columns)).alias("known"))  # at most ANCHORS * positives
    everywhere = blocks.join(known, "bucket").withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))

    def search(block, row, stripe):
        return negatives_of(block, {c: np.array([k[c] for k in row["known"]], np.int64) for c in columns}, stripe, low, high, negatives)

    out = "row long, anchor_id long, positive_id long, positive_score long, n long, negative_id long, negative_score long"
    order = Window.partitionBy("row", "n").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met(everywhere, listed, parts, search, out).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", plain("positive_id"), "rank", plain("negative_id"), "positive_score", "negative_score")


def plain(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)
