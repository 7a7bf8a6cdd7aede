"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its word shingles' hashes
have it set. Two fingerprints within ``radius`` bits agree in at least one of
``segments`` segments up to ``radius // segments`` bits. So each fingerprint
enumerates the small Hamming ball around each of its segments, fetches the
fingerprints filed under those segment values by an equality join, and verifies
the whole distance inside the join.

Only distinct fingerprints take part: exact copies cost nothing. A segment value
shared by more than ``crowd`` fingerprints would make all pairs of them, so such
values take a path without pairs: two fingerprints within ``radius`` have a common
point within half the radius of each; every member of a crowd enumerates those
points, and all members that meet at a point are linked to one of them.

Nulls and odd rows: a null text counts as empty; texts without words have
fingerprint zero and link like any other; repeated rows give repeated result
rows; a null id sorts before all other ids and a component that holds one has a
null component_id. Empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.llm.common import NULL_ID, Numbered, byte_values, components, texts, written

BITS = 64
#: Words hashed at a time: bounds the memory that a very long text takes.
BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned integer."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    total, ones = len(words) - width + 1, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for begin in range(0, total, BLOCK):
        part = words[begin : min(begin + BLOCK, total) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width))))
        hashes = np.array([digest(s, seed) for s in shingles], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp holds the 64 bits as a long."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in byte_values(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _ball(positions: list[int], least: int, most: int) -> list[int]:
    """Masks that flip ``least`` to ``most`` of the bit positions."""
    return [_signed(sum(1 << p for p in c)) for n in range(least, most + 1) for c in combinations(positions, n)]


def links(fps: DataFrame, radius: int = 3, segments: int = 2, crowd: int = 64) -> DataFrame:
    """Edges (u, v) between the distinct values of ``fps.fp`` whose components are those
    of all pairs within ``radius`` bits.

    Outside crowds every such pair is an edge. Probes only look upwards in segment
    values, so that a pair is met from one side.
    """
    spans = np.array_split(np.arange(BITS), segments)
    reach = radius // segments
    nodes = fps.select("fp").distinct()

    def filed(masks: Callable[[int], list[int]] | None = None) -> DataFrame:
        """(seg, key, fp[, away]) for each segment: own values, or those within the masks."""
        parts = []
        for s, span in enumerate(spans):
            bits = sum(1 << int(p) for p in span)
            own = F.col("fp").bitwiseAND(F.lit(_signed(bits)))
            if masks is None:
                parts.append(F.struct(F.lit(s).alias("seg"), own.alias("key")))
            else:
                parts += [F.struct(F.lit(s).alias("seg"), own.bitwiseXOR(F.lit(m)).alias("key")) for m in masks(s)]
        return nodes.select("fp", F.explode(F.array(*parts)).alias("x")).select("x.seg", "x.key", "fp")

    def around(s: int, least: int = 0) -> list[int]:
        return _ball([int(p) for p in spans[s]], least, reach)

    filed_rows = filed()
    probes = filed(around)
    # Own key or a greater one: the other side of the pair covers the rest.
    bits = F.element_at(F.array(*[F.lit(_signed(sum(1 << int(p) for p in s))) for s in spans]), F.col("seg") + 1)
    probes = probes.where(F.col("key") >= F.col("fp").bitwiseAND(bits))

    full, _ = written(filed_rows.groupBy("seg", "key").count().where(F.col("count") > crowd).select("seg", "key"), "crowds")
    crowded = not full.isEmpty()
    cold = filed_rows.join(full, ["seg", "key"], "left_anti") if crowded else filed_rows
    a, b = probes.withColumnRenamed("fp", "u"), cold.withColumnRenamed("fp", "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    once = (F.col("u") < F.col("v")) | (F.col("key") > F.col("u").bitwiseAND(bits))
    pairs = a.join(b, ["seg", "key"]).where(near & once).select("u", "v")
    if not crowded:
        return pairs

    half = radius // 2
    meeting = []
    for s, span in enumerate(spans):
        inside = F.lit(_signed(sum(1 << int(p) for p in span)))
        rest = [p for p in range(BITS) if p not in set(span.tolist())]
        here = full.where(F.col("seg") == s).select("key")
        members = nodes.select("fp", F.explode(F.array(*[F.col("fp").bitwiseAND(inside).bitwiseXOR(F.lit(m)) for m in around(s)])).alias("key"))
        members = members.join(here, "key").withColumn("away", F.bit_count(F.col("fp").bitwiseAND(inside).bitwiseXOR(F.col("key"))))
        # Within the crowd: cores within half the radius, others within what is left of it.
        for away in range(reach + 1):
            left = radius - away - half
            if left < 0:
                continue
            masks = F.array(*[F.lit(m) for m in _ball(rest, 0, max(left, half if not away else 0))])
            point = F.col("fp").bitwiseAND(F.bitwise_not(inside)).bitwiseOR(F.col("key")).bitwiseXOR(F.col("mask"))
            core = (F.bit_count("mask") <= half) if away == 0 else F.lit(False)
            meeting.append(
                members.where(F.col("away") == away)
                .select("fp", "key", F.explode(masks).alias("mask"))
                .select(F.lit(s).alias("seg"), point.alias("point"), "fp", core.alias("core"))
            )
    every = meeting[0]
    for more in meeting[1:]:
        every = every.union(more)
    centre = every.where("core").groupBy("seg", "point").agg(F.min("fp").alias("v"))
    stars = every.join(centre, ["seg", "point"]).where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.union(stars)


def classes(fps: DataFrame, radius: int = 3, segments: int = 2, crowd: int = 64) -> DataFrame:
    """(fp, root, least): the class of each distinct fingerprint of the written table
    ``fps``, and the least doc_id with that fingerprint (NULL_ID for null)."""
    nodes = fps.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("least"))
    edges, _ = written(links(fps, radius, segments, crowd), "links")
    roots = components(edges, "simhash").withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, segments: int = 2, crowd: int = 64
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    component_id is the least doc_id reachable over links; the fingerprints are
    written once, since linking and the final join read them.
    """
    fps, _ = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    placed = classes(fps, radius, segments, crowd)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp, _ = written(placed.join(named, "root").select("fp", "component_id"), "classes")
    return fps.join(by_fp, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component_id") != NULL_ID, F.col("component_id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, segments: int = 2, crowd: int = 64
) -> DataFrame:
    """One row of each class of near-duplicates, all columns kept: a row of the least id (null first)."""
    stored = Numbered(docs, text_col, "fp long", lambda: lambda t: (_signed(fingerprint(t, width)),), "fingerprinted")
    fps = stored.narrow(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    by_fp = classes(fps, radius, segments, crowd).select("fp", "root")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "slice", "place"))
    one = fps.groupBy("fp").agg(first.alias("one")).join(by_fp, "fp").groupBy("root").agg(F.min("one").alias("one"))
    return stored.only(one.select("one.slice", "one.place"))
