"""Near-duplicates: SimHash with multi-index hashing, then exact similarity of word shingles.

Texts are lower-cased (A-Z) and cut at ASCII white space; a text's set has its distinct
runs of five words (a text of fewer words is one shingle). Two texts are near-duplicates
if the Jaccard similarity of their sets is at least ``SHARE``; classes are the connected
components. Fingerprints find the closest pairs; since many similar texts are more than
``RADIUS`` bits apart, an exact filter finds the rest, so that no pair is left out:

1. Each set has a SimHash fingerprint. Those within ``RADIUS`` bits are found by
   multi-index hashing (``simhash.links``).
2. Two different sets of that similarity share ``LEAST`` shingles or more, and as many among
   the first n - ceil(0.8 n) + ``LEAST`` of each, in any order that holds for all texts
   (prefix filter). Shingles that are common in a sample come last, so that shared lines
   make few candidates; the sample decides cost, never results.
3. Texts that share such a shingle meet there. Where at most ``SMALL`` meet, pairs are
   counted: a similar pair meets ``LEAST`` times in small groups, or in a larger group too.
   In a larger group each text first meets one of the group, chosen by a hash (one of four),
   and is compared with the likeliest of those it met. Then the pairs that met there, are not in
   one class yet and meet ``LEAST`` times in groups of all sizes are compared, so a large group of
   copies makes no pairs of all of them, and texts that share a line or two make none.
4. Candidates of all kinds pass bounds that no similar pair exceeds (set sizes, small parity
   bitmaps, then ones of at least two bits a shingle) before their sets are compared whole.

Equal sets collapse before. Nulls and odd rows: a null text counts as empty; texts without
words are equal to each other; repeated rows collapse; a null id sorts before all others;
an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwatch.llm import simhash
from bandwatch.llm.common import NULL_ID, Numbered, byte_values, components, per_row, sent, written
from bandwatch.llm.decontaminate import _bits, _roll
from bandwatch.session import discard

#: Words of a shingle, and least similarity of near-duplicates as a fraction.
WIDTH, SHARE = 5, (4, 5)
#: Bits that the fingerprints of the first candidates may differ in.
RADIUS = 3
#: Shingles that different sets of that similarity share at least (4 of 5), and texts of a shingle whose pairs are counted.
LEAST, SMALL = 4, 5
#: Texts in the sample that tells common shingles, least texts with a common one, and the most that are kept.
SAMPLE, COMMON, KEPT = 4000, 4, 1 << 17
#: Texts of a shared shingle that the others meet first.
HUBS = 4
#: Longs of the small bitmap that every pair is tried with before the large ones are fetched.
SKETCH = 4


def hashes(text: bytes) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    return np.unique(_roll(np.fromiter(map(known.get, words), np.uint64, len(words)), min(WIDTH, len(words))))


def digest(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set: bits that over half of its shingles have."""
    ones = _bits(found).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view(">u8")[0].astype(np.uint64).view(np.int64))


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which similar sets share ``LEAST``: rare ones first, each kind by hash."""
    n, (up, down) = len(found), SHARE
    size = n + (up * n) // -down + LEAST if n else 0
    if not len(common) or not n:
        return found[:size]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[np.argsort(common[at] == found, kind="stable")[:size]]


def _marks(found: np.ndarray) -> list[int]:
    """Parities of the shingles in hash cells, as longs: 2^k cells, at least two for each shingle."""
    return _parities(found, max(64, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64)


def _parities(found: np.ndarray, cells: int) -> list[int]:
    odd = np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def common_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """Sorted hashes of the shingles that occur in several texts of a bounded sample."""
    every = max(1, docs.count() // SAMPLE)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def run(batches):
        for b in batches:
            own = [hashes(t) for t in byte_values(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))], names=["s"])

    chosen = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    counted = chosen.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= COMMON)
    rows = counted.orderBy(F.desc("count"), "s").limit(KEPT).select("s").toArrow().column(0)
    return np.sort(rows.to_numpy().view(np.uint64))


def _sizes_allow(a: Column, b: Column) -> Column:
    up, down = SHARE
    return down * F.least(a, b) >= up * F.greatest(a, b)


def _sketches_allow(a: str, b: str) -> Column:
    """Whether sizes and small bitmaps allow a similar pair."""
    up, down = SHARE
    na, nb = F.col(f"{a}.size"), F.col(f"{b}.size")
    apart = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH)), F.lit(0))
    return _sizes_allow(na, nb) & ((up + down) * apart <= (down - up) * (na + nb))


def _apart(a: str, b: str) -> Column:
    """Odd cells that differ, at most the shingles that do; null where sizes or cells allow no similar pair.

    At 4/5, 1/9 of both sizes may differ. Sizes that are close enough have bitmaps of one
    size, or of half and double; then the larger is folded.
    """
    up, down = SHARE
    na, nb, ma, mb = F.col(f"{a}.size"), F.col(f"{b}.size"), F.col(f"{a}.marks"), F.col(f"{b}.marks")
    xor = lambda x, y: x.bitwiseXOR(y)

    def as_long_as(m: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(m) > half, F.zip_with(F.slice(m, F.lit(1), half), F.slice(m, half + 1, half), xor)).otherwise(m)

    differ = F.zip_with(as_long_as(ma, mb), as_long_as(mb, ma), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.when(_sizes_allow(na, nb), F.aggregate(differ, F.lit(0), lambda n, x: n + x))
    return F.when((up + down) * apart <= (down - up) * (na + nb), apart)


def _verified(stored: Numbered, one: DataFrame, pairs: DataFrame, text_col: str) -> DataFrame:
    """Those of the written (u, v) whose whole sets are similar, written; the sets are made again from the texts and let go."""
    need = pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v").alias("fp"))).distinct()
    texts = stored.only(one.join(need, "fp").select("one.slice", "one.place"))

    def make():
        def found(text: bytes):
            own = hashes(text)
            return digest(own), own.view(np.int64)

        return found

    sets, path = written(per_row(texts.select(F.col(f"`{text_col}`").cast("string").alias("text")), "fp long, s array<long>", make, 0), "sets")
    up, down = SHARE
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    edges, _ = written(both.where((up + down) * shared >= up * (F.size("a") + F.size("b"))).select("u", "v"), "links")
    discard(stored.rows.sparkSession, path)
    return edges


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near-duplicates, all columns kept: a row of the least id (null first)."""
    load = sent(docs.sparkSession, common_shingles(docs, text_col))

    def make():
        def found(text: bytes):
            own = hashes(text)
            return digest(own), len(own), fingerprint(own), _parities(own, 64 * SKETCH), _marks(own)

        return found

    def firsts():
        common = load()

        def found(text: bytes):
            own = hashes(text)
            return digest(own), prefix(own, common).view(np.int64)

        return found

    stored = Numbered(docs, text_col, "fp long, size int, print long, sketch array<long>, marks array<long>", make, "shingled")
    rows = stored.narrow(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"))
    least = F.min(F.struct("id", "slice", "place")).alias("one")
    one, _ = written(rows.groupBy("fp").agg(least, *[F.first(c).alias(c) for c in ("size", "print", "sketch", "marks")]), "one")

    here = Window.partitionBy("s").orderBy("fp")
    whole = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    large = F.col("n") > SMALL
    first = F.min(F.struct(F.xxhash64("fp", F.pmod("s", F.lit(HUBS))).alias("at"), "fp")).over(whole)
    distinct = stored.only(one.select("one.slice", "one.place")).select(F.col(f"`{text_col}`").cast("string").alias("text"))
    met = per_row(distinct, "fp long, prefix array<long>", firsts, 0)
    met = met.select("fp", F.explode("prefix").alias("s")).repartition("s")  # before the window's own columns are made
    met = met.select("s", "fp", F.count("*").over(whole).alias("n")).where("n > 1")
    after = F.array_compact(F.array(*[F.lead("fp", k).over(here) for k in range(1, SMALL)]))
    met = met.select("s", "fp", "n", first["fp"].alias("hub"), after.alias("after"))
    meeting, _ = written(met.select("s", "fp", "n", F.when(large, F.col("hub")).alias("hub"), F.when(~large, F.col("after")).alias("after")), "meeting")

    def facts(name: str, *columns: str) -> DataFrame:
        return one.select(F.col("fp").alias(name), F.struct("size", *columns).alias(f"{name}_"))

    def alike(pairs: DataFrame) -> DataFrame:
        """(u, v, apart) of the pairs that all bounds allow."""
        pairs = pairs.join(facts("u", "sketch"), "u").join(facts("v", "sketch"), "v").where(_sketches_allow("u_", "v_")).select("u", "v")
        pairs = pairs.join(facts("u", "marks"), "u").join(facts("v", "marks"), "v")
        return pairs.select("u", "v", _apart("u_", "v_").alias("apart")).where("apart IS NOT NULL")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    near = meeting.where(large & (F.col("fp") != F.col("hub"))).select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()
    near, _ = written(alike(near), "hubs")
    hubs = near.groupBy("u").agg(F.min(F.struct("apart", "v")).alias("hub")).select("u", "hub.v")
    together = meeting.where(~large).select(F.col("fp").alias("u"), F.explode("after").alias("v"))
    few = together.groupBy("u", "v").count().where(F.col("count") >= LEAST).select("u", "v")
    # Of texts with one fingerprint, one stands for it.
    lead, _ = written(one.groupBy("print").agg(F.min("fp").alias("lead")), "prints")
    linked = simhash.links(lead.select(F.col("print").alias("fp")), RADIUS)
    for side in "uv":
        linked = linked.join(lead.select(F.col("print").alias(side), F.col("lead").alias(f"{side}_fp")), side)
    linked = linked.select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v"))
    linked = linked.union(one.join(lead, "print").where("fp <> lead").select(F.col("fp").alias("u"), F.col("lead").alias("v")))
    tried, _ = written(ordered(alike(linked.union(few)).select("u", "v").union(hubs)).distinct(), "tried")
    edges = _verified(stored, one, tried, text_col)

    def classes(nodes: DataFrame, name: str, links: DataFrame) -> DataFrame:
        """(name, root) of all ``nodes``, written."""
        roots = components(links, "near").select(F.col("node").alias(name), "root")
        return written(nodes.join(roots, name, "left").select(name, F.coalesce("root", name).alias("root")), "classes")[0]

    roots = classes(one.select("fp"), "fp", edges)
    placed = meeting.where(large).select("s", "fp").join(roots, "fp")
    mixed = placed.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("s")
    left, _ = written(placed.join(mixed, "s", "left_semi").join(one.select("fp", "size", "sketch"), "fp"), "apart")
    a, b = (left.select("s", F.col("fp").alias(n), F.col("root").alias(f"{n}r"), F.struct("size", "sketch").alias(f"{n}_")) for n in "uv")
    others = a.join(b, "s").where((F.col("u") < F.col("v")) & (F.col("ur") != F.col("vr")) & _sketches_allow("u_", "v_"))
    # All large groups of such a pair are here; with its small ones they must be LEAST.
    others = others.select("u", "v", F.lit(1).alias("large")).union(together.select("u", "v", F.lit(0)))
    others = others.groupBy("u", "v").agg(F.count("*").alias("times"), F.max("large").alias("large")).where((F.col("times") >= LEAST) & (F.col("large") == 1))
    others, _ = written(others.select("u", "v").join(tried, ["u", "v"], "left_anti"), "met")
    others, _ = written(alike(others).select("u", "v"), "others")
    if not others.isEmpty():
        across = _verified(stored, one, others, text_col)
        for side in "uv":
            across = across.join(roots.select(F.col("fp").alias(side), F.col("root").alias(f"{side}r")), side)
        merged = classes(roots.select(F.col("root").alias("was")).distinct(), "was", across.select(F.col("ur").alias("u"), F.col("vr").alias("v")))
        roots = roots.withColumnRenamed("root", "was").join(merged, "was").select("fp", "root")
    kept = one.select("fp", "one").join(roots, "fp").groupBy("root").agg(F.min("one").alias("one"))
    return stored.only(kept.select("one.slice", "one.place"))
