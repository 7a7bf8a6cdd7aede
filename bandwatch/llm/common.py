"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwatch.session import discard, shared_folder

#: Stands for a null id inside an operator: it sorts before all other ids.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, as (doc_id long, text)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def written(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read back, and the folder.

    Written files outlive lost executors and give Spark true sizes, so that it
    picks broadcast or shuffle joins by what is there.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def byte_values(column: pa.Array) -> Iterator[bytes]:
    """Each text of an Arrow column as UTF-8; null is empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def per_row(docs: DataFrame, schema: str, make: Callable[[], Callable[[bytes], tuple]], carry: int = 1) -> DataFrame:
    """A row of results for each row of ``docs``.

    The last column of ``docs`` is the text; the first ``carry`` columns are
    kept. ``make`` builds, once a task, the function from a text to the values
    of the columns that ``schema`` adds.
    """
    kept = docs.columns[:carry]
    out = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields[:carry]] + T._parse_datatype_string(schema).fields
    )

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        f, target = make(), to_arrow_schema(out)
        for batch in batches:
            rows = [f(text) for text in byte_values(batch.column(carry))]
            columns = list(zip(*rows)) if rows else [()] * (len(target) - carry)
            made = [pa.array(c, target.field(carry + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(target.field(i).type) for i in range(carry)] + made, schema=target)

    return docs.select(*kept, docs.columns[carry]).mapInArrow(run, out)


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the least node.

    Alternates large-star and small-star steps until the edges are stars. A step
    is an aggregation with partial minima and a join, so no node's neighbours
    meet in one task's memory; each round is written to the shared folder.
    """
    spark = edges.sparkSession

    def lowest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("low"))

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()

    now, path = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), purpose)
    seen = state(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(lowest(large), "u")
        small = small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(lowest(large))
        following, new_path = written(small.where("u <> v").distinct(), purpose)
        was, seen = seen, state(following)
        discard(spark, path)
        now, path = following, new_path
        if was == seen:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def sent(spark: SparkSession, model):
    """A function that gives ``model`` inside tasks: broadcast once, loaded once a task.

    The model must have a size bound of its own. It is pickled with its code, so that
    executors need no copy of this package.
    """
    data = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: cloudpickle.loads(data.value)


#: Rows that one bitmap covers, and bitmaps (of 4 KB) that are broadcast at a time.
BITMAP_ROWS, BITMAPS = 1 << 15, 1 << 14


class Numbered:
    """A written copy of a table whose rows have places, so that row decisions made on
    narrow tables can be applied to it without shuffling its texts or relying on ids.

    ``rows`` has the table's columns and, under names that do not clash, ``slice`` (the
    task that wrote the row), ``place`` (its number there) and the columns of ``extra``.
    """

    def __init__(self, docs: DataFrame, text_col: str, extra: str, make: Callable[[], Callable[[bytes], tuple]], purpose: str):
        added = T._parse_datatype_string(f"{extra}, slice int, place long")
        self.columns, self.names = docs.columns, {f.name: fresh(docs, f.name) for f in added}
        at, names = docs.columns.index(text_col), list(self.names.values())
        schema = T.StructType(docs.schema.fields + [T.StructField(self.names[f.name], f.dataType) for f in added])

        def run(batches):
            from pyspark import TaskContext
            from pyspark.sql.pandas.types import to_arrow_schema

            f, seen, own, target = make(), 0, TaskContext.get().partitionId(), to_arrow_schema(schema)
            kinds = [target.field(n).type for n in names]
            for b in batches:
                n = b.num_rows
                found = list(zip(*(f(t) for t in byte_values(b.column(at))))) or [()] * (len(kinds) - 2)
                made = [pa.array(c, k) for c, k in zip([*found, [own] * n, range(seen, seen + n)], kinds)]
                seen += n
                yield pa.RecordBatch.from_arrays([*(b.column(i).cast(target.field(i).type) for i in range(b.num_columns)), *made], schema=target)

        self.rows, _ = written(docs.mapInArrow(run, schema), purpose)

    def narrow(self, *columns: Column) -> DataFrame:
        """The added columns under their own names, and others."""
        return self.rows.select(*[F.col(f"`{n}`").alias(k) for k, n in self.names.items()], *columns)

    def only(self, keep: DataFrame) -> DataFrame:
        """The rows whose (slice, place) is in ``keep``, with the table's own columns.

        ``keep`` becomes a bit for each row of the table, in bitmaps by slice. They are
        broadcast in blocks of at most ``BITMAPS`` of them; each block reads only the
        files of its slices.
        """
        number = F.col("place") + 1
        bits = keep.groupBy("slice", F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
        bits, _ = written(bits, "bitmaps")
        n, slices = bits.agg(F.count("*"), F.coalesce(F.max("slice"), F.lit(0)) + 1).first()
        parts = -(-n // BITMAPS) or 1
        slice_, place = (F.col(f"`{self.names[k]}`") for k in ("slice", "place"))
        position = F.bitmap_bit_position(place + 1)
        out = None
        for part in range(parts):
            low, high = part * slices // parts, (part + 1) * slices // parts
            own = bits.where((F.col("slice") >= low) & (F.col("slice") < high)).select(
                F.col("slice").alias("_slice"), F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")
            )
            rows = self.rows.where((slice_ >= low) & (slice_ < high)) if parts > 1 else self.rows
            rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in self.columns]).alias("_row"), slice_.alias("_s"), F.bitmap_bucket_number(place + 1).alias("_b"), position.alias("_p"))
            byte = F.conv(F.hex(F.substring("_bits", (F.col("_p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            bit = F.getbit(byte, (F.col("_p") % 8).cast("int"))
            kept = rows.join(F.broadcast(own), (F.col("_s") == F.col("_slice")) & (F.col("_b") == F.col("_bucket"))).where(bit == 1)
            kept = kept.select(*[F.col("_row")[c].alias(c) for c in self.columns])
            out = kept if out is None else out.union(kept)
        return out
