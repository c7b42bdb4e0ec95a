"""Shared helpers: column passing, written intermediate tables, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.tables import shared_folder

#: Upper bound, in rows of an Arrow batch, for tables that carry whole texts.
TEXT_BATCH_ROWS = 1000


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here,
    and a lost executor costs a re-read rather than a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry texts, so that a worker holds few at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def give_back() -> None:
    """Returns what a worker has freed to the system: workers are used again, and two share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def with_columns_from_batches(
    df: DataFrame,
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]],
    fields: list[T.StructField],
    needs: list[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns ``needs``) with the columns ``fields`` that ``make`` computes batch by batch.

    An input column with the name of a new one is replaced, unless ``make`` reads it.
    """
    df = df if needs is None else df.select(*needs)
    text_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType(kept + fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, columns in make(batches):
            old = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [_as(c, f.type) for c, f in zip([*old, *columns], arrow, strict=True)],
                names=arrow.names,
            )
            give_back()

    return df.mapInArrow(run, schema)


def _as(column, kind):
    column = column if isinstance(column, pa.Array) else pa.array(column, kind)
    return column if column.type == kind else column.cast(kind)


#: Bits of a bitmap of codes, whatever the input: 8 MB.
BITMAP_BITS = 1 << 26


def bitmap(df: DataFrame, column: str):
    """Broadcast of a bitmap of fixed size that has a bit for each code in ``column`` (a long). It only spares
    shuffling rows that cannot match; what passes it is for a join to decide."""
    bit = (F.pmod(column, F.lit(BITMAP_BITS)) + 1).alias("bit")
    maps = df.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")))
    filled = np.zeros(BITMAP_BITS // 8, np.uint8)
    for bucket, bits in maps.collect():
        filled[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return df.sparkSession.sparkContext.broadcast(filled)


def in_bitmap(filled: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether the bit of each code (a signed 64-bit one) is set."""
    at = codes.view(np.uint64) & np.uint64(BITMAP_BITS - 1)
    return (filled[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``df`` with columns of these names renamed, and the columns that give it back its own names and order."""
    other = {c: f"__own_{c}" for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in df.columns]


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` as rows ``(node, root)``; root is the smallest node.

    Alternating large-star and small-star steps until nothing changes.
    Minima are partial aggregates and the joins are plain equi-joins, so a hub with very many neighbours is
    split by AQE. Every step is a written table; nothing but a row count and a checksum reaches the driver.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    nodes = now.select(F.col("u").alias("node")).union(now.select("v")).distinct()
    mark = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m")))
        now = written(small.where("u <> v").distinct(), name)
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
