"""Snapshots of the store as Parquet generations with a manifest.

A generation is a folder of its own with ``buckets``, ``sketch`` and ``manifest`` tables; the manifest is written
last, so a generation without one was never finished. The newest finished one is current and the one before
it is kept; restoring tries them in that order. Only Spark's readers and writers touch the store, so that it may
be any that Spark reaches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions import columns as C
from pulsegrid.operators import buckets as B

FORMAT = 2
MANIFEST = "format int, written_ms long, bucket_s int, rows long, sketch_rows long, checksum decimal(38,0)"


class Unusable(ValueError):
    """A snapshot that is there and cannot be used."""


def _sum(df: DataFrame) -> tuple:
    code = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(code), F.lit(0).cast("decimal(38,0)"))).first())


def write(buckets: DataFrame, sketch: DataFrame, folder: str, now_ms: int, config: Config = DEFAULT) -> str:
    """Write a generation of the live buckets, reserved names aside; returns its folder."""
    spark = buckets.sparkSession
    cut = B.cutoff(now_ms, config.window_s, config)
    own = F.startswith("name", F.lit(config.reserved_prefix))
    target = f"{folder}/generation={now_ms}"
    for name, df in (("buckets", buckets), ("sketch", sketch)):
        B.live(df, cut).where(~own).write.parquet(f"{target}/{name}")
    (n, a), (m, b) = (_sum(spark.read.parquet(f"{target}/{name}")) for name in ("buckets", "sketch"))
    spark.createDataFrame([(FORMAT, now_ms, config.bucket_s, n, m, a + b)], MANIFEST).coalesce(1).write.parquet(f"{target}/manifest")
    return target


def generations(spark: SparkSession, folder: str) -> list[str]:
    """Finished generations, the newest first."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
        paths = found.where(F.col("path").rlike("generation=[0-9]+/manifest/[^/]+$"))
        rows = paths.select(F.regexp_extract("path", "generation=([0-9]+)/", 1).cast("long").alias("at")).distinct().orderBy(F.desc("at")).collect()
    except AnalysisException:
        return []
    return [f"{folder}/generation={r[0]}" for r in rows]


def read(spark: SparkSession, target: str, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame, int]:
    """``(buckets, sketch, written_ms)`` of a generation that holds what its manifest says."""
    try:
        m = spark.read.schema(MANIFEST).parquet(f"{target}/manifest").first()
        buckets, sketch = (spark.read.parquet(f"{target}/{n}") for n in ("buckets", "sketch"))
        if m is None or m["format"] != FORMAT:
            raise Unusable(f"{target}: unknown format")
        if m["bucket_s"] != config.bucket_s:
            raise Unusable(f"{target}: buckets of {m['bucket_s']} s, not {config.bucket_s} s")
        (n, a), (k, b) = _sum(buckets), _sum(sketch)
    except Unusable:
        raise
    except Exception as e:  # any failure to read makes it unusable; the one before it is tried
        raise Unusable(f"{target}: {str(e)[:200]}") from e
    if (n, k, a + b) != (m["rows"], m["sketch_rows"], m["checksum"]):
        raise Unusable(f"{target}: rows or checksum differ from the manifest")
    if buckets.where(F.pmod("bucket_start", F.lit(config.bucket_s)) != 0).limit(1).count():
        raise Unusable(f"{target}: a bucket is off the grid")
    return buckets, sketch, m["written_ms"]


def freshness(spark: SparkSession, folder: str, now_ms: int) -> dict[str, float]:
    """Age in seconds and bytes of the newest generation, as readings of telemetry; none where there is no generation."""
    found = generations(spark, folder)
    if not found:
        return {}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(found[0]).agg(F.sum("length")).first()[0]
    return {"snapshot.age_seconds": (now_ms - int(found[0].rsplit("=", 1)[1])) / 1000, "snapshot.bytes": float(files or 0)}


def write_every(buckets_of, folder: str, clock, seconds: float, stop, config: Config = DEFAULT) -> dict[str, float]:
    """A generation of ``buckets_of()`` (buckets, sketch) each ``seconds``, and one at the end, until ``stop`` (an event)
    is set. A failed write is counted and the next one tried; returns the count as a reading of telemetry."""
    failures = 0
    while True:
        over = stop.wait(seconds)
        try:
            write(*buckets_of(), folder, clock(), config)
        except Exception:  # whatever failed, the generations before it are whole
            failures += 1
        if over:
            return {"snapshot.write_failures": float(failures)}


def restore(spark: SparkSession, folder: str, now_ms: int, config: Config = DEFAULT, capped: bool = True) -> tuple[DataFrame, DataFrame, list[str]] | None:
    """``(buckets, sketch, reports)`` from the newest usable generation, or None if there is none at all.

    Stale buckets, reserved names, and names beyond a shard's cap are left out; not ``capped``, all names come back,
    as a store that was folded without admission may hold any number of them."""
    reports: list[str] = []
    for target in generations(spark, folder)[:2]:
        try:
            buckets, sketch, _ = read(spark, target, config)
        except Unusable as e:
            reports.append(str(e))
            continue
        return *loaded(buckets, sketch, now_ms, config, capped), reports
    if reports:
        raise Unusable("; ".join(reports))
    return None


def loaded(buckets: DataFrame, sketch: DataFrame, now_ms: int, config: Config = DEFAULT, capped: bool = True) -> tuple[DataFrame, DataFrame]:
    cut = B.cutoff(now_ms, config.window_s, config)
    kept = B.live(buckets, cut).where(~F.startswith("name", F.lit(config.reserved_prefix)))
    names = kept.select("name").distinct()
    if not capped:
        return kept, B.live(sketch, cut).join(names, "name", "left_semi")
    rank = F.row_number().over(Window.partitionBy(C.shard(F.col("name"), config.shards)).orderBy("name"))
    fits = names.withColumn("__rank", rank).where(F.col("__rank") <= config.names_per_shard).select("name")
    return kept.join(fits, "name", "left_semi"), B.live(sketch, cut).join(fits, "name", "left_semi")


def replace_series(old: DataFrame, restored: DataFrame) -> DataFrame:
    """The store after a restore: a restored name takes the place of its series, others stay."""
    return old.join(restored.select("name").distinct(), "name", "left_anti").unionByName(restored)
