"""Events folded into buckets, and the bucket table's merges.

The store is two tables keyed by (name, bucket_start): ``buckets`` with count, sum, min and max, and
``sketch`` in long form with (sign, idx, n). Both are mergeable: adding later events is a union followed by
the same aggregate, which Spark runs as a partial and a final one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions import columns as C

QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
STAT_COLUMNS = ["count", "avg", "min", "max", *QUANTILES]


def fold(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``events(name, value, ts)`` as buckets: name, bucket_start, count, sum, min, max."""
    keyed = events.select("name", C.bucket_start(F.col("ts"), config.bucket_s).alias("bucket_start"), "value")
    return keyed.groupBy("name", "bucket_start").agg(
        F.count("*").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def index_counts(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``events(name, value, ts)`` as sketch rows: name, bucket_start, sign, idx, n, with every index its values have."""
    value = F.col("value")
    keyed = events.select("name", C.bucket_start(F.col("ts"), config.bucket_s).alias("bucket_start"), C.sign(value).alias("sign"), C.index(value).alias("idx"))
    return keyed.groupBy("name", "bucket_start", "sign", "idx").agg(F.count("*").alias("n"))


def sketch(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The same with at most ``config.sketch_buckets`` of each sign in a bucket."""
    return collapse(index_counts(events, config), config.sketch_buckets)


def collapse(rows: DataFrame, most: int) -> DataFrame:
    """Keep the ``most`` largest indexes of each sign in a bucket; the counts of lower ones go to the lowest kept."""
    key = Window.partitionBy("name", "bucket_start", "sign")
    ranked = rows.withColumn("__rank", F.row_number().over(key.orderBy(F.desc("idx"))))
    lowest = F.min(F.when(F.col("__rank") <= most, F.col("idx"))).over(key)
    return ranked.withColumn("idx", F.greatest("idx", lowest)).groupBy("name", "bucket_start", "sign", "idx").agg(F.sum("n").alias("n"))


def merge_buckets(*tables: DataFrame) -> DataFrame:
    """The union of bucket tables with one row for each (name, bucket_start)."""
    return _union(tables).groupBy("name", "bucket_start").agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max")
    )


def merge_sketches(*tables: DataFrame) -> DataFrame:
    """The union of sketch tables; counts of one index add up, and no cap holds."""
    return _union(tables).groupBy("name", "bucket_start", "sign", "idx").agg(F.sum("n").alias("n"))


def _union(tables):
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def cutoff(now_ms: int, window_s: int, config: Config = DEFAULT) -> int:
    """Start of the first bucket that a trailing window reads, in seconds: on the grid, rounded down."""
    width = config.bucket_s * 1000
    return (now_ms - window_s * 1000) // width * width // 1000


def covers(now_ms: int, cut: int) -> int:
    """Seconds that a window from ``cut`` on covers."""
    return now_ms // 1000 - cut


def quantiles(rows: DataFrame, keys: list[str], qs: dict[str, float] = QUANTILES) -> DataFrame:
    """Quantiles of sketch rows by ``keys``, in one ordered pass; 0 where there are no values."""
    by = Window.partitionBy(*keys)
    n = rows.groupBy(*keys, "sign", "idx").agg(F.sum("n").alias("n")).withColumn("__ord", C.order(F.col("sign"), F.col("idx")))
    n = n.withColumn("__cum", F.sum("n").over(by.orderBy("__ord"))).withColumn("__total", F.sum("n").over(by))
    value = F.when(F.col("sign") == 0, 0.0).otherwise(C.representative(F.col("sign"), F.col("idx")))
    pick = lambda q: F.min_by(value, F.when(F.col("__cum") > C.rank_of(q, F.col("__total")), F.col("__ord")))
    return n.groupBy(*keys).agg(*[pick(q).alias(a) for a, q in qs.items()])


def statistics(buckets: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """count, avg, min, max and quantiles by ``keys`` of live buckets and their sketch."""
    whole = buckets.groupBy(*keys).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))
    out = whole.join(quantiles(rows, keys), keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select(*keys, "count", (F.col("sum") / F.col("count")).alias("avg"), "min", "max", *[zero(q) for q in QUANTILES])


def increase() -> Column:
    """The rise of a counter over merged buckets."""
    return F.col("max") - F.col("min")


def latest(now_ms: int, config: Config = DEFAULT) -> int:
    """Start, in seconds, beyond which no bucket can be by ``now_ms``: events may be ahead by the slack only."""
    return (now_ms + config.future_ms) // 1000


def live(table: DataFrame, cut: int, last: int | None = None) -> DataFrame:
    """Rows of buckets from the cutoff on, and up to ``last``, so that what came later does not tell on the past."""
    kept = table.where(F.col("bucket_start") >= F.lit(cut).cast("long"))
    return kept if last is None else kept.where(F.col("bucket_start") <= F.lit(last).cast("long"))


def sweep(registry: DataFrame, buckets: DataFrame, now_ms: int, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(registry, buckets)`` without aged buckets and without the names that have none left."""
    kept = live(buckets, cutoff(now_ms, config.window_s, config))
    return registry.join(kept.select("name").distinct(), "name", "left_semi"), kept


def gauges(registry: DataFrame, buckets: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: names, buckets, and sketch buckets (those of values near zero aside)."""
    return (
        registry.agg(F.count_distinct("name").alias("metrics"))
        .join(buckets.agg(F.count("*").alias("buckets")))
        .join(rows.agg(F.count_if(F.col("sign") != 0).alias("histogram_buckets")))
    )
