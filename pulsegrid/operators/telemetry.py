"""The engine's own metrics under the reserved prefix, and checks of what it answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.operators.buckets import gauges

# The engine's own metrics, counters first, then gauges.
COUNTERS = (
    "requests.shed", "requests.throttled", "events.accepted", "events.rejected", "sweep.metrics_reclaimed", "clients.query_budget_refusals",
    "rules.reloads", "rules.reload_failures", "snapshot.write_failures", "snapshot.load_failures", "snapshot.empty_starts",
)
GAUGES = ("clients.tracked", "store.metrics", "store.buckets", "store.histogram_buckets", "runtime.tasks", "snapshot.age_seconds", "snapshot.bytes")


def samples(spark: SparkSession, readings: dict[str, float], now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """Readings as events ``(name, value, ts)`` for the reserved path; readings that are not there yet are left out."""
    rows = [(config.reserved_prefix + k, float(readings[k]), now_ms) for k in (*COUNTERS, *GAUGES) if k in readings]
    return spark.createDataFrame(rows, "name string, value double, ts long")


def sample(registry: DataFrame, table: DataFrame, rows: DataFrame, readings: dict[str, float], now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """All readings of one moment as events: the sizes of the store, measured before they are added to it, and what
    its jobs have counted. Counters are cumulative, so that their rise is read as an increase."""
    size = gauges(registry, table, rows).first()
    sizes = {"store.metrics": size["metrics"], "store.buckets": size["buckets"], "store.histogram_buckets": size["histogram_buckets"]}
    return samples(registry.sparkSession, readings | sizes, now_ms, config)


def counters(judged: DataFrame) -> DataFrame:
    """Accepted, rejected and refused events of a table of verdicts, as (name, value)."""
    row = judged.agg(
        F.count_if(F.col("error").isNull()).alias("events.accepted"),
        F.count_if(F.col("error").isNotNull() & ~F.col("retryable")).alias("events.rejected"),
        F.count_if("retryable").alias("events.refused"),
    )
    return row.unpivot([], [f"`{c}`" for c in row.columns], "name", "value")


def stats_violations(stats: DataFrame) -> DataFrame:
    """Rows of statistics that cannot be: out of order, or a quantile beyond the extremes by more than the sketch errs."""
    wide = lambda c: F.abs(F.col(c)) * 0.02 + 1e-9
    good = (
        (F.col("count") > 0)
        & (F.col("min") <= F.col("max"))
        & (F.col("avg") >= F.col("min") - wide("min"))
        & (F.col("avg") <= F.col("max") + wide("max"))
        & (F.col("p50") <= F.col("p90"))
        & (F.col("p90") <= F.col("p99"))
        & (F.col("p99") <= F.col("max") + wide("max"))
        & (F.col("p50") >= F.col("min") - wide("min"))
    )
    return stats.where(~good)


def series_violations(series: DataFrame, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """Points off the grid, outside the window, or that do not follow the point of their name before them."""
    start = F.col("start")
    before = F.lag("start").over(Window.partitionBy("name").orderBy("start"))
    oldest = (now_ms - config.window_s * 1000) // (config.bucket_s * 1000) * config.bucket_s
    newest = (now_ms + config.future_ms) // 1000
    wrong = (F.pmod(start, F.lit(config.bucket_s)) != 0) | (start < oldest) | (start > newest) | (F.coalesce(before, start - 1) >= start)
    return series.withColumn("__wrong", wrong).where("__wrong").drop("__wrong")


def exactness(judged: DataFrame, buckets: DataFrame) -> DataFrame:
    """One row: accepted events, recorded events, and whether they agree."""
    accepted = judged.agg(F.count_if(F.col("error").isNull()).alias("accepted"))
    recorded = buckets.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("recorded"))
    return accepted.join(recorded).select("accepted", "recorded", (F.col("accepted") == F.col("recorded")).alias("exact"))
