"""Which events are accepted, and the account of a batch of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions.durations import show

FULL_SHARD, FULL_CLIENT = "too many metrics", "client is creating metrics too fast"


def reject_reason(now_ms: int, config: Config = DEFAULT) -> Column:
    """The first rule that an event (name, ts) breaks, as text; null if none. Both time bounds accept their edge."""
    size = F.octet_length("name")
    past, ahead = show(config.window_s * 10**9), show(config.future_ms * 10**6)
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "name is required")
        .when(size > config.name_bytes, F.format_string(f"name is %d bytes, over the {config.name_bytes}-byte limit", size))
        .when(F.startswith("name", F.lit(config.reserved_prefix)), f'"{config.reserved_prefix}" is reserved for the server\'s own metrics')
        .when(F.coalesce(F.col("ts"), F.lit(0)) == 0, "ts is required (unix milliseconds)")
        .when(F.col("ts") < now_ms - config.window_s * 1000, f"event too old (ts before now-{past})")
        .when(F.col("ts") > now_ms + config.future_ms, f"ts too far in the future (after now+{ahead})")
    )


def verdicts(events: DataFrame, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """``events`` with ``error`` (null: accepted) and ``retryable``. An error they come with, from the decoder or
    from admission, goes before the rules here if it is a decoder's, and after them otherwise."""
    own = reject_reason(now_ms, config)
    if "error" in events.columns:
        capacity = F.col("error").isin(FULL_SHARD, FULL_CLIENT)
        own = F.when(F.col("error").isNotNull() & ~capacity, F.col("error")).otherwise(F.coalesce(own, F.col("error")))
    return marked(events, own)


def marked(events: DataFrame, error: Column) -> DataFrame:
    """``events`` with an error, and whether it is one of capacity."""
    out = events.withColumn("error", error)
    return out.withColumn("retryable", F.coalesce(F.col("error").isin(FULL_SHARD, FULL_CLIENT), F.lit(False)))


EMPTY = "empty batch: no events in body"


def batch_summary(judged: DataFrame, keys: list[str]) -> DataFrame:
    """accepted, rejected and the status of each batch: 200 if any event was accepted, 400 if there was none,
    429 if all could be sent again, else 400. Of verdicts that come from a decoder, a fatal row is no event: its
    status, 413 or 400, goes before these."""
    return _summary(judged, keys).select(*keys, "accepted", "rejected", "status")


def batch_responses(judged: DataFrame, bodies: DataFrame, keys: list[str], config: Config = DEFAULT) -> DataFrame:
    """Of every batch in ``bodies``, those without an event too: accepted, rejected, fatal (text or null), status, and
    for 429 the seconds after which to come again."""
    found = bodies.select(*keys).distinct().join(_summary(judged, keys), keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = F.coalesce("status", F.lit(400))
    none = (status == 400) & F.col("fatal").isNull() & (F.coalesce(F.col("accepted") + F.col("rejected"), F.lit(0)) == 0)
    return found.select(
        *keys, zero("accepted"), zero("rejected"), F.when(none, EMPTY).otherwise(F.col("fatal")).alias("fatal"), status.alias("status"),
        F.when(status == 429, config.window_s).alias("retry_after"),
    )


def _summary(judged: DataFrame, keys: list[str]) -> DataFrame:
    event = ~F.col("fatal") if "fatal" in judged.columns else F.lit(True)
    counts = judged.groupBy(*keys).agg(
        F.count_if(event & F.col("error").isNull()).alias("accepted"),
        F.count_if(event & F.col("error").isNotNull()).alias("rejected"),
        F.count_if(event & F.col("retryable")).alias("again"),
        F.min(F.when(~event, F.col("error"))).alias("fatal"),
    )
    status = F.when(F.col("accepted") > 0, 200).when(F.col("rejected") == 0, 400).when(F.col("again") == F.col("rejected"), 429).otherwise(400)
    return counts.withColumn("status", F.when(F.col("fatal").isNotNull(), fatal_status(F.col("fatal"))).otherwise(status))


def fatal_status(error: Column) -> Column:
    """413 where a body was too long or held too many events, else 400."""
    return F.when(error.rlike("^(body is over|more than)"), 413).otherwise(400)


def first_errors(judged: DataFrame, keys: list[str], index: str, most: int = DEFAULT.listed_errors) -> DataFrame:
    """The first errors of each batch by index, those of events; counts stay exact elsewhere."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(index))
    bad = judged.where("error is not null and not fatal" if "fatal" in judged.columns else "error is not null").withColumn("__rank", rank)
    return bad.where(F.col("__rank") <= most).select(*keys, index, "error", "retryable")
