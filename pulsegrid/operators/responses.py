"""Answers to requests as JSON, one row each; a request names or selects ``max_limit`` names at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions.durations import show
from pulsegrid.operators import alerts, reading
from pulsegrid.operators import buckets as B


def _seconds(n: float) -> str:
    return show(int(n * 10**9))


def _window(req: reading.Request, now_ms: int, config: Config) -> list:
    covers = B.covers(now_ms, reading.cutoff(req, now_ms, config))
    return [F.lit(_seconds(req.window_s)).alias("window"), F.lit(_seconds(covers)).alias("covers")]


def stats(registry: DataFrame, table: DataFrame, rows: DataFrame, req: reading.Request, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """``body``: window, covers, metrics by name, matched, truncated, and next if there is a next page."""
    found = reading.stats(registry, table, rows, req, now_ms, config)
    metrics = found.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.struct(*B.STAT_COLUMNS))))).alias("metrics"))
    page = reading.page(registry, req, now_ms, config).select("matched", "truncated", "next")
    return metrics.join(page).select(F.to_json(F.struct(*_window(req, now_ms, config), "metrics", "matched", "truncated", "next")).alias("body"))


def series(registry: DataFrame, table: DataFrame, rows: DataFrame, req: reading.Request, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """``body``: window, covers, bucket, and the points of each name that has any, by start."""
    points = reading.series(registry, table, rows, req, now_ms, config)
    of_name = points.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("start", *B.STAT_COLUMNS))).alias("points"))
    whole = of_name.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "points")))).alias("series"))
    return whole.select(F.to_json(F.struct(*_window(req, now_ms, config), F.lit(_seconds(config.bucket_s)).alias("bucket"), "series")).alias("body"))


def alert_states(states: DataFrame, state: str = "", after: str = "", limit: int = DEFAULT.max_limit) -> DataFrame:
    """``body``: the states listed, matched, truncated, and next if there is a next page. Times carry their offset."""
    since = F.date_format(F.timestamp_millis("since"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("since")
    rows = alerts.listing(states, state, after, limit).select("rule", "metric", "state", "value", since)
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("rule", "metric", "state", "value", "since"))).alias("alerts"))
    page = alerts.listing_page(states, state, after, limit)
    return listed.join(page).select(F.to_json(F.struct("alerts", "matched", "truncated", "next")).alias("body"))


def batches(judged: DataFrame, bodies: DataFrame, keys: list[str], index: str, responses: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``body`` of each batch, from ``validation.batch_responses``: accepted, rejected, the first errors, and fatal if it broke off."""
    from pulsegrid.operators.validation import first_errors

    of = first_errors(judged, keys, index, config.listed_errors)
    told = of.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("index"), "error", "retryable"))).alias("errors"))
    both = responses.join(told, keys, "left")
    none = F.array().cast("array<struct<index:bigint,error:string,retryable:boolean>>")
    return both.select(*keys, "status", F.to_json(F.struct("accepted", "rejected", F.coalesce("errors", none).alias("errors"), "fatal")).alias("body"))
