"""Reads of the bucket table: which names, their statistics over a window, their series, and paging."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions import durations
from pulsegrid.operators import buckets as B


@dataclass(frozen=True)
class Request:
    """A checked request. Windows are in seconds (a part of a second is kept)."""

    window_s: float = DEFAULT.window_s
    prefix: str = ""
    after: str = ""
    limit: int = DEFAULT.max_limit
    names: tuple[str, ...] = field(default=())


def request(
    window: str = "",
    prefix: str = "",
    after: str = "",
    limit: str = "",
    names: Iterable[str] | None = None,
    config: Config = DEFAULT,
) -> Request:
    """Parameters as text. Limits are not clamped; names exclude prefix and after; anything else wrong is an error."""
    seconds = float(config.window_s)
    if window:
        try:
            ns = durations.parse(window)
        except ValueError:
            ns = 0
        if ns <= 0:
            raise ValueError("invalid window (use e.g. 30s, 1m)")
        if ns > config.window_s * 10**9:
            raise ValueError(f"window exceeds retention ({durations.show(config.window_s * 10**9)})")
        seconds = ns / 1e9
    most = config.max_limit
    if limit:
        body = limit[1:] if limit[:1] in ("+", "-") else limit
        most = int(limit) if body.isascii() and body.isdigit() else 0
        if not 1 <= most <= config.max_limit:
            raise ValueError(f"limit must be a whole number from 1 to {config.max_limit}")
    chosen: tuple[str, ...] = ()
    if names is not None:
        names = list(names)
        if prefix or after:
            raise ValueError("name cannot be combined with prefix or after")
        if not names or any(not n for n in names):
            raise ValueError("name must not be empty")
        chosen = tuple(sorted(set(names), key=str.encode))
        if len(chosen) > config.max_limit:
            raise ValueError(f"at most {config.max_limit} names in one request")
    return Request(seconds, prefix, after, most, chosen)


def cutoff(req: Request, now_ms: int, config: Config = DEFAULT) -> int:
    width = config.bucket_s * 1000
    return int((now_ms - req.window_s * 1000) // width) * width // 1000


def matching(registry: DataFrame, req: Request) -> DataFrame:
    """Names of the registry that the request asks for, the limit aside."""
    name = F.col("name")
    if req.names:
        return registry.where(name.isin(*req.names)).select("name").distinct()
    kept = registry.where(F.startswith(name, F.lit(req.prefix)) & (name > req.after)) if req.prefix or req.after else registry
    return kept.select("name").distinct()


def selected(registry: DataFrame, req: Request) -> DataFrame:
    """The names that a request reads: asked for by name, or the smallest ``limit`` of a scan."""
    names = matching(registry, req)
    return names if req.names else names.orderBy("name").limit(req.limit)


def page(registry: DataFrame, req: Request, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """One row: matched names, whether the page cuts some off, the cursor of the next page, seconds covered, and
    the names walked past. Names count whether or not they have a live bucket."""
    cut = cutoff(req, now_ms, config)
    have = matching(registry, req).agg(F.count("*").alias("matched"))
    took = selected(registry, req).agg(F.count("*").alias("names"), F.max("name").alias("last"))
    walked = F.lit(0).cast("long").alias("walked") if req.names else None
    both = have.join(took)
    if walked is None:
        both = both.join(registry.agg(F.count_distinct("name").alias("walked")))
    cuts = F.lit(False) if req.names else F.col("matched") > F.col("names")
    return both.select(
        "matched",
        cuts.alias("truncated"),
        F.when(cuts, F.col("last")).alias("next"),
        F.lit(B.covers(now_ms, cut)).cast("long").alias("covers"),
        walked if walked is not None else "walked",
        "names",
    )


def stats(registry: DataFrame, table: DataFrame, rows: DataFrame, req: Request, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """name, count, avg, min, max, p50, p90, p99 of the selected names that have a live bucket.

    Names are chosen first; at most ``max_limit`` of them are broadcast, and buckets of others are not merged."""
    names = F.broadcast(selected(registry, req))
    cut = cutoff(req, now_ms, config)
    pick = lambda t: _of_names(B.live(t, cut, B.latest(now_ms, config)), req).join(names, "name", "left_semi")
    return B.statistics(pick(table), pick(rows), ["name"])


def series(registry: DataFrame, table: DataFrame, rows: DataFrame, req: Request, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """name, start and statistics of every live bucket of the names asked for, ascending; gaps stay gaps."""
    if not req.names:
        raise ValueError("name is required")
    cut = cutoff(req, now_ms, config)
    pick = lambda t: _of_names(B.live(t, cut, B.latest(now_ms, config)), req).withColumnRenamed("bucket_start", "start")
    return B.statistics(pick(table), pick(rows), ["name", "start"]).orderBy("name", "start")


def _of_names(table: DataFrame, req: Request) -> DataFrame:
    """The request's own conditions again, for the scan of the table to push down."""
    if req.names:
        return table.where(F.col("name").isin(*req.names))
    table = table.where(F.startswith("name", F.lit(req.prefix))) if req.prefix else table
    return table.where(F.col("name") > req.after) if req.after else table


def cost(computed: int, walked: int, config: Config = DEFAULT) -> int:
    """Units of work of a request: one for each merged name or bucket, one for so many names walked past."""
    return computed + -(-walked // config.names_per_unit)
