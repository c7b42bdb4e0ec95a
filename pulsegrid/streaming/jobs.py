"""Structured Streaming jobs: buckets from a stream of events, and states of rules from a stream of ticks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions import columns as C
from pulsegrid.operators import admission
from pulsegrid.operators import alerts as A
from pulsegrid.operators import buckets as B
from pulsegrid.operators import validation as V


def bucket_stream(events: DataFrame, config: Config = DEFAULT, late: bool = False) -> DataFrame:
    """Buckets of a stream ``events(name, value, ts)``, in update mode.

    The watermark only bounds the state: it lags by the window and the slack ahead, so it never drops an event
    that validation accepts against the clock. Events that no clock has judged may come in any order of time, as from
    the files of a table: with ``late`` there is no watermark, none is dropped, and the state holds every bucket."""
    if late:
        grouped = events.groupBy("name", C.bucket_start(F.col("ts"), config.bucket_s).alias("bucket_start"))
    else:
        lag_s = config.window_s + config.future_ms // 1000 + config.bucket_s
        marked = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", f"{lag_s} seconds")
        grouped = marked.groupBy("name", F.window("at", f"{config.bucket_s} seconds").alias("w"))
    folded = grouped.agg(F.count("*").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
    start = F.col("bucket_start") if late else F.unix_seconds(F.col("w.start")).alias("bucket_start")
    return folded.select("name", start, "count", "sum", "min", "max")


def sketch_stream(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Sketch rows of a stream, before the cap, in update mode."""
    lag_s = config.window_s + config.future_ms // 1000 + config.bucket_s
    marked = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", f"{lag_s} seconds")
    keyed = marked.select("name", F.window("at", f"{config.bucket_s} seconds").alias("w"), C.sign(F.col("value")).alias("sign"), C.index(F.col("value")).alias("idx"))
    counted = keyed.groupBy("name", "w", "sign", "idx").agg(F.count("*").alias("n"))
    return counted.select("name", F.unix_seconds(F.col("w.start")).alias("bucket_start"), "sign", "idx", "n")


def ingest(
    events: DataFrame,
    folder: str,
    checkpoint: str,
    clock: Callable[[int], int],
    config: Config = DEFAULT,
    seq: str | None = None,
    judge: bool = True,
    **trigger,
) -> StreamingQuery:
    """Validate and fold each micro-batch against one clock reading, and write it as a part of the store.

    With ``seq``, the order of arrival, valid events must also be admitted: by the cap on names, and by their
    clients' rates where they have ``client`` and ``arrived``. The names there are those with a live bucket in
    earlier parts, so that names which have aged out make room. Without ``judge``, events were judged elsewhere or not
    at all, and no rule refuses any; those that come with an ``error`` keep it.

    Parts are keyed by batch id and written over, so a batch that is run again after a failure counts once;
    ``stored`` merges them. ``clock`` gives the milliseconds now for a batch id."""

    def admitted(good: DataFrame, now_ms: int, batch_id: int) -> DataFrame:
        spark = good.sparkSession
        try:
            parts = spark.read.parquet(f"{folder}/buckets").where(F.col("batch") < batch_id)
            registry = B.live(parts, B.cutoff(now_ms, config.window_s, config)).select("name").distinct()
        except AnalysisException:  # no part yet
            registry = good.select("name").limit(0)
        if {"client", "arrived"} <= set(good.columns):
            return admission.admit(admission.clients(good, seq, config), registry, seq, config=config)
        return admission.admit_by_cap(good, registry, seq, config)

    def verdicts(df: DataFrame, now_ms: int) -> DataFrame:
        if judge:
            return V.verdicts(df, now_ms, config)
        return V.marked(df, F.col("error") if "error" in df.columns else F.lit(None).cast("string"))

    def batch(df: DataFrame, batch_id: int) -> None:
        now_ms = clock(batch_id)
        judged = verdicts(df, now_ms)
        if seq:
            bad, good = judged.where("error is not null"), judged.where("error is null").drop("error", "retryable")
            judged = bad.unionByName(verdicts(admitted(good, now_ms, batch_id), now_ms))
        judged = judged.persist()
        good = judged.where("error is null")
        for name, part in (
            ("buckets", B.fold(good, config)),
            ("sketch", B.sketch(good, config)),
            ("verdicts", judged.groupBy("error").agg(F.count("*").alias("n"))),
        ):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        judged.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored(spark, folder: str, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(buckets, sketch)`` of all parts that ``ingest`` wrote; the sketch's cap holds for a bucket over all of them."""
    read = lambda n: spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/{n}")
    return B.merge_buckets(read("buckets")), B.collapse(B.merge_sketches(read("sketch")), config.sketch_buckets)


def compact(spark, folder: str, into: str, now_ms: int, config: Config = DEFAULT) -> None:
    """All live parts as one, in another folder, for a store whose batches have become many. Ingest goes on there once
    it is written; the old folder is left as it is."""
    for name, table in zip(("buckets", "sketch"), stored(spark, folder, config), strict=True):
        B.live(table, B.cutoff(now_ms, config.window_s, config)).write.mode("overwrite").parquet(f"{into}/{name}/batch=-1")


def alert_stream(outcomes: DataFrame, began_ms: int) -> DataFrame:
    """States of rules from a stream of outcomes (rule, metric, now_ms, value, outcome, for_ms), in update mode.

    A rule's state is two values; ticks of one micro-batch are taken in order."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now_state, since = state.get if state.exists else (A.NODATA, began_ms)
        pdf = pd.concat(list(parts)).sort_values("now_ms")
        out = []
        for outcome, now, wait in zip(pdf["outcome"], pdf["now_ms"], pdf["for_ms"], strict=True):
            before = now_state
            now_state, since = A.step(now_state, since, outcome, int(now), float(wait))
            out.append((now_state, since, A.announced(before, now_state)))
        state.update((now_state, since))
        yield pdf[["rule", "metric", "now_ms", "value"]].assign(
            state=[o[0] for o in out], since=[o[1] for o in out], announce=[o[2] for o in out]
        )

    schema = "rule string, metric string, now_ms long, value double, state string, since long, announce boolean"
    return outcomes.groupBy("rule").applyInPandasWithState(run, schema, "state string, since long", "update", GroupStateTimeout.NoTimeout)
