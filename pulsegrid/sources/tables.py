"""Events from tables and generators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def service_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as ``(name, value, ts)`` by kind of event; ts in milliseconds."""
    return _named(table(spark, folder, "events"), F.concat(F.lit("svc."), "event_type"))


def user_events(spark: SparkSession, folder: str) -> DataFrame:
    """The same by user."""
    return _named(table(spark, folder, "events"), F.concat(F.lit("user."), F.col("user_id").cast("string")))


def _named(events: DataFrame, name) -> DataFrame:
    return events.select("event_id", name.alias("name"), "value", C.millis(F.col("ts")).alias("ts"))


def generated(spark: SparkSession, rows: int, names: int, now_ms: int, bad_percent: int = 0, config=None) -> DataFrame:
    """Events for load: values 1 to 10 in turn, names in turn, ``bad_percent`` of them wrong in five ways in turn."""
    from pulsegrid.config import DEFAULT

    config = config or DEFAULT
    i = F.col("id")
    bad = (i * bad_percent) % 100 + bad_percent >= 100 if bad_percent else F.lit(False)
    kind = F.when(bad, F.floor(i * bad_percent / 100) % 5).otherwise(-1)
    late, early = now_ms - 3_600_000, now_ms + 3_600_000
    return spark.range(rows).select(
        i.alias("seq"),
        F.when(kind == 0, "").when(kind == 4, F.lit("x" * (config.name_bytes + 1))).otherwise(F.concat(F.lit("load."), (i % names).cast("string"))).alias("name"),
        (i % 10 + 1).cast("double").alias("value"),
        F.when(kind == 1, 0).when(kind == 2, late).when(kind == 3, early).otherwise(F.lit(now_ms) - (i % config.window_s) * 1000).cast("long").alias("ts"),
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``. Where that is unset, a local one will do for a local session, as in
    tests; on a cluster other machines would not see it, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-pulsegrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/pulsegrid/{uuid.uuid4().hex}"
