"""Streams in several micro-batches against the batch operators."""

import random

from pyspark.sql import functions as F

from pulsegrid.config import Config
from pulsegrid.operators import alerts, buckets
from pulsegrid.streaming import jobs

NOW = 1_700_000_000_000
EVENTS = "seq long, name string, value double, ts long"


def files(spark, folder, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")


def parts(n=4, each=60, names=9):
    rng = random.Random(2)
    return [[(k * each + i, f"n{rng.randrange(names)}", rng.uniform(-5, 50), NOW - rng.randrange(50_000)) for i in range(each)] for k in range(n)]


def drained(stream, name, mode="update"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    return stream.sparkSession.table(name)


def plain(df, *keys):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*keys).collect())


def test_ingest_of_several_batches_is_one_fold(spark, tmp_path):
    data = parts()
    config = Config(sketch_buckets=4)
    stream = files(spark, tmp_path / "in", data, EVENTS)
    folder = f"{tmp_path}/store"
    jobs.ingest(stream, folder, f"{tmp_path}/checkpoint", lambda _: NOW, config).awaitTermination()
    whole = spark.createDataFrame([r for p in data for r in p], EVENTS)
    table, rows = jobs.stored(spark, folder, config)
    columns = ("name", "bucket_start", "count", "sum", "min", "max")
    assert plain(table, *columns) == plain(buckets.fold(whole, config), *columns)
    once = plain(table, *columns)
    assert rows.groupBy("name", "bucket_start", "sign").count().agg(F.max("count")).first()[0] <= 4
    assert rows.agg(F.sum("n")).first()[0] == 240
    # a batch that is run again writes its part over; another checkpoint runs them all again
    jobs.ingest(stream, folder, f"{tmp_path}/other", lambda _: NOW, config).awaitTermination()
    assert plain(jobs.stored(spark, folder, config)[0], *columns) == once
    jobs.compact(spark, folder, f"{tmp_path}/one", NOW, config)
    assert plain(jobs.stored(spark, f"{tmp_path}/one", config)[0], *columns) == once


def test_ingest_without_judging_refuses_nothing(spark, tmp_path):
    data = [[(0, "a", 1.0, NOW), (1, None, 2.0, NOW), (2, "pulsegrid.x", 3.0, NOW)], [(3, "a", 4.0, NOW + 10**9), (4, "a", 5.0, NOW - 10**9), (5, "a" * 300, 6.0, None)]]
    stream = files(spark, tmp_path / "in", data, EVENTS)
    jobs.ingest(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint", lambda _: NOW, judge=False).awaitTermination()
    columns = ("name", "bucket_start", "count", "sum", "min", "max")
    got, whole = jobs.stored(spark, f"{tmp_path}/store")[0], buckets.fold(spark.createDataFrame(data[0] + data[1], EVENTS))
    assert got.count() == 6
    assert got.select(*columns).exceptAll(whole.select(*columns)).isEmpty()
    told = spark.read.parquet(f"{tmp_path}/store/verdicts").groupBy("error").agg(F.sum("n").alias("n")).collect()
    assert {r.error: r.n for r in told} == {None: 6}


def test_ingest_admits_names_over_batches(spark, tmp_path):
    config = Config(shards=1, names_per_shard=5)
    data = parts(names=12)
    stream = files(spark, tmp_path / "in", data, EVENTS)
    folder = f"{tmp_path}/store"
    jobs.ingest(stream, folder, f"{tmp_path}/checkpoint", lambda _: NOW, config, seq="seq").awaitTermination()
    made = []
    for r in (r for p in data for r in p):
        if r[1] not in made and len(made) < 5:
            made.append(r[1])
    want = [r for p in data for r in p if r[1] in made]
    assert {r.name for r in jobs.stored(spark, folder)[0].collect()} == set(made)
    assert jobs.stored(spark, folder)[0].agg(F.sum("count")).first()[0] == len(want)
    told = spark.read.parquet(f"{folder}/verdicts").groupBy("error").agg(F.sum("n").alias("n")).collect()
    assert {r.error: r.n for r in told} == {None: len(want), "too many metrics": 240 - len(want)}


def test_ingest_charges_clients(spark, tmp_path):
    config = Config(client_names=2, shards=4)
    rows = [(i, f"n{i}", 1.0, NOW, "c", NOW) for i in range(6)] + [(9, "n5", 1.0, NOW, "d", NOW)]
    stream = files(spark, tmp_path / "in", [rows], f"{EVENTS}, client string, arrived long")
    jobs.ingest(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint", lambda _: NOW, config, seq="seq").awaitTermination()
    assert {r.name for r in jobs.stored(spark, f"{tmp_path}/store")[0].collect()} == {"n0", "n1", "n5"}


def test_streamed_buckets_and_sketches_are_those_of_a_batch(spark, tmp_path):
    data = parts()
    stream = files(spark, tmp_path / "in", data, EVENTS)
    whole = spark.createDataFrame([r for p in data for r in p], EVENTS)
    # in update mode the last row of a bucket is the largest count
    got = drained(jobs.bucket_stream(stream), "bucket_rows").groupBy("name", "bucket_start").agg(F.max_by(F.struct("count", "sum", "min", "max"), "count").alias("r")).select("name", "bucket_start", "r.*")
    columns = ("name", "bucket_start", "count", "sum", "min", "max")
    assert plain(got, *columns) == plain(buckets.fold(whole), *columns)
    got = drained(jobs.sketch_stream(stream), "sketch_rows").groupBy("name", "bucket_start", "sign", "idx").agg(F.max("n").alias("n"))
    columns = ("name", "bucket_start", "sign", "idx", "n")
    assert plain(got, *columns) == plain(buckets.sketch(whole), *columns)


def test_streamed_states_are_those_of_a_replay(spark, tmp_path):
    rng = random.Random(7)
    schema = "rule string, metric string, now_ms long, value double, outcome string, for_ms double"
    ticks = [[(r, "m", NOW + t * 1000, float(t), rng.choice(["ok", "firing", "firing", "nodata"]), w) for r, w in (("a", 0.0), ("b", 2500.0))] for t in range(12)]
    data = [sum(ticks[k : k + 3], []) for k in range(0, 12, 3)]
    columns = ("rule", "now_ms", "state", "since", "announce")
    got = drained(jobs.alert_stream(files(spark, tmp_path / "in", data, schema), NOW), "states")
    want = alerts.replay(spark.createDataFrame(sum(data, []), schema), NOW)
    assert plain(got, *columns) == plain(want, *columns)
