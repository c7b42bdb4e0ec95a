"""Admission of events that would create a name, and the budgets of clients.

Names that exist take every event. Of the others only first attempts matter: within an epoch a refusal stays
a refusal until somebody creates the name. So events are reduced to the first attempt of each (name, client,
epoch) before anything is ordered. Without a client rate each shard decides for itself by rank, in SQL
windows. With it, clients couple the shards, and attempts count in the order of their arrival: rounds take the
earliest ones that are still open, so many at a time, and settle them (up to where they reach is found from counts, so
that tasks send those and no others); attempts at names that then exist, in shards
that are full and of clients that have used up their epoch are closed and drop out of the next round together,
however many they are. What is remembered between rounds is the names made, which the cap bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions import columns as C
from pulsegrid.operators.validation import FULL_CLIENT, FULL_SHARD
from pulsegrid.sources.tables import shared_folder

#: First attempts that one round settles; slices of the running number of queries; ranges of it that a round is cut from.
ATTEMPTS, SLICE, RANGES = 100_000, 1 << 16, 1000
ANONYMOUS, OVERFLOW = "anonymous", "overflow"
_CLIENT = re.compile(r"[A-Za-z0-9._:-]{1,64}", re.A)


def client_id(header: str | None) -> str:
    """The client that a request's header names; anonymous if it names none."""
    text = (header or "").strip()
    if not text:
        return ANONYMOUS
    if not _CLIENT.fullmatch(text):
        raise ValueError("client id must be 1 to 64 letters, digits or . - _ :")
    return text


def clients(events: DataFrame, seq: str = "seq", config: Config = DEFAULT) -> DataFrame:
    """``events`` with ``client`` as the table of clients holds it: the first ones to come by name, others together."""
    first = events.groupBy("client").agg(F.min(seq).alias("__first"))
    # The smallest ``config.clients`` of the first arrivals: a bounded, sorted take.
    known = first.orderBy("__first", "client").limit(config.clients).select("client", F.lit(True).alias("__known"))
    return events.join(F.broadcast(known), "client", "left").withColumn("client", F.when(F.col("__known"), F.col("client")).otherwise(OVERFLOW)).drop("__known")


def admit_by_cap(events: DataFrame, registry: DataFrame, seq: str = "seq", config: Config = DEFAULT) -> DataFrame:
    """``events`` with ``error``: null if the name exists or finds a place in its shard, by order of arrival.

    Reserved names hold places but are never refused. The rank runs over the new names of a shard, one row
    each, not over events; an extra count per shard of names already there starts it."""
    reserved = F.startswith("name", F.lit(config.reserved_prefix))
    first = events.groupBy("name").agg(F.min(seq).alias("__seq")).join(registry.select("name").distinct(), "name", "left_anti")
    first = first.withColumn("shard", C.shard(F.col("name"), config.shards))
    held = registry.select("name").distinct().groupBy(C.shard(F.col("name"), config.shards).alias("shard")).agg(F.count("*").alias("__held"))
    # A shard has at most names_per_shard places: only so many of the earliest newcomers can be admitted.
    # The bound on the rank reaches the tasks before the shuffle, and what is admitted is as small as the cap.
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("__seq", "name"))
    ranked = first.withColumn("__rank", rank).where(F.col("__rank") <= config.names_per_shard).join(F.broadcast(held), "shard", "left")
    admitted = ranked.where(F.col("__rank") + F.coalesce("__held", F.lit(0)) <= config.names_per_shard).select("name")
    full = first.where(~reserved).join(F.broadcast(admitted), "name", "left_anti").select("name", F.lit(FULL_SHARD).alias("error"))
    return events.join(full, "name", "left")


class Places:
    """What is taken so far: names made, places of shards, and what clients used of their epochs."""

    def __init__(self, held: dict[int, int], config: Config = DEFAULT):
        self.config, self.places = config, dict(held)
        self.made: dict[str, int] = {}
        self.spent: dict[tuple[str, int], int] = {}

    def take(self, attempts: Iterable[tuple[str, str, int, int, int]]) -> None:
        """First attempts (name, client, shard, epoch, seq) in order of arrival. The shard's cap goes before the
        client's rate, and only a creation is charged."""
        for name, client, shard, epoch, seq in attempts:
            free = name.startswith(self.config.reserved_prefix)
            if name in self.made or (not free and self.places.get(shard, 0) >= self.config.names_per_shard):
                continue
            if not free and self.spent.get((client, epoch), 0) >= self.config.client_names:
                continue
            self.made[name] = seq
            self.places[shard] = self.places.get(shard, 0) + 1
            if not free:
                self.spent[client, epoch] = self.spent.get((client, epoch), 0) + 1

    def full(self) -> list[int]:
        return [k for k, n in self.places.items() if n >= self.config.names_per_shard]

    def used_up(self) -> list[tuple[str, int]]:
        return [k for k, n in self.spent.items() if n >= self.config.client_names]


def admit(events: DataFrame, registry: DataFrame, seq: str = "seq", time_ms: str = "arrived", config: Config = DEFAULT, at_a_time: int = ATTEMPTS) -> DataFrame:
    """``events(name, client, seq, arrived)`` with ``error`` under both the cap and the clients' rate."""
    spark = events.sparkSession
    new = events.join(registry.select("name").distinct(), "name", "left_anti")
    epoch = F.floor(F.col(time_ms) / (config.epoch_s * 1000)).cast("long")
    shard_of = C.shard(F.col("name"), config.shards)
    first = new.groupBy("name", "client", epoch.alias("epoch")).agg(F.min(seq).alias("seq")).withColumn("shard", shard_of)
    attempts = _written(first, "attempts")
    held = {r[0]: r[1] for r in registry.select("name").distinct().groupBy(shard_of.alias("shard")).count().collect()}
    taken, open_ = Places(held, config), attempts
    at, last = attempts.agg(F.min("seq"), F.max("seq")).first()
    while at is not None and (until := _until(open_, at, last, at_a_time)) is not None:
        # With the bound, no more than a round's attempts leave the tasks, however many tasks there are. It holds more
        # than that only if so many came at once; the rest is then left to the next round.
        some = open_.where(F.col("seq") <= until).orderBy("seq", "name").limit(at_a_time).select("name", "client", "shard", "epoch", "seq").collect()
        taken.take(some)
        at, name = some[-1]["seq"], some[-1]["name"]
        reserved = F.startswith("name", F.lit(config.reserved_prefix))
        # Names made are as many as the cap and the reserved ones at most; the others are fewer still.
        made = spark.createDataFrame([(n,) for n in taken.made], "name string")
        used = spark.createDataFrame(taken.used_up(), "client string, epoch long")
        open_ = attempts.where((F.col("seq") > at) | ((F.col("seq") == at) & (F.col("name") > name)))
        open_ = open_.where(reserved | ~F.col("shard").isin(taken.full())) if taken.full() else open_
        open_ = open_.join(F.broadcast(made), "name", "left_anti")
        open_ = open_.where(reserved).unionByName(open_.where(~reserved).join(F.broadcast(used), ["client", "epoch"], "left_anti"))
    created = spark.createDataFrame(list(taken.made.items()), "name string, created long")
    known = registry.select("name", F.lit(-1).cast("long").alias("created")).distinct()
    seen = events.join(created.unionByName(known), "name", "left")
    full = attempts_full(created, held, config)
    late = seen.withColumn("__shard", C.shard(F.col("name"), config.shards)).join(F.broadcast(full), F.col("__shard") == F.col("__full"), "left")
    error = F.when(F.col("created") <= F.col(seq), None).when(F.col("__when") <= F.col(seq), FULL_SHARD).otherwise(FULL_CLIENT)
    return late.select(*events.columns, error.alias("error"))


def _until(attempts: DataFrame, first: int, last: int, most: int) -> int | None:
    """Up to which ``seq`` of those from ``first`` to ``last`` there are half of ``most`` attempts or more, and no more than
    ``most`` unless so many share one. Counts of even ranges tell, then those within the range that is too full. None if
    there are no attempts."""
    until, room = None, most
    while True:
        width = (last - first) // RANGES + 1
        start = F.col("seq") - F.pmod(F.col("seq") - first, F.lit(width))
        counts = attempts.where(F.col("seq").between(first, last)).groupBy(start.alias("start")).count().collect()
        for start_, n in sorted(map(tuple, counts)):
            if n > room:
                break
            until, room = start_ + width - 1, room - n
        else:
            return until
        if until is not None and (room < most / 2 or width == 1):
            return until
        if width == 1:
            return start_
        first, last = start_, min(last, start_ + width - 1)


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, read again in each round."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attempts_full(created: DataFrame, held: dict[int, int], config: Config) -> DataFrame:
    """When each shard became full: a row for each of the ``shards`` that did."""
    spark = created.sparkSession
    start = spark.createDataFrame([(k, held.get(k, 0)) for k in range(config.shards)], "shard int, held long")
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("created"))
    made = created.withColumn("shard", C.shard(F.col("name"), config.shards)).withColumn("rank", rank)
    by_now = made.join(F.broadcast(start), "shard").where(F.col("rank") + F.col("held") == config.names_per_shard).select("shard", "created")
    before = start.where(F.col("held") >= config.names_per_shard).select("shard", F.lit(-1).cast("long").alias("created"))
    return by_now.unionByName(before).groupBy(F.col("shard").alias("__full")).agg(F.min("created").alias("__when"))


def client_rate(creations: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``creations(client, arrived, seq)``, each of another new name, with ``allowed``: the first so many in an epoch."""
    epoch = F.floor(F.col("arrived") / (config.epoch_s * 1000)).cast("long").alias("epoch")
    ranked = creations.select("*", epoch)
    rank = F.row_number().over(Window.partitionBy("client", "epoch").orderBy("seq"))
    return ranked.withColumn("allowed", rank <= config.client_names)


def query_budget(queries: DataFrame, config: Config = DEFAULT, slice_: int = SLICE) -> DataFrame:
    """``queries(client, arrived, seq, units)`` with ``allowed``: the budget is looked at before, and charged after,
    so that the query which uses it up still runs, and those refused cost nothing.

    ``seq`` is a running number. A client's queries are added up in slices of it, and slices after one another, so
    that no task holds all queries of a client."""
    at = [F.floor(F.col("arrived") / (config.epoch_s * 1000)).cast("long").alias("epoch"), F.floor(F.col("seq") / slice_).cast("long").alias("__slice")]
    rows = queries.select("*", *at)
    by = ["client", "epoch", "__slice"]
    sums = rows.groupBy(*by).agg(F.sum("units").alias("__units"))
    up_to = lambda c, keys, on: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(on).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.select(*[F.col(c).alias(f"__of_{c}") for c in by], up_to("__units", by[:2], "__slice").alias("__before"))
    joined = rows.join(before, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by])
    # Charges only add up until the budget is used, and nothing after that is allowed: the plain sum decides.
    spent = F.col("__before") + up_to("units", by, "seq")
    return joined.withColumn("allowed", spent < config.client_units).drop("__slice", "__before", *[f"__of_{c}" for c in by])


def query_cost(computed: Column, walked: Column, config: Config = DEFAULT) -> Column:
    return (computed + F.ceil(walked / F.lit(config.names_per_unit))).cast("long")
