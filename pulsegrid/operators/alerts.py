"""Threshold rules over windows of the bucket table, and the states that rules go through."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions import durations
from pulsegrid.operators import buckets as B

# What rules may name.
STATS = ("count", "avg", "min", "max", "p50", "p90", "p99", "increase")
OPS = (">", ">=", "<", "<=")
OK, PENDING, FIRING, NODATA = "ok", "pending", "firing", "nodata"

RULE_SCHEMA = "name string, metric string, stat string, op string, value double, window_ms double, for_ms double"
STATE_SCHEMA = "rule string, metric string, state string, value double, since long"
FIELDS = frozenset(("name", "metric", "stat", "op", "value", "window", "for"))
MAX_RULES_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """``window_ms`` 0 is the whole window; ``for_ms`` is how long a breach waits before it fires. Parts of a
    millisecond count."""

    name: str
    metric: str
    stat: str
    op: str
    value: float
    window_ms: float = 0.0
    for_ms: float = 0.0


def validate(rules: Iterable[Rule], config: Config = DEFAULT) -> list[Rule]:
    """The rules, or an error that names the first wrong one."""
    out, seen = list(rules), set()
    for r in out:
        wrong = (
            "name is required" if not r.name
            else "metric is required" if not r.metric
            else f"unknown stat {r.stat!r}" if r.stat not in STATS
            else f"unknown op {r.op!r}" if r.op not in OPS
            else "window must be within retention" if not 0 <= r.window_ms <= config.window_s * 1000
            else "for must not be negative" if r.for_ms < 0
            else "duplicate name" if r.name in seen
            else ""
        )
        if wrong:
            raise ValueError(f"rule {r.name!r}: {wrong}")
        seen.add(r.name)
    return out


def _no_constant(text: str):
    raise ValueError(f"invalid value {text}")


def load(body: bytes, config: Config = DEFAULT) -> list[Rule]:
    """Rules from a JSON array; unknown keys, data after it and bodies over the limit are errors. Keys match whatever
    their ASCII case, the last of equal ones counts, and null leaves a field as it is."""
    if len(body) > MAX_RULES_BYTES:
        raise ValueError("rules are too large")
    found = json.loads(body, parse_constant=_no_constant)
    if not isinstance(found, list):
        raise ValueError("rules must be an array")
    out = []
    for r in found:
        if not isinstance(r, dict):
            raise ValueError("a rule must be an object")
        r = {k.lower() if k.isascii() else k: v for k, v in r.items() if v is not None or k.lower() not in FIELDS}
        unknown = set(r) - FIELDS
        if unknown:
            raise ValueError(f"unknown field {sorted(unknown)[0]!r}")
        if any(not isinstance(r.get(k, ""), str) for k in ("name", "metric", "stat", "op", "window", "for")):
            raise ValueError("a rule's texts must be strings")
        if isinstance(r.get("value", 0), bool) or not isinstance(r.get("value", 0), (int, float)):
            raise ValueError("value must be a number")
        ms = [durations.parse(r[k]) / 1e6 if r.get(k) else 0.0 for k in ("window", "for")]
        out.append(Rule(r.get("name", ""), r.get("metric", ""), r.get("stat", ""), r.get("op", ""), float(r.get("value", 0)), *ms))
    return validate(out, config)


def default_rules(config: Config = DEFAULT) -> list[Rule]:
    """The rules that hold where no others are given; one of them depends on the cap on names."""
    own = config.reserved_prefix
    # Fixed values.
    return [
        Rule("cpu-hot", "cpu.load", "avg", ">", 0.9, 30_000, 20_000),
        Rule("cpu-spike", "cpu.load", "max", ">", 0.99),
        Rule("slow-requests", "http.latency_ms", "p99", ">", 500.0, 0, 20_000),
        Rule("server-shedding", f"{own}requests.shed", "increase", ">", 0.0, 0, 30_000),
        Rule("cardinality-pressure", f"{own}store.metrics", "max", ">", 0.8 * config.shards * config.names_per_shard, 0, 30_000),
    ]


def watches_itself(rules: Iterable[Rule], config: Config = DEFAULT) -> bool:
    return any(r.metric.startswith(config.reserved_prefix) for r in rules)


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [tuple(asdict(replace(r, value=float(r.value), window_ms=float(r.window_ms), for_ms=float(r.for_ms))).values()) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def breached(value: Column, op: Column, limit: Column) -> Column:
    return F.when(op == ">", value > limit).when(op == ">=", value >= limit).when(op == "<", value < limit).otherwise(value <= limit)


def evaluate(rules: DataFrame, table: DataFrame, rows: DataFrame, ticks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per tick (``now_ms``) and rule: value and outcome (ok, firing as soon as breached, or nodata with value 0).

    A rule's window decides which buckets it reads, so the join is on the metric with bounds on the bucket: from
    the cutoff to what may be there by the tick, so that a replay sees at each tick what was there then.
    Rules and ticks are small by nature (a rules file is bounded, ticks are one batch of clock readings)."""
    width = F.lit(config.bucket_s * 1000)
    start = F.col("now_ms") - F.when(F.col("window_ms") == 0, config.window_s * 1000).otherwise(F.col("window_ms"))
    asked = rules.join(ticks.select("now_ms").distinct()).withColumn("cut", (F.floor(start / width) * config.bucket_s).cast("long"))
    last = F.floor((F.col("now_ms") + config.future_ms) / 1000).cast("long").alias("last")
    asked = asked.select(F.col("name").alias("rule"), "metric", "stat", "op", F.col("value").alias("limit"), "for_ms", "now_ms", "cut", last)
    keys = ["rule", "now_ms"]
    reads = asked.select("rule", "now_ms", "metric", "cut", "last")
    bound = lambda t: reads.join(t, (F.col("metric") == t["name"]) & (t["bucket_start"] >= F.col("cut")) & (t["bucket_start"] <= F.col("last")))
    whole = bound(table).groupBy(*keys).agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max")
    )
    found = whole.join(B.quantiles(bound(rows), keys), keys, "left")
    out = asked.join(found, keys, "left")
    pick = F.when(F.col("stat") == "count", F.col("count").cast("double")).when(F.col("stat") == "avg", F.col("sum") / F.col("count"))
    for s in ("min", "max", *B.QUANTILES):
        pick = pick.when(F.col("stat") == s, F.coalesce(F.col(s), F.lit(0.0)))
    pick = pick.otherwise(B.increase())
    value = F.when(F.col("count").isNull(), 0.0).otherwise(pick)
    outcome = F.when(F.col("count").isNull(), NODATA).when(breached(value, F.col("op"), F.col("limit")), FIRING).otherwise(OK)
    return out.select("rule", "metric", "for_ms", "now_ms", value.alias("value"), outcome.alias("outcome"))


def step(state: str, since: int, outcome: str, now_ms: int, for_ms: float) -> tuple[str, int]:
    """The state after a tick. A fresh breach waits, pending, until it has lasted ``for_ms``."""
    after = outcome
    if outcome == FIRING and state != FIRING:
        began = since if state == PENDING else now_ms
        after = FIRING if now_ms - began >= for_ms else PENDING
    return after, since if after == state else now_ms


def announced(before: str, after: str) -> bool:
    """Whether a transition is told: not those into pending, nor out of it without firing."""
    return before != after and after != PENDING and not (before == PENDING and after in (OK, NODATA))


def replay(outcomes: DataFrame, began_ms: int, states: DataFrame | None = None) -> DataFrame:
    """States of each rule over its ticks in order: rule, metric, now_ms, state, value, since, announce.

    One rule's ticks are one group; rules start as nodata at ``began_ms``, or from ``states``."""
    start = {} if states is None else {r["rule"]: (r["state"], r["since"]) for r in states.collect()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("now_ms")
        state, since = start.get(pdf["rule"].iloc[0], (NODATA, began_ms))
        out = []
        for outcome, now, wait in zip(pdf["outcome"], pdf["now_ms"], pdf["for_ms"], strict=True):
            before = state
            state, since = step(state, since, outcome, int(now), float(wait))
            out.append((state, since, announced(before, state)))
        return pdf[["rule", "metric", "now_ms", "value"]].assign(state=[o[0] for o in out], since=[o[1] for o in out], announce=[o[2] for o in out])

    schema = "rule string, metric string, now_ms long, value double, state string, since long, announce boolean"
    return outcomes.groupBy("rule").applyInPandas(run, schema)


def initial(rules: DataFrame, now_ms: int) -> DataFrame:
    return rules.select(
        F.col("name").alias("rule"), "metric", F.lit(NODATA).alias("state"), F.lit(0.0).alias("value"), F.lit(now_ms).cast("long").alias("since")
    )


def reload(old: DataFrame, new: DataFrame, states: DataFrame, now_ms: int) -> DataFrame:
    """States after a change of rules: a rule that stays the same in every part keeps its own, others start anew."""
    same = new.join(old, new.columns, "left_semi").select(F.col("name").alias("rule"))
    kept = states.join(same, "rule", "left_semi")
    fresh = initial(new, now_ms).join(same, "rule", "left_anti")
    return kept.unionByName(fresh)


def listing(states: DataFrame, state: str = "", after: str = "", limit: int = DEFAULT.max_limit) -> DataFrame:
    """States by rule name, of one kind, from a cursor on, so many."""
    if state and state not in (OK, PENDING, FIRING, NODATA):
        raise ValueError(f"unknown state {state!r}")
    return _asked(states, state, after).orderBy("rule").limit(limit)


def listing_page(states: DataFrame, state: str = "", after: str = "", limit: int = DEFAULT.max_limit) -> DataFrame:
    """One row: matched (after both filters), truncated, next."""
    took = listing(states, state, after, limit).agg(F.count("*").alias("n"), F.max("rule").alias("last"))
    both = _asked(states, state, after).agg(F.count("*").alias("matched")).join(took)
    return both.select("matched", (F.col("matched") > F.col("n")).alias("truncated"), F.when(F.col("matched") > F.col("n"), F.col("last")).alias("next"))


def _asked(states: DataFrame, state: str, after: str) -> DataFrame:
    kept = states.where(F.col("state") == state) if state else states
    return kept.where(F.col("rule") > after) if after else kept


def transition_text(rule: str, metric: str, before: str, after: str, value: float) -> str:
    """A line for the log: with the value, unless there is none."""
    if after == NODATA:
        return f"alert {rule}: {before} -> {after} ({metric} has no data)"
    return f"alert {rule}: {before} -> {after} ({metric} = {value:g})"
