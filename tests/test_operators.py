"""Operators on small tables worked out by hand, and properties."""

import json
import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from pulsegrid.config import Config, from_environment
from pulsegrid.functions import columns as C
from pulsegrid.functions import durations
from pulsegrid.operators import admission, alerts, buckets, reading, responses, telemetry, validation
from pulsegrid.sources import decoder, snapshots, tables

NOW = 1_700_000_000_000
EVENT = "name string, value double, ts long"


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize(
    ("text", "ns"),
    [("90s", 90 * 10**9), ("2m30s", 150 * 10**9), ("1h", 3600 * 10**9), ("1.5s", 1_500_000_000), ("0", 0), ("-2ms", -2_000_000), ("3us", 3000), ("3µs", 3000)],
)
def test_durations(text, ns):
    assert durations.parse(text) == ns


@pytest.mark.parametrize("text", ["", "5", "s", "1x", "1 s", "-", "."])
def test_wrong_durations(text):
    with pytest.raises(ValueError):
        durations.parse(text)


def test_duration_text():
    shown = [durations.show(n) for n in (0, 10 * 10**9, 60 * 10**9, 65 * 10**9, 3600 * 10**9, 1_500_000, -90 * 10**9, 1_500_000_000)]
    assert shown == ["0s", "10s", "1m0s", "1m5s", "1h0m0s", "1.5ms", "-1m30s", "1.5s"]


def test_hash_vectors(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",)], "s string").select("s", C.fnv1a(F.col("s")).alias("h"))
    assert {r.s: r.h for r in df.collect()} == {"": 2166136261, "a": 0xE40C292C, "foobar": 0xBF9CF968}


def test_sketch_errs_by_one_percent(spark):
    values = [10 ** (i / 7) * s for i in range(-60, 63) for s in (1, -1)] + [0.0, 1e-12]
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    sign, idx = C.sign(F.col("value")), C.index(F.col("value"))
    for v, r, s in df.select("value", C.representative(sign, idx), sign).collect():
        assert abs(v) < 1e-9 and s == 0 or math.isclose(v, r, rel_tol=0.0100001)


def test_quantiles_take_the_ranked_value(spark):
    random.seed(3)
    values = [random.uniform(-50, 50) for _ in range(500)] + [0.0] * 9
    rows = buckets.sketch(events(spark, *[("a", v, NOW) for v in values]))
    got = one(buckets.quantiles(rows, ["name"]))
    for q, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
        want = sorted(values)[min(int(q * len(values)), len(values) - 1)]
        assert math.isclose(got[name], want, rel_tol=0.0101, abs_tol=1e-9)


def test_readme_spread(spark):
    got = one(buckets.quantiles(buckets.sketch(events(spark, *[("a", 20.0, NOW)] * 99, ("a", 900.0, NOW))), ["name"]))
    assert [round(got[k], 1) for k in ("p50", "p90", "p99")] == [19.9, 19.9, 907.0]


def test_collapse_keeps_counts_and_the_tail(spark):
    rows = spark.createDataFrame([("a", 0, 1, i, 1) for i in range(50)], "name string, bucket_start long, sign int, idx int, n long")
    got = {r.idx: r.n for r in buckets.collapse(rows, 8).collect()}
    assert got == {42: 43, **{i: 1 for i in range(43, 50)}}


def test_merge_is_the_fold_of_all(spark):
    a = events(spark, *[("m", float(i % 10 + 1), NOW - i * 1000) for i in range(40)])
    b = events(spark, *[("m", float(i % 7), NOW - i * 900) for i in range(30)], ("n", 1.0, NOW))
    both = buckets.merge_buckets(buckets.fold(a), buckets.fold(b))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, buckets.fold(a.union(b)).collect()))
    sketches = buckets.merge_sketches(buckets.sketch(a), buckets.sketch(b))
    assert sorted(map(tuple, sketches.collect())) == sorted(map(tuple, buckets.sketch(a.union(b)).collect()))


def test_window_rolls_and_is_open_above(spark):
    base = NOW // 10_000 * 10_000
    table = buckets.fold(events(spark, ("m", 1.0, base), ("m", 3.0, base), ("m", 5.0, base + 30_000), ("m", 9.0, base + 85_000)))
    counts = [
        buckets.live(table, buckets.cutoff(base + s * 1000, 60)).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] for s in (0, 69, 75, 150, 160)
    ]
    assert counts == [4, 4, 2, 0, 0]
    assert buckets.covers(base + 69_000, buckets.cutoff(base + 69_000, 60)) == 69


def test_series_sum_to_stats(spark):
    df = events(spark, *[("m", float(i), NOW - i * 1000) for i in range(50)])
    store = df.select("name").distinct(), buckets.fold(df), buckets.sketch(df)
    req = reading.request(names=["m"])
    points = reading.series(*store, req, NOW).collect()
    whole = one(reading.stats(*store, req, NOW))
    assert sum(p["count"] for p in points) == whole["count"] == 50
    assert [p.start for p in points] == sorted(p.start for p in points)
    assert telemetry.stats_violations(reading.stats(*store, req, NOW)).count() == 0


def test_paging_covers_each_name_once(spark):
    df = events(spark, *[(f"n{i:02d}", 1.0, NOW if i % 3 else NOW - 600_000) for i in range(23)])
    store = df.select("name").distinct(), buckets.fold(df), buckets.sketch(df)
    seen, after = [], ""
    for _ in range(10):
        req = reading.request(after=after, limit="5")
        seen += [r.name for r in reading.stats(*store, req, NOW).collect()]
        meta = one(reading.page(store[0], req, NOW))
        if not meta["truncated"]:
            break
        after = meta["next"]
    assert sorted(seen) == [f"n{i:02d}" for i in range(23) if i % 3]


@pytest.mark.parametrize(
    "parameters",
    [{"window": "0s"}, {"window": "61s"}, {"window": "x"}, {"limit": "0"}, {"limit": "1001"}, {"limit": "a"}, {"names": [""]}, {"names": []}, {"names": ["a"], "prefix": "b"}],
)
def test_wrong_requests(parameters):
    with pytest.raises(ValueError):
        reading.request(**parameters)


def test_reasons_in_order(spark):
    rows = [
        ("", 1.0, NOW), ("x" * 257, 1.0, NOW), ("pulsegrid.a", 1.0, NOW), ("a", 1.0, 0), ("a", 1.0, NOW - 60_001), ("a", 1.0, NOW - 60_000),
        ("a", 1.0, NOW + 10_000), ("a", 1.0, NOW + 10_001), (None, 1.0, NOW), ("é" * 128, 1.0, NOW), ("é" * 129, 1.0, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {EVENT}")
    got = [r.error for r in validation.verdicts(df, NOW).orderBy("i").collect()]
    assert got[0] == got[8] == "name is required"
    assert got[1] == "name is 257 bytes, over the 256-byte limit" and got[10].startswith("name is 258")
    assert "reserved" in got[2] and got[3].startswith("ts is required")
    assert got[4] == "event too old (ts before now-1m0s)" and got[7] == "ts too far in the future (after now+10s)"
    assert got[5] is got[6] is got[9] is None


def test_batch_status(spark):
    rows = [("a", None, False), ("a", "x", False), ("b", "x", False), ("c", "too many metrics", True), ("d", "too many metrics", True), ("d", "x", False)]
    df = spark.createDataFrame(rows, "b string, error string, retryable boolean")
    assert {r.b: r.status for r in validation.batch_summary(df, ["b"]).collect()} == {"a": 200, "b": 400, "c": 429, "d": 400}


GOOD = [
    ('{"name":"a","value":1.5,"ts":3}', ("a", 1.5, 3)),
    ('{"NAME":"a","tS":3}', ("a", 0.0, 3)),
    ('{"name":"a","name":null,"ts":1}', ("a", 0.0, 1)),
    ('{"name":"a","name":"b","value":-0,"ts":1}', ("b", 0.0, 1)),
    ('{"x":{"y":[1,{"z":"}"}]},"name":"\\ud83d"}', ("�", 0.0, 0)),
    ('{"name":"\\ud83d\\ude00","value":1E3}', ("\U0001f600", 1000.0, 0)),
    ("null", ("", 0.0, 0)),
    ("{}", ("", 0.0, 0)),
    ('{"type":5,"ts":9223372036854775807}', ("", 0.0, 9223372036854775807)),
]
BAD = [
    '{"name":5}', '{"value":"3"}', '{"ts":1.0}', '{"ts":1e3}', '{"ts":9223372036854775808}', '{"value":01}', '{"value":1.}', '{"value":.5}', '{"value":+1}',
    '{"value":1e}', '{"value":1e999}', '{"value":NaN}', "{", '{"name":"a",}', "[]", "123", "{'name':'a'}", '{"a":[1,]}', '{"a":{1:2}}', '{"a":"\\x"}', '{"a":"\t"}',
    '{"name":"a","ts":1}x', '{"name":"a"} {"name":"b"}', "", '{"value":true}',
]


@pytest.mark.parametrize(("text", "want"), GOOD)
def test_decoder_takes(text, want):
    assert decoder.decode_one(text.encode()) == want


@pytest.mark.parametrize("text", BAD)
def test_decoder_refuses(text):
    with pytest.raises(ValueError):
        decoder.decode_one(text.encode())


def test_bad_bytes_become_one_mark_each():
    assert decoder.decode_one(b'{"name":"\xf0\x9f\x98"}')[0] == "�" * 3


def test_decoder_agrees_with_json():
    random.seed(1)
    for _ in range(200):
        e = {"name": random.choice(["a", "é", '"\\']), "value": random.choice([0, 1.5, -2e10, 3]), "ts": random.randint(-5, 10**13), "z": [{}, [], "{", None, True]}
        text = json.dumps(e, indent=random.choice([None, 1]), ensure_ascii=random.random() < 0.5)
        assert decoder.decode_one(text.encode()) == (e["name"], float(e["value"]), e["ts"])


def test_bodies(spark):
    good = b'{"name":"a","ts":1}\n\n {"name":"b",\n"ts":2}'
    bodies = spark.createDataFrame([("x", good), ("y", good + b'{"name":'), ("z", None), ("e", b"")], "body_id string, body binary")
    got = decoder.decode_bodies(bodies)
    assert sorted((r.body_id, r["index"], r.fatal) for r in got.collect()) == [("x", 0, False), ("x", 1, False), ("y", 0, False), ("y", 1, False), ("y", 2, True)]
    assert [(r.body_id, r.status) for r in decoder.failure_status(got, ["body_id"]).collect()] == [("y", 400)]


def test_body_limits():
    small = Config(max_batch_events=2, max_body_bytes=50)
    assert [x[5] for x in decoder.decode(b"null " * 3, small)] == [False, False, True]
    assert next(decoder.decode(b" " * 51, small))[5]
    # what stands before the limit is read, whether it falls between events or into one
    event = b'{"name":"a","ts":1} '
    for size in (50, 45, 40, 39):
        got = list(decoder.decode(event * 3, Config(max_body_bytes=size)))
        assert [x[5] for x in got] == [False, False, True] and got[2][4] == f"body is over {size} bytes at event 2"
    assert [x[4] for x in decoder.decode(event + b"x" + event * 9, small)][1].startswith("event 1: ")
    # a value that nests too deep ends the body, those before it stay
    deep = event + b'{"x":' + b"[" * 20_000 + b"]" * 20_000 + b"}"
    got = list(decoder.decode(deep))
    assert [x[5] for x in got] == [False, True] and "max depth" in got[1][4]


def test_responses_of_bodies(spark):
    config = Config(max_batch_events=2, max_body_bytes=60, reserved_prefix="own.")
    event = '{"name":"a","ts":%d} ' % NOW
    texts = {"whole": event, "empty": " ", "null": None, "broken": event + '{"na', "many": "null " * 3, "long": event * 3, "bad": "{}", "none": "x"}
    bodies = spark.createDataFrame(list(texts.items()), "body_id string, body string")
    judged = validation.verdicts(decoder.decode_bodies(bodies, config), NOW, config)
    got = {r.body_id: r for r in validation.batch_responses(judged, bodies, ["body_id"], config).collect()}
    assert {k: (r.accepted, r.rejected, r.status) for k, r in got.items()} == {
        "whole": (1, 0, 200), "empty": (0, 0, 400), "null": (0, 0, 400), "broken": (1, 0, 400), "many": (0, 2, 413), "long": (1, 0, 413), "bad": (0, 1, 400), "none": (0, 0, 400),
    }
    assert got["empty"].fatal == validation.EMPTY and got["whole"].fatal is None and got["none"].fatal.startswith("event 0")
    assert {(r.body_id, r["index"]) for r in validation.first_errors(judged, ["body_id"], "index").collect()} == {("many", 0), ("many", 1), ("bad", 0)}
    full = spark.createDataFrame([("b", validation.FULL_SHARD, True, False)], "body_id string, error string, retryable boolean, fatal boolean")
    assert validation.batch_responses(full, full, ["body_id"], config).select("status", "retry_after").first() == (429, config.window_s)


@pytest.mark.parametrize("at_a_time", [1, 7, 1000])
def test_fold_of_attempts_and_tables_agree(spark, at_a_time):
    config = Config(shards=2, names_per_shard=3, client_names=2, epoch_s=10)
    random.seed(5)
    rows = [(i, f"n{random.randrange(14)}", f"c{random.randrange(3)}", NOW + i * 700) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, name string, client string, arrived long")
    registry = spark.createDataFrame([("n0",), ("n1",)], "name string")
    got = {r.seq: r.error for r in admission.admit(df, registry, config=config, at_a_time=at_a_time).collect()}
    names = spark.createDataFrame([(n,) for n in {r[1] for r in rows}], "name string").select("name", C.shard(F.col("name"), 2).alias("s"))
    shard = {r.name: r.s for r in names.collect()}
    made, spent, held = {"n0", "n1"}, {}, {}
    for n in made:
        held[shard[n]] = held.get(shard[n], 0) + 1
    for seq, name, client, at in rows:
        key = client, at // 10_000
        if name in made:
            want = None
        elif held.get(shard[name], 0) >= 3:
            want = admission.FULL_SHARD
        elif spent.get(key, 0) >= 2:
            want = admission.FULL_CLIENT
        else:
            want = None
            made.add(name)
            held[shard[name]] = held.get(shard[name], 0) + 1
            spent[key] = spent.get(key, 0) + 1
        assert got[seq] == want, seq


def test_rounds_send_their_attempts_and_no_others(spark):
    df = spark.range(80_000).select(F.col("id").alias("seq"), F.format_string("n%d", "id").alias("name"), F.lit("c").alias("client"), F.lit(NOW).alias("arrived"))
    sc = spark.sparkContext
    many = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    for k, v in many.items():
        spark.conf.set(k, v)
    sc.setJobGroup("rounds", "rounds")
    try:
        admission.admit(df, df.select("name").limit(0), config=Config(client_names=1), at_a_time=5000)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("rounds") for s in sc.statusTracker().getJobInfo(j).stageIds}
    of = sc._jsc.sc().statusStore().lastStageAttempt
    sent = [x.resultSize() for x in map(of, stages) if x.numCompleteTasks()]
    # some 85 bytes each
    assert max(sent) < 5000 * 120


@pytest.mark.parametrize("most", [1, 3, 10, 400])
def test_a_round_ends_where_it_is_full(spark, most):
    random.seed(3)
    seqs = sorted([*random.sample(range(10**12), 60), *range(5000, 5100), *[7] * 5])
    df, at = spark.createDataFrame([(x,) for x in seqs], "seq long"), 0
    for _ in range(6):
        until = admission._until(df.where(F.col("seq") >= at), at, seqs[-1], most)
        took, rest = [x for x in seqs if at <= x <= until], [x for x in seqs if x > until]
        assert took and (len(took) <= most or len(set(took)) == 1)
        assert 2 * len(took) >= most or not rest or len(took) + rest.count(rest[0]) > most
        if not rest:
            break
        at = until + 1
    assert admission._until(df.where("seq < 0"), at, seqs[-1], most) is None


def test_client_ids():
    assert [admission.client_id(x) for x in (None, " ", " a.b ")] == ["anonymous", "anonymous", "a.b"]
    for wrong in ("a b", "x" * 65, "é"):
        with pytest.raises(ValueError):
            admission.client_id(wrong)


def test_budget_lets_one_query_overshoot(spark):
    df = spark.createDataFrame([("c", NOW, i, 30_000) for i in range(4)], "client string, arrived long, seq long, units long")
    assert [r.allowed for r in admission.query_budget(df).orderBy("seq").collect()] == [True, True, False, False]


def test_budgets_add_up_over_slices(spark):
    random.seed(8)
    rows = [(random.choice(["a", "b", None]), NOW + i * 300, i, random.randrange(30)) for i in range(300)]
    df = spark.createDataFrame(rows, "client string, arrived long, seq long, units long")
    config = Config(client_units=150)
    got = {r.seq: r.allowed for r in admission.query_budget(df, config, 16).collect()}
    spent = {}
    for client, at, seq, units in rows:
        key = client, at // 10_000
        assert got[seq] == (spent.get(key, 0) < 150)
        spent[key] = spent.get(key, 0) + units


def test_the_cap_by_ranks(spark):
    config = Config(shards=3, names_per_shard=4)
    random.seed(9)
    rows = [(i, random.choice(["", "pulsegrid."]) * (i % 5 == 0) + f"n{random.randrange(60)}") for i in range(300)]
    registry = [f"n{i}" for i in range(5)]
    df = spark.createDataFrame(rows, "seq long, name string")
    got = {r.seq: r.error for r in admission.admit_by_cap(df, spark.createDataFrame([(n,) for n in registry], "name string"), "seq", config).collect()}
    shard = {r.name: r.s for r in df.select("name").union(spark.createDataFrame([(n,) for n in registry], "name string")).distinct().select("name", C.shard(F.col("name"), 3).alias("s")).collect()}
    made, held = set(registry), [sum(shard[n] == k for n in registry) for k in range(3)]
    for seq, name in rows:
        want = None
        if name not in made:
            if held[shard[name]] >= 4 and not name.startswith("pulsegrid."):
                want = admission.FULL_SHARD
            else:
                made.add(name)
                held[shard[name]] += 1
        assert got[seq] == want


def test_states_wait_and_fire():
    state, since, seen = alerts.NODATA, 0, []
    for now, outcome in ((10, "ok"), (20, "firing"), (49, "firing"), (50, "firing"), (60, "firing"), (70, "nodata"), (80, "firing"), (90, "ok")):
        before = state
        state, since = alerts.step(state, since, outcome, now, 30)
        seen.append((state, since, alerts.announced(before, state)))
    assert seen == [
        ("ok", 10, True), ("pending", 20, False), ("pending", 20, False), ("firing", 50, True), ("firing", 50, False), ("nodata", 70, True),
        ("pending", 80, False), ("ok", 90, False),
    ]
    assert alerts.step("ok", 0, "firing", 5, 0) == ("firing", 5)


def test_rules_file():
    rules = alerts.load(b'[{"name":"r","metric":"m","stat":"max","op":">","value":90,"window":"30s","for":"1m"}]')
    assert rules == [alerts.Rule("r", "m", "max", ">", 90.0, 30_000, 60_000)]
    for wrong in (b"{}", b'[{"name":"r","extra":1}]', b"[] x", b'[{"name":"r","metric":"m","stat":"sum","op":">"}]', b'[{"name":"r","metric":"m","stat":"max","op":">","window":"2m"}]'):
        with pytest.raises(ValueError):
            alerts.load(wrong)
    fine = alerts.load(b'[{"NAME":"r","Metric":"m","stat":"max","stat":"min","op":">","value":null,"Window":"500us","for":"1500ns"}]')
    assert fine == [alerts.Rule("r", "m", "min", ">", 0.0, 0.5, 0.0015)]
    with pytest.raises(ValueError):
        alerts.load(b'[{"name":"r","metric":"m","stat":"max","op":">","value":NaN}]')
    rules = alerts.default_rules(Config(shards=2, names_per_shard=50))
    assert alerts.watches_itself(rules) and alerts.validate(rules)
    assert [(r.name, r.metric, r.stat, r.value, r.window_ms, r.for_ms) for r in rules] == [
        ("cpu-hot", "cpu.load", "avg", 0.9, 30_000, 20_000), ("cpu-spike", "cpu.load", "max", 0.99, 0, 0),
        ("slow-requests", "http.latency_ms", "p99", 500.0, 0, 20_000), ("server-shedding", "pulsegrid.requests.shed", "increase", 0.0, 0, 30_000),
        ("cardinality-pressure", "pulsegrid.store.metrics", "max", 80.0, 0, 30_000),
    ]


def test_a_short_window_reads_its_own_bucket(spark):
    table = buckets.fold(events(spark, ("m", 1.0, NOW - 25_000), ("m", 5.0, NOW)))
    rows = buckets.sketch(events(spark, ("m", 1.0, NOW - 25_000), ("m", 5.0, NOW)))
    rules = alerts.rules_frame(spark, [alerts.Rule("short", "m", "count", ">", 0.0, 0.5), alerts.Rule("whole", "m", "count", ">", 0.0)])
    got = alerts.evaluate(rules, table, rows, spark.createDataFrame([(NOW,)], "now_ms long")).collect()
    assert {r.rule: r.value for r in got} == {"short": 1.0, "whole": 2.0}


def test_later_events_do_not_tell_on_earlier_ticks(spark):
    random.seed(3)
    every = [("m", random.randrange(1024) / 1024, NOW - 60_000 + 900 * i) for i in range(200)]
    rules = alerts.rules_frame(spark, [alerts.Rule(s, "m", s, ">", 0.5) for s in ("count", "avg", "p90", "increase")])
    for tick in (NOW - 20_000, NOW + 5_000, NOW + 60_000):
        at = spark.createDataFrame([(tick,)], "now_ms long")
        answers = []
        for some in (every, [e for e in every if e[2] // 10_000 <= (tick + 10_000) // 10_000]):
            store = buckets.fold(events(spark, *some)), buckets.sketch(events(spark, *some))
            evaluated = alerts.evaluate(rules, *store, at).select("rule", "value", "outcome").collect()
            registry = events(spark, *some).select("name")
            shown = reading.stats(registry, *store, reading.request(), tick).collect(), reading.series(registry, *store, reading.request(names=["m"]), tick).collect()
            answers.append((sorted(evaluated), shown))
        assert answers[0] == answers[1]


def test_snapshot_falls_back_and_reports(spark, tmp_path):
    df = events(spark, *[(f"m{i}", float(i), NOW - i * 500) for i in range(20)], ("pulsegrid.x", 1.0, NOW))
    table, rows, folder = buckets.fold(df), buckets.sketch(df), f"file://{tmp_path}/s"
    assert snapshots.restore(spark, folder, NOW) is None
    snapshots.write(table, rows, folder, NOW - 1000)
    last = snapshots.write(table, rows, folder, NOW)
    got, _, reports = snapshots.restore(spark, folder, NOW)
    assert not reports and got.count() == 20
    spark.createDataFrame([(9, 0, 10, 0, 0, 0)], "format int, written_ms long, bucket_s int, rows long, sketch_rows long, checksum long").select(
        "format", "written_ms", "bucket_s", "rows", "sketch_rows", F.col("checksum").cast("decimal(38,0)").alias("checksum")
    ).write.mode("overwrite").parquet(f"{last}/manifest")
    got, _, reports = snapshots.restore(spark, folder, NOW)
    assert len(reports) == 1 and got.count() == 20


def test_a_restore_holds_the_cap_unless_told(spark, tmp_path):
    df = events(spark, *[(f"m{i}", float(i), NOW) for i in range(20)])
    folder, config = f"file://{tmp_path}/s", Config(shards=2, names_per_shard=3)
    snapshots.write(buckets.fold(df), buckets.sketch(df), folder, NOW, config)
    names = lambda t: t.select("name").distinct().count()
    assert [names(t) for t in snapshots.restore(spark, folder, NOW, config)[:2]] == [6, 6]
    assert [names(t) for t in snapshots.restore(spark, folder, NOW, config, capped=False)[:2]] == [20, 20]


def test_accepted_is_recorded(spark):
    df = tables.generated(spark, 10_000, 50, NOW, 25)
    judged = validation.verdicts(df, NOW)
    got = one(telemetry.exactness(judged, buckets.fold(judged.where("error is null"))))
    assert got["exact"] and got["accepted"] == 7500


def test_environment():
    assert from_environment({"PULSEGRID_MAX_NAMES": "100"}).names_per_shard == 3
    paths = from_environment({"PULSEGRID_RULES": "/r.json", "PULSEGRID_SNAPSHOT": "/s"})
    assert (paths.rules_path, paths.snapshot_path) == ("/r.json", "/s") and from_environment({}) == Config()
    for wrong in ("0", "x", "31"):
        with pytest.raises(ValueError):
            from_environment({"PULSEGRID_MAX_NAMES": wrong})


def test_answers_as_json(spark):
    df = events(spark, ("a", 1.0, NOW - 11_000), ("a", 3.0, NOW), ("b", 2.0, NOW), ("c", 5.0, NOW))
    store = df.select("name"), buckets.fold(df), buckets.sketch(df)
    got = json.loads(responses.stats(*store, reading.request(limit="2", window="30s"), NOW).first().body)
    assert (got["window"], got["matched"], got["truncated"], got["next"]) == ("30s", 3, True, "b") and list(got["metrics"]) == ["a", "b"]
    assert got["metrics"]["a"]["count"] == 2 and got["metrics"]["a"]["avg"] == 2.0 and set(got["metrics"]["b"]) == set(buckets.STAT_COLUMNS)
    assert "next" not in json.loads(responses.stats(*store, reading.request(), NOW).first().body)
    got = json.loads(responses.series(*store, reading.request(names=["a", "x"]), NOW).first().body)
    assert got["bucket"] == "10s" and list(got["series"]) == ["a"] and [p["count"] for p in got["series"]["a"]] == [1, 1]
    states = spark.createDataFrame([("r1", "m", "ok", 1.5, NOW), ("r2", "m", "firing", 2.5, NOW)], alerts.STATE_SCHEMA)
    got = json.loads(responses.alert_states(states, limit=1).first().body)
    assert got["alerts"] == [{"rule": "r1", "metric": "m", "state": "ok", "value": 1.5, "since": "2023-11-14T22:13:20.000Z"}] and got["next"] == "r1" and got["matched"] == 2
    judged = validation.verdicts(decoder.decode_bodies(spark.createDataFrame([("x", '{"name":"a"} {"na')], "body_id string, body string")), NOW)
    bodies = judged.select("body_id").distinct()
    got = responses.batches(judged, bodies, ["body_id"], "index", validation.batch_responses(judged, bodies, ["body_id"])).first()
    body = json.loads(got.body)
    assert got.status == 400 and body["rejected"] == 1 and body["errors"][0]["index"] == 0 and body["fatal"].startswith("event 1")


def test_the_engine_samples_itself(spark, tmp_path):
    df = events(spark, ("a", 1.0, NOW), ("b", 0.0, NOW))
    store = df.select("name"), buckets.fold(df), buckets.sketch(df)
    folder, stop = f"file://{tmp_path}/s", threading.Event()
    stop.set()
    wrote = snapshots.write_every(lambda: store[1:], folder, lambda: NOW - 5000, 60.0, stop)
    fresh = snapshots.freshness(spark, folder, NOW)
    assert wrote == {"snapshot.write_failures": 0.0} and fresh["snapshot.age_seconds"] == 5.0 and fresh["snapshot.bytes"] > 0
    assert snapshots.freshness(spark, f"file://{tmp_path}/none", NOW) == {}
    got = {r.name: r.value for r in telemetry.sample(*store, {"events.accepted": 7.0} | wrote | fresh, NOW).collect()}
    assert got["pulsegrid.store.metrics"] == 2 and got["pulsegrid.store.buckets"] == 2 and got["pulsegrid.store.histogram_buckets"] == 1
    assert got["pulsegrid.events.accepted"] == 7 and got["pulsegrid.snapshot.age_seconds"] == 5 and len(got) == 7


def test_empty_tables(spark):
    none = events(spark).limit(0)
    store = none.select("name"), buckets.fold(none), buckets.sketch(none)
    assert reading.stats(*store, reading.request(), NOW).count() == 0
    assert one(buckets.gauges(*store)) == {"metrics": 0, "buckets": 0, "histogram_buckets": 0}
