"""SQL for DuckDB that says what the queries of the catalogue say."""

from __future__ import annotations

# Fixed values, as in the catalogue.
NOW, EARLIER, HOUR = 1_706_659_200_000, 1_705_708_800_000, 3600
GAMMA, LOG = "(1.01 / 0.99)", "ln(CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE))"

SVC = "SELECT event_id, 'svc.' || event_type AS name, value, epoch_ms(ts) AS ts FROM events"
USER = "SELECT event_id, 'user.' || CAST(user_id AS VARCHAR) AS name, value, epoch_ms(ts) AS ts FROM events"


def _bucket(width: int = HOUR) -> str:
    return f"CAST((ts - ts % {width * 1000}) // 1000 AS BIGINT)"


def _sketch(events: str, keys: str, where: str = "true") -> str:
    """Common tables: e (events with a bucket), s (sketch rows by ``keys``), q (quantiles by ``keys``)."""
    return f"""
e AS (SELECT * FROM (SELECT *, {_bucket()} AS bucket_start FROM ({events})) WHERE {where}),
x AS (SELECT *, CASE WHEN value >= 1e-9 THEN 1 WHEN value <= -1e-9 THEN -1 ELSE 0 END AS sign,
  CASE WHEN abs(value) >= 1e-9 THEN CAST(ceil(ln(abs(value)) / {LOG}) AS INTEGER) ELSE 0 END AS idx FROM e),
s AS (SELECT {keys}, sign, idx, count(*) AS n FROM x GROUP BY ALL),
o AS (SELECT *, CASE WHEN sign = 0 THEN 0 ELSE sign * (idx + 2000) END AS ord,
  CASE WHEN sign = 0 THEN 0.0 ELSE sign * 2 * pow(CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE), idx) / (CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE) + 1) END AS v FROM s),
c AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY ord) AS cum, sum(n) OVER (PARTITION BY {keys}) AS tot FROM o),
q AS (SELECT {keys}, {", ".join(f"min_by(v, ord) FILTER (cum > least(CAST(trunc(CAST({p} AS DOUBLE) * CAST(tot AS DOUBLE)) AS BIGINT), tot - 1)) AS {a}" for a, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))} FROM c GROUP BY ALL)"""


def _stats(events: str, cut: int, names: str = "true", keys: str = "name", shown: str = "", now: int = NOW) -> str:
    return f"""WITH {_sketch(events, keys, f"bucket_start BETWEEN {cut} AND {(now + HOUR * 1000) // 1000} AND ({names})")},
m AS (SELECT {keys}, count(*) AS count, avg(value) AS avg, min(value) AS min, max(value) AS max FROM e GROUP BY ALL)
SELECT {shown or keys}, CAST(m.count AS BIGINT) AS count, {", ".join(f"round({t}.{a} + 1e-9, 6) AS {a}" for t, a in (("m", "avg"), ("m", "min"), ("m", "max"), ("q", "p50"), ("q", "p90"), ("q", "p99")))}
FROM m JOIN q USING ({keys})"""


def _cut(now: int, seconds: float) -> int:
    return int((now - seconds * 1000) // (HOUR * 1000)) * HOUR


DAY, WEEK, MONTH = 86_400, 7 * 86_400, 31 * 86_400

MIXED = f"""SELECT event_id, event_id // 100 AS body, value,
  CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'pulsegrid.' || name WHEN 2 THEN repeat(name, 60) ELSE name END AS name,
  CASE event_id % 11 WHEN 3 THEN 0 WHEN 4 THEN {NOW + 3_600_001} WHEN 5 THEN {NOW + 3_600_000} ELSE ts END AS ts FROM ({SVC})"""
JUDGED = f"""SELECT *, CASE WHEN strlen(name) = 0 THEN 'name is required'
  WHEN strlen(name) > 256 THEN 'name is ' || strlen(name) || ' bytes, over the 256-byte limit'
  WHEN starts_with(name, 'pulsegrid.') THEN '"pulsegrid." is reserved for the server''s own metrics'
  WHEN ts = 0 THEN 'ts is required (unix milliseconds)'
  WHEN ts < {NOW - WEEK * 1000} THEN 'event too old (ts before now-168h0m0s)'
  WHEN ts > {NOW + 3_600_000} THEN 'ts too far in the future (after now+1h0m0s)' END AS error FROM ({MIXED})"""

FNV = """CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(('0x' || hex(encode(c))) AS BIGINT) FOR c IN string_split(name, '')]),
  lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS BIGINT)"""

#: Rules: name, metric, stat, op, limit, window in ms, wait in ms.
RULES = """(VALUES ('click-average', 'svc.click', 'avg', '>', 50.0, 86400000, 7200000), ('click-count', 'svc.click', 'count', '>=', 60.0, 43200000, 0),
  ('purchase-p90', 'svc.purchase', 'p90', '>', 110.0, 86400000, 3600000), ('view-low', 'svc.view', 'min', '<', 0.5, 86400000, 0),
  ('view-rise', 'svc.view', 'increase', '>', 200.0, 21600000, 10800000), ('nothing', 'svc.none', 'max', '<=', 1.0, 86400000, 0)) AS r(rule, metric, stat, op, lim, win, wait)"""


def _outcomes(ticks: str) -> str:
    """Common tables up to ``oc``: rule, metric, now_ms, wait, value, outcome."""
    joined = f"""SELECT a.rule, a.now_ms, b.value, b.ts FROM a JOIN ({SVC}) b ON b.name = a.metric AND {_bucket()} BETWEEN a.cut AND (a.now_ms + {HOUR * 1000}) // 1000"""
    return f"""a AS (SELECT rule, metric, stat, op, lim, wait, now_ms, ((now_ms - win) - (now_ms - win) % {HOUR * 1000}) // 1000 AS cut FROM {RULES}, ({ticks}) t),
{_sketch(joined, "rule, now_ms").strip()},
m AS (SELECT rule, now_ms, count(*) AS cnt, avg(value) AS av, min(value) AS mn, max(value) AS mx FROM e GROUP BY ALL),
val AS (SELECT a.*, m.cnt, CASE WHEN cnt IS NULL THEN CAST(0 AS DOUBLE) ELSE CASE stat WHEN 'count' THEN CAST(cnt AS DOUBLE) WHEN 'avg' THEN av WHEN 'min' THEN mn WHEN 'max' THEN mx
  WHEN 'p50' THEN p50 WHEN 'p90' THEN p90 WHEN 'p99' THEN p99 ELSE mx - mn END END AS value FROM a LEFT JOIN m USING (rule, now_ms) LEFT JOIN q USING (rule, now_ms)),
oc AS MATERIALIZED (SELECT rule, metric, now_ms, wait, value, CASE WHEN cnt IS NULL THEN 'nodata'
  WHEN CASE op WHEN '>' THEN value > lim WHEN '>=' THEN value >= lim WHEN '<' THEN value < lim ELSE value <= lim END THEN 'firing' ELSE 'ok' END AS outcome FROM val)"""


def _replayed() -> str:
    """Common tables up to ``st``: the states of all ticks, one after the other."""
    ticks = f"SELECT CAST(generate_series AS BIGINT) AS now_ms FROM generate_series({EARLIER}, {NOW}, 3600000)"
    began = "CASE WHEN st.state = 'pending' THEN st.since ELSE oc.now_ms END"
    after = f"CASE WHEN oc.outcome = 'firing' AND st.state <> 'firing' AND oc.now_ms - {began} < oc.wait THEN 'pending' ELSE oc.outcome END"
    return f"""RECURSIVE {_outcomes(ticks)},
st(rule, metric, now_ms, value, prev, state, since) AS (
  SELECT rule, metric, CAST({EARLIER - 3_600_000} AS BIGINT), CAST(0 AS DOUBLE), 'nodata', 'nodata', CAST({EARLIER} AS BIGINT) FROM {RULES}
  UNION ALL
  SELECT st.rule, st.metric, oc.now_ms, oc.value, st.state, {after}, CASE WHEN {after} = st.state THEN st.since ELSE oc.now_ms END
  FROM st JOIN oc ON oc.rule = st.rule AND oc.now_ms = st.now_ms + 3600000)"""


ROUNDED = "CAST(count(*) AS BIGINT) AS count, round(sum(value) + 1e-9, 6) AS sum, round(min(value) + 1e-9, 6) AS min, round(max(value) + 1e-9, 6) AS max"
FOLD = f"SELECT name, {_bucket()} AS bucket_start, {ROUNDED} FROM ({USER}) GROUP BY ALL"
MONTHLY = _cut(NOW, MONTH)

ORACLE_SQL = {
    "bucket_fold": FOLD,
    "sketch_index_counts": f"WITH {_sketch(SVC, 'name, bucket_start')} SELECT name, bucket_start, sign, idx, CAST(n AS BIGINT) AS n FROM s",
    "sketch_negatives_zeros": f"""WITH {_sketch(f"SELECT name, ts, CASE WHEN event_id % 7 = 0 THEN value * 1e-12 ELSE value - 30 END AS value FROM ({USER})", "name")}
SELECT name, round(p50 + 1e-9, 6) AS p50, round(p90 + 1e-9, 6) AS p90, round(p99 + 1e-9, 6) AS p99 FROM q""",
    "sketch_collapse": f"""WITH y AS (SELECT name, {_bucket(86_400)} AS bucket_start, CASE WHEN value >= 1e-9 THEN 1 WHEN value <= -1e-9 THEN -1 ELSE 0 END AS sign,
  CASE WHEN abs(value) >= 1e-9 THEN CAST(ceil(ln(abs(value)) / {LOG}) AS INTEGER) ELSE 0 END AS idx FROM ({SVC})),
g AS (SELECT name, bucket_start, sign, idx, count(*) AS n, row_number() OVER (PARTITION BY name, bucket_start, sign ORDER BY idx DESC) AS r FROM y GROUP BY 1, 2, 3, 4),
k AS (SELECT *, min(idx) FILTER (r <= 16) OVER (PARTITION BY name, bucket_start, sign) AS low FROM g)
SELECT name, bucket_start, sign, greatest(idx, low) AS idx, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1, 2, 3, 4""",
    "stats_window": _stats(SVC, _cut(NOW, DAY)),
    "stats_short_window": _stats(USER, _cut(EARLIER, 90.5 * 3600), f"name IN (SELECT DISTINCT name FROM ({USER}) ORDER BY name LIMIT 1000)", now=EARLIER),
    "stats_by_name": _stats(USER, MONTHLY, "name IN ('user.3', 'user.7', 'user.none')"),
    "stats_by_prefix": _stats(USER, MONTHLY, f"name IN (SELECT DISTINCT name FROM ({USER}) WHERE starts_with(name, 'user.1') ORDER BY name LIMIT 1000)"),
    "stats_page_after": _stats(USER, MONTHLY, f"name IN (SELECT DISTINCT name FROM ({USER}) WHERE name > 'user.12' ORDER BY name LIMIT 40)"),
    "stats_meta": f"""WITH r AS (SELECT DISTINCT name FROM ({USER})), n AS (SELECT name FROM r WHERE name > 'user.12'), p AS (SELECT name FROM n ORDER BY name LIMIT 40)
SELECT CAST((SELECT count(*) FROM n) AS BIGINT) AS matched, (SELECT count(*) FROM n) > (SELECT count(*) FROM p) AS truncated,
  CASE WHEN (SELECT count(*) FROM n) > (SELECT count(*) FROM p) THEN (SELECT max(name) FROM p) END AS next, CAST({NOW // 1000 - MONTHLY} AS BIGINT) AS covers,
  CAST((SELECT count(*) FROM r) AS BIGINT) AS walked, CAST((SELECT count(*) FROM p) AS BIGINT) AS names""",
    "quantiles_user_topk": _stats(USER, MONTHLY, f"name IN (SELECT DISTINCT name FROM ({USER}) ORDER BY name LIMIT 10)"),
    "series_by_name": _stats(SVC, _cut(NOW, WEEK), "name IN ('svc.click', 'svc.purchase', 'svc.view')", "name, bucket_start", "name, bucket_start AS start"),
    "counter_increase": f"SELECT name, round(max(value) - min(value) + 1e-9, 6) AS increase FROM ({USER}) WHERE {_bucket()} >= {_cut(NOW, WEEK)} GROUP BY name",
    "validate_reasons": f"SELECT coalesce(error, 'accepted') AS reason, CAST(count(*) AS BIGINT) AS n FROM ({JUDGED}) GROUP BY 1",
    "batch_summary": f"""SELECT body, CAST(count(*) FILTER (error IS NULL) AS BIGINT) AS accepted, CAST(count(*) FILTER (error IS NOT NULL) AS BIGINT) AS rejected,
  CASE WHEN count(*) FILTER (error IS NULL) > 0 THEN 200 ELSE 400 END AS status FROM ({JUDGED}) GROUP BY body""",
    "batch_first_errors": f"""SELECT body, event_id, error, false AS retryable FROM ({JUDGED}) WHERE error IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY body ORDER BY event_id) <= 10""",
    "shard_assignment": f"SELECT name, {FNV} AS hash, CAST({FNV} % 32 AS INTEGER) AS shard FROM (SELECT DISTINCT name FROM ({USER}))",
    "cap_admission": f"""WITH f AS (SELECT name, min(event_id) AS seq, count(*) AS events FROM ({USER}) GROUP BY 1),
h AS (SELECT *, {FNV} % 32 AS shard, name IN ('user.1', 'user.2', 'user.3') AS known FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY known DESC, seq, name) AS rank FROM h)
SELECT name, CAST(events AS BIGINT) AS events, CAST(CASE WHEN known OR rank <= 3 THEN events ELSE 0 END AS BIGINT) AS accepted FROM r""",
    "client_rate": """WITH f AS (SELECT min(event_id) AS seq, arg_min(event_type, event_id) AS client, epoch_ms(arg_min(ts, event_id)) AS came FROM events GROUP BY user_id)
SELECT client, CAST(came // 86400000 AS BIGINT) AS epoch, seq, row_number() OVER (PARTITION BY client, came // 86400000 ORDER BY seq) <= 4 AS allowed FROM f""",
    "query_cost": "SELECT event_id, CAST(user_id + (event_id + 324) // 325 AS BIGINT) AS units FROM events",
    "query_budget": """SELECT event_type AS client, CAST(epoch_ms(ts) // 86400000 AS BIGINT) AS epoch, event_id AS seq, user_id AS units,
  coalesce(sum(user_id) OVER (PARTITION BY event_type, epoch_ms(ts) // 86400000 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 1000 AS allowed FROM events""",
    "alerts_eval": f"WITH {_outcomes(f'SELECT CAST({NOW} AS BIGINT) AS now_ms')} SELECT rule, metric, round(value + 1e-9, 6) AS value, outcome FROM oc",
    "alerts_replay": f"""WITH {_replayed()} SELECT rule, now_ms, state, since,
  prev <> state AND state <> 'pending' AND NOT (prev = 'pending' AND state IN ('ok', 'nodata')) AS announce FROM st WHERE now_ms >= {EARLIER}""",
    "alerts_filter_page": f"WITH {_replayed()} SELECT rule, metric, state, since FROM st WHERE now_ms = {NOW} AND state = 'ok' AND rule > 'a' ORDER BY rule LIMIT 2",
    "alerts_reload": f"""WITH {_replayed()} SELECT rule, metric, state, since FROM st WHERE now_ms = {NOW} AND rule NOT IN ('nothing', 'view-low')
UNION ALL SELECT * FROM (VALUES ('view-low', 'svc.view', 'nodata', CAST({NOW} AS BIGINT)), ('fresh', 'svc.click', 'nodata', CAST({NOW} AS BIGINT)))""",
    "sweep_effect": f"""WITH b AS (SELECT DISTINCT name, {_bucket()} AS bucket_start FROM ({USER})), l AS (SELECT * FROM b WHERE bucket_start >= {_cut(NOW, WEEK)})
SELECT CAST((SELECT count(DISTINCT name) FROM l) AS BIGINT) AS names, CAST((SELECT count(*) FROM l) AS BIGINT) AS buckets,
  CAST((SELECT count(DISTINCT name) FROM b) AS BIGINT) AS names_before, CAST((SELECT count(*) FROM b) AS BIGINT) AS buckets_before""",
    "size_gauges": f"""WITH {_sketch(USER, "name, bucket_start")} SELECT CAST((SELECT count(DISTINCT name) FROM e) AS BIGINT) AS metrics,
  CAST((SELECT count(*) FROM (SELECT DISTINCT name, bucket_start FROM e)) AS BIGINT) AS buckets, CAST((SELECT count(*) FROM s WHERE sign <> 0) AS BIGINT) AS histogram_buckets""",
    "snapshot_roundtrip": f"SELECT * FROM ({FOLD}) WHERE bucket_start >= {MONTHLY}",
    "stream_equals_batch": f"SELECT * FROM ({FOLD}) WHERE bucket_start >= {MONTHLY}",
    "reading_invariants": "SELECT CAST(0 AS BIGINT) AS stats, CAST(0 AS BIGINT) AS series",
    "exactness": f"SELECT CAST(count(*) AS BIGINT) AS accepted, CAST(count(*) AS BIGINT) AS recorded, true AS exact FROM ({JUDGED}) WHERE error IS NULL",
    "self_counters": f"""SELECT 'events.accepted' AS name, CAST(count(*) FILTER (error IS NULL) AS BIGINT) AS value FROM ({JUDGED})
UNION ALL SELECT 'events.rejected', CAST(count(*) FILTER (error IS NOT NULL) AS BIGINT) FROM ({JUDGED}) UNION ALL SELECT 'events.refused', CAST(0 AS BIGINT)""",
    "decode_batch": f"""WITH b AS (SELECT event_id // 100 AS b, event_id, value, min(CASE WHEN event_id % 1000 = 550 THEN event_id END) OVER (PARTITION BY event_id // 100) AS stop FROM ({SVC}))
SELECT CAST(b AS VARCHAR) AS body_id, CAST(count(*) FILTER (stop IS NULL OR event_id < stop) AS BIGINT) AS events,
  CAST(count(DISTINCT stop) AS BIGINT) AS broken, round(sum(CASE WHEN stop IS NULL OR event_id < stop THEN value ELSE 0 END), 6) AS total FROM b GROUP BY b""",
    "batch_status": f"""WITH e AS (SELECT event_id // 100 AS b, event_id % 100 AS k, ts, event_id % 1000 = 550 AS stop,
  (event_id // 100) % 7 <> 3 AND event_id % 100 < 80 + 10 * ((event_id // 100) % 3) AS there FROM ({SVC})),
f AS (SELECT b, count(*) FILTER (there) AS n, min(k) FILTER (there AND stop) AS broken FROM e GROUP BY b),
c AS (SELECT b, count(*) FILTER (good) AS accepted, count(*) FILTER (NOT good) AS rejected FROM (
  SELECT e.b, e.ts BETWEEN {NOW - WEEK * 1000} AND {NOW + 3_600_000} AS good,
    row_number() OVER (PARTITION BY e.b ORDER BY k) AS r, k, broken FROM e JOIN f USING (b) WHERE there)
  WHERE r <= 90 AND (broken IS NULL OR k < broken) GROUP BY b)
SELECT CAST(f.b AS VARCHAR) AS body_id, CAST(coalesce(accepted, 0) AS BIGINT) AS accepted, CAST(coalesce(rejected, 0) AS BIGINT) AS rejected,
  CASE WHEN n = 0 THEN 'empty' WHEN broken IS NOT NULL THEN 'broken' WHEN n > 90 THEN 'too many' END AS fatal,
  CASE WHEN n = 0 OR broken IS NOT NULL THEN 400 WHEN n > 90 THEN 413 WHEN accepted > 0 THEN 200 ELSE 400 END AS status,
  CAST(NULL AS INTEGER) AS retry_after FROM f LEFT JOIN c USING (b)""",
    "bucket_stream": FOLD,
    "client_table": """WITH f AS (SELECT event_type AS c, min(event_id) AS s FROM events GROUP BY 1), k AS (SELECT c FROM f ORDER BY s, c LIMIT 2)
SELECT CASE WHEN event_type IN (SELECT c FROM k) THEN event_type ELSE 'overflow' END AS client, CAST(count(*) AS BIGINT) AS events FROM events GROUP BY 1""",
    "alerts_page_meta": f"""WITH {_replayed()}, n AS (SELECT rule FROM st WHERE now_ms = {NOW})
SELECT CAST(count(*) AS BIGINT) AS matched, count(*) > 3 AS truncated, CASE WHEN count(*) > 3 THEN (SELECT max(rule) FROM (SELECT rule FROM n ORDER BY rule LIMIT 3)) END AS next FROM n""",
}
