"""The registered queries: each operator over the ``events`` table read as a trade feed, and its DuckDB text.

``user_id`` picks the exchange, ``event_type`` the pair, ``value`` is the price
and the number in ``props`` the amount. Every tenth event arrives late: it is
numbered behind the next seven or eight. For the operational log, signups connect and errors
disconnect an exchange; every 500 events are one session, a third of which never
ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import candles, clean, connectivity, coverage, sequence
from ..session import utc
from ..sources import archive, feed, log, universe
from ..sources.workspace import folder, written
from ..streaming import ingest, processor
from . import report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DAY = date(2024, 1, 11)
NOW = "2024-01-29 00:00:00"
REPORT_NOW = "2024-01-11 18:30:30"
KEYS = ["exchange", "pair"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(utc(spark), sf_dir)
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the tables have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


# --- the feed -------------------------------------------------------------


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tenth = F.col("event_id") % 10 == 0
    return e.select(
        (2 * (F.col("event_id") + F.when(tenth, 15).otherwise(0)) + F.when(tenth, 1).otherwise(0)).alias("ingest_seq"),
        F.lit(1).cast("long").alias("session_id"),
        F.when(F.col("user_id") % 2 == 0, "binance_spot").otherwise("coinbase").alias("exchange"),
        F.lower("event_type").alias("base"),
        F.lit("usd").alias("quote"),
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("time_exchange"),
        (F.col("ts") + F.expr("INTERVAL 1 SECOND")).cast("timestamp").alias("time_received"),
        F.col("value").alias("price"),
        # A generator, so that filters on the amount do not parse the text anew at each mention.
        F.explode(F.array(F.get_json_object("props", "$.k").cast("double"))).alias("amount"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.lit(None).cast("string").alias("control"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.normalize(raw(spark, sf_dir), at(NOW))[0]


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = (
        F.when(F.col("event_type") == "signup", "connected")
        .when(F.col("event_type") == "error", "disconnected")
        .when(F.col("event_type") == "click", "gap_detected")
        .when(F.col("event_type") == "view", "late_trade")
        .otherwise("error")
    )
    per_pair = F.col("event_type").isin("click", "view") & (F.col("event_id") % 7 != 0)
    return e.select(
        F.col("event_id").alias("id"),
        F.floor(F.col("event_id") / 500).alias("session_id"),
        "ts",
        F.when(F.col("user_id") % 2 == 0, "binance_spot").otherwise("coinbase").alias("exchange"),
        F.when(per_pair, F.concat(F.upper("event_type"), F.lit("-USD"))).alias("pair"),
        kind.alias("kind"),
        F.lit(None).cast("string").alias("details"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 500 events are one session, so they are few."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = e.groupBy(F.floor(F.col("event_id") / 500).alias("id")).agg(F.min("ts").alias("started_at"))
    return s.select("id", "started_at", F.when(F.col("id") % 3 != 0, F.col("started_at") + F.expr("INTERVAL 1 HOUR")).alias("ended_at"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per key and day, as a day's run would close them."""
    t = trades(spark, sf_dir).withColumn("date", F.to_date("ts_exchange"))
    per = t.groupBy(*KEYS, "date").agg(F.count("*").alias("rows"), F.min(V.millisecond(F.col("ts_exchange"))).alias("ts_min"), F.max(V.millisecond(F.col("ts_exchange"))).alias("ts_max"))
    return per.select(F.lit("trades").alias("dataset"), *KEYS, "date", "rows", "ts_min", "ts_max")


# --- DuckDB texts of the same inputs ---------------------------------------

_SEQ = "2 * (event_id + CASE WHEN event_id % 10 = 0 THEN 15 ELSE 0 END) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END"
_EXCHANGE = "CASE WHEN user_id % 2 = 0 THEN 'binance_spot' ELSE 'coinbase' END"
_RAW = f"""raw AS (
  SELECT {_SEQ} AS ingest_seq, {_EXCHANGE} AS exchange, upper(event_type) || '-USD' AS pair, CAST(event_id AS VARCHAR) AS trade_id,
    ts AS ts_exchange, ts + INTERVAL 1 SECOND AS ts_received, value, CAST(regexp_extract(props, ':\\s*(-?[0-9.]+)', 1) AS DOUBLE) AS k,
    CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side
  FROM events),
judged AS (
  SELECT *, CASE WHEN ts_exchange > TIMESTAMP '{NOW}' + INTERVAL 30 SECOND THEN 'future_timestamp'
    WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 'non_finite:price' WHEN value <= 0 THEN 'non_positive:price'
    WHEN k IS NULL OR isnan(k) OR isinf(k) THEN 'non_finite:amount' WHEN k <= 0 THEN 'non_positive:amount' END AS reject_reason
  FROM raw),
trades AS (
  SELECT * EXCLUDE (value, k, reject_reason), CAST(CAST(value AS VARCHAR) AS DECIMAL(38,18)) AS price, CAST(CAST(k AS VARCHAR) AS DECIMAL(38,18)) AS amount
  FROM judged WHERE reject_reason IS NULL)"""
_FOLD = (
    "arg_min(price, ingest_seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, ingest_seq) AS close, "
    "CAST(sum(amount) AS DECIMAL(38,18)) AS volume, count(*) AS trade_count"
)
_EVENTS = f"""ev AS (
  SELECT event_id AS id, event_id // 500 AS session_id, ts, {_EXCHANGE} AS exchange,
    CASE WHEN event_type IN ('click', 'view') AND event_id % 7 != 0 THEN upper(event_type) || '-USD' END AS pair,
    CASE event_type WHEN 'signup' THEN 'connected' WHEN 'error' THEN 'disconnected' WHEN 'click' THEN 'gap_detected' WHEN 'view' THEN 'late_trade' ELSE 'error' END AS kind
  FROM events)"""
_SESSIONS = """st AS (SELECT event_id // 500 AS id, min(ts) AS started_at FROM events GROUP BY ALL),
se AS (SELECT id, started_at, CASE WHEN id % 3 != 0 THEN started_at + INTERVAL 1 HOUR END AS ended_at FROM st)"""
_DAY = f"TIMESTAMP '{DAY} 00:00:00'"
_NEXT = f"TIMESTAMP '{DAY} 00:00:00' + INTERVAL 1 DAY"


def _ohlcv(width: str) -> str:
    return f"WITH {_RAW} SELECT exchange, pair, date_trunc('{width}', ts_exchange) AS ts_open, {_FOLD} FROM trades GROUP BY ALL"


def _late(width: str) -> str:
    """By the definition: an earlier ascent between windows no older than the trade's own."""
    return f"""{_RAW},
w AS (SELECT *, date_trunc('{width}', ts_exchange) AS ts_open FROM trades),
rise AS (
  SELECT b.exchange, b.pair, b.ingest_seq, max(a.ts_open) AS base FROM w b JOIN w a
  ON a.exchange = b.exchange AND a.pair = b.pair AND a.ingest_seq < b.ingest_seq AND a.ts_open < b.ts_open GROUP BY ALL),
flagged AS (
  SELECT w.*, coalesce(max(base) OVER (PARTITION BY w.exchange, w.pair ORDER BY w.ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= w.ts_open, false) AS late
  FROM w LEFT JOIN rise USING (exchange, pair, ingest_seq))"""


# --- conversion -------------------------------------------------------------

_TRADE = "ingest_seq, exchange, pair, ts_exchange, ts_received, price, amount, side, trade_id"


@query(f"WITH {_RAW} SELECT {_TRADE} FROM trades")
def clean_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(trades(spark, sf_dir)).select(*_TRADE.split(", "))


@query(f"WITH {_RAW} SELECT ingest_seq, exchange, pair, trade_id, reject_reason FROM judged WHERE reject_reason IS NOT NULL")
def rejected_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.normalize(raw(spark, sf_dir), at(NOW))[1].select("ingest_seq", "exchange", "pair", "trade_id", "reject_reason")


@query(f"WITH {_RAW} SELECT exchange, pair, count(*) AS events FROM raw GROUP BY ALL")
def pair_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw(spark, sf_dir).select("exchange", V.pair_name(F.col("base"), F.col("quote")).alias("pair"))
    return r.groupBy("exchange", "pair").agg(F.count("*").alias("events"))


@query("SELECT event_id, date_trunc('minute', ts) AS minute, date_trunc('millisecond', ts) AS millisecond, CAST(ts AS DATE) AS date FROM events")
def minute_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return plain(e.select("event_id", V.minute_of(F.col("ts")).alias("minute"), V.millisecond(F.col("ts")).alias("millisecond"), clean.partition_date(F.col("ts")).alias("date")))


@query("""
SELECT event_id, t AS number, CASE WHEN event_id % 4 = 0 THEN 'scale' WHEN event_id % 4 = 1 THEN 'overflow' END AS fault,
  CASE WHEN event_id % 4 > 1 THEN CAST(CAST(value AS VARCHAR) AS DECIMAL(38,18)) END AS exact
FROM (SELECT event_id, value, CASE event_id % 4 WHEN 0 THEN CAST(value AS VARCHAR) || '0000000000000000001' WHEN 1 THEN '99' || CAST(value AS VARCHAR) || 'e10'
  WHEN 2 THEN CAST(value AS VARCHAR) || '0000000000000000000000' ELSE CAST(value AS VARCHAR) END AS t FROM events)""")
def lossless_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal texts that fit, that need too many digits, that are too large, and that end in zeros."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v, k = F.col("value").cast("string"), F.col("event_id") % 4
    text = F.when(k == 0, F.concat(v, F.lit("0000000000000000001"))).when(k == 1, F.concat(F.lit("99"), v, F.lit("e10"))).when(k == 2, F.concat(v, F.lit("0" * 22))).otherwise(v)
    e = e.select("event_id", text.alias("number"))
    return e.select("event_id", "number", V.lossless_fault(F.col("number")).alias("fault"), V.lossless(F.col("number")).alias("exact"))


# --- candles ----------------------------------------------------------------


@query(_ohlcv("minute"))
def ohlcv_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(candles.candles(trades(spark, sf_dir), late="include"))


@query(_ohlcv("hour"))
def ohlcv_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(candles.candles(trades(spark, sf_dir), width="hour", late="include"))


@query(_ohlcv("day"))
def ohlcv_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(candles.candles(trades(spark, sf_dir), width="day", late="include"))


@query(f"WITH {_late('minute')} SELECT exchange, pair, ingest_seq, trade_id, ts_open FROM flagged WHERE late")
def late_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(candles.flag_late(trades(spark, sf_dir)).where("late").select("exchange", "pair", "ingest_seq", "trade_id", "ts_open"))


_NOT_LATE = f"WITH {_late('minute')} SELECT exchange, pair, ts_open, {_FOLD} FROM flagged WHERE NOT late GROUP BY ALL"


@query(_NOT_LATE)
def candles_excluding_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(candles.candles(trades(spark, sf_dir)))


@query(f"""WITH {_late('minute')},
f AS (SELECT exchange, pair, ts_open, greatest(max(epoch(ts_open)) + 65, min(floor(epoch(ts_received))) + 1) AS closed FROM flagged GROUP BY ALL),
c AS (SELECT exchange, pair, ts_open, min(closed) OVER (PARTITION BY exchange, pair ORDER BY ts_open DESC ROWS UNBOUNDED PRECEDING) AS closed FROM f)
SELECT exchange, pair, ingest_seq, ts_open FROM flagged JOIN c USING (exchange, pair, ts_open) WHERE late OR floor(epoch(ts_received)) >= closed""")
def late_by_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late trades if windows are also emitted by whole seconds of arrival, five seconds after they end."""
    return plain(candles.replayed(trades(spark, sf_dir)).where("late").select("exchange", "pair", "ingest_seq", "ts_open"))


@query(_ohlcv("minute"))
def candles_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(candles.ordered(candles.candles(trades(spark, sf_dir), late="include")))


@query(f"WITH {_late('hour')} SELECT exchange, pair, ts_open, {_FOLD} FROM flagged WHERE NOT late GROUP BY ALL")
def hourly_excluding_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(candles.candles(trades(spark, sf_dir), width="hour"))


_AGAIN = (
    "arg_min(open, o) AS open, max(high) AS high, min(low) AS low, arg_max(close, o) AS close, "
    "CAST(sum(volume) AS DECIMAL(38,18)) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count"
)


@query(f"WITH {_late('minute')}, c AS (SELECT exchange, pair, ts_open AS o, {_FOLD} FROM flagged WHERE NOT late GROUP BY ALL) SELECT exchange, pair, date_trunc('hour', o) AS ts_open, {_AGAIN} FROM c GROUP BY ALL")
def rollup_from_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(candles.rollup(candles.candles(trades(spark, sf_dir)), "hour"))


@query(f"WITH {_RAW}, c AS (SELECT exchange, pair, date_trunc('hour', ts_exchange) AS ts_open, ingest_seq // 1000 AS o, {_FOLD} FROM trades GROUP BY ALL) SELECT exchange, pair, ts_open, {_AGAIN} FROM c GROUP BY ALL")
def merged_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles that restarts split, made one again: each 1,000 arrivals are a session."""
    t = trades(spark, sf_dir).withColumn("session_id", F.floor(F.col("ingest_seq") / 1000))
    parts = candles.candles(t, ["session_id", *KEYS], width="hour", late="include")
    return plain(candles.merge_candles(parts))


# --- id sequences -----------------------------------------------------------


def _gaps(keys: str) -> str:
    part = f"PARTITION BY {keys} ORDER BY ingest_seq" if keys else "ORDER BY ingest_seq"
    return f"""{_RAW},
s AS (SELECT *, CAST(trade_id AS DECIMAL(20,0)) AS id, lag(CAST(trade_id AS DECIMAL(20,0))) OVER ({part}) AS last FROM trades),
g AS (
  SELECT ingest_seq, exchange, pair, trade_id, CASE WHEN last IS NULL OR id = last + 1 THEN 'ok' WHEN id > last + 1 THEN 'gap' ELSE 'regression' END AS "check",
    CASE WHEN id > last + 1 THEN CAST(last + 1 AS DECIMAL(20,0)) END AS expected, CASE WHEN id <= last THEN last END AS last, CASE WHEN id != last + 1 THEN id END AS got
  FROM s)"""


_ANOMALY = 'ingest_seq, exchange, pair, trade_id, "check", expected, last, got'


def _anomalies(df: DataFrame) -> DataFrame:
    return df.select("ingest_seq", "exchange", "pair", "trade_id", "check", "expected", "last", "got")


@query(f"WITH {_gaps('')} SELECT {_ANOMALY} FROM g WHERE \"check\" != 'ok'")
def trade_id_gaps_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomalies(sequence.anomalies(trades(spark, sf_dir), ["session_id"]))


@query(f"WITH {_gaps('exchange, pair')} SELECT {_ANOMALY} FROM g WHERE \"check\" != 'ok'")
def trade_id_gaps_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomalies(sequence.anomalies(trades(spark, sf_dir)))


@query(f"WITH {_gaps('exchange, pair')} SELECT exchange, pair, \"check\", count(*) AS events FROM g GROUP BY ALL")
def gap_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.checked(trades(spark, sf_dir)).groupBy("exchange", "pair", "check").agg(F.count("*").alias("events"))


@query(f"""WITH {_gaps('exchange, pair')} SELECT ingest_seq, CASE "check" WHEN 'gap' THEN '{{"kind":"gap","expected":' || expected || ',"got":' || got || '}}'
ELSE '{{"kind":"regression","last":' || last || ',"got":' || got || '}}' END AS details FROM g WHERE "check" != 'ok'""")
def details_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.anomalies(trades(spark, sf_dir)).select("ingest_seq", "details")


# --- the operational log ------------------------------------------------------


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed, with errors of the table as breaks of their exchange."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "error", "reconnecting").alias("control"))
    return raw(spark, sf_dir).drop("control").join(e, "id")


@query(f"""WITH {_RAW}, b AS (SELECT raw.*, event_type = 'error' AS broke FROM raw JOIN events ON trade_id = CAST(event_id AS VARCHAR)),
w AS (SELECT *, lag(broke) OVER (PARTITION BY exchange ORDER BY ingest_seq) AS was FROM b)
SELECT exchange, ingest_seq, CASE WHEN broke THEN 'disconnected' ELSE 'connected' END AS kind FROM w WHERE broke OR was""")
def reconnect_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectivity.reconnects(broken(spark, sf_dir)).select("exchange", "ingest_seq", "kind")


@query(f"WITH {_RAW} SELECT exchange, count(*) AS events, max(ingest_seq) AS last FROM raw GROUP BY ALL")
def merged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds of the exchanges, made one."""
    r = raw(spark, sf_dir)
    whole = feed.merged([r.where(F.col("exchange") == x) for x in ("binance_spot", "coinbase")])
    return whole.groupBy("exchange").agg(F.count("*").alias("events"), F.max("ingest_seq").alias("last"))


@query(f"WITH {_EVENTS} SELECT CAST(1 + id % 2 AS BIGINT) AS session_id, kind, count(*) AS events, count(*) AS ids, id % 2 = 0 AS ended FROM ev GROUP BY ALL")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log in two sessions, of which the first ends; ids are apart."""
    root = _root(spark)
    own = [log.start_session(spark, root, datetime(2024, 1, 1)) for _ in range(2)]
    e = stream_events(spark, sf_dir)
    for k, session in enumerate(own):
        log.record_events(e.where(F.col("id") % 2 == k).withColumn("session_id", F.lit(session).cast("long")), root)
    log.end_session(spark, root, own[0], datetime(2024, 2, 1))
    per = log.events(spark, root).groupBy("session_id", "kind").agg(F.count("*").alias("events"), F.countDistinct("id").alias("ids"))
    ended = log.sessions(spark, root).select(F.col("id").alias("session_id"), F.col("ended_at").isNotNull().alias("ended"))
    return per.join(ended, "session_id")


@query(f"WITH {_EVENTS} SELECT id, session_id, ts, exchange, pair, kind FROM ev WHERE ts >= {_DAY} AND ts < {_NEXT}")
def events_for_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectivity.events_for_date(stream_events(spark, sf_dir), DAY).drop("details")


@query(f"WITH {_EVENTS} SELECT exchange, kind FROM ev WHERE kind IN ('connected', 'disconnected') AND ts < {_DAY} QUALIFY row_number() OVER (PARTITION BY exchange ORDER BY ts DESC, id DESC) = 1")
def latest_connection_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectivity.carry_in(stream_events(spark, sf_dir), connectivity.day_bounds(DAY)[0])


_CARRY = f"carry AS (SELECT exchange, arg_max(kind, (ts, id)) AS kind FROM ev WHERE kind IN ('connected', 'disconnected') AND ts < {_DAY} GROUP BY exchange)"
_DOWN = f"""{_EVENTS}, {_CARRY},
turns AS (
  SELECT exchange, ts, id, kind FROM ev WHERE kind IN ('connected', 'disconnected') AND ts >= {_DAY} AND ts < {_NEXT}
  UNION ALL SELECT exchange, {_DAY}, -1, coalesce(any_value(carry.kind), 'disconnected') FROM (SELECT DISTINCT exchange FROM ev) LEFT JOIN carry USING (exchange) GROUP BY exchange),
changes AS (SELECT * FROM (SELECT *, lag(kind) OVER (PARTITION BY exchange ORDER BY ts, id) AS was FROM turns) WHERE was IS DISTINCT FROM kind),
down AS (
  SELECT exchange, ts AS dis_start, dis_end FROM (SELECT *, coalesce(lead(ts) OVER (PARTITION BY exchange ORDER BY ts, id), {_NEXT}) AS dis_end FROM changes)
  WHERE kind = 'disconnected' AND ts < dis_end)"""


@query(f"WITH {_DOWN} SELECT * FROM down")
def disconnected_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectivity.disconnected_intervals(stream_events(spark, sf_dir), DAY)


_TAILS = f"""{_SESSIONS},
bounds AS (
  SELECT id, started_at, (SELECT max(e.ts) FROM ev e WHERE e.session_id = s.id) AS last_event, (SELECT min(n.started_at) FROM se n WHERE n.id > s.id) AS next_start
  FROM se s WHERE ended_at IS NULL),
tails AS (
  SELECT * FROM (SELECT id, greatest(coalesce(last_event, started_at), {_DAY}) AS dis_start, least(coalesce(next_start, {_NEXT}), {_NEXT}) AS dis_end FROM bounds)
  WHERE dis_start < dis_end)"""


@query(f"WITH {_EVENTS}, {_TAILS} SELECT * FROM tails")
def unended_session_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectivity.session_tails(sessions(spark, sf_dir), stream_events(spark, sf_dir), DAY)


@query(f"WITH {_EVENTS}, {_TAILS} SELECT * FROM bounds")
def next_session_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectivity.session_bounds(sessions(spark, sf_dir), stream_events(spark, sf_dir))


# --- coverage -----------------------------------------------------------------

_SPINE = f"spine AS (SELECT unnest(generate_series({_DAY}, least(TIMESTAMP '{REPORT_NOW}', {_NEXT}) - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS minute)"
_FILES = "fi AS (SELECT 'trades' AS dataset, exchange, pair, CAST(ts_exchange AS DATE) AS date, count(*) AS rows, date_trunc('millisecond', min(ts_exchange)) AS ts_min, date_trunc('millisecond', max(ts_exchange)) AS ts_max FROM trades GROUP BY ALL)"
_STATES = f"""{_late('minute')}, {_DOWN}, {_TAILS}, {_FILES}, {_SPINE},
have AS (SELECT DISTINCT exchange, pair, ts_open FROM flagged WHERE NOT late),
keys AS (SELECT DISTINCT exchange, pair FROM have WHERE ts_open >= {_DAY} AND ts_open < {_NEXT} UNION SELECT exchange, pair FROM fi WHERE date = DATE '{DAY}'),
away AS (SELECT * FROM down UNION ALL SELECT exchange, dis_start, dis_end FROM (SELECT DISTINCT exchange FROM keys), tails),
states AS (
  SELECT exchange, pair, minute, CASE WHEN EXISTS (SELECT 1 FROM have h WHERE h.exchange = k.exchange AND h.pair = k.pair AND h.ts_open = s.minute) THEN 'present'
    WHEN EXISTS (SELECT 1 FROM away a WHERE a.exchange = k.exchange AND a.dis_start < s.minute + INTERVAL 1 MINUTE AND a.dis_end > s.minute) THEN 'gap' ELSE 'quiet' END AS state
  FROM keys k, spine s)"""


def _inputs(spark: SparkSession, sf_dir: str) -> dict:
    c = plain(candles.candles(trades(spark, sf_dir))).select(*KEYS, "ts_open")
    on_day = written(c.where(F.to_date("ts_open") == F.lit(DAY)))  # as the archive would have it
    return {
        "partitions": on_day.select(*KEYS).distinct(), "minutes": on_day, "files": files(spark, sf_dir), "events": stream_events(spark, sf_dir),
        "sessions": sessions(spark, sf_dir), "day": DAY, "now": at(REPORT_NOW),
    }


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _inputs(spark, sf_dir)
    keys = coverage.key_universe(i["partitions"], i["files"].where(F.col("date") == F.lit(DAY)))
    down, tails = connectivity.disconnected_intervals(i["events"], DAY, keys), connectivity.session_tails(i["sessions"], i["events"], DAY)
    return coverage.classified(keys, i["minutes"], down, tails, DAY, i["now"])


@query(f"WITH {_SPINE} SELECT * FROM spine")
def minute_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.minute_spine(spark, DAY, at(REPORT_NOW))


@query(f"WITH {_STATES} SELECT exchange, pair, minute FROM states WHERE state != 'present'")
def missing_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).where("state != 'present'").drop("state")


@query(f"WITH {_STATES} SELECT exchange, pair, minute FROM states WHERE state = 'gap'")
def gap_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).where("state = 'gap'").drop("state")


@query(f"""WITH {_STATES},
n AS (SELECT exchange, pair, count(*) AS expected_minutes, count(*) FILTER (state = 'present') AS present_minutes, count(*) FILTER (state = 'quiet') AS quiet_minutes, count(*) FILTER (state = 'gap') AS gap_minutes FROM states GROUP BY ALL),
f AS (SELECT exchange, pair, count(*) AS files, CAST(sum(rows) AS BIGINT) AS trade_rows FROM fi WHERE date = DATE '{DAY}' GROUP BY ALL),
e AS (SELECT exchange, pair, count(*) FILTER (kind = 'gap_detected') AS gap_events, count(*) FILTER (kind = 'late_trade') AS late_events FROM ev WHERE ts >= {_DAY} AND ts < {_NEXT} AND pair IS NOT NULL GROUP BY ALL)
SELECT exchange, pair, coalesce(files, 0) AS files, coalesce(trade_rows, 0) AS trade_rows, expected_minutes, present_minutes, quiet_minutes, gap_minutes,
  coalesce(gap_events, 0) AS gap_events, coalesce(late_events, 0) AS late_events, present_minutes || '/' || expected_minutes AS coverage,
  CASE WHEN gap_minutes > 0 THEN 'GAPS:' || gap_minutes ELSE 'OK' END AS status
FROM n LEFT JOIN f USING (exchange, pair) LEFT JOIN e USING (exchange, pair)""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.with_status(coverage.coverage(**_inputs(spark, sf_dir)))


@query(ORACLE_SQL["coverage_report"].replace("coalesce(files, 0) AS files, ", "CAST(coalesce(files, 0) > 0 AS BIGINT) AS has_files, "))
def archived_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage report read back from directories, candle files and log of a written archive."""
    root = _root(spark)
    t = trades(spark, sf_dir)
    archive.write(t, root, archive.TRADES)
    archive.write(candles.candles(t), root, archive.CANDLES)
    sessions(spark, sf_dir).where("ended_at IS NOT NULL").select("id", "ended_at").write.parquet(f"{root}/_log/session_ends")
    sessions(spark, sf_dir).select("id", "started_at", F.lit("").alias("config")).write.parquet(f"{root}/_log/sessions")
    stream_events(spark, sf_dir).write.parquet(f"{root}/_log/events")
    log.record_files(archive.registry(spark, root, archive.TRADES), root, 1)
    r = report.archive_status(spark, root, DAY, datetime.fromisoformat(REPORT_NOW))
    return r.withColumn("files", (F.col("files") > 0).cast("long")).withColumnRenamed("files", "has_files")


@query(f"WITH {_RAW}, {_FILES} SELECT dataset, exchange, pair, date, rows, ts_min, ts_max FROM fi WHERE date = DATE '{DAY}'")
def files_for_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the day as the log has them, summed per partition."""
    root = _root(spark)
    archive.write(trades(spark, sf_dir), root, archive.TRADES)
    log.record_files(archive.registry(spark, root, archive.TRADES), root, 1)
    log.record_files(archive.registry(spark, root, archive.TRADES), root, 1)  # known files are not registered again
    f = log.files(spark, root, DAY)
    return plain(f.groupBy("dataset", *archive.PARTITIONS).agg(F.sum("rows").alias("rows"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max")))


@query(f"WITH {_RAW} SELECT exchange, pair, count(*) AS rows, CAST(1 AS BIGINT) AS quarantined FROM trades GROUP BY ALL")
def quarantined_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive with one broken file, which is set aside before it is read."""
    root = _root(spark)
    archive.write(trades(spark, sf_dir), root, archive.TRADES)
    archive.put(spark, f"{root}/trades/exchange=x/pair=A-B/date={DAY}/part-0.parquet", b"broken")
    moved = archive.quarantine(spark, root)
    return archive.scan(spark, root, archive.TRADES).groupBy(*KEYS).agg(F.count("*").alias("rows"), F.lit(len(moved)).cast("long").alias("quarantined"))


@query(f"WITH {_RAW}, {_FILES} SELECT exchange, pair, count(*) AS files, CAST(sum(rows) AS BIGINT) AS trade_rows FROM fi GROUP BY ALL")
def trade_rows_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("files"), F.sum("rows").alias("trade_rows"))


@query(f"WITH {_RAW} SELECT DISTINCT exchange, pair FROM raw UNION SELECT * FROM (VALUES {', '.join(f'({a!r}, {b.upper() + chr(45) + c.upper()!r})' for a, b, c in universe.PAIRS)})")
def pair_universe_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = raw(spark, sf_dir).select("exchange", V.pair_name(F.col("base"), F.col("quote")).alias("pair"))
    return coverage.key_universe(universe.universe(spark), seen)


@query(f"SELECT '{universe.config_json()}' AS config")
def subscription_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.config_column(universe.universe(spark))


@query(f"SELECT * FROM (VALUES {', '.join(str((a, b, c, b.upper() + '-' + c.upper())) for a, b, c in universe.PAIRS if a == 'coinbase')}) AS t(exchange, base, quote, pair)")
def exchange_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.subscriptions(spark, "coinbase")


@query(f"WITH {_EVENTS}, {_RAW} SELECT 'kind' AS domain, kind AS value, count(*) AS events FROM ev GROUP BY ALL UNION ALL SELECT 'side', side, count(*) FROM raw GROUP BY ALL")
def checked_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event kinds and sides, each held against its domain."""
    kinds = stream_events(spark, sf_dir).select(F.lit("kind").alias("domain"), V.in_domain(F.col("kind"), V.EVENT_KINDS).alias("value"))
    sides = raw(spark, sf_dir).select(F.lit("side").alias("domain"), V.in_domain(F.col("side"), V.SIDES).alias("value"))
    return kinds.unionByName(sides).groupBy("domain", "value").agg(F.count("*").alias("events"))


# --- archive and stream ---------------------------------------------------------


def _root(spark: SparkSession) -> str:
    return f"{folder(spark)}/candlewick-{uuid.uuid4().hex}"


@query(f"WITH {_RAW} SELECT exchange, pair, CAST(ts_exchange AS DATE) AS date, count(*) AS rows, date_trunc('millisecond', min(ts_exchange)) AS ts_min, date_trunc('millisecond', max(ts_exchange)) AS ts_max FROM trades GROUP BY ALL")
def archive_file_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades written to an archive; the registry read off its files, summed per partition."""
    root = _root(spark)
    archive.write(trades(spark, sf_dir), root, archive.TRADES)
    r = archive.registry(spark, root, archive.TRADES)
    return plain(r.groupBy(*archive.PARTITIONS).agg(F.sum("rows").alias("rows"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max")))


@query(f"WITH {_RAW} SELECT exchange, pair, CAST(ts_exchange AS DATE) AS date, date_trunc('millisecond', ts_exchange) AS ts_exchange, date_trunc('millisecond', ts_received) AS ts_received, price, amount, side, trade_id FROM trades")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _root(spark)
    archive.write(trades(spark, sf_dir), root, archive.TRADES)
    return plain(archive.scan(spark, root, archive.TRADES))


@query(_NOT_LATE)
def streaming_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed replayed through the stateful stream, with what is open at its end."""
    root = _root(spark)
    trades(spark, sf_dir).write.parquet(f"{root}/feed")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/feed").schema).parquet(f"{root}/feed")
    q = (
        processor.processed(stream)
        .where("kind = 'candle'")
        .writeStream.format("parquet")
        .option("path", f"{root}/candles")
        .option("checkpointLocation", f"{root}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    left = processor.remaining(spark, f"{root}/checkpoint")
    columns = [*KEYS, "ts_open", "open", "high", "low", "close", "volume", "trade_count"]
    return plain(spark.read.parquet(f"{root}/candles").select(*columns).unionByName(left.select(*columns)))


_EVER = "2100-01-01 00:00:00"


@query(f"""WITH {_gaps('exchange, pair').replace(NOW, _EVER)},
{_late('minute').replace(_RAW + ',', '', 1)}
SELECT exchange, pair, 'error' AS kind, count(*) AS events FROM judged WHERE reject_reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT exchange, pair, 'late_trade', count(*) FROM flagged WHERE late GROUP BY ALL
UNION ALL SELECT exchange, pair, 'gap_detected', count(*) FROM g WHERE "check" != 'ok' GROUP BY ALL
UNION ALL SELECT DISTINCT exchange, NULL, 'disconnected', 1 FROM raw""")
def ingested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of the ingest over the feed logs, by kind."""
    root = _root(spark)
    raw(spark, sf_dir).select(*feed.names()).write.parquet(f"{root}/raw")
    own = log.start_session(spark, root, datetime(2024, 1, 1))
    run = ingest.Ingest(spark, feed.stream(spark, f"{root}/raw").withColumn("session_id", F.lit(own).cast("long")), root, own, f"{root}/_checkpoints")
    for q in run.start(once=True):
        q.awaitTermination()
    run.finish(["binance_spot", "coinbase"])
    return log.events(spark, root).groupBy("exchange", "pair", "kind").agg(F.count("*").alias("events"))
