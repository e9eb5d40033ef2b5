from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from models import checks, down, late_flags
from pyspark.sql import functions as F

from candlewick.operators import candles, clean, connectivity, coverage, sequence

T0 = datetime(2026, 6, 12, 10)
TRADE = "exchange string, pair string, ingest_seq long, ts_exchange timestamp_ntz, price decimal(38,18), amount decimal(38,18), trade_id string"


def trades(spark, rows):
    """rows: (pair, seconds, price, amount), in arrival order."""
    return spark.createDataFrame([("x", p, i, T0 + timedelta(seconds=s), Decimal(str(pr)), Decimal(str(a)), str(i)) for i, (p, s, pr, a) in enumerate(rows)], TRADE)


def folded(spark, rows, **kw):
    c = candles.candles(trades(spark, rows), **kw)
    return {(r["pair"], int((r["ts_open"].replace(tzinfo=None) - T0).total_seconds())): (float(r["open"]), float(r["high"]), float(r["low"]), float(r["close"]), float(r["volume"]), r["trade_count"]) for r in c.withColumn("ts_open", F.col("ts_open").cast("timestamp_ntz")).collect()}


def test_ohlcv(spark):
    assert folded(spark, [("p", 1, 100, 1), ("p", 20, 105, 2), ("p", 40, 95, 3), ("p", 59, 102, 4)]) == {("p", 0): (100, 105, 95, 102, 10, 4)}


def test_open_and_close_follow_arrival(spark):
    assert folded(spark, [("p", 30, 100, 1), ("p", 10, 110, 2)]) == {("p", 0): (100, 110, 100, 110, 3, 2)}


def test_late_trade_is_left_out(spark):
    rows = [("p", 30, 100, 1), ("p", 70, 101, 2), ("p", 55, 999, 9)]
    assert folded(spark, rows) == {("p", 0): (100, 100, 100, 100, 1, 1), ("p", 60): (101, 101, 101, 101, 2, 1)}
    assert folded(spark, rows, late="include")[("p", 0)] == (100, 999, 100, 999, 10, 2)


def test_older_window_before_any_emission_is_not_late(spark):
    rows = [("p", 330, 1, 1), ("p", 10, 2, 1)]
    assert set(folded(spark, rows)) == {("p", 300), ("p", 0)}
    rows += [("p", 361, 3, 1), ("p", 50, 4, 1), ("p", 350, 5, 1)]
    assert [r["late"] for r in candles.flag_late(trades(spark, rows)).orderBy("ingest_seq").collect()] == [False, False, False, True, True]


def test_lateness_is_per_key_and_boundaries_open_windows(spark):
    rows = [("a", 30, 1, 1), ("b", 30, 1, 1), ("a", 90, 1, 1), ("b", 31, 1, 1), ("a", 59.999, 1, 1), ("b", 60, 1, 1)]
    got = [r["late"] for r in candles.flag_late(trades(spark, rows)).orderBy("ingest_seq").collect()]
    assert got == [False, False, False, False, True, False]
    assert ("b", 60) in folded(spark, rows)


@pytest.mark.parametrize("span", [3, 1 << 18])
def test_lateness_against_model(spark, span):
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(60):
        n, wide = rng.randint(1, 25), rng.randint(1, 8)
        w = [rng.randint(0, wide) + (i // 6 if rng.random() < 0.5 else 0) for i in range(n)]
        for i, x in enumerate(late_flags(w)):
            want[(f"p{k}", i)] = x
        rows += [("x", f"p{k}", i, T0 + timedelta(minutes=v), Decimal(1), Decimal(1), str(i)) for i, v in enumerate(w)]
    got = {(r["pair"], r["ingest_seq"]): r["late"] for r in candles.flag_late(spark.createDataFrame(rows, TRADE), span=span).collect()}
    assert got == want


def test_rollup_and_merge(spark):
    rows = [("p", 60 * m + s, 100 + m - s, 1) for m in range(5) for s in (1, 2)]
    minutes = candles.candles(trades(spark, rows))
    whole = candles.candles(trades(spark, rows), width="hour", late="include")
    assert candles.rollup(minutes, "hour").collect() == whole.select(*candles.rollup(minutes, "hour").columns).collect()
    parts = trades(spark, rows).withColumn("session_id", (F.col("ingest_seq") / 4).cast("int"))
    merged = candles.merge_candles(candles.candles(parts, ["session_id", "exchange", "pair"], late="include"))
    keep = ["pair", "ts_open", "open", "high", "low", "close", "volume", "trade_count"]
    assert sorted(map(tuple, merged.select(keep).collect())) == sorted(map(tuple, minutes.select(keep).collect()))


def test_clock_flush_replay(spark):
    t = trades(spark, [("p", 90, 1, 1), ("p", 30, 1, 1), ("p", 10, 1, 1)]).withColumn("ts_received", F.expr("timestamp_ntz'2026-06-12 10:01:00' + make_interval(0,0,0,0,0,0, ingest_seq * 10)"))
    assert [r["late"] for r in candles.replayed(t).orderBy("ingest_seq").collect()] == [False, False, True]


IDS = [["5", "6", "7"], ["5", "8", "9"], ["10", "3", "4"], ["7", "7", "8"], ["5", "abc-123", "6", "xyz", "1"], ["abc", "1"], ["18446744073709551615", "18446744073709551615", "0", "1"], [" 5 ", "6"], ["+5", "6"], ["1e3", "5"]]


@pytest.mark.parametrize("span", [2, 1 << 18])
def test_sequences_against_model(spark, span):
    rng = random.Random(3)
    runs = IDS + [[rng.choice(["1", "2", "3", "4", "9", "x", "18446744073709551615", "18446744073709551616"]) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = [("x", f"p{k}", i, T0, Decimal(1), Decimal(1), v) for k, ids in enumerate(runs) for i, v in enumerate(ids)]
    got = {(r["pair"], r["ingest_seq"]): r["check"] for r in sequence.checked(spark.createDataFrame(rows, TRADE), span=span).collect()}
    assert got == {(f"p{k}", i): c for k, ids in enumerate(runs) for i, c in enumerate(checks(ids))}


def test_sequence_details(spark):
    rows = [("x", "p", i, T0, Decimal(1), Decimal(1), v) for i, v in enumerate(["1", "5", "3", "z", "4"])]
    got = [r["details"] for r in sequence.anomalies(spark.createDataFrame(rows, TRADE)).orderBy("ingest_seq").collect()]
    assert got == ['{"kind":"gap","expected":2,"got":5}', '{"kind":"regression","last":5,"got":3}', '{"kind":"non_sequential","trade_id":"z"}']


RAW = "ingest_seq long, exchange string, base string, quote string, id string, time_exchange timestamp_ntz, time_received timestamp_ntz, price double, amount double, side string"


def test_conversion(spark):
    now = T0
    ok = dict(exchange="binance_spot", base="btc", quote="usdt", id="987654", time_exchange=T0, time_received=T0, price=104500.25, amount=0.015, side="sell")
    cases = [
        ({}, None), ({"amount": 1e-8}, None), ({"price": float("nan")}, "non_finite:price"), ({"price": float("inf")}, "non_finite:price"), ({"amount": float("-inf")}, "non_finite:amount"),
        ({"amount": 0.0}, "non_positive:amount"), ({"price": -0.5}, "non_positive:price"), ({"time_exchange": T0 + timedelta(seconds=30)}, None),
        ({"time_exchange": T0 + timedelta(seconds=30, milliseconds=1), "price": -1.0}, "future_timestamp"), ({"price": -1.0, "amount": 0.0}, "non_positive:price"), ({"side": "Sell"}, "unknown_side"), ({"side": None}, "unknown_side"),
    ]
    names = [c.split()[0] for c in RAW.split(", ")]
    rows = [tuple({**ok, **change, "ingest_seq": i}[n] for n in names) for i, (change, _) in enumerate(cases)]
    raw = spark.createDataFrame(rows, RAW)
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    got = [r["reject_reason"] for r in clean.normalized(raw, at).orderBy("ingest_seq").collect()]
    assert got == [c[1] for c in cases]
    good, bad = clean.normalize(raw, at)
    first = good.orderBy("ingest_seq").first()
    assert (first["pair"], first["price"], first["amount"], first["trade_id"]) == ("BTC-USDT", Decimal("104500.25"), Decimal("0.015"), "987654")
    assert good.count() + bad.count() == len(cases)


DAY = date(2026, 6, 10)
D0 = datetime(2026, 6, 10)
EVENT = "id long, session_id long, ts timestamp_ntz, exchange string, pair string, kind string, details string"


def events(spark, rows):
    """rows: (hours into the day, exchange, pair, kind[, session])."""
    return spark.createDataFrame([(i, r[4] if len(r) > 4 else 1, D0 + timedelta(hours=r[0]), r[1], r[2], r[3], None) for i, r in enumerate(rows)], EVENT)


def hours(df, *cols):
    return sorted(tuple((r[c] - D0).total_seconds() / 3600 for c in cols) for r in df.collect())


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(-1, "connected")], []),
        ([(-1, "connected"), (2, "disconnected"), (3, "connected"), (22, "disconnected")], [(2, 3), (22, 24)]),
        ([(-1, "disconnected"), (1, "connected"), (2, "connected"), (3, "disconnected"), (4, "disconnected")], [(0, 1), (3, 24)]),
        ([(-1, "disconnected"), (0, "connected")], []),
        ([(25, "connected")], [(0, 24)]),
    ],
)
def test_intervals(spark, rows, want):
    e = events(spark, [(h, "x", None, k) for h, k in rows])
    names = spark.createDataFrame([("x",)], "exchange string")
    assert hours(connectivity.disconnected_intervals(e, DAY, names), "dis_start", "dis_end") == want


def test_intervals_against_model(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(80):
        x = f"x{k}"
        carry = rng.choice([None, "connected", "disconnected"])
        if carry:
            rows.append((-rng.randint(1, 5), x, None, carry))
        turns = sorted((rng.randint(0, 23), rng.choice(["connected", "disconnected"])) for _ in range(rng.randint(0, 8)))
        turns = [(h, s) for i, (h, s) in enumerate(turns) if i == 0 or turns[i - 1][0] != h]
        rows += [(h, x, None, s) for h, s in turns]
        want[x] = down(carry == "connected", turns, 24)
    names = spark.createDataFrame([(x,) for x in want], "exchange string")
    got = {x: [] for x in want}
    for r in connectivity.disconnected_intervals(events(spark, rows), DAY, names).orderBy("exchange", "dis_start").collect():
        got[r["exchange"]].append(tuple((r[c] - D0).total_seconds() / 3600 for c in ("dis_start", "dis_end")))
    assert got == want


def test_carry_in_and_day(spark):
    rows = [(-16, "binance", None, "connected"), (-15, "binance", None, "disconnected"), (-14.5, "coinbase", None, "connected"), (-1, "binance", "P", "gap_detected"), (-1, None, None, "connected"), (0, "coinbase", None, "disconnected")]
    e = events(spark, rows)
    got = {r["exchange"]: r["kind"] for r in connectivity.carry_in(e, connectivity.day_bounds(DAY)[0]).collect()}
    assert got == {"binance": "disconnected", "coinbase": "connected"}
    assert [r["id"] for r in connectivity.events_for_date(e, DAY).collect()] == [5]
    with pytest.raises(connectivity.DateOutOfRange):
        connectivity.day_bounds(date.max)


SESSION = "id long, started_at timestamp_ntz, ended_at timestamp_ntz"


def test_session_bounds_and_tails(spark):
    at = lambda h: D0 + timedelta(hours=h)
    s = spark.createDataFrame([(1, at(-30), at(-29)), (2, at(-10), None), (3, at(5), None), (4, at(8), at(9))], SESSION)
    e = events(spark, [(-1, "x", None, "error", 2), (-3, "x", None, "error", 2)])
    got = {r["id"]: (r["last_event"], r["next_start"]) for r in connectivity.session_bounds(s, e).collect()}
    assert got == {2: (at(-1), at(5)), 3: (None, at(8))}
    assert hours(connectivity.session_tails(s, e, DAY), "dis_start", "dis_end") == [(0, 5), (5, 8)]
    assert connectivity.session_tails(s, e, date(2026, 7, 1)).count() == 0


def report(spark, minutes, rows=(), files=(), sessions=(), now="2026-07-01 00:00:00", partitions=(("x", "p"),)):
    m = spark.createDataFrame([("x", "p", D0 + timedelta(minutes=k) if k is not None else None) for k in minutes], "exchange string, pair string, ts_open timestamp_ntz")
    f = spark.createDataFrame(list(files), "dataset string, exchange string, pair string, date date, rows long")
    return coverage.with_status(
        coverage.coverage(spark.createDataFrame(list(partitions), "exchange string, pair string"), m, f, events(spark, rows), spark.createDataFrame(list(sessions), SESSION), DAY, F.lit(now).cast("timestamp_ntz"))
    ).collect()


UP = (-1, "x", None, "connected")


def counts(r):
    return r["expected_minutes"], r["present_minutes"], r["quiet_minutes"], r["gap_minutes"]


def test_coverage(spark):
    (r,) = report(spark, range(1440), [UP])
    assert counts(r) == (1440, 1440, 0, 0) and r["status"] == "OK" and r["coverage"] == "1440/1440"
    cut = [UP, (10, "x", None, "disconnected"), (10 + 5 / 60, "x", None, "connected")]
    (r,) = report(spark, [k for k in range(1440) if k not in (600, 720)], cut)
    assert counts(r) == (1440, 1438, 1, 1)
    (r,) = report(spark, [k for k in range(1440) if k not in (599, 600, 604, 605)], cut)
    assert counts(r) == (1440, 1436, 2, 2) and r["status"] == "GAPS:2"


@pytest.mark.parametrize("now, expected", [("2026-06-10 10:30:30", 630), ("2026-06-10 10:30:00", 630), ("2026-06-09 10:00:00", 0), ("2026-06-10 00:00:30", 0)])
def test_coverage_of_part_of_a_day(spark, now, expected):
    (r,) = report(spark, [*range(0, 631), -5, 2000], [UP], now=now)
    assert counts(r) == (expected, expected, 0, 0)


def test_coverage_joins_events_files_and_tails(spark):
    rows = [UP, (6, "x", "p", "gap_detected"), (6, "x", "p", "gap_detected"), (6, "x", None, "gap_detected"), (6, "x", "p", "late_trade"), (30, "x", "p", "late_trade")]
    files = [("trades", "x", "p", DAY, 5000), ("trades", "x", "p", DAY, -3), ("candles", "x", "p", DAY, 99), ("trades", "x", "q", date(2026, 6, 9), 7)]
    (r,) = report(spark, range(1440), rows, files)
    assert (r["files"], r["trade_rows"], r["gap_events"], r["late_events"]) == (3, 5000, 2, 1)
    (r,) = report(spark, [], [], [("trades", "x", "p", DAY, 123)], partitions=())
    assert counts(r) == (1440, 0, 0, 1440) and (r["files"], r["trade_rows"]) == (1, 123)
    (r,) = report(spark, range(360), [UP, (6, "x", None, "error")], sessions=[(1, D0 - timedelta(hours=2), None)])
    assert counts(r) == (1440, 360, 0, 1080)
    (r,) = report(spark, [None, 3, 3], [UP])
    assert counts(r) == (1440, 1, 1439, 0)
    assert report(spark, [], partitions=()) == []


def test_reconnects(spark):
    rows = [(0, "b", None), (1, "b", "reconnecting"), (2, "c", None), (3, "b", None), (4, "b", None)]
    feed = spark.createDataFrame(rows, "ingest_seq long, exchange string, control string")
    got = [(r["ingest_seq"], r["exchange"], r["kind"]) for r in connectivity.reconnects(feed).orderBy("ingest_seq").collect()]
    assert got == [(1, "b", "disconnected"), (3, "b", "connected")]
