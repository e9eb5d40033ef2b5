"""OHLCV candles in arrival order, with lateness per key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import SPAN
from ..functions.values import EXACT, minute_of
from ..sources.workspace import written

KEYS = ["exchange", "pair"]


def _closes(windows: list[int], state: tuple[int | None, list[int]] = (None, [])) -> Iterator[tuple[int | None, list[int]]]:
    """The newest window emitted and the open ones, newest first, after each arrival.

    An arrival emits what is open and older than its own window. A late one, not
    newer than the newest emitted, does nothing.
    """
    emitted, open_ = state[0], list(state[1])
    for w in windows:
        if emitted is None or w > emitted:
            if open_ and open_[-1] < w:
                while open_ and open_[-1] < w:
                    last = open_.pop()  # from the oldest on: the last is the newest
                emitted = last
            if not open_ or open_[-1] != w:
                open_.append(w)
        yield emitted, open_


def _spans(d: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and span of arrivals, what an empty state comes to: ``__e`` emitted, ``__o`` open, ``__x`` newest window."""
    types = [f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys]

    def end(key, rows):
        rows = rows.sort_by("__s")
        windows = rows.column("__w").to_pylist()
        for emitted, open_ in _closes(windows):
            pass
        return pa.Table.from_pydict({**{k: [v.as_py()] for k, v in zip([*keys, "__span"], key)}, "__e": pa.array([emitted], pa.int64()), "__o": pa.array([open_], pa.list_(pa.int64())), "__x": pa.array([max(windows)], pa.int64())})

    return d.groupBy(*keys, "__span").applyInArrow(end, f"{', '.join(types)}, __span long, __e long, __o array<long>, __x long")


def _before(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The state that each span starts from, by folding the few spans of a key in order.

    Windows left open that are older than a span's newest are emitted by it.
    """
    types = [f"`{k}` {spans.schema[k].dataType.simpleString()}" for k in keys]

    def fold(key, rows):
        rows = rows.sort_by("__span")
        emitted, open_, states = None, [], []
        for e, o, x in zip(*(rows.column(c).to_pylist() for c in ("__e", "__o", "__x"))):
            states.append((emitted, open_))
            emitted = max((v for v in (emitted, e, *(u for u in open_ if u < x)) if v is not None), default=None)
            open_ = sorted({u for u in [*open_, *o] if emitted is None or u > emitted}, reverse=True)
        return rows.select([*keys, "__span"]).append_column("__e", pa.array([x for x, _ in states], pa.int64())).append_column("__o", pa.array([x for _, x in states], pa.list_(pa.int64())))

    return spans.groupBy(*keys).applyInArrow(fold, f"{', '.join(types)}, __span long, __e long, __o array<long>")


def flag_late(trades: DataFrame, keys: list[str] = KEYS, seq: str = "ingest_seq", ts: str = "ts_exchange", width: str = "minute", span: int = SPAN) -> DataFrame:
    """Adds ``ts_open`` and ``late``: whether the trade's window was emitted before it came.

    A trade emits all older windows open in its key, so that state is a short
    list and is taken along arrival by arrival. A key's arrivals are cut into
    spans: each is folded from an empty state, the few ends of a key are joined up
    in order, and each span is then gone through from its real start. So a hot key
    is as many tasks as it has spans, no task holds more than one span's arrivals
    and windows, and the work is linear in the rows, whatever their order.

    Only key, arrival and window take part, written to the workspace; the late
    rows, which are few, are joined back.
    """
    whole = trades.withColumn("ts_open", minute_of(F.col(ts), width))
    window = F.unix_micros(F.col("ts_open").cast("timestamp"))
    d = whole.select(*keys, F.col(seq).cast("long").alias("__s"), window.alias("__w"), F.floor(F.col(seq) / span).cast("long").alias("__span"))
    d = written(d.where("__w IS NOT NULL"))
    states = written(_before(_spans(d, keys), keys))
    types = [f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys]

    def flag(key, rows, state):
        rows = rows.sort_by("__s")
        emitted, open_ = state.column("__e")[0].as_py(), state.column("__o")[0].as_py()
        late, before = [], emitted
        for n, (w, (after, _)) in enumerate(zip(windows := rows.column("__w").to_pylist(), _closes(windows, (emitted, open_)))):
            if before is not None and w <= before:
                late.append(n)
            before = after
        return rows.select([*keys, "__s"]).take(pa.array(late, pa.int64()))

    late = d.groupBy(*keys, "__span").cogroup(states.groupBy(*keys, "__span")).applyInArrow(flag, f"{', '.join(types)}, __s long")
    late = late.withColumnRenamed("__s", seq).withColumn("late", F.lit(True))
    return whole.join(late, [*keys, seq], "left").select(*whole.columns, F.coalesce("late", F.lit(False)).alias("late"))


def _fold(seq: str) -> list[Column]:
    return [
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"),
        F.sum("amount").cast(EXACT).alias("volume"), F.count("*").alias("trade_count"),
    ]


def candles(trades: DataFrame, keys: list[str] = KEYS, seq: str = "ingest_seq", ts: str = "ts_exchange", width: str = "minute", late: str = "exclude", span: int = SPAN) -> DataFrame:
    """One row per key and window that has trades; first and last are by arrival.

    ``late``: ``exclude`` gives the candles of a live run, ``include`` those of
    all archived trades. The fold combines before it shuffles.
    """
    if late == "include":
        d = trades.withColumn("ts_open", minute_of(F.col(ts), width))
    else:
        d = flag_late(trades, keys, seq, ts, width, span).where("NOT late")
    return d.groupBy(*keys, "ts_open").agg(*_fold(seq))


def _again(order: str) -> list[Column]:
    return [
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"),
        F.sum("volume").cast(EXACT).alias("volume"), F.sum("trade_count").alias("trade_count"),
    ]


def merge_candles(parts: DataFrame, keys: list[str] = KEYS, order: str = "session_id") -> DataFrame:
    """One candle per key and window from those that several sessions wrote, in session order."""
    return parts.groupBy(*keys, "ts_open").agg(*_again(order))


def rollup(minutes: DataFrame, width: str, keys: list[str] = KEYS) -> DataFrame:
    """Wider candles from minute candles."""
    wide = minutes.select(*keys, F.struct("ts_open").alias("__at"), minute_of(F.col("ts_open"), width).alias("ts_open"), "open", "high", "low", "close", "volume", "trade_count")
    return wide.groupBy(*keys, "ts_open").agg(*_again("__at"))


def ordered(c: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """In emission order."""
    return c.orderBy("ts_open", *keys)


def replayed(trades: DataFrame, keys: list[str] = KEYS, seq: str = "ingest_seq", lag_seconds: int = 5, width: str = "minute") -> DataFrame:
    """``flag_late`` with the clock flush replayed in batch: ticks at whole seconds of ``ts_received``.

    A tick at t emits windows that end ``lag_seconds`` before t and were open. So a
    row is late as well if an earlier row of its window, or of a newer one that a
    tick closed, came at least that long before it. Live tick phases are not
    archived: this is their stand-in, not a reproduction.
    """
    d = flag_late(trades, keys, seq, width=width)
    end = F.unix_timestamp(F.col("ts_open") + F.expr(f"INTERVAL 1 {width.upper()}"))
    tick = F.floor(F.unix_timestamp("ts_received"))
    # The first tick that closes a window: its end and the lag, or the whole second after its first row.
    first = d.groupBy(*keys, "ts_open").agg(F.min(tick).alias("__first"), F.max(end).alias("__end"))
    first = first.withColumn("__closed", F.greatest(F.col("__end") + lag_seconds, F.col("__first") + 1))
    newer = Window.partitionBy(*keys).orderBy(F.desc("ts_open")).rowsBetween(Window.unboundedPreceding, 0)
    first = first.withColumn("__closed", F.min("__closed").over(newer)).select(*keys, "ts_open", "__closed")
    return d.join(first, [*keys, "ts_open"]).withColumn("late", F.col("late") | (tick >= F.col("__closed"))).drop("__closed")
