"""Minute coverage of a UTC day: present, quiet or gap."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import connectivity as C

KEYS = ["exchange", "pair"]
MINUTE = "INTERVAL 1 MINUTE"


def minute_spine(spark, day: date, now: Column) -> DataFrame:
    """``minute`` of each window of the day that has ended by ``now``."""
    start, end = C.day_bounds(day)
    one = F.expr(MINUTE)
    r = spark.range(1).select(start.alias("s"), F.least(now.cast("timestamp_ntz"), end).alias("h"))
    # The bounds never cross, even where the filter is what leaves nothing.
    spine = r.select("h", F.explode(F.sequence(F.col("s"), F.greatest(F.col("h") - one, F.col("s")), one)).alias("minute"))
    return spine.where(F.col("minute") + one <= F.col("h")).select("minute")


def overlapped(intervals: DataFrame, *columns: str) -> DataFrame:
    """``columns, minute`` of minutes that an interval overlaps, once each; an interval of a day has 1440 at most."""
    last = F.date_trunc("minute", F.col("dis_end") - F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp_ntz")
    first = F.date_trunc("minute", F.col("dis_start")).cast("timestamp_ntz")
    spans = intervals.where("dis_start < dis_end")
    return spans.select(*columns, F.explode(F.sequence(first, F.greatest(first, last), F.expr(MINUTE))).alias("minute")).distinct()


def key_universe(found: DataFrame, files: DataFrame) -> DataFrame:
    """Keys of partition directories and of the registry."""
    return found.select(*KEYS).unionByName(files.select(*KEYS)).distinct()


def classified(keys: DataFrame, minutes: DataFrame, intervals: DataFrame, tails: DataFrame, day: date, now: Column) -> DataFrame:
    """``exchange, pair, minute, state`` of each elapsed minute: present before gap before quiet.

    ``intervals`` are down times of one exchange, ``tails`` (of sessions without
    an end) of every exchange, so they are joined to the spine by minute alone.
    """
    start, end = C.day_bounds(day)
    spine = minute_spine(keys.sparkSession, day, now).join(overlapped(tails).withColumn("tail", F.lit(True)), "minute", "left")
    there = minutes.where(F.col("ts_open").isNotNull() & (F.col("ts_open") >= start) & (F.col("ts_open") < end))
    there = there.select(*KEYS, F.col("ts_open").alias("minute"), F.lit(True).alias("there")).distinct()
    # The spine has 1440 rows at most.
    d = keys.crossJoin(F.broadcast(spine)).join(there, [*KEYS, "minute"], "left")
    d = d.join(overlapped(intervals, "exchange").withColumn("down", F.lit(True)), ["exchange", "minute"], "left")
    return d.select(*KEYS, "minute", F.when(F.col("there"), "present").when(F.coalesce("down", "tail"), "gap").otherwise("quiet").alias("state"))


def file_totals(files: DataFrame, day: date) -> DataFrame:
    """Files of the day per key, and rows of its trade files; negative counts are passed over."""
    rows = F.sum(F.when((F.col("dataset") == "trades") & (F.col("rows") >= 0), F.col("rows")))
    return files.where(F.col("date") == F.lit(day)).groupBy(*KEYS).agg(F.count("*").alias("files"), F.coalesce(rows, F.lit(0)).alias("trade_rows"))


def event_totals(events: DataFrame, day: date) -> DataFrame:
    """Gap and late events of the day per key; those without a pair belong to none."""
    start, end = C.day_bounds(day)
    on_day = events.where((F.col("ts") >= start) & (F.col("ts") < end) & F.col("kind").isin("gap_detected", "late_trade") & F.col("pair").isNotNull())
    return on_day.groupBy(*KEYS).agg(F.count_if(F.col("kind") == "gap_detected").alias("gap_events"), F.count_if(F.col("kind") == "late_trade").alias("late_events"))


def coverage(partitions: DataFrame, minutes: DataFrame, files: DataFrame, events: DataFrame, sessions: DataFrame, day: date, now: Column) -> DataFrame:
    """The coverage report: ten columns per key, in key order.

    ``partitions``: keys whose directory exists, even if it holds no readable
    file. ``now`` is passed in. Minutes after a running session's last event
    count as its tail.
    """
    on_day = files.where(F.col("date") == F.lit(day))
    keys = key_universe(partitions, on_day)
    states = classified(keys, minutes, C.disconnected_intervals(events, day, keys), C.session_tails(sessions, events, day), day, now)
    counts = states.groupBy(*KEYS).agg(
        F.count("*").alias("expected_minutes"),
        *[F.count_if(F.col("state") == s).alias(f"{s}_minutes") for s in ("present", "quiet", "gap")],
    )
    names = ["files", "trade_rows", "expected_minutes", "present_minutes", "quiet_minutes", "gap_minutes", "gap_events", "late_events"]
    d = keys.join(counts, KEYS, "left").join(file_totals(files, day), KEYS, "left").join(event_totals(events, day), KEYS, "left")
    return d.select(*KEYS, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in names]).orderBy(*KEYS)


def verdict(gap: str = "gap_minutes") -> Column:
    return F.when(F.col(gap) > 0, F.concat(F.lit("GAPS:"), F.col(gap))).otherwise("OK")


def with_status(report: DataFrame) -> DataFrame:
    ratio = F.concat_ws("/", F.col("present_minutes").cast("string"), F.col("expected_minutes").cast("string"))
    return report.withColumn("coverage", ratio).withColumn("status", verdict())
