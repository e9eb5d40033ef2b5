"""The archive's status: coverage of a day from disk and log, and its text."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage
from ..sources import archive, log

# The report's headings and messages.
TITLE, EMPTY = "archive coverage for {}", "no archive data for {}"
HEADER = ("EXCHANGE", "PAIR", "FILES", "TRADES", "COVERAGE", "QUIET", "GAP", "GAP_EVT", "LATE_EVT", "STATUS")
COLUMNS = ("exchange", "pair", "files", "trade_rows", "coverage", "quiet_minutes", "gap_minutes", "gap_events", "late_events", "status")


def archive_status(spark: SparkSession, root: str, day: date, now: datetime) -> DataFrame:
    """The coverage report of an archive. ``now`` is given, so the same archive gives the same report."""
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    report = coverage.coverage(
        archive.partitions(spark, root, archive.CANDLES, day),
        archive.present_minutes(spark, root, day),
        log.files(spark, root),
        log.events(spark, root),
        log.sessions(spark, root),
        day,
        at,
    )
    return coverage.with_status(report)


def rendered(report: DataFrame, day: date) -> str:
    """Aligned text: names to the left, numbers to the right. One line per pair, so it is collected."""
    rows = [tuple(str(r[c]) for c in COLUMNS) for r in report.orderBy("exchange", "pair").collect()]
    if not rows:
        return EMPTY.format(day.isoformat())
    lines = [HEADER, *rows]
    width = [max(len(x[k]) for x in lines) for k in range(len(HEADER))]
    left = {0, 1, len(HEADER) - 1}
    table = ("  ".join(v.ljust(w) if k in left else v.rjust(w) for k, (v, w) in enumerate(zip(x, width))).rstrip() for x in lines)
    return "\n".join([TITLE.format(day.isoformat()), *table])
