"""Anomalies of per-key trade-id sequences, in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import SPAN, Running, running
from ..functions.values import sequence_id

KEYS = ["exchange", "pair"]


def checked(trades: DataFrame, keys: list[str] = KEYS, seq: str = "ingest_seq", trade_id: str = "trade_id", span: int = SPAN) -> DataFrame:
    """Adds ``check`` (ok, gap, regression, non_sequential, untracked), ``expected``, ``last`` and ``got``.

    An id that is no unsigned 64-bit number degrades its key for good: reported
    once, untracked after. Detection goes on from the id just seen, up or down.
    Put ``session_id`` among the keys where state ends with a session.
    """
    columns = trades.columns
    d = trades.withColumn("__id", sequence_id(F.col(trade_id)))
    bad = F.when(F.col("__id").isNull(), 1).otherwise(0)
    d = running(d, keys, seq, span, __last=Running(F.col("__id"), "last"), __bad=Running(bad, "sum", inclusive=True))
    first_bad = (F.col("__bad") == 1) & F.col("__id").isNull()
    check = (
        F.when((F.col("__bad") > 0) & ~first_bad, "untracked")
        .when(F.col("__id").isNull(), "non_sequential")
        .when(F.col("__last").isNull() | (F.col("__id") == F.col("__last") + 1), "ok")
        .when(F.col("__id") > F.col("__last") + 1, "gap")
        .otherwise("regression")
    )
    d = d.withColumn("check", check)
    return d.select(
        *columns,
        "check",
        F.when(F.col("check") == "gap", F.col("__last") + 1).cast("decimal(20,0)").alias("expected"),
        F.when(F.col("check") == "regression", F.col("__last")).alias("last"),
        F.when(F.col("check").isin("gap", "regression"), F.col("__id")).alias("got"),
    )


def anomalies(trades: DataFrame, keys: list[str] = KEYS, seq: str = "ingest_seq", trade_id: str = "trade_id", span: int = SPAN) -> DataFrame:
    """The rows that become ``gap_detected`` events, with their ``details``."""
    d = checked(trades, keys, seq, trade_id, span).where(F.col("check").isin("gap", "regression", "non_sequential"))
    return d.withColumn("details", gap_details(trade_id))


def gap_details(trade_id: str = "trade_id") -> Column:
    number = lambda c: F.col(c).cast("decimal(20,0)")
    return (
        F.when(F.col("check") == "gap", F.to_json(F.struct(F.lit("gap").alias("kind"), number("expected").alias("expected"), number("got").alias("got"))))
        .when(F.col("check") == "regression", F.to_json(F.struct(F.lit("regression").alias("kind"), number("last").alias("last"), number("got").alias("got"))))
        .when(F.col("check") == "non_sequential", F.to_json(F.struct(F.lit("non_sequential").alias("kind"), F.col(trade_id).alias("trade_id"))))
    )
