"""Raw market events to trade records, or to rejects with their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

#: A trade may be stamped so far ahead of the receiver's clock.
AHEAD = "INTERVAL 30 SECONDS"


def reject_reason(now: Column) -> Column:
    """Null for a valid event. Checked in this order: time, price, amount, side."""
    return F.coalesce(
        F.when(F.col("time_exchange").isNull() | (F.col("time_exchange") > now + F.expr(AHEAD)), F.lit("future_timestamp")),
        V.number_fault(F.col("price"), "price"),
        V.number_fault(F.col("amount"), "amount"),
        F.when(~F.coalesce(F.col("side").isin(*V.SIDES), F.lit(False)), F.lit("unknown_side")),
    )


def normalized(raw: DataFrame, now: Column) -> DataFrame:
    """All events with the record's columns and ``reject_reason``."""
    return raw.select(
        *[c for c in ("session_id", "ingest_seq") if c in raw.columns],
        "exchange",
        V.pair_name(F.col("base"), F.col("quote")).alias("pair"),
        F.col("time_exchange").alias("ts_exchange"),
        F.col("time_received").alias("ts_received"),
        V.exact(F.col("price")).alias("price"),
        V.exact(F.col("amount")).alias("amount"),
        "side",
        F.col("id").alias("trade_id"),
        reject_reason(now).alias("reject_reason"),
    )


def normalize(raw: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Trades, and rejected events with ``reject_reason``. ``now`` is passed in, so that a rerun gives the same."""
    n = normalized(raw, now)
    return n.where("reject_reason IS NULL").drop("reject_reason"), n.where("reject_reason IS NOT NULL")


def partition_date(ts: Column) -> Column:
    """The UTC day of exchange time."""
    return F.to_date(ts)
