from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from candlewick.functions import values as V


def one(spark, text):
    r = spark.createDataFrame([(text,)], "x string").select(V.lossless_fault(F.col("x")), V.lossless(F.col("x"))).first()
    return r[0], r[1]


@pytest.mark.parametrize(
    "text, fault",
    [
        ("104500.25", None), ("1", None), ("0.00000001", None), ("-1.5", None), ("1e-18", None), ("1.0000000000000000000", None),
        ("1e-19", "scale"), ("0.0000000000000000010", None), ("0.0000000000000000001", "scale"), ("2e20", "overflow"), ("1.6e20", "overflow"),
        ("79228162514.264337593543950335", None), ("79228162514.264337593543950336", "overflow"), ("792281625142.6433759354395034", "overflow"),
        ("abc", "not_a_number"), ("", "not_a_number"), (".", "not_a_number"), ("0e-30", None), ("1500e-19", None), ("100e-20", None),
    ],
)
def test_lossless(spark, text, fault):
    got, value = one(spark, text)
    assert got == fault
    if fault is None:
        assert value == Decimal(text)
    else:
        assert value is None


@pytest.mark.parametrize(
    "text, value",
    [("5", 5), ("+5", 5), ("18446744073709551615", 2**64 - 1), ("18446744073709551616", None), (" 5", None), ("5 ", None), ("1e3", None), ("5.4", None), ("-1", None), ("", None), ("000000000000000000000000007", 7), ("٣", None)],
)
def test_sequence_id(spark, text, value):
    got = spark.createDataFrame([(text,)], "x string").select(V.sequence_id(F.col("x"))).first()[0]
    assert got == value


def test_number_faults(spark):
    rows = [(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (0.0,), (-0.5,), (1e-8,), (104500.25,), (1e300,), (1e12,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(V.number_fault(F.col("x"), "p")).collect()]
    assert got == ["non_finite:p"] * 4 + ["non_positive:p"] * 2 + [None, None, "overflow:p", "overflow:p"]
    assert spark.createDataFrame([(1e-8,)], "x double").select(V.exact(F.col("x"))).first()[0] == Decimal("0.00000001")


def test_time_buckets(spark):
    r = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:30.123456' AS t").select(V.minute_of(F.col("t")).cast("string"), V.millisecond(F.col("t")).cast("string")).first()
    assert tuple(r) == ("1969-12-31 23:59:00", "1969-12-31 23:59:30.123")


def test_domains_fail(spark):
    d = spark.createDataFrame([("Buy",)], "side string")
    with pytest.raises(Exception, match="unknown value"):
        d.select(V.in_domain(F.col("side"), V.SIDES)).collect()
    assert spark.createDataFrame([("btc", "usdt")], "a string, b string").select(V.pair_name(F.col("a"), F.col("b"))).first()[0] == "BTC-USDT"
