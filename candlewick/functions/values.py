"""Exact values: checks that reject where Spark's casts would round or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,18)"
#: Largest magnitude that an archive record may hold: 2**96 - 1 at scale 18.
LARGEST = "79228162514.264337593543950335"
_U64 = "18446744073709551615"


def not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def exact(x: Column) -> Column:
    """A double as an exact decimal; null if it is not finite or too large."""
    return F.when(~not_finite(x), x.try_cast(EXACT))


def number_fault(x: Column, name: str) -> Column:
    """Why a double is no positive exact number, else null. A null number counts as not finite.

    Decimals are looked at only near the bounds, where doubles cannot tell.
    """
    d = exact(x)
    over = d.isNull() | (F.abs(d) > F.lit(LARGEST).cast(EXACT))
    return (
        F.when(x.isNull() | not_finite(x), F.lit(f"non_finite:{name}"))
        .when((F.abs(x) > float(LARGEST) * 0.999) & over, F.lit(f"overflow:{name}"))
        .when((x <= 0) | ((x < 1e-15) & (d <= 0)), F.lit(f"non_positive:{name}"))
    )


def fractional_digits(text: Column) -> Column:
    """Digits after the point that a decimal text needs once trailing zeros go; null if it is no number."""
    number = r"^\s*[+-]?([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{1,4}))?\s*$"
    part = lambda k: F.regexp_extract(text, number, k)
    digits = F.concat(part(1), part(2))
    significant = F.length(F.rtrim(digits, F.lit("0")))
    exponent = F.coalesce(part(3).try_cast("int"), F.lit(0))
    scale = F.length(part(2)) - exponent - (F.length(digits) - significant)
    return F.when(text.rlike(number) & (F.length(digits) > 0), F.when(significant == 0, 0).otherwise(F.greatest(scale, F.lit(0))))


def lossless_fault(text: Column) -> Column:
    """Why a decimal text cannot be stored without loss, else null."""
    digits = fractional_digits(text)
    d = text.try_cast("decimal(38,18)")
    return (
        F.when(digits.isNull(), F.lit("not_a_number"))
        .when(digits > 18, F.lit("scale"))
        .when(d.isNull() | (F.abs(d) > F.lit(LARGEST).cast(EXACT)), F.lit("overflow"))
    )


def lossless(text: Column) -> Column:
    """The decimal of a text; null where ``lossless_fault`` has a reason."""
    return F.when(lossless_fault(text).isNull(), text.try_cast(EXACT))


def stored(value: Column, name: str) -> Column:
    """``value`` (exact decimal), or the query's failure if an archive record cannot hold it."""
    fits = F.abs(value) <= F.lit(LARGEST).cast(EXACT)
    return F.when(fits | value.isNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} overflows: "), value.cast("string"))).cast(EXACT))


def sequence_id(text: Column) -> Column:
    """An unsigned 64-bit id in decimal(20,0); null unless the text is digits alone, with a plus at most."""
    d = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("decimal(38,0)"))
    return F.when(d <= F.lit(_U64).cast("decimal(20,0)"), d.cast("decimal(20,0)"))


def pair_name(base: Column, quote: Column) -> Column:
    return F.upper(F.concat_ws("-", base, quote))


def minute_of(ts: Column, width: str = "minute") -> Column:
    """Start of the bucket of a timestamp; right before 1970 as well."""
    return F.date_trunc(width, ts)


def millisecond(ts: Column) -> Column:
    """Truncated, not rounded."""
    return F.date_trunc("millisecond", ts)


def in_domain(value: Column, names: tuple[str, ...]) -> Column:
    """``value`` if it is one of the names, case and all; else the query fails."""
    return F.when(value.isNull() | value.isin(*names), value).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), value)).cast("string"))


SIDES = ("buy", "sell")
EVENT_KINDS = ("connected", "disconnected", "gap_detected", "late_trade", "error")
