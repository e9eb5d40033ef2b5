"""Running values over one key's arrival order, without one task per key.

Arrival numbers are cut into spans. Each span's total is aggregated, the few
totals of a key are run over in order, and what came before a span is joined
back; inside spans plain windows do the rest. A hot key is so as many tasks as it
has spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Arrival numbers in one span.
SPAN = 1 << 18
_KINDS = {"max": F.max, "min": F.min, "sum": F.sum}


@dataclass(frozen=True)
class Running:
    """The ``kind`` (max, min, sum or last) of ``value`` over a key's earlier rows.

    ``inclusive`` counts the row itself. ``last`` gives the last earlier value,
    null or not. No earlier row: null.
    """

    value: Column
    kind: str
    inclusive: bool = False


def running(df: DataFrame, keys: list[str], seq: str, span: int = SPAN, **outs: Running) -> DataFrame:
    """Adds a column per keyword. All share one aggregation, one join and one sort. Without keys, the whole table is one."""
    columns = df.columns
    d = df.withColumn("__span", F.floor(F.col(seq) / span))
    for k, r in outs.items():
        d = d.withColumn(f"__v_{k}", r.value)
    total = lambda k, r: (F.max_by(F.struct(f"__v_{k}"), seq) if r.kind == "last" else _KINDS[r.kind](f"__v_{k}")).alias(f"__t_{k}")
    over = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda k, r: ((F.last if r.kind == "last" else _KINDS[r.kind])(f"__t_{k}").over(over)).alias(f"__b_{k}")
    totals = d.groupBy(*keys, "__span").agg(*[total(k, r) for k, r in outs.items()])
    d = d.join(totals.select(*keys, "__span", *[before(k, r) for k, r in outs.items()]), [*keys, "__span"])
    inside = Window.partitionBy(*keys, "__span").orderBy(seq)
    result = []
    for k, r in outs.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
        if r.kind == "last":
            d = d.withColumn(f"__o_{k}", F.last(F.struct(f"__v_{k}")).over(frame))
            result.append(F.coalesce(f"__o_{k}", f"__b_{k}")[f"__v_{k}"].alias(k))
        else:
            d = d.withColumn(f"__o_{k}", _KINDS[r.kind](f"__v_{k}").over(frame))
            both = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(F.col(a) + F.col(b), a, b)}[r.kind]
            result.append(both(f"__o_{k}", f"__b_{k}").alias(k))
    return d.select(*columns, *result)
