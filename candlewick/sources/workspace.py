"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which executors share; a temporary one only on one machine where that is unset."""
    global _own
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="candlewick-")
    return f"file://{_own}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written there and read again: computed once, however often it is used."""
    path = f"{folder(df.sparkSession)}/candlewick-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
