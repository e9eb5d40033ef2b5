"""What the training-data operators share: reading tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on one machine (``local[...]``) where that is unset."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="candlewick-")
    return f"file://{_own_dir}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    A lost executor then costs a re-read, not a recomputation, and the planner
    knows the real size, so that it broadcasts only what is small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/candlewick-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
