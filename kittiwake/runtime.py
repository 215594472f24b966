"""What operators need from the session: the shared folder, lineage cuts and sizing."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(spark, "_kittiwake_dir", None)
        if not named:
            named = "file://" + tempfile.mkdtemp(prefix="kittiwake-")
            spark._kittiwake_dir = named
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, partitions and their order kept."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, rows: int, rows_per_partition: int) -> int:
    """Enough partitions for ``rows``, never fewer than the session's own number."""
    return max(shuffle_partitions(spark), math.ceil(rows / max(1, rows_per_partition)))
