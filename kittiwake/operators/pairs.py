"""All pairs inside groups, in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_in_groups(rows: DataFrame, keys: list[str], id_column: str = "id", block: int = 2000) -> DataFrame:
    """(id_a, id_b), id_a < id_b, for every two different ids that share all ``keys``.

    Groups of one are dropped before the join. A group larger than ``block`` is split by a hash of the id and each pair
    of its blocks is a join key of its own, so that no task holds more than two blocks; no pair is left out. Rows with a
    null key or id are in no pair; a repeated row adds nothing; the result is distinct.
    """
    own = rows.select(*keys, F.col(id_column).alias("id")).dropna().distinct()
    sizes = own.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    split = own.join(sizes, keys).withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")))
    a = split.select(*keys, F.col("id").alias("a"), F.col("b").alias("b0"), F.explode(F.sequence("b", F.col("blocks") - 1)).alias("b1"))
    b = split.select(*keys, F.col("id").alias("z"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("b"))).alias("b0"), F.col("b").alias("b1"))
    met = a.join(b, [*keys, "b0", "b1"]).where(F.when(F.col("b0") == F.col("b1"), F.col("a") < F.col("z")).otherwise(F.col("a") != F.col("z")))
    return met.select(F.least("a", "z").alias("id_a"), F.greatest("a", "z").alias("id_b"))
