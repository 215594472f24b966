"""Delimited text in, JSON rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kittiwake.functions.coerce import number_of_text
from kittiwake.functions.strings import split_fields
from kittiwake.schema import NUMBERS, TableDef


def _typed(text: Column, kind: str, length: int | None) -> Column:
    if kind in NUMBERS and kind not in ("uint128", "sint128", "float128"):
        return number_of_text(text, kind)
    if kind == "float128":
        return text.cast("double")
    if kind == "uuid":
        return F.unhex(F.regexp_replace(text, "-", ""))
    if kind == "fixed":
        return F.rpad(text, length, "\x00").cast("binary")
    if kind in ("binary", "carbin"):
        return text.cast("binary")
    return text


def parse(lines: DataFrame, definition: TableDef, delimiter: str = "\t", line: str = "value") -> DataFrame:
    """Columns of every line and ``parsed``: how many columns the line had. Columns that are missing are null; further
    text stays in the last column."""
    n = len(definition.columns)
    fields = split_fields(F.col(line), delimiter, n)
    cols = [F.when(F.size("__f") > k, _typed(F.col("__f")[k], c.kind, c.length)).alias(c.name) for k, c in enumerate(definition.columns)]
    return lines.select(fields.alias("__f")).select(*cols, F.least(F.size("__f"), F.lit(n)).alias("parsed"))


def read_delimited(spark: SparkSession, path: str, definition: TableDef, delimiter: str = "\t", limit: int | None = None, skip_existing: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """Rows of text files (compressed ones too) that have all columns; at most ``limit``; without keys already there."""
    rows = parse(spark.read.text(path), definition, delimiter).where(F.col("parsed") == len(definition.columns)).drop("parsed")
    if skip_existing is not None:
        rows = rows.join(skip_existing.select(*key), key, "left_anti").select(*[c.name for c in definition.columns])
    return rows if limit is None else rows.limit(limit)


def to_lines(rows: DataFrame, delimiter: str = "\t") -> DataFrame:
    """One text line a row; binary columns as hexadecimal, null as empty."""
    cols = [F.hex(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name).cast("string") for f in rows.schema]
    return rows.select(F.concat_ws(delimiter, *[F.coalesce(c, F.lit("")) for c in cols]).alias("value"))


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row, columns in order, numbers by their declared sign, binary as hexadecimal, nulls kept; a row
    without columns gives ``emptyJson{}``."""
    if not rows.columns:
        return rows.select(F.lit("emptyJson{}").alias("json"))
    cols = [(F.hex(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name)).alias(f.name) for f in rows.schema]
    return rows.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def dump(rows: DataFrame, rid: str, start: int = 0, count: int | None = None) -> DataFrame:
    """JSON of the rows with ids from ``start`` on, at most ``count`` of them, in id order."""
    own = rows.where(F.col(rid) >= start).orderBy(F.col(rid).asc())
    return to_json(own if count is None else own.limit(count))


def write_lines(rows: DataFrame, path: str, delimiter: str = "\t", compression: str = "none") -> None:
    """Text files of the rows, plain or compressed (gzip, bzip2)."""
    to_lines(rows, delimiter).write.option("compression", compression).text(path)
