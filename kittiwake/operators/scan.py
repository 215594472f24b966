"""Table scans in both directions, reads by record id, counts and dense numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kittiwake.runtime import cut


class RecordError(LookupError):
    """A record id that is out of range or deleted."""


def live(rows: DataFrame, deleted: Column | str | None) -> DataFrame:
    """Rows that are not deleted; a null mark counts as not deleted."""
    if deleted is None:
        return rows
    mark = rows[deleted] if isinstance(deleted, str) else deleted
    return rows.where(~F.coalesce(mark, F.lit(False)))


def forward(rows: DataFrame, rid: str, deleted: Column | str | None = None) -> DataFrame:
    """Live rows in ascending id order."""
    return live(rows, deleted).orderBy(F.col(rid).asc())


def backward(rows: DataFrame, rid: str, deleted: Column | str | None = None) -> DataFrame:
    """Live rows in descending id order."""
    return live(rows, deleted).orderBy(F.col(rid).desc())


def seek_exact(rows: DataFrame, rid: str, value: int, deleted: Column | str | None = None) -> DataFrame:
    """The live row with that id, or no row."""
    return live(rows, deleted).where(F.col(rid) == value)


def seek_lower(rows: DataFrame, rid: str, value: int, deleted: Column | str | None = None) -> DataFrame:
    """Live rows with ids of at least ``value``, ascending."""
    return live(rows, deleted).where(F.col(rid) >= value).orderBy(F.col(rid).asc())


def resume_after(rows: DataFrame, rid: str, last: int | None, deleted: Column | str | None = None, ascending: bool = True) -> DataFrame:
    """A cursor that goes on after the id it last returned, from the start if there is none."""
    own = live(rows, deleted)
    if last is not None:
        own = own.where(F.col(rid) > last if ascending else F.col(rid) < last)
    return own.orderBy(F.col(rid).asc() if ascending else F.col(rid).desc())


def get(rows: DataFrame, rid: str, value: int, deleted: Column | str | None = None) -> dict:
    """The row with that id; RecordError if it is out of range or deleted."""
    mark = F.lit(False) if deleted is None else (F.col(deleted) if isinstance(deleted, str) else deleted)
    found = rows.where(F.col(rid) == value).select("*", F.coalesce(mark, F.lit(False)).alias("__gone")).limit(1).collect()
    if not found:
        raise RecordError(f"record {value} is out of range")
    row = found[0].asDict()
    if row.pop("__gone"):
        raise RecordError(f"record {value} is deleted")
    return row


def exists(rows: DataFrame, rid: str, value: int, deleted: Column | str | None = None) -> bool:
    return bool(seek_exact(rows, rid, value, deleted).limit(1).count())


def is_empty(rows: DataFrame, deleted: Column | str | None = None) -> bool:
    return not live(rows, deleted).limit(1).count()


def counts(rows: DataFrame, deleted: Column | str | None = None) -> DataFrame:
    """(physical, live): one row."""
    mark = F.lit(False) if deleted is None else (F.col(deleted) if isinstance(deleted, str) else deleted)
    return rows.agg(F.count("*").alias("physical"), F.count(F.when(~F.coalesce(mark, F.lit(False)), 1)).alias("live"))


def project(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in the order given; a repeated one gets a numbered name; an unknown one is an error of analysis."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        n = seen[c] = seen.get(c, 0) + 1
        out.append(rows[c].alias(c if n == 1 else f"{c}_{n}"))
    return rows.select(*out)


def project_group(rows: DataFrame, name: str, columns: list[str], beside: Sequence[str] = ()) -> DataFrame:
    """One struct column that holds a column group, after the columns of ``beside``."""
    return rows.select(*beside, F.struct(*columns).alias(name))


def many_cursors(rows: DataFrame, n: int, rid: str) -> list[DataFrame]:
    """``n`` scans that together see every row once."""
    return [rows.where(F.pmod(F.xxhash64(rid), F.lit(n)) == k) for k in range(n)]


def random_rows(rows: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A random sample without replacement."""
    return rows.sample(False, share, seed)


def numbered(rows: DataFrame, order: list[Column], name: str = "pos", start: int = 0) -> DataFrame:
    """``rows`` with dense positions in the given total order.

    Rows are range-partitioned and sorted; the sorted rows are kept in the shared folder, and a partition's first number
    is the sum of the counts before it, so that no task sees more than its partition."""
    kept = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    mid = F.monotonically_increasing_id()
    part = F.shiftright(mid, 33).cast("int")
    sizes = {r[0]: r[1] for r in kept.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    first, at = [], start
    for k in range(max(sizes, default=0) + 1):
        first.append(at)
        at += sizes.get(k, 0)
    return kept.withColumn(name, F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), part + 1) + mid.bitwiseAND(F.lit(2**33 - 1)))
