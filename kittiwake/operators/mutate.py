"""Mutations as plans: a base table and a batch give the new table.

Batches carry an explicit sequence column; of several changes to one key the last wins. Keys are combined before the
shuffle (min_by and max_by), so that one key with most of a batch is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kittiwake.functions.coerce import wrap
from kittiwake.runtime import cut


def _last(batch: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key by ``seq``."""
    row = F.struct(*batch.columns)
    return batch.groupBy(*key).agg(F.max_by(row, seq).alias("r")).select("r.*")


def insert(base: DataFrame, batch: DataFrame, unique: Sequence[Sequence[str]], seq: str, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a batch taken in ``seq`` order.

    A row is rejected if the base or an earlier accepted row has the same value of any unique key; rejected rows have a
    ``reason``. ``seq`` must be unique. Null keys are equal to nothing. Without ``check`` all are accepted."""
    if not check or not unique:
        return batch, batch.limit(0).withColumn("reason", F.lit(""))
    if len(unique) == 1:
        return _insert_one_key(base, batch, list(unique[0]), seq)
    open_ = batch
    rejected = None
    for key in unique:
        clash = base.select(*key).distinct()
        out = open_.join(clash, list(key), "left_semi").select(*batch.columns).withColumn("reason", F.lit("exists: " + ",".join(key)))
        rejected = out if rejected is None else rejected.unionByName(out)
        open_ = open_.join(clash, list(key), "left_anti").select(*batch.columns)
    accepted = None
    while True:
        first = open_
        for key in unique:
            known = F.lit(True)
            for k in key:
                known = known & F.col(k).isNotNull()
            least = open_.where(known).groupBy(*key).agg(F.min(seq).alias("__first"))
            first = first.join(least, list(key), "left").where(F.col("__first").isNull() | (F.col("__first") == F.col(seq))).select(*batch.columns)
        first = cut(first)
        accepted = first if accepted is None else accepted.unionByName(first)
        rest = open_.join(first.select(seq), seq, "left_anti")
        for key in unique:
            taken = first.select(*key).distinct()
            lost = rest.join(taken, list(key), "left_semi").select(*batch.columns).withColumn("reason", F.lit("repeated: " + ",".join(key)))
            rejected = rejected.unionByName(lost)
            rest = rest.join(taken, list(key), "left_anti").select(*batch.columns)
        # with several keys a rejected row frees its other keys for later rows; each round settles at least one row
        open_ = cut(rest)
        if not open_.limit(1).count():
            return accepted, rejected


def _insert_one_key(base: DataFrame, batch: DataFrame, key: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """Both outcomes from one plan whose shuffles are all by the key."""
    there = base.select(*key, F.lit(True).alias("__there")).distinct()
    first = batch.groupBy(*key).agg(F.min(seq).alias("__first"))
    full = batch.join(first.join(there, key, "left"), key, "left")
    reason = F.when(F.col("__there"), "exists: " + ",".join(key)).when(F.col("__first") != F.col(seq), "repeated: " + ",".join(key))
    told = full.select(*[full[c] for c in batch.columns], reason.alias("reason"))
    return told.where(F.col("reason").isNull()).drop("reason"), told.where(F.col("reason").isNotNull())


def upsert(base: DataFrame, batch: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The base with the last change of every key put in; columns and order of columns as in the base."""
    new = _last(batch, key, seq).select(*base.columns)
    return base.join(new, list(key), "left_anti").select(*base.columns).unionByName(new)


def upsert_codes(base: DataFrame, batch: DataFrame, key: Sequence[str], seq: str, frozen: str) -> DataFrame:
    """(key, code) per changed key: 0 new, 1 overwritten in place, 2 the old row was frozen, so it is deleted and the new
    one gets a new id."""
    new = _last(batch, key, seq).select(*key)
    old = base.select(*key, F.col(frozen).alias("__frozen"))
    code = F.when(F.col("__frozen").isNull(), 0).when(F.col("__frozen"), 2).otherwise(1)
    return new.join(old, list(key), "left").select(*key, code.alias("code"))


def update(base: DataFrame, changes: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The base with the last change of every key that exists; changes to unknown keys are ignored."""
    own = [c for c in base.columns if c in changes.columns and c not in key]
    new = _last(changes, key, seq).select(*key, F.struct(*own).alias("__new"))
    joined = base.join(new, list(key), "left")
    return joined.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in base.columns])


def delete(base: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """The base without the rows of these keys; unknown keys are ignored."""
    return base.join(keys.select(*key).distinct(), list(key), "left_anti").select(*base.columns)


def update_column(base: DataFrame, column: str, value: Column, where: Column) -> DataFrame:
    """One column set where the condition holds (null counts as no)."""
    return base.withColumn(column, F.when(F.coalesce(where, F.lit(False)), value.cast(base.schema[column].dataType)).otherwise(F.col(column)))


def increment(base: DataFrame, column: str, by: int | float | Column, where: Column | None = None, kind: str | None = None) -> DataFrame:
    """A column raised by ``by``; an integer column of ``kind`` wraps at its width, a floating one refuses nothing."""
    step = by if isinstance(by, Column) else F.lit(by)
    if kind and not kind.startswith("float"):
        if isinstance(by, float):
            raise TypeError("an integer column takes an integer")
        value = wrap(F.col(column).cast("decimal(38,0)") + step.cast("decimal(38,0)"), kind)
    else:
        value = F.col(column) + step
    return update_column(base, column, value, F.lit(True) if where is None else where)


def update_by(base: DataFrame, column: str, rule: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """Read, modify, write: ``rule`` gives the new value and whether to apply it."""
    value, apply = rule(F.col(column))
    return update_column(base, column, value, apply)


class UnitOfWork:
    """Changes that are visible to their session before they are committed: own inserts seen, own deletes hidden."""

    def __init__(self, base: DataFrame, key: Sequence[str]):
        self.base, self.key = base, list(key)
        self.inserted: DataFrame | None = None
        self.deleted: DataFrame | None = None

    def insert(self, rows: DataFrame) -> None:
        rows = rows.select(*self.base.columns)
        self.inserted = rows if self.inserted is None else self.inserted.unionByName(rows)

    def delete(self, keys: DataFrame) -> None:
        keys = keys.select(*self.key)
        if self.inserted is not None:
            self.inserted = self.inserted.join(keys, self.key, "left_anti").select(*self.base.columns)
        self.deleted = keys if self.deleted is None else self.deleted.unionByName(keys)

    def view(self) -> DataFrame:
        own = self.base if self.deleted is None else delete(self.base, self.deleted, self.key)
        return own if self.inserted is None else own.unionByName(self.inserted)

    def commit(self) -> DataFrame:
        """The new base; the unit starts over on it."""
        self.base = self.view()
        self.inserted = self.deleted = None
        return self.base

    def rollback(self) -> DataFrame:
        self.inserted = self.deleted = None
        return self.base
