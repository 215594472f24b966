"""Key-value access to a table with one unique key column and one value column."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kittiwake.schema import REST, TableDef
from kittiwake.sources.store import Store

KV_SCHEMA = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("val", T.BinaryType(), False)])


# plans over any table with key columns


def multi_get(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Each asked key once, with the columns of its row, null where there is none."""
    return keys.select(key).distinct().join(rows, key, "left")


def from_key(rows: DataFrame, start, key: str = "key") -> DataFrame:
    """Rows from the first key of at least ``start``, in key order."""
    return rows.where(F.col(key) >= start).orderBy(F.col(key).asc())


def before_key(rows: DataFrame, start, key: str = "key") -> DataFrame:
    """Rows before ``start``, the nearest first."""
    return rows.where(F.col(key) < start).orderBy(F.col(key).desc())


def apply_batch(rows: DataFrame, batch: DataFrame, key: str = "key", op: str = "op", seq: str = "seq") -> DataFrame:
    """The table after a batch of puts and deletes; of several operations on a key the last one counts."""
    last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), seq).alias("r")).select("r.*")
    kept = rows.join(last.select(key), key, "left_anti").select(*rows.columns)
    return kept.unionByName(last.where(F.col(op) == "put").select(*rows.columns))


class NotFound(KeyError):
    """No value under a key."""


class KeyValue:
    """Put, get, delete, write and iterate; a snapshot reads one version."""

    def __init__(self, store: Store, version: int | None = None):
        self.store, self.version = store, version

    @classmethod
    def open(cls, spark: SparkSession, folder: str, create: bool = True) -> KeyValue:
        try:
            return cls(Store.open(spark, folder))
        except FileNotFoundError:
            if not create:
                raise
            return cls(Store.create(spark, folder, KV_SCHEMA, [["key"]]))

    def rows(self) -> DataFrame:
        return self.store.read(self.version)

    def _frame(self, pairs: Iterable[tuple]) -> DataFrame:
        spark = self.store.spark
        return spark.createDataFrame([(k, v, op, n) for n, (op, k, v) in enumerate(pairs)], "key binary, val binary, op string, seq long")

    def put(self, key: bytes, value: bytes) -> None:
        self.write([("put", key, value)])

    def delete(self, key: bytes) -> None:
        """A missing key is no error."""
        self.write([("delete", key, None)])

    def write(self, batch: Sequence[tuple]) -> None:
        """Operations ("put", key, value) and ("delete", key, None) in one commit; the last one on a key counts."""
        if self.version is not None:
            raise ValueError("a snapshot cannot be written")
        if not batch:
            return
        self.load(self._frame(batch))

    def load(self, batch: DataFrame) -> None:
        """A table of operations (key, val, op, seq) in one commit, op being put or delete; the last by seq on a key counts."""
        if self.version is not None:
            raise ValueError("a snapshot cannot be written")
        last = batch.groupBy("key").agg(F.max_by(F.struct("val", "op"), "seq").alias("r")).select("key", "r.*")
        # every key of the batch is deleted first and comes once
        self.store.transact(last.where(F.col("op") == "put").select("key", "val"), last.select("key"), check=False)

    def get(self, key: bytes) -> bytes:
        found = self.rows().where(F.col("key") == F.lit(key)).select("val").limit(1).collect()
        if not found:
            raise NotFound(key)
        return bytes(found[0][0])

    def multi_get(self, keys: Sequence[bytes]) -> dict[bytes, bytes | None]:
        asked = self.store.spark.createDataFrame([(k,) for k in keys], "key binary")
        return {bytes(r[0]): None if r[1] is None else bytes(r[1]) for r in multi_get(self.rows(), asked).collect()}

    def snapshot(self) -> KeyValue:
        return KeyValue(self.store, self.store.manifest()["version"])

    def iterator(self, page: int = 1000) -> KeyIterator:
        return KeyIterator(self.snapshot() if self.version is None else self, page)

    def compact_range(self, low: bytes | None = None, high: bytes | None = None) -> None:
        """The whole table is compacted, whatever the range."""
        self.store.compact()

    def approximate_size(self, low: bytes, high: bytes) -> int:
        """Bytes of keys and values in a range."""
        r = self.rows().where((F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high))).agg(F.sum(F.length("key") + F.length("val"))).first()
        return r[0] or 0

    def backup(self, folder: str) -> KeyValue:
        return KeyValue(self.store.copy_to(folder))

    def replay(self, after: int) -> DataFrame:
        """Changes since a version, for another copy."""
        return self.store.changes(after)


class KeyIterator:
    """Cursor over a snapshot; rows are fetched a page at a time in the direction of travel."""

    def __init__(self, kv: KeyValue, page: int = 1000):
        self.kv, self.page = kv, page
        self.items: list[tuple[bytes, bytes]] = []
        self.at, self.ahead = 0, True

    def _fetch(self, rows: DataFrame, ahead: bool) -> None:
        order = F.col("key").asc() if ahead else F.col("key").desc()
        self.items = [(bytes(r[0]), bytes(r[1])) for r in rows.orderBy(order).limit(self.page).select("key", "val").collect()]
        self.at, self.ahead = 0, ahead

    def valid(self) -> bool:
        return self.at < len(self.items)

    def seek_to_first(self) -> None:
        self._fetch(self.kv.rows(), True)

    def seek_to_last(self) -> None:
        self._fetch(self.kv.rows(), False)

    def seek(self, key: bytes) -> None:
        """The first key of at least ``key``."""
        self._fetch(self.kv.rows().where(F.col("key") >= F.lit(key)), True)

    def _step(self, ahead: bool) -> None:
        here = self.key()
        if self.ahead == ahead and self.at + 1 < len(self.items):
            self.at += 1
            return
        beyond = F.col("key") > F.lit(here) if ahead else F.col("key") < F.lit(here)
        self._fetch(self.kv.rows().where(beyond), ahead)

    def next(self) -> None:
        self._step(True)

    def prev(self) -> None:
        self._step(False)

    def key(self) -> bytes:
        return self.items[self.at][0]

    def value(self) -> bytes:
        return self.items[self.at][1]

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        while self.valid():
            yield self.key(), self.value()
            self.next()


class Families:
    """Column families: one key-value table each."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def family(self, name: str = "default") -> KeyValue:
        return KeyValue.open(self.spark, f"{self.folder}/{name}")

    @staticmethod
    def declared(definition: TableDef) -> list[str]:
        """Names of the families that a table definition declares as column groups."""
        return [g.name for g in definition.groups if g.name not in {i.name for i in definition.indexes} | {REST}]

    def list(self) -> list[str]:
        from kittiwake.sources.store import Catalog

        return Catalog(self.spark, self.folder).list_tables()

    def drop(self, name: str) -> None:
        self.family(name).store.drop()


def compare_versions(a: int, b: int) -> int:
    return (a > b) - (a < b)
