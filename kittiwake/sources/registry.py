"""Sources by file suffix, and the table format for ``spark.read.format``."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kittiwake.sources.files import Files
from kittiwake.sources.store import Store

_OPENERS: dict[str, Callable[[SparkSession, str, T.StructType | None], DataFrame]] = {}


def register_source(suffix: str, opener: Callable[[SparkSession, str, T.StructType | None], DataFrame]) -> None:
    _OPENERS[suffix] = opener


def open_source(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file or folder by its suffix; a folder with manifests is a table."""
    if any(n.startswith("manifest-") for n in Files(spark, path).list()):
        return Store.open(spark, path).read()
    name = path.removesuffix(".gz").removesuffix(".bz2")
    suffix = name.rpartition(".")[2]
    if suffix not in _OPENERS:
        raise ValueError(f"no source for suffix {suffix!r}")
    return _OPENERS[suffix](spark, path, schema)


def _reader(kind: str, **options):
    def opener(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
        r = spark.read.options(**options)
        return (r.schema(schema) if schema else r).format(kind).load(path)

    return opener


for _suffix, _kind, _options in (("parquet", "parquet", {}), ("orc", "orc", {}), ("json", "json", {}), ("csv", "csv", {"header": "true"}), ("tsv", "csv", {"sep": "\t"}), ("txt", "text", {})):
    register_source(_suffix, _reader(_kind, **_options))
register_source("empty", lambda spark, path, schema: spark.createDataFrame([], schema or T.StructType()))


def _file_system(path: str):
    """File system and path of a local path or a URI, also on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _manifest(folder: str, version: int | None) -> dict:
    from pyarrow import fs

    system, at = _file_system(folder)
    names = [i.path for i in system.get_file_info(fs.FileSelector(at)) if i.base_name.startswith("manifest-")]
    with system.open_input_stream(max(names)) as f:
        m = json.loads(f.read())
    if any(version is None or o["version"] <= version for o in m["overlays"]):
        raise ValueError("this table has columns changed in place; compact it, or read it with Store.read")
    return m


class _File(InputPartition):
    def __init__(self, path: str, marks: list[tuple[str, bool]], version: int):
        self.path, self.marks, self.version = path, marks, version


class _TableReader(DataSourceReader):
    def __init__(self, schema: T.StructType, folder: str, version: int | None):
        self.names, self.folder = schema.names, folder
        self.manifest = _manifest(folder, version)
        self.version = self.manifest["version"] if version is None else version

    def partitions(self) -> list[InputPartition]:
        """A partition a file, with the mark files whose record ids meet its own."""
        out = []
        for s in self.manifest["segments"]:
            for p in s["parts"]:
                low, high = p["bounds"]["__rid"]
                marks = [(f"{self.folder}/{t['path']}/{q['name']}", t["clear"]) for t in self.manifest["tombstones"] if t["version"] <= self.version for q in t["parts"] if q["bounds"]["__rid"][0] <= high and q["bounds"]["__rid"][1] >= low]
                out.append(_File(f"{self.folder}/{s['path']}/{p['name']}", marks, self.version))
        return out

    def read(self, partition: _File) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        def opened(path: str):
            system, at = _file_system(path)
            return pq.ParquetFile(at, filesystem=system)

        f = opened(partition.path)
        own = f.read(columns=["__rid"]).column("__rid")
        # marks of this file's rows only, read once
        marks: dict[int, tuple[int, bool]] = {}
        for path, clear in partition.marks:
            for b in opened(path).iter_batches(columns=["__rid", "__del_ver"]):
                b = b.filter(pc.and_(pc.less_equal(b.column("__del_ver"), partition.version), pc.is_in(b.column("__rid"), value_set=own)))
                for rid, at in zip(b.column("__rid").to_pylist(), b.column("__del_ver").to_pylist()):
                    marks[rid] = max(marks.get(rid, (-1, True)), (at, clear))
        gone = pa.array([rid for rid, (_, clear) in marks.items() if not clear], pa.int64())
        for batch in f.iter_batches(columns=["__rid", "__ins_ver", *self.names]):
            keep = pc.and_(pc.less_equal(batch.column("__ins_ver"), partition.version), pc.invert(pc.is_in(batch.column("__rid"), value_set=gone)))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in self.names], names=self.names).filter(keep)


class TableSource(DataSource):
    """``spark.read.format("kittiwake").option("version", v).load(folder)`` after ``spark.dataSource.register``.

    For plans with pushdown, ``Store.read`` is the better way in; this one reads whole columns through Arrow."""

    @classmethod
    def name(cls) -> str:
        return "kittiwake"

    def _folder(self) -> str:
        return self.options["path"].removeprefix("file://").rstrip("/")

    def schema(self) -> T.StructType:
        v = self.options.get("version")
        return T.StructType.fromJson(_manifest(self._folder(), int(v) if v is not None else None)["schema"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        v = self.options.get("version")
        return _TableReader(schema, self._folder(), int(v) if v is not None else None)
