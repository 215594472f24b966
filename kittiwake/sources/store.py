"""A versioned table in a folder: Parquet segments sorted by key, tombstones, column overlays and one manifest a commit.

A commit writes its files first and then its manifest, whose name holds the version and is created exclusively: readers
see whole versions only, and of two writers one fails and tries again on the newer version. Rows keep their record id and
the version that inserted them; a deleted row has a tombstone with the version that deleted it. The manifest keeps the
least and greatest key and record id of every file, so that seeks open only the files that can hold their key.
"""

from __future__ import annotations

import datetime
import json
import math
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kittiwake.operators import index, mutate
from kittiwake.operators.scan import numbered
from kittiwake.operators.versions import next_action
from kittiwake.runtime import cut
from kittiwake.schema import TableDef
from kittiwake.sources.files import Files

RID, INSERTED = "__rid", "__ins_ver"
_TOMB = "__rid long, __del_ver long"
#: Longer texts have no bounds in the manifest.
_BOUND_LETTERS = 64

_KINDS: dict[str, dict[str, str]] = {}


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class WriteThrottled(RuntimeError):
    """More bytes a second were written than allowed."""


def register_segment(kind: str, **options: str) -> None:
    """How segments of a kind are written: options of the Parquet writer."""
    _KINDS[kind] = options


register_segment("delta", compression="snappy")
register_segment("frozen", compression="zstd")


def _bound(value):
    """A key value as JSON keeps it, in the same order; None if it has no bound."""
    if isinstance(value, datetime.datetime):
        return value.isoformat() if value.tzinfo is None else None
    if isinstance(value, datetime.date):
        return f"{value.isoformat()}T00:00:00"
    if isinstance(value, (bytes, bytearray)):
        value = bytes(value).hex()
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, str):
        return value if len(value) <= _BOUND_LETTERS else None
    return value if isinstance(value, (int, float)) else None


def _meets(bounds: list | None, low, high) -> bool:
    """Whether a file with these bounds may hold a key from ``low`` to ``high``, either of which may be None."""
    if not bounds or bounds[0] is None or bounds[1] is None:
        return True
    same = lambda x: type(x) is type(bounds[0]) or (isinstance(x, (int, float)) and isinstance(bounds[0], (int, float)))
    return not ((low is not None and same(low) and bounds[1] < low) or (high is not None and same(high) and bounds[0] > high))


class Store:
    """One table in ``folder``, on a file system that all executors share.

    ``bytes_per_second`` limits what this writer commits; beyond it a commit waits, or raises WriteThrottled without
    ``wait``. ``hooks`` are called with every manifest that this writer has committed."""

    def __init__(self, spark: SparkSession, folder: str, retries: int = 3, bytes_per_second: float | None = None, wait: bool = True):
        self.spark, self.files, self.retries = spark, Files(spark, folder), retries
        self.bytes_per_second, self.wait, self.hooks = bytes_per_second, wait, []
        self._pending: list[str] = []
        self._paid = 0.0

    # life cycle

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: T.StructType | TableDef, unique: Sequence[Sequence[str]] = (), history: bool = True, order: Sequence[str] = (), in_place: Sequence[Sequence[str]] = (), bloom: Sequence[str] = (), segment_bytes: int = 1 << 30) -> Store:
        """A new empty table; an error if the folder already holds one. Without ``history`` compaction drops old versions.

        ``order``: the key by which segments are sorted, by default the first unique one, or the first index of a
        definition. ``bloom``: columns with a Bloom filter in frozen segments, by default those of the other indexes of a
        definition. ``in_place``: groups of columns that change without their rows. ``segment_bytes``: a commit rolls to a
        further segment beyond it."""
        if isinstance(schema, TableDef):
            keys = [i.columns for i in schema.indexes]
            order = order or next((i.columns for i in schema.indexes if i.unique), keys[0] if keys else ())
            bloom = bloom or sorted({c for k in keys for c in k} - set(order))
            in_place = in_place or [g.columns for g in schema.groups if g.in_place]
            unique, history, schema = schema.unique_keys(), schema.permanent_ids, schema.struct()
        order = list(order or (unique[0] if unique else ()))
        fixed = {c for u in unique for c in u} | set(order)
        if fixed & {c for g in in_place for c in g}:
            raise ValueError("key columns cannot change in place")
        store = cls(spark, folder)
        store.files.make()
        store._publish({"version": 0, "schema": json.loads(schema.json()), "unique": [list(u) for u in unique], "history": history, "order": order, "bloom": list(bloom), "in_place": [list(g) for g in in_place], "segment_bytes": segment_bytes, "segments": [], "tombstones": [], "overlays": [], "next_rid": 0, "oldest": 0, "tags": {}, "applied": {}, "time": time.time()})
        return store

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Store:
        store = cls(spark, folder)
        store.manifest()
        return store

    def drop(self) -> None:
        self.files.remove()

    def copy_to(self, folder: str) -> Store:
        """A copy of the newest version and all that it still sees (backup)."""
        other = Store(self.spark, folder, self.retries)
        other.files.make()
        m = self.manifest()
        for path in sorted({e["path"] for k in ("segments", "tombstones", "overlays") for e in m[k]}):
            self.files.copy(path, other.files)
        other._publish(m)
        return other

    # manifests

    def versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.files.list() if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        all_versions = self.versions()
        if not all_versions:
            raise FileNotFoundError(f"no table in {self.files.folder}")
        v = all_versions[-1] if version is None else version
        if v not in all_versions:
            raise LookupError(f"no version {v}")
        return json.loads(self.files.read(f"manifest-{v:010d}.json"))

    def _publish(self, manifest: dict) -> None:
        name = f"manifest-{manifest['version']:010d}.json"
        try:
            self.files.publish(name, json.dumps(manifest))
        except FileExistsError:
            raise CommitConflict(f"version {manifest['version']} exists") from None
        if self.versions()[-1] > manifest["version"]:
            # an old manifest was vacuumed and its name taken again: newer ones hold
            self.files.remove(name)
            raise CommitConflict(f"version {manifest['version']} is past")

    def _commit(self, change: Callable[[dict], dict | None]) -> dict:
        """Apply ``change`` to the newest manifest and publish it, again on a newer one if another writer was first."""
        try:
            for attempt in range(self.retries + 1):
                old = self.manifest()
                new = change(json.loads(json.dumps(old)))
                if new is None:
                    return old
                new["version"], new["time"] = old["version"] + 1, time.time()
                self._throttle(old, new)
                try:
                    self._publish(new)
                except CommitConflict:
                    if attempt == self.retries:
                        raise
                    time.sleep(0.05 * 2**attempt)
                    continue
                for hook in self.hooks:
                    hook(new)
                return new
            raise AssertionError
        finally:
            # what was published is named by a manifest now, the rest is for vacuum
            for path in self._pending:
                self.files.remove(f".writing-{path}")
            self._pending = []

    def _throttle(self, old: dict, new: dict) -> None:
        if not self.bytes_per_second:
            return
        known = {e["path"] for k in ("segments", "tombstones", "overlays") for e in old[k]}
        size = sum(e["bytes"] for k in ("segments", "tombstones", "overlays") for e in new[k] if e["path"] not in known)
        ahead = self._paid - time.time()
        if ahead > 0:
            if not self.wait:
                raise WriteThrottled(f"next commit in {ahead:.1f} s")
            time.sleep(ahead)
        self._paid = max(self._paid, time.time()) + size / self.bytes_per_second

    # reading

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.manifest()["schema"])

    def _stored(self, m: dict) -> T.StructType:
        own = T.StructType.fromJson(m["schema"])
        return T.StructType([T.StructField(RID, T.LongType()), T.StructField(INSERTED, T.LongType()), *[T.StructField(f.name, f.dataType, True, f.metadata) for f in own]])

    def _files(self, entries: list[dict], schema) -> DataFrame:
        paths = [self.files.path(f"{e['path']}/{p['name']}") for e in entries for p in e["parts"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _gone(self, m: dict, version: int) -> DataFrame | None:
        """Record ids that are deleted in a version: those whose last mark by then is no clearing one."""
        marks = [t for t in m["tombstones"] if t["version"] <= version]
        if not any(t["clear"] for t in marks):
            return self._files(marks, _TOMB).where(F.col("__del_ver") <= version).select(RID) if marks else None
        both = [self._files([t for t in marks if t["clear"] == c], _TOMB).withColumn("__clear", F.lit(c)) for c in (False, True)]
        last = both[0].unionAll(both[1]).where(F.col("__del_ver") <= version).groupBy(RID).agg(F.max_by("__clear", "__del_ver").alias("c"))
        return last.where(~F.col("c")).select(RID)

    def _overlaid(self, m: dict, version: int, rows: DataFrame) -> DataFrame:
        """Rows with the newest values of their in-place columns."""
        own = T.StructType.fromJson(m["schema"])
        for group in m["in_place"]:
            took = [o for o in m["overlays"] if o["columns"] == group and o["version"] <= version]
            if took:
                schema = T.StructType([T.StructField(RID, T.LongType()), T.StructField("__set_ver", T.LongType()), *[T.StructField(c, own[c].dataType) for c in group]])
                new = self._files(took, schema).groupBy(RID).agg(F.max_by(F.struct(*group), "__set_ver").alias("__new"))
                rows = rows.join(new, RID, "left").select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in group else F.col(c) for c in rows.columns])
        return rows

    def _visible(self, m: dict, version: int, segments: list[dict] | None = None) -> DataFrame:
        rows = self._files(m["segments"] if segments is None else segments, self._stored(m)).where(F.col(INSERTED) <= version)
        gone = self._gone(m, version)
        if gone is not None:
            rows = rows.join(gone, RID, "left_anti").select(rows.columns)
        return self._overlaid(m, version, rows)

    def _version(self, m: dict, version: int | str | None) -> int:
        v = m["tags"][version] if isinstance(version, str) else m["version"] if version is None else version
        if not m["oldest"] <= v <= m["version"]:
            raise LookupError(f"version {v} is not kept")
        return v

    def read(self, version: int | str | None = None, ids: bool = False) -> DataFrame:
        """Live rows of the newest version, of an older one or of a tag; with record id and inserting version if asked."""
        m = self.manifest()
        rows = self._visible(m, self._version(m, version))
        return rows if ids else rows.drop(RID, INSERTED)

    def _meeting(self, m: dict, low, high, of: str | None = None) -> list[dict]:
        """Segments with the files whose bounds of the first key column, or of the record id, meet a closed range."""
        column = of or m["order"][0]
        cut_down = [s | {"parts": [p for p in s["parts"] if _meets(p["bounds"].get(column), _bound(low), _bound(high))]} for s in m["segments"]]
        return [s for s in cut_down if s["parts"]]

    def exact(self, values: Sequence, version: int | str | None = None, ids: bool = False) -> DataFrame:
        """Live rows whose key, or its first columns, have these values; only files that can hold them are opened."""
        m = self.manifest()
        keys = m["order"][: len(values)]
        rows = index.exact(self._visible(m, self._version(m, version), self._meeting(m, values[0], values[0])), keys, values)
        return rows if ids else rows.drop(RID, INSERTED)

    def between(self, low: Sequence = (), high: Sequence = (), low_inclusive: bool = True, high_inclusive: bool = False, version: int | str | None = None, ids: bool = False) -> DataFrame:
        """Live rows with keys from ``low`` to ``high``; either end may be left out."""
        m = self.manifest()
        some = self._meeting(m, low[0] if low else None, high[0] if high else None)
        rows = index.between(self._visible(m, self._version(m, version), some), m["order"], low, high, low_inclusive, high_inclusive)
        return rows if ids else rows.drop(RID, INSERTED)

    def segment_of(self, rid: int) -> list[str]:
        """Paths of the segments whose files may hold a record id, from the manifest alone."""
        return [s["path"] for s in self._meeting(self.manifest(), rid, rid, RID)]

    def get(self, rid: int, version: int | str | None = None) -> dict:
        """The live row with a record id; LookupError if it is deleted or was never given."""
        m = self.manifest()
        rows = self._visible(m, self._version(m, version), self._meeting(m, rid, rid, RID))
        found = rows.where(F.col(RID) == rid).drop(RID, INSERTED).limit(1).collect()
        if not found:
            raise LookupError(f"record {rid} is " + ("deleted" if rid < m["next_rid"] else "out of range"))
        return found[0].asDict()

    def segments(self) -> DataFrame:
        """(path, kind, rows, bytes, first_rid, last_rid) of every segment."""
        found = [(s["path"], s["kind"], s["rows"], s["bytes"], min(p["bounds"][RID][0] for p in s["parts"]), max(p["bounds"][RID][1] for p in s["parts"])) for s in self.manifest()["segments"]]
        return self.spark.createDataFrame(found, "path string, kind string, rows long, bytes long, first_rid long, last_rid long")

    def tag(self, name: str) -> int:
        return self._commit(lambda m: m | {"tags": m["tags"] | {name: m["version"]}})["tags"][name]

    def counts(self) -> dict:
        """Physical and live rows, segments, bytes of rows and of tombstones."""
        m = self.manifest()
        return {"physical": sum(s["rows"] for s in m["segments"]), "live": self.read().count(), "segments": len(m["segments"]), "bytes": sum(s["bytes"] for s in m["segments"]), "tombstone_bytes": sum(t["bytes"] for t in m["tombstones"])}

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """Change feed (op, __ver, __rid, columns) of what was committed after a version: insert, delete, restore (a
        deletion undone) and update (in place, with the newest values)."""
        m = self.manifest()
        last = m["version"] if upto is None else upto
        rows = self._files(m["segments"], self._stored(m))
        now = self._overlaid(m, last, rows)
        fresh = lambda c: (F.col(c) > after) & (F.col(c) <= last)
        parts = [now.where(fresh(INSERTED)).withColumn("op", F.lit("insert")).withColumnRenamed(INSERTED, "__ver")]
        for op, clear in (("delete", False), ("restore", True)):
            marks = self._files([t for t in m["tombstones"] if t["clear"] == clear and after < t["version"] <= last], _TOMB).where(fresh("__del_ver"))
            parts.append(now.join(marks, RID).withColumn("op", F.lit(op)).withColumn("__ver", F.col("__del_ver")))
        took = [o for o in m["overlays"] if after < o["version"] <= last]
        if took:
            sets = self._files(took, "__rid long, __set_ver long").groupBy(RID).agg(F.max("__set_ver").alias("__set_ver"))
            parts.append(now.where(F.col(INSERTED) <= after).join(sets, RID).withColumn("op", F.lit("update")).withColumn("__ver", F.col("__set_ver")))
        out = ["op", "__ver", RID, *[f.name for f in T.StructType.fromJson(m["schema"])]]
        feed = parts[0].select(out)
        for p in parts[1:]:
            feed = feed.unionByName(p.select(out))
        return feed

    # writing

    def _begin(self, prefix: str, version: int) -> str:
        """A new path with a mark that keeps vacuum away until the commit is over."""
        path = f"{prefix}-{version:010d}-{uuid.uuid4().hex[:8]}"
        self.files.put(f".writing-{path}", "")
        self._pending.append(path)
        return path

    def _described(self, path: str, schema, bounds: Sequence[str]) -> list[dict]:
        """Name, rows, bytes and bounds of every file in a path; one row a file reaches the driver."""
        sizes = self.files.list(path)
        if not any(n.endswith(".parquet") for n in sizes):
            return []
        rows = self.spark.read.schema(schema).parquet(self.files.path(path))
        each = [x for k, c in enumerate(bounds) for x in (F.min(c).alias(f"l{k}"), F.max(c).alias(f"h{k}"))]
        found = rows.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n"), *each).collect()
        parts = [{"name": r["name"], "rows": r["n"], "bytes": sizes[r["name"]][1], "bounds": {c: [_bound(r[f"l{k}"]), _bound(r[f"h{k}"])] for k, c in enumerate(bounds)}} for r in found]
        return sorted(parts, key=lambda p: p["name"])

    def _segments(self, m: dict, rows: DataFrame, kind: str, version: int) -> list[dict]:
        """Write rows as one segment, or several where they exceed ``segment_bytes``; none without rows."""
        path = self._begin("seg", version)
        w = rows.write.options(**_KINDS[kind])
        if kind == "frozen":
            for c in m["bloom"]:
                w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
        w.parquet(self.files.path(path))
        parts = self._described(path, self._stored(m), [RID, *m["order"][:1]])
        out, held = [], []
        for p in parts:
            if held and sum(x["bytes"] for x in held) + p["bytes"] > m["segment_bytes"]:
                out.append(held)
                held = []
            held.append(p)
        out += [held] if held else []
        return [{"path": path, "parts": ps, "rows": sum(p["rows"] for p in ps), "bytes": sum(p["bytes"] for p in ps), "kind": kind} for ps in out]

    def _write_rows(self, m: dict, rows: DataFrame, version: int) -> list[dict]:
        """Rows in the order of the key, then of their columns' hash, with new ids in that order."""
        own = [f.name for f in T.StructType.fromJson(m["schema"])]
        order = [*map(F.col, m["order"]), F.xxhash64(*own), *[F.col(c) for c in own if c not in m["order"] and rows.schema[c].dataType.typeName() not in ("map", "variant")]]
        full = numbered(rows.select(*own), order, RID, m["next_rid"]).withColumn(INSERTED, F.lit(version).cast("long")).select(RID, INSERTED, *own)
        return self._segments(m, full, "delta", version)

    def _write_marks(self, gone: DataFrame, version: int, clear: bool = False) -> dict | None:
        path = self._begin("del", version)
        gone.select(F.col(RID).cast("long").alias(RID), F.lit(version).cast("long").alias("__del_ver")).distinct().write.parquet(self.files.path(path))
        parts = self._described(path, _TOMB, [RID])
        return {"path": path, "parts": parts, "rows": sum(p["rows"] for p in parts), "bytes": sum(p["bytes"] for p in parts), "version": version, "clear": clear} if parts else None

    def _apply(self, m: dict, new: DataFrame | None, gone: DataFrame | None) -> dict | None:
        version = m["version"] + 1
        tomb = self._write_marks(gone, version) if gone is not None else None
        segs = self._write_rows(m, new, version) if new is not None else []
        if not tomb and not segs:
            return None
        if tomb:
            m["tombstones"].append(tomb)
        m["segments"] += segs
        m["next_rid"] += sum(s["rows"] for s in segs)
        return m

    def insert(self, rows: DataFrame, seq: str | None = None, check: bool = True) -> DataFrame:
        """Append rows; returns those rejected by a unique key with a ``reason``. With several rows of one key the first by
        ``seq`` stays; without ``seq`` their order is arbitrary but fixed."""
        rejected: list[DataFrame] = []

        def change(m: dict) -> dict | None:
            batch = cut(rows.withColumn("__seq", F.col(seq) if seq else F.monotonically_increasing_id()))
            good, bad = mutate.insert(self._visible(m, m["version"]), batch, m["unique"], "__seq", check)
            rejected[:] = [cut(bad).drop("__seq")]
            return self._apply(m, good, None)

        self._commit(change)
        return rejected[0]

    def upsert(self, rows: DataFrame, seq: str, key: Sequence[str] | None = None, applied: tuple[str, int] | None = None) -> dict:
        """Put the last row of every key in place of the old one, which gets a tombstone. ``applied`` (stream, batch)
        makes it happen once."""

        def change(m: dict) -> dict | None:
            if applied and m["applied"].get(applied[0], -1) >= applied[1]:
                return None
            own = list(key or self._key(m))
            new = cut(mutate._last(rows, own, seq))
            gone = self._visible(m, m["version"]).join(new.select(*own), own, "left_semi").select(RID)
            out = self._apply(m, new, gone)
            if applied:
                out = out or m
                out["applied"][applied[0]] = applied[1]
            return out

        return self._commit(change)

    def _key(self, m: dict) -> list[str]:
        if len(m["unique"]) != 1:
            raise ValueError("one unique key is needed, or a key given")
        return m["unique"][0]

    def _hit(self, m: dict, rows: DataFrame, where: DataFrame | str, key: Sequence[str] | None) -> DataFrame:
        if isinstance(where, str):
            return rows.where(where)
        own = list(key or self._key(m))
        return rows.join(where.select(*own).distinct(), own, "left_semi")

    def delete(self, where: DataFrame | str, key: Sequence[str] | None = None) -> dict:
        """Delete by a table of keys or by a condition; what is not there is ignored."""
        return self._commit(lambda m: self._apply(m, None, self._hit(m, self._visible(m, m["version"]), where, key).select(RID)))

    def undelete(self, where: DataFrame | str, key: Sequence[str] | None = None) -> dict:
        """Clear the tombstones of deleted rows, which come back with their ids; ValueError if that breaks a unique key.
        Rows whose history was dropped cannot come back."""

        def change(m: dict) -> dict | None:
            gone = self._gone(m, m["version"])
            if gone is None:
                return None
            dead = self._files(m["segments"], self._stored(m)).join(gone, RID, "left_semi")
            back = cut(self._hit(m, self._overlaid(m, m["version"], dead), where, key))
            self._refuse_clash(m, back, self._visible(m, m["version"]))
            mark = self._write_marks(back.select(RID), m["version"] + 1, True)
            if not mark:
                return None
            m["tombstones"].append(mark)
            return m

        return self._commit(change)

    def _refuse_clash(self, m: dict, new: DataFrame, rest: DataFrame) -> None:
        """ValueError if new rows share a unique key with each other or with ``rest``; null keys are equal to nothing."""
        for u in m["unique"]:
            if new.join(rest.select(*u), list(u), "left_semi").limit(1).count() or new.dropna(subset=u).groupBy(*u).count().where("count > 1").limit(1).count():
                raise ValueError(f"breaks unique key {','.join(u)}")

    def update(self, column_values: dict, where: str) -> dict:
        """Set columns by expressions where a condition holds; changed rows get new ids. Unique keys are checked against
        all other rows."""

        def change(m: dict) -> dict | None:
            rows = self._visible(m, m["version"])
            hit = cut(rows.where(where))
            new = cut(hit.select(*[_value(column_values[c]).cast(hit.schema[c].dataType).alias(c) if c in column_values else F.col(c) for c in hit.columns]))
            if set(column_values) & {c for u in m["unique"] for c in u}:
                self._refuse_clash(m, new, rows.join(hit.select(RID), RID, "left_anti"))
            return self._apply(m, new.drop(RID, INSERTED), hit.select(RID))

        return self._commit(change)

    def set_columns(self, column_values: dict, where: str) -> dict:
        """Set columns of one in-place group by expressions where a condition holds: rows keep their ids and are not
        written again, only the columns of the group are."""

        def change(m: dict) -> dict | None:
            group = next((g for g in m["in_place"] if set(column_values) <= set(g)), None)
            if group is None:
                raise ValueError("these columns are in no in-place group")
            hit = self._visible(m, m["version"]).where(where)
            version, path = m["version"] + 1, self._begin("set", m["version"] + 1)
            new = [_value(column_values[c]).cast(hit.schema[c].dataType).alias(c) if c in column_values else F.col(c) for c in group]
            hit.select(RID, F.lit(version).cast("long").alias("__set_ver"), *new).write.parquet(self.files.path(path))
            parts = self._described(path, "__rid long, __set_ver long", [RID])
            if not parts:
                return None
            m["overlays"].append({"path": path, "parts": parts, "rows": sum(p["rows"] for p in parts), "bytes": sum(p["bytes"] for p in parts), "version": version, "columns": group})
            return m

        return self._commit(change)

    def transact(self, inserts: DataFrame | None = None, deletes: DataFrame | None = None, check: bool = True) -> dict:
        """Delete by keys and insert in one commit. ValueError, and nothing done, if an inserted row shares a unique key
        with another or with a row that is not deleted."""

        def change(m: dict) -> dict | None:
            gone, rest = None, self._visible(m, m["version"])
            if deletes is not None:
                gone = cut(self._hit(m, rest, deletes, None).select(RID))
                rest = rest.join(gone, RID, "left_anti")
            new = None if inserts is None else cut(inserts) if check and m["unique"] else inserts
            if new is not None and check:
                self._refuse_clash(m, new, rest)
            return self._apply(m, new, gone)

        return self._commit(change)

    def begin(self) -> Transaction:
        return Transaction(self)

    def clear(self) -> dict:
        return self._commit(lambda m: m | {"segments": [], "tombstones": [], "overlays": [], "oldest": m["version"] + 1})

    # segments

    def compact(self, segments: Sequence[int] | None = None, renumber: bool = False) -> dict:
        """Write segments (all by default) as one frozen segment, sorted by key. With history, rows that a kept version
        still sees stay with their tombstones; without, deleted rows go for good and in-place changes are merged.
        ``renumber`` gives dense ids and ends the history."""

        def change(m: dict) -> dict | None:
            pick = [m["segments"][k] for k in (segments if segments is not None else range(len(m["segments"])))]
            if not pick:
                return None
            version = m["version"] + 1
            keep_history = m["history"] and not renumber
            rows = self._files(pick, self._stored(m)) if keep_history else self._visible(m, m["version"], pick)
            if renumber:
                if len(pick) != len(m["segments"]):
                    raise ValueError("renumbering takes all segments")
                rows = numbered(rows, [F.col(RID).asc()], "__new").withColumn(RID, F.col("__new")).drop("__new").select(RID, INSERTED, *[c for c in rows.columns if c not in (RID, INSERTED)])
            order = [*map(F.col, m["order"]), F.col(RID)]
            new = self._segments(m, rows.repartitionByRange(*order).sortWithinPartitions(*order), "frozen", version)
            left = [s for s in m["segments"] if s not in pick]
            m["segments"] = [*left, *new]
            if not keep_history:
                m["oldest"] = version
                if not left:
                    m["tombstones"], m["overlays"] = [], []
            if renumber:
                m["next_rid"] = sum(s["rows"] for s in new)
            return m

        return self._commit(change)

    def purge(self) -> dict:
        """Remove deleted rows for good, ids kept; older versions can no longer be read."""
        self._commit(lambda m: m | {"history": False})
        return self.compact()

    def maintain(self, **policy) -> str:
        """One step of the compaction policy; returns what was done. One job counts the deleted rows of all segments."""
        m = self.manifest()
        gone, dead = self._gone(m, m["version"]), {}
        if gone is not None and m["segments"]:
            at = F.regexp_extract("_metadata.file_path", r"([^/]+)/([^/]+)$", 0).alias("at")
            files = self.spark.read.schema(self._stored(m)).parquet(*[self.files.path(f"{s['path']}/{p['name']}") for s in m["segments"] for p in s["parts"]])
            dead = {r[0]: r[1] for r in files.select(RID, at).join(gone, RID, "left_semi").groupBy("at").count().collect()}
        state = [s | {"deleted": sum(dead.get(f"{s['path']}/{p['name']}", 0) for p in s["parts"])} for s in m["segments"]]
        action, which = next_action(state, **policy)
        if action == "purge":
            self.purge()
        elif action != "none":
            self.compact(which)
        return action

    def vacuum(self, keep_seconds: float = 3600, abandoned_seconds: float = 7 * 86400) -> int:
        """Remove manifests that were replaced over ``keep_seconds`` ago, and files that no manifest names; returns how many
        files and folders went.

        Files of a commit under way are marked and stay, unless the mark is older than ``abandoned_seconds``. They are
        listed first, then the marks, then the manifests, so that a commit that ends meanwhile is seen by one of them."""
        now = time.time()
        folders = [n for n, (is_dir, _, _) in self.files.list().items() if is_dir and n.startswith(("seg-", "del-", "set-"))]
        marks = {n: at for n, (_, _, at) in self.files.list().items() if n.startswith(".writing-")}
        writing = {n.removeprefix(".writing-") for n, at in marks.items() if now - at <= abandoned_seconds}
        kept = {v: self.manifest(v) for v in self.versions()}
        numbers = sorted(kept)
        old = [v for v, after in zip(numbers, numbers[1:]) if now - kept[after]["time"] > keep_seconds]
        for v in old:
            self.files.remove(f"manifest-{v:010d}.json")
        named = {e["path"] for v in numbers if v not in old for k in ("segments", "tombstones", "overlays") for e in kept[v][k]}
        loose = [n for n in folders if n not in named and n not in writing]
        for n in loose:
            self.files.remove(n)
            self.files.remove(f".writing-{n}")
        return len(loose) + len(old)


def _value(v):
    return F.expr(v) if isinstance(v, str) else v


class Transaction:
    """Changes of one session by the table's unique key: own changes are seen at once by it alone, and commit or rollback
    ends it. Commit fails with CommitConflict, and changes nothing, if since the start another writer has changed a row of
    a key that this session changed (the first committer wins)."""

    def __init__(self, store: Store):
        self.store, m = store, store.manifest()
        self.key, self.start = store._key(m), m["version"]
        self.unit = mutate.UnitOfWork(store.read(self.start), self.key)
        self.touched: DataFrame | None = None

    def _touch(self, keys: DataFrame) -> None:
        keys = keys.select(*self.key)
        self.touched = keys if self.touched is None else self.touched.unionAll(keys)

    def insert(self, rows: DataFrame) -> None:
        self.unit.insert(rows)
        self._touch(rows)

    def delete(self, keys: DataFrame) -> None:
        self.unit.delete(keys)
        self._touch(keys)

    def upsert(self, rows: DataFrame, seq: str) -> None:
        last = mutate._last(rows, self.key, seq)
        self.delete(last)
        self.insert(last)

    def rows(self) -> DataFrame:
        return self.unit.view()

    def rollback(self) -> None:
        self.unit.rollback()
        self.touched = None

    def commit(self) -> dict:
        """One commit of all changes; ValueError if they break the unique key."""
        if self.touched is None:
            return self.store.manifest()
        touched, new, deleted = cut(self.touched.distinct()), self.unit.inserted, self.unit.deleted

        def change(m: dict) -> dict | None:
            if m["version"] != self.start and self.store.changes(self.start).join(touched, self.key, "left_semi").limit(1).count():
                raise CommitConflict("a row of this transaction was changed by another writer")
            rest = self.store._visible(m, m["version"])
            gone = None if deleted is None else cut(self.store._hit(m, rest, deleted, self.key).select(RID))
            fresh = None if new is None else cut(new)
            if fresh is not None:
                self.store._refuse_clash(m, fresh, rest if gone is None else rest.join(gone, RID, "left_anti"))
            return self.store._apply(m, fresh, gone)

        out = self.store._commit(change)
        self.rollback()
        return out


class Catalog:
    """Tables in the subfolders of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Files(spark, folder)

    def create_table(self, name: str, schema: T.StructType | TableDef, unique: Sequence[Sequence[str]] = (), **options) -> Store:
        return Store.create(self.spark, self.files.path(name), schema, unique, **options)

    def open_table(self, name: str) -> Store:
        return Store.open(self.spark, self.files.path(name))

    def drop_table(self, name: str) -> None:
        self.open_table(name).drop()

    def list_tables(self) -> list[str]:
        folders = [n for n, (is_dir, _, _) in self.files.list().items() if is_dir]
        return sorted(n for n in folders if any(f.startswith("manifest-") for f in self.files.list(n)))
