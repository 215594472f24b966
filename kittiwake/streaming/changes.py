"""Change files as a stream, applied to a table exactly once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kittiwake.sources.store import Store


def change_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None, bytes_per_batch: str | None = None) -> DataFrame:
    """Parquet change files of a folder as they arrive; the limits throttle what one batch takes."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        r = r.option("maxBytesPerTrigger", bytes_per_batch)
    return r.parquet(folder)


def apply_stream(changes: DataFrame, store: Store, seq: str, checkpoint: str, key: Sequence[str] | None = None, op: str | None = None, name: str = "changes") -> StreamingQuery:
    """Upsert every batch of a change stream into a table until what is there is used up.

    The batch number is committed with the rows, so a batch that is run again after a failure changes nothing. ``op``: a
    column that marks deletions with ``delete``. A change replaces a row only if its ``seq`` is the largest of its key in
    the batch; streams deliver a key's changes in order of batches."""
    own = [f.name for f in store.schema()]

    def put(batch: DataFrame, number: int) -> None:
        keys = list(key or store.manifest()["unique"][0])
        m = store.manifest()
        if m["applied"].get(name, -1) >= number:
            return
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), seq).alias("r")).select("r.*")
        new, gone = (last, None) if op is None else (last.where(F.col(op) != "delete"), last.where(F.col(op) == "delete").select(*keys))
        apply_batch(store, new.select(*own), last.select(*keys) if gone is not None else new.select(*keys), keys, (name, number))

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_batch(store: Store, new: DataFrame, touched: DataFrame, key: Sequence[str], applied: tuple[str, int]) -> dict:
    """One commit: rows of the touched keys go, the new ones come, the batch number is noted."""

    def change(m: dict) -> dict | None:
        if m["applied"].get(applied[0], -1) >= applied[1]:
            return None
        gone = store._visible(m, m["version"]).join(touched.distinct(), list(key), "left_semi").select("__rid")
        out = store._apply(m, new, gone) or m
        out["applied"][applied[0]] = applied[1]
        return out

    return store._commit(change)


def replay(source: Store, target: Store, key: Sequence[str] | None = None, name: str = "replay") -> dict:
    """Bring a copy up to the source's newest version from the source's change feed."""
    keys = list(key or target.manifest()["unique"][0])
    done = target.manifest()["applied"].get(name, -1)
    upto = source.manifest()["version"]
    feed = source.changes(max(done, 0) if done >= 0 else -1, upto)
    live = source.read(upto)
    touched = feed.select(*keys).distinct()
    return apply_batch(target, live.join(touched, keys, "left_semi").select(*live.columns), touched, keys, (name, upto))
