"""Duplicates hidden by formatting differences.

Records are brought to a canonical key, range-partitioned and sorted by (key, id), and adjacent rows are compared by
their whole keys. A run that crosses partitions is stitched by the edges of the partitions, so that a key with a third of
all rows is spread over as many partitions as its size needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kittiwake.runtime import cut

WORD = r"[\p{L}\p{N}]+"


def word_bag(text: Column) -> Column:
    """Words in lower case, sorted, each as often as it occurs; '' without words, null for null."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))), " ")


def letters(text: Column) -> Column:
    """Letters and digits in lower case, in their order; null for null."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def person_key(name: Column, email: Column) -> Column:
    """Canonical key of a record, null if name or email has no word."""
    n, e = word_bag(name), letters(email)
    return F.when((n != "") & (e != ""), F.concat(n, F.lit("\n"), e))


class SortedRuns:
    """Canonical records in key order.

    ``key``: a string Column, rows with a null key take no part. ``id_column``: a bigint, rows without one are counted
    but never represent a run unless it has no other. The sorted rows are kept in the shared folder; each partition
    then is one stream of batches.
    """

    def __init__(self, rows: DataFrame, key: Column, id_column: str = "id"):
        keyed = rows.select(key.alias("key"), rows[id_column].cast("long").alias("id")).where(F.col("key").isNotNull())
        # kept, so that the range sample and the sort read keys instead of making them again
        keyed = cut(keyed)
        order = [F.col("key").asc(), F.col("id").asc_nulls_last()]
        self.spark = rows.sparkSession
        self.rows = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
        # two short rows a partition
        edges = self.rows.mapInArrow(_edges, "part int, first string, first_id long, first_rows long, last string, last_id long, last_rows long, whole boolean")
        self.carried, self.crossing = _stitch(edges.collect())

    def members(self) -> DataFrame:
        """(first_id, id) for every row whose id is not the smallest of its run; distinct."""
        return self.rows.mapInArrow(_members(self.carried), "first_id long, id long")

    def counts(self) -> DataFrame:
        """(first_id, copies) for every run: its smallest id and the exact number of its rows."""
        inside = self.rows.mapInArrow(_inner_counts, "first_id long, copies long")
        return inside.unionAll(self.spark.createDataFrame(self.crossing, "first_id long, copies long").coalesce(1))


def _mark(key: str) -> str:
    """The key itself, or length and SHA-256 of one over 1 KiB, for comparing edges on the driver."""
    return key if len(key) <= 1024 else f"{len(key)} {hashlib.sha256(key.encode()).hexdigest()}"


def _starts(keys: pa.Array, last: str | None) -> np.ndarray:
    """True where a run begins; ``last`` is the key before the batch."""
    new = np.ones(len(keys), bool)
    if len(keys) > 1:
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    new[0] = keys[0].as_py() != last
    return new


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, runs, first, current = None, None, 0, None, None
    for b in batches:
        if not b.num_rows:
            continue
        keys, ids = b.column(0), b.column(1)
        part = b.column(2)[0].as_py()
        at = np.nonzero(_starts(keys, last))[0]
        head = int(at[0]) if len(at) else b.num_rows
        if current:
            current[2] += head
        for k, begin in enumerate(at):
            end = int(at[k + 1]) if k + 1 < len(at) else b.num_rows
            runs += 1
            if runs == 2:
                first = current
            if k + 1 == len(at) or runs == 1:
                current = [keys[int(begin)].as_py(), ids[int(begin)].as_py(), end - int(begin)]
        last = keys[-1].as_py()
    if current:
        first = first or current
        row = [part, _mark(first[0]), first[1], first[2], _mark(current[0]), current[1], current[2], runs == 1]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["part", "first", "first_id", "first_rows", "last", "last_id", "last_rows", "whole"])


def _stitch(edges: list) -> tuple[dict[int, int | None], list[tuple[int | None, int]]]:
    """Smallest id of the run that each partition continues, and the counts of all runs at an edge."""
    carried: dict[int, int | None] = {}
    runs: list[list] = []
    for e in sorted(edges, key=lambda e: e["part"]):
        if runs and runs[-1][0] == e["first"]:
            carried[e["part"]] = runs[-1][1]
            runs[-1][2] += e["first_rows"]
        else:
            runs.append([e["first"], e["first_id"], e["first_rows"]])
        if not e["whole"]:
            runs.append([e["last"], e["last_id"], e["last_rows"]])
    return carried, [(i, n) for _, i, n in runs]


def _members(carried: dict[int, int | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first_id, last_id = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, ids = b.column(0), b.column(1)
            new = _starts(keys, last)
            if last is None and (part := b.column(2)[0].as_py()) in carried:
                new[0], first_id = False, carried[part]
            n = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
            firsts = np.where(at >= 0, n[np.maximum(at, 0)], first_id if first_id is not None else -(2**63))
            again = np.concatenate([[not new[0] and n[0] == last_id], ~new[1:] & (n[1:] == n[:-1])])
            keep = (at != np.arange(len(n))) & (n != firsts) & ~again & (n != -(2**63))
            yield pa.RecordBatch.from_arrays([pa.array(firsts[keep]), pa.array(n[keep])], names=["first_id", "id"])
            last, first_id, last_id = keys[-1].as_py(), int(firsts[-1]), n[-1]

    return run


def _inner_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the runs that touch neither edge of the partition."""
    last, seen, open_id, open_rows = None, 0, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys, ids = b.column(0), b.column(1)
        at = np.nonzero(_starts(keys, last))[0]
        open_rows += int(at[0]) if len(at) else b.num_rows
        out_ids, out_rows = [], []
        if len(at):
            if seen > 1:
                out_ids.append(open_id)
                out_rows.append(open_rows)
            # the first run of all, and the one still open, are left out
            done = at[:-1] if seen else at[1:-1]
            sizes = np.diff(at) if seen else np.diff(at)[1:]
            out_ids += ids.take(pa.array(done)).to_pylist()
            out_rows += sizes.tolist()
            seen += len(at)
            open_id, open_rows = ids[int(at[-1])].as_py(), b.num_rows - int(at[-1])
        last = keys[-1].as_py()
        yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out_rows, pa.int64())], names=["first_id", "copies"])


def person_runs(users: DataFrame, name: str = "name", email: str = "email", id_column: str = "id") -> SortedRuns:
    """Users whose names have the same words in any order and whose emails have the same letters and digits.

    Users without a word in either field take no part. Empty tables give no rows, repeated rows are counted, very long
    texts are compared whole, other columns are not read."""
    return SortedRuns(users, person_key(users[name], users[email]), id_column)


def collapse_people(users: DataFrame, name: str = "name", email: str = "email", id_column: str = "id") -> DataFrame:
    """One record of every run, the row of its smallest id with all its columns, and ``copies``, the exact number of its rows.

    Users without a word in name or email are in no run. Of rows that repeat the smallest id one is taken; runs whose rows
    have no id are left out."""
    counts = person_runs(users, name, email, id_column).counts().where(F.col("first_id").isNotNull())
    own = users.where(users[id_column].isNotNull()).dropDuplicates([id_column])
    own = own.select(own[id_column].cast("long").alias("first_id"), F.struct(*[own[c] for c in own.columns]).alias("__row"))
    return own.join(counts, "first_id").select("__row.*", "copies")
