"""Processing only new or changed records.

A ledger keeps the sequence numbers that were processed as disjoint closed intervals. A run subtracts them from what is
available, processes the gaps (late commits included) and commits the merged intervals in the same step that makes its
output visible. A run that fails or is killed commits nothing, so its gaps are processed by the next one.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kittiwake.sources.files import Files


class Intervals:
    """Disjoint, sorted closed intervals of integers; neighbours are merged. Immutable."""

    def __init__(self, pairs: Iterable[tuple[int, int]] = ()):
        merged: list[list[int]] = []
        for lo, hi in sorted((int(a), int(b)) for a, b in pairs if a <= b):
            if merged and lo <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        self.pairs = tuple((a, b) for a, b in merged)

    def __or__(self, other: Intervals) -> Intervals:
        return Intervals([*self.pairs, *other.pairs])

    def __sub__(self, other: Intervals) -> Intervals:
        left, cuts, k = [], other.pairs, 0
        for lo, hi in self.pairs:
            while k < len(cuts) and cuts[k][1] < lo:
                k += 1
            at, j = lo, k
            while j < len(cuts) and cuts[j][0] <= hi:
                if cuts[j][0] > at:
                    left.append((at, cuts[j][0] - 1))
                at = max(at, cuts[j][1] + 1)
                j += 1
            if at <= hi:
                left.append((at, hi))
        return Intervals(left)

    def __contains__(self, n: int) -> bool:
        k = bisect_right(self.pairs, (n, float("inf"))) - 1
        return k >= 0 and self.pairs[k][0] <= n <= self.pairs[k][1]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Intervals) and self.pairs == other.pairs

    def __hash__(self) -> int:
        return hash(self.pairs)

    def __bool__(self) -> bool:
        return bool(self.pairs)

    def __repr__(self) -> str:
        return f"Intervals({list(self.pairs)})"

    def covers(self, value: Column) -> Column:
        """Predicate that reaches the scan as range filters."""
        found = F.lit(False)
        for lo, hi in self.pairs:
            found = found | value.between(lo, hi)
        return found


@dataclass(frozen=True)
class Gap:
    """Interval ``lo..hi`` that the run at position ``order`` had to process."""

    lo: int
    hi: int
    run: int
    order: int


def gaps_of_runs(runs: Iterable[tuple[int, int | None, str | None]], first: int = 1) -> list[Gap]:
    """Gaps of every successful run, from (run, last available number, status) in any order.

    Only status ``ok`` commits. A run without a number had nothing to see. Runs whose gap is empty have no entry.
    """
    done, gaps = Intervals(), []
    for order, (run, upto, status) in enumerate(sorted(runs, key=lambda r: r[0])):
        if status != "ok" or upto is None:
            continue
        seen = Intervals([(first, int(upto))])
        gaps += [Gap(lo, hi, run, order) for lo, hi in (seen - done).pairs]
        done = done | seen
    return sorted(gaps, key=lambda g: g.lo)


_CASES = 512


def label_by_gap(value: Column, gaps: list[Gap]) -> Column:
    """Position of the run in whose gap ``value`` falls, null outside; a balanced CASE tree, or Arrow search beyond
    ``_CASES`` gaps."""
    if len(gaps) <= _CASES:

        def tree(part: list[Gap]) -> Column:
            if not part:
                return F.lit(None).cast("int")
            if len(part) == 1:
                return F.when(value.between(part[0].lo, part[0].hi), F.lit(part[0].order)).cast("int")
            mid = len(part) // 2
            return F.when(value < part[mid].lo, tree(part[:mid])).otherwise(tree(part[mid:]))

        return tree(gaps)
    lo, hi, order = (np.array([getattr(g, k) for g in gaps], dtype="int64") for k in ("lo", "hi", "order"))

    @F.pandas_udf(T.IntegerType())
    def search(v: pd.Series) -> pd.Series:
        known = v.notna().to_numpy()
        n = v.fillna(0).to_numpy().astype("int64")
        k = np.clip(np.searchsorted(lo, n, side="right") - 1, 0, None)
        return pd.Series(order[k]).where(known & (n >= lo[k]) & (n <= hi[k])).astype("Int32")

    return search(value)


def new_versions_by_run(feed: DataFrame, runs: DataFrame, *, seq: str, key: str, version: str, run: str = "run_id", upto: str = "upto_batch", status: str = "status") -> DataFrame:
    """For every successful run the newest version of each key in the run's gaps that is newer than all that earlier
    successful runs processed: columns (run, key, version).

    Rows with a null sequence number, key or version belong to no run. Repeated rows count once. Empty tables give no
    rows. Other columns of ``feed`` are not read. The ledger (one row a run, independent of the feed) is read on the
    driver; the feed is scanned once, combined before the shuffle, so that one key with a third of all rows costs no
    more than one row a run and task.
    """
    ledger = runs.select(F.col(run).cast("long"), F.col(upto).cast("long"), F.col(status)).where(F.col(run).isNotNull()).distinct().collect()
    gaps = gaps_of_runs([tuple(r) for r in ledger])
    ids = [r for _, r in sorted({(g.order, g.run) for g in gaps})]
    orders = {o: k for k, o in enumerate(sorted({g.order for g in gaps}))}
    gaps = [Gap(g.lo, g.hi, g.run, orders[g.order]) for g in gaps]
    n, k, v = (feed[x] for x in (seq, key, version))
    top = max((g.hi for g in gaps), default=0)
    rows = feed.where(n.between(1, top) & k.isNotNull() & v.isNotNull()).select(k.alias("_k"), v.alias("_v"), label_by_gap(n, gaps).alias("_o")).where(F.col("_o").isNotNull())
    newest = rows.groupBy("_k", "_o").agg(F.max("_v").alias("_v"))
    before = Window.partitionBy("_k").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    fresh = newest.withColumn("_b", F.max("_v").over(before)).where(F.col("_b").isNull() | (F.col("_b") < F.col("_v")))
    run_id = F.element_at(F.array(*[F.lit(i).cast("long") for i in ids]), F.col("_o") + 1) if ids else F.lit(None).cast("long")
    return fresh.select(run_id.alias(run), F.col("_k").alias(key), F.col("_v").alias(version))


class Ledger:
    """Processed intervals and outputs of a sync job in one folder of a shared file system.

    Every commit is a file ``state-<version>.json`` that names all intervals and output folders and is created once and
    whole, so that intervals and output become visible together and of two runs on one version the later always fails.
    Output of an unfinished run is never named and so never read.
    """

    def __init__(self, folder: str, spark: SparkSession | None = None):
        self.files = Files(spark or SparkSession.active(), folder)
        self.files.make()

    def state(self) -> dict:
        found = max((n for n in self.files.list() if n.startswith("state-")), default=None)
        return json.loads(self.files.read(found)) if found else {"version": 0, "done": [], "outputs": []}

    def done(self) -> Intervals:
        return Intervals(self.state()["done"])

    def run(self, feed: DataFrame, seq: str, available: Intervals, process: Callable[[DataFrame], DataFrame] = lambda new: new) -> Intervals:
        """Process the rows whose ``seq`` lies in ``available`` and was not processed; returns the gaps committed.

        Nothing is written if there is no gap. An exception leaves the ledger as it was; if another run committed in the
        meantime, this one raises RuntimeError and has changed nothing.
        """
        state = self.state()
        gap = available - Intervals(state["done"])
        if not gap:
            return gap
        out = f"run-{state['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        process(feed.where(gap.covers(feed[seq]))).write.parquet(self.files.path(out))
        self._commit(state, (Intervals(state["done"]) | gap), out)
        return gap

    def _commit(self, state: dict, done: Intervals, out: str) -> None:
        new = {"version": state["version"] + 1, "done": list(done.pairs), "outputs": [*state["outputs"], out]}
        try:
            self.files.publish(f"state-{new['version']:010d}.json", json.dumps(new))
        except FileExistsError:
            self.files.remove(out)
            raise RuntimeError("another run committed first; run again") from None

    def output(self, spark: SparkSession) -> DataFrame | None:
        """Rows of all committed runs, or None if there is none."""
        outs = [self.files.path(o) for o in self.state()["outputs"]]
        return spark.read.parquet(*outs) if outs else None
