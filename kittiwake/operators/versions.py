"""Versions, segments and record ids of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kittiwake.operators.scan import live, numbered

NEVER = 2**63 - 1


def as_of(rows: DataFrame, version: int, inserted: str = "__ins_ver", deleted: str = "__del_ver") -> DataFrame:
    """Rows that a snapshot of ``version`` sees: inserted by then and deleted only after it."""
    return rows.where((F.col(inserted) <= version) & (F.coalesce(F.col(deleted), F.lit(NEVER)) > version))


def merge(segments: Sequence[DataFrame], deleted: str | None = None) -> DataFrame:
    """Adjacent segments as one, without the rows marked as deleted; ids are kept."""
    return live(reduce(lambda a, b: a.unionByName(b), segments), deleted)


def purge(rows: DataFrame, deleted: Column | str) -> DataFrame:
    """Rows that stay when deleted ones are removed for good; ids are kept."""
    return live(rows, deleted)


def compact_ids(rows: DataFrame, rid: str, deleted: Column | str | None = None, name: str = "new_rid") -> DataFrame:
    """Live rows with new dense ids in the order of the old ones."""
    return numbered(live(rows, deleted), [F.col(rid).asc()], name)


def logical_ids(physical: DataFrame, rid: str, name: str = "physical_id") -> DataFrame:
    """Dense physical position of every row that is left, beside its record id."""
    return numbered(physical.select(rid), [F.col(rid).asc()], name)


def next_action(segments: Sequence[dict], *, merge_least: int = 5, purge_share: float = 0.1, large: int = 1 << 30) -> tuple[str, list[int]]:
    """What compaction does next and to which segments: convert a plain one, merge small neighbours, convert a large
    one, merge read-only ones, purge, or nothing. segments: dicts with kind (delta or frozen), bytes, rows, deleted."""
    plain = [k for k, s in enumerate(segments) if s["kind"] == "delta"]
    small = [k for k in plain if s_bytes(segments[k]) < large]
    if small and len(small) < merge_least:
        return "convert", small[:1]
    if len(small) >= merge_least:
        return "merge", small
    if plain:
        return "convert", plain[:1]
    frozen = [k for k, s in enumerate(segments) if s["kind"] == "frozen" and s_bytes(s) < large]
    if len(frozen) >= merge_least:
        return "merge", frozen
    full = [k for k, s in enumerate(segments) if s["rows"] and s["deleted"] / s["rows"] >= purge_share]
    return ("purge", full[:1]) if full else ("none", [])


def s_bytes(segment: dict) -> int:
    return int(segment.get("bytes", 0))
