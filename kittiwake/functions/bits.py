"""Checksums, integer codings and bit vectors over columns."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kittiwake.operators.scan import numbered

CASTAGNOLI = 0x82F63B78


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    """Remainders of all bytes, from the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1)
    return t


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of bytes; all rows of a batch advance together, byte by byte. Null stays null."""
    table, known = _crc_table(), data.notna().to_numpy()
    raw = [bytes(x) for x in data[known]]
    size = np.array([len(x) for x in raw], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    raw, length = [raw[k] for k in order], size[order]
    crc = np.full(len(raw), 0xFFFFFFFF, np.uint32)
    start = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(raw) else length
    flat = np.frombuffer(b"".join(raw), np.uint8)
    for k in range(int(length[0]) if len(raw) else 0):
        n = int(np.searchsorted(-length, -k, side="left"))
        crc[:n] = table[(crc[:n] ^ flat[start[:n] + k]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(raw), np.int64)
    out[order] = (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    full = pd.Series([None] * len(data), dtype="Int64")
    full[known] = out
    return full


def _placed(known: np.ndarray, parts: list) -> pd.Series:
    """The parts at the known places, None at the others."""
    out = np.full(len(known), None, object)
    for k, part in zip(np.nonzero(known)[0], parts):
        out[k] = part
    return pd.Series(out)


@F.pandas_udf(T.BinaryType())
def varint_encode(values: pd.Series) -> pd.Series:
    """Arrays of integers of at least 0 as 7-bit groups, the low one first; all numbers of a batch are coded together."""
    known = values.notna().to_numpy()
    arrays = [np.asarray(v, np.uint64) for v in values[known]]
    size = np.array([len(a) for a in arrays], np.int64)
    n = np.concatenate(arrays) if len(arrays) else np.zeros(0, np.uint64)
    groups = np.stack([(n >> np.uint64(7 * k)) & np.uint64(0x7F) for k in range(10)], axis=1).astype(np.uint8)
    width = np.maximum(1, 10 - np.argmax(groups[:, ::-1] > 0, axis=1)) * (n > 0) + (n == 0)
    at = np.arange(10)
    groups[at[None, :] < width[:, None] - 1] |= 0x80
    flat = groups[at[None, :] < width[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(size)])]
    return _placed(known, [flat[a:b] for a, b in zip(ends, ends[1:])])


@F.pandas_udf(T.ArrayType(T.LongType()))
def varint_decode(data: pd.Series) -> pd.Series:
    """The arrays of such bytes; what follows the last whole number is left out."""
    known = data.notna().to_numpy()
    raw = [bytes(b) for b in data[known]]
    byte = np.frombuffer(b"".join(raw), np.uint8)
    row = np.repeat(np.arange(len(raw)), [len(b) for b in raw])
    last = byte < 0x80
    # numbers end at such a byte, and at the end of their row
    start = np.concatenate([[True], last[:-1] | (row[1:] != row[:-1])]) if len(byte) else np.zeros(0, bool)
    number = np.cumsum(start) - 1
    begin = np.nonzero(start)[0]
    shift = 7 * (np.arange(len(byte)) - begin[number]) if len(byte) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        n = np.bitwise_or.reduceat((byte & 0x7F).astype(np.uint64) << shift.astype(np.uint64), begin).view(np.int64) if len(begin) else np.zeros(0, np.int64)
    whole = last[np.concatenate([begin[1:], [len(byte)]]) - 1] if len(begin) else np.zeros(0, bool)
    per_row = np.bincount(row[begin][whole], minlength=len(raw)) if len(begin) else np.zeros(len(raw), np.int64)
    return _placed(known, np.split(n[whole], np.cumsum(per_row)[:-1]) if len(raw) else [])


def deltas(values: Column) -> Column:
    """First value and differences of an array."""
    return F.transform(values, lambda v, k: F.when(k == 0, v).otherwise(v - F.element_at(values, k)))


def undeltas(values: Column) -> Column:
    """The array whose differences these are."""
    return _running_sums(values)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _running_sums(values: pd.Series) -> pd.Series:
    """All arrays of a batch summed at once, each from its own start."""
    known = values.notna().to_numpy()
    arrays = [np.asarray(v, np.int64) for v in values[known]]
    size = np.array([len(a) for a in arrays], np.int64)
    with np.errstate(over="ignore"):
        total = np.cumsum(np.concatenate(arrays)) if len(arrays) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        before = np.concatenate([[0], total])[ends - size]
        total = total - np.repeat(before, size)
    return _placed(known, np.split(total, ends[:-1]) if len(arrays) else [])


def with_rank(rows: DataFrame, order: list[Column], bit: Column, name: str = "rank1") -> DataFrame:
    """Rows with the number of set bits before them in a total order; unset rows have a null rank. Selecting the k-th
    set bit is a filter on the rank."""
    ones = numbered(rows.where(bit), order, name)
    zeros = rows.where(~F.coalesce(bit, F.lit(False))).withColumn(name, F.lit(None).cast("long"))
    return ones.unionByName(zeros)


def popcount(value: Column) -> Column:
    return F.bit_count(value)
