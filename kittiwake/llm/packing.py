"""Filling fixed-capacity containers with documents.

Sizes are tokens of a public tokenizer. Documents above a third of the capacity are matched in pairs, at most two a
container, largest first with the largest that still fits; smaller ones go into the tightest remaining gap. Documents are
packed in shards of bounded size, and containers left too empty are packed once more across shards.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kittiwake.runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item; no item may exceed ``capacity``."""
    where = np.full(len(sizes), -1)
    order = np.argsort(-sizes, kind="stable")
    large = [int(k) for k in order if 3 * sizes[k] > capacity]
    gaps: list[int] = []
    # ascending sizes of the items not matched yet, with their numbers
    waiting = sorted((int(sizes[k]), k) for k in large)
    while waiting:
        size, k = waiting.pop()
        where[k], gap = len(gaps), capacity - size
        at = bisect_right(waiting, (gap, len(sizes))) - 1
        if at >= 0:
            other, j = waiting.pop(at)
            where[j], gap = len(gaps), gap - other
        gaps.append(gap)
    free = sorted((g, b) for b, g in enumerate(gaps) if g)
    for k in order[len(large) :]:
        size = int(sizes[k])
        at = bisect_left(free, (size, -1))
        if at == len(free):
            gap, b = capacity, len(gaps)
            gaps.append(gap)
        else:
            gap, b = free.pop(at)
        where[k] = b
        if gap - size:
            insort(free, (gap - size, b))
    return where


@lru_cache(maxsize=2)
def _encoding(path: str):
    """Byte-pair encoding of a file of ranks, without special tokens; kept by the worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(encode(text)) if text else 0
                out += [(i, k, k * capacity, min(capacity, n - k * capacity)) for k in range(max(1, math.ceil(n / capacity)))]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["doc_id", "piece", "first_token", "tokens"])

    return run


_PACKED = "shard long, container long, doc_id long, piece int, first_token long, tokens int, filled int"


def _pack_shard(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # the result depends on the items, not on the order in which they arrive
        pdf = pdf.sort_values(["doc_id", "piece", "tokens"]).reset_index(drop=True)
        at = pack(pdf["tokens"].to_numpy(), capacity)
        filled = np.bincount(at, weights=pdf["tokens"], minlength=at.max() + 1)
        return pdf.assign(container=at, filled=filled[at].astype("int32"))[["shard", "container", "doc_id", "piece", "first_token", "tokens", "filled"]]

    return run


def fill_containers(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = TOKENIZER, items_per_shard: int = 20_000, full_enough: float = 0.95) -> DataFrame:
    """(container_id, doc_id, piece, first_token, tokens): every document in a container of ``capacity`` tokens.

    A document longer than a container is cut into full pieces and a rest; no other is cut. Null and empty texts have 0
    tokens and one row; repeated rows are packed as often as they occur; empty tables give no rows; texts are read whole.
    Containers filled below ``full_enough`` in their shard are packed again, in shards of their own.
    """
    items = cut(documents.select(documents[doc_id].cast("long").alias("doc_id"), documents[text].alias("text")).mapInArrow(_pieces(tokenizer, capacity), "doc_id long, piece int, first_token long, tokens int"))
    full = items.where(F.col("tokens") == capacity)
    rest = items.where(F.col("tokens") < capacity)
    shards = max(1, math.ceil(rest.count() / items_per_shard))
    # spread by every column and the number of the copy, so that a repeated row cannot fill one shard and the result
    # depends on the rows alone
    counted = rest.groupBy("doc_id", "piece", "first_token", "tokens").agg(F.count("*").cast("int").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "tokens", "copy"), F.lit(shards))
    once = cut(counted.withColumn("shard", spread).drop("copies", "copy").groupBy("shard").applyInPandas(_pack_shard(capacity), _PACKED))
    good = once.where(F.col("filled") >= full_enough * capacity)
    open_ = once.where(F.col("filled") < full_enough * capacity)
    again = max(1, math.ceil(open_.count() / items_per_shard))
    anew = open_.select(F.pmod(F.xxhash64("shard", "container"), F.lit(again)).alias("shard"), "doc_id", "piece", "first_token", "tokens").groupBy("shard").applyInPandas(_pack_shard(capacity), _PACKED)
    columns = ["doc_id", "piece", "first_token", "tokens"]
    name = lambda kind: F.format_string(f"{kind}-%d-%d", "shard", "container").alias("container_id")
    whole = full.select(F.format_string("f-%d-%d", "doc_id", "piece").alias("container_id"), *columns)
    return good.select(name("a"), *columns).unionAll(anew.select(name("b"), *columns)).unionAll(whole)
