import math
import os

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kittiwake.llm.packing import TOKENIZER, _encoding, fill_containers, pack


@given(st.lists(st.integers(0, 100), max_size=200))
def test_pack_is_a_packing(sizes):
    s = np.array(sizes, dtype=int)
    at = pack(s, 100)
    if not len(s):
        return
    fill = np.bincount(at, weights=s)
    assert (at >= 0).all() and fill.max() <= 100 and len(np.unique(at)) == at.max() + 1
    large = np.bincount(at, weights=(3 * s > 100), minlength=at.max() + 1)
    assert large.max() <= 2
    # small items never open a container while one has room for them
    small = [int(x) for x in s if 3 * x <= 100]
    if small and len(fill) > large.sum() + 1:
        assert np.sort(fill[large == 0])[1] > 100 - max(small)


def test_little_space_is_left():
    rng = np.random.default_rng(3)
    s = np.concatenate([rng.integers(1, 300, 5000), rng.integers(700, 2048, 300)])
    at = pack(s, 2048)
    assert at.max() + 1 <= math.ceil(s.sum() / 2048) * 1.02 + 1


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
def test_every_document_once(spark):
    texts = ["", None, "<|endoftext|> is text", "word " * 700, "a b c"] + [f"row {k} of the log" for k in range(60)]
    docs = spark.createDataFrame([(k, x, 1, "clash") for k, x in enumerate(texts)] + [(7, texts[7], 1, "clash"), (None, "no id", 1, "clash")], "doc_id long, text string, shard int, container string")
    for options in ({}, {"items_per_shard": 9}):
        rows = fill_containers(docs, capacity=64, **options).collect()
        fill, pieces = {}, {}
        for r in rows:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
            pieces.setdefault(r.doc_id, []).append(r)
        assert max(fill.values()) <= 64 and set(pieces) == {*range(len(texts)), None} and len(pieces[7]) == 2
        long = sorted(pieces[3], key=lambda r: r.piece)
        n = len(_encoding(TOKENIZER).encode_ordinary(texts[3]))
        assert [r.tokens for r in long] == [64] * (n // 64) + [n % 64] * (n % 64 > 0) and [r.first_token for r in long] == [64 * k for k in range(len(long))]
        assert pieces[0][0].tokens == pieces[1][0].tokens == 0 and pieces[2][0].tokens > 3
    assert fill_containers(docs.limit(0)).count() == 0
    # the containers depend on the rows, not on how they lie
    place = lambda df: sorted((tuple(r) for r in fill_containers(df, capacity=64, items_per_shard=9).collect()), key=str)
    assert place(docs) == place(docs.repartition(7))
