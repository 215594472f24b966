"""Evaluation texts leaking into training text.

A positional inverted index of the corpus is stored in shards of whole documents, so that all postings of a document lie
in one row and a passage is found without moving any text. Test passages are sent to the shards: there the two rarest
words of every window are looked up, their lists intersected at their offset, and all words of the passage compared with
the lists. Where words may be moved or missing, as many pairs of the rarest words are looked up as it takes that no window
is lost.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kittiwake.llm.tokens import text_words
from kittiwake.runtime import shared_dir

_SHARD = "terms array<string>, term_ends binary, places binary, doc_ids binary, doc_ends binary"
_NAMES = ["terms", "term_ends", "places", "doc_ids", "doc_ends"]


def _index(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards: the terms, the end of each one's list, the lists of ascending places in the words of the shard, and the
        ids and ends of its documents."""
        terms: dict[str, int] = {}
        words, ids, ends = array("i"), [], []

        def shard() -> pa.RecordBatch:
            code = np.frombuffer(words, np.int32)
            lists = np.argsort(code, kind="stable").astype(np.int32)
            term_ends = np.cumsum(np.bincount(code, minlength=len(terms))).astype(np.int32)
            row = [list(terms), term_ends.tobytes(), lists.tobytes(), np.array(ids, np.int64).tobytes(), np.array(ends, np.int32).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.list_(pa.string()), *[pa.binary()] * 4))], names=_NAMES)

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = text_words(t)
                if not w:
                    continue
                if words and len(words) + len(w) > shard_words:
                    yield shard()
                    terms, words, ids, ends = {}, array("i"), [], []
                words.extend([terms.setdefault(x, len(terms)) for x in w])
                ids.append(d)
                ends.append(len(words))
        if words:
            yield shard()

    return run


class Shard:
    """One row of the index."""

    def __init__(self, row: list):
        self.terms = row[0]
        self.term_ends, self.places, self.doc_ids, self.doc_ends = (np.frombuffer(x, t) for x, t in zip(row[1:], (np.int32, np.int32, np.int64, np.int32)))
        self.doc_starts = np.concatenate([[0], self.doc_ends[:-1]])
        self.counts = np.diff(self.term_ends, prepend=0)

    def places_of(self, term: int) -> np.ndarray:
        return self.places[self.term_ends[term] - self.counts[term] : self.term_ends[term]]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for b in batches:
        for k in range(b.num_rows):
            yield Shard([pa.array(b.column(0)[k].values), *(b.column(c)[k].as_buffer() for c in range(1, 5))])


class PositionalIndex:
    """The stored index of a corpus, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def create(cls, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, shard_words: int = 1_000_000) -> PositionalIndex:
        """Index all documents with an id and a word, in shards of ``shard_words`` words (a longer document alone); without
        ``folder`` in one of its own under the session's."""
        spark = documents.sparkSession
        folder = folder or f"{shared_dir(spark).rstrip('/')}/positions-{uuid.uuid4().hex}"
        own = documents.where(documents[doc_id].isNotNull() & (documents[text] != "")).select(documents[doc_id].cast("long").alias("doc_id"), documents[text].alias("text"))
        own.mapInArrow(_index(shard_words), _SHARD).write.parquet(folder)
        return cls(spark, folder)

    def shards(self) -> DataFrame:
        return self.spark.read.schema(_SHARD).parquet(self.folder)

    def postings(self) -> DataFrame:
        """(term, doc_id, positions): where each term stands in each document, counted in words from 0."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in _shards(batches):
                term = np.repeat(np.arange(len(s.counts)), s.counts)
                doc = np.searchsorted(s.doc_ends, s.places, side="right")
                new = np.nonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]))[0]
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(term)).astype(np.int32)), pa.array((s.places - s.doc_starts[doc]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([s.terms.take(pa.array(term[new])), pa.array(s.doc_ids[doc[new]]), lists], names=["term", "doc_id", "positions"])

        return self.shards().mapInArrow(run, "term string, doc_id long, positions array<int>")

    def matches(self, items: list[tuple[int, list[str]]], min_words: int, slack: int, missing: int) -> DataFrame:
        """(item_id, doc_id, words) of test passages, one row a pair of a shard; they are broadcast."""
        vocabulary = sorted({x for _, w in items for x in w})
        code = {x: k for k, x in enumerate(vocabulary)}
        shared = self.spark.sparkContext.broadcast((vocabulary, [(i, np.array([code[x] for x in w], np.int32)) for i, w in items]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, passages = shared.value
            asked = pa.array(vocabulary, pa.string())
            for s in _shards(batches):
                term = pc.fill_null(pc.index_in(asked, value_set=s.terms), -1).to_numpy()
                for item, codes in passages:
                    docs, longest = passage_matches(s, term[codes], min_words, slack, missing)
                    if len(docs):
                        words = pa.nulls(len(docs), pa.int32()) if slack or missing else pa.array(longest.astype(np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item, np.int64)), pa.array(s.doc_ids[docs]), words], names=["item_id", "doc_id", "words"])

        return self.shards().mapInArrow(run, "item_id long, doc_id long, words int")


def _probes(present: np.ndarray, rank: np.ndarray, min_words: int, missing: int) -> set[tuple[int, int]]:
    """Pairs of places in a passage so that every window with at most ``missing`` words out of place has both words of one
    pair in place; windows with too few ``present`` words have none."""
    need, pairs = min_words - missing, set()
    there = np.concatenate([[0], np.cumsum(present)])
    spare = there[min_words:] - there[:-min_words] - need
    for s in np.nonzero(spare >= 0)[0]:
        # of the words that occur at all, so many may still be out of place: two of two more than that are not
        rarest = sorted((k for k in range(s, s + min_words) if present[k]), key=rank.__getitem__)[: spare[s] + 2]
        pairs.update(combinations(rarest, 2) if need > 1 else ((k, k) for k in rarest))
    return pairs


def passage_matches(s: Shard, term: np.ndarray, min_words: int, slack: int, missing: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard in which a window of a passage has all but ``missing`` words within ``slack`` of their places,
    and the longest run of words that are; ``term``: the passage as terms of the shard, -1 where it has none."""
    none = np.zeros(0, int)
    if len(term) < min_words:
        return none, none
    present = term >= 0
    count = np.where(present, s.counts[term], 0)
    rank = np.empty(len(term), int)
    rank[np.lexsort((np.arange(len(term)), count))] = np.arange(len(term))
    starts, docs = [], []
    for j, k in _probes(present, rank, min_words, missing):
        at = s.places_of(term[j]).astype(np.int64)
        if j != k:
            other, low = s.places_of(term[k]), at + (k - j - 2 * slack)
            x = np.searchsorted(other, low)
            met = x < len(other)
            met[met] = other[x[met]] <= low[met] + 4 * slack
            at = at[met]
        if len(at):
            starts.append(at - j)
            docs.append(np.searchsorted(s.doc_ends, at, side="right"))
    if not starts:
        return none, none
    # where the passage would begin, or up to slack words from it, and in which document
    begin, doc = np.unique(np.stack([np.concatenate(starts), np.concatenate(docs)]), axis=1)
    if slack:
        around = np.arange(-slack, slack + 1)
        begin, doc = np.unique(np.stack([(begin[:, None] + around).ravel(), np.repeat(doc, len(around))]), axis=1)
    found, length = [], []
    step = max(1, 4_000_000 // len(term))
    for a in range(0, len(begin), step):
        b, d = begin[a : a + step], doc[a : a + step]
        fits = np.zeros((len(term), len(b)), bool)
        for k in np.nonzero(present)[0]:
            low, high = np.maximum(b + k - slack, s.doc_starts[d]), np.minimum(b + k + slack, s.doc_ends[d] - 1)
            own = s.places_of(term[k])
            x = np.searchsorted(own, low)
            met = x < len(own)
            met[met] = own[x[met]] <= high[met]
            fits[k] = met
        run, best = np.zeros(len(b), int), np.zeros(len(b), int)
        for row in fits:
            run = (run + 1) * row
            best = np.maximum(best, run)
        total = np.concatenate([np.zeros((1, len(b)), int), np.cumsum(fits, axis=0)])
        good = (total[min_words:] - total[:-min_words] >= min_words - missing).any(axis=0)
        found.append(d[good])
        length.append(best[good])
    found, length = np.concatenate(found), np.concatenate(length)
    order = np.lexsort((-length, found))
    found, length = found[order], length[order]
    first = np.concatenate([[True], found[1:] != found[:-1]]) if len(found) else np.zeros(0, bool)
    return found[first], length[first]


def leaks(documents: DataFrame | PositionalIndex, items: DataFrame, *, min_words: int = 12, slack: int = 0, missing: int = 0, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", prompt: str = "prompt", block_words: int = 1_000_000) -> DataFrame:
    """(item_id, doc_id, words): documents that hold at least ``min_words`` consecutive words of an item, with the
    longest such run; one row a pair. ``documents`` are indexed first, unless they are an index.

    With ``slack`` or ``missing`` the match is one of proximity: there is a place in the document at which all words of a
    window of ``min_words``, but for at most ``missing`` of them, stand within ``slack`` words of where the item has them,
    and ``words`` is null. A word of the document may stand for several equal ones of the window. Null and empty texts,
    prompts shorter than the window and null ids match nothing; copies of a document or item are all reported; of a
    repeated item id every prompt is matched; empty tables give no rows; other columns are not read. Texts are read whole.

    Items are broadcast in blocks of ``block_words`` words (a longer one alone); each block reads the index, not the texts.
    """
    if slack < 0 or not 0 <= missing < min_words:
        raise ValueError("slack must not be negative, missing must be less than min_words")
    index = documents if isinstance(documents, PositionalIndex) else PositionalIndex.create(documents, doc_id, text)
    results, part, held = [], [], 0
    own = items.where(items[item_id].isNotNull() & items[prompt].isNotNull()).select(items[item_id].cast("long"), items[prompt]).distinct()
    for r in own.toLocalIterator():
        w = text_words(r[1])
        if len(w) < min_words:
            continue
        if part and held + len(w) > block_words:
            results.append(index.matches(part, min_words, slack, missing))
            part, held = [], 0
        part.append((r[0], w))
        held += len(w)
    if part:
        results.append(index.matches(part, min_words, slack, missing))
    if not results:
        return index.spark.createDataFrame([], "item_id long, doc_id long, words int")
    out = results[0]
    for r in results[1:]:
        out = out.unionAll(r)
    # a repeated id has rows of several shards
    return out.groupBy("item_id", "doc_id").agg(F.max("words").alias("words"))
