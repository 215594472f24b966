"""Repetition inside single documents, and perplexity under a counted n-gram model.

``repeated_share`` measures each document against its own past: sorted hash arrays of its n-grams give the runs that occurred
before, without any shuffle. ``perplexity_bands`` counts a modified Kneser-Ney trigram model over the whole corpus, language by
language, stores it in sorted hash arrays, looks all trigrams up there, and rejects documents outside their language's band.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kittiwake.llm.tokens import text_words
from kittiwake.runtime import cut

_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """64-bit hashes of words; a cache of at most a million words, emptied when full."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 1_000_000:
            self.known.clear()
        out = np.empty(len(words), np.uint64)
        for k, w in enumerate(words):
            h = self.known.get(w)
            if h is None:
                h = self.known[w] = xxhash.xxh3_64_intdigest(w)
            out[k] = h
        return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ words[k : k + len(h)]) * _MIX
            h ^= h >> np.uint64(29)
    return h


def exact_repeats(words: list[str], n: int) -> int:
    """Runs of ``n`` words that occurred earlier, comparing the words themselves."""
    runs = max(0, len(words) - n + 1)
    return runs - len(set(zip(*(words[k:] for k in range(n))))) if runs else 0


def repeated_share(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, least_words: int = 20, above: float | None = None) -> DataFrame:
    """(doc_id, words, repeated, share): runs of ``n`` words that occurred earlier in the same text, over all its runs.

    share is null under ``least_words`` words. With ``above`` only documents with a greater share come out: the sorted
    hash array of a text, in which equal runs can only add to the count, proposes them, and the words decide. Every row
    is judged alone, so copies and repeated ids each come out; null texts have 0 words; texts are read whole; no data
    moves between tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = text_words(t)
                runs = len(w) - n + 1
                judged = len(w) >= least_words and runs > 0
                if above is not None:
                    if not judged:
                        continue
                    distinct = len(np.unique(gram_hashes(hashes.of(w), n)))
                    if runs - distinct <= above * runs:
                        continue
                again = exact_repeats(w, n)
                if above is None or again > above * runs:
                    out.append((d, len(w), again, again / runs if judged else None))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "words", "repeated", "share"])

    return documents.select(documents[doc_id].cast("long").alias("doc_id"), documents[text].alias("text")).mapInArrow(run, "doc_id long, words int, repeated int, share double")


def language(lang: Column) -> Column:
    """First two letters a to z in lower case, 'und' where there are none: at most 677 values."""
    two = F.regexp_extract(F.lower(F.coalesce(lang, F.lit(""))), r"^\s*([a-z]{2})", 1)
    return F.when(two == "", "und").otherwise(two)


#: Words of a shard of coded texts; a longer text is a shard of its own.
_SHARD_WORDS = 1_000_000
_CODED = "doc_ids binary, doc_ends binary, doc_langs binary, langs array<string>, codes binary, hashes binary"


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers of words, in shards of whole documents with the hash of each word; the same word of two languages
    is two words."""
    names = [f.split()[0] for f in _CODED.split(", ")]
    known: dict[str, dict[str, int]] = {}
    codes, hashes, ids, ends, langs = array("i"), array("Q"), [], [], []

    def shard() -> pa.RecordBatch:
        order = {x: k for k, x in enumerate(known)}
        row = [np.array(ids, np.int64).tobytes(), np.array(ends, np.int32).tobytes(), np.array([order[x] for x in langs], np.int16).tobytes(), list(known), codes.tobytes(), hashes.tobytes()]
        types = [pa.list_(pa.string()) if n == "langs" else pa.binary() for n in names]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    for b in batches:
        for d, lang, t in zip(*(c.to_pylist() for c in b.columns)):
            w = text_words(t)
            if ids and len(codes) + len(w) > _SHARD_WORDS:
                yield shard()
                known, codes, hashes, ids, ends, langs = {}, array("i"), array("Q"), [], [], []
            own = known.setdefault(lang, {})
            seed = int.from_bytes(lang.encode()[:8], "big")
            for x in w:
                k = own.get(x)
                if k is None:
                    k = own[x] = len(hashes)
                    hashes.append(xxhash.xxh3_64_intdigest(x, seed))
                codes.append(k)
            ids.append(d)
            ends.append(len(codes))
            langs.append(lang)
    if ids:
        yield shard()


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _turn(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


class Coded:
    """One shard: its documents, and the trigrams inside them."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.doc_ids, self.doc_ends, self.doc_langs, self.langs = read("doc_ids", np.int64), read("doc_ends", np.int32), read("doc_langs", np.int16), row["langs"]
        word, doc = read("hashes", np.uint64)[read("codes", np.int32)], np.repeat(np.arange(len(self.doc_ids)), np.diff(self.doc_ends, prepend=0))
        inside = np.nonzero(doc[2:] == doc[:-2])[0]
        self.doc, self.abc = doc[inside], (word[inside], word[inside + 1], word[inside + 2])
        a, b, c = self.abc
        # words are hashes already, so that turning two of three makes the order count
        self.hash = (a ^ _turned(b, 21) ^ _turned(c, 42)).view(np.int64)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Coded]:
    for b in batches:
        for k in range(b.num_rows):
            yield Coded(b.slice(k, 1).to_pylist()[0])


_COUNTED = "lang string, a long, b long, c long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in _shards(batches):
        _, first, n = np.unique(s.hash, return_index=True, return_counts=True)
        lang = pa.DictionaryArray.from_arrays(pa.array(s.doc_langs[s.doc[first]]), pa.array(s.langs, pa.string())).cast(pa.string())
        yield pa.RecordBatch.from_arrays([lang, *(pa.array(x[first].view(np.int64)) for x in s.abc), pa.array(n)], names=["lang", "a", "b", "c", "n"])


def coded(documents: DataFrame) -> DataFrame:
    """The texts of (doc_id, lang, text) as numbers, kept in the shared folder, so that they are split into words once."""
    return cut(documents.mapInArrow(_code, _CODED))


def _discounts(counts: DataFrame, n: str) -> DataFrame:
    """lang, d1, d2, d3 from the counts of counts; one row a language."""
    seen = counts.groupBy("lang").agg(*[F.count(F.when(F.col(n) == k, 1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(F.lit(0.5 * k)) for k in (1, 2, 3)]
    # kept between 0 and k, where few counts make the estimate leave that range
    return seen.select("lang", *[F.least(F.greatest(x, F.lit(0.05)), F.lit(0.95 * k)).alias(f"d{k}") for k, x in zip((1, 2, 3), d)])


def _discounted(n: Column) -> Column:
    return n - F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def _context(counts: DataFrame, by: list[str], n: str, prefix: str) -> DataFrame:
    """Total and discounted mass of every context."""
    return counts.groupBy("lang", *by).agg(F.sum(n).alias(f"{prefix}_all"), *[F.count(F.when((F.col(n) == k) if k < 3 else (F.col(n) >= 3), 1)).alias(f"{prefix}_{k}") for k in (1, 2, 3)])


def _left_mass(prefix: str) -> Column:
    return (F.col("d1") * F.col(f"{prefix}_1") + F.col("d2") * F.col(f"{prefix}_2") + F.col("d3") * F.col(f"{prefix}_3")) / F.col(f"{prefix}_all")


def kneser_ney(texts: DataFrame) -> DataFrame:
    """(lang, a, b, c, logp): natural logarithm of the interpolated modified Kneser-Ney probability of c after a b for
    every trigram of ``coded`` texts.

    Trigrams are combined inside each shard before the shuffle; lower orders use continuation counts."""
    tri = cut(texts.mapInArrow(_count, _COUNTED).groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n")))
    bi = cut(tri.groupBy("lang", "b", "c").agg(F.count("*").alias("n")))
    uni = bi.groupBy("lang", "c").agg(F.count("*").alias("n"))
    # one row a language each: a bounded number of two-letter codes
    d3, d2, d1 = (_discounts(x, "n") for x in (tri, bi, uni))
    whole = _context(uni, [], "n", "u").withColumn("v", F.col("u_1") + F.col("u_2") + F.col("u_3"))
    p1 = uni.join(F.broadcast(d1), "lang").join(F.broadcast(whole), "lang").select("lang", "c", (_discounted(F.col("n")) / F.col("u_all") + _left_mass("u") / F.col("v")).alias("p1"))
    p2 = bi.join(_context(bi, ["b"], "n", "x"), ["lang", "b"]).join(p1, ["lang", "c"]).join(F.broadcast(d2), "lang")
    p2 = p2.select("lang", "b", "c", (_discounted(F.col("n")) / F.col("x_all") + _left_mass("x") * F.col("p1")).alias("p2"))
    p3 = tri.join(_context(tri, ["a", "b"], "n", "x"), ["lang", "a", "b"]).join(p2, ["lang", "b", "c"]).join(F.broadcast(d3), "lang")
    p3 = p3.select("lang", "a", "b", "c", F.log(_discounted(F.col("n")) / F.col("x_all") + _left_mass("x") * F.col("p2")).alias("logp"))
    return p3


_ARRAYS = "hashes binary, logps binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(k).to_numpy().tobytes()], pa.binary()) for k in (0, 1)], names=["hashes", "logps"])


class HashArrays:
    """A model as sorted arrays of trigram hashes and logarithms, stored in the shared folder in blocks of ascending hashes."""

    def __init__(self, model: DataFrame):
        h = F.col("a").bitwiseXOR(_turn(F.col("b"), 21)).bitwiseXOR(_turn(F.col("c"), 42))
        ordered = model.select(h.alias("h"), "logp").repartitionByRange("h").sortWithinPartitions("h")
        self.blocks = cut(ordered.mapInArrow(_pack, _ARRAYS))
        self.entries = self.blocks.agg(F.sum(F.length("hashes") / 8)).first()[0] or 0

    def load(self) -> tuple[np.ndarray, np.ndarray]:
        rows = sorted(((np.frombuffer(r[0], np.int64), np.frombuffer(r[1], float)) for r in self.blocks.collect()), key=lambda r: r[0][0])
        return tuple(np.concatenate([r[k] for r in rows] or [np.zeros(0, t)]) for k, t in ((0, np.int64), (1, float)))

    def unpacked(self) -> DataFrame:
        """(h, logp) as rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b.column(j)[k].as_py(), t)) for j, t in ((0, np.int64), (1, float))], names=["h", "logp"])

        return self.blocks.mapInArrow(run, "h long, logp double")


_SCORED = "doc_id long, lang string, words long, grams long, total double"


def _score(shared):
    """Each document's trigrams looked up in the sorted arrays, each different one of a shard once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, logps = shared.value
        for s in _shards(batches):
            different, which = np.unique(s.hash, return_inverse=True)
            logp = logps[np.searchsorted(hashes, different)][which] if len(different) else np.zeros(0)
            n = len(s.doc_ids)
            lang = pa.DictionaryArray.from_arrays(pa.array(s.doc_langs), pa.array(s.langs, pa.string())).cast(pa.string())
            columns = [pa.array(s.doc_ids), lang, pa.array(np.diff(s.doc_ends, prepend=0).astype(np.int64)), pa.array(np.bincount(s.doc, minlength=n)), pa.array(np.bincount(s.doc, weights=logp, minlength=n))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "words", "grams", "total"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, words, h, n): the different trigrams of each document, and a row with a null h for each document."""
    for s in _shards(batches):
        order = np.lexsort((s.hash, s.doc))
        d, h = s.doc[order], s.hash[order]
        new = np.nonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))[0] if len(d) else np.zeros(0, int)
        own, n = np.concatenate([np.arange(len(s.doc_ids)), d[new]]), np.concatenate([np.zeros(len(s.doc_ids), int), np.diff(np.append(new, len(d)))])
        words = np.concatenate([np.diff(s.doc_ends, prepend=0), np.zeros(len(new), int)])
        lang = pa.DictionaryArray.from_arrays(pa.array(s.doc_langs[own]), pa.array(s.langs, pa.string())).cast(pa.string())
        hashes = pa.concat_arrays([pa.nulls(len(s.doc_ids), pa.int64()), pa.array(h[new])])
        yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[own]), lang, pa.array(words.astype(np.int64)), hashes, pa.array(n.astype(np.int64))], names=["doc_id", "lang", "words", "h", "n"])


def scored(texts: DataFrame, model: HashArrays, most_entries: int = 8_000_000) -> DataFrame:
    """(doc_id, lang, words, grams, total) of coded texts: number of trigrams, and sum of their logarithms under a model
    that holds all of them.

    Arrays of at most ``most_entries`` entries of 16 bytes are broadcast and no text moves; larger ones are joined by hash."""
    if model.entries <= most_entries:
        found = texts.mapInArrow(_score(texts.sparkSession.sparkContext.broadcast(model.load())), _SCORED)
    else:
        listed = texts.mapInArrow(_listed, "doc_id long, lang string, words long, h long, n long")
        found = listed.join(model.unpacked(), "h", "left").select("doc_id", "lang", "words", F.col("n").alias("grams"), F.coalesce(F.col("n") * F.col("logp"), F.lit(0.0)).alias("total"))
    return found.groupBy("doc_id", "lang").agg(*[F.sum(c).alias(c) for c in ("words", "grams", "total")])


def perplexity_bands(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least_words: int = 20, fence: float = 1.5, most_entries: int = 8_000_000) -> DataFrame:
    """(doc_id, lang, words, perplexity, verdict) for every row with an id.

    The model is counted over all documents and kept in sorted hash arrays; a language's band reaches ``fence``
    interquartile ranges of the logarithm of the perplexity below and above its quartiles. verdict: ok, low, high, or
    short under ``least_words`` words (with a null perplexity without three words in a row). Unknown languages are one
    language of their own. The rows of a repeated id and language are one document. ``most_entries``: see ``scored``.
    """
    own = documents.where(documents[doc_id].isNotNull()).select(documents[doc_id].cast("long").alias("doc_id"), language(documents[lang]).alias("lang"), documents[text].alias("text"))
    texts = coded(own)
    # 64-bit hashes stand for trigrams; every trigram scored is in the model, which is of the same texts
    each = cut(scored(texts, HashArrays(kneser_ney(texts)), most_entries).select("doc_id", "lang", F.col("words").cast("int").alias("words"), F.when(F.col("grams") > 0, -F.col("total") / F.col("grams")).alias("bits")))
    q = each.where((F.col("words") >= least_words) & F.col("bits").isNotNull()).groupBy("lang").agg(F.percentile_approx("bits", F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias("q"))
    band = q.select("lang", (F.col("q")[0] - fence * (F.col("q")[1] - F.col("q")[0])).alias("low"), (F.col("q")[1] + fence * (F.col("q")[1] - F.col("q")[0])).alias("high"))
    verdict = F.when(F.col("words") < least_words, "short").when(F.col("bits") < F.col("low"), "low").when(F.col("bits") > F.col("high"), "high").otherwise("ok")
    return each.join(F.broadcast(band), "lang", "left").select("doc_id", "lang", "words", F.exp("bits").alias("perplexity"), verdict.alias("verdict"))
