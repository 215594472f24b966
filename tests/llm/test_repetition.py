import math
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from kittiwake.llm.repetition import HashArrays, WordHashes, coded, exact_repeats, gram_hashes, kneser_ney, language, perplexity_bands, repeated_share

DOC = "doc_id long, text string, lang string, words int, h string"


@given(st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 5))
def test_repeats(words, n):
    seen, again = set(), 0
    for k in range(len(words) - n + 1):
        g = tuple(words[k : k + n])
        again += g in seen
        seen.add(g)
    assert exact_repeats(words, n) == again
    assert len(gram_hashes(WordHashes().of(words), n)) - len(np.unique(gram_hashes(WordHashes().of(words), n))) == again


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], DOC)


def test_share(spark):
    loop = "one two three four five six seven eight nine ten " * 4
    rows = [(1, loop, "en"), (2, " ".join(f"w{k}" for k in range(40)), "en"), (3, "a a a a a a a", "en"), (4, "", None), (5, None, None), (6, loop.upper(), "EN"), (6, loop, "en"), (7, "b " * 60000, "en")]
    got = {(r.doc_id, r.words): (r.repeated, r.share) for r in repeated_share(frame(spark, rows)).collect()}
    assert got[1, 40] == (26, 26 / 36) and got[2, 40] == (0, 0.0) and got[3, 7] == (2, None) and got[4, 0] == (0, None) and got[5, 0] == (0, None) and got[7, 60000] == (59995, 59995 / 59996)
    assert sorted(r.doc_id for r in repeated_share(frame(spark, rows), above=0.3).collect()) == [1, 6, 6, 7]
    assert repeated_share(frame(spark, [])).count() == 0


def reference_model(texts):
    """Interpolated modified Kneser-Ney over trigrams, counted plainly."""
    tri = Counter()
    for w in texts:
        tri.update(zip(w, w[1:], w[2:]))
    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)

    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[1] else 0.5 * k for k in (1, 2, 3)]
        return [min(max(x, 0.05), 0.95 * k) for k, x in zip((1, 2, 3), d)]

    d3, d2, d1 = map(discounts, (tri, bi, uni))
    less = lambda n, d: n - d[min(n, 3) - 1]

    def contexts(counts, m):
        out = defaultdict(list)
        for g, n in counts.items():
            out[g[:m]].append(n)
        return out

    c3, c2 = contexts(tri, 2), contexts(bi, 1)
    left = lambda ns, d: sum(d[min(n, 3) - 1] for n in ns) / sum(ns)
    p1 = {c: less(n, d1) / sum(uni.values()) + left(uni.values(), d1) / len(uni) for c, n in uni.items()}
    p2 = {(b, c): less(n, d2) / sum(c2[b,]) + left(c2[b,], d2) * p1[c] for (b, c), n in bi.items()}
    return {(a, b, c): math.log(less(n, d3) / sum(c3[a, b]) + left(c3[a, b], d3) * p2[b, c]) for (a, b, c), n in tri.items()}


def test_model_against_plain_counting(spark):
    rng = random.Random(6)
    texts = [[rng.choice("abcdefg") for _ in range(rng.randint(0, 40))] for _ in range(60)]
    rows = [(k, " ".join(w), "en") for k, w in enumerate(texts)]
    want = reference_model(texts)
    code = {w: int(np.uint64(xxhash.xxh3_64_intdigest(w, int.from_bytes(b"en", "big"))).view(np.int64)) for w in "abcdefg"}
    docs = frame(spark, rows)
    model = kneser_ney(coded(docs.select("doc_id", language(docs.lang).alias("lang"), "text")))
    got = {(r.a, r.b, r.c): r.logp for r in model.collect()}
    assert len(got) == len(want)
    for (a, b, c), p in want.items():
        assert math.isclose(got[code[a], code[b], code[c]], p, rel_tol=1e-9)
    hashes, logps = HashArrays(model).load()
    assert len(hashes) == len(want) and (np.diff(hashes) > 0).all() and math.isclose(logps.sum(), sum(want.values()), rel_tol=1e-9)
    # arrays sent to the texts, and arrays joined with them
    for most in (8_000_000, 0):
        scored = {r.doc_id: r for r in perplexity_bands(frame(spark, rows), most_entries=most).collect()}
        assert len(scored) == len(texts)
        for k, w in enumerate(texts):
            grams = list(zip(w, w[1:], w[2:]))
            assert scored[k].words == len(w)
            if grams:
                assert math.isclose(scored[k].perplexity, math.exp(-sum(want[g] for g in grams) / len(grams)), rel_tol=1e-9)
            else:
                assert scored[k].perplexity is None and scored[k].verdict == "short"


def test_bands(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(f"w{rng.randint(0, 60)}" for _ in range(80)), "en" if k % 2 else " EN") for k in range(60)]
    rows += [(900, "spam and eggs " * 30, "en"), (901, "x y", None), (902, None, "de"), (903, "", ""), (904, "noch ein wort " * 10, "de")]
    got = {r.doc_id: r for r in perplexity_bands(frame(spark, rows)).collect()}
    assert got[900].verdict == "low" and got[901].verdict == "short" and got[902].lang == "de" and got[903].lang == "und" and len(got) == len(rows)
    assert perplexity_bands(frame(spark, [])).count() == 0
