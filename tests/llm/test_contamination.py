import random

from kittiwake.llm.contamination import PositionalIndex, leaks
from kittiwake.llm.tokens import text_words

DOC, ITEM = "doc_id long, text string, item_id int, positions int", "item_id long, prompt string, doc_id int, n int"


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def sample():
    rng = random.Random(2)
    vocab = ["the", "a", "of", "log"] * 3 + [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))) for k in range(12)] + [(50, None), (51, ""), (52, "the " * 20), (None, "x " * 20)]
    docs = []
    for d in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            p = text_words(rng.choice(items[:12])[1])
            n = rng.randint(6, 30)
            at = rng.randint(0, max(0, len(p) - n))
            w[len(w) // 2 : len(w) // 2] = p[at : at + n]
        docs.append((d, rng.choice([" ", ", ", "\n- "]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    docs += [(200, None), (201, ""), (202, "the, THE " * 3000), (None, items[0][1]), (0, docs[0][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = sample()
    d = spark.createDataFrame([(*x, 1, 1) for x in docs], DOC)
    i = spark.createDataFrame([(*x, 1, 1) for x in items], ITEM)
    want = {}
    for n, p in items:
        for k, t in docs:
            if n is not None and k is not None and (m := longest(text_words(p), text_words(t))) >= 12:
                want[n, k] = m
    assert len(want) > 20 and (52, 202) in want
    for options in ({}, {"block_words": 50}):
        rows = leaks(d, i, **options).collect()
        assert len(rows) == len(want) and {(r.item_id, r.doc_id): r.words for r in rows} == want
    near = {(r.item_id, r.doc_id) for r in leaks(d, i, slack=2).collect()}
    assert set(want) <= near


def near_pairs(docs, items, slack, missing, n=12):
    """Every item at every place of every document, each word looked for around its place."""
    found = set()
    for i, p in items:
        for d, t in docs:
            w, x = text_words(p), text_words(t)
            if i is None or d is None or (i, d) in found or len(w) < n or not x:
                continue
            for start in range(-len(w) - slack, len(x) + slack + 1):
                fits = [w[k] in x[max(0, start + k - slack) : max(0, start + k + slack + 1)] for k in range(len(w))]
                if any(sum(fits[s : s + n]) >= n - missing for s in range(len(w) - n + 1)):
                    found.add((i, d))
                    break
    return found


def test_near_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["the", "a", "of", "log"] * 2 + [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(11, 30)))) for k in range(8)] + [(20, None), (21, ""), (22, "the " * 13)]
    docs = []
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 20))]
        p = text_words(items[d % 8][1])
        at = rng.randint(0, max(0, len(p) - 14))
        p = p[at : at + 14]
        for _ in range(d % 5):
            k = rng.randrange(len(p))
            # replaced by a word of no document, left out, put in, or moved
            p[k : k + 1] = rng.choice([["unseen" + str(d)], [], [p[k], rng.choice(vocab)], []])
        if d % 7 == 0:
            k = rng.randrange(len(p))
            p.insert(rng.randrange(len(p)), p.pop(k))
        w[len(w) // 2 : len(w) // 2] = p
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "the " * 200), (None, items[0][1])]
    d = spark.createDataFrame([(*x, 1, 1) for x in docs], DOC)
    i = spark.createDataFrame([(*x, 1, 1) for x in items], ITEM)
    sizes = set()
    for slack, missing in ((2, 0), (4, 1), (0, 1), (1, 3)):
        want = near_pairs(docs, items, slack, missing)
        rows = [(r.item_id, r.doc_id) for r in leaks(d, i, slack=slack, missing=missing).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want, (slack, missing)
        sizes.add(len(want))
    assert len(sizes) == 4 and min(sizes) > 20


def test_a_replaced_word(spark):
    words = [f"w{k}" for k in range(12)]
    others = [(k, " ".join(words[k:] + ["x"] * k)) for k in range(1, 12)]
    d = spark.createDataFrame([(0, " ".join(words[:11] + ["other"]), 1, 1), (50, "w0 w1 w2", 1, 1), *((*o, 1, 1) for o in others[6:])], DOC)
    i = spark.createDataFrame([(1, " ".join(words[:11] + ["w99"]), 1, 1)], ITEM)
    assert [(r.item_id, r.doc_id) for r in leaks(d, i, slack=4, missing=1).collect()] == [(1, 0)]
    assert not leaks(d, i, slack=4).collect()
    # three rare words in place are not enough
    rare = spark.createDataFrame([(0, "z0 z1 z2 " + " ".join(words[3:]), 1, 1), (1, "w0 w1 w2", 1, 1), *((k, " ".join(words[3:]), 1, 1) for k in range(2, 9))], DOC)
    whole = spark.createDataFrame([(1, " ".join(words), 1, 1)], ITEM)
    assert not leaks(rare, whole, slack=4).collect() and not leaks(rare, whole, slack=4, missing=1).collect()


def test_postings(spark, tmp_path):
    d = spark.createDataFrame([(1, "b a, B!", 1, 1), (2, None, 1, 1), (3, "", 1, 1), (4, "- -", 1, 1), (5, "a c", 1, 1)], DOC).coalesce(1)
    index = PositionalIndex.create(d, folder=str(tmp_path / "index"))
    assert {(r.term, r.doc_id, tuple(r.positions)) for r in index.postings().collect()} == {("b", 1, (0, 2)), ("a", 1, (1,)), ("a", 5, (0,)), ("c", 5, (1,))}
    assert index.shards().count() == 1


def test_an_index_in_several_shards_serves_again(spark, tmp_path):
    docs, items = sample()
    d = spark.createDataFrame([(*x, 1, 1) for x in docs], DOC).coalesce(1)
    i = spark.createDataFrame([(*x, 1, 1) for x in items] + [(0, items[3][1], 1, 1)], ITEM)
    rows = lambda x, **o: sorted(tuple(r) for r in leaks(x, i, **o).select("item_id", "doc_id").collect())
    want = rows(d), rows(d, slack=1, missing=1)
    index = PositionalIndex.create(d, folder=str(tmp_path / "index"), shard_words=500)
    assert index.shards().count() > 8
    again = PositionalIndex(spark, str(tmp_path / "index"))
    assert (rows(again), rows(again, slack=1, missing=1)) == want


def test_empty(spark):
    docs, items = sample()
    d = spark.createDataFrame([(*x, 1, 1) for x in docs], DOC)
    i = spark.createDataFrame([(*x, 1, 1) for x in items], ITEM)
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0
