from itertools import combinations

from kittiwake.operators.pairs import pairs_in_groups


def test_pairs_in_blocks(spark):
    rows = [("a", k) for k in range(25)] + [("b", 100), ("b", 101), ("b", 101), ("c", 7), (None, 1), (None, 2), ("a", None)]
    want = {p for p in combinations(range(25), 2)} | {(100, 101)}
    df = spark.createDataFrame(rows, "g string, id long")
    for block in (3, 2000):
        got = [tuple(r) for r in pairs_in_groups(df, ["g"], block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert pairs_in_groups(df.limit(0), ["g"]).count() == 0
