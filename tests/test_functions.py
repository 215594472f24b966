import pytest
from pyspark.sql import functions as F

from kittiwake.functions import bits
from kittiwake.functions.parsing import parse_ini, parse_serialized
from kittiwake.operators.scan import many_cursors, random_rows


def test_crc32c(spark):
    rows = [b"123456789", b"", b"\x00" * 32, b"\xff" * 32, None, b"a", bytes(range(32))]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, b binary").coalesce(1)
    got = [r[0] for r in df.orderBy("k").select(bits.crc32c("b")).collect()]
    assert got == [0xE3069283, 0, 0x8A9136AA, 0x62A8AB43, None, 0xC1D04330, 0x46DD794E]


def test_integer_codings(spark):
    lists = [[0], [127, 128, 300, 2**40], [], None, [5, 5, 6]]
    df = spark.createDataFrame([(x,) for x in lists], "v array<long>")
    assert [r[0] for r in df.select(bits.varint_decode(bits.varint_encode("v"))).collect()] == lists
    assert bytes(df.select(bits.varint_encode("v")).collect()[1][0])[:3] == b"\x7f\x80\x01"
    steps = df.where(F.size("v") > 0).select(bits.deltas(F.col("v")).alias("d"))
    assert [r.d for r in steps.collect()] == [[0], [127, 1, 172, 2**40 - 300], [5, 0, 1]]
    assert [r[0] for r in steps.select(bits.undeltas(F.col("d"))).collect()] == [x for x in lists if x]


def test_rank(spark):
    df = spark.createDataFrame([(k, k % 3 == 0) for k in range(10)] + [(10, None)], "k int, b boolean")
    assert {r.k: r.rank1 for r in bits.with_rank(df, [F.col("k").asc()], F.col("b")).collect()} == {k: k // 3 if k % 3 == 0 and k < 10 else None for k in range(11)}


def test_cursors_and_samples(spark):
    parts = many_cursors(spark.range(500), 3, "id")
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(500)) and 100 < random_rows(spark.range(1000), 0.3).count() < 500


def test_small_formats():
    assert parse_ini("a = 1\n[s x]\n# no\nB=2 = 3\nempty=\n[t]\n") == {"": {"a": "1"}, "s x": {"B": "2 = 3", "empty": ""}, "t": {}}
    assert parse_serialized('a:3:{i:0;s:2:"é";s:1:"k";d:1.5;i:7;a:1:{i:0;b:1;}}') == {0: "é", "k": 1.5, 7: {0: True}}
    assert parse_serialized('O:3:"Foo":1:{s:1:"x";N;}') == {"__class__": "Foo", "x": None}
    for bad in ("i:1;x", 's:3:"a";', "z:1;"):
        with pytest.raises(ValueError):
            parse_serialized(bad)
