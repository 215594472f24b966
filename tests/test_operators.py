import random

import pytest
from pyspark.sql import functions as F

from kittiwake.functions import coerce, strings
from kittiwake.operators import index, kv, mutate, pipeline, scan, versions


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(k, rng.choice("abc"), rng.randint(-5, 5), rng.random() * 10 - 5, k % 7 == 0) for k in range(200)]
    return data, spark.createDataFrame(data, "id long, s string, n int, x double, gone boolean")


def ids(df):
    return [r.id for r in df.collect()]


def test_scans(rows):
    data, df = rows
    live = [r[0] for r in data if not r[4]]
    assert ids(scan.forward(df, "id", "gone")) == live and ids(scan.backward(df, "id", "gone")) == live[::-1]
    assert ids(scan.seek_lower(df, "id", 100, "gone")) == [i for i in live if i >= 100]
    assert ids(scan.resume_after(df, "id", 100, "gone", ascending=False)) == [i for i in live[::-1] if i < 100]
    assert scan.get(df, "id", 8, "gone")["id"] == 8 and scan.exists(df, "id", 8, "gone") and not scan.exists(df, "id", 7, "gone")
    with pytest.raises(scan.RecordError, match="deleted"):
        scan.get(df, "id", 7, "gone")
    with pytest.raises(scan.RecordError, match="out of range"):
        scan.get(df, "id", 999, "gone")
    assert tuple(scan.counts(df, "gone").first()) == (200, len(live)) and scan.is_empty(df.limit(0)) and not scan.is_empty(df)
    assert scan.project(df, ["s", "id", "s"]).columns == ["s", "id", "s_2"]


def test_numbers_are_dense_and_ordered(rows):
    data, df = rows
    got = sorted((r.pos, r.id) for r in scan.numbered(df, [F.col("x").asc(), F.col("id").asc()], start=5).collect())
    assert got == [(k + 5, r[0]) for k, r in enumerate(sorted(data, key=lambda r: (r[3], r[0])))]
    assert scan.numbered(df.limit(0), [F.col("id").asc()]).count() == 0


def test_seeks_against_sorted_list(rows):
    data, df = rows
    keys = sorted((r[1], r[2], r[0]) for r in data)
    for key in [("a", 0), ("b", -9), ("b", 5), ("c", 9), ("", 0), ("d", 1)]:
        for forward in (True, False):
            for inclusive in (True, False):
                if forward:
                    want = next((k for k in keys if (k[:2] >= key if inclusive else k[:2] > key)), None)
                else:
                    want = next((k for k in reversed(keys) if (k[:2] <= key if inclusive else k[:2] < key)), None)
                got = index.seek(df, ["s", "n"], list(key), "id", forward=forward, inclusive=inclusive).collect()
                assert [(r.s, r.n, r.id) for r in got] == ([want] if want else [])
                assert not got or got[0].cmp == int(want[:2] != key)
    assert ids(index.seek(df, ["s", "n"], [], "id")) == [keys[0][2]] and ids(index.seek(df, ["s", "n"], [], "id", forward=False)) == [keys[-1][2]]
    got = index.between(df, ["s", "n"], ["a", 2], ["b", 1], low_inclusive=False, high_inclusive=True)
    assert sorted(ids(got)) == sorted(k[2] for k in keys if ("a", 2) < k[:2] <= ("b", 1))
    assert ids(index.exact(df, ["s", "n"], ["b", 1], "id")) == sorted((k[2] for k in keys if k[:2] == ("b", 1)), reverse=True)
    assert index.key_exists(df, ["s"], ["a"]) and not index.key_exists(df, ["s"], ["z"]) and index.rank_of(df, "s", "b") == sum(k[0] < "b" for k in keys)
    assert ids(index.top(df, ["x"], "id", 3, descending=True)) == [r[0] for r in sorted(data, key=lambda r: (r[3], r[0]), reverse=True)[:3]]


def test_prefix_and_regex(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "ab\ncd"), (4, None), (5, "xyz")], "id long, s string")
    hit = index.longest_prefix(df, "s", "abq", "id").first()
    assert (hit.id, hit.matched) == (3, 2) and index.longest_prefix(df, "s", "q", "id").first().matched == 0
    assert ids(index.matching(df, "s", "ab.*")) == [1, 2, 3] and ids(index.matching(df, "s", "b")) == [] and ids(index.matching(df, "s", "AB(C|D)", "i")) == [1, 2]
    with pytest.raises(TypeError):
        index.matching(df, "id", "1")
    with pytest.raises(KeyError):
        index.matching(df, "s", "1", engine="none")
    with pytest.raises(ValueError):
        index.matching(df, "s", "1", "q")


def model_insert(base, batch, keys):
    taken = [{tuple(r[k] for k in key) for r in base} for key in keys]
    good = []
    for r in sorted(batch, key=lambda r: r["seq"]):
        values = [tuple(r[k] for k in key) for key in keys]
        if not any(v in t for v, t in zip(values, taken)):
            good.append(r["seq"])
            for v, t in zip(values, taken):
                t.add(v)
    return sorted(good)


def test_insert_model(spark):
    rng = random.Random(9)
    for keys in ([["a"]], [["a"], ["b"]], [["a", "b"]]):
        base = [{"a": rng.randint(0, 15), "b": rng.randint(0, 15), "seq": -1 - k} for k in range(3)]
        batch = [{"a": rng.randint(0, 15), "b": rng.randint(0, 15), "seq": k} for k in range(40)]
        good, bad = mutate.insert(spark.createDataFrame(base, "a int, b int, seq int"), spark.createDataFrame(batch, "a int, b int, seq int"), keys, "seq")
        assert sorted(r.seq for r in good.collect()) == model_insert(base, batch, keys)
        assert good.count() + bad.select("seq").distinct().count() == 40


def test_upsert_update_delete(spark):
    base = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", True)], "k int, v string, frozen boolean")
    batch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1), (9, "n", 1)], "k int, v string, seq int")
    full = batch.withColumn("frozen", F.lit(False))
    assert {(r.k, r.v) for r in mutate.upsert(base, full, ["k"], "seq").collect()} == {(1, "a"), (2, "y"), (3, "z"), (9, "n")}
    assert {tuple(r) for r in mutate.upsert_codes(base, batch, ["k"], "seq", "frozen").collect()} == {(2, 1), (3, 2), (9, 0)}
    assert {(r.k, r.v) for r in mutate.update(base, batch, ["k"], "seq").collect()} == {(1, "a"), (2, "y"), (3, "z")}
    assert {r.k for r in mutate.delete(base, batch, ["k"]).collect()} == {1}
    assert {(r.k, r.v) for r in mutate.update_column(base, "v", F.lit("q"), F.col("k") > 1).collect()} == {(1, "a"), (2, "q"), (3, "q")}


def test_increment_wraps_and_refuses(spark):
    df = spark.createDataFrame([(127,), (-128,), (5,)], "n int")
    assert [r.n for r in mutate.increment(df, "n", 1, kind="sint8").collect()] == [-128, -127, 6]
    assert [r.n for r in mutate.increment(df, "n", -2, kind="uint8").collect()] == [125, 126, 3]
    with pytest.raises(TypeError):
        mutate.increment(df, "n", 1.5, kind="sint8")
    big = spark.createDataFrame([(2**63 - 1,)], "n long")
    assert mutate.increment(big, "n", 1, kind="sint64").first().n == -(2**63)


def test_unit_of_work(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    u = mutate.UnitOfWork(base, ["k"])
    u.insert(spark.createDataFrame([(3, "c"), (4, "d")], "k int, v string"))
    u.delete(spark.createDataFrame([(1,), (4,)], "k int"))
    assert {r.k for r in u.view().collect()} == {2, 3} and {r.k for r in u.base.collect()} == {1, 2}
    u.rollback()
    assert {r.k for r in u.view().collect()} == {1, 2}
    u.delete(spark.createDataFrame([(1,)], "k int"))
    u.commit()
    assert {r.k for r in u.base.collect()} == {2}


def test_versions(spark):
    df = spark.createDataFrame([(1, 0, 3), (2, 2, None), (3, 5, None)], "id long, __ins_ver long, __del_ver long")
    assert [ids(versions.as_of(df, v).orderBy("id")) for v in (0, 2, 3, 5)] == [[1], [1, 2], [2], [2, 3]]
    assert versions.next_action([{"kind": "delta", "bytes": 1, "rows": 5, "deleted": 0}] * 5) == ("merge", [0, 1, 2, 3, 4])
    assert versions.next_action([{"kind": "delta", "bytes": 1, "rows": 5, "deleted": 0}]) == ("convert", [0])
    assert versions.next_action([{"kind": "frozen", "bytes": 1, "rows": 5, "deleted": 1}]) == ("purge", [0])
    assert versions.next_action([{"kind": "frozen", "bytes": 1, "rows": 50, "deleted": 1}]) == ("none", [])


def test_kv_plans(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (5, "e")], "key int, val string")
    assert {tuple(r) for r in kv.multi_get(t, spark.createDataFrame([(1,), (1,), (3,)], "key int")).collect()} == {(1, "a"), (3, None)}
    assert [r.key for r in kv.from_key(t, 2).collect()] == [2, 5] and [r.key for r in kv.before_key(t, 5).collect()] == [2, 1]
    b = spark.createDataFrame([("put", 2, "x", 1), ("delete", 2, None, 2), ("put", 7, "n", 3), ("delete", 9, None, 4)], "op string, key int, val string, seq int")
    assert {tuple(r) for r in kv.apply_batch(t, b).collect()} == {(1, "a"), (5, "e"), (7, "n")}


def test_pipeline(spark):
    a = pipeline.Stage(lambda b: b.assign(y=b.id * 2)[["id", "y"]], "id long, y long")
    b = pipeline.Stage(lambda b: b[b.y > 4] if len(b) else None, "id long, y long")
    assert [tuple(r) for r in (a | b).run(spark.range(5), keep_order="id").collect()] == [(3, 6), (4, 8)]


def one(spark, expr, value, kind):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


def test_coercions(spark):
    assert [one(spark, lambda c: coerce.wrap(c, "sint8"), v, "long") for v in (127, 128, 255, 256, -129)] == [127, -128, -1, 0, 127]
    assert one(spark, lambda c: coerce.wrap(c, "uint64"), -1, "long") == 2**64 - 1
    assert [one(spark, lambda c: coerce.saturate(c, "sint16"), v, "double") for v in (1.9, -1.9, 1e9, -1e9, float("nan"), float("inf"))] == [1, -1, 32767, -32768, 0, 32767]
    assert one(spark, lambda c: coerce.saturate(c, "sint64"), 1e300, "double") == 2**63 - 1
    assert one(spark, lambda c: coerce.number_of_text(c, "sint32"), "  -42", "string") == -42 and one(spark, lambda c: coerce.number_of_text(c, "float64"), "1e3", "string") == 1000.0
    for bad in ("12x", "", "1.5"):
        with pytest.raises(Exception, match="not an integer"):
            one(spark, lambda c: coerce.number_of_text(c, "sint32"), bad, "string")
    assert one(spark, lambda c: coerce.text_of_number(c, "float64"), 1.5, "double") == "1.500000" and one(spark, lambda c: coerce.text_of_number(c, "sint8"), -3, "int") == "-3"
    assert one(spark, lambda c: coerce.zero_if_missing(c, "strzero"), None, "string") == "" and one(spark, lambda c: coerce.zero_if_missing(c, "float32"), None, "float") == 0.0
    assert spark.range(1).select(coerce.least_value("float32").alias("r")).first().r < -3e38 and spark.range(1).select(coerce.greatest_value("uint64").alias("r")).first().r == 2**64 - 1
    ts = F.timestamp_millis(F.lit(-1500))
    assert tuple(spark.range(1).select(coerce.seconds_of_date(ts), coerce.millis_of_date(ts)).first()) == (-1, -1500)
    assert len(one(spark, coerce.object_id, "0123456789abcdef01234567", "string")) == 12
    assert bytes(one(spark, lambda c: coerce.binary_for_text(c, 2), b"\x10\x01", "binary")) == b"\x03\x10\x01"
    with pytest.raises(Exception, match="zero byte"):
        one(spark, lambda c: coerce.binary_for_text(c, 2), b"\x10\x00", "binary")


def test_strings(spark):
    f = lambda e, v: one(spark, e, v, "string")
    assert f(lambda c: strings.split_fields(c, " "), "  a  b ") == ["a", "b"] and f(lambda c: strings.split_fields(c, " "), " ") == []
    assert f(lambda c: strings.split_fields(c, "\t"), "a\t\tb\t") == ["a", "", "b", ""] and f(lambda c: strings.split_fields(c, "|", 2), "a|b|c") == ["a", "b|c"]
    assert f(lambda c: strings.split_any(c, ",;"), "a,b;c") == ["a", "b", "c"] and f(strings.trim_space, "\t a \n") == "a" and f(strings.chomp_space, " a \n") == " a" and f(strings.chomp_line, "a \r\n") == "a "
    assert f(lambda c: strings.common_prefix_length(c, F.lit("abx")), "abc") == 2 and f(lambda c: strings.common_prefix_length(c, F.lit("")), "abc") == 0
    for bits in (8, 16, 32):
        assert f(lambda c: strings.utf_decode(strings.utf_encode(c, bits), bits), "aé語") == "aé語"
    values = [-(2**63), -5, -1, 0, 1, 77, 2**63 - 1]
    keys = [one(spark, strings.signed_key, v, "long") for v in values]
    assert keys == sorted(keys) and [one(spark, strings.signed_from_key, k, "string") for k in keys] == values
    short = [one(spark, lambda c: strings.signed_key(c, 32), v, "int") for v in (-(2**31), -1, 0, 9)]
    assert short == sorted(short) and one(spark, lambda c: strings.signed_from_key(c, 32), short[1], "string") == -1
    assert [bytes(one(spark, strings.successor, b, "binary") or b"") for b in (b"ab", b"a\xff", b"\xff")] == [b"ac", b"b", b""]


def test_snapshot_query_tests_all_versions(spark, tmp_path, monkeypatch):
    from kittiwake.plans import store

    events = [(k, k % 7) for k in range(1, 100)] + [(k, k % 7) for k in range(4990, 5020)] + [(9000, 8), (3, None), (4, None)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    asked, as_of = [], store.versions.as_of
    monkeypatch.setattr(store.versions, "as_of", lambda rows, version: asked.append(rows) or as_of(rows, version))
    got = {tuple(r) for r in store.q_snapshot_asof(spark, str(tmp_path)).collect()}
    assert got == {(u, max(e for e, v in events if v == u and e <= 5000)) for _, u in events if u != 8}
    seen = asked[0].collect()
    assert len(seen) == len(events) and sum(r["__del_ver"] is not None for r in seen) == len(events) - 9
