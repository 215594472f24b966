import os
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kittiwake.operators.kv import Families, KeyValue, NotFound, compare_versions
from kittiwake.schema import load
from kittiwake.sources import delimited, documents
from kittiwake.sources.registry import TableSource, open_source
from kittiwake.sources.store import Catalog, CommitConflict, Store, WriteThrottled, register_segment
from kittiwake.streaming.changes import apply_stream, change_stream, replay

ROW = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])


def put(spark, pairs):
    return spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(pairs)], "k int, v string, n int")


def state(store, version=None):
    return {r.k: r.v for r in store.read(version).collect()}


def test_against_a_dictionary(spark, tmp_path):
    rng = random.Random(12)
    store, model, history = Store.create(spark, str(tmp_path / "t"), ROW, [["k"]]), {}, {}
    for step in range(9):
        action = rng.choice(["insert", "upsert", "delete", "update", "compact"]) if step else "insert"
        pairs = [(rng.randint(0, 25), f"{step}-{j}") for j in range(12)]
        if action == "insert":
            rejected = store.insert(put(spark, pairs), "n")
            left = 0
            for k, v in pairs:
                left += k in model
                model.setdefault(k, v)
            assert rejected.count() == left
        elif action == "upsert":
            store.upsert(put(spark, pairs), "n")
            model |= dict(pairs)
        elif action == "delete":
            store.delete(put(spark, pairs[:4]))
            model = {k: v for k, v in model.items() if k not in {p[0] for p in pairs[:4]}}
        elif action == "update":
            store.update({"v": F.concat("v", F.lit("!"))}, "k < 5")
            model = {k: v + "!" if k < 5 else v for k, v in model.items()}
        else:
            store.compact()
        assert state(store) == model, action
        history[store.manifest()["version"]] = dict(model)
    for v, want in history.items():
        assert state(store, v) == want
    rids = [r[0] for r in store.read(ids=True).select("__rid").collect()]
    assert len(rids) == len(set(rids))
    store.purge()
    assert state(store) == model and store.counts()["physical"] == store.counts()["live"] == len(model)
    assert sorted(r[0] for r in store.read(ids=True).select("__rid").collect()) == sorted(rids)
    with pytest.raises(LookupError):
        store.read(0)
    store.compact(renumber=True)
    assert sorted(r[0] for r in store.read(ids=True).select("__rid").collect()) == list(range(len(model)))
    assert Store.open(spark, str(tmp_path / "t")).counts()["live"] == len(model)


def test_unique_update_tags_and_feed(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "t"), ROW, [["k"]])
    store.insert(put(spark, [(1, "a"), (2, "b")]), "n")
    store.tag("first")
    with pytest.raises(ValueError, match="unique"):
        store.update({"k": "2"}, "k = 1")
    # a row keeps its own key
    store.update({"v": "'A'", "k": "k"}, "k = 1")
    assert state(store) == {1: "A", 2: "b"} and state(store, "first") == {1: "a", 2: "b"}
    feed = sorted((r.op, r.k, r.v) for r in store.changes(store.manifest()["tags"]["first"]).collect())
    assert feed == [("delete", 1, "a"), ("insert", 1, "A")]
    store.clear()
    assert state(store) == {} and store.vacuum() == 0
    assert store.maintain() == "none"


def test_one_of_two_writers_wins(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "t"), ROW, [["k"]])
    old = store.manifest()
    store.insert(put(spark, [(1, "a")]), "n")
    with pytest.raises(CommitConflict):
        store._publish(old | {"version": old["version"] + 1})
    tries = []

    def change(m):
        if not tries:
            tries.append(Store.open(spark, str(tmp_path / "t")).insert(put(spark, [(2, "b")]), "n"))
        return m

    store._commit(change)
    assert state(store) == {1: "a", 2: "b"}


def test_catalog_copy_and_format(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    t = c.create_table("one", load('{"RowSchema": {"columns": {"k": {"type": "int32"}, "v": {"type": "strzero"}}}, "TableIndex": [{"fields": "k", "unique": true}]}'))
    t.insert(put(spark, [(k, f"v{k}") for k in range(20)]), "n")
    t.delete("k >= 15")
    assert c.list_tables() == ["one"] and c.open_table("one").counts()["live"] == 15
    spark.dataSource.register(TableSource)
    assert {r.k for r in spark.read.format("kittiwake").load(str(tmp_path / "one")).collect()} == set(range(15))
    assert spark.read.format("kittiwake").option("version", "1").load(str(tmp_path / "one")).count() == 20
    assert open_source(spark, str(tmp_path / "one")).count() == 15 and open_source(spark, "x.empty", ROW).count() == 0
    t.copy_to(str(tmp_path / "two"))
    c.drop_table("one")
    assert c.list_tables() == ["two"]
    with pytest.raises(ValueError):
        open_source(spark, "x.unknown")


def test_key_value(spark, tmp_path):
    kv = KeyValue.open(spark, str(tmp_path / "kv"))
    kv.write([("put", b"key%d" % k, b"value%d" % k) for k in range(1, 5)])
    snap = kv.snapshot()
    kv.put(b"key2", b"new")
    kv.delete(b"key3")
    kv.delete(b"nothing")
    assert kv.get(b"key2") == b"new" and snap.get(b"key2") == b"value2" and snap.get(b"key3") == b"value3"
    with pytest.raises(NotFound):
        kv.get(b"key3")
    with pytest.raises(ValueError):
        snap.put(b"a", b"b")
    assert kv.multi_get([b"key1", b"key3"]) == {b"key1": b"value1", b"key3": None}
    it = kv.iterator(page=2)
    it.seek_to_first()
    assert [k for k, _ in it] == [b"key1", b"key2", b"key4"]
    it.seek(b"key3")
    assert it.key() == b"key4"
    it.prev()
    assert it.key() == b"key2" and it.value() == b"new"
    it.next()
    assert it.key() == b"key4"
    it.seek_to_last()
    it.prev()
    it.prev()
    assert it.key() == b"key1"
    it.prev()
    assert not it.valid()
    kv.compact_range()
    assert kv.approximate_size(b"key1", b"key3") == 4 + 6 + 4 + 3
    assert kv.backup(str(tmp_path / "copy")).get(b"key2") == b"new" and compare_versions(1, 2) == -1
    f = Families(spark, str(tmp_path / "families"))
    f.family("a").put(b"x", b"y")
    assert f.list() == ["a"]
    f.drop("a")
    assert f.list() == []


def test_stream_is_applied_once(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "t"), ROW, [["k"]])
    schema = "k int, v string, n int, op string"
    for part, rows in enumerate([[(1, "a", 1, "put"), (2, "b", 2, "put")], [(1, None, 3, "delete"), (3, "c", 4, "put"), (2, "B", 5, "put")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        q = apply_stream(change_stream(spark, str(tmp_path / "feed"), T._parse_datatype_string(schema), files_per_batch=1), store, "n", str(tmp_path / "cp"), op="op")
        q.awaitTermination()
    assert state(store) == {2: "B", 3: "c"}
    version = store.manifest()["version"]
    store.upsert(put(spark, [(9, "again")]), "n", applied=("changes", 0))
    assert store.manifest()["version"] == version
    copy = Store.create(spark, str(tmp_path / "copy"), ROW, [["k"]])
    replay(store, copy)
    store.delete("k = 3")
    replay(store, copy)
    replay(store, copy)
    assert state(copy) == {2: "B"}


def test_documents_round_trip(spark):
    t = load('{"RowSchema": {"columns": {"a": {"type": "int32"}, "b": {"type": "uint8", "mongoType": "int"}, "s": {"type": "strzero"}, "x": {"type": "double"}, "r": {"type": "twostrzero"}, "o": {"type": "fixed", "length": 12}, "$$": {"type": "carbin"}}}}')
    docs = [
        '{"a": 5, "b": 300, "s": "t", "x": "1.5", "r": {"$regex": "a+", "$options": "i"}, "o": {"$oid": "0123456789abcdef01234567"}, "more": [1, {"z": "1"}], "n": null}',
        '{"a": "-7", "b": true, "s": 2.5, "x": {"$minKey": 1}}', '{"a": 1e20, "x": null, "s": {"k": 1}}', "{}", None, '{"a": {"$date": 1999}, "b": {"$maxKey": 1}}',
    ]
    rows = spark.createDataFrame([(d,) for d in docs], "doc string")
    got = documents.encode(rows, t).collect()
    assert [r.a for r in got] == [5, -7, 2**31 - 1, 0, 0, 1] and [r.b for r in got] == [44, 1, 0, 0, 0, 255] and [r.s for r in got] == ["t", "2.500000", '{"k":1}', "", "", ""]
    assert got[0].x == 1.5 and got[1].x < -1e308 and got[2].x == 0.0 and tuple(got[0].r) == ("a+", "i") and bytes(got[0].o).hex() == "0123456789abcdef01234567"
    back = documents.decode(documents.encode(rows, t).withColumn("$$", F.col("`$$`").cast("string")), t).collect()
    assert '"more":[1,{"z":"1"}]' in back[0].doc
    again = documents.encode(documents.decode(documents.encode(rows, t), t), t).collect()
    assert [tuple(r)[:5] for r in again] == [tuple(r)[:5] for r in got]
    dated = load('{"RowSchema": {"columns": {"d": {"type": "int32", "mongoType": "date"}, "e": {"type": "int64", "mongoType": "date"}, "o": {"type": "fixed", "length": 12, "mongoType": "oid"}, "t": {"type": "uint8"}}}}')
    doc = '{"d":{"$date":5000},"e":{"$date":-7},"o":{"$oid":"0123456789abcdef01234567"},"t":true}'
    assert documents.decode(documents.encode(spark.createDataFrame([(doc,)], "doc string"), dated), dated).first().doc == doc
    strict = load('{"RowSchema": {"columns": {"a": {"type": "int32"}}}}')
    assert documents.encode(spark.createDataFrame([('{"a": 3}',)], "doc string"), strict).first().a == 3
    with pytest.raises(Exception, match="undeclared"):
        documents.encode(spark.createDataFrame([('{"a": 3, "q": 1}',)], "doc string"), strict).collect()
    pair = spark.createDataFrame([('{"a": 1, "b": [2]}', '{"b":[2],"a":1}'), ('{"a": 1}', '{"a": "1"}')], "p string, q string")
    assert [r[0] for r in pair.select(documents.same_fields(F.col("p"), F.col("q"))).collect()] == [True, False]


def test_delimited(spark, tmp_path):
    t = load('{"RowSchema": {"columns": {"id": {"type": "uint64"}, "s": {"type": "strzero"}, "b": {"type": "fixed", "length": 4}, "u": {"type": "uint8"}}}}')
    path = tmp_path / "in.txt"
    path.write_text("18446744073709551615\ta\txy\t200\n2\tb\n")
    rows = delimited.read_delimited(spark, str(path), t).collect()
    assert [int(r.id) for r in rows] == [2**64 - 1] and bytes(rows[0].b) == b"xy\0\0" and rows[0].u == 200
    path.write_text("3\t\tzzzz\t7\textra\n")
    with pytest.raises(Exception, match="not an integer"):
        delimited.read_delimited(spark, str(path), t).collect()
    parsed = delimited.parse(spark.createDataFrame([("2\tb",)], "value string"), t).first()
    assert parsed.parsed == 2 and parsed.s == "b" and parsed.u is None
    j = delimited.to_json(spark.createDataFrame([(-1, 255, None, bytearray(b"\x01"))], "a tinyint, b smallint, c string, d binary")).first().json
    assert j == '{"a":-1,"b":255,"c":null,"d":"01"}' and delimited.to_json(spark.range(1).select()).first().json == "emptyJson{}"
    assert delimited.dump(spark.range(10), "id", 4, 2).count() == 2


@pytest.fixture
def many_files(spark):
    # small partitions stay files of their own, as large ones do
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_seeks_open_only_files_that_can_hold_the_key(spark, tmp_path, many_files):
    register_segment("frozen", compression="gzip")
    store = Store.create(spark, str(tmp_path / "t"), T.StructType([*ROW, T.StructField("s", T.StringType())]), [["k"]], bloom=["s"], segment_bytes=2000)
    rng = random.Random(3)
    keys = list(range(800))
    rng.shuffle(keys)
    for at in (0, 400):
        store.insert(spark.createDataFrame([(k, f"v{k}", f"s{k}", n) for n, k in enumerate(keys[at : at + 400])], "k int, v string, s string, n int"), "n")
    # every segment holds keys of the whole range, but each file of it only a part
    assert all(len(store.between([k], [k], high_inclusive=True).inputFiles()) < len(store.read().inputFiles()) for k in (3, 500))
    store.compact()
    files = len(store.read().inputFiles())
    assert files > 2 and len(store.manifest()["segments"]) > 1
    for k in (0, 3, 399, 500, 799):
        hit = store.exact([k])
        assert len(hit.inputFiles()) < files and [r.v for r in hit.collect()] == [f"v{k}"]
    assert store.exact([900]).inputFiles() == [] and store.exact([900]).count() == 0
    assert sorted(r.k for r in store.between([10], [20]).collect()) == list(range(10, 20)) and store.between([790]).count() == 10 and store.between((), [5]).count() == 5
    rid = store.exact([500], ids=True).first()["__rid"]
    assert store.get(rid)["v"] == "v500" and 1 <= len(store.segment_of(rid)) <= len(store.manifest()["segments"]) and store.segment_of(10**9) == []
    assert store.segments().agg(F.sum("rows")).first()[0] == 800 and min(r.first_rid for r in store.segments().collect()) == 0
    with pytest.raises(LookupError, match="out of range"):
        store.get(800)


def test_columns_change_in_place(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "t"), T.StructType([*ROW, T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]), [["k"]], in_place=[["a", "b"]])
    store.insert(spark.createDataFrame([(k, f"v{k}", k, None) for k in range(6)], "k int, v string, a int, b int"))
    ids = {r.k: r["__rid"] for r in store.read(ids=True).collect()}
    store.set_columns({"a": "a + 100"}, "k >= 4")
    store.set_columns({"b": "1", "a": "a + 1000"}, "k = 5")
    store.set_columns({"b": "2"}, "k = 77")
    now = lambda v=None: {r.k: (r.a, r.b) for r in store.read(v).collect()}
    want = {**{k: (k, None) for k in range(4)}, 4: (104, None), 5: (1105, 1)}
    assert now() == want and now(1)[5] == (5, None) and now(2)[5] == (105, None)
    assert {r.k: r["__rid"] for r in store.read(ids=True).collect()} == ids and len(store.manifest()["segments"]) == 1
    assert sorted((r.op, r.k, r.a) for r in store.changes(1).collect()) == [("update", 4, 104), ("update", 5, 1105)]
    spark.dataSource.register(TableSource)
    with pytest.raises(Exception, match="in place"):
        spark.read.format("kittiwake").load(str(tmp_path / "t")).collect()
    store.delete("k = 4")
    store.purge()
    assert now() == {k: v for k, v in want.items() if k != 4} and store.manifest()["overlays"] == []
    assert spark.read.format("kittiwake").load(str(tmp_path / "t")).count() == 5
    with pytest.raises(ValueError):
        store.set_columns({"v": "'x'"}, "k = 1")
    with pytest.raises(ValueError):
        Store.create(spark, str(tmp_path / "u"), ROW, [["k"]], in_place=[["k"]])


def test_a_transaction_keeps_unique_keys(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "t"), ROW, [["k"]])
    store.insert(put(spark, [(1, "a"), (2, "b")]), "n")
    for rows in ([(1, "x")], [(3, "x"), (3, "y")]):
        with pytest.raises(ValueError, match="unique"):
            store.transact(put(spark, rows).drop("n"))
    store.transact(put(spark, [(1, "A"), (None, "x"), (None, "y")]).drop("n"), put(spark, [(1, None)]))
    assert sorted(((r.k, r.v) for r in store.read().collect()), key=str) == [(1, "A"), (2, "b"), (None, "x"), (None, "y")]
    one, two = store.begin(), store.begin()
    one.upsert(put(spark, [(2, "one"), (5, "new")]), "n")
    two.delete(put(spark, [(2, None)]))
    assert {r.k for r in one.rows().collect()} == {1, 2, 5, None} and 2 not in {r.k for r in two.rows().collect()} and state(store)[2] == "b"
    one.commit()
    with pytest.raises(CommitConflict, match="another writer"):
        two.commit()
    three = store.begin()
    three.insert(put(spark, [(5, "again")]).drop("n"))
    with pytest.raises(ValueError, match="unique"):
        three.commit()
    three.rollback()
    three.upsert(put(spark, [(6, "six")]), "n")
    store.delete("k = 1")
    three.commit()
    assert {k: v for k, v in state(store).items() if k} == {2: "one", 5: "new", 6: "six"}


def test_deleted_rows_come_back(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "t"), ROW, [["k"]])
    store.insert(put(spark, [(k, f"v{k}") for k in range(5)]), "n")
    ids = {r.k: r["__rid"] for r in store.read(ids=True).collect()}
    store.delete("k >= 2")
    store.undelete("k = 3")
    assert state(store) == {0: "v0", 1: "v1", 3: "v3"} and state(store, 2) == {0: "v0", 1: "v1"}
    assert {r.k: r["__rid"] for r in store.read(ids=True).collect()} == {k: ids[k] for k in (0, 1, 3)}
    assert sorted((r.op, r.k) for r in store.changes(2).collect()) == [("restore", 3)]
    store.delete("k = 3")
    assert state(store) == {0: "v0", 1: "v1"} and state(store, 3)[3] == "v3"
    spark.dataSource.register(TableSource)
    assert {v: spark.read.format("kittiwake").option("version", str(v)).load(str(tmp_path / "t")).count() for v in (1, 2, 3, 4)} == {1: 5, 2: 2, 3: 3, 4: 2}
    store.insert(put(spark, [(4, "other")]), "n")
    with pytest.raises(ValueError, match="unique"):
        store.undelete("k = 4")


def test_vacuum_spares_a_commit_under_way(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "t"), ROW, [["k"]])
    other = Store.open(spark, str(tmp_path / "t"))
    publish = store._publish

    def late(m):
        assert other.vacuum(keep_seconds=0) == 0
        publish(m)

    store._publish = late
    store.insert(put(spark, [(1, "a")]), "n")
    store._publish = publish
    assert state(other) == {1: "a"} and not [n for n in store.files.list() if n.startswith(".writing")]
    # a commit that failed leaves files that go, and old manifests and what only they name go too
    with pytest.raises(RuntimeError, match="lost"):
        store._commit(lambda m: (store._apply(m, put(spark, [(2, "b")]).drop("n"), None), (_ for _ in ()).throw(RuntimeError("lost")))[0])
    store.compact()
    assert len(store.versions()) == 3 and store.vacuum() == 1
    assert store.vacuum(keep_seconds=0) == 3 and store.versions() == [2] and state(store) == {1: "a"} and state(store, 1) == {1: "a"}
    with pytest.raises(CommitConflict, match="past"):
        store._publish(store.manifest() | {"version": 1})
    assert store.versions() == [2] and store.copy_to(str(tmp_path / "copy")).read().count() == 1


def test_throttle_and_hooks(spark, tmp_path):
    Store.create(spark, str(tmp_path / "t"), ROW)
    seen, store = [], Store(spark, str(tmp_path / "t"), bytes_per_second=1.0, wait=False)
    store.hooks.append(lambda m: seen.append(m["version"]))
    store.insert(put(spark, [(1, "a")]))
    with pytest.raises(WriteThrottled):
        store.insert(put(spark, [(2, "b")]))
    assert seen == [1] and state(store) == {1: "a"}
    store.bytes_per_second, store.wait, store._paid = 1e6, True, time.time() + 0.2
    store.insert(put(spark, [(2, "b")]))
    assert seen == [1, 2] and store._paid > time.time() - 5


def test_collection(spark, tmp_path):
    t = load('{"RowSchema": {"columns": {"_id": {"type": "int32"}, "s": {"type": "strzero"}, "at": {"type": "int64", "mongoType": "timestamp"}, "$$": {"type": "carbin"}}}, "TableIndex": [{"fields": "_id", "unique": true}]}')
    c = documents.Collection.create(spark, str(tmp_path / "c"), t)
    docs = lambda *d: spark.createDataFrame([(x, n) for n, x in enumerate(d)], "doc string, n int")
    rejected = c.insert(docs('{"_id": 1, "s": "a", "more": [1, 2]}', '{"_id": 2, "at": {"$timestamp": 99}}', '{"_id": 1, "s": "again"}'), seq="n")
    assert [(r["_id"], r.s) for r in rejected.collect()] == [(1, "again")]
    c.update(docs('{"_id": 2, "s": "old"}', '{"_id": 2, "s": "new", "at": {"$timestamp": 7}}', '{"_id": 3}'), "n")
    assert sorted(r.doc for r in c.find().collect()) == ['{"_id":1,"s":"a","at":{"$timestamp":0},"more":[1,2]}', '{"_id":2,"s":"new","at":{"$timestamp":7}}', '{"_id":3,"s":"","at":{"$timestamp":0}}']
    c.delete("_id = 1")
    assert c.find("s = 'new'").count() == 1 and c.find().count() == 2
    d = spark.createDataFrame([('{"a": [1, 2], "o": {"x": 1, "y": "z"}}',), ('{"a": [1, "b"], "o": 5}',), ('{"a": []}',), (None,)], "doc string")
    got = d.select(documents.array_of(F.col("doc"), "a").alias("a"), F.to_json(documents.object_of(F.col("doc"), "o")).alias("o")).select("a.n", "a.kind", "o").collect()
    assert [tuple(r) for r in got] == [(2, "BIGINT", '{"x":1,"y":"z"}'), (2, None, None), (0, None, None), (None, None, None)]
    delimited.write_lines(spark.range(3), str(tmp_path / "lines"), compression="gzip")
    assert spark.read.text(str(tmp_path / "lines")).count() == 3 and any(f.endswith(".gz") for f in os.listdir(tmp_path / "lines"))
