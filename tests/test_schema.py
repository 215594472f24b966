import json

import pytest
from pyspark.sql import types as T

from kittiwake.schema import REST, SchemaError, load, parse_size


def text(columns, **more):
    return json.dumps({"RowSchema": {"columns": columns}} | more)


READING = {
    "station": {"type": "strzero"}, "at": {"type": "int64"}, "quality": {"type": "UINT8", "colstore": True}, "serial": {"type": "uint32"}, "probe": {"type": "fixed", "length": 24},
    "note": {"type": "strzero"}, "kelvin": {"type": "float64"},
}


def test_table_of_readings():
    t = load(text(READING, TableIndex=[{"columns": ["station", "at"], "unique": True}, {"fields": "serial"}, {"fields": "note", "ordered": False, "enableLinearScan": True}], ColumnGroups={"where": {"fields": ["station"]}}, MaxWritingSegmentSize="3G", EnableSnapshot=True))
    assert [f.dataType for f in t.struct()][:4] == [T.StringType(), T.LongType(), T.ShortType(), T.LongType()] and not any(f.nullable for f in t.struct())
    assert t.index("station,at").columns == ("station", "at") and t.unique_keys() == [("station", "at")] and not t.index(2).ordered and t.index("note").linear_scan
    assert t.group("where").columns == ("station",) and t.group("quality").in_place and t.group(REST).columns == ("probe", "kelvin")
    assert t.sizes == {"MaxWritingSegmentSize": 3 << 30} and t.permanent_ids
    assert t.project(["serial", "at", "serial"]) == [3, 1, 3] and t.column("probe").width == 24 and t.column(2).name == "quality"
    assert t.struct()["probe"].metadata["length"] == 24
    for wrong in (lambda: t.column("x"), lambda: t.column(99), lambda: t.index("x"), lambda: t.group("x"), lambda: t.index(9)):
        with pytest.raises(SchemaError):
            wrong()


@pytest.mark.parametrize(
    "bad",
    [
        text({}), text({"a b": {"type": "int32"}}), text({"a": {"type": "no"}}), text({"a": {"type": "fixed"}}), text({"a": {"type": "fixed", "length": 70000}}),
        '{"RowSchema": {"columns": {"a": {"type": "int32"}, "a": {"type": "int32"}}}}', text({"$$": {"type": "carbin"}, "a": {"type": "int32"}}),
        text({"a": {"type": "int32"}}, TableIndex=[{"fields": "b"}]), text({"a": {"type": "int32"}}, TableIndex=[{"fields": "a"}, {"fields": "a"}]), text({"a": {"type": "int32"}}, TableIndex=[{"fields": "a", "name": "x:y"}]),
        text({f"c{k}": {"type": "int8"} for k in range(65)}, TableIndex=[{"name": "wide", "fields": [f"c{k}" for k in range(65)]}]),
        text({"a": {"type": "int32"}}, ColumnGroups={"a": {"fields": ["a"]}}), text({"a": {"type": "int32"}}, ColumnGroups={"g": {"fields": ["b"]}}), text({"a": {"type": "int32"}}, ColumnGroups={"g": {"fields": ["a"]}, "h": {"fields": ["a"]}}),
        text({"a": {"type": "strzero"}}, ColumnGroups={"g": {"fields": ["a"], "inplaceUpdatable": True}}), text({"a": {"type": "int32"}}, TableIndex=[{"fields": "a"}], ColumnGroups={"g": {"fields": ["a"], "inplaceUpdatable": True}}),
        text({"a": {"type": "int32"}}, EnableSnapshot=True, PermanentRecordId=False), text({"a": {"type": "int32"}}, MaxWritingSegmentSize="3X"),
    ],
)
def test_rules(bad):
    with pytest.raises(SchemaError):
        load(bad)


def test_tail_nested_and_equality():
    t = load(text({"a": {"type": "int32"}, "n": {"type": "nested"}, "$$": {"type": "carbin"}}))
    assert [c.name for c in t.columns] == ["a", "$$"] and t.skipped == ["n"]
    assert t.same_as(load(text({"b": {"type": "int32"}, "$$": {"type": "carbin"}})), names=False) and not t.same_as(load(text({"b": {"type": "int32"}, "$$": {"type": "carbin"}})))


def test_sizes():
    assert [parse_size(x) for x in (5, "10", "1K", "2 MB", "1.5g", "1TiB")] == [5, 10, 1024, 2 << 20, 3 << 29, 1 << 40]


def test_document_types():
    kinds = {"a": ("int32", "date"), "b": ("strzero", "bindata"), "c": ("double", "double"), "d": ("int64", "timestamp"), "e": ("carbin", "array"), "f": ("twostrzero", "regex"), "g": ("int8", "bool")}
    t = load(text({k: {"type": a, "mongoType": m} for k, (a, m) in kinds.items()} | {"_id": {"type": "fixed", "length": 12}, "n": {"type": "uint32"}}))
    assert [c.document_type for c in t.columns] == ["date", "binary", "double", "timestamp", "array", "regex", "bool", "oid", "int"]
    for kind, wrong in (("int32", "double"), ("int32", "timestamp"), ("strzero", "array"), ("strzero", "int"), ("int8", "date"), ("int32", "no")):
        with pytest.raises(SchemaError):
            load(text({"a": {"type": kind, "mongoType": wrong}}))
    with pytest.raises(SchemaError):
        load(text({"a": {"type": "fixed", "length": 11, "mongoType": "oid"}}))
