"""Declared tables: column types, column groups and indexes from a JSON definition, as Spark types."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Names of column types and what they stand for.
TYPE_NAMES = {
    "uint8": ("byte", "ubyte", "uint8", "uint08"),
    "sint8": ("sbyte", "int8", "int08", "sint8", "sint08"),
    "uint16": ("uint16",),
    "sint16": ("int16", "sint16"),
    "uint32": ("uint32",),
    "sint32": ("int32", "sint32"),
    "uint64": ("uint64",),
    "sint64": ("int64", "sint64"),
    "uint128": ("uint128",),
    "sint128": ("int128", "sint128"),
    "float32": ("float", "float32"),
    "float64": ("double", "float64"),
    "float128": ("float128",),
    "uuid": ("uuid", "guid"),
    "fixed": ("fixed",),
    "varsint": ("varsint", "varint"),
    "varuint": ("varuint",),
    "strzero": ("strzero",),
    "twostrzero": ("twostrzero",),
    "binary": ("binary",),
    "carbin": ("carbin",),
    "any": ("any", "anytype"),
    "nested": ("nested",),
}
_KIND = {name: kind for kind, names in TYPE_NAMES.items() for name in names}

# Bytes of each fixed-width type.
WIDTH = {"uint8": 1, "sint8": 1, "uint16": 2, "sint16": 2, "uint32": 4, "sint32": 4, "uint64": 8, "sint64": 8, "uint128": 16, "sint128": 16, "float32": 4, "float64": 8, "float128": 16, "uuid": 16}

SPARK = {
    "uint8": T.ShortType(), "sint8": T.ByteType(), "uint16": T.IntegerType(), "sint16": T.ShortType(), "uint32": T.LongType(), "sint32": T.IntegerType(),
    "uint64": T.DecimalType(20, 0), "sint64": T.LongType(), "uint128": T.BinaryType(), "sint128": T.BinaryType(), "float32": T.FloatType(), "float64": T.DoubleType(),
    "float128": T.DoubleType(), "uuid": T.BinaryType(), "fixed": T.BinaryType(), "varsint": T.LongType(), "varuint": T.DecimalType(20, 0), "strzero": T.StringType(),
    "twostrzero": T.StructType([T.StructField("pattern", T.StringType()), T.StructField("options", T.StringType())]), "binary": T.BinaryType(), "carbin": T.BinaryType(), "any": T.StringType(),
}

# Document types that a column type takes by default.
DOCUMENT_TYPE = {
    "uint8": "bool", "sint8": "bool", "uint16": "int", "sint16": "int", "uint32": "int", "sint32": "int", "uint64": "long", "sint64": "long", "uint128": "long", "sint128": "long",
    "float32": "double", "float64": "double", "float128": "decimal", "varsint": "long", "varuint": "long", "strzero": "string", "twostrzero": "regex", "binary": "binary",
    "carbin": "object", "fixed": "binary", "uuid": "binary", "any": "any",
}

INTEGERS = frozenset(k for k in WIDTH if "int" in k) | {"varsint", "varuint"}
NUMBERS = INTEGERS | {"float32", "float64", "float128"}
#: Column types that may be declared to hold a document type.
HOLDS = {
    "bool": INTEGERS, "int": NUMBERS, "long": NUMBERS, "double": {"float32", "float64"}, "decimal": {"float128"}, "date": {"sint32", "uint32", "sint64", "uint64"},
    "timestamp": {"sint64", "uint64"}, "string": {"strzero", "binary"}, "binary": {"carbin", "strzero", "fixed", "binary", "uuid"}, "array": {"carbin"}, "object": {"carbin"}, "regex": {"twostrzero"}, "oid": {"fixed"},
}
_SAME_TYPE = {"bindata": "binary"}
STRINGS = frozenset({"strzero", "twostrzero", "binary", "carbin"})
MAX_INDEX_COLUMNS = 64
MAX_FIXED = 65536
TAIL = "$$"
REST = ".RestAll"
_BAD_NAME = re.compile(r"""[/\\\[\](){}<>?|~`'"!#%^&*=:;\s]""")
_SIZE = re.compile(r"^\s*(\d+(?:\.\d+)?)\s*([KMGTP]?)I?B?\s*$", re.I)


class SchemaError(ValueError):
    """A table definition that breaks a rule."""


def parse_size(value: int | float | str) -> int:
    """Bytes of a number or of a string with K, M, G, T or P (base 1024, B optional)."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise SchemaError(f"not a size: {value!r}")
    if not isinstance(value, str):
        return int(value)
    m = _SIZE.match(value)
    if not m:
        raise SchemaError(f"not a size: {value!r}")
    return int(float(m[1]) * 1024 ** " KMGTP".index(m[2].upper() or " "))


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    length: int | None = None
    document_type: str | None = None
    own_group: bool = False

    @property
    def width(self) -> int | None:
        """Bytes of a fixed-width column, else None."""
        return self.length if self.kind == "fixed" else WIDTH.get(self.kind)

    def spark(self) -> T.StructField:
        meta = {"kind": self.kind, "document_type": self.document_type or DOCUMENT_TYPE.get(self.kind, "any")}
        if self.length is not None:
            meta["length"] = self.length
        return T.StructField(self.name, SPARK[self.kind], False, meta)


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    ordered: bool = True
    unique: bool = False
    linear_scan: bool = False


@dataclass(frozen=True)
class Group:
    name: str
    columns: tuple[str, ...]
    in_place: bool = False


@dataclass
class TableDef:
    columns: list[Column]
    indexes: list[Index] = field(default_factory=list)
    groups: list[Group] = field(default_factory=list)
    snapshots: bool = False
    permanent_ids: bool = False
    sizes: dict[str, int] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)

    def struct(self) -> T.StructType:
        return T.StructType([c.spark() for c in self.columns])

    def column_id(self, name: str) -> int:
        for k, c in enumerate(self.columns):
            if c.name == name:
                return k
        raise SchemaError(f"no column {name!r}")

    def column(self, name_or_id: str | int) -> Column:
        if isinstance(name_or_id, str):
            return self.columns[self.column_id(name_or_id)]
        if not 0 <= name_or_id < len(self.columns):
            raise SchemaError(f"no column {name_or_id}")
        return self.columns[name_or_id]

    def index(self, name_or_id: str | int) -> Index:
        if isinstance(name_or_id, int):
            if not 0 <= name_or_id < len(self.indexes):
                raise SchemaError(f"no index {name_or_id}")
            return self.indexes[name_or_id]
        for i in self.indexes:
            if i.name == name_or_id:
                return i
        raise SchemaError(f"no index {name_or_id!r}")

    def group(self, name_or_id: str | int) -> Group:
        if isinstance(name_or_id, int):
            if not 0 <= name_or_id < len(self.groups):
                raise SchemaError(f"no column group {name_or_id}")
            return self.groups[name_or_id]
        for g in self.groups:
            if g.name == name_or_id:
                return g
        raise SchemaError(f"no column group {name_or_id!r}")

    def project(self, names: list[str]) -> list[int]:
        """Positions of columns by name, in the order given, repeats kept."""
        return [self.column_id(n) for n in names]

    def unique_keys(self) -> list[tuple[str, ...]]:
        return [i.columns for i in self.indexes if i.unique]

    def in_place_columns(self) -> set[str]:
        return {c for g in self.groups if g.in_place for c in g.columns}

    def same_as(self, other: TableDef, names: bool = True) -> bool:
        """Equal numbers of columns, types and lengths, and names if asked."""
        key = lambda c: (c.kind, c.length, c.name if names else "")
        return list(map(key, self.columns)) == list(map(key, other.columns))


def _check_name(name: str, what: str) -> str:
    if not name or _BAD_NAME.search(name):
        raise SchemaError(f"bad {what} name {name!r}")
    return name


def _names(value: object) -> list[str]:
    """A list of names from an array or a comma-separated string."""
    got = value.split(",") if isinstance(value, str) else list(value or ())
    got = [str(x).strip() for x in got]
    if not got or not all(got):
        raise SchemaError(f"no column names in {value!r}")
    return got


def _flag(entry: dict, name: str, default: bool) -> bool:
    return bool(entry.get(name, default))


def _document_type(name: str, kind: str, length: int | None, declared: str | None) -> str:
    """The document type of a column, declared or by default; SchemaError where the column cannot hold it."""
    if declared is None:
        return "oid" if kind == "fixed" and name == "_id" and length == 12 else DOCUMENT_TYPE[kind]
    t = _SAME_TYPE.get(declared.lower(), declared.lower())
    if t not in HOLDS:
        raise SchemaError(f"column {name!r}: unknown document type {declared!r}")
    if kind not in HOLDS[t] or (t == "oid" and length != 12):
        raise SchemaError(f"column {name!r}: {kind} cannot hold {t}")
    return t


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise SchemaError(f"{k!r} is given twice")
        out[k] = v
    return out


def load(text: str) -> TableDef:
    """Table definition from JSON text; every broken rule raises SchemaError."""
    root = json.loads(text, object_pairs_hook=_pairs)
    declared = root.get("RowSchema", {}).get("columns")
    if not declared:
        raise SchemaError("RowSchema.columns is missing or empty")
    columns, skipped = [], []
    for k, (name, entry) in enumerate(declared.items()):
        if name == TAIL:
            if k != len(declared) - 1:
                raise SchemaError(f"{TAIL} must be the last column")
            columns.append(Column(TAIL, "carbin"))
            continue
        _check_name(name, "column")
        kind = _KIND.get(str(entry.get("type", "")).lower())
        if kind is None:
            raise SchemaError(f"column {name!r}: unknown type {entry.get('type')!r}")
        if kind == "nested":
            skipped.append(name)
            continue
        length = None
        if kind == "fixed":
            length = entry.get("length")
            if not isinstance(length, int) or not 1 <= length <= MAX_FIXED:
                raise SchemaError(f"column {name!r}: length must be 1 to {MAX_FIXED}")
        columns.append(Column(name, kind, length, _document_type(name, kind, length, entry.get("mongoType")), _flag(entry, "colstore", False)))
    known = {c.name: c for c in columns}

    indexes: list[Index] = []
    for entry in root.get("TableIndex", []):
        cols = _names(entry.get("fields", entry.get("columns")))
        name = str(entry.get("name") or ",".join(cols))
        _check_name(name, "index")
        if len(cols) > MAX_INDEX_COLUMNS:
            raise SchemaError(f"index {name!r} has over {MAX_INDEX_COLUMNS} columns")
        for c in cols:
            if c not in known:
                raise SchemaError(f"index {name!r}: unknown column {c!r}")
        if any(i.name == name for i in indexes):
            raise SchemaError(f"index {name!r} is given twice")
        indexes.append(Index(name, tuple(cols), _flag(entry, "ordered", True), _flag(entry, "unique", False), _flag(entry, "enableLinearScan", False)))

    indexed = {c for i in indexes for c in i.columns}
    groups = [Group(i.name, i.columns) for i in indexes]
    grouped: dict[str, str] = {}
    for name, entry in (root.get("ColumnGroups") or root.get("ColumnGroup") or root.get("colgroup") or {}).items():
        cols = _names(entry.get("fields", entry.get("columns")) if isinstance(entry, dict) else entry)
        _check_name(name, "column group")
        if name in known:
            raise SchemaError(f"column group {name!r} has the name of a column")
        for c in cols:
            if c not in known:
                raise SchemaError(f"column group {name!r}: unknown column {c!r}")
            if c in grouped:
                raise SchemaError(f"column {c!r} is in groups {grouped[c]!r} and {name!r}")
            grouped[c] = name
        in_place = isinstance(entry, dict) and _flag(entry, "inplaceUpdatable", False)
        if in_place and any(known[c].width is None or c in indexed for c in cols):
            raise SchemaError(f"column group {name!r}: in-place columns must have fixed width and no index")
        groups.append(Group(name, tuple(cols), in_place))
    for c in columns:
        if c.own_group and c.name not in grouped and (c.name,) not in {g.columns for g in groups}:
            groups.append(Group(c.name, (c.name,), c.width is not None and c.name not in indexed))
    held = {c for g in groups for c in g.columns}
    rest = tuple(c.name for c in columns if c.name not in held)
    if rest:
        groups.append(Group(REST, rest))

    snapshots = _flag(root, "EnableSnapshot", False)
    if snapshots and root.get("PermanentRecordId") is False:
        raise SchemaError("EnableSnapshot needs permanent record ids")
    sizes = {k: parse_size(v) for k, v in root.items() if k.endswith(("Size", "Memory", "SizeLimit", "MemLimit")) and isinstance(v, (int, str))}
    return TableDef(columns, indexes, groups, snapshots, snapshots or _flag(root, "PermanentRecordId", False), sizes, skipped)


def load_file(path: str) -> TableDef:
    with open(path, encoding="utf-8") as f:
        return load(f.read())
