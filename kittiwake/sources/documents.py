"""JSON documents into declared columns and back, with the coercions of the declared types.

Special values use extended JSON: {"$date": ms}, {"$oid": hex}, {"$regex": p, "$options": o}, {"$binary": base64},
{"$timestamp": n}, {"$minKey": 1}, {"$maxKey": 1}.
"""

from __future__ import annotations

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kittiwake.functions.coerce import SPARK_NAME, greatest_value, least_value, number_of_text, saturate, text_of_number, wrap, wrap_long, zero_if_missing
from kittiwake.schema import INTEGERS, NUMBERS, TAIL, Column, TableDef
from kittiwake.sources.store import Store


def _fields(doc: Col) -> Col:
    return F.from_json(doc, "map<string,variant>")


def _kind_of(v: Col) -> Col:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _value(c: Column, v: Col, raw: Col, kind: Col, text: Col) -> Col:
    """A declared column from a field: its value, that as JSON, its type, and its text."""
    special = lambda key: F.get_json_object(raw, f"$['{key}']")
    none = v.isNull() | (kind == "VOID")
    if c.kind in NUMBERS and c.kind not in ("uint128", "sint128", "float128"):
        whole = kind == "BIGINT"
        long = F.try_variant_get(v, "$", "bigint")
        number = F.try_variant_get(v, "$", "double")
        if c.kind in INTEGERS:
            date = special("$date").cast("bigint")
            stamp = special("$timestamp")
            dated = F.when(stamp.isNotNull() & F.lit(c.width == 8), wrap(stamp.cast("decimal(20,0)"), c.kind)).when(date.isNotNull(), wrap_long(F.when(date >= 0, F.floor(date / 1000)).otherwise(F.ceil(date / 1000)), c.kind) if c.width == 4 else wrap_long(date, c.kind))
            plain = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("long").cast(SPARK_NAME[c.kind])).when(whole, wrap_long(long, c.kind)).when(kind == "STRING", number_of_text(F.when(kind == "STRING", text), c.kind)).otherwise(saturate(number, c.kind))
        else:
            dated = F.lit(None).cast("double")
            plain = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(kind == "STRING", number_of_text(F.when(kind == "STRING", text), c.kind)).otherwise(number)
        out = F.when(special("$minKey").isNotNull(), least_value(c.kind)).when(special("$maxKey").isNotNull(), greatest_value(c.kind)).when(dated.isNotNull(), dated).otherwise(plain)
        return zero_if_missing(F.when(~none, out), c.kind)
    if c.kind == "twostrzero":
        return F.struct(F.coalesce(special("$regex"), F.lit("")).alias("pattern"), F.coalesce(special("$options"), F.lit("")).alias("options"))
    if c.kind in ("binary", "carbin", "fixed", "uuid"):
        b = F.coalesce(F.unhex(special("$oid")), F.unbase64(special("$binary")), F.when(kind == "STRING", text.cast("binary")), F.when(~none, raw.cast("binary")))
        return F.coalesce(b, F.lit(b""))
    number_text = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint").cast("string")).when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), text_of_number(F.try_variant_get(v, "$", "double"), "float64"))
    return F.coalesce(F.when(kind == "STRING", text), number_text, F.when(~none, raw), F.lit(""))


def encode(rows: DataFrame, definition: TableDef, doc: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """Declared columns of JSON documents, and the columns of ``keep``. Missing and null fields become zero or empty; fields that are not declared go
    to the tail column as JSON text, and are an error without one. A null document counts as an empty one."""
    names = [c.name for c in definition.columns if c.name != TAIL]
    fields = _fields(F.coalesce(F.col(doc), F.lit("{}")))
    own = rows.select(*[F.col(c) for c in keep or ()], fields.alias("__m"))
    declared = [c for c in definition.columns if c.name != TAIL]
    extra = F.map_filter("__m", lambda k, _: ~k.isin(*names) if names else F.lit(True))
    # what several alternatives read is a column of its own, so that it is parsed once
    own = own.select(*(keep or ()), *[F.col("__m")[c.name].alias(f"__v{k}") for k, c in enumerate(declared)], F.to_json(extra).alias("__tail"), F.size(extra).alias("__more"))
    v = [F.col(f"__v{k}") for k in range(len(declared))]
    read = [x for k in range(len(declared)) for x in (v[k], F.to_json(v[k]).alias(f"__raw{k}"), _kind_of(v[k]).alias(f"__kind{k}"), F.try_variant_get(v[k], "$", "string").alias(f"__text{k}"))]
    own = own.select(*(keep or ()), *read, "__tail", "__more")
    cols = [*(keep or ()), *[_value(c, v[k], *[F.col(f"__{x}{k}") for x in ("raw", "kind", "text")]).cast(c.spark().dataType).alias(c.name) for k, c in enumerate(declared)]]
    if len(names) == len(definition.columns):
        return own.where(F.when(F.col("__more") == 0, True).otherwise(F.raise_error(F.concat(F.lit("undeclared fields: "), "__tail")).cast("boolean"))).select(*cols)
    return own.select(*cols, F.col("__tail").cast("binary").alias(TAIL))


def decode(rows: DataFrame, definition: TableDef, name: str = "doc") -> DataFrame:
    """JSON documents of declared columns, undeclared fields after them; binary as {"$binary": base64}, and dates, object
    ids and booleans by their declared document type."""
    cols = []
    for c in definition.columns:
        if c.name == TAIL:
            continue
        x = F.col(f"`{c.name}`")
        if c.kind == "twostrzero":
            x = F.struct(x["pattern"].alias("$regex"), x["options"].alias("$options"))
        elif c.document_type == "oid":
            x = F.struct(F.lower(F.hex(x)).alias("$oid"))
        elif c.document_type == "timestamp":
            x = F.struct(x.alias("$timestamp"))
        elif c.document_type == "date":
            x = F.struct((x.cast("bigint") * (1000 if c.width == 4 else 1)).alias("$date"))
        elif c.document_type == "bool":
            x = x != 0
        elif c.kind in ("binary", "carbin", "fixed", "uuid"):
            x = F.struct(F.base64(x).alias("$binary"))
        cols.append(x.alias(c.name))
    head = F.to_json(F.struct(*cols)) if cols else F.lit("{}")
    if not any(c.name == TAIL for c in definition.columns):
        return rows.select(head.alias(name))
    tail = F.coalesce(F.col(f"`{TAIL}`").cast("string"), F.lit("{}"))
    both = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.when((F.col("h") == "{}") | (F.col("t") == "{}"), "").otherwise(","), F.expr("substring(t, 2)"))
    return rows.select(head.alias("h"), tail.alias("t")).select(both.alias(name))


def undeclared(doc: Col, names: list[str]) -> Col:
    """JSON text of the fields that are not in ``names``."""
    return F.to_json(F.map_filter(_fields(doc), lambda k, _: ~k.isin(*names)))


def same_fields(a: Col, b: Col) -> Col:
    """Whether two documents have the same fields with the same values, in any order."""
    sorted_fields = lambda d: F.array_sort(F.transform(F.map_entries(_fields(d)), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v"))))
    return sorted_fields(a) == sorted_fields(b)


def array_of(doc: Col, name: str) -> Col:
    """(n, kind, items) of an array field: how many elements, their common type or null if they differ or there are none,
    and the elements with a type of their own each; null if the field is no array."""
    raw = F.get_json_object(doc, f"$['{name}']")
    items = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<variant>"))
    kinds = F.array_distinct(F.transform(items, _kind_of))
    return F.when(items.isNotNull(), F.struct(F.size(items).alias("n"), F.when(F.size(kinds) == 1, kinds[0]).alias("kind"), items.alias("items")))


def object_of(doc: Col, name: str) -> Col:
    """Fields of an object field with their own types, as map<string,variant>; null if the field is no object."""
    raw = F.get_json_object(doc, f"$['{name}']")
    return F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, "map<string,variant>"))


class Collection:
    """JSON documents in a table: written by declared columns, read as documents."""

    def __init__(self, store: Store, definition: TableDef):
        self.store, self.definition = store, definition

    @classmethod
    def create(cls, spark: SparkSession, folder: str, definition: TableDef) -> Collection:
        return cls(Store.create(spark, folder, definition), definition)

    def insert(self, rows: DataFrame, doc: str = "doc", seq: str | None = None) -> DataFrame:
        """Append documents; returns the rows of those that a unique key rejects, with a ``reason``."""
        own = encode(rows, self.definition, doc) if seq is None else self._with(rows, doc, seq)
        return self.store.insert(own, seq)

    def _with(self, rows: DataFrame, doc: str, seq: str) -> DataFrame:
        return encode(rows, self.definition, doc, keep=[seq])

    def update(self, rows: DataFrame, seq: str, doc: str = "doc") -> dict:
        """Put documents in place of those with the same unique key; of several the last by ``seq``."""
        return self.store.upsert(self._with(rows, doc, seq), seq)

    def delete(self, where: DataFrame | str) -> dict:
        return self.store.delete(where)

    def find(self, where: str | None = None) -> DataFrame:
        rows = self.store.read()
        return decode(rows if where is None else rows.where(where), self.definition)
