"""Coercions between document values and declared columns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least and greatest value of every number type.
LIMITS = {
    "uint8": (0, 2**8 - 1), "sint8": (-(2**7), 2**7 - 1), "uint16": (0, 2**16 - 1), "sint16": (-(2**15), 2**15 - 1), "uint32": (0, 2**32 - 1), "sint32": (-(2**31), 2**31 - 1),
    "uint64": (0, 2**64 - 1), "sint64": (-(2**63), 2**63 - 1), "varuint": (0, 2**64 - 1), "varsint": (-(2**63), 2**63 - 1),
    "float32": (-3.4028234663852886e38, 3.4028234663852886e38), "float64": (-1.7976931348623157e308, 1.7976931348623157e308),
}
SPARK_NAME = {"uint8": "smallint", "sint8": "tinyint", "uint16": "int", "sint16": "smallint", "uint32": "bigint", "sint32": "int", "uint64": "decimal(20,0)", "sint64": "bigint", "varuint": "decimal(20,0)", "varsint": "bigint", "float32": "float", "float64": "double"}
_BITS = {"uint8": 8, "sint8": 8, "uint16": 16, "sint16": 16, "uint32": 32, "sint32": 32, "uint64": 64, "sint64": 64, "varuint": 64, "varsint": 64}


def _big(n: int) -> Column:
    """A literal of any size."""
    return F.lit(str(n)).cast("decimal(38,0)")


def wrap(value: Column, kind: str) -> Column:
    """An integer value reduced to the width of ``kind``, as two's complement."""
    bits, low = _BITS[kind], LIMITS[kind][0]
    big = value.cast("decimal(38,0)")
    modulus, half = _big(2**bits), _big(-low)
    r = (big + half) % modulus
    return (F.when(r < 0, r + modulus).otherwise(r) - half).cast(SPARK_NAME[kind])


def wrap_long(value: Column, kind: str) -> Column:
    """The same for a 64-bit value, by shifts and masks."""
    bits, low = _BITS[kind], LIMITS[kind][0]
    if bits == 64:
        return value if low else F.when(value < 0, value.cast("decimal(20,0)") + _big(2**64)).otherwise(value).cast(SPARK_NAME[kind])
    if not low:
        return value.bitwiseAND(F.lit(2**bits - 1).cast("long")).cast(SPARK_NAME[kind])
    return F.shiftright(F.shiftleft(value, 64 - bits), 64 - bits).cast(SPARK_NAME[kind])


def saturate(value: Column, kind: str) -> Column:
    """A double truncated toward zero and held within the limits of an integer kind; NaN becomes 0."""
    low, high = LIMITS[kind]
    v = value.cast("double")
    whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
    lit = lambda x: _big(x).cast(SPARK_NAME[kind])
    return F.when(F.isnan(v), lit(0)).when(v <= float(low), lit(low)).when(v >= float(high), lit(high)).otherwise(whole.cast(SPARK_NAME[kind]))


def number_of_text(text: Column, kind: str) -> Column:
    """The number that a whole text spells, leading blanks allowed, integers wrapped to their width; anything else is
    an error in ANSI mode, as it is for the declared column."""
    bare = F.regexp_replace(text, r"^\s+", "")
    if kind in _BITS:
        good = bare.rlike(r"\A[+-]?[0-9]{1,38}\z")
        return F.when(text.isNotNull(), wrap(F.when(good, bare).otherwise(F.raise_error(F.concat(F.lit("not an integer: "), bare)).cast("string")), kind))
    good = bare.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    return F.when(text.isNotNull(), F.when(good, bare).otherwise(F.raise_error(F.concat(F.lit("not a number: "), bare)).cast("string")).cast(SPARK_NAME[kind]))


def text_of_number(value: Column, kind: str) -> Column:
    """Integers as they are, floating numbers with six decimals."""
    return F.format_string("%.6f", value.cast("double")) if kind in ("float32", "float64") else value.cast("string")


def zero_if_missing(value: Column, kind: str) -> Column:
    """A missing value becomes 0, 0.0, the empty text or no bytes."""
    if kind in SPARK_NAME:
        return F.coalesce(value, F.lit(0).cast(SPARK_NAME[kind]))
    return F.coalesce(value, F.lit("") if kind in ("strzero", "any") else F.lit(b""))


def least_value(kind: str) -> Column:
    low = LIMITS[kind][0]
    return (_big(low) if kind in _BITS else F.lit(low)).cast(SPARK_NAME[kind])


def greatest_value(kind: str) -> Column:
    high = LIMITS[kind][1]
    return (_big(high) if kind in _BITS else F.lit(high)).cast(SPARK_NAME[kind])


def number_of_bool(value: Column) -> Column:
    return value.cast("smallint")


def seconds_of_date(ts: Column) -> Column:
    """Whole seconds since 1970, milliseconds cut toward zero, in 32 bits."""
    ms = F.unix_millis(ts.cast("timestamp"))
    return wrap(F.when(ms >= 0, F.floor(ms / 1000)).otherwise(F.ceil(ms / 1000)), "sint32")


def millis_of_date(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def date_of_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def date_of_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def object_id(hexadecimal: Column) -> Column:
    """12 bytes of an object id in hexadecimal; an error for another length."""
    return F.when(hexadecimal.rlike(r"\A[0-9a-fA-F]{24}\z"), F.unhex(hexadecimal)).otherwise(F.raise_error(F.concat(F.lit("not an object id: "), F.coalesce(hexadecimal, F.lit("null")))).cast("binary"))


def regex_pair(pattern: Column, options: Column) -> Column:
    return F.struct(pattern.alias("pattern"), options.alias("options"))


def binary_for_text(data: Column, subtype: Column | int = 0) -> Column:
    """Bytes for a zero-terminated column: subtype + 1 first, no zero byte allowed."""
    kind = F.lit(subtype) if isinstance(subtype, int) else subtype
    plain = F.locate("00", F.regexp_replace(F.hex(data), "(..)", "$1 ")) == 0
    return F.when(plain, F.concat(F.unhex(F.lpad(F.hex(kind + 1), 2, "0")), data)).otherwise(F.raise_error(F.lit("a zero byte cannot be stored here")).cast("binary"))
