"""String and key helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def split_fields(s: Column, delimiter: str, max_fields: int = -1) -> Column:
    """Fields of a text, an empty trailing one kept. A blank delimiter skips leading blanks and takes runs of white space
    as one. At most ``max_fields`` fields, the last with the rest."""
    if delimiter == " ":
        bare = F.regexp_replace(s, r"^\s+|\s+$", "")
        return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+", max_fields))
    return F.split(s, _quoted(delimiter), max_fields)


def split_any(s: Column, delimiters: str, max_fields: int = -1) -> Column:
    """Fields between single characters of ``delimiters``."""
    return F.split(s, "|".join(_quoted(c) for c in delimiters), max_fields)


def trim_space(s: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def chomp_space(s: Column) -> Column:
    """Without white space at the end."""
    return F.regexp_replace(s, r"\s+$", "")


def chomp_line(s: Column) -> Column:
    """Without carriage returns and line feeds at the end."""
    return F.regexp_replace(s, r"[\r\n]+$", "")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix; null if either is null."""
    n = F.least(F.length(a), F.length(b))
    equal = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.array_max(equal)


def hex_of(b: Column) -> Column:
    return F.hex(b)


def from_hex(s: Column) -> Column:
    """Bytes of a hexadecimal text; null if it is not one."""
    return F.unhex(s)


def utf_encode(s: Column, bits: int = 8, big_endian: bool = True) -> Column:
    """Bytes of a text in UTF-8, UTF-16 or UTF-32."""
    return F.encode(s, {8: "UTF-8", 16: "UTF-16BE" if big_endian else "UTF-16LE", 32: "UTF-32"}[bits])


def utf_decode(b: Column, bits: int = 8, big_endian: bool = True) -> Column:
    return F.decode(b, {8: "UTF-8", 16: "UTF-16BE" if big_endian else "UTF-16LE", 32: "UTF-32"}[bits])


def signed_key(n: Column, bits: int = 64) -> Column:
    """Hexadecimal text of an integer that sorts as the integer does: the sign flipped, the high byte first."""
    digits = bits // 4
    if bits == 64:
        return F.lpad(F.hex(n.cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))), digits, "0")
    return F.lpad(F.hex(n.cast("long") + F.lit(2 ** (bits - 1)).cast("long")), digits, "0")


def signed_from_key(s: Column, bits: int = 64) -> Column:
    raw = F.conv(s, 16, -10).cast("long") if bits == 64 else F.conv(s, 16, 10).cast("long")
    return raw.bitwiseXOR(F.lit(-(2**63)).cast("long")) if bits == 64 else raw - F.lit(2 ** (bits - 1)).cast("long")


def successor(prefix: Column) -> Column:
    """Shortest bytes above all that begin with ``prefix`` (bytes): the last byte below 0xFF raised by one; null if there
    is none."""
    h = F.regexp_replace(F.hex(prefix), r"(?:FF)+$", "")
    last = F.conv(F.substring(h, -2, 2), 16, 10).cast("int") + 1
    return F.when(h != "", F.unhex(F.concat(F.substring(h, F.lit(1), F.length(h) - 2), F.lpad(F.hex(last), 2, "0"))))
