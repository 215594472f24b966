"""Access through an index: exact keys, seeks, ranges, prefixes and regular expressions.

An index is a list of key columns; the physical side of it is the order and the statistics of the files. Every predicate
is written so that it reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kittiwake.functions.strings import common_prefix_length


def _columns(rows: DataFrame, keys: Sequence[str], values: Sequence) -> None:
    if not keys or len(values) > len(keys):
        raise ValueError("as many key values as key columns, or fewer")
    for k in keys:
        rows[k]  # unknown columns fail here


def key_equals(keys: Sequence[str], values: Sequence) -> Column:
    """Every key column equals its value; no value at all leaves the key open."""
    out = F.lit(True)
    for k, v in zip(keys, values):
        out = out & (F.col(k) == F.lit(v))
    return out


def key_beyond(keys: Sequence[str], values: Sequence, *, above: bool = True, inclusive: bool = True) -> Column:
    """Composite comparison in the order of the key columns, expanded so that its first column can prune files. No values:
    everything."""
    if not values:
        return F.lit(True)
    pairs = list(zip(keys, values))
    out: Column | None = None
    for n in range(len(pairs)):
        part = key_equals([k for k, _ in pairs[:n]], [v for _, v in pairs[:n]])
        k, v = pairs[n]
        c = F.col(k)
        last = n == len(pairs) - 1
        step = (c >= v if inclusive and last else c > v) if above else (c <= v if inclusive and last else c < v)
        part = part & step
        out = part if out is None else out | part
    first = F.col(pairs[0][0])
    lead = first >= pairs[0][1] if above else first <= pairs[0][1]
    return lead & out


def exact(rows: DataFrame, keys: Sequence[str], values: Sequence, rid: str | None = None, newest_first: bool = True) -> DataFrame:
    """Rows whose key equals ``values``, the highest record id first unless told otherwise."""
    _columns(rows, keys, values)
    found = rows.where(key_equals(keys, values))
    return found.orderBy(F.col(rid).desc() if newest_first else F.col(rid).asc()) if rid else found


def key_exists(rows: DataFrame, keys: Sequence[str], values: Sequence) -> bool:
    return bool(exact(rows, keys, values).limit(1).count())


def keys_exist(rows: DataFrame, keys: Sequence[str], asked: DataFrame, name: str = "found") -> DataFrame:
    """The rows of ``asked``, which has the key columns, and whether their key is in the index; null keys never are."""
    known = rows.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return asked.join(known, list(keys), "left").select(*[asked[c] for c in asked.columns], F.coalesce("__hit", F.lit(False)).alias(name))


def key_counts(rows: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Every key of an index that need not be unique, with the number of its rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def ordered(rows: DataFrame, keys: Sequence[str], rid: str, descending: bool = False) -> DataFrame:
    """Rows in index order, ties by record id in the same direction."""
    return rows.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in (*keys, rid)])


def top(rows: DataFrame, keys: Sequence[str], rid: str, n: int, descending: bool = False) -> DataFrame:
    """The first ``n`` rows in index order."""
    return ordered(rows, keys, rid, descending).limit(n)


def seek(rows: DataFrame, keys: Sequence[str], values: Sequence, rid: str, *, forward: bool = True, inclusive: bool = True) -> DataFrame:
    """The first row at or beyond a key, with ``cmp``: 0 if the key was met, 1 if the next one was.

    Backward, the lower bound means at most and the upper bound less than. No values: the first row in that direction.
    Past the end: no row. Ties go to the smallest record id forward and to the greatest backward."""
    _columns(rows, keys, values)
    hit = top(rows.where(key_beyond(keys, values, above=forward, inclusive=inclusive)), keys, rid, 1, not forward)
    met = key_equals(keys, values) if len(values) == len(keys) else F.lit(False)
    return hit.withColumn("cmp", F.when(met, 0).otherwise(1))


def between(rows: DataFrame, keys: Sequence[str], low: Sequence = (), high: Sequence = (), low_inclusive: bool = True, high_inclusive: bool = False) -> DataFrame:
    """Rows with keys from ``low`` to ``high``, either end open or closed or left out."""
    _columns(rows, keys, low)
    _columns(rows, keys, high)
    return rows.where(key_beyond(keys, low, above=True, inclusive=low_inclusive) & key_beyond(keys, high, above=False, inclusive=high_inclusive))


#: Longer keys are compared letter by letter instead of by a branch of the plan for each.
_BRANCHES = 200


def longest_prefix(rows: DataFrame, column: str, key: str, rid: str) -> DataFrame:
    """The row that shares the longest prefix with ``key``, then the least key, then the least id, with ``matched``: the
    length shared. An empty table gives no row; a null key column shares nothing and is left out."""
    own = rows.where(F.col(column).isNotNull())
    # whether it starts with the key, the key but its last letter, and so on
    length = F.coalesce(*[F.when(F.col(column).startswith(key[:k]), F.lit(k)) for k in range(len(key), 0, -1)], F.lit(0))
    if len(key) > _BRANCHES:
        length = common_prefix_length(F.col(column), F.lit(key))
    return own.withColumn("matched", length).orderBy(F.col("matched").desc(), F.col(column).asc(), F.col(rid).asc()).limit(1)


_ENGINES: dict[str, Callable[[str, str], str]] = {}


def register_regex(name: str, engine: Callable[[str, str], str]) -> None:
    """Add an engine: a function of pattern and options that gives a Java pattern for the whole text."""
    _ENGINES[name] = engine


def _whole(pattern: str, options: str) -> str:
    unknown = set(options) - set("imsx")
    if unknown:
        raise ValueError(f"unknown options {''.join(sorted(unknown))!r}")
    return f"(?s{''.join(sorted(set(options) - {'s'}))})\\A(?:{pattern})\\z"


register_regex("java", _whole)


def matching(rows: DataFrame, column: str, pattern: str, options: str = "", engine: str = "java") -> DataFrame:
    """Rows whose text column matches the pattern as a whole; option ``i`` ignores case."""
    if not isinstance(rows.schema[column].dataType, (T.StringType, T.BinaryType)):
        raise TypeError(f"{column} is not a text column")
    if engine not in _ENGINES:
        raise KeyError(f"no regex engine {engine!r}")
    return rows.where(F.col(column).cast("string").rlike(_ENGINES[engine](pattern, options)))


def check_key(struct: T.StructType, keys: Sequence[str], values: Sequence) -> None:
    """A key of fixed length must have it; arrays and objects cannot be keys."""
    for k, v in zip(keys, values):
        f = struct[k]
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            raise TypeError(f"{k} cannot be a key")
        n = f.metadata.get("length")
        if n is not None and len(v) != n:
            raise ValueError(f"{k} needs {n} bytes, not {len(v)}")


def rank_of(rows: DataFrame, column: str, value) -> int:
    """How many rows sort before ``value``."""
    return rows.where(F.col(column) < value).count()
