"""Mapping freely typed values to a canonical list.

A symmetric-delete dictionary of the list is broadcast (its size is checked; a longer list is taken in blocks). A typed
value is stripped of what is not part of a name, looked up within a bounded edit distance, and the candidates are ranked
by weighted Damerau-Levenshtein distance, then by how often the entry is written correctly. Misses are reported.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kittiwake.runtime import cut

# Parts of place names and the ways they are shortened; a caller with another list gives their own.
AFFIXES = {
    "great": ("gt", "grt", "gr"),
    "lower": ("lwr", "low", "lr"),
    "upper": ("upr", "up", "uppr"),
    "fort": ("ft", "frt"),
    "mount": ("mt", "mnt"),
    "saint": ("st", "snt"),
    "port": ("pt", "prt"),
    "new": ("nw", "n"),
    "north": ("n", "nth", "no"),
    "south": ("s", "sth", "so"),
    "east": ("e",),
    "west": ("w",),
    "heights": ("hts", "hghts", "hgts", "ht"),
    "springs": ("spgs", "spr", "sprs", "spgs"),
    "falls": ("fls", "fl"),
    "junction": ("jct", "jctn", "junc"),
    "crossing": ("xing", "crsg", "xg"),
    "harbor": ("harbour", "hbr", "harb"),
    "bay": ("by",),
}
# Words around a name that say nothing about which place it is; a caller may give others.
NOISE = ("city", "of", "near", "downtown", "centre", "center", "central", "town", "area", "the", "nr", "outside", "around")
# Rows of a keyboard, for substitutions of neighbouring keys.
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

_NEAR = {(a, b) for row in KEYS for a, b in zip(row, row[1:])}
_NEAR |= {(row2[i], row1[j]) for row1, row2 in zip(KEYS, KEYS[1:]) for i in range(len(row2)) for j in (i, i + 1) if j < len(row1)}
_NEAR |= {(b, a) for a, b in _NEAR}


def bare(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def weighted_distance(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein distance (adjacent swaps) with cheaper swaps, doubled letters and neighbouring keys;
    infinite beyond ``most``."""
    if abs(len(a) - len(b)) * 0.7 > most:
        return float("inf")
    before, last = None, [0.0]
    for j, c in enumerate(b):
        last.append(last[-1] + (0.7 if j and b[j - 1] == c else 1.0))
    for i, x in enumerate(a, 1):
        row = [last[0] + (0.7 if i > 1 and a[i - 2] == x else 1.0)]
        for j, y in enumerate(b, 1):
            cost = last[j - 1] + (0.0 if x == y else 0.8 if (x, y) in _NEAR else 1.0)
            cost = min(cost, last[j] + (0.7 if i > 1 and a[i - 2] == x else 1.0), row[j - 1] + (0.7 if j > 1 and b[j - 2] == y else 1.0))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 0.8)
            row.append(cost)
        if min(row) > most and (before is None or min(last) > most):
            return float("inf")
        before, last = last, row
    return last[-1] if last[-1] <= most else float("inf")


def deletes(word: str, n: int) -> set[str]:
    """``word`` with up to ``n`` letters left out."""
    return {"".join(word[i] for i in range(len(word)) if i not in out) for k in range(min(n, len(word)) + 1) for out in combinations(range(len(word)), k)}


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", bare(text))


def written_forms(name: str, affixes: dict[str, tuple[str, ...]] = AFFIXES) -> set[str]:
    """Ways to write a name without blanks: as it is, and with its first or last word shortened."""
    w = words(name)
    found = {"".join(w)}
    if len(w) > 1:
        found |= {"".join([s, *w[1:]]) for s in affixes.get(w[0], ())}
        found |= {"".join([*w[:-1], s]) for s in affixes.get(w[-1], ())}
    return found - {""}


#: Forms beyond this length are not met by their deletions but by parts of them, which take no more room than the form.
LONG_FORM = 40


def parts(form: str, n: int) -> list[tuple[int, str]]:
    """``form`` in n parts with their starts. An edit, a swap of neighbours included, changes at most two of them, so that
    of 2 k + 1 parts one is whole after k edits, no more than k letters away from its place."""
    at = [len(form) * k // n for k in range(n + 1)]
    return [(a, form[a:b]) for a, b in zip(at, at[1:])]


@dataclass
class Dictionary:
    """Deletion variants of all written forms; ``forms`` maps a form to the entries it may stand for, ``pieces`` a part of a
    long form and its start to the form."""

    max_edits: int
    long_form: int
    codes: frozenset[str]
    weight: dict[int, int]
    forms: dict[str, tuple[int, ...]] = field(default_factory=dict)
    variants: dict[str, tuple[str, ...]] = field(default_factory=dict)
    names: dict[str, int] = field(default_factory=dict)
    pieces: dict[tuple[int, str], tuple[str, ...]] = field(default_factory=dict)
    noise: tuple[str, ...] = NOISE

    @classmethod
    def of(cls, entries: Iterable[tuple[int, str | None, str | None, str | None]], weight: dict[int, int], max_edits: int = 2, long_form: int = 12, codes: Iterable[str] = (), affixes: dict[str, tuple[str, ...]] = AFFIXES, noise: tuple[str, ...] = NOISE) -> Dictionary:
        """entries: (id, name, other name, region code); codes: region codes of entries that are not here."""
        entries = [e for e in entries if e[0] is not None]
        forms: dict[str, set[int]] = defaultdict(set)
        for i, name, other, _ in entries:
            for n in (name, other):
                for f in written_forms(n, affixes) if n else ():
                    forms[f].add(i)
        variants: dict[str, set[str]] = defaultdict(set)
        pieces: dict[tuple[int, str], set[str]] = defaultdict(set)
        for f in forms:
            if len(f) > LONG_FORM:
                for p in parts(f, 2 * max_edits + 1):
                    pieces[p].add(f)
                continue
            for v in deletes(f, max_edits if len(f) >= long_form else 1):
                variants[v].add(f)
        codes = frozenset(bare(c) for c in (*codes, *(e[-1] for e in entries)) if c)
        names = {n: i for i, n, *_ in sorted(entries, key=lambda e: -e[0]) if n}
        return cls(max_edits, long_form, codes, weight, {k: tuple(sorted(v)) for k, v in forms.items()}, {k: tuple(sorted(v)) for k, v in variants.items()}, names, {k: tuple(sorted(v)) for k, v in pieces.items()}, noise)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.forms), default=0)
        # how long parts are, and where they start
        self.part_sizes = sorted({(a, len(x)) for a, x in self.pieces})

    def readings(self, typed: str) -> list[str]:
        """What may be the name in a typed value, without blanks: all its words, and those without numbers, region code
        and words of ``NOISE``."""
        w = [x for x in words(typed) if not any(c.isdigit() for c in x)]
        if not w:
            return []
        no_code = w[:-1] if len(w) > 1 and w[-1] in self.codes else w
        plain = [x for x in no_code if x not in self.noise]
        return list(dict.fromkeys("".join(x) for x in (w, no_code, plain) if x))

    def best(self, typed: str) -> tuple[int, float] | None:
        """(entry, distance) of the closest entry within bounds, or None."""
        hit = self.closest(typed)
        return hit and (hit[3], hit[0])

    def closest(self, typed: str) -> tuple[float, int, int, int] | None:
        """(distance, reading, negative weight, entry) of the closest entry, the least of all dictionaries of a list;
        reading is the number of the one that is a form as it is, or 0."""
        ranked = []
        for n, r in enumerate(self.readings(typed)):
            if r in self.forms:
                ranked += [(0.0, n, -self.weight.get(i, 0), i) for i in self.forms[r]]
                break
            most = self.max_edits if len(r) >= self.long_form else 1
            if len(r) > self.longest + most:
                continue
            near = {f for v in deletes(r, most) for f in self.variants.get(v, ())} if len(r) <= LONG_FORM + most else set()
            if len(r) >= LONG_FORM - most:
                near |= {f for a, n in self.part_sizes for at in range(max(0, a - most), a + most + 1) for f in self.pieces.get((a, r[at : at + n]), ())}
            for f in near:
                d = weighted_distance(r, f, min(most, self.max_edits if len(f) >= self.long_form else 1))
                if d < float("inf"):
                    ranked += [(d, 0, -self.weight.get(i, 0), i) for i in self.forms[f]]
        return min(ranked, default=None)


def matcher(shared, column: int = 1):
    """Batches with ``closest`` of the text in ``column`` appended, named distance, reading, seldom and entry; each value is looked up once a batch run,
    with a cache of at most 200,000 values that is emptied when full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary: Dictionary = shared.value
        known: dict[str, tuple[float, int, int, int] | None] = {}
        for b in batches:
            coded = b.column(column).dictionary_encode()
            values = coded.dictionary.to_pylist()
            if len(known) + len(values) > 200_000:
                known.clear()
            for v in values:
                if v not in known:
                    # distance -1 marks a name written as in the list, character by character
                    known[v] = (-1.0, 0, 0, dictionary.names[v]) if v in dictionary.names else dictionary.closest(v)
            hits = [known[v] for v in values]
            found = [pa.array([h and h[k] for h in hits], t).take(coded.indices) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*b.schema.names, "distance", "reading", "seldom", "entry"])

    return run


def _room(letters: int, max_edits: int) -> int:
    """Bytes that a name takes in a dictionary, about: its deletions, or its parts, with what holds them."""
    each = letters + 120
    return 2 * each * (sum(math.comb(letters, k) for k in range(max_edits + 1)) if letters <= LONG_FORM else 2 * max_edits + 1)


def map_to_list(rows: DataFrame, entries: DataFrame, *, key: str = "id", value: str = "city", entry_id: str = "city_id", name: str = "city_name", other: str = "alt_name", code: str = "admin_code", max_edits: int = 2, exact_too: bool = True, block: int = 20_000, block_bytes: int = 64 << 20, affixes: dict[str, tuple[str, ...]] = AFFIXES, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """(key, value, entry, distance) for every row whose value is neither null nor blank; without ``exact_too`` those
    that are exactly a name are left out.

    A value that is exactly a name has that entry at distance 0; otherwise the closest entry by weighted
    Damerau-Levenshtein distance within ``max_edits`` (1 for names under 12 letters), ties going to the entry that occurs
    more often written correctly in ``rows``, then to the smaller id. Misses have a null entry. Rows whose key is null
    are left out, repeated rows are kept, empty tables give no rows, other columns are not read; very long texts are
    read whole. A list in several blocks gives the same rows as in one.

    The dictionary is broadcast: at most ``block`` entries at once and, by an estimate of what their deletions take, at most
    ``block_bytes`` (a single larger entry alone). A longer list is taken block by block, each released when it is looked
    up, and the best hit of each distinct value is kept; its region codes are then collected. ``affixes``: parts of names
    and the ways they are shortened; ``noise``: words that are not part of a name.
    """
    spark = rows.sparkSession
    typed = rows.select(rows[key].cast("long").alias("key"), rows[value].alias("value")).where(F.col("key").isNotNull() & (F.length(F.regexp_replace("value", r"[\s\p{Z}\x{200b}]+", "")) > 0))
    listed = entries.select(entries[entry_id].cast("long").alias("i"), entries[name].alias("n"), entries[other].alias("o"), entries[code].alias("c")).where(F.col("i").isNotNull())
    # the list is read to the driver a block at a time; its frequencies are one number an entry
    spelled = typed.groupBy("value").agg(F.count("*").alias("f")).withColumnRenamed("value", "n")
    counted = listed.join(spelled, "n", "left").select("i", "n", "o", "c", "f").orderBy("i").toLocalIterator()
    results, part, codes, held = [], [], [], 0
    rank = ["distance", "reading", "seldom", "entry"]

    def lookup(part):
        d = Dictionary.of([tuple(r)[:4] for r in part], {r["i"]: r["f"] or 0 for r in part}, max_edits, codes=codes, affixes=affixes, noise=noise)
        shared, found = spark.sparkContext.broadcast(d), ", distance double, reading long, seldom long, entry long"
        if single:
            return typed.mapInArrow(matcher(shared), "key long, value string" + found)
        done = cut(values.mapInArrow(matcher(shared, 0), "value string" + found))
        shared.unpersist()
        return done

    single = True
    for r in counted:
        size = sum(_room(len(n), max_edits) for n in (r["n"], r["o"]) if n)
        if part and (len(part) == block or held + size > block_bytes):
            if single:
                single, codes = False, [c[0] for c in listed.select("c").distinct().collect()]
                values = cut(typed.select("value").distinct())
            results.append(lookup(part))
            part, held = [], 0
        part.append(r)
        held += size
    results.append(lookup(part))
    best = results[0]
    if not single:
        for r in results[1:]:
            best = best.unionAll(r)
        best = best.groupBy("value").agg(F.min(F.when(F.col("entry").isNotNull(), F.struct(*rank))).alias("b")).select("value", "b.*")
        best = typed.join(best, "value")
    best = best.select("key", "value", "entry", "distance")
    if not exact_too:
        best = best.where(F.col("distance").isNull() | (F.col("distance") >= 0))
    return best.withColumn("distance", F.when(F.col("distance") < 0, 0.0).otherwise(F.col("distance")))
