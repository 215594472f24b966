"""Records of the same postal address written differently.

Addresses are linked from the top down: region (zipcode) and locality (city), then street, then house number, then unit.
A missing locality inherits the candidate of the zipcode; streets are linked inside their city only, to the spelling that
occurs most among those one deletion away on either side; a street type is needed only where one name carries several
types, and where it is missing the zipcode tells it. What stays ambiguous is said so and is in no pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kittiwake.llm.gazetteer import Dictionary, bare
from kittiwake.operators.pairs import pairs_in_groups
from kittiwake.runtime import cut

# Kinds of streets and the ways they are shortened.
STREET_TYPES = {
    "street": ("street", "str", "st"),
    "road": ("road", "rd"),
    "drive": ("drive", "dr", "drv"),
    "square": ("square", "sq"),
    "terrace": ("terrace", "terr", "ter"),
    "lane": ("lane", "ln"),
    "avenue": ("avenue", "ave", "av"),
    "way": ("way", "wy"),
    "court": ("court", "ct", "crt"),
    "boulevard": ("boulevard", "blvd", "boul"),
    "place": ("place", "pl"),
}
_TYPE = {form: kind for kind, forms in STREET_TYPES.items() for form in forms}
_ATTACHED = "(" + "|".join(sorted(_TYPE, key=len, reverse=True)) + ")$"

_CARE_OF = re.compile(r"^\s*c/o\b[^,]*,?")
_UNIT = re.compile(r"(?:\b(?:apartment|apt|flat|unit|floor|suite|ste|room)\b\.?\s*#?|#)\s*([0-9]+[a-z]?|[a-z])\b\.?")
_NUMBER = re.compile(r"\b(?:no|nr|number|house)\b\.?\s*([0-9]+[a-z]?)\b|\b([0-9]+[a-z]?)\b")
_LETTERS = re.compile(r"[^\W\d_]+")


def parse_street(text: str | None) -> tuple[str | None, str | None, str | None, str | None, str | None]:
    """(house number, street name without blanks, street type, unit, rest that may name a city); None where missing."""
    if not text:
        return (None,) * 5
    s = _CARE_OF.sub(" ", bare(text))
    unit = _UNIT.search(s)
    s = _UNIT.sub(" , ", s)
    found = _NUMBER.search(s)
    number = (found[1] or found[2]).lstrip("0") if found else None
    s = _NUMBER.sub(" , ", s)
    parts = [w for p in re.split(r"[,/;|\n]+", s) if (w := _LETTERS.findall(p.replace("'", "").replace("’", "")))]
    if not parts:
        return number or None, None, None, unit and unit[1], None
    typed = [k for k, w in enumerate(parts) if any(x in _TYPE for x in w[1:])]
    k = typed[0] if typed else 0
    w = parts[k]
    at = next((j for j in range(len(w) - 1, 0, -1) if w[j] in _TYPE), None)
    name, kind = ("".join(w[:at]), _TYPE[w[at]]) if at else ("".join(w), None)
    rest = [*(w[at + 1 :] if at else []), *(x for j, p in enumerate(parts) if j != k for x in p)]
    return number or None, name, kind, unit and unit[1], " ".join(rest) or None


#: Digits of a zipcode that name its region.
_REGION = 3


def parse_zip(text: str | None, digits: int = 5) -> str | None:
    """The leading ``digits`` digits of a zipcode, or None if there are fewer."""
    d = re.sub(r"\D", "", text or "")
    return d[:digits] if len(d) >= digits else None


_PARSED = "id long, zip string, city long, number string, name string, kind string, unit string"


def _parse(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary: Dictionary = shared.value
        known: dict[str | None, int | None] = {None: None}

        def city(text: str | None) -> int | None:
            if text not in known:
                if len(known) > 200_000:
                    known.clear()
                    known[None] = None
                hit = dictionary.best(text)
                known[text] = hit and hit[0]
            return known[text]

        for b in batches:
            rows = []
            for i, street, town, code in zip(*(c.to_pylist() for c in b.columns)):
                number, name, kind, unit, rest = parse_street(street)
                rows.append((i, parse_zip(code), city(town) or city(rest), number, name, kind, unit))
            cols = list(zip(*rows)) or [()] * 7
            types = (pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "zip", "city", "number", "name", "kind", "unit"])

    return run


#: Spellings beyond this length are met by a hash of 127 bits each, which takes time linear in the length of the name.
LONGEST_NAME = 60
_PRIME, _BASE = 2**127 - 1, 0x1F3D5B79A2C4E68013579BDF02468ACF


def _deletions(word: Column, shortest: int) -> Column:
    """The word, and with one letter left out if it has ``shortest`` letters."""
    out = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) >= shortest, F.array_distinct(F.concat(F.array(word), out))).otherwise(F.array(word))


def long_deletions(word: str) -> list[str]:
    """A word of over LONGEST_NAME letters, and with one letter left out: a hash for each that is still that long."""
    n, head, power = len(word), [0], [1]
    for c in word:
        head.append((head[-1] * _BASE + ord(c) + 1) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    found = {f"#{head[n]:x}"}
    if n == LONGEST_NAME + 1:
        return [*found, *{word[:i] + word[i + 1 :] for i in range(n)}]
    # of what comes before a letter, and what comes after it
    return [*found, *{f"#{(head[i] * power[n - 1 - i] + head[n] - head[i + 1] * power[n - 1 - i]) % _PRIME:x}" for i in range(n)} - found]


def _with_deletions(rows: DataFrame, column: str, shortest: int) -> DataFrame:
    """The rows once for every deletion of ``column``, named left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, word in enumerate(b.column(column).to_pylist()):
                left = long_deletions(word)
                for at in range(0, len(left), 10_000):
                    part = left[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array([k] * len(part))).columns, pa.array(part, pa.string())], names=[*b.schema.names, "left"])

    long = F.length(column) > LONGEST_NAME
    short = rows.where(~long).withColumn("left", F.explode(_deletions(F.col(column), shortest)))
    return short.unionAll(rows.where(long).mapInArrow(run, short.schema))


#: A spelling seen so often with a zipcode is a street of its own where it shares none with the street it resembles.
_NAME_LEAST = 3


def link_streets(named: DataFrame, shortest: int = 4) -> DataFrame:
    """(city, name, root) for every street name of a city: the spelling that occurs most among those that share one
    deletion, also without a street type grown onto the end; followed to its end by doubling.

    With a column zip, spellings that share a zipcode go before others, and two that were both written ``_NAME_LEAST``
    times with zipcodes of which they share none are different streets, however alike. Works on distinct names with their
    counts; the join meets one row a city and deletion."""
    zips = named.groupBy("city", "name", F.col("zip") if "zip" in named.columns else F.lit(None).cast("string").alias("zip")).agg(F.count("*").alias("n"))
    names = cut(zips.groupBy("city", "name").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("zip").isNotNull(), F.col("n")).otherwise(0)).alias("zipped"), F.collect_set("zip").alias("zips")))
    cut_off = F.regexp_replace("name", _ATTACHED, "")
    readings = F.when(F.length(cut_off) >= shortest, F.array_distinct(F.array(F.col("name"), cut_off))).otherwise(F.array("name"))
    # once for the whole city, and once for each zipcode of the name
    places = lambda rows: rows.withColumn("zip", F.explode(F.concat(F.array(F.lit("")), "zips"))).drop("zips")
    top = places(_with_deletions(names, "name", shortest)).groupBy("city", "left", "zip").agg(F.max(F.struct("n", "name")).alias("top"))
    asked = places(_with_deletions(names.select("city", "name", "n", "zips", F.explode(readings).alias("r")), "r", shortest))
    met = asked.join(top, ["city", "left", "zip"]).where(F.col("name") != F.col("top.name"))
    met = met.groupBy("city", "name", "n", F.col("top.n").alias("top_n"), F.col("top.name").alias("root")).agg(F.max(F.col("zip") != "").alias("shared"))
    often = names.where(F.col("zipped") >= _NAME_LEAST)
    met = met.join(often.select("city", F.col("name").alias("root"), F.lit(True).alias("root_often")), ["city", "root"], "left")
    met = met.join(often.select("city", "name", F.lit(True).alias("own_often")), ["city", "name"], "left")
    apart = ~F.col("shared") & F.coalesce(F.col("root_often") & F.col("own_often"), F.lit(False))
    best = met.where(~apart).groupBy("city", "name").agg(F.max(F.struct("shared", F.col("top_n").alias("n"), F.col("root").alias("name"))).alias("t"))
    link = cut(names.select("city", "name").join(best, ["city", "name"], "left").select("city", "name", F.coalesce("t.name", "name").alias("root")))
    while True:
        # every link leads to a greater (count, name), as a name is among those that share its deletions, so there is no circle
        further = link.select("city", F.col("name").alias("root"), F.col("root").alias("next"))
        link = cut(link.join(further, ["city", "root"], "left").select("city", "name", F.coalesce("next", "root").alias("next"), (F.col("next") != F.col("root")).alias("moved")))
        moved = link.where("moved").limit(1).count()
        link = link.select("city", "name", F.col("next").alias("root"))
        if not moved:
            return link


#: A type of a street name seen so often is no slip of the pen.
_KIND_LEAST = 3


def street_kinds(named: DataFrame, link: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(city, root) of the names that several streets share, and (city, root, zip, kind) where the zipcode has only one
    of these streets.

    The most frequent type of a name is a street, and any other that was written ``_KIND_LEAST`` times, stands in a zipcode
    without other types of the name, or belongs to types that make up a fifth of the typed rows. Works on counts."""
    written = named.where(F.col("kind").isNotNull()).groupBy("city", "name", "zip", "kind").agg(F.count("*").alias("n"))
    kinds = written.join(link, ["city", "name"]).groupBy("city", "root", "zip", "kind").agg(F.sum("n").alias("n"))
    at = Window.partitionBy("city", "root", "zip")
    kinds = cut(kinds.withColumn("alone", F.col("zip").isNotNull() & (F.min("kind").over(at) == F.max("kind").over(at))))
    each = kinds.groupBy("city", "root", "kind").agg(F.sum("n").alias("n"), F.max("alone").alias("alone"))
    name = Window.partitionBy("city", "root")
    each = each.withColumn("top", F.max(F.struct("n", "kind")).over(name)).withColumn("all", F.sum("n").over(name))
    each = each.where((F.col("kind") == F.col("top.kind")) | (F.col("n") >= _KIND_LEAST) | F.col("alone") | (F.col("all") - F.col("top.n") >= 0.2 * F.col("all")))
    each = cut(each.withColumn("streets", F.count("*").over(name)).where(F.col("streets") > 1).select("city", "root", "kind"))
    told = kinds.where(F.col("zip").isNotNull()).join(each, ["city", "root", "kind"]).groupBy("city", "root", "zip").agg(F.min("kind").alias("told"), F.max("kind").alias("last"))
    return each.select("city", "root").distinct(), told.where(F.col("told") == F.col("last")).drop("last")


def link_addresses(users: DataFrame, cities: DataFrame, *, id_column: str = "id", street: str = "street", city: str = "city", zipcode: str = "zipcode", city_id: str = "city_id", city_name: str = "city_name", other_name: str = "alt_name", code: str = "admin_code", max_cities: int = 100_000) -> DataFrame:
    """(id, zip, city, street, number, unit, ambiguous) for every row with an id.

    city is an entry of ``cities`` or null; street is the linked name, with its type where one name of the city has
    several; ``ambiguous`` is true where such a type is missing and the zipcode does not tell it. Null, empty or unreadable parts are null; very long
    texts are parsed whole; repeated rows are kept; empty tables give no rows.

    Broadcast: the dictionary of ``cities``, refused beyond ``max_cities``, the city of each zipcode of five digits, at most
    100,000 rows, and of each region, at most 1,000.
    """
    spark = users.sparkSession
    entries = cities.select(cities[city_id].cast("long"), cities[city_name], cities[other_name], cities[code]).limit(max_cities + 1).collect()
    if len(entries) > max_cities:
        raise ValueError(f"more than {max_cities} cities; link one region at a time")
    shared = spark.sparkContext.broadcast(Dictionary.of([tuple(e) for e in entries], {}))
    raw = users.where(users[id_column].isNotNull()).select(users[id_column].cast("long").alias("id"), users[street].alias("s"), users[city].alias("c"), users[zipcode].alias("z"))
    parsed = cut(raw.mapInArrow(_parse(shared), _PARSED))
    seen = cut(parsed.where(F.col("zip").isNotNull() & F.col("city").isNotNull()).groupBy("zip", "city").agg(F.count("*").alias("n")))
    by_zip = seen.groupBy("zip").agg(F.max(F.struct("n", "city"))["city"].alias("told"))
    # a zipcode not seen with a city tells it by its region, where that lies in one city
    region = F.substring("zip", 1, _REGION)
    by_region = seen.groupBy(region.alias("region"), "city").agg(F.sum("n").alias("n")).groupBy("region").agg(F.sum("n").alias("all"), F.max(F.struct("n", "city")).alias("top"))
    by_region = by_region.where(F.col("top.n") >= 0.9 * F.col("all")).select("region", F.col("top.city").alias("near"))
    placed = parsed.join(F.broadcast(by_zip), "zip", "left").withColumn("region", region).join(F.broadcast(by_region), "region", "left")
    placed = placed.withColumn("city", F.coalesce("city", "told", "near")).drop("told", "near", "region")
    named = placed.where(F.col("city").isNotNull() & F.col("name").isNotNull())
    link = link_streets(named)
    several, told = street_kinds(named, link)
    spelled = cut(link.join(several.withColumn("several", F.lit(True)), ["city", "root"], "left").select("city", "name", "root", F.coalesce("several", F.lit(False)).alias("several")))
    full = placed.join(spelled, ["city", "name"], "left").join(told, ["city", "root", "zip"], "left").withColumn("kind", F.coalesce("kind", "told"))
    lacks = F.coalesce(F.col("several"), F.lit(False)) & F.col("kind").isNull()
    road = F.when(F.col("several"), F.concat_ws(" ", "root", "kind")).otherwise(F.col("root"))
    return full.select("id", "zip", "city", road.alias("street"), "number", "unit", lacks.alias("ambiguous"))


def same_building(users: DataFrame, cities: DataFrame, **names) -> DataFrame:
    """(id_a, id_b), id_a < id_b: users with the same city, street and house number; see ``link_addresses``."""
    at = link_addresses(users, cities, **names).where(~F.col("ambiguous")).select("city", "street", "number", "id")
    return pairs_in_groups(at, ["city", "street", "number"])
