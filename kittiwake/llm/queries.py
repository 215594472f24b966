"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kittiwake.llm.addresses import link_addresses, same_building
from kittiwake.llm.contamination import leaks
from kittiwake.llm.copies import collapse_people, person_runs
from kittiwake.llm.disclosure import disclosing_spans, sanitise
from kittiwake.llm.gazetteer import map_to_list
from kittiwake.llm.packing import fill_containers
from kittiwake.llm.repetition import perplexity_bands, repeated_share
from kittiwake.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return person_runs(table(spark, d, "users")).members()


def p2_copies(spark: SparkSession, d: str) -> DataFrame:
    return person_runs(table(spark, d, "users")).counts()


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return collapse_people(table(spark, d, "users")).select("id", "name", "email", "copies")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    typed = map_to_list(table(spark, d, "users"), table(spark, d, "city_ref"), exact_too=False)
    return typed.select(F.col("key").alias("id"), F.coalesce("entry", F.lit(0)).cast("long").alias("city_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return disclosing_spans(table(spark, d, "users"), table(spark, d, "city_ref")).select("id", "kind", "found").distinct()


def p4_sanitised(spark: SparkSession, d: str) -> DataFrame:
    return sanitise(table(spark, d, "users"), table(spark, d, "city_ref"))


def p4_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row: texts that came out, of these empty or missing ones, and those that still hold an address of the plain form."""
    clean = sanitise(table(spark, d, "users"), table(spark, d, "city_ref"))
    left = F.col("text").rlike(r"(?i)[a-z0-9]@[a-z0-9\-.]+\.(test|example|invalid)")
    return clean.agg(F.count("*").alias("rows"), F.count(F.when(F.coalesce("text", F.lit("")) == "", 1)).alias("empty"), F.count(F.when(left, 1)).alias("emails_left"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return same_building(table(spark, d, "users"), table(spark, d, "city_ref"))


def p5_places(spark: SparkSession, d: str) -> DataFrame:
    return link_addresses(table(spark, d, "users"), table(spark, d, "city_ref"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(table(spark, d, "documents"), capacity=2048)


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents, containers over capacity, documents that are cut though not longer, and whether little is left."""
    rows = fill_containers(table(spark, d, "documents"), capacity=2048)
    each = rows.groupBy("container_id").agg(F.sum("tokens").alias("filled"))
    boxes = each.agg(F.count(F.when(F.col("filled") > 2048, 1)).alias("over"), (F.sum("filled") >= 0.98 * 2048 * (F.count("*") - 1)).alias("filled"))
    docs = rows.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    whole = docs.agg(F.count("*").alias("documents"), F.count(F.when(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / 2048)), 1)).alias("cut"))
    # one row each
    both = whole.unionByName(boxes, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("documents", "over", "cut", "filled")])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), slack=4, missing=1).select("item_id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_share(table(spark, d, "documents"), above=0.3).select("doc_id").distinct()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return repeated_share(table(spark, d, "documents"))


def p9_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return perplexity_bands(table(spark, d, "documents")).withColumn("perplexity", F.round("perplexity", 6))


QUERIES = {"p2_found": p2_found, "p2_copies": p2_copies, "p2_records": p2_records, "p3_found": p3_found, "p4_found": p4_found, "p4_sanitised": p4_sanitised, "p4_invariants": p4_invariants, "p5_found": p5_found, "p5_places": p5_places, "p7_containers": p7_containers, "p7_invariants": p7_invariants, "p8_found": p8_found, "p8_near": p8_near, "p9_found": p9_found, "p9_shares": p9_shares, "p9_perplexity": p9_perplexity}

_PERSON = r"""
    k AS (SELECT id, array_to_string(list_sort(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')), ' ') AS n,
                 regexp_replace(lower(email), '[^\p{L}\p{N}]+', '', 'g') AS e FROM users),
    r AS (SELECT id, min(id) OVER (PARTITION BY n, e) AS first_id, count(*) OVER (PARTITION BY n, e) AS copies
          FROM k WHERE n <> '' AND e <> '')
"""
ORACLE = {
    "p2_found": f"WITH {_PERSON} SELECT first_id, id FROM r WHERE id <> first_id",
    "p2_copies": f"WITH {_PERSON} SELECT DISTINCT first_id, copies FROM r",
    "p2_records": f"WITH {_PERSON} SELECT id, name, email, copies FROM r JOIN users USING (id) WHERE id = first_id",
    "p4_invariants": "SELECT count(*) AS rows, count(*) FILTER (coalesce(description, '') = '') AS empty, 0 AS emails_left FROM users",
    "p7_invariants": "SELECT count(*) AS documents, 0 AS over, 0 AS cut, true AS filled FROM documents",
    "p8_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(lower(prompt), '[\p{L}\p{N}]+') AS w FROM eval_items),
        dg AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
        ig AS (SELECT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
        SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (g)
    """,
    "p9_shares": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        g AS (SELECT doc_id, array_to_string(w[k:k+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
        r AS (SELECT doc_id, count(*) - count(DISTINCT g) AS repeated FROM g GROUP BY doc_id)
        SELECT doc_id, coalesce(len(w), 0) AS words, coalesce(repeated, 0) AS repeated,
               CASE WHEN len(w) >= 20 THEN repeated / (len(w) - 4) END AS share
        FROM d LEFT JOIN r USING (doc_id)
    """,
    "p9_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        g AS (SELECT doc_id, array_to_string(w[k:k+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 20))
        SELECT doc_id FROM g GROUP BY doc_id HAVING count(*) - count(DISTINCT g) > 0.3 * count(*)
    """,
    "p9_perplexity": r"""
        WITH d AS (SELECT doc_id, CASE WHEN regexp_extract(lower(coalesce(lang, '')), '^\s*([a-z]{2})', 1) = '' THEN 'und' ELSE regexp_extract(lower(coalesce(lang, '')), '^\s*([a-z]{2})', 1) END AS lang,
                          coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS w FROM documents),
        t AS (SELECT doc_id, lang, w[k] AS a, w[k+1] AS b, w[k+2] AS c FROM (SELECT *, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3)),
        tri AS (SELECT lang, a, b, c, count(*) AS n FROM t GROUP BY ALL),
        bi AS (SELECT lang, b, c, count(*) AS n FROM tri GROUP BY ALL),
        uni AS (SELECT lang, c, count(*) AS n FROM bi GROUP BY ALL),
        every AS (SELECT lang, n, 3 AS o FROM tri UNION ALL SELECT lang, n, 2 FROM bi UNION ALL SELECT lang, n, 1 FROM uni),
        seen AS (SELECT lang, o, count(*) FILTER (n = 1)::DOUBLE AS n1, count(*) FILTER (n = 2)::DOUBLE AS n2, count(*) FILTER (n = 3)::DOUBLE AS n3, count(*) FILTER (n = 4)::DOUBLE AS n4 FROM every GROUP BY ALL),
        disc AS (SELECT lang, o,
            least(greatest(CASE WHEN n1 > 0 THEN 1 - 2 * (n1 / (n1 + 2 * n2)) * n2 / n1 ELSE 0.5 END, 0.05), 0.95) AS d1,
            least(greatest(CASE WHEN n2 > 0 AND n1 > 0 THEN 2 - 3 * (n1 / (n1 + 2 * n2)) * n3 / n2 ELSE 1.0 END, 0.05), 1.9) AS d2,
            least(greatest(CASE WHEN n3 > 0 AND n1 > 0 THEN 3 - 4 * (n1 / (n1 + 2 * n2)) * n4 / n3 ELSE 1.5 END, 0.05), 2.85) AS d3 FROM seen),
        c1 AS (SELECT lang, sum(n) AS s, sum(CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END) AS m, count(*) AS v FROM uni JOIN disc USING (lang) WHERE o = 1 GROUP BY lang),
        p1 AS (SELECT lang, c, (n - CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END) / s + m / s / v AS p FROM uni JOIN c1 USING (lang) JOIN disc USING (lang) WHERE o = 1),
        c2 AS (SELECT lang, b, sum(n) AS s, sum(CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END) AS m FROM bi JOIN disc USING (lang) WHERE o = 2 GROUP BY lang, b),
        p2 AS (SELECT lang, b, c, (n - CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END) / s + m / s * p AS p FROM bi JOIN c2 USING (lang, b) JOIN p1 USING (lang, c) JOIN disc USING (lang) WHERE o = 2),
        c3 AS (SELECT lang, a, b, sum(n) AS s, sum(CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END) AS m FROM tri JOIN disc USING (lang) WHERE o = 3 GROUP BY lang, a, b),
        p3 AS (SELECT lang, a, b, c, ln((n - CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END) / s + m / s * p) AS lp FROM tri JOIN c3 USING (lang, a, b) JOIN p2 USING (lang, b, c) JOIN disc USING (lang) WHERE o = 3),
        e AS (SELECT doc_id, lang, -avg(lp) AS bits FROM t JOIN p3 USING (lang, a, b, c) GROUP BY doc_id, lang),
        r AS (SELECT d.doc_id, d.lang, len(w) AS words, bits FROM d LEFT JOIN e USING (doc_id, lang)),
        q AS (SELECT lang, list_sort(list(bits)) AS l FROM r WHERE words >= 20 AND bits IS NOT NULL GROUP BY lang),
        band AS (SELECT lang, l[ceil(0.25 * len(l))::INT] AS q1, l[ceil(0.75 * len(l))::INT] AS q3 FROM q)
        SELECT doc_id, lang, words::INT AS words, round(exp(bits), 6) AS perplexity,
               CASE WHEN words < 20 THEN 'short' WHEN bits < q1 - 1.5 * (q3 - q1) THEN 'low' WHEN bits > q3 + 1.5 * (q3 - q1) THEN 'high' ELSE 'ok' END AS verdict
        FROM r LEFT JOIN band USING (lang)
    """,
}
