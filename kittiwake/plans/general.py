"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kittiwake.operators.incremental import new_versions_by_run
from kittiwake.operators.proximity import locate, locate_classes
from kittiwake.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return locate(table(spark, d, "users"), table(spark, d, "zones"), radius_m=30.0)


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return locate_classes(table(spark, d, "users"), table(spark, d, "zones"), radius_m=30.0)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return new_versions_by_run(table(spark, d, "user_feed"), table(spark, d, "sync_runs"), seq="batch_no", key="id", version="update_time")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p6_found": p6_found}

ORACLE = {
    "p6_found": """
        WITH ok AS (
            SELECT run_id, upto_batch AS hi, coalesce(lag(upto_batch) OVER (ORDER BY run_id), 0) AS lo
            FROM sync_runs WHERE status = 'ok'),
        cand AS (
            SELECT ok.run_id, ok.lo, f.id, max(f.update_time) AS update_time
            FROM ok JOIN user_feed f ON f.batch_no > ok.lo AND f.batch_no <= ok.hi
            GROUP BY ALL)
        SELECT run_id, id, update_time FROM cand c
        WHERE NOT EXISTS (
            SELECT 1 FROM user_feed p
            WHERE p.id = c.id AND p.batch_no <= c.lo AND p.update_time >= c.update_time)
    """,
}

_USABLE = """
        WITH u AS (
            SELECT id, geopoint._1 AS la, geopoint._2 AS lo FROM users
            WHERE geopoint._1 IS NOT NULL AND geopoint._2 IS NOT NULL
              AND NOT isnan(geopoint._1) AND NOT isnan(geopoint._2)
              AND abs(geopoint._1) <= 90 AND abs(geopoint._2) <= 180
              AND NOT (geopoint._1 = 0 AND geopoint._2 = 0)),
"""
_MET = """
        v AS (
            SELECT *, cos(radians(la)) * cos(radians(lo)) AS x, cos(radians(la)) * sin(radians(lo)) AS y,
                   sin(radians(la)) AS z FROM u),
        near AS (
            SELECT 'near' AS kind, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b
            FROM v a JOIN v b ON b.la BETWEEN a.la - 0.0003 AND a.la + 0.0003 AND a.id < b.id
            WHERE 2 * 6371008.8 * asin(least(1, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) / 2)) <= 30.0),
        corner AS (
            SELECT zone_id, len(ring) AS n, unnest(range(1, len(ring) + 1)) AS k, ring FROM zones),
        edge AS (
            SELECT zone_id, ring[k]._1 AS y0, ring[k]._2 AS x0,
                   ring[k % n + 1]._1 AS y1, ring[k % n + 1]._2 AS x1 FROM corner),
        turned AS (
            SELECT id, la, lo + t AS lo, t FROM u, (VALUES (-360.0), (0.0), (360.0)) AS turn(t)),
        crossing AS (
            SELECT e.zone_id, p.id, p.t, count(*) AS n
            FROM edge e JOIN turned p
              ON (e.y0 > p.la) <> (e.y1 > p.la)
             AND p.lo < e.x0 + (p.la - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0)
            GROUP BY ALL),
        inside AS (
            SELECT DISTINCT 'in' AS kind, zone_id AS id_a, id AS id_b FROM crossing WHERE n % 2 = 1)
        SELECT * FROM near UNION ALL SELECT * FROM inside
"""
ORACLE["p1_found"] = _USABLE + _MET
ORACLE["p1_classes"] = (
    _USABLE.replace("u AS (", "every AS (")
    + "u AS (SELECT min(id) AS id, la, lo FROM every GROUP BY la, lo),"
    + _MET
    + " UNION ALL SELECT 'same', u.id, every.id FROM every JOIN u USING (la, lo) WHERE u.id <> every.id"
)
