"""Queries of the record-store operators on the driver's tables, each with its SQL.

The tables have no record ids or deletion marks of their own: the unique key stands for the id, and finished orders
(status F) stand for deleted rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kittiwake.functions import bits, coerce, strings
from kittiwake.operators import index, kv, mutate, pipeline, scan, versions
from kittiwake.runtime import shared_dir
from kittiwake.schema import load
from kittiwake.sources import delimited, documents
from kittiwake.sources.store import Catalog, Store
from kittiwake.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _gone() -> Column:
    return F.col("o_orderstatus") == "F"


# scans and counts


@query("q_scan_forward", "SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_orderstatus <> 'F'")
def q_scan_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.forward(table(spark, d, "orders"), "o_orderkey", _gone()).select("o_orderkey", "o_custkey", "o_totalprice")
    return scan.numbered(rows, [F.col("o_orderkey").asc()])


@query("q_scan_backward", "SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS pos FROM orders WHERE o_orderstatus <> 'F'")
def q_scan_backward(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.backward(table(spark, d, "orders"), "o_orderkey", _gone()).select("o_orderkey", "o_custkey", "o_totalprice")
    return scan.numbered(rows, [F.col("o_orderkey").desc()])


@query("q_scan_seek_exact", "SELECT * FROM orders WHERE o_orderkey = 77 AND o_orderstatus <> 'F'")
def q_scan_seek_exact(spark: SparkSession, d: str) -> DataFrame:
    return scan.seek_exact(table(spark, d, "orders"), "o_orderkey", 77, _gone())


@query("q_scan_seek_lower_id", "SELECT event_id, user_id, event_type FROM events WHERE event_id >= 4321")
def q_scan_seek_lower_id(spark: SparkSession, d: str) -> DataFrame:
    return scan.seek_lower(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", 4321)


@query("q_scan_resume", "SELECT event_id, value FROM events WHERE event_id > 9000")
def q_scan_resume(spark: SparkSession, d: str) -> DataFrame:
    return scan.resume_after(table(spark, d, "events").select("event_id", "value"), "event_id", 9000)


@query("q_get_row", "SELECT * FROM customer WHERE c_custkey = 42")
def q_get_row(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer")
    return spark.createDataFrame([scan.get(customers, "c_custkey", 42)], customers.schema)


@query("q_exists", "SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 42")
def q_exists(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(scan.exists(table(spark, d, "customer"), "c_custkey", 42),)], "found boolean")


@query("q_is_empty", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') = 0 AS live_empty, (SELECT count(*) FROM orders WHERE o_orderkey < 0) = 0 AS none")
def q_is_empty(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return spark.createDataFrame([(scan.is_empty(orders, _gone()), scan.is_empty(orders.where("o_orderkey < 0")))], "live_empty boolean, none boolean")


@query("q_many_cursors", "SELECT event_id, value FROM events")
def q_many_cursors(spark: SparkSession, d: str) -> DataFrame:
    parts = scan.many_cursors(table(spark, d, "events").select("event_id", "value"), 3, "event_id")
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("q_row_counts", "SELECT count(*) AS physical, count(*) FILTER (o_orderstatus <> 'F') AS live FROM orders")
def q_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return scan.counts(table(spark, d, "orders"), _gone())


@query("q_storage_stats", "SELECT count(*) AS physical, count(*) FILTER (o_orderstatus <> 'F') AS live, 2 AS segments, true AS has_bytes FROM orders")
def q_storage_stats(spark: SparkSession, d: str) -> DataFrame:
    store = _two_segments(spark, d)
    store.delete(table(spark, d, "orders").where(_gone()).select("o_orderkey"))
    n = store.counts()
    return spark.createDataFrame([(n["physical"], n["live"], n["segments"], n["bytes"] > 0 and n["tombstone_bytes"] > 0)], "physical long, live long, segments int, has_bytes boolean")


@query("q_segment_lookup", """
    WITH r AS (SELECT o_orderkey, o_custkey % 2 AS odd, row_number() OVER (ORDER BY o_custkey % 2, o_orderkey) - 1 AS rid FROM orders)
    SELECT o_orderkey, rid, odd::INT AS seg FROM r""")
def q_segment_lookup(spark: SparkSession, d: str) -> DataFrame:
    store = _two_segments(spark, d)
    rows = store.read(ids=True).select("o_orderkey", F.col("__rid").alias("rid"))
    # one row a segment
    segments = F.broadcast(store.segments().select("first_rid", "last_rid", (F.dense_rank().over(Window.orderBy("first_rid")) - 1).alias("seg")))
    return rows.join(segments, rows.rid.between(segments.first_rid, segments.last_rid)).select("o_orderkey", "rid", "seg")


# projection


@query("q_select_columns", "SELECT p_type, p_partkey, p_name, p_type AS p_type_2 FROM part")
def q_select_columns(spark: SparkSession, d: str) -> DataFrame:
    return scan.project(table(spark, d, "part"), ["p_type", "p_partkey", "p_name", "p_type"])


@query("q_select_one_column", "SELECT p_name FROM part")
def q_select_one_column(spark: SparkSession, d: str) -> DataFrame:
    return scan.project(table(spark, d, "part"), ["p_name"])


@query("q_select_colgroup", "SELECT p_partkey, struct_pack(p_brand := p_brand, p_type := p_type).p_brand AS brand, struct_pack(p_brand := p_brand, p_type := p_type).p_type AS type FROM part")
def q_select_colgroup(spark: SparkSession, d: str) -> DataFrame:
    group = scan.project_group(table(spark, d, "part"), "brand_type", ["p_brand", "p_type"], ["p_partkey"])
    return group.select("p_partkey", F.col("brand_type.p_brand").alias("brand"), F.col("brand_type.p_type").alias("type"))


@query("q_logical_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS physical_id FROM orders WHERE o_orderstatus <> 'F'")
def q_logical_ids(spark: SparkSession, d: str) -> DataFrame:
    return versions.logical_ids(scan.live(table(spark, d, "orders"), _gone()), "o_orderkey")


# index access


@query("q_index_exact", "SELECT o_orderkey FROM orders WHERE o_custkey = 77")
def q_index_exact(spark: SparkSession, d: str) -> DataFrame:
    return index.exact(table(spark, d, "orders"), ["o_custkey"], [77]).select("o_orderkey")


@query("q_index_exact_newest_first", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS pos FROM orders WHERE o_custkey = 77")
def q_index_exact_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return scan.numbered(index.exact(table(spark, d, "orders"), ["o_custkey"], [77]).select("o_orderkey"), [F.col("o_orderkey").desc()])


@query("q_key_exists", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS found FROM customer")
def q_key_exists(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return index.keys_exist(orders, ["c_custkey"], table(spark, d, "customer").select("c_custkey"))


@query("q_composite_exact", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand = 'Brand#12' AND p_type = 'ECONOMY'")
def q_composite_exact(spark: SparkSession, d: str) -> DataFrame:
    return index.exact(table(spark, d, "part"), ["p_brand", "p_type"], ["Brand#12", "ECONOMY"]).select("p_partkey", "p_brand", "p_type")


@query("q_composite_seek", "SELECT p_partkey, p_brand, p_type FROM part WHERE (p_brand, p_type) >= ('Brand#12', 'PROMO')")
def q_composite_seek(spark: SparkSession, d: str) -> DataFrame:
    return index.between(table(spark, d, "part"), ["p_brand", "p_type"], ["Brand#12", "PROMO"]).select("p_partkey", "p_brand", "p_type")


def _seek_query(name: str, forward: bool, inclusive: bool) -> None:
    op = {(True, True): ">=", (True, False): ">", (False, True): "<=", (False, False): "<"}[forward, inclusive]
    way = "ASC" if forward else "DESC"

    @query(name, f"SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice = 200000.0 THEN 0 ELSE 1 END AS cmp FROM orders WHERE o_totalprice {op} 200000.0 ORDER BY o_totalprice {way}, o_orderkey {way} LIMIT 1")
    def seek(spark: SparkSession, d: str) -> DataFrame:
        return index.seek(table(spark, d, "orders"), ["o_totalprice"], [200000.0], "o_orderkey", forward=forward, inclusive=inclusive).select("o_orderkey", "o_totalprice", "cmp")


_seek_query("q_seek_lower_fwd", True, True)
_seek_query("q_seek_upper_fwd", True, False)
_seek_query("q_seek_lower_bwd", False, True)
_seek_query("q_seek_upper_bwd", False, False)


@query("q_seek_open", "SELECT o_orderkey, o_custkey, 1 AS cmp FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1")
def q_seek_open(spark: SparkSession, d: str) -> DataFrame:
    return index.seek(table(spark, d, "orders"), ["o_custkey"], [], "o_orderkey").select("o_orderkey", "o_custkey", "cmp")


@query("q_range_incl_excl", "SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1996-03-01'")
def q_range_incl_excl(spark: SparkSession, d: str) -> DataFrame:
    ends = [F.to_timestamp(F.lit(x)) for x in ("1995-03-01", "1996-03-01")]
    return index.between(table(spark, d, "lineitem"), ["l_shipdate"], ends[:1], ends[1:]).select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")


@query("q_max_prefix", """
    WITH k AS (SELECT 'small rivet' AS s),
    m AS (SELECT p_partkey, p_name, (SELECT max(n) FROM range(0, length(s) + 1) t(n) WHERE left(p_name, n::INT) = left(s, n::INT) AND length(p_name) >= n) AS matched FROM part, k)
    SELECT p_partkey, p_name, matched FROM m ORDER BY matched DESC, p_name, p_partkey LIMIT 1""")
def q_max_prefix(spark: SparkSession, d: str) -> DataFrame:
    return index.longest_prefix(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "small rivet", "p_partkey")


@query("q_regex_full", "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, 'small .*g')")
def q_regex_full(spark: SparkSession, d: str) -> DataFrame:
    return index.matching(table(spark, d, "part"), "p_name", "small .*g").select("p_partkey", "p_name")


@query("q_regex_ci", "SELECT doc_id FROM documents WHERE regexp_full_match(text, '.*SNAPSHOT reader.*', 'is')")
def q_regex_ci(spark: SparkSession, d: str) -> DataFrame:
    return index.matching(table(spark, d, "documents"), "text", ".*SNAPSHOT reader.*", "i").select("doc_id")


@query("q_regex_alt", "SELECT _id, message FROM tweets WHERE regexp_full_match(message, '.*(merge|freeze) .*(once|twice).*', 's')")
def q_regex_alt(spark: SparkSession, d: str) -> DataFrame:
    return index.matching(table(spark, d, "tweets"), "message", ".*(merge|freeze) .*(once|twice).*").select("_id", "message")


@query("q_index_iter_fwd", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos FROM customer")
def q_index_iter_fwd(spark: SparkSession, d: str) -> DataFrame:
    return scan.numbered(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").asc(), F.col("c_custkey").asc()])


@query("q_index_iter_bwd", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) - 1 AS pos FROM customer")
def q_index_iter_bwd(spark: SparkSession, d: str) -> DataFrame:
    return scan.numbered(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), F.col("c_custkey").desc()])


@query("q_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
def q_topk(spark: SparkSession, d: str) -> DataFrame:
    return index.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "o_orderkey", 50)


@query("q_key_rank", "SELECT count(*) AS below FROM part WHERE p_name < 'red'")
def q_key_rank(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(index.rank_of(table(spark, d, "part"), "p_name", "red"),)], "below long")


@query("q_sorted_distinct", "SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS pos FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def q_sorted_distinct(spark: SparkSession, d: str) -> DataFrame:
    return scan.numbered(table(spark, d, "lineitem").select("l_partkey").distinct(), [F.col("l_partkey").asc()])


# mutations


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """Changes to orders made from line items: half of the keys are new, many come several times."""
    lines = table(spark, d, "lineitem")
    key = (F.col("l_orderkey") * 2).alias("o_orderkey")
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return lines.select(key, F.col("l_suppkey").alias("o_custkey"), F.lit("P").alias("o_orderstatus"), F.col("l_extendedprice").alias("o_totalprice"), F.col("l_shipdate").alias("o_orderdate"), F.col("l_returnflag").alias("o_orderpriority"), seq.alias("seq"))


_BATCH = """
    batch AS (SELECT l_orderkey * 2 AS o_orderkey, l_suppkey AS o_custkey, l_extendedprice AS o_totalprice,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber {0}, l_partkey {0}, l_suppkey {0}, l_quantity {0}, l_extendedprice {0}, l_discount {0}, l_tax {0}, l_shipdate {0}) AS n
              FROM lineitem)"""


@query("q_insert_unique_reject", f"""
    WITH {_BATCH.format('ASC')}
    SELECT CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders) THEN 'exists: o_orderkey' WHEN n > 1 THEN 'repeated: o_orderkey' ELSE 'accepted' END AS outcome,
           o_orderkey, o_custkey, o_totalprice FROM batch""")
def q_insert_unique_reject(spark: SparkSession, d: str) -> DataFrame:
    batch = _batch(spark, d)
    good, bad = mutate.insert(table(spark, d, "orders"), batch, [["o_orderkey"]], "seq")
    out = good.withColumn("reason", F.lit("accepted")).unionByName(bad)
    return out.select(F.col("reason").alias("outcome"), "o_orderkey", "o_custkey", "o_totalprice")


@query("q_insert_unchecked", "SELECT o_orderkey FROM orders UNION ALL SELECT l_orderkey * 2 FROM lineitem")
def q_insert_unchecked(spark: SparkSession, d: str) -> DataFrame:
    good, _ = mutate.insert(table(spark, d, "orders"), _batch(spark, d), [["o_orderkey"]], "seq", check=False)
    return table(spark, d, "orders").select("o_orderkey").unionAll(good.select("o_orderkey"))


@query("q_upsert_last_writer", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def q_upsert_last_writer(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("seq", F.struct("ts", "event_id"))
    return mutate.upsert(e.limit(0), e, ["user_id"], "seq").select("user_id", "event_id", "event_type", "value")


@query("q_upsert_orders", f"""
    WITH {_BATCH.format('DESC')}
    SELECT o_orderkey, o_custkey, o_totalprice FROM batch WHERE n = 1
    UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch)""")
def q_upsert_orders(spark: SparkSession, d: str) -> DataFrame:
    return mutate.upsert(table(spark, d, "orders"), _batch(spark, d), ["o_orderkey"], "seq").select("o_orderkey", "o_custkey", "o_totalprice")


@query("q_upsert_codes", """
    SELECT DISTINCT l_orderkey * 2 AS o_orderkey,
           CASE WHEN o.o_orderkey IS NULL THEN 0 WHEN o.o_orderdate < TIMESTAMP '1996-01-01' THEN 2 ELSE 1 END AS code
    FROM lineitem LEFT JOIN orders o ON o.o_orderkey = l_orderkey * 2""")
def q_upsert_codes(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").withColumn("frozen", F.col("o_orderdate") < F.to_timestamp(F.lit("1996-01-01")))
    return mutate.upsert_codes(base, _batch(spark, d), ["o_orderkey"], "seq", "frozen")


@query("q_update_rows", f"""
    WITH {_BATCH.format('DESC')}
    SELECT o.o_orderkey, coalesce(b.o_custkey, o.o_custkey) AS o_custkey, coalesce(b.o_totalprice, o.o_totalprice) AS o_totalprice, o.o_orderstatus
    FROM orders o LEFT JOIN batch b ON b.o_orderkey = o.o_orderkey AND b.n = 1""")
def q_update_rows(spark: SparkSession, d: str) -> DataFrame:
    changes = _batch(spark, d).select("o_orderkey", "o_custkey", "o_totalprice", "seq")
    return mutate.update(table(spark, d, "orders"), changes, ["o_orderkey"], "seq").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("q_delete_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q_delete_rows(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return mutate.delete(table(spark, d, "orders"), bad, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("q_update_column", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#12' THEN 99 ELSE p_size END AS p_size FROM part")
def q_update_column(spark: SparkSession, d: str) -> DataFrame:
    return mutate.update_column(table(spark, d, "part"), "p_size", F.lit(99), F.col("p_brand") == "Brand#12").select("p_partkey", "p_size")


@query("q_increment", "SELECT p_partkey, p_size + 7 AS p_size, round(p_retailprice + 0.5, 6) AS p_retailprice FROM part")
def q_increment(spark: SparkSession, d: str) -> DataFrame:
    up = mutate.increment(mutate.increment(table(spark, d, "part"), "p_size", 7, kind="sint32"), "p_retailprice", 0.5)
    return up.select("p_partkey", "p_size", F.round("p_retailprice", 6).alias("p_retailprice"))


@query("q_increment_wrap", "SELECT p_partkey, (((p_size * 5 + 100 + 128) % 256 + 256) % 256 - 128)::INT AS tiny FROM part")
def q_increment_wrap(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 5).alias("tiny"))
    return mutate.increment(parts, "tiny", 100, kind="sint8")


@query("q_callback_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def q_callback_update(spark: SparkSession, d: str) -> DataFrame:
    return mutate.update_by(table(spark, d, "customer"), "c_acctbal", lambda v: (F.lit(0.0), v < 0)).select("c_custkey", "c_acctbal")


@query("q_unit_of_work", """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    UNION ALL SELECT 1000000000 + c_custkey, c_custkey FROM customer WHERE c_acctbal >= 0""")
def q_unit_of_work(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer")
    unit = mutate.UnitOfWork(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])
    unit.insert(customers.select((F.col("c_custkey") + 1000000000).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey")))
    unit.delete(customers.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")))
    return unit.view()


# versions and segments


_EVENT_VERSIONS = "SELECT event_id, user_id, event_id AS ins, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 9223372036854775807) AS del FROM events"


@query("q_snapshot_asof", f"SELECT user_id, event_id FROM ({_EVENT_VERSIONS}) WHERE ins <= 5000 AND del > 5000")
def q_snapshot_asof(spark: SparkSession, d: str) -> DataFrame:
    # an event is deleted by the next one of its user
    replaced = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("__ins_ver"), replaced.alias("__del_ver"))
    return versions.as_of(e, 5000).select("user_id", "event_id")


@query("q_merge_segments", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def q_merge_segments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", _gone().alias("gone"))
    at = F.col("o_custkey")
    return versions.merge([o.where(at < 200), o.where((at >= 200) & (at < 800)), o.where(at >= 800)], "gone").select("o_orderkey", "o_custkey")


@query("q_purge_deleted", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def q_purge_deleted(spark: SparkSession, d: str) -> DataFrame:
    return versions.purge(table(spark, d, "orders"), _gone()).select("o_orderkey", "o_totalprice")


@query("q_compact_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS new_rid FROM orders WHERE o_orderstatus <> 'F'")
def q_compact_ids(spark: SparkSession, d: str) -> DataFrame:
    return versions.compact_ids(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", _gone()).select("o_orderkey", "new_rid")


# text, documents, coercions


_TWEET = '{"RowSchema": {"columns": {"_id": {"type": "int64"}, "int1": {"type": "int32"}, "date1": {"type": "int64"}, "nick": {"type": "strzero"}, "message": {"type": "strzero"}}}}'


def _tweet_lines(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\\t\\r\\n]", " ").alias(c)
    return table(spark, d, "tweets").where("int1 IS NOT NULL AND date1 IS NOT NULL").select("_id", "int1", "date1", clean("nick"), clean("message"))


_TWEETS = r"SELECT _id, int1, date1, regexp_replace(coalesce(nick, ''), '[\t\r\n]', ' ', 'g') AS nick, regexp_replace(coalesce(message, ''), '[\t\r\n]', ' ', 'g') AS message FROM tweets WHERE int1 IS NOT NULL AND date1 IS NOT NULL"


@query("q_tsv_parse", f"SELECT *, 5 AS parsed FROM ({_TWEETS})")
def q_tsv_parse(spark: SparkSession, d: str) -> DataFrame:
    return delimited.parse(delimited.to_lines(_tweet_lines(spark, d)), load(_TWEET))


@query("q_tsv_import", f"SELECT * FROM ({_TWEETS}) WHERE _id NOT IN (SELECT _id FROM tweets WHERE int1 % 2 = 0)")
def q_tsv_import(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "lines")
    delimited.write_lines(_tweet_lines(spark, d), path, compression="gzip")
    there = table(spark, d, "tweets").where("int1 % 2 = 0").select("_id")
    return delimited.read_delimited(spark, path, load(_TWEET), skip_existing=there, key=["_id"])


@query("q_json_export", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def q_json_export(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return delimited.to_json(own).select(F.from_json("json", own.schema).alias("r")).select("r.*")


@query("q_dump", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 ORDER BY o_orderkey LIMIT 500")
def q_dump(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return delimited.dump(own, "o_orderkey", 1000, 500).select(F.from_json("json", own.schema).alias("r")).select("r.*")


@query("q_json_round_trip", "SELECT event_id, user_id, value, event_type, props FROM events")
def q_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "value", "event_type", "props")
    return delimited.to_json(e).select(F.from_json("json", e.schema).alias("r")).select("r.*")


@query("q_doc_encode", "SELECT event_id, coalesce((props->>'k')::INT, 0) AS k FROM events")
def q_doc_encode(spark: SparkSession, d: str) -> DataFrame:
    definition = load('{"RowSchema": {"columns": {"event_id": {"type": "int64"}, "k": {"type": "int32"}, "$$": {"type": "carbin"}}}}')
    whole = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(", "), F.expr("substring(props, 2)"))
    return documents.encode(table(spark, d, "events").select(whole.alias("doc")), definition).select("event_id", "k")


@query("q_doc_decode", "SELECT event_id, event_type, (props->>'k')::INT AS k FROM events")
def q_doc_decode(spark: SparkSession, d: str) -> DataFrame:
    definition = load('{"RowSchema": {"columns": {"event_id": {"type": "int64"}, "event_type": {"type": "strzero"}, "$$": {"type": "carbin"}}}}')
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("props").cast("binary").alias("$$"))
    return documents.decode(rows, definition).select(F.from_json("doc", "event_id long, event_type string, k int").alias("r")).select("r.*")


@query("q_doc_values", """
    SELECT o_orderkey, (o_custkey % 2 = 0)::INT AS flag, epoch_ms(o_orderdate) AS at, o_custkey AS stamp, 255 AS most, -32768 AS least,
           lower(hex(lpad(o_orderkey::VARCHAR, 12, '0'))) AS oid, 2 AS n, o_custkey AS item, o_orderstatus AS inner_status, true AS same FROM orders""")
def q_doc_values(spark: SparkSession, d: str) -> DataFrame:
    definition = load('{"RowSchema": {"columns": {"flag": {"type": "uint8"}, "at": {"type": "int64", "mongoType": "date"}, "stamp": {"type": "int64", "mongoType": "timestamp"}, "most": {"type": "uint8"}, "least": {"type": "int16"}, "oid": {"type": "fixed", "length": 12}, "$$": {"type": "carbin"}}}}')
    o, oid = table(spark, d, "orders"), F.lower(F.hex(F.lpad(F.col("o_orderkey").cast("string"), 12, "0")))
    form = '{"o_orderkey": %d, "flag": %s, "at": {"$date": %d}, "stamp": {"$timestamp": %d}, "most": {"$maxKey": 1}, "least": {"$minKey": 1}, "oid": {"$oid": "%s"}, "list": [%d, 1], "inner": {"s": "%s"}}'
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    doc = F.format_string(form, "o_orderkey", (F.col("o_custkey") % 2 == 0).cast("string"), ms, "o_custkey", oid, "o_custkey", "o_orderstatus")
    own = documents.encode(o.select("o_orderkey", doc.alias("doc")), definition, keep=["o_orderkey"])
    rest = F.col("`$$`").cast("string")
    a, inner = documents.array_of(rest, "list"), documents.object_of(rest, "inner")
    item, inside = F.try_variant_get(a["items"][0], "$", "bigint"), F.try_variant_get(inner["s"], "$", "string")
    return own.select("o_orderkey", F.col("flag").cast("int").alias("flag"), "at", "stamp", F.col("most").cast("int").alias("most"), F.col("least").cast("int").alias("least"), F.lower(F.hex("oid")).alias("oid"), a["n"].alias("n"), item.alias("item"), inside.alias("inner_status"), documents.same_fields(rest, rest).alias("same"))


@query("q_doc_extra_fields", "SELECT event_id, props->>'k' AS extra_k FROM events")
def q_doc_extra_fields(spark: SparkSession, d: str) -> DataFrame:
    rest = documents.undeclared(F.col("props"), ["event_id"])
    return table(spark, d, "events").select("event_id", F.get_json_object(rest, "$.k").alias("extra_k"))


@query("q_coerce_double_to_int", "SELECT c_custkey, CASE WHEN c_acctbal * 30 >= 32767 THEN 32767 WHEN c_acctbal * 30 <= -32768 THEN -32768 ELSE trunc(c_acctbal * 30)::INT END AS small FROM customer")
def q_coerce_double_to_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", coerce.saturate(F.col("c_acctbal") * 30, "sint16").cast("int").alias("small"))


@query("q_coerce_date_sec", "SELECT o_orderkey, epoch(o_orderdate)::INT AS seconds, epoch_ms(o_orderdate) AS millis FROM orders")
def q_coerce_date_sec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", coerce.seconds_of_date(F.col("o_orderdate")).alias("seconds"), coerce.millis_of_date(F.col("o_orderdate")).alias("millis"))


@query("q_coerce_date_back", "SELECT o_orderkey, o_orderdate::TIMESTAMP AS from_seconds, o_orderdate::TIMESTAMP AS from_millis FROM orders")
def q_coerce_date_back(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", coerce.date_of_seconds(coerce.seconds_of_date(at)).alias("from_seconds"), coerce.date_of_millis(coerce.millis_of_date(at)).alias("from_millis"))


@query("q_coerce_special", """
    SELECT c_custkey, (c_acctbal < 0)::INT AS flag, -2147483648 AS least, 4294967295 AS greatest, hex(lpad(c_custkey::VARCHAR, 12, '0')) AS oid,
           '01' || hex(c_name) AS packed, c_name AS pattern, 'i' AS options FROM customer""")
def q_coerce_special(spark: SparkSession, d: str) -> DataFrame:
    digits = F.lpad(F.col("c_custkey").cast("string"), 12, "0")
    pair = coerce.regex_pair(F.col("c_name"), F.lit("i"))
    return table(spark, d, "customer").select("c_custkey", coerce.number_of_bool(F.col("c_acctbal") < 0).cast("int").alias("flag"), coerce.least_value("sint32").alias("least"), coerce.greatest_value("uint32").alias("greatest"), F.hex(coerce.object_id(F.hex(digits))).alias("oid"), F.hex(coerce.binary_for_text(F.col("c_name").cast("binary"))).alias("packed"), pair["pattern"].alias("pattern"), pair["options"].alias("options"))


@query("q_text_forms", r"""
    SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS trimmed, regexp_replace(text, '\s+$', '') AS chomped, hex(coalesce(source, '')) AS hexed,
           coalesce(source, '') AS back FROM documents""")
def q_text_forms(spark: SparkSession, d: str) -> DataFrame:
    source = F.coalesce("source", F.lit(""))
    coded = strings.utf_decode(strings.utf_encode(strings.utf_decode(strings.utf_encode(source, 16), 16), 32), 32)
    return table(spark, d, "documents").select("doc_id", strings.trim_space(F.col("text")).alias("trimmed"), strings.chomp_space(F.col("text")).alias("chomped"), strings.hex_of(strings.from_hex(strings.hex_of(source))).alias("hexed"), coded.alias("back"))


@query("q_successor", "SELECT p_partkey, left(p_name, length(p_name) - 1) || chr(ascii(right(p_name, 1)) + 1) AS next FROM part WHERE p_name <> ''")
def q_successor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_name <> ''").select("p_partkey", strings.successor(F.col("p_name").cast("binary")).cast("string").alias("next"))


@query("q_crc32c")
def q_crc32c(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", bits.crc32c(F.col("text").cast("binary")).alias("crc"))


@query("q_coerce_number_text", "SELECT c_custkey, format('{:.6f}', c_acctbal) AS balance, (c_custkey * 7)::VARCHAR AS digits FROM customer")
def q_coerce_number_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", coerce.text_of_number(F.col("c_acctbal"), "float64").alias("balance"), coerce.text_of_number(F.col("c_custkey") * 7, "sint64").alias("digits"))


@query("q_coerce_text_number", "SELECT _id, date1 % 65536 AS narrow FROM tweets")
def q_coerce_text_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tweets").select("_id", coerce.number_of_text(F.concat(F.lit("  "), F.col("date1").cast("string")), "uint16").cast("long").alias("narrow"))


@query("q_missing_zero", "SELECT _id, coalesce(nick, '') AS nick, coalesce(text6, '') AS text6 FROM tweets")
def q_missing_zero(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tweets").select("_id", coerce.zero_if_missing(F.col("nick"), "strzero").alias("nick"), coerce.zero_if_missing(F.col("text6"), "strzero").alias("text6"))


@query("q_split_fields", "SELECT _id, string_split_regex(trim(message), '\\s+')[1] AS first_word, len(string_split_regex(trim(message), '\\s+')) AS n FROM tweets WHERE trim(message) <> ''")
def q_split_fields(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "tweets").where(F.trim("message") != "").select("_id", strings.split_fields(F.col("message"), " ").alias("w"))
    return own.select("_id", F.col("w")[0].alias("first_word"), F.size("w").alias("n"))


@query("q_signed_key_order", "SELECT c_custkey, row_number() OVER (ORDER BY (c_acctbal * 100)::BIGINT, c_custkey) - 1 AS pos FROM customer")
def q_signed_key_order(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    keyed = table(spark, d, "customer").select("c_custkey", strings.signed_key(cents).alias("k"))
    return scan.numbered(keyed, [F.col("k").asc(), F.col("c_custkey").asc()]).select("c_custkey", "pos")


@query("q_pipeline", "SELECT o_orderkey, o_totalprice * 2 AS twice, o_totalprice * 2 > 300000 AS large FROM orders")
def q_pipeline(spark: SparkSession, d: str) -> DataFrame:
    double = pipeline.Stage(lambda b: b.assign(twice=b.o_totalprice * 2)[["o_orderkey", "twice"]], "o_orderkey long, twice double")
    mark = pipeline.Stage(lambda b: b.assign(large=b.twice > 300000), "o_orderkey long, twice double, large boolean")
    return (double | mark).run(table(spark, d, "orders").select("o_orderkey", "o_totalprice"))


@query("q_pipeline_ordered", "SELECT o_orderkey, o_totalprice * 2 AS twice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def q_pipeline_ordered(spark: SparkSession, d: str) -> DataFrame:
    double = pipeline.Stage(lambda b: b.assign(twice=b.o_totalprice * 2)[["o_orderkey", "twice"]], "o_orderkey long, twice double")
    return scan.numbered(double.run(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), keep_order="o_orderkey"), [F.col("o_orderkey").asc()])


# key-value access


def _documents_kv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("val"))


@query("q_kv_get", "SELECT doc_id AS key, source AS val FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def q_kv_get(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents_kv(spark, d)
    return kv.multi_get(rows, rows.agg(F.max("key").alias("key")))


@query("q_kv_multiget", "SELECT DISTINCT e.user_id + 1000000 AS key, d.source AS val FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id + 1000000")
def q_kv_multiget(spark: SparkSession, d: str) -> DataFrame:
    return kv.multi_get(_documents_kv(spark, d), table(spark, d, "events").select((F.col("user_id") + 1000000).alias("key")))


@query("q_kv_iterate", "SELECT doc_id AS key, source AS val FROM documents WHERE doc_id >= 1000500")
def q_kv_iterate(spark: SparkSession, d: str) -> DataFrame:
    return kv.from_key(_documents_kv(spark, d), 1000500)


@query("q_kv_prev", "SELECT doc_id AS key, source AS val, row_number() OVER (ORDER BY doc_id DESC) - 1 AS pos FROM documents WHERE doc_id < 1000500")
def q_kv_prev(spark: SparkSession, d: str) -> DataFrame:
    return scan.numbered(kv.before_key(_documents_kv(spark, d), 1000500), [F.col("key").desc()])


@query("q_kv_batch", """
    WITH b AS (SELECT user_id + 1000000 AS key, arg_max(event_type, event_id) AS t FROM events GROUP BY 1)
    SELECT doc_id AS key, source AS val FROM documents WHERE doc_id NOT IN (SELECT key FROM b)
    UNION ALL SELECT key, t FROM b WHERE t <> 'error'""")
def q_kv_batch(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    batch = table(spark, d, "events").select((F.col("user_id") + 1000000).alias("key"), F.col("event_type").alias("val"), op.alias("op"), F.col("event_id").alias("seq"))
    return kv.apply_batch(_documents_kv(spark, d), batch)


@query("q_kv_snapshot", """
    SELECT 'snapshot' AS at, p_partkey::VARCHAR AS key, p_name AS val FROM part
    UNION ALL SELECT 'now', p_partkey::VARCHAR, CASE WHEN p_size % 3 = 1 THEN p_brand ELSE p_name END FROM part WHERE p_size % 3 <> 0""")
def q_kv_snapshot(spark: SparkSession, d: str) -> DataFrame:
    pairs = kv.KeyValue.open(spark, _folder(spark, "kv"))
    key, part = F.col("p_partkey").cast("string").cast("binary").alias("key"), table(spark, d, "part")
    pairs.load(part.select(key, F.col("p_name").cast("binary").alias("val"), F.lit("put").alias("op"), F.lit(0).alias("seq")))
    snapshot = pairs.snapshot()
    op = F.when(F.col("p_size") % 3 == 0, "delete").otherwise("put")
    pairs.load(part.where("p_size % 3 <> 2").select(key, F.col("p_brand").cast("binary").alias("val"), op.alias("op"), F.lit(0).alias("seq")))
    text = lambda rows, at: rows.select(F.lit(at).alias("at"), F.col("key").cast("string").alias("key"), F.col("val").cast("string").alias("val"))
    return text(snapshot.rows(), "snapshot").unionAll(text(pairs.rows(), "now"))


# index and scan work on the domain tables


@query("q_users_city_street", "SELECT id, city, street FROM users WHERE city = 'Heiklek' AND street >= '2' AND street < '3'")
def q_users_city_street(spark: SparkSession, d: str) -> DataFrame:
    return index.between(index.exact(table(spark, d, "users"), ["city"], ["Heiklek"]), ["street"], ["2"], ["3"]).select("id", "city", "street")


@query("q_feed_current", "SELECT id, arg_max(op, (update_time, feed_seq)) AS op, max(update_time) AS update_time FROM user_feed GROUP BY id HAVING arg_max(op, (update_time, feed_seq)) <> 'delete'")
def q_feed_current(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "user_feed").select("id", "op", "update_time", F.struct("update_time", "feed_seq").alias("seq"))
    return mutate.upsert(feed.limit(0), feed, ["id"], "seq").where(F.col("op") != "delete").select("id", "op", "update_time")


@query("q_tweets_nonunique", "SELECT _id, count(*) AS n FROM tweets GROUP BY _id")
def q_tweets_nonunique(spark: SparkSession, d: str) -> DataFrame:
    return index.key_counts(table(spark, d, "tweets"), ["_id"])


@query("q_bit_rank", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_orderkey) - 1 END AS rank1 FROM orders")
def q_bit_rank(spark: SparkSession, d: str) -> DataFrame:
    return bits.with_rank(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), [F.col("o_orderkey").asc()], _gone()).select("o_orderkey", "rank1")


@query("q_popcount", "SELECT o_orderkey, bit_count(o_custkey)::INT AS ones FROM orders")
def q_popcount(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", bits.popcount(F.col("o_custkey")).alias("ones"))


@query("q_varint_round_trip", "SELECT o_custkey, max(o_orderkey) AS newest, count(*) AS n FROM orders GROUP BY o_custkey")
def q_varint_round_trip(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    back = lists.select("o_custkey", bits.varint_encode(bits.deltas(F.col("ids"))).alias("packed")).select("o_custkey", bits.varint_decode("packed").alias("steps"))
    ids = bits.undeltas(F.col("steps"))
    return back.select("o_custkey", F.array_max(ids).alias("newest"), F.size("steps").cast("long").alias("n"))


# a table in a folder, in versions


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_ORDER = ["o_orderkey", "o_custkey", "o_totalprice"]


def _plain_store(spark: SparkSession, d: str, **options) -> Store:
    """Orders in one commit."""
    orders = table(spark, d, "orders").select(*_ORDER)
    store = Store.create(spark, _folder(spark, "orders"), orders.schema, [["o_orderkey"]], **options)
    store.insert(orders, check=False)
    return store


def _two_segments(spark: SparkSession, d: str) -> Store:
    """Orders of even customers, then those of odd ones."""
    orders = table(spark, d, "orders").select(*_ORDER)
    store = Store.create(spark, _folder(spark, "orders"), orders.schema, [["o_orderkey"]])
    for odd in (0, 1):
        store.insert(orders.where(F.col("o_custkey") % 2 == odd), check=False)
    return store


def _orders_store(spark: SparkSession, d: str) -> Store:
    """Orders, then changes from line items, then without the customers in debt: versions 1 to 3."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    store = Store.create(spark, _folder(spark, "orders"), orders.schema, [["o_orderkey"]])
    store.insert(orders, check=False)
    store.upsert(_batch(spark, d).select("o_orderkey", "o_custkey", "o_totalprice", "seq"), "seq")
    debt = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    store.delete(debt, ["o_custkey"])
    return store


_AFTER = f"""
    WITH {_BATCH.format('DESC')},
    up AS (SELECT o_orderkey, o_custkey, o_totalprice FROM batch WHERE n = 1
           UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch))"""


@query("q_store_newest", f"{_AFTER} SELECT * FROM up WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q_store_newest(spark: SparkSession, d: str) -> DataFrame:
    return _orders_store(spark, d).read()


@query("q_store_compacted", f"{_AFTER} SELECT * FROM up WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q_store_compacted(spark: SparkSession, d: str) -> DataFrame:
    store = _orders_store(spark, d)
    store.purge()
    return store.read()


@query("q_store_asof", f"{_AFTER} SELECT * FROM up")
def q_store_asof(spark: SparkSession, d: str) -> DataFrame:
    store = _orders_store(spark, d)
    store.compact()
    return store.read(2)


@query("q_store_changes", f"{_AFTER} SELECT 'delete' AS op, o_orderkey FROM up WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q_store_changes(spark: SparkSession, d: str) -> DataFrame:
    return _orders_store(spark, d).changes(2).select("op", "o_orderkey")


@query("q_stream_upsert", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def q_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    from kittiwake.streaming.changes import apply_stream

    events = table(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"))
    store = Store.create(spark, _folder(spark, "stream"), events.drop("op").schema, [["user_id"]])
    # the file is one batch of the change stream
    changes = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d.rstrip('/')}/events.parquet*").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"))
    apply_stream(changes, store, "event_id", _folder(spark, "stream-checkpoint"), op="op").awaitTermination()
    return store.read()


@query("q_store_exact", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def q_store_exact(spark: SparkSession, d: str) -> DataFrame:
    return _plain_store(spark, d).exact([77])


@query("q_store_range", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 4000")
def q_store_range(spark: SparkSession, d: str) -> DataFrame:
    store = _two_segments(spark, d)
    store.compact()
    return store.between([1000], [4000])


@query("q_store_grown", "SELECT 1 AS at, o_orderkey FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT 2, o_orderkey FROM orders")
def q_store_grown(spark: SparkSession, d: str) -> DataFrame:
    store = _two_segments(spark, d)
    return store.read(1).select(F.lit(1).alias("at"), "o_orderkey").unionAll(store.read().select(F.lit(2), "o_orderkey"))


@query("q_store_in_place", """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rid,
           CASE WHEN o_orderkey % 3 = 0 THEN (CASE WHEN o_custkey < 500 THEN o_totalprice + 1 ELSE o_totalprice END) * 2
                WHEN o_custkey < 500 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders""")
def q_store_in_place(spark: SparkSession, d: str) -> DataFrame:
    store = _plain_store(spark, d, in_place=[["o_totalprice"]])
    store.set_columns({"o_totalprice": "o_totalprice + 1"}, "o_custkey < 500")
    store.set_columns({"o_totalprice": "o_totalprice * 2"}, "o_orderkey % 3 = 0")
    return store.read(ids=True).select("o_orderkey", F.col("__rid").alias("rid"), "o_totalprice")


@query("q_store_update", "SELECT o_orderkey, CASE WHEN o_custkey < 500 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders")
def q_store_update(spark: SparkSession, d: str) -> DataFrame:
    store = _plain_store(spark, d)
    store.update({"o_custkey": "o_custkey + 1"}, "o_custkey < 500")
    return store.read().select("o_orderkey", "o_custkey")


@query("q_store_undelete", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rid FROM orders QUALIFY o_custkey >= 500 OR o_orderkey % 2 = 0")
def q_store_undelete(spark: SparkSession, d: str) -> DataFrame:
    store = _plain_store(spark, d)
    store.delete("o_custkey < 500")
    store.undelete("o_orderkey % 2 = 0")
    return store.read(ids=True).select("o_orderkey", F.col("__rid").alias("rid"))


@query("q_store_transaction", """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal >= 0""")
def q_store_transaction(spark: SparkSession, d: str) -> DataFrame:
    store, customers = _plain_store(spark, d), table(spark, d, "customer")
    t = store.begin()
    t.upsert(customers.select(F.col("c_custkey").cast("long").alias("o_orderkey"), F.col("c_nationkey").cast("long").alias("o_custkey"), F.lit(0.0).alias("o_totalprice"), F.lit(0).alias("seq")), "seq")
    t.delete(customers.where("c_acctbal < 0").select(F.col("c_custkey").cast("long").alias("o_orderkey")))
    t.commit()
    return store.read().select("o_orderkey", "o_custkey")


@query("q_store_tag_and_copy", "SELECT 'tag' AS at, o_orderkey FROM orders UNION ALL SELECT 'copy', o_orderkey FROM orders WHERE o_custkey >= 500")
def q_store_tag_and_copy(spark: SparkSession, d: str) -> DataFrame:
    store = _plain_store(spark, d)
    store.tag("before")
    store.delete("o_custkey < 500")
    copy = store.copy_to(_folder(spark, "copy"))
    return store.read("before").select(F.lit("tag").alias("at"), "o_orderkey").unionAll(copy.read().select(F.lit("copy"), "o_orderkey"))


@query("q_store_maintain", "SELECT 'convert' AS first, 'none' AS last, count(*) AS n FROM orders")
def q_store_maintain(spark: SparkSession, d: str) -> DataFrame:
    store = _plain_store(spark, d)
    done = [store.maintain() for _ in range(2)]
    return store.read().agg(F.count("*").alias("n")).select(F.lit(done[0]).alias("first"), F.lit(done[1]).alias("last"), "n")


@query("q_store_replay", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey >= 500")
def q_store_replay(spark: SparkSession, d: str) -> DataFrame:
    from kittiwake.streaming.changes import replay

    store = _plain_store(spark, d)
    copy = Store.create(spark, _folder(spark, "replay"), store.schema(), [["o_orderkey"]])
    replay(store, copy)
    store.delete("o_custkey < 500")
    replay(store, copy)
    return copy.read()


@query("q_catalog", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'part', 0")
def q_catalog(spark: SparkSession, d: str) -> DataFrame:
    catalog, customers = Catalog(spark, _folder(spark, "catalog")), table(spark, d, "customer").select("c_custkey", "c_name")
    catalog.create_table("customer", customers.schema, [["c_custkey"]]).insert(customers, check=False)
    catalog.create_table("part", customers.schema).insert(customers, check=False)
    catalog.create_table("region", customers.schema)
    catalog.open_table("part").clear()
    catalog.drop_table("region")
    return spark.createDataFrame([(n, catalog.open_table(n).read().count()) for n in catalog.list_tables()], "name string, n long")
