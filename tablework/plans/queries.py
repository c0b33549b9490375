"""Queries over the sample star schema: one or more per operator, each with its SQL twin where SQL can say it.

Every query reads whole tables.  Derived inputs (a second ledger, dirty text, grids) are computed from
the tables by fixed column rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tablework import scale
from tablework.functions import columns as C
from tablework.functions import text as X
from tablework.functions import urls as U
from tablework.functions.registry import FunctionRegistry
from tablework.operators import aggregate as A
from tablework.operators import filters as L
from tablework.operators import finance as P
from tablework.operators import headers as H
from tablework.operators import infer as I
from tablework.operators import lookup as J
from tablework.operators import project as PR
from tablework.operators import quality as Q
from tablework.operators import rating as RT
from tablework.operators import reshape as S
from tablework.operators import retrieval as T
from tablework.operators import windows as W
from tablework.operators.reconcile import diff_snapshots, reconcile, reconcile_counts
from tablework.plans.flows import finance_closed_loop, run_flow
from tablework.session import checkpointed, scratch_path
from tablework.sources import feeds as FD
from tablework.sources import grids as G
from tablework.sources import html as HT
from tablework.sources import ingest as N
from tablework.sources import json_tables as JT
from tablework.sources import quoted
from tablework.sources import sinks as K
from tablework.streaming.streams import dedupe_stream, flag_repeat_fetch_stream, ingest_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WS = r"[\s\x0b   -     　﻿]"
SQL_WS = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


# ================================================================== reconcile
def ledgers(spark, sf):
    """The orders as booked, and as a second system might report them."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    ref = F.col("o_orderkey").cast("string")
    left = o.select(ref.alias("ref"), "o_totalprice", "o_orderpriority", (F.col("o_orderkey") * 2).alias("seq"))
    copies = F.when((st == "P") & (pr == "1-URGENT"), 0).when((st == "O") & (pr == "5-LOW"), 2).otherwise(1)
    own = o.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    more = o.filter((st == "P") & (pr == "4-NOT SPECIFIED")).withColumn("copy", F.lit(-1))
    right = own.unionByName(more).select(
        F.when(F.col("copy") == -1, F.concat(F.lit("-"), ref)).when(pr == "3-MEDIUM", F.concat(F.lit(" "), ref, F.lit("  "))).otherwise(ref).alias("ref"),
        (F.col("o_totalprice") + F.when((st == "F") & (pr == "2-HIGH"), 1.0).otherwise(0.0)).alias("o_totalprice"),
        "o_orderpriority",
        (F.col("o_orderkey") * 2 + F.greatest(F.col("copy"), F.lit(0))).alias("seq"),
    )
    return left, right


SQL_LEDGERS = """
l AS (SELECT cast(o_orderkey AS varchar) k, o_totalprice p, o_orderpriority pr, o_orderkey * 2 AS seq FROM orders),
r AS (
  SELECT cast(o_orderkey AS varchar) k, o_totalprice + CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 1.0 ELSE 0.0 END p,
         o_orderpriority pr, o_orderkey * 2 + c AS seq
  FROM orders, (VALUES (0), (1)) v(c)
  WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
    AND (c = 0 OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW'))
  UNION ALL
  SELECT '-' || cast(o_orderkey AS varchar), o_totalprice, o_orderpriority, o_orderkey * 2 FROM orders
  WHERE o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED'),
l1 AS (SELECT *, row_number() OVER (PARTITION BY k, p, pr ORDER BY seq) n FROM l),
r1 AS (SELECT *, row_number() OVER (PARTITION BY k, p, pr ORDER BY seq) n FROM r),
m AS (SELECT l1.k, l1.seq ls, r1.seq rs FROM l1 JOIN r1 ON l1.k = r1.k AND l1.p = r1.p AND l1.pr = r1.pr AND l1.n = r1.n),
l2 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) n2 FROM l1 WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = l1.k AND m.ls = l1.seq)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) n2 FROM r1 WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = r1.k AND m.rs = r1.seq)),
result AS (
  SELECT 'matched' AS status, k AS key, ls AS left_seq, rs AS right_seq, '' AS conflict_columns FROM m
  UNION ALL
  SELECT CASE WHEN l2.k IS NULL THEN 'right_only' WHEN r2.k IS NULL THEN 'left_only' ELSE 'conflict' END,
         coalesce(l2.k, r2.k), l2.seq, r2.seq,
         CASE WHEN l2.k IS NULL OR r2.k IS NULL THEN ''
              ELSE concat_ws(',', CASE WHEN l2.p <> r2.p THEN 'o_totalprice' END, CASE WHEN l2.pr <> r2.pr THEN 'o_orderpriority' END) END
  FROM l2 FULL JOIN r2 ON l2.k = r2.k AND l2.n2 = r2.n2)"""
RESULT = ["status", "key", "left_seq", "right_seq", "conflict_columns"]


def _ledger_result(spark, sf, **kw):
    left, right = ledgers(spark, sf)
    return reconcile(left, right, ["ref"], ["o_totalprice", "o_orderpriority"], order_by=["seq"], **kw)


@query(f"WITH {SQL_LEDGERS} SELECT * FROM result")
def reconcile_ledgers(spark, sf):
    return _ledger_result(spark, sf).select(*RESULT)


@query(f"""WITH {SQL_LEDGERS}
SELECT count(*) FILTER (status = 'matched') matched, count(*) FILTER (status = 'conflict') conflict,
  count(*) FILTER (status = 'left_only') left_only, count(*) FILTER (status = 'right_only') right_only, count(*) total,
  count(*) FILTER (status = 'conflict') review_pending, count(*) FILTER (status = 'matched') / cast(count(*) AS double) match_rate FROM result""")
def reconcile_counts_by_status(spark, sf):
    return reconcile_counts(_ledger_result(spark, sf))


@query(f"""WITH {SQL_LEDGERS} SELECT status, key, left_seq, right_seq, CASE WHEN status = 'matched' THEN 'exact' ELSE status END AS match_mode,
  CASE WHEN status = 'matched' THEN 1.0::double ELSE 0.0::double END AS score, CASE WHEN status = 'conflict' THEN '需复核' ELSE 'auto' END AS review FROM result""")
def reconcile_audit_columns(spark, sf):
    out = _ledger_result(spark, sf, audit_columns=True)
    return out.select(
        *RESULT[:4], F.col("__match_mode").alias("match_mode"), F.col("__match_score").alias("score"), F.col("__review").alias("review")
    )


@query("""WITH s AS (SELECT l_orderkey k, cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) a FROM lineitem GROUP BY 1)
SELECT CASE WHEN k IS NULL THEN 'left_only' WHEN o_orderkey IS NULL THEN 'right_only' WHEN round(o_totalprice, 2) = a THEN 'matched' ELSE 'conflict' END status,
  cast(coalesce(o_orderkey, k) AS varchar) AS key, round(o_totalprice, 2) left_amount, a right_amount FROM orders FULL JOIN s ON o_orderkey = k""")
def reconcile_orders_lines(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ref"), F.round("o_totalprice", 2).alias("amount"))
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("ref")).agg(F.sum(money("l_extendedprice")).cast("double").alias("amount"))
    return reconcile(o, li, ["ref"], order_by=["ref"]).select("status", "key", "left_amount", "right_amount")


@query("""SELECT 'matched' AS status, CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_name) ELSE c_name END AS key, c_custkey left_id, c_custkey right_id
FROM customer WHERE c_mktsegment <> 'MACHINERY'
UNION ALL SELECT 'left_only', lower(c_name), c_custkey, NULL FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT 'right_only', lower(c_name) || '-x', NULL, c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def reconcile_normalize_names(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    left = c.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    seg = F.col("c_mktsegment")
    altered = F.when(seg == "BUILDING", F.concat(F.lit(" "), F.upper("c_name"))).when(seg == "MACHINERY", F.concat("c_name", F.lit("-X"))).otherwise(F.col("c_name"))
    right = c.select(altered.alias("name"), F.col("c_custkey").alias("id"))
    return reconcile(left, right, ["name"], ["id"], "normalize", "trim_lower", order_by=["id"]).select("status", "key", "left_id", "right_id")


@query("""SELECT cast(o_orderkey AS varchar) AS key, CASE WHEN o_orderpriority = '2-HIGH' THEN 'conflict' ELSE 'matched' END status,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'amount' ELSE '' END conflict_columns FROM orders""")
def reconcile_tolerance(spark, sf):
    o = table(spark, sf, "orders")
    drift = F.when(F.col("o_orderpriority") == "2-HIGH", 0.02).when(F.col("o_orderpriority") == "5-LOW", -0.005).otherwise(0.005)
    left = o.select(F.col("o_orderkey").alias("ref"), F.col("o_totalprice").alias("amount"))
    right = o.select(F.col("o_orderkey").alias("ref"), (F.col("o_totalprice") + drift).alias("amount"))
    return reconcile(left, right, ["ref"], ["amount"], tolerance=0.01, order_by=["ref"]).select("key", "status", "conflict_columns")


@query()
def reconcile_tolerance_groups(spark, sf):
    """Many rows per key: lines of a part, prices within 100."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("ref"),
        F.col("l_extendedprice").alias("amount"), "l_orderkey", "l_suppkey", "l_linenumber",
    )
    right = li.withColumn("amount", F.col("amount") + F.when(F.col("l_linenumber") > 4, 90.0).otherwise(-120.0))
    order = ["l_orderkey", "l_linenumber", "l_suppkey"]
    out = reconcile(li, right, ["ref"], ["amount"], tolerance=100.0, order_by=order)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _ship_sides(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("prio")
    )
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"))
    s = o.join(first, F.col("seq") == F.col("l_orderkey")).select(
        "cust", F.to_date("ship").alias("day"), "seq", "prio"
    )
    return o, s


@query()
def reconcile_ship_window(spark, sf):
    o, s = _ship_sides(spark, sf)
    out = reconcile(o, s, ["cust", "day"], ["prio"], "date_window", window_days=30, left_date="day", right_date="day", order_by=["seq"])
    return out.select("status", "key", "left_seq", "right_seq", "conflict_columns", F.col("__match_mode").alias("match_mode"), F.col("__match_score").alias("score"))


@query("""WITH d AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderkey % 40 AS late,
  cast(DATE '2000-01-01' + cast(100 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS int) AS date) AS day FROM orders)
SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'conflict' ELSE 'matched' END AS status, o_orderkey AS left_seq, o_orderkey AS right_seq,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'prio' ELSE '' END AS conflict_columns FROM d WHERE late <= 30
UNION ALL SELECT 'left_only', o_orderkey, NULL, '' FROM d WHERE late > 30 UNION ALL SELECT 'right_only', NULL, o_orderkey, '' FROM d WHERE late > 30""")
def reconcile_window_spaced(spark, sf):
    """A customer's orders 100 days apart and their shipments 0 to 39 days later: the nearest partner is known."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    day = F.date_add(F.lit("2000-01-01").cast("date"), 100 * rank)
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), day.alias("day"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("prio"))
    prio = F.when(F.col("prio") == "5-LOW", "0-NONE").otherwise(F.col("prio"))
    s = o.select("cust", F.date_add("day", (F.col("seq") % 40).cast("int")).alias("day"), "seq", prio.alias("prio"))
    out = reconcile(o, s, ["cust", "day"], ["prio"], "date_window", window_days=30, left_date="day", right_date="day", order_by=["seq"])
    return out.select("status", "left_seq", "right_seq", "conflict_columns")


@query("""SELECT cast(o_custkey AS varchar) AS key, o_orderkey AS left_seq, o_orderkey AS right_seq,
  CASE WHEN o_orderkey % 7 < 4 THEN 'matched' ELSE 'conflict' END AS status, CASE WHEN o_orderkey % 7 < 4 THEN '' ELSE 'amount' END AS conflict_columns FROM orders""")
def reconcile_tolerance_spaced(spark, sf):
    """Several orders per customer with amounts 1,000 apart: those off by 90 pair within 100, those off by 120 are left over in order."""
    left = table(spark, sf, "orders").select(F.col("o_custkey").alias("ref"), (F.col("o_orderkey") * 1000.0).alias("amount"), F.col("o_orderkey").alias("seq"))
    right = left.withColumn("amount", F.col("amount") + F.when(F.col("seq") % 7 < 4, 90.0).otherwise(-120.0))
    return reconcile(left, right, ["ref"], ["amount"], tolerance=100.0, order_by=["seq"]).select("key", "left_seq", "right_seq", "status", "conflict_columns")


@query("""SELECT CASE WHEN p_type = 'ECONOMY' THEN 'removed' WHEN p_brand = 'Brand#2' THEN 'changed' ELSE 'unchanged' END AS change,
  cast(p_partkey AS varchar) AS key, CASE WHEN p_type <> 'ECONOMY' AND p_brand = 'Brand#2' THEN 'p_retailprice' ELSE '' END AS changed_columns FROM part
UNION ALL SELECT 'added', '-' || cast(p_partkey AS varchar), '' FROM part WHERE p_type = 'ECONOMY'""")
def diff_part_snapshots(spark, sf):
    old = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice")
    key = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("-"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    new = old.withColumns({"p_partkey": key, "p_retailprice": F.col("p_retailprice") + F.when(F.col("p_brand") == "Brand#2", 1.0).otherwise(0.0)})
    old = old.withColumn("p_partkey", F.col("p_partkey").cast("string"))
    return diff_snapshots(old, new, ["p_partkey"], order_by=["p_partkey"]).select("change", "key", "changed_columns")


# ================================================================== cleaning
@query(f"""SELECT doc_id, md5(trim(regexp_replace(text, '{SQL_WS}+', ' ', 'g'), ' ')) AS kept,
  md5(list_aggregate(list_transform(regexp_extract_all(trim(regexp_replace(text, '{SQL_WS}+', ' ', 'g'), ' '), '[A-Za-z]+|[^A-Za-z]+'),
    lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z]') THEN upper(x[1]) || lower(x[2:]) ELSE x END), 'string_agg', '')) AS title FROM documents""")
def normalize_text_documents(spark, sf):
    d = scale.spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.md5(C.normalize_text("text", "keep")).alias("kept"), F.md5(C.normalize_text("text", "title")).alias("title"))


@query("""SELECT c_custkey, c_name AS k_trim, lower(c_name) AS k_lower, 'A b' AS k_collapse FROM customer""")
def normalize_keys(spark, sf):
    c = table(spark, sf, "customer")
    padded = F.concat(F.lit("　 "), F.col("c_name"), F.lit(" \t"))
    spaced = F.concat(F.lit(" A"), F.repeat(F.lit(" "), (F.col("c_nationkey") + 1)), F.lit("b "))
    return c.select(
        "c_custkey",
        C.normalize_key(padded).alias("k_trim"),
        C.normalize_key(padded, "trim_lower").alias("k_lower"),
        C.normalize_key(spaced, "trim_collapse_ws").alias("k_collapse"),
    )


SQL_DIRTY = """CASE o_orderpriority WHEN '1-URGENT' THEN 'N/A' WHEN '2-HIGH' THEN '$' || cast(cast(round(o_totalprice) AS bigint) AS varchar)
  WHEN '3-MEDIUM' THEN ' 1,' || cast(cast(round(o_totalprice) AS bigint) AS varchar) || ' ' WHEN '4-NOT SPECIFIED' THEN '' ELSE cast(cast(round(o_totalprice) AS bigint) AS varchar) || '.5' END"""


def _dirty(spark, sf):
    whole = F.round("o_totalprice").cast("long").cast("string")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "N/A")
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("$"), whole))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit(" 1,"), whole, F.lit(" ")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "")
        .otherwise(F.concat(whole, F.lit(".5")))
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("amount"))


@query(f"""SELECT o_orderkey, try_cast(replace(trim(amount), ',', '') AS double) AS plain, try_cast(replace(replace(trim(amount), ',', ''), '$', '') AS double) AS money,
  CASE WHEN amount = '' THEN 'same' WHEN try_cast(replace(trim(amount), ',', '') AS double) IS NULL THEN 'blanked' ELSE 'converted' END AS kind,
  amount = 'N/A' AS bad FROM (SELECT o_orderkey, {SQL_DIRTY} AS amount FROM orders)""")
def coerce_dirty_amount(spark, sf):
    return _dirty(spark, sf).select(
        "o_orderkey", C.to_number("amount").alias("plain"), C.to_number("amount", currency=True).alias("money"),
        C.number_kind("amount").alias("kind"), C.flag_bad_amount("amount").alias("bad"),
    )


@query("""SELECT count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS same, count(*) FILTER (o_orderpriority IN ('3-MEDIUM', '5-LOW')) AS converted,
  count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS blanked FROM orders""")
def coerce_counts_amount(spark, sf):
    return S.coerce_counts(_dirty(spark, sf), "amount", "number")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  strftime(o_orderdate, '%Y-%m-%d') AS from_serial, CAST(o_orderdate AS date) AS from_number FROM orders""")
def parse_mixed_dates(spark, sf):
    d = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "yyyyMMdd"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.date_format(d, "yyyy/M/d"), F.lit(" 23:59:00 UTC")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(d, "M/d/yyyy"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(d, " yyyy-MM-dd"))
        .otherwise(F.date_format(d, "yyyy-'13'-dd"))
    )
    serial = F.datediff(d.cast("date"), F.lit(C.EPOCH).cast("date"))
    o = table(spark, sf, "orders").select("o_orderkey", text.alias("t"), serial.alias("s"), F.date_format(d, "yyyyMMdd").cast("int").alias("n"))
    return o.select(
        "o_orderkey", F.date_format(C.to_date("t"), "yyyy-MM-dd").alias("day"), C.day_to_iso("s").alias("from_serial"),
        C.to_date("n", o.schema["n"].dataType).alias("from_number"),
    )


@query(r"""SELECT o_orderkey, regexp_replace(cast(o_totalprice AS varchar), '\.0$', '') AS price, cast(cast(round(o_totalprice * 1000) AS bigint) AS varchar) AS big,
  lpad(cast(o_orderkey AS varchar), 15, '0') AS id_text, trim(o_orderpriority) AS txt FROM orders""")
def plain_numbers_and_ids(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        C.number_to_plain_text("o_totalprice").alias("price"),
        C.number_to_plain_text(F.round(F.col("o_totalprice") * 1000)).alias("big"),
        C.to_id_text(F.lpad(F.col("o_orderkey").cast("string"), 15, "0"), None, F.lit("1.2E+14")).alias("id_text"),
        C.to_text(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("txt"),
    )


@query("""SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS flag, lower(o_orderpriority) AS sku,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'partial_refund' END AS order_status, o_orderstatus AS st FROM orders""")
def booleans_skus_statuses(spark, sf):
    o = table(spark, sf, "orders")
    words = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "是").otherwise("no")
    raw = F.when(F.col("o_orderstatus") == "F", " Shipped ").when(F.col("o_orderstatus") == "O", "Partial Refund").otherwise("???")
    out = P.map_status(o.withColumn("raw", raw), "raw")
    return out.select(
        "o_orderkey", C.to_bool(words).alias("flag"), C.normalize_sku(F.concat(F.lit("\t"), "o_orderpriority")).alias("sku"),
        "order_status", F.col("o_orderstatus").alias("st"),
    )


@query("""SELECT p_partkey, regexp_replace(p_name, 'RING', 'Loop$1', 'gi') AS p_name, CASE WHEN p_brand = 'Brand#2' THEN 'B2' ELSE p_brand END AS p_brand FROM part""")
def find_replace_ci(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return S.find_replace(S.find_replace(p, "RING", "Loop$1", ["p_name"]), "brand#2", "B2", ["p_brand"], whole=True)


@query("""SELECT count(*) FILTER (p_name LIKE '%ring%') + count(*) FILTER (p_type LIKE '%ring%') + count(*) FILTER (p_brand LIKE '%ring%') AS replaced FROM part""")
def find_replace_counts(spark, sf):
    return S.replace_counts(table(spark, sf, "part"), "ring", "x", match_case=True)


# ================================================================== reshape and projection
@query("""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) n FROM events) WHERE n = 1""")
def dedupe_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return S.dedupe(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT count(*) source_rows, count(DISTINCT (user_id, event_type)) AS kept, count(*) - count(DISTINCT (user_id, event_type)) AS dropped FROM events")
def dedupe_event_counts(spark, sf):
    return S.dedupe_counts(table(spark, sf, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("SELECT DISTINCT upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def extract_unique_segments(spark, sf):
    seg = F.when(F.col("c_mktsegment") == "MACHINERY", " ").otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment")))
    return S.extract_columns(table(spark, sf, "customer").select(seg.alias("c_mktsegment")), ["c_mktsegment"], "title", True)


@query("""SELECT count(*) AS source_rows, count(*) FILTER (c_mktsegment = 'MACHINERY') AS blank_dropped,
  count(*) FILTER (c_mktsegment <> 'MACHINERY') - count(DISTINCT c_mktsegment) FILTER (c_mktsegment <> 'MACHINERY') AS unique_dropped FROM customer""")
def extract_segment_counts(spark, sf):
    seg = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment"))
    return S.extract_counts(table(spark, sf, "customer").select(seg.alias("s")), ["s"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, '数量' AS measure, l_quantity AS amount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax END FROM lineitem""")
def unpivot_lineitem_measures(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("数量"), F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("l_tax")
    )
    return S.unpivot(li, ["l_orderkey", "l_linenumber", "l_partkey"], None, "measure", "amount")


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS p_name_1, split_part(p_name, ' ', 2) AS p_name_2 FROM part")
def split_part_name(spark, sf):
    return S.split_column(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", " ")


@query("""SELECT o_orderkey AS "订单号", cast(round(o_totalprice) AS double) AS "金额", strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS note FROM orders""")
def coerce_columns_by_kind(spark, sf):
    whole = F.round("o_totalprice").cast("long").cast("string")
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("订单号"), F.concat(F.lit("¥"), whole).alias("金额"), F.date_format("o_orderdate", "yyyy/M/d").alias("day"),
        F.concat(F.lit(" "), F.col("o_orderpriority")).alias("note"),
    )
    out = S.coerce_columns(o, {"金额": "amount", "day": "datetime", "note": "plain_text"})
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""SELECT c_name || '/' || n_name || '/' AS label, cast(c_custkey AS varchar) AS id, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def project_merge(spark, sf):
    c = J.lookup(table(spark, sf, "customer"), table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", ["n_name"])
    c = c.withColumn("empty", F.lit(None).cast("string"))
    return PR.project(c, [
        {"as": "label", "merge": ["c_name", "N_NAME", "empty"], "separator": "/"},
        {"as": "id", "from": 0, "coerce": "text"},
        {"as": "balance", "from": "c_acctbal", "coerce": "number"},
    ])


@query("SELECT 'r_regionkey' AS id, 'r_name' AS region UNION ALL SELECT cast(r_regionkey AS varchar), r_name FROM region")
def project_headerless(spark, sf):
    return PR.project(table(spark, sf, "region"), [{"as": "id", "from": "A"}, {"as": "region", "from": "B", "coerce": "text"}], headerless_input=True)


@query("""SELECT 0 AS idx, 'A' AS letter, avg(length(cast(p_partkey AS varchar)))::double AS mean_length, 1.0::double AS "numeric",
  avg(CASE WHEN p_partkey < 10000 THEN 1.0 ELSE 0.0 END)::double AS "rank" FROM part
UNION ALL SELECT 1, 'B', avg(length(p_name))::double, 0.0, 0.0 FROM part""")
def profile_part_columns(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return PR.profile_columns(p, sample=None).select("idx", "letter", "mean_length", "numeric", "rank")


@query("""SELECT 'o_orderkey' AS "column", count(*) AS filled, 1.0::double AS numeric_rate, 'amount' AS kind FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), 0.0, 'plain_text' FROM orders
UNION ALL SELECT 'o_totalprice', count(*), 1.0, 'amount' FROM orders
UNION ALL SELECT 'o_orderdate', count(*), 0.0, 'datetime' FROM orders
UNION ALL SELECT 'waybill', count(*), 1.0, 'id_text' FROM orders""")
def profile_kinds(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.col("o_custkey").alias("waybill"))
    return I.infer_kinds(o, sample=None).select("column", "filled", "numeric_rate", "kind")


@query("""SELECT conv_id, turn, role, max(CASE WHEN role <> 'assistant' THEN text END) OVER g AS master_text
FROM (SELECT *, count(*) FILTER (role <> 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WINDOW g AS (PARTITION BY conv_id, k)""")
def attach_master_rows(spark, sf):
    c = table(spark, sf, "conversations")
    return S.attach_master_rows(c, F.col("role") != "assistant", ["text"], ["turn"], ["conv_id"]).drop("text")


# ================================================================== filter, sort, limit, flag
@query("""SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 45 AND p_size <> 10 AND p_retailprice > 905.5 AND p_retailprice <= 1050
 AND p_type >= 'ECONOMY' AND p_partkey < 1500""")
def filter_all_ops(spark, sf):
    return L.filter_rows(table(spark, sf, "part"), [
        {"column": "p_size", "op": "between", "value": "5", "value2": "45"}, {"column": "P_SIZE", "op": "<>", "value": 10},
        {"column": "p_retailprice", "op": "greater than", "value": 905.5}, {"column": "p_retailprice", "op": "<=", "value": 1050},
        {"column": "p_type", "op": "gte", "value": "ECONOMY"}, {"column": "p_partkey", "op": "less_than", "value": 1500},
    ]).select("p_partkey")


@query("""SELECT p_partkey FROM part WHERE lower(p_name) LIKE 's%' AND lower(p_name) LIKE '%g' AND lower(p_name) NOT LIKE '%bolt%' AND lower(p_brand) LIKE '%and#%' AND p_type = 'ECONOMY'""")
def filter_text_ops(spark, sf):
    return L.filter_rows(table(spark, sf, "part"), [
        {"column": "p_name", "op": "begins with", "value": "S"}, {"column": "p_name", "op": "endswith", "value": "G"},
        {"column": "p_name", "op": "notcontains", "value": "BOLT"}, {"column": "p_brand", "op": "contains", "value": "AND#"},
        {"column": "p_type", "op": "equals", "value": "ECONOMY"}, {"column": "p_type", "op": "not blank"},
    ]).select("p_partkey")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def sort_suppliers(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return L.sort_rows(s, [{"column": "s_nationkey"}, {"column": "s_acctbal", "order": "descending"}, {"column": "s_suppkey"}])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def sample_head_orders(spark, sf):
    return L.sample_head(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 5, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM (SELECT *, rank() OVER (ORDER BY l_extendedprice DESC) r FROM lineitem) WHERE r <= 10")
def top_n_lines(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return L.top_n(li, "l_extendedprice", 10)


@query("""SELECT c_custkey, c_acctbal > 0 AS flag, (c_acctbal - lo) / (hi - lo) AS position FROM customer, (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer)""")
def flag_and_scale_balance(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return L.scale_min_max(L.flag_rule(c, "c_acctbal"), "c_acctbal").drop("c_acctbal")


# ================================================================== joins
@query("SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_nation(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return J.lookup(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey")


@query("""SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) n FROM orders) ON o_custkey = c_custkey AND n = 1""")
def lookup_first_order(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.lookup(table(spark, sf, "customer").select("c_custkey", "c_name"), o, "c_custkey", ["o_orderkey", "o_totalprice"], ["o_orderdate", "o_orderkey"])


SIZE_TIERS = [(5.0, 1.5, "S"), (15.0, 2.5, "M"), (30.0, 4.0, "L"), (45.0, 7.0, "XL")]


@query("""SELECT p_partkey, p_size, CASE WHEN p_size >= 45 THEN 7.0 WHEN p_size >= 30 THEN 4.0 WHEN p_size >= 15 THEN 2.5 WHEN p_size >= 5 THEN 1.5 END::double AS fee,
 CASE WHEN p_size >= 45 THEN 'XL' WHEN p_size >= 30 THEN 'L' WHEN p_size >= 15 THEN 'M' WHEN p_size >= 5 THEN 'S' END AS label, p_size >= 5 AS tier_found FROM part""")
def tier_price(spark, sf):
    tiers = spark.createDataFrame(SIZE_TIERS, "at double, fee double, label string")
    return J.tier_lookup(table(spark, sf, "part").select("p_partkey", "p_size"), tiers, "p_size", "at", ["fee", "label"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, price, tier_found FROM (
 SELECT l.*, t.price, t.price IS NOT NULL AS tier_found FROM lineitem l ASOF LEFT JOIN
  (SELECT p_type z, cast(p_size AS double) AS at, min(p_retailprice) AS price FROM part GROUP BY 1, 2) t
  ON t.z = (CASE l_returnflag WHEN 'A' THEN 'ECONOMY' WHEN 'R' THEN 'PROMO' ELSE 'none' END) AND l.l_quantity >= t.at)""")
def two_key_rate(spark, sf):
    rates = table(spark, sf, "part").groupBy(F.col("p_type").alias("zone"), F.col("p_size").alias("tier")).agg(F.min("p_retailprice").alias("price"))
    zone = F.when(F.col("l_returnflag") == "A", "ECONOMY").when(F.col("l_returnflag") == "R", "PROMO").otherwise("none")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", zone.alias("zone"))
    return J.two_key_rate(li, rates, "l_quantity", "zone", "tier", "price").drop("zone", "l_quantity")


# ================================================================== aggregation and pivot
@query("""SELECT lower(o_orderpriority) AS seg, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS "合计" FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1""")
def sum_by_priority(spark, sf):
    seg = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", " ").otherwise(F.concat(F.lower("o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "  ").otherwise("")))
    o = table(spark, sf, "orders").select(seg.alias("seg"), money("o_totalprice").alias("v"), "o_orderkey")
    out = A.sum_by(o, "seg", "v", order_by=["o_orderkey"])
    return out.select(C.trim_ws("seg").alias("seg"), F.col("合计").cast("double").alias("合计"))


@query("""SELECT o_orderpriority, cast(sum(CASE WHEN o_orderdate BETWEEN '1996-01-01' AND '1996-12-31' AND o_orderstatus = 'F' THEN cast(o_totalprice AS decimal(18,2)) END) AS double) AS total,
 count(*) FILTER (o_orderdate BETWEEN '1996-01-01' AND '1996-12-31' AND o_orderstatus = 'F') AS n FROM orders GROUP BY 1""")
def sum_if_and_count_if(spark, sf):
    o = table(spark, sf, "orders").withColumn("v", money("o_totalprice"))
    rules = [{"column": "o_orderdate", "op": "between", "value": "1996-01-01", "value2": "1996-12-31"}, {"column": "o_orderstatus", "op": "eq", "value": "F"}]
    total = A.sum_if(o, "v", rules, ["o_orderpriority"]).withColumn("total", F.col("total").cast("double"))
    return total.join(A.count_if(o, rules, ["o_orderpriority"]), "o_orderpriority")


@query("""SELECT l_returnflag, l_linestatus, cast(sum(cast(l_quantity AS decimal(18,2)) * cast(l_extendedprice AS decimal(18,2))) AS double) / cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS weighted FROM lineitem GROUP BY 1, 2""")
def weighted_price(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", money("l_quantity").alias("q"), money("l_extendedprice").alias("p"))
    exact = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("q") * F.col("p")).cast("double").alias("v"), F.sum("q").cast("double").alias("w"))
    return A.weighted_avg(exact.select("l_returnflag", "l_linestatus", "w", F.try_divide("v", "w").alias("p")), "w", "p", ["l_returnflag", "l_linestatus"]).withColumn("weighted", F.round("weighted", 4))


SQL["weighted_price"] = "SELECT l_returnflag, l_linestatus, round(weighted, 4) AS weighted FROM (" + SQL["weighted_price"] + ")"


@query("""SELECT l_returnflag, cast(sum(q) FILTER (l_linestatus = 'F') AS double) AS "F_sum_q", count(q) FILTER (l_linestatus = 'F') AS "F_count_q",
 cast(sum(q) FILTER (l_linestatus = 'O') AS double) AS "O_sum_q", count(q) FILTER (l_linestatus = 'O') AS "O_count_q"
FROM (SELECT *, cast(l_quantity AS decimal(18,2)) q FROM lineitem WHERE l_discount <= 0.08) GROUP BY 1""")
def pivot_flag_status(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("q", money("l_quantity"))
    out = A.pivot_table(li, ["l_returnflag"], ["l_linestatus"], [{"field": "q"}, {"field": "q", "aggregation": "计数"}], [{"column": "l_discount", "op": "lte", "value": 0.08}], ["F", "O"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("F_sum_q", "O_sum_q")})


@query("""SELECT l_returnflag, l_linestatus, max(l_extendedprice) AS max_l_extendedprice, min(l_tax) AS min_l_tax, count(l_tax) AS count_l_tax,
 grouping(l_returnflag) + grouping(l_linestatus) AS lvl FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def pivot_totals(spark, sf):
    out = A.pivot_table(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [],
        [{"field": "l_extendedprice", "aggregation": "max"}, {"field": "l_tax", "aggregation": "min"}, {"field": "l_tax", "aggregation": "count"}], totals=True,
    )
    return out.withColumnRenamed("__level", "lvl")


PIVOT_CUBE = [(f, s) for f in ("A", "N", "R", None) for s in ("F", "O", None)]


@query("SELECT l_shipmode_, l_tax_, " + ", ".join(
    f"""{a}(CASE WHEN {' AND '.join(filter(None, (f and f"l_returnflag = '{f}'", s and f"l_linestatus = '{s}'"))) or 'true'} THEN l_linenumber END) AS "{'_'.join((f or 'total', s or 'total')) if f or s else 'total'}_{a}_l_linenumber\""""
    for f, s in PIVOT_CUBE for a in ("max", "count")
) + """, cast(grouping(l_shipmode_) * 2 + grouping(l_tax_) AS INTEGER) AS rolled
 FROM (SELECT *, l_suppkey % 5 AS l_shipmode_, l_partkey % 3 AS l_tax_ FROM lineitem) GROUP BY CUBE (l_shipmode_, l_tax_)""")
def pivot_cube(spark, sf):
    """Two row and two column fields with all subtotals."""
    li = table(spark, sf, "lineitem").withColumns({"l_shipmode_": F.col("l_suppkey") % 5, "l_tax_": F.col("l_partkey") % 3})
    values = [{"field": "l_linenumber", "aggregation": "max"}, {"field": "l_linenumber", "aggregation": "count"}]
    pairs = [(f, s) for f in ("A", "N", "R") for s in ("F", "O")]
    return A.pivot_table(li, ["l_shipmode_", "l_tax_"], ["l_returnflag", "l_linestatus"], values, column_values=pairs, totals="all").withColumnRenamed("__rolled", "rolled")


@query("""SELECT count(*) AS n, min(l_extendedprice) AS min_value, round(quantile_cont(l_extendedprice, 0.01), 6) AS p01, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
 round(quantile_cont(l_extendedprice, 0.999), 6) AS p999, max(l_extendedprice) AS max_value FROM lineitem""")
def price_distribution_whole(spark, sf):
    """Quantiles of a whole table, without groups."""
    out = A.price_distribution(table(spark, sf, "lineitem"), [], "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p999": 0.999})
    return out.withColumns({c: F.round(c, 6) for c in ("p01", "p50", "p999")})


@query("""SELECT p_type, count(*) AS n, min(p_retailprice) AS min_value, round(quantile_cont(p_retailprice, 0.25), 6) AS p25, round(quantile_cont(p_retailprice, 0.5), 6) AS p50,
 round(quantile_cont(p_retailprice, 0.75), 6) AS p75, max(p_retailprice) AS max_value FROM part GROUP BY 1""")
def price_distribution(spark, sf):
    out = A.price_distribution(table(spark, sf, "part"), ["p_type"], "p_retailprice")
    return out.withColumns({c: F.round(c, 6) for c in ("p25", "p50", "p75")})


@query("""SELECT l_returnflag, band, n, n / cast(sum(n) OVER (PARTITION BY l_returnflag) AS double) AS share FROM (
 SELECT l_returnflag, CASE WHEN l_extendedprice >= 50000 THEN 2 WHEN l_extendedprice >= 20000 THEN 1 ELSE 0 END AS band, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def band_distribution(spark, sf):
    return A.band_distribution(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [20000, 50000])


@query("""WITH p AS (SELECT l_returnflag, l_suppkey, sum(cast(l_extendedprice AS decimal(18,2))) v FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY v DESC, l_suppkey) n FROM p)
SELECT l_returnflag, cast(sum(v) AS double) AS total_value, count(*) AS entities, cast(sum(v) FILTER (n <= 3) AS double) AS top_value,
 round(cast(sum(v) FILTER (n <= 3) AS double) / cast(sum(v) AS double), 9) AS top_share FROM r GROUP BY 1""")
def concentration(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("v", money("l_extendedprice"))
    out = A.concentration(li, ["l_returnflag"], "l_suppkey", "v", 3)
    return out.withColumns({"total_value": F.col("total_value").cast("double"), "top_value": F.col("top_value").cast("double"), "top_share": F.round("top_share", 9)})


@query("""SELECT o_custkey, o_orderkey, o_totalprice, position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) WHERE position <= 3""")
def top_k_per_group(spark, sf):
    return A.top_k_per_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 3, ["o_orderkey"])


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS organic_rank FROM events WHERE event_type <> 'view'")
def organic_rank(spark, sf):
    out = A.organic_rank(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view")
    return out.select("event_id", "user_id", "organic_rank")


# ================================================================== windows
@query("""SELECT p_partkey, prev AS previous_price, coalesce(p_retailprice < prev, false) AS inverted FROM (SELECT *, lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) prev FROM part)""")
def non_monotonic(spark, sf):
    out = W.flag_non_monotonic(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_brand"], ["p_size", "p_partkey"], "p_retailprice")
    return out.select("p_partkey", "previous_price", "inverted")


@query("""WITH m AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS mon, count(*) AS reviews, 4.5 + min(l_tax) AS stars,
  count(*) FILTER (l_returnflag = 'N' AND l_quantity > 45) AS sales, CASE WHEN max(l_discount) > 0.09 THEN 1 END AS rk FROM lineitem GROUP BY 1, 2),
 p AS (SELECT *, lag(reviews) OVER w AS pr, lag(stars) OVER w AS ps FROM m WINDOW w AS (PARTITION BY l_suppkey ORDER BY mon))
SELECT l_suppkey, mon, CASE WHEN sales = 0 AND rk IS NOT NULL THEN 'data_delay' WHEN reviews < pr * 0.5 AND abs(stars - ps) <= 0.015 THEN 'review_cleanup' ELSE 'normal' END AS anomaly FROM p""")
def snapshot_anomaly(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("mon")).agg(
        F.count(F.lit(1)).alias("reviews"), (4.5 + F.min("l_tax")).alias("stars"),
        F.count_if((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 45)).alias("sales"), F.when(F.max("l_discount") > 0.09, 1).alias("rk"),
    )
    return W.flag_snapshot_anomaly(m, ["l_suppkey"], ["mon"], "reviews", "stars", "sales", "rk", 0.5, 0.015).select("l_suppkey", "mon", "anomaly")


@query("""SELECT event_id, prev AS previous_fetch, coalesce(epoch_us(ts) - epoch_us(prev) < 86400000000, false) AS repeat_fetch FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) prev FROM events)""")
def repeat_fetch(spark, sf):
    out = W.flag_repeat_fetch(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 24, ["event_id"])
    return out.select("event_id", "previous_fetch", "repeat_fetch")


# ================================================================== finance and pricing
@query("""SELECT p_brand, CASE WHEN p_brand = 'Brand#2' THEN 0.5 ELSE 0.15 END::double AS referral_rate, 0.35::double AS cogs_rate, 0.02::double AS other_rate FROM (SELECT DISTINCT p_brand FROM part)""")
def profit_assumptions(spark, sf):
    p = table(spark, sf, "part")
    own = p.filter("p_brand = 'Brand#2'").select(F.concat(F.lit(" "), "p_brand").alias("p_brand"), F.lit(0.5).alias("referral_rate")).distinct()
    return P.profit_assumptions(p, "p_brand", own).select("p_brand", "referral_rate", "cogs_rate", "other_rate")


FX = {"USD": 7.2, "EUR": 7.8, "GBP": 9.0}


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN cast(cast(o_totalprice AS decimal(18,2)) * 7.2 AS double) WHEN 'O' THEN cast(cast(o_totalprice AS decimal(18,2)) * 7.8 AS double) END AS local,
 CASE WHEN o_orderstatus IN ('F', 'O') THEN 'user' ELSE 'missing' END AS fx_source FROM orders""")
def convert_currency(spark, sf):
    cur = F.when(F.col("o_orderstatus") == "F", "usd ").when(F.col("o_orderstatus") == "O", "EUR").otherwise("XXX")
    o = table(spark, sf, "orders").select("o_orderkey", money("o_totalprice").alias("a"), cur.alias("c"))
    return P.convert_currency(o, "a", "c", FX, "local").select("o_orderkey", F.col("local").cast("double").alias("local"), "fx_source")


SCENARIOS = {"base": {}, "worse": {"commission_rate": 0.2, "refund_rate": 0.15, "fulfilment_fee": 4.0}}


@query("""WITH s(scenario, cr, ff, rr) AS (VALUES ('base', 0.15::decimal(18,4), 3.22::decimal(18,4), 0.08::decimal(18,4)), ('worse', 0.2, 4.0, 0.15)),
b AS (SELECT s.*, l_orderkey, l_linenumber, l_partkey, l_returnflag, cast(l_extendedprice AS decimal(18,4)) rev, cast(cast(l_quantity AS decimal(18,4)) * 100 AS decimal(18,4)) cogs, cast(l_quantity AS decimal(18,4)) ads,
  CASE WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 25::decimal(18,4) ELSE 0 END ra FROM lineitem, s),
c AS (SELECT *, CASE WHEN ra > 0 THEN ra WHEN l_returnflag = 'R' THEN round(rr * (rev - cogs), 4) ELSE 0 END AS refund FROM b)
SELECT scenario, l_orderkey, l_linenumber, l_partkey, cast(refund AS double) AS refund,
 cast(rev - cogs - ads - round(rev * cr, 4) - round(ff * 1.035, 4) - 1.5 - round(rev * 0.025, 4) - refund AS double) AS net FROM c""")
def net_profit_scenarios(spark, sf):
    status = F.when(F.col("l_returnflag") == "R", "PartialRefund").otherwise("completed")
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast(P.MONEY).alias("rev"),
        (F.col("l_quantity").cast(P.MONEY) * 100).cast(P.MONEY).alias("cogs"), F.col("l_quantity").cast(P.MONEY).alias("ads"), status.alias("status"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40), 25).otherwise(0).cast(P.MONEY).alias("ra"),
    )
    out = P.net_profit(P.apply_assumption_overrides(li, SCENARIOS, ["net_profit"]), "rev", "cogs", "ads", "status", "ra")
    return out.select("scenario", "l_orderkey", "l_linenumber", "l_partkey", F.col("refund").cast("double").alias("refund"), F.col("net_profit").cast("double").alias("net"))


@query("""WITH a AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
  cast(count(*) FILTER (event_type = 'signup') AS double) AS cost, cast(sum(cast(value AS decimal(18,2))) FILTER (event_type = 'purchase') AS double) AS attributed, cast(sum(cast(value AS decimal(18,2))) AS double) AS sales FROM events GROUP BY 1),
 m AS (SELECT *, clicks / nullif(cast(impressions AS double), 0) AS ctr, cost / nullif(clicks, 0) AS cpc, cost / nullif(attributed, 0) AS acos, cost / nullif(sales, 0) AS tacos, attributed / nullif(cost, 0) AS roas FROM a)
SELECT user_id, round(ctr, 9) ctr, round(cpc, 9) cpc, round(acos, 9) acos, round(tacos, 9) tacos, round(roas, 9) roas, coalesce(ctr < 0.003, false) low_ctr,
 coalesce(tacos > 0.15, false) high_tacos, coalesce(roas < 2, false) low_roas FROM m""")
def ad_metrics(spark, sf):
    kind = lambda k: F.col("event_type") == k
    e = table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(kind("view")).alias("impressions"), F.count_if(kind("click")).alias("clicks"), F.count_if(kind("signup")).cast("double").alias("cost"),
        F.sum(F.when(kind("purchase"), money("value"))).cast("double").alias("attributed"), F.sum(money("value")).cast("double").alias("sales"),
    )
    out = P.ad_metrics(e, "impressions", "clicks", "cost", "attributed", "sales").drop("impressions", "clicks", "cost", "attributed", "sales")
    return out.withColumns({c: F.round(c, 9) for c in ("ctr", "cpc", "acos", "tacos", "roas")})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(1 - l_extendedprice / nullif(l_extendedprice / (1 - l_discount) * CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, 0), 9) AS rate FROM lineitem""")
def discount_rate(spark, sf):
    listed = F.col("l_extendedprice") / (1 - F.col("l_discount")) * F.when(F.col("l_returnflag") == "R", 0).otherwise(1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(P.discount_rate("l_extendedprice", listed), 9).alias("rate"))


RATE_SQL = """r AS (SELECT p_type z, cast(p_size AS double) AS at, min(p_retailprice) AS price FROM part GROUP BY 1, 2),
 b AS (SELECT p_partkey, p_type, p_size, ceil(greatest(cast(p_size AS double), (p_size * 20.0) * (p_size * 10.0) * 30.0 / 6000.0))::double AS bw, CASE WHEN p_brand = 'Brand#2' THEN 'Residential' ELSE 'commercial' END AS addr FROM part)"""


@query(f"""WITH {RATE_SQL}
SELECT p_partkey, bw AS billable_weight, price AS base_price, price IS NOT NULL AS tier_found,
 round(CASE WHEN bw > 20 THEN (CASE WHEN addr = 'Residential' THEN 6.0 ELSE 4.0 END) * 0.5 ELSE 0 END + CASE WHEN p_size >= 40 THEN 30.0 ELSE 0.0 END, 6)::double AS surcharges,
 round(price * 0.25, 6) AS fuel,
 round(price + price * 0.25 + CASE WHEN bw > 20 THEN (CASE WHEN addr = 'Residential' THEN 6.0 ELSE 4.0 END) * 0.5 ELSE 0 END + CASE WHEN p_size >= 40 THEN 30.0 ELSE 0.0 END, 6) AS total
FROM b ASOF LEFT JOIN r ON r.z = b.p_type AND b.bw >= r.at""")
def rate_shipments(spark, sf):
    p = table(spark, sf, "part")
    rates = p.groupBy(F.col("p_type").alias("zone"), F.col("p_size").alias("tier")).agg(F.min("p_retailprice").alias("price"))
    size = F.col("p_size")
    ship = p.select(
        "p_partkey", F.col("p_type").alias("zone"), "p_size", (size * 20.0).alias("len"), (size * 10.0).alias("wid"), F.lit(30.0).alias("hei"),
        F.when(F.col("p_brand") == "Brand#2", "Residential").otherwise("commercial").alias("addr"),
    )
    rules = [
        {"measure": "billable_weight", "op": "gt", "value": 20, "residential": 6.0, "commercial": 4.0, "probability": 0.5},
        {"measure": "p_size", "op": "gte", "value": 40, "amount": 30.0},
    ]
    out = RT.rate_shipments(ship, rates, "len", "wid", "hei", "p_size", "zone", RT.VOLUME_FACTORS["cm_kg"], 0.25, rules, "addr")
    return out.select("p_partkey", "billable_weight", "base_price", "tier_found", *[F.round(c, 6).alias(c) for c in ("surcharges", "fuel", "total")])


@query("""SELECT p_size AS tier, round(greatest(sum(price / n), 930.0), 6) AS weighted_price FROM (
 SELECT p_size, p_type, min(p_retailprice) AS price, count(*) OVER (PARTITION BY p_size) AS n FROM part GROUP BY 1, 2) GROUP BY 1""")
def zone_weighted_price(spark, sf):
    r = table(spark, sf, "part").groupBy(F.col("p_size").alias("tier"), "p_type").agg(F.min("p_retailprice").alias("price"))
    r = r.withColumn("share", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("tier")))
    return RT.zone_weighted_price(r, "tier", "price", "share", 930.0).withColumn("weighted_price", F.round("weighted_price", 6))


@query()
def finance_flow_counts(spark, sf):
    """Orders as sales, first shipments as spend: the closed loop's audit counts."""
    o, s = _ship_sides(spark, sf)
    orders = o.select(F.col("cust").alias("platform_sku"), F.col("day").alias("biz_date"), F.col("prio").alias("currency"), F.col("seq").alias("item_price"))
    ads = s.select(F.col("cust").alias("platform_sku"), F.col("day").alias("biz_date"), F.col("prio").alias("currency"), F.col("seq").alias("spend"))
    return finance_closed_loop(orders, ads, order_by=["item_price"], right_order_by=["spend"])["audit"].drop("timestamp")


@query("""WITH d AS (SELECT o_orderkey % 10 AS late, o_orderpriority = '5-LOW' AS differs FROM orders)
SELECT 'finance' AS "packId", 'finance-reconciliation' AS "runType", count(*) FILTER (late <= 7 AND NOT differs) AS matched, count(*) FILTER (late > 7) AS left_only,
  count(*) FILTER (late > 7) AS right_only, count(*) FILTER (late <= 7 AND differs) AS conflict, count(*) FILTER (late <= 7 AND (late > 0 OR differs)) AS review_pending FROM d""")
def finance_flow_spaced(spark, sf):
    """The flow by name, over a customer's orders 100 days apart and spendings 0 to 9 days later: every pair is known."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    day = F.date_add(F.lit("2000-01-01").cast("date"), 100 * rank)
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("platform_sku"), day.alias("biz_date"), F.col("o_orderpriority").alias("currency"), F.col("o_orderkey").alias("item_price"))
    other = F.when(F.col("currency") == "5-LOW", "0-NONE").otherwise(F.col("currency"))
    ads = o.select("platform_sku", F.date_add("biz_date", (F.col("item_price") % 10).cast("int")).alias("biz_date"), other.alias("currency"), F.col("item_price").alias("spend"))
    audit = run_flow("finance", o, ads, order_by=["item_price"], right_order_by=["spend"])["audit"]
    return audit.select("packId", "runType", "matched", "left_only", "right_only", "conflict", "review_pending")


# ================================================================== quality
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES))
def profile_tables(spark, sf):
    return Q.profile_tables(spark, {t: table(spark, sf, t) for t in TABLES}).select("table", "rows")


@query("""SELECT 'o_orderkey' AS "column", 0 AS empty, 0 AS label, count(*) AS input, 0 AS error FROM orders
UNION ALL SELECT 'amount', count(*) FILTER (a = ''), count(*) FILTER (a LIKE '$%' OR a LIKE ' 1,%'), count(*) FILTER (a LIKE '%.5'), count(*) FILTER (a = '#N/A') FROM (
 SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN '#N/A' ELSE """ + SQL_DIRTY + """ END AS a FROM orders)""")
def classify_cells(spark, sf):
    d = _dirty(spark, sf)
    return Q.classify_cells(d.withColumn("amount", F.when(F.col("amount") == "N/A", "#N/A").otherwise(F.col("amount"))))


@query("""SELECT o_orderkey, 'o_orderpriority' AS "column", '#ref!' AS value FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o_orderkey, 'o_orderstatus', ' #DIV/0!' FROM orders WHERE o_orderstatus = 'P'""")
def scan_error_tokens(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "#ref!").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_orderstatus") == "P", " #DIV/0!").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return Q.scan_error_tokens(o, ["o_orderkey"])


@query("""SELECT p_partkey, 0 AS rule, 'p_size' AS "column" FROM part WHERE p_size NOT BETWEEN 5 AND 40
UNION ALL SELECT p_partkey, 1, 'p_type' FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')
UNION ALL SELECT p_partkey, 2, 'p_name' FROM part WHERE length(p_name) > 10
UNION ALL SELECT p_partkey, 3, 'p_retailprice' FROM part WHERE p_retailprice <> floor(p_retailprice) OR p_retailprice < 950
UNION ALL SELECT p_partkey, 4, 'p_brand' FROM part WHERE NOT (p_brand LIKE 'Brand#1%' OR p_size < 30)""")
def validate_rules(spark, sf):
    return Q.validate(table(spark, sf, "part"), [
        {"column": "p_size", "type": "decimal", "formula1": 5, "formula2": "40"},
        {"column": "p_type", "type": "drop down", "source": "ECONOMY, PROMO"},
        {"column": "p_name", "type": "text_length", "operator": "less than or equal", "formula1": 10},
        {"column": "p_retailprice", "type": "whole", "operator": "gte", "formula1": 950},
        {"column": "p_brand", "type": "custom", "formula": "p_brand like 'Brand#1%' or p_size < 30"},
    ], ["p_partkey"]).select("p_partkey", "rule", "column")


@query("""SELECT 'amount' AS "column", count(*) AS rows, count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS missing FROM orders
UNION ALL SELECT 'o_orderkey', count(*), 0 FROM orders""")
def required_columns(spark, sf):
    return Q.required_columns(_dirty(spark, sf), ["o_orderkey", "amount"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def primary_key_check(spark, sf):
    return Q.primary_key_check(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ================================================================== sources
RAW_FEED = """SELECT cast(o_orderkey AS varchar) AS order_id, cast(o_orderdate AS date) AS order_date, 'sku-' || o_custkey AS platform_sku, cast(o_custkey AS double) AS quantity,
 CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE round(o_totalprice) END AS item_price, 'USD' AS currency, o_orderstatus = 'F' AS is_refund, cast(o_orderdate AS date) AS biz_date,
 cast(NULL AS varchar) AS asin FROM orders"""
FEED_OUT = ["order_id", "order_date", "platform_sku", "quantity", "item_price", "currency", "is_refund", "biz_date", "asin"]


def _raw_orders(spark, sf):
    price = F.when(F.col("o_orderpriority") == "1-URGENT", "N/A").otherwise(F.concat(F.lit("$"), F.round("o_totalprice").cast("long").cast("string")))
    day = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy/M/d")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd 00:00:00 'UTC'"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("订单号"), day.alias("成交日"), F.concat(F.lit(" SKU-"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("Seller SKU"),
        F.col("o_custkey").cast("string").alias("数量"), price.alias("Item Price"), F.lit("USD").alias("币种"), F.when(F.col("o_orderstatus") == "F", "是").otherwise("false").alias("退款"),
        F.col("o_orderpriority").alias("ignored"), "o_orderstatus",
    )


@query(RAW_FEED)
def feed_from_raw(spark, sf):
    raw = _raw_orders(spark, sf).drop("o_orderstatus")
    return FD.conform(FD.canonicalize_feed(FD.map_header_aliases(raw, "orders"), "orders"), "orders").select(*FEED_OUT)


@query(RAW_FEED)
def load_feed_mixed_charsets(spark, sf):
    """Written as a GBK file set and a UTF-8 file set, read back as one feed."""
    raw = _raw_orders(spark, sf)
    path = scratch_path(spark, "feed")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for charset, part in (("GBK", raw.filter("o_orderstatus = 'F'")), ("UTF-8", raw.filter("o_orderstatus <> 'F'"))):
        part.drop("o_orderstatus").write.option("header", True).option("encoding", charset).csv(f"{path}/{charset}")
    return FD.load_feed(spark, [f"{path}/GBK", f"{path}/UTF-8"], "orders").select(*FEED_OUT)


@query("SELECT cast(doc_id AS varchar) AS doc_id, md5(coalesce(replace(text, chr(13) || chr(10), chr(10)), '')) AS digest, lang FROM documents")
def quoted_documents(spark, sf):
    """Whole texts written as CSV, with their line breaks inside of quotes, and read back split by split."""
    path = scratch_path(spark, "quoted")
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    d.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = quoted.read_quoted(spark, [r["f"] for r in spark.read.text(path).select(F.input_file_name().alias("f")).distinct().collect()], "UTF-8")
    return back.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "lang")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' OR o_orderstatus = 'F'")
def drop_blank_rows(spark, sf):
    blank = (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") != "F")
    o = table(spark, sf, "orders").select("o_orderkey", F.when(blank, "　").otherwise("x").alias("a"), F.when(blank, None).otherwise("y").alias("b"))
    return S.drop_blank_rows(o, ["a", "b"]).select("o_orderkey")


@query("SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS p_k FROM events")
def json_props(spark, sf):
    return JT.parse_json_column(table(spark, sf, "events").select("event_id", "props"), "props", "k bigint", "p_")


@query("""SELECT doc_id AS source_id, 1 AS row_idx, 'lang' AS col, lang AS value FROM documents UNION ALL SELECT doc_id, 1, 'n', cast(n_chars AS varchar) FROM documents
UNION ALL SELECT doc_id, 2, 'lang', source || '; x' FROM documents UNION ALL SELECT doc_id, 2, 'n', cast(doc_id AS varchar) || ' / true' FROM documents""")
def json_payload_tables(spark, sf):
    rec = lambda lang, n: F.concat(F.lit('{"lang":'), lang, F.lit(',"token":"t","n":'), n, F.lit("}"))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    d = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit('{"ok":true,"data":{"small":[{"a":1},{"a":2}],"records":['), rec(q(F.col("lang")), F.col("n_chars").cast("string")), F.lit(","),
            rec(F.concat(F.lit("["), q(F.col("source")), F.lit(',null,"x"]')), F.concat(F.lit('{"i":'), F.col("doc_id").cast("string"), F.lit(',"pwd":"s","b":true}'))), F.lit("]}}"),
        ).alias("payload"),
    )
    return JT.grid_to_long(JT.json_payload_to_table(d, "doc_id", "payload"))


@query("SELECT doc_id, lang || '; ' || source AS joined FROM documents")
def flatten_json_list(spark, sf):
    return table(spark, sf, "documents").select("doc_id", JT.flatten_list(F.array("lang", F.lit(""), F.lit(None).cast("string"), "source")).alias("joined"))


@query("""SELECT page_id AS source_id, 0 AS table_idx, 0 AS row_idx, 'id|url' AS cells FROM pages UNION ALL SELECT page_id, 0, 1, cast(page_id AS varchar) || '|' || url FROM pages
UNION ALL SELECT page_id, 1, 0, 'in ner' FROM pages""")
def html_tables(spark, sf):
    shown = F.replace("url", F.lit("&"), F.lit("&amp;"))
    wrapped = F.concat(
        F.lit("<table><tr><th>id</th><th>url</th></tr><tr><td> </td></tr><tr><td>"), F.col("page_id").cast("string"),
        F.lit("<script>var t='<table>';</script></td><td>"), shown, F.lit("<table><tr><td>in\n ner</td></tr></table></td></tr></table>"), F.col("html"),
    )
    p = table(spark, sf, "pages").select("page_id", wrapped.alias("html"))
    return HT.html_tables(p).withColumn("cells", F.array_join("cells", "|"))


@query("""SELECT page_id AS source_id, v.t AS table_idx, v.r AS row_idx, CASE WHEN v.h THEN 'id|url' ELSE cast(page_id AS varchar) || '|' || url END AS cells
FROM pages, (VALUES (0, 0, true), (1, 0, false), (2, 0, true), (2, 1, false)) v(t, r, h)""")
def html_component_grids(spark, sf):
    """A grid whose header and body are tables of their own: both, and the whole grid after them."""
    grid = F.concat(
        F.lit('<div class="el-table big"><table class="el-table__header"><thead><tr><th>id</th><th> url</th></tr></thead></table><table><tr class="el-table__row"><td>'),
        F.col("page_id").cast("string"), F.lit("<td>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</table></div>"), F.col("html"),
    )
    return HT.html_tables(table(spark, sf, "pages").select("page_id", grid.alias("html"))).withColumn("cells", F.array_join("cells", "|"))


@query()
def html_text(spark, sf):
    out = HT.html_text(table(spark, sf, "pages"))
    return out.select("page_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query()
def app_shell_pages(spark, sf):
    return HT.flag_app_shell(table(spark, sf, "pages")).select("page_id", "text_chars", "tables", "app_shell")


@query("""SELECT page_id, 'Page ' || page_id || chr(10) || url || chr(10) || '<b> & end' AS text FROM pages""")
def html_text_wrapped(spark, sf):
    """Known markup around the address of every page."""
    shown = F.replace("url", F.lit("&"), F.lit("&amp;"))
    html = F.concat(
        F.lit("<html><head><style>p{color:red}</style><script>var p='<p>no</p>';</script></head><body><!-- left <p>out</p> --><h1>Page "), F.col("page_id").cast("string"),
        F.lit("</h1>\n<div>  "), shown, F.lit(" </div><p>&lt;b&gt; &amp; end</p><p> </p></body></html>"),
    )
    return HT.html_text(table(spark, sf, "pages").select("page_id", html.alias("html"))).select("page_id", "text")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 1 ELSE 0 END AS text_chars, CASE WHEN page_id % 4 = 2 THEN 1 ELSE 0 END AS tables,
 page_id % 4 IN (0, 3) AS app_shell FROM pages""")
def app_shell_wrapped(spark, sf):
    """Short pages with and without scripts, a page with a table and an empty one."""
    scripts = "<script>a()</script><SCRIPT src='b'></SCRIPT>"
    kind = F.col("page_id") % 4
    html = F.when(kind == 0, scripts + "<p>short</p>").when(kind == 1, "<p>short</p>").when(kind == 2, scripts + "<table><tr><td>x</td></tr></table>").otherwise("<div id='root'> </div>")
    return HT.flag_app_shell(table(spark, sf, "pages").select("page_id", html.alias("html"))).select("page_id", "text_chars", "tables", "app_shell")


def _order_grids(spark, sf):
    """Every order as a small grid of its customer: a header and one to three rows, 3 or 4 wide."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    st, order, cust = F.col("o_orderstatus"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")

    def line(i, cells, more, keep):
        wide = F.concat(F.array(*cells), F.when(urgent, F.array(F.lit(more))).otherwise(F.array().cast("array<string>"))) if more else F.array(*cells)
        return F.when(keep, F.struct(F.lit(i).alias("row_idx"), wide.alias("cells")))

    rows = F.array(
        line(0, [F.lit("flag"), F.lit(" status"), F.lit("part")], "x", F.lit(True)),
        line(1, [st, F.col("o_orderpriority"), order], "1", F.lit(True)),
        line(2, [F.col("o_orderpriority"), F.lit(""), cust], "2", st != "P"),
        line(3, [F.lit("z")], None, st == "F"),
    )
    grid = table(spark, sf, "orders").withColumn("g", F.explode(F.array_compact(rows)))
    return grid.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("table_idx"), "g.row_idx", "g.cells")


SQL_GRIDS = """g AS (SELECT o_custkey AS source_id, o_orderkey AS table_idx, v.i AS row_idx, o_orderpriority = '1-URGENT' AS urgent, o_orderstatus AS st,
  CASE v.i WHEN 0 THEN 'flag| status|part' WHEN 1 THEN o_orderstatus || '|' || o_orderpriority || '|' || o_orderkey WHEN 2 THEN o_orderpriority || '||' || o_custkey ELSE 'z' END
  || CASE WHEN o_orderpriority <> '1-URGENT' OR v.i = 3 THEN '' WHEN v.i = 0 THEN '|x' ELSE '|' || v.i END AS cells
 FROM orders, (VALUES (0), (1), (2), (3)) v(i) WHERE v.i < 2 OR (v.i = 2 AND o_orderstatus <> 'P') OR (v.i = 3 AND o_orderstatus = 'F'))"""


@query(f"""WITH {SQL_GRIDS} SELECT source_id, table_idx, count(*) AS rows, CASE WHEN bool_or(urgent) THEN 4 ELSE 3 END AS cols,
 CASE WHEN bool_or(urgent) THEN 'flag; status;part;x' ELSE 'flag; status;part' END AS preview, true AS usable, bool_or(urgent) AND count(*) >= 3 AS capture FROM g GROUP BY 1, 2""")
def grid_summary(spark, sf):
    out = G.grid_summary(_order_grids(spark, sf))
    return out.withColumn("preview", F.array_join("preview", ";"))


@query(f"""WITH {SQL_GRIDS}, c AS (SELECT source_id, table_idx, count(*) * CASE WHEN bool_or(urgent) THEN 4 ELSE 3 END AS area FROM g GROUP BY 1, 2),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY area DESC, table_idx) r FROM c) WHERE r = 1)
SELECT g.source_id, g.table_idx, g.row_idx, g.cells FROM g JOIN b ON g.source_id = b.source_id AND g.table_idx = b.table_idx""")
def largest_grid(spark, sf):
    return G.largest_grid(_order_grids(spark, sf)).withColumn("cells", F.array_join("cells", "|"))


@query(f"WITH {SQL_GRIDS} SELECT source_id, table_idx, row_idx, substr(cells, strpos(cells, '|') + 1) AS cells FROM g WHERE row_idx BETWEEN 1 AND 2")
def slice_grid(spark, sf):
    return G.slice_grid(_order_grids(spark, sf), 3, 2, "B", 9).withColumn("cells", F.array_join("cells", "|"))


@query(f"""WITH {SQL_GRIDS}, f AS (SELECT source_id, min(table_idx) AS first, bool_and(urgent) OR NOT bool_or(urgent) AS same FROM g GROUP BY 1)
SELECT g.source_id, g.table_idx, g.row_idx, g.cells FROM g JOIN f ON g.source_id = f.source_id WHERE row_idx > 0 OR table_idx = first OR NOT same""")
def stack_grids(spark, sf):
    return G.stack_grids(_order_grids(spark, sf)).withColumn("cells", F.array_join("cells", "|"))


@query(f"WITH {SQL_GRIDS} SELECT source_id, table_idx, row_idx, cells FROM g WHERE row_idx > 0 OR urgent")
def append_without_header(spark, sf):
    return G.append_rows(["flag", "status", "part"], _order_grids(spark, sf)).withColumn("cells", F.array_join("cells", "|"))


@query("SELECT o_custkey AS source_id, o_orderkey AS table_idx, true AS has_header FROM orders")
def header_rows(spark, sf):
    return G.flag_header_rows(_order_grids(spark, sf))


@query("""SELECT p_partkey AS source_id, 0 AS table_idx, v.r AS row_idx, CASE v.r WHEN 0 THEN p_name || '|' || p_brand ELSE p_type || '|' || p_size END AS cells FROM part, (VALUES (0), (1)) v(r)""")
def positioned_boxes(spark, sf):
    box = lambda x, y, w, h, t: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"), t.alias("t"))
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"),
        F.array(
            box(200.0, 12.0, 80.0, 20.0, F.col("p_brand")), box(10.0, 10.0, 80.0, 20.0, F.col("p_name")), box(12.0, 50.0, 60.0, 20.0, F.col("p_type")),
            box(201.0, 53.0, 60.0, 20.0, F.col("p_size").cast("string")), box(0.0, 0.0, 400.0, 100.0, F.lit("wrapper of the whole page")),
        ).alias("boxes"),
    )
    return G.cells_to_grid(p).withColumn("cells", F.array_join("cells", "|"))


# Rows of a page slant by 0 to 9 points a box, so some run into the next one: the mean of a row decides, box by box from the top.
@query("""WITH RECURSIVE boxes AS (SELECT p_partkey AS page, r, c, 26 * r + c * (p_size % 10) AS y, 100 * c + r * (p_partkey % 5) AS x,
    repeat('x', cast((p_partkey + 3 * r + c) % 4 + 1 AS integer)) || r || c AS t FROM part, (SELECT unnest(range(4)) AS r), (SELECT unnest(range(3)) AS c)),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x) AS k FROM boxes),
 walk AS (SELECT page, k, 0 AS row_idx, cast(y AS double) AS total, 1 AS n FROM ordered WHERE k = 1
   UNION ALL SELECT o.page, o.k, CASE WHEN abs(o.y - total / n) <= 11 THEN row_idx ELSE row_idx + 1 END, CASE WHEN abs(o.y - total / n) <= 11 THEN total + o.y ELSE o.y END,
     CASE WHEN abs(o.y - total / n) <= 11 THEN n + 1 ELSE 1 END FROM walk JOIN ordered o ON o.page = walk.page AND o.k = walk.k + 1),
 cells AS (SELECT page, row_idx, c, first(t ORDER BY length(t) DESC, x, k) AS t FROM walk JOIN ordered USING (page, k) GROUP BY ALL)
SELECT page AS source_id, 0 AS table_idx, row_idx, coalesce(max(t) FILTER (c = 0), '') || '|' || coalesce(max(t) FILTER (c = 1), '') || '|' || coalesce(max(t) FILTER (c = 2), '') AS cells
FROM cells GROUP BY page, row_idx""")
def positioned_boxes_slanted(spark, sf):
    at = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).withColumns({"r": F.floor(F.col("i") / 3), "c": F.col("i") % 3})
    text = F.concat(F.repeat(F.lit("x"), ((F.col("p_partkey") + 3 * F.col("r") + F.col("c")) % 4 + 1).cast("int")), F.col("r").cast("string"), F.col("c").cast("string"))
    box = F.struct(
        (100 * F.col("c") + F.col("r") * (F.col("p_partkey") % 5)).cast("double").alias("x"), (26 * F.col("r") + F.col("c") * (F.col("p_size") % 10)).cast("double").alias("y"),
        F.lit(60.0).alias("w"), F.lit(20.0).alias("h"), text.alias("t"),
    )
    pages = at.groupBy(F.col("p_partkey").alias("page_id")).agg(F.collect_list(box).alias("boxes"))
    return G.cells_to_grid(pages).withColumn("cells", F.array_join("cells", "|"))


def _payloads(spark, sf):
    rows = F.transform(F.split("text", " "), lambda w: F.array(w, F.lit(None).cast("string")))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("job_id"), F.concat(F.lit("https://www."), "source", F.lit(".example.com/list?x=1")).alias("url"),
        F.when(F.col("lang") == "fr", F.array().cast("array<array<string>>")).otherwise(rows).alias("rows"),
    )


@query("""SELECT doc_id AS job_id, source || '.example.com' AS host, u.i - 1 AS row_idx, u.w AS word FROM (
 SELECT doc_id, source, unnest(range(1, len(w) + 1)) AS i, w FROM (SELECT doc_id, source, string_split(text, ' ') AS w FROM documents WHERE lang <> 'fr')) x, LATERAL (SELECT x.i AS i, x.w[x.i] AS w) u""")
def ingest_payload_rows(spark, sf):
    out = N.ingest_rows(_payloads(spark, sf))
    return out.select("job_id", "host", "row_idx", F.get("cells", F.lit(0)).alias("word"))


@query("""SELECT doc_id AS job_id, CASE WHEN lang = 'fr' THEN 'no_table' ELSE 'ok' END AS status, '取数_' || source || '.example.com' AS sheet_name,
 CASE WHEN lang = 'fr' THEN 0 ELSE len(string_split(text, ' ')) END AS row_count, CASE WHEN lang = 'fr' THEN 0 ELSE len(string_split(text, ' ')) END AS source_rows,
 false AS truncated, CASE WHEN lang = 'fr' THEN 0 ELSE 2 END AS col_count FROM documents""")
def ingest_payload_summary(spark, sf):
    return N.summarize_payloads(_payloads(spark, sf)).drop("url", "sample_head")


SQL_HOST = r"replace(regexp_extract(url, '^https?://([^/?#]+)', 1), 'www.', '')"


@query(f"SELECT page_id, {SQL_HOST} AS host_key, '取数_' || {SQL_HOST} AS sheet FROM pages")
def host_keys(spark, sf):
    shouted = F.regexp_replace("url", "^(https?://)", "$1www.")
    return table(spark, sf, "pages").select("page_id", U.host_key(shouted).alias("host_key"), U.sheet_name_from_url("url").alias("sheet"))


@query("""SELECT page_id, true AS public, NOT (n BETWEEN 0 AND 16777215 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183
 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3221225472 AND 3221225727 OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 3323068416 AND 3323199487
 OR n BETWEEN 3325256704 AND 3325256959 OR n BETWEEN 3405803776 AND 3405804031 OR n BETWEEN 3758096384 AND 4294967295) AS number_form, page_id > 255 OR page_id NOT IN (10, 127, 0, 172) AND page_id < 224 AS dotted,
 false AS user_info, false AS shouted_user_info, true AS shouted, false AS suffix, false AS scheme FROM (SELECT page_id, page_id * 17179869 AS n FROM pages)""")
def url_safety(spark, sf):
    i = F.col("page_id")
    return table(spark, sf, "pages").select(
        "page_id", U.url_is_safe("url").alias("public"),
        U.url_is_safe(F.concat(F.lit("http://"), (i * 17179869).cast("string"), F.lit("/x"))).alias("number_form"),
        U.url_is_safe(F.concat(F.lit("http://"), i.cast("string"), F.lit(".20.30.40:8080"))).alias("dotted"),
        U.url_is_safe(F.regexp_replace("url", "://", "://me:pw@")).alias("user_info"),
        U.url_is_safe(F.upper(F.regexp_replace("url", "://", "://me:pw@"))).alias("shouted_user_info"),
        U.url_is_safe(F.upper("url")).alias("shouted"),
        U.url_is_safe(F.concat(F.lit("https://a"), i.cast("string"), F.lit(".lan/x"))).alias("suffix"),
        U.url_is_safe(F.regexp_replace("url", "^https?", "file")).alias("scheme"),
    )


@query(f"""WITH {SQL_LEDGERS}, c AS (SELECT count(*) FILTER (status = 'matched') m, count(*) FILTER (status = 'left_only') l, count(*) FILTER (status = 'right_only') r, count(*) FILTER (status = 'conflict') x, count(*) t FROM result)
SELECT 'finance' AS "packId", '1' AS "packVersion", 'check' AS "runType", m AS matched, l AS left_only, r AS right_only, x AS conflict, x AS review_pending, 'h1' AS "sourceHash_orders", '' AS "sourceHash_ads",
 'n；matched=' || m || '/' || t || '；review_pending=' || x AS note FROM c""")
def audit_row(spark, sf):
    return K.audit_row(reconcile_counts(_ledger_result(spark, sf)), "finance", "1", "check", "h1", "", "n").drop("timestamp")


@query("""SELECT * FROM (VALUES ('c_custkey', 0, 'bigint', 0, 'string', 'retyped'), ('c_name', 1, 'string', 1, 'string', 'same'), ('c_nationkey', 2, 'int', NULL, NULL, 'removed'), ('c_acctbal', 3, 'double', 2, 'double', 'moved'),
 ('c_mktsegment', 4, 'string', 3, 'string', 'moved'), ('x', NULL, NULL, 4, 'int', 'added')) v("column", old_idx, old_type, new_idx, new_type, change), (SELECT count(*) AS rows FROM customer)""")
def schema_drift(spark, sf):
    c = table(spark, sf, "customer")
    new = c.withColumn("c_custkey", F.col("c_custkey").cast("string")).drop("c_nationkey").withColumn("x", F.lit(1))
    old = K.schema_snapshot(c, "customer")
    out = K.schema_drift(old, K.schema_snapshot(new, "customer"))
    return out.withColumn("rows", old.agg(F.max("rows")).scalar())


# ================================================================== text
SQL_SQUEEZED = f"trim(regexp_replace(lower(text), '{SQL_WS}+', ' ', 'g'), ' ')"


@query(f"""SELECT doc_id, len(list_distinct(list_concat(list_transform(range(1, greatest(len(c), 1)), lambda i: c[i] || c[i + 1]),
  list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2])))) AS grams FROM (SELECT doc_id, regexp_split_to_array({SQL_SQUEEZED}, '') AS c FROM documents)""")
def char_ngrams(spark, sf):
    return scale.spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.size(X.char_ngrams("text")).cast("long").alias("grams"))


@query(f"""SELECT conv_id, turn, round(cast({' + '.join(f"(CASE WHEN contains({SQL_SQUEEZED}, '{a}') THEN 1 ELSE 0 END)" for a in ('th', 'ha', 'at', 't ', ' i', 'is', 'tha', 'hat', 'at ', 't i', ' is'))} AS double) / 11, 9) AS overlap FROM conversations""")
def lexical_overlap(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(X.lexical_overlap(F.lit("That  IS"), "text"), 9).alias("overlap"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
 c AS (SELECT label, i, round(avg(v), 6) AS m FROM e GROUP BY 1, 2)
SELECT vec_id, round(sum(v * m), 5) AS similarity FROM e JOIN c USING (label, i) GROUP BY 1""")
def cosine_to_label_centre(spark, sf):
    e = table(spark, sf, "embeddings")
    cells = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("m"))
    # Dimensions are fixed, so one centre per label is a short list.
    centre = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    centre = centre.select("label", F.transform("c", lambda x: x["m"]).alias("centre"))
    return scale.join_unique(e, centre, ["label"]).select("vec_id", F.round(X.cosine("embedding", "centre"), 5).alias("similarity"))


# No document holds a blank line, so each is one paragraph.
@query(r"""WITH b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, i AS chunk_index, length(substr(t, i * 780 + 1, 900)) AS chars, md5(substr(t, i * 780 + 1, 900)) AS digest
FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) <= 900 THEN 1 ELSE cast(ceil(length(t) / 780.0) AS bigint) END)) AS i FROM b WHERE t <> '')""")
def chunk_documents(spark, sf):
    out = T.chunk_text(table(spark, sf, "documents"))
    return out.select("doc_id", "chunk_index", F.length("text").alias("chars"), F.md5("text").alias("digest"))


# One to nine paragraphs of 32 to 1,280 characters: short ones are packed up to 900, longer ones cut every 780.
@query("""WITH RECURSIVE paras AS (SELECT doc_id, i, repeat(md5(text), cast(1 + (doc_id + 5 * i) % 40 AS integer)) AS p FROM documents, (SELECT unnest(range(9)) AS i) WHERE i <= doc_id % 9 AND text IS NOT NULL),
 walk AS (SELECT doc_id, -1::BIGINT AS i, 0::BIGINT AS spot, 0::BIGINT AS upcoming, 0::BIGINT AS filled FROM (SELECT DISTINCT doc_id FROM paras)
   UNION ALL SELECT p.doc_id, p.i, CASE WHEN fits THEN spot ELSE upcoming END, CASE WHEN fits THEN upcoming WHEN n > 900 THEN upcoming + cast(ceil(n / 780.0) AS BIGINT) ELSE upcoming + 1 END,
     CASE WHEN n > 900 THEN 0 WHEN fits THEN filled + 2 + n ELSE n END
   FROM (SELECT q.doc_id, q.i, length(q.p) AS n, w.spot, w.upcoming, w.filled, w.filled > 0 AND w.filled + 2 + length(q.p) <= 900 AS fits FROM walk w JOIN paras q ON q.doc_id = w.doc_id AND q.i = w.i + 1) p),
 chunks AS (SELECT doc_id, spot AS chunk_index, string_agg(p, chr(10) || chr(10) ORDER BY i) AS t FROM walk JOIN paras USING (doc_id, i) WHERE length(p) <= 900 GROUP BY ALL
   UNION ALL SELECT doc_id, spot + j, substr(p, cast(j * 780 + 1 AS integer), 900) FROM (SELECT doc_id, spot, p, unnest(range(cast(ceil(length(p) / 780.0) AS BIGINT))) AS j FROM walk JOIN paras USING (doc_id, i) WHERE length(p) > 900))
SELECT doc_id, cast(chunk_index AS INTEGER) AS chunk_index, length(t) AS chars, md5(t) AS digest FROM chunks""")
def chunk_paragraphs(spark, sf):
    para = lambda i: F.repeat(F.md5("text"), (1 + (F.col("doc_id") + 5 * i) % 40).cast("int"))
    texts = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 9).cast("int")), para), " \n \t\n")
    out = T.chunk_text(table(spark, sf, "documents").filter("text is not null").select("doc_id", texts.alias("text")))
    return out.select("doc_id", "chunk_index", F.length("text").alias("chars"), F.md5("text").alias("digest"))


# Slots are CRC-32 numbers, made byte by byte from a table of 256 entries; documents are cut as in chunk_documents.
SQL_SLOTS = """crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS entries FROM (SELECT unnest(range(256)) AS i)),
 letters AS (SELECT side, a, b, string_split(t, '') AS c FROM texts),
 grams AS (SELECT side, a, b, gram, count(*) AS n FROM (SELECT side, a, b, unnest(list_concat(list_transform(range(1, greatest(len(c), 1)), lambda i: c[i] || c[i + 1]),
   list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS gram FROM letters) GROUP BY ALL),
 slots AS (SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(hex(gram)) // 2), lambda i: cast('0x' || substr(hex(gram), cast(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
   lambda a, b: xor(entries[cast(xor(a, b) & 255 AS INTEGER) + 1], a >> 8)), 4294967295) % 384 AS slot FROM (SELECT DISTINCT gram FROM grams), crc),
 cells AS (SELECT side, a, b, slot, ln(1 + sum(n)) AS x FROM grams JOIN slots USING (gram) GROUP BY ALL)"""


@query(f"""WITH texts AS (SELECT 'c' AS side, doc_id AS a, 0 AS b, coalesce({SQL_SQUEEZED}, '') AS t FROM documents), {SQL_SLOTS},
 sized AS (SELECT a, sum(x * x) AS square, max(x) AS peak FROM cells GROUP BY a)
SELECT doc_id, 384 AS dims, CASE WHEN a IS NULL THEN 0.0 ELSE 1.0 END AS norm, round(coalesce(peak / sqrt(square), 0), 6) AS peak FROM documents LEFT JOIN sized ON a = doc_id""")
def hash_embed_documents(spark, sf):
    d = scale.spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.hash_embed("text").alias("v"))
    return d.select("doc_id", F.size("v").alias("dims"), F.round(X.cosine("v", "v"), 6).alias("norm"), F.round(F.array_max("v"), 6).alias("peak"))


@query(f"""WITH texts AS (SELECT 'c' AS side, doc_id AS a, 0 AS b, coalesce({SQL_SQUEEZED}, '') AS t FROM documents), {SQL_SLOTS},
 sized AS (SELECT a, sqrt(sum(x * x)) AS size FROM cells GROUP BY a)
SELECT cast(slot AS INTEGER) AS slot, count(*) AS documents, round(sum(x / size), 6) AS total, round(max(x / size), 6) AS peak FROM cells JOIN sized USING (a) GROUP BY slot""")
def hash_embed_slots(spark, sf):
    """Every slot of a vector that is not zero."""
    d = scale.spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(X.hash_embed("text")).alias("slot", "x"))
    return d.filter("x > 0").groupBy("slot").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("x"), 6).alias("total"), F.round(F.max("x"), 6).alias("peak"))


SQL_CHUNKS = f"""chunks AS (SELECT doc_id, i AS chunk_index, substr(t, i * 780 + 1, 900) AS text FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) <= 900 THEN 1 ELSE cast(ceil(length(t) / 780.0) AS bigint) END)) AS i
   FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) WHERE t <> '')),
 texts AS (SELECT 'c' AS side, doc_id AS a, chunk_index AS b, {SQL_SQUEEZED} AS t FROM chunks UNION ALL SELECT 'q', item_id, 0, {SQL_SQUEEZED} FROM benchmark WHERE {SQL_SQUEEZED} <> '')"""
SQL_SEARCH = f"""WITH {SQL_CHUNKS}, {SQL_SLOTS},
 vectors AS (SELECT side, a, b, list(coalesce(x, 0) ORDER BY s) AS v, greatest(sqrt(sum(x * x)), 1e-300) AS r
   FROM (SELECT side, a, b, s, x FROM texts CROSS JOIN (SELECT unnest(range(384)) AS s) LEFT JOIN cells USING (side, a, b) WHERE slot = s UNION ALL SELECT side, a, b, s, NULL FROM texts CROSS JOIN (SELECT unnest(range(384)) AS s)
     ANTI JOIN cells ON cells.side = texts.side AND cells.a = texts.a AND cells.b = texts.b AND cells.slot = s) GROUP BY side, a, b),
 shared AS (SELECT q.a AS query_id, c.a AS doc_id, c.b AS chunk_index, count(*) AS n FROM grams q JOIN grams c USING (gram) WHERE q.side = 'q' AND c.side = 'c' GROUP BY ALL),
 sizes AS (SELECT a, count(*) AS n FROM grams WHERE side = 'q' GROUP BY a),
 scores AS (SELECT q.a AS query_id, c.a AS doc_id, c.b AS chunk_index,
    round(0.6::double * list_inner_product(q.v, c.v) / (q.r * c.r) + 0.4::double * coalesce(shared.n, 0) / coalesce(sizes.n, 1), 9) AS raw
   FROM vectors q JOIN vectors c ON q.side = 'q' AND c.side = 'c' LEFT JOIN sizes ON sizes.a = q.a LEFT JOIN shared ON query_id = q.a AND doc_id = c.a AND chunk_index = c.b)
SELECT query_id, doc_id, cast(chunk_index AS INTEGER) AS chunk_index, cast(row_number() OVER w AS INTEGER) AS position, round(raw, 4) AS score FROM scores
WINDOW w AS (PARTITION BY query_id ORDER BY raw DESC, doc_id, chunk_index) QUALIFY row_number() OVER w <= 5"""


@query(SQL_SEARCH)
def hybrid_search(spark, sf):
    """Every benchmark passage is looked up in all document chunks."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return T.hybrid_search(T.chunk_text(table(spark, sf, "documents")), q, 5, with_text=False)


@query(f"SELECT * REPLACE (cast(query_id AS varchar) AS query_id) FROM ({SQL_SEARCH})")
def hybrid_search_stored(spark, sf):
    """The same search over an index that was written before, of chunks that carry their vectors."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    index = checkpointed(T.search_index(T.embed_chunks(T.chunk_text(table(spark, sf, "documents"))), with_text=False), T.INDEX_ROWS)
    return T.hybrid_search(index, q, 5, with_text=False)


@query("""WITH inc AS (SELECT source || '/' || lang AS name, doc_id, text FROM documents WHERE lang = 'fr' AND trim(text) <> ''),
 latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id DESC) n FROM inc) WHERE n = 1),
 cur AS (SELECT source || '/' || CASE WHEN lang = 'en' THEN 'fr' ELSE lang END AS name, doc_id, text FROM documents WHERE lang <> 'fr')
SELECT name, doc_id, md5(text) AS digest FROM cur WHERE name NOT IN (SELECT name FROM latest) UNION ALL SELECT name, doc_id, md5(text) FROM latest""")
def upsert_documents(spark, sf):
    d = table(spark, sf, "documents")
    lang = F.when(F.col("lang") == "en", "fr").otherwise(F.col("lang"))
    cur = d.filter("lang <> 'fr'").select(F.concat_ws("/", "source", lang).alias("name"), "doc_id", "text")
    inc = d.filter("lang = 'fr'").select(F.concat_ws("/", "source", "lang").alias("name"), "doc_id", "text")
    return T.upsert_documents(cur, inc, "name", "doc_id").select("name", "doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, 'new' AS version, round(1.0::double, 6) AS norm FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, 'kept', 0.0 FROM documents WHERE lang = 'fr'")
def reembed_stale_documents(spark, sf):
    """Vectors of an older version are rebuilt, current ones (here marked by zeros) stay."""
    old = F.when(F.col("lang") == "fr", X.EMBED_VERSION).otherwise(X.EMBED_VERSION - 1)
    d = table(spark, sf, "documents").select("doc_id", "text", F.array(F.lit(0.0)).alias("embedding"), old.alias("embed_version"))
    out = T.reembed_on_version(d)
    version = F.when(F.size("embedding") == 1, "kept").otherwise("new")
    return out.select("doc_id", version.alias("version"), F.round(X.cosine("embedding", "embedding"), 6).alias("norm"))


# ================================================================== header rows and inferred projections
def _customer_grid(spark, sf):
    """Customers as raw rows below a three-row header."""
    body = table(spark, sf, "customer").select(
        (F.col("c_custkey") + 3).alias("row_idx"), F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")).alias("cells")
    )
    head = [(0, ["客户", "", "(市场)"]), (1, ["客户编号", "客户 名称", "Seg.Name"]), (2, ["CUST_ID", "NAME", "SEGMENT"])]
    return spark.createDataFrame(head, "row_idx long, cells array<string>").unionByName(body)


@query("""SELECT c_custkey + 3 AS row_idx, cast(c_custkey AS varchar) AS "客户_编号_CUST_ID", c_name AS "客户_名称_NAME", c_mktsegment AS "Seg_Name_SEGMENT" FROM customer""")
def flatten_header_customers(spark, sf):
    return H.flatten_header(_customer_grid(spark, sf), 3)


@query("""SELECT c_custkey + 3 AS row_idx, cast(c_custkey AS varchar) AS "CUST_ID", c_name AS "NAME", c_mktsegment AS "SEGMENT" FROM customer""")
def pick_header_row_customers(spark, sf):
    return H.pick_header_row(_customer_grid(spark, sf), 3, 3)


@query("""SELECT cast(p_size AS int) AS "排名", p_name || ' ' || p_brand || ' ' || p_type AS "标题", cast(floor(p_retailprice) AS bigint)::double + 0.25 AS "售价", 4.5::double AS "评分" FROM part""")
def project_inferred(spark, sf):
    """Column roles found from cell patterns over the whole table, then projected."""
    p = table(spark, sf, "part")
    shaped = p.select(
        "p_size", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("b"), F.lit("CNY").alias("c"), F.floor("p_retailprice").cast("string").alias("d"),
        F.lit(".").alias("e"), F.lit("25").alias("f"), F.lit("4.5").alias("g"),
    )
    return PR.project(shaped, PR.infer_projection(PR.profile_columns(shaped, sample=None), ["排名", "标题", "售价", "评分"]))


# ================================================================== streams and user functions
@query("""SELECT user_id, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts, CASE WHEN event_id % 50 <> 0 THEN lag(ts) OVER w END AS previous_fetch,
 coalesce(event_id % 50 <> 0 AND epoch_us(ts) - epoch_us(lag(ts) OVER w) < 86400000000, false) AS repeat_fetch
FROM events WINDOW w AS (PARTITION BY user_id, event_id % 50 = 0 ORDER BY ts)""")
def repeat_fetch_stream(spark, sf):
    """Every event of a user as seen by the streaming form: pushed out of order, in several batches, some without a time.

    A last event far ahead moves the watermark past all others; it waits itself and never comes out."""
    e = table(spark, sf, "events")
    span = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    out = scratch_path(spark, "stream")
    push = F.pmod(F.xxhash64("event_id"), F.lit(2))
    fetched = e.select("user_id", F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp")).alias("ts"), push.alias("push"))
    ahead = e.limit(1).select("user_id", F.lit(span["hi"] + (span["hi"] - span["lo"]) + timedelta(days=9)).cast("timestamp").alias("ts"))
    late = f"{int((span['hi'] - span['lo']).total_seconds()) + 1} seconds"
    for pushed in (fetched.where("push = 0").drop("push"), fetched.where("push = 1").drop("push"), ahead):
        pushed.write.mode("append").parquet(out + "/log")
        log = spark.readStream.schema("user_id long, ts timestamp").parquet(out + "/log")
        flagged = flag_repeat_fetch_stream(log, "user_id", "ts", late=late)
        flagged.writeStream.format("parquet").option("checkpointLocation", out + "/state").trigger(availableNow=True).start(out + "/rows").awaitTermination()
    return spark.read.schema(flagged.schema).parquet(out + "/rows")


@query("""SELECT doc_id AS job_id, len(string_split(text, ' ')) AS n FROM documents""")
def ingest_stream_rows(spark, sf):
    """Pushed payloads as a stream in three batches: French documents come empty at first, all jobs are pushed again, and half of them once more."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    out = scratch_path(spark, "ingest")
    for push, some in enumerate((d, d, d.where("doc_id % 2 = 0"))):
        words = F.transform(F.split("text", " "), lambda w: F.array(w))
        rows = F.when((F.col("lang") == "fr") & F.lit(push == 0), F.array().cast("array<array<string>>")).otherwise(words)
        pushed = some.select(F.col("doc_id").alias("job_id"), F.concat(F.lit("https://www."), "source", F.lit(".example.com")).alias("url"), rows.alias("rows"))
        pushed.write.mode("append").parquet(out + "/pushed")
        stream = spark.readStream.schema(pushed.schema).parquet(out + "/pushed")
        ingest_stream(stream, out + "/rows", out + "/state").awaitTermination()
    return spark.read.parquet(out + "/rows").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedupe_stream_events(spark, sf):
    """The events file as a stream, deduplicated by a streaming query into a table in the shared folder."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = scratch_path(spark, "stream")
    deduped = dedupe_stream(stream.select("user_id", "event_type", "ts"), ["user_id", "event_type"])
    run = deduped.writeStream.format("parquet").option("checkpointLocation", out + "/state").trigger(availableNow=True).start(out + "/rows")
    run.awaitTermination()
    return spark.read.schema(deduped.schema).parquet(out + "/rows").select("user_id", "event_type")


@query("SELECT p_partkey, p_retailprice * 1.5 AS marked_up, 'ok' AS status FROM part")
def user_row_function(spark, sf):
    registry = FunctionRegistry(spark)
    registry.register(
        "user.mark_up", lambda pdf, factor: pdf.assign(marked_up=pdf.p_retailprice * factor)[["p_partkey", "marked_up"]],
        "p_partkey long, marked_up double", "rows", {"factor": "number"}, ("factor",),
    )
    out = registry.apply_rows("user.mark_up", table(spark, sf, "part").select("p_partkey", "p_retailprice"), factor=1.5)
    return out.select("p_partkey", "marked_up", "status")


@query("""SELECT p_partkey, upper(p_brand) || '/' || p_size AS code, round(p_retailprice * (1 - p_size / 100.0), 4) AS net FROM part""")
def user_functions_in_sql(spark, sf):
    """A function of cells and one of whole columns, both called from SQL."""
    registry = FunctionRegistry(spark)
    registry.register("user.code", lambda brand, size: f"{brand.upper()}/{size}", "string", "scalar")
    registry.register("user.net", lambda price, size: price * (1 - size / 100.0), "double", "pandas")
    table(spark, sf, "part").createOrReplaceTempView("user_parts")
    return spark.sql("SELECT p_partkey, user_code(p_brand, p_size) AS code, round(user_net(p_retailprice, p_size), 4) AS net FROM user_parts")


class Steps:
    """Table function: per row of a group in order, how much a column has changed; a last row sums up the group."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        kind = rows.dataType[key.value].dataType
        return AnalyzeResult(StructType([StructField(key.value, kind), StructField("position", LongType()), StructField(f"{column.value}_step", DoubleType())]))

    def __init__(self):
        self.n, self.first, self.last, self.key = 0, None, None, None

    def eval(self, rows, key: str, column: str):
        value = float(rows[column])
        if self.n:
            yield rows[key], self.n, value - self.last
        else:
            self.first = value
        self.n, self.last, self.key = self.n + 1, value, rows[key]

    def terminate(self):
        if self.n:
            yield self.key, None, self.last - self.first


SQL_STEPS = """WITH s AS (SELECT o_custkey, row_number() OVER w - 1 AS position, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS step,
  first_value(o_totalprice) OVER w AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back, o_totalprice AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, position, step AS o_totalprice_step FROM s WHERE position > 0 UNION ALL SELECT o_custkey, NULL, round(b - a, 4) FROM s WHERE back = 1"""


@query(SQL_STEPS)
def user_table_function(spark, sf):
    """Columns told from the arguments, rows dealt by group and ordered, called on a DataFrame."""
    registry = FunctionRegistry(spark)
    registry.register("user.steps", Steps, None, "table", {"key": "string", "column": "string"}, ("key", "column"))
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    out = registry.apply_table("user.steps", orders, ["o_custkey"], ["o_orderkey"], key="o_custkey", column="o_totalprice")
    return out.withColumn("o_totalprice_step", F.round("o_totalprice_step", 4))


@query(SQL_STEPS)
def user_table_function_in_sql(spark, sf):
    registry = FunctionRegistry(spark)
    registry.register("user.steps", Steps, None, "table", {"key": "string", "column": "string"}, ("key", "column"))
    table(spark, sf, "orders").createOrReplaceTempView("user_orders")
    return spark.sql("""SELECT o_custkey, position, round(o_totalprice_step, 4) AS o_totalprice_step
        FROM user_steps(TABLE(SELECT o_custkey, o_orderkey, o_totalprice FROM user_orders) PARTITION BY o_custkey ORDER BY o_orderkey, key => 'o_custkey', column => 'o_totalprice')""")


@query("SELECT p_partkey, CASE WHEN p_size <> 10 THEN 100 / (p_size - 10) END AS share, CASE WHEN p_size = 10 THEN 'error' ELSE 'ok' END AS status FROM part")
def user_row_errors(spark, sf):
    """A function that fails on some rows: the others keep their results."""
    registry = FunctionRegistry(spark)

    def share(pdf):
        if (pdf["p_size"] == 10).any():
            raise ZeroDivisionError("size 10")
        return pdf.assign(share=100 / (pdf["p_size"] - 10))

    registry.register("user.share", share, "p_partkey long, share double", "rows")
    return registry.apply_rows("user.share", scale.spread(table(spark, sf, "part").select("p_partkey", "p_size"))).select("p_partkey", "share", "status")


@query("""SELECT CASE WHEN p_partkey <= 20 THEN cast(p_partkey AS varchar) ELSE 'word ' || p_partkey END AS mixed, cast(p_partkey AS double) AS whole FROM part""")
def coerce_columns_inferred(spark, sf):
    """Kinds are told from all rows: a column that starts with numbers and goes on with words stays text."""
    key = F.col("p_partkey").cast("string")
    mixed = F.when(F.col("p_partkey") <= 20, key).otherwise(F.concat(F.lit("word "), key))
    return S.coerce_columns(table(spark, sf, "part").orderBy("p_partkey").select(mixed.alias("mixed"), key.alias("whole")))


@query("""SELECT o_orderstatus, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END) AS "a_b_c_sum_o_custkey", sum(CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END) AS "a_b_c_2_sum_o_custkey"
FROM orders GROUP BY 1""")
def pivot_two_columns(spark, sf):
    """Two column fields whose values read alike when joined."""
    even = F.col("o_orderkey") % 2 == 0
    o = table(spark, sf, "orders").select("o_orderstatus", "o_custkey", F.when(even, "a").otherwise("a_b").alias("f"), F.when(even, "b_c").otherwise("c").alias("g"))
    return A.pivot_table(o, ["o_orderstatus"], ["f", "g"], [{"field": "o_custkey", "aggregation": "sum"}])


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN p_size >= 20 THEN 'e20' WHEN p_size >= 5 THEN 'e5' END WHEN p_type = 'PROMO' AND p_size >= 10 THEN 'p10' END AS price,
 coalesce(p_type = 'ECONOMY' AND p_size >= 5 OR p_type = 'PROMO' AND p_size >= 10, false) AS tier_found FROM part""")
def tier_price_nulls(spark, sf):
    """Tiers without a breakpoint or a zone fit nothing."""
    tiers = [(None, "ECONOMY", "none"), (5.0, "ECONOMY", "e5"), (20.0, "ECONOMY", "e20"), (20.0, "ECONOMY", "e2"), (1.0, None, "nowhere"), (10.0, "PROMO", "p10"), (None, "PROMO", "none")]
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.when(F.col("p_type").isin("ECONOMY", "PROMO"), F.col("p_type")).alias("zone"))
    return J.tier_lookup(p, spark.createDataFrame(tiers, "at double, zone string, price string"), "p_size", "at", ["price"], ["zone"]).select("p_partkey", "price", "tier_found")


# ================================================================== flows and sinks
@query(f"WITH {SQL_LEDGERS} SELECT status, key, left_seq, right_seq FROM result")
def flow_reconcile(spark, sf):
    left, right = ledgers(spark, sf)
    out = run_flow("reconcile", left, right, "ref", compare=["o_totalprice", "o_orderpriority"], order_by=["seq"])
    return out.select(*RESULT[:4])


@query("SELECT DISTINCT trim(c_mktsegment) AS c_mktsegment FROM customer WHERE trim(c_mktsegment) <> ''")
def flow_extract(spark, sf):
    return run_flow("extract", table(spark, sf, "customer"), ["c_mktsegment"], "keep", True)


@query("""SELECT cast(p_size AS int) AS "排名", p_name || ' ' || p_brand || ' ' || p_type AS "标题", 4.5::double AS "评分" FROM part""")
def flow_project(spark, sf):
    shaped = table(spark, sf, "part").select("p_size", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("b"), F.lit("4.5").alias("c"))
    return run_flow("project", shaped, ["排名", "标题", "评分"], "列表", has_header=True)


@query("SELECT c_custkey + 2 AS row_idx, c_name AS \"customer_name\", c_mktsegment AS \"customer_segment\" FROM customer")
def flow_flatten_header(spark, sf):
    heads = spark.createDataFrame([(0, ["customer", ""]), (1, ["name", "segment"])], "row_idx long, cells array<string>")
    body = table(spark, sf, "customer").select((F.col("c_custkey") + 2).alias("row_idx"), F.array("c_name", "c_mktsegment").alias("cells"))
    return run_flow("flatten_header", heads.unionByName(body))


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) n FROM events) WHERE n = 1""")
def flow_reshape(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return run_flow("reshape", e, "dedupe", keys=["user_id", "event_type"], order_by=["event_id"])


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def flow_calculate(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return run_flow("calculate", table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "lookup", nation, "c_nationkey", ["n_name"], order_by=["n_name"])


@query("""SELECT source || '.example.com' AS host, count(*) AS n, sum(len(string_split(text, ' '))) AS cells FROM documents WHERE lang <> 'fr' GROUP BY 1""")
def archive_rows(spark, sf):
    """Rows of pushed payloads written below their hosts' folders and read back."""
    out = scratch_path(spark, "archive")
    N.archive_by_host(N.ingest_rows(_payloads(spark, sf)), out)
    back = spark.read.parquet(out)
    return back.groupBy("host").agg(F.count_distinct("job_id").alias("n"), F.count(F.lit(1)).alias("cells"))


@query("""SELECT o_custkey, count(*) AS orders, version FROM orders, (VALUES ('1'), ('2')) v(version) GROUP BY ALL""")
def new_tables(spark, sf):
    """The same name twice: the second table gets the next free one, and the first stays as it was."""
    base = f"per_customer_{uuid.uuid4().hex}_"
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    names = [K.write_new_table(counts, base) for _ in range(2)]
    return reduce(DataFrame.unionByName, [spark.table(n).withColumn("version", F.lit(n.removeprefix(base) or "1")) for n in names])


@query("""SELECT count(*) AS files, count(*) AS fingerprints, true AS sized FROM (SELECT DISTINCT o_orderpriority, o_orderkey // 2000 FROM orders)""")
def fingerprint_files(spark, sf):
    """Every file written has a fingerprint of its own: one file for each priority and 2,000 order keys."""
    out = scratch_path(spark, "files")
    o = table(spark, sf, "orders").select("o_orderpriority", F.expr("o_orderkey div 2000").alias("part"), F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"))
    o.repartition("o_orderpriority", "part").write.partitionBy("o_orderpriority", "part").text(out)
    prints = FD.source_fingerprint(spark, out + "/*/*/*.txt")
    return prints.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("source_hash").alias("fingerprints"), (F.min("length") > 0).alias("sized"))


@query("""SELECT doc_id // 5000 AS block, sum(strlen(line) + 1)::BIGINT AS length, substr(sha256(string_agg(line || chr(10), '' ORDER BY doc_id, line)), 1, 16) AS source_hash
FROM (SELECT doc_id, doc_id || ',' || n_chars || ',' || source AS line FROM documents) GROUP BY 1""")
def fingerprint_document_files(spark, sf):
    """One file for each 5,000 documents, so files grow in number with the table; the hashes are those of the same lines."""
    out = scratch_path(spark, "document_files")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), "source")
    d = table(spark, sf, "documents").select(F.expr("doc_id div 5000").alias("block"), "doc_id", line.alias("value"))
    d.repartition("block").sortWithinPartitions("block", "doc_id", "value").select("block", "value").write.partitionBy("block").text(out)
    prints = FD.source_fingerprint(spark, out + "/*/*.txt")
    return prints.select(F.regexp_extract("path", r"block=(\d+)", 1).cast("long").alias("block"), "length", "source_hash")


@query(f"""WITH {SQL_LEDGERS}, c AS (SELECT count(*) FILTER (status = 'matched') m, count(*) FILTER (status = 'conflict') x FROM result)
SELECT v.r AS "runType", m AS matched, x AS conflict FROM c, (VALUES ('first'), ('second')) v(r)""")
def audit_log(spark, sf):
    """Two runs appended to the audit log and read back."""
    out = scratch_path(spark, "audit")
    counts = reconcile_counts(_ledger_result(spark, sf))
    for run in ("first", "second"):
        K.append_audit(K.audit_row(counts, "finance", "1", run), out)
    return K.read_audit(spark, out).select("runType", "matched", "conflict")


@query("""SELECT * FROM (VALUES (0, 'A', 'p_partkey', 'amount'), (1, 'B', 'p_name', 'plain_text'), (2, 'C', 'p_size', 'amount')) v(idx, letter, "column", kind)""")
def profile_one_table(spark, sf):
    return Q.profile_table(table(spark, sf, "part").select("p_partkey", "p_name", "p_size")).select("idx", "letter", "column", "kind")


@query("SELECT o_custkey AS source_id, o_orderkey AS table_idx, o_orderkey % 3 = 0 AS has_header FROM orders")
def header_rows_mixed(spark, sf):
    """First rows that are headers, that hold data, and that repeat the row below."""
    kind = F.col("o_orderkey") % 3
    line = lambda *cells: F.array(*[F.lit(c) for c in cells])
    first = F.when(kind == 0, line("name", "amount", "day")).when(kind == 1, line("CNY 12", "4.5 颗星", "17")).otherwise(line("x", "y", "z"))
    second = F.when(kind == 2, line("x", "y", "z")).otherwise(line("pear", "3", "4"))
    grids = table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("table_idx"), F.posexplode(F.array(first, second)).alias("row_idx", "cells"))
    return G.flag_header_rows(grids)
