"""Transaction views over the driver-generated tables.

These map the read-only parquet tables onto the canonical transaction
schema (see FIXTURES.md). The same definitions exist as SQL text in
``txnrisk.plans.oracle`` so an independent engine can check every query.

Scale notes: the loaders only project and filter, so Catalyst prunes the
parquet columns and pushes predicates into the scan. ``txn_orders`` joins
``orders`` with ``customer`` (a shuffle join: customer grows with the data)
and with ``nation`` (25 rows by definition, so it is always broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.schema import PAGE_SIZE, RAW_COLUMNS
from txnrisk.session import ensure_session_defaults

ID_BUCKET = 1 << 16  # ids per numbering bucket of the page fixture


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_session_defaults(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col, mapping: list, otherwise):
    expr = None
    for k, v in mapping:
        expr = (F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v)))
    return expr.otherwise(F.lit(otherwise))


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """µs timestamps, no ties (generator-like transactions)."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"([0-9]+)", 1).try_cast(T.LongType())
    e = e.select("event_id", "value", "ts", "user_id", "event_type", k.alias("k"))
    device = _case(F.col("event_id") % 3, [(0, "mobile"), (1, "desktop")], "tablet")
    country = _case(
        F.col("user_id") % 6,
        [(0, "USA"), (1, "CAN"), (2, "GBR"), (3, "AUS"), (4, "DEU")], "FRA",
    )
    fraud = F.when((F.col("value") > 150) | (F.col("k") % 56 == 0), 1).otherwise(0)
    return e.select(
        F.col("event_id").alias("transaction_id"),
        F.col("value").alias("amount"),
        F.col("ts").cast(T.TimestampType()).alias("date"),
        F.col("user_id"),
        (F.col("k") % 20).alias("organization_id"),
        (F.col("k") % 19 + 1).alias("product_id"),
        ((F.col("user_id") * 7 + F.col("k")) % 250 + 1).alias("merchant_id"),
        F.col("event_type").alias("transaction_type"),
        device.alias("device_type"),
        country.alias("location_country"),
        fraud.cast(T.IntegerType()).alias("is_fraud"),
    )


def txn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-granular dates: many ties and exact-24 h neighbours (API-like)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         # nation has 25 rows by definition of the schema: a fixed-size broadcast.
         .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")))
    device = _case(F.col("o_orderstatus"), [("F", "mobile"), ("O", "desktop")], "tablet")
    fraud = F.when((F.col("o_totalprice") > 480000) | (F.col("o_orderkey") % 56 == 0), 1).otherwise(0)
    return j.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").cast(T.TimestampType()).alias("date"),
        F.col("o_custkey").alias("user_id"),
        F.col("c_nationkey").cast(T.LongType()).alias("organization_id"),
        (F.col("o_orderkey") % 19 + 1).alias("product_id"),
        (F.col("o_custkey") % 250 + 1).alias("merchant_id"),
        F.col("o_orderpriority").alias("transaction_type"),
        device.alias("device_type"),
        F.col("n_name").alias("location_country"),
        fraud.cast(T.IntegerType()).alias("is_fraud"),
    )


def txn_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text amount/date and null keys, for cleaning and the display join."""
    t = txn_events(spark, sf_dir)
    tid = F.col("transaction_id")
    return t.select(
        tid.alias("row_id"),
        F.when(tid % 83 == 0, F.lit(None).cast(T.LongType())).otherwise(tid).alias("transaction_id"),
        F.when(tid % 97 == 0, F.lit("n/a")).otherwise(F.col("amount").cast(T.StringType())).alias("amount"),
        F.when(tid % 89 == 0, F.lit("not-a-date")).otherwise(F.col("date").cast(T.StringType())).alias("date"),
        "user_id",
        F.when(tid % 79 == 0, F.lit(None).cast(T.LongType())).otherwise(F.col("organization_id")).alias("organization_id"),
        *[c for c in RAW_COLUMNS[5:]],
    )


def org_directory_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organization records: id, slug, name (id 0 present on purpose)."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast(T.LongType()).alias("id"),
        F.upper(F.regexp_replace("n_name", "_", "-")).alias("slug"),
        F.col("n_name").alias("name"),
    )


# --- landed API pages ------------------------------------------------------------
#
# Table form of the paginated API: one row per record with its organization
# and 1-based page number (100 records per page, in id order), and fields
# missing on a fixed rule so the mapping defaults are exercised.

def api_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txnrisk.operators.ranking import keyed_row_number

    t = txn_events(spark, sf_dir)
    # per-organization record number in id order, spread over id ranges
    t = keyed_row_number(t, "organization_id", ["transaction_id"],
                         F.floor(F.col("transaction_id") / F.lit(ID_BUCKET)), out="_rn")
    tid = F.col("transaction_id")
    null_long = F.lit(None).cast(T.LongType())
    return t.select(
        tid.alias("id"),
        F.when(tid % 13 == 0, null_long).otherwise(F.round(F.col("amount") * 100).cast(T.LongType())).alias("amount_cents"),
        F.to_date("date").cast(T.StringType()).alias("date_text"),
        F.when(tid % 17 == 0, F.lit(None).cast(T.StringType())).otherwise(F.col("transaction_type")).alias("type"),
        F.when(tid % 7 == 0, null_long).otherwise(F.col("user_id")).alias("creator_id"),
        F.col("organization_id").alias("org_id"),
        F.when(tid % 11 == 0, null_long).otherwise(F.col("merchant_id")).alias("merchant_id"),
        F.ceil(F.col("_rn") / F.lit(PAGE_SIZE)).cast(T.LongType()).alias("page"),
    )


def api_pages(spark: SparkSession, sf_dir: str, error_rule: bool = True, text_ids: bool = False,
              cut_rule: bool = False) -> DataFrame:
    """Landed pages ``(org_id, page, payload)``: payload is the JSON text the API
    returned — an array of records, or an error object for a page the rule
    marks bad (page 2 of every organization with ``org_id % 7 = 3``).
    ``text_ids`` makes record ids text (``txn_<id>``); ``cut_rule`` cuts off the
    end of page 2 of every organization with ``org_id % 5 = 2``.

    A page holds at most 100 records, so building its array is bounded work.
    """
    r = api_records(spark, sf_dir)
    rec = F.struct(
        (F.concat(F.lit("txn_"), F.col("id").cast(T.StringType())) if text_ids else F.col("id")).alias("id"),
        F.col("amount_cents").alias("amount"),
        F.col("date_text").alias("date"),
        F.col("type"),
        F.when(F.col("creator_id").isNotNull(), F.struct(F.col("creator_id").alias("id"))).alias("creator"),
        F.struct(F.col("org_id").alias("id")).alias("organization"),
        F.when(F.col("merchant_id").isNotNull(), F.struct(F.col("merchant_id").alias("id"))).alias("merchant"),
    )
    pages = r.groupBy("org_id", "page").agg(
        F.sort_array(F.collect_list(F.struct(F.col("id").alias("_k"), rec.alias("_r")))).alias("_recs"))
    payload = F.to_json(F.transform("_recs", lambda x: x["_r"]))
    if error_rule:
        bad = (F.col("org_id") % 7 == 3) & (F.col("page") == 2)
        payload = F.when(bad, F.lit('{"message": "rate limited"}')).otherwise(payload)
    if cut_rule:
        cut = (F.col("org_id") % 5 == 2) & (F.col("page") == 2)
        payload = F.when(cut, F.left(payload, F.length(payload) - F.lit(25))).otherwise(payload)
    return pages.select("org_id", "page", payload.alias("payload"))
