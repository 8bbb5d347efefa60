"""Ingest: landed API pages → records → the canonical transaction schema.

The reference fetched pages over HTTP one by one. Here pages are *landed*
documents (one JSON text per organization and page); the fetch loop's rules
become set operations over the page table:

* of a page that landed more than once, the newest batch's document counts;
* a page is read only if every earlier page was present and full (100
  records) and, with a ``limit``, fewer records were fetched before it;
* an organization whose read pages include a payload that is no JSON array
  (an error object, a truncated page) yields nothing at all (all-or-nothing);
* record, user and merchant ids are any JSON scalar and stay text;
* records are mapped from the nested JSON, defaults fill missing fields, and
  placeholder attributes are a deterministic hash of the record id (so a
  re-executed task produces the same rows);
* rows missing id, amount, date or organization are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions import scalars as S
from txnrisk.schema import (
    API_RECORD_SCHEMA, COUNTRIES, DEVICE_TYPES, PAGE_SIZE,
    PLACEHOLDER_ID_RANGE, PRODUCT_ID_RANGE, RAW_COLUMNS, REQUIRED_NOT_NULL, SEED,
)
from txnrisk.session import ensure_session_defaults, materialize

PAGE_ARRAY = T.ArrayType(API_RECORD_SCHEMA)


# ---------------------------------------------------------------------------
# Landed pages: Parquet rows (org_id, page, payload), ranged by organization
# ---------------------------------------------------------------------------

LANDED_SCHEMA = T.StructType([
    T.StructField("org_id", T.LongType()),
    T.StructField("page", T.LongType()),
    T.StructField("payload", T.StringType()),
])


def land_pages(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sink: write ``(org_id, page, payload)`` rows, ranged by organization and
    page, so that a filter on ``org_id`` skips files and row groups by their
    statistics and a large organization spreads over several files."""
    pages.select("org_id", "page", "payload").repartitionByRange("org_id", "page") \
        .sortWithinPartitions("org_id", "page").write.mode(mode).parquet(path)


def read_landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Source: landed page documents → ``(org_id, page, payload)``."""
    ensure_session_defaults(spark)
    return spark.read.schema(LANDED_SCHEMA).parquet(path)


def union_pages(*pages: DataFrame) -> DataFrame:
    """Bag union of page sets in landing order (``batch`` counts up), of
    which ``page_table`` keeps each page's newest document."""
    out = None
    for i, p in enumerate(pages):
        p = p.select("org_id", "page", "payload", F.lit(i).cast(T.LongType()).alias("batch"))
        out = p if out is None else out.unionByName(p)
    return out


def newest_rows(rows: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    """``org_id, page`` and ``columns`` of each page's row with the largest ``order``.

    The pages that landed more than once are found by their numbers alone and
    written; only their rows are shuffled and compared, all others pass
    straight from the scan. Reads ``rows`` when called, and once more when used.
    """
    narrow = rows.groupBy(F.col("org_id").alias("_org"), F.col("page").alias("_page")).count().filter("count > 1").drop("count")
    again = materialize(narrow)
    if again.isEmpty():
        return rows.select("org_id", "page", *columns)
    same = F.col("org_id").eqNullSafe(F.col("_org")) & F.col("page").eqNullSafe(F.col("_page"))
    best = rows.join(again, same, "left_semi").groupBy("org_id", "page").agg(F.max_by(F.struct(*columns), order).alias("r"))
    return rows.join(again, same, "left_anti").select("org_id", "page", *columns).unionByName(best.select("org_id", "page", "r.*"))


def page_table(pages: DataFrame) -> DataFrame:
    """One parsed row per page: ``org_id, page, bad, n, records``.

    Of several documents of a page the one with the largest ``batch`` counts
    (the larger text without or within a batch). A page is bad when its
    payload is not a complete JSON array: the text must begin with ``[`` (an
    error object would parse as an array of nulls) and parse. Each payload is
    parsed once, and shuffled only where its page landed more than once.
    """
    batch = F.col("batch") if "batch" in pages.columns else F.lit(0)
    newest = newest_rows(pages, F.struct(batch.alias("b"), F.col("payload").alias("p")), ["payload"])
    array = F.coalesce(F.ltrim(F.col("payload")).startswith("["), F.lit(False))
    parsed = newest.select("org_id", "page", F.when(array, F.from_json("payload", PAGE_ARRAY)).alias("records"))
    return parsed.select("org_id", "page", F.col("records").isNull().alias("bad"),
                         F.when(F.col("records").isNotNull(), F.size("records")).cast(T.LongType()).alias("n"), "records")


def newest_pages(table: DataFrame, batch: str) -> DataFrame:
    """``page_table`` rows of several batches → the newest of each page."""
    return newest_rows(table, F.col(batch), ["bad", "n", "records"])


def pages_to_read(table: DataFrame, limit: int | None = None) -> DataFrame:
    """S1 + S2 over a page table (``org_id, page, bad, n``) → ``(org_id, page)``
    of the pages whose records are kept. ``limit`` is the fetch cap, if any.

    The fetch of an organization ends with the first page that is bad or not
    full, or that has no successor; pages before it held 100 records each, so
    a cap is a bound on the page number. Both ends are partial aggregates: no
    task sees all pages of an organization.
    """
    t = table.select("org_id", "page", "bad", F.coalesce("n", F.lit(0)).alias("n")).filter("page >= 1")
    if limit is not None:
        t = t.filter(F.col("page") <= F.lit((max(limit, 1) - 1) // PAGE_SIZE + 1))
    after = t.select("org_id", (F.col("page") - 1).alias("page"))
    run_ends = t.join(after, ["org_id", "page"], "left_anti").select("org_id", "page", F.lit(False).alias("bad"), F.lit(False).alias("stop"))
    stops = t.filter(F.col("bad") | (F.col("n") < PAGE_SIZE)).select("org_id", "page", "bad", F.lit(True).alias("stop"))
    # the first end counts; where a stop and a run's end coincide, the stop tells if the page is bad
    ends = stops.unionByName(run_ends).groupBy("org_id").agg(
        F.min("page").alias("_last"), F.min_by("bad", F.struct("page", (~F.col("stop")).alias("r"))).alias("_bad"))
    first = t.groupBy("org_id").agg(F.min("page").alias("_first")).filter("_first = 1").select("org_id")
    reach = ends.filter(~F.col("_bad")).join(first, "org_id", "left_semi")
    return t.join(reach, "org_id").filter((F.col("page") <= F.col("_last")) & (F.col("n") > 0)).select("org_id", "page")


def read_page_table(table: DataFrame, limit: int | None = None) -> DataFrame:
    """The records (``org_id, page, rec``) that the paginated fetch would have returned, from a stored page table."""
    kept = table.join(pages_to_read(table, limit), ["org_id", "page"], "left_semi")
    return kept.select("org_id", "page", F.explode("records").alias("rec"))


def read_transaction_pages(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per record (parsed struct ``rec``) with its ``org_id`` and
    ``page``. The parsed pages are written once; the page rules read only
    their narrow columns."""
    return read_page_table(materialize(page_table(pages)), limit)


# ---------------------------------------------------------------------------
# Record mapping
# ---------------------------------------------------------------------------

def hash_placeholders(id_col: Column) -> dict[str, Column]:
    """Attributes the API lacks, as deterministic functions of the id."""
    lo, hi = PLACEHOLDER_ID_RANGE
    plo, phi = PRODUCT_ID_RANGE
    return {
        "user_id": S.hash_int_range(f"{SEED}:user", id_col, lo, hi),
        "product_id": S.hash_int_range(f"{SEED}:product", id_col, plo, phi),
        "merchant_id": S.hash_int_range(f"{SEED}:merchant", id_col, lo, hi),
        "device_type": S.hash_choice(f"{SEED}:device", id_col, DEVICE_TYPES),
        "location_country": S.hash_choice(f"{SEED}:country", id_col, COUNTRIES),
    }


def map_api_records(records: DataFrame, rec: str = "rec") -> DataFrame:
    """S3: nested API record → the eleven flat columns (date still text).

    Missing ``creator``/``merchant`` (or their ids) fall back to placeholders,
    a missing or non-numeric organization to 0, a missing type to ``'unknown'``; amounts are
    cents (missing or non-numeric → 0). Live records carry no label: 0.
    """
    r = F.col(rec)
    tid = r["id"]
    ph = hash_placeholders(tid)
    return records.select(
        tid.alias("transaction_id"),
        S.cents_to_dollars(r["amount"]).alias("amount"),
        r["date"].alias("date"),
        F.coalesce(r["creator"]["id"], ph["user_id"].cast(T.StringType())).alias("user_id"),
        F.coalesce(r["organization"]["id"].try_cast(T.LongType()), F.lit(0).cast(T.LongType())).alias("organization_id"),
        ph["product_id"].alias("product_id"),
        F.coalesce(r["merchant"]["id"], ph["merchant_id"].cast(T.StringType())).alias("merchant_id"),
        F.coalesce(r["type"], F.lit("unknown")).alias("transaction_type"),
        ph["device_type"].alias("device_type"),
        ph["location_country"].alias("location_country"),
        F.lit(0).cast(T.IntegerType()).alias("is_fraud"),
    )


# ---------------------------------------------------------------------------
# Cleaning (S5, S6, S7)
# ---------------------------------------------------------------------------

def _typed_date(df: DataFrame, col: str = "date") -> Column:
    return S.coerce_timestamp(col, df.schema[col].dataType)


def clean_ingest(df: DataFrame) -> DataFrame:
    """Ingest clean — unparsable amount → 0, unparsable date → dropped,
    rows missing id/amount/date/organization dropped."""
    out = df.withColumns({
        "amount": F.coalesce(S.coerce_double("amount"), F.lit(0.0)),
        "date": _typed_date(df),
    })
    return out.na.drop(subset=["transaction_id", "amount", "date", "organization_id"])


def with_required_columns(df: DataFrame) -> DataFrame:
    """Add any missing canonical column with the reference default:
    amount 0.0, date NULL, is_fraud 0, id-like columns -1, else 'unknown'."""
    add = {}
    for c in RAW_COLUMNS:
        if c in df.columns:
            continue
        if c == "amount":
            add[c] = F.lit(0.0)
        elif c == "date":
            add[c] = F.lit(None).cast(T.TimestampType())
        elif c == "is_fraud":
            add[c] = F.lit(0).cast(T.IntegerType())
        elif "id" in c.split("_"):
            add[c] = F.lit(-1).cast(T.LongType())
        else:
            add[c] = F.lit("unknown")
    return df.withColumns(add) if add else df


def conform(df: DataFrame) -> DataFrame:
    """Amount and date coerced (failures → NULL), missing columns added."""
    out = df
    if "amount" in out.columns:
        out = out.withColumn("amount", S.coerce_double("amount"))
    if "date" in out.columns:
        out = out.withColumn("date", _typed_date(out))
    return with_required_columns(out)


def clean_processor(df: DataFrame) -> DataFrame:
    """Processor clean — conform, then drop rows missing amount, date, id
    or organization."""
    return conform(df).na.drop(subset=REQUIRED_NOT_NULL)


# ---------------------------------------------------------------------------
# Organization directory
# ---------------------------------------------------------------------------

def load_org_directory(raw: DataFrame, order_col: str | None = None) -> DataFrame:
    """Keep records with a non-empty slug and a non-zero id; slugs are
    lower-cased; for a repeated slug the last record (by ``order_col``, else
    scan order) wins. Returns ``(slug, id, name)``."""
    ordinal = F.col(order_col) if order_col else F.monotonically_increasing_id()
    d = raw.select(
        F.lower(F.coalesce(F.col("slug"), F.lit(""))).alias("slug"),
        F.col("id"),
        F.coalesce(F.col("name"), F.lit("Unknown")).alias("name"),
        ordinal.alias("_ord"),
    ).filter((F.col("slug") != "") & F.col("id").isNotNull() & (F.col("id") != 0))
    last = F.max_by(F.struct("id", "name"), "_ord")
    return d.groupBy("slug").agg(last.alias("_l")).select("slug", "_l.id", "_l.name")
