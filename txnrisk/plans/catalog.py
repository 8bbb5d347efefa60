"""Registered queries: one per operator of the survey inventory.

Each entry is ``(spark, sf_dir) -> DataFrame`` over the driver's tables (via
the fixture views), plus — where SQL can express it — an independently
written DuckDB query with the same column names. Queries without SQL are
checked on row counts by the driver and by property tests in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions import scalars as S
from txnrisk.operators import dashboard as D
from txnrisk.operators import dictionary as DI
from txnrisk.operators import features as FE
from txnrisk.operators import labels as L
from txnrisk.operators import logistic as LG
from txnrisk.operators import metrics as M
from txnrisk.operators import ml as ML
from txnrisk.plans import oracle as O
from txnrisk.schema import CATEGORICAL_FEATURES, DERIVED_FEATURES, NUMERIC_FEATURES, RAW_COLUMNS, SEED
from txnrisk.sources import fixtures as FX
from txnrisk.sources import ingest as IN
from txnrisk.session import materialize

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = Entry(fn, sql)
        return fn
    return deco


PASS = [c for c in RAW_COLUMNS if c != "date"]
MONEY = 2  # fixture amounts are cent-precise: exact integer-cent sums


def _features(spark, sf_dir, view="txn_events", **kw) -> DataFrame:
    src = getattr(FX, view)(spark, sf_dir)
    return FE.engineer_features(src, amount_scale=MONEY, **kw)


def _feat_sql(view: str, select: str, ratio: str = "serving", where: str = "") -> str:
    return O.with_views(view) + "," + O.features_ctes(view, ratio=ratio) + f"\nSELECT {select} FROM featr {where}"


# ===========================================================================
# Window features
# ===========================================================================

@query("engineer_features", _feat_sql("txn_events", O._PASS + ", " + O.FEATURE_COLUMNS))
def q_engineer_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query("engineer_features_orders", _feat_sql("txn_orders", O._PASS + ", " + O.FEATURE_COLUMNS))
def q_engineer_features_orders(spark, sf_dir):
    return _features(spark, sf_dir, "txn_orders")


@query("engineer_features_ranked", _feat_sql("txn_orders", O._PASS + ", " + O.FEATURE_COLUMNS))
def q_engineer_features_ranked(spark, sf_dir):
    """The same features by global rank, the strategy for any skew inside an hour."""
    return _features(spark, sf_dir, "txn_orders", strategy="ranked")


def _feature_subset(name: str, cols: list[str], view: str = "txn_orders"):
    sql = _feat_sql(view, "transaction_id, " + ", ".join(cols))

    @query(name, sql)
    def _q(spark, sf_dir):
        return _features(spark, sf_dir, view).select("transaction_id", *cols)
    return _q


_feature_subset("time_since_user", ["time_since_last_user_txn"])
_feature_subset("time_since_org", ["time_since_last_org_txn"])
_feature_subset("rolling_sum_24h_org", ["rolling_sum_24hr_org"])
_feature_subset("rolling_max_24h_org", ["rolling_max_24hr_org"])
_feature_subset("rolling_avg_24h_user", ["rolling_avg_24hr_user"])
_feature_subset("rolling_count_24h_user", ["rolling_count_24hr_user"])
_CALENDAR = ["timestamp", "hour_of_day", "day_of_week", "month", "day_of_month"]


@query("user_amount_stats", _feat_sql("txn_events", "transaction_id, user_avg_amount, user_max_amount"))
def q_user_amount_stats(spark, sf_dir):
    return FE.amount_stats(FX.txn_events(spark, sf_dir), "user_id", "user", MONEY).select("transaction_id", "user_avg_amount", "user_max_amount")


@query("org_amount_stats", _feat_sql("txn_events", "transaction_id, org_avg_amount, org_max_amount"))
def q_org_amount_stats(spark, sf_dir):
    return FE.amount_stats(FX.txn_events(spark, sf_dir), "organization_id", "org", MONEY).select("transaction_id", "org_avg_amount", "org_max_amount")


@query("calendar_features", _feat_sql("txn_events", "transaction_id, " + ", ".join(_CALENDAR)))
def q_calendar_features(spark, sf_dir):
    return FE.add_calendar_features(FX.txn_events(spark, sf_dir)).select("transaction_id", *_CALENDAR)


_feature_subset("amount_ratio_serve", ["amount_to_user_avg_ratio"], "txn_events")


@query("amount_ratio_train", _feat_sql("txn_events", "transaction_id, amount_to_user_avg_ratio", ratio="training"))
def q_amount_ratio_train(spark, sf_dir):
    return _features(spark, sf_dir, ratio="training").select("transaction_id", "amount_to_user_avg_ratio")


@query("rolling_order_key", O.with_views("txn_orders") + """
SELECT transaction_id,
  row_number() OVER (PARTITION BY organization_id ORDER BY date, transaction_id) - 1 AS ordinal,
  epoch_us(date) * 1000 + row_number() OVER (PARTITION BY organization_id ORDER BY date, transaction_id) - 1
    AS order_key_ns
FROM txn_orders""")
def q_rolling_order_key(spark, sf_dir):
    t = FX.txn_orders(spark, sf_dir)
    return FE.rolling_order_key(t, "organization_id").select("transaction_id", "ordinal", "order_key_ns")


@query("iso_dates", O.with_views("txn_events") + f"""
SELECT transaction_id, CAST(CAST(date AS DATE) AS VARCHAR) AS date_text, {O.iso_sql('date')} AS iso_text
FROM txn_events""")
def q_iso_dates(spark, sf_dir):
    t = FX.txn_events(spark, sf_dir)
    return t.select("transaction_id", S.date_string("date").alias("date_text"),
                    S.iso_timestamp("date").alias("iso_text"))


# ===========================================================================
# Dashboard aggregates and sorts
# ===========================================================================

@query("summary_kpi", O.with_views("txn_events") + """
SELECT count(*) AS total_transactions, CAST(coalesce(sum(is_fraud), 0) AS BIGINT) AS total_fraud,
  CASE WHEN count(*) > 0 THEN round_even(100.0::DOUBLE * CAST(coalesce(sum(is_fraud), 0) AS BIGINT) / count(*), 2)
       ELSE 0.0 END AS fraud_rate
FROM txn_events""")
def q_summary(spark, sf_dir):
    return D.summary(FX.txn_events(spark, sf_dir))


@query("daily_volume", O.with_views("txn_events") + """
SELECT CAST(CAST(date AS DATE) AS VARCHAR) AS date, round(sum(amount), 2) AS amount
FROM txn_events GROUP BY 1""")
def q_daily_volume(spark, sf_dir):
    dv = D.daily_volume(FX.txn_events(spark, sf_dir))
    return dv.select("date", F.round("amount", 2).alias("amount"))


@query("fraud_by_type", O.with_views("txn_events") + """
SELECT transaction_type, CAST(sum(is_fraud) AS BIGINT) AS is_fraud FROM txn_events GROUP BY 1""")
def q_fraud_by_type(spark, sf_dir):
    return D.fraud_by_type(FX.txn_events(spark, sf_dir))


@query("latest_transactions", O.with_views("txn_events") + f"""
SELECT transaction_id, amount, {O.iso_sql('date')} AS date, user_id, organization_id, transaction_type, is_fraud
FROM txn_events ORDER BY date DESC NULLS LAST, transaction_id DESC LIMIT 10""")
def q_latest(spark, sf_dir):
    lt = D.latest_transactions(FX.txn_events(spark, sf_dir))
    return lt.select("transaction_id", "amount", S.iso_timestamp("date").alias("date"), "user_id",
                     "organization_id", "transaction_type", "is_fraud")


@query("renumber_by_date", O.with_views("txn_orders") + """
SELECT transaction_id, row_number() OVER (ORDER BY date, transaction_id) - 1 AS row_number FROM txn_orders""")
def q_renumber(spark, sf_dir):
    t = FX.txn_orders(spark, sf_dir).withColumn("_us", F.unix_micros("date"))
    return M.renumber_by(t, "_us", "transaction_id").select("transaction_id", "row_number")


@query("org_filter", O.with_views("txn_orders") + """
SELECT transaction_id, amount, organization_id FROM txn_orders WHERE organization_id = 7""")
def q_org_filter(spark, sf_dir):
    return D.for_organization(FX.txn_orders(spark, sf_dir), 7).select("transaction_id", "amount", "organization_id")


@query("pseudo_org_filter", O.with_views("txn_events") + """
SELECT transaction_id, organization_id FROM txn_events WHERE organization_id = 107 % 100""")
def q_pseudo_org(spark, sf_dir):
    return D.pseudo_org_filter(FX.txn_events(spark, sf_dir), 107).select("transaction_id", "organization_id")


def _filter_or_head(spark, sf_dir, org):
    t = FX.txn_events(spark, sf_dir)
    return D.filter_or_head(D.pseudo_org_filter(t, org), t).select("transaction_id", "organization_id")


_FOH_SQL = O.with_views("txn_events") + """,
hit AS (SELECT * FROM txn_events WHERE organization_id = {org} % 100)
SELECT transaction_id, organization_id FROM hit
UNION ALL
SELECT transaction_id, organization_id FROM (
  SELECT * FROM txn_events ORDER BY date, transaction_id LIMIT 100) h
WHERE NOT EXISTS (SELECT 1 FROM hit)"""


@query("filter_or_head_hit", _FOH_SQL.format(org=103))
def q_foh_hit(spark, sf_dir):
    return _filter_or_head(spark, sf_dir, 103)


@query("filter_or_head_miss", _FOH_SQL.format(org=150))
def q_foh_miss(spark, sf_dir):
    return _filter_or_head(spark, sf_dir, 150)


_DIR_SQL = O.with_views("org_directory_raw") + """,
dir AS (SELECT lower(slug) AS slug, id, coalesce(name, 'Unknown') AS name FROM org_directory_raw
        WHERE coalesce(slug, '') <> '' AND id IS NOT NULL AND id <> 0)"""


def _directory(spark, sf_dir):
    return IN.load_org_directory(FX.org_directory_raw(spark, sf_dir), order_col="id")


@query("org_directory", _DIR_SQL + "\nSELECT slug, id, name FROM dir")
def q_org_directory(spark, sf_dir):
    return _directory(spark, sf_dir)


@query("resolve_org", _DIR_SQL + "\nSELECT slug, id, name FROM dir WHERE slug = lower(trim('  Nation-7 '))")
def q_resolve_org(spark, sf_dir):
    return D.resolve_org(_directory(spark, sf_dir), "  Nation-7 ")


@query("resolve_org_missing", _DIR_SQL + """
SELECT 'Organization ''atlantis'' not found.' AS message,
       array_to_string(list_sort(list(slug)), ',') AS available_organizations
FROM dir HAVING NOT bool_or(slug = 'atlantis')""")
def q_resolve_org_missing(spark, sf_dir):
    nf = D.org_not_found(_directory(spark, sf_dir), "atlantis")
    return nf.select("message", F.array_join("available_organizations", ",").alias("available_organizations"))


@query("org_listing", _DIR_SQL + """,
t AS (SELECT slug, id, list_transform(string_split(replace(slug, '-', ' '), ''), lambda ch, i:
        CASE WHEN i = 1 THEN upper(ch)
             WHEN upper(string_split(replace(slug, '-', ' '), '')[i - 1]) = lower(string_split(replace(slug, '-', ' '), '')[i - 1])
             THEN upper(ch) ELSE lower(ch) END) AS chars FROM dir)
SELECT slug, id, array_to_string(chars, '') AS name, (SELECT count(*) FROM dir) AS total FROM t""")
def q_org_listing(spark, sf_dir):
    return D.org_listing(_directory(spark, sf_dir))


@query("display_rows", O.with_views("txn_events") + """
SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, printf('$%.2f', amount) AS amount,
  strftime(date, '%-m/%-d/%Y') AS date, CAST(user_id AS VARCHAR) AS user_id,
  CAST(organization_id AS VARCHAR) AS organization_id, transaction_type,
  CASE is_fraud WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE 'N/A' END AS is_fraud, 'N/A' AS fraud_probability
FROM (SELECT * FROM txn_events ORDER BY date DESC NULLS LAST, transaction_id DESC LIMIT 10) l""")
def q_display_rows(spark, sf_dir):
    return D.display_rows(D.latest_transactions(FX.txn_events(spark, sf_dir)))


# ===========================================================================
# Ingest (S1–S7, U1) and the display join
# ===========================================================================

_CLEAN_SQL = O.with_views("txn_dirty") + """,
c AS (SELECT row_id, transaction_id, TRY_CAST(amount AS DOUBLE) AS amount, TRY_CAST(date AS TIMESTAMP) AS date,
        user_id, organization_id, product_id, merchant_id, transaction_type, device_type, location_country, is_fraud
      FROM txn_dirty)"""


@query("clean_processor", _CLEAN_SQL + f"""
SELECT row_id, transaction_id, amount, {O.iso_sql('date')} AS date, organization_id FROM c
WHERE amount IS NOT NULL AND date IS NOT NULL AND transaction_id IS NOT NULL AND organization_id IS NOT NULL""")
def q_clean_processor(spark, sf_dir):
    c = IN.clean_processor(FX.txn_dirty(spark, sf_dir))
    return c.select("row_id", "transaction_id", "amount", S.iso_timestamp("date").alias("date"), "organization_id")


@query("clean_ingest", _CLEAN_SQL + f"""
SELECT row_id, transaction_id, coalesce(amount, 0.0) AS amount, {O.iso_sql('date')} AS date, organization_id FROM c
WHERE date IS NOT NULL AND transaction_id IS NOT NULL AND organization_id IS NOT NULL""")
def q_clean_ingest(spark, sf_dir):
    c = IN.clean_ingest(FX.txn_dirty(spark, sf_dir))
    return c.select("row_id", "transaction_id", "amount", S.iso_timestamp("date").alias("date"), "organization_id")


@query("default_missing_columns", O.with_views("txn_events") + f"""
SELECT transaction_id, amount, {O.iso_sql('date')} AS date, user_id, CAST(-1 AS BIGINT) AS organization_id,
  CAST(-1 AS BIGINT) AS product_id, CAST(-1 AS BIGINT) AS merchant_id, 'unknown' AS transaction_type,
  'unknown' AS device_type, 'unknown' AS location_country, CAST(0 AS INT) AS is_fraud
FROM txn_events""")
def q_default_missing(spark, sf_dir):
    t = FX.txn_events(spark, sf_dir).select("transaction_id", "amount", "date", "user_id")
    d = IN.with_required_columns(t)
    return d.select(*[S.iso_timestamp("date").alias("date") if c == "date" else F.col(c) for c in RAW_COLUMNS])


@query("display_join", _CLEAN_SQL + """,
ok AS (SELECT * FROM c WHERE amount IS NOT NULL AND date IS NOT NULL AND transaction_id IS NOT NULL
       AND organization_id IS NOT NULL),""" + O.features_ctes("ok", passthrough="row_id, amount") + """
SELECT d.row_id, d.transaction_id, d.amount, d.date, d.organization_id, f.rolling_sum_24hr_org,
  f.time_since_last_user_txn, f.user_avg_amount, f.amount_to_user_avg_ratio
FROM txn_dirty d LEFT JOIN featr f ON d.row_id = f.row_id""")
def q_display_join(spark, sf_dir):
    j = D.display_frame(FX.txn_dirty(spark, sf_dir), amount_scale=MONEY)
    return j.select("row_id", "transaction_id", "amount", "date", "organization_id", "rolling_sum_24hr_org",
                    "time_since_last_user_txn", "user_avg_amount", "amount_to_user_avg_ratio")


@query("summary_kpi_display", O.with_views("txn_dirty") + """
SELECT count(*) AS total_transactions, CAST(coalesce(sum(is_fraud), 0) AS BIGINT) AS total_fraud,
  CASE WHEN count(*) > 0 THEN round_even(100.0::DOUBLE * CAST(coalesce(sum(is_fraud), 0) AS BIGINT) / count(*), 2)
       ELSE 0.0 END AS fraud_rate
FROM txn_dirty""")
def q_summary_display(spark, sf_dir):
    """A1 over the display join: rows dropped by cleaning still count."""
    raw = FX.txn_dirty(spark, sf_dir)
    feats = FE.engineer_features(IN.clean_processor(raw), amount_scale=MONEY)
    return D.summary(D.display_join(raw, feats))


def _ph_sql(key: str) -> dict[str, str]:
    return {
        "user": f"(({O.md5_int(f'{SEED}:user', key)}) % 999 + 1)",
        "product": f"(({O.md5_int(f'{SEED}:product', key)}) % 19 + 1)",
        "merchant": f"(({O.md5_int(f'{SEED}:merchant', key)}) % 999 + 1)",
        "device": f"(['mobile', 'desktop', 'tablet'])[({O.md5_int(f'{SEED}:device', key)}) % 3 + 1]",
        "country": f"(['USA', 'CAN', 'GBR', 'AUS', 'DEU', 'FRA'])[({O.md5_int(f'{SEED}:country', key)}) % 6 + 1]",
    }


_PH = _ph_sql("id")
_MAPPED_SQL = O.with_views("api_records") + f""",
mapped AS (SELECT CAST(id AS VARCHAR) AS transaction_id, coalesce(CAST(amount_cents AS DOUBLE), 0.0) / 100.0::DOUBLE AS amount,
  date_text AS date, CAST(coalesce(creator_id, {_PH['user']}) AS VARCHAR) AS user_id, org_id AS organization_id,
  {_PH['product']} AS product_id, CAST(coalesce(merchant_id, {_PH['merchant']}) AS VARCHAR) AS merchant_id,
  coalesce(type, 'unknown') AS transaction_type, {_PH['device']} AS device_type,
  {_PH['country']} AS location_country, CAST(0 AS INT) AS is_fraud, org_id, page
  FROM api_records)"""


def _all_records(spark, sf_dir, error_rule=False, limit=None, **kinds):
    pages = FX.api_pages(spark, sf_dir, error_rule=error_rule, **kinds)
    return IN.read_transaction_pages(pages, limit=limit)


@query("map_api_records", _MAPPED_SQL + "\nSELECT " + ", ".join(RAW_COLUMNS) + " FROM mapped")
def q_map_api_records(spark, sf_dir):
    return IN.map_api_records(_all_records(spark, sf_dir))


@query("hash_placeholders", O.with_views("api_records") + f"""
SELECT CAST(id AS VARCHAR) AS transaction_id, {_PH['user']} AS user_id, {_PH['product']} AS product_id,
  {_PH['merchant']} AS merchant_id, {_PH['device']} AS device_type, {_PH['country']} AS location_country
FROM api_records""")
def q_hash_placeholders(spark, sf_dir):
    recs = _all_records(spark, sf_dir)
    ph = IN.hash_placeholders(F.col("rec.id"))
    return recs.select(F.col("rec.id").alias("transaction_id"), *[ph[c].alias(c) for c in
                       ["user_id", "product_id", "merchant_id", "device_type", "location_country"]])


_PAGES_SQL = O.with_views("api_records") + """,
pg AS (SELECT org_id, page, count(*) AS n, {bad} AS bad FROM api_records GROUP BY org_id, page),
pf AS (SELECT * FROM pg WHERE page <= {max_page}),
pw AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY page) AS rn,
         coalesce(sum(CASE WHEN bad OR n < 100 THEN 1 ELSE 0 END) OVER (PARTITION BY org_id ORDER BY page
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops_before,
         coalesce(sum(CASE WHEN bad THEN 0 ELSE n END) OVER (PARTITION BY org_id ORDER BY page
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fetched_before
       FROM pf),
pr AS (SELECT *, (page = rn AND stops_before = 0 AND fetched_before < {limit}) AS reached FROM pw),
bad_orgs AS (SELECT DISTINCT org_id FROM pr WHERE reached AND bad),
keep AS (SELECT org_id, page FROM pr WHERE reached AND NOT bad AND n > 0
         AND org_id NOT IN (SELECT org_id FROM bad_orgs))
SELECT r.org_id, r.page, {prefix}CAST(r.id AS VARCHAR) AS transaction_id FROM api_records r JOIN keep k ON r.org_id = k.org_id AND r.page = k.page"""


def _pages_sql(bad: str = "false", limit: int | None = None, prefix: str = "") -> str:
    cap = 2**62 if limit is None else limit
    return _PAGES_SQL.format(bad=bad, max_page=(cap - 1) // 100 + 1, limit=cap, prefix=prefix)


def _read_pages(records):
    return records.select("org_id", "page", F.col("rec.id").alias("transaction_id"))


@query("ingest_page_cap", _pages_sql(limit=250))
def q_page_cap(spark, sf_dir):
    return _read_pages(_all_records(spark, sf_dir, limit=250))


@query("ingest_all_or_nothing", _pages_sql("(org_id % 7 = 3 AND page = 2)"))
def q_all_or_nothing(spark, sf_dir):
    return _read_pages(_all_records(spark, sf_dir, error_rule=True))


@query("ingest_text_ids", _pages_sql(prefix="'txn_' || "))
def q_text_ids(spark, sf_dir):
    """Ids that are no numbers survive mapping and cleaning."""
    clean = IN.clean_ingest(IN.map_api_records(recs := _all_records(spark, sf_dir, text_ids=True)).select("*"))
    return _read_pages(recs.join(clean.select(F.col("transaction_id").alias("_id")), F.col("rec.id") == F.col("_id"), "left_semi"))


@query("ingest_truncated_page", _pages_sql("(org_id % 5 = 2 AND page = 2)"))
def q_truncated_page(spark, sf_dir):
    """A page whose end is missing makes its organization unreadable."""
    return _read_pages(_all_records(spark, sf_dir, cut_rule=True))


@query("ingest_relanded_page", _pages_sql())
def q_relanded_page(spark, sf_dir):
    """Pages that landed before, some of them empty or broken then, count once, as they landed last."""
    pages = FX.api_pages(spark, sf_dir, error_rule=False)
    stale = pages.withColumn("payload", F.when(F.col("page") == 1, F.lit("[]")).when(F.col("page") == 2, F.lit("{}")).otherwise(F.col("payload")))
    return _read_pages(IN.read_transaction_pages(IN.union_pages(stale, pages)))


@query("union_pages", O.with_views("api_records") + """
SELECT org_id, page, count(*) AS n_records FROM api_records GROUP BY org_id, page""")
def q_union_pages(spark, sf_dir):
    pages = FX.api_pages(spark, sf_dir, error_rule=False)
    batches = IN.union_pages(pages.filter(F.col("org_id") < 10), pages.filter(F.col("org_id") >= 10))
    return IN.page_table(batches).select("org_id", "page", F.col("n").alias("n_records"))


# ===========================================================================
# Weak labels, cohort and order statistics
# ===========================================================================

_COHORT_SQL = O.with_views("txn_events") + f""",
u AS (SELECT DISTINCT user_id, {O.md5_int(f'{SEED}:cohort', 'user_id', 15)} AS h FROM txn_events WHERE user_id IS NOT NULL),
ur AS (SELECT user_id, row_number() OVER (ORDER BY h, user_id) AS rn, count(*) OVER () AS n FROM u),
cohort AS (SELECT user_id FROM ur WHERE rn <= CAST(floor(n * 0.01) AS BIGINT))"""


@query("fraud_cohort", _COHORT_SQL + "\nSELECT user_id FROM cohort")
def q_fraud_cohort(spark, sf_dir):
    return L.fraud_cohort(FX.txn_events(spark, sf_dir))


@query("cohort_semi", _COHORT_SQL + """
SELECT transaction_id, user_id FROM txn_events WHERE user_id IN (SELECT user_id FROM cohort)""")
def q_cohort_semi(spark, sf_dir):
    t = FX.txn_events(spark, sf_dir)
    inside = L.cohort_predicate(t)     # None only if two hashes tie at the cut
    rows = L.cohort_rows(t, L.fraud_cohort(t)) if inside is None else t.filter(inside)
    return rows.select("transaction_id", "user_id")


@query("amount_p95", O.with_views("txn_events") + """
SELECT quantile_cont(amount, 0.95) AS p95 FROM txn_events""")
def q_amount_p95(spark, sf_dir):
    t = FX.txn_events(spark, sf_dir)
    return t.agg(F.count(F.lit(1))).select(F.lit(L.amount_quantile(t)).cast(T.DoubleType()).alias("p95"))


@query("label_rate", O.with_views("txn_events") + "\nSELECT avg(is_fraud) AS fraud_rate FROM txn_events")
def q_label_rate(spark, sf_dir):
    return L.label_rate(FX.txn_events(spark, sf_dir))


def _thr(frac: float) -> str:
    return S.hash_threshold_hex(frac)


@query("label_base_rate", O.with_views("txn_events") + f"""
SELECT transaction_id, CAST({O.md5_prefix(f'{SEED}:base', 'transaction_id')} < '{_thr(0.0179)}' AS INT) AS base_flag
FROM txn_events""")
def q_label_base(spark, sf_dir):
    t = FX.txn_events(spark, sf_dir)
    return t.select("transaction_id", L.base_rate_flag().cast(T.IntegerType()).alias("base_flag"))


_TAIL = f"{O.md5_prefix(f'{SEED}:tail', 'transaction_id')} < '{_thr(L.tail_draw_fraction())}'"


@query("label_amount_tail", O.with_views("txn_events") + f""",
p AS (SELECT quantile_cont(amount, 0.95) AS p95 FROM txn_events)
SELECT transaction_id FROM txn_events, p WHERE amount > p95 AND {_TAIL}""")
def q_label_tail(spark, sf_dir):
    t = FX.txn_events(spark, sf_dir)
    return t.filter(L.amount_tail_flag(L.amount_quantile(t))).select("transaction_id")


_RELABEL = f"CAST({O.md5_prefix(f'{SEED}:relabel', 'transaction_id')} < '{_thr(0.5)}' AS INT)"


@query("label_cohort_override", _COHORT_SQL + f"""
SELECT transaction_id, {_RELABEL} AS is_fraud FROM txn_events WHERE user_id IN (SELECT user_id FROM cohort)""")
def q_label_cohort(spark, sf_dir):
    t = FX.txn_events(spark, sf_dir)
    return L.cohort_rows(t, L.fraud_cohort(t)).select("transaction_id", L.cohort_label().alias("is_fraud"))


_WEAK_SQL = _COHORT_SQL + f""",
p AS (SELECT quantile_cont(amount, 0.95) AS p95 FROM txn_events),
wl AS (SELECT t.*, CASE WHEN t.user_id IN (SELECT user_id FROM cohort) THEN {_RELABEL}
    ELSE CAST(({O.md5_prefix(f'{SEED}:base', 'transaction_id')} < '{_thr(0.0179)}')
              OR (amount > p95 AND {_TAIL}) AS INT) END AS wl_fraud
  FROM txn_events t, p)"""


@query("weak_labels", _WEAK_SQL + "\nSELECT transaction_id, wl_fraud AS is_fraud FROM wl")
def q_weak_labels(spark, sf_dir):
    return L.weak_labels(FX.txn_events(spark, sf_dir)).select("transaction_id", "is_fraud")


# ===========================================================================
# Evaluation metrics (A9–A13) over rule-based scores
# ===========================================================================

_SCORED_SQL = O.with_views("txn_events") + """,
s AS (SELECT is_fraud AS label, floor(amount / 10) AS score, CAST(amount > 120 AS INT) AS prediction FROM txn_events),
pts AS (SELECT score AS threshold, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
          sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM s GROUP BY score),
cum AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
          sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM pts),
c2 AS (SELECT *, tp - pos AS prev_tp, fp - neg AS prev_fp FROM cum)"""


def _scored(spark, sf_dir):
    t = FX.txn_events(spark, sf_dir)
    return t.select(F.col("is_fraud").alias("label"), F.floor(F.col("amount") / 10).cast(T.DoubleType()).alias("score"),
                    (F.col("amount") > 120).cast(T.IntegerType()).alias("prediction"))


@query("roc_auc", _SCORED_SQL + """
SELECT CAST(CAST(sum(neg * (2 * prev_tp + pos)) AS HUGEINT) AS DOUBLE) / (CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE) * 2.0::DOUBLE)
  AS roc_auc FROM c2""")
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(_scored(spark, sf_dir))


def _prec(tp: str, fp: str) -> str:
    return f"CASE WHEN {tp} + {fp} = 0 THEN 1.0::DOUBLE ELSE CAST({tp} AS DOUBLE) / CAST({tp} + {fp} AS DOUBLE) END"


@query("pr_auc", _SCORED_SQL + f"""
SELECT round(sum((CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) - CAST(prev_tp AS DOUBLE) / CAST(P AS DOUBLE))
  * ({_prec('tp', 'fp')} + {_prec('prev_tp', 'prev_fp')}) / 2.0::DOUBLE), 10) AS pr_auc FROM c2""")
def q_pr_auc(spark, sf_dir):
    return M.pr_auc(_scored(spark, sf_dir)).select(F.round("pr_auc", 10).alias("pr_auc"))


@query("pr_curve", _SCORED_SQL + f"""
SELECT CAST(threshold AS DOUBLE) AS threshold, {_prec('tp', 'fp')} AS precision,
  CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) AS recall FROM c2
UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE""")
def q_pr_curve(spark, sf_dir):
    return M.pr_curve(_scored(spark, sf_dir))


_REPORT_SQL = _SCORED_SQL + """,
k AS (SELECT sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp1,
             sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS fp1,
             sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS fn1,
             sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS tp0 FROM s),
b AS (SELECT *,
   CASE WHEN tp0 + fn1 = 0 THEN 0.0 ELSE CAST(tp0 AS DOUBLE) / CAST(tp0 + fn1 AS DOUBLE) END AS p0,
   CASE WHEN tp0 + fp1 = 0 THEN 0.0 ELSE CAST(tp0 AS DOUBLE) / CAST(tp0 + fp1 AS DOUBLE) END AS r0,
   CASE WHEN tp1 + fp1 = 0 THEN 0.0 ELSE CAST(tp1 AS DOUBLE) / CAST(tp1 + fp1 AS DOUBLE) END AS p1,
   CASE WHEN tp1 + fn1 = 0 THEN 0.0 ELSE CAST(tp1 AS DOUBLE) / CAST(tp1 + fn1 AS DOUBLE) END AS r1,
   CAST(tp0 + fp1 AS BIGINT) AS s0, CAST(tp1 + fn1 AS BIGINT) AS s1, tp0 + tp1 AS ok FROM k),
b2 AS (SELECT *, CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE 2.0::DOUBLE * p0 * r0 / (p0 + r0) END AS f0,
   CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE 2.0::DOUBLE * p1 * r1 / (p1 + r1) END AS f1, s0 + s1 AS n FROM b)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM b2
UNION ALL SELECT '1', p1, r1, f1, s1 FROM b2
UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN n = 0 THEN 0.0 ELSE CAST(ok AS DOUBLE) / CAST(n AS DOUBLE) END, n FROM b2
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM b2
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM b2"""


@query("classification_report", _REPORT_SQL)
def q_classification_report(spark, sf_dir):
    return M.classification_report(_scored(spark, sf_dir))


@query("class_weights", O.with_views("txn_events") + """
SELECT is_fraud, CAST(sum(count(*)) OVER () AS DOUBLE) / (CAST(count(*) OVER () AS DOUBLE) * CAST(count(*) AS DOUBLE))
  AS class_weight FROM txn_events GROUP BY is_fraud""")
def q_class_weights(spark, sf_dir):
    t = FX.txn_events(spark, sf_dir)
    return ML.with_class_weight(t).select("is_fraud", "class_weight").distinct()


# ===========================================================================
# Model pipeline (M1–M9, P2) — split/scale/index checked in SQL, fits rows-only
# ===========================================================================

@query("model_input", _feat_sql("txn_events", ", ".join(
    [c for c in O._PASS.split(", ") if c not in ("transaction_id", "is_fraud")]) + ", " + O.FEATURE_COLUMNS))
def q_model_input(spark, sf_dir):
    return ML.model_input(_features(spark, sf_dir))


@query("stratified_split", _WEAK_SQL + f""",
h AS (SELECT transaction_id, wl_fraud, {O.md5_int(f'{SEED}:split', 'transaction_id', 15)} AS h FROM wl),
cnt AS (SELECT wl_fraud, count(*) AS nc, sum(count(*)) OVER () AS n FROM h GROUP BY wl_fraud),
alloc0 AS (SELECT wl_fraud, nc, n, CAST(ceil(0.3 * n) AS BIGINT) AS nt,
    CAST(ceil(0.3 * n) AS BIGINT) * nc / CAST(n AS DOUBLE) AS share FROM cnt),
alloc1 AS (SELECT *, CAST(floor(share) AS BIGINT) AS fl, share - floor(share) AS frac FROM alloc0),
alloc2 AS (SELECT *, nt - sum(fl) OVER () AS rest,
    row_number() OVER (ORDER BY frac DESC, nc DESC, wl_fraud) AS pri FROM alloc1),
alloc AS (SELECT wl_fraud, fl + CASE WHEN pri <= rest THEN 1 ELSE 0 END AS t FROM alloc2),
r AS (SELECT h.*, row_number() OVER (PARTITION BY h.wl_fraud ORDER BY h.h) AS rn FROM h)
SELECT r.transaction_id, CASE WHEN r.rn <= a.t THEN 'test' ELSE 'train' END AS split
FROM r JOIN alloc a ON r.wl_fraud = a.wl_fraud""")
def q_stratified_split(spark, sf_dir):
    wl = L.weak_labels(FX.txn_events(spark, sf_dir))
    return ML.stratified_split(wl).select("transaction_id", "split")


@query("standard_scale", _feat_sql("txn_events", "transaction_id, " + ", ".join(
    f"round(CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END, 6)"
    f" AS {c}_scaled" for c in NUMERIC_FEATURES)))
def q_standard_scale(spark, sf_dir):
    """M2: every numeric column of the model, scaled by its mean and deviation over all rows."""
    s = ML.standard_scale(materialize(_features(spark, sf_dir)), NUMERIC_FEATURES)
    return s.select("transaction_id", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in NUMERIC_FEATURES])


@query("category_index", O.with_views("txn_events") + """
SELECT transaction_type, CAST(dense_rank() OVER (ORDER BY transaction_type) - 1 AS DOUBLE) AS category_index
FROM (SELECT DISTINCT transaction_type FROM txn_events) d""")
def q_category_index(spark, sf_dir):
    from pyspark.ml.feature import StringIndexer
    t = FX.txn_events(spark, sf_dir)
    model = StringIndexer(inputCol="transaction_type", outputCol="category_index",
                          handleInvalid="keep", stringOrderType="alphabetAsc").fit(t)
    return model.transform(t.select("transaction_type").distinct())


_LEVELS = "\nUNION ALL ".join(
    f"SELECT {i} AS o, '{c}' AS feature, CAST({c} AS VARCHAR) AS level FROM t" for i, c in enumerate(CATEGORICAL_FEATURES))
_DICTIONARY_SQL = O.with_views("txn_events") + f""",
t AS (SELECT *, hour(date) AS hour_of_day, isodow(date) - 1 AS day_of_week, month(date) AS month, day(date) AS day_of_month FROM txn_events),
entries AS (SELECT DISTINCT * FROM ({_LEVELS}) u WHERE level IS NOT NULL),
dictionary AS (SELECT feature, level, CAST(row_number() OVER (PARTITION BY o ORDER BY level) - 1 AS BIGINT) AS index,
                      CAST(row_number() OVER (ORDER BY o, level) - 1 AS BIGINT) AS place FROM entries)
"""


def _dictionary(spark, sf_dir):
    t = FE.add_calendar_features(FX.txn_events(spark, sf_dir))
    return t, DI.build_dictionary(t, CATEGORICAL_FEATURES)


@query("category_dictionary", _DICTIONARY_SQL + "SELECT feature, level, index, place FROM dictionary")
def q_category_dictionary(spark, sf_dir):
    return _dictionary(spark, sf_dir)[1].levels


@query("one_hot_places", _DICTIONARY_SQL + "SELECT transaction_id, array_to_string(list_sort(list(place)), ',') AS places FROM (\n" + "\nUNION ALL ".join(
    f"SELECT t.transaction_id, d.place FROM t JOIN dictionary d ON d.feature = '{c}' AND d.level = CAST(t.{c} AS VARCHAR)" for c in CATEGORICAL_FEATURES) + ") e GROUP BY transaction_id")
def q_one_hot_places(spark, sf_dir):
    t, dictionary = _dictionary(spark, sf_dir)
    return DI.with_places(t, dictionary, "hot").select("transaction_id", F.array_join(F.col("hot").cast("array<string>"), ",").alias("places"))


@query("table_model_gradient", _DICTIONARY_SQL + """
SELECT feature, count(*) AS levels, 0.0::DOUBLE AS gradient FROM dictionary WHERE feature IN ('user_id', 'transaction_type', 'device_type') GROUP BY feature
UNION ALL SELECT 'amount', 1, 0.0::DOUBLE FROM (SELECT 1 FROM t LIMIT 1) x
UNION ALL SELECT '(intercept)', 1, 0.0::DOUBLE FROM (SELECT 1 FROM t LIMIT 1) x""")
def q_table_model_gradient(spark, sf_dir):
    """M5 with its coefficients as a table: per feature the coefficients fitted and the largest gradient left at the optimum (of the mean loss, to 3 places)."""
    t = FX.txn_events(spark, sf_dir)
    model = LG.fit_table_model(t, numeric=["amount"], categorical=["user_id", "transaction_type", "device_type"], tolerance=3e-4)
    return model.named().groupBy("feature").agg(F.count("*").alias("levels"), F.round(F.max(F.abs("gradient")) / t.select(F.count("*")).scalar(), 3).alias("gradient"))


def _train_test(spark, sf_dir):
    # the windowed features and the final split are each read by several passes
    # (quantile, cohort, class cut-offs, every solver iteration): write them once
    # as tables under the checkpoint folder. The labels in between are cheap
    # column expressions over the written features and are not stored.
    feats = materialize(_features(spark, sf_dir, ratio="training"))
    return materialize(ML.stratified_split(L.weak_labels(feats)))


@query("fit_predict")
def q_fit_predict(spark, sf_dir):
    split = _train_test(spark, sf_dir)
    model = ML.fit_model(split.filter(F.col("split") == "train").drop("split"))
    test = split.filter(F.col("split") == "test").drop("split")
    return ML.fraud_probability(model, test).select("transaction_id", "is_fraud", "prediction", "fraud_probability")


@query("fraud_probability")
def q_fraud_probability(spark, sf_dir):
    """M7: P(fraud) of every held-out row (rows-only: depends on the solver)."""
    return q_fit_predict(spark, sf_dir).select("transaction_id", "fraud_probability")


@query("evaluate_model")
def q_evaluate_model(spark, sf_dir):
    pred = materialize(q_fit_predict(spark, sf_dir))     # scored once for the report and both curves
    scored = pred.select(F.col("is_fraud").alias("label"), F.col("fraud_probability").alias("score"),
                         "prediction")
    report = M.classification_report(scored)
    aucs = M.roc_auc(scored).select(F.lit("roc_auc").alias("class"), F.col("roc_auc").alias("f1_score")) \
        .unionByName(M.pr_auc(scored).select(F.lit("pr_auc").alias("class"), F.col("pr_auc").alias("f1_score")))
    return report.unionByName(aucs, allowMissingColumns=True)


@query("score_latest")
def q_score_latest(spark, sf_dir):
    split = _train_test(spark, sf_dir)
    model = ML.fit_model(split.filter(F.col("split") == "train").drop("split"))
    clean = IN.clean_processor(FX.txn_events(spark, sf_dir))
    return ML.score_latest(clean, model).select("transaction_id", "date", "amount", "fraud_probability")


@query("top_risks")
def q_top_risks(spark, sf_dir):
    pred = q_fit_predict(spark, sf_dir)
    return D.top_risks(pred).select("transaction_id", "fraud_probability")


#: Coefficients over three features, so that scores can be checked in SQL.
FIXED = ML.FixedModel(-1.5, {"amount": 0.002, "rolling_count_24hr_user": 0.3, "amount_to_user_avg_ratio": -0.25})
_FIXED_P = ("1.0::DOUBLE / (1.0::DOUBLE + exp(-(" + " + ".join([f"({FIXED.intercept}::DOUBLE)"] + [f"({w}::DOUBLE) * coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE)"
            for c, w in FIXED.weights.items()]) + ")))")


@query("score_fixed", _feat_sql("txn_events", f"transaction_id, CAST({_FIXED_P} > 0.5 AS INT) AS prediction, round({_FIXED_P}, 6) AS fraud_probability"))
def q_score_fixed(spark, sf_dir):
    """Hard prediction and probability of every row, by its own id."""
    return ML.fraud_probability(FIXED, _features(spark, sf_dir)).select("transaction_id", "prediction", F.round("fraud_probability", 6).alias("fraud_probability"))


@query("top_risks_fixed", _feat_sql("txn_events", f"transaction_id, round({_FIXED_P}, 6) AS fraud_probability") + f" ORDER BY {_FIXED_P} DESC, transaction_id LIMIT 10")
def q_top_risks_fixed(spark, sf_dir):
    return D.top_risks(ML.fraud_probability(FIXED, _features(spark, sf_dir))).select("transaction_id", F.round("fraud_probability", 6).alias("fraud_probability"))


@query("score_latest_fixed", "SELECT transaction_id, fraud_probability FROM (" + _feat_sql("txn_events", f"transaction_id, round({_FIXED_P}, 6) AS fraud_probability")
       + ") JOIN (" + O.with_views("txn_events") + " SELECT transaction_id FROM txn_events ORDER BY date DESC NULLS LAST, transaction_id DESC LIMIT 10) USING (transaction_id)")
def q_score_latest_fixed(spark, sf_dir):
    """M9: the ten latest rows with the features they have among all rows."""
    latest = ML.score_latest(FX.txn_events(spark, sf_dir), FIXED, amount_scale=MONEY)
    return latest.select("transaction_id", F.round("fraud_probability", 6).alias("fraud_probability"))


@query("latest_dirty", O.with_views("txn_dirty") + """
SELECT row_id, date FROM txn_dirty ORDER BY TRY_CAST(date AS TIMESTAMP) DESC NULLS LAST, transaction_id DESC NULLS LAST, row_id DESC LIMIT 10""")
def q_latest_dirty(spark, sf_dir):
    """L2 over text dates: what is no date comes last."""
    return D.latest_transactions(FX.txn_dirty(spark, sf_dir), seq="row_id").select("row_id", "date")


def _sections(payload):
    """Payload JSON → (section, ordinal, item): what each section lists, in its order."""
    doc = F.from_json("payload", "daily_volume array<struct<date string>>, fraud_by_type array<struct<`transaction.type` string, is_fraud long>>, "
                      "latest_transactions array<struct<transaction_id string>>, ml_predictions struct<available boolean, top_risks array<struct<transaction_id string>>>, "
                      "summary struct<total_transactions long, total_fraud long, fraud_rate double>")
    d = payload.select(doc.alias("d"))
    one = lambda name, items: d.select(F.lit(name).alias("section"), F.posexplode(items).alias("ordinal", "item"))
    return (one("daily_volume", F.transform("d.daily_volume", lambda x: x["date"]))
            .union(one("fraud_by_type", F.transform("d.fraud_by_type", lambda x: F.concat_ws(":", x["transaction.type"], x["is_fraud"]))))
            .union(one("latest_transactions", F.transform("d.latest_transactions", lambda x: x["transaction_id"])))
            .union(one("top_risks", F.transform("d.ml_predictions.top_risks", lambda x: x["transaction_id"])))
            .union(one("summary", F.array(F.concat_ws(":", "d.summary.total_transactions", "d.summary.total_fraud", "d.ml_predictions.available")))))


_LATEST = "(SELECT *, row_number() OVER (ORDER BY date DESC NULLS LAST, transaction_id DESC) - 1 AS place FROM txn_events QUALIFY place < 10)"


@query("payload_sections", O.with_views("txn_events") + ", fixed AS (" + _feat_sql("txn_events", f"transaction_id, {_FIXED_P} AS p") + f"""),
top AS (SELECT l.transaction_id, row_number() OVER (ORDER BY p DESC, l.transaction_id) - 1 AS place FROM {_LATEST} l JOIN fixed USING (transaction_id))
SELECT 'daily_volume' AS section, CAST(row_number() OVER (ORDER BY day) - 1 AS INT) AS ordinal, day AS item FROM (SELECT DISTINCT CAST(CAST(date AS DATE) AS VARCHAR) AS day FROM txn_events)
UNION ALL SELECT 'fraud_by_type', CAST(row_number() OVER (ORDER BY transaction_type) - 1 AS INT), transaction_type || ':' || CAST(sum(is_fraud) AS BIGINT) FROM txn_events GROUP BY transaction_type
UNION ALL SELECT 'latest_transactions', CAST(place AS INT), CAST(transaction_id AS VARCHAR) FROM {_LATEST}
UNION ALL SELECT 'top_risks', CAST(place AS INT), CAST(transaction_id AS VARCHAR) FROM top
UNION ALL SELECT 'summary', 0, count(*) || ':' || CAST(sum(is_fraud) AS BIGINT) || ':true' FROM txn_events""")
def q_payload_sections(spark, sf_dir):
    """S11 with a model: every section's items in order."""
    raw = FX.txn_events(spark, sf_dir).withColumn("row_id", F.col("transaction_id"))
    feats = FE.engineer_features(IN.clean_processor(raw), amount_scale=MONEY)
    return _sections(D.dashboard_payload(raw, "Global", engineered=feats, model=FIXED))


@query("dashboard_payload")
def q_dashboard_payload(spark, sf_dir):
    raw = FX.txn_events(spark, sf_dir).withColumn("row_id", F.col("transaction_id"))
    feats = FE.engineer_features(IN.clean_processor(raw), amount_scale=MONEY)
    return D.dashboard_payload(raw, "Global (Synthetic)", engineered=feats)


def _org_dashboard(spark, sf_dir, name):
    pages = FX.api_pages(spark, sf_dir)
    return D.organization_dashboard(_directory(spark, sf_dir), pages, FX.txn_events(spark, sf_dir), name)


@query("org_dashboard_live")
def q_org_dashboard_live(spark, sf_dir):
    """§3.2 for an organization whose pages are readable (nation-4 → id 4)."""
    return _org_dashboard(spark, sf_dir, "NATION-4")


@query("org_dashboard_fallback")
def q_org_dashboard_fallback(spark, sf_dir):
    """§3.2 for an organization with an error page (id 3): synthetic fallback."""
    return _org_dashboard(spark, sf_dir, "nation-3")


@query("org_dashboard_not_found", _DIR_SQL + """
SELECT CAST(NULL AS VARCHAR) AS payload, '{"message":"Organization ''atlantis'' not found.","available_organizations":["'
  || array_to_string(list_sort(list(slug)), '","') || '"]}' AS not_found
FROM dir HAVING NOT bool_or(slug = 'atlantis')""")
def q_org_dashboard_not_found(spark, sf_dir):
    return _org_dashboard(spark, sf_dir, "atlantis")


def _org_sections_sql(src, context):
    """Every section of one organization's payload; text ids, as landed records have them."""
    return f"""
SELECT 'daily_volume' AS section, CAST(row_number() OVER (ORDER BY day) - 1 AS INT) AS ordinal, day AS item
FROM (SELECT DISTINCT CAST(CAST(date AS DATE) AS VARCHAR) AS day FROM {src})
UNION ALL SELECT 'fraud_by_type', CAST(row_number() OVER (ORDER BY transaction_type) - 1 AS INT), transaction_type || ':' || CAST(sum(is_fraud) AS BIGINT)
FROM {src} GROUP BY transaction_type
UNION ALL SELECT 'latest_transactions', CAST(place AS INT), id FROM (SELECT CAST(transaction_id AS VARCHAR) AS id,
  row_number() OVER (ORDER BY CAST(date AS TIMESTAMP) DESC, CAST(transaction_id AS VARCHAR) DESC) - 1 AS place FROM {src} QUALIFY place < 10)
UNION ALL SELECT 'summary', 0, count(*) || ':' || CAST(sum(is_fraud) AS BIGINT) || ':false' FROM {src}
UNION ALL SELECT 'organization_context', 0, {context}"""


def _org_sections(answer):
    context = answer.select(F.lit("organization_context").alias("section"), F.lit(0).alias("ordinal"),
                            F.get_json_object("payload", "$.organization_context").alias("item"))
    return _sections(answer).union(context)


@query("org_live_sections", _MAPPED_SQL + ", live AS (SELECT * FROM mapped WHERE organization_id = 4)" + _org_sections_sql("live", "'NATION-4'"))
def q_org_live_sections(spark, sf_dir):
    """§3.2 of readable pages: every section's items in order."""
    return _org_sections(_org_dashboard(spark, sf_dir, "NATION-4"))


@query("org_fallback_sections", _MAPPED_SQL + """,
broken AS (SELECT count(*) > 0 AS b FROM api_records WHERE org_id = 3 AND page = 2),
chosen AS (SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, date, transaction_type, is_fraud FROM txn_events, broken WHERE b AND organization_id = 3 % 100
  UNION ALL SELECT transaction_id, CAST(date AS TIMESTAMP), transaction_type, is_fraud FROM mapped, broken WHERE NOT b AND organization_id = 3)"""
       + _org_sections_sql("chosen", "(SELECT CASE WHEN b THEN 'nation-3 (Synthetic)' ELSE 'nation-3' END FROM broken)"))
def q_org_fallback_sections(spark, sf_dir):
    """§3.2 of an organization whose second page, if it has one, is an error page: the synthetic fallback then."""
    return _org_sections(_org_dashboard(spark, sf_dir, "nation-3"))


def queries() -> dict[str, QueryFn]:
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in REGISTRY.items() if e.sql is not None}


__all__ = ["REGISTRY", "queries", "oracle_sql", "DERIVED_FEATURES"]
