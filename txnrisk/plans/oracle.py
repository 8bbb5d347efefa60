"""Independent SQL for every checked query (DuckDB dialect).

The driver registers the raw parquet tables as views; the transaction
fixtures are defined here as CTEs with the exact view text of FIXTURES.md.
Doubles are rounded in the final projection on both sides (sums and ratios
to 4 places) so engine-specific summation order cannot change the hash.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixture views (text shared with FIXTURES.md)
# ---------------------------------------------------------------------------

_VIEWS: dict[str, str] = {
    "txn_events": """
SELECT event_id AS transaction_id, value AS amount, CAST(ts AS TIMESTAMP) AS date, user_id,
       k % 20 AS organization_id, k % 19 + 1 AS product_id, (user_id * 7 + k) % 250 + 1 AS merchant_id,
       event_type AS transaction_type,
       CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_type,
       CASE user_id % 6 WHEN 0 THEN 'USA' WHEN 1 THEN 'CAN' WHEN 2 THEN 'GBR' WHEN 3 THEN 'AUS' WHEN 4 THEN 'DEU' ELSE 'FRA' END AS location_country,
       CAST(CASE WHEN value > 150 OR k % 56 = 0 THEN 1 ELSE 0 END AS INT) AS is_fraud
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) e""",
    "txn_orders": """
SELECT o_orderkey AS transaction_id, o_totalprice AS amount, CAST(o_orderdate AS TIMESTAMP) AS date, o_custkey AS user_id,
       CAST(c_nationkey AS BIGINT) AS organization_id, o_orderkey % 19 + 1 AS product_id, o_custkey % 250 + 1 AS merchant_id,
       o_orderpriority AS transaction_type,
       CASE o_orderstatus WHEN 'F' THEN 'mobile' WHEN 'O' THEN 'desktop' ELSE 'tablet' END AS device_type,
       n_name AS location_country,
       CAST(CASE WHEN o_totalprice > 480000 OR o_orderkey % 56 = 0 THEN 1 ELSE 0 END AS INT) AS is_fraud
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "txn_dirty": """
SELECT transaction_id AS row_id,
       CASE WHEN transaction_id % 83 = 0 THEN NULL ELSE transaction_id END AS transaction_id,
       CASE WHEN transaction_id % 97 = 0 THEN 'n/a' ELSE CAST(amount AS VARCHAR) END AS amount,
       CASE WHEN transaction_id % 89 = 0 THEN 'not-a-date' ELSE CAST(date AS VARCHAR) END AS date,
       user_id,
       CASE WHEN transaction_id % 79 = 0 THEN NULL ELSE organization_id END AS organization_id,
       product_id, merchant_id, transaction_type, device_type, location_country, is_fraud
FROM txn_events""",
    "org_directory_raw": """
SELECT CAST(n_nationkey AS BIGINT) AS id, upper(replace(n_name, '_', '-')) AS slug, n_name AS name FROM nation""",
    "api_records": """
SELECT transaction_id AS id,
       CASE WHEN transaction_id % 13 = 0 THEN NULL ELSE CAST(round(amount * 100) AS BIGINT) END AS amount_cents,
       CAST(CAST(date AS DATE) AS VARCHAR) AS date_text,
       CASE WHEN transaction_id % 17 = 0 THEN NULL ELSE transaction_type END AS type,
       CASE WHEN transaction_id % 7 = 0 THEN NULL ELSE user_id END AS creator_id,
       organization_id AS org_id,
       CASE WHEN transaction_id % 11 = 0 THEN NULL ELSE merchant_id END AS merchant_id,
       CAST(ceil(row_number() OVER (PARTITION BY organization_id ORDER BY transaction_id) / 100) AS BIGINT) AS page
FROM txn_events""",
}

_DEPENDS = {"txn_dirty": ["txn_events"], "api_records": ["txn_events"]}


def with_views(*names: str) -> str:
    """``WITH`` prelude defining the named fixture views (and what they need)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n]}\n)" for n in order)


def view_sql(name: str) -> str:
    return _VIEWS[name]


# ---------------------------------------------------------------------------
# Shared SQL blocks
# ---------------------------------------------------------------------------

_PASS = ("transaction_id, amount, user_id, organization_id, product_id, merchant_id, "
         "transaction_type, device_type, location_country, is_fraud")
_FRAME = "RANGE BETWEEN 86400000000000 PRECEDING AND 1 PRECEDING"


def features_ctes(src: str, passthrough: str = _PASS, ratio: str = "serving") -> str:
    """CTEs ending in ``featr``: the engineered columns over view ``src``.

    Written directly from the definition: per-key ``row_number`` order key,
    a BIGINT RANGE frame ``[ns - 24h, ns - 1]``, sums in exact cents."""
    if ratio == "serving":
        ratio_sql = "coalesce(amount / (nullif(user_avg_amount, 0) + 1e-6), 0.0)"
    else:
        ratio_sql = "amount / (user_avg_amount + 1e-6)"
    return f"""
_t AS (SELECT *, epoch_us(date) AS _us, CAST(round(amount * 100) AS BIGINT) AS _cents FROM {src}),
_o AS (SELECT *,
    _us * 1000 + row_number() OVER (PARTITION BY organization_id ORDER BY _us, transaction_id) - 1 AS _ns_o,
    _us * 1000 + row_number() OVER (PARTITION BY user_id ORDER BY _us, transaction_id) - 1 AS _ns_u,
    lag(_us) OVER (PARTITION BY user_id ORDER BY _us, transaction_id) AS _prev_u,
    lag(_us) OVER (PARTITION BY organization_id ORDER BY _us, transaction_id) AS _prev_o
  FROM _t),
_f AS (SELECT *,
    sum(_cents) OVER (PARTITION BY organization_id ORDER BY _ns_o {_FRAME}) AS _rs_o,
    max(amount) OVER (PARTITION BY organization_id ORDER BY _ns_o {_FRAME}) AS _rm_o,
    sum(_cents) OVER (PARTITION BY user_id ORDER BY _ns_u {_FRAME}) AS _rs_u,
    count(amount) OVER (PARTITION BY user_id ORDER BY _ns_u {_FRAME}) AS _rca_u,
    count(transaction_id) OVER (PARTITION BY user_id ORDER BY _ns_u {_FRAME}) AS _rc_u,
    sum(_cents) OVER (PARTITION BY user_id) AS _ks_u, count(amount) OVER (PARTITION BY user_id) AS _kc_u,
    max(amount) OVER (PARTITION BY user_id) AS _km_u,
    sum(_cents) OVER (PARTITION BY organization_id) AS _ks_o, count(amount) OVER (PARTITION BY organization_id) AS _kc_o,
    max(amount) OVER (PARTITION BY organization_id) AS _km_o
  FROM _o),
feat AS (SELECT {passthrough},
    epoch_us(date) / 1000000.0::DOUBLE AS timestamp,
    CAST(hour(date) AS INT) AS hour_of_day, CAST(isodow(date) - 1 AS INT) AS day_of_week,
    CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day_of_month,
    CASE WHEN user_id IS NULL OR _prev_u IS NULL THEN 0.0 ELSE (_us - _prev_u) / 1000000.0::DOUBLE END AS time_since_last_user_txn,
    CASE WHEN _prev_o IS NULL THEN 0.0 ELSE (_us - _prev_o) / 1000000.0::DOUBLE END AS time_since_last_org_txn,
    coalesce(CAST(_rs_o AS DOUBLE) / 100.0::DOUBLE, 0.0) AS rolling_sum_24hr_org,
    coalesce(_rm_o, 0.0) AS rolling_max_24hr_org,
    CASE WHEN user_id IS NULL OR _rca_u = 0 THEN 0.0 ELSE (CAST(_rs_u AS DOUBLE) / 100.0::DOUBLE) / _rca_u END AS rolling_avg_24hr_user,
    CASE WHEN user_id IS NULL THEN 0 ELSE _rc_u END AS rolling_count_24hr_user,
    CASE WHEN user_id IS NULL OR _kc_u = 0 THEN NULL ELSE (CAST(_ks_u AS DOUBLE) / 100.0::DOUBLE) / _kc_u END AS user_avg_amount,
    CASE WHEN user_id IS NULL THEN NULL ELSE _km_u END AS user_max_amount,
    CASE WHEN _kc_o = 0 THEN NULL ELSE (CAST(_ks_o AS DOUBLE) / 100.0::DOUBLE) / _kc_o END AS org_avg_amount,
    _km_o AS org_max_amount
  FROM _f),
featr AS (SELECT *, {ratio_sql} AS amount_to_user_avg_ratio FROM feat)"""


FEATURE_COLUMNS = (
    "timestamp, hour_of_day, day_of_week, month, day_of_month, time_since_last_user_txn, "
    "time_since_last_org_txn, rolling_sum_24hr_org, rolling_max_24hr_org, rolling_avg_24hr_user, "
    "rolling_count_24hr_user, user_avg_amount, user_max_amount, org_avg_amount, org_max_amount, "
    "amount_to_user_avg_ratio"
)


def md5_int(seed: str, key_sql: str, digits: int = 8) -> str:
    """Integer of the first ``digits`` hex digits of md5('seed:' || key)."""
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({key_sql} AS VARCHAR)), 1, {digits})) AS BIGINT)"


def md5_prefix(seed: str, key_sql: str) -> str:
    return f"substr(md5('{seed}:' || CAST({key_sql} AS VARCHAR)), 1, 8)"


def iso_sql(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN NULL WHEN epoch_us({col}) % 1000000 = 0 "
            f"THEN strftime({col}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({col}, '%Y-%m-%dT%H:%M:%S') || '.' || "
            f"lpad(CAST(epoch_us({col}) % 1000000 AS VARCHAR), 6, '0') END")
