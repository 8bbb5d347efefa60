"""Canonical transaction schema, column lists and name maps.

Internally every column is snake_case; the dotted names of the dashboard
payload (``user.id`` …) are restored only by the JSON sink, because Spark
would read a dot as a struct access.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference for identical results.
# ---------------------------------------------------------------------------

# The eleven raw transaction columns, in the reference's order.
RAW_COLUMNS = [
    "transaction_id", "amount", "date", "user_id", "organization_id",
    "product_id", "merchant_id", "transaction_type", "device_type",
    "location_country", "is_fraud",
]

# Display (payload) name of each raw column.
DISPLAY_NAMES = {
    "transaction_id": "transaction_id",
    "amount": "amount",
    "date": "date",
    "user_id": "user.id",
    "organization_id": "organization.id",
    "product_id": "product.id",
    "merchant_id": "merchant.id",
    "transaction_type": "transaction.type",
    "device_type": "device.type",
    "location_country": "location.country",
    "is_fraud": "is_fraud",
}

# Columns whose null makes a row unusable (processor clean).
REQUIRED_NOT_NULL = ["amount", "date", "transaction_id", "organization_id"]

# Derived feature columns, in the order the reference appends them.
CALENDAR_FEATURES = ["timestamp", "hour_of_day", "day_of_week", "month", "day_of_month"]
WINDOW_FEATURES = [
    "time_since_last_user_txn", "time_since_last_org_txn",
    "rolling_sum_24hr_org", "rolling_max_24hr_org",
    "rolling_avg_24hr_user", "rolling_count_24hr_user",
]
GROUP_FEATURES = ["user_avg_amount", "user_max_amount", "org_avg_amount", "org_max_amount"]
RATIO_FEATURE = "amount_to_user_avg_ratio"
DERIVED_FEATURES = CALENDAR_FEATURES + WINDOW_FEATURES + GROUP_FEATURES + [RATIO_FEATURE]

# Model inputs: 13 numeric (standard-scaled) and 11 categorical (one-hot).
NUMERIC_FEATURES = [
    "amount", "timestamp", "time_since_last_user_txn", "time_since_last_org_txn",
    "rolling_sum_24hr_org", "rolling_avg_24hr_user", "rolling_count_24hr_user", "rolling_max_24hr_org",
    "user_avg_amount", "user_max_amount", "org_avg_amount", "org_max_amount",
    "amount_to_user_avg_ratio",
]
CATEGORICAL_FEATURES = [
    "user_id", "organization_id", "product_id", "merchant_id",
    "transaction_type", "device_type", "location_country",
    "hour_of_day", "day_of_week", "month", "day_of_month",
]
# Columns removed before the model sees a row.
NON_FEATURE_COLUMNS = ["transaction_id", "is_fraud"]

# Placeholder vocabularies for attributes the API lacks.
DEVICE_TYPES = ["mobile", "desktop", "tablet"]
COUNTRIES = ["USA", "CAN", "GBR", "AUS", "DEU", "FRA"]
PRODUCT_ID_RANGE = (1, 19)          # inclusive
PLACEHOLDER_ID_RANGE = (1, 999)     # inclusive, user / merchant fallback

# Ingest paging.
PAGE_SIZE = 100
DEFAULT_FETCH_LIMIT = 50000
ORG_FETCH_LIMIT = 5000

# Dashboard parameters.
LATEST_N = 10
FALLBACK_HEAD_N = 100
PSEUDO_ORG_MODULUS = 100

# Generator / weak-label parameters.
BASE_FRAUD_RATE = 0.0179
TAIL_QUANTILE = 0.95
TAIL_SAMPLE_FRACTION = 0.3
COHORT_FRACTION = 0.01
COHORT_RELABEL_P = 0.5
SPLIT_TEST_FRACTION = 0.3
SEED = 42

# Ratio guard.
RATIO_EPS = 1e-6

# One day in microseconds / nanoseconds (24 h rolling frame).
DAY_US = 86_400_000_000
DAY_NS = DAY_US * 1000

# ---------------------------------------------------------------------------

TXN_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("date", T.TimestampType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("organization_id", T.LongType(), True),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("merchant_id", T.LongType(), True),
    T.StructField("transaction_type", T.StringType(), True),
    T.StructField("device_type", T.StringType(), True),
    T.StructField("location_country", T.StringType(), True),
    T.StructField("is_fraud", T.IntegerType(), True),
])

# A landed API record (one element of a page array).
API_RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("amount", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("creator", T.StructType([T.StructField("id", T.StringType(), True)]), True),
    T.StructField("organization", T.StructType([T.StructField("id", T.StringType(), True)]), True),
    T.StructField("merchant", T.StructType([T.StructField("id", T.StringType(), True)]), True),
])
