"""Dashboard sections.

Each section is its own small plan: aggregates use partial aggregation over
the raw rows, top-k uses TakeOrderedAndProject, features are attached only to
the top-k rows, and only already-bounded results (a top-k, a per-day or
per-type table) are folded into the JSON payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions import scalars as S
from txnrisk.schema import (
    DISPLAY_NAMES, FALLBACK_HEAD_N, LATEST_N, PSEUDO_ORG_MODULUS, REQUIRED_NOT_NULL,
)


# --- A1–A3 -----------------------------------------------------------------

def summary(df: DataFrame) -> DataFrame:
    """A1: one row — total transactions, total fraud, fraud rate % (2 dp, half-even)."""
    fraud = S.coerce_double("is_fraud") if "is_fraud" in df.columns else F.lit(0.0)
    agg = df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.coalesce(F.sum(fraud), F.lit(0.0)).cast(T.LongType()).alias("total_fraud"),
    )
    return agg.select(
        "total_transactions", "total_fraud",
        S.percent_2dp("total_fraud", "total_transactions").alias("fraud_rate"),
    )


def daily_volume(df: DataFrame) -> DataFrame:
    """A2: total amount per calendar day, ``date`` as ``YYYY-MM-DD``, ascending.

    Rows with no parsable date form no group (like a pandas groupby).
    """
    d = S.date_string(S.coerce_timestamp("date", df.schema["date"].dataType))
    return (df.select(d.alias("date"), S.coerce_double("amount").alias("amount"))
            .filter(F.col("date").isNotNull())
            .groupBy("date").agg(F.sum("amount").alias("amount"))
            .orderBy("date"))


def fraud_by_type(df: DataFrame) -> DataFrame:
    """A3: fraud count per transaction type, ascending; zero-fraud types kept."""
    return (df.filter(F.col("transaction_type").isNotNull())
            .groupBy("transaction_type")
            .agg(F.coalesce(F.sum(S.coerce_double("is_fraud")), F.lit(0.0)).cast(T.LongType()).alias("is_fraud"))
            .orderBy("transaction_type"))


# --- L2 / L5 / L7 -------------------------------------------------------------

def _when(df: DataFrame) -> Column:
    return S.coerce_timestamp("date", df.schema["date"].dataType)


def latest_transactions(df: DataFrame, n: int = LATEST_N, seq: str = "transaction_id") -> DataFrame:
    """L2: the ``n`` most recent rows (date descending, text dates as dates,
    missing and unparsable ones last; ties by ``seq`` descending). Planned as TakeOrderedAndProject: each task keeps
    its own top ``n`` and only those reach the final merge."""
    return df.orderBy(_when(df).desc_nulls_last(), F.col(seq).desc_nulls_last()).limit(n)


def head_by_date(df: DataFrame, n: int = FALLBACK_HEAD_N, seq: str = "transaction_id") -> DataFrame:
    """The first ``n`` rows in (date, seq) order."""
    return df.orderBy(_when(df).asc_nulls_last(), F.col(seq).asc_nulls_last()).limit(n)


def top_risks(scored: DataFrame, k: int = LATEST_N, seq: str = "transaction_id") -> DataFrame:
    """The ``k`` rows with the highest fraud probability."""
    return scored.orderBy(F.col("fraud_probability").desc_nulls_last(), F.col(seq).asc()).limit(k)


# --- P3–P6 ------------------------------------------------------------------------

def for_organization(df: DataFrame, org_id: int) -> DataFrame:
    """Organization equality filter (pushed into the parquet scan)."""
    return df.filter(F.col("organization_id") == F.lit(org_id))


def pseudo_org_filter(df: DataFrame, org_id: int | str, modulus: int = PSEUDO_ORG_MODULUS) -> DataFrame:
    """Rows of the pseudo-organization ``org_id mod 100`` (a text id is
    coerced; an unparsable one matches nothing)."""
    target = S.pseudo_org_id(F.lit(str(org_id)), modulus)
    return df.filter(F.col("organization_id") == target)


def filter_or_head(filtered: DataFrame, source: DataFrame, n: int = FALLBACK_HEAD_N,
                   seq: str = "transaction_id") -> DataFrame:
    """P5: ``filtered`` if it has a row, otherwise the first ``n`` rows of
    ``source``. Decided inside the plan: ``filtered.limit(1)`` is a scalar
    subquery, so no action runs on the driver and the head is only emitted
    when the match is empty."""
    empty = filtered.limit(1).agg(F.count(F.lit(1)).alias("_c")).scalar() == 0
    fallback = head_by_date(source, n, seq).filter(empty)
    return filtered.unionByName(fallback)


def resolve_org(directory: DataFrame, name: str) -> DataFrame:
    """Case-insensitive slug lookup → ``(slug, id, name)`` (0 or 1 row)."""
    return directory.filter(F.col("slug") == S.normalize_slug(F.lit(name)))


def org_not_found(directory: DataFrame, name: str) -> DataFrame:
    """The not-found answer — message and the available slugs — or no row
    when the name resolves. The directory is one API page (≤ 100 orgs)."""
    hit = resolve_org(directory, name).limit(1).agg(F.count(F.lit(1)).alias("_c")).scalar()
    return (directory.agg(F.sort_array(F.collect_list("slug")).alias("available_organizations"))
            .select(F.lit(f"Organization '{name}' not found.").alias("message"), "available_organizations")
            .filter(hit == 0))


def org_listing(directory: DataFrame) -> DataFrame:
    """``/api/organizations``: slug, id, display name, and the list total."""
    total = directory.agg(F.count(F.lit(1))).scalar()
    return directory.select(
        "slug", "id", S.slug_display_name("slug").alias("name"), total.alias("total"))


# --- J1 / P7 --------------------------------------------------------------------

def display_join(raw: DataFrame, engineered: DataFrame, row_id: str = "row_id") -> DataFrame:
    """J1 + P7: raw ⟕ engineered on the row identity. Raw rows dropped by
    cleaning stay (with NULL features); for the core columns the raw value
    wins and the engineered copy is dropped; engineered-only columns stay, the
    defaults of core columns that ``raw`` lacks among them."""
    feats = engineered.select(row_id, *[c for c in engineered.columns if c != row_id and c not in raw.columns])
    return raw.join(feats, row_id, "left")


def display_frame(raw: DataFrame, **features) -> DataFrame:
    """J1 + P7 from raw rows alone, without a join: the raw values travel
    through cleaning and the feature windows, and rows that cleaning drops are
    added with NULL features. ``features`` are options of ``engineer_features``.
    """
    from txnrisk.operators.features import engineer_features
    from txnrisk.sources import ingest as IN

    typed = IN.conform(raw.withColumn("_raw", F.struct(*raw.columns)))
    whole = F.lit(True)
    for c in REQUIRED_NOT_NULL:
        whole = whole & F.col(c).isNotNull()
    kept = engineer_features(typed.filter(whole), **features)
    names = [c for c in kept.columns if c not in raw.columns and c != "_raw"]
    dropped = typed.filter(~whole).select("_raw.*", *[F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in names])
    return kept.select("_raw.*", *names).unionByName(dropped)


# --- P9 ----------------------------------------------------------------------

def _or_na(c: Column) -> Column:
    """JS ``value || 'N/A'`` for ids and text: NULL or empty → 'N/A'."""
    s = c.cast(T.StringType())
    return F.when(s.isNull() | (s == ""), F.lit("N/A")).otherwise(s)


def display_rows(df: DataFrame) -> DataFrame:
    """Table text as the dashboard shows it — money ``$0.00``, date
    ``M/D/YYYY``, fraud Yes/No/N/A, probability ``12.34%`` or N/A."""
    amt = F.coalesce(S.coerce_double("amount"), F.lit(0.0))
    d = S.coerce_timestamp("date", df.schema["date"].dataType)
    prob = F.col("fraud_probability") if "fraud_probability" in df.columns else F.lit(None).cast(T.DoubleType())
    fraud = F.col("is_fraud").cast(T.IntegerType())
    return df.select(
        _or_na(F.col("transaction_id")).alias("transaction_id"),
        F.format_string("$%.2f", amt).alias("amount"),
        F.when(d.isNull(), F.lit("N/A")).otherwise(F.date_format(d, "M/d/yyyy")).alias("date"),
        _or_na(F.col("user_id")).alias("user_id"),
        _or_na(F.col("organization_id")).alias("organization_id"),
        _or_na(F.col("transaction_type")).alias("transaction_type"),
        F.when(fraud == 1, F.lit("Yes")).when(fraud == 0, F.lit("No")).otherwise(F.lit("N/A")).alias("is_fraud"),
        F.when(prob.isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f%%", prob * 100)).alias("fraud_probability"),
    )


# --- S11 -------------------------------------------------------------------------

def _records(df: DataFrame, key: list[Column], rename: dict[str, str]) -> Column:
    """Aggregate: ``array<struct>`` of an already-bounded section, ascending by
    ``key`` (an array of a few rows; collection order is not relied on)."""
    cols = [F.col(c).alias(rename.get(c, c)) for c in df.columns if not c.startswith("_k")]
    pairs = F.collect_list(F.struct(F.struct(*key).alias("_k"), F.struct(*cols).alias("_v")))
    return F.transform(F.array_sort(pairs), lambda x: x["_v"])


def dashboard_payload(raw: DataFrame, context: str | Column, *, engineered: DataFrame | None = None,
                      row_id: str = "row_id", latest: DataFrame | None = None, model=None) -> DataFrame:
    """One row, one column ``payload`` — the dashboard JSON document.

    The display frame is ``raw ⟕ engineered`` on a unique row id, so it has
    exactly the raw rows and raw values: summary, daily volume and fraud by
    type are computed from ``raw`` directly (no join, no feature windows);
    core columns that ``raw`` lacks have their defaults. Only the latest rows
    carry features: the ``n`` latest row ids (a bounded, broadcast set) select
    their engineered columns, so the feature pipeline runs once.

    With a ``model`` whose inputs the engineered columns cover, the latest
    rows are scored, ``ml_predictions.available`` is true and ``top_risks``
    lists them by probability; otherwise it is false and the list empty. That
    is decided from columns and types, before any row is read.
    """
    from txnrisk.operators.ml import can_score, fraud_probability
    from txnrisk.sources.ingest import with_required_columns

    raw = with_required_columns(raw)
    predictions_available = model is not None and engineered is not None and latest is None and can_score(model, engineered)
    risks = None
    s = summary(raw)
    dv = daily_volume(raw)
    ft = fraud_by_type(raw)
    lt = latest if latest is not None else latest_transactions(raw)
    # of at most n rows: the place in L2's order, which the array keeps
    place = F.row_number().over(Window.orderBy(_when(lt).desc_nulls_last(), F.col("transaction_id").desc_nulls_last()))
    lt = lt.withColumn("_k_place", place)
    if engineered is not None and latest is None:
        ids = lt.select(row_id)
        feats = engineered.join(F.broadcast(ids), row_id, "left_semi")
        if predictions_available:
            risks = top_risks(fraud_probability(model, feats))
        lt = display_join(lt, feats, row_id)
    lt = lt.withColumn("date", S.iso_timestamp(_when(lt)))
    names = dict(DISPLAY_NAMES)
    sec_daily = dv.agg(_records(dv, [F.col("date")], {}).alias("daily_volume"))
    sec_type = ft.agg(_records(ft, [F.col("transaction_type")], {"transaction_type": "transaction.type"})
                      .alias("fraud_by_type"))
    sec_latest = lt.agg(_records(lt.drop(row_id) if row_id in lt.columns and row_id != "transaction_id" else lt,
                                 [F.col("_k_place")], names).alias("latest_transactions"))
    risk_rows = F.array().cast(T.ArrayType(T.StringType()))
    if risks is not None:
        rk = risks.select("transaction_id", "fraud_probability", (-F.col("fraud_probability")).alias("_k_p"))
        risk_rows = rk.agg(_records(rk, [F.col("_k_p"), F.col("transaction_id")], {})).scalar()
    body = (s.select(F.struct("total_transactions", "total_fraud", "fraud_rate").alias("summary"))
            .select("summary", sec_daily.scalar().alias("daily_volume"),
                    sec_type.scalar().alias("fraud_by_type"),
                    sec_latest.scalar().alias("latest_transactions"),
                    F.struct(F.lit(predictions_available).alias("available"),
                             risk_rows.alias("top_risks")).alias("ml_predictions"),
                    (F.lit(context) if isinstance(context, str) else context).alias("organization_context")))
    return body.select(F.to_json(F.struct(*body.columns)).alias("payload"))


# --- §3.2: the organization dashboard, end to end ---------------------------------

def organization_dashboard(directory: DataFrame, pages: DataFrame, fallback: DataFrame, name: str,
                           limit: int | None = None, model=None) -> DataFrame:
    """Payload for one organization, or the not-found answer. All of its
    records count unless ``limit`` caps the fetch; ``model`` as in ``dashboard_payload``.

    1. resolve ``name`` in the directory (case-insensitive slug);
    2. read that organization's landed pages (a filter on ``org_id``, pruned
       to its directory when the pages are files), apply the page rules, map
       and clean the records;
    3. if nothing usable came back, use ``fallback`` rows of the
       pseudo-organization ``id mod 100`` — or, if there are none, its first
       100 rows — and mark the context "(Synthetic)";
    4. run the processor path (clean → features → raw ⟕ features) and build
       the payload.

    The branch is chosen inside the plan (scalar subqueries), so this returns
    a lazy one-row DataFrame: ``payload`` is NULL when the name does not
    resolve, and ``not_found`` carries the message and the available slugs.
    """
    from txnrisk.operators.features import engineer_features
    from txnrisk.session import materialize
    from txnrisk.sources import ingest as IN

    hit = resolve_org(directory, name)
    org_id = hit.select("id").limit(1).scalar()
    org_pages = pages.filter(F.col("org_id") == org_id)
    live = IN.clean_ingest(IN.map_api_records(IN.read_transaction_pages(org_pages, limit)))
    live_empty = live.limit(1).agg(F.count(F.lit(1))).scalar() == 0
    pseudo = fallback.filter(F.col("organization_id") == F.pmod(org_id, F.lit(PSEUDO_ORG_MODULUS)))
    synthetic = filter_or_head(pseudo, fallback).filter(live_empty)
    chosen = (live.filter(~live_empty).withColumn("_synthetic", F.lit(False))
              .unionByName(synthetic.select(*[F.col(f.name).cast(f.dataType) for f in live.schema]).withColumn("_synthetic", F.lit(True))))
    # one organization's rows: written once, then every section reads this small table
    chosen = materialize(chosen)
    raw = chosen.drop("_synthetic").withColumn("row_id", F.col("transaction_id"))
    feats = engineer_features(IN.clean_processor(raw))
    synthetic_used = chosen.agg(F.max("_synthetic")).scalar()
    context = F.when(synthetic_used, F.lit(f"{name} (Synthetic)")).otherwise(F.lit(name))
    payload = dashboard_payload(raw, context, engineered=feats, model=model)
    missing = org_not_found(directory, name).select(
        F.to_json(F.struct("message", "available_organizations")).alias("not_found"))
    return payload.select(F.when(org_id.isNotNull(), F.col("payload")).alias("payload"),
                          missing.select("not_found").scalar().alias("not_found"))
