"""Weak-label rules (G1–G4) and the statistics they use.

The reference injected labels with a seeded RNG. Here every random draw is a
threshold on ``md5(seed:key)``, so a label is a pure function of the row —
identical on task retry, on any partitioning, and in any SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions import scalars as S
from txnrisk.operators.ranking import exact_quantile, smallest_k, smallest_share_cutoff
from txnrisk.schema import (
    BASE_FRAUD_RATE, COHORT_FRACTION, COHORT_RELABEL_P, SEED, TAIL_QUANTILE,
    TAIL_SAMPLE_FRACTION,
)
from txnrisk.session import materialize


def hash_key60(seed: str, key: str | Column) -> Column:
    """A 60-bit integer from ``md5(seed:key)`` (first 15 hex digits): an order
    key that is uniform and, in practice, unique per key."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), k.cast(T.StringType()))), 1, 15)
    return F.conv(h, 16, 10).cast(T.LongType())


def tail_draw_fraction(sample_frac: float = TAIL_SAMPLE_FRACTION) -> float:
    """Distinct share hit by sampling ``frac·n`` rows with replacement:
    ``1 - (1 - 1/n)^(frac·n)`` → ``1 - e^-frac`` for large n."""
    return 1.0 - math.exp(-sample_frac)


def amount_quantile(df: DataFrame, q: float = TAIL_QUANTILE, col: str = "amount") -> float | None:
    """Exact quantile (linear interpolation) of ``col``."""
    return exact_quantile(df, col, q)


def label_rate(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """The mean of the label."""
    return df.agg(F.avg(F.col(label).cast(T.DoubleType())).alias("fraud_rate"))


def hashed_keys(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The distinct non-null keys with their cohort hash ``_h``, written once: the input is shuffled for them one time."""
    return materialize(df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_h", hash_key60(f"{seed}:cohort", key)))


def fraud_cohort(df: DataFrame, frac: float = COHORT_FRACTION, key: str = "user_id",
                 seed: int = SEED) -> DataFrame:
    """The ``int(frac · n_distinct)`` keys with the smallest
    ``md5(seed:cohort:key)`` — an exact-size, deterministic cohort."""
    users = hashed_keys(df, key, seed)
    return smallest_k(users, "_h", int(users.count() * frac), key).select(key)


def cohort_rows(df: DataFrame, cohort: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows whose key is in the cohort (left semi join)."""
    return df.join(cohort, key, "left_semi")


def base_rate_flag(tid: str = "transaction_id", rate: float = BASE_FRAUD_RATE, seed: int = SEED) -> Column:
    """G1: a ``rate`` share of rows, chosen by hash."""
    return S.hash_selected(f"{seed}:base", F.col(tid), rate)


def amount_tail_flag(p95: float | None, tid: str = "transaction_id", amount: str = "amount",
                     seed: int = SEED) -> Column:
    """Rows above the quantile, each hit with the with-replacement share."""
    if p95 is None:
        return F.lit(False)
    return (F.col(amount) > F.lit(p95)) & S.hash_selected(f"{seed}:tail", F.col(tid), tail_draw_fraction())


def cohort_label(tid: str = "transaction_id", p: float = COHORT_RELABEL_P, seed: int = SEED) -> Column:
    """The redrawn label of a cohort row (1 with probability ``p``)."""
    return S.hash_selected(f"{seed}:relabel", F.col(tid), p).cast(T.IntegerType())


def cohort_predicate(df: DataFrame, frac: float = COHORT_FRACTION, key: str = "user_id",
                     seed: int = SEED) -> Column | None:
    """A8 as a row predicate: ``md5(seed:cohort:key) <= v`` for the exact cut-off
    ``v`` of the ``int(frac · n_distinct)`` smallest keys. Membership then needs
    no join (no shuffle of the rows by key, so a hot key cannot skew it).
    Returns None in the practically impossible case of a hash tie at the cut,
    where the caller falls back to the cohort join."""
    users = hashed_keys(df, key, seed)
    v, exact = smallest_share_cutoff(users, "_h", frac)
    if not exact:
        return None
    if v is None:
        return F.lit(False)
    return F.coalesce(hash_key60(f"{seed}:cohort", key) <= F.lit(v), F.lit(False))


def weak_labels(df: DataFrame, *, tid: str = "transaction_id", key: str = "user_id",
                seed: int = SEED) -> DataFrame:
    """``is_fraud`` from the three rules, in order — base rate, amount
    tail, then the cohort redraw, which overrides (and can clear) the others.

    Every rule is a row-level predicate: the quantile and the cohort cut-off
    are exact scalars computed first, so labelling is a single projection."""
    p95 = amount_quantile(df)
    in_cohort = cohort_predicate(df, key=key, seed=seed)
    x = df
    if in_cohort is None:
        cohort = fraud_cohort(df, key=key, seed=seed).withColumn("_in_cohort", F.lit(True))
        x = df.join(cohort, key, "left")
        in_cohort = F.col("_in_cohort").isNotNull()
    base = base_rate_flag(tid, seed=seed) | amount_tail_flag(p95, tid, seed=seed)
    label = F.when(in_cohort, cohort_label(tid, seed=seed)).otherwise(base.cast(T.IntegerType()))
    out = x.withColumn("is_fraud", label.cast(T.IntegerType()))
    return out.drop("_in_cohort") if "_in_cohort" in out.columns else out
