"""Scalar column expressions.

All are plain Catalyst expressions, so they stay inside whole-stage codegen.
Spark 4 runs with ANSI mode on: coercions use the ``try_*`` forms so dirty
input becomes NULL instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.schema import RATIO_EPS

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- F8 / F9: coercion -------------------------------------------------------

def coerce_double(col: ColumnOrName) -> Column:
    """Numeric coerce: text or number → DOUBLE, unparsable/NaN → NULL."""
    d = _c(col).try_cast(T.DoubleType())
    return F.when(F.isnan(d), F.lit(None).cast(T.DoubleType())).otherwise(d)


def coerce_timestamp(col: ColumnOrName, source_type: T.DataType | None = None) -> Column:
    """Date coerce: text/date/timestamp → TIMESTAMP, unparsable → NULL."""
    c = _c(col)
    if source_type is None or isinstance(source_type, T.StringType):
        return F.try_to_timestamp(c.cast(T.StringType()))
    return c.cast(T.TimestampType())


def cents_to_dollars(col: ColumnOrName) -> Column:
    """API cents → dollars; missing or non-numeric → 0.0."""
    return F.coalesce(coerce_double(col), F.lit(0.0)) / F.lit(100.0)


# --- F1–F5: time -------------------------------------------------------------

def epoch_micros(col: ColumnOrName) -> Column:
    return F.unix_micros(_c(col))


def epoch_seconds(col: ColumnOrName) -> Column:
    """seconds since the epoch of a (UTC) timestamp, as DOUBLE."""
    return epoch_micros(col) / F.lit(1_000_000.0)


def hour_of_day(col: ColumnOrName) -> Column:
    return F.hour(_c(col)).cast(T.IntegerType())


def day_of_week(col: ColumnOrName) -> Column:
    """Monday = 0 … Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(_c(col)).cast(T.IntegerType())


def month(col: ColumnOrName) -> Column:
    return F.month(_c(col)).cast(T.IntegerType())


def day_of_month(col: ColumnOrName) -> Column:
    return F.dayofmonth(_c(col)).cast(T.IntegerType())


def date_string(col: ColumnOrName) -> Column:
    """calendar date as ``YYYY-MM-DD``."""
    return F.to_date(_c(col)).cast(T.StringType())


def iso_timestamp(col: ColumnOrName) -> Column:
    """ISO-8601 text; the fraction is printed only when non-zero."""
    c = _c(col)
    frac = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(c.isNull(), F.lit(None).cast(T.StringType())).when(
        frac == 0, base
    ).otherwise(F.concat(base, F.lit("."), F.lpad(frac.cast(T.StringType()), 6, "0")))


# --- F10 / F11 / F12 / F13: arithmetic ------------------------------------------

def ratio_training(amount: ColumnOrName, avg: ColumnOrName) -> Column:
    """amount / (avg + 1e-6); NULL when either side is NULL."""
    return F.try_divide(_c(amount), _c(avg) + F.lit(RATIO_EPS))


def ratio_serving(amount: ColumnOrName, avg: ColumnOrName) -> Column:
    """a zero average is treated as missing, missing ratios become 0."""
    a = _c(avg)
    guarded = F.when(a == 0, F.lit(None).cast(T.DoubleType())).otherwise(a)
    return F.coalesce(F.try_divide(_c(amount), guarded + F.lit(RATIO_EPS)), F.lit(0.0))


def percent_2dp(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """100·part/whole rounded half-even to 2 places; 0 when whole is 0."""
    w = _c(whole)
    return F.when(w > 0, F.bround(F.lit(100.0) * _c(part) / w, 2)).otherwise(F.lit(0.0))


# --- F14 / F15: text ---------------------------------------------------------------

def normalize_slug(col: ColumnOrName) -> Column:
    return F.lower(F.trim(_c(col)))


def title_case(col: ColumnOrName) -> Column:
    """Python ``str.title``: upper-case a cased char that follows an uncased one.

    A character is "cased" when its upper and lower forms differ, so digits
    and punctuation start a new word (``it's`` → ``It'S``), like Python.
    """
    chars = F.split(_c(col), "")
    cased = lambda ch: F.upper(ch) != F.lower(ch)
    titled = F.transform(
        chars,
        lambda ch, i: F.when(
            (i == 0) | ~cased(F.element_at(chars, i)), F.upper(ch)
        ).otherwise(F.lower(ch)),
    )
    return F.when(_c(col).isNull(), F.lit(None)).otherwise(F.array_join(titled, ""))


def slug_display_name(col: ColumnOrName) -> Column:
    """Slug → display name: dashes become spaces, then title case."""
    return title_case(F.regexp_replace(_c(col), "-", " "))


# --- F17 ------------------------------------------------------------------------

def pseudo_org_id(col: ColumnOrName, modulus: int) -> Column:
    """Python ``id % m`` (non-negative for a positive modulus) = ``pmod``."""
    return F.pmod(_c(col).try_cast(T.LongType()), F.lit(modulus))


# --- Deterministic hashing (replaces RNG so task retries are idempotent) -------------

def hash_prefix_hex(seed: int | str, key: ColumnOrName) -> Column:
    """First 8 hex digits of md5("seed:key") — the same text in every SQL engine."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast(T.StringType()))), 1, 8)


def hash_bucket(seed: int | str, key: ColumnOrName) -> Column:
    """The 32-bit integer of ``hash_prefix_hex`` (0 … 2^32-1)."""
    return F.conv(hash_prefix_hex(seed, key), 16, 10).cast(T.LongType())


def hash_threshold_hex(fraction: float) -> str:
    """Hex threshold so that ``prefix < threshold`` holds for ``fraction`` of keys."""
    v = int(fraction * 2**32)
    v = max(0, min(v, 2**32))
    return "100000000" if v >= 2**32 else f"{v:08x}"


def hash_selected(seed: int | str, key: ColumnOrName, fraction: float) -> Column:
    """Deterministic Bernoulli(fraction) draw keyed by ``key``."""
    if fraction >= 1.0:
        return F.lit(True)
    return hash_prefix_hex(seed, key) < F.lit(hash_threshold_hex(fraction))


def hash_choice(seed: int | str, key: ColumnOrName, options: list) -> Column:
    """Deterministic uniform choice from ``options``."""
    idx = F.pmod(hash_bucket(seed, key), F.lit(len(options)))
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (idx + 1).cast(T.IntegerType()))


def hash_int_range(seed: int | str, key: ColumnOrName, lo: int, hi: int) -> Column:
    """Deterministic integer in [lo, hi]."""
    return (F.pmod(hash_bucket(seed, key), F.lit(hi - lo + 1)) + F.lit(lo)).cast(T.LongType())
