"""Exact order statistics without funnelling a column through one task.

``percentile``/``ORDER BY … LIMIT k`` would hold every value (or every
candidate) in a single task. Here a mergeable quantile sketch of bounded size
brackets the wanted rank, and one more pass counts the rows below the bracket
and every distinct value inside it, with partial sums before the shuffle. The
bracket's values are ranged and summed, so the column is scanned twice,
whatever its values: point masses are one value, and powers of two, huge
ranges or infinities change nothing. Should a sketch ever miss the rank,
which the counts show, the second pass runs once more without a bracket.

NULL and NaN are no values. Infinities are the least and the greatest one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.session import materialize

GROUPS = 256           # groups of partitions in which sketches are merged first
STEPS = 1000           # quantiles read off a sketch
SKETCH_K = 4096        # size of a sketch: about 100 KB
SKETCH_ERROR = 0.003   # rank error allowed for, several times that of a sketch of this size


def _bracket(vals: DataFrame, rank_of: Callable[[int], int]) -> tuple[int, int, float, float]:
    """``(n, rank, low, high)``: the number of values, the wanted 0-based rank
    of n and values as doubles between which it and the next one lie, all but
    certainly. One scan; the sketch's quantiles at ``STEPS`` even ranks come back."""
    grouped = vals.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).groupBy("g").agg(
        F.kll_sketch_agg_double(F.col("v").cast("double"), F.lit(SKETCH_K)).alias("s"), F.count("v").alias("n"))
    ranks = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    n, at = grouped.agg(F.sum("n").alias("n"), F.kll_merge_agg_double("s", F.lit(SKETCH_K)).alias("s")) \
        .select("n", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", ranks))).first()
    n = n or 0
    rank = rank_of(n)
    if not 0 <= rank < n:
        return n, rank, 0.0, 0.0
    first, last = math.floor((rank / n - SKETCH_ERROR) * STEPS), math.ceil(((rank + 2) / n + SKETCH_ERROR) * STEPS)
    return n, rank, at[first] if first > 0 else -math.inf, at[last] if last < STEPS else math.inf


def _at_rank(vals: DataFrame, rank_of: Callable[[int], int]):
    """``(n, value, rows strictly below it, its multiplicity, the next rank's value)``
    at the 0-based rank that ``rank_of`` gives for n, of column ``v``."""
    n, k, low, high = _bracket(vals, rank_of)
    if not 0 <= k < n:
        return n, None, 0, 0, None
    as_double, inner = F.col("v").cast("double"), F.col("v").isNotNull()
    while True:
        inside = vals.filter(as_double <= F.lit(high)).withColumn("v", F.when(as_double >= F.lit(low), F.col("v")))   # NULL: below the bracket
        ranged = in_ranges(inside.groupBy("v").agg(F.count("*").alias("n")), [F.col("v")], "part", "local")
        sums = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum(F.when(inner, F.col("n")).otherwise(0)), F.sum(F.when(inner, 0).otherwise(F.col("n")))).collect())   # one row per range
        found, start = {}, sum(b for *_, b in sums)
        for part, m, _ in sums:
            for rank in (k, k + 1):
                if start <= rank < start + m:
                    found[rank] = (part, start)
            start += m
        if k in found and (k + 1 in found or k + 1 == n):
            break
        low, high = -math.inf, math.inf
    ranged = ranged.filter(inner)
    running = F.sum("n").over(Window.partitionBy("part").orderBy("local").rowsBetween(Window.unboundedPreceding, -1))
    starts = {part: at for part, at in found.values()}
    offset = F.coalesce(*[F.when(F.col("part") == p, F.lit(at)) for p, at in starts.items()])
    rows = ranged.filter(F.col("part").isin(list(starts))).withColumn("before", offset + F.coalesce(running, F.lit(0)))
    rows = rows.filter((F.col("before") <= max(found)) & (F.col("before") + F.col("n") > min(found))).select("v", "before", "n").collect()   # two at most
    at = {r: next(x for x in rows if x["before"] <= r < x["before"] + x["n"]) for r in found}
    return n, at[k]["v"], at[k]["before"], at[k]["n"], at[k + 1]["v"] if k + 1 in at else None


def _values(df: DataFrame, col: str) -> DataFrame:
    kind = df.schema[col].dataType.typeName()
    vals = df.select(F.col(col).alias("v")).filter(F.col("v").isNotNull())
    return vals.filter(~F.isnan("v")) if kind in ("double", "float") else vals


def value_at_rank(df: DataFrame, col: str, k: int):
    """The value at 0-based position ``k`` of ``col`` sorted ascending (NULLs
    ignored), or None when ``k`` is out of range. Exact."""
    return _at_rank(_values(df, col), lambda n: k)[1]


def exact_quantile(df: DataFrame, col: str, q: float):
    """Quantile with linear interpolation between closest ranks (the pandas /
    ``quantile_cont`` definition). Exact, None on empty input."""
    n, low, _, _, high = _at_rank(_values(df, col), lambda n: math.floor((n - 1) * q))
    pos = (n - 1) * q
    part = pos - math.floor(pos)
    if n == 0 or part == 0 or low == high:
        return low
    step = high - low
    return low + step * part if math.isfinite(step) else low * (1 - part) + high * part


def smallest_k(df: DataFrame, key: str, k: int, tiebreak: str) -> DataFrame:
    """The ``k`` rows with the smallest ``(key, tiebreak)``, exactly.

    The k-th key value ``v`` is found first; rows below it
    are a filter. Only when ``v`` is shared by more rows than needed is its
    tie group ordered by ``tiebreak`` (its size is the multiplicity of one
    key value).
    """
    if k <= 0:
        return df.limit(0)
    valid = df.filter(F.col(key).isNotNull())
    n, v, c_less, mult, _ = _at_rank(_values(df, key), lambda n: k - 1)
    if k >= n:
        return valid
    if c_less + mult == k:
        return valid.filter(F.col(key) <= F.lit(v))
    ties = valid.filter(F.col(key) == F.lit(v)).orderBy(tiebreak).limit(k - c_less)
    return valid.filter(F.col(key) < F.lit(v)).unionByName(ties)


def keyed_row_number(df: DataFrame, key: str, order_cols: list[str], bucket, out: str = "row_number") -> DataFrame:
    """``row_number() OVER (PARTITION BY key ORDER BY order_cols)`` without one
    task per key.

    ``bucket`` must not decrease along ``order_cols`` (a day of the timestamp,
    a range of the id). Rows are counted per ``(key, bucket)`` — a narrow
    table, windowed per key to give each bucket's starting number — and
    numbered inside ``(key, bucket)``, so a hot key is spread over its
    buckets. A NULL key is one group, as in SQL (null-safe join).
    """
    x = df.withColumn("_rb", bucket)
    counts = x.groupBy(key, "_rb").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select(
        F.col(key).alias("_rk"), F.col("_rb").alias("_rbb"),
        F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_rb")
                                    .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    x = x.join(offs, x[key].eqNullSafe(offs["_rk"]) & (x["_rb"] == offs["_rbb"]), "left")
    w = Window.partitionBy(key, "_rb").orderBy(*order_cols)
    return x.withColumn(out, F.col("_off") + F.row_number().over(w)).drop("_rb", "_rk", "_rbb", "_off")


def smallest_share_cutoff(df: DataFrame, key: str, share: float):
    """``(v, exact)`` such that ``key <= v`` selects exactly the ``int(share * n)``
    smallest of the n keys when ``exact`` is True (no tie straddles the cut).
    ``v`` is None when that is no key. When ``exact`` is False, use
    ``smallest_k``."""
    n, v, c_less, mult, _ = _at_rank(_values(df, key), lambda n: int(n * share) - 1)
    return v, v is None or c_less + mult == int(n * share)


def in_ranges(df: DataFrame, order: list[Column], part: str, local: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written once, with the
    range (``part``, ascending in ``order``) and 0-based place in it (``local``).

    Ranges are cut by rows, as many as the session has shuffle partitions.
    Rows that tie in all of ``order`` share a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                       .withColumn(part, F.spark_partition_id())
                       .withColumn(local, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def range_starts(table: DataFrame, part: str, sums: dict[str, Column]) -> DataFrame:
    """Per range the running totals of ``sums`` over the ranges before it, and of all; one row per range."""
    per_part = table.groupBy(part).agg(*[c.alias(k) for k, c in sums.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        part, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in sums],
        *[F.sum(k).over(Window.partitionBy()).alias(f"{k}_all") for k in sums])
