"""Per-transaction behaviour features.

Semantics (per key = user or organization, rows ordered by ``(date, seq)``):

* ``time_since_last_*``: seconds since the previous row of the key; the first
  row of a key, and rows tied with their predecessor, get 0.
* 24 h rolling aggregates: the frame is the left-closed interval
  ``[t - 24h, t)`` on a strictly increasing *order key*
  ``ns = epoch_µs(date)·1000 + ordinal``, where ``ordinal`` is the row's
  0-based position inside its key. A row therefore sees earlier rows with the
  same timestamp, never itself, and not a row exactly 24 h older. An empty
  frame gives 0.
* Group stats: mean / max of ``amount`` over the whole key.
* A NULL key gets 0 for the filled features and NULL for the group stats.

Physical design (``strategy="blocked"``, the default)
-----------------------------------------------------
A window partitioned by the key alone puts a hot key (think: one organization
holding a third of all rows) in one task, and Spark's sliding frame
re-aggregates its whole buffer for every row. Both are avoided, in the same
way for every key and every size:

1. *Blocks.* Rows are cut into UTC blocks of one width W (1 h by default; any
   divisor of 24 h). With n = 24h/W, a row's frame is the head of its own
   block, the whole blocks ``b-1 … b-(n-2)``, and the tails of the blocks
   ``b-(n-1)`` and ``b-n``, in one of which the frame begins.
2. *At most three emissions.* Each row is emitted as the *owner* of its block
   and as a narrow *copy* into the blocks n-1 and n later, at any width. The
   wide columns travel once, in a struct that is NULL on copies. One shuffle
   per key, on ``(key, block)``; a unit of work is three blocks.
3. *Block facts.* A narrow per-(key, block) table (partial aggregation, then
   windows per key on one row per block) gives the whole middle blocks' sum,
   count and max, the rows in the blocks before (so that a row's local number
   gives the exact ordinal difference), the previous active block's last
   timestamp and the key totals. It comes into its unit as one more row.
4. *O(n) frames.* Own head and tails are cumulative frames, ascending and
   descending, which Spark evaluates incrementally.

No step collects a group or sorts a key in one task, but a key's block is one.
Where one key may hold a large share of *all* rows within a few hours,
``strategy="ranked"`` (``operators/ranked.py``) has no unit that depends on a
key or an hour, for more shuffles of narrow rows. ``strategy="window"`` is the
direct per-key formulation, kept as an executable specification for tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions import scalars as S
from txnrisk.schema import DAY_NS, DAY_US, DERIVED_FEATURES
from txnrisk.session import materialize

HOUR_US = DAY_US // 24

ColumnOrName = Column | str

_US = "_f_us"
_SEQ = "_f_seq"
_NS = "_f_ns"
_UNITS = "_f_units"
_RID = "_f_rid"


def _floor_div(name: str, d: int) -> Column:
    """Exact floor division of a BIGINT column by a positive constant."""
    return F.expr(f"(`{name}` - pmod(`{name}`, {d}L)) div {d}L")


def calendar_columns(date_col: str = "date") -> dict[str, Column]:
    """Epoch seconds and calendar fields of the (UTC) transaction date."""
    d = F.col(date_col)
    return {
        "timestamp": S.epoch_seconds(d),
        "hour_of_day": S.hour_of_day(d),
        "day_of_week": S.day_of_week(d),
        "month": S.month(d),
        "day_of_month": S.day_of_month(d),
    }


def add_calendar_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.withColumns(calendar_columns(date_col))


# ---------------------------------------------------------------------------
# One key, blocked strategy
# ---------------------------------------------------------------------------

def block_facts(base: DataFrame, key: str, amount: str, units: str, tid: str, p: str, width_us: int = HOUR_US) -> DataFrame:
    """Narrow per-(key, block) table with what a unit needs of other blocks.

    Partial aggregation shrinks the rows to one per active (key, block) before
    any shuffle; the windows over blocks run per key on that small table (a
    key active for ten years has ~87 600 one-hour blocks). It reads only raw
    columns, so it never recomputes another key's stage.
    """
    blk, n = f"{p}blk", DAY_US // width_us
    blocks = base.groupBy(key, _floor_div(_US, width_us).alias(blk)).agg(
        F.max(_US).alias("_last"),
        F.sum(units).alias("_s"),
        F.count(amount).alias("_c"),
        F.max(amount).alias("_m"),
        F.count(tid).alias("_t"),
        F.count(F.lit(1)).alias("_n"),
    )
    by_key = Window.partitionBy(key)
    ordered = by_key.orderBy(blk)
    middle = ordered.rangeBetween(-(n - 2), -1)

    def rows_in(k: int) -> Column:
        return F.coalesce(F.sum("_n").over(ordered.rangeBetween(-k, -1)), F.lit(0))

    return blocks.select(
        key, blk,
        F.lag("_last").over(ordered).alias(f"{p}prev_last"),
        F.sum("_s").over(middle).alias(f"{p}ms"),
        F.coalesce(F.sum("_c").over(middle), F.lit(0)).alias(f"{p}mc"),
        F.coalesce(F.sum("_t").over(middle), F.lit(0)).alias(f"{p}mt"),
        F.max("_m").over(middle).alias(f"{p}mm"),
        rows_in(n).alias(f"{p}rows_n"),
        rows_in(n - 2).alias(f"{p}rows_mid"),
        F.sum("_s").over(by_key).alias(f"{p}ksum"),
        F.sum("_c").over(by_key).alias(f"{p}kcnt"),
        F.max("_m").over(by_key).alias(f"{p}max"),
    )


def emitted(df: DataFrame, key: str, narrow: list[str], p: str, width_us: int = HOUR_US) -> DataFrame:
    """Each row as the owner of its block and as a copy in the blocks n-1 and n later (n = 24h / width)."""
    n = DAY_US // width_us
    b = _floor_div(_US, width_us)
    wide = [c for c in df.columns if c not in narrow]
    # a literal array keeps the projection inside whole-stage codegen
    fan = F.array(*[F.struct((b + F.lit(k)).alias("b"), F.lit(k == 0).alias("o")) for k in (0, n - 1, n)])
    return df.select(*narrow, F.struct(*wide).alias(f"{p}payload"), F.explode(fan).alias("_e")).select(
        *narrow, F.col("_e.b").alias(f"{p}blk"), F.col("_e.o").alias(f"{p}own"),
        F.when(F.col("_e.o"), F.col(f"{p}payload")).alias(f"{p}payload"))


def _key_features_blocked(df: DataFrame, key: str, amount: str, units: str, tid: str, p: str,
                          facts: DataFrame, width_us: int = HOUR_US) -> DataFrame:
    """Adds ``{p}since``, ``{p}rsum``, ``{p}rcnt``, ``{p}rcnt_amt``, ``{p}rmax``,
    ``{p}ksum``, ``{p}kcnt``, ``{p}max`` for one key, with one shuffle of the rows.

    A unit's facts are one more row of it, which has no time and so comes
    first: a join would sort the emitted rows once more. The copies of block
    b-n follow, then those of b-(n-1), then the owners. Numbered together from
    0, a copy's ordinal relative to the block's first owner is ``number + 1 -
    rows_n`` and an owner's ``number + 1 - (rows_n - rows_mid)``, rows_n and
    rows_mid being the rows in the n and n-2 blocks before. What only owners
    need travels to the second order in a struct that is NULL on copies.
    """
    blk, own, payload, fact = f"{p}blk", f"{p}own", f"{p}payload", f"{p}fact"
    narrow = [key, _US, _SEQ, amount, units, tid]
    wide = [c for c in df.columns if c not in narrow]
    found = F.struct(*[c for c in facts.columns if c not in (key, blk)])
    e = emitted(df, key, narrow, p, width_us).filter(F.col(own) | (F.col(key).isNotNull() & F.col(blk).isNotNull()))
    heads = facts.filter(F.col(key).isNotNull() & F.col(blk).isNotNull()).select(key, blk, found.alias(fact))
    # both sides are dealt by unit, and Spark's union of equally dealt tables stays dealt so
    x = e.repartition(key, blk).unionByName(heads.repartition(key, blk), allowMissingColumns=True)
    w = Window.partitionBy(key, blk).orderBy(_US, _SEQ)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    is_own = F.col(own)
    a_own, u_own, t_own = (F.when(is_own, F.col(c)) for c in (amount, units, tid))
    x = x.withColumns({
        "_f": F.first(fact).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_rn": F.count(own).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_prev": F.lag(F.when(is_own, F.col(_US))).over(w),
        "_os": F.sum(u_own).over(before), "_oc": F.count(a_own).over(before),
        "_ot": F.count(t_own).over(before), "_om": F.max(a_own).over(before),
    })
    # a unit without owner has no facts: its copies go
    x = x.filter(is_own | (F.col(own).isNotNull() & F.col("_f").isNotNull()))
    f = {c: F.col(f"_f.{p}{c}") for c in ("prev_last", "ms", "mc", "mt", "mm", "rows_n", "rows_mid", "ksum", "kcnt", "max")}
    prev = F.coalesce(F.col("_prev"), f["prev_last"])
    kept = {
        **{c: F.col(c) for c in (_US, _SEQ, amount, units, tid, payload)},
        "since": F.when(prev.isNull(), F.lit(0.0)).otherwise((F.col(_US) - prev) / F.lit(1_000_000.0)),
        "s": _total([F.col("_os"), f["ms"]]), "c": F.col("_oc") + f["mc"], "t": F.col("_ot") + f["mt"], "m": F.greatest("_om", f["mm"]),
        "ksum": f["ksum"], "kcnt": f["kcnt"], "max": f["max"],
    }
    ns = F.col(_US) * F.lit(1000) + F.coalesce(F.col("_rn") - F.when(is_own, f["rows_n"] - f["rows_mid"]).otherwise(f["rows_n"]), F.lit(0))
    a_cp, u_cp, t_cp = (F.when(~is_own, F.col(c)) for c in (amount, units, tid))
    x = x.select(key, blk, own, ns.alias(_NS), u_cp.alias("_u"), a_cp.alias("_a"), t_cp.isNotNull().alias("_t"),
                 F.when(is_own, F.struct(*[c.alias(n) for n, c in kept.items()])).alias("_k"))
    desc = Window.partitionBy(key, blk).orderBy(F.col(_NS).desc()).rangeBetween(Window.unboundedPreceding, DAY_NS)
    x = x.withColumns({
        "_cs": F.sum("_u").over(desc), "_cc": F.count("_a").over(desc),
        "_ct": F.count(F.when(F.col("_t"), 1)).over(desc), "_cm": F.max("_a").over(desc),
    }).filter(is_own)
    k = {n: F.col(f"_k.{n}") for n in kept}
    return x.select(
        key, *[k[c].alias(c) for c in narrow[1:]],
        *[F.col(f"_k.{payload}.{c}").alias(c) for c in wide],
        k["since"].alias(f"{p}since"),
        _total([k["s"], F.col("_cs")]).alias(f"{p}rsum"),
        (k["c"] + F.col("_cc")).alias(f"{p}rcnt_amt"),
        (k["t"] + F.col("_ct")).alias(f"{p}rcnt"),
        F.greatest(k["m"], F.col("_cm")).alias(f"{p}rmax"),
        k["ksum"].alias(f"{p}ksum"), k["kcnt"].alias(f"{p}kcnt"), k["max"].alias(f"{p}max"),
    )


def _total(parts: list[Column]) -> Column:
    """The sum of the parts that are not NULL; NULL when all are."""
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in parts[1:]), F.coalesce(parts[0], F.lit(0))))


# ---------------------------------------------------------------------------
# One key, direct window strategy (specification)
# ---------------------------------------------------------------------------

def _key_features_window(df: DataFrame, key: str, amount: str, units: str, tid: str, p: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(_US, _SEQ)
    rows = df.withColumns({
        _NS: F.col(_US) * F.lit(1000) + F.row_number().over(w) - F.lit(1),
        "_prev": F.lag(_US).over(w),
    })
    rows = rows.withColumn(
        f"{p}since", F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise((F.col(_US) - F.col("_prev")) / F.lit(1e6))
    ).drop("_prev")
    frame = Window.partitionBy(key).orderBy(_NS).rangeBetween(-DAY_NS, -1)
    whole = Window.partitionBy(key)
    return rows.withColumns({
        f"{p}rsum": F.sum(units).over(frame),
        f"{p}rcnt_amt": F.count(amount).over(frame),
        f"{p}rcnt": F.count(tid).over(frame),
        f"{p}rmax": F.max(amount).over(frame),
        f"{p}ksum": F.sum(units).over(whole),
        f"{p}kcnt": F.count(amount).over(whole),
        f"{p}max": F.max(amount).over(whole),
    })


def money_units(amount: ColumnOrName, amount_scale: int | None) -> Column:
    """The summation unit of ``amount``.

    With ``amount_scale=None`` sums are plain DOUBLE sums (pandas-like). With a
    scale (2 = cents) each amount is rounded to an exact BIGINT of
    ``10^-scale`` units, so sums and means are exact and bit-identical under
    any partitioning, retry or engine — use it when amounts are money.
    """
    a = F.col(amount) if isinstance(amount, str) else amount
    if amount_scale is None:
        return a
    return F.round(a * F.lit(10 ** amount_scale)).cast(T.LongType())


def units_to_money(units: Column, amount_scale: int | None) -> Column:
    if amount_scale is None:
        return units.cast(T.DoubleType())
    return units.cast(T.DoubleType()) / F.lit(float(10 ** amount_scale))


def engineer_features(
    df: DataFrame,
    *,
    seq: str = "transaction_id",
    strategy: str = "blocked",
    ratio: str = "serving",
    keep_date: bool = False,
    amount_scale: int | None = None,
    block_us: int = HOUR_US,
) -> DataFrame:
    """Adds the 16 engineered columns to a cleaned transaction DataFrame.

    Extra input columns (e.g. a row id) pass through untouched. ``ratio`` is
    ``"serving"`` (zero/NULL average → 0) or ``"training"`` (amount/(avg+1e-6)).
    ``strategy`` is ``"blocked"`` (default), ``"ranked"`` (any skew within an
    hour; needs ``amount_scale``, as its sums are differences; it writes
    intermediate tables when called) or ``"window"``; ``block_us`` is the
    blocks' width in µs, at most 8 h and a divisor of 24 h.
    """
    if DAY_US % block_us or DAY_US // block_us < 3:
        raise ValueError("engineer_features: block_us must divide 24 h and be at most 8 h")
    for required in ("amount", "date", "user_id", "organization_id", "transaction_id"):
        if required not in df.columns:
            raise ValueError(f"engineer_features: missing column '{required}'")
    x = df.withColumns({
        _US: F.unix_micros(F.col("date")),
        _SEQ: F.col(seq),
        _UNITS: money_units("amount", amount_scale),
    })
    keys = (("organization_id", "_o_"), ("user_id", "_u_"))
    if strategy == "blocked":
        # both fact tables come from the input, so neither re-runs a key stage
        facts = [block_facts(x, key, "amount", _UNITS, "transaction_id", p, block_us) for key, p in keys]
        for (key, p), f in zip(keys, facts, strict=True):
            x = _key_features_blocked(x, key, "amount", _UNITS, "transaction_id", p, f, block_us)
    elif strategy == "ranked":
        from txnrisk.operators.ranked import key_features
        if amount_scale is None:
            raise ValueError("engineer_features: strategy 'ranked' needs an amount_scale")
        x = written = materialize(x.withColumn(_RID, F.monotonically_increasing_id()))
        for key, p in keys:
            x = x.join(key_features(written.select(F.col(_RID).alias("rid"), F.col(key).alias("k"), F.col(_US).alias("us"), F.col(_SEQ).alias("seq"), F.col("amount").cast("double").alias("amount"),
                                             F.col(_UNITS).alias("units"), F.col("transaction_id").isNotNull().cast("long").alias("has_tid")), p), F.col(_RID) == F.col("rid")).drop("rid")
    elif strategy == "window":
        for key, p in keys:
            x = _key_features_window(x, key, "amount", _UNITS, "transaction_id", p)
    else:
        raise ValueError(f"engineer_features: unknown strategy '{strategy}'")

    user_null = F.col("user_id").isNull()
    org_null = F.col("organization_id").isNull()
    null_d = F.lit(None).cast(T.DoubleType())

    def filled(c: Column, null_key: Column) -> Column:
        return F.when(null_key, F.lit(0)).otherwise(F.coalesce(c, F.lit(0)))

    def mean(total: str, count: str) -> Column:
        return F.when(F.col(count) > 0, units_to_money(F.col(total), amount_scale) / F.col(count))

    u_avg = F.when(user_null, null_d).otherwise(mean("_u_ksum", "_u_kcnt"))
    ratio_col = S.ratio_serving("amount", u_avg) if ratio == "serving" else S.ratio_training("amount", u_avg)
    derived = {
        **calendar_columns("date"),
        "time_since_last_user_txn": filled(F.col("_u_since"), user_null).cast(T.DoubleType()),
        "time_since_last_org_txn": filled(F.col("_o_since"), org_null).cast(T.DoubleType()),
        "rolling_sum_24hr_org": filled(units_to_money(F.col("_o_rsum"), amount_scale), org_null).cast(T.DoubleType()),
        "rolling_max_24hr_org": filled(F.col("_o_rmax"), org_null).cast(T.DoubleType()),
        "rolling_avg_24hr_user": filled(mean("_u_rsum", "_u_rcnt_amt"), user_null).cast(T.DoubleType()),
        "rolling_count_24hr_user": filled(F.col("_u_rcnt"), user_null).cast(T.LongType()),
        "user_avg_amount": u_avg,
        "user_max_amount": F.when(user_null, null_d).otherwise(F.col("_u_max")).cast(T.DoubleType()),
        "org_avg_amount": F.when(org_null, null_d).otherwise(mean("_o_ksum", "_o_kcnt")),
        "org_max_amount": F.when(org_null, null_d).otherwise(F.col("_o_max")).cast(T.DoubleType()),
        "amount_to_user_avg_ratio": ratio_col.cast(T.DoubleType()),
    }
    passthrough = [c for c in df.columns if keep_date or c != "date"]
    # one projection for all derived columns (one analysis pass, one codegen stage)
    return x.select(*passthrough, *[derived[c].alias(c) for c in DERIVED_FEATURES])


def hot_keys(facts: DataFrame, key: str, rows: str) -> DataFrame:
    """``(_hot, _salts)``: the keys with more rows than a shuffle partition's
    share, which are fewer than the partitions, and how many shares they hold."""
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = facts.select(F.sum(rows)).scalar()
    shares = F.col(rows) * F.lit(parts) / total
    return facts.filter(shares > 1).select(F.col(key).alias("_hot"), F.ceil(shares).cast("int").alias("_salts"))


def salted(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``df`` with ``_salt``: a hot key's rows are dealt to its shares by a hash of the row, the others have 0."""
    content = F.xxhash64(*[F.col(f.name) for f in df.schema if f.dataType.typeName() not in ("map", "variant")])
    return df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left") \
        .withColumn("_salt", F.coalesce(F.pmod(content, F.col("_salts")), F.lit(0))).drop("_hot", "_salts")


def join_facts(df: DataFrame, facts: DataFrame, key: str, rows: str) -> DataFrame:
    """``df`` left-joined to ``facts`` (``_key``, ``rows`` and more; one row per key).

    A hot key's facts are copied once per share, so its rows spread over as
    many tasks as they fill. The hot keys are fewer than the shuffle
    partitions, which bounds what is broadcast.
    """
    hot = hot_keys(facts, "_key", rows)
    copies = facts.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left") \
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hot", "_salts", rows)
    return salted(df, key, hot).join(copies, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_copy")), "left").drop("_key", "_salt", "_copy")


def amount_stats(df: DataFrame, key: str, prefix: str, amount_scale: int | None = None) -> DataFrame:
    """A4 / A5: every row with its key's mean and max amount: one partial
    aggregate, joined back with the rows of hot keys spread. A NULL key has none."""
    units = money_units("amount", amount_scale)
    stats = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.sum(units).alias("_s"), F.count("amount").alias("_c"), F.max("amount").cast(T.DoubleType()).alias(f"{prefix}_max_amount"), F.count("*").alias("_n"))
    mean = F.when(F.col("_c") > 0, units_to_money(F.col("_s"), amount_scale) / F.col("_c"))
    return join_facts(df, stats.withColumn(f"{prefix}_avg_amount", mean).drop("_s", "_c"), key, "_n")


def rolling_order_key(df: DataFrame, key: str, seq: str = "transaction_id") -> DataFrame:
    """The per-key ordinal (0-based position in ``(date, seq)`` order) and
    the strictly increasing order key ``epoch_µs·1000 + ordinal``. Rows are
    ranged by key, date and seq together, so a key of any size spreads over
    ranges; its rows in earlier ranges come from one row per key and range."""
    from txnrisk.operators.ranked import before
    from txnrisk.operators.ranking import in_ranges

    x = df.select(F.struct(*df.columns).alias("row"), F.col(key).alias("k"), F.unix_micros("date").alias("us"), F.col(seq).alias("seq"))
    x = before(in_ranges(x, [F.col("k"), F.col("us"), F.col("seq")], "_part", "_local"), {"ordinal": F.lit(1)})
    return x.select("row.*", "ordinal", (F.col("us") * F.lit(1000) + F.col("ordinal")).alias("order_key_ns"))
