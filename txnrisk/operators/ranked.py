"""24 h features by global rank: no unit of work depends on a key or an hour.

The blocked strategy gives a (key, hour) to one task. Here rows are ranged by
(key, date, seq) together, so a task holds a range of rows whatever key or
hour they are of; one key's rows in one range are a *piece*. Only the first
and last key of a range can have pieces in others, so what a piece needs of
other ranges is in a table with at most two rows per range. Every step works on pieces, or on blocks of
at most ``block`` rows of a key:

1. *Order key.* A row's ordinal is the rows of its key in earlier ranges plus
   its place in the piece. Prefix sums and counts up to the row likewise.
2. *Frame start.* Each row asks at ``ns - 24h``. Rows and questions are
   ranged together; the rows of the key before a question are the frame's
   first place ``a``, and their prefix sums the ones to take off. Sums and
   counts are differences, exact because amounts are whole units.
3. *Maxima* have no differences. A key's rows are cut into blocks by ordinal.
   A frame is the part in the row's own block (a sliding frame that never
   leaves the block), the rest of the block that holds ``a`` (a suffix
   maximum, which the question reads off the row after it), and whole blocks
   between, looked up in a sparse table of block maxima over powers of two.
   First blocks of frames do not decrease, so the distinct (first, last)
   pairs are at most twice the blocks, and each is looked up once.

``engineer_features(strategy="ranked")`` joins the result to the rows by a
row number, which has no hot values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.operators.ranking import in_ranges
from txnrisk.schema import DAY_NS
from txnrisk.session import materialize

BLOCK = 1024     # rows of a key whose frames are searched row by row


def edges(table: DataFrame, aggregates: list[Column]) -> DataFrame:
    """Pieces (_p, _k and ``aggregates``) of the first and last key of every range of ``table`` (ranged: k, _part, _local).

    Ranges ascend in the key first, so no other piece has a second one of its
    key: two rows per range tell all that pieces need of other ranges."""
    key = F.struct("k")
    ends = table.groupBy("_part").agg(F.min_by(key, "_local").alias("_first"), F.max_by(key, "_local").alias("_end"))
    held = table.join(F.broadcast(ends), "_part").filter(key.eqNullSafe(F.col("_first")) | key.eqNullSafe(F.col("_end")))
    return held.groupBy(F.col("_part").alias("_p"), F.col("k").alias("_k")).agg(*aggregates)


def before(table: DataFrame, sums: dict[str, Column], ranged: DataFrame | None = None) -> DataFrame:
    """``table`` (ranged: k, _part, _local) with the totals of ``sums`` over the key's rows before each row.

    What the ranges before hold of a key comes from the edges of ``ranged``, the written table that ``table`` adds
    columns to (itself if not given); inside, sums run along the range's order.
    """
    earlier = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = edges(table if ranged is None else ranged, [F.sum(c).alias(f"_{n}") for n, c in sums.items()]).select("_p", "_k", *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums])
    here = Window.partitionBy("_part", "k").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return _with_edges(table, offsets).select(
        *table.columns, *[(F.coalesce(F.col(f"_{n}"), zero) + F.coalesce(F.sum(c).over(here), zero)).alias(n) for n, c in sums.items()])


def _with_edges(table: DataFrame, found: DataFrame) -> DataFrame:
    return table.join(F.broadcast(found), (F.col("_part") == F.col("_p")) & F.col("k").eqNullSafe(F.col("_k")), "left")   # two rows per range


def ordered_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (rid, k, us, seq, amount, units, has_tid) with ordinal, ns, since, prefix sums and the key's totals."""
    r = in_ranges(rows, [F.col("k"), F.col("us"), F.col("seq"), F.col("rid")], "_part", "_local")
    totals = {"ksum": F.sum("units"), "kcnt": F.count("amount"), "kmax": F.max("amount")}
    pieces = edges(r, [F.max("us").alias("_last"), F.sum("units").alias("_s"), F.count("amount").alias("_c"), F.max("amount").alias("_m")])
    by_key = Window.partitionBy("_k")
    facts = pieces.select("_p", "_k", F.lag("_last").over(by_key.orderBy("_p")).alias("_last"),
                          F.sum("_s").over(by_key).alias("_ksum"), F.sum("_c").over(by_key).alias("_kcnt"), F.max("_m").over(by_key).alias("_kmax"))
    piece = Window.partitionBy("_part", "k")
    x = _with_edges(r, facts).withColumn("_prev", F.coalesce(F.lag("us").over(piece.orderBy("_local")), F.col("_last")))
    x = x.withColumn("since", F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise((F.col("us") - F.col("_prev")) / F.lit(1_000_000.0)))
    x = x.withColumns({c: F.when(F.col("_p").isNotNull(), F.col(f"_{c}")).otherwise(v.over(piece)) for c, v in totals.items()})
    sums = {"ordinal": F.lit(1), "ps": F.coalesce("units", F.lit(0)), "pc": F.col("amount").isNotNull().cast("long"), "pt": F.col("has_tid")}
    x = before(x.select(*r.columns, "since", *totals), sums, r)
    return x.withColumn("ns", F.col("us") * F.lit(1000) + F.col("ordinal")).drop("_part", "_local", "seq", "us")


def in_blocks(x: DataFrame, block: int) -> DataFrame:
    """Adds the row's block, the maximum of the frame inside it and the maximum from the row to the block's end."""
    unit = Window.partitionBy("k", "blk")
    return x.withColumn("blk", F.floor(F.col("ordinal") / block)).withColumns({
        "own_max": F.max("amount").over(unit.orderBy("ns").rangeBetween(-DAY_NS, -1)),
        "rest_max": F.max("amount").over(unit.orderBy(F.col("ns").desc()).rowsBetween(Window.unboundedPreceding, 0)),
    }).drop("ordinal")


def frame_starts(x: DataFrame, block: int) -> DataFrame:
    """Every row with its frame's first ordinal ``a``, the prefix sums there and ``a_rest``, the maximum from a to its block's end."""
    carried = F.struct("since", "ps", "pc", "pt", "ksum", "kcnt", "kmax", "own_max", "blk")
    shape = x.select(carried.alias("q")).schema["q"].dataType
    rows = x.select("k", F.col("ns").alias("t"), F.lit(1).alias("kind"), F.when(F.col("ns").isNull(), F.col("rid")).alias("rid"), F.col("rest_max").alias("next_max"), F.lit(None).cast(shape).alias("q"),
                    F.coalesce("units", F.lit(0)).alias("_units"), F.col("amount").isNotNull().cast("long").alias("_has"), F.col("has_tid").alias("_tid"))
    zero = F.lit(0).cast("long")
    asked = x.select("k", (F.col("ns") - F.lit(DAY_NS)).alias("t"), F.lit(0).alias("kind"), "rid", F.lit(None).cast("double").alias("next_max"), carried.alias("q"),
                     zero.alias("_units"), zero.alias("_has"), zero.alias("_tid"))
    e = in_ranges(rows.unionByName(asked), [F.col("k"), F.col("t"), F.col("kind"), F.col("rid")], "_part", "_local")
    # the row after a question is the next one in its piece, or the first one of the key's next piece with a row
    is_row = F.col("kind") == 1
    first = edges(e, [F.min_by(F.when(is_row, F.struct("next_max")), F.when(is_row, F.col("_local"))).alias("_first")])
    later = Window.partitionBy("_k").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = first.select("_p", "_k", F.last("_first", ignorenulls=True).over(later).alias("_ahead"))
    here = Window.partitionBy("_part", "k").orderBy(F.col("_local").desc()).rowsBetween(Window.unboundedPreceding, 0)
    e2 = _with_edges(e, ahead).withColumn("_next", F.coalesce(F.last(F.when(is_row, F.struct("next_max")), ignorenulls=True).over(here), F.col("_ahead")))
    e2 = before(e2.select(*e.columns, "_next"), {"a": F.col("kind").cast("long"), "as": F.col("_units"), "ac": F.col("_has"), "at": F.col("_tid")}, e)
    return e2.filter(~is_row).select("k", "rid", "q.*", "a", "as", "ac", "at", F.col("_next.next_max").alias("a_rest"), F.floor(F.col("a") / block).alias("a_blk"))


def between_maxima(x: DataFrame, starts: DataFrame) -> DataFrame:
    """(k, a_blk, blk, mid_max): the maximum of the whole blocks between, for every distinct pair with such blocks."""
    pairs = materialize(starts.filter("blk - a_blk > 1").select("k", "a_blk", "blk").distinct())
    longest = pairs.agg(F.max(F.col("blk") - F.col("a_blk") - 1)).first()[0] or 0
    level = materialize(x.groupBy("k", "blk").agg(F.max("amount").alias("m")))
    found = None
    for j in range(int(math.log2(longest)) + 1 if longest else 0):
        wide = F.col("blk") - F.col("a_blk") - 1
        here = pairs.filter((wide >= 1 << j) & (wide < 2 << j))
        table = level.select(F.col("k").alias("_k"), F.col("blk").alias("_b"), F.col("m"))
        sides = [here.join(table, F.col("k").eqNullSafe(F.col("_k")) & (F.col("_b") == at)).select("k", "a_blk", "blk", "m") for at in (F.col("a_blk") + 1, F.col("blk") - (1 << j))]
        both = sides[0].unionByName(sides[1])
        found = both if found is None else found.unionByName(both)
        further = level.select(F.col("k").alias("_k"), (F.col("blk") - (1 << j)).alias("_b"), F.col("m").alias("_m"))
        level = materialize(level.join(further, F.col("k").eqNullSafe(F.col("_k")) & (F.col("blk") == F.col("_b"))).select("k", "blk", F.greatest("m", "_m").alias("m")))
    if found is None:
        return pairs.withColumn("mid_max", F.lit(None).cast("double"))
    return found.groupBy("k", "a_blk", "blk").agg(F.max("m").alias("mid_max"))


def key_features(rows: DataFrame, p: str, block: int = BLOCK) -> DataFrame:
    """rid and the features of one key, named as the blocked strategy names them with prefix ``p``."""
    x = materialize(in_blocks(ordered_rows(rows), block))
    starts = materialize(frame_starts(x, block))
    mid = between_maxima(x, starts).select(F.col("k").alias("_k"), F.col("a_blk").alias("_a"), F.col("blk").alias("_b"), "mid_max")
    x = starts.join(mid, F.col("k").eqNullSafe(F.col("_k")) & (F.col("a_blk") == F.col("_a")) & (F.col("blk") == F.col("_b")), "left")
    earlier = F.when(F.col("a_blk") < F.col("blk"), F.col("a_rest"))
    return x.select(
        "rid", F.col("since").alias(f"{p}since"),
        F.when(F.col("pc") > F.col("ac"), F.col("ps") - F.col("as")).alias(f"{p}rsum"),
        (F.col("pc") - F.col("ac")).alias(f"{p}rcnt_amt"), (F.col("pt") - F.col("at")).alias(f"{p}rcnt"),
        F.greatest("own_max", earlier, "mid_max").alias(f"{p}rmax"),
        F.col("ksum").alias(f"{p}ksum"), F.col("kcnt").alias(f"{p}kcnt"), F.col("kmax").alias(f"{p}max"))
