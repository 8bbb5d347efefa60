"""Mixing to target weights: iterative proportional fitting and calibrated sampling.

Documents are counted in cells of (source, language, topic). Raking scales
the cells' token mass in turn to the target share of every source, language
and topic until all three marginals fit. No document is drawn twice, so no
cell can give more than its tokens: raking has that upper bound on each cell,
and what a bound holds back is raked to the other cells. A cell's weight is
its raked over its natural mass; a document is drawn with probability kept
share * weight of its cell, so the expected draw itself fits the marginals.
The kept share is ``keep`` or, where no draw of that size can fit, a smaller
one that does; it and the distance reached are columns of the result.

The draw is a hash of doc_id and text: a repeated run, a retried task and a
repeated row all decide alike.

Only the cell table, one row per combination that occurs, is iterated; each
dimension's step is one small write to the shared folder. The driver gets
scalars.

Defined results: null source, language or topic is a value of its own, shown
as null. A null text has no token. Cells without a token have weight and
probability 0. Shares are normalised over the values that occur; a value that
explicit targets leave out has target 0. Without a ``topic`` column the topic
is the bucket of a text's most frequent long word (ties: the smaller word),
``none`` without one. Extra columns pass through ``mixed``.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import add_columns, discard, saved

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a value: its natural share to this power, normalised.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
KEEP = 0.7          # expected share of the tokens drawn, at most
TOPICS = 8          # buckets of derived topics
LONG_WORD = 7       # letters of a word that can name a topic
TOLERANCE = 1e-6    # largest difference of a marginal share from its target
SWEEPS = 100
BELOW = 0.98        # of the largest kept share that single marginals allow, tried where keep is above it
LESS = 0.93         # factor of the kept share after a try that does not fit
TRIES = 12
WORD = re.compile(r"[^\W\d_]{%d,}" % LONG_WORD)


def topic_and_tokens(text: str | None) -> tuple[str, int]:
    words = Counter(WORD.findall((text or "").lower()))
    top = min(words.items(), key=lambda x: (-x[1], x[0]), default=None)
    return ("none" if top is None else f"topic{crc32(top[0].encode()) % TOPICS}"), len((text or "").split())


def described(docs: DataFrame, topic: str, tokens: str) -> DataFrame:
    """``docs`` with a derived topic and the whitespace-separated tokens of each text."""
    added = T.StructType([T.StructField(topic, T.StringType()), T.StructField(tokens, T.LongType())])

    def describe(texts: list) -> dict[str, list]:
        found = [topic_and_tokens(t) for t in texts]
        return {topic: [x[0] for x in found], tokens: [x[1] for x in found]}

    return add_columns(docs, "text", added, describe)


def shares(mass: DataFrame) -> DataFrame:
    """(value, share) from (value, m); the total is one number."""
    total = mass.agg(F.sum("m")).first()[0] or 1.0
    return mass.select("value", (F.col("m") / F.lit(total)).alias("share"))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): every value's share of the tokens, to a power and normalised."""
    mass = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("n").cast("double").alias("m")).filter("m > 0")
    return shares(mass.withColumn("m", F.pow("m", F.lit(power))))


def normalised(cells: DataFrame, dimension: str, targets: DataFrame) -> DataFrame:
    """Explicit targets (value, share) over the values that have tokens."""
    here = cells.filter("n > 0").select(F.col(dimension).alias("here")).distinct()
    return shares(here.join(targets, F.col("here").eqNullSafe(F.col("value"))).select("value", F.col("share").cast("double").alias("m")))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, sweeps: int = SWEEPS, kept: float | None = None) -> DataFrame:
    """``cells`` (dimensions, n) with the raked share ``x`` of each cell."""
    return raked_within(cells, targets, tolerance, sweeps, kept)[0]


def raked_within(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, sweeps: int = SWEEPS,
                 kept: float | None = None) -> tuple[DataFrame, float]:
    """``cells`` (dimensions, n) with the raked share ``x`` of each cell, and the largest difference of a marginal from its target.

    With ``kept``, x is at most the cell's natural share over it. A value's
    factor is then a Newton step to its target over its cells below their
    bounds, which never overshoots.

    Where the targets contradict the combinations that occur, or the bounds,
    raking stops when sweeps bring the marginals no nearer; the last dimension
    then fits and the others as nearly as that sweep left them.
    """
    total = cells.agg(F.sum("n")).first()[0] or 0
    natural = F.col("n") / F.lit(float(max(total, 1)))
    current = cells.withColumn("y", natural).withColumn("_bound", natural / F.lit(kept) if kept else F.lit(float("inf")))
    if not total:
        return saved(current.withColumnRenamed("y", "x").drop("_bound"), "cells"), 0.0
    for d, target in targets.items():  # a cell knows its targets from here on
        wanted = target.select(F.col("value").alias("_value"), F.col("share").alias(f"_goal_{d}"))
        current = current.join(wanted, F.col(d).eqNullSafe(F.col("_value")), "left").drop("_value").fillna(0.0, [f"_goal_{d}"])
    current = saved(current, "cells")
    nearest, stuck, farthest = float("inf"), 0, float("inf")
    for _ in range(sweeps):
        seen = []
        for d in targets:
            current, off = fitted(current, d)
            seen.append(off)
        stuck = stuck + 1 if max(seen) > 0.999 * nearest else 0
        nearest = min(nearest, max(seen))
        if max(seen) <= tolerance or stuck >= 3:
            farthest = distance(current, list(targets))
            if farthest <= tolerance or stuck >= 3:
                break
    else:
        farthest = distance(current, list(targets))
    return current.withColumn("x", F.least("y", "_bound")).drop("y", "_bound", *[f"_goal_{d}" for d in targets]), farthest


def marginals(current: DataFrame, d: str) -> DataFrame:
    """Per value of ``d`` the share in cells at their bounds (c) and below (u), the target, and how far the sum is from it."""
    x, full = F.least("y", "_bound"), F.col("y") >= F.col("_bound")
    return current.groupBy(F.col(d).alias("_key")).agg(F.sum(F.when(full, x).otherwise(0.0)).alias("_c"), F.sum(F.when(full, 0.0).otherwise(x)).alias("_u"), F.first(f"_goal_{d}").alias("_t")) \
        .withColumn("_off", F.abs(F.col("_c") + F.col("_u") - F.col("_t")))


def fitted(current: DataFrame, d: str) -> tuple[DataFrame, float]:
    """``current`` scaled to the targets of ``d``, and how far the farthest value was from its target before.

    One small plan of one shape per step, and one write, which also observes
    the distance.
    """
    m = F.col("_c") + F.col("_u")
    factor = F.when(m > F.col("_t"), F.col("_t") / m).when(F.col("_u") > 0, (F.col("_t") - F.col("_c")) / F.col("_u")).otherwise(1.0)
    step, seen = marginals(current, d).select("_key", "_off", factor.alias("_f")), Observation()
    scaled = current.join(step, F.col(d).eqNullSafe(F.col("_key"))).withColumn("y", F.col("y") * F.col("_f")).observe(seen, F.max("_off").alias("off"))
    following = saved(scaled.select(current.columns), "cells")
    discard(current)
    return following, seen.get["off"] or 0.0


def distance(current: DataFrame, dimensions: list[str]) -> float:
    """The largest difference of a marginal from its target."""
    return reduce(DataFrame.union, [marginals(current, d).select("_off") for d in dimensions]).agg(F.max("_off")).first()[0]


def largest_share(cells: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest kept share at which every value by itself has tokens enough for its target."""
    total = float(max(cells.agg(F.sum("n")).first()[0] or 0, 1))
    return min((m for d, target in targets.items() if (m := cells.groupBy(F.col(d).alias("key")).agg(F.sum("n").alias("m"))
                .join(target, F.col("key").eqNullSafe(F.col("value"))).filter("share > 0")
                .agg(F.min(F.col("m") / (F.col("share") * total))).first()[0]) is not None), default=1.0)


def raked_draw(cells: DataFrame, targets: dict[str, DataFrame], keep: float) -> tuple[DataFrame, float, float]:
    """``cells`` with ``x``, the kept share and the distance: of ``keep`` or the next smaller share tried that fits the targets.

    If even raking without bounds does not fit them, the targets contradict
    each other and the first try stands.
    """
    most = largest_share(cells, targets)
    kept = min(keep, 1.0) if most >= keep else BELOW * most
    first = raked, off = raked_within(cells, targets, kept=kept)
    if off <= TOLERANCE:
        return raked, kept, off
    free, off = raked_within(cells, targets)
    if off > TOLERANCE:
        return first[0], kept, first[1]
    total = cells.agg(F.sum("n")).first()[0]
    unbounded = 1.0 / free.filter("n > 0").agg(F.max(F.col("x") * float(total) / F.col("n"))).first()[0]
    for _ in range(TRIES):
        kept *= LESS
        if kept <= unbounded:
            break
        raked, near = raked_within(cells, targets, kept=kept)
        if near <= TOLERANCE:
            return raked, kept, near
    return free, min(keep, unbounded), off


def draw(doc_id: Column, text_hash: Column) -> Column:
    """A number in [0, 1) that depends on the document alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("draw"), doc_id, text_hash), 11) / F.lit(float(1 << 53))


def weighted(rows: DataFrame, targets: dict[str, DataFrame] | None = None, temper: dict[str, float] = TEMPER, keep: float = KEEP) -> DataFrame:
    """``rows`` (source, lang, topic, n_tokens, u, ...) with weight, probability, sampled, kept_share and distance. ``rows`` is read more than once."""
    cells = saved(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")), "cells")
    goal = {d: saved(normalised(cells, d, targets[d]) if targets and d in targets else tempered(cells, d, temper[d]), f"target-{d}") for d in DIMENSIONS}
    raked, kept, distance = raked_draw(cells, goal, keep)
    total = cells.agg(F.sum("n")).first()[0] or 0
    scaled = saved(raked.withColumn("weight", F.when(F.col("n") > 0, F.col("x") * float(max(total, 1)) / F.col("n")).otherwise(0.0)), "weights")
    table = scaled.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "weight", F.least(F.lit(1.0), F.col("weight") * kept).alias("probability"),
                          F.lit(kept).alias("kept_share"), F.lit(distance).alias("distance"))
    match = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS]
    return rows.join(table, match).drop(*[f"_{d}" for d in DIMENSIONS]).withColumn("sampled", F.col("u") < F.col("probability"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled of every document; kept_share and distance are those of the whole draw."""
    rows = described(docs.select("doc_id", "source", "lang", F.xxhash64("text").alias("h"), "text",
                                 *([F.col("topic").alias("own_topic")] if "topic" in docs.columns else [])), "topic", "n_tokens")
    if "topic" in docs.columns:
        rows = rows.withColumn("topic", F.col("own_topic"))
    rows = saved(rows.select("doc_id", "source", "lang", "topic", "n_tokens", draw(F.col("doc_id"), F.col("h")).alias("u")), "mix-rows")
    return weighted(rows, targets, keep=keep).select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", "sampled", "kept_share", "distance")


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """The documents drawn, with all their columns."""
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "source", "lang", "text", F.xxhash64("text").alias("h"),
                         *([F.col("topic").alias("own_topic")] if "topic" in docs.columns else []))
    rows = described(packed, "topic", "n_tokens")
    if "topic" in docs.columns:
        rows = rows.withColumn("topic", F.col("own_topic"))
    rows = saved(rows.select("row", "source", "lang", "topic", "n_tokens", draw(F.col("doc_id"), F.col("h")).alias("u")), "mix-docs")
    return weighted(rows, targets, keep=keep).filter("sampled").select("row.*")
