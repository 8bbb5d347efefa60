"""M5 with coefficients as a table: class-balanced L2 logistic regression at any number of levels.

The objective is that of ``ml.fit_model``, ``sum(s * log-loss) + |w|^2 / 2`` with balanced weights ``s`` and a free
intercept. What differs is where it is solved: training rows are a table of entries (row, place, value), the coefficients and
the optimiser's whole memory one of places, and the driver holds scalars only:
the products of the optimiser's vectors (at most ``2 * MEMORY + 1`` of them) and the losses of the tried steps.

The optimiser is limited-memory BFGS whose two loops run on those products, in variables scaled by the diagonal of the
Hessian's bound. An iteration is

* the step's margins: entries joined to the direction by place, partial sums by row;
* the losses of all tried steps, one aggregate of the margins;
* the new gradient: residuals joined by row to the features, packed in a row's arrays, partial sums by place;
* the products with the three new vectors, one aggregate of the coefficients.

Places in more rows than a shuffle partition's share are flagged once. There are at most as many as partitions times
features, so their coefficients are broadcast; every other place is a small key of a shuffled join. So no task's
rows grow with a hot level. Every table is written to the shared checkpoint folder, and its predecessor deleted.

Defined results: NULL or NaN numerics count as 0; a constant numeric and a level or NULL unseen in training have no effect.
Rows whose label or weight is NULL are not learned from. Without rows all coefficients are missing and every probability is 0.5.
"""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.dictionary import Dictionary, build_dictionary, with_places
from txnrisk.operators.ml import feature_contract, with_class_weight
from txnrisk.session import discard, materialize

MEMORY = 6                                             # pairs of steps and gradient differences kept
STEPS = [2.0 ** k for k in range(2, -13, -1)]          # step lengths tried at once
TOLERANCE = 1e-6                                       # of the gradient's norm, against its first one
MAX_ITER = 200
INTERCEPT = "(intercept)"

SLOTS = [f"s{i}" for i in range(MEMORY)] + [f"y{i}" for i in range(MEMORY)] + ["g"]
G = len(SLOTS) - 1


@dataclass(frozen=True)
class TableModel:
    """``coefficients`` (place, weight, gradient, frequent); numerics and the intercept have the places after the dictionary's."""

    dictionary: Dictionary
    scale: dict[str, tuple[float, float]]
    coefficients: DataFrame
    gradient_norm: float
    iterations: int

    def named(self) -> DataFrame:
        """(feature, level, weight, gradient) of every coefficient; numerics and the intercept have no level."""
        own = [F.struct(F.lit(c).alias("feature"), F.lit(self.dictionary.width + i).cast("long").alias("place")) for i, c in enumerate([*self.scale, INTERCEPT])]
        spark = self.coefficients.sparkSession
        dense = spark.range(1).select(F.inline(F.array(*own))).select("feature", F.lit(None).cast("string").alias("level"), "place")
        return (self.dictionary.levels.select("feature", "level", "place").unionByName(dense)
                .join(self.coefficients, "place").select("feature", "level", "weight", "gradient"))


def _number(c: str) -> Column:
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def _scales(df: DataFrame, numeric: list[str]) -> dict[str, tuple[float, float]]:
    r = df.agg(*[f(_number(c)).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("m", F.avg), ("d", F.stddev_samp))]).first() if numeric else {}
    return {c: (r[f"m{i}"] or 0.0, r[f"d{i}"] or 0.0) for i, c in enumerate(numeric)}


def _packed(df: DataFrame, dictionary: Dictionary, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """(row, places, values): every row of ``df``, which has a ``_row``, with its features in two arrays."""
    values = [(_number(c) - mean) / std if std else F.lit(0.0) for c, (mean, std) in scale.items()] + [F.lit(1.0)]
    places = F.array(*[F.lit(dictionary.width + i).cast("long") for i in range(len(values))])
    hot = with_places(df, dictionary, "_hot")
    return hot.select(F.col("_row").alias("row"), F.concat(F.col("_hot").cast("array<long>"), places).alias("places"),
                      F.concat(F.transform("_hot", lambda p: F.lit(1.0)), F.array(*[v.cast("double") for v in values])).alias("values"))


def _entries(packed: DataFrame) -> DataFrame:
    """(place, value, and the columns beside the arrays) of every non-zero feature."""
    kept = [c for c in packed.columns if c not in ("places", "values")]
    return packed.select(*kept, F.inline(F.arrays_zip("places", "values")).alias("place", "value")).filter("value <> 0")


def _times(entries: DataFrame, coefficients: DataFrame, weight: Column, out: str) -> DataFrame:
    """(row, ``out``): entries times ``weight`` of their place, summed by row."""
    w = coefficients.select("place", "frequent", weight.alias("_w"))
    few = entries.filter("frequent").join(F.broadcast(w.filter("frequent").drop("frequent")), "place")
    many = entries.filter("NOT frequent").join(w.filter("NOT frequent").drop("frequent"), "place")
    return few.unionByName(many).groupBy("row").agg(F.sum(F.col("value") * F.col("_w")).alias(out))


def _softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _gradient(packed: DataFrame, margins: DataFrame, z: Column) -> DataFrame:
    """(place, sum): the log-loss's gradient, partial sums by place. Rows meet their residual before their features are laid out."""
    residual = margins.select("row", (F.col("s") * (_sigmoid(z) - F.col("y"))).alias("residual"))
    return _entries(packed.join(residual, "row")).groupBy("place").agg(F.sum(F.col("value") * F.col("residual")).alias("sum"))


def _products(coefficients: DataFrame, new: list[int]) -> tuple[dict, float]:
    """Products of the vectors ``new`` with all vectors, and the norm of the gradient in its own variables."""
    pairs = sorted({(min(i, j), max(i, j)) for i in new for j in range(len(SLOTS))})
    r = coefficients.agg(F.sum((F.col("g") / F.col("root")) ** 2).alias("norm"),
                         *[F.sum(F.col(SLOTS[i]) * F.col(SLOTS[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return {(i, j): r[f"p{i}_{j}"] or 0.0 for i, j in pairs}, math.sqrt(r["norm"] or 0.0)


def direction(products: np.ndarray, order: list[int]) -> np.ndarray:
    """The quasi-Newton direction as factors of the vectors; ``order`` are the slots in use, oldest first."""
    c, alpha = np.zeros(len(SLOTS)), {}
    c[G] = 1.0
    for i in reversed(order):
        alpha[i] = products[i] @ c / products[i, MEMORY + i]
        c[MEMORY + i] -= alpha[i]
    if order:
        last = order[-1]
        c *= products[last, MEMORY + last] / products[MEMORY + last, MEMORY + last]
    for i in order:
        c[i] += alpha[i] - products[MEMORY + i] @ c / products[i, MEMORY + i]
    return -c


def fit_table_model(train: DataFrame, label: str = "is_fraud", max_iter: int = MAX_ITER, tolerance: float = TOLERANCE,
                    numeric: list[str] | None = None, categorical: list[str] | None = None) -> TableModel:
    """Fit on engineered rows; the feature lists are those of the contract unless given."""
    contract = feature_contract(train.columns)
    numeric = contract["numeric"] if numeric is None else numeric
    categorical = contract["categorical"] if categorical is None else categorical
    weighted = with_class_weight(train.filter(F.col(label).isNotNull()), label, "_s").filter("_s IS NOT NULL")
    rows = materialize(weighted.select(*numeric, *[c for c in categorical if c not in numeric], F.col(label).cast("double").alias("_y"), "_s",
                                       F.monotonically_increasing_id().alias("_row")))
    dictionary, scale = build_dictionary(rows, categorical), _scales(rows, numeric)
    packed = materialize(_packed(rows, dictionary, scale))
    plain = _entries(packed)
    margins = materialize(rows.select(F.col("_row").alias("row"), F.col("_y").alias("y"), F.col("_s").alias("s"), F.lit(0.0).alias("z")))

    share = max(1, rows.count() // int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bound = plain.join(margins.select("row", "s"), "row").groupBy("place").agg(F.count("*").alias("n"), F.sum(F.col("s") * F.col("value") ** 2).alias("q"))
    penalty = (F.col("place") != dictionary.width + len(numeric)).cast("double")
    stats = materialize(bound.select("place", penalty.alias("penalty"), (F.lit(1.0) / F.sqrt(penalty + F.col("q") / 4)).alias("root"), (F.col("n") > share).alias("frequent")))
    hot = stats.filter("frequent").select("place", "frequent")
    entries = materialize(plain.join(F.broadcast(hot), "place", "left").select("row", "place", "value", F.coalesce("frequent", F.lit(False)).alias("frequent")))

    first = stats.join(_gradient(packed, margins, F.col("z")), "place")
    coefficients = materialize(first.select("place", "penalty", "root", "frequent", F.lit(0.0).alias("w"),
                                            *[F.lit(0.0).alias(c) for c in SLOTS[:G]], (F.col("sum") * F.col("root")).alias("g")))
    table, order, done = np.zeros((len(SLOTS), len(SLOTS))), [], 0
    found, norm = _products(coefficients, [G])
    limit = tolerance * norm
    while True:
        for (i, j), v in found.items():
            table[i, j] = table[j, i] = v
        if norm <= limit or done == max_iter:
            break
        factors = direction(table, order)
        step = functools.reduce(operator.add, [F.lit(float(f)) * F.col(c) for f, c in zip(factors, SLOTS, strict=True) if f])
        moved = F.col("root") * step
        stepped = materialize(margins.join(_times(entries, coefficients, moved, "dz"), "row", "left").withColumn("dz", F.coalesce("dz", F.lit(0.0))))
        at = {a: F.col("z") + a * F.col("dz") for a in [0.0, *STEPS]}
        losses = stepped.agg(*[F.sum(F.col("s") * (_softplus(z) - F.col("y") * z)).alias(f"l{i}") for i, z in enumerate(at.values())])
        norms = coefficients.agg(*[F.sum(F.col("penalty") * (F.col("w") + a * moved) ** 2).alias(f"l{i}") for i, a in enumerate(at)])
        loss, penalties = sorted((tuple(r) for r in losses.select("*", F.lit(0)).union(norms.select("*", F.lit(1))).collect()), key=lambda r: r[-1])
        values = [x + y / 2 for x, y in zip(loss[:-1], penalties[:-1], strict=True)]
        best = min(range(len(values)), key=values.__getitem__)
        if best == 0:        # no step lowers the loss any more: the end of what doubles can tell
            discard(stepped)
            break
        length, slot = list(at)[best], done % MEMORY
        moved_margins = stepped.select("row", "y", "s", (F.col("z") + length * F.col("dz")).alias("z"))
        updated = coefficients.join(_gradient(packed, moved_margins, F.col("z")), "place", "left")
        weight = F.col("w") + length * moved
        gradient = F.col("root") * (F.coalesce("sum", F.lit(0.0)) + F.col("penalty") * weight)
        new = {"w": weight, SLOTS[slot]: length * step, SLOTS[MEMORY + slot]: gradient - F.col("g"), "g": gradient}
        following = materialize(updated.withColumns(new).drop("sum"))
        for old in (coefficients, margins):
            discard(old)
        coefficients, margins, done = following, moved_margins, done + 1
        order = [i for i in order if i != slot] + [slot]
        found, norm = _products(coefficients, [slot, MEMORY + slot, G])
    for old in (margins, entries, packed):
        discard(old)
    kept = coefficients.select("place", F.col("w").alias("weight"), (F.col("g") / F.col("root")).alias("gradient"), "frequent")
    return TableModel(dictionary, scale, kept, norm, done)


def table_probability(model: TableModel, df: DataFrame) -> DataFrame:
    """M6/M7: ``df`` with ``prediction`` (0/1) and ``fraud_probability``; writes the rows once, numbered, when called."""
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    hot = model.coefficients.filter("frequent").select("place", "frequent")
    entries = (_entries(_packed(rows, model.dictionary, model.scale)).join(F.broadcast(hot), "place", "left")
               .withColumn("frequent", F.coalesce("frequent", F.lit(False))))
    z = _times(entries, model.coefficients, F.col("weight"), "_z").withColumnRenamed("row", "_row")
    p = _sigmoid(F.coalesce("_z", F.lit(0.0)))
    return rows.join(z, "_row", "left").select(*df.columns, (p > 0.5).cast("int").alias("prediction"), p.alias("fraud_probability"))
