"""M3 at any number of levels: a distributed dictionary in place of labels on the driver.

The levels of every categorical column are one table (feature, level, index),
numbered by ranges: distinct levels are found with partial aggregation, ranged
by (feature, level), and a level's index is its place less its feature's first
place. The driver gets one row per feature. Rows get their indexes
by joining that table, column by column; Spark broadcasts a feature's levels
where they are few and shuffles where they are many.

Levels are compared as text. NULL and levels that the dictionary lacks have no
place, which one-hot encodes as all zeros, like an encoder that ignores them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.ranking import in_ranges, range_starts


@dataclass(frozen=True)
class Dictionary:
    """``levels`` (feature, level, index, place) and, per feature in order, where its places begin and how many there are."""

    levels: DataFrame
    first: dict[str, int]
    size: dict[str, int]

    @property
    def width(self) -> int:
        return sum(self.size.values())


def build_dictionary(df: DataFrame, cols: list[str]) -> Dictionary:
    """The levels of ``cols``, numbered from 0 in text order within each; places follow one another over the columns."""
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for i, c in enumerate(cols)]))
    found = df.select(entry.alias("e")).select("e.*").filter("level IS NOT NULL").distinct()
    ranged = in_ranges(found, [F.col("o"), F.col("level")], "part", "local")
    first, size, place = dict.fromkeys(cols, 0), dict.fromkeys(cols, 0), 0
    for _, feature, n in sorted(tuple(r) for r in ranged.groupBy("o", "feature").count().collect()):   # one row per feature
        first[feature], size[feature] = place, n
        place += n
    starts = range_starts(ranged, "part", {"n": F.count("*")}).select("part", "n_before")               # one row per range
    begin = F.element_at(F.create_map(*[F.lit(x) for p in first.items() for x in p]), F.col("feature"))
    at = (F.col("n_before") + F.col("local")).cast("long")
    numbered = ranged.join(F.broadcast(starts), "part")
    return Dictionary(numbered.select("feature", "level", (at - begin).cast("long").alias("index"), at.alias("place")), first, size)


def with_places(df: DataFrame, dictionary: Dictionary, out: str = "one_hot") -> DataFrame:
    """``df`` with the array of the places that are 1 in its one-hot encoding, ascending; the others are 0."""
    x, names = df, []
    for i, c in enumerate(dictionary.first):
        mine = dictionary.levels.filter(F.col("feature") == c).select(F.col("level").alias(f"_level{i}"), F.col("place").alias(f"_place{i}"))
        x = x.join(mine, F.col(c).cast("string") == F.col(f"_level{i}"), "left")
        names.append(f"_place{i}")
    return x.select(*df.columns, F.array_compact(F.array(*names)).alias(out))
