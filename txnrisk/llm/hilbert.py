"""Sharding along a Hilbert curve.

Metadata dimensions (text size, source by its whole value, doc_id) are quantised to equal-
frequency cells, the cells' Hilbert index orders the rows, and runs of that
order become shards. Rows that are near in all dimensions share a shard, so
each file's statistics cover a small box and filters on any of the dimensions
skip files.

The law is ``rows``: shard sizes in rows differ by one at most. The order is
total up to equal rows: curve index, then doc_id, text checksum and size.

Defined results: null values fall in the lowest cell and sort first; a null
text has size 1 and the checksum of the empty string. With fewer rows than
shards the last shards are empty. Repeated rows get slots of their own. Extra
columns pass through ``with_shards``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import as_array, discard, fresh, numbered, saved, tasks

SHARDS = 16
BITS = 8            # bits of a quantised dimension
ACCURACY = 10_000   # of the quantile sketches that place the cell borders
SKETCHES = 256      # groups of input partitions whose sketches are merged apart


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of rows of ``cells`` (n, d): Gray-code the axes bit by bit from the top, then interleave them."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = index << 1 | (x[i] >> b & 1)
    return index


def text_cells(df: DataFrame, name: str, bits: int = BITS) -> Column:
    """The equal-frequency cell, 0 to 2 ** bits - 1, of the whole text in column ``name``; null is in the lowest.

    The distinct texts are counted and ranged, and the smallest of each cell
    is its border: at most 2 ** bits texts reach the driver.
    """
    counts = df.groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n")).filter("v IS NOT NULL")
    table = saved(counts.repartitionByRange(tasks(df.sparkSession), "v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()), "texts")
    sums = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect())   # one row per range
    total = sum(n for _, n in sums)
    if not total:
        return F.lit(0)
    starts, before = [], 0
    for part, n in sums:
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "part int, start long")
    earlier = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    placed = table.withColumn("before", F.coalesce(earlier, F.lit(0))).join(F.broadcast(offsets), "part")
    cell = F.floor((F.col("start") + F.col("before")) / F.lit(total) * (1 << bits))
    borders = sorted(r["v"] for r in placed.groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).collect())
    discard(table)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(v) for v in borders[1:]]), lambda v: v <= F.col(name))), F.lit(0)) if borders[1:] else F.lit(0)


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; one for a null text."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def cell_borders(df: DataFrame, dimensions: list[Column], bits: int) -> list[np.ndarray]:
    """Ascending cell borders of each dimension, at most 2 ** bits - 1 numbers.

    Sketches are merged in groups of input partitions, so that no task takes
    one from every partition. Each group gives the middles of equal shares of
    its rows; weighted by rows, they are a table of constant size, whose
    quantiles are the borders.
    """
    marks, shares = [i / (1 << bits) for i in range(1, 1 << bits)], 4 << bits
    middles = [(i + 0.5) / shares for i in range(shares)]
    values = df.select(*[c.cast("double").alias(f"d{i}") for i, c in enumerate(dimensions)],
                       F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("g"))
    sketches = values.groupBy("g").agg(*[x for i in range(len(dimensions)) for x in (
        F.percentile_approx(f"d{i}", middles, ACCURACY).alias(f"b{i}"), F.count(f"d{i}").alias(f"n{i}"))])
    listed = sketches.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"b{i}").alias("b"), F.col(f"n{i}").alias("n"))
                                                 for i in range(len(dimensions))])).alias("x"))
    found = (listed.select("x.i", F.explode("x.b").alias("border"), "x.n")
             .groupBy("i").agg(F.percentile("border", marks, F.col("n")).alias("b")).collect())   # one row per dimension
    by = {r["i"]: np.unique(np.array(r["b"], np.float64)) for r in found}
    return [by.get(i, np.zeros(0)) for i in range(len(dimensions))]


def with_shards(df: DataFrame, dimensions: list[Column], ties: list[Column], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` with ``shard`` and gapless ``slot`` columns; ``dimensions`` are numeric expressions over ``df``.

    The cell borders come from one pass of quantile sketches. The rows are range-partitioned on
    the curve and written once.
    """
    d = len(dimensions)
    edges = cell_borders(df, dimensions, bits)
    packed = df.select(F.struct("*").alias("row"), F.array(*[F.coalesce(c.cast("double"), F.lit(float("-inf"))) for c in dimensions]).alias("at"),
                       F.struct(*[c.alias(f"t{i}") for i, c in enumerate(ties)]).alias("ties"))
    schema = T.StructType([*packed.schema.fields, T.StructField("curve", T.LongType())])

    def run(batches):
        for b in batches:
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            cells = np.stack([np.searchsorted(e, v, "left") for e, v in zip(edges, values.T, strict=True)], 1)
            yield pa.RecordBatch.from_arrays([*b.columns, as_array(hilbert_index(cells, bits), pa.int64())], names=[*b.schema.names, "curve"])

    curved = packed.mapInArrow(run, schema).drop("at")
    placed, total = numbered(curved, [F.col("curve"), F.col("ties")], "place", "curve")
    # shard s holds places floor(s * n / shards) to floor((s + 1) * n / shards) - 1
    shard = F.expr(f"cast(((place + 1) * {shards} - 1) div {max(total, 1)} as int)")
    placed = placed.withColumn("shard", shard)
    start = F.expr(f"shard * cast({total} as bigint) div {shards}")
    return placed.select("row.*", "shard", (F.col("place") - start).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with all its columns and ``shard`` and ``slot``, under longer names where it has such columns."""
    shard, slot = fresh(docs, "shard"), fresh(docs, "slot")
    packed = docs.select(F.struct("*").alias("doc"), text_size(F.col("text")).alias("size"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"),
                         F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    source = text_cells(packed, "source")
    rows = with_shards(packed, [F.col("size"), source, F.col("doc_id")],
                       [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards)
    return rows.select("doc.*", F.col("shard").alias(shard), F.col("slot").alias(slot))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    rows = docs.select("doc_id", text_size(F.col("text")).alias("size"),
                       F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.col("source").alias("source"))
    source = text_cells(rows, "source")
    rows = with_shards(rows, [F.col("size"), source, F.col("doc_id")],
                       [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One directory per shard, rows in curve order within each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
