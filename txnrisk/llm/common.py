"""Helpers shared by the corpus operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
every executor shares, so a lost executor costs a re-read and never a result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.session import checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a read of it."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``saved`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("llm-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, schema: T.StructType, per_batch: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """``mapInArrow`` over column lists; ``per_batch`` returns output columns by name.

    One input batch may yield any number of rows; batches are bounded by the
    session's Arrow batch limits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = per_batch({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def add_columns(df: DataFrame, text: str, added: T.StructType, per_text: Callable[[list], dict[str, list]]) -> DataFrame:
    """Append columns that ``per_text`` computes from column ``text``; every input column passes through untouched."""
    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(added)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = per_text(b.column(at).to_pylist())
            more = [as_array(out[f.name], f.type) for f in target]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *target.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def numbered(df: DataFrame, order: list[Column], number: str, label: str) -> tuple[DataFrame, int]:
    """Rows with a gapless global number from 0 in ``order``, and the row count.

    Range partitions are sorted and written once; the offset of each partition
    comes from its row count, so no task sees more than one range. The only
    ungrouped step works on one row per partition.
    """
    spark = df.sparkSession
    part, local = fresh(df, "_part"), fresh(df, "_local")
    table = saved(df.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
                  .withColumn(part, F.spark_partition_id())
                  .withColumn(local, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), label)
    counts = sorted((r[0], r[1]) for r in table.groupBy(part).count().collect())  # one row per partition
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts, f"`{part}` int, _start long")
    out = (table.join(F.broadcast(offsets), part)
           .withColumn(number, F.col("_start") + F.col(local)).drop(part, local, "_start"))
    return out, total


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has two BIGINT columns ``a`` and ``b``. Returns (node, root) for
    every node on an edge, root being the smallest node of its component.
    Each round is two shuffles on node keys with partially aggregated minima
    and is written to the shared folder; rounds grow with the logarithm of
    the longest chain.
    """
    current = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a <> b").distinct(), "cc")
    for _ in range(max_rounds):
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.filter("a <> b").distinct(), "cc")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        following = saved(small.filter("a <> b").distinct(), "cc")
        n, left = following.count(), following.exceptAll(current).limit(1).count() if following.count() == current.count() else 1
        discard(large)
        discard(current)
        current = following
        if not n or not left:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
