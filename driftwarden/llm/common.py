"""What several operators share: stored tables, bounded batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path

#: Rows that Python workers receive at once; a batch of very long texts stays small.
ROWS_PER_BATCH = "256"


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches, so that memory follows the longest texts, not the table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. Cuts lineage:
    later jobs, retries and lost executors read the files."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str
) -> DataFrame:
    """Apply ``function`` to Arrow batches; it returns columns by name."""
    bounded_batches(df.sparkSession)
    empty = df.sparkSession.createDataFrame([], schema)
    target = _arrow(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = function(batch)
                yield pa.RecordBatch.from_arrays(
                    [_typed(columns[f.name], f.type) for f in target], schema=target
                )

    return df.mapInArrow(run, empty.schema)


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def _typed(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (node, component): the
    smallest node reachable. Only nodes with an edge appear.

    Alternates large and small stars until the edges stay as they are, a logarithmic
    number of rounds in practice. Every round is a few keyed aggregates and joins and
    is stored; a node with very many edges is combined on the map side, and its join
    can be split.
    """
    now = store(
        edges.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(),
        "edges",
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20,0)))")).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.union(now.selectExpr("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").selectExpr("v as u", "m as v")
            .union(least.select("u", "m"))
            .where("u <> v")
            .selectExpr("greatest(u, v) as u", "least(u, v) as v")
            .distinct()
        )
        now = store(small, "edges")
    return now.selectExpr("u as node", "v as component").union(
        now.selectExpr("v as node", "v as component").distinct()
    )
