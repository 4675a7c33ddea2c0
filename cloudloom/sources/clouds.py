"""Point clouds made from the relational tables, and their row numbers.

A row number over a whole table is made without a task that sees it all: rows are cut into ranges of
the first ordering column, numbered inside each range, and moved by the counts of the ranges before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows wanted in a range of a numbered table, least and most ranges, and cuts that become one expression.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES, EXPRESSION_CUTS = 1_000_000, 32, 1 << 16, 256
ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def dense_index(df: DataFrame, order: list[str], name: str = "idx", ranges: int | None = None) -> DataFrame:
    """``df`` with the place of each row in ``order`` (the first column a number), from 0.

    The cuts are quantiles of the first column, so ranges hold about equal numbers of rows however its values lie; their number follows the
    table's (``RANGE_ROWS`` rows each). They shape the tasks only: the numbers are the same for any cuts.
    """
    first = F.col(order[0])
    if ranges is None:
        ranges = max(LEAST_RANGES, min(MOST_RANGES, df.count() // RANGE_ROWS))
    cuts = sorted(set(df.approxQuantile(order[0], [i / ranges for i in range(1, ranges)], max(0.1 / ranges, 1e-4)))) if ranges > 1 else []
    # at most MOST_RANGES numbers; the place of a value among them by halves
    cut = _among(first, cuts) if cuts else F.lit(0)
    rows = df.withColumn("__range", cut)
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__range").orderBy(*order)
    return rows.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.row_number().over(within) - 1).drop("__range", "__start")


def _among(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted ``cuts`` are not above a value: a tree of comparisons for few of them, else a search by halves in Arrow batches."""
    if len(cuts) > EXPRESSION_CUTS:
        held = np.array(cuts)

        @F.arrow_udf("int")
        def place(x: pa.Array) -> pa.Array:
            return pa.array(np.searchsorted(held, x.to_numpy(zero_copy_only=False), "right").astype(np.int32))

        return place(value.cast("double"))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(cuts[middle]), tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(cuts))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


POINT = {
    "x": "cast(floor(l_extendedprice / 100) as int)",
    "y": "cast(l_partkey as int)",
    "z": "datediff(l_shipdate, date'1995-01-02')",
    "c0": "cast(round(l_quantity * 5) as int)",
    "c1": "cast(round(l_tax * 1000) as int)",
    "c2": "cast(l_suppkey % 256 as int)",
    "refl": "cast(round(l_discount * 1000) as int)",
    "laser": "l_linenumber - 1",
}


def points(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The static cloud, without row numbers; only the columns asked for are read."""
    names = columns or tuple(POINT)
    return _read(spark, sf_dir, "lineitem").select(*(F.expr(POINT[n]).alias(n) for n in names))


def indexed_points(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The static cloud with ``idx``, the place of each row in the order of its source columns."""
    names = columns or tuple(POINT)
    rows = _read(spark, sf_dir, "lineitem")
    numbered = dense_index(rows.select(*dict.fromkeys([*ROW_ORDER, "l_tax", "l_discount"])), ROW_ORDER)
    return numbered.select("idx", *(F.expr(POINT[n]).alias(n) for n in names))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence of clouds, one a day."""
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"),
        F.expr("datediff(ts, date'2024-01-01')").alias("frame"),
        F.expr("cast(user_id as int)").alias("x"),
        F.expr("hour(ts) * 3600 + minute(ts) * 60 + second(ts)").alias("y"),
        F.expr("cast(floor(value) as int)").alias("z"),
        F.expr("cast(get_json_object(props, '$.k') as int)").alias("refl"),
        F.col("event_type").alias("slice"),
    )


def small_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small cloud from the first three components of the embeddings."""
    axis = lambda i: f"cast(floor(cast(embedding[{i}] as double) * 1000) + 1000 as int)"
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), *(F.expr(axis(i)).alias(n) for i, n in enumerate("xyz")), F.col("label"))


#: The same clouds in DuckDB's SQL.
SQL_POINTS = """
src AS (SELECT *, CAST(floor(l_extendedprice/100) AS INT) AS x, CAST(l_partkey AS INT) AS y,
  CAST(date_diff('day', TIMESTAMP '1995-01-02', l_shipdate) AS INT) AS z, CAST(round(l_quantity*5) AS INT) AS c0,
  CAST(round(l_tax*1000) AS INT) AS c1, CAST(l_suppkey % 256 AS INT) AS c2, CAST(round(l_discount*1000) AS INT) AS refl,
  CAST(l_linenumber - 1 AS INT) AS laser FROM lineitem),
pts AS (SELECT x, y, z, c0, c1, c2, refl, laser FROM src)"""
SQL_INDEXED = """
src AS (SELECT *, CAST(floor(l_extendedprice/100) AS INT) AS x, CAST(l_partkey AS INT) AS y,
  CAST(date_diff('day', TIMESTAMP '1995-01-02', l_shipdate) AS INT) AS z, CAST(round(l_quantity*5) AS INT) AS c0,
  CAST(round(l_tax*1000) AS INT) AS c1, CAST(l_suppkey % 256 AS INT) AS c2, CAST(round(l_discount*1000) AS INT) AS refl,
  CAST(l_linenumber - 1 AS INT) AS laser FROM lineitem),
pts AS (SELECT row_number() OVER (ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) - 1 AS idx, x, y, z, c0, c1, c2, refl, laser FROM src)"""
SQL_FRAMES = """
frames AS (SELECT event_id AS idx, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS frame, CAST(user_id AS INT) AS x,
  CAST(hour(ts)*3600 + minute(ts)*60 + second(ts) AS INT) AS y, CAST(floor(value) AS INT) AS z,
  CAST(json_extract_string(props, '$.k') AS INT) AS refl, event_type AS slice FROM events)"""
SQL_SMALL = """
emb3 AS (SELECT vec_id AS idx, CAST(floor(CAST(embedding[1] AS DOUBLE)*1000)+1000 AS INT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE)*1000)+1000 AS INT) AS y,
  CAST(floor(CAST(embedding[3] AS DOUBLE)*1000)+1000 AS INT) AS z, label FROM embeddings)"""
