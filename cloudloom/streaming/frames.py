"""Frame sequences as streams: a file source, state from the frame before, and periods of frames."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cloudloom.sources.shared import scratch

FRAME_FIELDS = "idx long, frame int, x int, y int, z int, refl int, slice string"


def store_sequence(frames: DataFrame, path: str, files: int = 4) -> None:
    """Frames as ``files`` batches in their order, written one after the other: a file stream reads by age."""
    low, high = frames.agg(F.min("frame"), F.max("frame")).first()
    rows = frames.select(*(f.split(" ")[0] for f in FRAME_FIELDS.split(", ")))
    if low is None:
        rows.write.parquet(path)
        return
    width = -(-(high - low + 1) // files)
    for begin in range(low, high + 1, width):
        rows.filter(F.col("frame").between(begin, begin + width - 1)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FRAME_FIELDS).option("maxFilesPerTrigger", 1).parquet(path)


def with_previous(stream: DataFrame) -> DataFrame:
    """(slice, frame, n, previous_frame, previous_n): each frame of a slice with the one before it, kept as state.

    The state of a slice is its last frame's number and count, whatever the length of the stream.
    """
    counts = "slice string, frame int, n long, previous_frame int, previous_n long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        for b in batches:
            for frame, n in b.groupby("frame").size().items():
                seen[int(frame)] = seen.get(int(frame), 0) + int(n)
        last = state.get if state.exists else (None, None)
        rows = []
        for frame in sorted(seen):
            rows.append((key[0], frame, seen[frame], last[0], last[1]))
            last = (frame, seen[frame])
        state.update(last)
        yield pd.DataFrame(rows, columns=["slice", "frame", "n", "previous_frame", "previous_n"]).astype({"previous_frame": "Int32", "previous_n": "Int64"})

    return stream.select("slice", "frame").groupBy("slice").applyInPandasWithState(step, counts, "frame int, n long", "append", GroupStateTimeout.NoTimeout)


def periods(stream: DataFrame, length: int) -> DataFrame:
    """(period, n) of random-access periods, as a running count."""
    return stream.groupBy(F.floor(F.col("frame") / length).cast("int").alias("period")).agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream over what is there and reads its output; sink and checkpoints lie in the shared folder."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_with_sinks(stream: DataFrame, name: str, hooks: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Runs a stream over what is there and gives each batch to every hook; what a hook makes of it is written to a sink of its own.

    A batch has a folder of its number in each sink and is overwritten when it runs again, so a restart leaves every row once.
    """
    spark = stream.sparkSession
    sinks = {k: scratch(spark, f"{name}-{k}") for k in hooks}

    def sink(batch: DataFrame, number: int) -> None:
        for k, hook in hooks.items():
            hook(batch).write.mode("overwrite").parquet(f"{sinks[k]}/batch={number}")

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return {k: spark.read.parquet(path).drop("batch") for k, path in sinks.items()}
