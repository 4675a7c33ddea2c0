"""Queries over streams and file formats; each writes its own inputs into the shared folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.queries.registry import query
from cloudloom.sources import ply, records
from cloudloom.sources.clouds import SQL_FRAMES, frames
from cloudloom.sources.shared import scratch
from cloudloom.streaming import frames as stream

FR = f"WITH {SQL_FRAMES} "


@query(FR + ", c AS (SELECT slice, frame, count(*) AS n FROM frames GROUP BY 1, 2) SELECT slice, frame, n, lag(frame) OVER w AS previous_frame, lag(n) OVER w AS previous_n FROM c WINDOW w AS (PARTITION BY slice ORDER BY frame)")
def str01_str06_str07_stream_with_previous(s, d):
    path = scratch(s, "sequence")
    stream.store_sequence(frames(s, d), path)
    return stream.run_to_end(stream.with_previous(stream.read_sequence(s, path)), "previous")


@query(FR + "SELECT frame, idx, x, y, z, refl FROM (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY idx) - 1 AS idx, x, y, z, refl FROM frames)")
def src01_src03_src04_ply_round_trip(s, d):
    path = scratch(s, "ply")
    written = ply.write_ply(frames(s, d).select("frame", "idx", "x", "y", "z", "refl"), path)
    written.write.parquet(scratch(s, "ply-files"))
    return ply.read_ply(s, f"{path}/*.ply").select("frame", "idx", "x", "y", "z", "refl")


@query(FR + "SELECT slice, row_number() OVER (PARTITION BY slice ORDER BY idx) - 1 AS place, CAST(refl AS BIGINT) AS value FROM frames")
def src06_packed_column_round_trip(s, d):
    return records.unpack_column(records.pack_column(frames(s, d), "slice", "refl", 7), 7)


@query(FR + "SELECT CAST(refl % 10 AS SMALLINT) AS type, count(*) AS n, CAST(sum(length(slice)) AS BIGINT) AS bytes FROM frames GROUP BY 1")
def src05_record_round_trip(s, d):
    def rows(batches):
        import pyarrow as pa

        for b in batches:
            got = [r for data in b.column(0).to_pylist() for r in records.records_of(data)]
            yield pa.record_batch([pa.array([t for t, _ in got], pa.int16()), pa.array([len(p) for _, p in got], pa.int64())], ["type", "size"])

    made = frames(s, d).select(records.record_bytes(F.col("refl") % 10, F.encode("slice", "utf-8")).alias("data"))
    return made.mapInArrow(rows, "type short, size long").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(FR + "SELECT frame, CAST(sum(refl) AS DOUBLE) AS positions, CAST(sum(x) AS DOUBLE) AS colors FROM frames GROUP BY 1")
def src12_src13_src14_log_scraping(s, d):
    f = frames(s, d)
    lines = f.select("frame", F.format_string("positions bitstream size %d B (0.5 bpp)", "refl").alias("value")).unionByName(f.select("frame", F.format_string("colors bitstream size %d B", "x").alias("value")))
    return records.scrape(lines, "frame").select("frame", "positions", "colors")


@query("SELECT frame, s || '_' || lpad(CAST(frame AS VARCHAR), 4, '0') || '.ply' AS path FROM (SELECT DISTINCT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS frame, 'cloud' AS s FROM events)")
def src04_frame_paths(s, d):
    f = frames(s, d).select("frame").distinct().withColumn("path", records.path_of("cloud_%04d.ply", F.col("frame")))
    return records.numbered_files(f.drop("frame")).select("frame", "path")


@query(FR + ", seqs AS (SELECT DISTINCT slice AS sequence, CASE WHEN slice < 'l' THEN 'cat1' ELSE 'cat3' END AS category FROM frames), v AS (SELECT unnest(['r01', 'r02', 'r03']) AS variant), o AS (SELECT * FROM (VALUES (0, 'cat1', NULL, 'qp', '40'), (1, 'cat1', 'r02', 'qp', '34'), (2, 'cat3', NULL, 'qp', '46'), (3, 'cat3', NULL, 'lasers', '64')) AS t(ord, c, vv, option, value)) SELECT sequence, variant, option, arg_max(value, ord) AS value FROM seqs, v, o WHERE c = category AND (vv IS NULL OR vv = variant) GROUP BY 1, 2, 3")
def src15_experiment_matrix(s, d):
    seqs = frames(s, d).select(F.col("slice").alias("sequence")).distinct().withColumn("category", F.when(F.col("sequence") < "l", "cat1").otherwise("cat3"))
    variants = s.createDataFrame([("r01",), ("r02",), ("r03",)], "variant string")
    options = s.createDataFrame([(0, "cat1", None, "qp", "40"), (1, "cat1", "r02", "qp", "34"), (2, "cat3", None, "qp", "46"), (3, "cat3", None, "lasers", "64")], "ord int, for_category string, for_variant string, option string, value string")
    return records.experiment_matrix(seqs, variants, options)
