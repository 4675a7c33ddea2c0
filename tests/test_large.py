"""What larger tables bring: wide keys, many leaves, and joins that must not be sent whole."""

import math

import duckdb
import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from cloudloom.operators import hierarchy, joins, kernels, surface
from cloudloom.queries import aggregates, coding, spatial, surfaces
from cloudloom.queries.registry import ORACLE


def moved(sf_dir, to, table, keys):
    """A copy of a table with some of its keys moved, by itself in a folder."""
    replaced = ", ".join(f"{k} + {v} AS {k}" for k, v in keys.items())
    duckdb.sql(f"COPY (SELECT * REPLACE ({replaced}) FROM '{sf_dir}/{table}.parquet' UNION ALL SELECT * FROM '{sf_dir}/{table}.parquet') TO '{to}/{table}.parquet' (FORMAT parquet)")
    return str(to)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_azimuth_order_of_wide_keys(spark, sf_dir, tmp_path):
    d = moved(sf_dir, tmp_path, "lineitem", {"l_partkey": 200_000})
    place = {r.idx: (r.laser, r.place) for r in aggregates.srt05_azimuth_order(spark, d).collect()}
    rows = aggregates.indexed_points(spark, d, "x", "y", "laser").collect()
    key = lambda r: (r.laser, math.floor(abs(a := math.atan2(r.y - 900, r.x - 500) * 1000) + 0.5) * (1 if a >= 0 else -1), (r.x - 500) ** 2 + (r.y - 900) ** 2, r.idx)
    counts = {}
    for r in sorted(rows, key=key):
        assert place[r.idx] == (r.laser, counts.get(r.laser, 0))
        counts[r.laser] = counts.get(r.laser, 0) + 1


def brute(q, p, k):
    d = ((q[:, None] - p[None]) ** 2).sum(2)
    return {(t, r + 1): (int(s), int(d[t, s])) for t in range(len(q)) for r, s in enumerate(np.lexsort((np.arange(len(p)), d[t]))[:k])}


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("sampled", [False, True])
def test_knn_over_leaves(spark, monkeypatch, k, sampled):
    if sampled:
        monkeypatch.setattr(joins, "SAMPLED_FROM", 100)
        monkeypatch.setattr(joins, "LEAF_SAMPLES", 4)
    rng = np.random.default_rng(5)
    # crowds, a line, repeated places, targets far from all sources
    p = np.concatenate([rng.integers(0, 2000, (300, 3)), rng.integers(500, 530, (400, 3)), np.stack([np.arange(200) * 9, *[np.full(200, 7)] * 2], 1), np.full((60, 3), 700)])
    q = np.concatenate([rng.integers(-300, 2300, (300, 3)), rng.integers(490, 540, (200, 3)), rng.integers(8000, 9000, (100, 3)), np.full((5, 3), 700)])
    table = lambda v: spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(v)], "idx long, x int, y int, z int")
    out = joins.knn_join(table(q), table(p), k, 16)
    assert {(r.t, r["rank"]): (r.s, r.d2) for r in out.collect()} == brute(q, p, k)


def test_knn_sends_no_table_whole(spark, sf_dir):
    assert "Broadcast" not in plan(spatial.jn01_knn_between_frames(spark, sf_dir))


def test_normal_equations_send_no_table_whole(spark, sf_dir):
    assert "Broadcast" not in plan(aggregates.agg20_normal_equations(spark, sf_dir))


@pytest.mark.parametrize("most", [1024, 2])
def test_spacing_of_wide_keys(spark, sf_dir, tmp_path, monkeypatch, most):
    monkeypatch.setattr(surface, "NODE_POINTS", most, raising=False)  # nodes above go by the nearest join
    # y >> 5 goes beyond 8192, so places must not be numbered by it
    d = moved(sf_dir, tmp_path, "lineitem", {"l_partkey": 8192 * 32})
    assert difference(surfaces.tri03_sampling_estimates(spark, d), connect(d), ORACLE["tri03_sampling_estimates"]) is None


def test_spacing_sends_no_table_whole(spark, sf_dir):
    assert "Broadcast" not in plan(surfaces.tri03_sampling_estimates(spark, sf_dir))


def test_motion_estimate_sends_no_table_whole(spark, sf_dir):
    assert "Broadcast" not in plan(spatial.agg20_motion_estimate(spark, sf_dir))


def test_recolouring_sends_only_a_row(spark, sf_dir):
    text = plan(spatial.recolour_reflectance(spark, sf_dir))
    assert "BroadcastHashJoin" not in text


@pytest.mark.parametrize("name", ["raht08_predicted_round_trip", "raht10_attributes"])
def test_predicted_transform_sends_no_table_whole(spark, sf_dir, name):
    assert "Broadcast" not in plan(getattr(coding, name)(spark, sf_dir))


def test_more_attributes_make_no_more_plans(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(hierarchy, "staged", lambda df, name, f=hierarchy.staged: seen.append((name, plan(df).count("SortMergeJoin"))) or f(df, name))
    df = spark.createDataFrame([(x, 3 - x, z, 10 * x + z, 100 - z) for x in range(4) for z in (0, 1, 3)], "x int, y int, z int, a int, b int")
    one, two = [], []
    for names, plans in ((["a"], one), (["a", "b"], two)):
        rows = hierarchy.raht_attributes(df, names, 2, 4).collect()
        plans += seen
        seen.clear()
    assert len(rows) == 12 and one == two
    assert max(n for name, n in two if name == "coded") <= 2


def test_motion_sources_search_once_and_send_no_table_whole(spark, sf_dir, monkeypatch):
    calls = []
    for at in (joins, kernels):
        monkeypatch.setattr(at, "knn_join", lambda *a, f=at.knn_join, **b: calls.append(1) or f(*a, **b))
    assert "BroadcastHashJoin" not in plan(coding.oct11_motion_sources(spark, sf_dir)) and len(calls) == 1
