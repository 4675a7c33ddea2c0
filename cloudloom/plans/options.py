"""Typed options of a run over point clouds, with the constraints between them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("none", "uniform", "square", "octree", "points")
TRANSFORMS = ("raht", "predicting", "lifting")
SAMPLINGS = ("distance", "period", "centroid")
ORDERS = ("none", "morton", "radius", "azimuth")
MOTIONS = ("none", "external", "estimated")


@dataclass(frozen=True)
class Options:
    """Options of input, partitioning, geometry, attributes, recolouring and sequences; a wrong value or combination raises."""

    # input and output
    position_scale: float = 1.0
    merge_duplicates: bool = True
    axis_order: int = 1
    first_frame: int = 0
    frame_count: int = 1
    # tiles and slices
    tile_size: int = 0
    partition: str = "none"
    slice_max_points: int = 1_100_000
    slice_min_points: int = 550_000
    octree_bits: int = 7
    # geometry
    surface_bits: int = 0
    surface_reach: int = 2
    direct_nodes: bool = True
    angular: bool = False
    lasers: int = 0
    tree_points: int = 1_100_000
    tree_order: str = "morton"
    # attributes
    transform: str = "lifting"
    bit_depth: int = 8
    qp: int = 4
    qp_chroma_offset: int = 0
    lod_sampling: str = "period"
    lod_period: int = 4
    lod_levels: int = 12
    neighbours: int = 3
    spread_threshold: int = 64
    # recolouring
    search_range: int = 1
    forward_neighbours: int = 8
    backward_neighbours: int = 1
    forward_offset: float = 4.0
    backward_offset: float = 4.0
    most_distance2: float = 1000.0
    most_attribute2: float = 1000.0
    # sequences
    random_access_period: int = 1
    group_of_frames: int = 0
    bidirectional: bool = False
    motion_source: str = "none"
    block_size: int = 0
    block_window: int = 0

    def __post_init__(self) -> None:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        for name, broken in RULES:
            if broken(values):
                raise ValueError(f"{name}: {TEXTS[name]}")

    @classmethod
    def of(cls, *layers: dict[str, str]) -> Options:
        """Options from layers of text values; the last layer that names one wins."""
        merged = {k: v for layer in layers for k, v in layer.items()}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if unknown := sorted(set(merged) - set(kinds)):
            raise ValueError(f"unknown option {unknown[0]}")
        return cls(**{k: _truth(v) if kinds[k] is bool else kinds[k](v) for k, v in merged.items()})


def _truth(text: str) -> bool:
    if text.lower() in ("1", "true", "yes"):
        return True
    if text.lower() in ("0", "false", "no"):
        return False
    raise ValueError(f"{text} is neither true nor false")


def _least(v: dict, *names: str):
    """The least of several options, of Python numbers or of columns."""
    return F.least(*(v[n] for n in names)) if isinstance(v[names[0]], Column) else min(v[n] for n in names)


def _outside(value, known: tuple[str, ...]):
    return ~value.isin(*known) if isinstance(value, Column) else value not in known


def _both(a, b):
    return a & b if isinstance(a, Column) else a and b


def _either(a, b):
    return a | b if isinstance(a, Column) else a or b


def _not(a):
    return ~a if isinstance(a, Column) else not a


#: What each rule forbids, for values that are Python values or columns, in the order in which faults are told.
RULES = [
    ("position_scale", lambda v: v["position_scale"] <= 0),
    ("partition", lambda v: _outside(v["partition"], METHODS)),
    ("slice_min_points", lambda v: _either(v["slice_min_points"] <= 0, v["slice_min_points"] > v["slice_max_points"])),
    ("neighbours", lambda v: _either(v["neighbours"] < 1, v["neighbours"] > 3)),
    ("axis_order", lambda v: _either(v["axis_order"] < 0, v["axis_order"] > 7)),
    ("periods", lambda v: _least(v, "lod_period", "lod_levels", "random_access_period", "frame_count", "tree_points") < 1),
    ("sizes", lambda v: _least(v, "tile_size", "octree_bits", "first_frame", "surface_bits", "block_size", "block_window", "group_of_frames", "spread_threshold", "search_range", "lasers") < 0),
    ("transform", lambda v: _outside(v["transform"], TRANSFORMS)),
    ("lod_sampling", lambda v: _outside(v["lod_sampling"], SAMPLINGS)),
    ("tree_order", lambda v: _outside(v["tree_order"], ORDERS)),
    ("motion_source", lambda v: _outside(v["motion_source"], MOTIONS)),
    ("bit_depth", lambda v: _either(v["bit_depth"] < 1, v["bit_depth"] > 16)),
    ("qp", lambda v: _either(v["qp"] < 4, v["qp"] > 51)),
    ("recolouring", lambda v: _either(_least(v, "forward_neighbours", "backward_neighbours") < 1, _least(v, "forward_offset", "backward_offset") <= 0)),
    ("angular", lambda v: _both(v["angular"], v["lasers"] < 1)),
    ("surface", lambda v: _both(v["surface_bits"] > 0, _either(v["surface_bits"] < 2, v["surface_reach"] < 1))),
    ("block_window", lambda v: v["block_window"] > v["block_size"]),
    ("bidirectional", lambda v: _both(v["bidirectional"], v["group_of_frames"] < 2)),
    ("surface_or_angular", lambda v: _both(v["angular"], v["surface_bits"] > 0)),
    ("direct_nodes", lambda v: _both(_not(v["direct_nodes"]), v["angular"])),
]

TEXTS = {
    "position_scale": "must be positive",
    "partition": f"must be one of {', '.join(METHODS)}",
    "slice_min_points": "must be positive and at most slice_max_points",
    "neighbours": "1 to 3 can be used",
    "axis_order": "is a code from 0 to 7",
    "periods": "periods, levels and counts must be at least 1",
    "sizes": "sizes, windows and thresholds must be at least 0",
    "transform": f"must be one of {', '.join(TRANSFORMS)}",
    "lod_sampling": f"must be one of {', '.join(SAMPLINGS)}",
    "tree_order": f"must be one of {', '.join(ORDERS)}",
    "motion_source": f"must be one of {', '.join(MOTIONS)}",
    "bit_depth": "must be 1 to 16",
    "qp": "must be 4 to 51",
    "recolouring": "needs a neighbour and a positive offset each way",
    "angular": "needs lasers",
    "surface": "needs nodes of at least 4 voxels and a reach",
    "block_window": "must not be wider than a block",
    "bidirectional": "needs groups of at least two frames",
    "surface_or_angular": "a surface has no lasers",
    "direct_nodes": "angular places need them",
}


def resolved(layers: DataFrame) -> DataFrame:
    """(run, name, value): the value of each option of a run from a table (run, layer, name, value) of layers; the last layer that names it wins."""
    return layers.groupBy("run", "name").agg(F.max_by("value", "layer").alias("value"))


def checked(options: DataFrame) -> DataFrame:
    """(run, fault): the first of ``RULES`` that each run's options break, null where all hold; ``options`` is (run, name, value) with defaults for what is not named."""
    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    pivot = options.groupBy("run").agg(*(F.max(F.when(F.col("name") == f.name, F.col("value"))).alias(f.name) for f in fields(Options)))
    values = {f.name: F.coalesce(F.col(f.name).cast(kinds[type(f.default)]), F.lit(f.default)) for f in fields(Options)}
    return pivot.select("run", F.coalesce(*(F.when(broken(values), F.lit(name)) for name, broken in RULES)).alias("fault"))
