"""Pitch heatmaps as sparse cells (row, col, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as C


def cell_index(value: Column, size_m: float, cells: int) -> Column:
    # truncation towards zero, then clamped to the grid
    raw = (value / size_m * cells).cast("bigint")
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), raw)).cast("bigint")


def frame_heatmap(points: DataFrame, keys: Sequence[str], fps: float, grid=C.FRAME_GRID) -> DataFrame:
    """Seconds per cell of each track with at least two rows."""
    cols, rows = grid
    cells = points.groupBy(
        *keys,
        cell_index(F.col("y"), C.PITCH_WIDTH_M, rows).alias("cell_row"),
        cell_index(F.col("x"), C.PITCH_LENGTH_M, cols).alias("cell_col"),
    ).agg(F.count(F.lit(1)).alias("samples"))
    enough = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2").drop("__n")
    return cells.join(enough, list(keys), "left_semi").select(
        *keys, "cell_row", "cell_col", (F.col("samples") / fps).alias("seconds")
    )


def sample_heatmap(
    points: DataFrame,
    keys: Sequence[str],
    length: float = C.PITCH_LENGTH_M,
    width: float = C.PITCH_WIDTH_M,
    margin: float = C.PITCH_MARGIN_M,
    grid=C.SAMPLE_GRID,
    members: DataFrame | None = None,
    member_keys: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(cells with sample counts, per-key sample count and mean). Points far off the pitch are dropped.

    With ``members`` (the ``keys`` and more columns, each key once) the result is by ``member_keys``: points are counted by
    ``keys`` first, so that counts, not points, are joined.
    """
    cols, rows = grid
    x, y = F.col("x"), F.col("y")
    near = points.where(x.between(-margin, length + margin) & y.between(-margin, width + margin))
    near = near.select(
        *keys,
        F.least(F.greatest(x, F.lit(0.0)), F.lit(length)).alias("x"),
        F.least(F.greatest(y, F.lit(0.0)), F.lit(width)).alias("y"),
    )
    at = [cell_index(F.col("y"), width, rows).alias("cell_row"), cell_index(F.col("x"), length, cols).alias("cell_col")]
    cells = near.groupBy(*keys, *at).agg(F.count(F.lit(1)).alias("samples"))
    if members is None:
        return cells, near.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    total = F.sum("samples").alias("samples")
    cells = cells.join(members, list(keys)).groupBy(*member_keys, "cell_row", "cell_col").agg(total)
    sums = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    mean = lambda c: (F.sum(c) / F.sum("samples")).alias(f"mean_{c}")
    return cells, sums.join(members, list(keys)).groupBy(*member_keys).agg(total, mean("x"), mean("y"))


def sum_grids(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys, "cell_row", "cell_col").agg(F.sum("value").alias("value"))


SHAPE = ["grid_cols", "grid_rows", "source", "cell_unit"]


def combine(heatmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the shape group with the most samples (tie: tracker grid first), and how many maps were skipped."""
    groups = heatmaps.groupBy(*keys, *SHAPE).agg(F.sum("samples").alias("samples"), F.count(F.lit(1)).alias("maps"))
    rank = F.struct(
        F.col("samples"), (F.col("source") == "pipeline").alias("first"), F.col("maps"), *[F.col(c) for c in SHAPE]
    )
    best = groups.groupBy(*keys).agg(F.max(rank).alias("b"), F.sum("maps").alias("all_maps"))
    return best.select(
        *keys, *[F.col(f"b.{c}").alias(c) for c in SHAPE], F.col("b.samples").alias("samples"),
        F.col("b.maps").alias("used"), (F.col("all_maps") - F.col("b.maps")).alias("skipped"),
    )


def combined_cells(heatmaps: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    chosen = combine(heatmaps, keys).select(*keys, *SHAPE)
    return sum_grids(cells.join(chosen, [*keys, *SHAPE]), [*keys, "grid_cols", "grid_rows"])


def peak_normalised(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Cell values relative to the highest cell of their key, 0 for an empty grid."""
    # a grid has a fixed number of cells, so a window per grid stays small
    peak = F.max(value).over(W.partitionBy(*keys))
    return cells.withColumn("share", F.when(peak > 0, F.round(F.col(value) / peak, 3)).otherwise(0.0))


def squad_heatmap(heatmaps: DataFrame, cells: DataFrame, team: str, order: str) -> DataFrame:
    """Sum of peak-normalised grids that have the shape of the team's first grid, normalised again."""
    first = heatmaps.groupBy(team).agg(F.min_by(F.struct("grid_cols", "grid_rows"), F.col(order)).alias("s"))
    first = first.select(team, "s.grid_cols", "s.grid_rows")
    same = cells.join(first, [team, "grid_cols", "grid_rows"])
    shares = peak_normalised(same, ["stat_id"])
    summed = shares.groupBy(team, "grid_cols", "grid_rows", "cell_row", "cell_col").agg(F.sum("share").alias("value"))
    return peak_normalised(summed, [team])


def modal_shape(heatmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = heatmaps.groupBy(*keys, "grid_cols", "grid_rows").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.max(F.struct("n", "grid_cols", "grid_rows")).alias("b"))
    return best.select(*keys, "b.grid_cols", "b.grid_rows", "b.n")


def weighted_position(heatmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample-weighted mean position over the maps of a key."""
    w = F.sum("samples")
    return heatmaps.groupBy(*keys).agg(
        (F.sum(F.col("mean_x") * F.col("samples")) / w).alias("x"),
        (F.sum(F.col("mean_y") * F.col("samples")) / w).alias("y"),
        w.alias("samples"),
    )


def valid_grid(grid: Column) -> Column:
    """struct(cols, rows) of a non-empty rectangular grid of non-negative numbers, else null."""
    widths = F.array_distinct(F.transform(grid, lambda r: F.size(r)))
    numbers = F.forall(grid, lambda r: F.forall(r, lambda v: F.coalesce((v >= 0) & ~F.isnan(v), F.lit(False))))
    ok = (F.size(grid) > 0) & (F.size(widths) == 1) & (widths[0] > 0) & numbers
    return F.when(ok, F.struct(widths[0].alias("cols"), F.size(grid).alias("rows")))


def dense_grid(cells: DataFrame, keys: Sequence[str], cols: int, rows: int, value: str = "value") -> DataFrame:
    """Nested array form of a sparse grid (rows of columns); at most rows * cols entries per key."""
    packed = cells.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct((F.col("cell_row") * cols + F.col("cell_col")).alias("k"), F.col(value).alias("v")))
        ).alias("m")
    )
    # the cells in their order, each after the empty ones before it; the work follows the cells, not cells times places
    zero, kind = F.lit(0).cast(cells.schema[value].dataType), cells.schema[value].dataType.simpleString()
    inside = F.sort_array(F.filter(F.map_entries("m"), lambda e: (e["key"] >= 0) & (e["key"] < rows * cols)))
    held = packed.select(*keys, inside.alias("e"))
    gap = lambda n: F.array_repeat(zero, n.cast("int"))
    start = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.try_element_at("e", F.greatest(i, F.lit(1)))["key"])
    pieces = F.transform("e", lambda e, i: F.concat(gap(e["key"] - start(i) - 1), F.array(F.coalesce(e["value"], zero))))
    last = F.when(F.size("e") > 0, F.try_element_at("e", F.lit(-1))["key"]).otherwise(F.lit(-1))
    flat = F.concat(F.flatten(pieces), gap(rows * cols - 1 - last)).cast(f"array<{kind}>")
    # the one element of an array, so that it is made once and not for every row of the grid
    cut = lambda f: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(f, r * cols + 1, cols))
    return held.select(*keys, F.transform(F.array(flat), cut)[0].alias("grid"))


def sparse_grid(df: DataFrame, keys: Sequence[str], grid: str = "grid") -> DataFrame:
    """(keys, cell_row, cell_col, value) from a nested array grid."""
    r = df.select(*keys, F.posexplode(grid).alias("cell_row", "__row"))
    return r.select(*keys, "cell_row", F.posexplode("__row").alias("cell_col", "value"))
