"""Selection and statistics of points on the map (columns x and y)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: cells of the grid along each axis.
GRID = 128


def in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Whether a ray to the right crosses the polygon's edges an odd number of times.

    The bounding box comes first, as plain comparisons that reach the scan. Fewer than three
    corners select nothing.
    """
    if len(polygon) < 3:
        return F.lit(False)
    xs, ys = [float(p[0]) for p in polygon], [float(p[1]) for p in polygon]
    crossings = F.lit(0)
    for k in range(len(polygon)):
        x1, y1, x2, y2 = xs[k - 1], ys[k - 1], xs[k], ys[k]
        if y1 != y2:
            straddles = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings = crossings + F.when(straddles & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)


def lasso(points: DataFrame, polygon: Sequence[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    return points.filter(in_polygon(F.col(x), F.col(y), polygon))


def pick_radius(points: DataFrame, at: tuple[float, float], radius: float, key: str = "doc_id", x: str = "x", y: str = "y") -> DataFrame:
    """The nearest point closer than radius, or no row; ties in order of key."""
    px, py = F.col(x), F.col(y)
    box = px.between(at[0] - radius, at[0] + radius) & py.between(at[1] - radius, at[1] + radius)
    return points.filter(box).withColumn("distance", F.hypot(px - at[0], py - at[1])).filter(F.col("distance") < radius).orderBy("distance", key).limit(1)


def viewport(points: DataFrame, low: tuple[float, float], high: tuple[float, float], margin: float = 0.0, x: str = "x", y: str = "y") -> DataFrame:
    return points.filter(F.col(x).between(low[0] - margin, high[0] + margin) & F.col(y).between(low[1] - margin, high[1] + margin))


def centroids(points: DataFrame, cluster: str = "cluster", x: str = "x", y: str = "y") -> DataFrame:
    return points.groupBy(cluster).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n_points"))


def map_center(points: DataFrame, cluster: str = "cluster", x: str = "x", y: str = "y") -> DataFrame:
    """One row: the centroids' mean, weighted by their points."""
    return centroids(points, cluster, x, y).agg((F.sum(F.col("x") * F.col("n_points")) / F.sum("n_points")).alias("x"), (F.sum(F.col("y") * F.col("n_points")) / F.sum("n_points")).alias("y"))


def bounds(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: extremes, centre and padded ranges (100 for a range of 0, else at least 60)."""
    ends = points.agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))
    padded = lambda a, b: F.when(b == a, 100.0).otherwise(F.greatest(F.lit(60.0), (b - a) * F.lit(1.2)))
    c = F.col
    return ends.select("*", ((c("min_x") + c("max_x")) / 2).alias("center_x"), ((c("min_y") + c("max_y")) / 2).alias("center_y"), padded(c("min_x"), c("max_x")).alias("padded_x"), padded(c("min_y"), c("max_y")).alias("padded_y"))


def with_cells(points: DataFrame, x: str = "x", y: str = "y", cells: int = GRID) -> DataFrame:
    """Adds cell_x and cell_y, clamped to the grid over the points' bounds."""
    ends = points.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    cell = lambda v, a, b: F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor((v - a) / F.when(b > a, b - a).otherwise(1.0) * cells).cast("int")))
    joined = points.join(F.broadcast(ends))  # one row
    return joined.withColumns({"cell_x": cell(F.col(x), F.col("_x0"), F.col("_x1")), "cell_y": cell(F.col(y), F.col("_y0"), F.col("_y1"))}).drop("_x0", "_x1", "_y0", "_y1")


def grid_cells(points: DataFrame, x: str = "x", y: str = "y", cells: int = GRID) -> DataFrame:
    return with_cells(points, x, y, cells).groupBy("cell_x", "cell_y").agg(F.count("*").alias("n_points"))


def normalize(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """x and y scaled to 0 to 1; a range of 0 counts as 1."""
    ends = points.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    scaled = lambda v, a, b: (v - a) / F.when(b > a, b - a).otherwise(1.0)
    joined = points.join(F.broadcast(ends))  # one row
    return joined.withColumns({x: scaled(F.col(x), F.col("_x0"), F.col("_x1")), y: scaled(F.col(y), F.col("_y0"), F.col("_y1"))}).drop("_x0", "_x1", "_y0", "_y1")


def projection_stats(points: DataFrame, coords: str = "embedding") -> DataFrame:
    """One row over all coordinates: finite ones' mean, deviation and extremes; counts of others; and the verdict."""
    v = points.select(F.explode(coords).alias("v")).select(F.col("v").cast("double").alias("v"))
    odd, infinite = F.isnan("v"), F.abs("v") == float("inf")
    finite = F.when(~odd & ~infinite, F.col("v"))
    out = v.agg(F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("std"), F.min(finite).alias("min"), F.max(finite).alias("max"), F.count_if(odd).alias("n_nan"), F.count_if(infinite).alias("n_infinite"), F.count_if(F.abs(finite) > 1e6).alias("n_extreme"))
    return out.withColumn("spread", F.when(F.col("std") < 0.1, "collapsed").when(F.col("std") < 1, "low").otherwise("normal"))
