"""Households and facilities on the map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions.geo import distance, utm
from tamarisk.sources.shared import cut

#: Rows up to this number (nodes of the tree, cells with their candidates) are broadcast.
BROADCAST_FACILITIES = 20_000
#: Facilities in a cell that isn't split, parts of each side of one that is, and the depth at which none is (a cell is then some centimetres wide).
LEAF, SPLIT, DEEPEST = 16, 4, 12


def points(df: DataFrame) -> DataFrame:
    """Rows with both coordinates, as doubles."""
    kinds = {c: F.col(c).cast("double") for c in ("gps_latitude", "gps_longitude")}
    return df.withColumns(kinds).na.drop(subset=list(kinds))


def projected(df: DataFrame, zone: int = 43) -> DataFrame:
    x, y = utm("gps_latitude", "gps_longitude", zone)
    return df.withColumns({"x_m": x, "y_m": y})


def _tree(places: DataFrame, x0: float, y0: float, width: float) -> DataFrame:
    """Places by the cells of all depths that hold them: ``k, ix, iy`` with ``f_id, fx, fy``; a cell has ``SPLIT`` by ``SPLIT`` below it."""
    depth = F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("k")
    along = lambda c, low: F.least(F.floor((F.col(c) - low) / width * F.pow(F.lit(float(SPLIT)), F.col("k"))), F.pow(F.lit(float(SPLIT)), F.col("k")) - 1).cast("long")
    return places.select("*", depth).withColumns({"ix": along("fx", x0), "iy": along("fy", y0)})


def _candidates(cells: DataFrame, places: DataFrame, x0: float, y0: float, side: float) -> DataFrame:
    """``cx, cy, near``: for each cell of households the facilities that may be the nearest of some place in it.

    Cells of facilities are split where they hold more than ``LEAF``. The search goes down this tree: what lies
    farther from all of a household cell than some facility does from its farthest corner is left behind, so
    that a far cluster is met by its front only.
    """
    tree = _tree(places, x0, y0, side)
    sides = [F.min("fx").alias("x0"), F.max("fx").alias("x1"), F.min("fy").alias("y0"), F.max("fy").alias("y1")]
    nodes = tree.groupBy("k", "ix", "iy").agg(F.count("*").alias("n"), F.min(F.struct("f_id", "fx", "fy")).alias("one"), *sides)
    nodes = nodes.withColumn("last", (F.col("n") <= LEAF) | (F.col("k") == DEEPEST))
    above = nodes.where(~F.col("last")).select((F.col("k") + 1).alias("k"), F.col("ix").alias("px"), F.col("iy").alias("py"))
    parent = {"px": F.expr(f"ix div {SPLIT}"), "py": F.expr(f"iy div {SPLIT}")}
    nodes = cut(nodes.where("k = 0").withColumns(parent).unionByName(nodes.withColumns(parent).join(above, ["k", "px", "py"], "left_semi")))
    total, depth = nodes.agg(F.count("*"), F.max("k")).first()
    small = F.broadcast if total <= BROADCAST_FACILITIES else lambda df: df
    fields = [c for c in nodes.columns if c not in ("px", "py")]

    found = cells.withColumn("k", F.lit(0)).join(F.broadcast(nodes.where("k = 0").select(*fields)), "k")  # one node
    for k in range(depth):
        # A row for the node itself where it is not split, else one for each below it.
        below = nodes.where(F.col("k") == k + 1).select("px", "py", F.struct(*fields).alias("node"))
        ends = (~F.col("last") & (F.col("k") == k)).alias("open")
        both = found.select("cx", "cy", "low_x", "low_y", "width", F.struct(*fields).alias("own"), ends, F.when(ends, F.col("ix")).alias("px"), F.when(ends, F.col("iy")).alias("py"))
        met = both.join(small(below), ["px", "py"], "left").withColumn("node", F.when(F.col("open"), F.col("node")).otherwise(F.col("own")))
        found = met.select("cx", "cy", "low_x", "low_y", "width", "node.*")
        gap = lambda low, a, b: F.greatest(F.col(a) - (F.col(low) + F.col("width")), F.col(low) - F.col(b), F.lit(0.0))
        reach = lambda low, c: F.greatest(F.abs(F.col(low) - c), F.abs(F.col(low) + F.col("width") - c))
        nearest = F.hypot(gap("low_x", "x0", "x1"), gap("low_y", "y0", "y1"))
        surely = F.hypot(reach("low_x", F.col("one.fx")), reach("low_y", F.col("one.fy")))
        bound = F.min(surely).over(Window.partitionBy("cx", "cy"))
        found = found.withColumns({"_near": nearest, "_sure": bound}).where(F.col("_near") <= F.col("_sure")).drop("_near", "_sure")
    leaves = tree.join(small(nodes.where("last").select("k", "ix", "iy")), ["k", "ix", "iy"], "left_semi")
    leaves = leaves.groupBy("k", "ix", "iy").agg(F.collect_list(F.struct("f_id", "fx", "fy")).alias("held"))
    return found.select("cx", "cy", "k", "ix", "iy").join(small(leaves), ["k", "ix", "iy"]).groupBy("cx", "cy").agg(F.flatten(F.collect_list("held")).alias("near"))


def nearest_facility(households: DataFrame, facilities: DataFrame, radius_km: float = 5.0) -> DataFrame:
    """Nearest facility of each household with its distance in metres and whether it is within the radius.

    Candidates are searched once for each grid cell (half a radius wide) that has households, in a tree of
    facility counts; a household is then joined with the candidates of its cell and compared with them in its own
    row. Of facilities at one place, or equally far, the smallest id counts. Households whose place is not finite,
    and all if there is no facility, come back with NULLs.
    """
    places = projected(points(facilities)).select(F.col("facility_id").alias("f_id"), F.col("x_m").alias("fx"), F.col("y_m").alias("fy")).where(_finite("fx", "fy"))
    places = cut(places.groupBy("fx", "fy").agg(F.min("f_id").alias("f_id")))
    width = radius_km * 500
    cell = {c: F.when(_finite("x_m", "y_m"), F.floor(F.col(m) / width)) for c, m in (("cx", "x_m"), ("cy", "y_m"))}
    homes = projected(points(households)).select(F.struct(*households.columns).alias("_row"), "x_m", "y_m").withColumns(cell)
    x0, x1, y0, y1 = places.agg(F.min("fx"), F.max("fx"), F.min("fy"), F.max("fy")).first()
    if x0 is None:
        return _result(homes.withColumn("_best", F.lit(None).cast(f"struct<d: double, f_id: {dict(places.dtypes)['f_id']}>")), households, radius_km)
    cells = homes.where("cx is not null").select("cx", "cy").distinct().withColumns({"low_x": F.col("cx") * width, "low_y": F.col("cy") * width, "width": F.lit(width)})
    near = cut(_candidates(cells, places, x0, y0, max(x1 - x0, y1 - y0, 1.0)))
    few = near.limit(BROADCAST_FACILITIES + 1).count() <= BROADCAST_FACILITIES
    met = homes.join(F.broadcast(near) if few else near, ["cx", "cy"], "left")
    far = lambda c: F.struct(distance(F.col("x_m"), F.col("y_m"), c["fx"], c["fy"]).alias("d"), c["f_id"].alias("f_id"))
    return _result(met.withColumn("_best", F.array_min(F.transform("near", far))), households, radius_km)


def _finite(*names: str):
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e12)
    return out


def _result(best: DataFrame, households: DataFrame, radius_km: float) -> DataFrame:
    return best.select(
        *[F.col("_row")[c].alias(c) for c in households.columns],
        F.col("_best.f_id").alias("nearest_facility"),
        F.round("_best.d", 1).alias("distance_m"),
        (F.col("_best.d") <= radius_km * 1000).alias("within_catchment"),
    )


def catchment_counts(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.count("*").alias("households"), F.count_if("within_catchment").alias("within"), F.count_if(~F.col("within_catchment")).alias("outside"))


def map_layer(households: DataFrame, facilities: DataFrame, indicator: str, radius_m: int = 5000) -> DataFrame:
    """Points of both kinds: households with a colour by indicator, facilities with type and radius."""
    colour = F.when(F.col(indicator) == 1, "red").when(F.col(indicator) == 0, "green").otherwise("gray")
    none = F.lit(None)
    a = points(households).select(
        F.lit("household").alias("kind"), F.col("household_id").cast("string").alias("id"), "gps_latitude", "gps_longitude",
        colour.alias("colour"), none.cast("string").alias("facility_type"), none.cast("int").alias("radius_m"),
    )
    b = points(facilities).select(
        F.lit("facility").alias("kind"), F.col("facility_id").cast("string").alias("id"), "gps_latitude", "gps_longitude",
        F.lit("blue").alias("colour"), "facility_type", F.lit(radius_m).alias("radius_m"),
    )
    return a.union(b)
