"""Point-in-polygon region assignment (J8) and region fallback (J9 lives in
``joins.merge_region``).

Polygons are a table ``(poly_id, attrs..., ring)`` or ``(..., rings)`` in the same
plane coordinates as the points: one ring, or several (islands and holes, by the
even-odd rule), as arrays of struct<x, y>; concave rings are fine.

The polygons become an index of grid cells.  No ring is copied:

* a *cut* cell is one that an edge passes.  It lists the edges that pass it, and
  whether a reference line in it has an odd number of crossings to its right;
* a *whole* cell lies inside without an edge, and lists nothing.

Points meet the index in an equi-join on their cell.  In a whole cell they are
inside.  In a cut cell the walk from the point straight up or down to the
reference line, and from there to the right, crosses an odd number of edges
when the point is inside; only the cell's own edges can be crossed within the
cell, and the rest is the cell's one bit.  Work grows with points, edge lengths
and cells, never points x polygons.  Cells are joined in ``salts`` copies, so
the points of one crowded cell are dealt to as many tasks.

Boundary rule: a point on the line of an edge counts as right of it, or above
a level one, so points on left and bottom edges are inside and points on
right and top edges are outside; shared edges never count twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Height of the reference line in a cell: no round part of it, so that vertices of map data miss it.
_LINE = 0.4871359


def _x_at(y: Column, e) -> Column:
    """x of an edge's line at height ``y``; the edge is not level."""
    return (e("x2") - e("x1")) * (y - e("y1")) / (e("y2") - e("y1")) + e("x1")


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """(poly_id, x1, y1, x2, y2) of every ring; rings of fewer than three points have none."""
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    ring = polygons.select("poly_id", F.explode(rings).alias("ring")).where(F.size("ring") >= 3)
    ends = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)), lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return ring.select("poly_id", F.explode(ends).alias("e")).select("poly_id", "e.*").where("x1 <> x2 OR y1 <> y2")


def polygon_cells(polygons: DataFrame, cell: float) -> DataFrame:
    """The index: (poly_id, cx, cy, edges, right); ``edges`` is null in whole cells."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = polygon_edges(polygons).withColumn("cy", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    # where the edge is within the row, and a little more, so that rounding loses no cell
    level, slack = F.col("y1") == F.col("y2"), cell * 1e-6
    bottom, top = F.greatest(lo, F.col("cy") * cell), F.least(hi, (F.col("cy") + 1) * cell)
    a, b = F.when(level, F.col("x1")).otherwise(_x_at(bottom, F.col)), F.when(level, F.col("x2")).otherwise(_x_at(top, F.col))
    line = (F.col("cy") + _LINE) * cell
    cross = F.when((F.col("y1") > line) != (F.col("y2") > line), F.floor(_x_at(line, F.col) / cell))  # column of the crossing
    rows = rows.withColumn("cross", cross).withColumn("cx", F.explode(F.sequence(
        F.floor((F.least(a, b) - slack) / cell), F.floor((F.greatest(a, b) + slack) / cell))))
    hit = F.coalesce(F.col("cross") == F.col("cx"), F.lit(False))
    cut = rows.groupBy("poly_id", "cx", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", hit.alias("hit"))).alias("edges"), F.sum(hit.cast("int")).alias("n"))
    # crossings of the reference line from the right end of the polygon's row up to this cell
    order = Window.partitionBy("poly_id", "cy").orderBy(F.col("cx").desc())
    cut = cut.withColumn("upto", F.sum("n").over(order)).withColumn("next", F.lead("cx").over(order))
    inside = cut.where((F.col("upto") % 2 == 1) & (F.col("cx") - F.col("next") > 1))
    whole = inside.select("poly_id", F.explode(F.sequence(F.col("next") + 1, F.col("cx") - 1)).alias("cx"), "cy")
    kind = cut.schema["edges"].dataType
    return cut.select("poly_id", "cx", "cy", "edges", ((F.col("upto") - F.col("n")) % 2 == 1).alias("right")).unionByName(
        whole.select("poly_id", "cx", "cy", F.lit(None).cast(kind).alias("edges"), F.lit(True).alias("right")))


def _inside(cell: float) -> Column:
    """Whether (px, py) is inside, in its cut cell (cx, cy)."""
    px, py = F.col("px"), F.col("py")
    line = (F.col("cy") + _LINE) * cell

    def flips(odd: Column, e: Column) -> Column:
        # right or above of the edge's line, before and after the walk up or down
        def side(y: Column) -> Column:
            return F.when(e["y1"] == e["y2"], y >= e["y1"]).otherwise(px < _x_at(y, e.__getitem__))

        walk = ((e["x1"] > px) != (e["x2"] > px)) & (side(py) != side(line))
        along = e["hit"] & (px < _x_at(line, e.__getitem__))
        return (odd != walk) != F.coalesce(along, F.lit(False))

    return F.aggregate("edges", F.col("right"), flips)


def assign_region(points: DataFrame, polygons: DataFrame, x: str, y: str, cell: float = 1000.0,
                  attrs: Sequence[str] = ("sido", "sigungu", "dong"), id_col: str = "unique_id", salts: int = 8) -> DataFrame:
    """(point id, polygon attributes) for every point inside a polygon; ``poly_id`` is unique.

    Points with null coordinates or outside every polygon produce no row.
    """
    pts = (points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
           .select(id_col, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
           .withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
           .withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")))
    cells = polygon_cells(polygons, cell).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = pts.join(cells, on=["cx", "cy", "salt"], how="inner").where(F.col("edges").isNull() | _inside(cell))
    return hits.select(id_col, "poly_id").join(polygons.select("poly_id", *attrs), "poly_id").select(id_col, "poly_id", *attrs)


def holed_from_nations(nation: DataFrame) -> DataFrame:
    """Test polygons by a fixed rule: a concave arrow a nation, every other one with a square hole and an island in it."""
    k = F.col("n_nationkey").cast("double")
    x0 = F.lit(190000.0) + F.lit(800.0) * k

    def ring(*corners):
        return F.array(*[F.struct((x0 + F.lit(float(dx))).alias("x"), F.lit(float(dy)).alias("y")) for dx, dy in corners])

    arrow = ring((0, 440000), (790, 441100), (400, 450000), (790, 458900), (0, 459900))
    hole = ring((50, 446050), (350, 446050), (350, 453950), (50, 453950))
    island = ring((150, 448000), (250, 450000), (150, 452000))
    return nation.select(F.col("n_nationkey").cast("bigint").alias("poly_id"), F.col("n_name").alias("sigungu"),
                         F.when(F.col("n_nationkey") % 2 == 0, F.array(arrow, hole, island)).otherwise(F.array(arrow)).alias("rings"))


def polygons_from_nations(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Test polygons derived from the nation/region dimension by a fixed rule:
    nation k owns a quadrilateral over the x strip [190000 + 800k, +800) with
    slanted top and bottom edges.  Attributes: region name, nation name, dong.
    """
    k = F.col("n_nationkey").cast("double")
    x0 = F.lit(190000.0) + F.lit(800.0) * k
    x1 = x0 + F.lit(800.0)
    ring = F.array(
        F.struct(x0.alias("x"), F.lit(439000.0).alias("y")),
        F.struct(x1.alias("x"), (F.lit(439000.0) + F.lit(300.0) * F.pmod(F.col("n_nationkey"), F.lit(3))).alias("y")),
        F.struct(x1.alias("x"), F.lit(461000.0).alias("y")),
        F.struct(x0.alias("x"), (F.lit(458000.0) + F.lit(500.0) * F.pmod(F.col("n_nationkey"), F.lit(4))).alias("y")),
    )
    j = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return j.select(F.col("n_nationkey").cast("bigint").alias("poly_id"), F.col("r_name").alias("sido"),
                    F.col("n_name").alias("sigungu"), F.concat(F.col("n_name"), F.lit("-poly")).alias("dong"),
                    ring.alias("ring"))
