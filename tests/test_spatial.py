"""J8 point-in-polygon (boundary rule, brute force), J9 fallback, C15 sanity."""
from pyspark.sql import functions as F

from bizlens.functions import geo
from bizlens.operators import joins as jn
from bizlens.operators import spatial as spt


def _polys(spark):
    sq = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    tri = [(10.0, 0.0), (20.0, 0.0), (10.0, 10.0)]
    rows = [(1, "A", "a", "a1", [{"x": x, "y": y} for x, y in sq]), (2, "B", "b", "b1", [{"x": x, "y": y} for x, y in tri])]
    return spark.createDataFrame(rows, "poly_id long, sido string, sigungu string, dong string, ring array<struct<x:double,y:double>>")


def test_point_in_polygon_boundaries(spark):
    pts = [(1, 5.0, 5.0), (2, 0.0, 5.0), (3, 10.0, 5.0), (4, 5.0, 0.0), (5, 5.0, 10.0), (6, 14.0, 2.0),
           (7, 19.0, 9.0), (8, None, 1.0), (9, -1.0, 5.0), (10, 10.0, 1.0)]
    df = spark.createDataFrame(pts, "unique_id long, x double, y double")
    out = {r.unique_id: r.poly_id for r in spt.assign_region(df, _polys(spark), "x", "y", cell=3.0).collect()}
    # left/bottom edges inside, right/top edges outside; shared edge x=10 belongs to the triangle
    assert out == {1: 1, 2: 1, 3: 2, 4: 1, 6: 2, 10: 2}


def _even_odd(px, py, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            odd ^= (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1
    return odd


def test_point_in_polygon_matches_even_odd_rule(spark):
    """Random stars with holes and islands, negative coordinates, points on corners and edges, several cell sizes."""
    import math
    import random
    rnd = random.Random(4)

    def star(x, y, size, n):
        return [(x + size * (f := rnd.uniform(0.3, 1)) * math.cos(2 * math.pi * k / n), y + size * f * math.sin(2 * math.pi * k / n)) for k in range(n)]

    polys = {k: [star(x := rnd.uniform(-50, 50), y := rnd.uniform(-50, 50), rnd.uniform(3, 60), rnd.randint(3, 40)), star(x, y, 3, 5), star(x, y, 1, 4)] for k in range(12)}
    polys[99] = [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)], [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)], [(1.0, 1.0)]]
    table = spark.createDataFrame([(k, f"p{k}", [[{"x": a, "y": b} for a, b in ring] for ring in rings]) for k, rings in polys.items()],
                                  "poly_id long, name string, rings array<array<struct<x:double,y:double>>>")
    pts = [(i, rnd.uniform(-110, 110), rnd.uniform(-110, 110)) for i in range(1500)]
    pts += [(2000 + i, float(a), float(b)) for i, (a, b) in enumerate((a, b) for a in (-1, 0, 1, 2, 4, 6, 8, 9) for b in (-1, 0, 1, 2, 4, 6, 8, 9))]
    df = spark.createDataFrame(pts, "unique_id long, x double, y double")
    want = {(i, k) for i, px, py in pts for k, rings in polys.items() if _even_odd(px, py, [r for r in rings if len(r) > 2])}
    for cell in (0.7, 5.0, 1000.0):
        got = [(r.unique_id, r.poly_id) for r in spt.assign_region(df, table, "x", "y", cell=cell, attrs=("name",)).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_index_copies_no_ring(spark):
    """A ring of 400 corners over many cells: a cell lists only the edges that pass it, and cells inside list none."""
    import math
    ring = [{"x": 100 * math.cos(2 * math.pi * k / 400), "y": 100 * math.sin(2 * math.pi * k / 400)} for k in range(400)]
    table = spark.createDataFrame([(1, ring)], "poly_id long, ring array<struct<x:double,y:double>>")
    cells = spt.polygon_cells(table, 10.0).collect()
    assert max(len(c.edges) for c in cells if c.edges is not None) < 20 and sum(c.edges is None for c in cells) > 200
    assert sum(len(c.edges or ()) for c in cells) < 600


def test_region_fallback_prefers_spatial(spark):
    spatial = spark.createDataFrame([(1, "S", "s", "d")], "unique_id long, sido string, sigungu string, dong string")
    lookup = spark.createDataFrame([(1, "L", "l", "d"), (2, "L2", "l2", "d2"), (3, None, None, None)],
                                   "unique_id long, sido string, sigungu string, dong string")
    lic = spark.createDataFrame([(1,), (2,), (3,)], "unique_id long")
    out = {r.unique_id: (r.sido, r.region_source) for r in jn.merge_region(lic, spatial, lookup, "unique_id").collect()}
    assert out == {1: ("S", "spatial"), 2: ("L2", "lookup"), 3: (None, None)}


def test_plane_to_geographic_origin(spark):
    # the projection origin maps near (38N, 127.0029E) before the datum shift
    df = spark.createDataFrame([(200000.0, 500000.0), (190000.0, 450000.0)], "x double, y double")
    rows = geo.plane_to_geographic(df, "x", "y").collect()
    assert abs(rows[0].lat - 38.0) < 0.01 and abs(rows[0].lon - 127.003) < 0.01
    assert rows[1].lat < rows[0].lat and rows[1].lon < rows[0].lon


def _forward_tm(lat_deg, lon_deg, p=geo.EPSG5174):
    """Snyder forward transverse Mercator (test-only reference)."""
    import math
    a = p["a"]
    f = 1 / p["inv_f"]
    e2 = 2 * f - f * f
    ep2 = e2 / (1 - e2)

    def M(phi):
        return a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi
                    - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * math.sin(2 * phi)
                    + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * math.sin(4 * phi)
                    - (35 * e2 ** 3 / 3072) * math.sin(6 * phi))
    phi, lam = math.radians(lat_deg), math.radians(lon_deg)
    N = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    T = math.tan(phi) ** 2
    C = ep2 * math.cos(phi) ** 2
    A = (lam - math.radians(p["lon0"])) * math.cos(phi)
    k0 = p["k0"]
    x = k0 * N * (A + (1 - T + C) * A ** 3 / 6 + (5 - 18 * T + T * T + 72 * C - 58 * ep2) * A ** 5 / 120) + p["x0"]
    y = k0 * (M(phi) - M(math.radians(p["lat0"])) + N * math.tan(phi) * (
        A * A / 2 + (5 - T + 9 * C + 4 * C * C) * A ** 4 / 24
        + (61 - 58 * T + T * T + 600 * C - 330 * ep2) * A ** 6 / 720)) + p["y0"]
    return x, y


def test_inverse_projection_round_trip(spark):
    from pyspark.sql import functions as F
    pts = [(37.5, 127.0), (35.1, 129.0), (33.5, 126.5), (38.2, 128.5)]
    rows = [(lat, lon, *_forward_tm(lat, lon)) for lat, lon in pts]
    df = spark.createDataFrame(rows, "lat0 double, lon0 double, x double, y double")
    for name, expr in geo.stages("x", "y"):
        df = df.withColumn(name, F.expr(expr))
    for r in df.select("lat0", "lon0", F.degrees("_lat_b").alias("lb"), F.degrees("_lon_b").alias("ob")).collect():
        assert abs(r.lb - r.lat0) < 1e-6 and abs(r.ob - r.lon0) < 1e-6
