"""Plane -> geographic coordinates (C15): EPSG:5174 -> EPSG:4326.

Inverse transverse Mercator on the Bessel 1841 ellipsoid (Snyder, USGS
Professional Paper 1395, eqs. 8-18..8-25), then a 7-parameter Helmert shift
(position-vector convention) to WGS84 through geocentric coordinates, then
Bowring's closed form back to latitude/longitude.

The formula is written once as a list of SQL expression stages over plain
arithmetic and trigonometric functions that Spark SQL and DuckDB share, so
the Spark plan stays codegen-able and the oracle evaluates the same text.
The projection parameters are the published EPSG:5174 definition; they are
parameters, and the accuracy of the datum shift has not been checked against
an independent implementation offline.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# EPSG:5174 (Korean 1985 / Modified Central Belt) definition.
EPSG5174 = dict(
    a=6377397.155, inv_f=299.1528128,               # Bessel 1841
    lat0=38.0, lon0=127.0028902777778, k0=1.0, x0=200000.0, y0=500000.0,
    towgs84=(-115.80, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43),
)
WGS84 = dict(a=6378137.0, inv_f=298.257223563)


def _num(v: float) -> str:
    return repr(float(v))


def stages(x: str, y: str, p: dict = EPSG5174) -> list[tuple[str, str]]:
    """(column, SQL expression) stages; later stages reference earlier names."""
    a = p["a"]
    f = 1.0 / p["inv_f"]
    e2 = 2 * f - f * f
    ep2 = e2 / (1 - e2)
    e4, e6 = e2 * e2, e2 * e2 * e2
    m1 = 1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256
    m2 = 3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024
    m3 = 15 * e4 / 256 + 45 * e6 / 1024
    m4 = 35 * e6 / 3072
    lat0 = math.radians(p["lat0"])
    M0 = a * (m1 * lat0 - m2 * math.sin(2 * lat0) + m3 * math.sin(4 * lat0) - m4 * math.sin(6 * lat0))
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    c1 = 3 * e1 / 2 - 27 * e1 ** 3 / 32
    c2 = 21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32
    c3 = 151 * e1 ** 3 / 96
    c4 = 1097 * e1 ** 4 / 512
    n = _num
    tx_, ty_, tz_, rx, ry, rz, ds = p["towgs84"]
    sec = math.pi / (180 * 3600)
    rx, ry, rz = rx * sec, ry * sec, rz * sec
    s = 1 + ds * 1e-6
    wa = WGS84["a"]
    wf = 1.0 / WGS84["inv_f"]
    we2 = 2 * wf - wf * wf
    wb = wa * (1 - wf)
    wep2 = (wa * wa - wb * wb) / (wb * wb)
    return [
        ("_mu", f"({n(M0)} + ({y} - {n(p['y0'])}) / {n(p['k0'])}) / {n(a * m1)}"),
        ("_phi1", f"_mu + {n(c1)} * sin(2 * _mu) + {n(c2)} * sin(4 * _mu) + {n(c3)} * sin(6 * _mu) + {n(c4)} * sin(8 * _mu)"),
        ("_sp", "sin(_phi1)"),
        ("_cp", "cos(_phi1)"),
        ("_t1", "tan(_phi1) * tan(_phi1)"),
        ("_c1", f"{n(ep2)} * _cp * _cp"),
        ("_n1", f"{n(a)} / sqrt(1 - {n(e2)} * _sp * _sp)"),
        ("_r1", f"{n(a * (1 - e2))} / power(1 - {n(e2)} * _sp * _sp, 1.5)"),
        ("_d", f"({x} - {n(p['x0'])}) / (_n1 * {n(p['k0'])})"),
        ("_lat_b", f"_phi1 - (_n1 * tan(_phi1) / _r1) * (_d * _d / 2 - (5 + 3 * _t1 + 10 * _c1 - 4 * _c1 * _c1 - 9 * {n(ep2)})"
                   f" * power(_d, 4) / 24 + (61 + 90 * _t1 + 298 * _c1 + 45 * _t1 * _t1 - 252 * {n(ep2)} - 3 * _c1 * _c1)"
                   f" * power(_d, 6) / 720)"),
        ("_lon_b", f"{n(math.radians(p['lon0']))} + (_d - (1 + 2 * _t1 + _c1) * power(_d, 3) / 6 + (5 - 2 * _c1 + 28 * _t1"
                   f" - 3 * _c1 * _c1 + 8 * {n(ep2)} + 24 * _t1 * _t1) * power(_d, 5) / 120) / _cp"),
        ("_nb", f"{n(a)} / sqrt(1 - {n(e2)} * sin(_lat_b) * sin(_lat_b))"),
        ("_gx", "_nb * cos(_lat_b) * cos(_lon_b)"),
        ("_gy", "_nb * cos(_lat_b) * sin(_lon_b)"),
        ("_gz", f"_nb * (1 - {n(e2)}) * sin(_lat_b)"),
        ("_wx", f"{n(tx_)} + {n(s)} * (_gx - {n(rz)} * _gy + {n(ry)} * _gz)"),
        ("_wy", f"{n(ty_)} + {n(s)} * ({n(rz)} * _gx + _gy - {n(rx)} * _gz)"),
        ("_wz", f"{n(tz_)} + {n(s)} * ({n(-ry)} * _gx + {n(rx)} * _gy + _gz)"),
        ("_pp", "sqrt(_wx * _wx + _wy * _wy)"),
        ("_th", f"atan2(_wz * {n(wa)}, _pp * {n(wb)})"),
        ("lat", f"degrees(atan2(_wz + {n(wep2 * wb)} * power(sin(_th), 3), _pp - {n(we2 * wa)} * power(cos(_th), 3)))"),
        ("lon", "degrees(atan2(_wy, _wx))"),
    ]


def plane_to_geographic(df: DataFrame, x: str, y: str, digits: int = 7) -> DataFrame:
    """Add ``lon``/``lat`` (degrees, WGS84) for EPSG:5174 ``x``/``y``."""
    out = df
    temps = []
    for name, expr in stages(x, y):
        out = out.withColumn(name, F.expr(expr))
        if name.startswith("_"):
            temps.append(name)
    out = out.withColumn("lat", F.round("lat", digits)).withColumn("lon", F.round("lon", digits))
    return out.drop(*temps)


def duck_plane_to_geographic(src: str, x: str, y: str, digits: int = 7) -> str:
    """The same stages as nested DuckDB subqueries (oracle)."""
    sql = f"SELECT * FROM {src}"
    for i, (name, expr) in enumerate(stages(x, y)):
        sql = f"SELECT *, {expr} AS {name} FROM ({sql}) s{i}"
    return sql
