"""Schemes for heat and waves, light on surfaces, scenes, orthogonal series, and the order of jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linear
from ..session import ship
from .registry import query, sql
from .solver_queries import MODE, PULL

# the right end's flux is 1, by one of three formulas; ratio of the steps 0.25, so h * h / (2 * tau) = 2
INNER = "if(k = 0, cast(0 as double), v + 0.25 * (get(u, k - 1) - 2 * v + coalesce(get(u, k + 1), v)))"
RIGHT = "case rule when 1 then {a} + 0.05 when 2 then (4 * {a} - {b} + 0.1) / 3 else ({a} + 0.05 + 2 * {c}) / 3 end"
sql("heat_flux_borders", f"""
select rule, cast(pos as bigint) as k, round(u, 8) as u from (select rule, posexplode(aggregate(sequence(1, 60), transform(sequence(0, 20), k -> sin(pi() * k / 40)),
  (u, n) -> element_at(transform(array(transform(u, (v, k) -> {INNER})), w -> concat(slice(w, 1, 20), array({RIGHT.format(a="get(w, 19)", b="get(w, 18)", c="get(u, 20)")}))), 1))) as (pos, u)
  from values (1), (2), (3) as t(rule))""",
    f"""with recursive e(n, rule, u) as (
  select 0, rule, [sin(pi() * k / 40) for k in range(21)] from (values (1), (2), (3)) t(rule)
  union all
  select n + 1, rule, list_concat(w, [{RIGHT.format(a="w[20]", b="w[19]", c="u[21]")}])
  from (select n, rule, u, [case when i = 1 then 0.0e0 else u[i] + 0.25e0 * (u[i - 1] - 2 * u[i] + u[i + 1]) end for i in range(1, 21)] as w from e where n < 60))
select rule, unnest(range(21)) as k, round(unnest(u), 8) as u from e where n = 60""")


@query(f"select x, y, round(sin(pi() * x / 20) * sin(pi() * y / 20) * power(1 / (1 + 0.8e0 * {PULL}), 40), 8) as u from (select {{range|1|19}} as x) a cross join (select {{range|1|19}} as y) b")
def heat_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat on a plate by fractional steps."""
    ship(spark)
    start = spark.sql("select transform(sequence(0, 360), i -> sin(pi() * (i % 19 + 1) / 20) * sin(pi() * (i div 19 + 1) / 20)) as u")
    out = start.select(F.posexplode(linear.heat_plate_split(0.8, 20)("u")).alias("i", "u"))
    return out.select((F.col("i") % 19 + 1).cast("long").alias("x"), F.expr("cast(i div 19 + 1 as bigint)").alias("y"), F.round("u", 8).alias("u"))


# an implicit wave from rest: step n is (1 + s) to the power -n / 2 times cos(n a) + sqrt(s) sin(n a), tan a = sqrt(s)
@query(f"""
select k, round({MODE} * power(1 + s, -15) * (cos(30 * atan(sqrt(s))) + sqrt(s) * sin(30 * atan(sqrt(s)))), 7) as u
from (select k, 0.64e0 * {PULL} as s from (select {{range|1|19}} as k) r)""")
def wave_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wave on a line, implicit steps."""
    ship(spark)
    start = spark.sql(f"select transform(sequence(1, 19), k -> {MODE}) as u")
    out = start.select(F.posexplode(linear.wave_line(0.64, 30)("u")).alias("k", "u"))
    return out.select((F.col("k") + 1).cast("long").alias("k"), F.round("u", 7).alias("u"))


@query("select nx, ny, round(least(1.95, greatest(1.0, 2 / (1 + sin(pi() / greatest(nx, ny))))), 9) as omega from (values (2, 1), (10, 20), (50, 40), (500, 3)) as t(nx, ny)")
def sor_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor of over-relaxation for grids of several sizes."""
    grids = [(2, 1), (10, 20), (50, 40), (500, 3)]
    return spark.createDataFrame([(nx, ny, round(linear.sor_factor(nx, ny), 9)) for nx, ny in grids], "nx int, ny int, omega double")


@query("select n, round(c, 7) as c, round(rest, 7) as rest from (values (1, 0.0, sqrt(2 / 9.0)), (2, 5 / 7.0, sqrt(8 / 441.0)), (3, 0.0, sqrt(8 / 441.0)), (4, 1.0, 0.0)) as t(n, c, rest)")
def weighted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube in a series of orthogonal polynomials on [-1, 1] under the weight t squared."""
    found = linear.orthogonal_series(lambda t: t**3, np.square, -1.0, 1.0, 4)
    return spark.createDataFrame([(n, round(c, 7) + 0.0, round(rest, 7)) for n, c, rest in found], "n int, c double, rest double")


RAYS = """(select i, dx / n as dx, dy / n as dy, 1 / n as dz from (select i, dx, dy, sqrt(dx * dx + dy * dy + 1) as n from (
  select i, cast(i % 32 - 16 as double) / 32 as dx, cast(floor(i / 32) - 16 as double) / 32 as dy from (select {range|0|1023} as i) r) d) e)"""
# planes y = -1 and z = 9; a ray that runs along a plane, or away from it, doesn't meet it
PLANES = "(values (1, 0.0e0, -1.0e0, 0.0e0, 0.0e0, 1.0e0, 0.0e0), (2, 0.0e0, 0.0e0, 9.0e0, 0.0e0, 0.0e0, -1.0e0)) as p(plane, px, py, pz, nx, ny, nz)"
sql("ray_plane", f"""
select i, round(min(t), 6) as depth from (
  select i, case when abs(dx * nx + dy * ny + dz * nz) > 1e-6 and (px * nx + py * ny + pz * nz) / (dx * nx + dy * ny + dz * nz) >= 0 then (px * nx + py * ny + pz * nz) / (dx * nx + dy * ny + dz * nz) end as t
  from {RAYS} r cross join {PLANES}) h group by i""")
# light on a unit ball: from (2, 3, -4), seen along z; the shine is to the power of 32
sql("phong_light", """
select i, j, round(greatest(0.0e0, nx * lx + ny * ly + nz * lz), 7) as diffuse, round(power(greatest(0.0e0, (nx * (lx + vx) + ny * (ly + vy) + nz * (lz + vz)) / h), 32), 7) as specular from (
  select *, sqrt((lx + vx) * (lx + vx) + (ly + vy) * (ly + vy) + (lz + vz) * (lz + vz)) as h from (
    select i, j, nx, ny, nz, (2 - nx) / d as lx, (3 - ny) / d as ly, (-4 - nz) / d as lz, 0.0e0 as vx, 0.0e0 as vy, -1.0e0 as vz from (
      select *, sqrt((2 - nx) * (2 - nx) + (3 - ny) * (3 - ny) + (-4 - nz) * (-4 - nz)) as d from (
        select i, j, sin(pi() * i / 16) * cos(pi() * j / 8) as nx, cos(pi() * i / 16) as ny, sin(pi() * i / 16) * sin(pi() * j / 8) as nz
        from (select {range|1|15} as i) a cross join (select {range|0|15} as j) b) n) m) l) v""")
TETRAHEDRON = "(0, 0, 1, 1, 1), (0, 1, 1, -1, -1), (0, 2, -1, 1, -1), (0, 3, -1, -1, 1)"
CUBE = ", ".join(f"(1, {i}, {2 * (i & 1) - 1}, {(i & 2) - 1}, {(i & 4) // 2 - 1})" for i in range(8))
FACES = [(0, f) for f in ((0, 1, 2), (0, 3, 1), (0, 2, 3), (1, 3, 2))]
FACES += [(1, f) for a, b, c, d in ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)) for f in ((a, b, c), (a, c, d))]
FACE_ROWS = ", ".join(f"({s}, {i}, {a}, {b}, {c})" for i, (s, (a, b, c)) in enumerate(FACES))
# triangles of solids, with their normals turned outwards; a closed surface's volume comes from them
sql("solid_triangles", f"""
with v(solid, i, x, y, z) as (values {TETRAHEDRON}, {CUBE}), f(solid, k, a, b, c) as (values {FACE_ROWS})
select f.solid, count(*) as triangles, round(sum(sqrt({{sq|(b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y)}} + {{sq|(b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z)}} + {{sq|(b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)}}) / 2), 6) as area,
       round(sum(a.x * (b.y * c.z - b.z * c.y) - a.y * (b.x * c.z - b.z * c.x) + a.z * (b.x * c.y - b.y * c.x)) / 6.0e0, 6) as volume
from f join v a on a.solid = f.solid and a.i = f.a join v b on b.solid = f.solid and b.i = f.b join v c on c.solid = f.solid and c.i = f.c group by f.solid""",
    "select solid, triangles, round(area, 6) as area, round(volume, 6) as volume from (values (0, 4, 4 * 2 * sqrt(3.0), 8 / 3.0), (1, 12, 24.0, 8.0)) as t(solid, triangles, area, volume)")
