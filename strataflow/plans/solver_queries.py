"""Solvers, iterations, ray casting and file round trips."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boolean, linear
from ..session import ship, table
from ..sources import files
from .registry import _render, query, sql


def iterate(name: str, fields: dict[str, tuple[str, str]], steps: int, out: str, every: bool = False) -> None:
    """A query that repeats a step: fields are name -> (start, next value), with earlier values as :name.

    Spark folds over a sequence within one row; the oracle is a recursive query. `every` returns each step, else the last.
    """
    of = lambda text, by: re.sub(r":(\w+)", by, text)
    cast = lambda text: f"cast({text} as double)"
    start = ", ".join(f"'{k}', {cast(a)}" for k, (a, _) in fields.items())
    then = ", ".join(f"'{k}', {cast(of(b, r's.\1'))}" for k, (_, b) in fields.items())
    ns = f"select explode(sequence(0, {steps})) as n" if every else f"select {steps} as n"
    fold = f"select n, aggregate(slice(sequence(1, {steps}), 1, n), named_struct({start}), (s, i) -> named_struct({then})) as s from ({ns})"
    names = ", ".join(fields)
    spark = f"select n, {of(out, r's.\1')} from ({fold})"
    oracle = f"with recursive e(n, {names}) as (select 0, {', '.join(cast(a) for a, _ in fields.values())} union all select n + 1, {', '.join(cast(of(b, r'\1')) for _, b in fields.values())} from e where n < {steps}) select n, {of(out, r'\1')} from e" + ("" if every else f" where n = {steps}")
    sql(name, spark, oracle)


def _runge_kutta(slope_y: str, slope_z: str, h: str) -> tuple[str, str]:
    """Next y and z of y' = slope_y, z' = slope_z, in terms of :x, :y, :z."""

    def at(x: str, y: str, z: str) -> tuple[str, str]:
        put = lambda t: "(" + t.replace(":x", f"({x})").replace(":y", f"({y})").replace(":z", f"({z})") + ")"
        return put(slope_y), put(slope_z)

    k = [at(":x", ":y", ":z")]
    for part in (f"{h} / 2", f"{h} / 2", h):
        ky, kz = k[-1]
        k.append(at(f":x + {part}", f":y + {part} * {ky}", f":z + {part} * {kz}"))
    mean = lambda i: f"{h} / 6 * ({k[0][i]} + 2 * {k[1][i]} + 2 * {k[2][i]} + {k[3][i]})"
    return f":y + {mean(0)}", f":z + {mean(1)}"


# y'' = -y' / x from x = 1, y = 1, y' = 1; the solution is 1 + ln x
NEXT_Y, NEXT_Z = _runge_kutta(":z", "-:z / :x", "0.1e0")
iterate("ode_rk4", {"x": ("1", ":x + 0.1e0"), "y": ("1", NEXT_Y), "z": ("1", NEXT_Z)}, 10, "round(:x, 6) as x, round(:y, 8) as y, round(:z, 8) as z", every=True)
BASHFORTH = "0.1e0 / 24 * (55 * {0} - 59 * :{1}1 + 37 * :{1}2 - 9 * :{1}3)"
iterate(
    "ode_adams",
    {
        "k": ("0", ":k + 1"), "x": ("1", ":x + 0.1e0"),
        "y": ("1", f"case when :k < 3 then {NEXT_Y} else :y + {BASHFORTH.format(':z', 'p')} end"),
        "z": ("1", f"case when :k < 3 then {NEXT_Z} else :z + {BASHFORTH.format('(-:z / :x)', 'q')} end"),
        "p1": ("0", ":z"), "p2": ("0", ":p1"), "p3": ("0", ":p2"), "q1": ("0", "-:z / :x"), "q2": ("0", ":q1"), "q3": ("0", ":q2"),
    },
    10, "round(:x, 6) as x, round(:y, 8) as y", every=True,
)
SWING_Y, SWING_Z = _runge_kutta(":z", "-9.81e0 * sin(:y) - 0.1e0 * :z", "0.05e0")
iterate("ode_pendulum", {"x": ("0", ":x + 0.05e0"), "y": ("1", SWING_Y), "z": ("0", SWING_Z)}, 40, "round(:y, 7) + 0.0e0 as angle, round(:z, 7) + 0.0e0 as speed", every=True)

# shooting: two trial slopes of y'' = y, y(0) = 0, y(1) = 1, and the secant between their ends; the problem is linear, so it's exact
UP_Y, UP_Z = _runge_kutta(":z", ":y", "0.1e0")
LOW = {"x": ("0", ":x + 0.1e0"), "y": ("0", UP_Y), "z": ("0.5", UP_Z)}
HIGH = {"v": ("0", UP_Y.replace(":y", ":v").replace(":z", ":w")), "w": ("1.5", UP_Z.replace(":y", ":v").replace(":z", ":w"))}
iterate("shooting", LOW | HIGH, 10, "round(0.5e0 + (1 - :y) * (1.5e0 - 0.5e0) / (:v - :y), 8) as slope")

# two equations: x0 = cos(x1) / 3 + 0.5 and x1 = sin(x0) / 2, by Newton with Cramer's rule and by simple iteration
F1, F2 = "(:a - cos(:b) / 3 - 0.5e0)", "(:b - sin(:a) / 2)"
DET = "(1 + sin(:b) / 3 * cos(:a) / 2)"
iterate("newton_2d", {"a": ("1", f":a - ({F1} - {F2} * sin(:b) / 3) / {DET}"), "b": ("1", f":b - ({F2} + {F1} * cos(:a) / 2) / {DET}")}, 8, "round(:a, 9) as a, round(:b, 9) as b")
iterate("contraction", {"a": ("1", "cos(:b) / 3 + 0.5e0"), "b": ("1", "sin(:a) / 2")}, 40, "round(:a, 9) as a, round(:b, 9) as b, round(greatest(abs(:a - cos(:b) / 3 - 0.5e0), abs(:b - sin(:a) / 2)), 9) as miss")
sql("grid_min", "select a, b from (select a, b, row_number() over (order by round(abs(a - cos(b) / 3 - 0.5e0) + abs(b - sin(a) / 2), 9), a, b) as k from (select a0 / 20.0e0 as a, b0 / 20.0e0 as b from (select {range|0|40} as a0) r cross join (select {range|0|40} as b0) q)) where k = 1")

# fixed values: a system of four unknowns, by simple iteration and by Seidel's
ROWS = [((-14, 6, 1, -5), 95), ((-6, 27, 7, -6), -41), ((7, -5, -23, -8), 69), ((3, -8, -7, 26), 27)]


def _relaxed(i: int, have: dict[int, str]) -> str:
    row, side = ROWS[i]
    return f"({side} - " + " - ".join(f"({v}) * {have.get(j, f':x{j}')}" for j, v in enumerate(row) if j != i) + f") / ({row[i]}e0)"


SOLUTION = ", ".join(f"round(:x{i}, 6) as x{i}" for i in range(4))
iterate("jacobi_iter", {f"x{i}": ("0", _relaxed(i, {})) for i in range(4)}, 60, SOLUTION)
SEIDEL: dict[int, str] = {}
for number in range(4):
    SEIDEL[number] = f"({_relaxed(number, SEIDEL)})"
iterate("seidel_iter", {f"x{i}": ("0", SEIDEL[i]) for i in range(4)}, 30, SOLUTION)

# fixed values: bands of a tridiagonal system
BANDS = "(values (1, 0.0e0, 16.0e0, -8.0e0, 0.0e0), (2, -7.0e0, -16.0e0, 5.0e0, -123.0e0), (3, 4.0e0, 12.0e0, 3.0e0, -68.0e0), (4, -4.0e0, 12.0e0, -7.0e0, 104.0e0), (5, -1.0e0, 7.0e0, 0.0e0, 20.0e0)) as t(i, a, b, c, d)"


def sweep(name: str, bands: str, n: int) -> None:
    """A tridiagonal system by a forward and a backward sweep over rows (i, a, b, c, d), i from 1 to n."""
    sql(name, f"""
with recursive bands as (select i, a, b, c, d from {bands}),
fw(i, p, q) as (select i, -c / b, d / b from bands where i = 1 union all select t.i, -t.c / (t.b + t.a * f.p), (t.d - t.a * f.q) / (t.b + t.a * f.p) from fw f join bands t on t.i = f.i + 1),
bw(i, x) as (select i, q from fw where i = {n} union all select f.i, f.p * r.x + f.q from bw r join fw f on f.i = r.i - 1)
select i, round(x, 7) + 0.0e0 as x from bw""")  # fmt: skip


sweep("thomas", BANDS, 5)
# y'' - y = 0 on [0, 1] in ten steps, y(0) = 0 and y(1) = 1
sweep("bvp_difference", "(select cast(k as int) as i, case when k = 1 then 0.0e0 else 1.0e0 end as a, -2.01e0 as b, case when k = 9 then 0.0e0 else 1.0e0 end as c, case when k = 9 then -1.0e0 else 0.0e0 end as d from (select {range|1|9} as k) r)", 9)
KNOTS = "(values (0, 0.1e0, 100.01e0), (1, 0.5e0, 4.25e0), (2, 0.9e0, 2.0446e0), (3, 1.3e0, 2.2817e0), (4, 1.7e0, 3.236e0)) as k(i, x, y)"
sweep("spline", f"(select i, case when i = 1 then 0.0e0 else x - px end as a, 2 * (nx - px) as b, case when i = 3 then 0.0e0 else nx - x end as c, 3 * ((ny - y) / (nx - x) - (y - py) / (x - px)) as d from (select i, x, y, lag(x) over (order by i) as px, lag(y) over (order by i) as py, lead(x) over (order by i) as nx, lead(y) over (order by i) as ny from {KNOTS}) where i between 1 and 3)", 3)
LEADS = "".join(f", lead(x, {k}) over (order by i) as x{k}" for k in range(1, 5))
sql("newton_interp", f"""
with t0 as (select i, x, y{LEADS} from {KNOTS}),
t1 as (select *, (lead(y) over (order by i) - y) / (x1 - x) as d1 from t0),
t2 as (select *, (lead(d1) over (order by i) - d1) / (x2 - x) as d2 from t1),
t3 as (select *, (lead(d2) over (order by i) - d2) / (x3 - x) as d3 from t2),
t4 as (select *, (lead(d3) over (order by i) - d3) / (x4 - x) as d4 from t3)
select round(y + d1 * (0.8e0 - x) + d2 * (0.8e0 - x) * (0.8e0 - x1) + d3 * (0.8e0 - x) * (0.8e0 - x1) * (0.8e0 - x2) + d4 * (0.8e0 - x) * (0.8e0 - x1) * (0.8e0 - x2) * (0.8e0 - x3), 7) as value from t4 where i = 0""")
GRID = "select x, y, case when x in (0, 63) or y in (0, 63) then cast(x * y as double) else 0.0e0 end as u from (select {range|0|63} as x) a cross join (select {range|0|63} as y) b"
sql("liebmann_step", f"""
with g as ({GRID}), o as (select dx, dy from (values (-1, 0), (1, 0), (0, -1), (0, 1)) as v(dx, dy)),
near as (select g.x + o.dx as x, g.y + o.dy as y, sum(g.u) / 4 as u, count(*) as n from g cross join o group by g.x + o.dx, g.y + o.dy)
select g.x, g.y, case when g.x in (0, 63) or g.y in (0, 63) then g.u else near.u end as u from g join near on near.x = g.x and near.y = g.y""")

# rays from the origin through a grid of pixels; walls are the border of a 16 x 16 map and some tiles inside
RAYS = "select i, cast(i % 32 - 16 as double) / 32 as dx, cast(floor(i / 32) - 16 as double) / 32 as dy from (select {range|0|1023} as i) r"
TRIANGLES = "(values (1, -1.0e0, -1.0e0, 4.0e0, 1.0e0, -1.0e0, 4.0e0, 0.0e0, 1.0e0, 5.0e0), (2, -2.0e0, -1.0e0, 6.0e0, 2.0e0, -1.0e0, 6.0e0, 0.0e0, 3.0e0, 3.0e0)) as t(k, ax, ay, az, bx, by_, bz, cx, cy, cz)"
sql("ray_triangle", f"""
with e as (select k, ax, ay, az, bx - ax as ux, by_ - ay as uy, bz - az as uz, cx - ax as vx, cy - ay as vy, cz - az as vz from {TRIANGLES}),
h as (select i, k, dx, dy, ux, uy, uz, vx, vy, vz, ax, ay, az, dy * vz - vy as px, vx - dx * vz as py, dx * vy - dy * vx as pz from ({RAYS}) r cross join e),
d as (select *, ux * px + uy * py + uz * pz as det, -ax * px - ay * py - az * pz as un, -ay * uz + az * uy as qx, -az * ux + ax * uz as qy, -ax * uy + ay * ux as qz from h),
s as (select i, k, un / det as u, (dx * qx + dy * qy + qz) / det as v, (vx * qx + vy * qy + vz * qz) / det as t from d where abs(det) > 1e-10),
hit as (select i, k, t, row_number() over (partition by i order by t, k) as near from s where u >= 0 and v >= 0 and u + v <= 1 and t > 0)
select i, k, round(t, 6) as depth from hit where near = 1""")
WALL = "({0} <= 0 or {0} >= 15 or {1} <= 0 or {1} >= 15 or (({0} * 5 + {1} * 3) % 17 = 0))"
sql("grid_raycast", f"""
with r as (select i, 7.3e0 as px, 6.6e0 as py, (i - 32) * 0.016e0 as off, cos((i - 32) * 0.016e0 + 0.4e0) as dx, sin((i - 32) * 0.016e0 + 0.4e0) as dy from (select {{range|0|64}} as i) a),
c as (select i, off, (k - px) / dx as t, k - case when dx < 0 then 1 else 0 end as tx, cast(floor(py + (k - px) / dx * dy) as bigint) as ty from r cross join (select {{range|0|16}} as k) l where abs(dx) > 1e-9
      union all select i, off, (k - py) / dy, cast(floor(px + (k - py) / dy * dx) as bigint), k - case when dy < 0 then 1 else 0 end from r cross join (select {{range|0|16}} as k) l where abs(dy) > 1e-9)
select i, round(greatest(min(t) * cos(off), 0.00001e0), 6) as depth from c where t > 0 and {WALL.format('tx', 'ty')} group by i, off""")
sql("collision", f"""
select x, y, max(case when {WALL.format('(x + dx)', '(y + dy)')} then 1 else 0 end) = 1 as blocked
from (select {{range|1|14}} as x) a cross join (select {{range|1|14}} as y) b cross join (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) as o(dx, dy) group by x, y""")

PIECE = "[A-Za-z0-9Ѐ-ѿ'-]+¦[^A-Za-z0-9Ѐ-ѿ'-]+"
POSITIONS = f"""
select doc_id, pos - {{bytes|piece}} + {{bytes|piece}} - {{bytes|{{replace_all|piece|{{re|^[-']+}}|''}}}} as position, {{bytes|token}} as size, token
from (select doc_id, piece, lower({{replace_all|piece|{{re|^[-']+¦[-']+$}}|''}}) as token, sum({{bytes|piece}}) over (partition by doc_id order by i) - {{bytes|piece}} as pos
      from (select doc_id, {{indexed|{{extract_all|text|{{re|{PIECE}}}|0}}|i|piece}} from documents))
where {{matches|piece|{{re|[A-Za-z0-9Ѐ-ѿ]}}}}""".replace("pos - {bytes|piece} + {bytes|piece} - ", "pos + {bytes|piece} - ")


@query(POSITIONS)
def tokenize_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with the byte where each begins. Pieces of a text are summed up in its own row, so nothing is shuffled but ids; only
    texts that share an id, whose pieces the SQL sums together, go through its window."""
    boolean.ready(spark)
    running = F.pandas_udf(lambda lists: lists.map(lambda x: x.cumsum(dtype="int64"), na_action="ignore"), "array<long>")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    several = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"))
    shared = None
    if several.isEmpty():
        alone = docs
    else:
        same = docs["doc_id"].eqNullSafe(several["__id"])
        alone, shared = docs.join(several, same, "left_anti"), docs.join(several, same, "left_semi")
    pieces = F.regexp_extract_all("text", F.lit(PIECE.replace("¦", "|")), 0)
    held = alone.select("doc_id", pieces.alias("pieces")).withColumn("ends", running(F.transform("pieces", F.octet_length)))
    each = held.select("doc_id", F.explode(F.arrays_zip("pieces", "ends")).alias("x"))
    rows = each.select("doc_id", F.col("x.pieces").alias("piece"), (F.col("x.ends") - F.octet_length("x.pieces")).alias("pos"))
    token = F.lower(F.regexp_replace("piece", "^[-']+|[-']+$", ""))
    position = F.col("pos") + F.octet_length("piece") - F.octet_length(F.regexp_replace("piece", "^[-']+", ""))
    found = rows.where(F.col("piece").rlike("[A-Za-z0-9Ѐ-ѿ]")).select("doc_id", position.alias("position"), F.octet_length(token).alias("size"), token.alias("token"))
    if shared is None:
        return found
    return found.union(spark.sql(_render(POSITIONS, 0).replace("from documents", "from {shared}"), shared=shared))


MATRIX = "array(s_suppkey % 7 + 20, s_suppkey % 5, s_suppkey % 3, s_suppkey % 11, s_suppkey % 13 + 30, s_suppkey % 2, s_suppkey % 17, s_suppkey % 4, s_suppkey % 19 + 25)"
CELLS = "select s_suppkey, s_suppkey % 7 + 20 as a, s_suppkey % 5 as b, s_suppkey % 3 as c, s_suppkey % 11 as d, s_suppkey % 13 + 30 as e, s_suppkey % 2 as f, s_suppkey % 17 as g, s_suppkey % 4 as h, s_suppkey % 19 + 25 as i, 1.0e0 as p, 2.0e0 as q, s_suppkey % 23 as r from supplier"


def _det(a: str, b: str, c: str, d: str, e: str, f: str, g: str, h: str, i: str) -> str:
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


@query(f"select s_suppkey, round({_det(*'abcdefghi')}, 4) as det, round({_det(*'pbcqefrhi')} / {_det(*'abcdefghi')}, 8) as x1, round({_det(*'apcdqfgri')} / {_det(*'abcdefghi')}, 8) as x2, round({_det(*'abpdeqghr')} / {_det(*'abcdefghi')}, 8) as x3 from ({CELLS})".replace("round((", "round(1.0e0 * ("))
def lu_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A system of three unknowns a supplier; the oracle uses Cramer's rule."""
    ship(spark)
    a = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(f"cast({MATRIX} as array<double>)").alias("m"), F.expr("cast(array(1, 2, s_suppkey % 23) as array<double>)").alias("b"))
    a = a.select("s_suppkey", linear.determinant("m").alias("det"), linear.solve("m", "b").alias("x"))
    return a.select("s_suppkey", F.round("det", 4).alias("det"), *[F.round(F.col("x")[i], 8).alias(f"x{i + 1}") for i in range(3)])


@query(f"select s_suppkey, round(1.0e0 * (e * i - f * h) / {_det(*'abcdefghi')}, 8) as first, round(1.0e0 * (a * e - b * d) / {_det(*'abcdefghi')}, 8) as last from ({CELLS})")
def matrix_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corner elements of each supplier's inverse matrix."""
    ship(spark)
    a = table(spark, sf_dir, "supplier").select("s_suppkey", linear.inverse(F.expr(f"cast({MATRIX} as array<double>)")).alias("m"))
    return a.select("s_suppkey", F.round(F.col("m")[0], 8).alias("first"), F.round(F.col("m")[8], 8).alias("last"))


@query("""
with c as (select s_suppkey, 1.0e0 * (s_suppkey % 7) as a, 1.0e0 * (s_suppkey % 5 + 9) as b, 1.0e0 * (s_suppkey % 3 + 20) as c, 1.0e0 * (s_suppkey % 4 + 1) as d, 1.0e0 * (s_suppkey % 6) as e, 1.0e0 * (s_suppkey % 2) as f from supplier),
m as (select *, (a + b + c) / 3 as q from c),
n as (select *, sqrt((2 * (d * d + e * e + f * f) + (a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q)) / 6) as p from m),
r as (select *, acos(least(1.0e0, greatest(-1.0e0, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (p * p * p) / 2))) / 3 as phi from n)
select s_suppkey, round(q + 2 * p * cos(phi + 2 * pi() / 3), 6) + 0.0e0 as low, round(q + 2 * p * cos(phi), 6) as high from r""")
def eig_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and largest eigenvalue of a symmetric matrix a supplier; the oracle has the closed form for three rows."""
    ship(spark)
    m = "cast(array(s_suppkey % 7, s_suppkey % 4 + 1, s_suppkey % 6, s_suppkey % 4 + 1, s_suppkey % 5 + 9, s_suppkey % 2, s_suppkey % 6, s_suppkey % 2, s_suppkey % 3 + 20) as array<double>)"
    a = table(spark, sf_dir, "supplier").select("s_suppkey", linear.symmetric_eigenvalues(F.expr(m)).alias("v"))
    return a.select("s_suppkey", (F.round(F.col("v")[0], 6) + F.lit(0.0)).alias("low"), F.round(F.col("v")[2], 6).alias("high"))


@query("""
with c as (select s_suppkey, 1.0e0 * (s_suppkey % 7) as a, 1.0e0 * (s_suppkey % 5 + 1) as b, 1.0e0 * (s_suppkey % 3 - 1) as c, 1.0e0 * (s_suppkey % 4) as d from supplier),
m as (select *, (a - d) * (a - d) / 4 + b * c as disc from c)
select s_suppkey, round((a + d) / 2 - case when disc > 0 then sqrt(disc) else 0 end, 6) + 0.0e0 as re, round(case when disc < 0 then -sqrt(-disc) else 0 end, 6) + 0.0e0 as im from m""")
def eig_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eigenvalue of a general matrix a supplier, complex ones included."""
    ship(spark)
    m = "cast(array(s_suppkey % 7, s_suppkey % 5 + 1, s_suppkey % 3 - 1, s_suppkey % 4) as array<double>)"
    a = table(spark, sf_dir, "supplier").select("s_suppkey", linear.eigenvalues(F.expr(m)).alias("v"))
    return a.select("s_suppkey", *[(F.round(F.col("v")[0][part], 6) + F.lit(0.0)).alias(part) for part in ("re", "im")])


@query()
def mc_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of a circle of radius ten from seeded random points."""
    points = spark.range(0, 1_000_000, 1, 8).select((F.rand(7) * 2 - 1).alias("x"), (F.rand(11) * 2 - 1).alias("y"))
    return points.agg((F.count_if(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1) * 400.0 / F.count("*")).alias("area"))


@query("select * from (values ('job3', 'job1'), ('job3', 'job2'), ('job4', 'job3'), ('job6', 'job4'), ('job6', 'job5')) as e(job, needs)")
def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a job graph kept as a JSON map from a job to what it needs."""
    text = '{"job1": {"dependencies": []}, "job3": {"dependencies": ["job1", "job2"]}, "job4": {"dependencies": ["job3"]}, "job6": {"dependencies": ["job4", "job5"]}}'
    jobs = spark.createDataFrame([(text,)], "body string").select(F.explode(F.from_json("body", "map<string, struct<dependencies: array<string>>>")).alias("job", "spec"))
    return jobs.select("job", F.explode("spec.dependencies").alias("needs"))


@query("select term, count(*) as docs, min(doc_id) as first_doc, max(doc_id) as last_doc from (select distinct doc_id, {unnest|{terms|text}} as term from documents) group by term")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A postings index, saved, loaded, and summed up by term."""
    docs = table(spark, sf_dir, "documents")
    parts = boolean.part_count(docs)
    path = files.save_index(boolean.posting_lists(docs, parts), boolean.universe(docs, parts), files.scratch_path(spark, "index"))
    lists, _ = files.load_index(spark, path)
    first, last = F.min(F.col("ids")[0]), F.max(F.element_at("ids", -1))
    return lists.groupBy("term").agg(F.sum(F.size("ids")).alias("docs"), first.alias("first_doc"), last.alias("last_doc"))


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV and read back by schema."""
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    columns = [c.split()[0] for c in schema.split(", ")]
    return files.read_csv(spark, files.write_csv(table(spark, sf_dir, "customer").select(*columns), files.scratch_path(spark, "csv")), schema)


@query("select conv_id, turn, role, text from conversations")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines and read back by schema."""
    path = files.scratch_path(spark, "json")
    table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").write.json(path)
    return spark.read.schema("conv_id long, turn long, role string, text string").json(path)


# a sine is a mode of each scheme, so its oracle is a closed form: every step multiplies the mode by one factor
MODE = "sin(pi() * k / 20)"
PULL = "(4 * sin(pi() / 40) * sin(pi() / 40))"


def _mode(factor: str) -> str:
    return f"select k, round({MODE} * {factor}, 8) as u from (select {{range|1|19}} as k) r"


def _line(spark: SparkSession, weight: float) -> DataFrame:
    ship(spark)
    start = spark.sql(f"select transform(sequence(1, 19), k -> {MODE}) as u")
    return start.select(F.posexplode(linear.heat_line(0.8, weight, 30)("u")).alias("k", "u")).select((F.col("k") + 1).cast("long").alias("k"), F.round("u", 8).alias("u"))


@query(_mode(f"power(1 / (1 + 0.8e0 * {PULL}), 30)"))
def heat_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat on a line, implicit steps."""
    return _line(spark, 1.0)


@query(_mode(f"power((1 - 0.4e0 * {PULL}) / (1 + 0.4e0 * {PULL}), 30)"))
def heat_crank_nicolson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat on a line, the mean of explicit and implicit steps."""
    return _line(spark, 0.5)


@query(f"select x, y, round(sin(pi() * x / 20) * sin(pi() * y / 20) * power((1 - 0.4e0 * {PULL}) / (1 + 0.4e0 * {PULL}), 40), 8) as u from (select {{range|1|19}} as x) a cross join (select {{range|1|19}} as y) b")
def heat_alternating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat on a plate by alternating directions."""
    ship(spark)
    start = spark.sql("select transform(sequence(0, 360), i -> sin(pi() * (i % 19 + 1) / 20) * sin(pi() * (i div 19 + 1) / 20)) as u")
    out = start.select(F.posexplode(linear.heat_plate(0.8, 20)("u")).alias("i", "u"))
    return out.select((F.col("i") % 19 + 1).cast("long").alias("x"), F.expr("cast(i div 19 + 1 as bigint)").alias("y"), F.round("u", 8).alias("u"))


@query("select x, y, cast(x * y as double) as u from (select {range|0|11} as x) a cross join (select {range|0|11} as y) b")
def poisson_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplace's equation by over-relaxation; with x * y held at the border the solution is x * y."""
    ship(spark)
    start = spark.sql("select transform(sequence(0, 143), i -> if(i % 12 in (0, 11) or i div 12 in (0, 11), cast((i % 12) * (i div 12) as double), cast(0 as double))) as u")
    out = start.select(F.posexplode(linear.relax(1.5, 120)("u")).alias("i", "u"))
    return out.select((F.col("i") % 12).cast("long").alias("x"), F.expr("cast(i div 12 as bigint)").alias("y"), F.round("u", 7).alias("u"))


# a standing wave: with a first step of second order, step n of the scheme is cos(n w) times the mode, cos w = 1 - C C pull / 2
sql("wave_explicit", f"""
select cast(pos as bigint) as k, round(u, 7) + 0.0e0 as u from (select posexplode(aggregate(sequence(1, 40),
  named_struct('old', transform(sequence(0, 20), k -> if(k in (0, 20), cast(0 as double), {MODE})), 'now', transform(sequence(0, 20), k -> if(k in (0, 20), cast(0 as double), {MODE} * (1 - 0.32e0 * {PULL})))),
  (s, n) -> named_struct('old', s.now, 'now', transform(s.now, (v, k) -> if(k in (0, 20), cast(0 as double), 2 * v - get(s.old, k) + 0.64e0 * (get(s.now, k - 1) - 2 * v + get(s.now, k + 1)))))).old) as (pos, u))""",
    f"select k, round(case when k in (0, 20) then 0.0e0 else {MODE} * cos(40 * acos(1 - 0.32e0 * {PULL})) end, 7) + 0.0e0 as u from (select {{range|0|20}} as k) r")


@query("select x, y, (x * 7 + y * 13) % 256 as red, (x * y) % 256 as green, (x + y) % 256 as blue, 255 as alpha from (select {range|0|15} as x) a cross join (select {range|0|15} as y) b")
def image_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image as bytes (width, height as little-endian 32-bit, then four bytes a pixel), stored, read back and taken apart."""
    byte = lambda v: f"lpad(hex({v}), 2, '0')"
    pixel = "".join(f", {byte(v)}" for v in ("((i % 16) * 7 + (i div 16) * 13) % 256", "((i % 16) * (i div 16)) % 256", "((i % 16) + (i div 16)) % 256", "255"))
    path = files.scratch_path(spark, "image")
    spark.sql(f"select unhex(concat('1000000010000000', array_join(transform(sequence(0, 255), i -> concat('' {pixel})), ''))) as content").write.parquet(path)
    at = lambda k: f"cast(conv(hex(substring(content, {k}, 1)), 16, 10) as bigint)"
    number = lambda k: "(" + " + ".join(f"{at(k + j)} * {256**j}" for j in range(4)) + ")"
    sized = spark.read.schema("content binary").parquet(path).selectExpr("content", f"{number(1)} as w", f"{number(5)} as h")
    pixels = sized.selectExpr("content", "w", "explode(sequence(0, cast(w * h - 1 as int))) as i")
    return pixels.selectExpr("i % w as x", "i div w as y", *[f"{at(f'9 + 4 * i + {j}')} as {name}" for j, name in enumerate(("red", "green", "blue", "alpha"))])
