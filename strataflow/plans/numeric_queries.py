"""Numeric, geometric, graph and stateful queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem_ru import stem_terms
from ..functions.text import index_terms
from ..session import ship, table
from ..streaming import stateful, streams
from .registry import ORACLES, QUERIES, _render, query, sql
from .text_queries import TOKENS

DAILY = "select cast(o_orderdate as date) as day, round(sum(o_totalprice), 2) as y from orders group by cast(o_orderdate as date)"
sql("finite_diff", f"""
select day, round((lead(y) over w - lag(y) over w) / 2, 4) as d1, round(lead(y) over w - 2 * y + lag(y) over w, 4) as d2 from ({DAILY}) window w as (order by day)""")
GRID = "select i, i * 0.02 as x from (select {range|0|100} as i) r"
F_X = "(cast(x as double) / (cast(x as double) * cast(x as double) * cast(x as double) * cast(x as double) + 81))"
sql("quad_rect", f"select round(sum(0.02 * y), 9) as area from (select i, (x + 0.01) / ((x + 0.01) * (x + 0.01) * (x + 0.01) * (x + 0.01) + 81) as y from (select i, cast(i * 0.02 as double) as x from (select {{range|0|99}} as i) r))")
sql("quad_trap", f"select round(sum(0.02 * y * case when i in (0, 100) then 0.5 else 1 end), 9) as area from (select i, {F_X} as y from ({GRID}))")
sql("quad_simpson", f"select round(sum(0.02e0 / 3 * y * case when i in (0, 100) then 1 when i % 2 = 1 then 4 else 2 end), 9) as area from (select i, {F_X} as y from ({GRID}))")
sql("runge_romberg", "select round(i1 + (i1 - i2) / (power(2, p) - 1), 9) as better from (values (0.023657, 0.023641, 2.0), (0.023651, 0.023650, 4.0)) as t(i1, i2, p)")
sql("root_bracket", "select i, x from (select i, x, y, lead(y) over (order by i) as ny from (select i, x, x * x * x - 2 * x - 5 as y from (select i, cast(i * 0.1 as double) as x from (select {range|-50|50} as i) r))) where y * ny < 0")
sql("lagrange", """
with p(i, x, y) as (values (1, 0.1, 0.01), (2, 0.5, 0.25), (3, 0.9, 0.81), (4, 1.3, 1.69)),
w as (select a.i, a.y, exp(sum(ln(abs((0.8 - b.x) / (a.x - b.x))))) * (case when sum(case when (0.8 - b.x) / (a.x - b.x) < 0 then 1 else 0 end) % 2 = 1 then -1 else 1 end) as l
      from p a join p b on a.i <> b.i group by a.i, a.y)
select round(sum(cast(y as double) * l), 9) as value from w""")
sql("det3", "select s_suppkey, a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) as det from (select s_suppkey, s_suppkey % 7 as a, s_suppkey % 5 as b, s_suppkey % 3 as c, s_suppkey % 11 as d, s_suppkey % 13 as e, s_suppkey % 2 as f, s_suppkey % 17 as g, s_suppkey % 4 as h, s_suppkey % 19 as i from supplier)")
COO = "select o_custkey % 40 as i, o_orderkey % 40 as j, cast(sum(round(o_totalprice)) as double) as v from orders group by 1, 2"
sql("matmul", f"select a.i, b.j, sum(a.v * b.v) as v from ({COO}) a join ({COO}) b on a.j = b.i group by a.i, b.j")
sql("matrix_norms", f"select max(c) as columns, max(r) as lines, round(sqrt(max(f)), 4) as frobenius from (select sum(abs(v)) as c, 0.0e0 as r, 0.0e0 as f from ({COO}) group by j union all select 0.0e0, sum(abs(v)), 0.0e0 from ({COO}) group by i union all select 0.0e0, 0.0e0, sum(v * v) from ({COO}))")
sql("error_norms", "select round(max(abs(l_quantity * 1500 - l_extendedprice)), 4) as sup, round(avg(abs(l_quantity * 1500 - l_extendedprice)), 4) as mean, round(sqrt(avg({sq|l_quantity * 1500 - l_extendedprice})), 4) as rms from lineitem")
sql("vector_min", "select l_orderkey, l_linenumber, least(l_discount, l_tax) as low from lineitem")
sql("areas", "select s_suppkey, case when a <= 0 or b <= 0 then -1 else a * b end as rectangle, case when a <= 0 or b <= 0 then -1.0e0 else a * b / 2.0e0 end as triangle from (select s_suppkey, s_suppkey % 5 - 1 as a, s_suppkey % 7 as b from supplier)")
sql("quadratic_roots", """
select s_suppkey, roots, case when roots = 'one' and a = 0 then -1.0e0 * c / b when roots in ('one', 'two') then (-b - sqrt(d)) / (2.0e0 * a) end + 0.0e0 as first_root,
       case when roots = 'two' then (-b + sqrt(d)) / (2.0e0 * a) end + 0.0e0 as second_root
from (select *, greatest(b * b - 4 * a * c, 0) as d,
  case when a = 0 and b = 0 and c = 0 then 'any' when a = 0 and b = 0 then 'incorrect' when a = 0 then 'one' when b * b - 4 * a * c < 0 then 'imaginary' when b * b = 4 * a * c then 'one' else 'two' end as roots
  from (select s_suppkey, s_suppkey % 3 as a, s_suppkey % 5 as b, s_suppkey % 2 as c from supplier))""",
    """select s_suppkey, roots, case when roots = 'one' and a = 0 then -1.0e0 * c / b when roots in ('one', 'two') then (-b - sqrt(d)) / (2.0e0 * a) end + 0.0e0 as first_root,
       case when roots = 'two' then (-b + sqrt(d)) / (2.0e0 * a) end + 0.0e0 as second_root
from (select *, greatest(b * b - 4 * a * c, 0) as d,
  case when a = 0 and b = 0 and c = 0 then 'any' when a = 0 and b = 0 then 'incorrect' when a = 0 then 'one' when b * b - 4 * a * c < 0 then 'imaginary' when b * b = 4 * a * c then 'one' else 'two' end as roots
  from (select s_suppkey, s_suppkey % 3 as a, s_suppkey % 5 as b, s_suppkey % 2 as c from supplier))""")
sql("rotate2d", "select l_orderkey, l_linenumber, round(l_quantity * cos(l_tax) - l_discount * sin(l_tax), 6) as x, round(l_quantity * sin(l_tax) + l_discount * cos(l_tax), 6) as y from lineitem")
sql("exec_sum", "select l_orderkey, cast(sum(l_linenumber) as bigint) as total from lineitem group by l_orderkey")
sql("lattice_circle", "select round(4.0 * 100 * sum(case when (x - 500) * (x - 500) + (y - 500) * (y - 500) <= 250000 then 1 else 0 end) / 1002001, 6) as area from (select x, y from (select {range|0|1000} as x) a cross join (select {range|0|1000} as y) b)".replace("round(4.0 * 100", "round(400.0e0"))
sql("bezier", "select i, round(power(1 - t, 3) * 0 + 3 * power(1 - t, 2) * t * 1 + 3 * (1 - t) * t * t * 3 + power(t, 3) * 4, 9) as x, round(3 * power(1 - t, 2) * t * 2 + 3 * (1 - t) * t * t * -1 + power(t, 3) * 1, 9) as y from (select i, cast(i as double) / 100 as t from (select {range|0|100} as i) r)")
sql("camera_orbit", "select i, round((5 + sin(t)) * cos(2 * t), 6) as x, round((5 + sin(t)) * sin(2 * t), 6) as y, round(2 + 0.5 * sin(3 * t), 6) as z from (select i, cast(i as double) * 0.05 as t from (select {range|0|125} as i) r)")
sql("kinematics", "select i, round((1 + sin(8 * t)) * cos(t), 6) + 0.0e0 as x, round((1 + sin(8 * t)) * sin(t), 6) + 0.0e0 as y, round(8 * cos(8 * t) * cos(t) - (1 + sin(8 * t)) * sin(t), 6) + 0.0e0 as vx from (select i, cast(i as double) / 100 as t from (select {range|0|999} as i) r)")
PIXELS = "select x, y, cast((x * 7 + y * 13 + (x * y) % 11) % 256 as double) as l from (select {range|0|63} as x) a cross join (select {range|0|63} as y) b"
OFFSETS = "(values (-1, -1, -1, -1), (0, -1, 0, -2), (1, -1, 1, -1), (-1, 0, -2, 0), (0, 0, 0, 0), (1, 0, 2, 0), (-1, 1, -1, 1), (0, 1, 0, 2), (1, 1, 1, 1)) as o(dx, dy, wx, wy)"
sql("sobel", f"""
with p as ({PIXELS}),
n as (select p.x, p.y, least(63, greatest(0, p.x + o.dx)) as nx, least(63, greatest(0, p.y + o.dy)) as ny, o.wx, o.wy from p cross join {OFFSETS})
select n.x, n.y, cast(least(255, floor(sqrt({{sq|sum(n.wx * q.l)}} + {{sq|sum(n.wy * q.l)}}) + 0.5)) as bigint) as v from n join p q on q.x = n.nx and q.y = n.ny group by n.x, n.y""")
sql("ray_sphere", """
select i, round(min(t), 6) as depth from (
  select r.i, case when b * b - c >= 0 and -b - sqrt(greatest(b * b - c, 0)) > 0 then -b - sqrt(greatest(b * b - c, 0)) end as t from (
    select r.i, dx * -sx + dy * -sy + dz * -sz as b, sx * sx + sy * sy + sz * sz - rad * rad as c from (
      select i, dx / n as dx, dy / n as dy, 1 / n as dz from (select i, dx, dy, sqrt(dx * dx + dy * dy + 1) as n from (select i, cast(i % 32 - 16 as double) / 32 as dx, cast(floor(i / 32) - 16 as double) / 32 as dy from (select {range|0|1023} as i) r))) r
    cross join (values (0.0e0, 0.0e0, 5.0e0, 1.0e0), (1.0e0, 1.0e0, 4.0e0, 0.5e0)) as s(sx, sy, sz, rad)) r) group by i""")

# iterations of fixed length are folds in Spark, recursive queries in the oracle
sql("ode_euler", """
select n, round(s.y, 8) as y from (select n, aggregate(sequence(1, n), named_struct('x', cast(0 as double), 'y', cast(1 as double)), (s, i) -> named_struct('x', s.x + 0.01, 'y', s.y + 0.01 * (s.x - s.y))) as s from values (10), (100), (200) as t(n))""",
    """with recursive e(n, x, y) as (select 0, 0.0e0, 1.0e0 union all select n + 1, x + 0.01, y + 0.01 * (x - y) from e where n < 200) select n, round(y, 8) as y from e where n in (10, 100, 200)""")
sql("newton_1d", """
select x0, round(aggregate(sequence(1, 30), cast(x0 as double), (x, i) -> x - (x * x * x - 2 * x - 5) / (3 * x * x - 2)), 9) as root from values (2), (3), (5) as t(x0)""",
    """with recursive e(x0, n, x) as (select x0, 0, cast(x0 as double) from (values (2), (3), (5)) t(x0) union all select x0, n + 1, x - (x * x * x - 2 * x - 5) / (3 * x * x - 2) from e where n < 30) select x0, round(x, 9) as root from e where n = 30""")
sql("fixed_point_1d", "select round(aggregate(sequence(1, 60), cast(1 as double), (x, i) -> cos(x)), 9) as root", "with recursive e(n, x) as (select 0, 1.0e0 union all select n + 1, cos(x) from e where n < 60) select round(x, 9) as root from e where n = 60")
# Euclid takes fewer than 92 steps for numbers of 63 bits
sql("gcd_pairs", """
select s_suppkey, aggregate(sequence(1, 92), named_struct('a', s_suppkey + 12, 'b', s_suppkey * 3 + 18), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b))).a as g from supplier""", "select s_suppkey, gcd(s_suppkey + 12, s_suppkey * 3 + 18) as g from supplier")
STEP = "u[i] + 0.25e0 * (u[i - 1] - 2 * u[i] + u[i + 1])"
sql("heat_explicit", """
select pos as i, round(u, 8) as u from (select posexplode(aggregate(sequence(1, 50), transform(sequence(0, 20), k -> sin(pi() * k / 20)), (u, n) -> transform(u, (v, k) -> if(k = 0 or k = 20, cast(0 as double), v + 0.25 * (get(u, k - 1) - 2 * v + get(u, k + 1)))))) as (pos, u))""",
    f"""with recursive e(n, u) as (select 0, [sin(pi() * k / 20) for k in range(21)] union all select n + 1, [case when i in (1, 21) then 0.0e0 else {STEP} end for i in range(1, 22)] from e where n < 50)
select cast(unnest(range(21)) as integer) as i, round(unnest(u), 8) as u from e where n = 50""")

sql("ping_available", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
sql("dict_commands", """
select event_id, case event_type when 'signup' then case when state = 'signup' then 'Exist' else 'OK' end when 'error' then case when state = 'signup' then 'OK' else 'NoSuchWord' end else case when state = 'signup' then 'OK: found' else 'NoSuchWord' end end as answer
from (select event_id, event_type, (select 1) as one, max(case when event_type in ('signup', 'error') then concat(lpad(cast(event_id as varchar(20)), 20, '0'), event_type) end) over (partition by user_id % 50 order by event_id rows between unbounded preceding and 1 preceding) as last_change,
  substring(max(case when event_type in ('signup', 'error') then concat(lpad(cast(event_id as varchar(20)), 20, '0'), event_type) end) over (partition by user_id % 50 order by event_id rows between unbounded preceding and 1 preceding), 21) as state from events)""")


@query("select distinct term, term as stem from (select {unnest|{terms|text}} as term from documents)")
def stem_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the vocabulary; words of Latin letters are their own stems."""
    ship(spark)
    terms = table(spark, sf_dir, "documents").select(F.explode(index_terms(F.col("text"))).alias("term"))
    return stem_terms(terms)


DICTIONARY = """
select event_id, user_id % 50 as word, event_type, substring(max(case when event_type in ('signup', 'error') then concat(lpad(cast(event_id as varchar(20)), 20, '0'), event_type) end)
  over (partition by user_id % 50 order by event_id rows between unbounded preceding and 1 preceding), 21) = 'signup' as held from events"""
CACHE = """
with recursive e as (
  select user_id, cast(floor(epoch(ts)) as bigint) as at, {change} as change, row_number() over (partition by user_id order by cast(floor(epoch(ts)) as bigint), event_id) as n from events),
r(user_id, n, filled, hits, misses) as (
  select distinct user_id, cast(0 as bigint), cast(null as bigint), cast(0 as bigint), cast(0 as bigint) from events
  union all
  select r.user_id, e.n, case when e.change then null when e.at < r.filled + 21600 then r.filled else e.at end,
         r.hits + case when not e.change and coalesce(e.at < r.filled + 21600, false) then 1 else 0 end,
         r.misses + case when not e.change and not coalesce(e.at < r.filled + 21600, false) then 1 else 0 end
  from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, max(hits) as hits, max(misses) as misses from r group by user_id"""
#: Streams, and the batch queries that have the same rows.
for _name, _run, _batch in (
    ("stream_term_freq", streams.term_freq, f"select token as term, count(*) as freq from ({TOKENS}) group by token"),
    ("stream_event_windows", streams.event_windows, """
select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n from events group by 1, 2
having date_trunc('day', ts)::timestamp + interval 1 day <= (select max(ts) from events) - interval 1 hour"""),
    ("stream_dictionary", streams.dictionary, f"""
select word, string_agg(case when event_type = 'signup' then case when coalesce(held, false) then 'Exist' else 'OK' end when coalesce(held, false) then 'OK' else 'NoSuchWord' end, ',' order by event_id) as answers
from ({DICTIONARY}) group by word"""),
    ("stream_cache_hits", streams.cache_hits, CACHE.replace("{change}", "false")),
    ("stream_cache_invalidation", streams.cache_invalidation, CACHE.replace("{change}", "event_type = 'purchase'")),
    ("stream_line_routing", streams.line_routing, """
select doc_id, case when place % 2 = 1 then 'first' else 'second' end as child, translate(text, 'aeiouAEIOU', '') as line
from (select doc_id, text, row_number() over (order by doc_id) as place from documents)"""),
    ("stream_newest_events", streams.newest_events, "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 100"),
    ("state_newest_events", stateful.newest_events, "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 100"),
    ("state_cache_hits", stateful.cache_hits, CACHE.replace("{change}", "false")),
    ("state_distinct_within", stateful.distinct_within, f"""
with recursive e as (select user_id, event_type, event_id, ts, (row_number() over (order by ts, event_id) - 1) * {stateful.FILES} // count(*) over () as run from events),
marks as (select k.run, max(e.ts) - interval 2 hour as mark from (select distinct run from e) k left join e on e.run < k.run group by k.run),
firsts as (select run, user_id, event_type, arg_min(event_id, (ts, event_id)) as event_id, min(ts) as ts from e group by run, user_id, event_type),
said(run, user_id, event_type, event_id, known) as (
  select distinct cast(-1 as bigint), user_id, event_type, cast(null as bigint), cast(null as timestamp) from e
  union all
  select m.run, s.user_id, s.event_type, case when s.known is null or s.known + interval 2 hour < m.mark then f.event_id end,
         case when s.known is null or s.known + interval 2 hour < m.mark then f.ts else s.known end
  from said s join marks m on m.run = s.run + 1 left join firsts f on f.run = m.run and f.user_id = s.user_id and f.event_type = s.event_type)
select user_id, event_type, event_id, cast(run as integer) as run from said where event_id is not null"""),
    ("stream_frontier", streams.frontier, "select distinct url from pages"),
    ("stream_distinct_within", streams.distinct_within, "select distinct user_id, event_type from events"),
):
    QUERIES[_name], ORACLES[_name] = _run, _render(_batch, 1)
