"""Graphs made from tables, a store that loads change, and a database: queries on operators that keep state of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, ranking
from ..session import spread, table, views
from ..sources import databases, files, seeds
from ..sources.store import BucketStore
from .registry import query

# an order waits for its customer's order before; every fortieth also for the one before among those of its day
JOBS = """
select o_orderkey as needs, job from (select o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as job from orders) where job is not null
union select o_orderkey, job from (select o_orderkey, lead(o_orderkey) over (partition by o_orderdate order by o_orderkey) as job from orders where o_orderkey % 40 = 0) where job is not null"""
LEVELS = f"""with recursive e as ({JOBS}), l(job, depth) as (
  select needs, 0 from e where needs not in (select job from e) union select e.job, l.depth + 1 from l join e on e.needs = l.job),
d as (select job, cast(max(depth) as bigint) as depth from l group by job)"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return graphs.levels(spark.sql(JOBS), "needs", "job").select(F.col("node").alias("job"), F.col("level").alias("depth"))


@query(f"{LEVELS} select job, depth from d")
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs stand before each on the longest way to it."""
    return _levels(spark, sf_dir)


@query(f"{LEVELS} select job, row_number() over (order by depth, job) as place from d")
def dag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in an order in which each comes after all that it needs."""
    return ranking.ranked(_levels(spark, sf_dir), F.col("depth"), F.col("job")).select("job", "place")


@query(f"""with e as ({JOBS}), n as (select needs as job from e union select job from e)
select job, case when job not in (select job from e) then 'start' else 'end' end as kind from n where job not in (select job from e) or job not in (select needs from e)""")
def dag_sources_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that need none, and jobs that none needs."""
    spread(spark, sf_dir, "orders", size=8 << 20)
    views(spark, sf_dir, "orders")
    edges = ranking.staged(spark.sql(JOBS), "jobs")
    first = edges.select(F.col("needs").alias("job")).distinct().join(edges.select("job"), "job", "left_anti")
    last = edges.select("job").distinct().join(edges.select(F.col("needs").alias("job")), "job", "left_anti")
    return first.withColumn("kind", F.lit("start")).union(last.withColumn("kind", F.lit("end")))


@query(f"""with recursive e as ({JOBS}), back as (select job as needs, needs as job from e where needs % 250 = 0), f as (select * from e union select * from back),
r(job) as (select job from back union select f.job from r join f on f.needs = r.job)
select job from r""")
def dag_has_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that can't run, as they are on a cycle or wait for one, once every 250th order waits for the jobs after it as well."""
    views(spark, sf_dir, "orders")
    edges = spark.sql(JOBS)
    back = edges.where("needs % 250 = 0").select(F.col("job").alias("needs"), F.col("needs").alias("job"))
    return graphs.levels(edges.union(back), "needs", "job").where("level is null").select(F.col("node").alias("job"))


SOLD = "select distinct concat('s', l_suppkey) as a, concat('p', l_partkey) as b from lineitem where l_quantity = 50 and l_returnflag = 'R'"


@query(f"""with recursive e as ({SOLD}), both_ways as (select a, b from e union select b, a from e),
r(node, reached) as (select a, a from both_ways union select r.node, x.b from r join both_ways x on x.a = r.reached)
select node, min(reached) as component from r group by node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts that large returned lines connect, with the least name among those that each is connected with."""
    views(spark, sf_dir, "lineitem")
    return graphs.components(spark.sql(SOLD), "a", "b")


#: Loads of pages, one after another: each leaves out a third, and changes a fifth.
LOADS = 3


def _load(pages: DataFrame, i: int) -> DataFrame:
    # a null page is an empty one, as the SQL has it
    html = F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 5 == i, "!").otherwise(""))
    return pages.where(F.col("page_id") % 3 != i).select("url", "page_id", html.alias("html"), F.lit(i).alias("loaded"))


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[BucketStore, list[dict]]:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    store = BucketStore(spark, files.scratch_path(spark, "store"), _load(pages, 0).schema, "url", ["html"], 16)
    return store, [store.upsert(_load(pages, i), "loaded", "page_id") for i in range(LOADS)]


CRAWLED = " union all ".join(f"select url, page_id, concat(html, case when page_id % 5 = {i} then '!' else '' end) as html, {i} as loaded from pages where page_id % 3 <> {i} and url is not null" for i in range(LOADS))
TOLD = f"""with c as ({CRAWLED}), k as (select *, lag(html) over (partition by url order by loaded) as old, row_number() over (partition by url order by loaded) as n from c),
t as (select *, case when n = 1 then 'new' when html = old then 'same' else 'updated' end as kind from k)"""


@query(f"{TOLD} select url, arg_max(page_id, loaded) as page_id, arg_max(md5(html), loaded) as digest, cast(max(case when kind <> 'same' then loaded end) as integer) as loaded from t group by url")
def store_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as three loads leave them in a stored table: the last content, and the load that last changed it."""
    store, _ = _loaded(spark, sf_dir)
    return store.rows().select("url", "page_id", F.md5(F.col("html").cast("binary")).alias("digest"), "loaded")


@query(f"{TOLD} select cast(loaded as integer) as loaded, kind, count(*) as n from t group by loaded, kind")
def store_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages each load found new, updated and same."""
    _, told = _loaded(spark, sf_dir)
    return spark.createDataFrame([(i, kind, n) for i, t in enumerate(told) for kind, n in t.items() if n], "loaded int, kind string, n long")


#: Name of the setting that holds the url of a database for the query below; without it, a local session uses one embedded in its JVM, and
#: a cluster databases in files of its shared folder, since its executors share no database of a JVM.
JDBC_URL = "spark.strataflow.jdbc.url"


@query("select c_custkey, c_name, c_nationkey, c_acctbal from customer where c_custkey > 40 and c_custkey <= 900")
def jdbc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written to a database in batches and read back in ranges of their key, filtered there."""
    url = spark.conf.get(JDBC_URL, None)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    if url is None:
        if not spark.sparkContext.master.startswith("local["):
            folder = files.scratch_path(spark, "databases")
            found = databases.write(rows, folder, "customer", "c_custkey")
            return databases.read(spark, folder, found, "customer", rows.schema, "c_custkey > 40 and c_custkey <= 900")
        url = f"jdbc:derby:memory:strataflow{uuid.uuid4().hex};create=true"
    seeds.write_jdbc(rows, url, "customer", parts=4)
    low, high = rows.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    back = seeds.read_jdbc(spark, url, "customer", key="c_custkey", bounds=(low or 0, high or 0), parts=4)
    return back.where("c_custkey > 40 and c_custkey <= 900")
