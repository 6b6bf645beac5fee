"""Article catalogue and store: joins, distinct aggregates, clean-up, upserts, batch transactions, event ETL.

The catalogue's tables are read from the driver's: orders are articles, suppliers authors, parts keywords, customers users; the
bridges are line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trigram_index
from ..session import table
from .registry import query, sql

AUTHORS = "select l_orderkey as article, {list_set|s_name} as authors from lineitem join supplier on l_suppkey = s_suppkey group by l_orderkey"
KEYWORDS = "select l_orderkey as article, {list_set|p_type} as keywords from lineitem join part on l_partkey = p_partkey group by l_orderkey"
LISTING = f"""
select o.o_orderkey as article, o.o_orderpriority as title, o.o_orderdate as published, c.c_name as uploaded_by,
       coalesce(a.authors, '') as authors, coalesce(k.keywords, '') as keywords
from orders o left join customer c on o.o_custkey = c.c_custkey left join ({AUTHORS}) a on a.article = o.o_orderkey left join ({KEYWORDS}) k on k.article = o.o_orderkey"""
sql("articles_listing", LISTING)
sql("article_by_id", f"select * from ({LISTING}) where article = 7")
sql("authors_contains", f"select article, authors from ({LISTING}) where {{matches|authors|'(?i)supplier#0+3'}}")
sql("user_favorites", "select c_custkey as user_id, o_orderkey as article from customer left join orders on c_custkey = o_custkey where o_custkey = 11")
sql("is_favorite", "select c_custkey as user_id from customer c where exists (select 1 from orders where o_custkey = c.c_custkey and o_orderstatus = 'F')")
sql("orphan_authors", "select c_custkey as author from customer c where not exists (select 1 from orders where o_custkey = c.c_custkey)")
sql("title_contains_ci", "select p_partkey, p_name from part where coalesce({matches|p_type|'(?i)promo'}, false)")
sql("lookup_by_key", "select c_custkey, c_name, c_acctbal from customer where c_name = 'Customer#000000042' or c_custkey = 7")
sql("validate_rows", """
select page_id, {matches|url|'^https://'} and url is not null and {matches|html|'<title>[^< ]+ +[^< ]+'} as valid from pages""")
sql("split_name", "select c_custkey, {at|{split|c_name|'#'}|1} as first_name, coalesce({at|{split|c_name|'#'}|2}, '') as last_name from customer")
sql("split_csv_list", "select p_partkey, trim(part) as word from (select p_partkey, {unnest|{split|p_type|'[ ,]'}} as part from part) where trim(part) <> ''")
sql("category_leaf", "select url, coalesce(nullif({extract|url|'([^./]*)$'|1}, ''), 'uncategorized') as leaf from (select distinct url from pages)")
sql("needs_hash", "select c_custkey, not (p like '$2b$%') as needs_hash from (select c_custkey, case when c_custkey % 3 = 0 then concat('$2b$12$', md5(c_name)) else c_name end as p from customer)", "select c_custkey, c_custkey % 3 <> 0 as needs_hash from customer")
sql("delete_user_cascade", """
select o_orderkey as article, case when o_custkey = 11 then null else o_custkey end as uploaded_by from orders
where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_suppkey = 3 and o_custkey = 11)""")
sql("insert_ignore_conflict", """
select c_custkey, c_name from customer
union all
select k, name from (select c_custkey + 10 as k, c_name as name from customer) n where not exists (select 1 from customer c where c.c_custkey = n.k)""")
sql("notify_last_n", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 100")
sql("notify_unread", "select user_id, count(*) as unread, max(event_id) as newest from events where event_type <> 'view' group by user_id")
# a token is issued by an event, lasts an hour, and is looked at when the last event comes
sql("token_valid", "select event_id, {epoch|ts} + 3600 > (select max({epoch|ts}) from events) as valid from events")

# the store
sql("price_range", "select count(*) as n from part where p_retailprice between 950 and 1200")
sql("date_range", "select count(*) as n from orders where o_orderdate >= timestamp '1995-01-01 00:00:00' and o_orderdate < timestamp '1996-01-01 00:00:00'")
sql("full_text_search", "select doc_id from documents where {matches|lower(text)|{re|\\bthe\\b}} and {matches|lower(text)|{re|\\bwith\\b}}")
sql("limit_after_filter", "select o_orderkey from orders where o_totalprice > 100000 order by o_orderkey limit 100")
sql("filter_after_limit", "select o_orderkey from (select o_orderkey, o_totalprice from orders order by o_orderkey limit 100) where o_totalprice > 100000")
sql("products_load", "select p_partkey, p_retailprice, m.brand_id from part join (select p_brand as brand, cast(row_number() over (order by p_brand) as bigint) as brand_id from (select distinct p_brand from part)) m on p_brand = m.brand")
sql("first_per_key", "select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as n from lineitem) where n = 1")
sql("event_etl", """
select event_id, user_id, ts as order_date, case event_type when 'purchase' then 'completed' when 'click' then 'pending' else 'cancelled' end as status
from events where event_type <> 'view' and user_id is not null""")
sql("fill_users", "select top + i as user_id, i % 5 as profile from (select {range|1|500} as i) r cross join (select max(c_custkey) as top from customer) m")
sql("transfer_funds", """
select c_custkey, round(c_acctbal + coalesce(d.amount, 0), 2) as balance from customer left join (
  select k, sum(amount) as amount from (
    select o_custkey as k, -1.0 * round(o_totalprice / 1000) as amount from orders union all select o_custkey % 10 + 1, round(o_totalprice / 1000) from orders) group by k) d on d.k = c_custkey""")
sql("restock", "select p_partkey, p_size + case when p_size < 10 then 50 else 0 end as stock from part")
sql("random_sample_md5", "select p_partkey from part order by md5(cast(p_partkey as {string})), p_partkey limit 20".replace("{string}", "varchar(20)"))
sql("sort_values", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice, l_orderkey, l_linenumber")
sql("bucketize", "select p_partkey, case when p_size < 18 then 'low' when p_size < 25 then 'normal' when p_size < 30 then 'high' else 'top' end as bucket from part")
sql("parse_ts", """
select i, cast(coalesce(try_to_timestamp(s, 'yyyy-MM-dd HH:mm:ss z'), try_to_timestamp(s, 'yyyy-MM-dd HH:mm:ss'), try_to_timestamp(s, 'yyyy-MM-dd HH:mm'), try_to_timestamp(s, 'yyyy-MM-dd')) as timestamp_ntz) as parsed
from values (1, '2019-11-05 10:20:30'), (2, '2019-11-05 10:20'), (3, '2019-11-05'), (4, 'never'), (5, '2019-11-05 10:20:30 UTC'), (6, null), (7, '2019-13-05') as t(i, s)""",
    """select * from (values (1, timestamp '2019-11-05 10:20:30'), (2, timestamp '2019-11-05 10:20:00'), (3, timestamp '2019-11-05 00:00:00'), (4, null), (5, timestamp '2019-11-05 10:20:30'), (6, null), (7, null)) as t(i, parsed)""")
sql("encrypt_roundtrip", """
select c_custkey, cast(aes_decrypt(sealed, unhex(md5('key'))) as string) as c_name, try_aes_decrypt(sealed, unhex(md5('other'))) is null as kept_from_others, sealed <> cast(c_name as binary) as hidden
from (select c_custkey, c_name, aes_encrypt(c_name, unhex(md5('key'))) as sealed from customer)""", "select c_custkey, c_name, true as kept_from_others, true as hidden from customer")

TRIGRAMS = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower($1), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query(
    f"""select p_partkey, p_name, score from (
  select p_partkey, p_name, round(len(list_intersect(a, b)) / cast(len(list_distinct(list_concat(a, b))) as double), 6) as score
  from (select p_partkey, p_name, {TRIGRAMS.replace("$1", "p_name")} as a, {TRIGRAMS.replace("$1", "'small widgit'")} as b from part)) where score > 0.05 order by score desc, p_partkey limit 50"""
)
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names most like a text by trigrams."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    found = trigram_index.look_up(trigram_index.index(parts, "p_partkey", "p_name"), "small widgit", 0.05, 50)
    return found.join(parts, F.col("id") == F.col("p_partkey")).select("p_partkey", "p_name", "score")


@query(f"""with n as (select min(p_partkey) as id, {TRIGRAMS.replace("$1", "p_name")} as g from part where p_name is not null group by p_name)
select a, b, round(common / (la + lb - common), 6) as score
from (select x.id as a, y.id as b, len(list_intersect(x.g, y.g)) as common, len(x.g) as la, len(y.g) as lb from n x join n y on x.id < y.id) where common / (la + lb - common) >= 0.4""")
def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different names of parts that are alike by trigrams, each name by its first part."""
    return trigram_index.join(table(spark, sf_dir, "part"), "p_partkey", "p_name", 0.4)[0]


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(
    """select user_id, min(ts) as start, count(*) as n from (
  select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (
    select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as fresh from events)) group by user_id, s"""
)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, ended by half an hour without events."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
