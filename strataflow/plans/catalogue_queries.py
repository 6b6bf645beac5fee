"""Links, articles, edits, accounts and tokens over whole tables: column functions and joins held against SQL of another make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links, tokens
from ..operators import catalogue
from ..session import spread, table, views
from .registry import query, sql

# References are written in four ways by the page's number: from the root, from the page's folder, from the folder above, with a host.
HREFS = "select page_id, url, substr(h, 2) as word from (select page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as h from pages) where h like '/%'"
SITE, FOLDERS = "example.net", ["/de", "/th", "/en"]
LINKS = f"""
select page_id, case page_id % 4 when 0 then concat(origin, '/', word) when 1 then concat(origin, folder, word) when 2 then concat(origin, regexp_replace(folder, '[^/]+/$', ''), word)
  else concat(regexp_extract(url, '^([a-z]+:)', 1), '//www.{SITE}/', word) end as link
from (select page_id, url, word, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*/)', 1) as folder from ({HREFS}))"""
FOLLOWED = f"""select page_id, link from ({LINKS}) where regexp_extract(link, '//([^/]*)', 1) like '%{SITE}%' and regexp_matches(regexp_extract(link, '//[^/]*([^?#]*)', 1), '{"|".join(FOLDERS)}')"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(links.references(F.col("html"))).alias("quoted"))
    pages = pages.select("page_id", "url", links.unquoted(F.col("quoted")).alias("href")).where("href like '/%'")
    word, way = F.substring("href", F.lit(2), F.length("href")), F.col("page_id") % 4
    href = F.when(way == 0, F.col("href")).when(way == 1, word).when(way == 2, F.concat(F.lit("../"), word)).otherwise(F.concat(F.lit(f"//www.{SITE}/./a/../"), word))
    return pages.select("page_id", links.resolve(F.col("url"), href).alias("link"))


@query(f"select page_id, link, count(*) as n from ({LINKS}) group by page_id, link")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page as absolute URLs."""
    return _links(spark, sf_dir).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(f"select link, count(distinct page_id) as n_pages, min(page_id) as first_page from ({FOLLOWED}) group by link")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that a crawl of a site follows by host and folder, each with the pages that hold it."""
    followed = _links(spark, sf_dir).where(links.follows(F.lit(SITE), F.col("link"), FOLDERS))
    return followed.groupBy("link").agg(F.count_distinct("page_id").alias("n_pages"), F.min("page_id").alias("first_page"))


# One page in five lacks its heading, one its title too, one holds its text in another element, one has none.
MARKED = """select page_id, case page_id % 5 when 1 then replace(html, 'h1>', 'h2>') when 2 then replace(replace(html, 'h1>', 'h2>'), 'title>', 'b>')
  when 3 then replace(replace(html, '<article>', '<div class="content">'), '</article>', '</div>') when 4 then replace(html, 'article>', 'main>') else html end as html from pages"""


def _inner(html, tag: str):
    return F.regexp_extract(html, f"(?is)<{tag}>(.*?)</{tag.split()[0]}>", 1)


def _bare(html):
    """Text without tags, scripts and runs of blanks."""
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>|<[^>]+>", " "), r"[ \t\r\n]+", " ")
    return F.trim(text)


def parse_article(rows: DataFrame, key: str) -> DataFrame:
    """Articles of pages (html): title from the heading, else the title, else `untitled`; author and time from their elements, else
    `unknown`; body from the first container that holds text. Pages without a body, null ones among them, are left out."""
    html = F.col("html")
    some = lambda *found: F.coalesce(*[F.nullif(_bare(x), F.lit("")) for x in found])
    author = some(F.regexp_extract(html, r'(?is)<a[^>]*class="[^"]*author[^"]*"[^>]*>(.*?)</a>', 1), F.regexp_extract(html, r'(?is)<meta name="author" content="([^"]*)"', 1))
    published = some(F.regexp_extract(html, r'(?is)<time[^>]*datetime="([^"]*)"', 1))
    return rows.select(
        key,
        F.coalesce(some(_inner(html, "h1"), _inner(html, "title")), F.lit("untitled")).alias("title"),
        F.coalesce(author, F.lit("unknown")).alias("author"), F.coalesce(published, F.lit("unknown")).alias("published"),
        some(_inner(html, "article"), _inner(html, 'div class="content"')).alias("body"),
    ).where("body is not null")


DUCK_BARE = r"trim(regexp_replace(regexp_replace($, '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"
DUCK_BODY = DUCK_BARE.replace("$", "regexp_extract(html, '(?is)<article>(.*?)</article>', 1)")


@query(f"""select page_id, case when page_id % 5 = 2 then 'untitled' else coalesce(nullif({DUCK_BARE.replace("$", "case when page_id % 5 = 1 then regexp_extract(html, '(?is)<title>(.*?)</title>', 1) else regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1) end")}, ''), 'untitled') end as title,
'unknown' as author, 'unknown' as published, md5({DUCK_BODY}) as digest from pages where page_id % 5 <> 4 and {DUCK_BODY} <> ''""")
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of all pages, some of which lack one part or another."""
    views(spark, sf_dir, "pages")
    return parse_article(spark.sql(MARKED), "page_id").select("page_id", "title", "author", "published", F.md5(F.col("body").cast("binary")).alias("digest"))


# Orders are articles, customers their authors, names of parts sold in bulk their keywords. Filled orders are dropped; every third pending
# one gets its customer and a supplier as authors, and a keyword in capitals; orders of key 0 modulo 11 are uploaded anew.
NAMES = {"author": "select c_custkey as id, c_name as name from customer", "keyword": "select p_partkey as id, concat(p_name, ' ', p_partkey) as name from part"}
BRIDGES = {"author": "select o_orderkey as article, o_custkey as id from orders", "keyword": "select distinct l_orderkey as article, l_partkey as id from lineitem where l_quantity = 50"}
DROPPED = "select o_orderkey as article from orders where o_orderstatus <> 'P'"
PENDING = "select o_orderkey as article, o_custkey from orders where o_orderstatus = 'P' and o_orderkey % 3 = 0"
UPLOADED = "select o_orderkey + 1000000000 as article, o_custkey from orders where o_orderkey % 11 = 0"
ASKED = {
    "author": f"""select article, c_name as name from (({PENDING}) union all ({UPLOADED})) join customer on c_custkey = o_custkey
      union all select article, s_name from ({PENDING}) join lineitem on l_orderkey = article join supplier on s_suppkey = l_suppkey""",
    "keyword": f"select article, upper(p_name) as name from ({PENDING}) join lineitem on l_orderkey = article join part on p_partkey = l_partkey",
}
EDITED = " union all ".join(
    f"""(with names as ({NAMES[k]}), bridge as ({BRIDGES[k]}), dropped as ({DROPPED}), asked as (select distinct article, name from ({ASKED[k]}) where article not in (select article from dropped)),
fresh as (select distinct name from asked where name not in (select name from names)),
known as (select id, name from names union all select (select max(id) from names) + row_number() over (order by name), name from fresh),
whole as (select article, id from bridge where article not in (select article from asked) and article not in (select article from dropped)
  union select a.article, k.id from asked a join (select name, min(id) as id from known group by name) k on a.name = k.name)
select '{k}' as kind, id, name, cast(null as bigint) as article from known where id in (select id from whole)
union all select '{k} of', id, null, article from whole)"""
    for k in NAMES
)


@query(EDITED)
def catalogue_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's names and bridges after articles were uploaded, edited and dropped, without names that no article has."""
    used = ("customer", "part", "orders", "lineitem", "supplier")
    spread(spark, sf_dir, *used)
    views(spark, sf_dir, *used)
    out = []
    for kind in NAMES:
        names, bridge = catalogue.edit(spark.sql(NAMES[kind]), spark.sql(BRIDGES[kind]), spark.sql(ASKED[kind]), spark.sql(DROPPED))
        out.append(names.select(F.lit(kind).alias("kind"), "id", "name", F.lit(None).cast("long").alias("article")))
        out.append(bridge.select(F.lit(f"{kind} of").alias("kind"), "id", F.lit(None).cast("string").alias("name"), "article"))
    return out[0].union(out[1]).union(out[2]).union(out[3])


# A click of a user likes the order of its number; accounts in debt are removed.
LIKED = "select distinct user_id as user, event_id as article from events where event_type = 'click'"
DEBTORS = "select c_custkey from customer where c_acctbal < 1000"


@query(f"""select 'user' as kind, c_custkey as id, cast(null as bigint) as other from customer where c_custkey not in ({DEBTORS})
union all select 'article', o_orderkey, case when o_custkey not in ({DEBTORS}) then o_custkey end from orders
union all select 'favorite', "user", article from ({LIKED.replace("as user", 'as "user"')}) where "user" not in ({DEBTORS})""")
def accounts_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts, articles and favorites once some accounts are gone."""
    views(spark, sf_dir, "customer", "orders", "events")
    users, articles, favorites = catalogue.remove_accounts(
        spark.sql("select c_custkey as user from customer"), spark.sql("select o_orderkey as article, o_custkey as uploaded_by from orders"),
        spark.sql(LIKED), spark.sql(DEBTORS).select(F.col("c_custkey").alias("user")),
    )
    rows = users.select(F.lit("user").alias("kind"), F.col("user").alias("id"), F.lit(None).cast("long").alias("other"))
    return rows.union(articles.select(F.lit("article"), "article", "uploaded_by")).union(favorites.select(F.lit("favorite"), "user", "article"))


sql("suppliers_without_returns", """
select s_suppkey, s_name from supplier s where not exists (
  select 1 from lineitem join orders on l_orderkey = o_orderkey where l_suppkey = s.s_suppkey and o_orderstatus = 'P' and l_returnflag = 'R' and l_quantity = 50)""")
sql("shared_folders", """
select folder, count(*) as n, min(page_id) as first_page from (
  select page_id, {replace_all|{replace_all|url|'[?#].*'|''}|'[^/]*$'|''} as folder from pages) group by folder having count(*) > 1""")


@query("""select o_orderkey, o_orderkey % 4 <> 0 and o_orderkey % 7 <> 0 and names is not null and o_orderkey % 9 <> 0 as valid
from orders left join (select l_orderkey, count(p_name) as names from lineitem join part on l_partkey = p_partkey group by 1) on l_orderkey = o_orderkey""")
def valid_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an article may be uploaded: an https link, a title, and authors of two words at least. Some lack one of these."""
    views(spark, sf_dir, "orders", "lineitem", "part")
    rows = spark.sql("""
      select o_orderkey, concat(if(o_orderkey % 4 = 0, 'http', 'https'), '://example.org/', o_orderkey) as link, if(o_orderkey % 7 = 0, null, o_orderpriority) as title,
             concat(array_join(names, ', '), if(o_orderkey % 9 = 0, ', solo', '')) as authors
      from orders left join (select l_orderkey, sort_array(collect_set(p_name)) as names from lineitem join part on l_partkey = p_partkey group by l_orderkey) on l_orderkey = o_orderkey""")
    whole = F.forall(F.split("authors", ","), lambda a: F.size(F.split(F.trim(a), r"\s+")) >= 2)
    return rows.select("o_orderkey", F.coalesce(F.col("link").startswith("https://") & F.col("title").isNotNull() & whole, F.lit(False)).alias("valid"))


#: The keys that the query signs with; a deployment reads its own from its secrets.
KEY, OTHER = b"strataflow", b"another key, " * 8
# every fifth token is signed with another key, every seventh changed afterwards; each holds for an hour, looked at half a day later
BODY = """'{"user":' || user_id || ',"exp":' || (cast(floor(epoch(ts)) as bigint) + 3600) || '}'"""


def _duck_token(key: bytes) -> str:
    inner, outer = (p.hex() for p in tokens._pads(key))
    return f"to_base64(unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(signed))))))"


@query(f"""select event_id, signed || '.' || translate(case when event_id % 5 = 0 then {_duck_token(OTHER)} else {_duck_token(KEY)} end, '+/=', '-_') as token,
  case when event_id % 5 = 0 or event_id % 7 = 0 then 'refused' when cast(floor(epoch(ts)) as bigint) + 3600 <= noon then 'expired' else 'valid' end as state,
  case when event_id % 5 <> 0 and event_id % 7 <> 0 then user_id end as user_id
from (select event_id, user_id, ts, noon, translate(to_base64(encode('{tokens.HEADER}')) || '.' || to_base64(encode({BODY})), '+/=', '-_') as signed
  from events cross join (select cast(floor((epoch(min(ts)) + epoch(max(ts))) / 2) as bigint) as noon from events) where user_id is not null)""")
def token_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed tokens of the events' users, and what a check half-way through the events says of each."""
    views(spark, sf_dir, "events")
    rows = spark.sql("select event_id, user_id, unix_timestamp(cast(ts as timestamp)) as at from events where user_id is not null")
    low, high = spark.sql("select unix_micros(cast(min(ts) as timestamp)), unix_micros(cast(max(ts) as timestamp)) from events").first()
    now = ((low or 0) + (high or 0)) // 2_000_000
    claims = F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"exp":'), (F.col("at") + 3600).cast("string"), F.lit("}"))
    signed = rows.select("event_id", F.when(F.col("event_id") % 5 == 0, tokens.issue(claims, OTHER)).otherwise(tokens.issue(claims, KEY)).alias("token"))
    # one who changes the claims can't sign them anew
    forged = F.when(F.col("event_id") % 7 == 0, F.regexp_replace("token", r"\.[^.]*\.", "." + _forged() + ".")).otherwise(F.col("token"))
    user = F.get_json_object(tokens.claims(forged, KEY), "$.user").cast("long").alias("user_id")
    return signed.select("event_id", "token", tokens.state(forged, KEY, F.lit(now)).alias("state"), user)


def _forged() -> str:
    import base64

    return base64.urlsafe_b64encode(b'{"user":0,"exp":9999999999}').decode().rstrip("=")
