"""Life cycles of articles, accounts, notifications and orders; parsing, loading and diagnostics. Small fixtures stand where the
driver's tables have nothing for an operator to do; their oracles state the rows that must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem_en import stem_words
from ..functions.stem_ru import stem_terms
from ..operators import ranking, reservations
from ..session import ship, table
from ..sources import files, seeds
from .registry import query, sql
from .text_queries import TERMS

CATALOGUE = """
articles(article, title, uploaded_by) as (values (1, 'Sparse sets', 1), (2, 'Wide joins', 1), (3, 'Old news', 2)),
authors(author, name) as (values (1, 'Ann Lee'), (2, 'Bob Ray'), (3, 'Cy Poe'), (4, 'Di Moor')),
article_authors(article, author) as (values (1, 1), (1, 2), (2, 3), (2, 4), (3, 1)),
keywords(keyword, word) as (values (1, 'sets'), (2, 'joins'), (3, 'news')),
article_keywords(article, keyword) as (values (1, 1), (2, 2), (3, 3), (2, 1)),
favorites(person, article) as (values (1, 1), (1, 2), (2, 3), (2, 1)),
users(person, email) as (values (1, 'a@x.org'), (2, 'b@x.org'), (3, 'c@x.org'))"""
# article 4 is inserted, article 2 is given other authors and keywords, article 3 is deleted; then authors and keywords of no article go
EDITS = f"""with {CATALOGUE},
asked(article, name) as (values (4, 'Ann Lee'), (4, 'Eve Fox'), (2, 'Eve Fox'), (2, 'Bob Ray')),
asked_words(article, word) as (values (4, 'sets'), (4, 'trees'), (2, 'trees')),
new_authors as (select distinct name from asked where name not in (select name from authors)),
all_authors as (select author, name from authors union all select (select max(author) from authors) + (select count(*) from new_authors m where m.name <= n.name), name from new_authors n),
new_words as (select distinct word from asked_words where word not in (select word from keywords)),
all_words as (select keyword, word from keywords union all select (select max(keyword) from keywords) + (select count(*) from new_words m where m.word <= n.word), word from new_words n),
kept_articles as (select article, title from articles where article <> 3 union all select 4, 'Tall trees'),
bridge as (select article, author from article_authors where article not in (2, 3) union all select a.article, b.author from asked a join all_authors b on a.name = b.name),
word_bridge as (select article, keyword from article_keywords where article not in (2, 3) union all select a.article, b.keyword from asked_words a join all_words b on a.word = b.word)
select 'article' as kind, article as id, title as name from kept_articles
union all select 'author', author, name from all_authors where author in (select author from bridge)
union all select 'keyword', keyword, word from all_words where keyword in (select keyword from word_bridge)
union all select 'written', article, cast(author as varchar(9)) from bridge
union all select 'tagged', article, cast(keyword as varchar(9)) from word_bridge"""
sql("article_lifecycle", EDITS, """select * from (values ('article', 1, 'Sparse sets'), ('article', 2, 'Wide joins'), ('article', 4, 'Tall trees'),
('author', 1, 'Ann Lee'), ('author', 2, 'Bob Ray'), ('author', 5, 'Eve Fox'), ('keyword', 1, 'sets'), ('keyword', 4, 'trees'),
('written', 1, '1'), ('written', 1, '2'), ('written', 4, '1'), ('written', 4, '5'), ('written', 2, '5'), ('written', 2, '2'),
('tagged', 1, '1'), ('tagged', 4, '1'), ('tagged', 4, '4'), ('tagged', 2, '4')) as t(kind, id, name)""")
sql("account_delete", f"""with {CATALOGUE}
select 'article' as kind, article as id, case when uploaded_by = 1 then null else uploaded_by end as other from articles
union all select 'favorite', article, person from favorites where person <> 1
union all select 'user', person, null from users where person <> 1""",
    "select * from (values ('article', 1, null), ('article', 2, null), ('article', 3, 2), ('favorite', 3, 2), ('favorite', 1, 2), ('user', 2, null), ('user', 3, null)) as t(kind, id, other)")
sql("orphan_cleanup", f"with {CATALOGUE} select author, name from authors a where not exists (select 1 from article_authors b where b.author = a.author and b.article <> 2)",
    "select * from (values (3, 'Cy Poe'), (4, 'Di Moor')) as t(author, name)")
sql("duplicate_links", "select link, count(*) as n from (values ('https://a/1'), ('https://a/2'), ('https://a/1')) as t(link) group by link having count(*) > 1", "select 'https://a/1' as link, 2 as n")

# an event is a notification, read if its user has signed up since; the newest of each user is marked by its time
sql("notify_read_state", """
select e.event_id, e.user_id, s.at is not null and e.ts <= s.at or e.ts = m.newest as is_read from events e
left join (select user_id, max(ts) as at from events where event_type = 'signup' group by user_id) s on s.user_id = e.user_id
join (select user_id, max(ts) as newest from events group by user_id) m on m.user_id = e.user_id""")
sql("notify_unread_list", """
select user_id, event_id, cast(place as bigint) as place from (
  select e.user_id, e.event_id, row_number() over (partition by e.user_id order by e.ts desc, e.event_id desc) as place
  from events e left join (select user_id, max(ts) as at from events where event_type = 'signup' group by user_id) s on s.user_id = e.user_id
  where s.at is null or e.ts > s.at) where place <= 100""")

sql("user_list", "select c_custkey as user_id, c_name as name, concat(lower(replace(c_name, '#', '.')), '@example.com') as email, c_mktsegment as role from customer")
sql("drop_null_targets", "select d.doc_id, l.quality from documents d left join labels l on l.doc_id = d.doc_id where l.quality is not null")
sql("synthetic_users", """
select i as user_id, concat({at|a|1 + i % 5}, ' ', {at|b|1 + i % 7}) as name, concat(substring(md5(cast(i as varchar(20))), 1, 12), '@example.com') as email
from (select {range|1|2000} as i) r cross join (select split('Ann Bob Cy Di Eve', ' ') as a, split('Lee Ray Poe Fox Moor Hale Quin', ' ') as b) n""")
sql("product_attributes", """
select p_partkey, greatest(100, least(50000, cast(floor(100 * power(2, 3 + 0.8 * sqrt(-2 * ln(u)) * cos(2 * pi() * v))) as bigint))) as price,
       case when v < 0.8 then cast(floor(u * 1000) as bigint) else 1000 + cast(floor(u * 9000) as bigint) end as stock,
       case when w < 0.4 then 12 when w < 0.8 then 24 when w < 0.9 then 6 when w < 0.95 then 36 else 60 end as warranty
from (select p_partkey, (p_partkey * 7919 % 99991 + 1) / 99992.0e0 as u, (p_partkey * 104729 % 99989) / 99989.0e0 as v, (p_partkey * 15485863 % 99971) / 99971.0e0 as w from part)""")
sql("store_diagnostics", """
select 'documents' as name, count(*) as n, min(doc_id) as first_key, max(doc_id) as last_key, cast(sum({bytes|text}) as bigint) as bytes from documents
union all select 'pages', count(*), min(page_id), max(page_id), cast(sum({bytes|html}) as bigint) from pages""")
sql("index_bucket_load", f"""
select round(100.0e0 * count(*) / 65536, 6) as load_percent, max(n) as longest_chain, sum(n) as terms
from (select bucket, count(*) as n from (select distinct term, substring(md5(term), 1, 4) as bucket from ({TERMS})) group by bucket)""")
sql("password_check", """
select c_custkey, {sha|concat(salt, given)} = stored as ok from (
  select c_custkey, salt, {sha|concat(salt, c_name)} as stored, case when c_custkey % 4 = 0 then concat(c_name, 'x') else c_name end as given
  from (select c_custkey, c_name, substring(md5(cast(c_custkey as varchar(20))), 1, 16) as salt from customer))""",
    "select c_custkey, c_custkey % 4 <> 0 as ok from customer")

LINK_PAGES = """(values (1, 'https://news.example.org/2025/', '<a href="/articles/17/">a</a> <a href="https://sub.news.example.org/news/9">b</a> <a href="https://else.org/articles/1">c</a> <a href="/about">d</a>'),
(2, 'https://habit.example.com/x/y', '<a class=q href="/ru/articles/5/#top">e</a><a href="//habit.example.com/news/7?p=1">f</a><a href="mailto:z@q.org">g</a>'), (3, null, '<a href="/news/1">'), (4, 'https://a.org', null)) as p(page_id, url, html)"""
sql("follow_links", f"""
select page_id, link from (
  select page_id, host, case when {{matches|href|'^[A-Za-z][A-Za-z0-9+.-]*:'}} then href when href like '//%' then concat('https:', href) else concat('https://', host, href) end as link
  from (select page_id, {{extract|url|'^https?://([^/?#]*)'|1}} as host, {{unnest|{{extract_all|html|'href="([^"]*)"'|1}}}} as href from {LINK_PAGES} where url is not null and html is not null))
where {{extract|link|'^https?://([^/?#]*)'|1}} like concat('%', host, '%') and ({{matches|link|'^https?://[^?#]*/articles/'}} or {{matches|link|'^https?://[^?#]*/news/'}})""",
    """select * from (values (1, 'https://news.example.org/articles/17/'), (1, 'https://sub.news.example.org/news/9'), (2, 'https://habit.example.com/ru/articles/5/#top'), (2, 'https://habit.example.com/news/7?p=1')) as t(page_id, link)""")
ARTICLE_PAGES = """(values
(1, '<h1 class="tm-title">  Fast <em>joins</em> </h1><a class="tm-user-info__username"> ann </a><time datetime="2025-12-20T10:00"></time><div class="tm-article-body"><p>One.</p><p>Two</p></div>'),
(2, '<h1>Other</h1><div class="article-formatted-body article-formatted-body_v2">Body &amp; soul</div>'), (3, '<h1 class="tm-title">No body</h1>'), (4, null)) as p(page_id, html)"""
STRIPPED = "trim({replace_all|{replace_all|$|'<[^>]+>'|' '}|{re|\\s+}|' '})"
sql("article_parse", f"""
select page_id, coalesce(nullif({STRIPPED.replace('$', 'title')}, ''), 'untitled') as title, coalesce(nullif({STRIPPED.replace('$', 'author')}, ''), 'unknown') as author,
       coalesce(nullif(published, ''), 'unknown') as published, replace({STRIPPED.replace('$', 'body')}, '&amp;', '&') as body
from (select page_id, {{extract|html|'(?is)<h1[^>]*class="tm-title"[^>]*>(.*?)</h1>'|1}} as title, {{extract|html|'(?is)<a[^>]*class="tm-user-info__username"[^>]*>(.*?)</a>'|1}} as author,
             {{extract|html|'(?is)<time[^>]*datetime="([^"]*)"'|1}} as published,
             coalesce(nullif({{extract|html|'(?is)<div[^>]*class="tm-article-body[^"]*"[^>]*>(.*?)</div>'|1}}, ''), {{extract|html|'(?is)<div[^>]*class="article-formatted-body[^"]*"[^>]*>(.*?)</div>'|1}}) as body
      from {ARTICLE_PAGES} where html is not null) where body <> ''""",
    "select * from (values (1, 'Fast joins', 'ann', '2025-12-20T10:00', 'One. Two'), (2, 'untitled', 'unknown', 'unknown', 'Body & soul')) as t(page_id, title, author, published, body)")
sql("valid_articles", """
select i, coalesce({matches|link|'^https://'}, false) and title is not null and authors is not null and not {matches|concat(',', authors)|',[ ]*[^ ,]*[ ]*(,¦$)'} as valid
from (values (1, 'T', 'https://a', 'Ann Lee, Bob Ray'), (2, 'T', 'http://a', 'Ann Lee'), (3, 'T', 'https://a', 'Ann'), (4, null, 'https://a', 'Ann Lee'), (5, 'T', null, 'Ann Lee'), (6, 'T', 'https://a', 'Ann Lee, Bob'), (7, 'T', 'https://a', null)) as t(i, title, link, authors)""",
    "select * from (values (1, true), (2, false), (3, false), (4, false), (5, false), (6, false), (7, false)) as t(i, valid)")


@query("select distinct s_suppkey as author_id, s_name as name from supplier union all select (select max(s_suppkey) from supplier) + row_number() over (order by name), name from (select distinct c_name as name from customer where c_name not in (select s_name from supplier))")
def article_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors, with those among all customers' names that aren't known yet added under new ids."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name")).distinct()
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).distinct().join(known, "name", "left_anti")
    top = known.agg(F.coalesce(F.max("author_id"), F.lit(0))).first()[0]
    return known.union(ranking.ranked(names, F.col("name")).select((F.col("place") + top).alias("author_id"), "name"))


PLACED = """
with recursive o as (select o_orderkey, o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
r(o_custkey, n, o_orderkey, accepted, left_over) as (
  select c_custkey, cast(0 as bigint), cast(null as bigint), false, c_acctbal * 100 from customer
  union all
  select r.o_custkey, o.n, o.o_orderkey, o.o_totalprice <= r.left_over, case when o.o_totalprice <= r.left_over then r.left_over - o.o_totalprice else r.left_over end
  from r join o on o.o_custkey = r.o_custkey and o.n = r.n + 1)
select o_orderkey, o_custkey as c_custkey, accepted from r where n > 0"""


@query(PLACED)
def place_order_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in turn, each accepted if its customer's balance bears it after those accepted before; a refused one costs nothing."""
    orders, people = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    draws = orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("seq"), F.col("c_custkey").alias("account"), F.col("o_totalprice").alias("amount"), (F.col("c_acctbal") * 100).alias("held")
    )
    said = reservations.decide(draws).withColumnRenamed("seq", "o_orderkey")
    return said.join(orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").select("o_orderkey", "c_custkey", "accepted")


ORDERS = """(values (1, 'ann', 'pen', 3, 2.0e0), (2, 'ann', 'ink', 1, 30.0e0), (3, 'bob', 'pen', 4, 2.0e0), (4, 'ann', 'ink', 1, 10.0e0), (5, 'bob', 'pen', 2, 2.0e0), (6, 'cy', 'pen', 1, 2.0e0), (7, 'dan', 'pen', 1, 2.0e0), (8, 'bob', 'cap', 1, 1.0e0), (9, 'bob', 'pen', 1, 2.0e0)) as t(seq, person, part, quantity, price)"""
HELD = "(values ('ann', 20.0e0), ('bob', 9.0e0), ('cy', 1.0e0), ('pen', 6.0e0), ('ink', 2.0e0)) as h(account, held)"


@query("select * from (values (1, true), (2, false), (3, false), (4, true), (5, true), (6, false), (7, false), (8, false), (9, true)) as t(seq, accepted)")
def place_orders_from_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in turn, each accepted if its part's stock and its person's balance bear it; unknown parts and persons refuse it."""
    draws = f"select seq, person as account, quantity * price as amount from {ORDERS} union all select seq, part, cast(quantity as double) from {ORDERS}"
    return reservations.decide(spark.sql(f"select seq, d.account, amount, held from ({draws}) d left join {HELD} on d.account = h.account"))


WORDS = """(values ('деятельностью', 'деятельност'), ('способностью', 'способност'), ('национальностью', 'национальност'), ('молодостью', 'молодост'), ('активностью', 'активност'),
('программирование', 'программирован'), ('ПРОГРАММА', 'программ'), ('книгам', 'книг'), ('обучение', 'обучен'), ('россия', 'росс'), ('новость', 'новос'), ('Ёлка', 'елк'), ('студентов', 'студенто'),
('важнейший', 'важн'), ('написав', 'написа'), ('учился', 'учи'), ('язык', 'язык'), ('я', 'я'), ('python3', 'python3'), ('it-индустрия', 'it-индустр')) as t(term, stem)"""


@query(f"select term, stem from {WORDS}")
def stem_russian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of Russian words."""
    ship(spark)
    return stem_terms(spark.sql(f"select term from {WORDS}"))


TEXTS = """(values (1, 'The rivers were running high'), (2, 'A river runs; it RAN before'), (3, 'Runner by the riverside'), (4, 'Run, run to the River!'), (5, null), (6, 'running')) as t(i, text)"""


def full_text_match(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of the rows whose text has every lexeme of a query: words of letters and digits, stemmed, without stop words."""
    asked = stem_words([text])[0]
    words = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0))).alias("word"))
    stems = F.pandas_udf(lambda s: s.map(lambda w: next(iter(stem_words([w])[0]), None)), "string")
    known = words.select("word").distinct().withColumn("lexeme", stems("word")).where(F.col("lexeme").isin(asked))
    hits = words.join(known, "word").groupBy(key).agg(F.count_distinct("lexeme").alias("n"))
    return hits.where(F.col("n") == len(set(asked))).select(key)


@query(f"select i from {TEXTS} where regexp_matches(lower(text), '\\b(run|runs|running)\\b') and regexp_matches(lower(text), '\\brivers?\\b')")
def full_text_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that have the lexemes of a query, in whatever form."""
    ship(spark)
    return full_text_match(spark.sql(f"select * from {TEXTS}"), "i", "the running of rivers")


@query("select doc_id, concat('Title: ', source, chr(10), 'Length: ', n_chars, chr(10), chr(10), text) as body from documents")
def text_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files, each with a head of metadata, and read back."""
    path = files.scratch_path(spark, "texts")
    body = F.concat(F.lit("Title: "), "source", F.lit("\nLength: "), F.col("n_chars").cast("string"), F.lit("\n\n"), "text")
    files.write_texts(table(spark, sf_dir, "documents").select("doc_id", body.alias("body")), "doc_id", "body", path)
    return files.read_texts(spark, path, "doc_id long, body string")


@query("select page_id, url, cast(page_id % 7 as bigint) as priority from pages")
def queue_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl's queue, saved twice over, each time in place of what was there, and loaded."""
    path = files.scratch_path(spark, "queue")
    queue = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 7).alias("priority"))
    for kept in (queue.where("priority > 3"), queue):
        kept.write.mode("overwrite").parquet(path)
    return spark.read.schema(queue.schema).parquet(path).orderBy(F.desc("priority"), "page_id")


@query("select * from (values (1, 'pen', 2.5), (2, 'ink, blue', 11.0), (4, 'cap \"x\"', null)) as t(id, name, price)")
def csv_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with a header loaded into a typed table; a row that doesn't fit is left out."""
    path = files.scratch_path(spark, "copy")
    lines = ["id,name,price", "1,pen,2.5", '2,"ink, blue",11', "three,bad,1", '4,"cap ""x""",\\N']
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).orderBy("i").select("value").write.text(path)
    return files.read_csv(spark, path, "id int, name string, price double")


@query("select * from (values ('users', 2), ('articles', 3)) as t(name, n)")
def seed_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables seeded from a script of INSERT statements."""
    script = """
    INSERT INTO users (user_id, email) VALUES (1, 'a;b@x.org'), (2, 'it''s@x.org');
    insert into articles (article_id, title, year) values (1, 'One', 2001), (2, 'Two', 2002);
    INSERT INTO articles (article_id, title, year) VALUES (3, 'Three', null);"""
    tables = seeds.read_inserts(spark, script)
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.lit(name).alias("name"), F.count("*").cast("int").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("select * from (values (1, 'absent', false, 0), (2, 'loaded', true, 25), (3, 'emptied', true, 0), (4, 'dropped', false, 0)) as t(step, state, present, n)")
def staging_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A staging view that is looked for in the catalogue, loaded, emptied and dropped."""
    name, rows = "staging_nation", []
    nation = table(spark, sf_dir, "nation")

    def note(state: str) -> None:
        present = spark.catalog.tableExists(name)
        rows.append((len(rows) + 1, state, present, spark.table(name).count() if present else 0))

    spark.catalog.dropTempView(name)
    note("absent")
    nation.createOrReplaceTempView(name)
    note("loaded")
    nation.limit(0).createOrReplaceTempView(name)
    note("emptied")
    spark.catalog.dropTempView(name)
    note("dropped")
    return spark.createDataFrame(rows, "step int, state string, present boolean, n int")
