"""Queries on pages and documents: cleaning, tokens, URLs, the crawl's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import ranking
from ..session import table
from .registry import query, sql

TOKENS = "select doc_id, {unnest|{tokens|text}} as token from documents"
sql("tokenize", TOKENS)
sql("tokenize_min3", f"select doc_id, token from ({TOKENS}) where length(token) >= 3")
sql("token_stats", f"select count(*) as total, count(distinct token) as distinct_tokens, round(avg(length(token)), 6) as mean_chars from ({TOKENS})")
sql("token_stats_bytes", f"select count(*) as total, count(distinct token) as distinct_tokens, round(avg({{bytes|token}}), 6) as mean_bytes from ({TOKENS})")
sql("token_length_hist", f"select cast(length(token) as bigint) as chars, count(*) as n from ({TOKENS}) group by 1")
sql("top_tokens", f"select token, count(*) as n from ({TOKENS}) group by token order by n desc, token limit 20")
sql("term_freq", f"select token as term, count(*) as freq from ({TOKENS}) group by token")


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents with their counts: term, freq."""
    tokens = table(spark, sf_dir, "documents").select(F.explode(tokenize(F.col("text"))).alias("term"))
    return tokens.groupBy("term").agg(F.count("*").alias("freq"))


@query(f"select term, freq, cast(row_number() over (order by freq desc, term) as bigint) as place from (select token as term, count(*) as freq from ({TOKENS}) group by token)")
def term_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by falling frequency, with their places."""
    return ranking.ranked(term_counts(spark, sf_dir), F.desc("freq"), F.col("term"))


# Words of the crawled sites' user interface that aren't content.
UI_WORDS = "нравится добавить закладки комментарий ответить рейтинг скрыт избранное поделиться подписаться читать далее продолжение источник".split()
_UI_LIST = ", ".join(f"'{w}'" for w in UI_WORDS)
sql("term_freq_filtered", f"select token as term, count(*) as freq from ({TOKENS}) where token not in ({_UI_LIST}) group by token")
# a text of the kind that is filtered, beside the documents, which hold none
sql("ui_words_filtered", f"""
select token as term, count(*) as freq from (
  select {{unnest|{{tokens|text}}}} as token from (values ('Мне нравится! Добавить в закладки: далее — Источник, читать ИСТОЧНИК'), ('Комментарий скрыт. Ответить? Рейтинг статьи 5'), (null)) as t(text))
where token not in ({_UI_LIST}) group by token""")
sql("problem_tokens", f"""
select cast({{count_if|{{matches|token|'^[0-9]+$'}}}} as bigint) as digits, cast({{count_if|length(token) <= 2}} as bigint) as short_ones, cast({{count_if|length(token) > 30}} as bigint) as long_ones,
       cast({{count_if|{{matches|token|'[a-z].*[Ѐ-ѿ]¦[Ѐ-ѿ].*[a-z]'}}}} as bigint) as mixed
from (select distinct token from (select token, doc_id from ({TOKENS}) order by doc_id, token limit 10000))""")

TERMS = "select doc_id, {unnest|{terms|text}} as term from documents where length(text) > 50"
sql("index_terms", TERMS)
sql("tf_postings", f"select term, doc_id, count(*) as freq from ({TERMS}) group by term, doc_id")
sql("bool_postings", f"select distinct term, doc_id from ({TERMS})")
sql("index_stats", f"""
select count(distinct doc_id) as docs, count(distinct term) as terms, count(*) as postings, round(count(*) / count(distinct term), 6) as mean_postings
from (select distinct term, doc_id from ({TERMS}))""")
LISTED = "select term, count(distinct doc_id) as n, min(doc_id) as first_doc, max(doc_id) as last_doc from ($) group by term"

STRIP = "{replace_all|{replace_all|html|'(?is)<(script¦style)[^>]*>.*?</(script¦style)>'|' '}|'<[^>]+>'|' '}"
FULL = STRIP
for _old, _new in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
    FULL = f"replace({FULL}, '{_old}', '{_new}')"
sql("html_to_text", f"select page_id, trim({{replace_all|{FULL}|{{re|\\s+}}|' '}}) as text from pages")
sql("html_to_text_short", "select page_id, trim({replace_all|{replace_all|html|'<[^>]+>'|' '}|{re|\\s+}|' '}) as text from pages")
sql("html_title", """
select page_id, coalesce(nullif(trim({extract|html|'(?is)<title>(.*?)</title>'|1}), ''), nullif(trim({extract|html|'(?is)<h1>(.*?)</h1>'|1}), ''), 'unknown') as title from pages""")
sql("content_hash", "select page_id, md5(html) as hash from pages")
sql("extract_links", "select page_id, {unnest|{extract_all|html|'href=\"([^\"]*)\"'|1}} as link from pages")
NORMAL = f"""case when length({{replace_all|u|'[^/]'|''}}) > 3 then {{replace_all|u|'/+$'|''}} else u end"""
sql("normalize_url", f"""
select page_id, {NORMAL} as url from (
  select page_id, concat(lower({{extract|url|'^([^/?#]*//[^/?#]*)'|1}}), {{replace_all|{{replace_all|url|'^[^/?#]*//[^/?#]*'|''}}|'#.*'|''}}) as u from pages)""")
sql("url_strip_query", "select page_id, {replace_all|url|'[?].*'|''} as url from pages")
sql("url_article_id", "select page_id, {extract|url|'/([0-9]+)'|1} as article, {replace_all|{extract|{replace_all|url|'[?#].*'|''}|'([^/]*)/?$'|1}|'[.]html$'|''} as slug from pages")
sql("url_union_dedup", "select distinct url from (select url from pages union all select {replace_all|url|'[?#].*'|''} from pages)")
sql("url_uniqueness_check", "select url, count(*) as n from pages group by url having count(*) > 1")
sql("queue_by_priority", "select page_id, url, cast(page_id % 7 as bigint) as priority from pages order by priority desc, page_id")
sql("incremental_new_urls", "select p.page_id, p.url from pages p left anti join (select url from pages where page_id % 3 = 0) seen on p.url = seen.url".replace("left anti", "left anti"),
    "select p.page_id, p.url from pages p where not exists (select 1 from pages s where s.page_id % 3 = 0 and s.url = p.url)")
sql("upsert_by_url", "select url, page_id, md5(html) as hash from (select *, row_number() over (partition by url order by page_id desc) as n from pages) where n = 1")
sql("change_detect", """
select coalesce(o.url, n.url) as url,
       case when o.url is null then 'new' when n.url is null then 'gone' when o.hash <> n.hash then 'updated' else 'unchanged' end as state
from (select url, min(md5(html)) as hash from pages where page_id % 4 <> 0 group by url) o
full outer join (select url, min(md5(case when page_id % 5 = 0 then concat(html, '!') else html end)) as hash from pages where page_id % 4 <> 1 group by url) n on o.url = n.url""")
sql("archive_dates", "select date_add(date '2025-12-20', cast(-i as int)) as day from (select {range|0|1459} as i)",
    "select cast(date '2025-12-20' - cast(i as integer) as date) as day from (select unnest(range(1460)) as i)")
sql("docs_by_source", "select source, count(*) as n from documents group by source")
sql("corpus_stats", """
select coalesce(source, 'all') as source, count(*) as docs, cast(sum({bytes|text}) as bigint) as raw_bytes, cast(sum(length(text)) as bigint) as chars,
       round(avg(length(text)), 6) as mean_chars, round(sum({bytes|text}) / 1048576.0e0, 6) as raw_mb, round(avg({bytes|text}) / 1024.0e0, 6) as mean_kb
from documents group by rollup(source)""")
sql("corpus_keep", "select doc_id, cast(length(text) as bigint) as chars from documents where length(text) > 50 and {bytes|text} > 10")
sql("remove_vowels", "select doc_id, translate(text, 'aeiouAEIOU', '') as text from documents")
sql("remove_vowels_y", "select doc_id, translate(text, 'aeiouyAEIOUY', '') as text from documents")


@query("""
select doc_id, case when place % 2 = 1 then 'first' else 'second' end as child, translate(text, 'aeiouAEIOU', '') as line
from (select doc_id, text, row_number() over (order by doc_id) as place from documents)""")
def route_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, without vowels, dealt to two children in turn. Places are found on the ids alone."""
    docs = table(spark, sf_dir, "documents")
    places = ranking.ranked(docs.select("doc_id"), F.col("doc_id"))
    child = F.when(F.col("place") % 2 == 1, "first").otherwise("second").alias("child")
    return places.join(docs, "doc_id").select("doc_id", child, F.translate("text", "aeiouAEIOU", "").alias("line"))


sql("recrawl_due", "select event_id, {days|(select cast(max(ts) as date) from events)|cast(ts as date)} >= 7 as due from events")
sql("iso_to_epoch", "select event_id, coalesce({epoch|ts}, cast(0 as bigint)) as epoch from events")
sql("json_props", "select event_type, cast(sum({json_n|props}) as bigint) as n from events group by event_type")
