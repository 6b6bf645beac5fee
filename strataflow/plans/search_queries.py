"""Search: boolean queries compiled to one aggregation, ranked search, Zipf's law, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stem_en, stem_ru
from ..functions.text import index_terms
from ..operators import boolean, ranking, stems
from ..session import table, views
from ..sources import files, postings
from .registry import ORACLES, QUERIES, _render, query, sql
from .text_queries import LISTED, TERMS, TOKENS, term_counts

DOCS = "select doc_id from documents where length(text) > 50"


#: By application and folder: the stamp of the input's files, the saved index, and the parts that ids are dealt into.
_SAVED: dict[tuple[str, str], tuple[dict, list[str], int]] = {}


def search_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The index of a folder's documents: posting lists and all ids. The first search of the application builds and saves it. Later
    ones look at the stamps of the documents' files (size and time): files that came since are indexed as a segment of their
    own, which is read with the others; if files went or changed, the index is built anew."""
    key, now = (spark.sparkContext.applicationId, sf_dir), files.stamps(spark, f"{sf_dir}/documents.parquet")
    stamp, segments, parts = _SAVED.get(key, ({}, [], 0))
    if now != stamp or not segments:
        grown = segments and all(now.get(f) == s for f, s in stamp.items())
        docs = spark.read.parquet(*sorted(set(now) - set(stamp))) if grown else table(spark, sf_dir, "documents")
        docs = docs.where(F.length("text") > 50)
        parts = parts if grown else boolean.part_count(docs)
        made = files.save_index(boolean.posting_lists(docs, parts), boolean.universe(docs, parts), files.scratch_path(spark, "index"))
        segments = [*segments, made] if grown else [made]
        _SAVED[key] = now, segments, parts
    return files.load_index(spark, *segments)


@query(LISTED.replace("$", TERMS))
def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each term's posting list, made whole: how many documents it has, the first and the last. Documents without an id are in no list,
    but their terms count."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 50)
    lists = boolean.posting_lists(docs, boolean.part_count(docs))
    ends = lists.select("term", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last"))
    lost = docs.where("doc_id is null").select(F.explode(F.array_distinct(index_terms(F.col("text")))).alias("term"))
    none = F.lit(None).cast("long")
    each = ends.union(lost.select("term", F.lit(0).cast("long"), none, none))
    return each.groupBy("term").agg(F.sum("n").alias("n"), F.min("first").alias("first_doc"), F.max("last").alias("last_doc"))


def has(term: str) -> str:
    return f"exists (select 1 from p where p.doc_id = d.doc_id and p.term = '{term}')"


def boolean_query(name: str, text: str, condition: str, mode: str = "lr") -> None:
    """Register a boolean search, with its condition written out for the oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lists, every = search_index(spark, sf_dir)
        return boolean.search(lists, every, text, mode)

    run.__doc__, run.__name__ = text, name
    QUERIES[name] = run
    ORACLES[name] = _render(f"with p as (select distinct doc_id, term from ({TERMS})), d as ({DOCS}) select doc_id from d where {condition}", 1)


boolean_query("bool_flagship", "the AND for AND NOT that", f"{has('the')} and {has('for')} and not {has('that')}")
boolean_query("bool_and", "the AND with", f"{has('the')} and {has('with')}")
boolean_query("bool_or", "the OR les", f"{has('the')} or {has('les')}")
boolean_query("bool_not", "NOT the", f"not {has('the')}")
boolean_query("bool_not_missing", "the AND NOT zzzzqqq", f"{has('the')}")
boolean_query("bool_left_to_right", "the OR les AND des", f"({has('the')} or {has('les')}) and {has('des')}")
boolean_query("bool_precedence", "the OR les AND des", f"{has('the')} or ({has('les')} and {has('des')})", "prec")
boolean_query("bool_parentheses", "(the OR les) AND NOT (that OR des)", f"({has('the')} or {has('les')}) and not ({has('that')} or {has('des')})", "prec")
boolean_query("bool_implicit_and", "the that", f"{has('the')} and {has('that')}")
boolean_query("bool_symbols", "the && ! that || les", f"({has('the')} and not {has('that')}) or {has('les')}")

ASKED = ["the", "les", "der", "que"]
IN_ASKED = ", ".join(f"'{t}'" for t in ASKED)


@query(f"select term, count(distinct doc_id) as n from ({TERMS}) where term in ({IN_ASKED}) group by term")
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have each of some terms."""
    lists, _ = search_index(spark, sf_dir)
    return lists.where(F.col("term").isin(ASKED)).groupBy("term").agg(F.sum(F.size("ids")).alias("n"))


@query(f"select term, max(case when doc_id = 7 then 1 else 0 end) = 1 as holds from ({TERMS}) where term in ({IN_ASKED}) group by term")
def posting_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document is among those of some terms."""
    lists, _ = search_index(spark, sf_dir)
    return lists.where(F.col("term").isin(ASKED)).groupBy("term").agg(F.max(F.array_contains("ids", F.lit(7).cast("long"))).alias("holds"))


@query(f"select doc_id, count(*) over () as total from (select distinct doc_id from ({TERMS}) where term = 'the') order by doc_id limit 50")
def bool_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the documents that match, with the number of all."""
    lists, every = search_index(spark, sf_dir)
    hits = lists.where("term = 'the'")
    total = hits.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("total"))
    return boolean.search(lists, every, "the").orderBy("doc_id").limit(50).crossJoin(F.broadcast(total))


@query(f"select doc_id, count(*) as score from ({TERMS}) where term in ('the', 'with') group by doc_id order by score desc, doc_id limit 100")
def tf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred documents that have the query's terms most often."""
    return boolean.scores(search_index(spark, sf_dir)[0], ["the", "with"]).orderBy(F.desc("score"), "doc_id").limit(100)


@query(f"""
with q(qid, term) as (values (1, 'the'), (1, 'for'), (2, 'les'), (3, 'und'), (3, 'der'), (4, 'zzzz')),
scored as (select cast(qid as bigint) as qid, doc_id, count(*) as score from ({TERMS}) t join q on t.term = q.term group by qid, doc_id)
select qid, doc_id, score, cast(place as bigint) as place
from (select *, row_number() over (partition by qid order by score desc, doc_id) as place from scored) where place <= 20""")
def multi_query_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of each of several queries, answered together."""
    asked = [(1, "the"), (1, "for"), (2, "les"), (3, "und"), (3, "der"), (4, "zzzz")]
    return boolean.best_scores(search_index(spark, sf_dir)[0], asked, 20)


_STEMMED: dict[str, str] = {}


def stem_index(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """Posting lists of stems, saved beside the index that they are made from; a new index gets new ones."""
    lists, every = search_index(spark, sf_dir)
    key = f"{language}:" + "|".join(_SAVED[spark.sparkContext.applicationId, sf_dir][1])
    if key not in _STEMMED:
        known = stems.dictionary(lists, STEMMERS[language])
        _STEMMED[key] = files.save_index(stems.stem_lists(lists, known), every, files.scratch_path(spark, "stems"))
    return files.load_index(spark, _STEMMED[key])[0]


STEMMERS = {"ru": stem_ru.stem, "en": stem_en.lexeme}
#: The slash parts terms of the index but not of a query, so "und/der" finds nothing; "the" counts twice.
ASKED_RANKED = "The, with the: und/der (QUE)"


@query(f"""
with q as (select {{unnest|{{query_terms|'{ASKED_RANKED}'}}}} as term)
select doc_id, count(*) as score from ({TERMS}) t join q on t.term = q.term group by doc_id order by score desc, doc_id limit 100""")
def stem_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred documents that have the stems of a query's words most often. Latin words are their own stems to the Russian
    stemmer, which the SQL relies on."""
    found = stems.scores(stem_index(spark, sf_dir, "ru"), ASKED_RANKED, STEMMERS["ru"])
    return found.orderBy(F.desc("score"), "doc_id").limit(100)


#: Words that the English stemmer cuts, and a stop word, which doesn't count.
ASKED_TEXT = "tioned and the erings"


@query()
def full_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have all English lexemes of a query, whatever form of the words they use."""
    return stems.having_all(stem_index(spark, sf_dir, "en"), ASKED_TEXT, STEMMERS["en"])


@query(f"select term, count(distinct doc_id) as n, min(doc_id) as first_id, max(doc_id) as last_id, cast(sum(doc_id) as bigint) as id_sum from (select distinct term, doc_id from ({TERMS})) group by term")
def index_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written as text in segments, and read back from byte ranges of them."""
    lists, every = search_index(spark, sf_dir)
    path = files.scratch_path(spark, "postings")
    postings.register(spark)
    count = every.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    lists.select("term", "ids").write.format("postings").option("docs", count).mode("append").save(path)
    back = spark.read.format("postings").load(path).where(F.size("ids") > 0)
    sums = F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x)
    return back.groupBy("term").agg(F.sum(F.size("ids")).alias("n"), F.min(F.array_min("ids")).alias("first_id"), F.max(F.array_max("ids")).alias("last_id"), F.sum(sums).alias("id_sum"))


RANKED = f"select term, freq, row_number() over (order by freq desc, term) as place from (select token as term, count(*) as freq from ({TOKENS}) group by token)"
DEV = f"select r.*, 100.0 * (r.freq - m.top / r.place) / (m.top / r.place) as dev from ({RANKED}) r cross join (select cast(max(freq) as double) as top from (select count(*) as freq from ({TOKENS}) group by token)) m"


def ranked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with place, top (the first one's frequency) and dev (how far in percent the frequency is from top / place). The
    ranked table is staged, and the top is read from it."""
    ranks = ranking.staged(ranking.ranked(term_counts(spark, sf_dir), F.desc("freq"), F.col("term")), "ranked-terms")
    first = ranks.where("place = 1").first()
    law = F.lit(float(first.freq) if first else None).cast("double") / F.col("place")
    return ranks.withColumns({"law": law, "dev": 100.0 * (F.col("freq") - law) / law})


@query(f"select case when place <= 100 then 'head' when place <= 10000 then 'middle' else 'tail' end as part, count(*) as n, round(avg(abs(dev)), 4) as mean_dev from ({DEV}) group by 1")
def zipf_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean deviation from Zipf's law among frequent, middling and rare terms."""
    part = F.when(F.col("place") <= 100, "head").when(F.col("place") <= 10000, "middle").otherwise("tail").alias("part")
    return ranked_terms(spark, sf_dir).groupBy(part).agg(F.count("*").alias("n"), F.round(F.avg(F.abs("dev")), 4).alias("mean_dev"))


@query(f"select term, freq, cast(place as bigint) as place, round(dev, 4) as dev from ({DEV}) where dev > 0 order by dev desc, term limit 10")
def zipf_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten terms that are furthest above Zipf's law."""
    top = ranked_terms(spark, sf_dir).where("dev > 0").orderBy(F.desc("dev"), "term").limit(10)
    return top.select("term", "freq", "place", F.round("dev", 4).alias("dev"))


@query(f"""
select round(avg({{sq|r.freq - m.top / r.place}}), 3) as zipf, round(avg({{sq|r.freq - m.top / (r.place + 2.7)}}), 3) as mandelbrot
from ({RANKED}) r cross join (select cast(max(freq) as double) as top from (select count(*) as freq from ({TOKENS}) group by token)) m""")
def zipf_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared errors of Zipf's and Mandelbrot's laws."""
    mandelbrot = F.col("law") * F.col("place") / (F.col("place") + 2.7)
    error = lambda law: F.round(F.avg((F.col("freq") - law) * (F.col("freq") - law)), 3)
    return ranked_terms(spark, sf_dir).agg(error(F.col("law")).alias("zipf"), error(mandelbrot).alias("mandelbrot"))


sql("cls_metrics", """
select round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(tp / nullif(tp + fp, 0), 6) as prec, round(tp / nullif(tp + fn, 0), 6) as recall,
       round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1
from (select cast(sum(case when y = 1 and p = 1 then 1 else 0 end) as double) as tp, cast(sum(case when y = 0 and p = 0 then 1 else 0 end) as double) as tn,
             cast(sum(case when y = 0 and p = 1 then 1 else 0 end) as double) as fp, cast(sum(case when y = 1 and p = 0 then 1 else 0 end) as double) as fn
      from (select l.quality as y, case when length(d.text) > 300 then 1 else 0 end as p from labels l join documents d on l.doc_id = d.doc_id))""")
sql("reg_metrics", """
select round(avg(abs(y - p)), 4) as mae, round(avg({sq|y - p}), 2) as mse, round(sqrt(avg({sq|y - p})), 4) as rmse,
       round(1 - sum({sq|y - p}) / sum({sq|y - (select avg(l_extendedprice) from lineitem)}), 6) as r2
from (select l_extendedprice as y, l_quantity * 1500.0 as p from lineitem)""")
sql("precision_at_k", f"""
with hits as (select doc_id, count(*) as score from ({TERMS}) where term in ('the', 'with') group by doc_id),
top as (select * from hits order by score desc, doc_id limit 10)
select count(*) as n, round(avg(cast(case when l.quality = 1 then 1 else 0 end as double)), 6) as precision_at_10 from top left join labels l on top.doc_id = l.doc_id""")
EVALUATED = {"the": 10, "les": 10, "und": 10, "que": 5}


@query(f"""
with q(term, expected_min) as (values ('the', 10), ('les', 10), ('und', 10), ('que', 5)),
n as (select q.term, q.expected_min, count(distinct t.doc_id) as found from q left join ({TERMS}) t on t.term = q.term group by q.term, q.expected_min)
select round(avg(found), 6) as mean_found, sum(case when found > 0 then 1 else 0 end) = count(*) as all_found, cast(sum(case when found >= expected_min then 1 else 0 end) as bigint) as passed from n""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether some terms are found as often as expected. Other terms are left out where they are read, so that only these meet."""
    views(spark, sf_dir, "documents")
    rows = spark.sql(_render(TERMS, 0)).where(F.col("term").isin(list(EVALUATED)))
    found = rows.groupBy("term").agg(F.count_distinct("doc_id").alias("found"))
    asked = spark.createDataFrame(list(EVALUATED.items()), "asked string, expected_min int")
    n = asked.join(F.broadcast(found), F.col("asked") == F.col("term"), "left").select("expected_min", F.coalesce("found", F.lit(0)).alias("found"))
    return n.agg(
        F.round(F.avg("found"), 6).alias("mean_found"), (F.count_if(F.col("found") > 0) == F.count("*")).alias("all_found"), F.count_if(F.col("found") >= F.col("expected_min")).alias("passed")
    )
