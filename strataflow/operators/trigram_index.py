"""Trigram similarity from an index: posting lists of trigrams, for look-ups and for similarity joins.

Similarity is the number of common trigrams over that of all trigrams of both texts. A look-up reads the lists of the query's trigrams
alone; a text's count of them and its own number of trigrams give the similarity. A join looks for pairs of different texts at or above a
threshold t: such a pair shares one of the first n - ceil(t n) + 1 trigrams of either, in any order common to both; rare
trigrams come first in it. Sizes must fit as well: t n <= m <= n / t.

Defined cases: null texts, and those without letters or digits, are like nothing; equal texts are one text with several ids; an empty table
gives no rows; ties are broken by the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trigrams
from .ranking import staged


def index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, id, size), staged: a row for each distinct trigram of each text, sorted by trigram so that a look-up reads few row groups."""
    sized = rows.select(F.col(key).alias("id"), trigrams(F.col(text)).alias("grams")).where(F.size("grams") > 0)
    lists = sized.select(F.explode("grams").alias("gram"), "id", F.size("grams").alias("size"))
    return staged(lists.repartitionByRange("gram").sortWithinPartitions("gram", "id"), "trigrams")


def look_up(lists: DataFrame, text: str, least: float, limit: int | None = None) -> DataFrame:
    """(id, score): texts that are more than `least` (0 or above) like a text; with a limit, the most alike of them."""
    asked = [r[0] for r in lists.sparkSession.range(1).select(F.explode(trigrams(F.lit(text)))).collect()]
    common = lists.where(F.col("gram").isin(asked)).groupBy("id").agg(F.count("*").alias("common"), F.first("size").alias("size"))
    scored = common.select("id", F.round(F.col("common") / (F.col("size") + len(asked) - F.col("common")), 6).alias("score")).where(F.col("score") > least)
    return scored.orderBy(F.desc("score"), "id").limit(limit) if limit is not None else scored


def join(rows: DataFrame, key: str, text: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, score) of different texts whose similarity is `least` or more, each text by its smallest id; and
    (id, member) that text's ids, so that copies aren't paired with one another."""
    named = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("member"), F.col(text).alias("t"))
    firsts = named.groupBy("t").agg(F.min("member").alias("id"))
    members = named.join(firsts.select("id", F.col("t").alias("__t")), F.col("t") == F.col("__t")).select("id", "member")
    texts = staged(firsts.select("id", trigrams(F.col("t")).alias("grams")).where(F.size("grams") > 0), "texts")
    each = texts.select("id", F.explode("grams").alias("gram"))
    counts = each.groupBy(F.col("gram").alias("__gram")).agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct("n", "gram")))
    ranked = each.join(counts, F.col("gram") == F.col("__gram")).groupBy("id").agg(order.alias("o"))
    grams = F.transform("o", lambda x: x["gram"])
    sized = staged(ranked.select("id", grams.alias("grams"), F.size("o").alias("size")), "ranked-texts")
    # a hair below, so that rounding of t n never drops a pair at the threshold
    head = F.col("size") - F.ceil(F.lit(least) * F.col("size") - F.lit(1e-9)).cast("int") + 1
    heads = sized.select("id", "size", F.explode(F.slice("grams", F.lit(1), head)).alias("gram"))
    other = heads.select(F.col("id").alias("b"), F.col("size").alias("b_size"), F.col("gram").alias("b_gram"))
    fits = (F.col("size") >= least * F.col("b_size") - 1e-9) & (F.col("b_size") >= least * F.col("size") - 1e-9)
    pairs = heads.join(other, (F.col("gram") == F.col("b_gram")) & (F.col("id") < F.col("b")) & fits).select(F.col("id").alias("a"), "b").distinct()
    left = sized.select(F.col("id").alias("__a"), F.col("grams").alias("x"))
    right = sized.select(F.col("id").alias("__b"), F.col("grams").alias("y"))
    both = pairs.join(left, F.col("a") == F.col("__a")).join(right, F.col("b") == F.col("__b"))
    common = F.size(F.array_intersect("x", "y"))
    scored = both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("raw"))
    return scored.where(F.col("raw") >= least).select("a", "b", F.round("raw", 6).alias("score")), members
