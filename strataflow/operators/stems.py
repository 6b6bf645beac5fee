"""An index of stems made from an index of terms: a dictionary from distinct terms to stems, and the lists of a stem's terms merged.

Only the dictionary goes through the stemmer, once a distinct term. Lists of a stem's terms are merged as they stream by in order of stem,
with the frequencies of a document that has several of the terms added. Defined cases: null texts
have no terms; a stem of two bytes or fewer is dropped, as are stop words where the language has any; a query
without terms left finds nothing; a term that a query has twice counts twice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, query_terms
from ..session import ship
from . import boolean


def dictionary(lists: DataFrame, stem: Callable[[str], str | None], least_bytes: int = 3) -> DataFrame:
    """(term, stem) of the distinct terms of an index; terms whose stem is null or short are left out."""
    ship(lists.sparkSession)
    f = F.pandas_udf(lambda s: s.map(stem, na_action="ignore"), "string")
    found = lists.select("term").distinct().withColumn("stem", f("term"))
    return found.where(F.octet_length("stem") >= least_bytes)


def stem_lists(lists: DataFrame, known: DataFrame) -> DataFrame:
    """(term, part, ids, freqs): posting lists of stems, from those of terms and their dictionary. Lists are packed before they meet it."""
    rows = boolean.packed(lists).join(known.select(F.col("term").alias("__term"), "stem"), F.col("term") == F.col("__term"))
    return boolean.merged(rows.select(F.col("stem").alias("term"), "part", "packed"))


def asked(text: str, stem: Callable[[str], str | None]) -> Counter:
    """The stems of a query with how often it has them; words are cut at the shorter list of delimiters."""
    found = (stem(ascii_lower(w)) for w in query_terms(text))
    return Counter(s for s in found if s)


def scores(lists: DataFrame, text: str, stem: Callable[[str], str | None]) -> DataFrame:
    """(doc_id, score): how often documents have the stems of a query, in all."""
    wanted = asked(text, stem)
    rows = lists.where(F.col("term").isin(list(wanted)))
    times = F.element_at(F.create_map(*[F.lit(v) for pair in wanted.items() for v in pair]), F.col("term")) if wanted else F.lit(0)
    each = rows.select(times.alias("times"), F.explode(F.arrays_zip("ids", "freqs")).alias("x"))
    return each.groupBy(F.col("x.ids").alias("doc_id")).agg(F.sum(F.col("times") * F.col("x.freqs")).cast("long").alias("score"))


def having_all(lists: DataFrame, text: str, stem: Callable[[str], str | None]) -> DataFrame:
    """(doc_id): documents that have every stem of a query; none for a query without stems."""
    wanted = list(asked(text, stem))
    rows = lists.where(F.col("term").isin(wanted)).groupBy("part").agg(F.collect_list("ids").alias("held"))
    # every part has its own documents: lists meet within the part
    rows = rows.where(F.size("held") == len(wanted))
    both = F.aggregate(F.slice("held", 2, max(len(wanted) - 1, 1)), F.col("held")[0], lambda a, b: F.array_intersect(a, b))
    return rows.select(F.explode(both).alias("doc_id")) if wanted else rows.select(F.lit(0).cast("long").alias("doc_id")).limit(0)
