"""Edits of a catalogue: articles with bridges to names (authors, keywords), and accounts that upload and like them.

Everything is joins on keys: names are got or created, bridges of edited articles replaced, names of no article removed. New names get
ids after the largest one, in the names' order, by places over ranges (`ranking`), so no task sees them all.

Defined cases: null names and null articles aren't asked for; repeated rows are one; a name that is asked for twice is created once; of
several ids of one known name the least is used for new rows; an article that is both edited and dropped is dropped; empty
edits still remove names of no article.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking

#: Rows of one name from which on a join takes it as frequent. Such names are at most one for so many rows, and are broadcast.
FREQUENT = 100_000


def get_or_create(names: DataFrame, asked: DataFrame) -> DataFrame:
    """All names (id, name), with those asked for (name) that aren't known yet under new ids."""
    fresh = asked.select("name").where(F.col("name").isNotNull()).distinct().join(names.select("name"), "name", "left_anti")
    top = names.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return names.select("id", "name").union(ranking.ranked(fresh, F.col("name")).select((F.col("place") + top).alias("id"), "name"))


def numbered(asked: DataFrame, known: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(article, id) of rows (article, name) whose name is known (id, name), the least id of each. Rows of a frequent name stay where
    they are and don't meet in one task; the others are joined by name."""
    counts = ranking.staged(asked.groupBy(F.col("name").alias("__name")).agg(F.count("*").alias("n")), "counts")
    one = known.join(counts.select("__name"), F.col("name") == F.col("__name"), "left_semi").groupBy("name").agg(F.min("id").alias("id"))
    one = ranking.staged(one.join(counts, F.col("name") == F.col("__name")).select("__name", "id", "n"), "numbered")
    often = F.broadcast(one.where(F.col("n") >= frequent))
    on = F.col("name") == F.col("__name")
    rest = asked.join(F.broadcast(counts.where(F.col("n") >= frequent).select("__name")), on, "left_anti").join(one.where(F.col("n") < frequent), on)
    return asked.join(often, on).select("article", "id").union(rest.select("article", "id"))


def edit(names: DataFrame, bridge: DataFrame, asked: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """names (id, name) and bridge (article, id) after edits: asked (article, name) replaces the names of its articles, and dropped
    (article) removes articles. Names that no article has are removed."""
    asked = asked.where(F.col("article").isNotNull() & F.col("name").isNotNull()).join(dropped.select("article"), "article", "left_anti")
    asked = ranking.staged(asked.select("article", "name"), "asked")
    known = ranking.staged(get_or_create(names, asked), "names")
    touched = asked.select("article").union(dropped.select("article")).distinct()
    kept = bridge.select("article", "id").join(touched, "article", "left_anti")
    whole = ranking.staged(kept.union(numbered(asked, known)).distinct(), "bridge")
    return known.join(whole.select("id").distinct(), "id", "left_semi").select("id", "name"), whole


def remove_accounts(users: DataFrame, articles: DataFrame, favorites: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """users (user), articles (article, uploaded_by) and favorites (user, article) once accounts (user) are gone: their articles stay
    without an uploader, their favorites go."""
    left = gone.select(F.col("user").alias("__gone")).where("__gone is not null").distinct()
    orphaned = articles.join(left, F.col("uploaded_by") == F.col("__gone"), "left")
    by = F.when(F.col("__gone").isNull(), F.col("uploaded_by")).alias("uploaded_by")
    keep = lambda rows: rows.join(left, F.col("user") == F.col("__gone"), "left_anti")
    return keep(users), orphaned.select("article", by), keep(favorites)
