"""The corpus pipeline: five of the training-data operators, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's rows as Parquet in the shared folder
and reads them back as the next stage's documents. All stages but the last return the columns of documents.

Defined cases: a null text counts as empty, which the quality rules reject; rows with a null id or source are documents like others; repeated
rows are one class of near-duplicates, of which the row with the smallest id stays (of rows alike in all columns, one); an empty table, or
one of which a stage keeps nothing, ends in no rows; benchmark items of fewer than five words take no document away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import common, decontam, jaccard, mixing, quality_rules, simhash, token_records
from strataflow.session import table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, as does their host."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: fingerprints within op8's bits, or five-word sets that are 0.8 alike."""
    return simhash.keep_first(docs, jaccard.links)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix of sources, once for each time that they are taken."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records written to files and read back: doc_id, start, n_tokens, ids_crc32."""
    files = token_records.write_records(docs, common.fresh_path(spark, "tokens"))
    return token_records.read_records(files)


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("source mix", mix),
    ("token records", tokenize),
]

#: SQL can't express the fingerprints, the mix's shuffle or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), "pipeline")
        common.discard(*before)
        before = [docs]
    return docs
