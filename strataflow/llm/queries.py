"""Registered queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import common as C
from . import classifier, decontam, mixing, packing, prefix_trie, quality_rules, sharding, simhash, spelling, substring, token_records, url_filter, warc_zip
from .oracles import ORACLES


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document, and its first place in the mix."""
    got = mixing.take(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source", "source_size", "target", "taken", "position")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record into ZIP archives, and read back from them."""
    archives = warc_zip.write_archives(table(spark, sf_dir, "pages"), C.fresh_path(spark, "warc"))
    return warc_zip.read_archives(archives, with_payload=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures and verdicts of every document."""
    return quality_rules.rated(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once those that start earlier as well are gone."""
    return substring.dedup(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the likeness."""
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item_words", "covered_words", "similarity", "n_slots")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from the labels that aren't held out."""
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest id in its class."""
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_code().alias("fingerprint"), "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document, now and with one more shard, and its shard once bytes are balanced."""
    got = sharding.assign(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("place").alias("slot"), "grown_shard", "vslot", "balanced_shard"
    )


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids written as binary records, and read back from them."""
    files = token_records.write_records(table(spark, sf_dir, "documents"), C.fresh_path(spark, "tokens"))
    return token_records.read_records(files)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its sequence and its place there."""
    return packing.pack(table(spark, sf_dir, "documents")).drop("part", "row", "ids")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over rebuilt conversations."""
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its near words counted, and the form that it is a variant of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_url_filter,
        op3_warc_zip,
        op4_quality_rules,
        op5_substring_dedup,
        op6_decontamination,
        op7_quality_classifier,
        op8_simhash,
        op9_sharding,
        op10_token_records,
        op11_packing,
        op12_prefix_trie,
        op13_spelling_variants,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
