"""Registry of queries. A query is Spark SQL text or a function; its oracle is DuckDB SQL.

Most text is common to both engines. What differs is written as a macro in braces, with one form for each engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import INDEX_DELIMITERS, LOWER, QUERY_DELIMITERS, TOKEN, UPPER
from ..functions.text import char_class as _class
from ..session import TABLES, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

def _spark_text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _duck_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _hide(text: str) -> str:
    """Braces and bars of a pattern, as characters that the macros leave alone."""
    return text.replace("|", "¦").replace("{", "«").replace("}", "»")


#: name -> (Spark SQL, DuckDB SQL); arguments are $1, $2, ...
MACROS = {
    "tokens": (
        f"filter(transform(regexp_extract_all($1, {_spark_text(TOKEN)}, 0), t -> lower(regexp_replace(t, '^[-\\']+¦[-\\']+$', ''))), t -> t <> '')",
        f"list_filter(list_transform(regexp_extract_all($1, {_duck_text(TOKEN)}), lambda t: lower(regexp_replace(t, '^[-'']+¦[-'']+$', '', 'g'))), lambda t: t <> '')",
    ),
    "terms": (
        f"filter(split(translate($1, '{UPPER}', '{LOWER}'), {_hide(_spark_text(_class(INDEX_DELIMITERS) + '+'))}), t -> octet_length(t) > 2)",
        f"list_filter(regexp_split_to_array(translate($1, '{UPPER}', '{LOWER}'), {_hide(_duck_text(_class(INDEX_DELIMITERS) + '+'))}), lambda t: strlen(t) > 2)",
    ),
    "query_terms": (
        f"filter(split(translate($1, '{UPPER}', '{LOWER}'), {_hide(_spark_text(_class(QUERY_DELIMITERS) + '+'))}), t -> octet_length(t) > 2)",
        f"list_filter(regexp_split_to_array(translate($1, '{UPPER}', '{LOWER}'), {_hide(_duck_text(_class(QUERY_DELIMITERS) + '+'))}), lambda t: strlen(t) > 2)",
    ),
    "unnest": ("explode($1)", "unnest($1)"),
    "bytes": ("octet_length($1)", "strlen($1)"),
    "matches": ("($1 rlike $2)", "regexp_matches($1, $2)"),
    "replace_all": ("regexp_replace($1, $2, $3)", "regexp_replace($1, $2, $3, 'g')"),
    "extract": ("regexp_extract($1, $2, $3)", "regexp_extract($1, $2, $3)"),
    "extract_all": ("regexp_extract_all($1, $2, $3)", "regexp_extract_all($1, $2, $3)"),
    "range": ("explode(sequence(cast($1 as bigint), cast($2 as bigint)))", "unnest(range(cast($1 as bigint), cast($2 as bigint) + 1))"),
    "at": ("element_at($1, cast($2 as int))", "$1[$2]"),
    "split": ("split($1, $2)", "regexp_split_to_array($1, $2)"),
    "days": ("datediff($1, $2)", "date_diff('day', $2, $1)"),
    "epoch": ("unix_timestamp(cast($1 as timestamp))", "cast(floor(epoch($1)) as bigint)"),
    "list_set": ("array_join(array_sort(collect_set($1)), ',')", "coalesce(array_to_string(list_sort(list(distinct $1) filter ($1 is not null)), ','), '')"),
    "fold": ("aggregate", "list_reduce"),
    "count_if": ("count_if($1)", "count_if($1)"),
    "sq": ("(($1) * ($1))", "(($1) * ($1))"),
    "json_n": ("cast(get_json_object($1, '$.n') as bigint)", "cast(json_extract_string($1, '$.n') as bigint)"),
    "dist2": (
        "aggregate(zip_with($1, $2, (a, b) -> (cast(a as double) - cast(b as double)) * (cast(a as double) - cast(b as double))), cast(0 as double), (s, x) -> s + x)",
        "list_sum([(cast($1[i] as double) - cast($2[i] as double)) * (cast($1[i] as double) - cast($2[i] as double)) for i in range(1, len($1) + 1)])",
    ),
    "indexed": ("posexplode($1) as ($2, $3)", "unnest(range(len($1))) as $2, unnest($1) as $3"),
    "sha": ("sha2($1, 256)", "sha256($1)"),
    "re": (None, None),
}


def _render(text: str, side: int) -> str:
    """Replace {name|argument|...} by the engine's form; arguments may hold macros themselves. {re|pattern} is a pattern literal."""
    while m := re.search(r"\{(\w+)((?:\|[^{}]*)?)\}", text):
        name, args = m[1], m[2][1:].split("|") if m[2] else []
        if name == "re":
            form = (_spark_text, _duck_text)[side](m[2][1:].replace("¦", "|").replace("«", "{").replace("»", "}"))
            form = _hide(form)
        else:
            form = MACROS[name][side]
            for i, a in enumerate(args, 1):
                form = form.replace(f"${i}", a.strip())
        text = text[: m.start()] + form + text[m.end() :]
    return text.replace("¦", "|").replace("«", "{").replace("»", "}")


def _tables(text: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", text)]


def sql(name: str, text: str, oracle: str | None = None, check: bool = True) -> None:
    """Register a query given as SQL; the oracle is the same text in DuckDB's form unless another is given."""
    spark_text = _render(text, 0)
    used = _tables(text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *used) if used else None
        return spark.sql(spark_text)

    run.__doc__, run.__name__ = spark_text, name
    QUERIES[name] = run
    if check:
        ORACLES[name] = _render(oracle or text, 1)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = _render(oracle, 1)
        return f

    return keep
