"""Every query against its oracle on the smallest tables, as the driver does it."""

import datetime
import decimal

import duckdb
import pytest

from strataflow import catalogue
from strataflow.functions.stem_ru import stem
from strataflow.operators.boolean import best_scores, parse_left_to_right, parse_precedence, posting_lists, search, universe
from strataflow.session import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else str(v)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck):
    df = catalogue.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    oracle = catalogue.oracle_sql().get(name)
    if oracle is None:
        assert got
        return
    want = duck.execute(oracle)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(got, df.columns) == rows_of(want.fetchall(), columns)


SMALL = [(0, "python программирование"), (1, "python java"), (2, "java программирование"), (3, "машинное обучение")]


@pytest.mark.parametrize(
    ("text", "mode", "want"),
    [
        ("python", "lr", {0, 1}),
        ("python AND программирование", "lr", {0}),
        ("python OR машинное", "lr", {0, 1, 3}),
        ("python AND NOT java", "lr", {0}),
        ("несуществующее", "lr", set()),
        ("python программирование", "lr", {0}),
        ("python OR java AND машинное", "lr", set()),
        ("python OR java AND машинное", "prec", {0, 1}),
        ("python AND NOT missing", "lr", {0, 1}),
        ("NOT python", "lr", {2, 3}),
        ("(python OR java) AND программирование", "prec", {0, 2}),
        ("", "lr", set()),
        ("NOT python AND NOT java", "lr", {3}),
        ("NOT (python AND NOT java)", "prec", {1, 2, 3}),
        ("java AND NOT (NOT python)", "prec", {1}),
        ("машинное OR NOT java", "lr", {0, 3}),
    ],
)
@pytest.mark.parametrize("parts", [1, 3])
def test_boolean(spark, text, mode, want, parts):
    docs = spark.createDataFrame(SMALL, "doc_id long, text string")
    assert {r.doc_id for r in search(posting_lists(docs, parts), universe(docs, parts), text, mode).collect()} == want


@pytest.mark.parametrize("parts", [1, 5])
def test_best_scores(spark, parts):
    """Against a plain count, with ties, a term listed twice, a query without hits and none at all."""
    texts = [(i, " ".join(["java"] * (i % 3) + ["python"] * (i % 4))) for i in range(40)]
    asked = [(1, "java"), (1, "python"), (2, "python"), (2, "python"), (3, "missing")]
    index = posting_lists(spark.createDataFrame(texts, "doc_id long, text string"), parts)
    want = []
    for qid in (1, 2, 3):
        hits = [(-sum(t.split().count(w) for q, w in asked if q == qid), i) for i, t in texts]
        want += [(qid, i, -s, n + 1) for n, (s, i) in enumerate(sorted(h for h in hits if h[0])[:7])]
    got = best_scores(index, asked, 7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert best_scores(index, [], 7).count() == 0


def test_trees():
    assert parse_left_to_right("a or b and c").kind == "AND"
    assert parse_precedence("a or b and c").kind == "OR"


@pytest.mark.parametrize(
    ("word", "want"),
    [("программирование", "программирован"), ("книгам", "книг"), ("россия", "росс"), ("Ёлка", "елк"), ("Hello", "hello"), ("новость", "новос"),
     ("написав", "написа"), ("язык", "язык"), ("программистов", "программисто"), ("it-индустрия", "it-индустр")],
)
def test_stems(word, want):
    assert stem(word) == want
