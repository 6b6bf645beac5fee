"""Stems, index files and segments against plain Python."""

import re
import shutil

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter

from strataflow import catalogue
from strataflow.functions import stem_en, stem_ru
from strataflow.functions.text import ascii_lower, query_terms
from strataflow.operators import boolean, stems
from strataflow.plans import search_queries
from strataflow.sources import files, postings

DATA = "/root/testdata/sf0.001"
TEXTS = [(0, "Книги о программировании, книга"), (1, "книгой; программирования"), (2, "running dogs and a dog's run"), (3, "the runner/dog runs"), (4, None), (5, ""), (6, "книгам книгам книга KNIGA ab")]
INDEX_SPLIT = re.compile(r"[ \t\n\r.,;:!?()\[\]{}\"'<>/|@#$%^&*+=`~\\]+")


def plain_index(rows, stem):
    found = {}
    for i, text in rows:
        for word in INDEX_SPLIT.split(ascii_lower(text or "")):
            if len(word.encode()) > 2 and (s := stem(word)) and len(s.encode()) > 2:
                found.setdefault(s, {}).setdefault(i, 0)
                found[s][i] += 1
    return found


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("stem", [stem_ru.stem, stem_en.lexeme])
def test_stem_lists(spark, stem, parts):
    lists = boolean.posting_lists(spark.createDataFrame(TEXTS, "doc_id long, text string"), parts)
    made = stems.stem_lists(lists, stems.dictionary(lists, stem))
    got = {}
    for r in made.collect():
        assert r.ids == sorted(set(r.ids))
        got.setdefault(r.term, {}).update(zip(r.ids, r.freqs, strict=True))
    want = plain_index(TEXTS, stem)
    assert got == want
    for text in ("книга книгами, dogs", "run the run", "the", "", "dog/run x", "программирование книги"):
        asked = [s for w in query_terms(text) if (s := stem(ascii_lower(w)))]
        score = {}
        for s in asked:
            for i, n in want.get(s, {}).items():
                score[i] = score.get(i, 0) + n
        assert {r.doc_id: r.score for r in stems.scores(made, text, stem).collect()} == score
        have = set.intersection(*[set(want.get(s, {})) for s in asked]) if asked else set()
        assert sorted(r.doc_id for r in stems.having_all(made, text, stem).collect()) == sorted(have)


def test_query_terms():
    assert query_terms("a/b+c (the) x") == ["a/b+c", "the"]


def test_full_text(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").where(F.length("text") > 50).collect()]
    want = plain_index(rows, stem_en.lexeme)
    asked = [s for w in query_terms(search_queries.ASKED_TEXT) if (s := stem_en.lexeme(w))]
    assert len(asked) == 2  # stop words don't count
    have = set(want.get(asked[0], {})) & set(want.get(asked[1], {}))
    assert have and {r.doc_id for r in search_queries.full_text_match(spark, DATA).collect()} == have


@pytest.mark.parametrize("split", [1, 7, 50, 1 << 20])
def test_postings_source(spark, tmp_path, monkeypatch, split):
    postings.register(spark)
    rows = [(f"t{i}é", list(range(i % 9 + 1))) for i in range(60)] + [("77", [5]), ("none", []), (None, [1])]
    df = spark.createDataFrame(rows, "term string, ids array<long>").repartition(3)
    df.write.format("postings").option("docs", 9).mode("append").save(str(tmp_path))
    spark.createDataFrame([("t1é", [50])], "term string, ids array<long>").write.format("postings").option("docs", 1).mode("append").save(str(tmp_path))
    (tmp_path / "segment-of-a-lost-task.txt").write_text("1 1\nlost\n1\n1 \n")
    back = spark.read.format("postings").option("split", split).load(str(tmp_path))
    want = sorted([r for r in rows if r[0] and r[1]] + [("t1é", [50])])
    assert sorted((r.term, r.ids) for r in back.collect()) == want
    segments = [p for p in tmp_path.glob("segment-*.txt") if "lost" not in p.name]
    heads = [tuple(map(int, p.read_text().split("\n")[0].split())) for p in segments]
    assert sum(t for _, t in heads) == len(want) and {d for d, _ in heads} == {9, 1}
    assert segments[0].read_text().split("\n")[3].endswith(" ")


def test_postings_of_nothing(spark, tmp_path):
    postings.register(spark)
    spark.createDataFrame([], "term string, ids array<long>").write.format("postings").mode("append").save(str(tmp_path / "x"))
    assert spark.read.format("postings").load(str(tmp_path / "x")).count() == 0


def test_index_sees_new_documents(spark, tmp_path):
    folder = tmp_path / "documents.parquet"
    text = lambda w: f"{w} " * 30
    add = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(folder))
    ids = lambda q: sorted(r.doc_id for r in boolean.search(*search_queries.search_index(spark, str(tmp_path)), q).collect())
    add([(1, text("alpha beta")), (2, text("beta"))])
    assert ids("beta") == [1, 2] and ids("NOT alpha") == [2]
    key = (spark.sparkContext.applicationId, str(tmp_path))
    first = search_queries._SAVED[key][1]
    assert ids("alpha") == [1] and search_queries._SAVED[key][1] == first  # nothing is built anew
    add([(3, text("alpha")), (4, text("gamma"))])
    assert ids("alpha") == [1, 3] and ids("NOT alpha") == [2, 4] and ids("beta OR gamma") == [1, 2, 4]
    assert search_queries._SAVED[key][1][0] == first[0] and len(search_queries._SAVED[key][1]) == 2
    shutil.rmtree(folder)
    add([(9, text("gamma"))])
    assert ids("gamma") == [9] and ids("alpha") == []


def test_texts_with_nulls(spark, tmp_path):
    rows = [(1, "a\nb\tc"), (2, ""), (3, None), (None, "x"), (None, None)]
    path = files.write_texts(spark.createDataFrame(rows, "id long, body string"), "id", "body", str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_texts(spark, path, "id long, body string").collect()), key=str) == sorted(rows, key=str)


def test_lists_are_shuffled_once(spark, monkeypatch):
    """Against plain counts, over many tasks; documents of equal ids are one; lists, not postings, are shuffled, and once."""
    texts = [(i % 37, " ".join(f"word{(i * k) % 11} the" for k in range(i % 9))) for i in range(400)] + [(None, "lost word1"), (50, None), (51, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    want = {}
    for i, t in texts:
        for w in (t or "").split() if i is not None else []:
            want.setdefault(w, {}).setdefault(i, 0)
            want[w][i] += 1
    monkeypatch.setattr(boolean, "GATHER", 50)
    plain = spark.createDataFrame([(t, 0, [i], [n]) for t, x in sorted(want.items()) for i, n in sorted(x.items(), reverse=True)] * 2, boolean.LIST_SCHEMA)
    rows = plain.orderBy("term").toArrow().to_batches(max_chunksize=9)
    twice = [r for b in boolean._merged(iter(rows)) for r in b.to_pylist()]
    assert {r["term"]: dict(zip(r["ids"], r["freqs"], strict=True)) for r in twice} == {t: {i: 2 * n for i, n in x.items()} for t, x in want.items()} and len(twice) == len(want)
    for parts in (1, 3):
        found = boolean.posting_lists(docs, parts)
        got = {}
        for r in found.collect():
            assert r.ids == sorted(set(r.ids)) and not set(r.ids) & set(got.get(r.term, {}))
            got.setdefault(r.term, {}).update(zip(r.ids, r.freqs, strict=True))
        assert got == want
        plan = boolean.posting_lists(docs, parts)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan


def test_evaluation_shuffles_its_terms_alone(spark):
    plan = search_queries.eval_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_listed_terms_leave_a_text_once(spark):
    plan = catalogue.queries()["posting_lists"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct(" in plan


def _lists(lists):
    columns = [pa.array([f"t{i}" for i in range(len(lists))]), pa.array(range(len(lists)), pa.int32()), *(pa.array([x[k] for x in lists], pa.list_(pa.int64())) for k in (0, 1))]
    return pa.RecordBatch.from_arrays(columns, boolean.LIST_COLUMNS)


def test_packed_lists(monkeypatch):
    """Any ids and counts come back; lists are unpacked in pieces, however large their batch is."""
    own = np.random.default_rng(1).integers(-(2**62), 2**62, 300)
    lists = [([-5, 3, 2**62, 2**63 - 1], [1, 200, 2**40, 1]), ([-(2**63), 2**63 - 1], [5, 1]), ([7], [1]), (sorted(own.tolist()), [1] * 300), *(([i], [i]) for i in range(1, 40))]
    for size in (1, 64, 1 << 20):
        monkeypatch.setattr(boolean, "UNPACK_BYTES", size)
        for batch in (_lists(lists), _lists(lists).slice(1, 2), _lists(lists).slice(0, 0)):
            pieces = list(boolean._unpacked(boolean._packed(batch)))
            assert [r for p in pieces for r in p.to_pylist()] == batch.to_pylist()
            assert len(pieces) > 30 or size > 1 or batch.num_rows < 5
    wide = _lists([(list(range(3, 9000, 3)), [1] * 2999)])
    assert boolean._packed(wide).nbytes * 7 < wide.nbytes


def test_stems_meet_once_and_packed(spark):
    lists = boolean.posting_lists(spark.createDataFrame(TEXTS, "doc_id long, text string"), 2)
    plan = stems.stem_lists(lists, stems.dictionary(lists, stem_en.lexeme))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= boolean.BATCH_BYTES


def test_postings_go_by_batches(tmp_path, monkeypatch):
    """Segments are written and read by Arrow batches, and closed by the entry that fills them."""
    monkeypatch.setattr(postings, "SEGMENT_BYTES", 40)
    writer = postings.Writer(str(tmp_path), 3)
    assert isinstance(writer, DataSourceArrowWriter)
    batch = pa.RecordBatch.from_pydict({"term": [f"t{i}" for i in range(30)], "ids": [[i, -i] for i in range(30)]}, postings.ARROW_SCHEMA)
    made = writer.write(iter([batch]))
    writer.commit([made])
    assert all(40 <= (tmp_path / f).stat().st_size - 4 < 60 for f in made.files[:-1]) and len(made.files) > 5
    reader = postings.Reader(str(tmp_path), 25)
    got = [b for r in reader.partitions() for b in reader.read(r)]
    assert all(isinstance(b, pa.RecordBatch) for b in got)
    assert sorted((x["term"], x["ids"]) for b in got for x in b.to_pylist()) == sorted((f"t{i}", [i, -i]) for i in range(30))


def test_listed_terms_come_from_lists(spark, tmp_path):
    """The query makes the lists by the operator, in parts, and gives the SQL's rows; terms of documents without an id are listed too."""
    texts = [(i % 30 if i < 60 else None, f"The word{i % 7} word{i % 7} of Slash/und number{i} " + "filler " * 9) for i in range(64)] + [(90, None), (91, "short one")]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.queries()["posting_lists"](spark, str(tmp_path))
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    own = duckdb.connect()
    own.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = own.sql(catalogue.oracle_sql()["posting_lists"]).fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str) and any(n == 0 for _, n, _, _ in want)
