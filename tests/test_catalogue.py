"""Links against the standard library, tokens against its HMAC, edits of a catalogue and removed accounts against plain loops."""

import base64
import hashlib
import hmac
import json
import random
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from strataflow.functions import links, tokens
from strataflow.operators import catalogue
from strataflow.plans.catalogue_queries import parse_article
from strataflow.session import spread

BASES = ["http://a/b/c/d;p?q", "https://Ex.org", "https://u@ex.org:8080/x/?k=/../z#f/..", "http://ex.org/a/./b/../c", "http://ex.org/ü/y"]
# the references of RFC 3986, 5.4, but for those that older rules read in another way
REFS = """g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h
g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x mailto:z@q.org //h.org/p/../q ß/.. //h.org""".split()


def test_links(spark):
    rows = [(b, r) for b in BASES for r in [*REFS, ""]]
    got = spark.createDataFrame(rows, "base string, ref string").select("base", "ref", links.resolve(F.col("base"), F.col("ref")).alias("x")).collect()
    for r in got:
        want = urljoin(r.base, r.ref) if r.ref else r.base.partition("#")[0]
        if r.ref == "//h.org/p/../q":
            want = r.base.partition(":")[0] + "://h.org/q"  # the library keeps dots after a host, the RFC doesn't
        if r.base == "http://ex.org/a/./b/../c" and r.ref[:1] in ("", "?", "#"):
            continue  # the page's own path stays as it is
        assert r.x == want, (r.base, r.ref)
    none = spark.createDataFrame([("http://a/b", None), (None, "c")], "base string, ref string")
    assert [r.x for r in none.select(links.resolve(F.col("base"), F.col("ref")).alias("x")).collect()] == [None, None]


def test_hosts_and_rules(spark):
    urls = [*BASES, "//x.org/y", "/p", "", "https://news.EX.org/de/1?x=/en", "https://ex.org.evil/de", "https://evil.org/?ex.org/de"]
    got = spark.createDataFrame([(u,) for u in [*urls, None]], "u string").select("u", links.host(F.col("u")).alias("h"), links.follows(F.lit("ex.org"), F.col("u"), ["/de", "/en"]).alias("f")).collect()
    for r in got[:-1]:
        parts = urlsplit(r.u)
        assert r.h == (parts.hostname or "") and r.f == ("ex.org" in r.h and ("/de" in parts.path or "/en" in parts.path)), r.u
    assert got[-1].h is None and not got[-1].f


def test_references(spark):
    html = """<a href="/x?a=1&amp;b=2">1</a> <A class=q HREF = '/y'>2</A><a name="z">3</a><link href="/css"><a href="">4</a><abbr href="/no">"""
    got = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(F.transform(links.references(F.col("h")), links.unquoted).alias("x")).collect()
    assert [r.x for r in got] == [["/x?a=1&b=2", "/y"], None, []]


@pytest.mark.parametrize("key", [b"k", b"", b"x" * 64, b"long key " * 20])
def test_tokens(spark, key):
    enc = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    claims = ['{"user":1,"exp":100}', '{"user":"ü?>","exp":101}', "{}", json.dumps({"pad": "?" * 200, "exp": 99})]
    want = {}
    for c in claims:
        body = f"{enc(tokens.HEADER.encode())}.{enc(c.encode())}"
        want[c] = f"{body}.{enc(hmac.new(key, body.encode(), hashlib.sha256).digest())}"
    df = spark.createDataFrame([(c,) for c in claims], "c string")
    got = {r.c: r for r in df.withColumn("t", tokens.issue(F.col("c"), key)).select("c", "t", tokens.claims(F.col("t"), key).alias("back"), tokens.state(F.col("t"), key, F.lit(100)).alias("s")).collect()}
    assert {c: r.t for c, r in got.items()} == want and all(r.back == c for c, r in got.items())
    assert [got[c].s for c in claims] == ["expired", "valid", "refused", "expired"]
    good = want[claims[1]]
    head, body, sign = good.split(".")
    none = f"{enc(b'{\"alg\":\"none\"}')}.{body}"
    bad = [None, "", ".", "..", good[:-2], good + ".", f"{head}.{body}", f"{head}.{body}A.{sign}", f"{none}.", f"{none}.{enc(hmac.new(key, none.encode(), hashlib.sha256).digest())}", f"{head}.{body}.", "a.b.c.d"]
    got = spark.createDataFrame([(b,) for b in bad], "t string").select(tokens.claims(F.col("t"), key).alias("c"), tokens.state(F.col("t"), key, F.lit(0)).alias("s")).collect()
    assert all(r.c is None and r.s == "refused" for r in got)


@pytest.mark.parametrize("seed", range(2))
def test_edits(spark, seed):
    rng = random.Random(seed)
    names = {i: f"n{i}" for i in range(1, 30)}
    bridge = {(rng.randrange(40), rng.randrange(1, 30)) for _ in range(60)}
    asked = [(rng.choice([None, *range(60)]), rng.choice([None, *[f"n{i}" for i in range(1, 50)]])) for _ in range(40)]
    dropped = {rng.randrange(60) for _ in range(15)}
    live = {(a, n) for a, n in asked if a is not None and n is not None and a not in dropped}
    ids = {n: i for i, n in names.items()}
    for n in sorted({n for _, n in live} - set(ids)):
        ids[n] = max(ids.values()) + 1
    want = {(a, i) for a, i in bridge if a not in dropped and a not in {x for x, _ in live}} | {(a, ids[n]) for a, n in live}
    frames = (spark.createDataFrame(list(names.items()), "id long, name string"), spark.createDataFrame(list(bridge), "article long, id long"),
              spark.createDataFrame(asked * 2, "article long, name string"), spark.createDataFrame([(d,) for d in dropped] * 2, "article long"))
    left, whole = catalogue.edit(*frames)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(want)
    assert {(r.id, r.name) for r in left.collect()} == {(i, n) for n, i in ids.items() if i in {x for _, x in want}}
    left, whole = catalogue.edit(*(f.limit(0) for f in frames))
    assert left.count() == whole.count() == 0
    left, whole = catalogue.edit(frames[0], frames[1], frames[2].limit(0), frames[3].limit(0))
    assert whole.count() == len(bridge) and {r.id for r in left.collect()} == {i for _, i in bridge}


@pytest.mark.parametrize("frequent", [1, 40, 1000])
def test_frequent_names(spark, frequent):
    """Names that many articles ask for are joined where their rows are, and give the rows that the others give."""
    rng = random.Random(3)
    asked = [(i, "often" if i % 3 else f"n{rng.randrange(20)}") for i in range(300)]
    known = [(7, "often"), (5, "often"), (9, "unused"), *((100 + i, f"n{i}") for i in range(20))]
    least = {n: min(i for i, m in known if m == n) for _, n in known}
    got = catalogue.numbered(spark.createDataFrame(asked, "article long, name string").repartition(4), spark.createDataFrame(known, "id long, name string"), frequent)
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, least[n]) for a, n in asked)


def test_spread(spark, tmp_path):
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    held = {n: spark.conf.get(n) for n in names}
    spark.range(5000).write.parquet(str(tmp_path / "t.parquet"))
    size = sum(f.stat().st_size for f in (tmp_path / "t.parquet").glob("*.parquet"))
    spread(spark, str(tmp_path), "t", size=size)
    assert spark.conf.get(names[0]) == held[names[0]]
    spread(spark, str(tmp_path), "t", size=-(-size // 50))
    assert int(spark.conf.get(names[0])) in (49, 50) and all(int(spark.conf.get(n)) == -(-size // 50) for n in names[1:])
    for n, v in held.items():
        spark.conf.set(n, v)


def test_accounts(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user long")
    articles = spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 9)], "article long, uploaded_by long")
    liked = spark.createDataFrame([(1, 11), (2, 10), (2, 13), (3, 10)], "user long, article long")
    a, b, c = catalogue.remove_accounts(users, articles, liked, spark.createDataFrame([(2,), (2,), (None,), (7,)], "user long"))
    rows = lambda x: sorted((tuple(r) for r in x.collect()), key=str)
    assert rows(a) == [(1,), (3,)] and rows(b) == [(10, 1), (11, None), (12, None), (13, 9)] and rows(c) == [(1, 11), (3, 10)]


def test_articles(spark):
    pages = [
        (1, '<h1> A <em>b</em> </h1><title>T</title><a class="x author-link"> ann </a><time datetime="2025-01-02"></time><article><p>One.</p><script>x</script>Two</article>'),
        (2, '<title>T</title><meta name="author" content="bob"><article> </article><div class="content">body</div>'),
        (3, "<h1></h1><article>x</article>"), (4, "<h1>no body</h1>"), (5, None), (6, ""),
    ]
    got = parse_article(spark.createDataFrame(pages, "i long, html string"), "i").collect()
    assert [tuple(r) for r in sorted(got)] == [(1, "A b", "ann", "2025-01-02", "One. Two"), (2, "T", "bob", "unknown", "body"), (3, "untitled", "unknown", "unknown", "x")]
