"""Reservations against a plain loop; English stems; scripts of INSERT statements; ranks over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from strataflow.functions.stem_en import stem
from strataflow.functions.stem_ru import VOWELS, regions
from strataflow.functions.stem_ru import stem as stem_ru
from strataflow.operators import ranking, reservations
from strataflow.sources import seeds


@pytest.mark.parametrize("seed", range(2))
def test_reservations(spark, seed):
    rng = random.Random(seed)
    held = {f"a{i}": float(rng.randrange(5, 40)) for i in range(6)}
    asked = {s: {f"a{rng.randrange(7)}": float(rng.randrange(1, 12)) for _ in range(2)} for s in range(60)}
    left, want = dict(held), {}
    for s, draws in asked.items():
        want[s] = all(a in left and x <= left[a] for a, x in draws.items())
        for a, x in draws.items() if want[s] else ():
            left[a] -= x
    rows = [(s, a, x, held.get(a)) for s, draws in asked.items() for a, x in draws.items()]
    df = spark.createDataFrame(rows, "seq long, account string, amount double, held double")
    assert {r.seq: r.accepted for r in reservations.decide(df).collect()} == want
    assert reservations.decide(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("word", "want"),
    [(x.split(":")[0], x.split(":")[1]) for x in """caresses:caress ponies:poni ties:tie cats:cat agreed:agre plastered:plaster motoring:motor hopping:hop hoping:hope
    relational:relat conditional:condit vietnamization:vietnam happy:happi generously:generous running:run rivers:river rational:ration adjustment:adjust adoption:adopt
    controlling:control probate:probat national:nation knightly:knight skies:sky dying:die proceed:proceed consignment:consign knocked:knock""".split()],
)
def test_english_stems(word, want):
    assert stem(word) == want


def test_russian_regions():
    """Places by a walk along the letters: after the first vowel; after two others in a row; and once more from there."""
    rng = random.Random(8)
    for _ in range(3000):
        word = "".join(rng.choice("аеиоубвгдлпмнстрьюя") for _ in range(rng.randrange(1, 14)))
        last, first, run, found = len(word), None, 0, 0
        for i, c in enumerate(word):
            if first is None:
                first = i + 1 if c in VOWELS else None
                continue
            run = 0 if c in VOWELS else run + 1
            if run >= 2:
                found += 1
                # one more that is no vowel, right after the first pair, makes the second
                run = 1
                if found == 2:
                    last = i + 1
                    break
        assert regions(word) == ((0, 2 * len(word)) if first is None else (2 * first, 2 * last)), word


@pytest.mark.parametrize(("word", "want"), [("деятельностью", "деятельност"), ("молодостью", "молодост"), ("сь", ""), ("ь", "ь")])
def test_russian_stems(word, want):
    assert stem_ru(word) == want


def test_inserts(spark):
    script = "create table t (a int);\nINSERT INTO t (a, b) VALUES (1, 'x;''y'), (2, null); insert into t (a, b) values (3, 'back\\slash');"
    assert seeds.statements("a; 'b;c' d;;") == ["a", "'b;c' d"]
    got = seeds.read_inserts(spark, script)
    assert list(got) == ["t"] and {r.a: r.b for r in got["t"].collect()} == {1: "x;'y", 2: None, 3: "back\\slash"}
    assert seeds.jdbc_options("jdbc:x", "t", "id", (1, 9), 4)["numPartitions"] == "4" and "partitionColumn" not in seeds.jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError, match="bound"):
        seeds.jdbc_options("jdbc:x", "t", "id", (9, 1))


def test_running(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"), F.when(F.col("id") % 9 > 0, F.col("id") * 1.5).alias("y")).repartition(6)
    got = sorted(ranking.running(df, [F.col("x")], {"s": F.col("y")}, following="x").collect(), key=lambda r: r.x)
    total = 0.0
    for i, r in enumerate(got):
        total += r.y or 0.0
        assert r.place == i + 1 and r.next_x == (i + 1 if i < 499 else None) and (r.s or 0.0) == pytest.approx(total)
    assert ranking.ranked(df.limit(0), F.col("x")).count() == 0
