"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Numbers, names and units become typed placeholders, so a question that was copied with other parameters has the template of the
original. Windows of WINDOW template words are hashed and joined with those of the benchmark. Words of an item that lie in a
window found in the document, over the item's words, are the similarity. Where windows hold placeholders, the values that
fill them are compared along each alignment of item and document: one value of the item must always stand for one and the
same value of the document. Alignments that break this are chance likenesses of form, and their windows don't count.

Windows with fewer than MIN_LITERAL words that aren't placeholders count along alignments that cover MIN_LITERAL such words in all
(all of the item's, if it has fewer) and whose values agree. Windows of placeholders alone aren't looked for in documents, but
compared where other windows have found an alignment. Items of placeholders alone, and those of fewer than WINDOW words, are looked
for word by word, the short ones whole.

An item's first word may be a name by its form where other words come before it; it is then found in either form, but only as
the same word.

Defined cases: a null text or one without words never leaks; an item without words is none, and an item that is repeated counts once; documents with equal ids are told apart by a hash of
the text, and rows that repeat both count once; empty tables give an empty result. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 5
MIN_LITERAL = 3
SIMILARITY = 0.8

# Units that may follow a number.
UNITS = """
mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz ounce ounces lb lbs pound
pounds ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week
weeks month months year years percent dollar dollars cent cents euro euros mph kmh degree degrees kb mb gb tb watt watts volt volts
""".split()

#: Stand for a name, a number and a unit.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
NAME_AT = r"(?<=[\p{L}\p{N},;]\s)\p{Lu}\p{Ll}+"
NUMBER_AT = r"\d(?<![\p{L}\p{N}]\d)\d*(?:[.,:/-]\d+)*(?![\p{L}\p{N}])"
UNIT_AT = rf"(?<={NUMBER}\s)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
PUNCTUATION = rf"[^\p{{L}}\p{{N}}\s{NAME}-{UNIT}]+"


def tokens(text: Column) -> Column:
    """Words in lower case without punctuation; a word of punctuation alone is none."""
    bare = F.btrim(F.regexp_replace(F.lower(text), PUNCTUATION, ""), F.lit(C.SPACE_CHARS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))


def template(text: Column) -> Column:
    """The text with placeholders; it has as many tokens as the text itself."""
    named = F.regexp_replace(plain(text), NAME_AT, NAME)
    return F.regexp_replace(F.regexp_replace(named, NUMBER_AT, NUMBER), UNIT_AT, UNIT)


def plain(text: Column) -> Column:
    """The text without characters that stand for something."""
    return F.regexp_replace(text, f"[{NAME}-{UNIT}]", " ")


def windows(t: str, width: int = WINDOW) -> Column:
    """Hash of each run of `width` tokens."""
    n = F.greatest(F.size(t) - (width - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice(t, F.lit(k + 1), n).alias(str(k)) for k in range(width)])
    return F.transform(runs, lambda x: F.xxhash64(*[x[str(k)] for k in range(width)]))


def with_windows(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `t` (template tokens) and `h` (hash of each window)."""
    df = df.withColumn("t", tokens(template(F.col(text))))
    return df.withColumn("h", windows("t"))


def is_slot(token: Column) -> Column:
    return token.isin(NAME, NUMBER, UNIT)


def item_table(benchmark: DataFrame) -> DataFrame:
    """Items: item_id, t (template), words, n_item_words, n_literal (words that aren't placeholders), and inner (the first word as
    it is after other words, where that differs)."""
    items = with_windows(benchmark.where("text is not null and item_id is not null").select("item_id", "text").dropDuplicates())
    items = items.withColumns({"words": tokens(plain(F.col("text"))), "n_item_words": F.size("t")})
    inner = F.get(tokens(template(F.concat(F.lit("x "), F.ltrim(F.col("text"))))), F.lit(1))
    items = items.withColumn("inner", F.when(inner != F.get("t", F.lit(0)), inner))
    return items.withColumn("n_literal", F.size(F.filter("t", lambda x: ~is_slot(x)))).drop("text")


def item_windows(items: DataFrame) -> DataFrame:
    """Windows of the items: item_id, ipos, mark, n_item_words, n_literal, slots (places of placeholders in the window), strong (it
    has words enough that aren't), sought (it has any), loose (places of the item's windows that aren't sought), and first (the
    item's first word, which a document must have as well, in a window that has its inner form; null in others)."""
    base = ["item_id", "t", "n_item_words", "n_literal"]
    rows = items.select(*base, F.posexplode("h").alias("ipos", "mark"), F.lit(None).cast("string").alias("first"))
    inner = F.concat(F.array("inner"), F.slice("t", 2, WINDOW - 1))
    turned = items.where(f"inner is not null and n_item_words >= {WINDOW}").withColumn("u", inner)
    mark = F.xxhash64(*[F.get("u", F.lit(k)) for k in range(WINDOW)])
    rows = rows.union(turned.select(*base, F.lit(0), mark, F.get("words", F.lit(0))))
    rows = rows.withColumn("slots", F.filter(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: is_slot(F.get("t", F.col("ipos") + k)))).drop("t")
    rows = rows.withColumns({"strong": F.size("slots") <= WINDOW - MIN_LITERAL, "sought": F.size("slots") < WINDOW})
    loose = rows.groupBy(F.col("item_id").alias("__item")).agg(F.collect_set(F.when(~F.col("sought"), F.col("ipos"))).alias("loose"))
    return rows.join(loose, F.col("item_id") == F.col("__item")).drop("__item")


def covered(places: Column, width: Column | None = None) -> Column:
    """Words that windows starting at these places cover."""
    width = F.lit(WINDOW) if width is None else width
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, p: F.struct(
        (a["n"] + F.least(width, p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def scored(matches: DataFrame, similarity: float) -> DataFrame:
    """(document, item) pairs whose similarity reaches the threshold, if all windows in `loose` are taken as found."""
    pairs = matches.groupBy("doc_id", "th", "item_id", "n_item_words").agg(
        F.sort_array(F.array_union(F.collect_set("ipos"), F.first("loose"))).alias("places"), F.max(F.size("slots") + F.size("loose") + F.col("first").isNotNull().cast("int")).alias("slots")
    )
    pairs = pairs.withColumn("covered_words", covered(F.col("places")))
    pairs = pairs.withColumn("similarity", F.col("covered_words") / F.col("n_item_words"))
    return pairs.where(F.col("similarity") >= similarity).drop("places")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and item that leaked into it: doc_id, th (hash of the text), item_id, n_item_words,
    covered_words, similarity, and n_slots (values compared along the fullest alignment)."""
    items = C.stage(item_table(benchmark), "items")
    marks = C.stage(item_windows(items), "item-windows")
    sought = marks.where("sought").withColumnRenamed("mark", "__mark").drop("sought")
    rows = with_windows(docs.select("doc_id", "text", F.xxhash64("text").alias("th")))
    # the outer form, because Spark guards the other one by a filter that would compute the windows a second time
    rows = rows.select("doc_id", "th", F.posexplode_outer("h").alias("dpos", "mark"))
    met = rows.join(C.bounded_broadcast(sought, sought.count()), F.col("mark") == F.col("__mark")).drop("__mark", "mark")
    met = C.stage(met, "matches")
    pairs = C.stage(scored(met, similarity), "leaks")
    found = pairs.where("slots = 0").select("doc_id", "th", "item_id", "n_item_words", "covered_words", "similarity", F.lit(0).cast("long").alias("n_slots"))
    open_pairs = pairs.where("slots > 0").select("doc_id", "th", "item_id")
    if not open_pairs.isEmpty():
        found = found.union(_checked(docs, items, marks, met, open_pairs, similarity))
    exact = items.where(VERBATIM)
    if exact.isEmpty():
        return found
    return found.union(_verbatim(docs, exact, similarity))


#: Items that no window finds.
VERBATIM = f"n_item_words between 1 and {WINDOW - 1} or n_item_words >= {WINDOW} and n_literal = 0"


def _verbatim(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Pairs with items that are looked for by windows of their own words, of WINDOW words or of all if they are fewer."""
    items = items.withColumn("width", F.least(F.lit(WINDOW), "n_item_words"))
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    marked = lambda w: F.transform(windows("words", w), lambda h: F.xxhash64(F.lit(w), h))
    parts = [items.where(F.col("width") == w).select("item_id", "n_item_words", "width", F.posexplode(marked(w)).alias("ipos", "__mark")) for w in widths]
    marks = parts[0]
    for part in parts[1:]:
        marks = marks.union(part)
    marks = C.stage(marks, "item-words")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), tokens(plain(F.col("text"))).alias("words"))
    rows = rows.select("doc_id", "th", F.explode_outer(F.array_distinct(F.concat(*[marked(w) for w in widths]))).alias("mark"))
    met = rows.join(C.bounded_broadcast(marks, marks.count()), F.col("mark") == F.col("__mark"))
    pairs = met.groupBy("doc_id", "th", "item_id", "n_item_words", "width").agg(F.sort_array(F.collect_set("ipos")).alias("places"))
    pairs = pairs.withColumn("covered_words", covered(F.col("places"), F.col("width")))
    pairs = pairs.withColumn("similarity", F.col("covered_words") / F.col("n_item_words")).where(F.col("similarity") >= similarity)
    return pairs.select("doc_id", "th", "item_id", "n_item_words", "covered_words", "similarity", F.lit(0).cast("long").alias("n_slots"))


def _checked(docs: DataFrame, items: DataFrame, marks: DataFrame, met: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs with placeholders, scored again by the alignments whose values are consistent."""
    key = lambda df: (F.col("doc_id").eqNullSafe(df["__id"])) & (F.col("th") == df["__th"])
    ids = [F.col("doc_id").alias("__id"), F.col("th").alias("__th")]
    align = ["doc_id", "th", "item_id", "shift"]
    want = C.stage(pairs.select(*ids).distinct(), "slot-docs")
    want = C.bounded_broadcast(want, want.count())
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    text = text.join(want, key(want), "left_semi").dropDuplicates(["doc_id", "th"])
    text = C.stage(text.select(*ids, tokens(plain(F.col("text"))).alias("words"), tokens(template(F.col("text"))).alias("t")), "slot-texts")
    renamed = pairs.select(*ids, F.col("item_id").alias("__item"))
    mine = met.join(renamed, key(renamed) & (F.col("item_id") == F.col("__item")), "left_semi").withColumn("shift", F.col("dpos") - F.col("ipos"))
    turned = mine.where("first is not null").join(text.drop("t"), key(text)).where(F.get("words", "dpos") == F.col("first"))
    mine = mine.where("first is null").union(turned.select(mine.columns))
    mine = C.stage(mine.drop("dpos", "loose", "first"), "alignments")
    loose = marks.where("not sought").select("item_id", "ipos", "slots")
    if not loose.isEmpty():
        asked = items.select("item_id", F.col("t").alias("item_t"))
        more = mine.select(*align, "n_item_words", "n_literal").distinct().join(loose, "item_id").join(asked, "item_id").join(text, key(text))
        at = lambda k: F.col("ipos") + k
        agree = lambda k: F.get("t", at(k) + F.col("shift")) == F.get("item_t", at(k))
        more = more.where(F.forall(F.sequence(F.lit(0), F.lit(WINDOW - 1)), agree)).withColumn("strong", F.lit(False))
        mine = C.stage(mine.union(more.select(mine.columns)), "all-alignments")
    slots = mine.where("size(slots) > 0").select(*align, "strong", F.explode(F.transform("slots", lambda k: F.col("ipos") + k)).alias("at"))
    slots = slots.groupBy(*align, "at").agg(F.max("strong").alias("strong"))
    item_words = items.select("item_id", F.col("words").alias("item_words"))
    values = slots.join(text.drop("t"), key(text)).join(item_words, "item_id").select(
        *align, "strong", F.get("item_words", F.col("at")).alias("asked"), F.get("words", F.col("at") + F.col("shift")).alias("found")
    )
    firm = F.when(F.col("strong"), F.col("found"))
    by_value = values.groupBy(*align, "asked").agg(F.min("found").alias("a"), F.max("found").alias("b"), F.min(firm).alias("c"), F.max(firm).alias("d"))
    said = by_value.groupBy(*align).agg(
        F.max(F.coalesce(F.col("c") != F.col("d"), F.lit(False))).alias("broken"), F.count("c").alias("n_firm"),
        F.max(F.col("a") != F.col("b")).alias("weak_broken"), F.count("*").alias("n_all"),
    )
    # literal words that an alignment covers; one strong window has enough
    literal = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(WINDOW - 1)), "slots"), lambda k: F.col("ipos") + k)
    seen = mine.select(*align, "strong", "n_literal", literal.alias("literal")).groupBy(*align).agg(
        F.max("strong").alias("any_strong"), F.size(F.array_distinct(F.flatten(F.collect_set("literal")))).alias("n"), F.first("n_literal").alias("of")
    )
    seen = seen.select(*align, (F.col("any_strong") | (F.col("n") >= F.least(F.lit(MIN_LITERAL), "of"))).alias("enough"))

    def told(df: DataFrame, other: DataFrame) -> DataFrame:
        other = other.withColumnsRenamed({"doc_id": "__id", "th": "__th", "item_id": "__item", "shift": "__shift"})
        same = key(other) & (F.col("item_id") == F.col("__item")) & (F.col("shift") == F.col("__shift"))
        return df.join(other, same, "left").drop("__id", "__th", "__item", "__shift")

    good = told(told(mine, said), seen).withColumn("weak_good", F.col("enough") & ~F.coalesce("weak_broken", F.lit(False)))
    good = good.where((F.col("strong") & ~F.coalesce("broken", F.lit(False))) | (~F.col("strong") & F.col("weak_good")))
    n_slots = F.coalesce(F.when(F.col("weak_good"), F.col("n_all")).otherwise(F.col("n_firm")), F.lit(0).cast("long"))
    counts = good.groupBy("doc_id", "th", "item_id").agg(F.max(n_slots).alias("n_slots"))
    counts = counts.select(*ids, F.col("item_id").alias("__item"), "n_slots")
    none = F.array().cast("array<int>").alias("loose")
    first = F.lit(None).cast("string").alias("first")
    out = scored(good.select("doc_id", "th", "item_id", "n_item_words", "ipos", "slots", none, first), similarity)
    out = out.join(counts, key(counts) & (F.col("item_id") == F.col("__item")))
    return out.select("doc_id", "th", "item_id", "n_item_words", "covered_words", "similarity", "n_slots")


#: Fewest words of an item that takes a document away: an item of one word or a few stands in very many texts by chance.
LEAST_WORDS = WINDOW


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without a leak of an item of `least_words` words or more, with the columns of the input. Shorter items are
    reported by `leaks` alone."""
    found = leaks(docs, benchmark, similarity).where(F.col("n_item_words") >= least_words)
    bad = C.stage(found.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct(), "leaked")
    bad = C.bounded_broadcast(bad, bad.count())
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    held = held.withColumns({"__doc": F.col("__row.doc_id"), "__hash": F.xxhash64("__row.text")})
    return held.join(bad, held["__doc"].eqNullSafe(bad["__id"]) & (held["__hash"] == bad["__th"]), "left_anti").select("__row.*")
