"""Quality rules with a verdict on the host (DataFrame functions only).

Every document is measured on its whole text and tested against RULES. Failures of each rule are then counted by host (the
document's source). A host's failure rate is shrunk towards the rate of all hosts by a beta prior whose two parameters are
fitted to the hosts' own rates by moments, so that a host with few documents is not judged on them alone. For each rule the
prior also says how far hosts differ: its mean and deviation. A host is `rejected`, with all its documents, if a shrunken rate
is above HOST_LIMIT, or above half and REJECT_SD deviations from the mean; it is `suspect` if one is SUSPECT_SD deviations above
the mean. A document goes if it fails a base rule, if its host is rejected, or if its host is suspect and it fails any rule.
Where hosts are alike the prior is so strong that no host stands out, and the documents are judged by the base rules alone.

Defined cases: a null or blank text has no words and fails; a null source is a host of its own; repeated rows are rows of
their own; an empty table gives an empty result. Only doc_id, text and source are read for the measures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The base rules reject a document by themselves; the others count against its host.
BASE_RULES = {"few_words": "n_words < 50", "repeats": "n_repeat_words * 100 > n_words * 50"}
HOST_RULES = {
    "symbols": "n_symbols * 100 > word_chars * 5",
    "lines": "n_dup_lines * 100 > n_lines * 30",
    "word_length": "word_chars > n_words * 9 or word_chars < n_words * 3",
}
RULES = BASE_RULES | HOST_RULES
#: A host is rejected if, after shrinking, more than this part of its documents fails a rule.
HOST_LIMIT = 0.8
#: Deviations above the mean of all hosts from which a host is suspect, and from which it is rejected if most of it fails.
SUSPECT_SD, REJECT_SD = 1.5, 3.0

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_repeat_words(df: DataFrame, w: str, out: str) -> DataFrame:
    """Add `out`: words that lie in a 3-word window whose words occur as a window twice or more in the text.

    Windows are compared by 64-bit hashes. Sorting them with their places brings equal ones together; the places of those
    that have an equal neighbour, in order, then cover min(3, distance to the next) words each. Each step is a column of
    its own because Spark evaluates what a lambda refers to anew for every element, unless it is a column.
    """
    width = F.greatest(F.size(w) - 2, F.lit(0))
    zipped = F.arrays_zip(F.slice(w, 1, width), F.slice(w, F.lit(2), width), F.slice(w, F.lit(3), width))
    df = df.withColumn("__h", F.transform(zipped, lambda x: F.xxhash64(x["0"], x["1"], x["2"])))
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__p", F.when(twice, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    near = lambda x, k: F.coalesce(F.get("__p", k)["h"] == x["h"], F.lit(False))
    twins = F.filter("__p", lambda x, k: F.when(k > 0, near(x, k - 1)).otherwise(F.lit(False)) | near(x, k + 1))
    df = df.withColumn("__i", F.sort_array(F.transform(twins, lambda x: x["i"])))
    gaps = F.transform("__i", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__i", k + 1) - p, F.lit(3))))
    return df.withColumn(out, F.aggregate(gaps, F.lit(0), lambda a, g: a + g).cast("long")).drop("__h", "__p", "__i")


def measures(docs: DataFrame) -> DataFrame:
    """Add the measures, base_failed, and failed (of each rule, in order) to every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w = C.words(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(C.SPACE_CHARS)) != "")
    out = docs.select("*", w.alias("__w"), lines.alias("__l"))
    out = out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        }
    )
    out = with_repeat_words(out, "__w", "n_repeat_words")
    base = F.expr(" or ".join(f"({x})" for x in BASE_RULES.values()))
    return out.withColumns({"base_failed": base, "failed": F.array(*[F.expr(x) for x in RULES.values()])}).drop("__w", "__l", "n_lines")


def host_verdicts(measured: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Per host and rule: documents, failures, the prior's mean and deviation, the shrunken rate, and the verdict."""
    by_rule = [F.struct(F.lit(k).alias("rule"), F.sum(F.col("failed")[i].cast("long")).alias("failures")) for i, k in enumerate(RULES)]
    hosts = measured.groupBy("source").agg(F.count("*").alias("documents"), F.array(*by_rule).alias("by_rule"))
    hosts = C.stage(hosts.select("source", "documents", F.inline("by_rule")), "hosts")
    prior = beta_priors(hosts)
    m, strength = (F.element_at(F.create_map(*[F.lit(x) for k, v in prior.items() for x in (k, v[i])]), F.col("rule")) for i in (0, 1))
    hosts = hosts.withColumns({"mean": m, "strength": strength})
    rate = (F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("documents") + F.col("strength"))
    hosts = hosts.withColumns({"rate": rate, "deviation": F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))})
    far = (F.col("rate") - F.col("mean")) / F.col("deviation")
    verdict = F.when((F.col("rate") > host_limit) | ((far > REJECT_SD) & (F.col("rate") > 0.5)), "rejected").when(far > SUSPECT_SD, "suspect").otherwise("good")
    return hosts.withColumn("verdict", verdict)


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """For each rule the mean of a beta distribution of failure rates and its strength in documents, from moments. The spread that
    binomial chance alone would give is taken off first; where nothing is left, the hosts are alike and the prior is worth as
    much as all their documents. One row a rule comes to the driver."""
    p = F.col("failures") / F.col("documents")
    d = F.col("documents").cast("double")
    sums = [F.sum(d), F.sum("failures"), F.count("*"), F.sum(d * d), F.sum(d * p), F.sum(d * p * p)]
    out = dict.fromkeys(RULES, (0.5, 1.0))
    for rule, total, failures, n, squares, first, second in hosts.groupBy("rule").agg(*sums).collect():
        mean = (failures + 0.5) / (total + 1.0)
        strength = 1.0
        if n > 1:
            between = second - 2 * mean * first + mean * mean * total
            # E[between] = mean (1 - mean) (n - 1 + (total - squares / total - (n - 1)) rho), rho the correlation within a host
            excess = between / (mean * (1 - mean)) - (n - 1)
            room = total - squares / total - (n - 1)
            rho = excess / room if room > 0 else 0.0
            strength = 1.0 / min(max(rho, 1.0 / (total + 1.0)), 0.5) - 1.0
        out[rule] = mean, strength
    return out


def judge(measured: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Add host (the verdict on it) and kept to staged measures."""
    found = host_verdicts(measured, host_limit).where("verdict <> 'good'")
    found = found.groupBy(F.col("source").alias("__host")).agg(F.min("verdict").alias("host"))  # rejected comes before suspect
    found = C.stage(found, "bad-hosts")
    found = C.bounded_broadcast(found, found.count())
    joined = measured.join(found, measured.source.eqNullSafe(found["__host"]), "left").withColumn("host", F.coalesce("host", F.lit("good")))
    gone = F.col("base_failed") | (F.col("host") == "rejected") | ((F.col("host") == "suspect") & F.exists("failed", lambda x: x))
    return joined.withColumn("kept", ~gone).drop("__host")


def rated(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept and host (good, suspect or rejected) of every document; each text is read once."""
    narrow = C.stage(measures(docs.select("doc_id", "source", "text")).drop("text"), "measures")
    return judge(narrow).select("doc_id", *MEASURES, "base_failed", "kept", "host")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents kept, with the columns of the input (names that clash with the measures included).

    Each text is measured once: rows are checkpointed with their flags, those that a base rule rejects without their columns,
    and the hosts' verdicts, which are few, meet them where they lie. No text is shuffled."""
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), "text", "source")
    row = F.when(~F.col("base_failed"), F.col("__row")).alias("__row")
    measured = C.checkpointed(measures(held).select(row, "source", "base_failed", "failed"))
    return judge(measured).where("kept").select("__row.*")
