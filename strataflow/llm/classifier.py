"""Quality classifier: regularised quadratic discriminant analysis on document statistics.

Each whole text is measured by FEATURES, which are transformed so that they spread evenly. Class means and covariances come from
two aggregates over all labelled training rows; each covariance is shrunk towards the average of both classes and towards its
diagonal. The score is the logistic of the difference of the two log densities, from Mahalanobis distances by Cholesky
factors that each task computes once.

Training rows are those whose crc32(doc_id as text) mod FOLDS is not HELD_OUT. Labels, lang, source and doc_id are never inputs.

Defined cases: a null or empty text is measured as an empty one and gets a score; a null doc_id is a training id, but no label
joins it; repeated labels of a document count once (the largest); repeated documents are rows of their own; where the training
rows lack a class, every score is the part of label 1 among them, or a half if there are none; an empty table gives an
empty result. Only doc_id, text and the label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FOLDS, HELD_OUT = 4, 2
CUT = 0.7
SHRINK_POOLED, SHRINK_DIAGONAL, RIDGE = 0.2, 0.1, 0.02
#: A standardised statistic beyond this many deviations is held there.
CLIP = 6.0
#: Log-density differences are divided by this before the logistic, since statistics aren't independent.
TEMPERATURE = 2.0

#: Weight, in words and in characters, of the usual value that a share is drawn towards.
USUAL_WORDS, USUAL_CHARS = 30.0, 150.0

FEATURES = ["length", "word_length", "symbols", "punctuation", "capitals", "digits", "distinct", "short", "stops", "line_words"]


def statistics(docs: DataFrame) -> DataFrame:
    """Stage doc_id, held_out and the array x of transformed statistics of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("s"), C.words(F.col("text")).alias("w"))
    left = lambda pattern: F.length(F.regexp_replace("s", pattern, "")).cast("double")
    n = F.greatest(F.size("w"), F.lit(1)).cast("double")
    letters = F.greatest(left(r"\P{L}+"), F.lit(1.0))
    chars = F.greatest(F.length("s"), F.lit(1)).cast("double")
    # a share of few words or characters is drawn towards a usual value, so that short texts aren't taken for odd ones
    share = lambda count, of, usual, weight: F.log1p((count + usual * weight) / (of + weight) * 100.0)
    values = {
        "length": F.log1p(F.size("w").cast("double")),
        "word_length": F.log1p((letters + 5.0 * USUAL_WORDS) / (n + USUAL_WORDS)),
        "symbols": share(left(r"[^#*$%&|<>]+"), chars, 0.0, USUAL_CHARS),
        "punctuation": share(left(r"[\p{L}\p{N}\s]+"), chars, 0.02, USUAL_CHARS),
        "capitals": share(left(r"\P{Lu}+"), letters, 0.03, USUAL_CHARS),
        "digits": share(left(r"\P{N}+"), chars, 0.0, USUAL_CHARS),
        "distinct": F.log((F.size(F.array_distinct("w")) + 0.8 * USUAL_WORDS) / (n + USUAL_WORDS)),
        "short": share(F.size(F.filter("w", lambda x: F.octet_length(x) <= 3)), n, 0.3, USUAL_WORDS),
        "stops": share(left(r"[^.!?]+"), n, 0.1, USUAL_WORDS),
        "line_words": F.log1p((n + 30.0) / (left(r"[^\n]+") + 2.0)),
    }
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0))
    x = F.array(*[F.coalesce(values[k], F.lit(0.0)) for k in FEATURES])
    return C.stage(rows.select("doc_id", (fold == HELD_OUT).alias("held_out"), x.alias("x")), "statistics")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> dict | float:
    """The model (means, Cholesky factors, log priors), or a constant score where a class is missing."""
    k = len(FEATURES)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    rows = C.stage(stats.where("not held_out").join(known, "doc_id").select("x", "y"), "training")
    cols = [F.col("x")[i] for i in range(k)]
    got = rows.agg(F.count("*"), F.coalesce(F.avg("y"), F.lit(0.5)), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    n, ones = got[0], got[1]
    if not n or ones in (0.0, 1.0):
        return float(ones)
    center, scale = np.array(got[2 : 2 + k]), np.maximum(np.array(got[2 + k :]), 1e-6)
    z = [F.least(F.lit(CLIP), F.greatest(F.lit(-CLIP), (c - float(m)) / float(s))) for c, m, s in zip(cols, center, scale, strict=True)]
    rows = rows.select("y", *[v.alias(f"z{i}") for i, v in enumerate(z)])
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = rows.groupBy("y").agg(
        F.count("*").alias("n"), *[F.avg(f"z{i}").alias(f"m{i}") for i in range(k)], *[F.avg(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"c{i}_{j}") for i, j in pairs]
    )
    means, covs, counts = {}, {}, {}
    for row in sums.collect():  # two rows
        m = np.array([row[f"m{i}"] for i in range(k)])
        c = np.zeros((k, k))
        for i, j in pairs:
            c[i, j] = c[j, i] = row[f"c{i}_{j}"] - m[i] * m[j]
        means[row.y], covs[row.y], counts[row.y] = m, c, row.n
    pooled = sum(covs[y] * counts[y] for y in covs) / n
    model = {"center": center, "scale": scale, "mean": {}, "cov": {}, "prior": {}}
    for y in (0, 1):
        c = (1 - SHRINK_POOLED) * covs[y] + SHRINK_POOLED * pooled
        c = (1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(k)
        model["mean"][y], model["cov"][y], model["prior"][y] = means[y], c, float(np.log(counts[y] / n))
    return model


def whitening(model: dict | float) -> dict:
    """The inverse of each class's Cholesky factor, which turns deviations into Mahalanobis ones."""
    return {} if isinstance(model, float) else {y: np.linalg.inv(np.linalg.cholesky(model["cov"][y])) for y in (0, 1)}


def log_density(model: dict, factors: dict, z: np.ndarray, y: int) -> np.ndarray:
    factor = factors[y]
    d = (z - model["mean"][y]) @ factor.T
    return model["prior"][y] + np.log(np.diag(factor)).sum() - 0.5 * (d * d).sum(axis=1)


def scores(model: dict | float, factors: dict, x: np.ndarray) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(x), model)
    z = np.clip((x - model["center"]) / model["scale"], -CLIP, CLIP)
    gap = (log_density(model, factors, z, 1) - log_density(model, factors, z, 0)) / TEMPERATURE
    return 1.0 / (1.0 + np.exp(-np.clip(gap, -500, 500)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    C.ready_python(docs.sparkSession)
    stats = statistics(docs)
    model = fit(stats, labels, label)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = whitening(model)
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(model, factors, x))], ["doc_id", "held_out", "score"])

    out = stats.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
