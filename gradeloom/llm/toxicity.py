"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are densities of a lexicon learned from the labelled rows, its nearness to second-person words, and rates of
capitals, punctuation and obfuscation (digits or signs for letters, letters repeated or spaced out).
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, masked, rows_in, saved, unmasked

#: Second-person words of the languages served.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch ti tú usted ustedes vuestro".split())
#: Signs that stand for letters.
LOOKALIKE = str.maketrans("0134578@$!", "oleastbasi")
NEAR = 5
LEXICON = 200

FEATURES = [
    "log_words",
    "strong_rate",
    "strong_count",
    "strong_kinds",
    "weight_rate",
    "weight_top",
    "hidden_count",
    "hidden_rate",
    "near_you_count",
    "near_you_rate",
    "you_rate",
    "capital_rate",
    "shout_rate",
    "punctuation_rate",
    "exclaim_rate",
    "digit_rate",
    "stretch_rate",
    "spaced_rate",
]

_EDGE = ".,;:!?\"'()[]{}<>|#*%&$-_«»¿¡…"
_STRETCH = re.compile(r"(\w)\1{2,}")
_SPACED = re.compile(r"(?<!\w)\w(?:[ .\-_*]\w){3,}(?!\w)")
_HIDDEN = re.compile(r"[^\W\d_][\d@$!*._\-]+[^\W\d_]|[\d@$!]+[^\W\d_]{2,}")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_PUNCTUATION = re.compile(r"[^\w\s]")
_DIGIT = re.compile(r"\d")


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]  # log odds of words
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    base: float  # share of label 1, used where there is nothing to learn from


def words_of(text: str) -> list[str]:
    return [bare for w in text.lower().split() if (bare := w.strip(_EDGE))]


def _plain(word: str) -> str:
    """The word behind look-alike signs, inner signs and stretched letters."""
    bare = re.sub(r"[^\w]|_", "", word.translate(LOOKALIKE))
    return re.sub(r"(.)\1{2,}", r"\1", bare)


def features(text: str | None, lexicon: dict[str, float], strong: frozenset[str]) -> list[float]:
    """Dense features of a whole text; of a null or empty one, zeros."""
    text = text or ""
    raw = text.split()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    words = [w.strip(_EDGE) for w in text.lower().split()]
    hits = [i for i, w in enumerate(words) if w in strong]
    hidden = [i for i, w in enumerate(words) if w not in strong and _HIDDEN.search(w) and _plain(w) in strong]
    spaced = _SPACED.findall(text.lower())
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if you and (hits or hidden):
        places = np.asarray(you)
        found = np.asarray(sorted(hits + hidden))
        after = np.searchsorted(places, found)
        gap = np.minimum(np.abs(found - places[np.minimum(after, len(places) - 1)]), np.abs(found - places[np.maximum(after - 1, 0)]))
        near = int((gap <= NEAR).sum())
    weights = [lexicon[w] for w in words if w in lexicon]
    size = len(text)
    return [
        math.log1p(n),
        len(hits) / n,
        float(len(hits)),
        float(len({words[i] for i in hits})),
        sum(weights) / n,
        max(weights, default=0.0),
        float(len(hidden)),
        len(hidden) / n,
        float(near),
        near / n,
        len(you) / n,
        len(_UPPER.findall(text)) / size,
        sum(w.isupper() and len(w) > 2 for w in raw) / n,
        len(_PUNCTUATION.findall(text)) / size,
        text.count("!") / size,
        len(_DIGIT.findall(text)) / size,
        len(_STRETCH.findall(text)) / n,
        float(len(spaced)) / n,
    ]


def featurized(docs: DataFrame, lexicon: dict[str, float], text_col: str, as_col: str) -> DataFrame:
    """`docs` with an array of the features of its text."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, frozenset(w for w, v in lexicon.items() if v >= 1.0)))

    @F.pandas_udf("array<double>")
    def rate(text: pd.Series) -> pd.Series:
        weights, strong = shared.value
        return pd.Series([features(t, weights, strong) for t in text], index=text.index, dtype=object)

    return docs.withColumn(as_col, rate.asNondeterministic()(F.col(text_col)))


def learn_lexicon(rows: DataFrame, size: int = LEXICON, least: int = 3) -> dict[str, float]:
    """Words by the log odds of the contexts they stand in: those furthest from the base rate in standard errors. rows: text, label.

    A word between the same two neighbours counts once per label, so the words of a document that has many copies gain nothing by it.
    """

    def count(frames):
        for frame in rows_in(frames):
            seen: set[tuple[str, int, int]] = set()
            for text, label in zip(frame["text"], frame["label"], strict=True):
                words = words_of(text or "")
                seen.update((w, zlib.crc32(f"{a} {b}".encode("utf-8", "replace")), int(label)) for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False))
            yield pd.DataFrame(list(seen), columns=["word", "context", "label"])

    contexts = rows.mapInPandas(count, "word string, context long, label int").distinct()
    words = contexts.groupBy("word").agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos")).persist()
    totals = words.agg(F.sum("neg"), F.sum("pos")).first()
    neg, pos = int(totals[0] or 0), int(totals[1] or 0)
    best = []
    if neg and pos:
        odds = F.log((F.col("pos") + 0.5) / (pos - F.col("pos") + 0.5)) - F.log((F.col("neg") + 0.5) / (neg - F.col("neg") + 0.5))
        error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
        best = words.where(F.col("pos") >= least).withColumns({"odds": odds, "z": odds / error}).where("odds >= 0.7 and z >= 2.5").orderBy(F.desc("z"), "word").limit(size).collect()
    words.unpersist()
    return {r["word"]: float(r["odds"]) for r in best}


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 12_000,
    trees: int = 30,
    depth: int = 4,
    seed: int = 7,
) -> ToxicityModel:
    """Learn from documents with a label (0 or 1; other labels and nulls are left out).

    `max_rows` bounds the sample of labelled rows. Three quarters of it teach the lexicon and the trees, the last quarter calibrates
    them and was seen by neither. An id labelled more than once counts with its largest label.
    Fewer than two classes: a model that gives the share of label 1 to all.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = bounded_sample(known, "id", max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = saved(texts.join(F.broadcast(known), "id"), "labelled")
    part = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(4))
    counts = rows.groupBy((part == 3).alias("last"), "label").count().collect()
    by = {(r["last"], r["label"]): r["count"] for r in counts}
    total = sum(by.values())
    base = sum(v for (_, label), v in by.items() if label == 1) / total if total else 0.0
    if not by.get((False, 0)) or not by.get((False, 1)):
        return ToxicityModel({}, None, None, base)
    lexicon = learn_lexicon(rows.where(part < 3).select("text", "label"))
    made = saved(featurized(rows, lexicon, "text", "f").select("f", F.col("label").cast("double").alias("label"), (part == 3).alias("last")), "features")
    vectors = made.select(_vector("f").alias("features"), "label", "last")
    learn = vectors.where(~F.col("last")).coalesce(2).persist()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.15, subsamplingRate=1.0, minInstancesPerNode=5, seed=seed).fit(learn)
    learn.unpersist()
    steps = None
    if by.get((True, 0)) and by.get((True, 1)):
        margin = _margin(model, vectors.where("last")).select("margin", "label").coalesce(1)
        steps = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margin)
    return ToxicityModel(lexicon, model, steps, base)


def _vector(column: str):
    return array_to_vector(F.col(column))


def _margin(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("margin", vector_to_array("probability")[1])


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", as_col: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1. Null and empty texts are scored by their (zero) features; repeated rows alike.

    Other columns are carried whatever their names; one named `as_col` gives way to the score. An empty table gives an empty result.
    """
    rows, text = masked(docs, text_col)
    return unmasked(_scored(rows, model, text).withColumnRenamed("__score", as_col), docs.columns, as_col)


def _scored(rows: DataFrame, model: ToxicityModel, text_col: str) -> DataFrame:
    if model.trees is None:
        return rows.withColumn("__score", F.lit(float(model.base)))
    out = featurized(rows, model.lexicon, text_col, "__f").withColumn("features", _vector("__f"))
    out = _margin(model.trees, out)
    if model.steps is not None:
        out = model.steps.transform(out.drop("prediction")).withColumn("__score", F.col("prediction"))
    else:
        out = out.withColumn("__score", F.col("margin"))
    return out.select(*rows.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__score"))).alias("__score"))


def reject(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """`docs` without those that score `threshold` or more, in the columns it came with, whatever their names."""
    rows, text = masked(docs, text_col)
    return unmasked(_scored(rows, model, text).where(F.col("__score") < threshold), docs.columns)
