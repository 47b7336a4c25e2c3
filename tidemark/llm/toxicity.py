"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled rows are a bounded sample (at most ``train_rows`` per class, chosen by hash).  All of them serve the lexicon, the trees and
the calibration, out of fold: a row's features come from the lexicon of the other folds, the trees learn from such features, and
the calibration from scores of trees that did not see the row's fold, so that no row is judged by words it taught.  New texts meet
the lexicon and the trees of all rows.  The lexicon holds words and word beginnings whose log-odds between the classes are clear of
chance, given how many were tried.  Features: densities and peaks of lexicon words and beginnings, distance to a second-person
word, capitals, punctuation, repeated letters and signs inside words, lexicon words that appear only once such signs are read as
letters, length.

Defined cases: null and empty texts have all features 0 and get the model's score for that; without labelled rows every
score is 0; with one class only, every score is that class; a label other than 0 or 1 is ignored; a document labelled
twice counts as toxic if one label says so; rows that repeat are scored alike; texts are read whole, however long.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, materialise

# fixed values: second-person words
SECOND_PERSON = {
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre",
    "tú", "ti", "usted", "ustedes", "vosotros", "tus",
}
# fixed values: signs that stand for letters
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
BEGINNINGS = (4, 5, 6)
FEATURES = (
    "log_words", "word_density", "word_peak", "word_hits", "start_density", "start_peak", "start_hits", "near_you", "capitals", "shouted", "marks", "marked_runs",
    "inner_signs", "repeats", "hidden_hits", "hidden_peak",
)


def words_of(text: str) -> list[str]:
    """Runs of characters other than white space, in lower case, without signs at their ends."""
    return [w for w in (x.strip(".,;:?!\"'()[]{}<>«»„“”‚‘’…-*_") for x in text.lower().split()) if w]


def starts_of(word: str) -> list[str]:
    return [f"{word[:n]}^" for n in BEGINNINGS if len(word) > n]


@dataclasses.dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: object | None  # a fitted tree ensemble
    calibration: object | None
    constant: float = 0.0


class Weights(dict):
    """Per token, as it stands in a text: 0, or what the lexicon says of it.  Filled as tokens come, within a bound."""

    def __init__(self, lexicon: dict[str, float], most: int = 500_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, token: str):
        import re

        get = self.lexicon.get
        words = words_of(token)
        word = words[0] if words else ""
        value = get(word, 0.0)
        start = max([get(f"{word[:k]}^", 0.0) for k in BEGINNINGS if len(word) > k], default=0.0)
        hidden = 0.0
        if word and not value and not word.isalpha():
            hidden = get(re.sub(r"[^\w]|_", "", word.translate(SIGNS)), 0.0)
        you = word in SECOND_PERSON
        said = (value, start, hidden, you) if value or start or hidden or you else 0
        if len(self) >= self.most:
            self.clear()
        self[token] = said
        return said


def features_of(text: str, weights: Weights) -> list[float]:
    import re
    from bisect import bisect_left

    raw = text.split()
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    told = [(i, x) for i, x in enumerate(map(weights.__getitem__, raw)) if x]
    hits, starts, hidden = ([x[j] for _, x in told if x[j]] for j in range(3))
    you = [i for i, x in told if x[3]]
    near = sum(1 for i, x in told if x[0] and you[(j := bisect_left(you, i - 5)) : j + 1] and you[j] <= i + 5)
    letters = len(re.findall(r"[^\W\d_]", text))
    capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    shouted = len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b", text))
    return [
        math.log1p(n), sum(hits) / n, max(hits, default=0.0), math.log1p(len(hits)), sum(starts) / n, max(starts, default=0.0), math.log1p(len(starts)), near / n,
        capitals / max(1, letters), shouted / n, (text.count("!") + text.count("?")) / n, len(re.findall(r"[!?]{2,}", text)) / n,
        len(re.findall(r"[^\W\d_][@$!|*0-9]+[^\W\d_]", text)) / n, len(re.findall(r"([^\W\d_])\1\1", text)) / n, math.log1p(len(hidden)), max(hidden, default=0.0),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], keep: Sequence[Column], names: Sequence[str], text: Column) -> DataFrame:
    """The columns of ``keep`` (called ``names``) and ``features``, an array."""
    rows = docs.select(*(c.alias(n) for c, n in zip(keep, names, strict=True)), text.cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        import pyarrow as pa

        weights = Weights(shared.value)
        for batch in batches:
            made = [features_of(t or "", weights) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(made, pa.list_(pa.float64()))], names=[*names, "features"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])
    return bounded_batches(rows).mapInArrow(run, f"{schema}, features array<double>")


def learn_lexicons(sample: DataFrame, folds: int, least_docs: int = 4, most: int = 20_000) -> list[dict[str, float]]:
    """For each fold the lexicon of all other rows, and last that of all rows.  ``sample``: ``text``, ``label``, ``fold``.

    A lexicon holds words and beginnings that are typical of label 1: the log-likelihood ratio of their shares of documents is one
    that chance gives to fewer than one of all terms tried.  Terms are counted once; a fold's counts are taken off the whole.
    """

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            seen: dict = {}
            for text, label, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = set(words_of(text or ""))
                kept = seen.setdefault(fold, (Counter(), Counter()))[label]
                kept.update(words)
                kept.update({s for w in words for s in starts_of(w)})
            # a term that no toxic text of the batch holds can still matter; clean counts of all terms are needed
            rows = [(t, fold, bad[t], good[t]) for fold, (good, bad) in sorted(seen.items()) for t in sorted(good.keys() | bad.keys())]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["term", "fold", "bad", "good"])

    sizes = {(r["fold"], r["label"]): r["n"] for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    terms = bounded_batches(sample.select("text", "label", "fold")).mapInArrow(count, "term string, fold int, bad long, good long")
    of = lambda name, k: F.sum(F.when(F.col("fold") == k, F.col(name)).otherwise(0)).alias(f"{name}{k}")
    terms = terms.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), *(of(n, k) for n in ("bad", "good") for k in range(folds)))
    terms = materialise(terms.where(F.col("bad") >= least_docs), "toxicity-terms")
    found = []
    for k in range(folds + 1):
        n_bad, n_good = (sum(n for (fold, label), n in sizes.items() if label == side and fold != k) for side in (1, 0))
        counts = terms.select("term", *((F.col(x) - F.col(f"{x}{k}") if k < folds else F.col(x)).alias(x) for x in ("bad", "good"))).where(F.col("bad") >= least_docs)
        bad, good, n = F.col("bad"), F.col("good"), F.col("bad") + F.col("good")
        odds = F.log((bad + 0.5) / (n_bad + 1)) - F.log((good + 0.5) / (n_good + 1))
        part = lambda seen, size: F.when(seen > 0, seen * F.log(seen * (n_bad + n_good) / (n * max(1, size)))).otherwise(0.0)  # noqa: E731, B023
        least_g = 2 * math.log(max(2, counts.count()))
        scored = counts.withColumn("odds", odds).withColumn("g", 2 * (part(bad, n_bad) + part(good, n_good))).where((F.col("g") >= least_g) & (F.col("odds") >= 1.5))
        found.append({r["term"]: float(r["odds"]) for r in scored.orderBy(F.desc("g"), "term").limit(most).collect()})  # a bounded list: the lexicon's best terms
    return found


def train_toxicity(
    docs: DataFrame, labels: DataFrame, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    train_rows: int = 6000, rounds: int = 15, depth: int = 3, folds: int = 4,
) -> ToxicityModel:
    """Learn from documents whose id satisfies ``allowed`` (a condition on ``labels``).  ``train_rows`` bounds each class."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    known = labels.where(allowed & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    rank = F.xxhash64(F.col("id").cast("string"), F.lit("toxicity"))
    known = known.where(F.col("id").isNotNull()).withColumn("rank", rank)
    picked = known.where("label = 1").orderBy("rank", "id").limit(train_rows).unionByName(known.where("label = 0").orderBy("rank", "id").limit(train_rows))
    picked = materialise(picked, "toxicity-labels")  # at most two times train_rows rows of 20 bytes, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("fold")), F.lit(folds)).cast("int")
    sample = materialise(texts.join(F.broadcast(picked), "id").withColumn("fold", fold), "toxicity-sample")
    classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return ToxicityModel({}, None, None, float(max(classes, default=0)))
    *others, lexicon = learn_lexicons(sample, folds)
    made = [with_features(sample.where(F.col("fold") == k), other, [F.col("label").cast("double"), F.col("fold")], ["label", "fold"], F.col("text")) for k, other in enumerate(others)]
    ready = materialise(functools.reduce(DataFrame.unionByName, made).coalesce(2), "toxicity-features").select("label", "fold", array_to_vector("features").alias("features"))
    learner = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=1, minInstancesPerNode=5)
    checked = []
    for half in range(2):  # trees of each half of the folds score the other half
        fit, check = ready.where(F.col("fold") % 2 == half), ready.where(F.col("fold") % 2 != half)
        if fit.select("label").distinct().count() == 2:
            checked.append(learner.fit(fit).transform(check).select("label", vector_to_array("probability")[1].alias("p")))
    trees = learner.fit(ready)
    calibration = None
    if len(checked) == 2 and min(classes.values()) >= 20:
        calibration = IsotonicRegression(labelCol="label", featuresCol="p").fit(checked[0].unionByName(checked[1]))
    return ToxicityModel(lexicon, trees, calibration)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: Sequence[Column], names: Sequence[str], *, text_col: str = "text", bar: float = 0.7) -> DataFrame:
    """The columns of ``keep``, then ``score`` (0 to 1) and ``predicted`` (1 if score >= ``bar``)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if model.trees is None:
        rows = docs.select(*(c.alias(n) for c, n in zip(keep, names, strict=True)), F.lit(float(model.constant)).alias("score"))
    else:
        made = with_features(docs, model.lexicon, keep, names, F.col(text_col)).withColumn("features", array_to_vector("features"))
        rows = model.trees.transform(made).select(*names, vector_to_array("probability")[1].alias("p"))
        if model.calibration is None:
            rows = rows.withColumnRenamed("p", "score")
        else:
            rows = model.calibration.transform(rows).select(*names, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= bar).cast("int"))
