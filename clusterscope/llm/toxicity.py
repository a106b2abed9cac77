"""Toxicity by a counterfactual-regularised classifier.

Features of a text are its words and their first 4, 5 and 6 letters, so unseen
forms of a known insult count too.  The features that tell labelled toxic texts
from clean ones are found by counts over a bounded sample of labelled rows;
a logistic regression is fitted on them.  For every labelled text that names a
group of people, copies with another group's name and with no name are made,
and the squared differences of the scores (before the sigmoid) are added to the loss: a name
that happens to occur in toxic texts gets no weight of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterscope.llm.linear import Sparse, fit, sigmoid
from clusterscope.llm.texts import row_runs, text_bytes
from clusterscope.session import cut, ship_package

SAMPLE_ROWS = 16_000         # labelled rows that the model is fitted on, at most (about)
FEATURES = 4096              # features of the model, at most
LEAST_TOXIC = 4              # toxic sample texts in which a feature must occur
LEAST_RATIO = 8.0            # of its rates in toxic and in clean sample texts
PULL, RIDGE = 4.0, 5e-6
RIDGE_B = 4e-3               # on the intercept: one sure word must be able to outweigh it
TOXIC_WEIGHT = 2.0           # of a toxic sample text against a clean one, as there are fewer
THRESHOLD = 0.7
RUN_BYTES = 1 << 18          # of sample texts whose features are held at once
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Names of groups of people that are exchanged for each other.
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino",
    "african", "european", "american", "mexican", "chinese", "indian", "german", "french", "spanish", "turkish", "arab", "jewish",
    "muslim", "christian", "hindu", "buddhist", "atheist", "catholic", "immigrants", "refugees", "disabled", "deaf", "blind", "old", "young",
    "frauen", "männer", "schwule", "juden", "muslime", "christen", "ausländer", "flüchtlinge", "behinderte",
    "femmes", "hommes", "homosexuels", "juifs", "musulmans", "chrétiens", "étrangers", "réfugiés", "handicapés",
    "mujeres", "hombres", "homosexuales", "judíos", "musulmanes", "cristianos", "extranjeros", "refugiados", "discapacitados",
)


def word_features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


def feature_counts(words: set[str]) -> Counter:
    """How many different words of a text have each feature."""
    return Counter(f for w in words for f in word_features(w))


def _values(counts: dict[str, int]) -> dict[str, float]:
    """A feature's value: 1 for one word, and less for every further one."""
    return {f: math.log2(1 + n) for f, n in counts.items()}


def text_words(text: str) -> set[str]:
    """Distinct lower-case words; long texts in stretches, so that no list of all words is made."""
    found: set[str] = set()
    for start in range(0, len(text), 1 << 20):
        stretch = text[start:start + (1 << 20)]
        if start + (1 << 20) < len(text):            # up to the next gap between words
            tail = re.match(r"[^\W\d_]*", text[start + (1 << 20):start + (1 << 20) + 1000])
            stretch += tail.group()
        if start:
            stretch = re.sub(r"^[^\W\d_]+", "", stretch) if re.match(r"[^\W\d_]", text[start - 1]) else stretch
        found.update(WORD.findall(stretch.lower()))
    return found


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are kept for testing: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, features with their counts, identity terms) of every sample text; a feature is its name."""
    names = set(IDENTITY_TERMS)
    for batch in batches:
        _, offsets = text_bytes(batch.column("text"))
        for first, last in row_runs(offsets, RUN_BYTES):
            part = batch.slice(first, last - first)
            features, counts, ends, groups = [], [], [0], []
            for text in part.column("text"):
                words = text_words(text.as_py() or "")
                counted = feature_counts(words)
                features += counted.keys()
                counts += counted.values()
                ends.append(len(features))
                groups.append(sorted(words & names))
            pairs = pa.StructArray.from_arrays([pa.array(features, pa.string()), pa.array(counts, pa.int32())], names=["feature", "n"])
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                                              pa.array(groups, pa.list_(pa.string()))], names=["toxic", "features", "groups"])


class Model:
    """Weights by feature name, and the intercept."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept
        self.known: dict[str, tuple[str, ...]] = {}

    def score(self, text: str) -> float:
        counts: dict[str, int] = {}
        for word in text_words(text):
            features = self.known.get(word)
            if features is None:
                if len(self.known) > 50_000:
                    self.known.clear()
                features = self.known[word] = tuple(f for f in word_features(word) if f in self.weights)
            for f in features:
                counts[f] = counts.get(f, 0) + 1
        return float(sigmoid(self.intercept + math.fsum(self.weights[f] * v for f, v in _values(counts).items())))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, pull: float = PULL) -> Model:
    """Fit on about ``sample_rows`` rows (all, if fewer) whose labels are not held out, picked by a hash of doc_id."""
    ship_package(docs.sparkSession)
    own = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = min(1.0, sample_rows / max(own.count(), 1))
    picked = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Copies of a text would count its chance words many times: one row for each text.
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")
             .groupBy("text").agg(F.max("toxic").alias("toxic")))
    sample = cut(texts.mapInArrow(_sample_features, "toxic int, features array<struct<feature:string,n:int>>, groups array<string>"))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        rate = toxic / max(toxic + clean, 1)
        return Model({}, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    counts = (sample.select("toxic", F.explode("features.feature").alias("feature")).groupBy("feature")
              .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where(f"t >= {LEAST_TOXIC}"))
    odds = F.log(((F.col("t") + 0.5) / toxic) / ((F.col("c") + 0.5) / clean))
    chosen = [r["feature"] for r in counts.withColumn("gain", odds * F.sqrt("t")).where(odds >= math.log(LEAST_RATIO))
              .orderBy(F.desc("gain"), "feature").limit(features).collect()]
    names = {f: i for i, f in enumerate(chosen)}
    for term in IDENTITY_TERMS:
        for f in word_features(term):
            names.setdefault(f, len(names))
    listed = sample.sparkSession.createDataFrame([(f,) for f in names], "feature string")
    numbered = sample.withColumn("row", F.monotonically_increasing_id())
    hits = (cut(numbered.select("row", "toxic", "groups", "features")))
    found = (hits.select("row", F.inline("features")).join(F.broadcast(listed), "feature")
             .groupBy("row").agg(F.collect_list(F.struct("feature", "n")).alias("hit")))
    rows = hits.select("row", "toxic", "groups").join(found, "row", "left").select("toxic", "groups", "hit").collect()
    x, differences = [], []
    for r in rows:
        here = {h["feature"]: h["n"] for h in r["hit"] or ()}
        x.append(sorted((names[f], v) for f, v in _values(here).items()))
        differences += _counterfactuals(here, r["groups"], names)
    y = np.array([r["toxic"] for r in rows], float)
    w, b = fit(Sparse(x, len(names)), y, np.where(y == 1, TOXIC_WEIGHT, 1.0), ridge=RIDGE, ridge_b=RIDGE_B, pairs=Sparse(differences, len(names)), pull=pull, rounds=1000)
    return Model({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-9}, float(b))


def _counterfactuals(here: dict[str, int], groups: list[str], names: dict[str, int]) -> list[list[tuple[int, float]]]:
    """Feature differences between a text and its copies with a group's name exchanged (for the
    next three on the list) or left out."""
    out = []
    for term in groups:
        at = IDENTITY_TERMS.index(term)
        for other in (None, *(IDENTITY_TERMS[(at + k) % len(IDENTITY_TERMS)] for k in (1, 2, 3))):
            there = Counter(here)
            there.subtract(word_features(term))
            if other and other not in groups:
                there.update(word_features(other))
            a, b = _values(here), _values({f: n for f, n in there.items() if n > 0})
            out.append([(names[f], d) for f in sorted({*a, *b} & names.keys()) if (d := a.get(f, 0.0) - b.get(f, 0.0))])
    return out


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "toxicity"])
    return run


def with_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column toxicity (0 to 1, replaced if there is one); a null text scores like an empty one."""
    ship_package(docs.sparkSession)
    rows = docs.drop("toxicity").withColumn("text", F.col("text").cast("string"))
    schema = rows.withColumn("toxicity", F.lit(0.0)).schema
    return rows.mapInArrow(_scored(model), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``threshold``) of every row of ``docs`` (doc_id, text).

    Only the text enters a score.  ``labels`` has doc_id and toxic (0 or 1; other values are
    passed over; a doc_id that is toxic in any row is toxic).  Without labels of both kinds
    every text gets the labelled rate (0 without labels).  Rows without a doc_id are scored and not held out; repeated
    rows are scored each; other columns are ignored.
    """
    model = train(docs, labels, **options)
    rows = with_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
                       (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def _clean(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for first, last in row_runs(offsets, 4 * RUN_BYTES):
                part = batch.slice(first, last - first)
                yield part.filter(pa.array([model.score(t.as_py() or "") < threshold for t in part.column("text")], pa.bool_()))
    return run


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, with its columns, that score under ``threshold``."""
    model = train(docs, labels, **options)
    return docs.mapInArrow(_clean(model, threshold), docs.schema)
