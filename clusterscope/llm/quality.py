"""Quality by co-training two classifiers on two views of a document.

The *content* view is computed from the words and characters of the whole text;
the *page* view from the record around it: source, language, length and the layout of its lines.
Both start from a bounded sample of labelled rows.  In every round each view
labels a bounded sample of unlabelled rows, and its most confident ones of either
kind, in the labelled sample's proportion, join the other view's training set as
pseudo-labels of half weight.  Labelled rows that neither view was
trained on calibrate the two and weigh them against each other; the combined model scores all rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterscope.llm.linear import Dense, fit, sigmoid
from clusterscope.session import cut, ship_package

LABELLED_ROWS, UNLABELLED_ROWS = 9_000, 6_000     # sample bounds (about)
ROUNDS = 5
SHARE = 0.05                 # of the unlabelled sample that a view labels in a round
KEEP_FROM = 0.5
SOURCES, LANGS = 32, 8       # hash buckets
_SYMBOL = re.compile(r"[^\w\s.,;:'\"()?-]")
_STOPS = (".", "!", "?")


def content_view(text: str) -> list[float]:
    words = text.split()
    n = max(len(words), 1)
    chars = max(len(text), 1)
    counts = Counter(words)
    letters = [w for w in words if w.isalpha()]
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    symbols = len(_SYMBOL.findall(text))
    marked = sum(_SYMBOL.search(w) is not None for w in words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    top = counts.most_common(1)[0][1] if counts else 0
    spread = -sum(c / n * math.log(c / n) for c in counts.values()) / max(math.log(n + 1), 1)
    return [math.log1p(len(words)), len(counts) / n, spread, top / n, repeats / n, upper / n, marked / n, symbols / chars, len(letters) / n,
            sum(w.endswith(_STOPS) for w in words) / n, sum(w[0].isupper() for w in words) / n, sum(map(len, words)) / n / 10,
            sum(len(w) <= 3 for w in words) / n, sum(c.isdigit() for c in text) / chars, float(not words)]


def page_view(text: str, source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    lines = text.split("\n")
    n = len(lines)
    full = [x for x in lines if x.strip()]
    bucket = lambda value, size: [float(i == zlib.crc32((value or "").encode()) % size) for i in range(size)]
    said = len(text) if n_chars is None else n_chars
    return [math.log1p(max(said, 0)), float(said != len(text)), math.log1p(n), len(full) / n, math.log1p(len(text) / n),
            math.log1p(max(map(len, lines))), sum(len(x) < 40 for x in lines) / n, sum(x.rstrip().endswith(_STOPS) for x in lines) / n,
            len(set(lines)) / n, *bucket(source, SOURCES), *bucket(lang, LANGS)]


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content, page = [], []
        for text, source, lang, n_chars in zip(*(batch.column(c) for c in ("text", "source", "lang", "n_chars"))):
            text = text.as_py() or ""
            content.append(content_view(text))
            page.append(page_view(text, source.as_py(), lang.as_py(), n_chars.as_py()))
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(content, kind), pa.array(page, kind)],
                                         names=["doc_id", "label", "content", "page"])


VIEW_SCHEMA = "doc_id long, label int, content array<double>, page array<double>"


class View:
    """A logistic regression on standardised features and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._features(x)
        self.w, self.b = fit(Dense(z), y, weight, ridge=1e-3, rounds=200)

    def _features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([z, z * z])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._features(x) @ self.w + self.b


def _stack(logits: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    return fit(Dense(logits), y, ridge=1e-3, rounds=300)


class CoTrained:
    def __init__(self, labelled: tuple[np.ndarray, np.ndarray, np.ndarray], pool: tuple[np.ndarray, np.ndarray],
                 check: tuple[np.ndarray, np.ndarray, np.ndarray], rounds: int = ROUNDS, share: float = SHARE):
        """Views (content, page) with labels: to train on, unlabelled, and for calibration."""
        *own, y = labelled
        # what each view is trained on: its rows of the labelled sample and the other's pseudo-labels
        xs, ys, ws = [own[0], own[1]], [y, y], [np.ones(len(y))] * 2
        left = np.arange(len(pool[0]))
        good = max(1, round(share * len(left) * y.mean()))
        bad = max(1, round(share * len(left) * (1 - y.mean())))
        self.pseudo = [0, 0]
        for turn in range(rounds + 1):
            self.views = [View(x, t, w) for x, t, w in zip(xs, ys, ws)]
            if turn == rounds or len(left) < 4 * (good + bad):
                break
            taken: set[int] = set()
            for v in (0, 1):
                order = np.argsort(self.views[v].logit(pool[v][left]), kind="stable")
                chosen = np.concatenate([left[order[:bad]], left[order[len(order) - good:]]])
                labels = np.concatenate([np.zeros(bad), np.ones(good)])
                o = 1 - v
                xs[o], ys[o] = np.vstack([xs[o], pool[o][chosen]]), np.concatenate([ys[o], labels])
                ws[o] = np.concatenate([ws[o], np.full(len(labels), 0.5)])
                taken.update(chosen.tolist())
                self.pseudo[o] += len(labels)
            left = np.array([i for i in left if i not in taken], int)
        logits = np.stack([self.views[v].logit(check[v]) for v in (0, 1)], axis=1)
        self.weights, self.intercept = _stack(np.clip(logits, -15, 15), check[2])

    def score(self, content: np.ndarray, page: np.ndarray) -> np.ndarray:
        logits = np.stack([self.views[0].logit(content), self.views[1].logit(page)], axis=1)
        return sigmoid(np.clip(logits, -15, 15) @ self.weights + self.intercept)


def held_out(doc_id: Column) -> Column:
    """Labelled rows for calibration: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _documents(docs: DataFrame) -> DataFrame:
    at = {c.lower(): c for c in docs.columns}
    column = lambda name, kind: (F.col(at[name]) if name in at else F.lit(None)).cast(kind).alias(name)
    return docs.select(column("doc_id", "long"), column("text", "string"), column("source", "string"), column("lang", "string"), column("n_chars", "long"))


def co_train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> CoTrained | float:
    """The co-trained model, or the rate of good labels where a sample holds fewer than two of a kind.

    Samples are picked by a hash of doc_id: about ``labelled_rows`` rows for training and half as
    many for calibration, and ``unlabelled_rows`` rows without a label (fewer, if there are no more)."""
    ship_package(docs.sparkSession)
    own = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
           .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label")))
    rows = _documents(docs).where(F.col("doc_id").isNotNull())
    n_labelled, n_rows = own.count(), rows.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    part = lambda most, n: draw < min(1.0, most / max(n, 1))
    mine = own.where(part(1.5 * labelled_rows, n_labelled))
    pool = rows.where(part(unlabelled_rows, n_rows - n_labelled)).join(own, "doc_id", "left_anti").withColumn("label", F.lit(-1))
    sample = rows.join(mine, "doc_id").unionByName(pool)
    table = sample.mapInArrow(_views, VIEW_SCHEMA).withColumn("check", held_out(F.col("doc_id"))).toArrow()
    y, check = table.column("label").to_numpy(), table.column("check").to_numpy()
    content, page = (np.array(table.column(c).to_pylist()) for c in ("content", "page"))
    train, test, free = (y >= 0) & ~check, (y >= 0) & check, y < 0
    if min(*(np.sum(y[m] == k) for m in (train, test) for k in (0, 1))) < 2:
        return float(np.mean(y[y >= 0])) if (y >= 0).any() else 0.5
    return CoTrained((content[train], page[train], y[train].astype(float)), (content[free], page[free]),
                     (content[test], page[test], y[test].astype(float)))


def _scored(model: CoTrained | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _views(batches):
            if not len(batch):
                continue
            content, page = (np.array(batch.column(c).to_pylist()) for c in ("content", "page"))
            score = np.full(len(batch), model) if isinstance(model, float) else model.score(content, page)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, **options) -> DataFrame:
    """doc_id, score (chance of good quality) and kept (score >= ``keep_from``) of every row of ``docs``.

    ``docs`` has doc_id and text, and source, lang and n_chars if known (missing or null ones have a
    bucket of their own); other columns are ignored.  ``labels`` has doc_id and quality (1 or 0; other
    values are passed over, a doc_id with both is bad).  A null text counts as empty.  Without
    labels of both kinds every row gets the rate of good labelled rows (0.5 without labels).  Repeated rows are scored each.
    """
    model = co_train(docs, labels, **options)
    rows = _documents(docs).withColumn("label", F.lit(-1))
    return rows.mapInArrow(_scored(model), "doc_id long, score double").withColumn("kept", F.col("score") >= keep_from)
