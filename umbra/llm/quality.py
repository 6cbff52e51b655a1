"""Quality classification by co-training: a text view and a metadata view teach each other, then vote.

Both views are logistic regressions. In every round each view scores all documents and labels some of those
that it is sure of, for the other view to learn from. Calibrated on labels kept aside, the views' log odds
add up (less the prior's, which each holds).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import arrow_batches, staged, text_of
from umbra.llm.hashing import Words, mixed, parts_of

SHAPES, ENDINGS, WORDS, DENSE = 512, 256, 256, 8
TEXT_WIDTH = SHAPES + ENDINGS + WORDS + DENSE
META_WIDTH = 64 + 16 + 24
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = bytes(x for x in range(33, 127) if not chr(x).isalnum())
_CLASSES = bytes(65 if chr(x) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 48 if chr(x) in "0123456789" else 97 if x >= 128 or chr(x).isalpha() else x for x in range(256))


def text_features(texts: pa.Array) -> np.ndarray:
    """A row for each text: shares of its words' features, as roots, and what its length, words, lines and characters are like.

    A word has three places, each by a hash: its shape (runs of capitals, small letters and digits as A, a and 0, runs of
    another character as itself), its last two bytes and the word itself, A-Z lower-cased.
    """
    words, shapes = Words(texts), Words(texts, classes=_CLASSES)
    sizes, rows, width = words.counts, len(texts), TEXT_WIDTH - DENSE
    row = np.repeat(np.arange(rows), sizes)
    places = (
        shapes.codes % np.uint64(SHAPES), np.uint64(SHAPES) + mixed(words.endings()) % np.uint64(ENDINGS), np.uint64(SHAPES + ENDINGS) + words.codes % np.uint64(WORDS)
    )
    counts = sum(np.bincount(row * width + p.astype(np.int64), minlength=rows * width) for p in places).reshape(rows, width)
    n = np.maximum(sizes, 1)
    out = np.empty((rows, TEXT_WIDTH), np.float32)
    np.sqrt(counts / n[:, None], out=out[:, :width], casting="unsafe")
    numbers = pa.array(words.codes).dictionary_encode()
    types = max(len(numbers.dictionary), 1)
    different = np.bincount(pc.unique(pa.array(row * types + numbers.indices.to_numpy())).to_numpy() // types, minlength=rows)
    dense = []
    for text in texts.cast(pa.binary()).to_pylist():
        size, lines = len(text), text.split(b"\n")
        share = lambda some: (size - len(text.translate(None, some))) / max(size, 1)  # noqa: B023, E731
        dense.append((size, len(set(lines)) / len(lines), np.log1p(len(lines)), share(_UPPER), share(_DIGITS), share(_SYMBOLS)))
    size, *others = np.array(dense).reshape(-1, 6).T
    out[:, width:] = np.column_stack([np.log1p(sizes), np.log1p(size / n), different / n, *others])
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_WIDTH, np.float32)
    out[zlib.crc32((source or "").encode()) % 64] = 1
    out[64 + zlib.crc32((lang or "").encode()) % 16] = 1
    out[80 + (0 if n_chars is None or n_chars < 0 else min(1 + int(2 * np.log2(n_chars + 1) / 2), 23))] = 1
    return out


@dataclass
class View:
    """A logistic regression on standardised features with a Platt scale on top."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # the last place is the bias
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        by_scale = self.weight[:-1] / self.scale
        return x @ by_scale + (self.weight[-1] - self.mean @ by_scale)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 150, rate: float = 0.05) -> View:
    """Full-batch Adam on the weighted log loss."""
    mean = x.mean(0)
    scale = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x) - mean.astype(np.float64) ** 2, 0)).astype(np.float32) + np.float32(1e-2)
    z = x - mean
    z /= scale
    w, m, s = np.zeros((3, x.shape[1] + 1), np.float32)
    y, share = y.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    for step in range(1, steps + 1):
        error = (_sigmoid(z @ w[:-1] + w[-1]) - y) * share
        g = np.append(error @ z + ridge * w[:-1], error.sum())
        g = g.astype(np.float32)
        m, s = np.float32(0.9) * m + np.float32(0.1) * g, np.float32(0.999) * s + np.float32(0.001) * g * g
        w = w - np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(s / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return View(mean, scale, w)


def calibrated(view: View, x: np.ndarray, y: np.ndarray, steps: int = 50) -> View:
    """Platt scaling by short Newton steps on labels the view did not learn from; a unit prior holds the slope near 1."""
    raw = view.raw(x).astype(np.float64)
    good = y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = _sigmoid(a * raw + b)
        error, v = p - target, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[v @ (raw * raw) + 1.0, v @ raw], [v @ raw, v.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(h, [error @ raw + a - 1.0, error.sum() + 1e-3 * b]), -0.5, 0.5)
        a, b = a - move[0], b - move[1]
    view.slope, view.shift = float(max(a, 0.0)), float(b)
    return view


@dataclass
class Model:
    text: View | None
    meta: View | None
    prior: float  # log odds of good

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good by text, by metadata and by both."""
        if self.text is None or self.meta is None:
            same = np.full(len(text), float(_sigmoid(np.array(self.prior))))
            return same, same, same
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


class Lessons:
    """Features of both views and labels (1 good); one label in four is kept aside to calibrate."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray):
        aside = np.arange(len(y)) % 4 == 3
        self.learn, self.aside = tuple(v[~aside] for v in views), tuple(v[aside] for v in views)
        self.y_learn, self.y_aside = y[~aside], y[aside]
        self.good = float(y.mean()) if len(y) else 0.5
        self.prior = float(np.log((self.good * len(y) + 1) / ((1 - self.good) * len(y) + 1)))
        self.enough = len(y) >= 8 and all(len(set(some)) == 2 for some in (self.y_learn, self.y_aside))

    def model(self, given: tuple[list[tuple[np.ndarray, np.ndarray]], ...] = ([], [])) -> Model:
        """Both views from the labels and what each was ``given``, (features, labels) of which weigh half a label."""
        views = []
        for view in (0, 1):
            x, y = self.learn[view], self.y_learn
            weight = np.ones(len(y))
            if given[view]:
                x, y = np.concatenate([x, *(g[0] for g in given[view])]), np.concatenate([y, *(g[1] for g in given[view])])
                weight = np.concatenate([weight, np.full(len(y) - len(weight), 0.5)])
            views.append(calibrated(fit(x, y, weight), self.aside[view], self.y_aside))
        return Model(*views, self.prior)


def co_train(lessons: Lessons, surest, rounds: int = 3, sure: float = 0.95) -> Model:
    """Learns both views. In each round ``surest(model, sure, good)`` gives, for each view, what it teaches the other one:
    (the other view's features, labels) of documents that it is at least ``sure`` of, a share of about ``good`` of them good."""
    if not lessons.enough:
        return Model(None, None, lessons.prior)
    given: tuple[list, list] = ([], [])
    model = lessons.model()
    for _ in range(rounds):
        found = surest(model, sure, lessons.good)
        for view in (0, 1):
            given[1 - view].append(found[view])
        model = lessons.model(given)
    return model


_SCORED = "text_score double, meta_score double, quality_score double"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches (text, source, lang, n_chars and more) in parts, with the features of both views."""
    for part in parts_of(batches, 0):
        meta = [meta_features(*m) for m in zip(*[c.to_pylist() for c in part.columns[1:4]], strict=True)]
        yield part, text_features(part.column(0)), np.stack(meta)


def _arrays(rows: DataFrame, y: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of both views and the column ``y`` of the rows, in the order of their doc_id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, a, b in _features(batches):
            packed = lambda x: pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([packed(a), packed(b), *part.columns[4:]], names=["a", "b", "doc_id", "y"])

    table = rows.select("text", "source", "lang", "n_chars", "doc_id", F.col(y).alias("y")).mapInArrow(make, "a binary, b binary, doc_id long, y double").toArrow()
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))

    def matrix(column: str, width: int) -> np.ndarray:
        """Rows by doc_id, read from the Arrow buffers as they are."""
        out, at = np.empty((len(order), width), np.float32), 0
        for chunk in table.column(column).chunks:
            if len(chunk):
                out[place[at : at + len(chunk)]] = np.frombuffer(chunk.buffers()[2], np.float32, (chunk.offset + len(chunk)) * width).reshape(-1, width)[chunk.offset :]
                at += len(chunk)
        return out

    return matrix("a", TEXT_WIDTH), matrix("b", META_WIDTH), table.column("y").to_numpy()[order]


def _views(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
    )


def by_hash(ids: DataFrame, what: str, most: int) -> DataFrame:
    """At most ``most`` of the rows, by a hash of the doc_id."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(what)), "doc_id").limit(most)


def learned(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, most_given: int = 1000, rounds: int = 3) -> Model:
    """The co-trained model from at most ``most_labelled`` labels, taken by a hash of the id.

    In each round both views score all documents. Of those without a label that a view is sure of, at most
    ``most_given`` go to the other view, in the proportion of the labels and by a hash of the id.
    A document whose id repeats teaches nothing unless it is labelled; then its first row does.
    """
    counted = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y"))
    rows = _views(docs)
    some = staged(by_hash(counted, "label", most_labelled))
    known = rows.join(F.broadcast(some), "doc_id")
    # a labelled id may repeat: of its rows one is taken
    first = staged(known.groupBy("doc_id").agg(F.min(F.xxhash64("text", "source", "lang", "n_chars")).alias("row")))
    chosen = known.withColumn("row", F.xxhash64("text", "source", "lang", "n_chars")).join(F.broadcast(first), ["doc_id", "row"]).dropDuplicates(["doc_id"])
    *views, y = _arrays(chosen, "y")
    lessons = Lessons(tuple(views), y)
    del views

    def surest(model: Model, sure: float, good: float) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        scored = staged(score(rows.where("doc_id is not null"), model, ["doc_id"]).join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti"))
        out = []
        for view, column in enumerate(("text_score", "meta_score")):
            picked = [
                by_hash(scored.where(found).select("doc_id"), f"{view}", max(round(most_given * share), 1)).withColumn("y", F.lit(label))
                for found, share, label in ((F.col(column) >= sure, good, 1.0), (F.col(column) <= 1 - sure, 1 - good, 0.0))
            ]
            ids = staged(picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.min("y").alias("y"), F.count("*").alias("rows")).where("rows = 1"))
            alone = scored.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows = 1")
            features = _arrays(rows.join(F.broadcast(ids.join(alone.select("doc_id"), "doc_id")), "doc_id"), "y")
            out.append((features[1 - view], features[2]))
        return out[0], out[1]

    return co_train(lessons, surest, rounds)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    with arrow_batches(docs.sparkSession, rows=10_000, size=8 << 20):
        model = learned(docs, labels)
    pa.default_memory_pool().release_unused()  # the driver goes on with the model alone
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document with text_score, meta_score and quality_score."""
    return _scored(docs, model, keep).withColumnsRenamed({f"k{i}": k for i, k in enumerate(keep)})


def _scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The same with the columns ``keep`` as k0, k1 and so on, so that none clashes."""
    fields = model.text and vars(model.text), model.meta and vars(model.meta), model.prior
    shared = docs.sparkSession.sparkContext.broadcast(fields)
    passed = [F.col(k).alias(f"k{i}") for i, k in enumerate(keep)]
    kinds = [docs.schema[k].dataType.simpleString() for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, meta, prior = shared.value
        model = Model(text and View(**text), meta and View(**meta), prior)
        for part, a, b in _features(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[4:], *(pa.array(x.astype(np.float64)) for x in model.scores(a, b))], names=[*(f"k{i}" for i in range(len(keep))), *(c.split()[0] for c in _SCORED.split(", "))])

    views = docs.select(
        text_of().alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars"), *passed,
    )
    return views.mapInArrow(run, ", ".join([*(f"k{i} {kind}" for i, kind in enumerate(kinds)), _SCORED]))


def classify(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """doc_id, text_score, meta_score, quality_score and accepted for every document.

    Null texts count as empty, null metadata as a value of its own. Labels that are null or of
    unknown documents are ignored; a document labelled twice has its lower label. With fewer than eight
    labels or one class only, every score is the labels' smoothed share of good ones (0.5 without any). Texts
    are read whole; repeated rows are scored each. An empty table gives no rows; other columns are ignored.
    """
    scored = score(docs, fitted(docs, labels), ["doc_id"])
    return scored.withColumn("accepted", F.col("quality_score") >= limit)


def accepted(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, all columns kept."""
    found = _scored(docs, fitted(docs, labels), docs.columns).where(F.col("quality_score") >= limit)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
