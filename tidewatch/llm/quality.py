"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios.

Features of a text are the distinct n-grams (n = 1, 2) of its words and the distinct n-grams
(n = 1 to 3) of its words' kinds: which classes of characters a word has, and whether it repeats
the word before it. They are hashed to SIZE indices. Class counts run over every labelled
training row in Spark; a feature's scale is the logarithm of the ratio of its shares in the two
classes. The linear model is fitted by dual coordinate descent on at most FIT_ROWS labelled
training rows for each class (those of smallest hash), a documented bound; a logistic curve then
turns margins into scores, weighted back to the classes' true shares. Scoring is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .words import SEPARATOR, Chunk, Pieces, chunks, mix, ngrams

#: Indices that features are hashed to.
SIZE = 1 << 16
#: Labelled rows of each class that the linear model is fitted on, at most.
FIT_ROWS = 4000
#: Added to every count.
SMOOTHING = 1.0
#: Bound of a row's dual variable, and passes over the rows.
COST, PASSES = 1.0, 12

_U = np.uint64
_ROWS = 256

_KIND = np.full(256, 128, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 1
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 16
_KIND[ord("!")] = 32
_KIND[[ord(c) for c in "#*$%&|<>"]] = 64
_KIND[SEPARATOR] = 0


def _keys(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), with repeats."""
    w = Pieces(c, lower=False)
    docs, feats = [], []
    for n in (1, 2):
        d, h = ngrams(w, n)
        docs.append(d)
        feats.append(mix(h + _U(n)))
    if len(w.hash):
        kind = np.bitwise_or.reduceat(_KIND[c.buf], w.start).astype(_U)
        again = np.zeros(len(kind), _U)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        w.hash = mix(kind + again * _U(256) + _U(7_000_000))
        for n in (1, 2, 3):
            d, h = ngrams(w, n)
            docs.append(d)
            feats.append(mix(h + _U(100 + n)))
    return np.concatenate(docs), (np.concatenate(feats) % _U(SIZE)).astype(np.int64)


def features(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, count, and distinct (row in run, feature) sorted by row."""
    for c in chunks(col):
        doc, feat = _keys(c)
        order = np.argsort(doc, kind="stable") if c.n > _ROWS else slice(None)
        doc, feat = doc[order], feat[order]
        for low in range(0, c.n, _ROWS):
            n = min(_ROWS, c.n - low)
            part = slice(*np.searchsorted(doc, [low, low + n])) if c.n > _ROWS else slice(None)
            seen = np.zeros(n * SIZE, bool)
            seen[(doc[part] - low) * SIZE + feat[part]] = True
            at = np.flatnonzero(seen)
            yield c.row + low, n, at // SIZE, at % SIZE


@dataclass
class Model:
    """scale: log-count ratios; weight: of each scaled feature; slope and offset of the logistic curve."""

    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, n: int, row: np.ndarray, feat: np.ndarray) -> np.ndarray:
        s = self.scale[feat]
        norm = np.sqrt(np.bincount(row, s * s, n))
        return np.bincount(row, s * self.weight[feat], n) / np.maximum(norm, 1e-12) + self.bias

    def scores(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, n1, n0) over all labelled rows; feature -1 counts rows."""

    def run(batches):
        total = np.zeros((2, SIZE), np.int64)
        for b in batches:
            y = b.column("label").to_numpy()
            for first, n, row, feat in features(b.column("text")):
                own = y[first : first + n]
                for k in (0, 1):
                    total[k] += np.bincount(feat[own[row] == k], minlength=SIZE)
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1, at]), pa.array(total[0, at])], ["feature", "n1", "n0"])

    part = rows.mapInArrow(run, "feature long, n1 long, n0 long")
    return part.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _feature_rows(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            y = b.column("label").to_pylist()
            for first, n, row, feat in features(b.column("text")):
                edge = np.searchsorted(row, np.arange(n + 1))
                packed = [feat[edge[i] : edge[i + 1]].astype("<u4").tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(y[first : first + n], pa.int32()), pa.array(packed, pa.binary())], ["label", "packed"])

    return rows.mapInArrow(run, "label int, packed binary")


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss on unit-length rows with a constant feature."""
    weight, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    values = []
    for r in rows:
        v = scale[r]
        values.append((v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32))
    square = np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(17)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            slope = y[i] * (weight[r] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                weight[r] += step * v
                bias += step
    return weight, bias


def _curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - np.array([1e-3, 0]) * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        beta += np.clip(np.linalg.solve(hess, grad), -5, 5)
    return float(max(beta[0], 1e-3)), float(beta[1])


def held_out(id_col: str = "doc_id"):
    """True for rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows that aren't held out. Without labels of both classes every score is 1."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    source = docs.select("doc_id", "text").filter(~held_out())
    counts = _counts(source.join(known.hint("shuffle_hash"), "doc_id").select("label", "text"))
    size = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pick = known.filter("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).union(
        known.filter("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    )
    got = counts.collect()  # at most SIZE rows
    n1, n0 = np.full(SIZE, SMOOTHING), np.full(SIZE, SMOOTHING)
    for r in got:
        n1[r["feature"]] += r["n1"]
        n0[r["feature"]] += r["n0"]
    scale = np.log(n1 / n1.sum()) - np.log(n0 / n0.sum())
    # A row for each document picked, so at most 2 * FIT_ROWS: of several texts of one id, the smallest.
    picked = source.join(F.broadcast(pick), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = _feature_rows(picked.select("label", "text")).collect()
    sample.sort(key=lambda r: (r["label"], bytes(r["packed"])))
    y = np.array([r["label"] for r in sample], float)
    if not (y == 0).any() or not (y == 1).any():
        return Model(scale, np.zeros(SIZE), 0.0, 1.0, 500.0)
    rows = [np.frombuffer(r["packed"], "<u4") for r in sample]
    share = np.where(y == 1, size[1] / (y == 1).sum(), size[0] / (y == 0).sum())
    weight, bias = descend(rows, 2 * y - 1, scale, np.full(len(rows), COST))
    model = Model(scale, weight, bias, 1.0, 0.0)
    margin = np.array([model.margins(1, np.zeros(len(r), np.int64), r)[0] for r in rows])
    model.slope, model.offset = _curve(margin, y, share / share.mean())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; a null text is scored as the empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            for first, n, row, feat in features(b.column("text")):
                s = m.scores(m.margins(n, row, feat))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text).

    Defined results: null and empty texts have no features and get the score of the bias;
    labels of unknown documents, null labels and labels other than 0 and 1 are left out; of
    several labels of a document the highest counts; of several texts of one doc_id all are counted and scored, one is fitted on; without both classes all scores are 1;
    a null doc_id gives a null held_out; repeated rows give repeated results.
    """
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, columns as they were."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        m, out = model.value, np.zeros(len(text), bool)
        for first, n, row, feat in features(text):
            out[first : first + n] = m.scores(m.margins(n, row, feat)) >= 0.5
        return pa.array(out)

    return docs.filter(good(F.col("text")))
