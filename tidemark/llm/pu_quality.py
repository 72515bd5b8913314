"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled texts train a linear model by the non-negative
unbiased risk with the logistic loss; the class prior is estimated from the
same two sets.  Labelled rows of both kinds then only set the scale of the
score (two numbers).  Features are shapes and repetition of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, text_of, written
from tidemark.llm.spans import Hashes, steps, words

#: Bounds of the fit: labelled rows and unlabelled rows, the first in hash order of their ids.
LABELLED_ROWS, UNLABELLED_ROWS = 30_000, 30_000
ROUNDS, RATE, DECAY = 400, 0.05, 1e-3
#: Share of positives that a region must hold to bound the prior.
REGION = 0.2

_CLASSES = 8
_CLASS = np.full(256, 7, np.int64)  # other ASCII points and controls
_CLASS[list(range(97, 123))] = 0
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(48, 58))] = 2
_CLASS[list(b"#*$%&|<>")] = 3
_CLASS[list(b"!?")] = 4
_CLASS[list(b".,;:")] = 5
_CLASS[128:] = 6
WIDTH = 9 + _CLASSES + _CLASSES * _CLASSES


def _distinct(doc: np.ndarray, keys: np.ndarray, docs: int) -> np.ndarray:
    """How many different keys each document has."""
    if not len(keys):
        return np.zeros(docs)
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return np.bincount(d[new], minlength=docs).astype(float)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of lines that are not empty, and their documents."""
    edge = np.unique(np.concatenate([np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1, offsets]))
    starts, ends = edge[:-1], edge[1:]
    line = data[np.minimum(starts, max(len(data) - 1, 0))] != 10 if len(data) else np.zeros(len(starts), bool)
    starts, ends = starts[line], ends[line]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def features(data: np.ndarray, offsets: np.ndarray, by_byte: Hashes, by_word: Hashes) -> np.ndarray:
    """One row per text; a text without words has zeros."""
    docs = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    count = np.diff(first)
    doc = np.repeat(np.arange(docs), count)
    n = np.maximum(count, 1)
    out = np.zeros((docs, WIDTH), np.float32)
    if not len(starts):
        return out
    keys = by_byte.texts(data, starts, ends)
    classes = _CLASS[data]
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])
    place = np.arange(len(keys)) - first[doc]
    wide = np.flatnonzero(count[doc] - place >= 8)
    windows = by_word.slices(keys, wide, wide + 8)
    made = np.maximum(np.bincount(doc[wide], minlength=docs), 1)
    at, to, owner = _lines(data, offsets)
    n_lines = np.bincount(owner, minlength=docs) if len(owner) else np.zeros(docs)
    size = np.bincount(doc, (ends - starts), minlength=docs)
    distinct = _distinct(doc, keys, docs)
    out[:, 0] = np.log1p(count)
    out[:, 1] = size / n
    out[:, 2] = np.bincount(doc, (ends - starts) <= 3, minlength=docs) / n
    out[:, 3] = np.bincount(doc, same, minlength=docs) / n
    out[:, 4] = distinct / n
    out[:, 5] = np.log(distinct + 1) / np.log(count + 2)
    out[:, 6] = 1 - _distinct(doc[wide], windows, docs) / made * (np.bincount(doc[wide], minlength=docs) > 0) - (np.bincount(doc[wide], minlength=docs) == 0)
    out[:, 7] = 1 - _distinct(owner, by_byte.texts(data, at, to), docs) / np.maximum(n_lines, 1)
    out[:, 8] = np.log1p(count / np.maximum(n_lines, 1))
    for c in range(_CLASSES):
        sums = np.append(0, np.cumsum(classes == c))
        out[:, 9 + c] = np.sqrt((sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1))
    shape = classes[starts] * _CLASSES + classes[ends - 1]
    shapes = np.bincount(doc * _CLASSES**2 + shape, minlength=docs * _CLASSES**2).reshape(docs, -1)
    out[:, 9 + _CLASSES :] = np.sqrt(shapes / n[:, None])
    out[count == 0] = 0
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_byte, by_word = Hashes(8), Hashes(9)
    for b in batches:
        rows = [x.tobytes() for _, _, data, offsets in steps(b["text"]) for x in features(data, offsets, by_byte, by_word)]
        yield pa.record_batch({"doc_id": b["doc_id"], "features": pa.array(rows, pa.binary())})


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of unlabelled to positive share over regions above or below a score.

    Any region holds at least prior * (its share of positives) of the unlabelled
    rows; the tightest region gives the estimate.  Small regions are left out,
    and a deviation of two standard errors is granted.
    """
    best = 1.0
    for sign in (1, -1):
        p, u = np.sort(sign * positive), np.sort(sign * unlabelled)
        cuts = p[np.linspace(0, len(p) - 1, 200).astype(int)]
        share_p = 1 - np.searchsorted(p, cuts) / len(p)
        share_u = 1 - np.searchsorted(u, cuts) / len(u)
        ok = share_p >= REGION
        slack = 2 * np.sqrt(np.maximum(share_u * (1 - share_u), 1e-9) / len(u))
        if ok.any():
            best = min(best, float(((share_u + slack) / share_p)[ok].min()))
    return min(max(best, 0.01), 0.99)


def _descend(gradient, width: int) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, ROUNDS + 1):
        g = gradient(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(positive: np.ndarray, unlabelled: np.ndarray, labelled: np.ndarray, quality: np.ndarray) -> dict:
    """Weights, scale and prior of the model; features are standardised on the unlabelled rows."""
    both = np.concatenate([positive, unlabelled])
    mean, deviation = both.mean(axis=0), both.std(axis=0) + 1e-3

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - mean) / deviation, -6, 6), np.ones((len(x), 1))])

    p, u = scaled(positive), scaled(unlabelled)

    def apart(some: int) -> np.ndarray:
        """Positives against unlabelled, both from one half of the rows."""
        a, b = p[some::2], u[some::2]
        return _descend(lambda w: (-(1 - _sigmoid(a @ w)) @ a / len(a) + _sigmoid(b @ w) @ b / len(b)) / 2, p.shape[1])

    prior = 0.5
    if min(len(p), len(u)) > 1:
        # each half is scored by what the other half taught
        halves = [(p[k::2] @ w, u[k::2] @ w) for k, w in ((0, apart(1)), (1, apart(0)))]
        prior = float(np.mean([estimate_prior(a, b) for a, b in halves]))

    def risk(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = _sigmoid(zu) @ u / len(u) - prior * (_sigmoid(zp) @ p) / len(p)
        if as_negative < 0:  # the risk of negatives cannot be below zero: step back from overfitting
            return -negative
        return prior * (-(1 - _sigmoid(zp)) @ p) / len(p) + negative

    w = _descend(risk, p.shape[1])
    scale = np.array([1.0, 0.0])
    if len(np.unique(quality)) == 2:
        z = np.stack([scaled(labelled) @ w, np.ones(len(labelled))], axis=1)
        spread = max(float(np.abs(z[:, 0]).mean()), 1e-6)
        z[:, 0] /= spread
        a = _descend(lambda s: (_sigmoid(z @ s) - quality) @ z / len(z), 2)
        scale = np.array([max(a[0], 1e-6) / spread, a[1]])
    return {"mean": mean, "deviation": deviation, "weights": w, "scale": scale, "prior": prior}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["deviation"], -6, 6) @ model["weights"][:-1] + model["weights"][-1]
    return _sigmoid(model["scale"][0] * z + model["scale"][1])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _matrix(rows: DataFrame, columns: list[str]) -> pa.Table:
    return rows.select(*columns, "features").toArrow()


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict | None]:
    """``doc_id, held_out, score`` of every row, and the model.

    Learns from labelled rows outside the held-out quarter and from unlabelled
    rows, both bounded (``LABELLED_ROWS``, ``UNLABELLED_ROWS``).  Contradicting
    labels of an id count as bad.  Null texts and texts without words have zero
    features; rows without an id are scored, never learned from.  Without a
    labelled positive or an unlabelled row the score is 0.5 for all.
    """
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    measured = written(given.mapInArrow(_measure, "doc_id long, features binary"), "quality-features")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    learn = measured.where(F.col("doc_id").isNotNull() & ~held_out())
    seen = _matrix(bounded_sample(learn.join(known, "doc_id"), LABELLED_ROWS, ["doc_id", "features"]), ["quality"])
    rest = _matrix(bounded_sample(learn.join(known, "doc_id", "left_anti"), UNLABELLED_ROWS, ["doc_id", "features"]), [])

    def rows(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t["features"].to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)

    labelled, quality, unlabelled = rows(seen), seen["quality"].to_numpy().astype(float), rows(rest)
    model = fit(labelled[quality == 1], unlabelled, labelled, quality) if (quality == 1).any() and len(unlabelled) else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b["features"].to_pylist()), np.float32).reshape(-1, WIDTH)
            found = predict(model, x) if model else np.full(len(x), 0.5)
            yield pa.record_batch({"doc_id": b["doc_id"], "score": pa.array(found, pa.float64())})

    scored = measured.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score"), model
