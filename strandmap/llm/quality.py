"""Quality by ordinal regression: one hashed-text weight vector under ordered thresholds.

P(grade <= k) = sigmoid(t_k - s) with s = the mean weight of a text's features
(words, word shapes, immediate repeats) and t_0 < t_1 < ... . The expected
grade and the chance of a wanted grade or better select texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.llm import textkernel as K
from strandmap.llm.common import lean, ship, text_slices
from strandmap.llm.features import style_features

#: Hashed features, and rated texts that fit the model at most.
SIZE, MOST_RATED = 4096, 4000
_SLICE = 1_000_000


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # one less than there are grades, rising


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _shares(rows, features, n):
    """Dense rows of feature shares."""
    x = np.bincount(rows * SIZE + features, minlength=n * SIZE).reshape(n, SIZE).astype(np.float32)
    return x / np.maximum(1, x.sum(axis=1, keepdims=True))


def _sample_features(batches):
    for batch in batches:
        data, offsets = K.flat(batch.column("text"))
        for a, b in text_slices(np.diff(offsets), _SLICE):
            part = offsets[a : b + 1]
            rows, features = style_features(data[part[0] : part[-1]], part - part[0], SIZE)
            cells, counts = np.unique(rows * SIZE + features, return_counts=True)
            bounds = np.searchsorted(cells, np.arange(b - a + 1) * SIZE)
            f = [(cells[i:j] % SIZE).astype("<u2").tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            c = [counts[i:j].astype("<u4").tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("grade").slice(a, b - a), pa.array(f, pa.binary()), pa.array(c, pa.binary())], names=["grade", "f", "c"])


def fit_shares(x: np.ndarray, grades: np.ndarray, n_grades: int, steps: int = 250) -> Model:
    """Maximum likelihood with a small penalty; thresholds rise because their steps are exponentials."""
    w = np.zeros(x.shape[1])
    below = [np.clip((grades <= k).mean(), 0.01, 0.99) for k in range(n_grades - 1)]
    t = np.log(np.array(below) / (1 - np.array(below)))
    raw = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    m, v = np.zeros(len(w) + len(raw)), np.zeros(len(w) + len(raw))
    for step in range(1, steps + 1):
        gaps = np.exp(raw[1:])
        t = raw[0] + np.concatenate([[0], np.cumsum(gaps)])
        s = (x @ w.astype(np.float32)).astype(np.float64)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        hi, lo = _sigmoid(edge[grades + 1] - s), _sigmoid(edge[grades] - s)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gs = (d_hi - d_lo) / len(s)  # of the negative log-likelihood
        gt = np.zeros(len(t))
        np.add.at(gt, grades[grades < n_grades - 1], -d_hi[grades < n_grades - 1] / len(s))
        np.add.at(gt, grades[grades > 0] - 1, d_lo[grades > 0] / len(s))
        later = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([x.T @ gs.astype(np.float32) + 1e-6 * w, [gt.sum()], later[1:] * gaps])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        delta = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, raw = w - delta[: len(w)], raw - delta[len(w) :]
    return Model(w, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, text: str = "text", grade: str = "grade", key: str = "doc_id") -> Model:
    """Fit on the texts of at most ``MOST_RATED`` ratings (key, grade), those whose keys have the smallest hashes.

    Grades are whole numbers from 0 to n_grades - 1; other ratings are left
    out. Of several ratings of a key the lowest counts. Without rated texts all
    weights are zero. The chosen ratings are broadcast, so texts stay in place.
    """
    ship(docs.sparkSession)
    ratings = ratings.where(F.col(grade).between(0, n_grades - 1)).groupBy(F.col(key).alias("_key")).agg(F.min(F.col(grade).cast("int")).alias("grade"))
    ratings = ratings.orderBy(F.xxhash64("_key"), "_key").limit(MOST_RATED)
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(ratings), "_key").select("grade", "text")
    rows = sorted((r.grade, bytes(r.f), bytes(r.c)) for r in sample.mapInArrow(lean(_sample_features), "grade int, f binary, c binary").collect())
    if not rows:
        return Model(np.zeros(SIZE), np.arange(n_grades - 1, dtype=float))
    x = np.zeros((len(rows), SIZE), np.float32)
    for i, (_, f, c) in enumerate(rows):
        x[i, np.frombuffer(f, "<u2")] = np.frombuffer(c, "<u4")
    x /= np.maximum(1, x.sum(axis=1, keepdims=True))
    return fit_shares(x, np.array([g for g, _, _ in rows]), n_grades)


def grade(docs: DataFrame, model: Model, wanted: int = 1, least: float = 0.5, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if None), expected_grade, tail_prob = P(grade >= wanted) and kept = tail_prob >= least.

    Whole texts are graded. Null, empty and blank texts have no feature and are
    graded by the thresholds alone. Rows stay as they are; columns of the new
    names are replaced.
    """
    ship(docs.sparkSession)
    new = ["expected_grade", "tail_prob", "kept"]
    others = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = T.StructType([docs.schema[c] for c in others]).add("expected_grade", "double").add("tail_prob", "double").add("kept", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = K.flat(batch.column(len(others)))
            for a, b in text_slices(np.diff(offsets), _SLICE):
                part = offsets[a : b + 1]
                rows, features = style_features(data[part[0] : part[-1]], part - part[0], SIZE)
                n = np.bincount(rows, minlength=b - a)
                s = np.bincount(rows, weights=m.weights[features], minlength=b - a) / np.maximum(1, n)
                above = 1 - _sigmoid(m.thresholds[None] - s[:, None])
                tail = above[:, wanted - 1] if wanted >= 1 else np.ones(b - a)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(others))), pa.array(above.sum(axis=1)), pa.array(tail), pa.array(tail >= least)], names=[*others, *new])

    return docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text}`").alias("_text")).mapInArrow(lean(run), schema)
