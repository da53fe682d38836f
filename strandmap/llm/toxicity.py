"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled texts (U) train a linear model in
numpy. With the share p of toxic texts in U, the risk is

    p * E_P[loss(+)] + max(0, E_U[loss(-)] - p * E_P[loss(-)])

so no text has to be confirmed clean, and the part that stands for clean texts
cannot fall below zero by overfitting. Features are the presence of words and
of proper prefixes of words, hashed and counted in Spark; only those more frequent
in P than in U enter the model, at most ``MOST_FEATURES`` of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.llm import textkernel as K
from strandmap.llm.common import lean, ship, smallest_hashes, stored, text_slices
from strandmap.llm.features import letter_words, word_and_prefix_hashes

U64 = np.uint64
PREFIXES = range(3, 11)
#: Texts that fit the model at most, whatever the size of the tables, and features of the model.
MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 2500, 5000, 1024
#: Log-likelihood ratio of a feature that enters the model: of millions tried, hardly one passes by chance.
EVIDENCE = 12.0
PENALTY = 1e-4
_SLICE = 1_000_000


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # of the features, of the log of the number of words that have one, and of the log of their share
    bias: float


def _feature_counts(batches):
    """(feature, texts of P, texts of U that hold it), summed over each slice of texts; a feature has 32 bits."""
    for batch in batches:
        data, offsets = K.flat(batch.column("text"))
        positive = batch.column("positive").to_numpy(zero_copy_only=False)
        for a, b in text_slices(np.diff(offsets), _SLICE):
            part = offsets[a : b + 1]
            low, rows, words, starts, lengths = letter_words(data[part[0] : part[-1]], part - part[0])
            hashes = word_and_prefix_hashes(low, starts, lengths, PREFIXES)
            bounds = np.searchsorted(rows, np.arange(b - a + 1))  # words come row by row
            sides = ([np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)])
            for i in range(b - a):
                f = hashes[np.unique(words[bounds[i] : bounds[i + 1]])].ravel()
                sides[bool(positive[a + i])].append(np.unique((f[f > 0] >> U64(32)).astype(np.uint32)))
            counted = [np.unique(np.concatenate(s), return_counts=True) for s in sides]
            features = np.union1d(counted[0][0], counted[1][0])
            in_u, in_p = np.zeros(len(features), np.int64), np.zeros(len(features), np.int64)
            for (found, n), out in zip(counted, (in_u, in_p), strict=True):
                out[np.searchsorted(features, found)] = n
            yield pa.RecordBatch.from_arrays([pa.array(features.astype(np.int64)), pa.array(in_p), pa.array(in_u)], names=["feature", "in_p", "in_u"])


def fit(positive: DataFrame, unlabelled: DataFrame, prior: float, text: str = "text", key: str = "doc_id") -> Model:
    """Fit on at most ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` texts: those whose keys have the smallest hashes.

    Without positive texts every score is the prior.
    """
    ship(positive.sparkSession)
    sample = smallest_hashes(positive, MOST_POSITIVE, key, text).withColumn("positive", F.lit(True)).unionByName(smallest_hashes(unlabelled, MOST_UNLABELLED, key, text).withColumn("positive", F.lit(False)))
    sample = stored(sample.repartition(12), "toxicity-sample")
    sizes = {bool(r.positive): r["count"] for r in sample.groupBy("positive").count().collect()}
    counts = sample.mapInArrow(lean(_feature_counts), "feature long, in_p long, in_u long").groupBy("feature").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    prior = min(max(prior, 1e-3), 0.9)
    chosen = choose_features(counts, sizes.get(True, 0), sizes.get(False, 0), prior)
    if not len(chosen):
        return Model(chosen, np.zeros(2), float(np.log(prior / (1 - prior))))
    rows = sorted((bool(r.positive), bytes(r.present), r.hits, r.words) for r in sample.mapInArrow(lean(_designs(chosen)), "positive boolean, present binary, hits long, words long").collect())
    x = np.zeros((len(rows), len(chosen) + 2), np.float32)
    for i, (_, present, hits, words) in enumerate(rows):
        x[i, np.frombuffer(present, np.uint16)] = 1
        x[i, -2:] = _density(hits, words)
    y = np.array([r[0] for r in rows])
    return fit_rows(x[y], x[~y], prior, chosen)


def choose_features(counts: DataFrame, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Features of P that are more frequent there than in the clean part of U, by their evidence; only these leave Spark.

    counts: (feature, in_p, in_u), the numbers of texts of P and U that hold a feature.
    """
    if not n_p or not n_u:
        return np.zeros(0, np.uint32)
    rate_p, rate_u = F.col("in_p") / n_p, F.col("in_u") / n_u
    # In U a feature of toxic texts alone has the rate prior * rate_p; what is beyond stands for clean texts.
    clean = F.greatest(F.lit(0.0), rate_u - prior * rate_p) / (1 - prior)
    spread = F.sqrt(rate_u / n_u + prior**2 * rate_p / n_p) + 1 / n_u
    rows = counts.where("in_p > 0").select("feature", "in_p", rate_p.alias("rate"), clean.alias("clean"), ((clean + spread) * n_p).alias("expected"))
    rows = rows.withColumn("evidence", F.col("in_p") * F.log(F.col("in_p") / F.col("expected")) - (F.col("in_p") - F.col("expected")))
    good = rows.where((F.col("in_p") > F.col("expected")) & (F.col("rate") > 4 * F.col("clean")) & (F.col("evidence") >= EVIDENCE))
    best = good.orderBy(F.desc("evidence"), "feature").limit(MOST_FEATURES).select("feature").collect()
    return np.sort(np.array([r.feature for r in best], np.uint32))


def _density(hits, words):
    return np.stack([np.log1p(hits), np.log((hits + 0.3) / (words + 30.0))], axis=-1)


def design(chosen: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """(row, feature) of each feature present, and by row the words that have one and all words."""
    n = len(offsets) - 1
    low, rows, words, starts, lengths = letter_words(data, offsets)
    hashes = (word_and_prefix_hashes(low, starts, lengths, PREFIXES) >> U64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(chosen, hashes), len(chosen) - 1)
    hit = chosen[at] == hashes
    some = hit.any(axis=1)[words]
    total, hits = np.bincount(rows, minlength=n), np.bincount(rows[some], minlength=n)
    rows, words = rows[some], words[some]
    r, c = np.nonzero(hit[words])
    seen = np.unique(rows[r] * np.int64(len(chosen)) + at[words[r], c])
    return seen // len(chosen), seen % len(chosen), hits, total


def _designs(chosen: np.ndarray):
    def run(batches):
        for batch in batches:
            data, offsets = K.flat(batch.column("text"))
            for a, b in text_slices(np.diff(offsets), _SLICE):
                part = offsets[a : b + 1]
                rows, features, hits, words = design(chosen, data[part[0] : part[-1]], part - part[0])
                bounds = np.searchsorted(rows, np.arange(b - a + 1))
                present = [features[i:j].astype(np.uint16).tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("positive").slice(a, b - a), pa.array(present, pa.binary()), pa.array(hits), pa.array(words)], names=["positive", "present", "hits", "words"])

    return run


def fit_rows(xp: np.ndarray, xu: np.ndarray, prior: float, chosen: np.ndarray, steps: int = 400) -> Model:
    """Minimise the non-negative risk with the logistic loss and a quadratic penalty by Adam."""
    w, b = np.zeros(xp.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        w32 = w.astype(np.float32)
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w32 + b, -30, 30))) for x in (xp, xu))
        risk_clean = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
        gp, turn = -prior * (1 - sp) / len(sp), 1.0
        if risk_clean < 0:  # step back on the part that has overfitted
            gp, turn = np.zeros(len(sp)), -1.0
        gu = turn * su / len(su)
        gp = gp - turn * prior * sp / len(sp)
        g = np.append(xp.T @ gp.astype(np.float32) + xu.T @ gu.astype(np.float32) + PENALTY * w, gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        delta = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - delta[:-1], b - delta[-1]
        w[: len(chosen)] = np.maximum(w[: len(chosen)], 0)  # features were chosen for toxicity alone
    return Model(chosen, w, float(b))


def score_bytes(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of texts given as bytes with offsets."""
    n = len(offsets) - 1
    total = np.full(n, model.bias)
    if len(model.features):
        rows, features, hits, words = design(model.features, data, offsets)
        np.add.at(total, rows, model.weights[features])
        total += _density(hits, words) @ model.weights[-2:]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if None) and score, from 0 to 1.

    Whole texts are scored; null counts as empty, and a text without any
    feature of the model has the same low score. Rows stay as they are. A
    column named score is replaced.
    """
    ship(docs.sparkSession)
    others = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = T.StructType([docs.schema[c] for c in others]).add("score", "double")
    sent = others if text in others else [*others, text]
    at = sent.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = K.flat(batch.column(at))
            for a, b in text_slices(np.diff(offsets), _SLICE):
                part = offsets[a : b + 1]
                s = score_bytes(m, data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(others))), pa.array(s)], names=[*others, "score"])

    return docs.select(*(F.col(f"`{c}`") for c in sent)).mapInArrow(lean(run), schema)


def held_out(key: str = "doc_id") -> F.Column:
    """Whether a row belongs to the fold from which nothing is learnt."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_from_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled rows outside the held-out fold; U is all text of the same folds, labels unseen.

    The prior is the share of toxic rows among those labels.
    """
    labels = labels.where(~held_out()).select(F.col("doc_id"), F.col("toxic")).dropna()
    counts = labels.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("k")).first()
    toxic = labels.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_POSITIVE)
    positive = docs.join(F.broadcast(toxic), "doc_id", "left_semi")
    return fit(positive, docs.where(~held_out()), (counts.k or 0) / counts.n if counts.n else 0.05)
