"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, unlabelled ones are drawn from the
whole training part. A linear model over hashed words and word beginnings is
fitted in numpy against the class-prior-corrected risk

    prior * E+[l(g, +1)] + max(0, Eu[l(g, -1)] - prior * E+[l(g, -1)])

with the logistic loss; where the second term falls below zero the step goes
against its own gradient, which keeps the model from fitting the unlabelled
sample. Features are chosen by counts over all training documents; the fit sees a
bounded sample (POSITIVES and UNLABELLED documents); every document is scored,
whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .words import PLAIN, Words, pieces, span_hash, words

BITS = 18
BEGINNINGS = (4, 5, 6)  # bytes
POSITIVES, UNLABELLED = 4000, 12000
FEATURES = 4000  # kept, by association with the positives
LEAST_POSITIVES = 3  # documents a kept feature is in
LEAST_SCORE = 2.0
THRESHOLD = 0.7


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each word and each beginning of a longer word."""
    text = w.text_of
    out_text, out = [text], [w.hash]
    for k in BEGINNINGS:
        long = np.flatnonzero(w.end - w.start > k)
        out_text.append(text[long])
        out.append(span_hash(w.data, w.start[long], w.start[long] + k) ^ np.uint64(0x5851F42D4C957F2D))
    return np.concatenate(out_text), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def fold(id_col: str, folds: int = 3) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def _sample(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` ids, the first by hash: the same whatever the partitions.
    Hashes beyond twice the share that is wanted aren't sorted at all."""
    ids = rows.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    share = 2 * (limit + 1000) / max(ids.count(), 1)
    if share < 1:
        ids = ids.filter(F.call_function("shiftrightunsigned", key, F.lit(11)) < F.lit(int(share * (1 << 53))))
    return ids.orderBy(F.call_function("shiftrightunsigned", key, F.lit(11)), "doc_id").limit(limit)


def sample(documents: DataFrame, labels: DataFrame, training: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[DataFrame, float]:
    """(doc_id, text, positive) of the training sample, and the class prior: the
    toxic share of all labelled training rows."""
    known = labels.filter(training & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    chosen = _sample(known.filter("toxic = 1"), positives, 1).withColumn("positive", F.lit(1)).unionByName(
        _sample(documents.filter(training), unlabelled, 2).withColumn("positive", F.lit(0))
    )
    # bounded by the two limits, so small enough to send to every task; of an id that repeats, one text
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    return rows.select("doc_id", "text", "positive"), float(min(max(prior, 0.001), 0.9))


def feature_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each feature is, and how many texts there are: a
    vector of fixed size from each task, summed in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for piece in pieces(batch):
                text, feature = _features(words(piece.column(0), PLAIN))
                total += np.bincount(np.unique(text << BITS | feature) & ((1 << BITS) - 1), minlength=1 << BITS)
                n += piece.num_rows
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(found, -1)), pa.array(np.append(total[found], n))], names=["feature", "n"])

    rows = texts.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = rows.column("feature").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(1 << BITS, np.int64)
    out[feature[feature >= 0]] = n[feature >= 0]
    return out, int(n[feature < 0].sum())


def choose_features(positive: DataFrame, every: DataFrame, limit: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The features most tied to positives, and how many standard errors their
    rate there lies above their rate in all training documents."""
    (p, n_p), (u, n_u) = feature_counts(positive), feature_counts(every)
    if not n_p or not n_u:
        return np.zeros(0, np.int64), np.zeros(0)
    rate, base = (p + 0.5) / (n_p + 1.0), (u + 0.5) / (n_u + 1.0)
    score = (rate - base) / np.sqrt((base + rate) / min(n_p, n_u))
    kept = np.flatnonzero((p >= LEAST_POSITIVES) & (score > LEAST_SCORE))
    kept = np.sort(kept[np.lexsort((kept, -score[kept]))[:limit]])
    return kept, score[kept]


def _table(features: np.ndarray) -> np.ndarray:
    """Position of each feature among the kept ones, -1 for others."""
    out = np.full(1 << BITS, -1, np.int32)
    out[features] = np.arange(len(features))
    return out


def risk(w: np.ndarray, b: float, rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, prior: float) -> tuple[tuple[float, np.ndarray], tuple[float, np.ndarray]]:
    """The risk's positive and negative part, each with its gradient (weights, then offset)."""
    n, p, u = len(positive), positive == 1, positive == 0
    g = np.bincount(rows, w[cols], n) + b
    sig = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    gain = prior * np.logaddexp(0, -g[p]).mean()
    loss = np.logaddexp(0, g[u]).mean() - prior * np.logaddexp(0, g[p]).mean()
    d_gain, d_loss = np.zeros(n), np.zeros(n)
    d_gain[p] = -prior * (1 - sig[p]) / p.sum()
    d_loss[u] = sig[u] / u.sum()
    d_loss[p] = -prior * sig[p] / p.sum()
    gradient = lambda d: np.append(np.bincount(cols, d[rows], len(w)), d.sum())
    return (float(gain), gradient(d_gain)), (float(loss), gradient(d_loss))


def nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of the linear model; row and column of each feature that is there."""
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    if not (positive == 1).any() or not (positive == 0).any():
        return w, b
    for step in range(1, steps + 1):
        (_, d_gain), (loss, d_loss) = risk(w, b, rows, cols, positive, prior)
        grad = (-d_loss if loss < 0 else d_gain + d_loss) + decay * np.append(w, 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def fit(documents: DataFrame, labels: DataFrame, training: Column) -> dict:
    rows, prior = sample(documents, labels, training)
    rows = cut(rows)
    features, _ = choose_features(rows.filter("positive = 1"), documents.filter(training))
    table = _table(features)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                text, feature = _features(words(piece.column(0), PLAIN))
                k = table[feature]
                both = np.unique((text << BITS | k)[k >= 0])
                counts = np.bincount(both >> BITS, minlength=piece.num_rows)
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.record_batch([piece.column(1), values], names=["positive", "f"])

    # at most POSITIVES + UNLABELLED rows of kept features
    got = rows.select("text", "positive").mapInArrow(encode, "positive int, f array<int>").toArrow()
    lists = got.column("f").combine_chunks()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    cols = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    w, b = nnpu(np.repeat(np.arange(len(counts)), counts), cols, got.column("positive").to_numpy(), len(features), prior)
    return {"features": features, "weights": w, "offset": b, "prior": prior}


def score(documents: DataFrame, model: dict) -> DataFrame:
    """documents with score and predicted; the text alone decides.

    Null and empty texts get the score of a text without any kept feature; a very
    long one is scored whole. Ids may be null or repeat; rows are scored one by
    one. Columns named score and predicted are replaced, others kept as they are.
    """
    own = [c for c in documents.columns if c not in ("score", "predicted")]
    boxed = documents.select(F.struct(*[F.col(f"`{c}`") for c in own if c != "text"]).alias("_row"), F.col("text"))
    weight = np.zeros(1 << BITS, np.float64)
    weight[model["features"]] = model["weights"]
    live = np.zeros(1 << BITS, bool)
    live[model["features"]] = True
    offset = model["offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                text, feature = _features(words(piece.column(1), PLAIN))
                on = live[feature]
                both = np.unique(text[on] << BITS | feature[on])
                g = offset + np.bincount(both >> BITS, weight[both & ((1 << BITS) - 1)], piece.num_rows)
                yield pa.record_batch([piece.column(0), pa.array(1 / (1 + np.exp(-np.clip(g, -30, 30))))], names=["_row", "score"])

    inner = boxed.schema["_row"].dataType.simpleString()
    out = boxed.mapInArrow(run, f"_row {inner}, score double")
    return out.select("_row.*", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op1(documents: DataFrame, labels: DataFrame) -> DataFrame:
    held = fold("doc_id") == 1
    model = fit(documents.select("doc_id", "text"), labels.select("doc_id", "toxic"), ~held)
    return score(documents.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")
