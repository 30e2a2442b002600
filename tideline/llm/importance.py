"""Quality by importance resampling: hashed n-gram models of target and raw text.

Words and word pairs are hashed into 2**BITS buckets. The target model counts
them in documents marked as good (a bounded sample of TARGETS of them), the raw
model in all documents. A document's log weight is the sum of
log(target / raw) over its n-grams; adding Gumbel noise and keeping the k largest
samples k documents without replacement in proportion to their weights. k is
found exactly by counting in ever narrower ranges, never by a sort in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .toxicity import _sample
from .words import pieces, runs, words

BITS = 16
TARGETS = 20000
SMOOTHING = 1.0
SEED = 29


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and each pair of neighbouring words."""
    w = words(texts)
    text = w.text_of
    pair = runs(w.hash, 2)
    inside = text[1:] == text[:-1]
    h = np.concatenate([w.hash, pair[inside]])
    return np.concatenate([text, text[:-1][inside]]), (h >> np.uint64(64 - BITS)).astype(np.int64)


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all buckets over all texts: one vector of fixed size from each
    task, summed bucket by bucket in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                total += np.bincount(_grams(piece.column(0))[1], minlength=1 << BITS)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    smooth = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c)))
    # the raw model has the target's share of smoothing, so unseen buckets weigh nothing
    scale = raw.sum() / max(target.sum(), 1.0)
    even = np.log((raw + SMOOTHING * scale) / (raw.sum() + SMOOTHING * scale * len(raw)))
    return smooth(target) - even


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """docs' ids with log_weight and n_grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                text, bucket = _grams(piece.column(1))
                yield pa.record_batch(
                    [piece.column(0), pa.array(np.bincount(text, ratio[bucket], piece.num_rows).astype(np.float64)), pa.array(np.bincount(text, minlength=piece.num_rows))],
                    names=["doc_id", "log_weight", "n_grams"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, log_weight double, n_grams long")


def kth_largest(rows: DataFrame, column: str, k: int, least: int = 4096, ways: int = 1024) -> float:
    """The k-th largest value: counts in ``ways`` equal ranges, then in the range
    that holds it, until that range has few rows or a single value."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        inside = rows.filter(F.col(column).between(low, high))
        if high <= low:
            return low
        width = (high - low) / ways
        n = inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(ways - 1)).alias("way")).agg(
            F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")
        ).orderBy(F.desc("way")).collect()  # ``ways`` rows at most
        for r in n:
            if above + r.n >= k:
                break
            above += r.n
        low, high = r.lo, r.hi
        if r.n <= least:
            values = rows.filter(F.col(column).between(low, high)).select(column).orderBy(F.desc(column)).limit(least).collect()
            return values[k - above - 1][0]


def resample(documents: DataFrame, labels: DataFrame, share: float | None = None, targets: int = TARGETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, key, selected for each row of documents.

    ``share`` of the rows is selected; by default the share of good documents
    among the labelled ones. Rows with equal keys are selected or not together,
    which can only add to the k wanted. A null or empty text has log weight 0, a
    very long one the sum over all its n-grams; other columns are ignored. The
    noise comes from the id, a null id's from a fixed value. Without any good
    document the two models agree and the noise alone decides.
    """
    docs = documents.select("doc_id", "text")
    known = labels.select("doc_id", "quality").filter("quality IS NOT NULL")
    if share is None:
        share = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
        share = 1.0 if share is None else share
    good = _sample(known.filter("quality = 1"), targets, seed)
    target = gram_counts(docs.join(F.broadcast(good), "doc_id", "left_semi"))  # ``targets`` ids at most
    raw = gram_counts(docs)
    ratio = log_ratio(target, raw) if target.sum() else np.zeros(1 << BITS)
    uniform = (F.call_function("shiftrightunsigned", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), F.lit(11)) + 0.5) / F.lit(float(1 << 53))
    rows = cut(weigh(docs, ratio).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))))
    n = rows.count()
    k = round(n * share)
    if not k:
        return rows.withColumn("selected", F.lit(False))
    least = kth_largest(rows, "key", k)
    return rows.withColumn("selected", F.col("key") >= F.lit(least))


def op9(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return resample(documents, labels)
