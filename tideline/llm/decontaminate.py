"""Benchmark decontamination by greedy string tiling.

Windows of ``min_match`` words of documents and benchmark items meet in an
equi-join on their rolling hash (the seeds). For each pair of a document and an
item, the longest run of seeds along a diagonal that touches no marked word is
marked as a tile, again and again. An item's share of words under tiles is its
coverage; since tiles may stand in any order in the document, a shuffled passage
is covered as well as a straight one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sieve
from .words import pieces, runs, words

MIN_MATCH = 4
COVERAGE = 0.5


def _seeds(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position, hash) of each window of ``size`` words, and the words of each text."""
    w = words(batch.column(batch.schema.get_field_index("text")))
    h = runs(w.hash, size)
    text = w.text_of[: len(h)]
    place = np.arange(len(h)) - w.splits[text]
    inside = place <= w.counts[text] - size
    return text[inside], place[inside], h[inside], w.counts


def item_seeds(benchmark: DataFrame, size: int = MIN_MATCH) -> DataFrame:
    """(item_id, item_words, item_pos, seed) of every window of the benchmark."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                text, place, h, n = _seeds(piece, size)
                ids = piece.column(0).take(pa.array(text))
                yield pa.record_batch([ids, pa.array(n[text]), pa.array(place), pa.array(h.view(np.int64))], names=["item_id", "item_words", "item_pos", "seed"])

    source = benchmark.select("item_id", "text").filter("item_id IS NOT NULL")
    return source.mapInArrow(scan, "item_id long, item_words long, item_pos long, seed long")


def tiles(doc_pos: np.ndarray, item_pos: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seeds: (document position, item position, words) of each tile.

    Longest first, then earliest in the item, then in the document. A run that
    an earlier tile cut into is split and tried again at its new length.
    """
    order = np.lexsort((item_pos, doc_pos - item_pos))
    d, i = doc_pos[order], item_pos[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(d - i) != 0) | (np.diff(i) != 1)]))
    length = np.diff(np.concatenate([new, [len(d)]])) + size - 1
    open_runs = [(-int(n), int(i[k]), int(d[k])) for k, n in zip(new, length, strict=True)]
    heapq.heapify(open_runs)
    in_doc, in_item, found = set(), set(), []
    while open_runs:
        n, p, q = heapq.heappop(open_runs)
        n = -n
        free = [p + j not in in_item and q + j not in in_doc for j in range(n)]
        if all(free):
            found.append((q, p, n))
            in_item.update(range(p, p + n))
            in_doc.update(range(q, q + n))
            continue
        j = 0
        while j < n:
            k = j
            while k < n and free[k]:
                k += 1
            if k - j >= size:
                heapq.heappush(open_runs, (-(k - j), p + j, q + j))
            j = k + 1
    return found


def contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, size: int = MIN_MATCH) -> DataFrame:
    """One row for each document and item with enough of the item's words under
    tiles: doc_id, item_id, n_tiles, longest_tile, covered, item_words, coverage.

    Null or empty texts, items of fewer than ``size`` words and rows without an
    id take no part. Rows that share a doc_id are read as that one document;
    an identical row twice tiles as one. Other columns are ignored.
    """
    spark = documents.sparkSession
    seeds = item_seeds(benchmark, size)
    bits = spark.sparkContext.broadcast(sieve.build(seeds, "seed"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            for piece in pieces(batch):
                text, place, h, _ = _seeds(piece, size)
                hit = sieve.holds(known, h)
                ids = piece.column(0).take(pa.array(text[hit]))
                yield pa.record_batch([ids, pa.array(place[hit]), pa.array(h[hit].view(np.int64))], names=["doc_id", "doc_pos", "seed"])

    hits = documents.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(scan, "doc_id long, doc_pos long, seed long")
    joined = hits.join(seeds, "seed").groupBy("doc_id", "item_id").agg(
        F.first("item_words").alias("item_words"),
        F.collect_set(F.struct("doc_pos", "item_pos")).alias("seeds"),
    )  # as many as the two texts have in common, never more than a document's own words times an item's repeats
    enough = F.size(F.array_distinct(F.flatten(F.transform("seeds.item_pos", lambda p: F.sequence(p, p + size - 1))))) >= coverage * F.col("item_words")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column(3)
            flat, at = seen.flatten(), seen.value_lengths().to_numpy(zero_copy_only=False)
            border = np.concatenate([[0], np.cumsum(at)])
            d, i = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            found = [tiles(d[a:b], i[a:b], size) for a, b in zip(border, border[1:], strict=False)]
            covered = np.array([sum(x[2] for x in t) for t in found], np.int64)
            total = batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in found], pa.int64()), pa.array([max(x[2] for x in t) for t in found], pa.int64()), pa.array(covered), batch.column(2), pa.array(covered / total)],
                names=["doc_id", "item_id", "n_tiles", "longest_tile", "covered", "item_words", "coverage"],
            )

    out = joined.filter(enough).mapInArrow(tile, "doc_id long, item_id long, n_tiles long, longest_tile long, covered long, item_words long, coverage double")
    return out.filter(F.col("coverage") >= coverage)


def clean(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """documents without the contaminated ones."""
    return documents.join(contaminated(documents, benchmark, coverage).select("doc_id").distinct(), "doc_id", "left_anti").select(*documents.columns)


def op10(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(documents, benchmark)
