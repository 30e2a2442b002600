"""Repeated passages by a sparse suffix array.

Of all suffixes (a text from some word on) only those are retained that begin
at a minimiser: the smallest hash of a word 5-gram within a window. A passage
that two documents share has its minimisers in both, so a first pass finds the
retained suffixes whose first words a second document has too. A second pass
takes each run of LENGTH words whose first minimiser is among those, by hash. In
order of hash and document each run meets its equals in the nearest documents on
either side: every run of LENGTH words that a smaller id has meets one there.
Matches on one diagonal are chained, and each chain is extended word by word to
the left and right on the two texts.

Rows are small (a hash, an id, a place) and are dealt by ranges of hash and
document, so the runs of a passage in a third of all documents spread over many
tasks; only the rows at a task's ends are matched with those of the next one.
They pass through as a stream in which only the current document's rows are held. Texts are only
joined to pairs of documents that have matches, of which a document has a few
however many others share its passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from . import sieve
from .words import Words, mix, pieces, runs, words

LENGTH = 50
GRAM = 5
WINDOW = 12
NEIGHBOUR_NAMES = ["a", "pa", "b", "pb", "edge", "part", "h"]


def _least(length: int, window: int) -> int:
    """Words that follow the first minimiser of a shared passage inside it, at least."""
    return length - window + 1


def _lowest(w: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``gram``-grams the word place of the leftmost smallest
    hash, and whether the window lies inside one text."""
    g = mix(runs(w.hash, gram))
    if len(g) < window:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    low = np.lib.stride_tricks.sliding_window_view(g, window).argmin(1) + np.arange(len(g) - window + 1)
    text = w.text_of
    return low, text[: len(low)] == text[window + gram - 2 : window + gram - 2 + len(low)]


def minimisers(w: Words, gram: int, window: int) -> np.ndarray:
    """Word places of the leftmost smallest ``gram``-gram hash of each window."""
    low, inside = _lowest(w, gram, window)
    return np.unique(low[inside])


def _suffixes(batch: pa.RecordBatch, length: int, window: int) -> pa.RecordBatch:
    """(h, doc): hashes of the first words of the suffixes retained, once for a text."""
    w = words(batch.column(1))
    least = _least(length, window)
    at = minimisers(w, GRAM, window)
    text = w.text_of[at] if len(at) else np.zeros(0, np.int64)
    on = at - w.splits[text] + least <= w.counts[text]
    at, text = at[on], text[on]
    h = runs(w.hash, least)[at] if len(at) else np.zeros(0, np.uint64)
    key = np.lexsort((h, text))
    h, text = h[key], text[key]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return pa.record_batch([pa.array(h[new].view(np.int64)), batch.column(0).take(pa.array(text[new]))], names=["h", "doc"])


def _passages(batch: pa.RecordBatch, length: int, window: int, bits: np.ndarray) -> pa.RecordBatch:
    """(h, doc, place) of the runs of ``length`` words whose first minimiser's suffix may be shared."""
    w = words(batch.column(1))
    n = max(len(w.hash) - length + 1, 0)
    low = _lowest(w, GRAM, window)[0][:n]
    text = w.text_of
    place = np.flatnonzero(text[:n] == text[length - 1 : length - 1 + n])
    at = np.unique(low[place])
    held = np.zeros(len(text), bool)
    if len(at):
        held[at] = sieve.holds(bits, runs(w.hash, _least(length, window))[at])
    place = place[held[low[place]]]
    h = runs(w.hash, length)[place] if len(place) else np.zeros(0, np.uint64)
    text = text[place]
    place = place - w.splits[text]
    # of a text that repeats itself word by word, the first and last of equal runs in ``length`` words cover all between
    key = np.lexsort((place, h, text))
    h, text, place = h[key], text[key], place[key]
    ends = np.ones(len(key) + 1, bool)
    ends[1:-1] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (place[1:] // length != place[:-1] // length)
    on = ends[1:] | ends[:-1]
    return pa.record_batch([pa.array(h[on].view(np.int64)), batch.column(0).take(pa.array(text[on])), pa.array(place[on].astype(np.int32))], names=["h", "doc", "place"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs of words in order of h and doc: (a, pa, b, pb) of each and the
    nearest equal ones of another document on either side, once each; a < b.

    Held between batches: the rows of the last document in the run, and the one
    before them. The rows of the task's first and last document come once more,
    with edge = -1 or 1, the task's number and h, as (doc, place) in (a, pa).
    """
    held = [np.zeros(0, np.int64)] * 3
    context = 0  # 1 if the first held row is only there as a neighbour
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    start, opening = None, True  # (h, doc) of the task's first rows; whether they may go on

    def edge(side: int, h, doc, place) -> pa.RecordBatch:
        none = pa.nulls(len(h), pa.int64())
        return pa.record_batch([pa.array(doc), pa.array(place), none, none, pa.array(np.full(len(h), side, np.int32)), pa.array(np.full(len(h), part, np.int32)), pa.array(h)], names=NEIGHBOUR_NAMES)

    def pairs(h, doc, place, done: int, upto: int) -> pa.RecordBatch:
        n = len(h)
        new = np.ones(n, bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        starts = np.append(np.flatnonzero(new), n)
        nxt = starts[np.searchsorted(starts, np.arange(n), "right")]
        i = np.arange(done, upto)
        before, after = first[i] - 1, nxt[i]
        l1, l2 = i[(before >= 0) & (h[before] == h[i])], i[(after < n) & (h[np.minimum(after, n - 1)] == h[i]) & (after > i + 1)]
        x, y = np.concatenate([l1, l2]), np.concatenate([first[l1] - 1, nxt[l2]])
        swap = doc[x] > doc[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        zero = np.zeros(len(x), np.int32)
        return pa.record_batch([*map(pa.array, (doc[x], place[x], doc[y], place[y], zero, zero + part, h[x]))], names=NEIGHBOUR_NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        if opening:
            own = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("h", "doc", "place")]
            start = start or (own[0][0], own[1][0])
            first = (own[0] == start[0]) & (own[1] == start[1])
            opening = bool(first.all())
            yield edge(-1, *(c[first] for c in own))
        h, doc, place = (np.concatenate([old, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for old, k in zip(held, ("h", "doc", "place"), strict=True))
        last = np.flatnonzero((h != h[-1]) | (doc != doc[-1]))
        begin = int(last[-1]) + 1 if len(last) else 0  # of the last document's rows
        if begin > context:
            yield pairs(h, doc, place, context, begin)
        keep = begin - 1 if begin and h[begin - 1] == h[-1] else begin
        context = begin - keep if begin > context or context == 0 else context
        held = [h[keep:], doc[keep:], place[keep:]]
    if len(held[0]) > context:
        yield pairs(*held, context, len(held[0]))
        yield edge(1, *(c[context:] for c in held))


def _matches(passages: DataFrame) -> DataFrame:
    """(a, pa, b, pb) of equal runs of the nearest documents, whatever task they are in."""
    kinds = "a long, pa long, b long, pb long, edge int, part int, h long"
    ordered = passages.repartitionByRange("h", "doc").sortWithinPartitions("h", "doc", "place")
    rows = cut(ordered.mapInArrow(_neighbours, kinds))
    last, first = (rows.filter(F.col("edge") == side).select("part", "h", F.col("a").alias("doc"), F.col("pa").alias("place")) for side in (1, -1))
    parts = rows.filter("edge = -1").select("part").distinct()
    # a row for each task that had rows
    follows = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("next")).filter("next IS NOT NULL")
    across = last.join(follows, "part").withColumnRenamed("part", "before").join(
        first.select(F.col("part").alias("next"), "h", F.col("doc").alias("d2"), F.col("place").alias("p2")), ["next", "h"]
    ).filter("doc <> d2")
    # each row of either document with the nearest one of the other
    ends = across.groupBy("before", "h", "doc", "d2").agg(F.max("place").alias("low"), F.min("p2").alias("high"))
    met = across.join(ends, ["before", "h", "doc", "d2"]).filter("place = low OR p2 = high")
    swap = F.col("doc") > F.col("d2")
    a, b = (F.when(swap, F.col(x)).otherwise(F.col(y)) for x, y in (("d2", "doc"), ("doc", "d2")))
    pa_, pb_ = (F.when(swap, F.col(x)).otherwise(F.col(y)) for x, y in (("p2", "place"), ("place", "p2")))
    return rows.filter("edge = 0").select("a", "pa", "b", "pb").union(met.select(a, pa_, b, pb_))


def _chains(length: int) -> Callable:
    """Joins matches in order of (a, b, diagonal, place) into one row for as long
    as each begins inside the one before it: (a, b, pa, pb, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)  # a, b, diagonal, first and last place of the open chain
        names = ["a", "b", "pa", "pb", "n"]

        def out(x: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x[0]), pa.array(x[1]), pa.array(x[3]), pa.array(x[3] - x[2]), pa.array(x[4] - x[3] + length)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, d, p = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            rows = np.concatenate([held, np.stack([a, b, d, p, p])], axis=1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(0) | (rows[3, 1:] > rows[4, :-1] + length)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], rows.shape[1]) - 1
            chains = np.concatenate([rows[:4, starts], rows[4:, ends]])
            if chains.shape[1] > 1:
                yield out(chains[:, :-1])
            held = chains[:, -1:]
        if held.shape[1]:
            yield out(held)

    return run


def _extended(length: int) -> Callable:
    """From (a, b, chains, x, y) with the two texts: (doc, start, end, repeat) of
    both sides of each passage that reaches ``length`` words."""

    def grow(x: np.ndarray, y: np.ndarray, chains: list[dict]) -> list[tuple[int, int, int]]:
        found: dict[int, list[list[int]]] = {}
        for c in sorted(chains, key=lambda c: c["pa"]):
            p, q, n = c["pa"], c["pb"], c["n"]
            if p + n > len(x) or q + n > len(y) or (x[p : p + n] != y[q : q + n]).any():
                continue  # another text of the same id, or equal hashes of unequal words
            done = found.setdefault(p - q, [])
            if done and p + n <= done[-1][1]:
                continue
            left = min(p, q)
            back = np.flatnonzero(x[p - left : p] != y[q - left : q])
            begin = p - (left - 1 - back[-1] if len(back) else left)
            right = min(len(x) - p - n, len(y) - q - n)
            ahead = np.flatnonzero(x[p + n : p + n + right] != y[q + n : q + n + right])
            done.append([begin, p + n + (ahead[0] if len(ahead) else right)])
        return [(s, e, d) for d, spans in found.items() for s, e in spans if e - s >= length]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "x"):
                wx, wy = words(piece.column(3)), words(piece.column(4))
                a, b = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                out = []
                for r, chains in enumerate(piece.column(2).to_pylist()):
                    for s, e, d in grow(wx.hash[wx.splits[r] : wx.splits[r + 1]], wy.hash[wy.splits[r] : wy.splits[r + 1]], chains):
                        out += [(a[r], s, e, False, b[r]), (b[r], s - d, e - d, True, a[r])]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["doc", "start", "end", "repeat", "other"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the spans of each row: (doc_id, repeat, word_start, word_end, other_id)."""
    for batch in batches:
        out = []
        for doc, repeat, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            now: list[list[int]] = []
            for s in sorted((x["start"], x["end"], x["other"]) for x in spans):
                if now and s[0] <= now[-1][1]:
                    now[-1][1], now[-1][2] = max(now[-1][1], s[1]), min(now[-1][2], s[2])
                else:
                    now.append(list(s))
            out += [(doc, repeat, *s) for s in now]
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "repeat", "word_start", "word_end", "other_id"])


def repeats(documents: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Passages of ``length`` words or more (A-Z as a-z) that another document has
    too: doc_id, repeat, word_start, word_end, other_id, n_words, one row for each
    stretch of overlapping ones.

    repeat is true where a document with a smaller id has the passage; a document
    can have stretches of both kinds. other_id is the smallest id it was matched
    with. Every passage of ``length`` words is found, as is whether a smaller and
    whether a larger id has it. Passages that only one document repeats are left
    alone. Null and empty texts, texts under ``length`` words and rows without an
    id have no passages; rows that share a doc_id are one document. Other columns
    are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield _suffixes(piece, length, window)

    def scan_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield _passages(piece, length, window, bits.value)

    suffixes = docs.mapInArrow(scan, "h long, doc long")
    shared = suffixes.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi")
    bits = documents.sparkSession.sparkContext.broadcast(sieve.build(shared, "h"))
    matches = _matches(cut(docs.mapInArrow(scan_again, "h long, doc long, place int")))
    along = matches.select("a", "b", (F.col("pa") - F.col("pb")).alias("d"), "pa").repartition("a", "b").sortWithinPartitions("a", "b", "d", "pa")
    chains = along.mapInArrow(_chains(length), "a long, b long, pa long, pb long, n long")
    pairs = cut(chains.groupBy("a", "b").agg(F.collect_list(F.struct("pa", "pb", "n")).alias("chains")))
    full = pairs.join(docs.select(F.col("doc").alias("a"), F.col("text").alias("x")), "a")
    full = full.join(docs.select(F.col("doc").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "chains", "x", "y")
    spans = full.mapInArrow(_extended(length), "doc long, start long, end long, repeat boolean, other long")
    stretches = spans.groupBy("doc", "repeat").agg(F.collect_set(F.struct("start", "end", "other")).alias("spans"))
    return stretches.mapInArrow(_merged, "doc_id long, repeat boolean, word_start long, word_end long, other_id long").withColumn("n_words", F.col("word_end") - F.col("word_start"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans of words; the bytes between kept words stay."""
    for batch in batches:
        for piece in pieces(batch):
            w = words(piece.column(1))
            raw = piece.column(1).to_pylist()
            out = []
            for r, (text, spans) in enumerate(zip(raw, piece.column(2).to_pylist(), strict=True)):
                if not spans:
                    out.append(text)
                    continue
                data, base = text.encode(), w.at[r]
                start, end = w.start[w.splits[r] : w.splits[r + 1]] - base, w.end[w.splits[r] : w.splits[r + 1]] - base
                kept, at = [], 0
                for s, e in sorted((x["word_start"], x["word_end"]) for x in spans):
                    if e <= len(end):
                        kept.append(data[at : start[s]])
                        at = int(end[e - 1])
                out.append((b"".join(kept) + data[at:]).decode())
            yield pa.record_batch([piece.column(0), pa.array(out, pa.string())], names=["_row", "text"])


def remove_repeats(documents: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """documents with the repeated stretches cut out of the text, and n_chars, if
    it is there, counted anew; no row goes, even where nothing is left of its text."""
    spans = repeats(documents, length, window).filter("repeat").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("word_start", "word_end")).alias("_spans"))
    own = documents.columns
    boxed = documents.select(F.struct(*[F.col(f"`{c}`") for c in own if c != "text"]).alias("_row"), "text", F.col("doc_id").cast("long").alias("_id"))
    boxed = boxed.join(spans, "_id", "left").select("_row", "text", "_spans")
    out = boxed.mapInArrow(_without, f"_row {boxed.schema['_row'].dataType.simpleString()}, text string")
    chars = F.coalesce(F.length("text"), F.lit(0))
    return out.select(*[
        F.col("text") if c == "text" else chars.cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row").getField(c).alias(c) for c in own
    ])


def op5(documents: DataFrame) -> DataFrame:
    return repeats(documents)
