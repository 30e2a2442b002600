"""Language model scoring with a hidden Markov model.

A state emits a word w with probability base(w) * share(w, state) / norm(state):
base is the word's smoothed frequency, share how often the state emits w when w
occurs. Shares come from a word's own expected counts, so the model has a row
for each training word, in a distributed table that grows with the corpus. Over
all training words, the end mark and one unknown word, a state's emissions add
up to 1.

Training is Baum-Welch over all training documents: each task adds up expected
counts, Spark sums them. The first iterations tie words to classes (the most
frequent words and the end mark have their own, all others share hashed
classes), so that the driver can turn the sums into the next model. The last
iteration, from there, counts for each word and state. Training and scoring are
exact for texts of any length: windows after the first are carried as
state-to-state matrices, by which what comes before and after each window is
chained along its text. Scoring is the scaled forward recursion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .toxicity import fold
from .words import lists, pieces, words

STATES = 4
CLASS_BITS = 13  # hashed classes; as many classes of one word, the first of which is the end mark
OWN = 1 << CLASS_BITS
CLASSES = 2 * OWN
FREQUENT = 1 << 19  # words looked up where the text is; the others meet their counts in a join
WINDOW = 256
ITERATIONS = 4
DELTA = 0.1
PRIOR = 1.0  # occurrences that a word's shares of the states are smoothed by
GROUP = 2048  # windows handled at once
TOKENS = 1 << 18  # handled at once, one text at least
HELD = 10


def word_counts(docs: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """(word, c) of all words of docs, a word being its 64-bit hash."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return h, np.bincount(at, np.concatenate([p[1] for p in parts]), len(h)).astype(np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for piece in pieces(batch):
                parts.append(np.unique(words(piece.column(0)).hash, return_counts=True))
                held += len(parts[-1][0])
                if held > 2 * limit:
                    parts = [merge(parts)]
                    held = len(parts[0][0])
                    if held > limit:
                        yield pa.record_batch([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], names=["word", "c"])
                        parts, held = [], 0
        if parts:
            h, c = merge(parts)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c)], names=["word", "c"])

    return docs.select("text").mapInArrow(scan, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The least c such that at most ``most`` words have a count of c or more."""
    # as many rows as there are different counts below 1000, or powers above
    level = F.when(F.col("c") < 1000, F.col("c")).otherwise(F.floor(F.pow(F.lit(1.02), F.ceil(F.log(1.02, "c")))))
    rows = counts.groupBy(level.cast("long").alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("c")).collect()
    least, total = 1 << 62, 0
    for r in rows:
        total += r.n
        if total > most:
            break
        least = r.c
    return least


class Vocabulary:
    """What scoring a text needs of the training words: fixed in size."""

    def __init__(self, counts: DataFrame, documents: int):
        totals = counts.agg(F.count("*"), F.sum("c")).first()
        self.documents = documents
        self.tokens = int(totals[1] or 0) + documents
        self.distinct = int(totals[0]) + (documents > 0)
        own, self.frequent = _least_count(counts, OWN - 1), _least_count(counts, FREQUENT)
        table = counts.filter(F.col("c") >= self.frequent).toArrow()  # FREQUENT rows at most
        h = table.column("word").to_numpy().view(np.uint64)
        order = np.argsort(h)
        self.words, c = h[order], table.column("c").to_numpy()[order].astype(np.float64)
        self.log_total = float(np.log10(self.tokens + DELTA * (self.distinct + 1)))
        alone = c >= own
        k = (self.words >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
        self.classes = np.where(alone, 1 + np.cumsum(alone) - 1, OWN + k).astype(np.int16)
        self.classes[alone] = np.arange(1, alone.sum() + 1)
        self.base = np.log10(c + DELTA) - self.log_total
        self.end_base = float(np.log10(documents + DELTA)) - self.log_total


def sequences(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """For each document: row, doc_id, held_out, n (words), known and base (number
    and log10 sum of its frequent words), classes and places (in the vocabulary's
    words, from 1; 0 is the end mark, -1 any other word) of all its tokens, and rare
    (the other words' hashes, in order)."""
    names = ["row", "doc_id", "held_out", "n", "known", "base", "classes", "places", "rare"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        row = TaskContext.get().partitionId() << 33  # kept with the row in the written table
        for batch in batches:
            for piece in pieces(batch):
                w, rows = words(piece.column(2)), piece.num_rows
                at = np.minimum(np.searchsorted(v.words, w.hash), max(len(v.words) - 1, 0))
                hit = v.words[at] == w.hash if len(v.words) else np.zeros(len(w.hash), bool)
                cls = (OWN + (w.hash >> np.uint64(64 - CLASS_BITS)).astype(np.int64)).astype(np.int16)
                cls[hit] = v.classes[at[hit]]
                text, rare = w.text_of, ~hit
                every = np.arange(len(cls)) + text  # the end mark is class 0 and place 0
                classes, places = np.zeros(len(cls) + rows, np.int16), np.zeros(len(cls) + rows, np.int32)
                classes[every], places[every] = cls, np.where(hit, at + 1, -1)
                yield pa.record_batch(
                    [
                        pa.array(np.arange(row, row + rows)), piece.column(0), piece.column(1), pa.array(w.counts),
                        pa.array(np.bincount(text[hit], minlength=rows)), pa.array(np.bincount(text[hit], v.base[at[hit]], rows).astype(np.float64)),
                        lists(classes, w.counts + 1), lists(places, w.counts + 1), lists(w.hash[rare].view(np.int64), np.bincount(text[rare], minlength=rows)),
                    ],
                    names=names,
                )
                row += rows

    kinds = "row long, doc_id long, held_out boolean, n long, known long, base double, classes array<short>, places array<int>, rare array<long>"
    return cut(docs.select("doc_id", "held_out", "text").mapInArrow(scan, kinds))


class Model:
    """start (S), move (S, S) and emit (classes, S)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, states: int = STATES, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        emit = rng.dirichlet(np.full(states, 2.0), CLASSES)
        move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def of(cls, sums: np.ndarray, states: int) -> Model:
        """From expected counts, with a pseudo-count in each place."""
        start, move, emit = np.split(sums + 1e-3, [states, states + states**2])
        move, emit = move.reshape(states, states), emit.reshape(CLASSES, states)
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _windows(splits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first place, length) of the windows of sequences, in order."""
    n = np.diff(splits)
    count = -(-n // WINDOW)
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, splits[:-1][text] + number * WINDOW, np.minimum(WINDOW, n[text] - number * WINDOW)


def expected(model: Model, x: np.ndarray, start: np.ndarray, length: np.ndarray, sums: np.ndarray, before: np.ndarray, after: np.ndarray) -> float:
    """Adds the windows' expected counts to sums; the log likelihood. ``before``
    has the states' chances at the end of the window before (NaN for a text's first
    window), ``after`` how likely what follows the window is from each state, to a
    factor."""
    s = len(model.start)
    order = np.argsort(-length, kind="stable")
    start, length, before, after = start[order], length[order], before[order], after[order]
    live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    first = np.isnan(before[:, 0])
    entry = np.where(first[:, None], model.start, np.nan_to_num(before) @ model.move)
    alphas, scales, places, seen = [], [], [], []
    last, ones = np.zeros((len(length), s)), np.ones(s)
    for t, n in enumerate(live):
        seen.append(x[start[:n] + t])
        e = model.emit.take(seen[-1], 0)
        a = (alphas[-1][:n] @ model.move if t else entry) * e
        scale = (a @ ones)[:, None]  # quicker than a sum along a short axis
        alphas.append(a / scale)
        scales.append(scale)
        places.append(e)
        last[:n] = alphas[-1]
    beta, xi = after / (last * after).sum(1, keepdims=True), np.zeros((s, s))
    gammas = [None] * len(live)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        gammas[t] = alphas[t] * beta[:n]
        b = places[t] * beta[:n] / scales[t]
        if t:
            xi += alphas[t - 1][:n].T @ b
            beta[:n] = b @ model.move.T
        else:
            xi += before[~first].T @ b[~first]  # the steps that lead into later windows
    sums[:s] += gammas[0][first].sum(0)
    sums[s : s + s * s] += (xi * model.move).ravel()
    gamma = np.concatenate(gammas)
    seen = np.concatenate(seen)
    emit = sums[s + s * s :].reshape(-1, s)
    for k in range(s):
        emit[:, k] += np.bincount(seen, gamma[:, k], len(emit))
    return float(sum(np.log(c).sum() for c in scales))


def borders(model: Model, x: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, after) of expected() for all windows of whole sequences, in order."""
    n, s = len(text), len(model.start)
    number = np.arange(n) - np.searchsorted(text, text)
    before, after = np.full((n, s), np.nan), np.ones((n, s))
    more = np.flatnonzero(number > 0)
    if not len(more):
        return before, after
    lead = np.flatnonzero((number == 0) & np.append(text[1:] == text[:-1], False))
    step, state = np.zeros((n, s, s)), np.zeros((n, s))
    for k in range(0, len(more), GROUP):
        at = more[k : k + GROUP]
        step[at] = _run(model, x, start[at], length[at], False)[0]
    for k in range(0, len(lead), GROUP):
        at = lead[k : k + GROUP]
        state[at] = _run(model, x, start[at], length[at], True)[0][:, 0]
    state[lead] /= state[lead].sum(1, keepdims=True)
    for j in range(1, number.max() + 1):  # the windows with one number, of all texts at once
        at = np.flatnonzero(number == j)
        before[at] = state[at - 1]
        state[at] = np.einsum("ns,nsj->nj", state[at - 1], step[at])
        state[at] /= state[at].sum(1, keepdims=True)
    for j in range(number.max(), 0, -1):
        at = np.flatnonzero(number == j)
        after[at - 1] = np.einsum("nsj,nj->ns", step[at], after[at])
        after[at - 1] /= after[at - 1].sum(1, keepdims=True)
    return before, after


def _flat(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column(k).value_lengths().to_numpy(zero_copy_only=False)
    return batch.column(k).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)])


def _parts(batch: pa.RecordBatch, k: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` values in lists k, one row at least."""
    n = np.cumsum(batch.column(k).value_lengths().to_numpy(zero_copy_only=False)) // limit
    borders = [0, *(np.flatnonzero(np.diff(n)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(borders, borders[1:], strict=False):
        yield batch.slice(a, b - a)


def train(rows: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> tuple[Model, list[float]]:
    """The model after the iterations, and the log likelihood of the texts before each."""
    model, likelihood = Model.first(states), []
    spark = rows.sparkSession
    width = states + states**2 + CLASSES * states
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast((model.start, model.move, model.emit))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now, sums, log = Model(*shared.value), np.zeros(width), 0.0
            for batch in batches:
                x, splits = _flat(batch, 0)
                text, start, length = _windows(splits)
                before, after = borders(now, x, text, start, length)
                for k in range(0, len(start), GROUP):
                    on = slice(k, k + GROUP)
                    log += expected(now, x, start[on], length[on], sums, before[on], after[on])
            found = np.flatnonzero(sums)
            yield pa.record_batch([pa.array(np.append(found, -1)), pa.array(np.append(sums[found], log))], names=["place", "n"])

        got = rows.select("classes").mapInArrow(scan, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        place, n = got.column("place").to_numpy(), got.column("n").to_numpy()
        sums = np.zeros(width)
        sums[place[place >= 0]] = n[place >= 0]
        likelihood.append(float(n[place < 0].sum()))
        model = Model.of(sums, states)
        shared.unpersist()
    return model, likelihood


def _run(model: Model, x: np.ndarray, start: np.ndarray, length: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of windows: their forward vectors (first ones) or matrices, scaled, and the logs of the scales."""
    s = len(model.start)
    order = np.argsort(-length, kind="stable")
    st, ln = start[order], length[order]
    live = np.searchsorted(-ln, -np.arange(ln[0] if len(ln) else 0), "left")
    f = np.ones((len(st), 1, s)) if first else np.tile(np.eye(s), (len(st), 1, 1))
    log, ones = np.zeros(len(st)), np.ones(f[0].size if len(st) else s)
    for t, n in enumerate(live):
        e = model.emit.take(x[st[:n] + t], 0)[:, None, :]
        # one product of two matrices; a stack of small ones takes far longer
        f[:n] = (model.start if first and not t else (f[:n].reshape(-1, s) @ model.move).reshape(n, -1, s)) * e
        if t % 8 == 7 or t + 1 == len(live) or live[t + 1] < n:
            scale = f[:n].reshape(n, -1) @ ones
            f[:n] /= scale[:, None, None]
            log[:n] += np.log(scale)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return f[back], log[back]


def likelihoods(model: Model, x: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each whole sequence."""
    text, start, length = _windows(splits)
    out, alpha = np.zeros(len(splits) - 1), np.zeros((len(splits) - 1, len(model.start)))
    number = np.arange(len(text)) - np.searchsorted(text, text)
    for k in range(0, len(out), GROUP):
        at = np.flatnonzero((number == 0) & (text >= k) & (text < k + GROUP))
        f, log = _run(model, x, start[at], length[at], True)
        alpha[text[at]], out[text[at]] = f[:, 0], log
    later = np.flatnonzero(number > 0)
    for k in range(0, len(later), GROUP):  # in order of text and window
        at = later[k : k + GROUP]
        f, log = _run(model, x, start[at], length[at], False)
        rank = np.arange(len(at)) - np.searchsorted(text[at], text[at])
        for j in range(rank.max() + 1):
            on = rank == j
            t = text[at[on]]
            a = np.einsum("ns,nsj->nj", alpha[t], f[on])
            scale = a.sum(1)
            alpha[t] = a / scale[:, None]
            out[t] += np.log(scale) + log[on]
    return out + np.log(alpha.sum(1))


WORD, END, START, MOVE = range(4)  # kinds of rows of word_sums


def word_sums(rows: DataFrame, model: Model, vocabulary: Broadcast) -> DataFrame:
    """(kind, word, c, n0, n1, ...): a training word's count and expected counts in
    the states; the same of the end mark, of starts, and of moves from state ``word``."""
    shared, s = rows.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit)), len(model.start)
    names = [f"n{k}" for k in range(s)]

    def table(kind: np.ndarray, word: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(kind), pa.array(word), pa.array(c), *(pa.array(n[:, k].copy()) for k in range(s))], names=["kind", "word", "c", *names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, v = Model(*shared.value), vocabulary.value
        known = np.concatenate([now.emit[:1], now.emit[v.classes]])  # by place: the end mark, the vocabulary's words
        m, few = len(known), np.zeros(s + s * s)
        count, total = np.zeros(m, np.int64), np.zeros((m, s))
        for batch in batches:
            for part in _parts(batch, 0, TOKENS):
                (cls, splits), place = _flat(part, 0), _flat(part, 1)[0]
                word, one, at = np.unique(_flat(part, 2)[0].view(np.uint64), return_index=True, return_inverse=True)
                rare, x = np.flatnonzero(place < 0), place.astype(np.int64)
                x[rare] = m + at  # this part's other words
                local = Model(now.start, now.move, np.concatenate([known, now.emit[cls[rare[one]]]]))
                sums = np.zeros(s + s * s + (m + len(word)) * s)
                text, start, length = _windows(splits)
                before, after = borders(local, x, text, start, length)
                for k in range(0, len(start), GROUP):
                    on = slice(k, k + GROUP)
                    expected(local, x, start[on], length[on], sums, before[on], after[on])
                few += sums[: s + s * s]
                n, c = sums[s + s * s :].reshape(-1, s), np.bincount(x, minlength=m + len(word))
                total += n[:m]
                count += c[:m]
                yield table(np.full(len(word), WORD, np.int8), word.view(np.int64), c[m:], n[m:])
        if count[0]:
            seen = 1 + np.flatnonzero(count[1:])
            yield table(np.full(len(seen), WORD, np.int8), v.words[seen - 1].view(np.int64), count[seen], total[seen])
            kind, zeros = np.array([END, START, *[MOVE] * s], np.int8), np.zeros(1 + s, np.int64)
            yield table(kind, np.array([0, 0, *range(s)]), np.append(count[:1], zeros), np.concatenate([total[:1], few.reshape(-1, s)]))

    kinds = "kind byte, word long, c long, " + ", ".join(f"{x} double" for x in names)
    found = rows.select("classes", "places", "rare").mapInArrow(scan, kinds)
    return found.groupBy("kind", "word").agg(*[F.sum(x).alias(x) for x in ["c", *names]])


class Emissions:
    """The last model: start, move, and the emissions of words of given counts; those
    of the vocabulary's words by place."""

    def __init__(self, sums: DataFrame, vocabulary: Vocabulary, states: int):
        v, names = vocabulary, [f"n{k}" for k in range(states)]
        few = {(r.kind, r.word): np.array([r[x] for x in names]) for r in sums.filter(F.col("kind") != WORD).collect()}  # states + 2 rows
        none = np.zeros(states)
        self.start = few.get((START, 0), none) + 1e-3
        self.start /= self.start.sum()
        self.move = np.array([few.get((MOVE, k), none) for k in range(states)]) + 1e-3
        self.move /= self.move.sum(1, keepdims=True)
        weight = (F.col("c") + F.lit(DELTA)) / (F.col("c") + F.lit(PRIOR))
        of_words = sums.filter(F.col("kind") == WORD)
        got = of_words.agg(F.sum(weight), *[F.sum(x) for x in names], *[F.sum(F.col(x) * weight) for x in names]).first()
        got = np.array([x or 0.0 for x in got])
        end, n = few.get((END, 0), none), v.documents
        self.share = (got[1 : 1 + states] + end) / v.tokens if v.tokens else np.full(states, 1 / states)
        self.total = v.tokens + DELTA * (v.distinct + 1)
        end_weight = (n + DELTA) / (n + PRIOR) if n else 0.0
        self.norm = got[1 + states :] + PRIOR * self.share * got[0] + end_weight * (end + PRIOR * self.share) + DELTA * self.share
        self.norm /= self.total
        self.unknown = DELTA * self.share / self.total / self.norm
        first = self.of(np.array([n]), end[None]) if n else self.unknown[None]
        self.table = np.concatenate([first, np.tile(self.unknown, (len(v.words), 1))])
        table = of_words.filter(F.col("c") >= v.frequent).toArrow()  # the vocabulary's words
        at = np.searchsorted(v.words, table.column("word").to_numpy().view(np.uint64))
        self.table[1 + at] = self.of(table.column("c").to_numpy(), np.stack([table.column(x).to_numpy() for x in names], 1))

    def of(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of words with counts c and expected counts n (words, states)."""
        weight = (c + DELTA) / (c + PRIOR) / self.total
        return weight[:, None] * (n + PRIOR * self.share) / self.norm


def score(documents: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    A null or empty text is the end mark alone. Rows are scored one by one, so
    repeated rows and ids give repeated results; a null id counts as held out.
    Without training documents every token is unknown, and both scores are 0. A
    very long text is scored whole. Other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", fold("doc_id", HELD) == 0)
    training = docs.filter(~F.col("held_out"))
    v = Vocabulary(cut(word_counts(training)), training.select("doc_id").count())
    vocabulary = spark.sparkContext.broadcast(v)
    rows = sequences(docs, vocabulary)
    known = rows.filter(~F.col("held_out"))
    sums = cut(word_sums(known, train(known, states, iterations)[0], vocabulary))
    emissions = spark.sparkContext.broadcast(Emissions(sums, v, states))
    names = [f"n{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = emissions.value
        for batch in batches:
            for part in _parts(batch, 7, TOKENS):
                place, splits = _flat(part, 7)
                emit = e.table[np.maximum(place, 0)]
                rare = np.flatnonzero(place < 0)
                emit[rare] = e.unknown
                at, c, *n = [x.to_numpy(zero_copy_only=False) for x in part.column(8).flatten().flatten()]
                text = np.repeat(np.arange(part.num_rows), part.column(8).value_lengths().to_numpy(zero_copy_only=False))
                emit[rare[np.searchsorted(rare, splits[:-1])[text] + at]] = e.of(c, np.stack(n, 1))
                log = likelihoods(Model(e.start, e.move, emit), np.arange(len(place)), splits) / np.log(10)
                yield pa.record_batch([*part.columns[:7], pa.array(log)], names=[*part.schema.names[:7], "score"])

    # a rare word's count is below the vocabulary's words', so no key of this join is hot;
    # what meets in a row is one text's words
    rare = rows.select("row", F.posexplode("rare").alias("at", "word")).join(sums.filter((F.col("kind") == WORD) & (F.col("c") < v.frequent)), "word").groupBy("row").agg(
        F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + F.lit(DELTA))).alias("rare_log"), F.collect_list(F.struct("at", "c", *names)).alias("found")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    others = F.col("n_rare") - zero("rare_known")
    base = F.col("base") + zero("rare_log") + others * F.lit(float(np.log10(DELTA))) - F.col("n_rare") * F.lit(v.log_total) + F.lit(v.end_base)
    nothing = F.array().cast("array<struct<at int, c long, " + ", ".join(f"{x} double" for x in names) + ">>")
    sized = rows.withColumn("n_rare", F.size("rare")).drop("classes", "rare")  # before the shuffle of the join
    return sized.join(rare, "row", "left").select(
        "doc_id", "held_out", (F.col("n") + 1).alias("n_tokens"), (F.col("known") + zero("rare_known") + F.lit(int(v.documents > 0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "row", "places", F.coalesce("found", nothing).alias("found"),
    ).mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, row long, score double"
    ).drop("row")


def op6(documents: DataFrame) -> DataFrame:
    return score(documents)
