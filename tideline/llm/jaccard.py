"""N-gram Jaccard join: all documents whose sets of word shingles are similar.

1. One pass fingerprints each document's set and counts shingles into a sketch
   of fixed size. Documents with equal sets are one class from here on.
2. The sketch orders shingles rare first: a shingle's token is its frequency
   class followed by its hash. Two sets at the threshold share a token within
   their first few (the prefix), so only prefix tokens are joined.
3. Candidates pass the length filter (set sizes), the positional filter (what
   can still follow the shared token), and at verification the suffix filter
   (sizes between pivots bound the overlap) before sets are intersected.
4. Every class first meets only its lists' smallest ids; the links found merge
   most classes, and then classes that share a token but are not yet connected
   meet each other, long lists in blocks. So no link that could change a
   component is left out.
5. Links lie inside components, so they are counted there: a component's sets are
   dealt into blocks of bounded size, each pair of blocks meets in one task, and a
   task gives each class's number of similar ones, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import sieve
from .graph import components
from .words import lists, mix, pieces, shingles, words

SIZE = 5
PERCENT = 80
SLOT_BITS = 20  # of the frequency sketch, whatever the corpus: a megabyte as sent out
CHUNK = 4096
PIVOTS = 16
BLOCK = 1000  # members of a posting list that meet each other in one group
MEMBERS, MEMBER_TOKENS = 1024, 1 << 20  # about as many sets, and tokens of theirs, are a block of a component
RARE, COLUMNS = 16, 2048


def _sets(texts: pa.Array, size: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, set sizes) of the distinct shingles of each text: hashes, or with
    the frequency classes, tokens; each text's in ascending order."""
    h, text = shingles(words(texts), size)
    if rank is not None:
        h = rank[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(texts))


def _fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document: doc_id, n (of its set), f1, f2; and rows with a
    chunk of a task's sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                h, n = _sets(piece.column(1), size)
                sketch += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
                sums = []
                for salt in (0, 0x5851F42D4C957F2D):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
                    ends = np.concatenate([[0], np.cumsum(n)])
                    sums.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
                none = pa.nulls(piece.num_rows, pa.int32())
                yield pa.record_batch([piece.column(0), pa.array(n), *map(pa.array, sums), none, pa.nulls(piece.num_rows, pa.list_(pa.int64()))], names=names)
        chunks = len(sketch) // CHUNK
        none = pa.nulls(chunks, pa.int64())
        yield pa.record_batch([none, none, none, none, pa.array(np.arange(chunks, dtype=np.int32)), lists(sketch, np.full(chunks, CHUNK))], names=names)

    names = ["doc_id", "n", "f1", "f2", "chunk", "counts"]
    return cut(docs.mapInArrow(scan, "doc_id long, n long, f1 long, f2 long, chunk int, counts array<long>"))


def _ranks(table: DataFrame) -> np.ndarray:
    """Frequency class of each slot: the counts of all tasks, summed as a stream."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = counts.values.to_numpy()
                total[k] = total[k] + more if k in total else more
        for k, v in total.items():
            yield pa.record_batch([pa.array([k], pa.int32()), lists(v, np.array([CHUNK]))], names=["chunk", "counts"])

    parts = table.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts array<long>").toArrow()
    out = np.zeros(1 << SLOT_BITS)
    for k, counts in zip(parts.column(0).to_pylist(), parts.column(1), strict=True):
        out[k * CHUNK : (k + 1) * CHUNK] = counts.values.to_numpy()
    return np.clip(np.round(6 * np.log2(out + 1)), 0, 255).astype(np.uint8)


def _prefixes(docs: DataFrame, size: int, rank, percent: int, copies: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, n, tokens) of each class's representative, of the tokens only the
    prefix. What a filter of fixed size doesn't take for a copy is one for sure
    and needs no join."""
    bits = docs.sparkSession.sparkContext.broadcast(sieve.build(copies.select(sieve.key("doc_id").alias("key")), "key"))

    def scan(batches: Iterator[pa.RecordBatch], copy: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = sieve.holds(bits.value, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
            for piece in pieces(batch.filter(pa.array(maybe == copy))):
                tokens, n = _sets(piece.column(1), size, rank.value)
                keep = n - (percent * n + 99) // 100 + (n > 0)
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.record_batch([piece.column(0), pa.array(n), lists(tokens[place < np.repeat(keep, n)].view(np.int64), keep)], names=["doc_id", "n", "tokens"])

    keyed = docs.filter("doc_id IS NOT NULL").withColumn("key", sieve.key("doc_id"))
    sure, unsure = (keyed.mapInArrow(partial(scan, copy=copy), "doc_id long, n long, tokens array<long>").filter("n > 0") for copy in (False, True))
    return sure.union(unsure.join(reps, "doc_id", "left_semi"))


def _sets_of(docs: DataFrame, ids: DataFrame, size: int, rank) -> DataFrame:
    """(doc_id, tokens) of the documents with the given ids: whole sets. A filter
    of fixed size spares most other documents the work; the few it lets by meet no
    pair, and where it is too full for that a join drops them."""
    bits = docs.sparkSession.sparkContext.broadcast(sieve.build(ids.select(sieve.key("doc_id").alias("key")), "key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = sieve.holds(bits.value, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
            for piece in pieces(batch.filter(pa.array(maybe))):
                tokens, n = _sets(piece.column(1), size, rank.value)
                yield pa.record_batch([piece.column(0), lists(tokens.view(np.int64), n)], names=["doc_id", "tokens"])

    found = docs.withColumn("key", sieve.key("doc_id")).mapInArrow(scan, "doc_id long, tokens array<long>")
    full = ids.count() > (1 << sieve.BITS) // 16
    return cut(found.join(ids, "doc_id", "left_semi") if full else found)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings in order of token and doc_id: those whose token has more than
    one, each with the first doc_id of its token. Only one row is held between batches."""
    held, lead, open_run = None, 0, False
    names = ["token", "doc_id", "n", "pos", "lead"]
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
        if held is not None:
            columns = [np.concatenate([[x], c]) for x, c in zip(held, columns, strict=True)]
        token, doc = columns[:2]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        leads = doc[np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))]
        more = np.zeros(len(token), bool)
        more[1:] |= ~new[1:]
        more[:-1] |= ~new[1:]
        if held is not None and open_run:  # the held row's run began in an earlier batch
            first = token == token[0]
            leads[first] = lead
            more[0] = True
        on = np.flatnonzero(more[:-1])
        yield pa.record_batch([pa.array(c[on]) for c in (*columns, leads)], names=names)
        held, lead = [int(c[-1]) for c in columns], int(leads[-1])
        open_run = bool(len(token) > 1 and not new[-1]) or bool(len(token) == 1 and open_run)
    if held is not None and open_run:
        yield pa.record_batch([pa.array([x]) for x in (*held, lead)], names=names)


def _able(an: str, ap: str, bn: str, bp: str, percent: int) -> Column:
    """Length and positional filter of two sets that share a token, their sizes and its places given."""
    fits = F.expr(f"100 * least({an}, {bn}) >= {percent} * greatest({an}, {bn})")
    most = F.expr(f"1 + least({an} - {ap}, {bn} - {bp}) - 1")
    return fits & ((100 + percent) * most >= percent * F.expr(f"{an} + {bn}"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Sets travel to the pairs, once each."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for k in (2, 3):
                n = batch.column(k).value_lengths().to_numpy(zero_copy_only=False)
                sides.append((batch.column(k).flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(n)])))
            (x, xs), (y, ys) = sides
            good = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                p, q = x[xs[r] : xs[r + 1]], y[ys[r] : ys[r + 1]]
                need = -(-percent * (len(p) + len(q)) // (100 + percent))
                at = np.linspace(0, len(q), PIVOTS + 1).astype(np.int64)
                cut_at = np.concatenate([[0], np.searchsorted(p, q[at[1:-1]]), [len(p)]])
                if np.minimum(np.diff(at), np.diff(cut_at)).sum() < need:
                    continue  # suffix filter: not even if all between the pivots agreed
                place = np.searchsorted(p, q)
                place[place == len(p)] = 0
                good[r] = (p[place] == q).sum() >= need
            yield pa.record_batch([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    full = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    full = full.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").select("a", "b", "x", "y")
    return cut(full.mapInArrow(look, "a long, b long").distinct())


def _dealt(rows: DataFrame, blocks: Column, salt: str) -> DataFrame:
    """rows once for each pair of blocks that theirs is in: block, lo, hi. Any two
    rows of different blocks meet under one (lo, hi), those of one block under lo = hi."""
    rows = rows.withColumns({"block": F.pmod(F.xxhash64(salt), blocks), "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    return rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def _connecting(postings: DataFrame, percent: int, sets_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Enough of the links (a, b) to connect all classes that links connect, and
    the sets that were looked at, among them those of all linked classes; a set
    may come twice."""
    leads = postings.filter("doc_id = lead").select("token", F.col("n").alias("an"), F.col("pos").alias("ap"))
    first = (
        postings.filter("doc_id <> lead").join(leads, "token").filter(_able("an", "ap", "n", "pos", percent))
        .select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    )
    first = cut(first)
    seen = cut(_ids(first))
    sets = sets_of(seen)
    links = _verified(first, sets, percent)

    merged = postings.join(components(links).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    merged = cut(merged.select("token", "doc_id", "n", "pos", "component"))
    mixed = merged.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size")).filter("least < most")
    rows = cut(_dealt(merged.join(mixed.select("token", "size"), "token"), F.ceil(F.col("size") / BLOCK), "doc_id").drop("size"))
    right = rows.filter("block = hi").select("token", "lo", "hi", F.col("doc_id").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"), F.col("component").alias("bc"))
    rest = (
        rows.filter("block = lo").join(right, ["token", "lo", "hi"]).filter("component < bc OR lo < hi AND component > bc")
        .filter(_able("n", "pos", "bn", "bp", percent))
        .select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    )
    rest = cut(rest)
    sets = sets.union(sets_of(cut(_ids(rest).join(seen, "doc_id", "left_anti"))))
    return links.union(_verified(rest, sets, percent)), sets


def _overlaps(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many tokens each two of the sets share; n are their sizes."""
    m = len(n)
    _, code, count = np.unique(tokens, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), n)
    out = np.zeros((m, m), np.float32)
    often = np.flatnonzero(count > RARE)
    for k in range(0, len(often), COLUMNS):  # tokens of many sets: products of bit matrices
        column = np.full(len(count), -1, np.int64)
        part = often[k : k + COLUMNS]
        column[part] = np.arange(len(part))
        on = column[code] >= 0
        bits = np.zeros((m, len(part)), np.float32)
        bits[row[on], column[code[on]]] = 1
        out += bits @ bits.T
    rare = np.flatnonzero((count[code] > 1) & (count[code] <= RARE))  # tokens of few sets: their pairs
    order = rare[np.argsort(code[rare], kind="stable")]
    code, row = code[order], row[order]
    met = [np.zeros(0, np.int64)]
    for k in range(1, RARE):
        on = np.flatnonzero(code[k:] == code[: max(len(code) - k, 0)])
        met.append(row[on] * m + row[on + k])
    few = np.bincount(np.concatenate(met), minlength=m * m).reshape(m, m)
    return out.astype(np.int64) + few + few.T


def _degrees(percent: int) -> Callable:
    """Of the sets of two blocks of a component: (doc_id, n), the number of
    similar ones each has in the other block, or for a single block in its own."""

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("doc_id")
        doc, block = (table.column(k).to_numpy() for k in ("doc_id", "block"))
        lists_of = table.column("tokens").combine_chunks()
        n = lists_of.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        both = _overlaps(lists_of.flatten().to_numpy(zero_copy_only=False), n)
        size = n[:, None] + n[None, :]
        linked = (100 + percent) * both >= percent * size
        linked &= doc[:, None] != doc[None, :]
        if table.column("lo")[0].as_py() != table.column("hi")[0].as_py():
            linked &= block[:, None] != block[None, :]
        ids, first = np.unique(doc, return_index=True)
        if len(ids) < len(doc):  # several sets of one id, or a set that came twice
            linked = np.add.reduceat(np.add.reduceat(linked, first, 0, dtype=np.int64), first, 1) > 0
        return pa.table({"doc_id": ids, "n": linked.sum(1).astype(np.int64)})

    return count


def _link_counts(found: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(node, n_links) of each linked class. sizes: (rep, n) of all classes."""
    nodes = found.join(sizes.withColumnRenamed("rep", "node"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / MEMBER_TOKENS))
    large = nodes.groupBy("component").agg(F.countDistinct("node").alias("members"), blocks.alias("blocks")).filter("members > 2")
    where = cut(found.join(large.select("component", "blocks"), "component").withColumnRenamed("node", "doc_id"))
    dealt = _dealt(sets.join(where, "doc_id"), F.col("blocks"), "doc_id").select("component", "lo", "hi", "doc_id", "block", "tokens")
    counted = dealt.groupBy("component", "lo", "hi").applyInArrow(_degrees(percent), "doc_id long, n long")
    many = counted.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n").alias("n_links"))
    # of a component of two, the one link is known
    two = found.join(where.select(F.col("doc_id").alias("node")), "node", "left_anti").select("node", F.lit(1).cast("long").alias("n_links"))
    return many.union(two)


def join(documents: DataFrame, size: int = SIZE, percent: int = PERCENT, every: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links for each row of documents.

    component_id is the smallest doc_id reachable by links, class_id the smallest
    with the same set, n_links how many other classes are similar to the document's
    (copies of its own set not counted); without ``every`` links aren't counted, and
    n_links is null for a document that has any.
    A null or empty text has the empty set and is linked with nothing; its
    component is its own id. Rows that share a doc_id are one node of the graph.
    Rows without an id take the component of an equal set, if any. Other columns
    are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = _fingerprints(docs, size)
    rank = spark.sparkContext.broadcast(_ranks(table))
    each = table.filter("chunk IS NULL").select("doc_id", "n", "f1", "f2")
    classes = cut(each.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")))
    reps = classes.filter("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).distinct()

    copies = each.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id").join(reps, "doc_id", "left_anti")
    prefixes = _prefixes(docs, size, rank, percent, copies, reps)
    postings = prefixes.select("doc_id", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("pos", "token")).select("token", "doc_id", "n", "pos")
    ordered = postings.repartition("token").sortWithinPartitions("token", "doc_id")
    postings = cut(ordered.mapInArrow(_shared, "token long, doc_id long, n long, pos long, lead long"))

    links, sets = _connecting(postings, percent, lambda ids: _sets_of(docs, ids, size, rank))
    found = cut(components(links))
    sizes = classes.filter("rep IS NOT NULL").select("rep", "n")
    degree = _link_counts(found, sets, sizes, percent) if every else found.select("node", F.lit(None).cast("long").alias("n_links"))
    known = classes.join(found.join(degree, "node", "left").withColumnRenamed("node", "rep"), "rep", "left")
    alone = F.when(F.col("component").isNull(), F.lit(0).cast("long"))
    known = known.select("f1", "f2", "n", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", alone).alias("n_links"), F.lit(True).alias("_known"))
    return each.join(known, ["f1", "f2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"), F.when(F.col("_known"), F.col("n_links")).otherwise(F.lit(0).cast("long")).alias("n_links"),
    )


def keep_one(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id.

    Documents without words stay, as do rows without an id. Of rows that share
    an id the one with the least text stays, in the order of strings.
    """
    own = documents.columns
    keep = join(documents, size, percent, every=False).filter("doc_id = component_id").select("doc_id").distinct()
    rows = documents.join(keep, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id"))
    whole = F.struct(*[F.col(f"`{c}`") for c in own])
    kept = rows.agg(F.min_by(whole, F.coalesce("text", F.lit(""))).alias("_row")).select("_row.*")
    return kept.union(documents.filter("doc_id IS NULL").select(*own))


def op3(documents: DataFrame) -> DataFrame:
    return join(documents)
