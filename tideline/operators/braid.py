"""One deterministic order over concurrent commands.

Backwards from the heads the command with the smallest (priority, id) comes
first, so forwards, among concurrent commands, the smallest comes last and its
writes win. On chains that share a root this order is a running maximum; on
general graphs it is a merge with a heap, piece by piece.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..session import cut
from .facts import latest
from .graph import Segments, contract, heads, places, reach, segment_cuts, waists
from .schema import Fact


def chain_keys(commands: DataFrame, chain: list[str], order: list[str], key: Column, bucket: Column) -> DataFrame:
    """commands with ``d`` (place from its chain's head) and ``rk`` (greatest key
    from the head down to it). Larger (rk, d) comes earlier in the order.

    The running maximum is taken inside each bucket and then over the buckets'
    maxima, so a chain with very many commands is spread over tasks.
    """
    rows = places(commands.withColumn("_key", key), chain, [F.col(o).desc() for o in order], -bucket, "d")
    rows = rows.withColumn("_b", bucket)
    head_first = Window.partitionBy(*chain).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*chain, "_b").agg(F.max("_key").alias("_m"))
    tops = tops.select(*chain, "_b", F.max("_m").over(head_first).alias("_above"))
    inside = Window.partitionBy(*chain, "_b").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.max("_key").over(inside)).join(tops, [*chain, "_b"])
    return rows.withColumn("rk", F.greatest("_run", F.coalesce("_above", "_run"))).drop("_b", "_run", "_above", "_key")


def positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Rows with their place (from 1) in a total order, by a range sort: each
    task numbers its own rows, and only the tasks' counts are added up."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    low = (1 << 33) - 1
    numbered = cut(ranged.withColumn("_id", F.monotonically_increasing_id()))
    numbered = numbered.withColumns({"_part": F.call_function("shiftright", "_id", F.lit(33)), "_at": F.col("_id").bitwiseAND(F.lit(low))})
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return numbered.join(sizes, "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("long")).drop("_id", "_part", "_at", "_before")


def sequences(rows: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Rows with their place (from 1) in their group's order: places in the order of
    all groups, less what comes before the group. A group may have any number of rows."""
    placed = positions(rows, [*[F.col(g) for g in group], *order], name)
    before = placed.groupBy(*group).agg((F.min(name) - 1).alias("_before"))
    return placed.join(before, group).withColumn(name, F.col(name) - F.col("_before")).drop("_before")


class ParallelFinalize(ValueError):
    """Two finalizing commands are concurrent."""


FINALIZE = 2  # rank: merge 0, basic 1, finalize 2, init 3


def order(ids: list, parents: dict, rank: dict, floor: set) -> list:
    """The order of one graph's commands: reverse topological from the heads,
    smallest rank first, merges left out, ``floor`` and what is above it not entered."""
    inside = [i for i in ids if i not in floor]
    waiting = dict.fromkeys(inside, 0)
    for i in inside:
        for p in parents.get(i, ()):
            if p in waiting:
                waiting[p] += 1
    heap = [(rank[i], i) for i in inside if not waiting[i]]
    heapq.heapify(heap)
    out = []
    open_finalizing = sum(r[0] == FINALIZE for r, _ in heap)
    while heap:
        if open_finalizing > 1:
            raise ParallelFinalize(str(sorted(i for r, i in heap if r[0] == FINALIZE)))
        r, i = heapq.heappop(heap)
        open_finalizing -= r[0] == FINALIZE
        if r[0]:
            out.append(i)
        for p in parents.get(i, ()):
            if p in waiting:
                waiting[p] -= 1
                if not waiting[p]:
                    heapq.heappush(heap, (rank[p], p))
                    open_finalizing += rank[p][0] == FINALIZE
    return out[::-1]


def braid(commands: DataFrame, edges: DataFrame, targets: DataFrame | None = None, by: tuple[str, ...] = (), segments: Segments | None = None) -> DataFrame:
    """(*by, graph_id, id, position) of general graphs, merges left out. commands:
    graph_id, id, priority_rank, priority_n.

    ``targets`` (*by, graph_id, id) restrict it to them and what lies above them;
    each combination of ``by`` is an order of its own. Without them whole graphs
    are ordered.

    Commands that every way up passes divide a graph into pieces, one after the
    other. A piece's commands, all of which are concurrent with some other, meet in
    one task; runs without concurrent commands need none.
    """
    key = [*by, "graph_id"]
    # written first: the range sort reads its input twice, to find the ranges and to sort
    every = cut(ordered(commands, edges, targets, by, segments))
    return sequences(every, key, [F.col("anchor"), F.col("n")]).select(*key, "id", "position")


def ordered(commands: DataFrame, edges: DataFrame, targets: DataFrame | None = None, by: tuple[str, ...] = (), segments: Segments | None = None) -> DataFrame:
    """(*by, graph_id, id, anchor, n): what braid() numbers; smaller (anchor, n) comes earlier."""
    key = [*by, "graph_id"]
    segments = segments or contract(commands, edges)
    cuts = segment_cuts(segments)
    targets = heads(commands, edges).select("graph_id", "id") if targets is None else targets.select(*key, "id").distinct()
    covered = reach(segments, targets, by)
    rows = cut(waists(segments, cuts, covered, targets, by))
    # a piece is known by the depth of the last command before it that all pass
    before = Window.partitionBy(*key).orderBy("top", "seg").rowsBetween(Window.unboundedPreceding, -1)
    floor = F.coalesce(F.max(F.when(F.col("alone"), F.col("end"))).over(before), F.lit(-1).cast("long"))
    rows = rows.withColumn("floor", floor).select(*key, "seg", "top", "end", "alone", "floor")
    placed = segments.places.join(rows, ["graph_id", "seg"]).filter("top + off <= end")
    placed = placed.join(commands.select("graph_id", "id", "priority_rank", "priority_n"), ["graph_id", "id"])
    placed = cut(placed.select(*key, "id", "priority_rank", "priority_n", "alone", F.when(F.col("alone"), F.col("top") + F.col("off")).otherwise(F.col("floor")).alias("anchor")))
    lone = placed.filter("alone").select(*key, "id", "priority_rank", "anchor", F.lit(0).cast("long").alias("n"))
    shared = placed.filter("NOT alone")
    parents = edges.groupBy("graph_id", "id").agg(F.sort_array(F.collect_set("parent_id")).alias("parents"))
    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in key)
    schema = f"{kinds}, id {commands.schema['id'].dataType.simpleString()}, priority_rank int, anchor long, n long"
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def one(rows: list[dict]) -> list[dict]:
        above = {r["id"]: r["parents"] for r in rows if r["parents"] is not None}
        rank = {r["id"]: (r["priority_rank"], r["priority_n"], r["id"]) for r in rows}
        first = {c: rows[0][c] for c in [*key, "anchor"]}
        return [first | {"id": i, "priority_rank": 1, "n": n} for n, i in enumerate(order(list(rank), above, rank, set()), 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                this = tuple(row[c] for c in [*key, "anchor"])
                if rows and this != held:
                    out += one(rows)
                    rows = []
                held = this
                rows.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=out_schema)
        if rows:
            yield pa.RecordBatch.from_pylist(one(rows), schema=out_schema)

    # many small pieces in a batch: a call for each would cost more than their order
    pieces = shared.join(parents, ["graph_id", "id"], "left").repartition(*key, "anchor").sortWithinPartitions(*key, "anchor")
    pieces = pieces.mapInArrow(run, schema)
    return lone.filter("priority_rank > 0").unionByName(pieces).drop("priority_rank")


def facts_at(changes: DataFrame, fact: Fact, commands: DataFrame, edges: DataFrame, targets: DataFrame, by: tuple[str, ...] = (), segments: Segments | None = None) -> DataFrame:
    """Facts as they are at each target command: the changes (graph_id, id, seq,
    the fact's columns, deleted) of it and of all above it, in their order. targets:
    (*by, graph_id, id); with several for one graph ``by`` tells them apart."""
    key = [*by, "graph_id"]
    placed = ordered(commands, edges, targets, by, segments).select(*key, "id", F.struct("anchor", "n").alias("position"))
    kinds = {c: placed.schema[c].dataType.simpleString() for c in key}
    scoped = Fact(fact.name, kinds | fact.key, fact.value, check=False)
    return latest(changes.join(placed, ["graph_id", "id"]), scoped, ["position", "seq"])


def fold(rows: DataFrame, key: list[str], order_by: list[str], step, state, schema: str) -> DataFrame:
    """Replays commands whose effect depends on the state that earlier ones left.

    step(state, row) returns (state, result); a key's rows come in order and only
    the current key's state is held, so a key may have any number of rows. Keys
    are independent: choose them so that no rule reads another key's facts. A null
    key is a key. A rejected row must leave the state as it was: step returns the
    old state then, and makes a new one instead of changing it in place.
    """
    sorted_rows = rows.repartition(*key).sortWithinPartitions(*key, *order_by)
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                this = tuple(row[k] for k in key)
                if this != held:
                    now, held = state(), this
                now, result = step(now, row)
                out.append(result)
            yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    return sorted_rows.mapInArrow(run, schema)
