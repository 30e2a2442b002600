"""Facts of an unbounded command log, by Structured Streaming.

Late branches are never dropped: each micro-batch is merged into the snapshot by
position, so a command that arrives late takes the place its position gives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.facts import latest
from ..operators.schema import Fact
from ..sources.snapshots import Snapshots


def merge_into(snapshots: Snapshots, fact: Fact, position: list[str]):
    """A foreachBatch function: the snapshot holds each key's last change, with
    its position and deletions, so that merging a batch again changes nothing."""
    whole = Fact(fact.name, fact.key, fact.value | {p: "bigint" for p in position})

    def run(batch: DataFrame, batch_id: int) -> None:
        columns = [*fact.key, *fact.value, *position, "deleted"]
        seen = snapshots.version()
        changes = batch.select(*columns)
        if seen:
            changes = changes.union(snapshots.read(seen).select(*columns))
        snapshots.commit(latest(changes, whole, position, keep_deleted=True), seen)
        snapshots.prune()

    return run


def fold_stream(changes: DataFrame, snapshots: Snapshots, fact: Fact, position: list[str], checkpoint: str):
    """Runs over what has arrived, in micro-batches, and stops."""
    query = changes.writeStream.foreachBatch(merge_into(snapshots, fact, position)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return snapshots


def current(snapshots: Snapshots, fact: Fact) -> DataFrame:
    return snapshots.read().filter("NOT deleted").select(*fact.key, *fact.value)


def windowed_counts(events: DataFrame, length: str, late: str) -> DataFrame:
    """Event-time counts; works on a stream (append mode) and on a table alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))
