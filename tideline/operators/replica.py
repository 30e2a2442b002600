"""What two replicas of a command log need of each other. All limits are a graph's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .graph import Segments, contract, inside, reach, synthetic_head

SAMPLE = 100
BATCH = 100
PEER_HEADS = 10


def ingest(known: DataFrame, arriving: DataFrame, edges: DataFrame, accepted: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new commands, those refused with a reason). known and arriving: graph_id, id, ...

    A known command is skipped. One that comes twice is taken once, of differing
    rows the least. Refused are: ``init``, a command without parents that isn't its
    graph's first; ``missing parent``, one with a parent that is neither known nor
    arriving; ``rule``, one for which ``accepted`` (a condition on its row) doesn't
    hold; ``refused parent``, everything below a refused one. edges are those of
    the arriving commands.
    """
    on = ["graph_id", "id"]
    own = arriving.columns
    new = arriving.join(known.select(*on).distinct(), on, "left_anti")
    new = new.groupBy(*on).agg(F.min(F.struct(*own)).alias("_row"))
    new = cut(new.select("_row.*"))
    there = known.select(*on).union(new.select(*on)).distinct()
    lost = edges.join(there.withColumnRenamed("id", "parent_id"), ["graph_id", "parent_id"], "left_anti").select(*on).distinct()
    started = known.select("graph_id").distinct().withColumn("_started", F.lit(True))
    child = edges.select(*on).distinct().withColumn("_child", F.lit(True))
    good = F.lit(True) if accepted is None else F.coalesce(accepted, F.lit(False))
    # of several first commands of a new graph the one with the smallest id begins it
    first = Window.partitionBy("graph_id", F.col("_child").isNull()).orderBy("id")
    rows = new.withColumn("_good", good).join(lost.withColumn("_lost", F.lit(True)), on, "left").join(child, on, "left").join(started, "graph_id", "left")
    rows = rows.withColumn("_init", F.col("_child").isNull() & (F.col("_started").isNotNull() | (F.row_number().over(first) > 1)))
    reason = F.when(F.col("_lost"), "missing parent").when(F.col("_init"), "init").when(~F.col("_good"), "rule")
    rows = cut(rows.withColumn("reason", reason).select(*own, "reason"))
    segments = contract(new, edges)
    below = inside(segments, reach(segments, rows.filter("reason IS NOT NULL").select(*on), down=True), down=True).withColumn("_below", F.lit(True))
    rows = cut(rows.join(below, on, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_below"), "refused parent"))).select(*own, "reason"))
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def needed(mine: DataFrame, sample: DataFrame, edges: DataFrame, segments: Segments | None = None) -> DataFrame:
    """My commands that a peer lacks which has the sampled ones and all above them."""
    segments = segments or contract(mine, edges)
    return mine.join(inside(segments, reach(segments, sample)), ["graph_id", "id"], "left_anti")


def deepest(commands: DataFrame, n: int, smallest: bool = False) -> DataFrame:
    """The n deepest commands of each graph, or the n least deep; ties by id."""
    cut_order = F.col("max_cut") if smallest else F.desc("max_cut")
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(cut_order, "id"))
    return commands.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def sample(commands: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The deepest commands of each graph: what a request tells the peer."""
    return deepest(commands, n)


def batches(commands: DataFrame, position: str, n: int = BATCH) -> DataFrame:
    """commands with the number of the message each is sent in; position is that in
    its graph, parents first."""
    return commands.withColumn("batch", F.floor((F.col(position) - 1) / n).cast("long"))


def antichain(addresses: DataFrame, commands: DataFrame, edges: DataFrame, most: int | None = PEER_HEADS, segments: Segments | None = None) -> DataFrame:
    """Known peer heads (graph_id, id, max_cut) without those that lie above another
    of the same graph, each once; the deepest ``most`` of a graph. Unknown ones are ignored."""
    segments = segments or contract(commands, edges)
    known = addresses.join(commands.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_semi").dropDuplicates(["graph_id", "id"])
    above = inside(segments, reach(segments, known.select("graph_id", "id"), strict=True))
    top = known.join(above, ["graph_id", "id"], "left_anti")
    return top if most is None else deepest(top, most)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two replicas has, with ``side``; none if they agree."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def graph_differences(mine: dict[str, DataFrame], theirs: dict[str, DataFrame]) -> DataFrame:
    """(graph_id, what, side, n): in which of the given tables (commands, heads,
    facts; each with a graph_id) graphs differ, and by how many rows."""
    out = None
    for what, rows in mine.items():
        found = differences(rows, theirs[what].select(*rows.columns)).groupBy("graph_id", "side").agg(F.count("*").alias("n"))
        found = found.select("graph_id", F.lit(what).alias("what"), "side", "n")
        out = found if out is None else out.union(found)
    return out


def sync_wanted(hellos: DataFrame, commands: DataFrame, own_heads: DataFrame) -> DataFrame:
    """Hellos (graph_id, id as text) with ``sync``: false if the peer's head is the
    one that my heads come to, or a command that I have."""
    mine = synthetic_head(own_heads).select("graph_id", F.col("head").alias("id"))
    known = commands.select("graph_id", F.col("id").cast("string").alias("id")).union(mine).distinct().withColumn("_known", F.lit(True))
    return hellos.join(known, ["graph_id", "id"], "left").withColumn("sync", F.col("_known").isNull()).drop("_known")


def merge_policy(sides: DataFrame) -> DataFrame:
    """(graph_id, policy) of the greatest serial; of equal ones the rightmost ``side``'s."""
    return sides.groupBy("graph_id").agg(F.max_by("policy", F.struct("serial", "side")).alias("policy"))
