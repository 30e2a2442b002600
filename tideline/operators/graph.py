"""Command graphs: vertices (graph_id, id, ...) and edges (graph_id, id, parent_id).

Most commands have one parent, whose only child they are. Such runs are contracted
into segments first, by pointer doubling: a run of n commands takes log n rounds.
What goes level by level (depth, ancestors) then goes over segments, whose number
grows with the forks and merges, not with the commands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import merge_id
from ..session import cut


@dataclass(frozen=True)
class Segments:
    """places (graph_id, id, seg, off): a command's segment and its steps below the
    segment's topmost command; sizes (graph_id, seg, size); links
    (graph_id, seg, parent) between segments, parent's last command being a parent
    of seg's first."""

    places: DataFrame
    sizes: DataFrame
    links: DataFrame


def heads(commands: DataFrame, edges: DataFrame) -> DataFrame:
    """Commands that are no command's parent."""
    parents = edges.select("graph_id", F.col("parent_id").alias("id")).distinct()
    return commands.join(parents, ["graph_id", "id"], "left_anti")


def arrivals(edges: DataFrame) -> DataFrame:
    """How many children each parent has."""
    return edges.groupBy("graph_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("arrivals"))


def places(rows: DataFrame, chain: list[str], order: list[str], bucket, name: str = "place") -> DataFrame:
    """Rows with their place (from 1) along their chain.

    ``bucket`` is a column that doesn't fall along the order (say, the day), so
    that a long chain is numbered bucket by bucket and only the buckets' sizes
    are summed along the chain.
    """
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*chain, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*chain).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*chain, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*chain, "_bucket").orderBy(*order)
    rows = rows.withColumn("_rank", F.row_number().over(inside))
    return rows.join(sizes, [*chain, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_bucket", "_rank", "_before")


def contract(commands: DataFrame, edges: DataFrame) -> Segments:
    """The graphs' segments. Edges to commands that aren't there are left out."""
    ids = cut(commands.select("graph_id", "id").distinct())
    links = edges.select("graph_id", "id", "parent_id").distinct()
    links = links.join(ids, ["graph_id", "id"], "left_semi").join(ids.withColumnRenamed("id", "parent_id"), ["graph_id", "parent_id"], "left_semi")
    links = cut(links.select("graph_id", "id", "parent_id"))
    single = links.groupBy("graph_id", "id").agg(F.count("*").alias("n"), F.first("parent_id").alias("parent_id")).filter("n = 1").drop("n")
    only = links.groupBy("graph_id", "parent_id").agg(F.count("*").alias("n")).filter("n = 1").select("graph_id", "parent_id")
    inner = single.join(only, ["graph_id", "parent_id"])
    state = ids.join(inner, ["graph_id", "id"], "left").select(
        "graph_id", "id", F.coalesce("parent_id", "id").alias("seg"), F.col("parent_id").isNotNull().cast("long").alias("off"), F.col("parent_id").isNull().alias("done")
    )
    state, most = cut(state), ids.count()
    settled, front = state.filter("done"), state.filter("NOT done")
    reach = 1
    while not front.isEmpty():
        if reach > 2 * most:
            raise ValueError("the graph has a cycle")
        reach *= 2
        at = settled.union(front).select("graph_id", F.col("id").alias("seg"), F.col("seg").alias("_seg"), F.col("off").alias("_off"), F.col("done").alias("_done"))
        moved = front.join(at, ["graph_id", "seg"])
        moved = cut(moved.select("graph_id", "id", F.col("_seg").alias("seg"), (F.col("off") + F.col("_off")).alias("off"), F.col("_done").alias("done")))
        settled, front = settled.union(moved.filter("done")), moved.filter("NOT done")  # settled rows aren't written again
    return segments_of(settled.drop("done"), links)


def segments_of(places: DataFrame, edges: DataFrame) -> Segments:
    """Segments that are known beforehand, such as each author's chain: places are
    (graph_id, id, seg, off), seg any name that is unique in its graph. Only a
    segment's first command (off 0) may have other parents than the one before it,
    and only its last one other children."""
    places = cut(places.select("graph_id", "id", "seg", "off"))
    sizes = cut(places.groupBy("graph_id", "seg").agg((F.max("off") + 1).alias("size")))
    tops = places.filter("off = 0").select("graph_id", "id", "seg")
    above = places.select("graph_id", F.col("id").alias("parent_id"), F.col("seg").alias("parent"))
    between = edges.select("graph_id", "id", "parent_id").join(tops, ["graph_id", "id"]).join(above, ["graph_id", "parent_id"])
    return Segments(places, sizes, cut(between.select("graph_id", "seg", "parent").distinct()))


def segment_cuts(segments: Segments) -> DataFrame:
    """(graph_id, seg, size, cut): the depth of each segment's first command. One
    round for each level of the segments."""
    sizes, links = segments.sizes, segments.links
    front = cut(sizes.join(links, ["graph_id", "seg"], "left_anti").select("graph_id", "seg", F.lit(0).cast("long").alias("cut")))
    done, rounds, most = front, 0, sizes.count()
    while True:
        rounds += 1
        above = front.join(sizes, ["graph_id", "seg"]).select("graph_id", F.col("seg").alias("parent"), (F.col("cut") + F.col("size")).alias("cut"))
        front = cut(above.join(links, ["graph_id", "parent"]).groupBy("graph_id", "seg").agg(F.max("cut").alias("cut")))
        if front.isEmpty():
            break
        if rounds > most:
            raise ValueError("the graph has a cycle")
        done = done.union(front)
    found = cut(sizes.join(done.groupBy("graph_id", "seg").agg(F.max("cut").alias("cut")), ["graph_id", "seg"], "left"))
    if not found.filter("cut IS NULL").isEmpty():
        raise ValueError("the graph has a cycle")
    return found


def max_cut(commands: DataFrame, edges: DataFrame, segments: Segments | None = None) -> DataFrame:
    """(graph_id, id, max_cut): 0 without parents, else one more than the deepest parent's."""
    segments = segments or contract(commands, edges)
    cuts = segment_cuts(segments).select("graph_id", "seg", "cut")
    return segments.places.join(cuts, ["graph_id", "seg"]).select("graph_id", "id", (F.col("cut") + F.col("off")).alias("max_cut"))


def reach(segments: Segments, seeds: DataFrame, by: tuple[str, ...] = (), down: bool = False, strict: bool = False) -> DataFrame:
    """How far into each segment the seeds and all above them go: (*by, graph_id,
    seg, upto); with ``down`` all below them, from ``upto`` on. seeds have graph_id,
    id and the columns ``by``, each combination of which is a search of its own; a
    seed that isn't there is ignored. ``strict`` leaves the seeds themselves out
    unless another seed reaches them."""
    key = [*by, "graph_id"]
    here, next_ = ("parent", "seg") if down else ("seg", "parent")
    sizes, links = segments.sizes, segments.links
    own = seeds.select(*key, "id").distinct().join(segments.places, ["graph_id", "id"])
    step = (1 if down else -1) if strict else 0
    part = cut(own.groupBy(*key, "seg").agg(((F.min if down else F.max)("off") + step).alias("upto")))
    front = part.select(*key, "seg")
    whole = None
    while True:
        found = front.withColumnRenamed("seg", here).join(links, ["graph_id", here]).select(*key, F.col(next_).alias("seg")).distinct()
        front = cut(found if whole is None else found.join(whole, [*key, "seg"], "left_anti"))
        if front.isEmpty():
            break
        whole = front if whole is None else cut(whole.union(front))
    if whole is None:
        return part
    full = whole.join(sizes, ["graph_id", "seg"]).select(*key, "seg", (F.lit(0).cast("long") if down else F.col("size") - 1).alias("upto"))
    return cut(part.union(full).groupBy(*key, "seg").agg((F.min if down else F.max)("upto").alias("upto")))


def inside(segments: Segments, covered: DataFrame, by: tuple[str, ...] = (), down: bool = False) -> DataFrame:
    """(*by, graph_id, id) of the commands that reach() covers."""
    rows = segments.places.join(covered, ["graph_id", "seg"])
    return rows.filter("off >= upto" if down else "off <= upto").select(*by, "graph_id", "id")


def ancestors(commands: DataFrame, edges: DataFrame, seeds: DataFrame, segments: Segments | None = None) -> DataFrame:
    """(graph_id, id) of the seeds and of everything above any of them."""
    segments = segments or contract(commands, edges)
    return inside(segments, reach(segments, seeds))


def is_ancestor(pairs: DataFrame, commands: DataFrame, edges: DataFrame, segments: Segments | None = None) -> DataFrame:
    """pairs (graph_id, a, b, ...) with ``above``: whether a lies strictly above b.
    Each pair of segments searches upwards from b's, no higher than a's."""
    segments = segments or contract(commands, edges)
    cuts, links = segment_cuts(segments).select("graph_id", "seg", "cut"), segments.links
    rest = [c for c in pairs.columns if c not in ("graph_id", "a", "b")]
    asked = pairs.select("graph_id", "a", "b", F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0)]).alias("_rest"))
    for side in ("a", "b"):
        at = segments.places.join(cuts, ["graph_id", "seg"]).select("graph_id", F.col("id").alias(side), F.col("seg").alias(f"s{side}"), F.col("off").alias(f"o{side}"), F.col("cut").alias(f"c{side}"))
        asked = asked.join(at, ["graph_id", side], "left")
    # most pairs are settled by their places; only the others look for a way up
    settled = F.when(F.col("sa") == F.col("sb"), F.col("oa") < F.col("ob")).when(F.col("ca") < F.col("cb"), F.lit(None)).otherwise(F.lit(False))
    asked = asked.withColumn("above", settled)
    asked = cut(asked.select("graph_id", "a", "b", "_rest", "above", *[F.when(F.col("above").isNull(), F.col(c)).alias(c) for c in ("sa", "sb", "ca")]))
    goal = ["graph_id", "sa", "sb"]
    waiting = asked.filter("above IS NULL")
    front = cut(waiting.select(*goal, "ca", F.col("sb").alias("seg")).distinct())
    hits = None
    while not front.isEmpty():
        up = front.join(links, ["graph_id", "seg"]).select(*goal, "ca", F.col("parent").alias("seg"))
        up = cut(up.join(cuts, ["graph_id", "seg"]).filter("cut > ca OR seg = sa").select(*goal, "ca", "seg").distinct())
        met = up.filter("seg = sa").select(*goal)
        hits = met if hits is None else hits.union(met)
        front = cut(up.filter("seg <> sa").join(met, goal, "left_anti"))
    found = asked.filter("above IS NOT NULL").select("graph_id", "a", "b", "_rest", "above")
    if hits is not None:
        linked = waiting.drop("above").join(hits.distinct().withColumn("above", F.lit(True)), goal, "left")
        found = found.union(linked.select("graph_id", "a", "b", "_rest", F.coalesce("above", F.lit(False)).alias("above")))
    return found.select("graph_id", "a", "b", *[F.col(f"_rest.`{c}`") for c in rest], "above")


def waists(segments: Segments, cuts: DataFrame, covered: DataFrame, heads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The covered segments (*by, graph_id, seg, top, end: depths of their first
    and last covered commands) with ``alone``: whether every way up from the heads
    passes their commands. ``least`` is the depth of the shallowest head.

    A level of the graph is passed by all if it holds one command and no edge leads
    over it: commands and edges are counted as their levels open and close. A
    graph's segments, not its commands, are put in order of level in one task.
    """
    key = [*by, "graph_id"]
    spans = cut(covered.join(cuts, ["graph_id", "seg"]).select(*key, "seg", "size", F.col("cut").alias("top"), (F.col("cut") + F.col("upto")).alias("end")))
    above = spans.select(*key, F.col("seg").alias("parent"), F.col("end").alias("_above"))
    over = spans.join(segments.links, ["graph_id", "seg"]).join(above, [*key, "parent"]).select(*key, F.col("_above").alias("_from"), "top").filter("_from + 1 < top")

    def turn(level: Column, n: int) -> Column:
        return F.struct(level.alias("level"), F.lit(n).alias("n"))

    turns = spans.select(*key, F.explode(F.array(turn(F.col("top"), 1), turn(F.col("end") + 1, -1))).alias("t"))
    turns = turns.union(over.select(*key, F.explode(F.array(turn(F.col("_from") + 1, 1), turn(F.col("top"), -1))).alias("t")))
    along = Window.partitionBy(*key).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    open_at = turns.groupBy(*key, "t.level").agg(F.sum("t.n").alias("n")).withColumn("open", F.sum("n").over(along))
    at = heads.join(segments.places, ["graph_id", "id"]).join(cuts, ["graph_id", "seg"])
    least = at.groupBy(*key).agg(F.min(F.col("cut") + F.col("off")).alias("least"))
    rows = spans.join(open_at.select(*key, F.col("level").alias("top"), "open"), [*key, "top"]).join(least, key)
    return rows.select(*key, "seg", "top", "end", "least", ((F.col("open") == 1) & (F.col("top") <= F.col("least"))).alias("alone"))


def common_ancestor(nodes: DataFrame, commands: DataFrame, edges: DataFrame, segments: Segments | None = None) -> DataFrame:
    """(graph_id, id, max_cut): the deepest command that every way from the given
    nodes to the root passes (a node counts as passed by its own); none for a graph
    without such a command."""
    segments = segments or contract(commands, edges)
    cuts = segment_cuts(segments)
    nodes = nodes.select("graph_id", "id").distinct()
    rows = waists(segments, cuts, reach(segments, nodes), nodes).filter("alone")
    level = F.least("end", "least")
    best = rows.groupBy("graph_id").agg(F.max_by(F.struct("seg", (level - F.col("top")).alias("off"), level.alias("max_cut")), level).alias("b"))
    return best.select("graph_id", "b.*").join(segments.places, ["graph_id", "seg", "off"]).select("graph_id", "id", "max_cut")


def locate(commands: DataFrame, addresses: DataFrame) -> DataFrame:
    """The commands at the given addresses (graph_id, id, max_cut); both must agree."""
    return commands.join(addresses.select("graph_id", "id", "max_cut").distinct(), ["graph_id", "id", "max_cut"], "left_semi")


def commands_from(segments: Segments, locations: DataFrame) -> DataFrame:
    """The rest of each location's segment: (graph_id, start, id, off) of the
    commands from the location's (graph_id, id) on."""
    at = locations.select("graph_id", "id").distinct().join(segments.places, ["graph_id", "id"])
    at = at.select("graph_id", "seg", F.col("id").alias("start"), F.col("off").alias("_from"))
    return segments.places.join(at, ["graph_id", "seg"]).filter("off >= _from").select("graph_id", "start", "id", (F.col("off") - F.col("_from")).alias("off"))


def latest_heads(commands: DataFrame, edges: DataFrame, segments: Segments | None = None) -> DataFrame:
    """(graph_id, head_id): the deepest head of each graph, of equal ones the smallest id."""
    deep = heads(commands, edges).select("graph_id", "id").join(max_cut(commands, edges, segments), ["graph_id", "id"])
    return deep.groupBy("graph_id").agg(F.min_by("id", F.struct(-F.col("max_cut"), "id")).alias("head_id"))


def _fold_heads(heads: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs the heads first in, first out, until each graph has one: (graph_id,
    head), and the merges of each round. A round halves all graphs' queues: an odd
    last head goes to the front of the next round."""
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("id")) - 1
    n = F.count("*").over(Window.partitionBy("graph_id"))
    rows = cut(heads.select("graph_id", "id").distinct().select("graph_id", rank.cast("long").alias("i"), n.alias("n"), F.col("id").cast("string").alias("id")))
    merges = []
    while not rows.filter("n > 1").isEmpty():
        odd = F.col("n") % 2
        pair = F.when((odd == 1) & (F.col("i") == F.col("n") - 1), F.lit(-1).cast("long")).otherwise(F.expr("i div 2"))
        met = rows.groupBy("graph_id", "n", pair.alias("p")).agg(F.min_by("id", "i").alias("left"), F.max_by("id", "i").alias("right"), F.count("*").alias("c"))
        met = cut(met.withColumn("id", F.when(F.col("c") == 2, merge_id(F.col("left"), F.col("right"))).otherwise(F.col("left"))))
        merges.append(met.filter("c = 2").select("graph_id", "id", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")))
        rows = met.select("graph_id", (F.col("p") + odd * (F.col("n") > 1).cast("long")).alias("i"), F.expr("(n + 1) div 2").alias("n"), "id")
    return rows.select("graph_id", F.col("id").alias("head")), merges


def synthetic_head(heads: DataFrame) -> DataFrame:
    """(graph_id, head): the id of the merge that a graph's heads would come to; a
    single head is its own. Ids are text."""
    return _fold_heads(heads)[0]


def collapse_heads(heads: DataFrame) -> DataFrame:
    """(graph_id, id, left, right) of the merge commands that leave each graph one head."""
    found = None
    for m in _fold_heads(heads)[1]:
        found = m if found is None else found.union(m)
    return found if found is not None else heads.select("graph_id", *[F.col("id").cast("string").alias(c) for c in ("id", "left", "right")]).limit(0)
