import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tideline.functions import foreign
from tideline.functions import scalars as S
from tideline.operators import braid, facts, graph, reads, replica, rules
from tideline.operators.schema import Enum, Fact, SchemaError, facts_from_json
from tideline.session import cut, cuts_of, scratch
from tideline.sources.snapshots import Snapshots
from tideline.streaming import folds, sinks

F2 = Fact("F", {"i": "bigint", "j": "bigint"}, {"v": "string"})


def ranks(ids, merges=(), finalize=()):
    return {i: (0, 0, i) if i in merges else (2, 0, i) if i in finalize else (1, i, i) for i in ids}


def test_order_smallest_key_wins_the_last_place():
    parents = {2: [1], 3: [1], 5: [2, 3], 4: [2], 6: [5, 4]}
    assert braid.order(list(range(1, 7)), parents, ranks(range(1, 7), {5, 6}), set()) == [1, 2, 4, 3]


def test_order_of_two_heads_does_not_depend_on_input_order():
    parents = {2: [1], 3: [2], 4: [3], 5: [4], 6: [5], 7: [6], 8: [4], 9: [8], 10: [9]}
    want = [1, 2, 3, 4, 8, 9, 10, 5, 6, 7]
    for seed in range(5):
        ids = list(range(1, 11))
        random.Random(seed).shuffle(ids)
        assert braid.order(ids, parents, ranks(ids), set()) == want


def test_parallel_finalizing_commands_are_refused():
    with pytest.raises(braid.ParallelFinalize):
        braid.order([1, 2, 3], {2: [1], 3: [1]}, ranks([1, 2, 3], finalize={2, 3}), set())


def test_braid_of_graphs_and_measures(spark):
    commands = spark.createDataFrame([(0, i, 0 if i > 4 else 1, i) for i in range(1, 7)] + [(1, 1, 3, 0), (1, 2, 1, 9)], "graph_id long, id long, priority_rank int, priority_n long")
    edges = spark.createDataFrame([(0, 2, 1), (0, 3, 1), (0, 5, 2), (0, 5, 3), (0, 4, 2), (0, 6, 5), (0, 6, 4), (1, 2, 1)], "graph_id long, id long, parent_id long")
    got = {}
    for r in braid.braid(commands, edges).orderBy("graph_id", "position").collect():
        got.setdefault(r.graph_id, []).append(r.id)
    assert got == {0: [1, 2, 4, 3], 1: [1, 2]}
    depth = graph.max_cut(commands.select("graph_id", "id"), edges)
    assert {(r.graph_id, r.id): r.max_cut for r in depth.collect()} == {(0, 1): 0, (0, 2): 1, (0, 3): 1, (0, 4): 2, (0, 5): 2, (0, 6): 3, (1, 1): 0, (1, 2): 1}
    assert [(r.graph_id, r.id) for r in graph.heads(commands, edges).orderBy("graph_id").collect()] == [(0, 6), (1, 2)]
    lca = lambda *ids: [r.id for r in graph.common_ancestor(spark.createDataFrame([(0, i) for i in ids], "graph_id long, id long"), commands, edges).collect()]
    assert lca(5, 4) == [1]  # 5 also comes from 3
    assert lca(4, 2) == [2]
    assert lca(6) == [6]
    assert [r.id for r in replica.needed(commands.filter("graph_id = 0"), spark.createDataFrame([(0, 4)], "graph_id long, id long"), edges).orderBy("id").collect()] == [3, 5, 6]
    heads = depth.filter("graph_id = 0 AND id IN (2, 3, 4)").union(spark.createDataFrame([(0, 99, 5)], depth.schema))
    assert sorted(r.id for r in replica.antichain(heads, commands, edges).collect()) == [3, 4]


def chain(*ids):
    return [(b, a) for a, b in zip(ids, ids[1:], strict=False)]


# Graphs and the orders that they must give.
GOLDEN = {
    "one head": (chain("a", "b") + chain("a", "c") + [("ma", "b"), ("ma", "c")] + chain("b", "d") + [("mb", "ma"), ("mb", "d")], {"ma", "mb"}, set(), "a:b:d:c"),
    "four heads": (
        chain("a", "1", "2", "3", "4", "6", "7") + chain("3", "5", "8") + [("9", "6"), ("9", "8")] + chain("9", "aa") + chain("7", "a1", "a2") + [("a3", "aa"), ("a3", "a2")]
        + chain("a3", "a6", "a4") + chain("a3", "a7", "a5") + [("a8", "a4"), ("a8", "a5")] + chain("9", "42", "43") + chain("42", "45", "46") + chain("45", "47", "48"),
        {"9", "a3", "a8"}, set(), "a:1:2:3:5:8:4:6:42:45:47:48:46:43:aa:7:a1:a2:a7:a6:a5:a4",
    ),
    "two heads": (chain("a", "b", "c", "d", "e", "f", "g") + chain("d", "h", "i", "j"), set(), set(), "a:b:c:d:h:i:j:e:f:g"),
    "finalizing": (
        chain("a", "b", "c", "d", "e", "f", "g") + chain("d", "h", "i", "j") + chain("e", "fff1", "x", "y", "fff2"), set(), {"fff1", "fff2"}, "a:b:c:d:e:fff1:x:y:fff2:h:i:j:f:g",
    ),
}


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def number(i):
    n = 0
    for c in i:
        n = n * 58 + BASE58.index(c)
    return n


def key_of(i, merges, finalizing):
    """The ids are base-58 numbers there, the priority their last byte."""
    return 0 if i in merges else 2 if i in finalizing else 1, (number(i) % 256 << 32) + number(i)


def test_golden_orders(spark):
    nodes, edges = [], []
    for name, (links, merges, finalizing, _) in GOLDEN.items():
        nodes += [(name, i, *key_of(i, merges, finalizing)) for i in sorted({x for e in links for x in e})]
        edges += [(name, *e) for e in links]
    commands = spark.createDataFrame(nodes, "graph_id string, id string, priority_rank int, priority_n long")
    got = {}
    for r in braid.braid(commands, spark.createDataFrame(edges, "graph_id string, id string, parent_id string")).orderBy("graph_id", "position").collect():
        got.setdefault(r.graph_id, []).append(r.id)
    assert {k: ":".join(v) for k, v in got.items()} == {k: v[3] for k, v in GOLDEN.items()}


def test_two_finalizing_branches_are_refused(spark):
    links = chain("a", "b", "c", "d", "e", "f", "g") + chain("d", "h", "i", "j") + chain("e", "fff1") + chain("i", "fff2")
    commands = spark.createDataFrame([(0, i, *key_of(i, set(), {"fff1", "fff2"})) for i in sorted({x for e in links for x in e})], "graph_id long, id string, priority_rank int, priority_n long")
    with pytest.raises(Exception, match="ParallelFinalize"):
        braid.braid(commands, spark.createDataFrame([(0, *e) for e in links], "graph_id long, id string, parent_id string")).collect()


def random_graphs(seed, n=25):
    rng = random.Random(seed)
    graphs = {}
    for g in range(n):
        parents, size = {0: []}, rng.randrange(2, 22)
        for i in range(1, size):
            parents[i] = rng.sample(range(max(0, i - 5), i), min(i, 2)) if rng.random() < 0.25 and i > 1 else [rng.choice([i - 1, rng.randrange(i)])]
        graphs[g] = parents
    return graphs


def above(parents, i):
    out, todo = set(), list(parents[i])
    while todo:
        p = todo.pop()
        if p not in out:
            out.add(p)
            todo += parents[p]
    return out


def test_random_graphs(spark):
    graphs = random_graphs(4)
    nodes = [(g, i, 0 if len(p) > 1 else 1, (i * 7919 + g) % 5) for g, ps in graphs.items() for i, p in ps.items()]
    links = [(g, i, p) for g, ps in graphs.items() for i, p2 in ps.items() for p in p2]
    commands = spark.createDataFrame(nodes, "graph_id long, id long, priority_rank int, priority_n long").repartition(3)
    edges = spark.createDataFrame(links, "graph_id long, id long, parent_id long").repartition(3)
    up = {(g, i): above(ps, i) for g, ps in graphs.items() for i in ps}
    depth = {}
    for g, ps in graphs.items():
        for i in ps:
            depth[g, i] = 1 + max((depth[g, p] for p in ps[i]), default=-1)
    segments = graph.contract(commands, edges)
    assert {(r.graph_id, r.id): r.max_cut for r in graph.max_cut(commands, edges, segments).collect()} == depth
    pairs = spark.createDataFrame([(g, a, b) for g, ps in graphs.items() for a in ps for b in ps] + [(0, 0, 999)], "graph_id long, a long, b long")
    assert all(r.above == ((r.graph_id, r.b) in up and r.a in up[r.graph_id, r.b]) for r in graph.is_ancestor(pairs, commands, edges, segments).collect())

    rng = random.Random(1)
    asked = {g: set(rng.sample(sorted(ps), min(len(ps), rng.randrange(1, 4)))) for g, ps in graphs.items()}
    nodes_asked = spark.createDataFrame([(g, i) for g, x in asked.items() for i in x], "graph_id long, id long")
    want = {}
    for g, ps in graphs.items():
        for c in ps:
            without = {k: [p for p in v if p != c] for k, v in ps.items()}
            if all(c in up[g, i] | {i} for i in asked[g]) and (c == 0 or all(i == c or 0 not in above(without, i) | {i} for i in asked[g])):
                want[g] = max(want.get(g, 0), depth[g, c] * 100 + c)
    assert {r.graph_id: r.max_cut * 100 + r.id for r in graph.common_ancestor(nodes_asked, commands, edges, segments).collect()} == want

    got = {}
    for r in braid.braid(commands, edges, segments=segments).orderBy("graph_id", "position").collect():
        got.setdefault(r.graph_id, []).append(r.id)
    rank = {g: {i: (0 if len(p) > 1 else 1, (i * 7919 + g) % 5, i) for i, p in ps.items()} for g, ps in graphs.items()}
    assert got == {g: braid.order(list(ps), ps, rank[g], set()) for g, ps in graphs.items()}
    got = {}
    for r in braid.braid(commands, edges, nodes_asked, segments=segments).orderBy("graph_id", "position").collect():
        got.setdefault(r.graph_id, []).append(r.id)
    scope = {g: asked[g].union(*(up[g, i] for i in asked[g])) for g in graphs}
    assert got == {g: braid.order(sorted(scope[g]), {i: ps[i] for i in scope[g]}, rank[g], set()) for g, ps in graphs.items()}


def test_a_deep_chain_takes_few_rounds(spark):
    n = 10_000
    commands = spark.range(n).selectExpr("0L AS graph_id", "id")
    edges = spark.range(1, n).selectExpr("0L AS graph_id", "id", "id - 1 AS parent_id")
    began = time.monotonic()
    assert graph.max_cut(commands, edges).filter("max_cut <> id").count() == 0
    assert time.monotonic() - began < 60


def test_cycles_are_refused(spark):
    ring = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 1)], "graph_id long, id long, parent_id long")
    fork = spark.createDataFrame([(0, 1, 0), (0, 1, 3), (0, 2, 1), (0, 3, 2), (0, 4, 2)], "graph_id long, id long, parent_id long")
    for edges in (ring, fork):
        with pytest.raises(ValueError, match="cycle"):
            graph.max_cut(edges.select("graph_id", "id").union(edges.select("graph_id", "parent_id")).distinct(), edges)


def test_samples_and_antichains_are_a_graphs_own(spark):
    commands = spark.range(5 * 200).selectExpr("id % 5 AS graph_id", "id", "id div 5 AS max_cut")
    assert {(r.graph_id, r["count"]) for r in replica.sample(commands).groupBy("graph_id").count().collect()} == {(g, 100) for g in range(5)}
    edges = commands.filter("max_cut > 0").selectExpr("graph_id", "id", "graph_id AS parent_id")
    got = replica.antichain(commands, commands, edges).groupBy("graph_id").count().collect()
    assert {(r.graph_id, r["count"]) for r in got} == {(g, 10) for g in range(5)}


def test_heads_fold_first_in_first_out(spark):
    sets = {1: [5], 2: [3, 1], 3: [4, 2, 9], 4: [1, 2, 3, 4, 5, 6, 7]}
    heads = spark.createDataFrame([(g, i) for g, x in sets.items() for i in x], "graph_id long, id long")
    made = {(r.graph_id, r.left, r.right): r.id for r in graph.collapse_heads(heads).collect()}
    want, merges = {}, set()
    for g, x in sets.items():
        queue = [str(i) for i in sorted(x)]
        while len(queue) > 1:
            left, right = sorted(queue[:2])
            merges.add((g, left, right))
            queue = [*queue[2:], made[g, left, right]]
        want[g] = queue[0]
    assert made.keys() == merges and {r.graph_id: r.head for r in graph.synthetic_head(heads).collect()} == want


def test_pieces_meet_once_and_not_a_call_each(spark):
    commands = spark.createDataFrame([(g, i, 3 if i == 0 else 1, i % 3) for g in range(40) for i in range(5)], "graph_id long, id long, priority_rank int, priority_n long")
    edges = spark.createDataFrame([(g, i, 0 if i < 3 else i - 2) for g in range(40) for i in range(1, 5)], "graph_id long, id long, parent_id long")
    plan = braid.ordered(commands, edges)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan
    got = braid.braid(commands, edges)
    # the range sort's input is a written table, so that sampling doesn't order the pieces again
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    parents = {i: [0 if i < 3 else i - 2] for i in range(1, 5)}
    want = braid.order(list(range(5)), parents, {i: (3 if i == 0 else 1, i % 3, i) for i in range(5)}, set())
    rows = got.orderBy("graph_id", "position").collect()
    assert [(r.graph_id, r.id) for r in rows] == [(g, i) for g in range(40) for i in want]
    changes = commands.filter("priority_rank = 1").selectExpr("graph_id", "id", "0 AS seq", "id % 2 AS name", "CAST(id AS DOUBLE) AS value", "false AS deleted")
    fact = Fact("S", {"name": "bigint"}, {"value": "double"})
    at = braid.facts_at(changes, fact, commands, edges, commands.filter("id IN (3, 4)"))
    last = {i % 2: i for i in want if i}
    assert {(r.graph_id, r.name): r.value for r in at.collect()} == {(g, k): v for g in range(40) for k, v in last.items()}


def test_pairs_keep_their_rows_and_are_looked_up_once(spark):
    commands = spark.createDataFrame([(0, i) for i in range(5)], "graph_id long, id long")
    edges = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (0, 3, 1), (0, 3, 2), (0, 4, 3)], "graph_id long, id long, parent_id long")
    asked = [(0, 0, 4, "x"), (0, 0, 4, "x"), (0, 1, 2, "y"), (0, 1, 3, "z"), (0, 4, 1, "u"), (0, 3, 4, "v"), (0, 9, 1, "w"), (None, 1, 2, "n"), (0, None, 2, "m")]
    got = graph.is_ancestor(spark.createDataFrame(asked, "graph_id long, a long, b long, seg string"), commands, edges)
    assert got.columns == ["graph_id", "a", "b", "seg", "above"]
    assert sorted((r.seg, r.above) for r in got.collect()) == sorted((x, x in "xzv") for *_, x in asked)
    assert "LocalTableScan" not in got._jdf.queryExecution().toString() and "ExistingRDD" not in got._jdf.queryExecution().toString()


def test_ingest_reads_what_arrives_once(spark):
    known = spark.createDataFrame([(0, 1)], "graph_id long, id long")
    new = spark.createDataFrame([(0, 2), (0, 4)], "graph_id long, id long")
    edges = spark.createDataFrame([(0, 2, 1), (0, 4, 3)], "graph_id long, id long, parent_id long")
    for rows, want in zip(replica.ingest(known, new, edges), ([(0, 2)], [(0, 4, "missing parent")]), strict=True):
        assert "ExistingRDD" not in rows._jdf.queryExecution().toString()
        assert [tuple(r) for r in rows.collect()] == want


def test_chain_keys_agree_with_the_heap(spark):
    rng = random.Random(3)
    rows = [(c, p, rng.randrange(5), 100 * c + p) for c in range(4) for p in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "chain long, place long, priority long, id long")
    keyed = braid.chain_keys(df, ["chain"], ["place"], F.col("priority") * 1000 + F.col("id"), F.expr("place div 7"))
    got = [r.id for r in braid.positions(keyed, [F.desc("rk"), F.desc("d")]).orderBy("position").collect()]
    parents = {i: [-1] if p == 0 else [i - 1] for c, p, _, i in rows}
    rank = {i: (1, n, i) for _, _, n, i in rows} | {-1: (3, 0, -1)}
    assert got == braid.order([-1, *(r[3] for r in rows)], parents, rank, set())[1:]


def test_key_prefix_rule():
    assert F2.check_key({"i": 1}) == ["i"]
    for bad in ({"j": 1}, {"i": None, "j": 1}, {"x": 1}):
        with pytest.raises(SchemaError):
            F2.check_key(bad)
    with pytest.raises(SchemaError):
        Fact("G", {"x": "double"})
    assert facts_from_json(json.dumps({"A": {"key": {"i": "bigint"}, "immutable": True}}))["A"].immutable


def test_writes(spark):
    now = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "i long, j long, v string")
    wanted = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "z", "y"), (9, 9, "a", "q")], "i long, j long, old_v string, new_v string")
    changes, rejected = facts.update(now, wanted, F2, expected=True)
    assert [tuple(r) for r in changes.collect()] == [(1, 1, "x", False)]
    assert {(r.i, r.j) for r in rejected.collect()} == {(1, 2), (9, 9)}
    with pytest.raises(SchemaError):
        facts.update(now, wanted, Fact("I", F2.key, F2.value, immutable=True))
    assert facts.create(now, F2, existing=now).count() == 0
    assert facts.delete(now.filter("j = 1"), F2, existing=now).count() == 1


def test_map_ignores_values_and_counts_check_limits(spark):
    now = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "i long, j long, v string")
    assert reads.map_facts(now, F2, {"i": 1}, j=F.col("j")).count() == 2
    assert reads.count_up_to(now, F2, 2).first().n == 2
    with pytest.raises(SchemaError):
        reads.count_up_to(now, F2, 0)


def test_rules():
    with pytest.raises(SchemaError):
        rules.Priority(None).check(True)
    with pytest.raises(SchemaError):
        rules.Priority("basic", 1 << 32).check(True)
    rules.Priority("finalize").check(True)
    with pytest.raises(SchemaError):
        Enum("E", ("a", "b")).match(None, {"a": 1})


def test_scalars(spark):
    row = spark.range(1).select(
        S.saturating_add(F.lit(S.INT_MAX), F.lit(1)).alias("a"), S.saturating_sub(F.lit(S.INT_MIN), F.lit(1)).alias("b"),
        S.checked_add(F.lit(S.INT_MAX), F.lit(1)).alias("c"), S.merge_id(F.lit(1), F.lit(2)).alias("d"), S.merge_id(F.lit(2), F.lit(1)).alias("e"),
    ).first()
    assert (row.a, row.b, row.c) == (S.INT_MAX, S.INT_MIN, None) and row.d == row.e


def test_ingest_refuses_orphans_and_all_below_them(spark):
    known = spark.createDataFrame([(0, 1, "x")], "graph_id long, id long, v string")
    rows = [(0, 1, "x"), (0, 2, "b"), (0, 2, "a"), (0, 4, "x"), (0, 5, "x"), (0, 6, "x"), (0, 7, "bad"), (0, 8, "x"), (0, 9, "x"), (1, 3, "x"), (1, 4, "x"), (1, 5, "x")]
    new = spark.createDataFrame(rows, known.schema)
    edges = spark.createDataFrame([(0, 2, 1), (0, 4, 3), (0, 5, 4), (0, 6, 5), (0, 6, 2), (0, 7, 2), (0, 8, 7), (1, 4, 3)], "graph_id long, id long, parent_id long")
    good, refused = replica.ingest(known, new, edges, F.col("v") != "bad")
    assert sorted(tuple(r) for r in good.collect()) == [(0, 2, "a"), (1, 3, "x"), (1, 4, "x")]
    assert {(r.graph_id, r.id): r.reason for r in refused.collect()} == {
        (0, 4): "missing parent", (0, 5): "refused parent", (0, 6): "refused parent", (0, 7): "rule", (0, 8): "refused parent", (0, 9): "init", (1, 5): "init",
    }


def test_two_commits_of_one_version(spark):
    root = scratch(spark)
    a, b = Snapshots(spark, root), Snapshots(spark, root)
    assert a.commit(spark.range(3), 0) == 1
    with pytest.raises(RuntimeError):
        b.commit(spark.range(5), 0)
    seen = b.version
    b.version = lambda: 0  # as if it had looked before a's commit
    with pytest.raises(RuntimeError, match="another commit"):
        b.commit(spark.range(5), 0)
    b.version = seen
    assert b.version() == 1 and b.read().count() == 3
    for n in range(4):
        b.commit(spark.range(n))
    b.prune(2)
    assert b.versions() == [4, 5] and b.read().count() == 3


def test_sinks_keep_whole_batches_once(spark):
    sink = sinks.BatchSink(spark, scratch(spark))
    write = sink.writer(lambda batch: batch.select((F.col("id") * 2).alias("x")))
    write(spark.range(3), 0)
    write(spark.range(3), 0)  # as after a restart
    with pytest.raises(Exception, match="nothing"):
        write(spark.range(3).withColumn("id", F.raise_error(F.lit("nothing")).cast("long")), 1)
    write(spark.range(10, 11), 1)
    assert sorted(r.x for r in sink.read().collect()) == [0, 2, 4, 20] and sink.batches() == [0, 1]


def test_snapshots_and_stream(spark, tmp_path):
    fact = Fact("S", {"k": "bigint"}, {"v": "string"})
    rows = [(1, "a", False, 1), (2, "b", False, 2), (1, "c", False, 3), (2, None, True, 4), (3, "late", False, 0), (3, "x", False, 9)]
    for n, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "k long, v string, deleted boolean, p long").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    root = scratch(spark)
    snapshots = Snapshots(spark, root)
    for n in range(2):
        stream = spark.readStream.schema("k long, v string, deleted boolean, p long").parquet(f"{tmp_path}/in/{n}")
        folds.fold_stream(stream, snapshots, fact, ["p"], f"{tmp_path}/c{n}")
    assert sorted(tuple(r) for r in folds.current(snapshots, fact).collect()) == [(1, "c"), (3, "x")]
    assert sorted(r.k for r in snapshots.read(1).collect()) == [1, 2]
    with pytest.raises(RuntimeError):
        snapshots.commit(spark.range(1), expected=0)
    snapshots.remove()
    assert snapshots.version() == 0


def test_fold_rejects_without_leaving_state(spark):
    rows = spark.createDataFrame([(1, n, v) for n, v in enumerate((5, -7, -5, 3))], "k long, n long, v long")

    def step(state, row):
        good = state + row["v"] >= 0
        state += row["v"] if good else 0
        return state, {"n": row["n"], "state": state, "good": good}

    got = braid.fold(rows, ["k"], ["n"], step, int, "n long, state long, good boolean").orderBy("n").collect()
    assert [(r.state, r.good) for r in got] == [(5, True), (5, False), (0, True), (3, True)]


def test_fold_of_null_keys_and_large_numbers(spark):
    big = (1 << 60) + 1
    rows = spark.createDataFrame([(None, n, big) for n in range(4)] + [(1, 0, None)], "k long, n long, v long")
    got = braid.fold(rows, ["k"], ["n"], lambda state, row: (state + 1, {"k": row["k"], "state": state + 1, "v": row["v"]}), int, "k long, state long, v long").collect()
    assert sorted(r.state for r in got if r.k is None) == [1, 2, 3, 4] and {r.v for r in got if r.k is None} == {big}


def test_ids_do_not_collide(spark):
    pairs = [("a|b", "c"), ("a", "b|c"), (None, "q"), ("q", None), ("", "q"), ("1:a", ""), ("1", "a")]
    rows = spark.createDataFrame(pairs, "x string, y string").select(S.label_id(F.col("x"), F.col("y")).alias("i")).collect()
    assert len({r.i for r in rows}) == len(pairs)


def test_literal_types_and_whole_writes():
    for bad in ({"i": "1"}, {"i": True}, {"i": 1.0}):
        with pytest.raises(SchemaError):
            F2.check_key(bad)
    with pytest.raises(SchemaError):
        F2.check_value({"v": 1})
    with pytest.raises(SchemaError):
        rules.Write("create", F2, {"i": 1, "j": 2})
    with pytest.raises(SchemaError):
        rules.Write("update", Fact("I", F2.key, F2.value, immutable=True), {"i": 1, "j": 2}, {"v": "x"})


def test_more_scalars(spark):
    nothing = F.lit(None).cast("long")
    row = spark.range(1).select(S.same(nothing, F.lit(1)).alias("a"), S.same(nothing, nothing).alias("b"), S.unwrap(F.lit(3)).alias("c")).first()
    assert tuple(row) == (False, True, 3)
    for broken in (S.unwrap(nothing), S.todo()):
        with pytest.raises(Exception, match="unwrap of none|todo"):
            spark.range(1).select(broken).collect()
    with pytest.raises(ValueError):
        S.insert_fields({"a": "int"}, {"a": "int"})
    with pytest.raises(ValueError):
        S.convert(F.col("x"), {"a": "int"}, {"a": "bigint"})
    with pytest.raises(ValueError):
        S.compose({"a": F.lit(1)}, (F.col("x"), ["a"]))


def test_declared_functions(spark):
    rows = spark.createDataFrame([("k", 1)], "key string, n long")
    known = foreign.use(foreign.IDENTITIES)
    assert len(rows.select(known.call("idam::derive_device_id", rows, "key")).first()[0]) == 64
    for path, arguments in (("idam::derive_device_id", ["n"]), ("idam::derive_device_id", []), ("idam::none", []), ("envelope::author_id", ["key"])):
        with pytest.raises(foreign.ForeignError):
            known.call(path, rows, *arguments)


def test_rule_columns():
    assert rules.Rule("R", [], {}, priority=rules.Priority("finalize")).columns().keys() == {"priority_rank", "priority_n"}


def test_windowed_counts_on_a_stream(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 00:10:00', 'a'), (TIMESTAMP '2024-01-01 00:50:00', 'a'), (TIMESTAMP '2024-01-01 05:00:00', 'b') AS t(ts, event_type)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/in")
    query = folds.windowed_counts(stream, "1 hour", "10 minutes").writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.event_type, r.n) for r in spark.table("counted").collect()] == [("a", 2)]


def test_intermediate_tables_of_a_block_go(spark):
    import os

    with cuts_of(spark):
        path = cut(spark.range(3)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_entry_without_the_text_operators(monkeypatch):
    import __spark_entry__ as entry

    found = entry._found
    monkeypatch.setattr(entry, "_found", lambda n: n == "tideline.plans.catalog" and found(n))
    assert "lww_fold" in entry.queries() and not [n for n in entry.queries() if n[:2] == "op" and n[2].isdigit()]
    assert entry.oracle_sql().keys() <= entry.queries().keys()
