"""The operators as queries over the driver's tables, each with its SQL.

Facts: Customer [c_nationkey, c_custkey], Order [o_custkey, o_orderkey], and
Setting [event_id % 20], a register that events write to and errors delete.
Commands: events, one chain per user, priority by event type.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import foreign
from ..functions import scalars as S
from ..operators import braid, facts, graph, reads, replica, rules
from ..operators.schema import Enum, Fact
from ..session import cut, load, scratch
from ..sources.snapshots import Snapshots, graph_ids
from ..streaming import folds, sinks

Query = Callable[[SparkSession, str], DataFrame]

CUSTOMER = Fact("Customer", {"c_nationkey": "int", "c_custkey": "bigint"}, {"c_name": "string", "c_mktsegment": "string"})
ORDER = Fact("Order", {"o_custkey": "bigint", "o_orderkey": "bigint"}, {"o_orderstatus": "string", "o_orderpriority": "string"})
NATION = Fact("Nation", {"n_regionkey": "int", "n_nationkey": "int"}, {"n_name": "string"})
SETTING = Fact("Setting", {"name": "bigint"}, {"value": "double"})
TYPES = Enum("EventType", ("view", "click", "signup", "purchase", "error"))
BY_CUSTOMER = {"o_custkey": "c_custkey"}

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def customers(s, d):
    return CUSTOMER.rows(load(s, d, "customer"))


def orders(s, d):
    return ORDER.rows(load(s, d, "orders"))


def priority():
    return F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 3).otherwise(4).cast("long")


def log(s, d) -> DataFrame:
    """Events as commands with rk and d: larger comes earlier in the order."""
    events = load(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    key = priority() * F.lit(1_000_000_000).cast("long") + F.col("event_id")
    return braid.chain_keys(events, ["user_id"], ["ts", "event_id"], key, F.unix_date(F.col("ts").cast("date")))


LOG_SQL = """WITH keyed AS (
  SELECT *, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS BIGINT) * 1000000000 + event_id AS pk,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS d FROM events),
log AS (SELECT *, max(pk) OVER (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS rk FROM keyed)"""
CHAIN_SQL = """WITH chain AS (
  SELECT event_id AS id, user_id AS graph_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS max_cut,
         lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_id FROM events)"""


def chains(s, d) -> tuple[DataFrame, DataFrame]:
    """Events as one graph per user: (commands with max_cut, edges)."""
    events = load(s, d, "events").select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("id"), "ts", "event_type")
    placed = cut(graph.places(events, ["graph_id"], ["ts", "id"], F.unix_date(F.col("ts").cast("date")), "_p"))
    commands = placed.withColumn("max_cut", F.col("_p") - 1).drop("_p")
    above = commands.select("graph_id", F.col("id").alias("parent_id"), (F.col("max_cut") + 1).alias("max_cut"))
    return commands, commands.join(above, ["graph_id", "max_cut"]).select("graph_id", "id", "parent_id")


def chain_segments(commands: DataFrame, edges: DataFrame) -> graph.Segments:
    """Each graph of chains() is one segment."""
    return graph.segments_of(commands.select("graph_id", "id", F.lit(0).alias("seg"), F.col("max_cut").alias("off")), edges)


# --- facts: scans, state, writes ---------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = 899 AND o_orderkey = 0")
def fact_point_lookup(s, d):
    return facts.lookup(orders(s, d), ORDER, {"o_custkey": 899, "o_orderkey": 0})


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey")
def fact_prefix_scan(s, d):
    return facts.scan(orders(s, d), ORDER, {"o_custkey": 7})


def settings(s, d) -> DataFrame:
    """Changes of Setting; a later position wins."""
    rows = log(s, d)
    return rows.select((F.col("event_id") % 20).alias("name"), "value", (F.col("event_type") == "error").alias("deleted"), (-F.col("rk")).alias("p1"), (-F.col("d")).alias("p2"))


@query(LOG_SQL + """, ranked AS (SELECT event_id % 20 AS name, value, event_type, row_number() OVER (PARTITION BY event_id % 20 ORDER BY rk, d) AS n FROM log)
SELECT name, value FROM ranked WHERE n = 1 AND event_type <> 'error'""")
def lww_fold(s, d):
    return facts.latest(settings(s, d), SETTING, ["p1", "p2"])


@query(LOG_SQL + """, ranked AS (SELECT event_id % 97 AS name, event_type, row_number() OVER (PARTITION BY event_id % 97 ORDER BY rk, d) AS n FROM log)
SELECT name, CAST(count(*) AS BIGINT) AS changes, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS tombstones,
bool_or(n = 1 AND event_type = 'error') AS skipped FROM ranked GROUP BY name""")
def tombstones_skipped(s, d):
    rows = log(s, d).select((F.col("event_id") % 97).alias("name"), "value", (F.col("event_type") == "error").alias("deleted"), (-F.col("rk")).alias("p1"), (-F.col("d")).alias("p2"))
    kept = facts.latest(rows, SETTING, ["p1", "p2"]).select("name", F.lit(True).alias("there"))
    return facts.live(rows, SETTING, ["p1", "p2"]).join(kept, "name", "left").select("name", "changes", "tombstones", F.col("there").isNull().alias("skipped"))


@query("""SELECT name, value FROM (SELECT event_id % 20 AS name, value, event_type, row_number() OVER (PARTITION BY event_id % 20 ORDER BY ts DESC, event_id DESC) AS n
FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00') WHERE n = 1 AND event_type <> 'error'""")
def facts_as_of(s, d):
    rows = load(s, d, "events").select((F.col("event_id") % 20).alias("name"), "value", (F.col("event_type") == "error").alias("deleted"), "ts", "event_id")
    return facts.as_of(rows, SETTING, ["ts", "event_id"], F.struct(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit((1 << 63) - 1)))


def overlay_rows(s, d) -> DataFrame:
    base = orders(s, d)
    return base.filter("o_orderkey % 10 < 3").select("o_custkey", "o_orderkey", F.lit("S").alias("o_orderstatus"), "o_orderpriority", (F.col("o_orderkey") % 10 == 0).alias("deleted"))


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 10 < 3 THEN 'S' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority
FROM orders WHERE o_orderkey % 10 <> 0""")
def overlay_merge(s, d):
    return facts.overlay(orders(s, d), overlay_rows(s, d), ORDER)


@query("SELECT o_custkey, o_orderkey, 'S' AS o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = 8 AND o_orderkey % 10 IN (1, 2)")
def session_prefix_read(s, d):
    return facts.scan(facts.overlay(orders(s, d), overlay_rows(s, d), ORDER), ORDER, {"o_custkey": 8}, {"o_orderstatus": "S"})


@query("SELECT DISTINCT user_id AS graph_id FROM events")
def list_graphs(s, d):
    return graph_ids(load(s, d, "events").withColumnRenamed("user_id", "graph_id"))


@query("""SELECT o_custkey, o_orderkey, 'F' AS o_orderstatus, o_orderpriority, FALSE AS deleted FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0""")
def guarded_update(s, d):
    now = orders(s, d)
    wanted = now.filter("o_orderkey % 3 = 0").select(
        "o_custkey", "o_orderkey", F.lit("O").alias("old_o_orderstatus"), F.col("o_orderpriority").alias("old_o_orderpriority"),
        F.lit("F").alias("new_o_orderstatus"), F.col("o_orderpriority").alias("new_o_orderpriority"))
    return facts.update(now, wanted, ORDER, expected=True)[0]


@query("""SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 3 = 0""")
def guarded_update_rejected(s, d):
    now = orders(s, d)
    wanted = now.filter("o_orderkey % 3 = 0").select(
        "o_custkey", "o_orderkey", F.lit("O").alias("old_o_orderstatus"), F.col("o_orderpriority").alias("old_o_orderpriority"),
        F.lit("F").alias("new_o_orderstatus"), F.col("o_orderpriority").alias("new_o_orderpriority"))
    return facts.update(now, wanted, ORDER, expected=True)[1].select("o_custkey", "o_orderkey")


@query("SELECT c_nationkey, c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0")
def delete_then_compact(s, d):
    now = customers(s, d)
    gone = facts.delete(now.filter("c_custkey % 5 = 0"), CUSTOMER)
    changes = facts.create(now, CUSTOMER).withColumn("p", F.lit(0)).unionByName(gone.withColumn("p", F.lit(1)))
    return facts.latest(changes, CUSTOMER, ["p"])


@query("SELECT CAST(min(event_id) AS BIGINT) AS first_event, CAST(max(event_id) AS BIGINT) AS last_event FROM events")
def singleton_fact(s, d):
    one = Fact("Span", {}, {"first_event": "bigint", "last_event": "bigint"})
    rows = load(s, d, "events").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    return facts.latest(facts.create(rows, one).withColumn("p", F.lit(1)), one, ["p"])


# --- reads and joins -----------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1")
def query_first_match(s, d):
    return reads.first(orders(s, d), ORDER, {"o_custkey": 7}, {"o_orderstatus": "F"})


@query("SELECT c_nationkey, c_custkey, c_name, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_semi(s, d):
    return reads.exists(customers(s, d), orders(s, d), ORDER, BY_CUSTOMER, {"o_orderstatus": "P"})


@query("SELECT c_nationkey, c_custkey, c_name, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists_anti(s, d):
    return reads.exists(customers(s, d), orders(s, d), ORDER, BY_CUSTOMER, {"o_orderstatus": "P"}, negate=True)


COUNTED = "WITH n AS (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) "


@query("SELECT least(count(*), 500) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_up_to_500(s, d):
    return reads.count_up_to(orders(s, d), ORDER, 500, value={"o_orderstatus": "F"})


@query(COUNTED + "SELECT c_custkey, least(k, 5) AS n FROM n")
def counting_join(s, d):
    return reads.counts(customers(s, d).select("c_custkey"), orders(s, d), ORDER, BY_CUSTOMER, limit=5)


@query(COUNTED + "SELECT c_custkey FROM n WHERE k >= 3")
def at_least_3(s, d):
    return reads.at_least(customers(s, d).select("c_custkey"), orders(s, d), ORDER, BY_CUSTOMER, 3)


@query(COUNTED + "SELECT c_custkey FROM n WHERE k <= 3")
def at_most_3(s, d):
    return reads.at_most(customers(s, d).select("c_custkey"), orders(s, d), ORDER, BY_CUSTOMER, 3)


@query(COUNTED + "SELECT c_custkey FROM n WHERE k = 3")
def exactly_3(s, d):
    return reads.exactly(customers(s, d).select("c_custkey"), orders(s, d), ORDER, BY_CUSTOMER, 3)


@query("SELECT o_orderkey AS id, 'Ship' AS command, o_orderpriority AS priority FROM orders WHERE o_custkey = 7")
def map_publish(s, d):
    return reads.map_facts(orders(s, d), ORDER, {"o_custkey": 7}, id=F.col("o_orderkey"), command=F.lit("Ship"), priority=F.col("o_orderpriority"))


FIRST_ORDER = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F')"


@query(f"SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN {FIRST_ORDER} ON o_custkey = c_custkey AND n = 1")
def lookup_join_left(s, d):
    out = reads.lookup_join(customers(s, d), orders(s, d), ORDER, BY_CUSTOMER, {"o_orderstatus": "F"})
    return out.select("c_custkey", "found.o_orderkey", "found.o_orderpriority")


@query(f"SELECT c_custkey, o_orderkey, o_orderpriority FROM customer JOIN {FIRST_ORDER} ON o_custkey = c_custkey AND n = 1")
def lookup_join_inner(s, d):
    out = reads.lookup_join(customers(s, d), orders(s, d), ORDER, BY_CUSTOMER, {"o_orderstatus": "F"}, "inner")
    return out.select("c_custkey", "found.o_orderkey", "found.o_orderpriority")


@query("SELECT n_nationkey, c_custkey, n_name, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def nested_map(s, d):
    nations = reads.map_facts(NATION.rows(load(s, d, "nation")), NATION, {"n_regionkey": 1}, n_nationkey=F.col("n_nationkey"), n_name=F.col("n_name"))
    return reads.map_nested(nations, customers(s, d), CUSTOMER, {"c_nationkey": "n_nationkey"}, **{c: F.col(c) for c in ("n_nationkey", "c_custkey", "n_name", "c_name")})


# --- structs and scalars -------------------------------------------------------


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, 1 AS version, c_nationkey AS nation FROM customer")
def struct_compose(s, d):
    parts = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    more = F.struct(F.col("c_nationkey").alias("nation"))
    out = customers(s, d).select("c_custkey", parts.alias("a"), more.alias("b"))
    return out.select("c_custkey", S.compose({"version": F.lit(1)}, (F.col("a"), ["name", "segment"]), (F.col("b"), ["nation"])).alias("x")).select("c_custkey", "x.*")


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer")
def substruct(s, d):
    whole = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return customers(s, d).select("c_custkey", whole.alias("x")).select("c_custkey", S.substruct(F.col("x"), ["segment"]).alias("x")).select("c_custkey", "x.segment")


EDGE_SQL = "CASE event_id % 3 WHEN 0 THEN 9223372036854775807 WHEN 1 THEN -9223372036854775807 ELSE event_id END"


def edges_of_range(s, d) -> DataFrame:
    x = F.when(F.col("event_id") % 3 == 0, F.lit(S.INT_MAX)).when(F.col("event_id") % 3 == 1, F.lit(S.INT_MIN + 1)).otherwise(F.col("event_id"))
    return load(s, d, "events").select("event_id", x.alias("x"), (F.col("event_id") % 7 - 3).alias("y"))


@query(f"""SELECT event_id, TRY_CAST(CAST(x AS HUGEINT) + y AS BIGINT) AS added, TRY_CAST(CAST(x AS HUGEINT) - y AS BIGINT) AS taken
FROM (SELECT event_id, {EDGE_SQL} AS x, event_id % 7 - 3 AS y FROM events)""")
def checked_add(s, d):
    return edges_of_range(s, d).select("event_id", S.checked_add(F.col("x"), F.col("y")).alias("added"), S.checked_sub(F.col("x"), F.col("y")).alias("taken"))


@query(f"""SELECT event_id, CAST(greatest(least(CAST(x AS HUGEINT) + y, 9223372036854775807), -9223372036854775808) AS BIGINT) AS added,
CAST(greatest(least(CAST(x AS HUGEINT) - y, 9223372036854775807), -9223372036854775808) AS BIGINT) AS taken
FROM (SELECT event_id, {EDGE_SQL} AS x, event_id % 7 - 3 AS y FROM events)""")
def saturating_add(s, d):
    return edges_of_range(s, d).select("event_id", S.saturating_add(F.col("x"), F.col("y")).alias("added"), S.saturating_sub(F.col("x"), F.col("y")).alias("taken"))


@query(f"""SELECT event_id, coalesce(TRY_CAST(CAST(x AS HUGEINT) + y AS BIGINT), -1) AS v, TRY_CAST(CAST(x AS HUGEINT) + y AS BIGINT) IS NOT NULL AS is_some
FROM (SELECT event_id, {EDGE_SQL} AS x, event_id % 7 - 3 AS y FROM events)""")
def coalesce_or(s, d):
    rows = edges_of_range(s, d).select("event_id", S.checked_add(F.col("x"), F.col("y")).alias("o"))
    return rows.select("event_id", S.either(F.col("o"), F.lit(-1).cast("long")).alias("v"), F.col("o").isNotNull().alias("is_some"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'low' WHEN 'click' THEN 'low' WHEN 'purchase' THEN 'high' ELSE 'other' END AS level FROM events")
def match_case(s, d):
    arms = [(["view", "click"], F.lit("low")), (["purchase"], F.lit("high"))]
    return load(s, d, "events").select("event_id", S.match(F.col("event_type"), arms, F.lit("other")).alias("level"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END * 10 AS weight FROM events")
def enum_match(s, d):
    ordinal = S.match(F.col("event_type"), [([m], getattr(TYPES, m)) for m in TYPES.members], F.lit(-1))
    rows = load(s, d, "events").select("event_id", ordinal.alias("kind"))
    return rows.select("event_id", TYPES.match(F.col("kind"), {m: getattr(TYPES, m) * 10 for m in TYPES.members}).alias("weight"))


@query("""SELECT event_id, event_type = 'error' AND value > 10 AS both_hold, event_type = 'error' OR value > 10 AS one_holds, NOT (value > 10) AS not_more,
event_id % 7 <= 3 AS le, event_id % 7 >= 3 AS ge FROM events""")
def boolean_logic(s, d):
    a, b, n = F.col("event_type") == "error", F.col("value") > 10, F.col("event_id") % 7
    return load(s, d, "events").select("event_id", S.both(a, b).alias("both_hold"), S.any_of(a, b).alias("one_holds"), (~b).alias("not_more"), (n <= 3).alias("le"), (n >= 3).alias("ge"))


@query("""SELECT event_id, value > 10 AS is_ok, CASE WHEN value > 10 THEN event_id ELSE -1 END AS v, event_id % 4 = 0 AS outer_some, event_id % 8 = 0 AS inner_some FROM events""")
def options_and_results(s, d):
    result = F.when(F.col("value") > 10, S.ok(F.col("event_id"), "string")).otherwise(S.err(F.lit("small"), "bigint"))
    inner = F.when(F.col("event_id") % 8 == 0, S.some(F.col("event_id"))).otherwise(S.none("bigint"))
    nested = F.when(F.col("event_id") % 4 == 0, S.some(inner)).otherwise(S.none("struct<is_some:boolean,v:bigint>"))
    rows = load(s, d, "events").select("event_id", result.alias("r"), nested.alias("o"))
    return rows.select("event_id", "r.is_ok", F.when(F.col("r.is_ok"), F.col("r.ok")).otherwise(F.lit(-1).cast("long")).alias("v"),
                       F.col("o.is_some").alias("outer_some"), F.coalesce("o.v.is_some", F.lit(False)).alias("inner_some"))


ID_SQL = "sha256(concat({}))".format
PART_SQL = "coalesce(concat(length({0}), ':', {0}), '-')".format


@query(f"""SELECT o_orderkey, {ID_SQL("'5:merge', " + PART_SQL("CAST(least(o_orderkey, o_custkey) AS VARCHAR)") + ", " + PART_SQL("CAST(greatest(o_orderkey, o_custkey) AS VARCHAR)"))} AS merge_id,
{ID_SQL("'5:label', " + PART_SQL("CAST(o_orderkey AS VARCHAR)") + ", " + PART_SQL("o_orderstatus"))} AS label_id, 'AB' AS decoded FROM orders""")
def derived_ids(s, d):
    return orders(s, d).select("o_orderkey", S.merge_id(F.col("o_orderkey"), F.col("o_custkey")).alias("merge_id"), S.label_id(F.col("o_orderkey"), F.col("o_orderstatus")).alias("label_id"),
                               F.decode(S.bytes_from_hex(F.lit("4142")), "UTF-8").alias("decoded"))


@query(f"""SELECT event_id, {ID_SQL("'6:device', " + PART_SQL("event_type"))} AS device_id, {ID_SQL("'6:change', " + PART_SQL("event_type") + ", " + PART_SQL("CAST(event_id AS VARCHAR)"))} AS change_id,
user_id AS author_id FROM events""")
def foreign_functions(s, d):
    rows = load(s, d, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("text"), F.lit(None).cast("bigint").alias("parent_id"),
                                       F.col("user_id").alias("author_id"), F.col("event_id").alias("id"), F.col("props").alias("payload"))
    rows = rows.withColumn("e", foreign.envelope())
    known = foreign.use(foreign.IDENTITIES, foreign.ENVELOPES)
    return rows.select("event_id", known.call("idam::derive_device_id", rows, "event_type").alias("device_id"),
                       known.call("idam::compute_change_id", rows, "event_type", "text").alias("change_id"), known.call("envelope::author_id", rows, "e").alias("author_id"))


@query("SELECT event_id, CASE WHEN value > 10 THEN event_id + 1 ELSE -1 END AS v, CASE WHEN value > 10 THEN 'big' ELSE 'small' END AS size, user_id AS b, event_id AS a FROM events")
def bound_arms_and_conversion(s, d):
    option = F.when(F.col("value") > 10, S.some(F.col("event_id"))).otherwise(S.none("bigint"))
    result = F.when(F.col("value") > 10, S.ok(F.col("event_id"), "string")).otherwise(S.err(F.lit("small"), "bigint"))
    own = F.struct(F.col("event_id").alias("a"), F.col("user_id").alias("b"))
    rows = load(s, d, "events").select("event_id", option.alias("o"), result.alias("r"), own.alias("x"))
    fields = S.insert_fields({"b": "bigint"}, {"a": "bigint"})
    return rows.select("event_id", S.match_option(F.col("o"), lambda v: v + 1, F.lit(-1).cast("long")).alias("v"),
                       S.match_result(F.col("r"), lambda v: F.lit("big"), lambda e: e).alias("size"), S.convert(F.col("x"), {"a": "bigint", "b": "bigint"}, fields).alias("x")).select("event_id", "v", "size", "x.*")


# --- order, graphs, replicas ----------------------------------------------------


@query(LOG_SQL + " SELECT event_id, user_id, row_number() OVER (ORDER BY rk DESC, d DESC) AS braid_pos FROM log")
def braid_order(s, d):
    return braid.positions(log(s, d).select("event_id", "user_id", "rk", "d"), [F.desc("rk"), F.desc("d")], "braid_pos").select("event_id", "user_id", "braid_pos")


@query(LOG_SQL + " SELECT user_id % 16 AS graph_id, event_id AS id, row_number() OVER (PARTITION BY user_id % 16 ORDER BY rk DESC, d DESC) AS position FROM log")
def braid_graphs(s, d):
    """Each graph is many chains, so their keys order it; positions start anew in each."""
    rows = log(s, d).select((F.col("user_id") % 16).alias("graph_id"), F.col("event_id").alias("id"), "rk", "d")
    return braid.sequences(rows, ["graph_id"], [F.desc("rk"), F.desc("d")], "position").select("graph_id", "id", "position")


@query(LOG_SQL + """ SELECT event_id % 10 AS name, event_id, row_number() OVER (PARTITION BY event_id % 10 ORDER BY rk DESC, d DESC) AS n FROM log WHERE event_type = 'signup'""")
def sequence_fold(s, d):
    """The sequence that each name's commands leave, as numbered rows: no name is gathered anywhere."""
    rows = log(s, d).filter("event_type = 'signup'").select((F.col("event_id") % 10).alias("name"), "event_id", "rk", "d")
    return braid.sequences(rows, ["name"], [F.desc("rk"), F.desc("d")], "n").select("name", "event_id", "n")


@query(CHAIN_SQL + " SELECT graph_id, id, max_cut FROM chain")
def max_cut(s, d):
    commands, edges = chains(s, d)
    return graph.max_cut(commands, edges, chain_segments(commands, edges))


@query(CHAIN_SQL + " SELECT graph_id, id FROM chain c WHERE NOT EXISTS (SELECT 1 FROM chain p WHERE p.parent_id = c.id)")
def heads(s, d):
    commands, edges = chains(s, d)
    return graph.heads(commands, edges).select("graph_id", "id")


@query(CHAIN_SQL + " SELECT graph_id, parent_id AS id, count(*) AS arrivals FROM chain WHERE parent_id IS NOT NULL GROUP BY ALL")
def arrivals(s, d):
    return graph.arrivals(chains(s, d)[1])


@query("""WITH n AS (SELECT user_id AS graph_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT x.graph_id, x.id AS a, y.id AS b, x.k < y.k AS above FROM n x JOIN n y ON x.graph_id = y.graph_id AND (y.k = x.k + 3 OR y.k = x.k - 2 OR y.k = x.k)""")
def is_ancestor(s, d):
    commands, edges = chains(s, d)
    return graph.is_ancestor(near(commands, "max_cut", (3, -2, 0)), commands, edges, chain_segments(commands, edges))


@query(CHAIN_SQL + " SELECT graph_id, id, max_cut FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY max_cut DESC, id) AS n FROM chain) WHERE n <= 100")
def sample_commands(s, d):
    return replica.sample(chains(s, d)[0].select("graph_id", "id", "max_cut"))


@query(CHAIN_SQL + " SELECT graph_id, id, max_cut FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY max_cut, id) AS n FROM chain) WHERE n <= 5")
def least_deep(s, d):
    return replica.deepest(chains(s, d)[0].select("graph_id", "id", "max_cut"), 5, smallest=True)


@query(CHAIN_SQL + " SELECT graph_id, id, max_cut FROM chain WHERE (id % 3 = 0)")
def locate_by_address(s, d):
    """Every command's address is asked for, two thirds of them with a wrong depth."""
    commands = chains(s, d)[0].select("graph_id", "id", "max_cut")
    asked = commands.withColumn("max_cut", F.when(F.col("id") % 3 == 0, F.col("max_cut")).otherwise(F.col("max_cut") + 1))
    return graph.locate(commands, asked)


@query(CHAIN_SQL + ", mid AS (SELECT graph_id, id AS start, max_cut AS m FROM chain WHERE max_cut = 5) SELECT graph_id, start, id, max_cut - m AS off FROM chain JOIN mid USING (graph_id) WHERE max_cut >= m")
def commands_from(s, d):
    commands, edges = chains(s, d)
    return graph.commands_from(chain_segments(commands, edges), commands.filter("max_cut = 5"))


@query(CHAIN_SQL + """, seen AS (SELECT graph_id, max(max_cut) AS upto FROM chain WHERE id % 5 = 0 GROUP BY graph_id)
SELECT c.graph_id, c.id, c.max_cut FROM chain c LEFT JOIN seen USING (graph_id) WHERE upto IS NULL OR max_cut > upto""")
def sync_needed(s, d):
    commands, edges = chains(s, d)
    commands = commands.select("graph_id", "id", "max_cut")
    return replica.needed(commands, commands.filter("id % 5 = 0"), edges, chain_segments(commands, edges))


@query(CHAIN_SQL + " SELECT graph_id, max_by(id, max_cut) AS id, max(max_cut) AS max_cut FROM chain WHERE id % 7 = 0 GROUP BY graph_id")
def peer_antichain(s, d):
    commands, edges = chains(s, d)
    return replica.antichain(commands.filter("id % 7 = 0").select("graph_id", "id", "max_cut"), commands, edges, segments=chain_segments(commands, edges))


@query("SELECT user_id AS graph_id, event_id AS id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS batch FROM events")
def response_batches(s, d):
    rows = load(s, d, "events").select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("id"), "ts")
    return replica.batches(braid.sequences(rows, ["graph_id"], [F.col("ts"), F.col("id")], "position"), "position", 10).select("graph_id", "id", "batch")


@query(CHAIN_SQL + """, low AS (SELECT graph_id, min(max_cut) AS missing FROM chain WHERE max_cut >= 3 AND id % 9 = 4 GROUP BY graph_id)
SELECT graph_id, id, CASE WHEN max_cut < missing OR missing IS NULL THEN 'taken' WHEN max_cut = missing + 1 THEN 'missing parent' ELSE 'refused parent' END AS verdict
FROM chain LEFT JOIN low USING (graph_id) WHERE max_cut >= 3 AND max_cut IS DISTINCT FROM missing""")
def ingest_union(s, d):
    """The first three of each chain are known; the first gap in the rest stops all that follow."""
    commands, edges = chains(s, d)
    commands = commands.select("graph_id", "id", "max_cut")
    low = commands.filter("max_cut >= 3 AND id % 9 = 4").groupBy("graph_id").agg(F.min("max_cut").alias("missing"))
    known, late = commands.filter("max_cut < 3"), commands.filter("max_cut >= 3").join(low, "graph_id", "left").filter("NOT max_cut <=> missing").drop("missing")
    taken, refused = replica.ingest(known, late.union(commands.filter("max_cut < 5").join(low, "graph_id", "left").filter("NOT max_cut <=> missing").drop("missing")), edges)
    return taken.select("graph_id", "id", F.lit("taken").alias("verdict")).union(refused.select("graph_id", "id", "reason"))


@query("""SELECT user_id AS graph_id, what, CASE WHEN event_id % 11 = 0 THEN 'right' ELSE 'left' END AS side, count(*) AS n FROM events, (VALUES ('commands'), ('facts')) AS w(what)
WHERE (event_id % 11 = 0) <> (event_id % 13 = 0) AND (what = 'commands' OR event_type = 'purchase') GROUP BY ALL""")
def graph_differences(s, d):
    rows = load(s, d, "events").select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("id"), "event_type", "value")

    def side(n):
        kept = rows.filter(f"id % {n} <> 0")
        return {"commands": kept.select("graph_id", "id"), "facts": kept.filter("event_type = 'purchase'").select("graph_id", "id", "value")}

    return replica.graph_differences(side(11), side(13))


HEADS_SQL = """, heads AS (SELECT user_id // 4 AS graph_id, max_by(event_id, (ts, event_id)) AS id FROM events GROUP BY user_id),
queue AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY graph_id) AS n, CAST(id AS VARCHAR) AS id FROM heads),
sides AS (SELECT graph_id, n, id, CASE WHEN n % 2 = 1 AND i = n - 1 THEN 0 ELSE i // 2 + n % 2 END AS pair, i FROM queue),
halved AS (SELECT graph_id, (any_value(n) + 1) // 2 AS n, pair AS i, list(id ORDER BY i) AS ids FROM sides GROUP BY graph_id, pair),
pairs AS (SELECT graph_id, n, i, CASE WHEN len(ids) = 1 THEN ids[1] ELSE """ + ID_SQL("'5:merge', " + PART_SQL("least(ids[1], ids[2])") + ", " + PART_SQL("greatest(ids[1], ids[2])")) + """ END AS id FROM halved),
last AS (SELECT graph_id, list(id ORDER BY i) AS ids FROM pairs GROUP BY graph_id),
top AS (SELECT graph_id, CASE WHEN len(ids) = 1 THEN ids[1] ELSE """ + ID_SQL("'5:merge', " + PART_SQL("least(ids[1], ids[2])") + ", " + PART_SQL("greatest(ids[1], ids[2])")) + """ END AS head FROM last)"""


def own_heads(s, d) -> DataFrame:
    """The last event of each user, four users to a graph."""
    rows = load(s, d, "events")
    last = rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("id"))
    return last.select(F.expr("user_id div 4").alias("graph_id"), "id")


@query("WITH unused AS (SELECT 1)" + HEADS_SQL + " SELECT graph_id, head FROM top")
def synthetic_head(s, d):
    return graph.synthetic_head(own_heads(s, d))


@query("WITH unused AS (SELECT 1)" + HEADS_SQL + """ SELECT graph_id, id, l AS "left", r AS "right" FROM (
SELECT graph_id, id, least(x[1], x[2]) AS l, greatest(x[1], x[2]) AS r FROM (SELECT p.graph_id, p.id, h.ids AS x FROM pairs p JOIN halved h USING (graph_id, i) WHERE len(h.ids) = 2)
UNION ALL SELECT graph_id, head, least(ids[1], ids[2]), greatest(ids[1], ids[2]) FROM top JOIN last USING (graph_id) WHERE len(ids) = 2)""")
def collapse_heads(s, d):
    return graph.collapse_heads(own_heads(s, d))


@query("WITH unused AS (SELECT 1)" + HEADS_SQL + """ SELECT graph_id, head AS id, FALSE AS sync FROM top
UNION ALL SELECT user_id // 4, CAST(event_id AS VARCHAR), FALSE FROM events WHERE event_id % 10 = 0 UNION ALL SELECT user_id // 4, 'new' || event_id, TRUE FROM events WHERE event_id % 10 = 1""")
def hello_decision(s, d):
    commands = load(s, d, "events").select(F.expr("user_id div 4").alias("graph_id"), F.col("event_id").alias("id"))
    mine = own_heads(s, d)
    hellos = graph.synthetic_head(mine).select("graph_id", F.col("head").alias("id"))
    hellos = hellos.union(commands.filter("id % 10 = 0").select("graph_id", F.col("id").cast("string")))
    hellos = hellos.union(commands.filter("id % 10 = 1").select("graph_id", F.concat(F.lit("new"), F.col("id").cast("string"))))
    return replica.sync_wanted(hellos, commands, mine).select("graph_id", "id", "sync")


@query(CHAIN_SQL + " SELECT graph_id, max_by(id, max_cut) AS head_id FROM chain GROUP BY graph_id")
def head_id(s, d):
    commands, edges = chains(s, d)
    return graph.latest_heads(commands, edges, chain_segments(commands, edges))


@query("SELECT graph_id, max_by(policy, (serial, side)) AS policy FROM (SELECT user_id AS graph_id, event_type AS policy, event_id % 3 AS serial, event_id AS side FROM events) GROUP BY graph_id")
def merge_policy(s, d):
    rows = load(s, d, "events").select(F.col("user_id").alias("graph_id"), F.col("event_type").alias("policy"), (F.col("event_id") % 3).alias("serial"), F.col("event_id").alias("side"))
    return replica.merge_policy(rows)


# --- graphs with forks and merges --------------------------------------------------

# Four users to a graph. In each ten days (a period) each has a chain of its own,
# begun at what the period before was merged into; the first two periods end with
# three merges, the last one doesn't, so a graph has up to four heads.
DAG_SQL = """WITH RECURSIVE ev AS (
  SELECT event_id AS id, user_id // 4 AS g, user_id % 4 AS u, least(greatest(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10, 0), 2) AS p, ts, event_id, event_type, value FROM events),
graphs AS (SELECT DISTINCT g FROM ev), periods AS (SELECT g, p FROM graphs, (VALUES (0), (1), (2)) AS t(p)),
root AS (SELECT g, p, CASE WHEN p = 0 THEN -(g * 100 + 99) - 1 ELSE -(g * 100 + (p - 1) * 10 + 3) - 1 END AS root FROM periods),
ends AS (SELECT g, p, u, max_by(id, (ts, id)) AS id FROM ev GROUP BY g, p, u),
sides AS (SELECT r.g, r.p, k, e.id AS parent FROM root r, (VALUES (1), (2)) AS t(k) JOIN ends e ON e.g = r.g AND e.p = r.p AND e.u // 2 + 1 = k WHERE r.p < 2),
edges AS (
  SELECT g AS graph_id, id, coalesce(lag(id) OVER (PARTITION BY g, u, p ORDER BY ts, id), root) AS parent_id FROM ev JOIN root USING (g, p)
  UNION ALL SELECT g, -(g * 100 + p * 10 + k) - 1, parent FROM sides
  UNION ALL SELECT g, -(g * 100 + p * 10 + k) - 1, root FROM root, (VALUES (1), (2)) AS t(k) WHERE p < 2 AND NOT EXISTS (SELECT 1 FROM sides s WHERE s.g = root.g AND s.p = root.p AND s.k = t.k)
  UNION ALL SELECT g, -(g * 100 + p * 10 + 3) - 1, -(g * 100 + p * 10 + k) - 1 FROM root, (VALUES (1), (2)) AS t(k) WHERE p < 2),
nodes AS (SELECT DISTINCT graph_id, id FROM edges UNION SELECT g, -(g * 100 + 99) - 1 FROM graphs),
heads AS (SELECT graph_id, id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.parent_id = n.id)),
walk(graph_id, id, depth) AS (SELECT g, -(g * 100 + 99) - 1, 0 FROM graphs UNION SELECT e.graph_id, e.id, depth + 1 FROM walk w JOIN edges e ON e.graph_id = w.graph_id AND e.parent_id = w.id),
cuts AS (SELECT graph_id, id, CAST(max(depth) AS BIGINT) AS max_cut FROM walk GROUP BY graph_id, id)"""
ORDER_SQL = """, ranked AS (SELECT *, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS BIGINT) * 1000000000 + id AS pk,
  row_number() OVER (PARTITION BY g, u, p ORDER BY ts DESC, id DESC) AS d FROM ev),
keyed AS (SELECT *, max(pk) OVER (PARTITION BY g, u, p ORDER BY d ROWS UNBOUNDED PRECEDING) AS rk FROM ranked)"""


def dag(s, d, known: bool = True) -> tuple[DataFrame, DataFrame, graph.Segments | None]:
    """(commands, edges, segments) of the graphs above; the segments are the users'
    chains, or with ``known`` false left for the operators to find."""
    events = load(s, d, "events")
    period = F.greatest(F.least(F.expr("(unix_date(CAST(ts AS DATE)) - 19723) div 10"), F.lit(2)), F.lit(0)).cast("long")
    rows = events.select(
        F.expr("user_id div 4").alias("g"), (F.col("user_id") % 4).alias("u"), period.alias("p"), F.col("event_id").alias("id"), "ts", "event_type", "value",
        F.lit(1).alias("priority_rank"), priority().alias("priority_n"),
    )
    rows = cut(graph.places(rows, ["g", "u", "p"], ["ts", "id"], F.unix_date(F.col("ts").cast("date")), "k"))
    made = lambda k: -(F.col("g") * 100 + F.col("p") * 10 + F.lit(k)) - 1
    first = -(F.col("g") * 100 + 99) - 1
    root = F.when(F.col("p") == 0, first).otherwise(-(F.col("g") * 100 + (F.col("p") - 1) * 10 + 3) - 1)
    graphs = cut(rows.select("g").distinct())
    periods = graphs.withColumn("p", F.explode(F.array(*[F.lit(p).cast("long") for p in range(2)])))
    above = rows.select("g", "u", "p", (F.col("k") + 1).alias("k"), F.col("id").alias("parent_id"))
    edges = rows.join(above, ["g", "u", "p", "k"], "left").select("g", "id", F.coalesce("parent_id", root).alias("parent_id"))
    ends = rows.groupBy("g", "p", "u").agg(F.max_by("id", "k").alias("parent_id")).filter("p < 2")
    sides = periods.withColumn("s", F.explode(F.array(F.lit(1), F.lit(2)))).join(ends.withColumn("s", F.expr("CAST(u div 2 + 1 AS INT)")), ["g", "p", "s"], "left")
    edges = edges.union(sides.select("g", made(F.col("s")), F.coalesce("parent_id", root)))
    edges = edges.union(periods.select("g", made(3).alias("id"), F.explode(F.array(made(1), made(2)))))
    merges = periods.select("g", F.explode(F.array(made(1), made(2), made(3))).alias("id"))
    bare = lambda rank: [F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit(rank).alias("priority_rank"), F.lit(0).cast("long").alias("priority_n")]
    commands = rows.select("g", "id", "ts", "event_type", "value", "priority_rank", "priority_n").union(merges.select("g", "id", *bare(0))).union(graphs.select("g", first.alias("id"), *bare(3)))
    commands, edges = cut(commands.withColumnRenamed("g", "graph_id")), cut(edges.withColumnRenamed("g", "graph_id").distinct())
    if not known:
        return commands, edges, None
    chained = rows.select(F.col("g").alias("graph_id"), "id", F.concat_ws(":", "p", "u").alias("seg"), (F.col("k") - 1).alias("off"))
    single = commands.filter("id < 0").select("graph_id", "id", F.col("id").cast("string"), F.lit(0).cast("long"))
    return commands, edges, graph.segments_of(chained.union(single), edges)


def near(commands: DataFrame, order: str, steps: tuple[int, ...]) -> DataFrame:
    """Pairs (graph_id, a, b) of each command and the ones so many places on in its graph."""
    x = commands.select("graph_id", F.col("id").alias("a"), F.explode(F.array(*[F.col(order) + n for n in steps])).alias(order))
    return x.join(commands.select("graph_id", F.col("id").alias("b"), order), ["graph_id", order]).select("graph_id", "a", "b")


@query(DAG_SQL + " SELECT graph_id, id, max_cut FROM cuts")
def dag_max_cut(s, d):
    return graph.max_cut(*dag(s, d, known=False))


@query(DAG_SQL + """, placed AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS k FROM nodes),
up(graph_id, b, id) AS (SELECT graph_id, id, parent_id FROM edges UNION SELECT u.graph_id, b, e.parent_id FROM up u JOIN edges e ON e.graph_id = u.graph_id AND e.id = u.id)
SELECT x.graph_id, x.id AS a, y.id AS b, u.id IS NOT NULL AS above FROM placed x JOIN placed y ON x.graph_id = y.graph_id AND y.k IN (x.k, x.k + 1, x.k + 9, x.k - 4)
LEFT JOIN up u ON u.graph_id = x.graph_id AND u.b = y.id AND u.id = x.id""")
def dag_is_ancestor(s, d):
    """Of each command and four others of its graph, by id: most are concurrent."""
    commands, edges, segments = dag(s, d)
    placed = braid.sequences(commands.select("graph_id", "id"), ["graph_id"], [F.col("id")], "k")
    return graph.is_ancestor(near(placed, "k", (0, 1, 9, -4)), commands, edges, segments)


NODES_SQL = ", nodes_asked AS (SELECT g AS graph_id, id FROM ends WHERE p = 1 AND u < 2)"


@query(DAG_SQL + NODES_SQL + """, above(graph_id, start, id) AS (SELECT graph_id, id, id FROM nodes_asked UNION SELECT a.graph_id, start, e.parent_id FROM above a JOIN edges e ON e.graph_id = a.graph_id AND e.id = a.id),
shared AS (SELECT graph_id, id AS c FROM above GROUP BY graph_id, id HAVING count(*) = (SELECT count(*) FROM nodes_asked n WHERE n.graph_id = above.graph_id)),
around(graph_id, c, id) AS (SELECT n.graph_id, c, n.id FROM nodes_asked n JOIN shared USING (graph_id) WHERE n.id <> c
  UNION SELECT a.graph_id, c, e.parent_id FROM around a JOIN edges e ON e.graph_id = a.graph_id AND e.id = a.id WHERE e.parent_id <> c),
passed AS (SELECT s.graph_id, c FROM shared s WHERE NOT EXISTS (SELECT 1 FROM around a WHERE a.graph_id = s.graph_id AND a.c = s.c AND a.id = -(s.graph_id * 100 + 99) - 1))
SELECT graph_id, max_by(id, max_cut) AS id, max(max_cut) AS max_cut FROM passed p JOIN cuts x USING (graph_id) WHERE x.id = p.c GROUP BY graph_id""")
def dag_common_ancestor(s, d):
    """Of the ends of two users' chains in the second period."""
    commands, edges, segments = dag(s, d)
    rows = load(s, d, "events").filter("user_id % 4 < 2 AND ts >= TIMESTAMP '2024-01-11 00:00:00' AND ts < TIMESTAMP '2024-01-21 00:00:00'")
    last = rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("id"))
    return graph.common_ancestor(last.select(F.expr("user_id div 4").alias("graph_id"), "id"), commands, edges, segments)


@query(DAG_SQL + """, has(graph_id, id) AS (SELECT g, id FROM ev WHERE id % 5 = 0 AND ts < TIMESTAMP '2024-01-16 00:00:00' UNION SELECT h.graph_id, e.parent_id FROM has h JOIN edges e ON e.graph_id = h.graph_id AND e.id = h.id)
SELECT graph_id, id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM has h WHERE h.graph_id = n.graph_id AND h.id = n.id)""")
def dag_needed(s, d):
    commands, edges, segments = dag(s, d)
    return replica.needed(commands.select("graph_id", "id"), commands.filter("id >= 0 AND id % 5 = 0 AND ts < TIMESTAMP '2024-01-16 00:00:00'"), edges, segments)


@query(DAG_SQL + """, asked AS (SELECT g AS graph_id, id FROM ev WHERE id % 7 = 0),
over(graph_id, id) AS (SELECT e.graph_id, e.parent_id FROM asked a JOIN edges e ON e.graph_id = a.graph_id AND e.id = a.id UNION SELECT o.graph_id, e.parent_id FROM over o JOIN edges e ON e.graph_id = o.graph_id AND e.id = o.id),
top AS (SELECT a.graph_id, a.id, max_cut, row_number() OVER (PARTITION BY a.graph_id ORDER BY max_cut DESC, a.id) AS n FROM asked a JOIN cuts c ON c.graph_id = a.graph_id AND c.id = a.id
  WHERE NOT EXISTS (SELECT 1 FROM over o WHERE o.graph_id = a.graph_id AND o.id = a.id))
SELECT graph_id, id, max_cut FROM top WHERE n <= 3""".replace("over(", "covered(").replace("FROM over o", "FROM covered o"))
def dag_antichain(s, d):
    commands, edges, segments = dag(s, d)
    known = commands.filter("id >= 0 AND id % 7 = 0").select("graph_id", "id").join(graph.max_cut(commands, edges, segments), ["graph_id", "id"])
    return replica.antichain(known, commands, edges, 3, segments)


@query(DAG_SQL + ORDER_SQL + """ SELECT g AS graph_id, id, row_number() OVER (PARTITION BY g ORDER BY p, rk DESC, d DESC) AS position FROM
(SELECT g, p, id, rk, d FROM keyed UNION ALL SELECT g, -1, -(g * 100 + 99) - 1, 0, 0 FROM graphs)""")
def dag_braid(s, d):
    commands, edges, _ = dag(s, d, known=False)
    return braid.braid(commands, edges)


@query(DAG_SQL + ORDER_SQL + """, seen AS (SELECT g AS graph_id, id % 20 AS name, value, event_type, row_number() OVER (PARTITION BY g, id % 20 ORDER BY p DESC, rk, d) AS n FROM keyed WHERE p = 0 OR p = 1 AND u < 2)
SELECT graph_id, name, value FROM seen WHERE n = 1 AND event_type <> 'error'""")
def facts_at_command(s, d):
    """As they are at the merge of two users' chains in the second period."""
    commands, edges, segments = dag(s, d)
    changes = commands.filter("priority_rank = 1").select("graph_id", "id", F.lit(0).alias("seq"), (F.col("id") % 20).alias("name"), "value", (F.col("event_type") == "error").alias("deleted"))
    at = commands.select("graph_id", (-(F.col("graph_id") * 100 + 11) - 1).alias("id")).distinct()
    return braid.facts_at(changes, SETTING, commands, edges, at, segments=segments)


@query("""SELECT p.event_id, v.event_id AS viewed FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN
(SELECT user_id, ts, event_id FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of_join(s, d):
    """The last view of the same user at each purchase."""
    rows = load(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    views = rows.filter("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("viewed"))
    bought = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return facts.as_of_join(bought, views, ["user_id"], "ts", "at", ["viewed"], lambda t: F.unix_date(t.cast("date"))).select("event_id", "viewed")


# --- rules, effects, folds, streams ---------------------------------------------


def payment() -> rules.Rule:
    return rules.Rule(
        "Paid",
        [(F.col("event_type").isin("purchase", "error"), "Ignored"), (F.col("value") >= 5, "TooLittle")],
        {"id": F.col("event_id"), "amount": F.col("value")},
        {"TooLittle": {"id": F.col("event_id"), "amount": -F.col("value")}},
    )


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('purchase', 'error') THEN 'Ignored' WHEN value < 5 THEN 'TooLittle' END AS recall,
CASE WHEN event_type IN ('purchase', 'error') AND value >= 5 THEN 'normal' ELSE 'check' END AS exit FROM events""")
def check_else_recall(s, d):
    return payment().judged(load(s, d, "events")).select("event_id", "recall", "exit")


@query("""WITH w AS (SELECT event_id AS p, 0 AS seq, event_id % 20 AS name, value, FALSE AS deleted FROM events WHERE event_type IN ('purchase', 'error') AND value >= 5
UNION ALL SELECT event_id, 1, event_id % 7, NULL, TRUE FROM events WHERE event_type = 'error' AND value >= 5
UNION ALL SELECT event_id, 0, event_id % 20, -1, FALSE FROM events WHERE event_type IN ('purchase', 'error') AND value < 5)
SELECT name, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p DESC, seq DESC) AS n FROM w) WHERE n = 1 AND NOT deleted""")
def rule_writes(s, d):
    """Accepted commands set a fact and may delete another; recalled ones set it to -1."""
    name = {"name": F.col("event_id") % 20}
    rule = replace(
        payment(),
        writes=[rules.Write("create", SETTING, name, {"value": F.col("value")}), rules.Write("delete", SETTING, {"name": F.col("event_id") % 7}, when=F.col("event_type") == "error")],
        recall_writes={"TooLittle": [rules.Write("update", SETTING, name, {"value": F.lit(-1.0)})]},
    )
    changes = rule.changes(load(s, d, "events"), SETTING, ["event_id"])
    return facts.latest(changes, SETTING, ["event_id", "seq"])


@query("""SELECT effect, id, amount, recalled FROM (SELECT 'Paid' AS effect, event_id AS id, value AS amount, FALSE AS recalled, event_id % 3 AS b FROM events WHERE event_type IN ('purchase', 'error') AND value >= 5
UNION ALL SELECT 'TooLittle', event_id, -value, TRUE, event_id % 3 FROM events WHERE event_type IN ('purchase', 'error') AND value < 5) WHERE b <> 1""")
def effect_sink(s, d):
    """Three batches of effects: the second is rolled back, the third comes twice."""
    sink = sinks.BatchSink(s, scratch(s))
    for batch_id, n in enumerate((0, 1, 2, 2)):
        sink.begin(min(batch_id, 2))
        sink.consume(payment().emitted(load(s, d, "events").filter(F.col("event_id") % 3 == n)))
        sink.rollback() if n == 1 else sink.commit()
    return sink.read()


@query("SELECT user_id AS graph_id, event_id AS id FROM events WHERE user_id <> 7")
def remove_one_graph(s, d):
    table = Snapshots(s, scratch(s))
    table.commit(load(s, d, "events").select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("id")))
    table.remove_graph(7)
    return table.read()


@query("""SELECT 'Paid' AS effect, event_id AS id, value AS amount, FALSE AS recalled FROM events WHERE event_type IN ('purchase', 'error') AND value >= 5
UNION ALL SELECT 'TooLittle', event_id, -value, TRUE FROM events WHERE event_type IN ('purchase', 'error') AND value < 5""")
def recall_effects(s, d):
    return payment().emitted(load(s, d, "events"))


@query("""WITH RECURSIVE n AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('purchase', 'error')),
f(user_id, k, event_id, balance, accepted) AS (
  SELECT user_id, k, event_id, CASE WHEN event_type = 'purchase' THEN c ELSE 0 END, event_type = 'purchase' FROM n WHERE k = 1
  UNION ALL
  SELECT n.user_id, n.k, n.event_id, f.balance + CASE WHEN event_type = 'purchase' THEN c WHEN f.balance >= 2000 THEN -2000 ELSE 0 END, event_type = 'purchase' OR f.balance >= 2000
  FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1)
SELECT user_id, event_id, balance, accepted FROM f""")
def conditional_fold(s, d):
    """A purchase pays in; an error takes 20.00 out, if there is as much."""

    def step(state, row):
        if row["event_type"] == "purchase":
            state, good = state + row["cents"], True
        else:
            good = state >= 2000
            state -= 2000 if good else 0
        return state, {"user_id": row["user_id"], "event_id": row["event_id"], "balance": state, "accepted": good}

    rows = load(s, d, "events").filter("event_type IN ('purchase', 'error')").select("user_id", "event_id", "ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return braid.fold(rows, ["user_id"], ["ts", "event_id"], step, int, "user_id long, event_id long, balance long, accepted boolean")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS counter FROM events")
def running_counter(s, d):
    rows = load(s, d, "events").select("event_id", "user_id", "ts")
    return graph.places(rows, ["user_id"], ["ts", "event_id"], F.unix_date(F.col("ts").cast("date")), "counter").select("event_id", "user_id", "counter")


@query("SELECT name, value FROM (SELECT event_id % 20 AS name, value, event_type, row_number() OVER (PARTITION BY event_id % 20 ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def stream_fold(s, d):
    """The events as a stream of files, folded micro-batch by micro-batch."""
    root = scratch(s)
    table = load(s, d, "events")
    stream = s.readStream.schema(table.schema).parquet(f"{d}/events.parquet*")
    changes = stream.select((F.col("event_id") % 20).alias("name"), "value", (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("p"))
    state = folds.fold_stream(changes, Snapshots(s, f"{root}/state"), SETTING, ["p"], f"{root}/checkpoint")
    return folds.current(state, SETTING)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(s, d):
    return folds.windowed_counts(load(s, d, "events"), "1 hour", "10 minutes").select(F.col("window.start").alias("window_start"), "event_type", "n")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
