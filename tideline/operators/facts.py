"""Facts as tables of changes: latest state, time travel, overlays and writes.

A change has the fact's key and value columns, ``deleted``, and a position. The
state of a key is its change with the greatest position; a deletion hides it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .schema import Fact, SchemaError


def equal(literal: dict) -> Column:
    """A conjunction of equalities, true for an empty literal; None leaves a column open."""
    out = F.lit(True)
    for c, v in literal.items():
        if v is not None:
            out = out & F.col(c).eqNullSafe(v if isinstance(v, Column) else F.lit(v))
    return out


def latest(changes: DataFrame, fact: Fact, position: list[str], keep_deleted: bool = False) -> DataFrame:
    """Current rows. An aggregate, combined before the shuffle, so a key that is
    written very often is not a hot group."""
    body = F.struct(*[F.col(c) for c in (*fact.value, "deleted")])
    last = F.max_by(body, F.struct(*position))
    if fact.key:
        out = changes.groupBy(*fact.key).agg(last.alias("_last"))
    else:
        out = changes.agg(last.alias("_last")).filter("_last IS NOT NULL")
    out = out.select(*fact.key, "_last.*")
    return out if keep_deleted else out.filter("NOT deleted").drop("deleted")


def as_of(changes: DataFrame, fact: Fact, position: list[str], limit: Column) -> DataFrame:
    """The state after all changes whose position isn't beyond ``limit``."""
    return latest(changes.filter(F.struct(*position) <= limit), fact, position)


def as_of_join(outer: DataFrame, changes: DataFrame, on: list[str], at: str, position: str, value: list[str], bucket: Callable[[Column], Column]) -> DataFrame:
    """Each outer row with the ``value`` columns (null if there is none) of the last
    change of its key whose ``position`` isn't beyond the row's ``at``.

    ``bucket`` maps positions to numbers that don't fall as positions grow (say, the
    day). A key's rows are looked through bucket by bucket; only the buckets' last
    changes are carried along a key, so a key may have any number of changes.
    """
    body = F.struct(*[F.col(v) for v in value])
    left = outer.withColumns({"_row": F.struct(*outer.columns), "_at": F.col(at), "_side": F.lit(1), "_change": F.lit(None).cast(changes.select(body.alias("x")).schema["x"].dataType)})
    right = changes.withColumns({"_row": F.lit(None).cast(left.schema["_row"].dataType), "_at": F.col(position), "_side": F.lit(0), "_change": body})
    names = [*on, "_row", "_at", "_side", "_change"]
    rows = left.select(*names).union(right.select(*names)).withColumn("_bucket", bucket(F.col("_at")))
    seen = Window.partitionBy(*on, "_bucket").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*on, "_bucket").agg(F.max_by(F.when(F.col("_side") == 0, F.col("_change")), F.when(F.col("_side") == 0, F.col("_at"))).alias("_c"))
    before = last.select(*[F.col(k).alias(f"_on_{k}") for k in on], F.col("_bucket").alias("_b"), F.last("_c", ignorenulls=True).over(along).alias("_before"))
    met = rows.withColumn("_change", F.last("_change", ignorenulls=True).over(seen)).filter("_side = 1")
    test = F.col("_bucket") == F.col("_b")
    for k in on:
        test = test & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return met.join(before, test, "left").withColumn("_found", F.coalesce("_change", "_before")).select("_row.*", *[F.col("_found").getField(v).alias(v) for v in value])


def live(changes: DataFrame, fact: Fact, position: list[str]) -> DataFrame:
    """For each key its number of changes and of tombstones among them, and whether
    a read skips it for its last one: (key, changes, tombstones, skipped)."""
    last = F.max_by("deleted", F.struct(*position))
    return changes.groupBy(*fact.key).agg(F.count("*").alias("changes"), F.count_if("deleted").alias("tombstones"), last.alias("skipped"))


def lookup(facts: DataFrame, fact: Fact, key: dict) -> DataFrame:
    """The row of a whole key, if there is one."""
    fact.check_key(key, whole=True)
    return facts.filter(equal(key))


def scan(facts: DataFrame, fact: Fact, key: dict | None = None, value: dict | None = None, ordered: bool = True) -> DataFrame:
    """Rows whose key begins with the given one, and whose values agree, in key order."""
    fact.check_key(key or {})
    fact.check_value(value or {})
    out = facts.filter(equal(key or {}) & equal(value or {}))
    return out.orderBy(*fact.key) if ordered and fact.key else out


def overlay(base: DataFrame, session: DataFrame, fact: Fact) -> DataFrame:
    """base as a session sees it: a session's row hides base's, a deleted one both."""
    value = list(fact.value)
    over = session.select(*fact.key, F.struct(*value).alias("_new"), F.col("deleted").alias("_gone"))
    both = base.select(*fact.key, F.struct(*value).alias("_old")).join(over, list(fact.key), "full_outer")
    seen = F.when(F.col("_gone").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    return both.filter(~F.coalesce("_gone", F.lit(False))).select(*fact.key, seen.alias("_row")).select(*fact.key, "_row.*")


def create(rows: DataFrame, fact: Fact, existing: DataFrame | None = None) -> DataFrame:
    """Changes that insert rows; keys that exist are overwritten, or with
    ``existing`` (strict) the rows with such keys are left out."""
    out = rows.select(*fact.key, *fact.value, F.lit(False).alias("deleted"))
    return out if existing is None else out.join(existing.select(*fact.key), list(fact.key), "left_anti")


def update(facts: DataFrame, requests: DataFrame, fact: Fact, expected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(changes, rejected). requests: key and ``new_`` columns, and if expected
    ``old_`` columns for every value, all of which must agree. A missing row is rejected."""
    if fact.immutable:
        raise SchemaError(f"{fact.name} is immutable")
    now = facts.select(*fact.key, F.lit(True).alias("_there"), *[F.col(v).alias(f"_now_{v}") for v in fact.value])
    met = requests.join(now, list(fact.key), "left")
    good = F.coalesce("_there", F.lit(False))
    if expected:
        for v in fact.value:
            good = good & F.col(f"old_{v}").eqNullSafe(F.col(f"_now_{v}"))
    changes = met.filter(good).select(*fact.key, *[F.col(f"new_{v}").alias(v) for v in fact.value], F.lit(False).alias("deleted"))
    return changes, met.filter(~good).select(*requests.columns)


def delete(keys: DataFrame, fact: Fact, existing: DataFrame | None = None) -> DataFrame:
    """Tombstones for whole keys; with ``existing`` (strict) only for those that are there."""
    out = keys.select(*fact.key, *[F.lit(None).cast(t).alias(v) for v, t in fact.value.items()], F.lit(True).alias("deleted"))
    return out if existing is None else out.join(existing.select(*fact.key), list(fact.key), "left_semi")
