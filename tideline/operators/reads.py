"""Fact reads for each row of another table: lookups, existence and bounded counts.

``on`` maps key columns of the facts to columns of the outer rows; it is a
prefix of the fact's key, so the join is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import scan
from .schema import Fact, SchemaError


def _side(facts: DataFrame, fact: Fact, on: dict[str, str], value: dict | None) -> DataFrame:
    fact.check_key(dict.fromkeys(on, F.lit(None)))
    return scan(facts, fact, {}, value, ordered=False)


def _equal(outer: DataFrame, inner: DataFrame, on: dict[str, str]):
    out = F.lit(True)
    for k, o in on.items():
        out = out & (outer[o] == inner[k])
    return out


def first(facts: DataFrame, fact: Fact, key: dict | None = None, value: dict | None = None) -> DataFrame:
    """The first match in key order, with all its columns."""
    return scan(facts, fact, key, value).limit(1)


def lookup_join(outer: DataFrame, facts: DataFrame, fact: Fact, on: dict[str, str], value: dict | None = None, how: str = "left", name: str = "found") -> DataFrame:
    """Each outer row with the first match in key order as a struct; ``left``
    keeps rows without one (null), ``inner`` drops them."""
    rest = [k for k in fact.key if k not in on]
    body = F.struct(*fact.key, *fact.value)
    side = _side(facts, fact, on, value)
    best = F.min_by(body, F.struct(*rest)) if rest else F.first(body)
    side = side.groupBy(*[F.col(k).alias(f"_{k}") for k in on]).agg(best.alias(name))
    test = F.lit(True)
    for k, o in on.items():
        test = test & (outer[o] == side[f"_{k}"])
    return outer.join(side, test, how).drop(*[f"_{k}" for k in on])


def exists(outer: DataFrame, facts: DataFrame, fact: Fact, on: dict[str, str], value: dict | None = None, negate: bool = False) -> DataFrame:
    side = _side(facts, fact, on, value)
    return outer.join(side, _equal(outer, side, on), "left_anti" if negate else "left_semi")


def counts(outer: DataFrame, facts: DataFrame, fact: Fact, on: dict[str, str], value: dict | None = None, limit: int | None = None, name: str = "n") -> DataFrame:
    """Each outer row with its number of matches, at most ``limit``."""
    if limit is not None and limit <= 0:
        raise SchemaError("a count's limit must be above 0")
    side = _side(facts, fact, on, value).groupBy(*[F.col(k).alias(f"_{k}") for k in on]).agg(F.count("*").alias("_n"))
    test = F.lit(True)
    for k, o in on.items():
        test = test & (outer[o] == side[f"_{k}"])
    n = F.coalesce("_n", F.lit(0).cast("long"))
    out = outer.join(side, test, "left").withColumn(name, n if limit is None else F.least(n, F.lit(limit).cast("long")))
    return out.drop("_n", *[f"_{k}" for k in on])


def at_least(outer, facts, fact, on, n: int, value=None) -> DataFrame:
    return counts(outer, facts, fact, on, value, n, "_c").filter(F.col("_c") >= n).drop("_c")


def at_most(outer, facts, fact, on, n: int, value=None) -> DataFrame:
    return counts(outer, facts, fact, on, value, n + 1, "_c").filter(F.col("_c") <= n).drop("_c")


def exactly(outer, facts, fact, on, n: int, value=None) -> DataFrame:
    return counts(outer, facts, fact, on, value, n + 1, "_c").filter(F.col("_c") == n).drop("_c")


def count_up_to(facts: DataFrame, fact: Fact, n: int, key: dict | None = None, value: dict | None = None) -> DataFrame:
    """One row: the number of matches, reading no more than n of them."""
    if n <= 0:
        raise SchemaError("a count's limit must be above 0")
    return scan(facts, fact, key, value, ordered=False).limit(n).agg(F.count("*").alias("n"))


def map_facts(facts: DataFrame, fact: Fact, key: dict | None = None, **columns) -> DataFrame:
    """A row for each match of a key prefix. Values don't restrict a map; the
    body sees the facts as they were when it began, as any DataFrame does."""
    return scan(facts, fact, key, ordered=False).select(*[c.alias(n) for n, c in columns.items()])


def map_nested(outer: DataFrame, facts: DataFrame, fact: Fact, on: dict[str, str], **columns) -> DataFrame:
    """A map inside a map: a row for each outer row and each match of its key prefix."""
    side = _side(facts, fact, on, None)
    return outer.join(side, _equal(outer, side, on)).select(*[c.alias(n) for n, c in columns.items()])
