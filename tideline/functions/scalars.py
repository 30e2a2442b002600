"""Scalar expressions with checked, saturating and optional semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1


def checked_add(x: Column, y: Column) -> Column:
    """None beyond 64 bits."""
    return F.try_add(x.cast("long"), y.cast("long"))


def checked_sub(x: Column, y: Column) -> Column:
    return F.try_subtract(x.cast("long"), y.cast("long"))


def saturating_add(x: Column, y: Column) -> Column:
    return F.coalesce(checked_add(x, y), F.when(y > 0, F.lit(INT_MAX)).otherwise(F.lit(INT_MIN)))


def saturating_sub(x: Column, y: Column) -> Column:
    return F.coalesce(checked_sub(x, y), F.when(y > 0, F.lit(INT_MIN)).otherwise(F.lit(INT_MAX)))


def same(x: Column, y: Column) -> Column:
    """Equality that is never null."""
    return x.eqNullSafe(y)


def either(x: Column, fallback: Column) -> Column:
    """An option's value, or the fallback."""
    return F.coalesce(x, fallback)


def both(x: Column, y: Column) -> Column:
    """And, with y looked at only where x holds."""
    return F.when(x, y).otherwise(F.lit(False))


def any_of(x: Column, y: Column) -> Column:
    return F.when(x, F.lit(True)).otherwise(y)


def some(x: Column) -> Column:
    """An option that can hold another option."""
    return F.struct(F.lit(True).alias("is_some"), x.alias("v"))


def none(kind: str) -> Column:
    return F.struct(F.lit(False).alias("is_some"), F.lit(None).cast(kind).alias("v"))


def ok(x: Column, error: str) -> Column:
    return F.struct(F.lit(True).alias("is_ok"), x.alias("ok"), F.lit(None).cast(error).alias("err"))


def err(x: Column, value: str) -> Column:
    return F.struct(F.lit(False).alias("is_ok"), F.lit(None).cast(value).alias("ok"), x.alias("err"))


def unwrap(x: Column, message: str = "unwrap of none") -> Column:
    return F.coalesce(x, F.raise_error(F.lit(message)))


def todo() -> Column:
    return F.raise_error(F.lit("todo"))


def match(subject: Column, arms: list[tuple[list, Column]], default: Column) -> Column:
    """The first arm with a literal equal to the subject."""
    out = None
    for literals, value in arms:
        test = F.lit(False)
        for x in literals:
            test = test | subject.eqNullSafe(F.lit(x))
        out = F.when(test, value) if out is None else out.when(test, value)
    return default if out is None else out.otherwise(default)


def match_option(subject: Column, some: Callable[[Column], Column], none: Column) -> Column:
    """An arm for an option's value, bound to its argument, and one for none."""
    return F.when(subject.getField("is_some"), some(subject.getField("v"))).otherwise(none)


def match_result(subject: Column, ok: Callable[[Column], Column], err: Callable[[Column], Column]) -> Column:
    """An arm for a result's value and one for its error, each bound to its argument."""
    return F.when(subject.getField("is_ok"), ok(subject.getField("ok"))).otherwise(err(subject.getField("err")))


def convert(source: Column, have: dict[str, str], want: dict[str, str]) -> Column:
    """source as a struct of another type with the same fields and types, in that one's order."""
    if have != want:
        odd = sorted(k for k in have.keys() | want.keys() if have.get(k) != want.get(k))
        raise ValueError(f"{', '.join(odd)} differ")
    return F.struct(*[source.getField(f).alias(f) for f in want])


def insert_fields(own: dict[str, str], *others: dict[str, str]) -> dict[str, str]:
    """A struct's fields with those of others inserted; no name may come twice."""
    out = dict(own)
    for other in others:
        if twice := out.keys() & other.keys():
            raise ValueError(f"{', '.join(sorted(twice))} comes twice")
        out |= other
    return out


def substruct(source: Column, fields: list[str]) -> Column:
    """source's given fields, in that order."""
    return F.struct(*[source.getField(f).alias(f) for f in fields])


def compose(given: dict[str, Column], *sources: tuple[Column, list[str]]) -> Column:
    """Given fields, and the other fields of the sources; none may come twice, and
    every source must add something."""
    seen, out = set(given), [c.alias(n) for n, c in given.items()]
    for source, fields in sources:
        more = [f for f in fields if f not in given]
        if not more:
            raise ValueError("a source adds no field")
        if twice := seen & set(more):
            raise ValueError(f"{', '.join(sorted(twice))} comes from two sources")
        seen |= set(more)
        out += [source.getField(f).alias(f) for f in more]
    return F.struct(*out)


def bytes_from_hex(x: Column) -> Column:
    return F.unhex(x)


def tagged_id(tag: str, *parts: Column) -> Column:
    """An id as the hex SHA-256 of a tag and its parts, each with its length before
    it and null apart from all texts, so that no two lists of parts look alike."""

    def framed(p: Column) -> Column:
        text = p.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(p) for p in (F.lit(tag), *parts)]), 256)


def merge_id(left: Column, right: Column) -> Column:
    """The same whichever side is called left."""
    return tagged_id("merge", F.least(left, right), F.greatest(left, right))


def change_id(current: Column, new: Column) -> Column:
    return tagged_id("change", current, new)


def label_id(command: Column, name: Column) -> Column:
    return tagged_id("label", command, name)
