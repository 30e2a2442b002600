"""Declared fact schemas and the checks that a plan has to pass before it runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_TYPES = {"bigint", "boolean", "string", "binary", "int"}  # int: an enum's ordinal


LITERALS = {"bigint": int, "int": int, "boolean": bool, "string": str, "binary": (bytes, bytearray), "double": float}


class SchemaError(ValueError):
    """A literal or statement that the declared schema doesn't allow."""


@dataclass(frozen=True)
class Fact:
    """A relation with one row for each key. A fact without key columns has one row at most."""

    name: str
    key: dict[str, str]
    value: dict[str, str] = field(default_factory=dict)
    immutable: bool = False
    check: bool = True  # of the key's types; a key made by an operator can have others

    def __post_init__(self):
        if self.check and (bad := [k for k, t in self.key.items() if t not in KEY_TYPES]):
            raise SchemaError(f"{self.name}: {', '.join(bad)} can't be a key")
        if both := self.key.keys() & self.value.keys():
            raise SchemaError(f"{self.name}: {', '.join(both)} is key and value")

    def check_key(self, given: dict, whole: bool = False) -> list[str]:
        """The concrete key columns; after the first that is left open none may be concrete."""
        if unknown := given.keys() - self.key.keys():
            raise SchemaError(f"{self.name} has no key {', '.join(sorted(unknown))}")
        concrete = [k for k in self.key if given.get(k) is not None]
        if concrete != list(self.key)[: len(concrete)]:
            raise SchemaError(f"{self.name}: leading keys must be given before later ones")
        if whole and len(concrete) < len(self.key):
            raise SchemaError(f"{self.name}: every key must be given")
        self._check_types(given, self.key)
        return concrete

    def _check_types(self, given: dict, declared: dict[str, str]) -> None:
        for name, value in given.items():
            if value is None or isinstance(value, Column):
                continue
            want = LITERALS.get(declared[name])
            if want and (not isinstance(value, want) or isinstance(value, bool) != (want is bool)):
                raise SchemaError(f"{self.name}: {name} is {declared[name]}, not {type(value).__name__}")

    def check_value(self, given: dict, whole: bool = False) -> None:
        if unknown := given.keys() - self.value.keys():
            raise SchemaError(f"{self.name} has no value {', '.join(sorted(unknown))}")
        if whole and given.keys() != self.value.keys():
            raise SchemaError(f"{self.name}: every value must be given")
        self._check_types(given, self.value)

    def rows(self, df: DataFrame) -> DataFrame:
        """df's columns in declared order and type."""
        return df.select(*[F.col(c).cast(t).alias(c) for c, t in (self.key | self.value).items()])


def facts_from_json(text: str) -> dict[str, Fact]:
    """Schemas from a JSON object: name -> {key, value, immutable}."""
    return {n: Fact(n, d.get("key", {}), d.get("value", {}), d.get("immutable", False)) for n, d in json.loads(text).items()}


@dataclass(frozen=True)
class Enum:
    name: str
    members: tuple[str, ...]

    def __getattr__(self, member: str) -> Column:
        if member.startswith("_") or member not in self.members:
            raise AttributeError(member)
        return F.lit(self.members.index(member))

    def match(self, subject: Column, arms: dict[str, Column], default: Column | None = None) -> Column:
        """A value for each member; without a default every member needs an arm."""
        if unknown := arms.keys() - set(self.members):
            raise SchemaError(f"{self.name} has no {', '.join(sorted(unknown))}")
        if default is None and (missing := [m for m in self.members if m not in arms]):
            raise SchemaError(f"match on {self.name} lacks {', '.join(missing)}")
        out = None
        for m, value in arms.items():
            test = subject == F.lit(self.members.index(m))
            out = F.when(test, value) if out is None else out.when(test, value)
        return default if out is None else out.otherwise(default) if default is not None else out
