"""Declared functions: a module's names, argument types and results, checked when a
plan is made. A function is one Spark expression or a user function over columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalars


class ForeignError(ValueError):
    """A call that the declaration doesn't allow."""


@dataclass(frozen=True)
class Function:
    name: str
    arguments: dict[str, str]
    result: str
    body: Callable[..., Column]


@dataclass(frozen=True)
class Module:
    name: str
    functions: dict[str, Function] = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, *functions: Function) -> Module:
        return cls(name, {f.name: f for f in functions})

    def call(self, name: str, rows: DataFrame, *arguments: str) -> Column:
        """The function over columns of rows; their number and types must be the declared ones."""
        if name not in self.functions:
            raise ForeignError(f"{self.name} has no {name}")
        f = self.functions[name]
        if len(arguments) != len(f.arguments):
            raise ForeignError(f"{self.name}::{name} takes {len(f.arguments)} arguments, not {len(arguments)}")
        for (a, want), column in zip(f.arguments.items(), arguments, strict=True):
            have = rows.select(column).schema[0].dataType.simpleString()
            if have != want:
                raise ForeignError(f"{self.name}::{name}: {a} is {want}, not {have}")
        return f.body(*[F.col(c) for c in arguments]).cast(f.result)


@dataclass(frozen=True)
class Imports:
    """What a plan may call: only the modules that it names."""

    modules: dict[str, Module]

    def call(self, path: str, rows: DataFrame, *arguments: str) -> Column:
        module, _, name = path.partition("::")
        if module not in self.modules:
            raise ForeignError(f"{module} isn't imported")
        return self.modules[module].call(name, rows, *arguments)


def use(*modules: Module) -> Imports:
    return Imports({m.name: m for m in modules})


def envelope(parent: str = "parent_id", author: str = "author_id", command: str = "id", payload: str = "payload") -> Column:
    """A command's envelope as a struct."""
    return F.struct(F.col(parent).alias("parent_id"), F.col(author).alias("author_id"), F.col(command).alias("command_id"), F.col(payload).alias("payload"))


ENVELOPE = "struct<parent_id:bigint,author_id:bigint,command_id:bigint,payload:string>"
ENVELOPES = Module.of("envelope", *[
    Function(n, {"e": ENVELOPE}, kind, lambda e, n=n: e.getField(n)) for n, kind in (("parent_id", "bigint"), ("author_id", "bigint"), ("command_id", "bigint"), ("payload", "string"))
])
IDENTITIES = Module.of(
    "idam",
    Function("derive_device_id", {"key": "string"}, "string", lambda k: scalars.tagged_id("device", k)),
    Function("derive_sign_key_id", {"key": "string"}, "string", lambda k: scalars.tagged_id("sign", k)),
    Function("derive_enc_key_id", {"key": "string"}, "string", lambda k: scalars.tagged_id("encrypt", k)),
    Function("compute_change_id", {"current": "string", "new": "string"}, "string", scalars.change_id),
    Function("label_id", {"command": "string", "name": "string"}, "string", scalars.label_id),
)
