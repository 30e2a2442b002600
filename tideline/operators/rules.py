"""Rules: checks that accept a command or recall it, and the rows either gives."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import Fact, SchemaError

RANKS = {"merge": 0, "basic": 1, "finalize": 2, "init": 3}


@dataclass(frozen=True)
class Priority:
    """Exactly one of init, finalize or a basic number; none if ephemeral."""

    kind: str | None
    n: int = 0

    def check(self, persistent: bool) -> None:
        if persistent and self.kind not in ("init", "finalize", "basic"):
            raise SchemaError("a persistent command has one priority")
        if not persistent and self.kind is not None:
            raise SchemaError("an ephemeral command has no priority")
        if not 0 <= self.n < 1 << 32:
            raise SchemaError("a priority is an unsigned 32-bit number")

    def columns(self) -> dict[str, Column]:
        return {"priority_rank": F.lit(RANKS[self.kind or "basic"]), "priority_n": F.lit(self.n).cast("long")}


@dataclass(frozen=True)
class Write:
    """A change that a rule makes: ``kind`` is create, update or delete; columns of
    the key, and of the value unless it deletes. ``when`` restricts it."""

    kind: str
    fact: Fact
    key: dict[str, Column]
    value: dict[str, Column] = field(default_factory=dict)
    when: Column | None = None

    def __post_init__(self):
        if self.kind not in ("create", "update", "delete"):
            raise SchemaError(f"{self.kind} is no write")
        if self.kind == "update" and self.fact.immutable:
            raise SchemaError(f"{self.fact.name} is immutable")
        self.fact.check_key(self.key, whole=True)
        if self.kind == "delete":
            self.fact.check_value(self.value)
        else:
            self.fact.check_value(self.value, whole=True)

    def rows(self, commands: DataFrame, carry: list[str]) -> DataFrame:
        kept = commands if self.when is None else commands.filter(self.when)
        value = [self.value.get(v, F.lit(None)).cast(t).alias(v) for v, t in self.fact.value.items()]
        key = [self.key[k].cast(t).alias(k) for k, t in self.fact.key.items()]
        return kept.select(*carry, *key, *value, F.lit(self.kind == "delete").alias("deleted"))


@dataclass(frozen=True)
class Rule:
    """checks are (condition, recall name); the first that fails decides. Reads
    are joined to the commands before, so conditions are plain columns. A false
    or null condition fails."""

    name: str
    checks: list[tuple[Column, str]]
    effects: dict[str, Column]
    recalls: dict[str, dict[str, Column]] = field(default_factory=dict)
    writes: list[Write] = field(default_factory=list)
    recall_writes: dict[str, list[Write]] = field(default_factory=dict)
    priority: Priority | None = None

    def columns(self) -> dict[str, Column]:
        """priority_rank and priority_n of this rule's commands."""
        return (self.priority or Priority("basic")).columns()

    def judged(self, commands: DataFrame) -> DataFrame:
        """commands with ``exit`` (normal or check) and ``recall`` (its name, or null)."""
        out = None
        for condition, recall in self.checks:
            failed = ~F.coalesce(condition, F.lit(False))
            out = F.when(failed, F.lit(recall)) if out is None else out.when(failed, F.lit(recall))
        recall = F.lit(None).cast("string") if out is None else out
        return commands.withColumn("recall", recall).withColumn("exit", F.when(F.col("recall").isNull(), "normal").otherwise("check"))

    def emitted(self, commands: DataFrame) -> DataFrame:
        """Effects of accepted commands, and the compensating ones of recalled commands."""
        rows = self.judged(commands)
        out = rows.filter("exit = 'normal'").select(F.lit(self.name).alias("effect"), *[c.alias(n) for n, c in self.effects.items()], F.lit(False).alias("recalled"))
        for name, fields in self.recalls.items():
            if fields.keys() != self.effects.keys():
                raise SchemaError(f"{name} must give the fields of {self.name}")
            out = out.union(rows.filter(F.col("recall") == name).select(F.lit(name).alias("effect"), *[fields[n].alias(n) for n in self.effects], F.lit(True).alias("recalled")))
        return out

    def changes(self, commands: DataFrame, fact: Fact, carry: list[str]) -> DataFrame:
        """The changes of one fact, with the commands' columns in ``carry`` and
        ``seq``, their place in the command: a command's writes all hold or none."""
        rows = self.judged(commands)
        sides = [(F.col("exit") == "normal", self.writes)] + [(F.col("recall") == name, w) for name, w in self.recall_writes.items()]
        out = None
        for test, writes in sides:
            for seq, w in enumerate(writes):
                if w.fact.name == fact.name:
                    more = w.rows(rows.filter(test), carry).withColumn("seq", F.lit(seq))
                    out = more if out is None else out.unionByName(more)
        if out is None:
            raise SchemaError(f"{self.name} never writes {fact.name}")
        return out
