"""Mixing sources to target weights: tempered shares, met by block permutations.

A source's share p of all tokens becomes a weight p**a / sum(p**a). The exponent
a is bisected in [0, 1] until the mixture meets a target: the least a whose
most repeated source is passed over at most ``max_repeats`` times, or the
largest a whose entropy is at least ``entropy`` nats. Each source then gets its
weight of the token budget: whole epochs of all its documents, and a last,
partial epoch that ends where the budget ends.

An epoch is a permutation of fixed-size blocks and of the documents in each
block, both ordered by MD5 of (seed, epoch, block or document), so any executor
can compute any part again. Blocks are ranked inside ranges of their keys, and
only the ranges' sums are added up along a source; documents are ordered within
their block, so a source with a third of all rows is no different from many
small ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

WORD = r"[^\x20\x09-\x0D]+"
STEPS = 60
HALVINGS = 5  # in one job
MAX_REPEATS = 1.25
BLOCK_TOKENS = 200_000
SEED = 17
RANGE_DIGITS = 3  # of a block's hexadecimal key: 4096 ranges of a source's epoch


def exponent(stats: DataFrame, max_repeats: float | None = None, entropy: float | None = None, budget_share: float = 1.0) -> DataFrame:
    """stats (source, tokens) with the bisected exponent and each weight.

    STEPS halvings, HALVINGS of them in a job: it sums p**a, and for the entropy
    p**a * ln p, at all exponents that the next halvings can come to. So however
    many sources there are, none of them meet in one row.
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("one target: max_repeats or entropy")
    rows = stats.filter("tokens > 0").select("source", "tokens", F.col("tokens").cast("double").alias("t"))
    total, least = rows.agg(F.sum("t"), F.min("t")).first()
    if not total:
        return stats.limit(0).select("source", "tokens", F.lit(0.0).alias("exponent"), F.lit(0.0).alias("weight"))
    p = F.col("t") / F.lit(total)
    low, high = 0.0, 1.0
    for _ in range(STEPS // HALVINGS):
        ways = 1 << HALVINGS
        grid = [low + (high - low) * k / ways for k in range(1, ways)]
        power = [F.pow(p, F.lit(a)) for a in grid]
        found = rows.agg(*[F.sum(x) for x in power], *([F.sum(x * F.ln(p)) for x in power] if entropy is not None else [])).first()
        begin, end = 0, ways
        while end - begin > 1:
            mid = (begin + end) // 2
            a, z = grid[mid - 1], found[mid - 1]
            if max_repeats is not None:  # the smallest source repeats most, and the less the greater the exponent
                up = (least / total) ** (a - 1) / z * budget_share > max_repeats
            else:  # entropy falls as the exponent grows
                up = math.log(z) - a * found[ways - 1 + mid - 1] / z >= entropy
            begin, end = (mid, end) if up else (begin, mid)
        low, high = (grid[begin - 1] if begin else low), (grid[end - 1] if end < ways else high)
    a = high if max_repeats is not None else low
    z = rows.agg(F.sum(F.pow(p, F.lit(a)))).first()[0]
    return rows.select("source", "tokens", F.round(F.lit(a), 6).alias("exponent"), F.round(F.pow(p, F.lit(a)) / F.lit(z), 9).alias("weight"))


def _hash(*parts):
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)) for p in parts]))


def mix(
    docs: DataFrame,
    max_repeats: float | None = MAX_REPEATS,
    entropy: float | None = None,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each time a document is read: doc_id, source, epoch, block,
    block_rank (of the block in its source's epoch), rank (in the block),
    n_tokens, weight, and the document's columns named in ``carry``. ``budget``
    defaults to the tokens that there are.

    A null source is a source of its own, written as the empty string. A text
    without words, or null, has no tokens to budget: it isn't drawn. A very long
    text counts whole, and makes its block that much larger. Repeated rows are
    drawn as often as they stand there; null ids are left out of the hash,
    and of rows with one id in one block the shorter comes first. A document that
    the budget ends inside isn't read, nor is any after it. Columns of docs that
    aren't named don't matter, whatever their names.
    """
    same = [F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], F.lit(k)) for k in range(2)]
    keys = [F.hex(same[0]).alias("_k0"), F.hex(same[1]).alias("_k1")] if carry else []
    tokens = cut(
        docs.select(
            "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("source"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"), *keys,
        ).filter("n_tokens > 0")
    )
    stats = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = int(tokens.agg(F.sum("n_tokens")).first()[0] or 0)
    goal = total if budget is None else int(budget)
    share = goal / total if total else 1.0
    plan = exponent(stats, max_repeats, entropy, share).withColumns({
        "_budget": F.floor(F.col("weight") * F.lit(float(goal))).cast("long"),
        "_blocks": F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(float(block_tokens)))).cast("long"),
    })
    plan = cut(plan.withColumns({"_whole": F.expr("_budget div tokens"), "_rest": F.expr("_budget % tokens")}))
    in_block = F.conv(F.substring(_hash(seed, "doc_id"), 1, 12), 16, 10).cast("long")
    placed = tokens.join(plan.select("source", "_whole", "_blocks"), "source").withColumn("block", F.pmod(in_block, F.col("_blocks")))

    # the last epoch of a source: which blocks lie before the budget's end, and which one holds it
    blocks = (
        placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("_tokens"))
        .join(plan.select("source", "_whole", "_rest", "weight"), "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole"))))
        .withColumn("_key", _hash(seed, "epoch", "source", "block"))
    )
    # ranks and sums inside ranges of the keys, and the ranges' own sums along the source
    blocks = cut(blocks.withColumn("_range", F.substring("_key", 1, RANGE_DIGITS)))
    along = Window.partitionBy("source", "epoch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("source", "epoch", "_range").agg(F.count("*").alias("_n"), F.sum("_tokens").alias("_t"))
    ranges = ranges.select("source", "epoch", "_range", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_n"), F.coalesce(F.sum("_t").over(along), F.lit(0)).alias("_t"))
    order = Window.partitionBy("source", "epoch", "_range").orderBy("_key", "block")
    inner = F.coalesce(F.sum("_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"_rank": F.row_number().over(order), "_inner": inner}).join(ranges, ["source", "epoch", "_range"])
    blocks = blocks.withColumns({"block_rank": (F.col("_n") + F.col("_rank")).cast("long"), "_before": (F.col("_t") + F.col("_inner")).cast("long")})
    blocks = blocks.filter((F.col("epoch") < F.col("_whole")) | (F.col("_before") < F.col("_rest")))
    names = ["_k0", "_k1"] if carry else []
    rows = placed.select("doc_id", "source", "block", "n_tokens", *names).join(
        blocks.select("source", "block", "epoch", "block_rank", "_before", "_whole", "_rest", "weight"), ["source", "block"]
    )
    inside = Window.partitionBy("source", "epoch", "block").orderBy("_key", "doc_id", "n_tokens", *names)
    rows = rows.withColumn("_key", _hash(seed, "epoch", "doc_id")).withColumns({
        "rank": F.row_number().over(inside).cast("long"),
        "_upto": F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before"),
    })
    out = ["doc_id", "source", "epoch", "block", "block_rank", "rank", "n_tokens", "weight"]
    rows = rows.filter("epoch < _whole OR _upto <= _rest").select(*out, *names)
    if not carry:
        return rows
    # the two hashes of all columns tell rows apart; equal rows carry the same values
    whole = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")).dropDuplicates(["_k0", "_k1"])
    return rows.join(whole, ["_k0", "_k1"]).select(*out, *[F.col("_row").getField(c).alias(c) for c in carry])


def op4(documents: DataFrame) -> DataFrame:
    return mix(documents.select("doc_id", "source", "text"))


def sql(docs: str, ctes: str = "") -> str:
    """The same for a DuckDB relation of documents; ctes come before."""
    md5 = lambda *x: "md5(concat_ws(':', " + ", ".join(x) + "))"
    w = "list_transform(p, lambda x: pow(x, {a}) / list_sum(list_transform(p, lambda y: pow(y, {a}))))"
    return rf"""WITH RECURSIVE {ctes}
tokens AS (
  SELECT doc_id, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM {docs}),
real_tokens AS (SELECT * FROM tokens WHERE n_tokens > 0),
stats AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM real_tokens GROUP BY source),
shares AS (SELECT list(tokens / total ORDER BY source) AS p, any_value(total) AS total
           FROM (SELECT source, tokens, sum(tokens) OVER () AS total FROM stats)),
bisect(i, lo, hi, p) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), p FROM shares
  UNION ALL
  SELECT i + 1, CASE WHEN bad THEN (lo + hi) / 2 ELSE lo END, CASE WHEN bad THEN hi ELSE (lo + hi) / 2 END, p
  FROM (SELECT *, list_max(list_transform(range(1, len(p) + 1), lambda k: w[k] / p[k])) > {MAX_REPEATS} AS bad
        FROM (SELECT *, {w.format(a="((lo + hi) / 2)")} AS w FROM bisect WHERE i < {STEPS}))),
weighed AS (SELECT source, tokens, pow(tokens / total, a) / sum(pow(tokens / total, a)) OVER () AS w, total
            FROM (SELECT source, tokens, sum(tokens) OVER () AS total, (SELECT hi FROM bisect WHERE i = {STEPS}) AS a FROM stats)),
plan AS (
  SELECT source, tokens, round(w, 9) AS weight, CAST(floor(round(w, 9) * total) AS BIGINT) AS budget,
         CAST(greatest(1, ceil(tokens / {float(BLOCK_TOKENS)})) AS BIGINT) AS blocks
  FROM weighed),
placed AS (
  SELECT t.*, weight, budget // p.tokens AS whole, budget % p.tokens AS rest,
         CAST('0x' || substr({md5(f"'{SEED}'", "doc_id")}, 1, 12) AS BIGINT) % blocks AS block
  FROM real_tokens t JOIN plan p USING (source)),
block_sums AS (
  SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS tokens, any_value(weight) AS weight, any_value(whole) AS whole, any_value(rest) AS rest
  FROM placed GROUP BY source, block),
epochs AS (SELECT *, unnest(generate_series(0, whole)) AS epoch FROM block_sums),
ranked AS (
  SELECT *, row_number() OVER o AS block_rank, coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
  FROM (SELECT *, {md5(f"'{SEED}'", "epoch", "source", "block")} AS key FROM epochs)
  WINDOW o AS (PARTITION BY source, epoch ORDER BY key, block)),
picked AS (
  SELECT p.doc_id, p.source, r.epoch, p.block, r.block_rank, p.n_tokens, r.weight, r.whole, r.rest, r.bef,
         {md5(f"'{SEED}'", "r.epoch", "p.doc_id")} AS key
  FROM placed p JOIN ranked r ON p.source = r.source AND p.block = r.block),
summed AS (
  SELECT *, row_number() OVER o AS rank, sum(n_tokens) OVER (PARTITION BY source, epoch, block ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) + bef AS upto
  FROM picked WINDOW o AS (PARTITION BY source, epoch, block ORDER BY key, doc_id, n_tokens))
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block, CAST(block_rank AS BIGINT) AS block_rank,
       CAST(rank AS BIGINT) AS rank, n_tokens, weight
FROM summed WHERE epoch < whole OR upto <= rest"""


SQL = sql("documents")
