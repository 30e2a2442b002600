"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in expression over the row's own text, so there is no
shuffle, no user function and no state: the operator costs one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SEPARATOR = r"[\x20\x09-\x0D]"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by are this from at an or "
    "der die das und ist von den mit zu ein eine für auf des dem nicht auch sich "
    "le la les de des et un une du que qui dans pour par sur au avec est "
    "el los las y en del se una por con para su al lo como más"
).split()

#: (metric, comparison, bound): a document is kept if all hold. Integer
#: arithmetic only: a ratio is written as 100 * part against bound * whole.
THRESHOLDS = (
    ("n_words", ">=", "50"),
    ("100 * n_repeat_words", "<=", "50 * n_words"),
    ("word_chars", ">=", "2 * n_words"),
    ("word_chars", "<=", "12 * n_words"),
    ("100 * n_symbols", "<=", "30 * n_words"),
    ("100 * n_stop_words", ">=", "4 * n_words"),
    ("100 * n_dup_lines", "<=", "50 * n_lines"),
)
BASE = THRESHOLDS[:2]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, each counted once.

    Windows become longs, hash above and position below, so that one primitive
    sort brings equal windows together; neighbours with equal hashes are then
    compared word by word.
    """
    bits = F.length(F.bin(n))
    keys = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n.cast("int") - 3),
            lambda i: F.call_function("shiftleft", F.xxhash64(words[i], words[i + 1], words[i + 2]), bits).bitwiseOR(i.cast("long")),
        )
    )
    place = lambda k: (k.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)).cast("int")
    group = lambda k: F.call_function("shiftrightunsigned", k, bits)

    def same(a: Column, b: Column) -> Column:
        p, q = place(a), place(b)
        return (group(a) == group(b)) & (words[p] == words[q]) & (words[p + 1] == words[q + 1]) & (words[p + 2] == words[q + 2])

    found = lambda ks: F.filter(
        ks, lambda k, j: F.coalesce(same(k, F.get(ks, j - 1)), F.lit(False)) | F.coalesce(same(k, F.get(ks, j + 1)), F.lit(False))
    )
    spread = F.flatten(F.transform(found(F.col("_keys")), lambda k: F.array(place(k), place(k) + 1, place(k) + 2)))
    return keys, F.size(F.array_distinct(spread)).cast("long")


def metrics(docs: DataFrame, text_col: str = "text", stop_words: tuple[str, ...] | list[str] = tuple(STOP_WORDS)) -> DataFrame:
    """docs with the measured columns, beside all its own.

    A null text counts as the empty one, with zero for every metric; a very long
    one is measured whole. Rows are measured one by one, so null and repeated ids
    and repeated rows don't matter. Columns of docs that carry a metric's name are
    replaced, all others kept, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    own = [c for c in docs.columns if c not in METRICS]
    step = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),  # so that no name of docs meets one of these
        _words(text).alias("_words"),
        lines.alias("_lines"),
        (F.length(text) - F.regexp_count(text, F.lit(SEPARATOR))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    step = step.select(
        "_row", "_words", "word_chars", "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(list(stop_words)))).cast("long").alias("n_stop_words"),
    )
    keys, n_repeat = repeat_words(F.col("_words"), F.col("n_words"))
    # always true, and not deterministic: a caller's filter stays above this step instead of working out the keys for each word
    once = F.monotonically_increasing_id() >= 0
    step = step.withColumn("_keys", F.when(once & (F.col("n_words") >= 3), keys).otherwise(F.array().cast("array<bigint>")))
    measured = step.withColumn("n_repeat_words", n_repeat)
    return measured.select(*[F.col("_row").getField(c).alias(c) for c in own], *METRICS)


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def holds(table=THRESHOLDS) -> Column:
    """The table as one boolean expression over the metric columns."""
    return F.expr(" AND ".join(f"({a} {op} {b})" for a, op, b in table))


def judge(docs: DataFrame, text_col: str = "text", table=THRESHOLDS) -> DataFrame:
    """docs with the metrics, base_failed (length or repetition) and kept; columns
    of these names are replaced. Awkward rows are as in metrics()."""
    out = metrics(docs.drop("base_failed", "kept"), text_col)
    return out.withColumns({"base_failed": ~holds(BASE), "kept": holds(table)})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with docs' own columns, ids repeated or null alike."""
    own = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("text"))
    return judge(boxed).filter("kept").select("_row.*")


def op8(documents: DataFrame) -> DataFrame:
    return judge(documents.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


METRICS_SQL = rf"""
quality_rows AS (SELECT row_number() OVER () AS rid, * FROM {{docs}}),
quality_words AS (
  SELECT rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM quality_rows),
quality_windows AS (
  SELECT rid, unnest(generate_series(1, len(w) - 2)) AS p, w FROM quality_words WHERE len(w) >= 3),
quality_same AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, w[p], w[p + 1], w[p + 2]) AS c FROM quality_windows),
quality_repeat AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM quality_same WHERE c > 1) GROUP BY rid),
quality_metrics AS (
  SELECT r.*, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(k.n_symbols AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(coalesce(t.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({_sql_list(STOP_WORDS)}))) AS BIGINT) AS n_stop_words
  FROM quality_rows r JOIN quality_words k USING (rid) LEFT JOIN quality_repeat t USING (rid))"""


def _condition(table) -> str:
    return " AND ".join(f"({a} {op} {b})" for a, op, b in table)


SQL = f"""WITH {METRICS_SQL.format(docs="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       NOT ({_condition(BASE)}) AS base_failed, {_condition(THRESHOLDS)} AS kept
FROM quality_metrics"""
