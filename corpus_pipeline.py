"""From raw documents to a weighted training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents. Columns of other names,
whatever they are, pass through all stages but the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, jaccard, mixing, quality_rules, suffixes
from tideline.session import cut, load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text has no words and goes. Each row is judged by its own whole
    text: ids may be null or repeat, and repeated rows stay or go together.
    """
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Texts without words and rows without an id stay. Rows that share an id are one
    document, of which the row with the least text stays.
    """
    return jaccard.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut out of the text.

    No row goes, not even one of which nothing is left. Null and empty texts and
    rows without an id stay as they are; rows that share an id are one document.
    n_chars is that of the text that is left.
    """
    return suffixes.remove_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their id.

    Null and empty texts and rows without an id stay; null and very short items
    are in no document.
    """
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with their texts, in the order in which they are read, source by source.

    A row for each time that a document is read: its id, source, epoch, block and
    ranks, and the text with its language and length. Texts without words aren't
    read; a null source is one of its own; repeated rows are read as often as they
    stand there.
    """
    return mixing.mix(docs, carry=("text", "lang", "n_chars"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", passages),
    ("benchmark decontamination", benchmark_leaks),
    ("source mixing", mixture),
]

#: Neither suffix matching nor string tiling can be put in SQL; tests/llm holds
#: the whole run against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
