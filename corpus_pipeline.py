"""The corpus pipeline: five stages over the documents, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return rows of
``documents`` with its columns; rows are dropped by each stage's decision and never changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import bpe, decontam, exact_dedup, minhash, toxicity
from loomframe.llm.common import settle, sized
from loomframe.llm.queries import CATEGORIES, WORD_BPE, table


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column, of a name that it doesn't have, which tells every row from all others.

    It is (no key, key, file, place in the file), so that rows without a key come last and the least
    number has the least key.  Rows are numbered by where they are stored, which no retry changes;
    a table that isn't read from files is stored first.
    """
    try:
        place = docs.select("*", F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
        place.schema  # noqa: B018  resolved here
        stored = docs
    except AnalysisException:
        stored = settle(docs, "docs")
    name = "__row"
    while name in stored.columns:
        name += "_"
    number = F.struct(
        F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"),
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"),
    )
    return stored.select("*", number.alias(name)), name


def _kept(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``judge`` (rows, name of their number) -> (number, kept) keeps."""
    rows, number = _numbered(docs)
    rejected = settle(judge(rows, number).filter("not kept").select(number), "rejected")
    return rows.join(sized(rejected), number, "left_anti").select(*docs.columns)


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: toxic documents go."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return _kept(docs, lambda rows, number: toxicity.scored(rows, chain, ["toxic"], key=number))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts the longest row stays, then the one with the least key, one without a key last."""
    return _kept(docs, lambda rows, number: exact_dedup.exact_duplicates(rows, key=number))


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each component the row with the least key stays, one without a key last.

    A similarity of 0.8 links, 0.85 is the contract of the op1 query alone; 14 hashes miss a pair in 800 at 0.8.
    """
    return _kept(docs, lambda rows, number: minhash.near_duplicates(rows, key=number, percent=80, hashes=14))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents with a passage of the benchmark go."""
    items = table(spark, sf_dir, "benchmark")
    return _kept(docs, lambda rows, number: decontam.contaminated(rows, items, key=number))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: what stays is encoded, with the digests of ids and decoded text."""
    return bpe.token_digests(docs, WORD_BPE)


STAGES = [
    ("toxicity", clean_language),
    ("exact_dedup", one_of_equal),
    ("near_dedup", one_of_near),
    ("decontamination", without_benchmark),
    ("bpe", tokens),
]

#: SQL can't express the trained stage; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
