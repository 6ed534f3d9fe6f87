"""Exact duplicates of texts, with frequent texts settled apart from the shuffle.

Misra-Gries counting (``DataFrame.freqItems``) names every digest that may hold more than a share
``support`` of all rows, and 1 / support digests at most.  Exact counts then verify them.  Their
winners are broadcast and the rows of these groups are judged where they are; all other digests
are shuffled as usual, in groups that are known to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import settle

# Fixed value: white space of the contract.
WHITE = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without white space, in UTF-8; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "").cast("binary"), 256)


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text_sha256, length): the narrow table that grouping needs, read from ``docs`` once."""
    full = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("id"), text_digest(F.col(text)).alias("text_sha256"), F.char_length(full).alias("length"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = 0.001) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal if they are identical without ``[\\x20\\x09-\\x0D]``.  Of equal texts the row with
    the most code points stays, then the one with the smallest key; a null key comes last.  Rows that
    repeat key and text keep one: each of these rows has the same keep_id, and of a group's equal
    best rows one is kept.  Null texts count as empty and form one group with texts of white space.
    Other columns are ignored; an empty table gives an empty result.

    The broadcast tables have at most 1 / ``support`` rows of some 100 bytes, whatever the input.
    """
    rows = settle(digests(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "digests")
    frequent = rows.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    order = F.struct((-F.col("length")).alias("a"), F.col("id").isNull().alias("b"), F.col("id"), F.col("row"))
    winners = (
        rows.join(F.broadcast(frequent), "text_sha256")
        .groupBy("text_sha256").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
        .select("text_sha256", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    )
    # 1 / support rows at most: verified counts of the digests that counting named
    winners = F.broadcast(settle(winners, "winners"))
    heavy = rows.join(winners, "text_sha256")
    group = Window.partitionBy("text_sha256")
    light = rows.join(winners, "text_sha256", "left_anti")
    first = group.orderBy(F.desc("length"), F.col("id").asc_nulls_last(), "row")
    light = light.select(
        "*", F.first("id").over(first).alias("keep_id"), F.first("row").over(first).alias("keep_row"),
        F.count("*").over(group).alias("group_size"),
    )
    columns = [
        F.col("id").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256",
    ]
    return heavy.select(*columns).union(light.select(*columns))
