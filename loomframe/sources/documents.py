"""One large JSON document of arrays, read by byte ranges in many tasks.

Spark's text source cuts the file at every closing brace, which it does for each range of bytes on
its own.  What a piece does to the reader's state doesn't depend on the pieces before it except
through two numbers: whether a string is open (the parity of the quotes before) and how deep the
brackets are (the sum of their steps).  Both are running sums, so pieces are judged where they
are: sums inside a range, then sums of whole ranges, of which there are few.  A piece that closes an
object of depth three ends a record; pieces between two such ends are one record.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.session import fits, materialise

#: Depth of an object that is an element of an array of the document: document, array, object.
DEPTH = 3
FEW = 100_000


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, text): the text before each closing brace, in order of (block, n) of a file."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"),
    )


def _summed(rows: DataFrame, value: str, into: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over a file up to each row: inside a range, plus earlier ranges."""
    inside = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__inside", F.sum(value).over(inside))
    ranges = rows.groupBy("file", "block").agg(F.sum(value).alias("__whole"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shifts = ranges.select("file", "block", F.coalesce(F.sum("__whole").over(earlier), F.lit(0)).alias("__shift"))
    return rows.join(shifts, ["file", "block"]).withColumn(into, F.col("__inside") + F.col("__shift")).drop("__inside", "__shift")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, position, body): the objects in the arrays of JSON documents, as text.

    ``section`` is the key of the array in its document, ``position`` the object's place in it from zero.
    Documents are objects whose arrays hold objects; other values are passed over.  Strings may hold any
    quotes, braces and escapes.  A record's pieces meet in one task, and so does what stands between the
    arrays, so that a record has to fit in a row; the document doesn't.
    """
    plain = F.regexp_replace("text", r"(?s)\\.", "")  # no escape goes on beyond a brace
    pieces = _pieces(spark, path).withColumn("quotes", _count(plain, '"'))
    pieces = _summed(pieces, "quotes", "so_far")
    opened = (F.col("so_far") - F.col("quotes")) % 2 == 1
    bare = F.regexp_replace(F.concat(F.when(opened, '"').otherwise(""), plain), r'(?s)"[^"]*("|$)', "")
    outside = (F.col("so_far") % 2 == 0).cast("int")
    step = _count(bare, "{") + _count(bare, "[") - _count(bare, "]") - outside
    pieces = pieces.select("file", "block", "n", "text", outside.alias("outside"), step.alias("step"))
    pieces = _summed(pieces, "step", "depth")
    ends = (F.col("outside") == 1) & (F.col("depth") == DEPTH - 1)
    pieces = pieces.select("file", "block", "n", "text", ends.cast("int").alias("ends"))
    pieces = _summed(pieces, "ends", "number")
    grouped = (
        pieces.groupBy("file", (F.col("number") - F.col("ends")).alias("number"))
        .agg(F.sort_array(F.collect_list(F.struct("block", "n", "text"))).alias("parts"), F.max("ends").alias("ends"))
        .filter("ends = 1")
        .select("file", "number", F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), "}"), F.lit("}")).alias("text"))
    )
    found = materialise(grouped, "records")
    # only the first record of an array, and of a document, has more than a comma before it
    following = (F.col("number") > 0) & F.col("text").rlike(r"^[\s,]*\{")
    first = found.filter(~following)
    kind = "file string, number long, section string, body string"
    named = materialise(first.mapInPandas(_first_records, kind), "sections")
    if not fits(named, FEW):
        raise ValueError("the documents have too many arrays")
    starts = named.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("number", "section"))).alias("starts"))
    rest = found.filter(following).select("file", "number", F.regexp_replace("text", r"^[\s,]+", "").alias("body"))
    # FEW rows at most
    every = rest.unionByName(named.select("file", "number", "body")).join(F.broadcast(starts), "file")
    start = F.try_element_at(F.filter("starts", lambda s: s["number"] <= F.col("number")), F.lit(-1))
    return every.withColumn("start", start).select(
        "file", F.col("start.section").alias("section"), (F.col("number") - F.col("start.number")).alias("position"), "body"
    ).filter("section is not null")


def _first_records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The section and the text of the last object at DEPTH; no section if it isn't in an array."""
    for part in parts:
        rows = [(f, n, *_last_object(t, 0 if n == 0 else DEPTH - 1)) for f, n, t in zip(part["file"], part["number"], part["text"])]
        yield pd.DataFrame(rows, columns=["file", "number", "section", "body"])


def _last_object(text: str, depth: int) -> tuple[str | None, str]:
    key, inside, last, at, holders = None, None, "", 0, ["["] * depth
    begin, section = 0, None
    while at < len(text):
        sign = text[at]
        if sign == '"':
            stop = at + 1
            while text[stop] != '"':
                stop += 2 if text[stop] == "\\" else 1
            last, at = text[at + 1 : stop], stop
        elif sign == ":" and len(holders) == 1:
            key = last
        elif sign in "{[":
            if sign == "{" and len(holders) == DEPTH - 1:
                begin, section = at, key if holders[-1] == "[" else None
            holders.append(sign)
        elif sign in "}]":
            holders.pop()
        at += 1
    return section, text[begin:]


def sections(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """The arrays of a document as tables of (position, columns), all from one reading.

    ``schemas`` gives the columns of each array; an object that doesn't parse raises.
    """
    found = materialise(records(spark, path).filter(F.col("section").isin(list(schemas))), "objects")
    return {
        name: found.filter(F.col("section") == name)
        .select("position", F.from_json("body", schema, {"mode": "FAILFAST"}).alias("o")).select("position", "o.*")
        for name, schema in schemas.items()
    }
