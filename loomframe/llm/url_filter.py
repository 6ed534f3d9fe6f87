"""URL rules, and a list of URLs behind a blocked Bloom filter.

The filter is a table of 64-bit blocks.  A listed URL sets PROBES bits, all in the one block that
its hash names, so that a probe reads a single block.  URLs that pass it, the listed ones and a
few others, go on to an exact hash join with the list; all others never meet the list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import ascii_lower, settle, sized

PROBES = 5
#: Bits of the filter for each listed URL.
BITS = 16
#: Blocks (of 16 bytes as a row) that are broadcast at most; a longer list is probed by a shuffle.
BROADCAST_BLOCKS = 1 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, and path without ``.html`` and closing slashes."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html$", ""), r"/+$", "")
    return F.concat(host, path)


def rule_of(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest of ``rules`` (host and path, as ``net/``) that fits; else null.

    A rule fits its host and all subdomains if the path starts with the rule's.  Equally long rules
    that fit one URL are the same rule, as they share its host's end and its path's start or differ
    in how they split, where the longer host wins.
    """
    cases = []
    for rule in sorted(rules, key=lambda r: (-len(r), -len(r.partition("/")[0]), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        cases.append((fits, rule))
    return reduce(lambda otherwise, case: F.when(case[0], F.lit(case[1])).otherwise(otherwise), reversed(cases), F.lit(None).cast("string"))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> Column:
    second = F.xxhash64(url, F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", second, F.lit(6 * k)).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(PROBES)])


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, word): the filter over ``listed.url``, one row for each block that isn't empty."""
    return listed.groupBy(_block(F.col("url"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("url"))).alias("word"))


def listed_urls(rows: DataFrame, listed: DataFrame, url: str) -> DataFrame:
    """``rows`` with a column ``hit``: the value of column ``url`` if ``listed.url`` holds it, else null.

    The filter is asked where the rows are: only what passes it goes to the exact join, the rest keeps
    null without any exchange.  Nulls never match.  The filter is a broadcast table of BROADCAST_BLOCKS
    rows at most; above that it is joined as a shuffled table, with the same result.
    """
    known = settle(listed.select("url").filter("url is not null").distinct(), "listed")
    blocks = max(1, -(-known.count() * BITS // 64))
    words = bloom(known, blocks).withColumnRenamed("block", "__block")
    words = F.broadcast(words) if blocks <= BROADCAST_BLOCKS else words
    asked = rows.withColumns({"__block": _block(F.col(url), blocks), "__bits": _bits(F.col(url))}).join(words, "__block", "left")
    asked = asked.withColumn("__possible", F.coalesce(F.col("word").bitwiseAND(F.col("__bits")) == F.col("__bits"), F.lit(False)) & F.col(url).isNotNull())
    asked = asked.select(*rows.columns, "__possible")
    exact = sized(known.select(F.col("url").alias("hit")))
    joined = asked.filter("__possible").join(exact, F.col(url) == F.col("hit"), "left")
    rest = asked.filter("not __possible").withColumn("hit", F.lit(None).cast("string"))
    return joined.unionByName(rest).drop("__possible")


def judge_urls(pages: DataFrame, listed: DataFrame, allow: list[str], block: list[str], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, listed) for every row of ``pages``.

    The verdict is that of the longest rule that fits; without one, ``block`` if the canonical URL
    is among the canonical URLs of ``listed.url``, else ``allow``.  A null URL or one without
    ``://`` has an empty host and path, and is neither fitted by a rule nor listed.  Repeated rows
    are each judged; a null key stays null; other columns are ignored; empty tables are fine.
    """
    address = F.col("url")
    judged = pages.select(F.col(key).alias("id"), F.col(url).alias("url")).select(
        "id", host_of(address).alias("host"), path_of(address).alias("path"),
        F.when(host_of(address) != "", canonical(address)).alias("canonical"),
    )
    names = listed.select(F.when(host_of(address) != "", canonical(address)).alias("url"))
    judged = listed_urls(judged, names, "canonical").withColumn("rule", rule_of(F.col("host"), F.col("path"), [*allow, *block]))
    verdict = (
        F.when(F.col("rule").isin(allow), "allow").when(F.col("rule").isin(block), "block")
        .when(F.col("hit").isNotNull(), "block").otherwise("allow")
    )
    return judged.select(
        F.col("id").alias(key), "host", "path", "rule", verdict.alias("verdict"), F.col("hit").isNotNull().alias("listed")
    )
