"""Hand-worked text cases."""

import html
import html.entities
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.functions import paths, text
from loomframe.operators import filters, tokenizer


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(*columns).first()


def test_tags(spark):
    a, b = text.split_tags("v")
    row = one(spark, "风景,tree,花flower,cat猫,123", a.alias("a"), b.alias("b"))
    assert row["a"] == ["风景", "花", "猫"] and row["b"] == ["tree", "flower", "cat"]
    row = one(spark, "", a.alias("a"), b.alias("b"))
    assert row["a"] == [] and row["b"] == []
    assert one(spark, None, a.alias("a"))["a"] == []


@pytest.mark.parametrize(
    "value,legacy,want",
    [
        ("1.红色花朵 red flower", False, ("红色花朵", "red flower")),
        ("a红b", False, ("红", "b")),
        ("cat", True, ("", "at")),
        ("cat", False, ("", "cat")),
        ("a", True, ("", "")),
        ("", False, ("", "")),
        ("x红 - 12 yz!", False, ("红", "- 12 yz")),
    ],
)
def test_remark(spark, value, legacy, want):
    a, b = text.split_remark("v", legacy=legacy)
    assert tuple(one(spark, value, a, b)) == want


@pytest.mark.parametrize(
    "tags,kept",
    [
        (["背景", "人物"], False), (["背景", "没有人"], True), (["背景", " 没有人"], False),
        (["背景", "风景"], False), (["背景", " 风景"], True), ([" 背景 "], True), ([], False),
        (["猫"], False), (None, False),
    ],
)
def test_topic(spark, tags, kept):
    rule = filters.on_topic("v", ["背景", "插图", "图案", "设计"], "人", "没有人", ["风景", "自然"])
    assert one(spark, tags, rule.alias("k"), kind="array<string>")["k"] is kept


def test_range_list(spark):
    assert one(spark, "5-8, 2", text.range_list("v").alias("r"))["r"] == [2, 5, 6, 7]
    assert one(spark, "3,3", text.range_list("v").alias("r"))["r"] == [3, 3]
    assert one(spark, "4-4,1", text.range_list("v").alias("r"))["r"] == [1]
    with pytest.raises(Exception, match="bad range list"):
        one(spark, "5-8,", text.range_list("v"))


def test_wrap_has_no_trailing_break(spark):
    assert one(spark, "abcdef", text.wrap("v", 3).alias("w"))["w"] == "abc\ndef"
    assert one(spark, "abcdefg", text.wrap("v", 3).alias("w"))["w"] == "abc\ndef\ng"


def test_frame_tokens(spark):
    ids = lambda n: list(range(1, n + 1))
    short = one(spark, ids(2), text.frame_tokens("v", 8, 9, 6).alias("f"), kind="array<int>")
    assert short["f"] == [8, 1, 2, 9, 0, 0]
    cut = one(spark, ids(9), text.frame_tokens("v", 8, 9, 4, truncate=True).alias("f"), kind="array<int>")
    assert cut["f"] == [8, 1, 2, 9]
    with pytest.raises(Exception, match="longer than"):
        one(spark, ids(9), text.frame_tokens("v", 8, 9, 4).alias("f"), kind="array<int>")


def test_clean(spark):
    value = " A &amp;lt;b&amp;gt; \n\t C&nbsp;d "
    want = re.sub(r"\s+", " ", html.unescape(html.unescape(value))).strip().lower()
    assert one(spark, value, text.clean("v").alias("c"))["c"] == want


def test_entities_are_read_as_html_reads_them(spark):
    values = [f"{before}&{n}{after}" for n in html.entities.html5 for before, after in (("", ""), ("a", "q; b"))]
    numbers = [*range(0x102), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFDEF, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**7, 10**30]
    values += [f"&#{z}{n}{end}&#X{z}{n:x}{end}" for n in numbers for z in ("", "00") for end in (";", "z")]
    values += ["", "&", "&&", "&;", "&#;", "&#x;", "&#xg", "&notit;", "& amp;", "&amp;amp;#38;lt;", "&" + "z" * 40 + ";", "é&日;😀&eacute😀"]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v string").repartition(8)
    got = rows.select("v", text.unescape("v").alias("u")).collect()
    assert len(got) == len(values) + 1
    assert [(r["v"], r["u"]) for r in got if r["u"] != (None if r["v"] is None else html.unescape(r["v"]))] == []


def test_cleaning_needs_no_python(spark):
    """Before, whole batches of texts were Python strings, three times over."""
    plan = spark.createDataFrame([("a",)], "v string").select(text.clean("v"))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_paths(spark):
    row = one(
        spark, "a/b/0123.x.png", paths.stem("v").alias("s"), paths.content_number("v").alias("n"),
        paths.swap_suffix("v", ".png", "_seg.jpg").alias("p"),
    )
    assert tuple(row) == ("0123", 123, "a/b/0123.x_seg.jpg")
    assert one(spark, "7", paths.padded_image_name("v").alias("p"))["p"] == "0" * 15 + "7.jpg"
    long = "9" * 20
    assert one(spark, long, paths.padded_image_name("v").alias("p"))["p"] == long + ".jpg"
    with pytest.raises(Exception, match="not a number"):
        one(spark, "a/b.png", paths.content_number("v"))


def test_pair_encoding_round_trip(spark):
    merges = [("l", "o"), ("lo", "w</w>"), ("e", "r</w>"), ("lo", "w"), ("low", "er</w>")]
    table = spark.createDataFrame([("low lower",), ("Größe 12!",), ("",)], "v string")
    coded = table.select(
        "v", tokenizer.encode("v", merges).alias("ids")
    ).withColumn("back", tokenizer.decode_ids("ids", merges)).collect()
    names = {n: s for s, n in tokenizer.vocabulary(merges).items()}
    by_text = {r["v"]: r for r in coded}
    assert [names[i] for i in by_text["low lower"]["ids"]] == ["low</w>", "lower</w>"]
    assert by_text["Größe 12!"]["back"] == "größe 1 2 ! "
    assert by_text[""]["ids"] == []
    assert len(tokenizer.byte_symbols()) == len(set(tokenizer.byte_symbols().values())) == 256


def test_special_words_are_whole(spark):
    words = one(spark, "it's <|endoftext|> ok42", text.words("v").alias("w"))["w"]
    assert words == ["it", "'s", "<|endoftext|>", "ok", "4", "2"]
    assert F is not None


def test_merges_come_from_a_table(spark):
    fields = "rank int, first string, second string"
    table = spark.createDataFrame([(2, "lo", "w</w>"), (1, "l", "o")], fields)
    assert tokenizer.merges_of(table) == [("l", "o"), ("lo", "w</w>")]
    with pytest.raises(ValueError, match="earlier merge"):
        tokenizer.merges_of(spark.createDataFrame([(1, "lo", "w"), (2, "l", "o")], fields))
    broken = spark.createDataFrame([([0x41 - 0x21, 195],)], "ids array<int>")  # a letter and a byte that is no text alone
    sign = [n for n, s in enumerate(tokenizer.byte_symbols().values()) if s == "\u00c3"][0]
    text_ = broken.select(tokenizer.decode_ids(F.array(F.lit(0x41 - 0x21), F.lit(sign)), []).alias("t")).first()["t"]
    assert text_ == "A\ufffd"


def test_lists_of_words_are_encoded_in_slices():
    merges = [("l", "o"), ("lo", "w</w>")]
    names = {s: n for n, s in enumerate(tokenizer.vocabulary(merges))}
    low, lo, er = [names["low</w>"]], [names["lo"], names["e"], names["r</w>"]], [names["e"], names["r</w>"]]
    rows = [["low", "loer"], None, [], ["low"] * (tokenizer.SLICE_WORDS + 1), ["er", "low", "er"], [], ["loer"]]
    want = [low + lo, None, [], low * (tokenizer.SLICE_WORDS + 1), er + low + er, [], lo]
    part = pa.array([["cut"], *rows], pa.list_(pa.string())).slice(1)
    for remembered in (1, 100):
        parts = list(tokenizer.encoded_lists(iter([part, part.slice(4)]), merges, remembered))
        assert [x for p in parts for x in p.to_pylist()] == want + want[4:]
        assert max(len(p) for p in parts[:3]) < len(rows)  # no slice is the whole batch


def test_encoding_a_large_batch_makes_few_objects():
    """A batch of a million words: before, each was a Python string at the same time (over 50 MB)."""
    part = pa.array([[f"w{(i * 7 + k) % 5000}" for k in range(100)] for i in range(10_000)], pa.list_(pa.string()))
    tracemalloc.start()
    try:
        n = sum(len(p) for p in tokenizer.encoded_lists(iter([part]), [("w", "1")], 500_000))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 10_000 and peak < 16 << 20


def test_encoding_keeps_null_and_empty_rows(spark):
    rows = spark.createDataFrame([(1, ["lo", "w"]), (2, None), (3, [])], "k int, w array<string>")
    got = {r["k"]: r["ids"] for r in rows.select("k", tokenizer.encode_words("w", [("l", "o</w>")]).alias("ids")).collect()}
    names = tokenizer.vocabulary([("l", "o</w>")])
    assert got == {1: [names["lo</w>"], names["w</w>"]], 2: None, 3: []}
