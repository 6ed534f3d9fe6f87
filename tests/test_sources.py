"""Readers, sinks and incremental jobs on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import rasters
from loomframe.operators import filters, images, labels
from loomframe.plans import registry
from loomframe.sources import readers, sinks
from loomframe.streaming import jobs


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_shards_and_manifest(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "d"))
    listed = readers.manifest(spark, str(tmp_path / "d"))
    assert listed.count() == 4 and "content" not in listed.columns
    rows = readers.shards(spark, str(tmp_path / "d"))
    assert rows.select("shard").distinct().count() == 4
    done = rows.filter("id < 0").select(F.col("shard").alias("path")).distinct()
    assert sinks.unprocessed(listed, done).count() == 4


def test_annotation_csv(spark, tmp_path):
    head = "ImageID,Source,LabelName,Confidence,XMin,XMax,YMin,YMax,IsOccluded,IsTruncated,IsGroupOf,IsDepiction,IsInside\n"
    path = write(tmp_path / "a.csv", head + "i1,x,/m/1,1,0.25,0.75,0.5,1.0,1,0,0,0,1\n")
    row = readers.box_annotations(spark, path).first()
    assert (row["x"], row["y"], row["w"], row["h"], row["area"]) == (0.25, 0.5, 0.5, 0.5, 0.25)
    assert row["is_occluded"] is True and row["is_group_of"] is False
    broken = write(tmp_path / "b.csv", head + "i1,x,/m/1,one,0,1,0,1,0,0,0,0,0\n")
    with pytest.raises(Exception):
        readers.box_annotations(spark, broken).collect()
    assert readers.class_names(spark, write(tmp_path / "c.csv", "/m/1,Cat\n")).first()["name"] == "Cat"
    ids = readers.image_ids(spark, write(tmp_path / "i.csv", "image_name\nab.jpg\n"))
    assert ids.first()["image_id"] == "ab"


def test_json_documents(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 4, "height": 2, "coco_url": "u"}],
        "categories": [{"id": 7, "supercategory": "s", "name": "cat"}],
        "annotations": [{"id": 5, "image_id": 1, "category_id": 7, "bbox": [0, 1, 2, 1], "iscrowd": 1}],
    }
    found = readers.instances(spark, write(tmp_path / "i.json", json.dumps(doc)))
    assert [d.count() for d in found] == [1, 1, 1]
    assert found[0].first()["license"] is None
    row = found[2].first()
    assert (row["x"], row["w"], row["is_group_of"]) == (0.0, 2.0, True)
    caps = {"images": [{"id": 1, "file_name": "a"}], "annotations": [{"image_id": 1, "caption": c} for c in "xy"]}
    _, texts = readers.captions(spark, write(tmp_path / "c.json", json.dumps(caps)))
    assert [r["caption"] for r in texts.orderBy("caption_id").collect()] == ["x", "y"]


def awkward(rng, n):
    signs = ['"', "\\", "{", "}", "[", "]", ":", ",", " ", "é", "\n", "images", 'x": [{', "😀"]
    return "".join(rng.choice(signs) for _ in range(rng.randrange(n)))


@pytest.mark.parametrize("indent", [None, 1])
def test_documents_are_read_by_byte_ranges(spark, tmp_path, indent):
    import random

    from loomframe.sources import documents

    rng = random.Random(3)
    make = lambda k: {"id": k, "t": awkward(rng, 30), "deep": [{"a": {"b": [awkward(rng, 5)]}}] * (k % 3), "box": [1.5, 2], "o": {"t": awkward(rng, 9)}}
    doc = {
        "info": {"year": 1, "more": {"of": {"images": [{"no": 1}]}}, "v": awkward(rng, 9)}, "version": awkward(rng, 9), "empty": [],
        "images": [make(k) for k in range(300)], "tags": ["a", "}", "{"], "licenses": [{"id": 7}], "nested": [[{"id": 1}], []],
        "annotations": [make(k) for k in range(500)], "after": {"id": 3},
    }
    path = write(tmp_path / "d.json", json.dumps(doc, indent=indent, ensure_ascii=indent is None))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = documents.records(spark, path)
        assert documents._pieces(spark, path).select("block").distinct().count() > 20
        got = {(r.section, r.position): json.loads(r.body) for r in rows.collect()}
        want = {(s, k): x for s in ("images", "licenses", "annotations") for k, x in enumerate(doc[s])}
        assert got == want
        field = "id long, t string"
        table = documents.sections(spark, path, {"annotations": field})["annotations"]
        whole = spark.read.json(path, schema=f"annotations array<struct<id:long,t:string>>", multiLine=True).selectExpr("posexplode(annotations) as (position, a)").select("position", "a.*")
        assert table.exceptAll(whole).isEmpty() and whole.exceptAll(table).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for text in ("{}", '{"a": []}', '{"images": [{}, {}]}'):
        count = documents.records(spark, write(tmp_path / "e" / f"{len(text)}.json", text)).count()
        assert count == (2 if "images" in text else 0)


def test_key_value_files(spark, tmp_path):
    assert readers.index_to_class(spark, write(tmp_path / "a", "0: n01\n1: n02\n")).collect()[1]["name"] == "n02"
    table = readers.index_to_label(spark, write(tmp_path / "b", "{0: 'cat, tom',\n 1: 'dog'}\n"))
    assert [r["label"] for r in table.orderBy("idx").collect()] == ["cat, tom", "dog"]
    row = readers.first_word_map(spark, write(tmp_path / "c", "n01 tench, fish\n"), "id", "label").first()
    assert tuple(row) == ("n01", "tench, fish")
    row = readers.path_list(spark, write(tmp_path / "d", "x/1.png\n\n"), "/root/").first()
    assert tuple(row) == ("x/1.png", "/root/x/1.png")


def test_image_tree_and_arrays(spark, tmp_path):
    for name in ("id_2/0007.png", "id_10/0003.PNG", "id_2/readme.txt"):
        write(tmp_path / "t" / name, "x")
    tree = readers.image_tree(spark, str(tmp_path / "t"))
    assert {r["folder"] for r in tree.collect()} == {"id_2", "id_10"}
    styles = labels.class_index(tree, "folder", rank=labels.numeric_suffix("folder"))
    assert {r["folder"]: r["class_no"] for r in styles.collect()} == {"id_2": 0, "id_10": 1}
    readers.write_file_list(tree, str(tmp_path / "list"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "list")).collect()] == ["id_10/0003.PNG", "id_2/0007.png"]


def png_of(pixels):
    """8-bit gray PNG of rows of values."""
    import struct
    import zlib

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)
    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_encode_then_decode(spark):
    coded = spark.createDataFrame([(0, png_of([[0, 1, 2], [3, 4, 5]]))], "id long, imbytes binary")
    w, h = images.header_size("imbytes")
    assert tuple(coded.select(w, h).first()) == (3, 2)

    def decode(raw):
        import struct
        import zlib

        width, height = struct.unpack(">II", raw[16:24])
        at = raw.index(b"IDAT")
        size = struct.unpack(">I", raw[at - 4 : at])[0]
        body = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + size]), dtype=np.uint8)
        return body.reshape(height, width + 1)[:, 1:]

    back = readers.decoded(coded, "id", "imbytes", decode).first()
    assert back["data"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_sink_keeps_the_tail_and_gates_yield(spark, tmp_path):
    out = str(tmp_path / "o")
    sinks.append(spark.range(25).coalesce(1), out, rows_per_file=10)
    sinks.append(spark.range(25, 30).coalesce(1), out, rows_per_file=10)
    assert spark.read.parquet(out).count() == 30
    assert readers.manifest(spark, out).count() == 4
    rows = spark.createDataFrame([(n, "a" if n < 9 else "b") for n in range(12)], "id bigint, s string")
    assert sinks.shards_with_yield(rows, "s", 5).count() == 9


def test_lookup_and_tiling_errors(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k bigint")
    names = spark.createDataFrame([(1, "one")], "k bigint, name string")
    with pytest.raises(Exception, match="no label for 2"):
        labels.lookup_or_fail(rows, names, "k", "name", "label").collect()
    with pytest.raises(ValueError):
        labels.tiled(rows, "k", 5)
    with pytest.raises(ValueError, match="missing columns"):
        filters.require_columns(rows, ["k", "z"])


def test_oversized_groups_are_dropped_whole(spark):
    rows = spark.createDataFrame([("hot", n) for n in range(500)] + [("ok", n) for n in range(3)], "g string, n int")
    kept = filters.groups_with_count(rows, "g", ["n"], 2, 6)
    assert kept.groupBy("g").count().collect()[0].asDict() == {"g": "ok", "count": 3}


@pytest.fixture()
def shard_folder(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.range(60).select(
        F.col("id").alias("step"), F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("name"),
        (F.col("id") * 0.5).alias("value"),
    )
    for n in range(3):
        rows.filter((F.col("step") >= 20 * n) & (F.col("step") < 20 * n + 20)).coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


def test_append_resumes_where_it_stopped(spark, tmp_path, shard_folder):
    folder, rows = shard_folder
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    jobs.filter_append(spark, folder, F.col("value") > 5, out, mark, files_per_batch=1)
    jobs.filter_append(spark, folder, F.col("value") > 5, out, mark, files_per_batch=1)
    assert spark.read.parquet(out).count() == rows.filter("value > 5").count()
    rows.limit(20).withColumn("value", F.lit(99.0)).coalesce(1).write.mode("append").parquet(folder)
    jobs.filter_append(spark, folder, F.col("value") > 5, out, mark)
    assert spark.read.parquet(out).count() == rows.filter("value > 5").count() + 20


def test_streamed_average_equals_batch(spark, tmp_path, shard_folder):
    from loomframe.operators.ordering import moving_average

    folder, rows = shard_folder
    stream = jobs.incoming(spark, folder, files_per_batch=1)
    got = jobs.moving_averages(stream, "name", "step", "value", 0.9, str(tmp_path / "s"), str(tmp_path / "c"))
    want = {r["name"]: r["average"] for r in moving_average(rows, "name", "step", "value", 0.9).collect()}
    assert {r["name"]: r["average"] for r in got.collect()} == pytest.approx(want)
    assert {r["n"] for r in got.collect()} == {30}


def test_streamed_histories_and_restart(spark, tmp_path, shard_folder):
    from loomframe.operators.ordering import trailing

    folder, rows = shard_folder
    where = [str(tmp_path / n) for n in ("state", "mark", "out")]

    def run():
        stream = jobs.incoming(spark, folder, files_per_batch=1)
        return jobs.trailing_histories(stream, "name", "step", "value", 5, *where, block=4)

    known = lambda df: {(r["step"], r["name"]): r["history"] for r in df.collect()}
    assert known(run()) == known(trailing(rows, "name", "step", "value", 5))
    more = spark.range(60, 75).select(F.col("id").alias("step"), F.lit("p1").alias("name"), F.lit(1.0).alias("value"))
    more.coalesce(1).write.mode("append").parquet(folder)
    assert known(run()) == known(trailing(rows.union(more), "name", "step", "value", 5))  # from the checkpoint on
    state = [p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("version=")]
    assert sorted(state) == ["version=2", "version=3"] and len(list((tmp_path / "out").glob("batch=*"))) == 4


def test_streamed_means_and_their_meter(spark, tmp_path, shard_folder):
    folder, rows = shard_folder
    meter = jobs.Meter("passed")
    spark.streams.addListener(meter)
    try:
        stream = meter.watched(jobs.incoming(spark, folder, files_per_batch=1).filter("step >= 10"))
        got = jobs.running_means(stream, "name", "value", str(tmp_path / "m"), str(tmp_path / "c"))
        want = {r["name"]: (r["mean"], r["n"]) for r in rows.filter("step >= 10").groupBy("name").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).collect()}
        assert {r["name"]: (r["mean"], r["n"]) for r in got.collect()} == want
        table = meter.write(spark, str(tmp_path / "meter"))
        assert sorted((r["batch"], r["rows"]) for r in table.collect()) == [(0, 10), (1, 20), (2, 20)]
        assert table.filter("rows_per_second <= 0 or seconds <= 0").isEmpty()
    finally:
        spark.streams.removeListener(meter)


def test_streamed_codebook_equals_batch_by_batch(spark, tmp_path):
    from loomframe.operators import matching, vectors

    rows = spark.range(60).select("id", F.array(F.col("id") % 7 * 1.0, F.col("id") % 5 * 1.0).alias("z"))
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [4.0, 4.0])], "code long, e array<double>")
    folder = jobs.dealt(rows, "id", str(tmp_path / "in"))
    stream = jobs.incoming(spark, folder, files_per_batch=1)
    got = jobs.online_codebook(stream, book, 2, 0.9, 1e-5, str(tmp_path / "s"), str(tmp_path / "c"))
    state = vectors.fresh_state(book)
    for n in range(3):
        batch = rows.filter(f"id >= {20 * n} and id < {20 * n + 20}")
        assigned = matching.nearest_code(batch, state.select("code", "e"), "id", "z", keep_vector=True)
        state = vectors.codebook_update(state, assigned, 0.9, 1e-5, 2, "z")
        state = spark.createDataFrame(state.collect(), state.schema)
    plain = lambda df: {r["code"]: [r["cluster_size"], *r["e"]] for r in df.collect()}
    a, b = plain(got), plain(state)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_named_plans(spark):
    @registry.builder("numbers")
    def numbers(spark, n=3, scale=1.0):
        return spark.range(n).select((F.col("id") * scale).alias("v"))

    config = {"target": "numbers", "params": {"n": 4, "scale": 2.0}}
    assert registry.build(config, spark).count() == 4
    assert registry.build(config, spark, ["n=2"]).count() == 2
    with pytest.raises(KeyError, match="unknown plan"):
        registry.build({"target": "nothing"}, spark)
    nested = {"a": {"b": [{"c": 5}]}}
    assert registry.lookup(nested, "a/b/0/c") == 5
    assert registry.lookup(nested, "a/x", default=None) is None
    step = registry.chain(lambda d: d.filter("id > 2"), lambda d: d.filter("id < 7"))
    assert step(spark.range(10)).count() == 4
    doubled = registry.map_batches(spark.range(10), lambda p: p * 2, "id bigint", rows=3)
    assert doubled.agg(F.sum("id")).first()[0] == 90


def test_image_jobs(spark):
    ramp = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda k: (k % 20).cast("double"))
    df = images.as_images(spark.range(2), "id", ramp, 20, 20)
    same = images.ssim(df.withColumn("ref", F.col("data")), "id").first()
    assert same["ssim"] == pytest.approx(1.0)
    up = images.resize(images.resize(df, "id", 40, 40), "id", 20, 20).first()["data"]
    assert np.abs(np.array(up) - np.arange(400) % 20).max() < 0.6
    m = F.array(*[F.lit(v) for v in (1.0, 0.0, 3.0, 0.0, 1.0, 0.0)])
    moved = images.warp(df.withColumn("m", m), "id", "m", 20, 20).first()["data"]
    assert moved[5] == pytest.approx(2.0) and moved[0] == 0.0
    tiled = images.tiles(df, "id", 8, 2, 19).groupBy("id").count().collect()
    assert {r["count"] for r in tiled} == {9}
    origins = spark.range(1).select(images.tile_origins(F.lit(1000), 800, 96).alias("o")).first()["o"]
    assert origins == [0, 200]
    box = df.withColumn("b", F.array(*[F.lit(v) for v in (0.0, 0.0, 6.0, 4.0)]))
    assert images.square_crop_around(box, "id", "b").first()["h"] == 6
    seg = df.withColumn("label", F.transform("data", lambda v: v % 2))
    hot = images.segmentation_pairs(seg, "id", "label", 10).select(rasters.runs_one_hot(F.col("runs"), 3).alias("hot")).first()["hot"]
    assert len(hot) == 300 and sum(hot) == 100
    for mode in range(8):
        assert sorted(images.augment_order(mode, 3, 3)) == list(range(9))
    low = images.low_high_pairs(df, "id", 10, 20).first()
    assert low["low"]["h"] == low["high"]["h"] == 20
    with pytest.raises(ValueError):
        images.low_high_pairs(df, "id", 20, 20)


def test_yield_counters(spark, tmp_path):
    from loomframe.operators import metrics

    rows = spark.createDataFrame([("a", n) for n in range(6)] + [("b", 9)], "s string, n int")
    counted, counter = metrics.observed(rows, "yield", F.col("n") > 3)
    counted.filter("n > 3").write.parquet(str(tmp_path / "o"))
    assert counter.get == {"before": 7, "after": 3}
    audit = metrics.audit(rows, rows.filter("n > 3 and s = 'a'"), "s")
    assert {r["s"]: (r["before"], r["after"]) for r in audit.collect()} == {"a": (6, 2), "b": (1, 0)}


def test_shared_folder_setting():
    from loomframe.session import shared_folder

    class Session:
        settings = {"spark.sql.warehouse.dir": "hdfs:/warehouse/"}

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: Session.settings.get(key, default))

    assert shared_folder(Session()) == "hdfs:/warehouse/_shared"
    Session.settings["spark.checkpoint.dir"] = "hdfs:/shared"
    assert shared_folder(Session()) == "hdfs:/shared"


def test_random_crops(spark):
    df = images.as_images(spark.range(6), "id", F.transform(F.sequence(F.lit(1), F.lit(256)), lambda k: k / 256.0), 16, 16)
    crops = images.random_crop(df, "id", 5, 3)
    assert {(r["h"], r["w"]) for r in crops.collect()} == {(5, 5)}
    for top, left, side in ((0, 14, 4), (-1, 0, 4), (0, 0, 17)):
        with pytest.raises(Exception, match="crop outside the image of row"):
            images.crop(df, "id", top, left, side, side).collect()
    assert images.resize_short_side(df, "id", 8).first()["h"] == 8
    assert images.cropped_to_multiple(df, "id", 5).first()["h"] == 15
    assert images.halved(df, "id", 2).first()["w"] == 4


def test_lowpass_swap_keeps_image_when_reference_is_itself(spark):
    df = images.as_images(spark.range(2), "id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: k * 1.0), 8, 8)
    same = images.lowpass_swap(df, df, "id", 2).first()["data"]
    assert same == pytest.approx([float(k) for k in range(1, 65)])


def test_sizes_from_headers(spark):
    jpeg = (
        b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xc4\x00\x03z"
        + b"\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x00\x00\x00"
    )
    png = png_of([[0] * 5] * 3)
    rows = spark.createDataFrame([(0, png), (1, jpeg), (2, b"GIF"), (3, None)], "id int, raw binary")
    got = rows.select("id", images.file_size_of("raw").alias("s")).select("id", "s.*").collect()
    assert [(r["w"], r["h"]) for r in sorted(got)] == [(5, 3), (32, 16), (None, None), (None, None)]
    large = rows.select("id", images.file_size_of("raw").alias("s")).filter(
        filters.large_enough(F.col("s.w"), F.col("s.h"), 16, "all_ge")
    )
    assert [r["id"] for r in large.collect()] == [1]


def test_plug_in_columns(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "")], "id int, text string")

    def plug_in(batch):
        return {"ids": [[ord(c) for c in t] for t in batch["text"]], "valid": (batch["text"] != "").astype(int)}

    got = registry.with_bundle(rows, plug_in, ["text"], "ids array<int>, valid int").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "ab", [97, 98], 1), (2, "", [], 0)]


def test_crop_takes_the_right_pixels(spark):
    n = 5 * 7 * 2
    df = images.as_images(spark.range(2), "id", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: k * 1.0), 5, 7, 2)
    want = np.arange(1, n + 1.0).reshape(5, 7, 2)[1:4, 2:6]
    got = images.crop(df, "id", 1, 2, 3, 4).first()
    assert (got["h"], got["w"], got["c"]) == (3, 4, 2)
    assert got["data"] == want.ravel().tolist()
    parts = images.patches(df, "id", 3, 2).filter("id = 0").orderBy("patch").collect()
    grid = np.arange(1, n + 1.0).reshape(5, 7, 2)
    assert len(parts) == 6
    assert parts[4]["data"] == grid[2:5, 2:5].ravel().tolist()


def test_overrides_take_the_declared_type(spark):
    from loomframe.plans import registry

    seen = {}
    registry.BUILDERS["probe"] = lambda spark, **params: seen.update(params)
    config = {"target": "probe", "params": {"flag": True, "n": 3, "share": 0.5, "names": ["a"], "stem": "x"}}
    registry.build(config, spark, ["flag=False", "n=4", "share=1e-3", 'names=["b", "c"]', "stem=y", "new=z"])
    assert seen == {"flag": False, "n": 4, "share": 1e-3, "names": ["b", "c"], "stem": "y", "new": "z"}
    for bad in ("flag=maybe", "n=1.5", "names=3"):
        with pytest.raises(ValueError):
            registry.build(config, spark, [bad])
    del registry.BUILDERS["probe"]


def test_entities_are_decoded_before_encoding(spark):
    from loomframe.operators import tokenizer

    rows = spark.createDataFrame([("Ben &amp;amp; Tom",), ("ben & tom",)], "t string")
    first, second = rows.select(tokenizer.encode("t", [("b", "e")])).collect()
    assert first == second


def test_natural_order_of_names(spark):
    def last(*names):
        return labels.latest_by_name(spark.createDataFrame([(n,) for n in names], "name string"), "name").first()[0]

    assert last("run_9", "run_10", "run_2") == "run_10"
    assert last("2024-b-9", "2025-a-1") == "2025-a-1"
    assert last("a2b", "a10a") == "a10a"
    assert last("v1", "v" + "9" * 30, "v" + "1" * 31) == "v" + "1" * 31
    assert last("v002", "v1") == "v002"


def test_outputs_present_and_landmarks(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n:06d}.png").write_bytes(b"x")
    (tmp_path / "notes.txt").write_text("x")
    assert sinks.outputs_present(spark, str(tmp_path)) == 3
    rows = spark.createDataFrame(
        [(1, [(0.5, 1.0)]), (2, []), (3, None)], "id int, pts array<struct<x:double,y:double>>"
    )
    assert [r["id"] for r in rows.filter(filters.with_landmarks("pts")).collect()] == [1]
