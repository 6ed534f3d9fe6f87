"""Hand-worked and round-trip cases for arrays, boxes and sequences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import arrays, boxes, scores


@pytest.fixture(scope="module")
def row(spark):
    return spark.range(1)


def val(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_points(row):
    assert val(row, boxes.point_token(F.lit(1.0), F.lit(1.0), 16)) == 15
    assert val(row, boxes.point_token(F.lit(2 / 3), F.lit(1 / 3), 16)) == 6
    assert val(row, boxes.point_token(F.lit(0.5), F.lit(0.0), 36)) == 2


def test_labels(row):
    flags = {
        "is_group_of": F.lit(True), "is_occluded": F.lit(False),
        "is_depiction": F.lit(None).cast("boolean"), "is_inside": F.lit(1),
    }
    assert val(row, boxes.pack_label(F.lit(3), flags, 10)) == 93
    parts = boxes.unpack_label(F.lit(93), 10)
    got = row.select(*[c.alias(n) for n, c in parts.items()]).first().asDict()
    assert got == {
        "category_no": 3, "is_group_of": True, "is_occluded": False, "is_depiction": False,
        "is_inside": True,
    }


def test_center_crop(row):
    assert tuple(val(row, boxes.center_crop(F.lit(200), F.lit(100)))) == (0.25, 0.0, 0.5, 1.0)


@pytest.mark.parametrize("per_object", [2, 3])
@pytest.mark.parametrize("encode_crop", [True, False])
def test_sequence_round_trip(row, per_object, encode_crop):
    spec = boxes.SequenceSpec(5, 4, 4096, encode_crop, per_object)
    placed = [(7, 0.1, 0.2, 0.3, 0.4), (3, 0.5, 0.5, 0.2, 0.1)]
    objects = F.array(*[
        F.struct(F.lit(n).alias("label"), boxes.box(x, y, w, h).alias("box"))
        for n, x, y, w, h in placed
    ])
    crop = boxes.box(0.0, 0.0, 1.0, 1.0)
    seq = boxes.object_sequence(objects, crop, F.lit(False), spec)
    df = row.select(seq.alias("s"))
    assert len(df.first()["s"]) == spec.length
    back = df.select(boxes.sequence_objects("s", spec).alias("o")).first()["o"]
    assert [o["label"] for o in back] == [7, 3]
    for o, (_, x, y, w, h) in zip(back, placed):
        want = (x, y, w, h) if per_object == 3 else (x + w / 2, y + h / 2)
        assert tuple(o["place"]) == pytest.approx(want, abs=1 / 63)
    if encode_crop:
        found = df.select(boxes.sequence_crop("s", spec).alias("c")).first()["c"]
        assert tuple(found) == (0.0, 0.0, 1.0, 1.0)


def test_sequence_rejects_bad_tokens(row):
    spec = boxes.SequenceSpec(5, 2, 16)
    objects = F.array(F.struct(F.lit(99).alias("label"), boxes.box(0.1, 0.1, 0.2, 0.2).alias("box")))
    with pytest.raises(Exception, match="wrong length or token"):
        row.select(boxes.object_sequence(objects, boxes.full_frame(), F.lit(False), spec)).first()


def test_permutations():
    assert arrays.permutation("boustrophedon", 2, 2) == [0, 1, 3, 2]
    assert arrays.permutation("spiral_out", 4, 4)[:5] == [9, 5, 6, 10, 14]
    assert arrays.permutation("subsample", 4, 4)[:4] == [0, 2, 8, 10]
    for kind in ("identity", "subsample", "z_curve", "spiral_out", "spiral_in", "random", "boustrophedon"):
        order = arrays.permutation(kind, 8, 8)
        assert sorted(order) == list(range(64))
        inverse = arrays.inverse_permutation(order)
        assert [order[k] for k in inverse] == list(range(64))


def test_morton(row):
    for i, j, code in ((1, 0, 2), (0, 1, 1), (1, 1, 3), (5, 9, arrays.morton_number(5, 9))):
        assert val(row, arrays.morton(F.lit(i), F.lit(j))) == code


def test_quantile_and_bytes(spark):
    v = np.linspace(-3, 2, 11)
    df = spark.createDataFrame([(v.tolist(),)], "v array<double>")
    assert val(df, arrays.abs_quantile("v", 0.9)) == pytest.approx(np.quantile(np.abs(v), 0.9))
    packed = df.select(arrays.to_float_bytes("v").alias("b"))
    assert val(packed, arrays.from_float_bytes("b", 11)) == pytest.approx(v.astype("f4").tolist())
    with pytest.raises(Exception, match="expected 4 floats"):
        packed.select(arrays.from_float_bytes("b", 4)).first()
    depth = val(packed, arrays.depth_from_bytes("b"))
    assert depth[0] == pytest.approx(-1) and depth[-1] == pytest.approx(1)


def test_level_and_label_edges(row):
    assert val(row, arrays.shift_label(F.lit(255))) == 0
    assert val(row, arrays.one_hot(F.lit(2), 4)) == [0, 0, 1, 0]
    assert val(row, scores.arg_max(arrays.literal([1, 3, 3]))) == 1
    kept = val(row, arrays.top_k_logits(arrays.literal([1, 2, 2, 0]), 1))
    assert kept == [None, 2.0, 2.0, None]


def test_condition_dropout_is_exact_at_the_ends(spark):
    df = spark.range(200).select("id", arrays.literal([1.0]).alias("v"))
    blank = arrays.literal([0.0])
    for p, want in ((0.0, {1.0}), (1.0, {0.0})):
        got = df.select(arrays.drop_condition("v", "id", p, blank, 3)[0].alias("x")).collect()
        assert {r["x"] for r in got} == want


def test_eye_alignment_rejects_close_eyes(spark):
    pts = [(float(10 + k % 2), 10.0) for k in range(14)]
    df = spark.createDataFrame([(pts,)], "p array<struct<x:double,y:double>>")
    eye = boxes.eye_affine("p", (1, 7), (7, 13), F.lit(128), F.lit(128), 128)
    assert val(df, eye) is None


def test_gaussian_kl_of_equal_distributions(row):
    m, l = arrays.literal([0.3, -1.0]), arrays.literal([0.1, 0.7])
    assert val(row, scores.gaussian_kl(m, l, m, l)) == pytest.approx(0.0)
