"""Box, coordinate-token and alignment functions.

A box is ``struct<x, y, w, h>`` of doubles in units of the image size unless a
function says otherwise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions import seeded
from loomframe.functions.arrays import bind


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _d(value) -> Column:
    return F.lit(float(value)) if isinstance(value, (int, float)) else _c(value)


def box(x, y, w, h) -> Column:
    return F.struct(
        _d(x).alias("x"), _d(y).alias("y"), _d(w).alias("w"), _d(h).alias("h")
    )


def full_frame() -> Column:
    return box(0.0, 0.0, 1.0, 1.0)


def from_corners(x_min, y_min, x_max, y_max) -> Column:
    return box(x_min, y_min, _c(x_max) - _c(x_min), _c(y_max) - _c(y_min))


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def relative(b: Column, width, height) -> Column:
    width, height = _c(width), _c(height)
    return box(b["x"] / width, b["y"] / height, b["w"] / width, b["h"] / height)


def overlap_area(a: Column, b: Column) -> Column:
    across = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    down = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(across, F.lit(0.0)) * F.greatest(down, F.lit(0.0))


def flipped(b: Column) -> Column:
    return box(F.lit(1) - (b["x"] + b["w"]), b["y"], b["w"], b["h"])


def pixel_corners(b: Column, width, height) -> Column:
    """Integer corners (left, top, right, bottom), truncated."""
    width, height = _c(width), _c(height)
    return F.array(
        (b["x"] * width).cast("int"),
        (b["y"] * height).cast("int"),
        ((b["x"] + b["w"]) * width).cast("int"),
        ((b["y"] + b["h"]) * height).cast("int"),
    )


def in_crop(b: Column, crop: Column, flip=None) -> Column:
    """``b`` in the coordinates of ``crop``: origin clamped to [0, 1], size cut."""

    def unit(v: Column) -> Column:
        return F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))

    x = unit((b["x"] - crop["x"]) / crop["w"])
    y = unit((b["y"] - crop["y"]) / crop["h"])
    w = F.least(b["w"] / crop["w"], F.lit(1) - x)
    h = F.least(b["h"] / crop["h"], F.lit(1) - y)
    if flip is not None:
        x = F.when(_c(flip), F.lit(1) - (x + w)).otherwise(x)
    return box(x, y, w, h)


def center_crop(width, height) -> Column:
    width, height = _c(width).cast("double"), _c(height).cast("double")
    wide = box(F.lit(0.5) - height / width / 2, 0.0, height / width, 1.0)
    tall = box(0.0, F.lit(0.5) - width / height / 2, 1.0, width / height)
    return F.when(width > height, wide).otherwise(tall)


def random_crop(width, height, crop_w: int, crop_h: int, seed: int, key) -> Column:
    """A crop of fixed pixel size placed uniformly; the image must be as large."""
    width, height = _c(width), _c(height)
    left = seeded.uniform_int(seed, width - crop_w + 1, F.lit("l"), key)
    top = seeded.uniform_int(seed, height - crop_h + 1, F.lit("t"), key)
    return box(left / width, top / height, F.lit(crop_w) / width, F.lit(crop_h) / height)


def random_square_crop(width, height, min_size: int, seed: int, key) -> Column:
    """A square of random size in [min_size, short side], placed uniformly."""
    width, height = _c(width).cast("long"), _c(height).cast("long")
    short = F.least(width, height)
    span = F.greatest(short - min_size, F.lit(0))
    size = F.when(short <= min_size, short).otherwise(
        F.lit(min_size) + seeded.uniform_int(seed, span + 1, F.lit("s"), key)
    )
    top = seeded.uniform_int(seed, height - size + 1, F.lit("t"), key)
    left = seeded.uniform_int(seed, width - size + 1, F.lit("l"), key)
    return box(left / width, top / height, size / width, size / height)


# --- coordinate tokens -------------------------------------------------------


def sections(tokens: int) -> int:
    return math.isqrt(tokens)


def point_token(x, y, tokens: int) -> Column:
    """Grid cell number of a point; halves round to even."""
    side = sections(tokens)
    column = F.rint(_c(x) * (side - 1)).cast("int")
    row = F.rint(_c(y) * (side - 1)).cast("int")
    return row * side + column


def token_point(token, tokens: int) -> Column:
    side = sections(tokens)
    token = _c(token)
    return F.struct(
        ((token % side) / F.lit(float(side - 1))).alias("x"),
        (F.floor(token / side) / F.lit(float(side - 1))).alias("y"),
    )


def box_tokens(b: Column, tokens: int) -> Column:
    return F.array(
        point_token(b["x"], b["y"], tokens),
        point_token(b["x"] + b["w"], b["y"] + b["h"], tokens),
    )


def tokens_box(first, second, tokens: int) -> Column:
    a, b = token_point(first, tokens), token_point(second, tokens)
    return box(a["x"], a["y"], b["x"] - a["x"], b["y"] - a["y"])


# --- object labels -----------------------------------------------------------

# Bit of each flag in the packed label.
FLAG_BITS = {"is_group_of": 1, "is_occluded": 2, "is_depiction": 4, "is_inside": 8}


def pack_label(category_no, flags: dict[str, Column], classes: int) -> Column:
    """Category number plus flags in one integer; a flag counts only when true."""
    bits = F.lit(0)
    for name, bit in FLAG_BITS.items():
        if name in flags:
            on = F.coalesce(_c(flags[name]).cast("boolean"), F.lit(False))
            bits = bits.bitwiseOR(F.when(on, bit).otherwise(0))
    return _c(category_no) + F.lit(classes) * bits


def unpack_label(label, classes: int, group: bool = True, extra: bool = True) -> dict[str, Column]:
    label = _c(label)
    bits = F.floor(label / classes).cast("int")
    out = {"category_no": (label % classes).cast("int")}
    for name, bit in FLAG_BITS.items():
        used = group if name == "is_group_of" else extra
        out[name] = (bits.bitwiseAND(bit) > 0) if used else F.lit(False)
    return out


def flag_text(flags: dict[str, Column], short: bool = True) -> Column:
    """Flags as ``(g,o,d,i)`` or in words, empty when none is set."""
    words = {n: n.split("_")[1] for n in FLAG_BITS}
    parts = [
        F.when(_c(flags[n]), F.lit(w[0] if short else w)) for n, w in words.items() if n in flags
    ]
    inner = F.concat_ws(",", *parts)
    return F.when(inner == "", "").otherwise(F.concat(F.lit("("), inner, F.lit(")")))


@dataclass(frozen=True)
class SequenceSpec:
    """Shape of an object sequence.  ``per_object`` is 2 (centre) or 3 (box)."""

    classes: int
    max_objects: int
    tokens: int
    encode_crop: bool = True
    per_object: int = 2

    @property
    def none(self) -> int:
        return self.tokens - 1

    @property
    def length(self) -> int:
        return self.max_objects * self.per_object + (2 if self.encode_crop else 0)


def object_sequence(objects: Column, crop: Column, flip: Column, spec: SequenceSpec) -> Column:
    """Token sequence of an image.

    ``objects`` is an array of ``struct<label:int, box>`` in its final order with
    at most ``max_objects`` entries.  Objects outside the crop are dropped.  With
    ``encode_crop`` boxes stay relative to the full frame and the (flipped) crop
    fills the last two tokens; without it boxes are relative to the crop.
    """
    seen = F.filter(objects, lambda o: overlap_area(o["box"], crop) > 0)
    frame = full_frame() if spec.encode_crop else crop

    def tokens_of(o: Column) -> Column:
        b = in_crop(o["box"], frame, flip)
        if spec.per_object == 3:
            where = box_tokens(b, spec.tokens)
        else:
            where = F.array(point_token(b["x"] + b["w"] / 2, b["y"] + b["h"] / 2, spec.tokens))
        return F.concat(F.array(o["label"].cast("int")), where)

    def padded(body: Column) -> Column:
        room = F.lit(spec.max_objects * spec.per_object) - F.size(body)
        out = F.concat(body, F.array_repeat(F.lit(spec.none), room))
        if not spec.encode_crop:
            return out
        shown = F.when(flip, flipped(crop)).otherwise(crop)
        return F.concat(out, box_tokens(shown, spec.tokens))

    def checked(out: Column) -> Column:
        valid = (F.size(out) == spec.length) & F.forall(
            out, lambda t: (t >= 0) & (t < spec.tokens)
        )
        wrong = F.raise_error(F.lit("object sequence has a wrong length or token"))
        return F.when(valid, out).otherwise(wrong.cast("array<int>"))

    body = F.flatten(F.transform(seen, tokens_of))
    return bind(bind(body, padded), checked)


def sequence_objects(sequence, spec: SequenceSpec) -> Column:
    """Inverse of :func:`object_sequence`: the objects without padding."""
    sequence = _c(sequence)
    starts = F.sequence(F.lit(0), F.lit(spec.max_objects - 1))
    groups = bind(
        sequence,
        lambda a: F.transform(
            starts, lambda i: F.slice(a, i * spec.per_object + 1, spec.per_object)
        ),
    )
    kept = F.filter(groups, lambda g: g[0] != spec.none)

    def decode(g: Column) -> Column:
        if spec.per_object == 3:
            where = tokens_box(g[1], g[2], spec.tokens)
        else:
            where = token_point(g[1], spec.tokens)
        return F.struct(g[0].alias("label"), where.alias("place"))

    return F.transform(kept, decode)


def sequence_crop(sequence, spec: SequenceSpec) -> Column:
    sequence = _c(sequence)
    return tokens_box(F.element_at(sequence, -2), F.element_at(sequence, -1), spec.tokens)


def patch_boxes(grid_w: int, grid_h: int, kernel: int, stride: int, scale: int, width, height):
    """Array of ``struct<patch, box>``: every patch of a latent grid in image units."""
    per_row = (grid_w - kernel) // stride + 1
    rows = (grid_h - kernel) // stride + 1
    width, height = _c(width), _c(height)

    def one(i: Column) -> Column:
        left = (i % per_row) * (scale * stride) / width
        top = F.floor(i / per_row) * (scale * stride) / height
        b = box(left, top, F.lit(scale * kernel) / width, F.lit(scale * kernel) / height)
        return F.struct(i.alias("patch"), b.alias("box"))

    return F.transform(F.sequence(F.lit(0), F.lit(per_row * rows - 1)), one)


def with_patch(sequence, patch_box: Column, spec: SequenceSpec) -> Column:
    """A sequence whose crop, its last two tokens, gives way to the box of a patch."""
    sequence = _c(sequence)
    return F.concat(F.slice(sequence, F.lit(1), F.size(sequence) - 2), box_tokens(patch_box, spec.tokens))


# --- landmark alignment ------------------------------------------------------


def landmark_box(points, min_x, min_y, max_x, max_y) -> Column:
    """Integer bounding box of landmarks, clipped to bounds."""
    points = _c(points)
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])

    def clip(v: Column, low, high) -> Column:
        return F.least(F.greatest(v, _d(low)), _d(high)).cast("int")

    return F.array(
        clip(F.array_min(xs), min_x, max_x),
        clip(F.array_min(ys), min_y, max_y),
        clip(F.array_max(xs), min_x, max_x),
        clip(F.array_max(ys), min_y, max_y),
    )


# The target box on a grid of 128 pixels.
def target_box(size: int, base=(28, 48, 100, 115), grid: int = 128) -> list[int]:
    """Target face box for an output size, scaled from its 128-pixel grid."""
    return [v * size // grid for v in base]


def box_affine(source, target: list[int]) -> Column:
    """Row-major 2x3 matrix taking ``source`` corners to ``target`` corners."""
    s = _c(source)
    left, top, right, bottom = (float(v) for v in target)
    sx = F.lit(right - left) / (s[2] - s[0])
    sy = F.lit(bottom - top) / (s[3] - s[1])
    zero = F.lit(0.0)
    return F.array(sx, zero, F.lit(left) - sx * s[0], zero, sy, F.lit(top) - sy * s[1])


def eye_affine(
    points, left_eye: tuple[int, int], right_eye: tuple[int, int], width, height,
    out_size: int, eye_at=(0.35, 0.35), min_ratio: float = 0.15,
) -> Column:
    """Row-major 2x3 matrix that levels the eyes; null when they are too close.

    Eye ranges are half-open point indices.  Eye centres are truncated to whole
    pixels and their midpoint is floored.
    """
    points = _c(points)

    def centre(span: tuple[int, int], axis: str) -> Column:
        n = span[1] - span[0]
        part = F.slice(points, span[0] + 1, n)
        total = F.aggregate(part, F.lit(0.0), lambda acc, p: acc + p[axis])
        return (total / n).cast("int")

    lx, ly = centre(left_eye, "x"), centre(left_eye, "y")
    rx, ry = centre(right_eye, "x"), centre(right_eye, "y")
    dx, dy = (rx - lx).cast("double"), (ry - ly).cast("double")
    dist = F.sqrt(dx * dx + dy * dy)
    angle = F.radians(F.degrees(F.atan2(dy, dx)) - 180.0)
    scale = F.lit((1.0 - 2 * eye_at[0]) * out_size) / dist
    a, b = scale * F.cos(angle), scale * F.sin(angle)
    mx = F.floor((lx + rx) / F.lit(2)).cast("double")
    my = F.floor((ly + ry) / F.lit(2)).cast("double")
    shift_x = (F.lit(1.0) - a) * mx - b * my + (F.lit(out_size * 0.5) - mx)
    shift_y = b * mx + (F.lit(1.0) - a) * my + (F.lit(out_size * eye_at[1]) - my)
    near = dist < F.least(_c(width), _c(height)) * F.lit(min_ratio)
    return F.when(~near, F.array(a, b, shift_x, -b, a, shift_y))
