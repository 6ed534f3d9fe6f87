"""Image-table jobs: rows of ``(key, h, w, c, data)`` with channel-last pixels.

Every step is a Column expression over the pixel array, so that images stay in the engine: which
step applies to which image, every size, crop and weight is decided by columns.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import arrays, rasters, seeded
from loomframe.functions.arrays import bind

def as_images(df: DataFrame, key: str, pixels: Column, height: int, width: int, channels: int = 1):
    return df.select(
        key, F.lit(height).alias("h"), F.lit(width).alias("w"), F.lit(channels).alias("c"),
        pixels.cast("array<double>").alias("data"),
    )


def _renamed(df: DataFrame, height: str = "__h", width: str = "__w") -> DataFrame:
    """New sizes as h and w.  They keep other names while pixels are made from the old ones: inside
    a lambda a new "w" of the same projection would be taken for the width of the source."""
    return df.withColumnsRenamed({height: "h", width: "w"})


# --- resampling --------------------------------------------------------------


def resize(df: DataFrame, key: str, height, width, kind: str = "cubic", edge: str = "cut", keep: Sequence[str] = ()) -> DataFrame:
    """Resize to sizes given as numbers or columns; kinds are nearest, box, linear and cubic."""
    sized = df.withColumns({"__h": _int(height), "__w": _int(width)})
    data = rasters.resized(F.col("data"), F.col("h"), F.col("w"), F.col("c"), F.col("__h"), F.col("__w"), kind, edge)
    return _renamed(sized.select(key, *keep, "__h", "__w", "c", data.alias("data")))


def resize_short_side(df: DataFrame, key: str, size: int, kind: str = "cubic") -> DataFrame:
    """Resize so that the short side becomes ``size``, keeping the ratio."""
    short = F.least("h", "w")
    return resize(
        df, key, F.rint(F.col("h") * size / short), F.rint(F.col("w") * size / short), kind
    )


def halved(df: DataFrame, key: str, times: int, kind: str = "linear", keep: Sequence[str] = ()) -> DataFrame:
    """Halve ``times`` times."""
    half = lambda n: F.floor(F.col(n) / 2)
    for _ in range(times):
        df = resize(df, key, half("h"), half("w"), kind, keep=keep)
    return df


def _int(value) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("int")


# --- crops and tiles ---------------------------------------------------------


def cut(data: Column, width, channels, top, left, out_h, out_w) -> Column:
    """A rectangle of a raster, as slices of its rows."""
    rows = F.sequence(top, top + out_h - 1)
    return F.flatten(
        F.transform(
            rows, lambda r: F.slice(data, (r * width + left) * channels + 1, out_w * channels)
        )
    )


def crop(df: DataFrame, key: str, top, left, height, width, keep: Sequence[str] = ()) -> DataFrame:
    """Crop at offsets and sizes given as numbers or columns; needs no Python worker.

    A crop that isn't wholly inside its image raises an error that names the row.
    """
    out_h, out_w = _int(height), _int(width)
    placed = df.withColumns(
        {"__top": _int(top), "__left": _int(left), "__h": out_h, "__w": out_w}
    )
    inside = F.expr("__top >= 0 and __left >= 0 and __top + __h <= h and __left + __w <= w")
    outside = F.raise_error(F.concat(F.lit("crop outside the image of row "), F.col(key).cast("string")))
    data = F.when(~inside, outside.cast(df.schema["data"].dataType)).otherwise(cut(
        F.col("data"), F.col("w"), F.col("c"), F.col("__top"), F.col("__left"),
        F.col("__h"), F.col("__w"),
    ))
    return _renamed(placed.select(key, *keep, "__h", "__w", "c", data.alias("data")))


def center_crop(df: DataFrame, key: str, size: int) -> DataFrame:
    middle = lambda n: F.floor((F.col(n) - size) / 2)
    return crop(df, key, middle("h"), middle("w"), size, size)


def random_crop(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    top = seeded.uniform_int(seed, F.col("h") - size + 1, F.lit("t"), key)
    left = seeded.uniform_int(seed, F.col("w") - size + 1, F.lit("l"), key)
    return crop(df, key, top, left, size, size)


def square_crop_around(df: DataFrame, key: str, corners: str, ratio: float = 1.0) -> DataFrame:
    """Square crop centred on a box (left, top, right, bottom), mirrored at the image's edges.

    Places beyond an edge are folded back, so that no padded image is made.  The side is ``ratio`` times
    the box's longer one, 2 at least.
    """
    limit = F.greatest("h", "w").cast("double")
    box = F.transform(F.col(corners), lambda v: F.least(F.greatest(v.cast("double"), F.lit(0.0)), limit))
    # a box is an array of its own until its numbers are columns
    placed = df.withColumn("__box", box).withColumns({
        "__side": F.greatest(F.lit(2), (F.greatest(F.expr("__box[2] - __box[0]"), F.expr("__box[3] - __box[1]")) * ratio).cast("int")),
        "__cx": F.expr("(__box[0] + __box[2]) / 2"), "__cy": F.expr("(__box[1] + __box[3]) / 2"),
    })

    def places(centre: str, n: str) -> Column:
        first = F.floor(F.col(centre) - F.col("__side") / 2).cast("int")
        return F.transform(F.sequence(first, first + F.col("__side") - 1), lambda i: rasters.reflected(i, F.col(n)))

    data = rasters.gathered(F.col("data"), F.col("w"), F.col("c"), places("__cy", "h"), places("__cx", "w"))
    return _renamed(placed.select(key, "__side", F.col("__side").alias("__w"), "c", data.alias("data")), "__side", "__w")


def tile_origins(side: Column, size: int, overlap: int) -> Column:
    """Origins of overlapping tiles along one side; the last one is pinned to the edge."""
    last = (side - size).cast("int")
    step = size - overlap
    inner = F.filter(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), lambda v: v < last
    )
    return F.concat(inner, F.array(last))


def tiles(df: DataFrame, key: str, size: int, overlap: int, above: int) -> DataFrame:
    """Overlapping tiles of images larger than ``above`` on both sides; others whole.

    All tiles of an image are cut before they become rows, so the whole image is
    never copied once per tile.
    """
    large = (F.col("h") > above) & (F.col("w") > above)
    zero = F.array(F.lit(0))
    rows = F.when(large, tile_origins(F.col("h"), size, overlap)).otherwise(zero)
    cols = F.when(large, tile_origins(F.col("w"), size, overlap)).otherwise(zero)
    sized = df.withColumns(
        {
            "__h": F.when(large, F.lit(size)).otherwise(F.col("h")),
            "__w": F.when(large, F.lit(size)).otherwise(F.col("w")),
            "__rows": rows, "__cols": cols,
        }
    )

    def part(top: Column, left: Column) -> Column:
        data = cut(F.col("data"), F.col("w"), F.col("c"), top, left, F.col("__h"), F.col("__w"))
        return F.struct(top.alias("top"), left.alias("left"), data.alias("data"))

    parts = F.flatten(
        F.transform("__rows", lambda top: F.transform("__cols", lambda left: part(top, left)))
    )
    return sized.select(key, F.explode(parts).alias("p"), "__h", "__w", "c").select(
        key, "p.top", "p.left", F.col("__h").alias("h"), F.col("__w").alias("w"), "c", "p.data"
    )


def patches(df: DataFrame, key: str, kernel: int, stride: int) -> DataFrame:
    """Every ``kernel``-sized patch of equal stride, numbered row by row."""
    across = (F.floor((F.col("w") - kernel) / stride) + 1).cast("int")
    down = (F.floor((F.col("h") - kernel) / stride) + 1).cast("int")
    sized = df.withColumn("__across", across).withColumn("__count", across * down)
    side = F.lit(kernel)

    def part(n: Column) -> Column:
        top = F.floor(n / F.col("__across")).cast("int") * stride
        left = n % F.col("__across") * stride
        data = cut(F.col("data"), F.col("w"), F.col("c"), top, left, side, side)
        return F.struct(n.alias("patch"), data.alias("data"))

    parts = F.transform(F.sequence(F.lit(0), F.col("__count") - 1), part)
    return sized.select(key, F.explode(parts).alias("p"), "c").select(
        key, "p.patch", side.alias("h"), side.alias("w"), "c", "p.data"
    )


def border_weight(y: Column, x: Column, height: int, width: int, low: float, high: float) -> Column:
    """Distance to the border of a raster in [0, 0.5], clipped."""
    fy, fx = y / F.lit(float(height - 1)), x / F.lit(float(width - 1))
    edge = F.least(fy, fx, F.lit(1.0) - fy, F.lit(1.0) - fx)
    return F.greatest(F.least(edge, F.lit(high)), F.lit(low))


def stitched(
    parts: DataFrame, key: str, height: int, width: int, kernel: int, stride: int,
    clip=(0.01, 0.5), tie_clip: tuple[float, float] | None = (0.01, 0.5), channels: int = 1, up: int = 1, down: int = 1,
) -> DataFrame:
    """Overlap-normalised images (key, h, w, c, data) from the patches of a ``height`` x ``width`` raster.

    Patches were cut with ``kernel`` and ``stride`` and may since have been enlarged by ``up`` or shrunk by
    ``down``; the image changes with them.  Pixels of a patch are weighted by their distance to its
    border and, with ``tie_clip``, by the place of the patch in the grid.  An image's patches are
    one group of as many rows as the grid has places; each output pixel gathers the few patches over
    it, and no row is made for a pixel.  A place under no patch is null.
    """
    if up > 1 and down > 1:
        raise ValueError("patches are either enlarged or shrunk")
    rows, cols = (height - kernel) // stride + 1, (width - kernel) // stride + 1
    scaled = lambda n: n * up // down
    size, step, out_h, out_w = scaled(kernel), scaled(stride), scaled(height), scaled(width)
    line = lambda n: F.sequence(F.lit(0), F.lit(n - 1))

    def over(at: Column, count: int) -> Column:
        """Grid places whose patches lie over a row or column of the image."""
        return F.filter(line(count), lambda p: (at >= p * step) & (at < p * step + size))

    def pixel(patches: Column, y: Column, x: Column) -> Column:
        def meet(py: Column, px: Column) -> Column:
            iy, ix = y - py * step, x - px * step
            weight = border_weight(iy, ix, size, size, *clip)
            if tie_clip is not None:
                weight = weight * border_weight(py, px, rows, cols, *tie_clip)
            return F.struct((py * cols + px).alias("p"), ((iy * size + ix) * channels).alias("i"), weight.alias("g"))

        here = F.flatten(F.transform(over(y, rows), lambda py: F.transform(over(x, cols), lambda px: meet(py, px))))

        def blend(some: Column) -> Column:
            total = F.aggregate(some, F.lit(0.0), lambda acc, m: acc + m["g"])
            return bind(total, lambda t: F.transform(line(channels), lambda k: F.when(t > 0, F.aggregate(
                some, F.lit(0.0), lambda acc, m: acc + m["g"] * F.get(F.get(patches, m["p"]), m["i"] + k)) / t)))

        return bind(here, blend)

    def whole(patches: Column) -> Column:
        return F.flatten(F.transform(line(out_h), lambda y: F.flatten(F.transform(line(out_w), lambda x: pixel(patches, y, x)))))

    # a grid of rows * cols patches is all that a group can hold
    inside = parts.filter((F.col("patch") >= 0) & (F.col("patch") < rows * cols))
    grid = inside.groupBy(key).agg(F.collect_list(F.struct("patch", "data")).alias("__some"))
    patches = F.transform(line(rows * cols), lambda n: F.get(F.filter("__some", lambda s: s["patch"] == n), F.lit(0))["data"])
    return grid.select(
        key, F.lit(out_h).alias("h"), F.lit(out_w).alias("w"), F.lit(channels).alias("c"), bind(patches, whole).alias("data")
    )


# --- augment, conditions, codecs --------------------------------------------


def augment_order(mode: int, height: int, width: int) -> list[int]:
    """Source index per output pixel of one of eight flips and rotations."""
    grid = np.arange(height * width).reshape(height, width)
    # Fixed values: (quarter turns, flipped upside down) of modes 0 to 7.
    turns, flip = ((0, 0), (1, 1), (0, 1), (3, 0), (2, 1), (1, 0), (2, 0), (3, 1))[mode]
    grid = np.rot90(grid, turns)
    return [int(k) for k in (grid[::-1] if flip else grid).ravel()]


def cropped_to_multiple(df: DataFrame, key: str, step: int) -> DataFrame:
    cut = lambda n: F.col(n) - F.col(n) % step
    return crop(df, key, 0, 0, cut("h"), cut("w"))


def warp(df: DataFrame, key: str, matrix: str, height: int, width: int) -> DataFrame:
    """Bilinear warp by a forward 2x3 matrix column; zero outside the source."""
    data = rasters.warped(F.col("data"), F.col("h"), F.col("w"), F.col("c"), F.col(matrix), height, width)
    return _renamed(df.select(key, F.lit(height).alias("__h"), F.lit(width).alias("__w"), "c", data.alias("data")))


def header_size(column) -> tuple[Column, Column]:
    """Width and height of PNG bytes, read from the header without decoding."""
    column = F.col(column) if isinstance(column, str) else column

    def number(at: int) -> Column:
        return F.conv(F.hex(F.substring(column, at, 4)), 16, 10).cast("int")

    return number(17), number(21)


def file_size_of(column) -> Column:
    """``struct<w, h>`` of PNG or JPEG bytes from their headers; null for others."""

    @F.pandas_udf("struct<w:int,h:int>")
    def sizes(raw: pd.Series) -> pd.DataFrame:
        found = [_header(b) if b is not None else (None, None) for b in raw]
        return pd.DataFrame(found, columns=["w", "h"]).astype("Int32")

    return sizes(F.col(column) if isinstance(column, str) else column)


def _header(raw: bytes) -> tuple[int | None, int | None]:
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", raw[16:24])
    if raw[:2] != b"\xff\xd8":
        return None, None
    at = 2
    while at + 9 <= len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        # Frame headers carry the size; C4, C8 and CC share their range.
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
            return width, height
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
        else:
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None, None


# --- pairs and metrics --------------------------------------------


def low_high_pairs(df: DataFrame, key: str, low: int, high: int, blur_sigma: float | None = None) -> DataFrame:
    """Training pairs (key, low, high): the image at ``high``, and the same after a detour over ``low``.

    Both are structs of an image, scaled to [-1, 1]; each step rounds to bytes, as stored images do.
    """
    if low >= high:
        raise ValueError("the low size must be below the target size")
    c = F.col("c")
    # one step a projection: an expression of all steps would be too deep to resolve
    steps = df.withColumn("__high", rasters.resized(F.col("data"), F.col("h"), F.col("w"), c, high, high))
    steps = steps.withColumn("__low", rasters.as_bytes(rasters.resized(F.col("data"), F.col("h"), F.col("w"), c, low, low)))
    if blur_sigma is not None:
        steps = steps.withColumn("__low", rasters.as_bytes(rasters.blurred(F.col("__low"), low, low, c, rasters.gaussian(7, blur_sigma))))
    steps = steps.withColumn("__back", rasters.resized(F.col("__low"), low, low, c, high, high))
    scaled = lambda v: F.transform(rasters.as_bytes(F.col(v)), lambda x: x / 127.5 - 1.0)
    image = lambda v: F.struct(F.lit(high).alias("h"), F.lit(high).alias("w"), "c", scaled(v).alias("data"))
    return steps.select(key, image("__back").alias("low"), image("__high").alias("high"))


def lowpass_swap(df: DataFrame, reference: DataFrame, key: str, factor: int) -> DataFrame:
    """Replace the low frequencies of an image by those of its reference (key, data) of the same size."""
    pairs = df.join(reference.select(key, F.col("data").alias("__ref")), key)
    h, w, c = F.col("h"), F.col("w"), F.col("c")
    small = pairs.withColumns({"__small_h": F.floor(h / factor).cast("int"), "__small_w": F.floor(w / factor).cast("int")})
    for name in ("data", "__ref"):  # one step a projection: an expression of all steps would be too deep to resolve
        small = small.withColumn(f"__s{name}", rasters.resized(F.col(name), h, w, c, F.col("__small_h"), F.col("__small_w"), "cubic", "mirror"))
        small = small.withColumn(f"__l{name}", rasters.resized(F.col(f"__s{name}"), F.col("__small_h"), F.col("__small_w"), c, h, w, "cubic", "mirror"))
    parts = F.arrays_zip(F.col("data").alias("x"), F.col("__ldata").alias("a"), F.col("__l__ref").alias("b"))
    return small.select(key, "h", "w", "c", F.transform(parts, lambda z: z["x"] - z["a"] + z["b"]).alias("data"))


def ssim(pairs: DataFrame, key: str, border: int = 0) -> DataFrame:
    """(key, ssim): structural similarity of ``data`` and ``ref`` on the 8-bit scale, channel mean.

    ``border`` pixels are left out at every edge; an image of fewer than 11 that remain has null.
    """
    h, w = F.col("h") - 2 * border, F.col("w") - 2 * border
    inner = lambda v: cut(F.col(v), F.col("w"), F.col("c"), F.lit(border), F.lit(border), h, w) if border else F.col(v)
    value = bind(F.struct(inner("data").alias("a"), inner("ref").alias("b")), lambda s: rasters.structural_similarity(s["a"], s["b"], h, w, F.col("c")))
    return pairs.select(key, F.when((h >= rasters.SSIM_SIZE) & (w >= rasters.SSIM_SIZE), value).alias("ssim"))


def segmentation_pairs(pairs: DataFrame, key: str, label: str, size: int, shift: bool = False) -> DataFrame:
    """(key, h, w, c, data, runs): the image resized (cubic) and its label map by the nearest label.

    Labels are runs of (class, start, length); :func:`rasters.runs_one_hot` expands them where they
    are needed.  ``shift`` adds one, so that 255 becomes 0.
    """
    near = rasters.resized(F.col(label).cast("array<double>"), F.col("h"), F.col("w"), 1, size, size, "nearest")
    labels = near.cast("array<int>")
    if shift:
        labels = F.transform(labels, lambda v: arrays.shift_label(v))
    both = pairs.withColumn("__runs", rasters.label_runs(labels))
    return resize(both, key, size, size, keep=["__runs"]).withColumnRenamed("__runs", "runs")
