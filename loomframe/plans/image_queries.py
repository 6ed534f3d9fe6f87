"""Image-table queries over small gray images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomframe.functions import arrays, boxes, rasters
from loomframe.operators import images
from loomframe.plans import views
from loomframe.plans.annotation_queries import EYES_SQL
from loomframe.plans.registry import joined, query, rounded
from loomframe.plans.views import IMAGES8, u_sql


def _images(t):
    return images.as_images(views.images8(t, spread=True), "image_id", F.col("px"), 8, 8)


def _pixel_rows(df, column="data"):
    # "outer", as the planner would else filter by the pixels' number first and make them twice
    flat = df.select("image_id", F.posexplode_outer(column).alias("pos", "x"))
    return flat.select("image_id", F.col("pos").cast("long").alias("pos"), rounded("x").alias("v"))


# --- SQL twins of filters: taps as lists of (at, w), both passes as nested lists --


def _added(values: str) -> str:
    """Sum of a list from left to right."""
    return f"list_reduce(list_prepend(0.0::double, {values}), lambda a, b: a + b)"


def _resize_taps(name: str, n_in: int, n_out: int, kind: str = "cubic", edge: str = "cut") -> str:
    """CTEs with the table ``name`` (t): taps of every output place."""
    if kind == "nearest":
        at = f"least(floor((o + 0.5::double) * {n_in} / {n_out})::int, {n_in - 1})"
        return f"{name} as (select list_transform(range({n_out}), lambda o: [{{'at': {at}, 'w': 1.0::double}}]) as t)"
    stretch, radius = max(1.0, n_in / n_out), {"box": 0.5, "linear": 1.0, "cubic": 2.0}[kind]
    reach = math.ceil(stretch * radius) + 1
    centre = f"((o + 0.5::double) * {n_in} / {n_out} - 0.5::double)"
    d = f"(({centre} - k) / {stretch!r}::double)"
    shape = {
        "box": f"case when {d} > -0.5 and {d} <= 0.5 then 1.0::double else 0.0::double end",
        "linear": f"greatest(0.0::double, 1.0::double - abs({d}))",
        "cubic": f"""case when abs({d}) <= 1 then (abs({d}) * 1.5::double - 2.5::double) * abs({d}) * abs({d}) + 1.0::double
          when abs({d}) < 2 then ((abs({d}) * -0.5::double + 2.5::double) * abs({d}) - 4.0::double) * abs({d}) + 2.0::double
          else 0.0::double end""",
    }[kind]
    some = f"list_transform(range(floor({centre})::int - {reach}, floor({centre})::int + {reach + 1}), lambda k: {{'at': k, 'w': {shape}}})"
    if edge == "cut":
        kept = f"list_filter({some}, lambda q: q.w <> 0 and q.at >= 0 and q.at < {n_in})"
    else:
        turn = f"(((q.at % {2 * n_in}) + {2 * n_in}) % {2 * n_in})"
        fold = f"case when {turn} >= {n_in} then {2 * n_in - 1} - {turn} else {turn} end"
        kept = f"list_transform(list_filter({some}, lambda q: q.w <> 0), lambda q: {{'at': {fold}, 'w': q.w}})"
    whole = _added("list_transform(taps, lambda q: q.w)")
    return f"""{name}_raw as (select list_transform(range({n_out}), lambda o: {kept}) as r),
    {name} as (select list_transform(r, lambda taps: list_transform(taps, lambda q: {{'at': q.at, 'w': q.w / {whole}}})) as t from {name}_raw)"""


def _kernel_taps(name: str, n: int, weights: list[float], edge: str = "mirror") -> str:
    size, table = len(weights), "[" + ", ".join(f"{v!r}::double" for v in weights) + "]"
    if edge == "valid":
        places, at = n - size + 1, "o + k - 1"
    else:
        turn = f"(((o + k - 1 - {size // 2}) + {2 * n}) % {2 * n})"
        places, at = n, f"case when {turn} >= {n} then {2 * n - 1} - {turn} else {turn} end"
    one = f"list_transform(range(1, {size + 1}), lambda k: {{'at': {at}, 'w': {table}[k]}})"
    return f"{name} as (select list_transform(range({places}), lambda o: {one}) as t)"


def _filtered(px: str, w: int, taps: str) -> str:
    """The list ``px`` (rows of ``w`` values) under the taps of table ``taps``, which is joined in, along both axes."""
    t = f"{taps}.t"
    part = _added(f"list_transform(v, lambda q: q.w * {px}[q.at * {w} + x + 1])")
    rows = f"list_transform({t}, lambda v: list_transform(range({w}), lambda x: {part}))"
    return f"flatten(list_transform({rows}, lambda line: list_transform({t}, lambda h: {_added('list_transform(h, lambda q: q.w * line[q.at + 1])')})))"


def _bytes(px: str) -> str:
    return f"list_transform({px}, lambda v: least(255.0::double, greatest(0.0::double, round_even(v, 0))))"


def _pixels(columns: str, count: int, source: str) -> str:
    return f"select image_id, pos, {columns} from (select *, unnest(range({count})) as pos from {source})"


@query(
    "level_map",
    f"""with {IMAGES8}, e as (select image_id, px, unnest(range(0, 16)) pos from images8),
    c as (select *, pos // 4 * 16 + pos % 4 * 2 as o from e),
    m as (select image_id, pos, (px[o+1] / 255.0::double + px[o+2] / 255.0::double + px[o+9] / 255.0::double
      + px[o+10] / 255.0::double) / 4 as mean from c)
    select image_id, pos, cast(round_even(mean * 12, 0) as int) as level,
      round(cast(round_even(mean * 12, 0) as int) / 12.0::double, 6) as decoded from m""",
)
def level_map(t):
    """Area-pooled images quantised to levels and back."""
    unit = arrays.unit_from_int("px")
    levels = views.images8(t).select(
        "image_id", arrays.quantise_levels(arrays.block_mean(unit, 8, 8, 2), 12).alias("lv")
    )
    both = levels.select("image_id", F.posexplode(F.arrays_zip(
        F.col("lv").alias("a"), arrays.level_values("lv", 12).alias("b"))).alias("pos", "d"))
    return both.select(
        "image_id", F.col("pos").cast("long").alias("pos"), F.col("d.a").alias("level"),
        rounded("d.b").alias("decoded"),
    )


@query(
    "level_map_full",
    f"""with {IMAGES8}, e as (select image_id, px, unnest(range(0, 64)) pos from images8),
    c as (select *, pos // 16 * 16 + pos % 8 // 2 * 2 as o from e)
    select image_id, pos, round(cast(round_even((px[o+1] / 255.0::double + px[o+2] / 255.0::double + px[o+9] / 255.0::double
      + px[o+10] / 255.0::double) / 4 * 12, 0) as int) / 12.0::double, 6) as v from c""",
)
def level_map_full(t):
    """Levels of area-pooled images, decoded and enlarged to the images' size."""
    levels = arrays.quantise_levels(arrays.block_mean(arrays.unit_from_int("px"), 8, 8, 2), 12)
    decoded = views.images8(t).select("image_id", arrays.level_values(levels, 12).alias("low"))
    return _pixel_rows(decoded.select("image_id", arrays.block_repeat("low", 4, 4, 2).alias("data")))


@query(
    "patchify",
    f"""with {IMAGES8}, e as (select image_id, px, unnest(range(0, 16)) as token from images8)
    select image_id, token, array_to_string(list_transform(range(0, 4), lambda f:
      px[((f // 2) * 4 + token // 4) * 8 + (f % 2) * 4 + token % 4 + 1]), ' ') as features from e""",
)
def patchify(t):
    tokens = views.images8(t).select(
        "image_id", F.posexplode(arrays.strided_tokens("px", 8, 8, 1, 2)).alias("token", "f")
    )
    return tokens.select(
        "image_id", F.col("token").cast("long").alias("token"), joined("f").alias("features")
    )


@query(
    "colour_convert",
    f"""with {IMAGES8}, e as (select image_id, px, unnest(range(0, 21)) pos from images8),
    c as (select image_id, pos, px[3*pos+1] r, px[3*pos+2] g, px[3*pos+3] b from e),
    y as (select *, (r * 65.481::double + g * 128.553::double + b * 24.966::double) / 255 + 16 yy,
      (r * -37.797::double + g * -74.203::double + b * 112.0::double) / 255 + 128 cb,
      (r * 112.0::double + g * -93.786::double + b * -18.214::double) / 255 + 128 cr from c)
    select image_id, pos, cast(round_even(yy, 0) as int) as y, cast(round_even(cb, 0) as int) as cb,
      cast(round_even(cr, 0) as int) as cr,
      round((yy * 0.00456621::double + cr * 0.00625893::double) * 255 - 222.921::double, 4) + 0.0 as red,
      round((yy * 0.00456621::double - cb * 0.00153632::double - cr * 0.00318811::double) * 255
        + 135.576::double, 4) + 0.0 as green,
      round((yy * 0.00456621::double + cb * 0.00791071::double) * 255 - 276.836::double, 4) + 0.0 as blue,
      round(r * 0.299::double + g * 0.587::double + b * 0.114::double, 6) as gray from y""",
)
def colour_convert(t):
    """Consecutive values as RGB pixels, to YCbCr and back, and to gray."""
    pixels = views.images8(t).select(
        "image_id", "px", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("pos")
    ).select(
        "image_id", F.col("pos").cast("long").alias("pos"),
        *[F.get("px", F.col("pos") * 3 + n).alias(c) for n, c in enumerate("rgb")],
    )
    y, cb, cr = arrays.rgb_to_ycc("r", "g", "b")
    raw = pixels.withColumns({"yy": y, "cbb": cb, "crr": cr})
    red, green, blue = arrays.ycc_to_rgb("yy", "cbb", "crr")
    return raw.select(
        "image_id", "pos", arrays.as_byte("yy").alias("y"), arrays.as_byte("cbb").alias("cb"),
        arrays.as_byte("crr").alias("cr"), rounded(red, 4).alias("red"),
        rounded(green, 4).alias("green"), rounded(blue, 4).alias("blue"),
        rounded(arrays.gray_value("r", "g", "b")).alias("gray"),
    )


@query(
    "coord_map",
    f"""with {IMAGES8}, e as (select image_id, px, unnest(range(0, 16)) pos from images8)
    select image_id, pos, px[(pos // 4 + 2) * 8 + pos % 4 + 2 + 1]::double as v,
      round(((pos // 4 + 2) * 8 + pos % 4 + 2) / 64.0::double, 6) as coord from e""",
)
def coord_map(t):
    """Centre crop of an image together with its coordinate map."""
    both = images.as_images(
        views.images8(t), "image_id",
        F.flatten(F.zip_with("px", arrays.coordinate_map(8, 8), lambda p, c: F.array(p.cast("double"), c))),
        8, 8, 2,
    )
    cut = images.center_crop(both, "image_id", 4)
    flat = cut.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos"), "data")
    return flat.select(
        "image_id", F.col("pos").cast("long").alias("pos"), F.get("data", F.col("pos") * 2).alias("v"),
        rounded(F.get("data", F.col("pos") * 2 + 1)).alias("coord"),
    )


@query(
    "augment_modes",
    f"""with {IMAGES8}, e as (select image_id, image_id % 8 as mode, px, unnest(range(0, 64)) pos from images8),
    c as (select *, pos // 8 i, pos % 8 j from e)
    select image_id, mode, pos, px[1 + case mode when 0 then i * 8 + j when 1 then j * 8 + i
      when 2 then (7 - i) * 8 + j when 3 then (7 - j) * 8 + i when 4 then i * 8 + 7 - j
      when 5 then j * 8 + 7 - i when 6 then (7 - i) * 8 + 7 - j else (7 - j) * 8 + 7 - i end] as v from c""",
)
def augment_modes(t):
    """One of eight flips and rotations per image, as index permutations."""
    mode = F.col("image_id") % 8
    moved = F.col("px")
    for n in range(1, 8):
        moved = F.when(mode == n, arrays.reorder("px", images.augment_order(n, 8, 8))).otherwise(moved)
    flat = views.images8(t).select("image_id", mode.alias("mode"), F.posexplode(moved).alias("pos", "v"))
    return flat.withColumn("pos", F.col("pos").cast("long"))


@query(
    "stitch_patches",
    f"""with {IMAGES8}, p as (select image_id, px, unnest(range(0, 9)) as patch from images8),
    i as (select *, unnest(range(0, 16)) k from p),
    w as (select image_id, patch // 3 * 2 + k // 4 as y, patch % 3 * 2 + k % 4 as x, px, patch, k,
      greatest(least(least(k // 4 / 3.0::double, k % 4 / 3.0::double, 1 - k // 4 / 3.0::double,
        1 - k % 4 / 3.0::double), 0.5), 0.01)
      * greatest(least(least(patch // 3 / 2.0::double, patch % 3 / 2.0::double, 1 - patch // 3 / 2.0::double,
        1 - patch % 3 / 2.0::double), 0.5), 0.01) as g from i)
    select image_id, y, x, round(sum(g * px[y * 8 + x + 1] * (patch + 1)) / sum(g), 9) + 0.0 as v
    from w group by image_id, y, x""",
)
def stitch_patches(t):
    """Patches, each scaled by its number, blended into whole images again."""
    parts = images.patches(_images(t), "image_id", 4, 2)
    scaled = parts.select(
        "image_id", "patch",
        F.transform("data", lambda v: v * (F.col("patch") + 1)).alias("data"),
    )
    whole = images.stitched(scaled, "image_id", 8, 8, 4, 2).select("image_id", F.posexplode_outer("data").alias("i", "v"))
    return whole.select(
        "image_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), rounded("v", 9).alias("v")
    )


@query(
    "stitch_scaled",
    f"""with {IMAGES8}, p as (select image_id, px, unnest(range(0, 9)) as patch from images8),
    i as (select *, unnest(range(0, 64)) k from p),
    w as (select image_id, patch // 3 * 4 + k // 8 as y, patch % 3 * 4 + k % 8 as x, patch,
      px[(patch // 3 * 2 + k // 8 // 2) * 8 + patch % 3 * 2 + k % 8 // 2 + 1] as v,
      greatest(least(least(k // 8 / 7.0::double, k % 8 / 7.0::double, 1 - k // 8 / 7.0::double,
        1 - k % 8 / 7.0::double), 0.5), 0.01)
      * greatest(least(least(patch // 3 / 2.0::double, patch % 3 / 2.0::double, 1 - patch // 3 / 2.0::double,
        1 - patch % 3 / 2.0::double), 0.5), 0.01) as g from i)
    select image_id, y, x, round(sum(g * v * (patch + 1)) / sum(g), 6) + 0.0 as red,
      round(sum(g * (255 - v) * (patch + 1)) / sum(g), 6) + 0.0 as green, round(sum(g * (v // 2) * (patch + 1)) / sum(g), 6) + 0.0 as blue
    from w group by image_id, y, x""",
)
def stitch_scaled(t):
    """Patches of three channels, each enlarged twofold and scaled by its number, blended into whole images."""
    colours = F.flatten(F.transform("px", lambda p: F.array(p, F.lit(255) - p, F.floor(p / 2).cast("int"))))
    parts = images.patches(images.as_images(views.images8(t), "image_id", colours, 8, 8, 3), "image_id", 4, 2)
    parts = images.resize(parts, "image_id", 8, 8, "nearest", keep=["patch"])
    scaled = parts.withColumn("data", F.transform("data", lambda v: v * (F.col("patch") + 1)))
    whole = images.stitched(scaled, "image_id", 8, 8, 4, 2, channels=3, up=2)
    pixels = whole.select("image_id", "data", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("i"))
    return pixels.select(
        "image_id", F.floor(F.col("i") / 16).alias("y"), (F.col("i") % 16).cast("long").alias("x"),
        *[rounded(F.get("data", F.col("i") * 3 + k)).alias(n) for k, n in enumerate(("red", "green", "blue"))],
    )


@query(
    "tiles",
    f"""with {IMAGES8}, o as (select image_id, px, unnest([0, 2]) as top from images8),
    p as (select *, unnest([0, 2]) as left_px from o), e as (select *, unnest(range(0, 36)) pos from p)
    select image_id, top, left_px, pos, px[(top + pos // 6) * 8 + left_px + pos % 6 + 1]::double as v from e""",
)
def tiles(t):
    """Overlapping tiles; the last one of a row is pinned to the edge."""
    cut = images.tiles(_images(t), "image_id", 6, 2, 7)
    flat = cut.select("image_id", "top", F.col("left").alias("left_px"), F.posexplode("data").alias("pos", "v"))
    return flat.withColumn("pos", F.col("pos").cast("long"))


@query(
    "crop_resize",
    f"""with {IMAGES8}, e as (select image_id, px, unnest(range(0, 9)) pos from images8),
    c as (select *, (1 + pos // 3 * 2) * 8 + 1 + pos % 3 * 2 + 1 as o from e)
    select image_id, pos, round((px[o] + px[o+1] + px[o+8] + px[o+9]) / 4.0::double, 6) as v from c""",
)
def crop_resize(t):
    """Centre crop to 6x6, then an area resize to 3x3."""
    cut = images.center_crop(_images(t), "image_id", 6)
    return _pixel_rows(images.resize(cut, "image_id", 3, 3, "box"))


@query(
    "cubic_resize",
    f"""with {IMAGES8}, {_resize_taps("t", 8, 12)},
    large as (select image_id, {_filtered("px", 8, "t")} as px from images8, t),
    placed as (select *, floor({u_sql(13, "'t'", "image_id")} * 5)::int as top, floor({u_sql(13, "'l'", "image_id")} * 5)::int as lft from large)
    {_pixels("round(px[(top + pos // 8) * 12 + lft + pos % 8 + 1], 6) + 0.0 as v", 64, "placed")}""",
)
def cubic_resize(t):
    """Short-side bicubic resize to 12, then a seeded random crop to 8."""
    large = images.resize_short_side(_images(t), "image_id", 12)
    return _pixel_rows(images.random_crop(large, "image_id", 8, 13))


@query(
    "lowpass_swap",
    f"""with {IMAGES8}, {_resize_taps("d", 8, 4, edge="mirror")}, {_resize_taps("e", 4, 8, edge="mirror")},
    small as (select image_id, px, {_filtered("px", 8, "d")} as sm from images8, d),
    low as (select image_id, px, {_filtered("sm", 4, "e")} as lo from small, e),
    pairs as (select a.image_id, a.px, a.lo, b.lo as ref from low a join low b on b.image_id = a.image_id + 1 - 2 * (a.image_id % 2))
    {_pixels("round(px[pos + 1] - lo[pos + 1] + ref[pos + 1], 6) + 0.0 as v", 64, "pairs")}""",
)
def lowpass_swap(t):
    """Low frequencies of every image replaced by those of its neighbour; one without a neighbour is left out."""
    source = _images(t)
    reference = source.select((F.col("image_id") + 1 - 2 * (F.col("image_id") % 2)).alias("image_id"), "data")
    return _pixel_rows(images.lowpass_swap(source, reference, "image_id", 2))


@query(
    "ssim",
    f"""with {IMAGES8}, {_resize_taps("u", 8, 16)}, {_resize_taps("d", 16, 8, "linear")}, {_kernel_taps("g", 16, rasters.gaussian(11, 1.5), "valid")},
    large as (select image_id, {_filtered("px", 8, "u")} as a from images8, u),
    half as (select image_id, a, {_filtered("a", 16, "d")} as sm from large, d),
    pair as (select image_id, a, {_filtered("sm", 8, "u")} as b from half, u),
    products as (select *, list_transform(range(1, 257), lambda i: a[i] * a[i]) as aa, list_transform(range(1, 257), lambda i: b[i] * b[i]) as bb,
      list_transform(range(1, 257), lambda i: a[i] * b[i]) as ab from pair),
    maps as (select image_id, {_filtered("a", 16, "g")} as ma, {_filtered("b", 16, "g")} as mb, {_filtered("aa", 16, "g")} as mp,
      {_filtered("bb", 16, "g")} as mq, {_filtered("ab", 16, "g")} as mr from products, g)
    select image_id, round({_added("""list_transform(range(1, 37), lambda i:
      (2 * ma[i] * mb[i] + 6.5025::double) / (ma[i] * ma[i] + mb[i] * mb[i] + 6.5025::double)
      * (2 * (mr[i] - ma[i] * mb[i]) + 58.5225::double) / (mp[i] - ma[i] * ma[i] + (mq[i] - mb[i] * mb[i]) + 58.5225::double))""")} / 36, 6) + 0.0 as ssim
    from maps""",
)
def ssim(t):
    """Structural similarity of each enlarged image and its blurred copy."""
    large = images.resize(_images(t), "image_id", 16, 16)
    small = images.halved(large.withColumn("__kept", F.col("data")), "image_id", 1, keep=["__kept"])
    pairs = images.resize(small, "image_id", 16, 16, keep=["__kept"])
    pairs = pairs.withColumnsRenamed({"data": "ref", "__kept": "data"})
    return images.ssim(pairs, "image_id").withColumn("ssim", rounded("ssim"))


@query(
    "sr_pairs",
    f"""with {IMAGES8}, {_resize_taps("same", 8, 8)}, {_resize_taps("d", 8, 4)}, {_resize_taps("u", 4, 8)},
    {_kernel_taps("g", 4, rasters.gaussian(7, 0.8))},
    target as (select image_id, {_bytes(_filtered("px", 8, "same"))} as hi, {_bytes(_filtered("px", 8, "d"))} as sm from images8, same, d),
    soft as (select image_id, hi, {_bytes(_filtered("sm", 4, "g"))} as sm from target, g),
    pairs as (select image_id, hi, {_bytes(_filtered("sm", 4, "u"))} as lo from soft, u)
    {_pixels("round(lo[pos + 1] / 127.5::double - 1.0::double, 6) + 0.0 as low, round(hi[pos + 1] / 127.5::double - 1.0::double, 6) + 0.0 as high", 64, "pairs")}""",
)
def sr_pairs(t):
    """Low- and high-resolution training pairs."""
    pairs = images.low_high_pairs(_images(t), "image_id", 4, 8, blur_sigma=0.8)
    flat = pairs.select("image_id", F.posexplode_outer(F.arrays_zip(
        F.col("low.data").alias("a"), F.col("high.data").alias("b"))).alias("pos", "d"))
    return flat.select("image_id", F.col("pos").cast("long").alias("pos"), rounded("d.a").alias("low"), rounded("d.b").alias("high"))


def _near(y: str, x: str, weight: str) -> str:
    """One of four neighbours with its weight, zero beyond an 8x8 image."""
    return f"case when {y} >= 0 and {y} < 8 and {x} >= 0 and {x} < 8 then {weight} * px[({y}) * 8 + {x} + 1] else 0.0::double end"


def _reflected(at: str, n: int) -> str:
    turn = f"((({at}) % {2 * n - 2}) + {2 * n - 2}) % {2 * n - 2}"
    return f"(case when {turn} >= {n} then {2 * n - 2} - {turn} else {turn} end)"


@query(
    "square_crop",
    f"""with {IMAGES8}, b as (select image_id, px, image_id * 5 % 11 - 2 as x0, image_id * 3 % 9 - 1 as y0 from images8),
    e as (select *, least(x0 + 1 + image_id % 6, 8) as x1, least(y0 + 2 + image_id % 4, 8) as y1 from b),
    c as (select image_id, px, greatest(least(x0, 8), 0)::double as x0, greatest(least(y0, 8), 0)::double as y0,
      greatest(x1, 0)::double as x1, greatest(y1, 0)::double as y1 from e),
    s as (select *, greatest(2, trunc(greatest(x1 - x0, y1 - y0) * 1.5)::int) as side from c),
    p as (select *, floor((x0 + x1) / 2 - side / 2.0::double)::int as lft, floor((y0 + y1) / 2 - side / 2.0::double)::int as top from s),
    q as (select *, unnest(range(side * side)) as pos from p)
    select image_id, side, pos, px[{_reflected("top + pos // side", 8)} * 8 + {_reflected("lft + pos % side", 8)} + 1]::double as v from q""",
)
def square_crop(t):
    """Square crops around boxes at and beyond every edge, mirrored."""
    n = F.col("image_id")
    left, top = n * 5 % 11 - 2, n * 3 % 9 - 1
    eight = F.lit(8).cast("long")
    boxed = views.images8(t).withColumn("box", F.array(left, top, F.least(left + 1 + n % 6, eight), F.least(top + 2 + n % 4, eight)))
    source = images.as_images(boxed, "image_id", F.col("px"), 8, 8).join(boxed.select("image_id", "box"), "image_id")
    cut = images.square_crop_around(source, "image_id", "box", 1.5)
    flat = cut.select("image_id", F.col("h").alias("side"), F.posexplode_outer("data").alias("pos", "v"))
    return flat.withColumn("pos", F.col("pos").cast("long"))


@query(
    "align_warp",
    EYES_SQL + f""", {IMAGES8}, s as (select e.image_id, px, box[1] / 16.0::double as l, box[2] / 16.0::double as t, box[3] / 16.0::double as r, box[4] / 16.0::double as b
      from e join images8 i on i.image_id = e.image_id where box[3] > box[1] and box[4] > box[2]),
    k as (select image_id, px, 5.0::double / (r - l) as sx, 4.0::double / (b - t) as sy, l, t from s),
    a as (select *, 1.0::double - sx * l as mx, 3.0::double - sy * t as my from k),
    o as (select *, unnest(range(36)) as pos from a),
    q as (select image_id, px, pos, (sy * (pos % 6 - mx)) / (sx * sy) as x, (sx * (pos // 6 - my)) / (sx * sy) as y from o),
    n as (select *, floor(x)::int as xa, floor(y)::int as ya, x - floor(x) as fx, y - floor(y) as fy from q)
    select image_id, pos, floor(((({_near("ya", "xa", "(1 - fy) * (1 - fx)")}) + ({_near("ya", "xa + 1", "(1 - fy) * fx")}))
      + (({_near("ya + 1", "xa", "fy * (1 - fx)")}) + ({_near("ya + 1", "xa + 1", "fy * fx")}))) * 1000000.0::double + 0.5::double) / 1000000.0::double as v from n""",
)
def align_warp(t):
    """Images warped so that the box of their landmarks meets the target box."""
    placed = views.landmarks(t).select("image_id", boxes.landmark_box("pts", 0, 0, 128, 128).alias("box"))
    solid = placed.filter((F.col("box")[2] > F.col("box")[0]) & (F.col("box")[3] > F.col("box")[1]))
    small = F.transform("box", lambda v: v / F.lit(16.0))
    matrix = solid.select("image_id", boxes.box_affine(small, boxes.target_box(8)).alias("m"))
    moved = images.warp(_images(t).join(matrix, "image_id"), "image_id", "m", 6, 6)
    # many values are halves of the last digit, which the engines' own functions round apart
    flat = moved.select("image_id", F.posexplode_outer("data").alias("pos", "x"))
    return flat.select("image_id", F.col("pos").cast("long").alias("pos"), (F.floor(F.col("x") * 1e6 + 0.5) / 1e6).alias("v"))


@query(
    "segmentation_pairs",
    f"""with {IMAGES8}, {_resize_taps("t", 8, 6)}, {_resize_taps("near", 8, 6, "nearest")},
    labels as (select image_id, px, list_transform(px, lambda p: p // 64) as seg from images8),
    pair as (select image_id, {_filtered("px", 8, "t")} as data, list_transform({_filtered("seg", 8, "near")}, lambda v: v::int) as seg from labels, t, near),
    runs as (select *, len(list_filter(range(1, 37), lambda i: i = 1 or seg[i] <> seg[i - 1])) as n_runs from pair)
    {_pixels("round(data[pos + 1], 6) + 0.0 as v, array_to_string(list_transform(range(3), lambda k: (k = seg[pos + 1])::int), ' ') as hot, n_runs", 36, "runs")}""",
)
def segmentation_pairs(t):
    """Images and their label maps at another size, the labels as runs and one-hot; class 3 is outside the classes."""
    labelled = images.as_images(views.images8(t), "image_id", F.col("px"), 8, 8)
    labelled = labelled.withColumn("label", F.transform("data", lambda p: F.floor(p / 64)))
    pairs = images.segmentation_pairs(labelled, "image_id", "label", 6)
    wide = pairs.withColumn("hot", rasters.runs_one_hot(F.col("runs"), 3))
    pixels = wide.select("image_id", F.size("runs").cast("long").alias("n_runs"), "hot", F.posexplode_outer("data").alias("pos", "v"))
    return pixels.select(
        "image_id", F.col("pos").cast("long").alias("pos"), rounded("v").alias("v"),
        joined(F.slice("hot", F.col("pos") * 3 + 1, F.lit(3))).alias("hot"), "n_runs",
    )
