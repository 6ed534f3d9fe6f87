"""Box annotations, crops and object sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import boxes, seeded
from loomframe.operators import annotations as ann
from loomframe.operators import filters, labels
from loomframe.operators.ordering import gathered
from loomframe.plans import views
from loomframe.plans.registry import joined, query, rounded
from loomframe.plans.views import (
    ANNOTATIONS,
    CATEGORIES,
    CATEGORY_MAP,
    DESCRIPTIONS,
    digest_sql,
    u_sql,
)



def _flags():
    return {n: F.col(n) for n in boxes.FLAG_BITS}


def _fields(box, digits: int = 9, prefix: str = ""):
    return [rounded(box[c], digits).alias(prefix + c) for c in "xywh"]


# --- categories --------------------------------------------------------------

NUMBERED = """usable as (
  select * from categories where name not like '%9' and id not in (select src from category_map)),
numbers as (
  select id, name, super_category, row_number() over (order by (id = 'c5')::int, id) - 1 as category_no
  from usable)"""


def _numbers(t):
    cats = views.categories(t)
    allow = cats.filter(~F.col("name").endswith("9")).select("name")
    usable = ann.usable_categories(cats, views.category_map(t), allow)
    return usable.join(ann.category_numbers(usable, "c5"), "id")


@query(
    "category_numbers",
    f"with {CATEGORIES}, {CATEGORY_MAP}, {NUMBERED} select id, name, super_category, category_no from numbers",
)
def category_numbers(t):
    return _numbers(t).select("id", "name", "super_category", "category_no")


@query(
    "remap_filter_annotations",
    f"""with {ANNOTATIONS}, {CATEGORIES}, {CATEGORY_MAP}, {NUMBERED},
    moved as (select a.* replace (coalesce(m.dst, a.category_id) as category_id)
      from annotations a left join category_map m on a.category_id = m.src
      where a.w * a.h > 0.01::double)
    select ann_id, image_id, category_id, name, round(w * h, 9) as area
    from moved join usable on category_id = id""",
)
def remap_filter_annotations(t):
    usable = ann.usable_categories(
        views.categories(t), views.category_map(t),
        views.categories(t).filter(~F.col("name").endswith("9")),
    )
    known = ann.known_annotations(views.annotations(t), usable, views.category_map(t), 0.01)
    return known.select(
        "ann_id", "image_id", "category_id", "name",
        rounded(F.col("w") * F.col("h"), 9).alias("area"),
    )


@query(
    "relative_boxes",
    f"""with {ANNOTATIONS}, {DESCRIPTIONS}
    select ann_id, round(x * 512 / width, 9) x, round(y * 512 / height, 9) y,
           round(w * 512 / width, 9) w, round(h * 512 / height, 9) h,
           round((w * 512 / width) * (h * 512 / height), 9) as area
    from annotations join descriptions using (image_id)""",
)
def relative_boxes(t):
    size = F.struct("width", "height").alias("size")
    placed = labels.lookup_or_fail(
        views.annotations(t), views.descriptions(t).select("image_id", size),
        "image_id", "size", "image description",
    )
    pixels = boxes.box(*[F.col(c) * 512 for c in "xywh"])
    box = boxes.relative(pixels, F.col("size.width"), F.col("size.height"))
    out = placed.select("ann_id", box.alias("box"))
    return out.select(
        "ann_id", *_fields(F.col("box")), rounded(boxes.area(F.col("box")), 9).alias("area")
    )


@query(
    "images_with_n_objects",
    f"""with {ANNOTATIONS}, {DESCRIPTIONS}
    select image_id, file_name, n from descriptions join (
      select image_id, count(*) as n from annotations where w * h > 0.01::double
      group by image_id having count(*) between 2 and 6) using (image_id)""",
)
def images_with_n_objects(t):
    large = views.annotations(t).filter(F.col("w") * F.col("h") > 0.01)
    # only the counts are wanted: one partial aggregate, no window
    counts = large.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, 6))
    return views.descriptions(t).join(counts, "image_id").select("image_id", "file_name", "n")


@query(
    "annotations_by_image",
    f"""with {ANNOTATIONS}, p as (select *, row_number() over (partition by image_id order by ann_id) - 1 pos
      from annotations)
    select image_id, pos // 1000 as chunk, count(*) as n,
           string_agg(ann_id || ':' || category_id, ' ' order by pos) as anns
    from p group by image_id, pos // 1000""",
)
def annotations_by_image(t):
    item = F.concat("ann_id", F.lit(":"), "category_id")
    return gathered(views.annotations(t), ["image_id"], ["ann_id"], item, "items").select(
        "image_id", "chunk", F.size("items").cast("long").alias("n"),
        joined("items").alias("anns"),
    )


@query(
    "top_categories",
    f"""with {ANNOTATIONS}, {CATEGORIES}
    select name, count(*) as n from annotations join categories on category_id = id
    group by name order by n desc, name limit 10""",
)
def top_categories(t):
    return ann.top_categories(views.annotations(t), views.categories(t), 10)


@query(
    "corner_boxes",
    f"""with {ANNOTATIONS}, {DESCRIPTIONS}, {CATEGORIES}
    select ann_id, name, round((x + w) - x, 9) as w, round((y + h) - y, 9) as h,
      concat_ws(' ', trunc(x * width)::int, trunc(y * height)::int,
        trunc((x + ((x + w) - x)) * width)::int, trunc((y + ((y + h) - y)) * height)::int) as corners
    from annotations join descriptions using (image_id) join categories on category_id = id""",
)
def corner_boxes(t):
    x, y = F.col("x"), F.col("y")
    cats = views.categories(t).select(F.col("id").alias("category_id"), "name")
    box = boxes.from_corners("x", "y", x + F.col("w"), y + F.col("h"))
    placed = (
        views.annotations(t).join(views.descriptions(t), "image_id").join(cats, "category_id")
        .select("ann_id", "name", "width", "height", box.alias("box"))
    )
    corners = boxes.pixel_corners(F.col("box"), "width", "height")
    return placed.select(
        "ann_id", "name", rounded("box.w", 9).alias("w"), rounded("box.h", 9).alias("h"),
        joined(corners).alias("corners"),
    )


# --- crops -------------------------------------------------------------------

CENTER = """crops as (
  select image_id, width, height,
    case when width > height then 0.5 - height / width::double / 2 else 0.0 end::double cx,
    case when width > height then 0.0 else 0.5 - width / height::double / 2 end::double cy,
    case when width > height then height / width::double else 1.0 end::double cw,
    case when width > height then 1.0 else width / height::double end::double ch
  from descriptions)"""


@query(
    "center_crop_boxes",
    f"""with {DESCRIPTIONS}, {CENTER}, r as (
      select *, least(width, height) short,
        case when least(width, height) <= 96 then least(width, height)
          else 96 + cast(floor({u_sql(5, "'s'", "image_id")} * (least(width, height) - 96 + 1)) as int)
        end as size from crops),
    p as (select *, cast(floor({u_sql(5, "'t'", "image_id")} * (height - size + 1)) as int) as top_px,
        cast(floor({u_sql(5, "'l'", "image_id")} * (width - size + 1)) as int) as left_px,
        floor({u_sql(6, "'l'", "image_id")} * (width - 48 + 1)) / width as fx,
        floor({u_sql(6, "'t'", "image_id")} * (height - 32 + 1)) / height as fy from r)
    select image_id, round(cx, 9) x, round(cy, 9) y, round(cw, 9) w, round(ch, 9) h,
      round(left_px / width, 9) as sq_x, round(top_px / height, 9) as sq_y,
      round(size / width, 9) as sq_w, round(size / height, 9) as sq_h,
      round(fx, 9) as fx_x, round(fy, 9) as fx_y, round(48 / width, 9) as fx_w, round(32 / height, 9) as fx_h
    from p""",
)
def center_crop_boxes(t):
    placed = views.descriptions(t).select(
        "image_id",
        boxes.center_crop("width", "height").alias("center"),
        boxes.random_square_crop("width", "height", 96, 5, "image_id").alias("square"),
        boxes.random_crop("width", "height", 48, 32, 6, "image_id").alias("fixed"),
    )
    return placed.select(
        "image_id", *_fields(F.col("center")), *_fields(F.col("square"), prefix="sq_"),
        *_fields(F.col("fixed"), prefix="fx_"),
    )


@query(
    "crop_overlap",
    f"""with {ANNOTATIONS}, {DESCRIPTIONS}, {CENTER}, o as (
      select *, greatest(least(x + w, cx + cw) - greatest(x, cx), 0)
              * greatest(least(y + h, cy + ch) - greatest(y, cy), 0) as overlap
      from annotations join crops using (image_id)),
    r as (select *, greatest(least((x - cx) / cw, 1.0::double), 0.0::double) rx,
        greatest(least((y - cy) / ch, 1.0::double), 0.0::double) ry from o where overlap > 0),
    s as (select *, least(w / cw, 1 - rx) rw, least(h / ch, 1 - ry) rh from r)
    select ann_id, overlap, round(1 - (rx + rw), 12) as x, round(ry, 12) as y,
           round(rw, 12) as w, round(rh, 12) as h, round(1 - (x + w), 12) as flipped_x
    from s""",
)
def crop_overlap(t):
    crops = views.descriptions(t).select(
        "image_id", boxes.center_crop("width", "height").alias("crop")
    )
    joined_boxes = views.boxed_annotations(t).join(crops, "image_id")
    overlap = boxes.overlap_area(F.col("box"), F.col("crop"))
    seen = joined_boxes.withColumn("overlap", overlap).filter(F.col("overlap") > 0)
    inner = boxes.in_crop(F.col("box"), F.col("crop"), F.lit(True))
    moved = seen.select(
        "ann_id", "overlap", inner.alias("inner"), boxes.flipped(F.col("box")).alias("mirror")
    )
    return moved.select(
        "ann_id", "overlap", *_fields(F.col("inner"), 12),
        rounded("mirror.x", 12).alias("flipped_x"),
    )


# --- tokens and packed labels ------------------------------------------------


def _token(x: str, y: str, side: int) -> str:
    return (
        f"(round_even(({y}) * {side - 1}, 0)::int * {side} + round_even(({x}) * {side - 1}, 0)::int)"
    )


BOX_TOKENS = f"""tokens as (
  select ann_id, {_token('x + w / 2', 'y + h / 2', 16)} as center,
    {_token('x', 'y', 16)} as first, {_token('x + w', 'y + h', 16)} as last from annotations)"""


def _box_tokens(t):
    box = F.col("box")
    pair = boxes.box_tokens(box, 256)
    center = boxes.point_token(box["x"] + box["w"] / 2, box["y"] + box["h"] / 2, 256)
    return views.boxed_annotations(t).select(
        "ann_id", center.alias("center"), pair[0].alias("first"), pair[1].alias("last")
    )


@query(
    "box_tokens",
    f"with {ANNOTATIONS}, {BOX_TOKENS} select ann_id, center, first, last from tokens",
)
def box_tokens(t):
    return _box_tokens(t)


@query(
    "box_untoken",
    f"""with {ANNOTATIONS}, {BOX_TOKENS}
    select ann_id, round(center % 16 / 15.0::double, 9) as cx, round(center // 16 / 15.0::double, 9) as cy,
      round(first % 16 / 15.0::double, 9) as x, round(first // 16 / 15.0::double, 9) as y,
      round(last % 16 / 15.0::double - first % 16 / 15.0::double, 9) + 0.0 as w,
      round(last // 16 / 15.0::double - first // 16 / 15.0::double, 9) + 0.0 as h from tokens""",
)
def box_untoken(t):
    decoded = _box_tokens(t).select(
        "ann_id", boxes.token_point("center", 256).alias("p"),
        boxes.tokens_box(F.col("first"), F.col("last"), 256).alias("b"),
    )
    return decoded.select(
        "ann_id", rounded("p.x", 9).alias("cx"), rounded("p.y", 9).alias("cy"),
        *_fields(F.col("b")),
    )


PACKED = """packed as (
  select ann_id, cast(substr(category_id, 2) as int) + 25 * ((is_group_of::int) | (2 * is_occluded::int)
    | (4 * is_depiction::int) | (8 * is_inside::int)) as label,
    is_group_of, is_occluded, is_depiction, is_inside from annotations)"""


def _packed(t):
    number = F.substring("category_id", 2, 9).cast("int")
    return views.annotations(t).withColumn("label", boxes.pack_label(number, _flags(), 25))


@query(
    "flag_pack",
    f"""with {ANNOTATIONS}, {PACKED}, w as (select *, concat_ws(',',
        case when is_group_of then 'group' end, case when is_occluded then 'occluded' end,
        case when is_depiction then 'depiction' end, case when is_inside then 'inside' end) as words,
        concat_ws(',', case when is_group_of then 'g' end, case when is_occluded then 'o' end,
        case when is_depiction then 'd' end, case when is_inside then 'i' end) as letters from packed)
    select ann_id, label, case when letters = '' then '' else '(' || letters || ')' end as short,
      case when words = '' then '' else '(' || words || ')' end as long_text from w""",
)
def flag_pack(t):
    return _packed(t).select(
        "ann_id", "label", boxes.flag_text(_flags()).alias("short"),
        boxes.flag_text(_flags(), short=False).alias("long_text"),
    )


@query(
    "flag_unpack",
    f"""with {ANNOTATIONS}, {PACKED} select ann_id, label % 25 as category_no,
      is_group_of, is_occluded, is_depiction, is_inside from packed""",
)
def flag_unpack(t):
    parts = boxes.unpack_label("label", 25)
    return _packed(t).select("ann_id", *[c.alias(n) for n, c in parts.items()])


# --- sequences ---------------------------------------------------------------

CENTERS = boxes.SequenceSpec(classes=25, max_objects=8, tokens=1024, encode_crop=True)
CROPPED = boxes.SequenceSpec(classes=25, max_objects=8, tokens=1024, encode_crop=False, per_object=3)


def _sequences(t, spec):
    crops = views.descriptions(t).select(
        "image_id",
        boxes.center_crop("width", "height").alias("crop"),
        seeded.coin(11, 0.5, "image_id").alias("flip"),
    )
    return ann.object_sequences(
        _packed(t).select("image_id", "ann_id", "label", *"xywh"), crops, spec, 3, F.col("label")
    )


def _sequence_sql(crop_encoded: bool) -> str:
    """Forward build, one row per image with list ``sequence``."""
    fx, fy, fw, fh = ("0", "0", "1", "1") if crop_encoded else ("cx", "cy", "cw", "ch")
    if crop_encoded:
        per = f"[label, {_token('fx + rw / 2', 'ry + rh / 2', 32)}]"
        width = 2
        tail = (
            f"[{_token('case when flip then 1 - (cx + cw) else cx end', 'cy', 32)}, "
            f"{_token('case when flip then 1 - (cx + cw) + cw else cx + cw end', 'cy + ch', 32)}]"
        )
    else:
        per = f"[label, {_token('fx', 'ry', 32)}, {_token('fx + rw', 'ry + rh', 32)}]"
        width, tail = 3, "[]::int[]"
    return f"""with {ANNOTATIONS}, {DESCRIPTIONS}, {CENTER},
    flips as (select *, {u_sql(11, "image_id")} < 0.5 as flip from crops),
    capped as (select * from (select a.*, row_number() over (partition by image_id order by ann_id) rn
      from annotations a) where rn <= 8),
    labelled as (select *, cast(substr(category_id, 2) as int) + 25 * ((is_group_of::int)
      | (2 * is_occluded::int) | (4 * is_depiction::int) | (8 * is_inside::int)) as label,
      {digest_sql(3, "ann_id")} d from capped join flips using (image_id)),
    seen as (select *, (greatest(least(x + w, cx + cw) - greatest(x, cx), 0)
        * greatest(least(y + h, cy + ch) - greatest(y, cy), 0)) > 0 as visible from labelled),
    r as (select *, greatest(least((x - {fx}) / {fw}, 1.0::double), 0.0::double) rx,
      greatest(least((y - {fy}) / {fh}, 1.0::double), 0.0::double) ry from seen),
    s as (select *, least(w / {fw}, 1 - rx) rw, least(h / {fh}, 1 - ry) rh from r),
    f as (select *, case when flip then 1 - (rx + rw) else rx end fx from s),
    grouped as (select image_id, any_value(cx) cx, any_value(cy) cy, any_value(cw) cw,
      any_value(ch) ch, any_value(flip) flip,
      coalesce(flatten(list({per} order by d) filter (where visible)), []) body
      from f group by image_id),
    sequences as (select image_id, list_concat(list_concat(body,
      list_transform(range(0, 8 * {width} - len(body)), lambda i: 1023)), {tail}) as sequence
      from grouped)"""


@query(
    "center_sequence",
    _sequence_sql(True)
    + " select image_id, array_to_string(sequence, ' ') as sequence from sequences",
)
def center_sequence(t):
    return _sequences(t, CENTERS).select("image_id", joined("sequence").alias("sequence"))


@query(
    "box_sequence",
    _sequence_sql(False)
    + " select image_id, array_to_string(sequence, ' ') as sequence from sequences",
)
def box_sequence(t):
    return _sequences(t, CROPPED).select("image_id", joined("sequence").alias("sequence"))


@query(
    "inverse_sequence",
    _sequence_sql(True)
    + """, places as (select image_id, sequence, unnest(range(0, 8)) i from sequences)
    select image_id, i as pos, sequence[2*i+1]::int as label,
      round(sequence[2*i+2] % 32 / 31.0::double, 9) as x,
      round(sequence[2*i+2] // 32 / 31.0::double, 9) as y,
      round(sequence[-2] % 32 / 31.0::double, 9) as crop_x,
      round(sequence[-1] // 32 / 31.0::double - sequence[-2] // 32 / 31.0::double, 9) as crop_h
    from places where sequence[2*i+1] <> 1023""",
)
def inverse_sequence(t):
    crop = boxes.sequence_crop("sequence", CENTERS)
    found = _sequences(t, CENTERS).select(
        "image_id", crop.alias("crop"),
        F.posexplode(boxes.sequence_objects("sequence", CENTERS)).alias("pos", "o"),
    )
    return found.select(
        "image_id", F.col("pos").cast("long").alias("pos"), F.col("o.label").alias("label"),
        rounded("o.place.x", 9).alias("x"), rounded("o.place.y", 9).alias("y"),
        rounded("crop.x", 9).alias("crop_x"), rounded("crop.h", 9).alias("crop_h"),
    )


@query(
    "patch_crop_tokens",
    f"""with {DESCRIPTIONS}, p as (select image_id, unnest(range(0, 9)) as patch, width, height
      from descriptions),
    b as (select *, patch % 3 * 8 / width::double l, patch // 3 * 8 / height::double t,
      16 / width::double w, 16 / height::double h from p)
    select image_id, patch, {_token('l', 't', 32)} as first, {_token('l + w', 't + h', 32)} as last
    from b""",
)
def patch_crop_tokens(t):
    patches = views.descriptions(t).select(
        "image_id", F.explode(boxes.patch_boxes(16, 16, 8, 4, 2, "width", "height")).alias("p")
    )
    pair = boxes.box_tokens(F.col("p.box"), 1024)
    return patches.select(
        "image_id", F.col("p.patch").cast("long").alias("patch"),
        pair[0].alias("first"), pair[1].alias("last"),
    )


@query(
    "patch_sequences",
    _sequence_sql(True)
    + f""", p as (select s.image_id, sequence, unnest(range(0, 9)) as patch, width, height
      from sequences s join descriptions d on d.image_id = s.image_id),
    b as (select *, patch % 3 * 8 / width::double l, patch // 3 * 8 / height::double t,
      16 / width::double w, 16 / height::double h from p)
    select image_id, patch, array_to_string(list_concat(sequence[:-3], [{_token('l', 't', 32)}, {_token('l + w', 't + h', 32)}]), ' ') as sequence
    from b""",
)
def patch_sequences(t):
    """The sequence of each image once for every patch, with the patch in place of the crop."""
    grid = boxes.patch_boxes(16, 16, 8, 4, 2, "width", "height")
    sized = _sequences(t, CENTERS).select("image_id", "sequence").join(
        views.descriptions(t).select("image_id", "width", "height"), "image_id"
    )
    each = sized.select("image_id", "sequence", F.explode(grid).alias("p"))
    return each.select(
        "image_id", F.col("p.patch").cast("long").alias("patch"),
        joined(boxes.with_patch("sequence", F.col("p.box"), CENTERS)).alias("sequence"),
    )


# --- landmarks ---------------------------------------------------------------

EYES_SQL = f"""with {views.LANDMARKS}, e as (
  select image_id, pts,
    trunc(list_sum(list_transform(pts[2:7], lambda p: p.x)) / 6)::int lx,
    trunc(list_sum(list_transform(pts[2:7], lambda p: p.y)) / 6)::int ly,
    trunc(list_sum(list_transform(pts[8:13], lambda p: p.x)) / 6)::int rx,
    trunc(list_sum(list_transform(pts[8:13], lambda p: p.y)) / 6)::int ry,
    [trunc(least(greatest(list_min(list_transform(pts, lambda p: p.x)), 0), 128))::int,
     trunc(least(greatest(list_min(list_transform(pts, lambda p: p.y)), 0), 128))::int,
     trunc(least(greatest(list_max(list_transform(pts, lambda p: p.x)), 0), 128))::int,
     trunc(least(greatest(list_max(list_transform(pts, lambda p: p.y)), 0), 128))::int] box
  from landmarks),
g as (select *, sqrt(((rx-lx)*(rx-lx) + (ry-ly)*(ry-ly))::double) dist,
    radians(degrees(atan2((ry-ly)::double, (rx-lx)::double)) - 180.0) ang,
    floor((lx+rx)/2)::double mx, floor((ly+ry)/2)::double my from e),
m as (select *, dist >= 128 * 0.05::double as ok, (1 - 2 * 0.37::double) * 128 / dist * cos(ang) a,
    (1 - 2 * 0.37::double) * 128 / dist * sin(ang) b from g)"""


@query(
    "landmark_align",
    EYES_SQL
    + """ select image_id, array_to_string(box, ' ') as box,
      round(72.0::double / (box[3] - box[1]), 6) as scale_x,
      round(28.0::double - 72.0::double / (box[3] - box[1]) * box[1], 6) as shift_x,
      round(67.0::double / (box[4] - box[2]), 6) as scale_y,
      round(48.0::double - 67.0::double / (box[4] - box[2]) * box[2], 6) as shift_y,
      case when ok then round(a, 6) + 0.0 end as eye_a, case when ok then round(b, 6) + 0.0 end as eye_b,
      case when ok then round((1 - a) * mx - b * my + (64.0 - mx), 6) + 0.0 end as eye_x,
      case when ok then round(b * mx + (1 - a) * my + (128 * 0.45::double - my), 6) + 0.0 end as eye_y
    from m where box[3] > box[1] and box[4] > box[2]""",
)
def landmark_align(t):
    placed = views.landmarks(t).withColumn("box", boxes.landmark_box("pts", 0, 0, 128, 128))
    solid = placed.filter((F.col("box")[2] > F.col("box")[0]) & (F.col("box")[3] > F.col("box")[1]))
    eye = boxes.eye_affine(
        "pts", (1, 7), (7, 13), F.lit(128), F.lit(128), 128, (0.37, 0.45), min_ratio=0.05
    )
    found = solid.select(
        "image_id", "box", boxes.box_affine("box", boxes.target_box(128)).alias("m"),
        eye.alias("eye"),
    )
    return found.select(
        "image_id", joined("box").alias("box"),
        *[rounded(F.col("m")[i]).alias(n) for n, i in
          (("scale_x", 0), ("shift_x", 2), ("scale_y", 4), ("shift_y", 5))],
        *[rounded(F.col("eye")[i]).alias(n) for n, i in
          (("eye_a", 0), ("eye_b", 1), ("eye_x", 2), ("eye_y", 5))],
    )


@query(
    "size_filter_modes",
    f"""with {DESCRIPTIONS} select image_id, least(width, height) >= 256 as all_ge,
      least(width, height) > 256 as all_gt, greatest(width, height) > 256 as any_gt,
      greatest(width, height) >= 256 as any_ge from descriptions""",
)
def size_filter_modes(t):
    return views.descriptions(t).select(
        "image_id",
        *[filters.large_enough("width", "height", 256, m).alias(m) for m in filters.SIZE_MODES],
    )
