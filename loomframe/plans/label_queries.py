"""Class labels, unions, pair joins and list filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import paths, scores
from loomframe.operators import filters, labels, sampling
from loomframe.operators.ordering import batches, gathered, numbered
from loomframe.plans import views
from loomframe.plans.registry import emit_rows, joined, query
from loomframe.plans.views import CATEGORIES, DESCRIPTIONS, digest_sql
from loomframe.session import settled


@query(
    "class_index",
    """with c as (select source, row_number() over (order by source) - 1 as class_no
      from (select distinct source from documents))
    select doc_id, source, class_no, n_name as label from documents join c using (source)
    join nation on n_nationkey = class_no""",
)
def class_index(t):
    """Dense class number by name, and its human label (missing is an error)."""
    numbered_docs = labels.with_class_index(t.documents.select("doc_id", "source"), "source")
    names = t.nation.select(
        F.col("n_nationkey").cast("long").alias("class_no"), F.col("n_name").alias("label")
    )
    return labels.lookup_or_fail(numbered_docs, names, "class_no", "label", "label").select(
        "doc_id", "source", "class_no", "label"
    )


@query(
    "suffix_index",
    """select source, row_number() over (order by cast(substr(source, 4) as int)) - 1 as class_no
    from (select distinct source from documents)""",
)
def suffix_index(t):
    rank = labels.numeric_suffix("source")
    return labels.class_index(t.documents, "source", rank=rank)


@query(
    "distinct_classes",
    "select source, count(*) as n from documents group by source order by source",
)
def distinct_classes(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")


CONCAT = """parts as (
  select 0::bigint as class, c_custkey as key, c_name as name from customer
  union all select 1, s_suppkey, s_name from supplier)"""


@query(
    "concat_index",
    f"""with {CONCAT} select class, key, name,
      row_number() over (order by class, key) - 1 as global_index,
      row_number() over (partition by class order by key) - 1 as local_index from parts""",
)
def concat_index(t):
    union = labels.tagged_union(
        [
            t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")),
            t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")),
        ]
    )
    return labels.concat_positions(union, "class", "key").select(
        "class", "key", "name", "global_index", "local_index"
    )


@query(
    "pair_join_siblings",
    """select doc_id, quality, toxic, 'img/' || doc_id || '.jpg' as image,
      'seg/' || doc_id || '.png' as mask from documents join labels using (doc_id)""",
)
def pair_join_siblings(t):
    """Images and their mask files, paired by file stem."""
    images = t.documents.select(
        "doc_id", F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image")
    )
    masks = t.labels.select(
        F.concat(F.lit("seg/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("mask"),
        "quality", "toxic",
    )
    return labels.sibling_join(images, masks, paths.stem("image"), paths.stem("mask")).select(
        "doc_id", "quality", "toxic", "image", "mask"
    )


CAPTIONS = """captions as (
  select conv_id image_id, turn caption_id, text caption from conversations)"""


def _captions(t):
    return t.conversations.select(
        F.col("conv_id").alias("image_id"), F.col("turn").alias("caption_id"),
        F.col("text").alias("caption"),
    )


@query(
    "captions_pick",
    f"""with {CAPTIONS}, {DESCRIPTIONS}, r as (select *, row_number() over (partition by image_id
      order by {digest_sql(9, 'image_id', 'caption_id')}, caption_id) rn from captions)
    select image_id, file_name, caption_id, caption from r join descriptions using (image_id)
    where rn = 1""",
)
def captions_pick(t):
    """One random caption per image."""
    picked = sampling.one_per_group(_captions(t), ["image_id"], "caption_id", 9)
    return picked.join(views.descriptions(t).select("image_id", "file_name"), "image_id").select(
        "image_id", "file_name", "caption_id", "caption"
    )


def _neighbours():
    """Pairs of consecutive captions of an image, the last one with none."""
    last = None

    def step(row):
        nonlocal last
        if last is not None:
            yield last["image_id"], last["caption_id"], None if row is None else row["caption_id"]
        last = row

    return step


@query(
    "caption_neighbours",
    f"""with {CAPTIONS} select image_id, caption_id, lead(caption_id) over (partition by image_id order by caption_id) as following
    from captions""",
)
def caption_neighbours(t):
    """Every caption with the one that follows it, by a table function over the images' captions."""
    rows = _captions(t).select("image_id", "caption_id")
    return emit_rows(rows, "image_id", "caption_id", _neighbours, "image_id long, caption_id long, following long")


@query(
    "captions_by_image",
    f"""with {CAPTIONS}, p as (select *, (row_number() over (partition by image_id
      order by caption_id) - 1) // 1000 as chunk from captions)
    select image_id, chunk, count(*) as n, string_agg(caption, chr(10) order by caption_id) as captions
    from p group by image_id, chunk""",
)
def captions_by_image(t):
    lists = gathered(_captions(t), ["image_id"], ["caption_id"], F.col("caption"), "items")
    return lists.select(
        "image_id", "chunk", F.size("items").cast("long").alias("n"), joined("items", "\n").alias("captions")
    )


LAST = """written as (
  select l_suppkey style, l_partkey % 200 as content,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) file from lineitem),
entries as (select style, content, max(file) file from written group by style, content)"""


@query(
    "style_content_pairs",
    f"""with {LAST}, placed as (select *, (row_number() over (order by file) - 1) // 64 as batch
      from entries),
    l as (select *, row_number() over (partition by batch order by file) slot from placed),
    r as (select batch, style ref_style, row_number() over (partition by batch
      order by {digest_sql(4, 'file')}, file) slot from placed)
    select l.file, l.batch, l.style, l.content, r.ref_style, e.file as target
    from l join r using (batch, slot) join entries e on e.style = r.ref_style and e.content = l.content""",
)
def style_content_pairs(t):
    """Each image, a reference style drawn in its batch, and the image to produce."""
    written = t.lineitem.select(
        F.col("l_suppkey").alias("style"), (F.col("l_partkey") % 200).alias("content"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("file"),
    )
    last = labels.last_written(
        written.withColumn("pos", F.col("file")), ["style", "content"], ["pos"]
    )
    entries = settled(last.drop("pos"), "entries")
    placed = batches(entries, ["file"], 64)
    pairs = sampling.paired_in_batch(placed, "batch", "file", 4, ["style"])
    target = entries.select(
        F.col("style").alias("ref_style"), "content", F.col("file").alias("target")
    )
    return pairs.join(target, ["ref_style", "content"]).select(
        "file", "batch", "style", "content", "ref_style", "target"
    )


@query(
    "ignore_and_subset",
    """with placed as (select *, row_number() over (order by p_partkey) - 1 as idx from part)
    select p_partkey, p_name, idx from placed
    where p_brand not in (select p_brand from part where p_size = 13 and p_retailprice < 950)
      and p_type in (select p_type from part where p_size = 21)
      and idx in (select s_suppkey * 3 from supplier)""",
)
def ignore_and_subset(t):
    """Ignore list, keep list and stored row numbers together."""
    placed = numbered(t.part, ["p_partkey"], "idx")
    ignored = t.part.filter((F.col("p_size") == 13) & (F.col("p_retailprice") < 950)).select("p_brand").distinct()
    listed = t.part.filter(F.col("p_size") == 21).select("p_type").distinct()
    subset = t.supplier.select((F.col("s_suppkey") * 3).alias("idx"))
    kept = filters.drop_listed(placed, ignored, ["p_brand"])
    kept = filters.keep_listed(kept, listed, ["p_type"])
    return filters.keep_listed(kept, subset, ["idx"]).select("p_partkey", "p_name", "idx")


@query(
    "union_chain",
    """with parts as (select r_regionkey as id, r_name as name, 0 as part from region
      union all select n_nationkey, n_name, 1 from nation)
    select id, arg_max(name, part) as name from parts group by id""",
)
def union_chain(t):
    """Two category lists chained; a later entry replaces an earlier one."""
    things = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    stuff = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return labels.chained_lookup([things, stuff], "id")


@query(
    "key_intersect",
    """select n_regionkey as key, 'both' as side from nation intersect
       select r_regionkey, 'both' from region
       union all select * from (select n_nationkey, 'nation' from nation except
       select r_regionkey, 'nation' from region)""",
)
def key_intersect(t):
    regions = t.region.select(F.col("r_regionkey").alias("key"))
    shared = t.nation.select(F.col("n_regionkey").alias("key")).intersect(regions)
    alone = t.nation.select(F.col("n_nationkey").alias("key")).subtract(regions)
    return shared.withColumn("side", F.lit("both")).unionByName(
        alone.withColumn("side", F.lit("nation"))
    )


@query(
    "labelled_categories",
    f"""with {CATEGORIES} select id, name, super_category from categories where name <> 'NATION_7'""",
)
def labelled_categories(t):
    """Categories without the catch-all one."""
    return views.categories(t).filter(F.col("name") != "NATION_7")


@query(
    "prompts_tiled",
    """select item_id, text, cast(r as bigint) as repeat from benchmark, range(0, 5) x(r)""",
)
def prompts_tiled(t):
    n = t.benchmark.count() * 5
    tiled = labels.tiled(t.benchmark, "item_id", n)
    return tiled.select("item_id", "text", F.col("repeat").cast("long").alias("repeat"))


@query(
    "log_steps",
    """with m as (select max(event_id) top from events)
    select event_id, event_type, value from events, m where event_id % 250 = 0 or event_id = top""",
)
def log_steps(t):
    """Every 250th step and the last one."""
    last = t.events.agg(F.max("event_id")).first()[0]
    step = F.col("event_id")
    return t.events.filter((step % 250 == 0) | (step == last)).select(
        "event_id", "event_type", "value"
    )


@query(
    "first_batches",
    """with b as (select event_id, (row_number() over (order by event_id) - 1) // 100 as batch
       from events) select event_id, batch from b where batch < 7""",
)
def first_batches(t):
    """Rows of the first seven batches of a hundred."""
    placed = batches(t.events.select("event_id"), ["event_id"], 100)
    return placed.filter(F.col("batch") < 7).select("event_id", "batch")


@query(
    "array_extremes",
    f"""with {views.VECTORS} select id, list_position(z, list_max(z)) - 1 as top,
      list_position(z, list_min(z)) - 1 as bottom,
      array_to_string(list_transform(list_sort(list_transform(range(0, len(z)),
        lambda i: {{'v': -z[i+1], 'i': i}}))[1:5], lambda s: s.i), ' ') as top_five from vectors""",
)
def array_extremes(t):
    return views.vectors(t).select(
        "id", scores.arg_max("z").alias("top"), scores.arg_min("z").alias("bottom"),
        joined(scores.top_indices("z", 5)).alias("top_five"),
    )


@query(
    "latest_by_name",
    """select 'run_' || cast(max(cast(substr(source, 4) as int)) as varchar) as latest from documents""",
)
def latest_by_name(t):
    """Newest name in natural order (``run_10`` after ``run_9``)."""
    names = t.documents.select(F.replace("source", F.lit("src"), F.lit("run_")).alias("latest"))
    return labels.latest_by_name(names.distinct(), "latest")
