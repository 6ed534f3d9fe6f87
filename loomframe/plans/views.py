"""Image-text shaped views of the given tables, with their SQL twins as CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions import arrays
from loomframe.operators.annotations import box_of
from loomframe.plans.registry import Tables

# Accented Latin letters play script A, ASCII letters script B.
A = "à-ÿß"
B = "A-Za-z"
WS = r"\t-\r\x1c-\x20\x85\p{Z}"


def tagged_docs(t: Tables, spread: bool = False) -> DataFrame:
    docs = t.spread("documents", "doc_id") if spread else t.documents
    return docs.select(
        "doc_id", "lang", "source", F.col("text").alias("remark"),
        F.replace("text", F.lit(" "), F.lit(",")).alias("keywords"),
    )


TAGGED = """tagged_docs as (
  select doc_id, lang, source, text as remark, replace(text, ' ', ',') as keywords
  from documents)"""


def categories(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("c"), "n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("super_category"),
    )


CATEGORIES = """categories as (
  select concat('c', n_nationkey) id, n_name as name, r_name as super_category
  from nation join region on n_regionkey = r_regionkey)"""


def category_map(t: Tables) -> DataFrame:
    # A literal relation, so the planner knows that it is tiny.
    return t.spark.sql(
        "select * from values ('c3', 'c1'), ('c7', 'c2'), ('c11', 'c4') as m(src, dst)"
    )


CATEGORY_MAP = """category_map as (
  select * from (values ('c3','c1'), ('c7','c2'), ('c11','c4')) m(src, dst))"""


def descriptions(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("image_id"),
        F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit(".jpg")).alias(
            "file_name"
        ),
        (F.lit(64) + (F.col("o_custkey") * 7) % 449).cast("int").alias("width"),
        (F.lit(64) + (F.col("o_orderkey") * 13) % 449).cast("int").alias("height"),
    )


DESCRIPTIONS = """descriptions as (
  select o_orderkey image_id, lpad(cast(o_orderkey as varchar), 12, '0') || '.jpg' file_name,
         cast(64 + (o_custkey * 7) % 449 as int) width,
         cast(64 + (o_orderkey * 13) % 449 as int) height
  from orders)"""


def annotations(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ann_id"),
        F.col("l_orderkey").alias("image_id"),
        F.concat(F.lit("c"), F.col("l_suppkey") % 25).alias("category_id"),
        (((F.col("l_partkey") * 37) % 800) / F.lit(1000.0)).alias("x"),
        (((F.col("l_partkey") * 53) % 800) / F.lit(1000.0)).alias("y"),
        (F.lit(0.02) + F.lit(0.0035) * F.col("l_quantity")).alias("w"),
        (F.lit(0.02) + F.lit(1.7) * F.col("l_discount")).alias("h"),
        (F.col("l_returnflag") == "R").alias("is_group_of"),
        (F.col("l_linestatus") == "O").alias("is_occluded"),
        (F.col("l_tax") > 0.04).alias("is_depiction"),
        (F.col("l_quantity") > 40).alias("is_inside"),
    )


ANNOTATIONS = """annotations as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) ann_id,
         l_orderkey image_id, concat('c', l_suppkey % 25) category_id,
         ((l_partkey * 37) % 800) / 1000.0::double x, ((l_partkey * 53) % 800) / 1000.0::double y,
         0.02::double + 0.0035::double * l_quantity w, 0.02::double + 1.7::double * l_discount h,
         l_returnflag = 'R' is_group_of, l_linestatus = 'O' is_occluded,
         l_tax > 0.04::double is_depiction, l_quantity > 40 is_inside
  from lineitem)"""


def boxed_annotations(t: Tables) -> DataFrame:
    return annotations(t).withColumn("box", box_of())


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"),
        arrays.doubles("embedding").alias("z"),
    )


VECTORS = """vectors as (
  select vec_id id, cast(label as bigint) as label, cast(embedding as double[]) z from embeddings)"""


def codebook(t: Tables, codes: int = 16) -> DataFrame:
    """The codes: the first vectors of the table serve as a codebook."""
    return t.embeddings.filter(F.col("vec_id") < codes).select(
        F.col("vec_id").alias("code"), arrays.doubles("embedding").alias("e")
    )


CODEBOOK = """codebook as (
  select vec_id code, cast(embedding as double[]) e from embeddings where vec_id < 16)"""

# Squared distance of every vector to every code, and the nearest code.
NEAREST = """distances as (
  select v.id, v.label, c.code,
         list_sum(list_transform(list_zip(v.z, c.e), lambda p: (p[1]-p[2])*(p[1]-p[2]))) dist
  from vectors v, codebook c),
nearest as (
  select id, label, arg_min(code, {'d': dist, 'c': code}) code, min(dist) dist
  from distances group by id, label)"""


def predictions(t: Tables) -> DataFrame:
    return t.embeddings.select(
        "vec_id", F.col("label").cast("long").alias("label"),
        arrays.doubles(F.slice("embedding", 1, 10)).alias("logits"),
        (F.col("vec_id") % 5).alias("step"),
    )


PREDICTIONS = """predictions as (
  select vec_id, cast(label as bigint) as label, cast(embedding[1:10] as double[]) logits,
         vec_id % 5 as step from embeddings)"""


def images8(t: Tables, spread: bool = False) -> DataFrame:
    byte = lambda v: F.least(
        F.lit(255.0), F.greatest(F.lit(0.0), F.rint((v.cast("double") + 0.5) * 255.0))
    ).cast("int")
    rows = t.spread("embeddings", "vec_id") if spread else t.embeddings
    return rows.select(
        F.col("vec_id").alias("image_id"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.transform("embedding", byte).alias("px"),
    )


IMAGES8 = """images8 as (
  select vec_id image_id, list_transform(embedding, lambda v: cast(least(255::double,
    greatest(0::double, round_even((cast(v as double) + 0.5::double) * 255, 0))) as int)) px
  from embeddings)"""


def landmarks(t: Tables) -> DataFrame:
    z = arrays.doubles("embedding")
    point = lambda i: F.struct(
        (F.lit(64.0) + 100.0 * F.get(z, i * 2)).alias("x"),
        (F.lit(64.0) + 100.0 * F.get(z, i * 2 + 1)).alias("y"),
    )
    return t.embeddings.select(
        F.col("vec_id").alias("image_id"),
        F.transform(F.sequence(F.lit(0), F.lit(31)), point).alias("pts"),
    )


LANDMARKS = """landmarks as (
  select vec_id image_id, list_transform(range(0, 32), lambda i:
    {'x': 64.0::double + 100.0::double * cast(embedding[2*i+1] as double),
     'y': 64.0::double + 100.0::double * cast(embedding[2*i+2] as double)}) pts
  from embeddings)"""


def u_sql(seed: int, *ids: str) -> str:
    """SQL twin of :func:`loomframe.functions.seeded.uniform`."""
    inner = ", ".join([f"'{seed}'", *[f"cast({i} as varchar)" for i in ids]])
    return f"(('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::bigint / 4294967296.0::double)"


def digest_sql(seed: int, *ids: str) -> str:
    inner = ", ".join([f"'{seed}'", *[f"cast({i} as varchar)" for i in ids]])
    return f"md5(concat_ws('|', {inner}))"


def normal_sql(seed: int, *ids: str) -> str:
    """SQL twin of :func:`loomframe.functions.seeded.normal`."""
    radius, angle = u_sql(seed, "'r'", *ids), u_sql(seed, "'a'", *ids)
    return f"(sqrt(-2.0::double * ln(1.0::double - {radius})) * cos(2 * pi() * {angle}))"


def strip_sql(expression: str) -> str:
    return f"regexp_replace({expression}, '^[{WS}]+|[{WS}]+$', '', 'g')"
