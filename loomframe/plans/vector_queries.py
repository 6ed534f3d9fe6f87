"""Codebooks, schedules, similarity and array functions on vector tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import arrays, scores
from loomframe.operators import schedule as sch
from loomframe.operators import matching
from loomframe.operators import vectors as vec
from loomframe.operators.ordering import numbered
from loomframe.plans import views
from loomframe.plans.registry import joined, query, rounded
from loomframe.plans.views import (
    CODEBOOK,
    IMAGES8,
    NEAREST,
    VECTORS,
    digest_sql,
    normal_sql,
    u_sql,
)
from loomframe.session import materialise, settled

STEPS = 1000


def _nearest(t, keep=False):
    return matching.nearest_code(views.vectors(t), views.codebook(t), keep_vector=keep)


def _spelled(df, column: str, keys: list[str], name: str = "v"):
    """Array elements as rows, rounded."""
    flat = df.select(*keys, F.posexplode(column).alias("pos", "x"))
    return flat.select(*keys, F.col("pos").cast("long").alias("pos"), rounded("x").alias(name))


def _spell_sql(cte: str, source: str, expression: str, keys: str = "id", length: int = 64) -> str:
    return (
        f"with {cte}, f as (select {keys}, {expression} a from {source}), "
        f"e as (select {keys}, a, unnest(range(0, len(a))) pos from f) "
        f"select {keys}, pos, round(a[pos + 1], 6) + 0.0 as v from e"
    )


# --- codebooks ---------------------------------------------------------------


@query(
    "nearest_code",
    f"with {VECTORS}, {CODEBOOK}, {NEAREST} select id, code, round(dist, 6) as dist from nearest",
)
def nearest_code(t):
    return _nearest(t).select("id", "code", rounded("dist").alias("dist"))


@query(
    "code_usage",
    f"""with {VECTORS}, {CODEBOOK}, {NEAREST}, u as (select code, count(*) n from nearest group by code),
    p as (select code, n, n / sum(n) over () share from u)
    select code, n, round(share, 6) as share,
      round((select exp(-sum(share * ln(share + 1e-10::double))) from p), 6) as perplexity,
      (select count(*) from p where share > 0) as used from p""",
)
def code_usage(t):
    usage = vec.with_perplexity(vec.code_usage(_nearest(t)))
    return usage.select(
        "code", "n", rounded("share").alias("share"), rounded("perplexity").alias("perplexity"), "used"
    )


@query(
    "quantiser_loss",
    f"""with {VECTORS}, {CODEBOOK}, {NEAREST}, m as (select sum(dist) / (count(*) * 64) mse from nearest)
    select round(mse, 6) as mse, round((1 + 0.25::double) * mse, 6) as loss,
      round(0.25::double * mse, 6) as moving_loss from m""",
)
def quantiser_loss(t):
    mse = F.sum("dist") / (F.count(F.lit(1)) * 64)
    return _nearest(t).agg(mse.alias("m")).select(
        rounded("m").alias("mse"), rounded(F.col("m") * 1.25).alias("loss"),
        rounded(F.col("m") * 0.25).alias("moving_loss"),
    )


USED = """used as (select code, row_number() over (order by code) - 1 as position from (
  select distinct code from nearest where code % 3 <> 0))"""


@query(
    "code_remap",
    f"""with {VECTORS}, {CODEBOOK}, {NEAREST}, {USED}, s as (select count(*) size from used),
    r as (select id, n.code, coalesce(position, size) compact,
      coalesce(position, cast(floor({u_sql(61, 'id')} * size) as bigint)) random_compact
      from nearest n left join used using (code), s)
    select r.id, r.code, compact, random_compact, u.code as back from r, s join used u
      on u.position = case when compact >= size then 0 else compact end""",
)
def code_remap(t):
    codes = materialise(_nearest(t).select("id", "code"), "codes")
    listed = codes.filter(F.col("code") % 3 != 0).select("code").distinct()
    used = settled(numbered(listed, ["code"], "position"), "used")
    out = vec.remap_codes(codes, used, unknown="extra")
    out = vec.remap_codes(out, used, unknown="random", seed=61, into="random_compact")
    return vec.unmap_codes(out, used, into="back").select(
        "id", "code", "compact", "random_compact", "back"
    )


def _round_sql(n: int) -> str:
    """One k-means round as CTEs: codes nearest to codebook n-1, and their means as codebook n."""
    return f"""near{n} as (select id, arg_min(code, {{'d': dist, 'c': code}}) code from (
      select v.id, c.code, list_sum(list_transform(list_zip(v.z, c.e), lambda p: (p[1]-p[2])*(p[1]-p[2]))) dist
      from vectors v, code{n - 1} c) group by id),
    code{n} as materialized (select code, list(m order by pos) e from (
      select code, pos, avg(z[pos + 1]) m from (
        select n.code, v.z, unnest(range(0, 64)) pos from near{n} n join vectors v using (id))
      group by code, pos) group by code)"""


@query(
    "kmeans_run",
    f"""with {VECTORS}, code0 as (select row_number() over (order by {digest_sql(71, 'id')}, id) - 1 code,
      z e from vectors qualify code < 8), {", ".join(_round_sql(n) for n in range(1, 6))},
    f as (select code, e, unnest(range(0, 64)) pos from code5)
    select code, pos, round(e[pos + 1], 6) + 0.0 as v from f""",
)
def kmeans_run(t):
    """Five k-means rounds on all vectors."""
    codebook = vec.kmeans(views.vectors(t), 8, 5, seed=71)
    return _spelled(codebook, "e", ["code"])


@query(
    "kmeans_iter",
    f"""with {VECTORS}, codebook as (select row_number() over (order by {digest_sql(71, 'id')}, id) - 1 code,
      z e from vectors qualify code < 8), {NEAREST},
    e as (select n.code, v.z, unnest(range(0, 64)) pos from nearest n join vectors v using (id))
    select code, pos, round(avg(z[pos + 1]), 6) + 0.0 as v from e group by code, pos""",
)
def kmeans_iter(t):
    """One k-means round: assignment and means."""
    return _spelled(vec.kmeans(views.vectors(t), 8, 1, seed=71), "e", ["code"])


@query(
    "centroid_means",
    f"""with {VECTORS}, e as (select label, z, unnest(range(0, 64)) pos from vectors)
    select label, pos, round(avg(z[pos + 1]), 6) + 0.0 as v, count(*) as n from e group by label, pos""",
)
def centroid_means(t):
    means = vec.element_means(views.vectors(t), "label", "z")
    return means.select(
        "label", F.col("pos").cast("long").alias("pos"), rounded("mean").alias("v"), "n"
    )


@query(
    "reconstruct",
    f"""with {VECTORS}, {CODEBOOK}, {NEAREST}, e as (select id, code, e, unnest(range(0, 64)) pos
      from nearest join codebook using (code))
    select id, code, pos, round(e[pos + 1], 6) + 0.0 as v from e""",
)
def reconstruct(t):
    """The code vector that stands for every vector."""
    return _spelled(vec.with_code_vector(_nearest(t), views.codebook(t)), "e", ["id", "code"])


@query(
    "codebook_ema",
    f"""with {VECTORS}, {CODEBOOK}, {NEAREST}, counts as (select code, count(*) n from nearest group by code),
    e as (select n.code, v.z, unnest(range(0, 64)) pos from nearest n join vectors v using (id)),
    sums as (select code, pos, sum(z[pos + 1]) s from e group by code, pos),
    st as (select code, e, unnest(range(0, 64)) pos from codebook),
    sizes as (select code, 0.01::double * coalesce(n, 0) as size from codebook left join counts using (code)),
    total as (select sum(size) tot from sizes)
    select code, pos, round(size, 6) as cluster_size,
      round((0.99::double * e[pos + 1] + 0.01::double * coalesce(s, 0))
        / ((size + 1e-5::double) / (tot + 16 * 1e-5::double) * tot), 5) + 0.0 as v
    from st left join sums using (code, pos) join sizes using (code), total""",
)
def codebook_ema(t):
    """One decayed codebook update from all vectors."""
    state = vec.fresh_state(views.codebook(t))
    new = vec.codebook_update(state, _nearest(t, keep=True), 0.99, 1e-5, 16)
    flat = new.select("code", "cluster_size", F.posexplode("e").alias("pos", "x"))
    return flat.select(
        "code", F.col("pos").cast("long").alias("pos"),
        rounded("cluster_size").alias("cluster_size"), rounded("x", 5).alias("v"),
    )


# --- similarity --------------------------------------------------------------

UNIT = """norms as (select id, z, sqrt(list_sum(list_transform(z, lambda x: x * x))) nz from vectors),
cnorms as (select code, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) ne from codebook),
sims as (select id, code, list_sum(list_transform(list_zip(z, e), lambda p: p[1] * p[2])) / nz / ne s
  from norms, cnorms)"""


@query(
    "cosine_pairs",
    f"""with {VECTORS}, {CODEBOOK}, {UNIT}
    select id, code, round(s * exp(1.5::double), 6) + 0.0 as logit from sims""",
)
def cosine_pairs(t):
    """Scaled similarity of every vector to every code."""
    return _logits(matching.similarity(views.vectors(t), views.codebook(t), scale=1.5), "id", "code")


@query(
    "cosine_pairs_by_code",
    f"""with {VECTORS}, {CODEBOOK}, {UNIT}
    select code, id, round(s * exp(1.5::double), 6) + 0.0 as logit from sims""",
)
def cosine_pairs_by_code(t):
    """The same with one list per code: the two tables change places."""
    found = matching.similarity(
        views.codebook(t), _as_right(views.vectors(t)), scale=1.5, key="code", vector="e"
    )
    return _logits(found, "code", "id")


def _logits(found, key: str, other: str):
    flat = found.select(key, F.explode(F.arrays_zip("codes", "logits")).alias("p"))
    return flat.select(key, F.col("p.codes").alias(other), rounded("p.logits").alias("logit"))


def _as_right(table):
    return table.select(F.col("id").alias("code"), F.col("z").alias("e"))


@query(
    "top_matches",
    f"""with {VECTORS}, n as (select id, z, sqrt(list_sum(list_transform(z, lambda x: x * x))) nz from vectors),
    sims as (select a.id, b.id as code, list_sum(list_transform(list_zip(a.z, b.z), lambda p: p[1] * p[2]))
      / a.nz / b.nz s from n a, n b)
    select id, code, round(s, 6) + 0.0 as score, rank from (select *, row_number() over
      (partition by id order by s desc, code) as rank from sims) where rank <= 3""",
)
def top_matches(t):
    found = matching.top_matches(views.vectors(t), _as_right(views.vectors(t)), 3)
    return found.select(
        "id", "code", rounded("score").alias("score"), F.col("rank").cast("long").alias("rank")
    )


@query(
    "sinusoid_code",
    f"""with {VECTORS}, f as (select id, unnest(range(0, 9)) pos from vectors)
    select id, pos, round(case when pos < 4 then cos(id * exp(-ln(10000::double) * pos / 4.0::double))
      when pos < 8 then sin(id * exp(-ln(10000::double) * (pos - 4) / 4.0::double))
      else 0 end, 6) + 0.0 as v from f""",
)
def sinusoid_code(t):
    coded = views.vectors(t).select("id", arrays.sinusoid("id", 9).alias("s"))
    return _spelled(coded, "s", ["id"])


@query(
    "unit_vectors",
    f"""with {VECTORS}, n as (select id, z, sqrt(list_sum(list_transform(z, lambda x: x * x))) + 1e-10::double n
      from vectors), e as (select id, z, n, unnest(range(0, 64)) pos from n)
    select id, pos, round(z[pos + 1] / n, 6) + 0.0 as v from e""",
)
def unit_vectors(t):
    return _spelled(
        views.vectors(t).select("id", arrays.l2_normalised("z", 1e-10).alias("u")), "u", ["id"]
    )


@query(
    "gaussian_draw",
    f"""with {VECTORS}, e as (select id, z, unnest(range(0, 32)) pos from vectors)
    select id, pos, round(z[pos + 1] + exp(0.5::double * z[pos + 33]) * {normal_sql(81, 'id', 'pos')}, 6)
      + 0.0 as v, round(z[pos + 1], 6) + 0.0 as mode from e""",
)
def gaussian_draw(t):
    mean, log_var = scores.gaussian_parts("z")
    drawn = views.vectors(t).select(
        "id", F.posexplode(F.arrays_zip(
            vec.gaussian_sample(mean, log_var, "id", 81).alias("v"), mean.alias("m")
        )).alias("pos", "d"),
    )
    return drawn.select(
        "id", F.col("pos").cast("long").alias("pos"), rounded("d.v").alias("v"),
        rounded("d.m").alias("mode"),
    )


# --- array functions on vectors ----------------------------------------------


@query(
    "normalise_pixels",
    f"""with {IMAGES8}, s as (select image_id, px, list_transform(px, lambda x: x / 127.5::double - 1) s
      from images8), e as (select *, unnest(range(0, 64)) pos from s)
    select image_id, pos, round(s[pos+1], 6) + 0.0 as v,
      cast(trunc(least(greatest((s[pos+1] + 1) * 127.5::double, 0), 255)) as int) as scaled,
      cast(trunc((least(greatest(s[pos+1], -1), 1) + 1) / 2 * 255) as int) as unit from e""",
)
def normalise_pixels(t):
    signed = views.images8(t).select("image_id", arrays.signed_unit("px").alias("s"))
    both = signed.select(
        "image_id", F.posexplode(F.arrays_zip(
            F.col("s").alias("v"), arrays.to_byte_scaled("s").alias("a"),
            arrays.to_byte_unit("s").alias("b"),
        )).alias("pos", "d"),
    )
    return both.select(
        "image_id", F.col("pos").cast("long").alias("pos"), rounded("d.v").alias("v"),
        F.col("d.a").alias("scaled"), F.col("d.b").alias("unit"),
    )


@query(
    "minmax_rows",
    _spell_sql(VECTORS, "vectors", "list_transform(z, lambda x: (x - list_min(z)) / "
               "(list_max(z) - list_min(z) + 1e-12::double) * 2 - 1)"),
)
def minmax_rows(t):
    return _spelled(
        views.vectors(t).select("id", arrays.min_max("z", signed=True).alias("a")), "a", ["id"]
    )


@query(
    "dynamic_clip",
    f"""with {VECTORS}, big as (select id, list_transform(z, lambda x: x * 12) z from vectors),
    q as (select id, z, greatest(quantile_cont(abs(x), 0.9), 1) s from (select id, z, unnest(z) x from big)
      group by id, z), e as (select id, z, s, unnest(range(0, 64)) pos from q)
    select id, pos, round(greatest(least(z[pos+1], s), -s) / s, 6) + 0.0 as v from e""",
)
def dynamic_clip(t):
    big = views.vectors(t).select("id", F.transform("z", lambda x: x * 12).alias("z"))
    return _spelled(big.select("id", arrays.quantile_clip("z", 0.9).alias("a")), "a", ["id"])


@query(
    "mask_blend",
    f"""with {VECTORS}, p as (select a.id, a.z m, a.z x, b.e y from vectors a join codebook b on b.code = a.id % 16),
    e as (select id, m, x, y, unnest(range(0, 64)) pos from p)
    select id, pos, round(case when m[pos+1] * 4 < 0.5 then y[pos+1] else x[pos+1] end, 6) + 0.0 as v
    from e""".replace("with ", f"with {CODEBOOK}, ", 1),
)
def mask_blend(t):
    codes = views.codebook(t)
    pairs = views.vectors(t).join(codes, F.col("id") % 16 == F.col("code"))
    mask = arrays.binarise(F.transform("z", lambda x: x * 4))
    return _spelled(
        pairs.select("id", arrays.blend(mask, F.col("z"), F.col("e")).alias("a")), "a", ["id"]
    )


@query(
    "one_hot",
    """with f as (select vec_id, label, list_transform(range(0, 10), lambda i: cast(i = label as int)) h
      from embeddings) select vec_id, array_to_string(h, ' ') as hot,
      cast((label + 250) % 256 as bigint) as label, cast((label + 251) % 256 as bigint) as shifted from f""",
)
def one_hot(t):
    label = (F.col("label").cast("long") + 250) % 256
    return t.embeddings.select(
        "vec_id", joined(arrays.one_hot("label", 10)).alias("hot"), label.alias("label"),
        arrays.shift_label(label).alias("shifted"),
    )


@query(
    "permute_roundtrip",
    f"""with {VECTORS}, e as (select id, z, unnest(range(0, 64)) pos from vectors),
    c as (select *, pos // 8 i, pos % 8 j from e),
    m as (select *, (i & 1) * 2 + (i & 2) * 4 + (i & 4) * 8 + (j & 1) + (j & 2) * 2 + (j & 4) * 4 as code,
      (i & 1) * 32 + (j & 1) * 16 + (i & 2) * 4 + (j & 2) * 2 + ((i & 4) >> 1) + ((j & 4) >> 2) as sub,
      i * 8 + case when i % 2 = 1 then 7 - j else j end as snake from c)
    select id, code as pos, round(z[pos + 1], 6) + 0.0 as z_curve, true as same from m""",
)
def permute_roundtrip(t):
    """Z-curve order of 8x8 rasters; every order must undo itself."""
    same = F.lit(True)
    for kind in ("identity", "subsample", "z_curve", "spiral_out", "spiral_in", "random", "boustrophedon"):
        order = arrays.permutation(kind, 8, 8)
        there = arrays.reorder("z", order)
        same = same & (arrays.reorder(there, arrays.inverse_permutation(order)) == F.col("z"))
    # Columns next to an explode are computed per exploded row, so check first.
    checked = views.vectors(t).select(
        "id", same.alias("same"),
        arrays.reorder("z", arrays.permutation("z_curve", 8, 8)).alias("moved"),
    )
    moved = checked.select("id", "same", F.posexplode("moved").alias("pos", "x"))
    return moved.select(
        "id", F.col("pos").cast("long").alias("pos"), rounded("x").alias("z_curve"), "same"
    )


@query(
    "morton",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      list_sum(list_transform(range(0, 20), lambda b: (((l_partkey >> b) & 1) << (2 * b + 1))
        + (((l_suppkey >> b) & 1) << (2 * b))))::bigint as code from lineitem""",
)
def morton(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        arrays.morton("l_partkey", "l_suppkey").alias("code"),
    )


@query(
    "topk_logits_softmax",
    f"""with {views.PREDICTIONS}, s as (select vec_id, list_transform(logits, lambda x: x / 0.7::double) l
      from predictions), c as (select vec_id, l, list_reverse_sort(l)[4] cut, list_max(l) top from s),
    x as (select vec_id, list_transform(l, lambda x: case when x >= cut then exp(x - top) else 0 end) x from c),
    e as (select vec_id, x, list_sum(x) n, unnest(range(0, 10)) pos from x)
    select vec_id, pos, round(x[pos + 1] / n, 6) + 0.0 as v from e""",
)
def topk_logits_softmax(t):
    probs = arrays.softmax(arrays.top_k_logits("logits", 4, 0.7))
    return _spelled(views.predictions(t).select("vec_id", probs.alias("a")), "a", ["vec_id"])


@query(
    "guidance_mix",
    f"""with {VECTORS}, {CODEBOOK}, e as (select id, z, e, unnest(range(0, 64)) pos from vectors
      join codebook on code = id % 16)
    select id, pos, round(e[pos+1] + 3.0::double * (z[pos+1] - e[pos+1]), 6) + 0.0 as v from e""",
)
def guidance_mix(t):
    pairs = views.vectors(t).join(views.codebook(t), F.col("id") % 16 == F.col("code"))
    return _spelled(pairs.select("id", arrays.guided("e", "z", 3.0).alias("a")), "a", ["id"])


# Channel means and deviations of the image encoder.
ENCODER_MEAN, ENCODER_STD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)


@query(
    "channel_scale",
    f"""with {VECTORS}, e as (select id, z, unnest(range(0, 64)) pos from vectors)
    select id, pos, round((z[pos+1] - (case pos % 3 when 0 then 0.48145466 when 1 then 0.4578275
      else 0.40821073 end)::double) / (case pos % 3 when 0 then 0.26862954 when 1 then 0.26130258
      else 0.27577711 end)::double, 6) + 0.0 as v from e""",
)
def channel_scale(t):
    # 64 values are 21 pixels of three channels and one of a further pixel
    scaled = arrays.channel_scale("z", ENCODER_MEAN, ENCODER_STD)
    return _spelled(views.vectors(t).select("id", scaled.alias("a")), "a", ["id"])


@query(
    "unit_scale",
    f"""with {IMAGES8}, e as (select image_id, px, unnest(range(0, 64)) pos from images8)
    select image_id, pos, round(px[pos+1] / 255.0::double, 6) as unit,
      cast(round_even(px[pos+1] / 255.0::double * 255, 0) as int) as back,
      cast(round_even(px[pos+1] / 255.0::double * 65535, 0) as int) as wide from e""",
)
def unit_scale(t):
    unit = arrays.unit_from_int("px")
    both = views.images8(t).select("image_id", F.posexplode(F.arrays_zip(
        unit.alias("u"), arrays.int_from_unit(unit).alias("b"),
        arrays.int_from_unit(unit, 65535).alias("w"),
    )).alias("pos", "d"))
    return both.select(
        "image_id", F.col("pos").cast("long").alias("pos"), rounded("d.u").alias("unit"),
        F.col("d.b").alias("back"), F.col("d.w").alias("wide"),
    )


# --- schedules ---------------------------------------------------------------

SCHEDULE = f"""base as (select r as t, power(sqrt(1e-4::double) + (sqrt(2e-2::double) - sqrt(1e-4::double))
    * r / {STEPS - 1}.0::double, 2) as beta from range(0, {STEPS}) x(r)),
bars as (select t, beta, 1 - beta as alpha, product(1 - beta) over (order by t) a from base),
prevs as (select *, lag(a, 1, 1.0) over (order by t) p from bars),
terms as (select *, beta * (1 - p) / (1 - a) as pv from prevs),
weighted as (select *, case when pv > 0 then beta * beta / (2 * pv * alpha * (1 - a)) end w0 from terms),
sched as (select *, case when t = 0 then lead(w0) over (order by t) else w0 end as weight from weighted)"""


def _schedule(t, kind="eps"):
    return sch.schedule(t.spark, STEPS, sch.betas("linear", STEPS), kind=kind)


def _stepped(t):
    return views.vectors(t).withColumn("t", sch.random_step("id", STEPS, 91))


DRAWN = f"drawn as (select *, cast(floor({u_sql(91, 'id')} * {STEPS}) as bigint) as t from vectors)"


@query(
    "noise_schedule",
    f"""with {VECTORS}, {DRAWN}, {SCHEDULE} select t, count(*) as n, round(any_value(beta), 9) as beta,
      round(any_value(a), 9) as alpha_bar, round(any_value(p), 9) as alpha_bar_prev,
      round(any_value(pv), 9) + 0.0 as variance, round(any_value(beta * sqrt(p) / (1 - a)), 9) as coef1,
      round(any_value((1 - p) * sqrt(alpha) / (1 - a)), 9) + 0.0 as coef2,
      round(any_value(weight), 6) as weight from drawn join sched using (t) group by t""",
)
def noise_schedule(t):
    """Schedule terms of the steps that the rows draw, with their number of rows."""
    drawn = _stepped(t).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return sch.at_step(drawn, _schedule(t)).select(
        "t", "n", rounded("beta", 9).alias("beta"), rounded("alpha_bar", 9).alias("alpha_bar"),
        rounded("alpha_bar_prev", 9).alias("alpha_bar_prev"),
        rounded("posterior_variance", 9).alias("variance"),
        rounded("posterior_coef1", 9).alias("coef1"), rounded("posterior_coef2", 9).alias("coef2"),
        rounded("weight").alias("weight"),
    )


@query(
    "subsampled_schedule",
    f"""with {VECTORS}, {SCHEDULE}, picked as (select t, a, coalesce(lag(a) over (order by t),
        (select a from sched where t = 0)) p from sched where t % 50 = 1),
    d as (select id, 1 + 50 * cast(floor({u_sql(92, 'id')} * 20) as bigint) t from vectors)
    select id, t, round(a, 9) as alpha_bar, round(p, 9) as alpha_bar_prev,
      round(0.5::double * sqrt((1 - p) / (1 - a) * (1 - a / p)), 9) as sigma from d join picked using (t)""",
)
def subsampled_schedule(t):
    """Every row with a step of the shortened schedule and its sigma."""
    from loomframe.functions import seeded

    steps = sch.subsampled(_schedule(t), sch.uniform_steps(STEPS, 20), 0.5)
    drawn = views.vectors(t).select("id", (F.lit(1) + 50 * seeded.uniform_int(92, 20, "id")).alias("t"))
    return sch.at_step(drawn, steps).select(
        "id", "t", rounded("alpha_bar", 9).alias("alpha_bar"),
        rounded("alpha_bar_prev", 9).alias("alpha_bar_prev"), rounded("sigma", 9).alias("sigma"),
    )


@query(
    "step_lookup",
    f"""with {VECTORS}, {DRAWN}, {SCHEDULE} select id, t, round(sqrt(a), 9) as signal,
      round(sqrt(1 - a), 9) as noise, round(ln(1 - a), 6) as log_noise from drawn join sched using (t)""",
)
def step_lookup(t):
    return sch.at_step(_stepped(t), _schedule(t)).select(
        "id", "t", rounded("sqrt_alpha_bar", 9).alias("signal"),
        rounded("sqrt_one_minus", 9).alias("noise"), rounded("log_one_minus").alias("log_noise"),
    )


@query(
    "forward_noise",
    f"""with {VECTORS}, {DRAWN}, {SCHEDULE}, e as (select id, t, z, a, unnest(range(0, 64)) pos
      from drawn join sched using (t))
    select id, t, pos, round(sqrt(a) * z[pos+1] + sqrt(1 - a) * {normal_sql(93, 'id', 'pos')}, 6) + 0.0 as v,
      round(z[pos+1], 5) + 0.0 as back from e""",
)
def forward_noise(t):
    """Noised vectors, and the clean ones recovered from them."""
    stepped = sch.at_step(_stepped(t), _schedule(t)).withColumn(
        "eps", sch.noise_vector("id", 64, 93)
    )
    noisy = stepped.withColumn("x_t", sch.noised(F.col("z"), F.col("eps")))
    back = sch.denoised(F.col("x_t"), F.col("eps"))
    flat = noisy.select("id", "t", F.posexplode(
        F.arrays_zip(F.col("x_t").alias("v"), back.alias("b"))).alias("pos", "d"))
    return flat.select(
        "id", "t", F.col("pos").cast("long").alias("pos"), rounded("d.v").alias("v"),
        rounded("d.b", 5).alias("back"),
    )
