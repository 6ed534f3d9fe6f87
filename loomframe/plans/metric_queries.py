"""Metric aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import arrays, scores
from loomframe.operators import metrics, schedule, vectors
from loomframe.plans import views
from loomframe.plans.registry import query, rounded
from loomframe.plans.vector_queries import DRAWN, SCHEDULE, _schedule, _stepped
from loomframe.plans.views import CODEBOOK, IMAGES8, PREDICTIONS, VECTORS

HITS = """ranked as (select *, list_transform(list_sort(list_transform(range(0, 10),
  lambda i: {'v': -logits[i+1], 'i': i})), lambda s: s.i) r from predictions),
hits as (select *, cast(r[1] = label as int) h1, cast(list_contains(r[1:5], label) as int) h5 from ranked)"""


def _hits(t):
    return views.predictions(t).select(
        "step", scores.hit_at("logits", "label", 1).alias("h1"),
        scores.hit_at("logits", "label", 5).alias("h5"),
    )


@query(
    "topk_accuracy",
    f"""with {PREDICTIONS}, {HITS} select round(avg(h1), 6) as acc_1, round(avg(h5), 6) as acc_5,
      sum(h1)::bigint as hits from hits""",
)
def topk_accuracy(t):
    return _hits(t).agg(
        rounded(F.avg("h1")).alias("acc_1"), rounded(F.avg("h5")).alias("acc_5"),
        F.sum("h1").alias("hits"),
    )


@query(
    "accuracy_by_step",
    f"""with {PREDICTIONS}, {HITS} select step, round(avg(h1), 6) as acc_1, round(avg(h5), 6) as acc_5
    from hits group by step""",
)
def accuracy_by_step(t):
    return _hits(t).groupBy("step").agg(
        rounded(F.avg("h1")).alias("acc_1"), rounded(F.avg("h5")).alias("acc_5")
    )


PAIRS = f"""{VECTORS}, {CODEBOOK}, losses as (select id, label,
    list_sum(list_transform(list_zip(z, e), lambda p: abs(p[1] - p[2]))) / 64 l1,
    list_sum(list_transform(list_zip(z, e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 64 l2
  from vectors join codebook on code = id % 16)"""


def _losses(t):
    pairs = views.vectors(t).join(views.codebook(t), F.col("id") % 16 == F.col("code"))
    return pairs.select(
        "id", "label", scores.mean_abs_error("z", "e").alias("l1"),
        scores.mean_square_error("z", "e").alias("l2"),
    )


@query(
    "row_errors",
    f"with {PAIRS} select id, round(l1, 6) as l1, round(l2, 6) as l2 from losses",
)
def row_errors(t):
    return _losses(t).select("id", rounded("l1").alias("l1"), rounded("l2").alias("l2"))


@query(
    "masked_loss",
    f"""with {PAIRS} select round(sum(l2 * coalesce(quality, 0)) / count(*), 6) as masked,
      round(avg(l2), 6) as plain, round(avg(l1), 6) as mean_abs
    from losses left join labels on doc_id = id""",
)
def masked_loss(t):
    """Mean loss over all rows in which only valid rows count."""
    valid = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("valid"))
    joined = _losses(t).join(valid, "id", "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    return joined.agg(
        rounded(metrics.masked_mean("l2", "valid")).alias("masked"),
        rounded(F.avg("l2")).alias("plain"), rounded(F.avg("l1")).alias("mean_abs"),
    )


@query(
    "weighted_loss",
    f"""with {PAIRS}, {DRAWN}, {SCHEDULE}, j as (select l2, weight from losses join
      (select id, t from drawn) using (id) join sched using (t))
    select round(avg(l2), 6) as simple, round(avg(weight * l2), 6) as bound,
      round(avg(l2) + 0.001::double * avg(weight * l2), 6) as total,
      round(avg(l2 / exp(0.3::double) + 0.3::double), 6) as scaled from j""",
)
def weighted_loss(t):
    """Loss, its step-weighted bound, and their sum."""
    stepped = _losses(t).join(_stepped(t).select("id", "t"), "id")
    weighed = schedule.at_step(stepped, _schedule(t).select("t", "weight"))
    simple, bound = F.avg("l2"), F.avg(F.col("weight") * F.col("l2"))
    log_var = F.lit(0.3)
    return weighed.agg(
        rounded(simple).alias("simple"), rounded(bound).alias("bound"),
        rounded(simple + 0.001 * bound).alias("total"),
        rounded(F.avg(F.col("l2") / F.exp(log_var) + log_var)).alias("scaled"),
    )


@query(
    "hinge_weighted",
    f"""with {PREDICTIONS}, h as (select vec_id, 1 + vec_id % 7 as w,
      list_sum(list_transform(logits, lambda x: greatest(0, 1 - x))) / 10 r,
      list_sum(list_transform(logits, lambda x: greatest(0, 1 + x))) / 10 f,
      list_sum(list_transform(logits, lambda x: ln(1 + exp(-x)))) / 10 sr,
      list_sum(list_transform(logits, lambda x: ln(1 + exp(x)))) / 10 sf from predictions)
    select round(sum(w * r) / sum(w), 6) as loss_real, round(sum(w * f) / sum(w), 6) as loss_fake,
      round(0.5::double * (sum(w * r) / sum(w) + sum(w * f) / sum(w)), 6) as hinge,
      round(0.5::double * (avg(sr) + avg(sf)), 6) as softplus from h""",
)
def hinge_weighted(t):
    per_row = views.predictions(t).select(
        (F.lit(1) + F.col("vec_id") % 7).alias("w"),
        scores.hinge("logits", -1).alias("r"), scores.hinge("logits", 1).alias("f"),
        scores.softplus("logits", -1).alias("sr"), scores.softplus("logits", 1).alias("sf"),
    )
    real, fake = metrics.weighted_mean("r", "w"), metrics.weighted_mean("f", "w")
    return per_row.agg(
        rounded(real).alias("loss_real"), rounded(fake).alias("loss_fake"),
        rounded(0.5 * (real + fake)).alias("hinge"),
        rounded(0.5 * (F.avg("sr") + F.avg("sf"))).alias("softplus"),
    )


@query(
    "channel_stats",
    f"""with {VECTORS}, e as (select unnest(z) v, unnest(range(0, 64)) pos from vectors)
    select pos, round(avg(v), 6) + 0.0 as mean, round(stddev_samp(v), 6) as std,
      round(1 / (stddev_samp(v) + 1e-6::double), 5) as scale from e group by pos""",
)
def channel_stats(t):
    stats = metrics.channel_stats(views.vectors(t), "z")
    return stats.select(
        F.col("pos").cast("long").alias("pos"), rounded("mean").alias("mean"),
        rounded("std").alias("std"), rounded("scale", 5).alias("scale"),
    )


@query(
    "scale_factor",
    f"""with {VECTORS}, e as (select unnest(z) v from vectors),
    s as (select stddev_samp(v) as std from e), r as (select id, unnest(z) v, unnest(range(0, 64)) pos from vectors)
    select id, pos, round(v / std, 6) + 0.0 as v from r, s""",
)
def scale_factor(t):
    """Every vector divided by the deviation over all elements."""
    factor = metrics.scale_factor(views.vectors(t), "z").first()["scale_factor"]
    scaled = views.vectors(t).select("id", F.posexplode("z").alias("pos", "x"))
    return scaled.select(
        "id", F.col("pos").cast("long").alias("pos"), rounded(F.col("x") * factor).alias("v")
    )


@query(
    "gaussian_kl",
    f"""with {VECTORS}, {CODEBOOK}, p as (select id, list_zip(z[1:32], z[33:64], e[1:32], e[33:64]) q
      from vectors join codebook on code = id % 16)
    select id, round(0.5 * list_sum(list_transform(q, lambda p: p[1]*p[1] + exp(p[2]) - 1 - p[2])), 6) as kl,
      round(0.5 * list_sum(list_transform(q, lambda p: (p[1]-p[3])*(p[1]-p[3]) / exp(p[4])
        + exp(p[2]-p[4]) - 1 - p[2] + p[4])), 6) as kl_pair,
      round(0.5 * list_sum(list_transform(q, lambda p: ln(2*pi()) + p[2]
        + (p[3]-p[1])*(p[3]-p[1]) / exp(p[2]))), 6) as nll,
      round(0.5 * list_sum(list_transform(q, lambda p: p[1]*p[1] + exp(p[2]) - 1 - p[2])) / 32 / ln(2), 6)
        as bits_per_dim from p""",
)
def gaussian_kl(t):
    pairs = views.vectors(t).join(views.codebook(t), F.col("id") % 16 == F.col("code"))
    m, l = scores.gaussian_parts("z")
    n, k = scores.gaussian_parts("e")
    parts = pairs.select("id", m.alias("m"), l.alias("l"), n.alias("n"), k.alias("k"))
    kl = scores.gaussian_kl("m", "l")
    return parts.select(
        "id", rounded(kl).alias("kl"), rounded(scores.gaussian_kl("m", "l", "n", "k")).alias("kl_pair"),
        rounded(scores.gaussian_nll("n", "m", "l")).alias("nll"),
        rounded(scores.bits(kl / 32)).alias("bits_per_dim"),
    )


@query(
    "cross_entropy",
    f"""with {PREDICTIONS}, c as (select step,
      ln(list_sum(list_transform(logits, lambda x: exp(x)))) - logits[label + 1] ce,
      list_sum(list_transform(range(0, 10), lambda i: greatest(logits[i+1], 0)
        - logits[i+1] * cast(i = label as int) + ln(1 + exp(-abs(logits[i+1]))))) / 10 bce from predictions)
    select step, round(avg(ce), 6) as ce, round(avg(bce), 6) as bce,
      round(avg(ce) + 0.5::double * avg(bce), 6) as total from c group by step""",
)
def cross_entropy(t):
    hot = arrays.one_hot("label", 10).cast("array<double>")
    rows = views.predictions(t).select(
        "step", scores.cross_entropy("logits", "label").alias("ce"),
        scores.binary_cross_entropy("logits", hot).alias("bce"),
    )
    ce, bce = F.avg("ce"), F.avg("bce")
    return rows.groupBy("step").agg(
        rounded(ce).alias("ce"), rounded(bce).alias("bce"), rounded(ce + 0.5 * bce).alias("total")
    )


@query(
    "psnr",
    f"""with {IMAGES8}, p as (select a.image_id, list_filter(list_zip(a.px, b.px, range(0, 64)),
        lambda q: q[3] // 8 between 1 and 6 and q[3] % 8 between 1 and 6) q
      from images8 a join images8 b on b.image_id = a.image_id + 1 - 2 * (a.image_id % 2)),
    m as (select image_id, list_sum(list_transform(q, lambda q: (q[1]-q[2]) * (q[1]-q[2])))::double / 36 mse from p)
    select image_id, round(mse, 6) as mse,
      case when mse = 0 then 'inf'::double else round(20 * log10(255.0::double / sqrt(case when mse = 0 then 1 else mse end)), 6) end as psnr
    from m""",
)
def psnr(t):
    """Every image against its neighbour; one without a neighbour is left out."""
    other = F.col("image_id") + 1 - 2 * (F.col("image_id") % 2)
    pairs = views.images8(t).join(views.images8(t).select(other.alias("image_id"), F.col("px").alias("ref")), "image_id")
    inner = lambda c: scores.interior(c, 8, 8, 1).cast("array<double>")
    found = pairs.select("image_id", scores.mean_square_error(inner("px"), inner("ref")).alias("mse"))
    value = scores.psnr("mse")
    return found.select(
        "image_id", rounded("mse").alias("mse"),
        F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(rounded(value)).alias("psnr"),
    )


@query(
    "parameter_stats",
    """select event_type as name, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std,
      min(value) as min, max(value) as max, count(*) as n from events group by event_type""",
)
def parameter_stats(t):
    stats = metrics.parameter_stats(t.events.withColumnRenamed("event_type", "name"), "name", "value")
    return stats.withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query(
    "vector_check",
    f"""with {VECTORS}, scaled as (
      select z, list_max(list_transform(z, lambda x: abs(x))) / 127.0 as step from vectors)
    select max(case when step > 0 then
             list_max(list_transform(z, lambda x: abs(x - floor(x / step + 0.5) * step))) else 0.0 end) as largest,
           count(*) as n from scaled""",
)
def vector_check(t):
    """Stored vectors against a recomputation from one byte a value: the largest difference."""
    stored = t.embeddings.select("vec_id", arrays.doubles("embedding").alias("stored"))
    step = F.array_max(F.transform("stored", F.abs)) / 127.0
    fresh = stored.withColumn("step", step).select(
        "vec_id",
        F.when(F.col("step") > 0, F.transform("stored", lambda x: F.floor(x / F.col("step") + 0.5) * F.col("step")))
        .otherwise(F.col("stored")).alias("fresh"),
    )
    return stored.join(fresh, "vec_id").agg(
        vectors.largest_difference(F.col("stored"), F.col("fresh")).alias("largest"),
        F.count(F.lit(1)).alias("n"),
    )
