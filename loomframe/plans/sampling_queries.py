"""Shuffles, splits, samples, batches and random flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import arrays, seeded
from loomframe.operators import labels, sampling, vectors
from loomframe.operators.ordering import batches, moving_average, trailing
from loomframe.plans import views
from loomframe.plans.registry import joined, query, rounded
from loomframe.plans.views import VECTORS, digest_sql, normal_sql, u_sql

RANKED = f"""ranked as (
  select doc_id, source, row_number() over (order by {digest_sql(21, 'doc_id')}, doc_id) - 1 as rank,
    count(*) over () as n from documents)"""


def _docs(t):
    return t.documents.select("doc_id", "source")


@query("shuffle_order", f"with {RANKED} select doc_id, rank from ranked")
def shuffle_order(t):
    return sampling.shuffled(t.documents.select("doc_id"), "doc_id", 21)


@query(
    "exact_split",
    f"""with {RANKED} select doc_id, case when rank < 50 then 'val' when rank < 120 then 'test'
      else 'train' end as split from ranked""",
)
def exact_split(t):
    return sampling.exact_split(
        t.documents.select("doc_id"), "doc_id", 21, [("val", 50), ("test", 70)]
    )


@query(
    "ratio_split",
    f"""with {RANKED} select doc_id, case when rank < floor(0.9::double * n) then 'train'
      else 'test' end as split from ranked""",
)
def ratio_split(t):
    return sampling.ratio_split(t.documents.select("doc_id"), "doc_id", 21, 0.9)


@query("hash_sample", f"with {RANKED} select doc_id, source from ranked where rank < 100")
def hash_sample(t):
    return sampling.sample_exact(_docs(t), "doc_id", 21, 100)


@query(
    "fraction_sample",
    f"select doc_id, source from documents where {u_sql(7, 'doc_id')} < 0.1::double",
)
def fraction_sample(t):
    return sampling.sample_fraction(_docs(t), "doc_id", 7, 0.1)


@query(
    "stride_slice",
    """with p as (select doc_id, row_number() over (order by doc_id) - 1 as row_no from documents)
    select doc_id, row_no, cast(row_no < 20 and row_no % 5 = 0 as bigint) as strided
    from p where row_no < 100""",
)
def stride_slice(t):
    return sampling.head_then_stride(t.documents.select("doc_id"), ["doc_id"], 100, 20, 5)


@query(
    "every_nth",
    """with p as (select doc_id, row_number() over (order by doc_id) - 1 as row_no,
      count(*) over () as n from documents)
    select doc_id from p where row_no % greatest(1, n // 50) = 0""",
)
def every_nth(t):
    return sampling.every_nth(t.documents.select("doc_id"), ["doc_id"])


@query(
    "fixed_batches",
    """with p as (select doc_id, row_number() over (order by doc_id) - 1 as row_no,
      count(*) over () as n from documents)
    select doc_id, row_no // 64 as batch from p where row_no < n // 64 * 64""",
)
def fixed_batches(t):
    return batches(t.documents.select("doc_id"), ["doc_id"], 64, drop_last=True)


@query(
    "epochs",
    """with e as (select doc_id, r as epoch from documents, range(0, 3) x(r)),
    p as (select *, (row_number() over (order by epoch, doc_id) - 1) // 64 as batch from e)
    select doc_id, epoch, batch, batch // 10 as pseudo_epoch, batch % 10 as step from p""",
)
def epochs(t):
    """Three passes over the table, cut into pseudo-epochs of ten batches."""
    repeated = labels.repeated(t.documents.select("doc_id"), 3).withColumn(
        "epoch", F.col("epoch").cast("long")
    )
    placed = batches(repeated, ["epoch", "doc_id"], 64)
    return placed.select(
        "doc_id", "epoch", "batch", F.floor(F.col("batch") / 10).alias("pseudo_epoch"),
        (F.col("batch") % 10).alias("step"),
    )


@query(
    "random_flags",
    f"""with {VECTORS}, e as (select id, z, {u_sql(31, 'id')} < 0.5 as flip,
      cast(floor({u_sql(32, 'id')} * 1000) as bigint) as step,
      id % 2 = 0 and {u_sql(33, 'id')} < 0.5 as noisy, unnest(range(0, 64)) i from vectors)
    select id, flip, step, i as pos, round(case when noisy then z[i + 1] + 0.25::double
      * {normal_sql(34, 'id', 'i')} else z[i + 1] end, 6) + 0.0 as v from e""",
)
def random_flags(t):
    """Flip flag, random step, and noise on some rows, all repeatable."""
    noisy = vectors.sometimes_noised("z", "id", 0.25, 0.5, 33)
    # Columns next to an explode are computed per exploded row, so draw first.
    drawn = views.vectors(t).select(
        "id", seeded.coin(31, 0.5, "id").alias("flip"),
        seeded.uniform_int(32, 1000, "id").alias("step"), noisy.alias("noisy"),
    )
    flat = drawn.select("id", "flip", "step", F.posexplode("noisy").alias("pos", "v"))
    return flat.select("id", "flip", "step", F.col("pos").cast("long").alias("pos"), rounded("v").alias("v"))


@query(
    "cond_dropout",
    f"""with {VECTORS}, e as (select id, z, unnest(range(0, 64)) pos from vectors)
    select id, pos, {u_sql(41, 'id')} >= 0.8::double as dropped,
      round(case when {u_sql(41, 'id')} < 0.8::double then z[pos + 1] else 0.5 end, 6) + 0.0 as v
    from e""",
)
def cond_dropout(t):
    blank = arrays.literal([0.5] * 64)
    drawn = views.vectors(t).select(
        "id", (seeded.uniform(41, "id") >= 0.8).alias("dropped"),
        F.posexplode(arrays.drop_condition("z", "id", 0.2, blank, 41)).alias("pos", "x"),
    )
    return drawn.select("id", F.col("pos").cast("long").alias("pos"), "dropped", rounded("x").alias("v"))


@query(
    "token_keep",
    f"""with w as (select doc_id, list_transform(string_split(text, ' '), lambda s: length(s)) ids
      from documents), e as (select doc_id, unnest(ids) x, unnest(range(0, len(ids))) i from w),
    k as (select doc_id, i, case when {u_sql(51, 'doc_id', 'i')} < 0.7::double then x
      else cast(floor({u_sql(52, 'doc_id', 'i')} * 300) as bigint) end v from e)
    select doc_id, string_agg(v, ' ' order by i) as ids from k group by doc_id""",
)
def token_keep(t):
    ids = F.transform(F.split("text", " ", -1), lambda s: F.length(s))
    docs = t.spread("documents", "doc_id").select("doc_id", ids.alias("ids"))
    return docs.select("doc_id", joined(arrays.keep_tokens("ids", "doc_id", 0.7, 300, 51)).alias("ids"))


@query(
    "trailing_history",
    """with h as (select event_type as name, event_id as step, list(value) over
      (partition by event_type order by event_id rows between 9 preceding and current row) h from events)
    select name, step, len(h) as n, round(h[1], 6) as oldest, round(h[-1], 6) as newest,
      round(list_sum(h) / len(h), 6) as mean from h""",
)
def trailing_history(t):
    params = t.events.select(
        F.col("event_type").alias("name"), F.col("event_id").alias("step"), "value"
    )
    held = trailing(params, "name", "step", "value", 10)
    return held.select(
        "name", "step", F.size("history").cast("long").alias("n"),
        rounded(F.col("history")[0]).alias("oldest"),
        rounded(F.element_at("history", -1)).alias("newest"),
        rounded(arrays.mean("history")).alias("mean"),
    )


@query(
    "ema",
    """with s as (select event_type as name, list(value order by event_id) v from events
      group by event_type),
    m as (select name, list_transform(range(0, len(v)), lambda i: {'n': i, 'v': v[i + 1]}) v from s),
    r as (select name, list_reduce(v, lambda acc, x: {'n': x.n, 'v':
      acc.v - (1 - least(0.999::double, (1 + x.n) / (10 + x.n)::double)) * (acc.v - x.v)}) a from m)
    select name, round(a.v, 6) as average from r""",
)
def ema(t):
    """Exponential moving average per name after its last value."""
    params = t.events.select(
        F.col("event_type").alias("name"), F.col("event_id").alias("step"), "value"
    )
    done = moving_average(params, "name", "step", "value", 0.999)
    return done.select("name", rounded("average").alias("average"))
