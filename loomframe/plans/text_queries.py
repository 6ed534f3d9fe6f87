"""Text, path and shard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import paths, text
from loomframe.operators import filters, labels, metrics
from loomframe.operators.ordering import running_total
from loomframe.operators.tokenizer import END, byte_symbols, decode_ids, encode, merges_of, vocabulary
from loomframe.plans import views
from loomframe.plans.registry import joined, query, rounded
from loomframe.plans.views import TAGGED, A, B, strip_sql
from loomframe.sources import sinks

HAS_A = f"regexp_matches(keywords, '[{A}]')"


@query(
    "text_filter_yield",
    f"""with {TAGGED}
    select lang, source, count(*) as before,
           count(*) filter (where len(list_filter(string_split(keywords, ','),
                lambda t: regexp_matches(t, '[{A}]'))) > 0 and regexp_matches(remark, '[{A}]')) as after
    from tagged_docs group by lang, source""",
)
def text_filter_yield(t):
    """Rows per language and source before and after the text filter."""
    parsed = _parsed(views.tagged_docs(t, spread=True), "lang", "source")
    kept = filters.tagged_and_described("tags", "remark")
    return metrics.yield_by_shard(parsed, ["lang", "source"], kept)


def _parsed(docs, *columns: str):
    """Tags of script A and the A part of the remark."""
    tags, _ = text.split_tags("keywords", A, B)
    remark, _ = text.split_remark("remark", A, B)
    return docs.select(*columns, tags.alias("tags"), remark.alias("remark"))


def _tag_sql(own: str, other: str, own_first_on: str) -> str:
    # p: characters before the first own letter, q: before the first other letter.
    p = f"length(regexp_extract(t, '(?s)^[^{own}]*'))"
    q = f"length(regexp_extract(t, '(?s)^[^{other}]*'))"
    return (
        f"list_transform(list_filter(string_split(keywords, ','), lambda t: "
        f"regexp_matches(t, '[{own}]')), lambda t: case when {q} = length(t) then t "
        f"when {p} < {q} then substr(t, 1, {q}) else substr(t, {p} + 1) end)"
    )


A_TAGS, B_TAGS = _tag_sql(A, B, "a"), _tag_sql(B, A, "b")


@query(
    "tag_split",
    f"""with {TAGGED}, cut as (select doc_id, {A_TAGS} a, {B_TAGS} b from tagged_docs)
    select doc_id, len(a) as n_a, len(b) as n_b, array_to_string(a, '|') as a_tags,
           array_to_string(b, '|') as b_tags from cut""",
)
def tag_split(t):
    a, b = text.split_tags("keywords", A, B)
    cut = views.tagged_docs(t, spread=True).select("doc_id", a.alias("a"), b.alias("b"))
    return cut.select(
        "doc_id",
        F.size("a").cast("long").alias("n_a"),
        F.size("b").cast("long").alias("n_b"),
        F.array_join("a", "|").alias("a_tags"),
        F.array_join("b", "|").alias("b_tags"),
    )


def _remark_sql(legacy: bool) -> str:
    shift = "fb <= a_last" if legacy else "a_any and fb <= a_last"
    return f"""with pos as (
      select doc_id, text, length(text) n, regexp_matches(text, '[{A}]') a_any,
             length(regexp_extract(text, '(?s)^[^{A}]*')) fa,
             length(regexp_extract(text, '(?s)^[^{B}]*')) fb,
             length(text) - length(regexp_extract(text, '(?s)[^{A}]*$')) - 1 la,
             length(text) - length(regexp_extract(text, '(?s)[^{B}]*$')) - 1 lb
      from documents),
    spans as (select *, greatest(la, 0) a_last, greatest(lb, 0) b_last from pos),
    cut as (select *, case when {shift} then a_last + 1 else fb end b_from from spans)
    select doc_id,
      {strip_sql("substr(text, fa + 1, greatest(a_last + 1 - fa, 0))")} as a_part,
      {strip_sql("substr(text, b_from + 1, greatest(b_last + 1 - b_from, 0))")} as b_part
    from cut"""


def _remark(t, legacy: bool):
    a, b = text.split_remark("text", A, B, legacy)
    return t.documents.select("doc_id", a.alias("a_part"), b.alias("b_part"))


@query(
    "filtered_docs",
    f"""with {TAGGED}, tags as (select doc_id, {A_TAGS} a from tagged_docs), parts as ({_remark_sql(False)})
    select doc_id, array_to_string(a, ' ') as keywords, a_part as remark
    from tags join parts using (doc_id) where len(a) > 0 and length(a_part) > 0""",
)
def filtered_docs(t):
    """The text filter as rows: parsed and joined tags, parsed remark."""
    parsed = _parsed(views.tagged_docs(t, spread=True), "doc_id")
    kept = parsed.filter(filters.tagged_and_described("tags", "remark"))
    return kept.select("doc_id", text.join_tags("tags", " ").alias("keywords"), "remark")


@query(
    "filtered_docs_shortcut",
    f"""with {TAGGED} select doc_id from tagged_docs
    where regexp_matches(keywords, '[{A}]') and regexp_matches(remark, '[{A}]')""",
)
def filtered_docs_shortcut(t):
    """Keys of the same rows by two searches, without parsing."""
    docs = views.tagged_docs(t)
    return docs.filter(filters.describable("keywords", "remark", A)).select("doc_id")


@query("remark_split", _remark_sql(False))
def remark_split(t):
    return _remark(t, False)


@query("remark_split_legacy", _remark_sql(True))
def remark_split_legacy(t):
    return _remark(t, True)


@query(
    "tag_join_valid",
    f"""with {TAGGED}, cut as (select doc_id, {A_TAGS} a, {B_TAGS} b from tagged_docs)
    select doc_id, array_to_string(a, ' ') as a_text, array_to_string(a || b, ',') as all_tags,
           cast(case when array_to_string(a, ' ') = '' then 0 else 1 end as bigint) as valid
    from cut""",
)
def tag_join_valid(t):
    a, b = text.split_tags("keywords", A, B)
    cut = views.tagged_docs(t, spread=True).select("doc_id", a.alias("a"), b.alias("b"))
    a_text = text.join_tags("a", " ")
    return cut.select(
        "doc_id",
        a_text.alias("a_text"),
        text.join_tags(F.concat("a", "b"), ",").alias("all_tags"),
        text.validity(a_text).cast("long").alias("valid"),
    )


@query(
    "topic_rule",
    f"""with {TAGGED}, tags as (
      select doc_id, source, string_split(lower(keywords), ',') tags from tagged_docs)
    select doc_id, source from tags
    where len(list_filter(tags, lambda t: (contains(t, 'sch') and t <> 'schen') or t = 'under')) = 0
      and len(list_filter(tags, lambda t: {strip_sql("t")} in ('the', 'die', 'que', 'le'))) > 0""",
)
def topic_rule(t):
    tags = F.split(F.lower("keywords"), ",", -1)
    rule = filters.on_topic(tags, ["the", "die", "que", "le"], "sch", "schen", ["under"])
    return views.tagged_docs(t, spread=True).filter(rule).select("doc_id", "source")


@query(
    "shard_min_yield",
    f"""with kept as (select doc_id, source from documents where regexp_matches(text, '[{A}]')),
    good as (select source from kept group by source having count(*) >= 18)
    select doc_id, source from kept where source in (select source from good)""",
)
def shard_min_yield(t):
    kept = t.documents.filter(text.has_script("text", A)).select("doc_id", "source")
    return sinks.shards_with_yield(kept, "source", 18)


@query(
    "running_yield",
    f"""with y as (select source, count(*) as before,
        count(*) filter (where regexp_matches(text, '[{A}]')) as after
      from documents group by source)
    select source, before, after,
           cast(sum(after) over (order by source rows unbounded preceding) as bigint) as running_after
    from y""",
)
def running_yield(t):
    per_shard = metrics.yield_by_shard(t.documents, ["source"], text.has_script("text", A))
    return running_total(per_shard, ["source"], F.col("after"), "running_after")


@query(
    "resume_manifest",
    """with manifest as (select source, count(*) as n_rows, sum(n_chars)::bigint as n_chars
      from documents group by source),
    done as (select source from manifest where cast(substr(source, 4) as int) < 7)
    select m.* from manifest m anti join done d on m.source = d.source""",
)
def resume_manifest(t):
    manifest = t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars")
    )
    done = t.documents.select("source").distinct().filter(labels.numeric_suffix("source") < 7)
    return sinks.unprocessed(manifest, done, "source")


@query(
    "sequential_names",
    """select page_id, lpad(cast(row_number() over (order by page_id) - 1 + 17 as varchar), 6, '0')
       || '.png' as out_name from pages""",
)
def sequential_names(t):
    return sinks.output_names(t.pages.select("page_id"), ["page_id"], already=17)


_UNESCAPED = "html"
for _entity, _char in (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\xa0"),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;?", "&"),
) * 2:
    _UNESCAPED = f"regexp_replace({_UNESCAPED}, '{_entity}', '{_char}', 'g')"


@query(
    "clean_text",
    f"""select page_id, lower(trim(regexp_replace({_UNESCAPED}, '[{views.WS}]+', ' ', 'g'))) as clean
    from pages""",
)
def clean_text(t):
    return t.spread("pages", "page_id").select("page_id", text.clean("html").alias("clean"))


_WORD_SQL = text.WORD.replace("'", "''")


@query(
    "word_split",
    f"""with w as (select doc_id, regexp_extract_all(text, '{_WORD_SQL}') words from documents)
    select doc_id, len(words) as n_words, array_to_string(words, ' ') as words from w""",
)
def word_split(t):
    found = t.documents.select("doc_id", text.words("text").alias("words"))
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.array_join("words", " ").alias("words"),
    )


@query(
    "pad_truncate",
    """with w as (select doc_id, list_transform(string_split(text, ' '),
        lambda s: cast(length(s) % 300 as int)) ids from documents),
    framed as (select doc_id, ids, list_concat([300], list_concat(ids, [301])) f from w)
    select doc_id,
      array_to_string(case when len(f) > 77 then list_concat(f[1:76], [301])
        else list_concat(f, list_transform(range(0, 77 - len(f)), lambda i: 0)) end, ' ') as framed,
      array_to_string(list_concat(ids[1:64],
        list_transform(range(0, greatest(64 - len(ids), 0)), lambda i: 7)), ' ') as padded,
      cast(least(len(ids), 64) as bigint) as attended
    from framed""",
)
def pad_truncate(t):
    ids = F.transform(F.split("text", " ", -1), lambda s: (F.length(s) % 300).cast("int"))
    padded, mask = text.pad_with_mask("ids", 64, pad=7)
    return t.documents.select("doc_id", ids.alias("ids")).select(
        "doc_id",
        joined(text.frame_tokens("ids", 300, 301, 77, truncate=True)).alias("framed"),
        joined(padded).alias("padded"),
        F.aggregate(mask, F.lit(0), lambda acc, m: acc + m).cast("long").alias("attended"),
    )


# A given table of merges, lowest rank first; some make symbols of several bytes out of such symbols.
MERGES = [tuple(pair.split(" ")) for pair in (
    "t h,e r,i n,a n,e n,o n,c h,s t,r e,th e,th e</w>,an d</w>,in g</w>,e r</w>,e n</w>,s ch,i o,io n</w>,t ion</w>,o u,u n,un g</w>,"
    "q u,qu e</w>,Ã ©,Ã ¼,Ã ±,Ã ³,Ã ©</w>,the r,the r</w>,sch Ã¼,l e,le s</w>,d e,de r</w>,de n</w>,ou r</w>,st er</w>,a l,al l</w>,on e,1 2</w>"
).split(",")]


def _merged_sql(symbols: str) -> str:
    for first, second in MERGES:
        symbols = f"replace({symbols}, chr(1) || '{first}' || chr(2) || chr(1) || '{second}' || chr(2), chr(1) || '{first}{second}' || chr(2))"
    return symbols


def _listed_sql(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


@query(
    "bpe_encode",
    f"""with cleaned as (select doc_id, lower(trim(regexp_replace({_UNESCAPED.replace("(html,", "(text,")}, '[{views.WS}]+', ' ', 'g'))) as clean from documents),
    split as (select doc_id, regexp_extract_all(clean, '{_WORD_SQL}') as words from cleaned),
    placed as (select doc_id, unnest(words) as word, unnest(range(len(words))) as pos from split),
    known as (select distinct word, hex(encode(word)) as raw from placed),
    bytes as (select word, list_transform(range(len(raw) // 2), lambda i: ('0x' || substr(raw, 2 * i + 1, 2))::int) as b from known),
    signs as (select word, array_to_string(list_transform(b, lambda x, i: chr(1) || ({_listed_sql(byte_symbols().values())})[list_position({list(byte_symbols())}, x)]
      || case when i = len(b) then '{END}' else '' end || chr(2)), '') as s from bytes),
    merged as (select word, {_merged_sql("s")} as s from signs),
    coded as (select word, case when word in ('<|startoftext|>', '<|endoftext|>') then [word] else string_split(s[2:-2], chr(2) || chr(1)) end as names from merged),
    numbers as (select unnest({_listed_sql(vocabulary(MERGES))}) as name, unnest(range({len(vocabulary(MERGES))})) as id),
    each as (select word, unnest(names) as name, unnest(range(len(names))) as k from coded),
    ids as (select word, string_agg(id::varchar, ' ' order by k) as ids, count(*) as n from each join numbers using (name) group by word),
    found as (select doc_id, string_agg(ids, ' ' order by pos) as ids, sum(n) as n,
      string_agg(case when word in ('<|startoftext|>', '<|endoftext|>') then word else word || ' ' end, '' order by pos) as back
      from placed join ids using (word) group by doc_id)
    select doc_id, coalesce(n, 0)::int as n_ids, md5(coalesce(ids, '')) as ids_md5, md5(coalesce(back, '')) as decoded_md5
    from documents left join found using (doc_id)""",
)
def bpe_encode(t):
    """Byte-pair codes of whole documents by a given table of merges, and the text they decode to."""
    table = t.spark.createDataFrame([(n, *pair) for n, pair in enumerate(MERGES)], "rank int, first string, second string")
    merges = merges_of(table)
    encoded = t.spread("documents", "doc_id").select("doc_id", encode(F.coalesce("text", F.lit("")), merges).alias("ids"))
    return encoded.select(
        "doc_id",
        F.size("ids").alias("n_ids"),
        F.md5(joined("ids")).alias("ids_md5"),
        F.md5(decode_ids("ids", merges)).alias("decoded_md5"),
    )


@query(
    "wrap_slug",
    """select item_id,
      array_to_string(list_transform(range(0, cast(ceil(length(text) / 16.0) as bigint)),
        lambda i: substr(text, i * 16 + 1, 16)), chr(10)) as wrapped,
      substr(text, 1, 16) as short, replace(text, ' ', '-') as slug
    from benchmark""",
)
def wrap_slug(t):
    return t.benchmark.select(
        "item_id",
        text.wrap("text", 16).alias("wrapped"),
        text.shorten("text", 16).alias("short"),
        text.slug("text").alias("slug"),
    )


@query(
    "range_list",
    """with e as (select p_partkey, unnest(list_concat([p_partkey % 7],
        range(cast(p_size as bigint), cast(p_size as bigint) + 3))) i from part)
    select p_partkey, array_to_string(list(i order by i), ' ') as ids from e group by p_partkey""",
)
def range_list(t):
    size = F.col("p_size")
    spec = F.concat(
        size.cast("string"), F.lit("-"), (size + 3).cast("string"), F.lit(", "),
        (F.col("p_partkey") % 7).cast("string"),
    )
    return t.part.select("p_partkey", joined(text.range_list(spec)).alias("ids"))


@query(
    "class_ranges",
    """select p_partkey, p_size from part
    where p_size in (2, 5, 6, 7) or p_size between 30 and 32""",
)
def class_ranges(t):
    """Rows whose class lies in index ranges (ends exclusive)."""
    wanted = t.spark.range(1).select(
        F.explode(text.range_list(F.lit("5-8, 2, 30-33"))).alias("p_size")
    )
    return filters.keep_listed(t.part.select("p_partkey", "p_size"), wanted, ["p_size"])


@query(
    "path_parts",
    """with p as (select page_id, url, string_split(url, '/')[-1] as last from pages)
    select page_id, string_split(last, '.')[1] as stem, string_split(url, '/')[1] as first_part,
      '/data/' || url as full_path,
      regexp_replace(last, '#top$', '_segmentation') as sibling,
      case when length(last) < 16 then lpad(last, 16, '0') else last end || '.jpg' as padded,
      format('id_{}/{}.png', page_id % 11, lpad(cast(page_id % 10000 as varchar), 4, '0')) as styled
    from p""",
)
def path_parts(t):
    last = paths.name("url")
    return t.pages.select(
        "page_id",
        paths.stem("url").alias("stem"),
        paths.folder_class("url").alias("first_part"),
        paths.under_root("/data", "url").alias("full_path"),
        paths.swap_suffix(last, "#top", "_segmentation").alias("sibling"),
        paths.padded_image_name(last).alias("padded"),
        paths.style_content_path(F.col("page_id") % 11, F.col("page_id") % 10000).alias("styled"),
    )


@query(
    "text_length_stats",
    """select lang, min(length(text)) as min_length, max(length(text)) as max_length,
       round(avg(length(text)), 6) as mean_length from documents group by lang""",
)
def text_length_stats(t):
    stats = t.documents.groupBy("lang").agg(*metrics.text_length_stats("text"))
    return stats.withColumn("mean_length", rounded("mean_length"))


@query(
    "script_flags",
    f"""select doc_id, cast(regexp_matches(text, '[{A}]') as bigint) as has_a,
      cast(regexp_matches(text, '[{B}]') as bigint) as has_b, doc_id % 2 = 0 as is_even from documents""",
)
def script_flags(t):
    """Scripts present per document, and whether the even-number row filter passes it."""
    a, b = text.scripts_present("text", [A, B])
    return t.documents.select(
        "doc_id", a.alias("has_a"), b.alias("has_b"), (F.col("doc_id") % 2 == 0).alias("is_even")
    )


@query(
    "file_name_rules",
    f"""with {views.DESCRIPTIONS}, f as (
      select image_id, 'id_' || (image_id % 9) || '/' || case when image_id % 3 = 0
        then replace(file_name, '.jpg', '.PNG') when image_id % 3 = 1 then file_name
        else file_name || '.txt' end as path from descriptions)
    select image_id, path, cast(string_split(string_split(path, '/')[-1], '.')[1] as bigint) as content
    from f where regexp_matches(path, '(?i)\\.(jpg|jpeg|png|ppm|bmp|tif)$')
      and contains(path, 'id') and regexp_matches(path, '^id_[0-6]/')""",
)
def file_name_rules(t):
    case = F.col("image_id") % 3
    name = (
        F.when(case == 0, F.replace("file_name", F.lit(".jpg"), F.lit(".PNG")))
        .when(case == 1, F.col("file_name"))
        .otherwise(F.concat("file_name", F.lit(".txt")))
    )
    path = F.concat(
        F.lit("id_"), (F.col("image_id") % 9).cast("string"), F.lit("/"), name
    )
    files = views.descriptions(t).select("image_id", path.alias("path"))
    return (
        files.filter(filters.is_image_file("path"))
        .filter(F.col("path").contains("id") & F.col("path").rlike("^id_[0-6]/"))
        .select("image_id", "path", paths.content_number("path").alias("content"))
    )


@query(
    "project_valid_rows",
    f"""with {TAGGED}, cut as (select doc_id, lang, array_to_string({A_TAGS}, ' ') text_a
      from tagged_docs)
    select doc_id, text_a, length(text_a) as n_chars from cut where length(text_a) > 0
      and lang <> 'de'""",
)
def project_valid_rows(t):
    """Rows with text, one dropped label, and the requested columns only."""
    a, _ = text.split_tags("keywords", A, B)
    cut = views.tagged_docs(t, spread=True).filter(F.col("lang") != "de").select(
        "doc_id", text.join_tags(a, " ").alias("text_a")
    )
    valid = cut.filter(filters.has_text("text_a")).filter(text.validity("text_a") == 1)
    sized = valid.withColumn("n_chars", F.length("text_a").cast("long"))
    return filters.require_columns(sized, ["doc_id", "text_a", "n_chars"])
