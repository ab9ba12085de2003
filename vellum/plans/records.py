"""Queries of record parsing and formatting, and of the remaining samplers and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import table, with_index
from ..operators import chunk, joins, records, sampling, stats
from .registry import query

_DOC = "coalesce(text, '')"


def _docs(spark, d):
    return table(spark, d, "documents").withColumn("t", F.coalesce("text", F.lit("")))


@query(r"select doc_id, md5(regexp_replace(substr(x, instr(x, chr(8203)) + 1), '^\s*\d+\s*\n', '')) as text_md5 from (select doc_id, '← back' || chr(8203) || '77' || chr(10) || " + _DOC + " as x from documents)")
def c17_page_headers(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(records.page_header(F.concat(F.lit("← back\u200b77\n"), "t"))).alias("text_md5"))


@query("select doc_id, md5(" + _DOC + ") as text_md5 from documents")
def c18_service_headers(spark, d):
    page = F.concat(F.lit("A notice by Google.\nSee http://books.google.com/x\n"), "t")
    return _docs(spark, d).select("doc_id", F.md5(records.service_header(page)).alias("text_md5"))


@query("select doc_id, md5(" + _DOC + ") as text_md5 from documents")
def c19_preambles(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(records.preamble(F.concat(F.lit("a\nb\nc\nd\n\n"), "t"))).alias("text_md5"))


@query("select doc_id, md5(" + _DOC + ") as text_md5 from documents")
def c23_archive_headers(spark, d):
    head = F.concat(F.lit("Digitized by X\n\nNotes\nUniversity Library\n"), "t")
    return _docs(spark, d).select("doc_id", F.md5(records.archive_trimmed(head, 4)).alias("text_md5"))


@query(r"select doc_id, md5(regexp_replace(regexp_replace(" + _DOC + r", '^\s+', ''), '\s+$', '')) as text_md5 from documents")
def c25_literal_markers(spark, d):
    t = F.concat(F.lit("x\n*** START OF THE PROJECT GUTENBERG EBOOK ***\n"), "t", F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK ***\ny"))
    return _docs(spark, d).select("doc_id", F.md5(records.literal_markers(t)).alias("text_md5"))


@query("select doc_id, md5(replace(replace(" + _DOC + ", 'the', 'THE'), 'of', '')) as text_md5, cast(contains(" + _DOC + ", 'the') as int) + cast(contains(replace(" + _DOC + ", 'the', 'THE'), 'of') as int) as applied from documents where contains(" + _DOC + ", 'the') and contains(" + _DOC + ", 'of')")
def c27_applied_edits(spark, d):
    edits = F.array(F.struct(F.lit("the").alias("a"), F.lit("THE").alias("b")), F.struct(F.lit("of").alias("a"), F.lit("REMOVE").alias("b")))
    df = _docs(spark, d).where(F.contains("t", F.lit("the")) & F.contains("t", F.lit("of")))
    return df.select("doc_id", records.apply_edits(F.col("t"), edits).alias("r")).select("doc_id", F.md5("r.text").alias("text_md5"), F.col("r.applied").alias("applied"))


@query()
def c28_casual_prompts(spark, d):
    ms = table(spark, d, "instruct_pairs").select("conv_id", F.posexplode("messages").alias("turn", "m")).where("m.role = 'user'")
    return ms.select("conv_id", "turn", records.casual(F.col("m.content"), F.concat_ws("-", "conv_id", "turn")).alias("prompt"))


@query(r"select doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_extract(trim(coalesce(source, 'unknown')), '(\S+)$', 1) || ' ' || coalesce(title, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), '_+$', '', 'g') as slug from documents")
def c31_file_slugs(spark, d):
    return _docs(spark, d).select("doc_id", records.file_slug(F.col("source"), F.col("title")).alias("slug"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def c32_fenced_json(spark, d):
    reply = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", records.json_reply(reply, "k bigint")["k"].alias("k"))


@query("select book_filename, coalesce(author, 'Unknown') as author, coalesce(nullif(year, 0), 1880) as year, coalesce(title, replace(replace(book_filename, '.txt', ''), '_', ' ')) as title from physics_books")
def c35_default_metadata(spark, d):
    b = table(spark, d, "physics_books")
    return b.select("book_filename", F.coalesce("author", F.lit("Unknown")).alias("author"), F.coalesce(F.nullif("year", F.lit(0)), F.lit(1880)).alias("year"), F.coalesce("title", F.replace(F.replace("book_filename", F.lit(".txt"), F.lit("")), F.lit("_"), F.lit(" "))).alias("title"))


@query(r"select book_filename, regexp_extract(book_filename, '^(.*)_(\d+)\.txt$', 1) as stem, regexp_extract(book_filename, '^(.*)_(\d+)\.txt$', 2) as part from physics_books")
def c36_file_stems(spark, d):
    p = r"^(.*)_(\d+)\.txt$"
    return table(spark, d, "physics_books").select("book_filename", F.regexp_extract("book_filename", p, 1).alias("stem"), F.regexp_extract("book_filename", p, 2).alias("part"))


@query("select l_orderkey, l_linenumber, 3::bigint as n_parts, '2*' || l_linenumber || '=' || 2 * l_linenumber as call, (2 * l_linenumber)::varchar as output from lineitem where l_linenumber > 0")
def c41_tool_calls(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber > 0")
    n = F.col("l_linenumber")
    parts = records.tool_parts(F.concat(F.lit("So <<2*"), n, F.lit("="), 2 * n, F.lit("="), 2 * n, F.lit(">>")))
    return li.select("l_orderkey", "l_linenumber", parts.alias("p")).select("l_orderkey", "l_linenumber", F.size("p").cast("bigint").alias("n_parts"), F.get("p", F.lit(1))["text"].alias("call"), F.get("p", F.lit(2))["text"].alias("output"))


@query("select doc_id, 'import os' || chr(10) || 'from re import sub' as imports, 'x = ' || doc_id as program from documents")
def c44_code_parts(spark, d):
    prompt = F.lit("import os\n# note\n\nfrom re import sub\ndef f():\n  import sys")
    reply = F.concat(F.lit("Sure:\n```python\nx = "), "doc_id", F.lit("\n```\nDone"))
    return table(spark, d, "documents").select("doc_id", records.import_lines(prompt).alias("imports"), records.code_block(reply).alias("program"))


@query("select doc_id, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k]))::int as n_common from (select doc_id, string_split(coalesce(title, ''), ' ') as a, string_split('A Treatise on the Wheel', ' ') as b from documents)")
def c46_common_prefix(spark, d):
    a, b = F.split(F.coalesce("title", F.lit("")), " "), F.split(F.lit("A Treatise on the Wheel"), " ")
    n = F.least(F.size(a), F.size(b))
    return table(spark, d, "documents").select("doc_id", records.common_prefix(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)).cast("int").alias("n_common"))


@query(r"select doc_id, '<think>' || coalesce(title, '') || '</think>' || chr(10) || '\answer{' || coalesce(lang, '') || '}' as trace, length(coalesce(title, '')) >= 40 and length(coalesce(lang, '')) > 0 as valid from documents")
def c49_traces(spark, d):
    x = records.trace(F.coalesce("title", F.lit("")), F.coalesce("lang", F.lit("")))
    return table(spark, d, "documents").select("doc_id", x.alias("trace"), records.valid_trace(x, 40).alias("valid"))


@query("select doc_id, case when n_tokens = 0 or mean_prior < -11.36 then 'low' when mean_prior > -9.91 then 'high' else 'keep' end as verdict, case when n_tokens = 0 or mean_prior < -9.2 then 'low' when mean_prior > -7.6 then 'high' else 'keep' end as verdict_here from (select doc_id, coalesce(n, 0) as n_tokens, round(coalesce(m, 0), 6) as mean_prior from documents left join (select doc_id, count(*) as n, avg(log2_prior) as m from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents) join (select token, log2(count(*) / (sum(count(*)) over ())) as log2_prior from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents) group by token) using (token) group by doc_id) using (doc_id))")
def f12_prior_filter(spark, d):
    df = table(spark, d, "documents")
    s = stats.document_scores(df, ["doc_id"], F.col("text"), stats.priors(stats.exploded(df, [], F.col("text"))))
    """By the published thresholds, and by some that part these texts, whose few words are all frequent."""
    mean, n = F.round("mean_prior", 6), F.col("n_tokens")
    return s.select("doc_id", stats.prior_verdict(mean, n).alias("verdict"), stats.prior_verdict(mean, n, -9.2, -7.6).alias("verdict_here"))


@query(r"select conv_id, i as turn, regexp_matches(m.content, '\d+\s*(?:feet|yards|inches|degrees|pounds|ounces|grains|shillings|leagues|fathoms|minutes|acres)') or regexp_matches(m.content, '\\answer\{-?[\d.]+\}') as quantitative from (select conv_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from instruct_pairs) where m.role = 'assistant' and m.content is not null")
def f22_quantities(spark, d):
    ms = table(spark, d, "instruct_pairs").select("conv_id", F.posexplode("messages").alias("i", "m")).where("m.role = 'assistant' and m.content is not null")
    c = F.col("m.content")
    hit = c.rlike(r"\d+\s*(?:feet|yards|inches|degrees|pounds|ounces|grains|shillings|leagues|fathoms|minutes|acres)") | c.rlike(r"\\answer\{-?[\d.]+\}")
    return ms.select("conv_id", (F.col("i") + 1).cast("bigint").alias("turn"), hit.alias("quantitative"))


@query()
def x06_conversation_parts(spark, d):
    ms = table(spark, d, "instruct_pairs").where("size(messages) >= 2").select("conv_id", F.get("messages", F.lit(0)).alias("q"), F.get("messages", F.lit(1)).alias("a"))
    return ms.select("conv_id", F.posexplode(chunk.split_messages(F.col("a.content"), 250)).alias("part", "content")).join(ms.select("conv_id", F.length("q.content").alias("n_prefix")), "conv_id")


@query("select label, a.vec_id as vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), c.m), 4) as cosine from embeddings a join (select label, list(v order by i) as m from (select label, i, avg(x::double) as v from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i) group by label) c using (label)")
def a24_cosine_to_centre(spark, d):
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    j = e.join(joins.small(centre), "label")
    return j.select("label", "vec_id", F.round(dot(F.col("embedding"), F.col("m")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("m"), F.col("m"))), 4).alias("cosine"))


@query("select event_type, round(avg(cast(value > 50 as int)), 6) as over_share, round(avg(cast(value is null as int)), 6) as null_share, count(*) as n from events group by 1")
def a28_batch_fractions(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("over_share"), F.round(F.avg(F.col("value").isNull().cast("int")), 6).alias("null_share"), F.count("*").alias("n"))


@query("select vec_id, round(m + ln(list_sum(list_transform(e, lambda x: exp(x - m)))) - list_sum(e) / len(e), 4) as certainty from (select vec_id, list_transform(embedding, lambda x: x::double) as e, list_max(embedding)::double as m from embeddings)")
def r07_self_certainty(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(records.certainty(F.transform("embedding", lambda x: x.cast("double"))), 4).alias("certainty"))


@query("select p_partkey as key, part from (select p_partkey, 'a' as part, row_number() over (order by md5(p_partkey::varchar), p_partkey) as i from part) where i <= 300 union all select s_suppkey, 'b' from (select s_suppkey, row_number() over (order by md5(s_suppkey::varchar), s_suppkey) as i from supplier) where i <= 60")
def m10_ratio_mix(spark, d):
    def first(name, key, n, part):
        r = with_index(table(spark, d, name).select(F.col(key).alias("key")), F.md5(F.col("key").cast("string")), "key")
        return r.where(F.col("idx") < n).select("key", F.lit(part).alias("part"))

    return first("part", "p_partkey", 300, "a").unionByName(first("supplier", "s_suppkey", 60, "b"))


@query("select conv_id, i as turn, rank from (select conv_id, i, row_number() over (partition by conv_id order by md5(conv_id || '|' || i), i) as rank from (select conv_id, unnest(range(0, 5)) as i from (select distinct conv_id from instruct_pairs)) where i <> conv_id % 5) where rank <= 2")
def m13_few_shot(spark, d):
    c = table(spark, d, "instruct_pairs").select("conv_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("i <> conv_id % 5").withColumn("i", F.col("i").cast("bigint"))
    picked = sampling.per_group(c.withColumn("k", F.concat_ws("|", "conv_id", "i")), ["conv_id"], F.col("k"), 2)
    from pyspark.sql import Window

    return picked.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.md5("k"), "i")).cast("bigint")).select("conv_id", F.col("i").alias("turn"), "rank")


@query("select doc_id, octet_length(encode(coalesce(text, ''))) as n_bytes, ceil(length(coalesce(text, '')) / 4.2)::bigint as tokens_42, length(coalesce(text, '')) // 4 as tokens_4 from documents")
def t08_token_estimates(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.octet_length(t).alias("n_bytes"), F.ceil(F.length(t) / 4.2).alias("tokens_42"), F.floor(F.length(t) / 4).alias("tokens_4"))


@query()
def x04_overlapping_windows(spark, d):
    return chunk.overlapping_windows(table(spark, d, "physics_books"), "book_filename", size=6000, overlap=1200).select("book_filename", "chunk_idx", F.length("chunk").alias("n_chars"))


@query()
def x07_excerpts(spark, d):
    return table(spark, d, "physics_books").select("book_filename", F.length(chunk.excerpts(F.col("text"), F.col("book_filename"))).alias("n_chars"))


@query()
def t03_rendered(spark, d):
    from ..operators import training

    r = training.rendered(table(spark, d, "instruct_pairs"), "conv_id", "messages", training.RANKS)
    return r.select("conv_id", F.size("ids").alias("n_ids"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_supervised"))


@query("select conv_id, round(cast((conv_id % 10)::varchar = (conv_id % 7)::varchar as int) * 0.5 + cast((conv_id % 10)::varchar = (conv_id % 3)::varchar as int) * 0.5, 6)::double as reward from (select distinct conv_id from instruct_pairs)")
def r02_multi_reward(spark, d):
    from ..operators import training

    c = table(spark, d, "instruct_pairs").select("conv_id").distinct()
    part = lambda k: (F.col("conv_id") % k).cast("string")
    return c.select("conv_id", training.share_of_golds(part(10), F.array(part(7), part(3))).alias("reward"))


@query("select user_id, count(*) as n, round(avg(cast(upper(substr(event_type, 1, 1)) = 'C' as int)), 6) as accuracy from events group by 1")
def r04_letter_accuracy(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg((F.upper(F.substring("event_type", 1, 1)) == "C").cast("int")), 6).alias("accuracy"))


_FORM = r"case when l_linenumber = 1 then 'number' when l_linenumber = 2 then 'fraction' else 'symbolic' end"


@query(f"select key, form from (select key, form, row_number() over (order by case form when 'number' then 0 when 'fraction' then 1 else 2 end, md5(key), key) as i, row_number() over (partition by form order by md5(key), key) as j from (select l_orderkey || '-' || l_linenumber as key, {_FORM} as form from lineitem)) where i <= 20000 - 100 or (form = 'symbolic' and j <= 100)")
def m11_priority_fill(spark, d):
    n = F.col("l_linenumber")
    form = F.when(n == 1, "number").when(n == 2, "fraction").otherwise("symbolic")
    li = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), form.alias("form"))
    rank = F.when(F.col("form") == "number", 0).when(F.col("form") == "fraction", 1).otherwise(2)
    ordered = with_index(li.withColumn("rank", rank).withColumn("h", F.md5("key")), "rank", "h", "key")
    first = ordered.where("rank = 2").agg(F.min("idx").alias("first"))
    return ordered.join(F.broadcast(first), F.lit(True)).where((F.col("idx") < 20_000 - 100) | ((F.col("rank") == 2) & (F.col("idx") < F.col("first") + 100))).select("key", "form")


@query("select p_partkey, i <= 515 as picked from (select p_partkey, row_number() over (order by md5(p_partkey::varchar), p_partkey) as i from part)")
def m12_exact_split(spark, d):
    p = with_index(table(spark, d, "part").select("p_partkey").withColumn("h", F.md5(F.col("p_partkey").cast("string"))), "h", "p_partkey")
    return p.select("p_partkey", (F.col("idx") < 515).alias("picked"))


@query("select event_id, (list_value('plain', 'plain', 'terse', 'ornate'))[('0x' || substr(md5('0|' || event_id), 1, 4))::int % 4 + 1] as manner from events")
def m14_weighted_choice(spark, d):
    pick = F.pmod(sampling.chance(F.col("event_id")), F.lit(4)) + 1
    return table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("plain", "plain", "terse", "ornate"))), pick).alias("manner"))


@query()
def a25_two_components(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(e).transform(e)
    return out.select("vec_id", "label", F.round(vector_to_array("p")[0], 3).alias("x"), F.round(vector_to_array("p")[1], 3).alias("y"))
