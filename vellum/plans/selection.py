"""Queries of term lists, validators, prompts, projections and block-wise selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.runtime import lit_sql as q
from ..functions.runtime import table
from ..operators import gates, records, sampling, stats, training
from .gating import _any, _period, _plant, _SPOKEN, _T
from .registry import query

_SAID = "array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: coalesce(m.content, '')), ' ')"


def _in(c: str, words) -> str:
    """Number of the words that occur, in SQL."""
    return "(" + " + ".join(f"cast(contains({c}, {q(w)}) as int)" for w in words) + ")"


def _weighted(c: str, weights) -> str:
    return "(" + " + ".join(f"case when contains({c}, {q(w)}) then {n} else 0 end" for w, n in weights.items()) + ")"


def _cycle(texts: tuple[str, ...], key: str):
    """One of the texts by the key, so that every branch occurs; and the same in SQL."""

    def column():
        return F.element_at(F.array(*[F.lit(x) for x in texts]), (F.pmod(F.col(key), F.lit(len(texts))) + 1).cast("int"))

    return column, f"(list_value({', '.join(q(x) for x in texts)}))[({key} % {len(texts)}) + 1]"


@query(f"select doc_id, coalesce({_period('t', 1915, 5, 500, P.terms_after(1914))}, 'kept') as reason from (select doc_id, {_T} as t from documents)")
def f07_later_cutoff_gate(spark, d):
    t = F.concat("text", _plant("doc_id"))
    reason = gates.period_reason(t, 500, 1915, terms=P.terms_after(1914))
    return table(spark, d, "documents").select("doc_id", F.coalesce(reason, F.lit("kept")).alias("reason"))


_PROBLEMS = ("", " The spin up state.", " \\answer{12}", " An antenna \\answer{3}", " \\answer{ }")
_PROBLEM, _PROBLEM_SQL = _cycle(_PROBLEMS, "conv_id")


@query(
    f"select conv_id, coalesce(case when regexp_matches(t, {_any(P.COMPACT_REJECT)}) then 'later_concept' when conv_id % 11 = 0 then 'has_graphs' when trim(a) = '' then 'no_answer' end, 'kept') as reason "
    rf"from (select conv_id, t, regexp_extract(t, '\\answer\{{(.*?)\}}', 1) as a from (select conv_id, {_SPOKEN} || {_PROBLEM_SQL} as t from instruct_pairs where messages is not null))"
)
def f11_problem_gate(spark, d):
    t = F.concat(gates.spoken(F.col("messages")), _PROBLEM())
    answers = F.array(F.regexp_extract(t, r"\\answer\{(.*?)\}", 1))
    df = table(spark, d, "instruct_pairs").where("messages is not null")
    return df.select("conv_id", F.coalesce(gates.problem_reason(t, answers, F.col("conv_id") % 11 == 0), F.lit("kept")).alias("reason"))


_MARKS, _MARKS_SQL = _cycle(("", " Mark my words.", " I foresee that within fifty years all will change.", " I am persuaded.", " Mark my words, the coming century shall see it; I hold it to be sure."), "conv_id")


@query(f"select conv_id, {_in('t', P.PREDICTIONS)} >= 2 as predicts, {_in('t', P.OPINIONS)} >= 1 as opines from (select conv_id, lower({_SAID} || {_MARKS_SQL}) as t from instruct_pairs where messages is not null)")
def f13_marked_answers(spark, d):
    t = F.lower(F.concat(gates.spoken(F.col("messages"), "assistant"), _MARKS()))
    return table(spark, d, "instruct_pairs").where("messages is not null").select("conv_id", gates.predicts(t).alias("predicts"), gates.opines(t).alias("opines"))


_TOPICS, _TOPICS_SQL = _cycle(("", " The black-body.", " An interferometer.", " The elevator, light as air.", " falling freely in the shaft", ""), "conv_id")


@query(f"select conv_id, {_in('t', P.EVAL_TOPICS)} > 0 as excluded from (select conv_id, lower({_SPOKEN} || {_TOPICS_SQL}) as t from instruct_pairs where messages is not null)")
def f14_topic_exclusion(spark, d):
    t = F.lower(F.concat(gates.spoken(F.col("messages")), _TOPICS()))
    return table(spark, d, "instruct_pairs").where("messages is not null").select("conv_id", (gates.count_in(t, P.EVAL_TOPICS) > 0).alias("excluded"))


@query(
    r"""select doc_id, length(t) >= 50 and length(title) >= 20 and length(source) >= 10 as insight,
length(regexp_replace(regexp_replace(regexp_extract(r, '(?s)<think>(.*?)</think>', 1), '^\s+', ''), '\s+$', '')) >= 100 and contains(r, '\answer{') and length(title) >= 20 as trace,
length(t) >= 100 and length(title) >= 50 and regexp_matches(lower(t), 'observation|observed|experimental') and contains(lower(t), 'assumption') and contains(t, '?') as contradiction,
contains(r, '<think>') and contains(r, '</think>') and regexp_matches(r, '\\answer\s*\{') as form
from (select doc_id, coalesce(title, '') as title, coalesce(source, '') as source, coalesce(text, '') || case when doc_id % 3 = 0 then ' It was observed; which assumption fails?' else '' end as t,
'<think> ' || substr(coalesce(text, ''), 1, 140) || case when doc_id % 4 = 0 then '' else ' </think>' end || '\answer' || case when doc_id % 5 = 0 then ' ' else '' end || '{7}' as r from documents)"""
)
def f15_validators(spark, d):
    text = F.coalesce("text", F.lit(""))
    t = F.concat(text, F.when(F.col("doc_id") % 3 == 0, " It was observed; which assumption fails?").otherwise(""))
    r = F.concat(F.lit("<think> "), F.substring(text, 1, 140), F.when(F.col("doc_id") % 4 == 0, "").otherwise(" </think>"), F.lit("\\answer"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(""), F.lit("{7}"))
    title, source = F.coalesce("title", F.lit("")), F.coalesce("source", F.lit(""))
    df = table(spark, d, "documents")
    return df.select("doc_id", records.valid_insight(t, title, source).alias("insight"), records.valid_reply(r, title).alias("trace"), records.valid_contradiction(t, title).alias("contradiction"), records.valid_form(r).alias("form"))


_NOTES, _NOTES_SQL = _cycle(("", "A facsimile.", "law and theology", "Nabu Press", "a treatise on heat", "sermons, law, optics"), "doc_id")


@query(
    f"select doc_id, {_in('t', P.REPRINTS)} >= 1 as reprint, {_in('t', P.OFF_TOPIC)} >= 2 and {_weighted('t', P.ON_TOPIC)} < 2 as off_topic, {_weighted('t', P.ON_TOPIC)} as score "
    f"from (select doc_id, lower(coalesce(title, '') || ' ' || {_NOTES_SQL}) as t from documents)"
)
def f19_weighted_terms(spark, d):
    t = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), _NOTES()))
    score = gates.weighted_in(t, P.ON_TOPIC)
    return table(spark, d, "documents").select("doc_id", (gates.count_in(t, P.REPRINTS) >= 1).alias("reprint"), ((gates.count_in(t, P.OFF_TOPIC) >= 2) & (score < 2)).alias("off_topic"), score.alias("score"))


@query(
    f"select coalesce(reason, 'kept') as reason, count(*) as n from (select case when year is null then 'no_date' when year < 1500 or year > 1899 then 'bad_date' when {_in('r', P.REPRINTS)} >= 1 then 'modern_reprint' "
    f"when {_in('s', P.OFF_TOPIC)} >= 2 and {_weighted('s', P.ON_TOPIC)} < 2 then 'off_topic' when {_weighted('s', P.ON_TOPIC)} < 1 then 'low_score' end as reason from (select year, lower({_NOTES_SQL} || ' ' || coalesce(title, '') || ' ' || coalesce(source, '')) as r, "
    f"lower(coalesce(domain, '') || ' ' || coalesce(title, '')) as s from documents)) group by 1"
)
def f20_catalogue_report(spark, d):
    reason = gates.catalogue_reason(F.col("title"), F.col("domain"), _NOTES(), F.col("source"), F.col("year"))
    return table(spark, d, "documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_CASUAL, _CASUAL_SQL = _cycle(("", "Hey, what's this stuff? ", "Esteemed sir, permit me. ", "Dear sir, that's cool. ", "so I was thinking "), "conv_id")


@query(
    f"select conv_id, i as turn, {_in('t', P.CASUAL_MARKS)} > {_in('t', P.FORMAL_MARKS)} and {_in('t', P.CASUAL_MARKS)} >= 1 as modern from (select conv_id, i, lower({_CASUAL_SQL} || coalesce(m.content, '')) as t from "
    "(select conv_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from instruct_pairs) where m.role = 'user')"
)
def f21_modern_prompts(spark, d):
    ms = table(spark, d, "instruct_pairs").select("conv_id", F.posexplode("messages").alias("i", "m")).where("m.role = 'user'")
    t = F.concat(_CASUAL(), F.coalesce("m.content", F.lit("")))
    return ms.select("conv_id", (F.col("i") + 1).cast("bigint").alias("turn"), gates.is_modern_prompt(t).alias("modern"))


@query(
    f"select book_filename, coalesce(case when octet_length(encode(coalesce(text, ''))) < 20480 then 'too_small' when length(coalesce(author, '')) / 16.0 < 0.8 then 'low_score' "
    f"when {_in('lower(coalesce(title, ' + chr(39) * 2 + '))', P.NOT_TEACHING)} >= 1 then 'excluded' end, 'kept') as reason from physics_books"
)
def f29_book_gate(spark, d):
    b = table(spark, d, "physics_books")
    score = F.length(F.coalesce("author", F.lit(""))) / 16.0
    return b.select("book_filename", F.coalesce(gates.book_reason(F.col("text"), score, F.col("title"), 20), F.lit("kept")).alias("reason"))


@query(
    "select doc_id, md5(array_to_string(list_transform([coalesce(lang, ''), coalesce(source, '')], lambda c: 'What is it?' || chr(10) || 'A mill' || chr(10) || chr(10) || coalesce(title, '') || chr(10) || c), '|')) as choice, "
    "md5('It ran; and stopped' || chr(10) || chr(10) || coalesce(source, '') || '; and ended|' || 'It ran; and stopped' || chr(10) || chr(10) || coalesce(lang, '') || '; and ended') as schema, "
    r"md5(regexp_replace(l, '\s+$', '') || '|' || l || coalesce(domain, '')) as lm from (select *, 'One two three' || chr(10) || chr(10) || trim(coalesce(title, '')) || ' ' as l from documents)"
)
def c45_prompts(spark, d):
    v = {c: F.coalesce(c, F.lit("")) for c in ("title", "lang", "source", "domain")}
    joined = lambda a: F.md5(F.array_join(a, "|"))
    return table(spark, d, "documents").select(
        "doc_id", joined(records.choice_prompts(v["title"], F.array(v["lang"], v["source"]), "\n", [("What is it?", "A mill")])).alias("choice"),
        joined(records.schema_prompts(F.array(v["source"], v["lang"]), F.lit("and ended"), "; ", [("It ran", "and stopped")])).alias("schema"),
        joined(records.lm_prompts(v["title"], v["domain"], " ", [(" One two ", "three")])).alias("lm"),
    )


@query(
    r"select conv_id, 'converted' as _source, md5(p) as prompt_md5, regexp_extract(a, '\\answer\{(.*?)\}', 1) as gold_answer from (select conv_id, (list_filter(messages, lambda m: m.role = 'user'))[-1].content as p, "
    r"(list_filter(messages, lambda m: m.role = 'assistant'))[-1].content || case when conv_id % 4 = 0 then ' \answer{' || conv_id || '}' else '' end as a from instruct_pairs where messages is not null) where regexp_matches(a, '\\answer\{[^{}]*\}')"
)
def c50_problems_from_conversations(spark, d):
    """Conversations with a marked answer as problems; others are skipped."""
    answered = lambda m: F.struct(m["role"].alias("role"), F.when((m["role"] == "assistant") & (F.col("conv_id") % 4 == 0), F.concat(m["content"], F.lit(" \\answer{"), F.col("conv_id"), F.lit("}"))).otherwise(m["content"]).alias("content"))
    df = table(spark, d, "instruct_pairs").where("messages is not null").select("conv_id", records.gold_problem(F.transform("messages", answered)).alias("p"))
    return df.where("p.gold_answer is not null").select("conv_id", F.lit("converted").alias("_source"), F.md5("p.prompt").alias("prompt_md5"), F.col("p.gold_answer").alias("gold_answer"))


@query(
    "select conv_id, case when conv_id % 5 = 0 then null when conv_id % 3 <> 2 and len(u) > 0 and len(a) > 0 then 2 end::bigint as n_messages, case when conv_id % 5 = 0 then 'unfit' end as reason from "
    "(select conv_id, coalesce(messages[1].content, '') as u, coalesce(messages[2].content, '') as a from instruct_pairs)"
)
def g07_json_replies(spark, d):
    """Replies as a model gives them: fenced, rejecting, broken off."""
    said = lambda i: F.coalesce(F.get("messages", F.lit(i))["content"], F.lit(""))
    body = F.to_json(F.struct(F.when(F.col("conv_id") % 5 == 0, True).alias("rejected"), F.when(F.col("conv_id") % 5 == 0, "unfit").alias("reason"), said(0).alias("user"), said(1).alias("assistant")))
    cut = F.when((F.col("conv_id") % 3 == 2) & (F.col("conv_id") % 5 != 0), F.left(body, F.length(body) - 2)).otherwise(body)
    reply = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("```json\n"), cut, F.lit("\n```"))).otherwise(cut)
    got = table(spark, d, "instruct_pairs").select("conv_id", records.conversation_reply(reply).alias("r"))
    return got.select("conv_id", F.when(F.col("r.messages").isNotNull(), F.size("r.messages")).cast("bigint").alias("n_messages"), F.col("r.reason").alias("reason"))


@query(
    "with s as (select source as g, count(*) as n, md5('0|' || coalesce(source, '')) as h from documents group by 1), v as (select g from (select g, n, sum(n) over (order by h, g nulls first) - n as before from s) where before < greatest(1, floor(0.3 * (select count(*) from documents)))) "
    "select doc_id, case when exists (select 1 from v where v.g is not distinct from documents.source) then 'val' else 'train' end as split from documents"
)
def m05_group_validation(spark, d):
    return sampling.group_validation(table(spark, d, "documents").select("doc_id", "source"), "source", 0.3).select("doc_id", "split")


@query(
    "with p as (select doc_id, doc_id // 64 as b from documents where length(text) >= 500), s as (select b, count(*) as n, md5('0|' || b) as h from p group by 1), v as (select b from (select b, sum(n) over (order by h, b) - n as before from s) where before < 200) "
    "select doc_id from p where b in (select b from v) order by md5(doc_id::varchar), doc_id limit 100"
)
def m08_block_sample(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text")
    return sampling.block_sample(df, F.expr("doc_id div 64"), F.length("text") >= 500, "doc_id", 100).select("doc_id")


@query("select l_returnflag, round(slope, 5) as slope, round(my - slope * mx, 4) as intercept, round(1 - (syy - 2 * slope * sxy + slope * slope * sxx) / syy, 5) as r2 from (select *, sxy / (sxx + 1000) as slope from (select l_returnflag, avg(x) as mx, avg(y) as my, covar_pop(y, x) * count(*) as sxy, var_pop(x) * count(*) as sxx, var_pop(y) * count(*) as syy from (select l_returnflag, l_quantity as x, l_extendedprice as y from lineitem) group by 1))")
def a23_ridge(spark, d):
    r = stats.ridge(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice"), 1000.0)
    return r.select("l_returnflag", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 5).alias("r2"))


@query(
    "with l as (select value, row_number() over (order by value) - 1 as r, count(*) over () as n, avg(value) over () as mean from (select value from events where event_type <> 'error' and value is not null order by event_id desc limit 100)) "
    "select max(n) as n, round(max(mean), 6) as mean, " + ", ".join(f"max(case when r = least(floor(n * {p} / 100), n - 1) then value end) as p{p}" for p in (50, 95, 99)) + " from l"
)
def a15_latest_ok(spark, d):
    """Figures of the last hundred requests without an error."""
    last = table(spark, d, "events").where("event_type <> 'error' and value is not null").orderBy(F.desc("event_id")).limit(100).select("value")
    got = last.agg(F.array_sort(F.collect_list("value")).alias("v"), F.avg("value").alias("mean")).withColumn("n", F.size("v"))
    at = lambda p: F.get("v", F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1).cast("int")).alias(f"p{p}")
    return got.select(F.col("n").cast("bigint").alias("n"), F.round("mean", 6).alias("mean"), at(50), at(95), at(99))


@query("select doc_id, title from documents where title is not null")
def t02_round_trip(spark, d):
    """Titles encoded between two ids and decoded again: the titles themselves."""
    df = table(spark, d, "documents").where("title is not null")
    ids = training.encoded(df, "doc_id", F.col("title"), prepend=50256, append=50256)
    return ids.select("doc_id", training.decoded(F.slice("ids", 2, F.size("ids") - 2)).alias("title"))


@query()
def t04_token_bytes(spark, d):
    return training.token_bytes(spark).groupBy("n_bytes").agg(F.count("*").alias("n_tokens"))


@query()
def a20_token_compression(spark, d):
    """Bytes a token by source, with the vocabulary's own tokens."""
    docs = table(spark, d, "documents").where("text is not null")
    ids = training.encoded(docs.select("doc_id", "text"), "doc_id", F.col("text")).select("doc_id", F.size("ids").alias("n_ids"))
    per = docs.select("doc_id", "source", F.octet_length("text").alias("n_bytes")).join(ids, "doc_id")
    return per.groupBy("source").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_ids").alias("n_tokens"), F.round(F.sum("n_bytes") / F.sum("n_ids"), 6).alias("bytes_per_token"))


@query()
def t07_long_chunks(spark, d):
    r = training.rendered(table(spark, d, "instruct_pairs"), "conv_id", "messages", training.RANKS, limit=1_000_000)
    parts = r.select("conv_id", F.explode(training.long_chunks(F.col("ids"), 512, 50256)).alias("c"))
    return parts.select("conv_id", "c.chunk_no", "c.own_row", F.size("c.ids").alias("n_ids"))
