"""Queries of the quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.runtime import lit_sql as q
from ..functions.runtime import table
from ..operators import gates
from .registry import query

#: Planted sentences by id: clean, later term, term with and without evidence, years at and under the bound, context at and under it.
PLANTS = (
    "", " The photon was known.", " A standard model of the particle.", " A standard model of virtue.", " 1900 1911 1925 1999 2029", " 1900 1911 1925 1999 19000", " radiation of nuclear fusion", " radiation and fusion and fusion",
    " Wikipedia and the internet say so.", "",
)


def _plant(key: str):
    return F.element_at(F.array(*[F.lit(x) for x in PLANTS]), (F.pmod(key, F.lit(len(PLANTS))) + 1).cast("int"))


PLANT_SQL = "(list_value(" + ", ".join(q(x) for x in PLANTS) + "))"


def _any(terms) -> str:
    return q("(?i)" + "|".join("(?:" + p.replace("(?=.*", "(?:.*") + ")" for p in terms))


def _hits(c: str, terms, flags: str = "(?i)") -> str:
    return " + ".join(f"cast(regexp_matches({c}, {q(flags + p.replace('(?=.*', '(?:.*'))}) as int)" for p in terms)


def _years(c: str, first: int) -> str:
    return f"len(list_filter(regexp_extract_all({c}, '\\b(\\d{{4}})\\b', 1), lambda y: cast(y as int) between {first} and 2029))"


def _period(c: str, first: int = 1900, years: int = 5, least: int = 500, terms=P.ALWAYS_REJECT) -> str:
    return (
        f"case when {c} is null or length({c}) < {least} then 'too_short' when regexp_matches({c}, {_any(terms)}) then 'always_reject' "
        f"when {_years(c, first)} >= {years} then 'later_years' when {_hits(c, P.CONTEXT_TERMS)} >= 3 then 'context' end"
    )


_T = f"text || {PLANT_SQL}[(doc_id % {len(PLANTS)}) + 1]"


@query(f"select coalesce(reason, 'kept') as reason, count(*) as n_docs, sum(length(t)) as n_chars from (select t, {_period('t')} as reason from (select {_T} as t from documents)) group by 1")
def f05_period_gate_report(spark, d):
    t = F.concat("text", _plant("doc_id"))
    return gates.report(table(spark, d, "documents"), gates.period_reason(t), F.length(t))


@query(
    f"select doc_id, coalesce(case when year > 1880 then 'metadata_year' else {_period('t', 1881, 5, 300, P.terms_after(1904))} end, 'kept') as reason from (select doc_id, year, {_T} as t from documents)"
)
def f06_cutoff_gate(spark, d):
    t = F.concat("text", _plant("doc_id"))
    reason = F.coalesce(gates.period_reason(t, 300, 1881, terms=P.terms_after(1904)), F.lit("kept"))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("year") > 1880, "metadata_year").otherwise(reason).alias("reason"))


_SPOKEN = "array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), ' ')"


@query(
    f"select coalesce(reason, 'kept') as reason, count(*) as n from (select case when regexp_matches(t, {_any(P.ALWAYS_REJECT)}) then 'always_reject' when {_years('t', 1900)} >= 2 then 'later_years' "
    f"when {_hits('t', P.CONTEXT_TERMS)} >= 3 then 'context' when regexp_matches(t, {_any(P.META_REFERENCES)}) then 'meta_reference' end as reason "
    f"from (select {_SPOKEN} || {PLANT_SQL}[(conv_id % {len(PLANTS)}) + 1] as t from instruct_pairs)) group by 1"
)
def f09_conversation_gate(spark, d):
    t = F.concat(gates.spoken(F.col("messages")), _plant("conv_id"))
    return table(spark, d, "instruct_pairs").groupBy(F.coalesce(gates.conversation_reason(t), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"select doc_id, (regexp_matches(t, {_any(P.TIER_ONE)}) or {_hits('t', P.TIER_TWO, '(?is)')} >= 2) as later from (select doc_id, {_T} as t from documents where text is not null)")
def f04_two_tier(spark, d):
    t = F.concat("text", _plant("doc_id"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", gates.two_tier(t).alias("later"))


@query("select doc_id, " + " + ".join(f"len(regexp_extract_all(substr(text, 1, 30000), {q(p)}))" for p in P.OCR_ARTIFACTS) + " as n_artefacts from documents where text is not null")
def f03_artefacts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", gates.artefacts(F.col("text")).cast("bigint").alias("n_artefacts"))


@query(r"select doc_id, case when length(s) = 0 then 0.0 else round(1 - len(regexp_extract_all(s, '[\p{C}\x{0}-\x{8}\x{b}-\x{1f}\x{7f}]|[\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) / length(s), 6) end as ratio from (select doc_id, regexp_replace(substr(text, 1, 10000), '[\n\t]', ' ', 'g') as s from documents where text is not null)")
def f02_printable(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(gates.printable_ratio(F.col("text")), 6).alias("ratio"))


_BAD_CHARS = r"[\p{C}\x{0}-\x{8}\x{b}-\x{1f}\x{7f}]|[\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PRINTABLE = f"(1 - len(regexp_extract_all(regexp_replace(substr(text, 1, 10000), '[\\n\\t]', ' ', 'g'), {q(_BAD_CHARS)})) / greatest(length(substr(text, 1, 10000)), 1))"
_ARTEFACTS = " + ".join(f"len(regexp_extract_all(substr(text, 1, 30000), {q(p)}))" for p in P.OCR_ARTIFACTS)


@query(
    "select source, coalesce(reason, 'kept') as reason, count(*) as n from (select source, case when text is null or length(text) < 500 then 'too_short' when norm >= 0 and norm < case when source in ('institutional-books', 'blbooks') then 0.9 else 0 end then 'low_score' "
    f"when legibility >= 0 and legibility < 0.9 then 'illegible' when {_PRINTABLE} < 0.85 then 'unprintable' when {_ARTEFACTS} > 50 then 'artefacts' when regexp_matches(text, {_any(P.TIER_ONE)}) or {_hits('text', P.TIER_TWO, '(?is)')} >= 2 then 'later_terms' end as reason "
    "from (select *, case when ocr_score is null or ocr_score < 0 then -1 when source = 'institutional-books' and ocr_score > 1 then ocr_score / 100 else ocr_score end as norm from raw_documents)) group by all"
)
def f01_document_gate(spark, d):
    raw = table(spark, d, "raw_documents")
    reason = gates.document_reason(F.col("text"), F.col("source"), F.col("ocr_score"), F.col("legibility"), 500, min_legibility=0.9)
    return raw.groupBy("source", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "select conv_id, len(r) >= 2 and len(list_filter(r, lambda m, i: coalesce(m.role <> case when i % 2 = 1 then 'user' else 'assistant' end, true))) = 0 as alternates from "
    "(select conv_id, case when messages[1].role = 'system' then messages[2:] else messages end as r from instruct_pairs where messages is not null)"
)
def f16_alternation(spark, d):
    return table(spark, d, "instruct_pairs").where("messages is not null").select("conv_id", gates.alternates(F.col("messages")).alias("alternates"))


@query(
    r"select conv_id, i as turn, length(t) between 20 and 2000 and not regexp_matches(t, '(?:^|\s)(?:66|99|6 6|9 9)(?:\s|$)') and length(regexp_replace(t, '[^a-zA-Z0-9\s.,;:!?''\"\-\(\)]', '', 'g')) / length(t) >= 0.85 "
    r"and not (length(regexp_replace(t, '[^A-Za-z]', '', 'g')) > 0 and length(regexp_replace(t, '[^A-Z]', '', 'g')) / length(regexp_replace(t, '[^A-Za-z]', '', 'g')) > 0.5) "
    r"and not regexp_matches(t, '(?i)^(?:CHAPTER|BOOK|PART|SECTION|VOL(?:UME)?\.?)\s+[IVXLCDM0-9]+') and not regexp_matches(t, '^\s*[0-9]{1,4}\s*$') and not regexp_matches(t, '\.{3,}\s*[0-9]+\s*$') "
    r"and not regexp_matches(t, '[0-9]{1,3}\s+[A-Z]{2,}(?:\s+[A-Z]{2,}){1,5}\.?\s') as good from (select conv_id, i, m.content as t from (select conv_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from instruct_pairs) where length(m.content) > 0)"
)
def f17_turn_quality(spark, d):
    ms = table(spark, d, "instruct_pairs").select("conv_id", F.posexplode("messages").alias("i", "m")).where("length(m.content) > 0")
    return ms.select("conv_id", (F.col("i") + 1).cast("bigint").alias("turn"), gates.turn_quality(F.col("m.content")).alias("good"))


@query(r"select doc_id, round(case when length(text) = 0 then 0.0 else length(regexp_replace(text, '[\x{0}-\x{7f}]', '', 'g')) / length(text) end, 6) as share from documents where text is not null")
def f18_non_ascii(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(gates.non_ascii_share(F.col("text")), 6).alias("share"))


@query("select source, sum(case when length(text) >= 200 then 1 else 0 end) as n_200, sum(case when length(text) >= 1000 then 1 else 0 end) as n_1000, sum(case when length(text) >= 5000 then 1 else 0 end) as n_5000, count(*) as n from documents group by source")
def f23_length_gates(spark, d):
    n = lambda k: F.sum(F.when(F.length("text") >= k, 1).otherwise(0))
    return table(spark, d, "documents").groupBy("source").agg(n(200).alias("n_200"), n(1000).alias("n_1000"), n(5000).alias("n_5000"), F.count("*").alias("n"))


@query(r"select form, count(*) as n from (select case when regexp_matches(a, '^-?[0-9]+(?:\.[0-9]+)?$') then 'number' when regexp_matches(a, '^-?[0-9]+\s*/\s*[0-9]+$') or contains(a, '\frac') then 'fraction' else 'symbolic' end as form from (select trim((list_value(cast(l_quantity as int)::varchar, l_linenumber || ' / ' || l_orderkey, '\frac{1}{2}', l_returnflag))[(l_orderkey % 4) + 1]) as a from lineitem)) group by 1")
def f24_answer_forms(spark, d):
    li = table(spark, d, "lineitem")
    a = F.element_at(F.array(F.col("l_quantity").cast("int").cast("string"), F.concat("l_linenumber", F.lit(" / "), "l_orderkey"), F.lit("\\frac{1}{2}"), F.col("l_returnflag")), (F.pmod("l_orderkey", F.lit(4)) + 1).cast("int"))
    return li.groupBy(gates.answer_form(a).alias("form")).agg(F.count("*").alias("n"))


@query(
    "select coalesce(case when messages is null or len(messages) = 0 then 'no_messages' when len(messages) > 500 then 'too_many' when len(list_filter(messages, lambda m: length(coalesce(m.content, '')) = 0)) > 0 then 'empty_message' "
    "when len(list_filter(messages, lambda m: length(coalesce(m.content, '')) > 600)) > 0 then 'long_message' when list_sum(list_transform(messages, lambda m: length(coalesce(m.content, '')))) > 1500 then 'long_request' "
    "when len(list_filter(messages, lambda m: not coalesce(m.role in ('user', 'assistant', 'system'), false))) > 0 then 'bad_role' end, 'ok') as error, count(*) as n from instruct_pairs group by 1"
)
def f26_requests(spark, d):
    e = gates.request_error(F.col("messages"), max_chars=600, max_total=1500)
    return table(spark, d, "instruct_pairs").groupBy(F.coalesce(e, F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query(r"select source, domain, sum(cast(regexp_matches(lower(text), 'heat|optic|electric|magnet|lens') as int)) as n_hits, count(*) as n, round(avg(cast(regexp_matches(lower(text), 'heat|optic|electric|magnet|lens') as int)), 6) as density from documents where text is not null group by all")
def f27_topic_density(spark, d):
    hit = F.lower("text").rlike("heat|optic|electric|magnet|lens").cast("int")
    return table(spark, d, "documents").where("text is not null").groupBy("source", "domain").agg(F.sum(hit).alias("n_hits"), F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("density"))
