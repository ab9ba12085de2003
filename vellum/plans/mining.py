"""Queries of dialogue mining. Quotations are planted in each text by its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import table
from ..operators import dialogue
from .registry import query

SPEECH = (
    '"It is a fine day for it," said Mr. Darcy. "I cannot agree to that," replied Elizabeth.', '"The glass," said he, "is falling very fast." Captain Smith answered, "Then we must turn back now."',
    '"We are alone here at last," said she. "We are not alone at all," said she.', "No words are spoken.",
)


def _spoken():
    return F.concat(F.element_at(F.array(*map(F.lit, SPEECH)), (F.pmod("doc_id", F.lit(len(SPEECH))) + 1).cast("int")), F.lit("\n"), F.coalesce("text", F.lit("")))


@query()
def g01_quotes(spark, d):
    return dialogue.quotes(table(spark, d, "documents"), "doc_id", _spoken())


@query()
def g05_dialogue_turns(spark, d):
    q = dialogue.two_speakers(dialogue.sessions(dialogue.quotes(table(spark, d, "documents"), "doc_id", _spoken()), "doc_id"), "doc_id")
    return dialogue.merged_turns(q, ["doc_id", "session"], "pos", "speaker", "quote")


@query()
def g03_quote_sessions(spark, d):
    """Sessions of attributed quotes that two speakers, or one who is a pronoun, hold."""
    s = dialogue.two_speakers(dialogue.sessions(dialogue.quotes(table(spark, d, "documents"), "doc_id", _spoken()), "doc_id"), "doc_id")
    return s.groupBy("doc_id", "session").agg(F.count("*").alias("n_quotes"), F.min("pos").alias("first_pos"))


@query(
    """with t as (select doc_id, string_split('"A first line that is quoted."' || chr(10) || '"A second line that is quoted."' || chr(10) || coalesce(text, ''), chr(10)) as ls from documents),
u as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from t), p as (select doc_id, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from u),
o as (select doc_id, pos, pos + length(line) as past from p where regexp_matches(trim(line), '^"[^"]{10,}"$')), r as (select doc_id, pos, sum(fresh) over (partition by doc_id order by pos) as run from (select *, case when pos - lag(past) over (partition by doc_id order by pos) > 200 then 1 else 0 end as fresh from o))
select doc_id, run::bigint as run, count(*) as n_quotes, min(pos)::bigint as first_pos from r group by 1, 2 having count(*) >= 2"""
)
def g02_quote_runs(spark, d):
    lines = F.concat(F.lit('"A first line that is quoted."\n"A second line that is quoted."\n'), F.coalesce("text", F.lit("")))
    return dialogue.quote_runs(table(spark, d, "documents"), "doc_id", lines)


_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null)"


@query(f"select doc_id, count(*) as n_lines, count(distinct regexp_extract(l, '^([A-Z]{{3,}})\\. ', 1)) as n_speakers from {_LINES} where regexp_matches(l, '^[A-Z]{{3,}}\\. \\S') group by doc_id")
def g06_script_lines(spark, d):
    ls = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(dialogue.script_lines(F.col("text"))).alias("x")).where("x.cap <> ''")
    return ls.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.countDistinct("x.cap").alias("n_speakers"))


@query(
    f"with s as (select doc_id, i, regexp_extract(l, '^([A-Z]{{3,}})\\. ', 1) as who, regexp_replace(l, '^[A-Z]{{3,}}\\. ', '') as t from {_LINES} where regexp_matches(l, '^[A-Z]{{3,}}\\. \\S')), "
    "r as (select *, sum(new) over (partition by doc_id order by i) as turn from (select *, case when who = lag(who) over (partition by doc_id order by i) then 0 else 1 end as new from s)) "
    "select doc_id, turn::bigint as turn, any_value(who) as role, md5(string_agg(t, ' ' order by i)) as text_md5 from r group by 1, 2"
)
def g04_merged_turns(spark, d):
    ls = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(dialogue.script_lines(F.col("text"))).alias("i", "x")).where("x.cap <> ''").select("doc_id", "i", F.col("x.cap").alias("who"), F.col("x.line").alias("t"))
    return dialogue.merged_turns(ls, ["doc_id"], "i", "who", "t").select("doc_id", F.col("turn").cast("bigint").alias("turn"), "role", F.md5("text").alias("text_md5"))
