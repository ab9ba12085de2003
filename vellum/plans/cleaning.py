"""Queries of the text cleaners. Texts get planted lines by id, so that every branch has rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.runtime import lit_sql as q
from ..functions.runtime import table
from ..operators import clean
from .registry import query

NOTICES = (
    "Digitized by Google", "This is a digital copy of a book that was preserved for ages.\nFound at books.google.com\nEnd", "LIBRARY", "G o o g l e", "Generated on a day by HathiTrust Digital Library now\nEnd",
    "university of oxford • press and more", "From the collections of a friend\nEnd", "*** START OF THE PROJECT GUTENBERG EBOOK X ***\nBody here\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nTail",
    "Keep it legal and proper", "collect-\ning and Well-\nKnown x-\ny", "\t a\r\nb  c   \n\n\n\nd  ", "abc\n12\ndef\n\n[13]\n\nq\n-- --\nghi", "CHAPTER IV\nThe body", "THE END\nCatalogue of works",
)


def planted(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """documents and their text followed by one of the planted pieces, chosen by id."""
    pick = F.element_at(F.array(*[F.lit(x) for x in NOTICES]), (F.pmod("doc_id", F.lit(len(NOTICES))) + 1).cast("int"))
    return table(spark, d, "documents"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), pick, F.lit("\n"), F.coalesce("title", F.lit("")))


def _chr(s: str) -> str:
    return " || ".join({"\n": "chr(10)", "\t": "chr(9)", "\r": "chr(13)"}.get(x, q(x)) for x in __import__("re").split(r"([\n\t\r])", s) if x)


PLANTED_SQL = "(coalesce(text, '') || chr(10) || (list_value(" + ", ".join(_chr(x) for x in NOTICES) + f"))[(doc_id % {len(NOTICES)}) + 1] || chr(10) || coalesce(title, ''))"
BASE = f"with t as (select doc_id, {PLANTED_SQL} as t from documents)"


def _result(df: DataFrame, c: Column) -> DataFrame:
    return df.select("doc_id", F.md5(c).alias("text_md5"), F.length(c).alias("n_chars"))


def _steps(pairs: list[tuple[str, str]], flags: str, start: str = "t") -> str:
    out = start
    for p, to in pairs:
        out = f"regexp_replace({out}, {q(flags + p)}, {q(to)}, 'g')"
    return out


def _sql(expr: str) -> str:
    return f"{BASE} select doc_id, md5(x) as text_md5, length(x) as n_chars from (select doc_id, {expr} as x from t)"


@query(_sql(_steps([(p, "") for p in P.SCAN_BLOCKS], "(?is)")))
def c01_scan_blocks(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.drop_scan_blocks(t))


_LOW = "lower(x)"
_NOTICE = (
    f"((instr({_LOW}, 'google') > 0 and (length(x) < 100 or instr({_LOW}, 'google') - 1 < 50 or instr({_LOW}, 'google') - 1 > length(x) - 50)) or regexp_matches(x, "
    + q("(?i)^(?:" + "|".join(f"(?:{p})" for p in P.MANGLED_NAMES) + ")")
    + f") or regexp_matches({_LOW}, {q('|'.join(w.replace('.', chr(92) + '.') for w in P.NOTICE_WORDS))}) or trim(x) = 'LIBRARY')"
)


@query(_sql(f"array_to_string(list_filter(string_split(t, chr(10)), lambda x: not {_NOTICE}), chr(10))"))
def c02_notice_lines(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.drop_notice_lines(t))


@query(_sql(_steps([(p, "") for p in P.TRUST_NOTICES], "(?i)")))
def c03_trust_notices(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.drop_trust_notices(t))


@query(_sql(_steps([(p, "") for p in P.LIBRARY_STAMPS], "")))
def c04_library_stamps(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.drop_stamps(t))


@query(_sql(_steps([(r"(?is)^.*?\*{3}\s*START\s+OF\s+.*?PROJECT\s+GUTENBERG.*?\*{3}", ""), (r"(?is)\*{3}\s*END\s+OF\s+.*?PROJECT\s+GUTENBERG.*?\*{3}.*$", "")], "")))
def c05_ebook_markers(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.inside_markers(t))


@query()
def c06_unicode(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.unify_unicode(t, curly_quotes=True))


_STRIP = [(r"^\s+", ""), (r"\s+$", "")]
_WHITE = "replace(replace(replace(t, chr(9), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@query(_sql(_steps([(r"(?m)[ \t]+$", ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), *_STRIP], "", _WHITE)))
def c07_whitespace(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.squeeze_white(t))


@query(_sql(_steps([(r"(?m)^\s*[-\[]*\s*\d{1,4}\s*[-\]]*\s*$", ""), (r"(?m)^\s*[a-zA-Z]\s*$", ""), (r"(?m)^[^a-zA-Z]*$", "")], "")))
def c08_page_artefacts(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.drop_page_artefacts(t))


@query(_sql(_steps([(r"([a-z]{2,})-\n([a-z])", r"\1\2")], "")))
def c09_join_hyphens(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.join_hyphens(t))


@query(_sql("array_to_string(list_transform(string_split(t, chr(10) || chr(10)), lambda p: trim(regexp_replace(replace(p, chr(10), ' '), '  +', ' ', 'g'))), chr(10) || chr(10))"))
def c10_reflow(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.reflow(t))


_STAMPED = f"regexp_matches(s, {q('|'.join(f'(?:{p})' for p in P.LEADING_STAMPS))}) or (length(s) < 80 and regexp_matches(s, {q('|'.join(f'(?:{p})' for p in P.LEADING_WORDS))}))"
_ALPHA = r"length(regexp_replace(s, '[^\p{L}]', '', 'g')) / greatest(length(s), 1)"
_WORDS = r"len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> ''))"
_CONTENT = f"(length(s) > 40 and {_ALPHA} > 0.5) or ({_ALPHA} > 0.8 and {_WORDS} >= 3 and length(s) > 15) or ({_WORDS} >= 4 and {_ALPHA} > 0.6)"


@query(
    f"{BASE}, b as (select doc_id, 'University of X' || chr(10) || 'Harvard College Library' || chr(10) || '7701' || chr(10) || 'ab' || chr(10) || t as t from t), l as (select doc_id, string_split(t, chr(10)) as ls from b), "
    f"u as (select doc_id, i, trim(line) as s from (select doc_id, unnest(ls[1:100]) as line, generate_subscripts(ls[1:100], 1) as i from l)), f as (select doc_id, min(i) as i from u where length(s) > 0 and not ({_STAMPED}) and ({_CONTENT}) group by 1) "
    "select doc_id, md5(x) as text_md5, length(x) as n_chars from (select b.doc_id, case when f.i > 1 then array_to_string(ls[f.i:], chr(10)) else t end as x from b join l on l.doc_id = b.doc_id left join f on f.doc_id = b.doc_id)"
)
def c11_leading_lines(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.drop_leading(F.concat(F.lit("University of X\nHarvard College Library\n7701\nab\n"), t)))


_HEADS = [f"case when regexp_matches(substr(t, 1, 15000), {q('(?m)' + p)}) then length(regexp_extract(substr(t, 1, 15000), {q('(?s)^(.*?)(?m:' + p + ')')}, 1)) end" for p in P.CONTENT_HEADINGS]


@query(_sql(f"case when least({', '.join(_HEADS)}) > 200 then substr(t, least({', '.join(_HEADS)}) + 1) else t end"))
def c12_front_matter(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.drop_front_matter(t))


@query()
def c13_clean_text(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.clean_text(t))


@query("select conv_id, i as turn, md5(translate(m.content, '—–‘’“”', '..''''\"\"')) as text_md5 from (select conv_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from instruct_pairs)")
def c14_message_unicode(spark, d):
    ms = table(spark, d, "instruct_pairs").select("conv_id", F.posexplode("messages").alias("i", "m"))
    return ms.select("conv_id", (F.col("i") + 1).cast("bigint").alias("turn"), F.md5(clean.plain_message(F.col("m.content"))).alias("text_md5"))


_FILL = [*[("(?i)" + p, to) for p, to in clean.FILLERS], (r"  +", " "), (r"^\s*[,;]\s*", ""), (r"\s+([,;.!?])", r"\1"), *_STRIP]
_SAID = "(list_value('I confess that ', 'Indeed, ', '', 'Mark my words , '))[(conv_id % 4) + 1] || coalesce(m.content, '')"


@query(
    f"select conv_id, i as turn, md5(case when m.role = 'assistant' then {_steps(_FILL, '', '(' + _SAID + ')')} else {_SAID} end) as text_md5 "
    "from (select conv_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from instruct_pairs)"
)
def c15_fillers(spark, d):
    ms = table(spark, d, "instruct_pairs").select("conv_id", F.posexplode("messages").alias("i", "m"))
    lead = F.element_at(F.array(*map(F.lit, ("I confess that ", "Indeed, ", "", "Mark my words , "))), (F.pmod("conv_id", F.lit(4)) + 1).cast("int"))
    said = F.concat(lead, F.coalesce("m.content", F.lit("")))
    return ms.select("conv_id", (F.col("i") + 1).cast("bigint").alias("turn"), F.md5(F.when(F.col("m.role") == "assistant", clean.drop_fillers(said)).otherwise(said)).alias("text_md5"))


_THINK = "'<think>a' || chr(10) || 'b</think> ' || coalesce(m.content, '')"


@query(f"select conv_id, i as turn, md5(replace({_THINK}, 'a' || chr(10) || 'b', 'a b')) as text_md5 from (select conv_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from instruct_pairs)")
def c16_flat_reasoning(spark, d):
    ms = table(spark, d, "instruct_pairs").select("conv_id", F.posexplode("messages").alias("i", "m"))
    t = F.concat(F.lit("<think>a\nb</think> "), F.coalesce("m.content", F.lit("")))
    head, tail = F.substring_index(t, "</think>", 1), F.substr(t, F.instr(t, "</think>"))
    flat = F.when(F.instr(t, "</think>") > 0, F.concat(F.translate(head, "\n", " "), tail)).otherwise(t)
    return ms.select("conv_id", (F.col("i") + 1).cast("bigint").alias("turn"), F.md5(flat).alias("text_md5"))


_KEEP = r"""(trim(x) = '' or not ((length(regexp_replace(trim(x), '[^\p{L}\p{N}]', '', 'g')) = 0 and length(trim(x)) > 1) or (length(trim(x)) > 10 and length(regexp_replace(trim(x), '[^\p{L}\p{N}]', '', 'g')) / length(trim(x)) < 0.3)))"""


@query(_sql(f"array_to_string(list_filter(string_split(t, chr(10)), lambda x: {_KEEP}), chr(10))"))
def c21_noise_lines(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.drop_noise_lines(t))


@query(_sql(r"case when regexp_matches(right(t, 5000), '(?m)^\s*THE END\.?\s*$') then left(t, greatest(length(t) - 5000, 0)) || regexp_extract(right(t, 5000), '(?ms)\A(.*?)^\s*THE END\.?\s*$', 1) else t end"))
def c20_trailing_catalogue(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.cut_after_end(t))


@query(_sql(_steps(_STRIP, "", "replace(regexp_replace(t, '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), chr(8203), '')")))
def c22_blank_lines(spark, d):
    df, t = planted(spark, d)
    return _result(df, clean.collapse_blank_lines(t))


_HTML = "'<html><script>x<1</script><p class=a>' || coalesce(title, '') || '</p><br/>' || replace(coalesce(text, ''), chr(10), '</p><p>') || '&amp;&nbsp;&lt;</div></html>'"
_HTML_STEPS = _steps([(r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), (r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr)>", "\n"), (r"<[^>]+>", "")], "", f"({_HTML})")
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    _HTML_STEPS = f"replace({_HTML_STEPS}, {q(_a)}, {q(_b)})"
_HTML_STEPS = _steps([(r"[ \t]+", " "), (r"\n{3,}", "\n\n")], "", _HTML_STEPS)


@query(f"select doc_id, md5(x) as text_md5, length(x) as n_chars from (select doc_id, array_to_string(list_transform(string_split({_HTML_STEPS}, chr(10)), lambda y: trim(y)), chr(10)) as x from documents)")
def c24_html_text(spark, d):
    df = table(spark, d, "documents")
    page = F.concat(F.lit("<html><script>x<1</script><p class=a>"), F.coalesce("title", F.lit("")), F.lit("</p><br/>"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("</p><p>")), F.lit("&amp;&nbsp;&lt;</div></html>"))
    return _result(df, clean.html_text(page))


@query(
    "with l as (select doc_id, unnest(string_split(coalesce(title, '') || ' >>> ' || coalesce(lang, '') || chr(10) || 'teh >>> the' || chr(10) || 'CLEAN', chr(10))) as x from documents), "
    "p as (select doc_id, trim(split_part(x, '>>>', 1)) as a, trim(split_part(x, '>>>', 2)) as b from l where contains(x, '>>>')) "
    "select doc_id, count(*) as n_edits, sum(length(a)) as n_from, sum(length(b)) as n_to from p where a <> '' and b <> '' and (b = 'REMOVE' or length(b) / length(a) between 0.5 and 2.0) group by doc_id"
)
def c26_edit_lists(spark, d):
    df = table(spark, d, "documents")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" >>> "), F.coalesce("lang", F.lit("")), F.lit("\nteh >>> the\nCLEAN"))
    e = df.select("doc_id", F.explode(clean.corrections(text)).alias("e"))
    return e.groupBy("doc_id").agg(F.count("*").alias("n_edits"), F.sum(F.length("e.a")).alias("n_from"), F.sum(F.length("e.b")).alias("n_to"))


_KEY = _steps([(r"[^\w\s]", ""), (r"\s+", " ")], "", "lower(title)")
_KEY = _steps([("^a ", ""), ("^an ", ""), ("^the ", "")], "", f"trim({_KEY})")


@query(f"select doc_id, {_KEY} as title_key from documents where title is not null")
def c30_title_keys(spark, d):
    return table(spark, d, "documents").where("title is not null").select("doc_id", clean.title_key(F.col("title")).alias("title_key"))


@query("select doc_id, source, round(case when ocr_score is null or ocr_score < 0 then -1.0 when source = 'institutional-books' and ocr_score > 1 then ocr_score / 100 else ocr_score end, 6) as score, count(*) as n from raw_documents group by all")
def c33_scores(spark, d):
    raw = table(spark, d, "raw_documents")
    return raw.select("doc_id", "source", F.round(clean.score_0_1(F.col("ocr_score"), F.col("source")), 6).alias("score")).groupBy("doc_id", "source", "score").agg(F.count("*").alias("n"))


@query("select case when year is null then 'unknown' when year < 1800 then 'early' when year < 1850 then 'early century' when year < 1880 then 'mid century' else 'late century' end as era, count(*) as n from documents group by 1")
def c34_eras(spark, d):
    return table(spark, d, "documents").groupBy(clean.era(F.col("year")).alias("era")).agg(F.count("*").alias("n"))


@query(r"select date, cast(nullif(regexp_extract(date, '\b(1[4-9]\d\d|20[0-2]\d)\b', 1), '') as int) as year_any, cast(nullif(regexp_extract(trim(date), '^(\d{4})', 1), '') as int) as year_lead, count(*) as n from book_pages group by all")
def s14_years(spark, d):
    p = table(spark, d, "book_pages")
    return p.select("date", clean.year_of(F.col("date")).alias("year_any"), clean.leading_year(F.col("date")).alias("year_lead")).groupBy("date", "year_any", "year_lead").agg(F.count("*").alias("n"))


@query(r"select conv_id, i as turn, nullif(regexp_extract(m.content, '\\answer\{(.*?)\}', 1), '') as answer, nullif(replace(regexp_extract(replace(m.content, '\answer{', '#### '), '#### (\-?[0-9\.\,]+)', 1), ',', ''), '') as final_number from (select conv_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from instruct_pairs) where m.role = 'assistant'")
def c42_answers(spark, d):
    ms = table(spark, d, "instruct_pairs").select("conv_id", F.posexplode("messages").alias("i", "m")).where("m.role = 'assistant'")
    c = F.col("m.content")
    return ms.select("conv_id", (F.col("i") + 1).cast("bigint").alias("turn"), clean.simple_answer(c).alias("answer"), clean.final_number(F.replace(c, F.lit("\\answer{"), F.lit("#### "))).alias("final_number"))


@query(r"select conv_id, i as turn, case when regexp_matches(r, p) then trim(regexp_extract(r, p, 1)) end as answer from (select conv_id, i, substr(x, strpos(x, '\answer{') + 8) as r, '^((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}' as p from (select conv_id, i, m.content || ' \answer{\frac{1}{2}}' as x from (select conv_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from instruct_pairs) where m.role = 'assistant' and m.content is not null))")
def c43_braced_answers(spark, d):
    ms = table(spark, d, "instruct_pairs").select("conv_id", F.posexplode("messages").alias("i", "m")).where("m.role = 'assistant' and m.content is not null")
    return ms.select("conv_id", (F.col("i") + 1).cast("bigint").alias("turn"), clean.braced_answer(F.concat(F.col("m.content"), F.lit(" \\answer{\\frac{1}{2}}"))).alias("answer"))


@query("select doc_id, 'Multiple Choice question: ' || coalesce(title, '') || chr(10) || '- ' || coalesce(source, '') || '=A' || chr(10) || '- ' || coalesce(domain, '') || '=B' || chr(10) || chr(10) || 'Respond only with the letter of the correct answer.' as prompt from documents")
def c40_choice_prompt(spark, d):
    df = table(spark, d, "documents")
    options = F.array(F.coalesce("source", F.lit("")), F.coalesce("domain", F.lit("")))
    letters = F.array(F.lit("A"), F.lit("B"))
    body = F.array_join(F.zip_with(options, letters, lambda o, k: F.concat(F.lit("- "), o, F.lit("="), k)), "\n")
    return df.select("doc_id", F.concat(F.lit("Multiple Choice question: "), F.coalesce("title", F.lit("")), F.lit("\n"), body, F.lit("\n\nRespond only with the letter of the correct answer.")).alias("prompt"))


@query("select conv_id, source, len(messages) + case when messages[1].role = 'system' then 0 else 1 end as n_messages from instruct_pairs where messages is not null and len(messages) > 0")
def c48_system_prompt(spark, d):
    df = table(spark, d, "instruct_pairs").where("messages is not null and size(messages) > 0")
    sys = F.array(F.struct(F.lit("system").alias("role"), F.lit("Answer plainly.").alias("content")))
    full = F.when(F.get("messages", F.lit(0))["role"] == "system", F.col("messages")).otherwise(F.concat(sys, F.col("messages")))
    return df.select("conv_id", "source", F.size(full).cast("bigint").alias("n_messages"))


@query("select conv_id, source, case when messages[1].role = 'system' and messages[2].role = 'user' then md5(coalesce(messages[1].content, '') || chr(10) || chr(10) || coalesce(messages[2].content, '')) else md5(coalesce(messages[1].content, '')) end as first_md5 from instruct_pairs where len(messages) > 1")
def c47_merged_system(spark, d):
    df = table(spark, d, "instruct_pairs").where("size(messages) > 1")
    a, b = F.get("messages", F.lit(0)), F.get("messages", F.lit(1))
    merged = F.concat(F.coalesce(a["content"], F.lit("")), F.lit("\n\n"), F.coalesce(b["content"], F.lit("")))
    return df.select("conv_id", "source", F.md5(F.when((a["role"] == "system") & (b["role"] == "user"), merged).otherwise(F.coalesce(a["content"], F.lit("")))).alias("first_md5"))
