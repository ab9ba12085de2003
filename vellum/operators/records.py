"""Parsing and formatting of single records: headers of archives, edits, prompts, traces, code, names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import _sub, braced_answer, once, strip

#: Literal markers of e-books, and marks at the end of an encyclopedia page.
START_MARKS = ("*** START OF THIS PROJECT GUTENBERG", "*** START OF THE PROJECT GUTENBERG", "*END*THE SMALL PRINT")
END_MARKS = ("*** END OF THIS PROJECT GUTENBERG", "*** END OF THE PROJECT GUTENBERG", "End of the Project Gutenberg", "End of Project Gutenberg", "***END OF THE PROJECT GUTENBERG")
PAGE_ENDS = ("Public domain", "This work is in the public domain", "↑", "Retrieved from")


def page_header(c: Column) -> Column:
    """A page that starts with a left arrow: from past the first zero-width space in 3,000 characters, else the right arrow in 1,000; one numeric line dropped."""
    z, arrow = F.instr(F.substring(c, 1, 3000), "\u200b"), F.instr(F.substring(c, 1, 1000), "→")
    cut = F.when(z > 0, F.substr(c, z + 1)).when(arrow > 0, F.substr(c, arrow + 1)).otherwise(c)
    return F.when(F.startswith(c, F.lit("←")), _sub(cut, r"^\s*\d+\s*\n", "")).otherwise(c)


def page_footer(c: Column) -> Column:
    """Without what begins, at a line start, with the earliest end mark of the last 2,000 characters."""
    base = F.greatest(F.length(c) - 2000, F.lit(0))
    tail = F.right(c, F.lit(2000))
    at = F.least(*[once(F.instr(tail, m), lambda x: F.when(x > 0, x)) for m in PAGE_ENDS])
    head = once(at, lambda a: F.substr(c, F.lit(1), base + a - 1))
    line = F.length(head) - F.instr(F.reverse(head), "\n") + 1
    return F.when(at.isNull(), c).otherwise(F.rtrim(F.when(F.instr(head, "\n") > 0, F.substr(c, F.lit(1), line - 1)).otherwise(F.lit(""))))


def service_header(c: Column, name: str = "google") -> Column:
    """If the scanning service is named in the first 500 characters, what follows the line of its address."""
    named = F.contains(F.lower(F.substring(c, 1, 500)), F.lit(name))
    return F.when(named & c.rlike(r"(?i)https?://\S*" + name), _sub(c, r"(?is)^.*?https?://\S*" + name + r"[^\n]*\n", "")).otherwise(c)


def preamble(c: Column) -> Column:
    """Cut at the first blank line after the third line and within the first twenty."""
    ls = F.slice(F.split(c, "\n", -1), 1, 20)
    blank = F.array_position(F.transform(ls, lambda x, i: (F.trim(x) == "") & (i >= 3)), True)
    return F.when(blank > 0, F.array_join(F.slice(F.split(c, "\n", -1), blank.cast("int") + 1, 1_000_000_000), "\n")).otherwise(c)


def literal_markers(c: Column) -> Column:
    """Text between the first literal start marker's line and the first literal end marker."""
    for m in reversed(START_MARKS):
        at = F.instr(c, m)
        rest = F.substr(c, at)
        c = F.when(at > 0, F.substr(rest, F.instr(rest, "\n") + 1)).otherwise(c)
    ends = F.least(*[once(F.instr(c, m), lambda x: F.when(x > 0, x)) for m in END_MARKS])
    return strip(once(c, lambda t: F.when(ends.isNull(), t).otherwise(F.substr(t, F.lit(1), ends - 1))))


def archive_trimmed(c: Column, head_lines: int = 500, clean_run: int = 5) -> Column:
    """Without the leading part up to the last notice line before five text lines in a row; blank lines count for neither."""
    notice = r"(?i)library|digitized|archive|internet|university|funding|copyright"
    ls = F.split(c, "\n", -1)
    state = lambda i, run, cut, done: F.struct(i.cast("int").alias("i"), run.cast("int").alias("run"), cut.cast("int").alias("cut"), done.alias("done"))

    def step(a, x):
        blank, bad = F.trim(x) == "", x.rlike(notice)
        run = F.when(a["done"] | blank, a["run"]).when(bad, 0).otherwise(a["run"] + 1)
        cut = F.when(~a["done"] & ~blank & bad, a["i"] + 1).otherwise(a["cut"])
        return state(a["i"] + 1, run, cut, a["done"] | (run >= clean_run))

    cut = F.aggregate(F.slice(ls, 1, head_lines), state(F.lit(0), F.lit(0), F.lit(0), F.lit(False)), step)["cut"]
    return F.array_join(F.slice(ls, cut + 1, 1_000_000_000), "\n")


def file_slug(creator: Column, title: Column, size: int = 60) -> Column:
    """lower-case words of creator's last name and title joined by underscores."""
    last = F.regexp_extract(F.trim(F.substring_index(F.coalesce(creator, F.lit("unknown")), ",", 1)), r"(\S+)$", 1)
    slug = _sub(_sub(F.lower(F.concat_ws(" ", last, F.coalesce(title, F.lit("")))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return _sub(F.substring(slug, 1, size), r"_+$", "")


def json_reply(c: Column, schema: str) -> Column:
    """JSON of a reply inside fences or other words: the outermost braces."""
    bare = _sub(_sub(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    outer = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.from_json(F.when(outer == "", bare).otherwise(outer), schema)


def tool_parts(c: Column) -> Column:
    """Text, tool call and tool output of ``<<expr=result>>``, cut at its last equals sign, in order."""
    pieces = F.filter(F.split(c, r"(?=<<)|(?<=>>)", -1), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(3), F.length(p) - 4)
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    each = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(r"(?s)^<<.*=.*>>$"),
            F.array(part("python", F.substr(body(p), F.lit(1), F.length(body(p)) - F.length(F.substring_index(body(p), "=", -1)) - 1)), part("python_output", F.substring_index(body(p), "=", -1))),
        ).otherwise(F.array(part("text", p))),
    )
    return F.flatten(each)


def code_block(c: Column) -> Column:
    """The first fenced block, else the whole text."""
    inner = F.regexp_extract(c, r"(?s)```(?:python)?\s*\n(.*?)\n?```", 1)
    return F.when(inner != "", inner).otherwise(strip(c))


def import_lines(c: Column) -> Column:
    """Leading import lines; comments and blank lines between them are passed over."""
    ls = F.transform(F.split(c, "\n", -1), lambda x: F.trim(x))
    state = lambda got, done: F.struct(got.cast("array<string>").alias("got"), done.alias("done"))
    step = lambda a, x: state(
        F.when(~a["done"] & x.rlike("^(?:import|from) "), F.concat(a["got"], F.array(x))).otherwise(a["got"]), a["done"] | ~((x == "") | F.startswith(x, F.lit("#")) | x.rlike("^(?:import|from) "))
    )
    return F.array_join(F.aggregate(ls, state(F.array(), F.lit(False)), step)["got"], "\n")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    off = F.array_position(same, False)
    return F.when(off > 0, off - 1).otherwise(F.size(same))


def trace(thought: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>"), strip(thought), F.lit("</think>\n\\answer{"), strip(answer), F.lit("}"))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("applied", T.IntegerType()), T.StructField("failed", T.IntegerType())]))
def apply_edits(text: pd.Series, edits: pd.Series) -> pd.DataFrame:
    """Edits in turn: everywhere as they are, else once with any white space, else once in any case; REMOVE deletes."""
    out = []
    for t, es in zip(text, edits):
        ok = bad = 0
        for e in es if es is not None and t is not None else ():
            a, b = e["a"], "" if e["b"] == "REMOVE" else e["b"]
            if a in t:
                t, ok = t.replace(a, b), ok + 1
                continue
            m = re.search(r"\s+".join(map(re.escape, a.split())), t) or re.search(re.escape(a), t, re.IGNORECASE)
            if m:
                t, ok = t[: m.start()] + b + t[m.end() :], ok + 1
            else:
                bad += 1
        out.append((t, ok, bad))
    return pd.DataFrame(out, columns=["text", "applied", "failed"])


def casual(c: Column, key: Column) -> Column:
    """Prompts as people type them: shortened, without stops, lower case, with misprints, each by chance of the key.

    In three of ten prompts one word in eight of four letters or more has two inner letters exchanged or one left out.
    """
    roll = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}|"), key.cast("string"))), 1, 4), 16, 10).cast("int") / 65536
    first = F.regexp_extract(c, r"(?s)^(.*?[.!?])\s", 1)
    c = F.when((F.length(c) > 200) & (roll(1) < 0.25) & (first != ""), first).otherwise(c)
    c = F.when(roll(2) < 0.5, _sub(c, r"[.,;:!?]+$", "")).otherwise(c)
    c = F.when(roll(3) < 0.7, F.lower(c)).otherwise(c)
    lot = lambda i, k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}|"), key.cast("string"), F.lit("|"), i.cast("string"))), 1, 4), 16, 10).cast("int")

    def misprint(w: Column, i: Column) -> Column:
        at = F.pmod(lot(i, 6), F.length(w) - 3) + 2
        a, b = F.substr(w, at, F.lit(1)), F.substr(w, at + 1, F.lit(1))
        return F.concat(F.substr(w, F.lit(1), at - 1), F.when(F.pmod(lot(i, 7), F.lit(2)) == 0, F.concat(b, a)).otherwise(b), F.substr(w, at + 2))

    able = lambda w, i: w.rlike(r"^[A-Za-z]{4,}$") & (lot(i, 5) < 0.12 * 65536)
    misprinted = F.array_join(F.transform(F.split(c, " ", -1), lambda w, i: F.when(able(w, i), misprint(w, i)).otherwise(w)), " ")
    return F.when(roll(4) < 0.3, misprinted).otherwise(c)


def valid_trace(c: Column, least: int = 100) -> Column:
    """One reasoning block of at least ``least`` characters followed by an answer."""
    inner = F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1)
    return (F.length(inner) >= least) & c.rlike(r"(?s)</think>.*\\answer\{.+\}")


def certainty(logits: Column) -> Column:
    """log-sum-exp of an array of logits less their mean."""
    top = F.array_max(logits)
    lse = top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return lse - F.aggregate(logits, F.lit(0.0), lambda a, x: a + x) / F.size(logits)


def _long(c: Column, n: int) -> Column:
    return F.coalesce(F.length(c) >= n, F.lit(False))


def valid_insight(setup: Column, insight: Column, excerpt: Column) -> Column:
    return _long(setup, 50) & _long(insight, 20) & _long(excerpt, 10)


def valid_reply(assistant: Column, user: Column | None = None, least: int = 100) -> Column:
    """A reasoning block of ``least`` characters without the blanks around it, and an answer mark; a question of 20 characters if one is given."""
    inner = strip(F.regexp_extract(assistant, r"(?s)<think>(.*?)</think>", 1))
    ok = F.coalesce((F.length(inner) >= least) & F.contains(assistant, F.lit("\\answer{")), F.lit(False))
    return ok if user is None else ok & _long(user, 20)


def valid_contradiction(prompt: Column, gold: Column) -> Column:
    """A long prompt with observations, assumptions and a question, and a gold answer of 50 characters."""
    low = F.lower(prompt)
    any_in = lambda *ws: F.coalesce(low.rlike("|".join(ws)), F.lit(False))
    return _long(prompt, 100) & _long(gold, 50) & any_in("observation", "observed", "experimental") & any_in("assumption") & any_in("which assumption", "reconcile", r"\?")


def valid_form(reply: Column) -> Column:
    """Both tags of a reasoning block and an answer mark, in any place."""
    return F.coalesce(F.contains(reply, F.lit("<think>")) & F.contains(reply, F.lit("</think>")) & reply.rlike(r"\\answer\s*\{"), F.lit(False))


MESSAGE = "array<struct<role:string,content:string>>"


def conversation_reply(reply: Column, several_turns: bool = False) -> Column:
    """(messages, reason) of a JSON reply, fenced or not: a conversation, a stated rejection, or both null if it is neither.

    One turn has user and assistant; several are four or more, in turn, none empty.
    """
    bare = _sub(_sub(strip(reply), r"^```[^\n]*\n", ""), r"\n\s*```\s*$", "")
    got = F.from_json(bare, f"rejected boolean, reason string, user string, assistant string, turns {MESSAGE}")
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    if several_turns:
        turns = got["turns"]
        in_turn = F.transform(turns, lambda m, i: F.coalesce(m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False)) & filled(m["content"]))
        ok, messages = F.coalesce((F.size(turns) >= 4) & F.forall(in_turn, lambda x: x), F.lit(False)), turns
    else:
        ok = filled(got["user"]) & filled(got["assistant"])
        messages = F.array(*[F.struct(F.lit(r).alias("role"), got[r].alias("content")) for r in ("user", "assistant")])
    rejected = F.coalesce(got["rejected"], F.lit(False))
    return F.struct(F.when(ok & ~rejected, messages).alias("messages"), F.when(rejected, F.coalesce(got["reason"], F.lit("unknown"))).alias("reason"))


def gold_problem(messages: Column) -> Column:
    """(prompt, gold_answer) of the last question and answer of a conversation; null gold without an answer mark."""
    said = lambda role: F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]
    return F.struct(said("user").alias("prompt"), braced_answer(said("assistant")).alias("gold_answer"))


def shots(examples: list[str]) -> Column:
    return F.lit("".join(f"{x}\n\n" for x in examples))


def choice_prompts(query: Column, choices: Column, glue: str, examples: list[tuple[str, str]] = ()) -> Column:
    """A prompt per choice: worked examples, the query and the choice."""
    head = shots([f"{q}{glue}{a}" for q, a in examples])
    return F.transform(choices, lambda c: F.concat(head, query, F.lit(glue), c))


def schema_prompts(contexts: Column, continuation: Column, glue: str, examples: list[tuple[str, str]] = ()) -> Column:
    """A prompt per context, all with one continuation."""
    head = shots([f"{c}{glue}{x}" for c, x in examples])
    return F.transform(contexts, lambda c: F.concat(head, c, F.lit(glue), continuation))


def lm_prompts(context: Column, continuation: Column, glue: str, examples: list[tuple[str, str]] = ()) -> Column:
    """Two prompts: without the continuation, white space at its ends dropped, and with it; contexts are trimmed."""
    lead = F.concat(shots([f"{c.strip()}{glue}{x}" for c, x in examples]), strip(context), F.lit(glue))
    return F.array(strip(lead), F.concat(lead, continuation))
