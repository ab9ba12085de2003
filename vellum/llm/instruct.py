"""Defects of question-answer pairs: empty, copied, refusal, wrong language, truncated.

Refusals are found by the templates of their openings. The opening clauses that say no in the first person,
whatever the answer's length, are reduced to distinct texts and clustered by MinHash with exact
verification (word pairs, likeness 0.6). A cluster, a clause and those alike to it, is a refusal template if
it opens the answers of several unrelated prompts or if it holds one of the seed templates. An answer is a
refusal if such a template is among its opening clauses and little of it lies outside templates and question:
outside the clusters, the clauses that recur in other answers of that kind, and the question's words. Copies, languages and endings are checked pair by pair.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import checkpointed
from .language import LanguageModel, word_scores
from .neardup import FEW, near_duplicate_links

OPENING_CLAUSES = 5
#: An answer declines if at most so many words, or this share of its words, lie outside templates and question.
SPARE_WORDS, SPARE_SHARE = 9, 0.2
#: Known ways to decline, which need not recur to count (fixed values).
SEEDS = (
    "i cannot answer that question", "i can't do that", "i am not able to help with this matter", "i am unable to comply with your request",
    "i must decline to speak of it", "i shall not undertake to answer", "it is not in my power to give any reply to this", "no answer of mine can be given here",
    "it would not be proper for me to say", "i would rather not discuss this subject", "i don't have enough information to respond to that",
    "i know nothing that would let me reply to you", "i have no liberty to treat of what you ask", "this is a thing upon which i may not pronounce",
    "such an enquiry lies outside what i am permitted to answer", "as an assistant i do not give replies of this kind",
    "i'm sorry but i can't assist with that", "i cannot help with that request", "i am not permitted to answer this", "i can't provide that information",
    "je ne peux pas répondre à cette question", "ich kann diese frage nicht beantworten", "no puedo responder a esta pregunta", "non posso rispondere a questa domanda",
    "ik kan deze vraag niet beantwoorden", "respondere non possum",
)
FIRST_PERSON = re.compile(r"\b(?:i|me|my|mine|we|je|ich|ik|no puedo|non posso|possum)\b")
DECLINE = re.compile(r"\b(?:not|no|cannot|can't|don't|won't|unable|decline|nothing|outside|refuse|beyond|excused|never|pas|nicht|niet|non)\b")
DOUBLE = re.compile(r"\b(?:cannot|can't|could not|couldn't) (?:but|help)\b")
CLAUSE = re.compile(r"[.!?;:,\n]+")
LEAD = re.compile(r"^(?:but|for|and|as|then|unfortunately|alas|i regret that|that) (?=.* .* )")
NAMES = {
    "en": "english|anglais|englisch\\w*|inglés|inglese|engels\\w*|anglic\\w*", "fr": "french|français|französisch\\w*|francés|francese|frans\\w*|gallic\\w*",
    "de": "german|allemand|deutsch\\w*|alemán|tedesco|duits\\w*|germanic\\w*", "la": "latin\\w*|latein\\w*|latijn\\w*", "it": "italian\\w*|italien|italienisch\\w*|italiaans\\w*",
    "es": "spanish|espagnol|spanisch\\w*|español|castellano|spagnolo|spaans\\w*|hispanic\\w*", "nl": "dutch|néerlandais|hollandais|niederländisch\\w*|holländisch\\w*|holandés|neerlandés|olandese|nederlands\\w*|hollandsch\\w*|batavic\\w*",
}
ASKED = {lang: re.compile(rf"\b(?:{names})\b", re.IGNORECASE) for lang, names in NAMES.items()}
PLACEHOLDER = re.compile(
    r"^[\W_]*(?:(?:no|none|not) (?:answer|response|reply|given|provided|available)|none|none given|null|nil|nan|n ?/? ?a|empty|blank|answer|assistant|response|reply|a|tbd|todo|\\?answer ?\{ ?\})?[\W_]*$",
    re.IGNORECASE,
)
TERMINAL = re.compile("[.!?…][\"'”’“»›)\\]}]*$")
CLOSED = re.compile("(?:[”»)\\]}]|\\\\(?:answer|boxed)\\{[^{}]*\\})$")
ITEM = re.compile(r"^\s*(?:[-*•–—·+]|\(?\w{1,4}[.)])\s+\S")
HANGING = frozenset("the a an of to and or but that which with for in on at by from as than his her its their our my your this these those such every is was were are be been had has have may might must not no who whose when while where because since if le la les un une des du de et ou que qui dans pour par sur avec der die das ein eine und oder den dem des mit von zu el los las y o con por il lo gli e di che per una het een en van op met dat et cum ad qui quae quod".split())
#: Words that begin a clause, so that a few words after them are no whole answer.
OPENERS = frozenset("what if as no nor let it there having when while whereas although because since thus how that's".split())
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def pairs(df: DataFrame, id_col: str = "conv_id", messages_col: str = "messages") -> DataFrame:
    """id, pair_no, question, answer: one row per user message; the answer is the assistant message right after, else null.

    Null messages arrays and null roles give no pair. Repeated conversations give repeated rows.
    """
    m = F.col("m")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{messages_col}`").alias("m")).where("m is not null")
    at = F.filter(F.transform(m, lambda x, i: F.struct(i.alias("i"), F.lower(F.trim(x["role"])).alias("role"))), lambda x: x["role"] == "user")
    each = rows.select("id", "m", F.posexplode(at).alias("k", "u"))
    nxt = F.get("m", F.col("u.i") + 1)
    return each.select(
        F.col("id"), (F.col("k") + 1).cast("int").alias("pair_no"), F.get("m", F.col("u.i"))["content"].alias("question"),
        F.when(F.lower(F.trim(nxt["role"])) == "assistant", nxt["content"]).alias("answer"),
    )


def is_empty(answer: str | None) -> bool:
    return answer is None or PLACEHOLDER.match(answer.strip()) is not None


def is_copy(question: str, answer: str) -> bool:
    """The answer's words are the question's, give or take a few, perhaps more than once over."""
    q = Counter(WORD.findall(question.lower()))
    nq = sum(q.values())
    if nq < 3 or 0.5 * len(answer.split()) > 3.5 * nq:
        return False
    said = WORD.findall(answer.lower())
    a, na = Counter(said), len(said)
    if na < 3:
        return False
    tail = Counter(said[-nq:])
    if na <= nq + 5 and sum(min(n, q[w]) for w, n in tail.items()) >= 0.9 * nq:  # a short lead, then the question
        return True
    times = max(1, round(na / nq))
    shared = sum(min(a[w], q[w] * times) for w in a)
    covered = sum(min(a[w], q[w]) for w in q)
    return shared >= 0.78 * na and covered >= 0.72 * nq and na <= 3.5 * nq


def is_truncated(answer: str) -> bool:
    """The answer breaks off: an unclosed answer mark, or no ending though its form asks for one."""
    text = answer.strip()
    opened = text.rfind("\\answer{")
    if opened >= 0 and "}" not in text[opened:]:
        return True
    if text.count("```") % 2:
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    if TERMINAL.search(text):
        return False
    if CLOSED.search(text):
        return False
    last = lines[-1].strip()
    words = WORD.findall(last)
    if text[-1] in ",;:-–—(“‘" or (words and words[-1].lower() in HANGING):
        return True
    if text.count("“") > text.count("”") or text.count("(") > text.count(")"):
        return True
    if ITEM.match(lines[-1]):
        items = [x for x in lines[:-1] if ITEM.match(x)]
        stops = sum(1 for x in items if TERMINAL.search(x.strip()))
        return bool(items) and stops == len(items)
    n = len(WORD.findall(text))
    if 4 < n <= 8 and len(lines) == 1 and ("," in text or words[0].lower() in OPENERS):
        return True
    return n > 8 and (len(words) > 8 or any(TERMINAL.search(x.strip()) for x in lines) or len(lines) == 1)


QUOTED = re.compile("“[^”]*”|«[^»]*»|\"[^\"\n]*\"|\\\\(?:answer|boxed)\\{[^{}]*\\}?")


def languages_of(texts: list[str], model: LanguageModel, min_words: int = 4) -> list[str | None]:
    """Language of each text without its quotations; None if it has too few words or no clear lead."""
    b = tv.block(texts)
    w0, _, _ = tv.words(b)
    if not len(w0):
        return [None] * len(texts)
    per, inv = word_scores(model, b)
    doc = np.searchsorted(b.start, w0, side="right") - 1
    n = np.bincount(doc, minlength=b.n)
    acc = np.zeros((len(inv) + 1, per.shape[1]))
    np.cumsum(per[inv], axis=0, out=acc[1:])
    ends = np.cumsum(n)
    total = acc[ends] - acc[ends - n]
    top = total.argmax(axis=1)
    two = np.partition(total, -2, axis=1)[:, -2:]
    sure = (n >= min_words) & (two[:, 1] - two[:, 0] > 3.0)
    return [model.langs[top[i]] if sure[i] else None for i in range(b.n)]


def clauses_of(answer: str, at_least: int = 0) -> list[str]:
    """All clauses of an answer, lower case, without words that only lead over; the last may be longer if only the first are asked for."""
    parts = (" ".join(x.split()) for x in CLAUSE.split(answer.strip().lower().replace("‘", "'").replace("’", "'"), at_least))
    return [LEAD.sub("", x) for x in parts if x]


def clause_key(text: str) -> int:
    b = text.encode()
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "big", signed=True)


def says_no(clause: str) -> bool:
    """Three words or more that deny something in the first person."""
    return clause.count(" ") >= 2 and DECLINE.search(clause) is not None and FIRST_PERSON.search(clause) is not None and DOUBLE.search(clause) is None


def declining(answer: str) -> list[str]:
    """Opening clauses that say no."""
    first = clauses_of(answer, OPENING_CLAUSES + 1)
    return [c for c in first[:OPENING_CLAUSES] if says_no(c)]


CHECKED = "pair_no int, text_key bigint, prompt bigint, is_empty boolean, copied boolean, wrong_language boolean, truncated boolean, opening array<string>, clauses array<string>, fresh array<int>"


def pair_checks(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """id, pair_no, keys of the pair's texts and of its prompt, the checks, and the clauses of answers whose opening says no.

    ``opening`` has their opening clauses that do, ``clauses`` all clauses and ``fresh`` each one's number of words
    that the question has not; all are null for other answers, and for empty or copied ones.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            at = 0
            for part in tv.split_by_size(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()), lambda r: len(r[0] or "") + len(r[1] or "")):
                q_lang = languages_of([QUOTED.sub(" ", q or "") for q, _ in part], m)
                a_lang = languages_of([QUOTED.sub(" ", a or "") for _, a in part], m)
                none = [is_empty(a) for _, a in part]
                copied = [not e and bool(q) and is_copy(q, a) for e, (q, a) in zip(none, part)]
                cut = [not e and is_truncated(a) for e, (_, a) in zip(none, part)]
                foreign, opening, clauses, fresh, keys, prompts = [], [], [], [], [], []
                for ql, al, e, c, (q, a) in zip(q_lang, a_lang, none, copied, part):
                    foreign.append(ql is not None and al is not None and ql != al and not (al in ASKED and ASKED[al].search(q or "")))
                    first = declining(a) if not e and not c else []
                    opening.append(first or None)
                    own = clauses_of(a) if first else None
                    asked = set(WORD.findall((q or "").lower())) if first else set()
                    clauses.append(own)
                    fresh.append([sum(w not in asked for w in x.split()) for x in own] if first else None)
                    prompt = " ".join((q or "").lower().split())
                    prompts.append(clause_key(prompt))
                    keys.append(clause_key(f"{q}\x00{a}"))
                ids = [batch.column(i).slice(at, len(part)) for i in range(2)]
                flags = [pa.array(x, pa.bool_()) for x in (none, copied, foreign, cut)]
                texts = [*(pa.array(x, pa.list_(pa.string())) for x in (opening, clauses)), pa.array(fresh, pa.list_(pa.int32()))]
                names = ["id", "pair_no", "text_key", "prompt", "is_empty", "copied", "wrong_language", "truncated", "opening", "clauses", "fresh"]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(keys, pa.int64()), pa.array(prompts, pa.int64()), *flags, *texts], names=names)
                at += len(part)

    return rows.mapInArrow(run, f"id {kind}, {CHECKED}")


def templates(opening: DataFrame, min_prompts: int = 3) -> DataFrame:
    """clause: the refusal templates among opening clauses that say no (columns clause, prompt).

    A clause is one if its cluster, it and the clauses alike to it, opens the answers of ``min_prompts`` prompts or
    holds a seed, and if a clause alike to it is one by that.
    """
    spark = opening.sparkSession
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "clause string").select("clause", F.lit(None).cast("bigint").alias("prompt"), F.lit(True).alias("seed"))
    every = opening.select("clause", "prompt", F.lit(False).alias("seed")).unionByName(seeds)
    texts = every.groupBy("clause").agg(F.countDistinct("prompt").alias("prompts"), F.max("seed").alias("seed"))
    texts = checkpointed(texts.select("clause", "prompts", "seed", F.regexp_replace("clause", "[^a-z0-9à-ÿ ]", "").alias("body"), F.lit(None).cast("string").alias("none")))
    members, links = near_duplicate_links(texts, "clause", "none", "body", k=2, threshold=0.6)
    facts = members.select(F.col("id").alias("clause"), "node").join(texts.select("clause", "prompts", "seed"), "clause")
    # clauses of equal words are one node; a node's cluster is it and the nodes linked to it
    nodes = checkpointed(facts.groupBy("node").agg(F.sum("prompts").alias("prompts"), F.max("seed").alias("seed")))
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    around = both.join(nodes.select(F.col("node").alias("b"), "prompts", "seed"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("prompts").alias("near_prompts"), F.max("seed").alias("near_seed"))
    n = F.col("prompts") + F.coalesce("near_prompts", F.lit(0))
    first = checkpointed(nodes.join(around, "node", "left").where((n >= min_prompts) | F.col("seed") | F.coalesce("near_seed", F.lit(False))).select("node"))
    second = both.join(first.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"))
    return facts.select("clause", "node").join(first.unionByName(second).distinct(), "node", "left_semi").select("clause")


def refusals(checks: DataFrame, min_prompts: int = 3) -> DataFrame:
    """id, pair_no, text_key of answers that decline. checks: as ``pair_checks`` has them."""
    spoken = checks.where("opening is not null")
    known = checkpointed(templates(spoken.select(F.explode("opening").alias("clause"), "prompt"), min_prompts))
    few = (lambda df: F.broadcast(df)) if known.count() <= FEW else (lambda df: df)
    hit = spoken.select("id", "pair_no", "text_key", F.explode("opening").alias("clause")).join(few(known), "clause", "left_semi")
    able = hit.select("id", "pair_no", "text_key").distinct()
    each = spoken.join(able, ["id", "pair_no", "text_key"], "left_semi").dropDuplicates(["id", "pair_no", "text_key"])
    each = checkpointed(each.select("id", "pair_no", "text_key", "prompt", F.explode(F.arrays_zip("clauses", "fresh")).alias("c")).select("id", "pair_no", "text_key", "prompt", F.col("c.clauses").alias("clause"), F.col("c.fresh").alias("n_fresh"), F.size(F.split("c.clauses", " ")).alias("n_words")))
    # a clause outside the opening, as a closing formula, counts as a template where it recurs in answers that open with one
    again = each.groupBy("clause").agg(F.countDistinct("prompt").alias("n")).where(f"n >= {min_prompts}").select("clause").unionByName(known).distinct()
    marked = each.join(again.withColumn("formula", F.lit(True)), "clause", "left")
    spare = F.sum(F.when(F.col("formula"), 0).otherwise(F.col("n_fresh")))
    out = marked.groupBy("id", "pair_no", "text_key").agg(spare.alias("spare"), F.sum("n_words").alias("words"))
    return out.where((F.col("spare") <= SPARE_WORDS) | (F.col("spare") <= SPARE_SHARE * F.col("words"))).select("id", "pair_no", "text_key")


def pair_defects(df: DataFrame, model: LanguageModel, id_col: str = "conv_id", messages_col: str = "messages") -> DataFrame:
    """id, pair_no, defect: one row per pair, defect null for a sound one.

    The first that holds of empty, copied, refusal, wrong_language, truncated. A blank question
    makes no defect by itself. A conversation delivered again gives its rows once; one id with other
    texts has rows for each.
    """
    checks = checkpointed(pair_checks(pairs(df, id_col, messages_col), model))
    declined = refusals(checks).withColumn("refusal", F.lit(True))
    defect = (
        F.when(F.col("is_empty"), "empty").when(F.col("copied"), "copied").when(F.coalesce("refusal", F.lit(False)), "refusal").when(F.col("wrong_language"), "wrong_language").when(F.col("truncated"), "truncated")
    )
    rows = checks.drop("opening", "clauses", "fresh", "prompt").distinct()
    return rows.join(declined, ["id", "pair_no", "text_key"], "left").select(F.col("id").alias(id_col), "pair_no", defect.alias("defect"))
