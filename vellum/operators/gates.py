"""Quality gates and signals. A gate chain gives the reason of the first gate that fails, null if none does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import clean


def first_reason(*gates: tuple[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, fails in reversed(gates):
        out = F.when(fails, name).otherwise(out)
    return out


def report(df: DataFrame, reason: Column, chars: Column) -> DataFrame:
    """Rows and characters by reason; 'kept' for rows that pass."""
    return df.select(F.coalesce(reason, F.lit("kept")).alias("reason"), chars.alias("n")).groupBy("reason").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"))


def fused(terms: tuple[str, ...]) -> str:
    """One pattern that matches where any term does: terms at word starts share the boundary test and
    are grouped by their first letter, so a position tries only the terms that can begin there."""
    by: dict[str, list[str]] = {}
    rest = []
    for p in terms:
        if p.startswith(r"\b") and p[2:4].isalpha() and "|" not in p.split("(")[0]:
            by.setdefault(p[2].lower(), []).append(p[3:])
        else:
            rest.append(p)
    heads = "|".join(f"{a}(?:{'|'.join(f'(?:{x})' for x in tails)})" for a, tails in sorted(by.items()))
    return "|".join([*([rf"\b(?:{heads})"] if heads else []), *(f"(?:{p})" for p in rest)])


def any_of(c: Column, terms: tuple[str, ...], flags: str = "(?i)(?d)") -> Column:
    return c.rlike(flags + fused(terms))


def hits(c: Column, terms: tuple[str, ...], flags: str = "(?i)(?d)") -> Column:
    """How many of the terms occur."""
    return reduce(lambda a, b: a + b, [c.rlike(flags + p).cast("int") for p in terms])


def count_in(c: Column, words) -> Column:
    """How many of the words or phrases occur anywhere in the text."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("int") for w in words], F.lit(0))


def weighted_in(c: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of the words that occur anywhere in the text."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(c, F.lit(w)), n).otherwise(0) for w, n in weights.items()], F.lit(0))


def later_years(c: Column, first: int = 1900, last: int = 2029) -> Column:
    """Year tokens from ``first`` to ``last``."""
    found = F.regexp_extract_all(c, F.lit(r"\b(\d{4})\b"), 1)
    return F.size(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: (y >= first) & (y <= last)))


def period_reason(c: Column, min_chars: int = 500, first_year: int = 1900, max_years: int = 5, max_context: int = 3, terms: tuple[str, ...] = P.ALWAYS_REJECT) -> Column:
    """Too short, a later term, too many later years, too many ambiguous terms."""
    return first_reason(
        ("too_short", c.isNull() | (F.length(c) < min_chars)), ("always_reject", any_of(c, terms)),
        ("later_years", later_years(c, first_year) >= max_years), ("context", hits(c, P.CONTEXT_TERMS) >= max_context),
    )


def conversation_reason(text: Column) -> Column:
    return first_reason(
        ("always_reject", any_of(text, P.ALWAYS_REJECT)), ("later_years", later_years(text) >= 2), ("context", hits(text, P.CONTEXT_TERMS) >= 3), ("meta_reference", any_of(text, P.META_REFERENCES))
    )


def two_tier(c: Column) -> Column:
    """A term of the first tier, or two of the second; long texts by their first and last 50,000 characters."""
    s = F.when(F.length(c) > 100_000, F.concat(F.left(c, F.lit(50_000)), F.right(c, F.lit(50_000)))).otherwise(c)
    return any_of(s, P.TIER_ONE) | (hits(s, P.TIER_TWO, "(?is)") >= 2)


def printable_ratio(c: Column, sample: int = 10_000) -> Column:
    s = F.substring(c, 1, sample)
    return F.when(F.length(s) == 0, 0.0).otherwise(1 - F.regexp_count(s, F.lit(r"[\p{C}\p{Z}&&[^ \n\t]]")) / F.length(s))


def artefacts(c: Column, sample: int = 30_000) -> Column:
    s = F.substring(c, 1, sample)
    return reduce(lambda a, b: a + b, [F.regexp_count(s, F.lit(p)) for p in P.OCR_ARTIFACTS])


def document_reason(text: Column, source: Column, score: Column, legibility: Column, min_chars: int = 5000, min_scores: dict[str, float] | None = None, min_legibility: float = 1.0) -> Column:
    """Length, score, legibility, printable share and artefacts, cheap gates first."""
    norm = clean.score_0_1(score, source)
    floor = F.lit(0.0)
    for name, value in (min_scores or {"institutional-books": 0.9, "blbooks": 0.9}).items():
        floor = F.when(source == name, value).otherwise(floor)
    return first_reason(
        ("too_short", text.isNull() | (F.length(text) < min_chars)), ("low_score", (norm >= 0) & (norm < floor)), ("illegible", (legibility >= 0) & (legibility < min_legibility)),
        ("unprintable", printable_ratio(text) < 0.85), ("artefacts", artefacts(text) > 50), ("later_terms", two_tier(text)),
    )


def alternates(messages: Column, least: int = 2, filled: bool = False) -> Column:
    """Optional leading system message, then user and assistant in turn, at least ``least`` of them."""
    rest = F.filter(messages, lambda m, i: ~((i == 0) & (m["role"] == "system")))
    turns = F.transform(rest, lambda m, i: F.coalesce(m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False)))
    ok = (F.size(rest) >= least) & F.forall(turns, lambda x: x)
    return ok & F.forall(rest, lambda m: F.length(F.trim(F.coalesce(m["content"], F.lit("")))) > 0) if filled else ok


def spoken(messages: Column, role: str | None = None) -> Column:
    """Contents of all messages, or of one role, joined by blanks."""
    pick = messages if role is None else F.filter(messages, lambda m: m["role"] == role)
    return F.array_join(F.transform(pick, lambda m: F.coalesce(m["content"], F.lit(""))), " ")


#: What no mined turn may have: broken quotation marks, a heading, a page number, a contents line, a running head.
NO_SPEECH = (
    r"(?:^|\s)(?:66|99|6 6|9 9)(?:\s|$)", r"(?i)^(?:CHAPTER|BOOK|PART|SECTION|VOL(?:UME)?\.?)\s+[IVXLCDM0-9]+", r"^\s*[0-9]{1,4}\s*$", r"\.{3,}\s*[0-9]+\s*$",
    r"[0-9]{1,3}\s+[A-Z]{2,}(?:\s+[A-Z]{2,}){1,5}\.?\s",
)


def turn_quality(t: Column) -> Column:
    """A mined turn that reads as speech: length, plain characters, few capitals, nothing of NO_SPEECH."""
    alpha = F.length(F.regexp_replace(t, r"[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(t, r"[^A-Z]", ""))
    good = F.length(F.regexp_replace(t, r"[^a-zA-Z0-9\s.,;:!?'\"\-\(\)]", ""))
    sized = (F.length(t) >= 20) & (F.length(t) <= 2000)
    lower = ~((alpha > 0) & (upper / alpha > 0.5))
    return reduce(lambda a, p: a & ~t.rlike(p), NO_SPEECH, sized & (good / F.length(t) >= 0.85) & lower)


def non_ascii_share(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0.0).otherwise(F.length(F.regexp_replace(c, r"[\x00-\x7F]", "")) / F.length(c))


def answer_form(c: Column) -> Column:
    s = F.trim(c)
    return F.when(s.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), "number").when(s.rlike(r"^-?[0-9]+\s*/\s*[0-9]+$") | s.contains("\\frac"), "fraction").otherwise("symbolic")


def request_error(messages: Column, max_messages: int = 500, max_chars: int = 8000, max_total: int = 32_000) -> Column:
    """Why a chat request is refused; null for a valid one."""
    size = lambda m: F.length(F.coalesce(m["content"], F.lit("")))
    total = F.aggregate(messages, F.lit(0), lambda a, m: a + size(m))
    return first_reason(
        ("no_messages", messages.isNull() | (F.size(messages) == 0)), ("too_many", F.size(messages) > max_messages), ("empty_message", F.exists(messages, lambda m: size(m) == 0)),
        ("long_message", F.exists(messages, lambda m: size(m) > max_chars)), ("long_request", total > max_total),
        ("bad_role", F.exists(messages, lambda m: ~F.coalesce(m["role"].isin("user", "assistant", "system"), F.lit(False)))),
    )


def problem_reason(text: Column, answers: Column, has_graphs: Column) -> Column:
    """A later concept in question, solution and answers; needs graphs; no answer that is more than blank."""
    blank = F.coalesce(F.forall(answers, lambda a: F.trim(F.coalesce(a, F.lit(""))) == ""), F.lit(True))
    return first_reason(("later_concept", any_of(text, P.COMPACT_REJECT)), ("has_graphs", F.coalesce(has_graphs, F.lit(False))), ("no_answer", blank))


def predicts(c: Column) -> Column:
    """Two marks of prediction or more in lower-cased answers."""
    return count_in(c, P.PREDICTIONS) >= 2


def opines(c: Column) -> Column:
    return count_in(c, P.OPINIONS) >= 1


def is_modern_prompt(c: Column) -> Column:
    """More casual than formal marks, one at least."""
    low = F.lower(c)
    casual = count_in(low, P.CASUAL_MARKS)
    return (casual > count_in(low, P.FORMAL_MARKS)) & (casual >= 1)


def catalogue_reason(title: Column, subject: Column, description: Column, creator: Column, year: Column, first: int = 1500, last: int = 1899) -> Column:
    """Why a catalogue entry is passed over: date, modern reprint, off the topic, no word on the topic; null if it is not."""
    text = lambda *cs: F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cs]))
    score = weighted_in(text(title, subject), P.ON_TOPIC)
    return first_reason(
        ("no_date", year.isNull()), ("bad_date", (year < first) | (year > last)), ("modern_reprint", count_in(text(description, title, creator), P.REPRINTS) >= 1),
        ("off_topic", (count_in(text(subject, title), P.OFF_TOPIC) >= 2) & (score < 2)), ("low_score", score < 1),
    )


def book_reason(text: Column, score: Column, title: Column, least_kb: int = 50, least_score: float = 0.8) -> Column:
    """A book's file is too small, its score too low, or its title names what no lesson is made of."""
    return first_reason(
        ("too_small", F.coalesce(F.octet_length(text), F.lit(0)) < least_kb * 1024), ("low_score", F.coalesce(score, F.lit(0.0)) < least_score),
        ("excluded", count_in(F.lower(F.coalesce(title, F.lit(""))), P.NOT_TEACHING) >= 1),
    )
