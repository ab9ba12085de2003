"""Dialogue mining: attributed quotes, sessions by distance, roles, bracketed scripts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verbs of speech and titles of speakers.
VERBS = "said|replied|answered|asked|cried|exclaimed|observed|remarked|continued|added|responded|inquired|demanded|declared|murmured|whispered|shouted|returned|rejoined|repeated|interrupted|insisted|objected|explained|admitted|entreated|pronounced|announced"
TITLES = r"Mr\.|Mrs\.|Miss|Dr\.|Sir|Lady|Lord|Captain|Colonel|General|Major|Professor|Rev\.|Father|Mother|Uncle|Aunt|the"
SPEAKER = rf"(?:(?:{TITLES})\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?|[A-Z][a-z]{{2,}}(?:\s+[A-Z][a-z]+)?|[Hh]e|[Ss]he|I)"
FORMS = (
    (re.compile(rf'"([^"]{{5,}}?)[,.]"\s*(?:{VERBS})\s+({SPEAKER}),?\s*"([^"]{{5,}}?)[,.!?]"', re.DOTALL), lambda m: (m[2], f"{m[1].strip()} {m[3].strip()}")),
    (re.compile(rf'"([^"]{{10,}}?)[,.!?]"\s*(?:{VERBS})\s+({SPEAKER})', re.DOTALL), lambda m: (m[2], m[1])),
    (re.compile(rf'({SPEAKER})\s+(?:{VERBS}),?\s*"([^"]{{10,}}?)[,.!?]"', re.DOTALL), lambda m: (m[1], m[2])),
)


def found_quotes(text: str) -> list[dict]:
    got = sorted(((m.start(), rank, *read(m)) for rank, (form, read) in enumerate(FORMS) for m in form.finditer(text)), key=lambda q: (q[0], q[1]))
    out: list[dict] = []
    for at, _, speaker, quote in got:
        if not out or at - out[-1]["pos"] > 10:
            out.append({"speaker": speaker.strip(), "quote": quote.strip(), "pos": at})
    return out


def quotes(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, speaker, quote, pos of attributed quotes, overlapping forms counted once."""

    @F.pandas_udf("array<struct<speaker:string, quote:string, pos:int>>")
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else found_quotes(t))

    return df.select(id_col, F.explode(find(text)).alias("q")).select(id_col, "q.*")


def sessions(q: DataFrame, id_col: str, gap: int = 500) -> DataFrame:
    """Quotes with a session number: a new one where the last quote began more than ``gap`` before."""
    w = Window.partitionBy(id_col).orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(w) > gap, 1).otherwise(0)
    return q.withColumn("__n", new).withColumn("session", F.sum("__n").over(w)).drop("__n")


def two_speakers(s: DataFrame, id_col: str) -> DataFrame:
    """Sessions of exactly two speakers, or of one who is a pronoun."""
    who = F.lower("speaker")
    ok = s.groupBy(id_col, "session").agg(F.countDistinct(who).alias("k"), F.max(who).alias("one")).where("k = 2 or (k = 1 and one in ('he', 'she', 'i'))")
    return s.join(ok.select(id_col, "session"), [id_col, "session"], "left_semi")


def merged_turns(t: DataFrame, by: list[str], order: str, role: str, text: str) -> DataFrame:
    """Runs of one role as one turn: by, turn, role, text."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.col(role) == F.lag(role).over(w), 0).otherwise(1)
    runs = t.withColumn("__new", new).withColumn("turn", F.sum("__new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), " ")
    return runs.groupBy(*by, "turn").agg(F.first(role).alias("role"), joined.alias("text"))


def quote_runs(df: DataFrame, id_col: str, text: Column, gap: int = 200) -> DataFrame:
    """Lines that are one quotation, in runs with at most ``gap`` characters between: id, run, n_quotes, first_pos."""
    lines = F.split(text, "\n", -1)
    each = df.select(id_col, F.posexplode(lines).alias("i", "line"), lines.alias("ls"))
    at = F.aggregate(F.slice("ls", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + F.length(x) + 1)
    own = each.where(F.trim("line").rlike('^"[^"]{10,}"$')).select(id_col, at.alias("begin"), (at + F.length("line")).alias("end"))
    w = Window.partitionBy(id_col).orderBy("begin")
    runs = own.withColumn("run", F.sum(F.when(F.col("begin") - F.lag("end").over(w) > gap, 1).otherwise(0)).over(w))
    return runs.groupBy(id_col, "run").agg(F.count("*").alias("n_quotes"), F.min("begin").alias("first_pos")).where("n_quotes >= 2")


def script_lines(text: Column) -> Column:
    """(speaker, line) of each ``NAME. words`` line of a play or ``[Name] words`` line of a script."""
    ls = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"^(?:\[[^\]]+\]|[A-Z]{3,}\.) \S"))
    return F.transform(ls, lambda x: F.struct(F.regexp_extract(x, r"^(?:\[([^\]]+)\]|[A-Z]{3,}\.) ", 1).alias("bracket"), F.regexp_extract(x, r"^([A-Z]{3,})\. ", 1).alias("cap"), F.regexp_replace(x, r"^(?:\[[^\]]+\]|[A-Z]{3,}\.) ", "").alias("line")))
