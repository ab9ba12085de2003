"""Splitting long texts: greedy windows, paragraph packers, message splitter."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = re.compile(r"[.!?]\s")


def window_cut(window: str, limit: int) -> int:
    """Where to cut a full window: after its last blank line, else its last sentence end, if past a quarter; else its end."""
    at = window.rfind("\n\n")
    if at > limit // 4:
        return at + 2
    ends = [m.end() for m in SENTENCE_END.finditer(window)]
    return ends[-1] if ends and ends[-1] > limit // 4 else limit


def greedy_windows(text: str, limit: int, least: int, least_for_whole: bool = False) -> list[str]:
    if len(text) <= limit:
        return [text] if not least_for_whole or len(text) >= least else []
    out, begin = [], 0
    while len(text) - begin > limit:
        cut = begin + window_cut(text[begin : begin + limit], limit)
        piece = text[begin:cut].rstrip()
        if len(piece) >= least:
            out.append(piece)
        begin = cut
        while begin < len(text) and text[begin].isspace():
            begin += 1
    tail = text[begin:].strip()
    return out + [tail] if len(tail) >= least else out


def windows(df: DataFrame, id_col: str, text_col: str = "text", limit: int = 8000, least: int = 200, least_for_whole: bool = False) -> DataFrame:
    """id, chunk_idx, chunk. Null texts have no chunk; ``least`` spares texts that need no split unless told otherwise."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else greedy_windows(t, limit, least, least_for_whole))

    return df.select(id_col, F.posexplode(cut(F.col(text_col))).alias("chunk_idx", "chunk"))


def pack_parts(parts: list[str], limit: int, glue: str, split) -> list[str]:
    """Parts joined in order up to ``limit``; a part above it is split by ``split`` and packed by blanks."""
    out: list[str] = []
    held = ""
    for part in parts:
        if len(part) > limit:
            if held:
                out.append(held)
                held = ""
            out.extend(pack_parts(split(part), limit, " ", lambda x: [x[i : i + limit] for i in range(0, len(x), limit)]))
        elif not held:
            held = part
        elif len(held) + len(glue) + len(part) <= limit:
            held += glue + part
        else:
            out.append(held)
            held = part
    return out + [held] if held else out


def sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+", text) if x]


def packed_paragraphs(df: DataFrame, id_col: str, text_col: str = "text", limit: int = 4000) -> DataFrame:
    """id, chunk_idx, chunk: paragraphs packed up to ``limit``, longer ones by sentences."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else pack_parts([p.strip() for p in t.split("\n\n") if p.strip()], limit, "\n\n", sentences))

    return df.select(id_col, F.posexplode(cut(F.col(text_col))).alias("chunk_idx", "chunk"))


def message_parts(text: str, limit: int) -> list[str]:
    """A message cut at the last blank line, line end or sentence end of the second half, else hard."""
    out = []
    while len(text) > limit:
        cut = limit
        for mark, extra in (("\n\n", 0), ("\n", 0), (". ", 1)):
            at = text.rfind(mark, 0, limit)
            if at >= limit // 2:
                cut = at + extra
                break
        out.append(text[:cut].strip())
        text = text[cut:].strip()
    return [x for x in [*out, text] if x]


def split_messages(content: Column, limit: int = 8000) -> Column:
    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else message_parts(t, limit))

    return cut(content)


def overlapping(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs in windows of about ``size`` characters, each begun with the last paragraphs of the one before, up to ``overlap``."""
    out: list[str] = []
    held: list[str] = []
    fresh = 0
    for p in (x.strip() for x in text.split("\n\n")):
        if not p:
            continue
        if fresh and sum(map(len, held)) + len(p) > size:
            out.append("\n\n".join(held))
            tail: list[str] = []
            while held and sum(map(len, tail)) + len(held[-1]) <= overlap:
                tail.insert(0, held.pop())
            held, fresh = tail, 0
        held.append(p)
        fresh += 1
    return out + ["\n\n".join(held)] if fresh else out


def excerpt(text: str, key: str, limit: int = 4000, least: int = 2000) -> str:
    """The text if short; else from a paragraph chosen by the key, at least ``least`` characters, cut to its last sentence end."""
    if len(text) <= limit:
        return text
    import hashlib

    starts = [0, *(m.end() for m in re.finditer(r"\n\n", text) if len(text) - m.end() >= least)]
    at = starts[int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % len(starts)]
    part = text[at : at + limit]
    end = part.rfind(". ")
    return part[: end + 1] if end >= least else part


def overlapping_windows(df: DataFrame, id_col: str, text_col: str = "text", size: int = 20_000, overlap: int = 2000) -> DataFrame:
    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else overlapping(t, size, overlap))

    return df.select(id_col, F.posexplode(cut(F.col(text_col))).alias("chunk_idx", "chunk"))


def excerpts(text: Column, key: Column, limit: int = 4000, least: int = 2000) -> Column:
    @F.pandas_udf("string")
    def cut(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else excerpt(t, str(x), limit, least) for t, x in zip(s, k)], dtype=object)

    return cut(text, key)
