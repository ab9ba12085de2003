"""Splitting long texts at natural boundaries by content-defined chunking.

A rolling hash over the last WINDOW characters marks landmarks. From each cut the next one is the
natural boundary nearest to the first landmark of the allowed span, so a change of the text moves
only the cuts near it. A boundary is a blank line, or a stop with any closing quotes or brackets
before white space. A span without landmark ends at its last boundary; one without boundary at its
last white space; one without that at the size limit. Pieces repeat the last ``overlap`` characters
before their cut, and pieces without their overlaps join to the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

WINDOW = 48
#: One landmark in so many characters on average.
SPACING = 512
BOUNDARY = re.compile("(?P<stop>[.!?][\"'”’“»›)\\]}]*)(?=\\s)|(?P<blank>(?:\r\n|\n|\r(?!\n))[ \t]*(?:\r\n|\n|\r))")
WHITE = re.compile(r"\s+")


def landmarks(text: str) -> np.ndarray:
    """Positions whose preceding WINDOW characters hash to a landmark, in rising order."""
    n = len(text)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.arange(WINDOW, n + 1)
    h = tv.range_hash(cps, at - WINDOW, at)
    return at[(h % np.uint64(SPACING)) == 0]


def boundaries(text: str) -> list[tuple[int, str]]:
    """(position after a sentence's closing marks or before a blank line, kind), in rising order."""
    return [(m.end() if m.lastgroup == "stop" else m.start(), "sentence" if m.lastgroup == "stop" else "paragraph") for m in BOUNDARY.finditer(text)]


def unbroken(text: str, found: list[tuple[int, str]], made: list[tuple[int, str]], limit: int) -> list[tuple[int, int]]:
    """(first, past last) visible character of each stretch of more than ``limit`` characters without a boundary inside.

    Pieces are no longer than the limit, so such a stretch shows as a cut inside it that is no boundary: each
    forced cut is widened to the boundaries on either side of it and measured.
    """
    where = [p for p, _ in found]
    out = []
    done = 0
    for cut, kind in made:
        if kind not in ("word", "hard") or cut < done:
            continue
        i = bisect_right(where, cut)
        at, done = where[i - 1] if i else 0, where[i] if i < len(where) else len(text)
        part = text[at:done]
        body = len(part.strip())
        if body > limit:
            lead = len(part) - len(part.lstrip())
            out.append((at + lead, at + lead + body))
    return out


def cuts(text: str, max_size: int, overlap: int, found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(cut position, kind) of all pieces; the last is the end of the text."""
    n = len(text)
    if n <= max_size:
        return [(n, "end")] if n else []
    marks = landmarks(text).tolist()
    where = [p for p, _ in found]
    out: list[tuple[int, str]] = []
    at, room = 0, max_size
    while n - at > room:
        low, high = at + max(overlap + 1, room // 4), at + room
        first, last = bisect_left(where, low), bisect_right(where, high)
        k = bisect_left(marks, at + room // 2)
        if first == last:
            gap = None
            for gap in WHITE.finditer(text, low, high):
                pass
            cut, kind = (gap.end(), "word") if gap else (high, "hard")
        elif k == len(marks) or marks[k] > high:
            cut, kind = found[last - 1]
        else:
            i = bisect_left(where, marks[k], first, last)
            near = [j for j in (i - 1, i) if first <= j < last]
            cut, kind = found[min(near, key=lambda j: (abs(where[j] - marks[k]), j))]
        out.append((cut, kind))
        at, room = cut, max_size - overlap
    return [*out, (n, "end")]


PIECE = "array<struct<piece_no:int, start_char:bigint, new_from:bigint, end_char:bigint, cut:string, text:string>>"
STRETCH = "array<struct<start_char:bigint, end_char:bigint>>"


def chunked(df: DataFrame, id_col: str, max_size: int, overlap: int = 0, text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, pieces and unbroken stretches.

    A null or empty text has no piece; a text within the size is one piece. Sizes are code points.
    """
    if not 0 <= overlap < max_size // 4:
        raise ValueError("overlap must be under a quarter of max_size")
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    piece_t = pa.list_(pa.struct([("piece_no", pa.int32()), ("start_char", pa.int64()), ("new_from", pa.int64()), ("end_char", pa.int64()), ("cut", pa.string()), ("text", pa.string())]))
    stretch_t = pa.list_(pa.struct([("start_char", pa.int64()), ("end_char", pa.int64())]))

    def run(batches):
        for batch in batches:
            at = 0
            for part in tv.split_by_size(((t,) for t in batch.column(1).to_pylist()), lambda r: len(r[0])):
                sizes, pieces, long = [], [], []
                for (text,) in part:
                    found = boundaries(text)
                    made = cuts(text, max_size, overlap, found)
                    rows, begin = [], 0
                    for i, (cut, how) in enumerate(made):
                        start = max(0, begin - overlap) if i else 0
                        rows.append({"piece_no": i, "start_char": start, "new_from": begin, "end_char": cut, "cut": how, "text": text[start:cut]})
                        begin = cut
                    sizes.append(len(text))
                    pieces.append(rows)
                    long.append([{"start_char": a, "end_char": z} for a, z in unbroken(text, found, made, max_size)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(sizes, pa.int64()), pa.array(pieces, piece_t), pa.array(long, stretch_t)], names=["id", "n_chars", "pieces", "stretches"]
                )
                at += len(part)

    return src.mapInArrow(run, f"id {kind}, n_chars bigint, pieces {PIECE}, stretches {STRETCH}").withColumnRenamed("id", id_col)


def pieces(chunks: DataFrame, id_col: str) -> DataFrame:
    """One row per piece."""
    return chunks.select(id_col, F.explode("pieces").alias("p")).select(id_col, "p.*")


def stretches(chunks: DataFrame, id_col: str) -> DataFrame:
    """One row per stretch longer than the size limit without a natural boundary inside."""
    return chunks.select(id_col, F.explode("stretches").alias("s")).select(id_col, "s.*")
