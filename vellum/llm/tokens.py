"""Exact token counts: split, tokenize each distinct piece once, join lengths back by piece frequency.

Documents are split by the tokenizer's own pattern in blocks of about a million characters; a block
keeps its vocabulary and each document's piece frequencies by vocabulary position. The distinct
pieces of all blocks are tokenized once, their lengths return to the blocks that use them, and a
document's total is its frequencies times those lengths. Only vocabularies are shuffled by piece,
never the documents, and a block's vocabulary is bounded by the block.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.training import RANKS, rank_file
from . import textvec as tv
from .common import checkpointed

#: The published split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK, ALPHA, NUMBER, OTHER = range(4)
#: Endings that stay with an apostrophe (fixed value of the pattern).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _piece_class(ch: str) -> int:
    if ch in _WHITE:
        return BLANK
    return {"L": ALPHA, "N": NUMBER}.get(unicodedata.category(ch)[0], OTHER)


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    return np.array([*(_piece_class(chr(c)) for c in range(65536)), OTHER], np.uint8)


def split(b: tv.Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pieces of all texts of a block, as the pattern cuts them.

    The pattern takes runs of letters, numbers or other marks, each with one blank before it; of a
    run of white space before such a run only the last blank joins it; an apostrophe that begins a
    run of marks takes one of ENDINGS that follows.
    """
    cls = _class_table()[b.clip]
    for at in np.flatnonzero(b.clip == 65536):
        cls[at] = _piece_class(chr(b.cps[at]))
    sep = np.zeros(len(cls), bool)
    sep[b.end] = True  # the line feeds between texts belong to none
    edge = np.ones(len(cls), bool)
    edge[1:] = (cls[1:] != cls[:-1]) | sep[1:] | sep[:-1]
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(cls))
    kind = cls[start]
    real = ~sep[start]
    blank = (kind == BLANK) & real
    # a blank run that a run of the same text follows gives its last character away
    gives = np.zeros(len(start), bool)
    gives[:-1] = blank[:-1] & real[1:]
    last_space = gives & (b.cps[end - 1] == 32)
    lone_last = gives & ~last_space
    s2, e2 = start.copy(), end.copy()
    e2[gives] -= 1
    joined = np.zeros(len(start), bool)
    joined[1:] = last_space[:-1]
    s2[joined] -= 1
    keep = real & (e2 > s2)
    extra_s, extra_e = end[lone_last] - 1, end[lone_last]
    # contractions: the apostrophe run and the beginning of the letter run after it
    apo = np.flatnonzero((kind[:-1] == OTHER) & real[:-1] & (end[:-1] - start[:-1] == 1) & (b.cps[start[:-1]] == 39) & ~joined[:-1] & (kind[1:] == ALPHA) & real[1:])
    if len(apo):
        first = b.cps[start[apo + 1]]
        second = np.where(end[apo + 1] - start[apo + 1] > 1, b.cps[np.minimum(start[apo + 1] + 1, len(cls) - 1)], 0)
        size = np.zeros(len(apo), np.int64)
        for ending in ENDINGS:
            hit = (first == ord(ending[0])) & ((len(ending) == 1) | (second == ord(ending[-1])))
            size[hit & (size == 0)] = len(ending)
        with_end = size > 0
        e2[apo[with_end]] += size[with_end]
        s2[apo[with_end] + 1] += size[with_end]
        keep &= e2 > s2
    s, e = np.concatenate([s2[keep], extra_s]), np.concatenate([e2[keep], extra_e])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def pieces(text: str) -> list[str]:
    """The pieces that the pattern cuts the text into; they join to the whole text."""
    b = tv.block([text])
    return [text[i:j] for i, j in zip(*split(b))] if text else []


@lru_cache(maxsize=4)
def encoding(ranks: str):
    import tiktoken

    with open(rank_file(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vellum", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def piece_length(piece: str, ranks: str = RANKS) -> int:
    return len(encoding(ranks).encode_ordinary(piece))


def _blocks(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """A row per block of documents: ids, vocabulary, and each document's piece positions and counts."""
    src = df.select(*[F.col(f"`{c}`") for c in id_cols], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    kinds = [(f"k{i}", f.dataType.simpleString()) for i, f in enumerate(src.schema.fields[:-1])]

    def run(batches):
        made = 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids = [batch.column(i) for i in range(batch.num_columns - 1)]
            at = 0
            for group in tv.split_by_size(((t,) for t in batch.column(batch.num_columns - 1).to_pylist()), lambda r: len(r[0])):
                b = tv.block([t for (t,) in group])
                start, end = split(b)
                h = tv.range_hash(b.cps, start, end)
                _, first, inv = np.unique(h, return_index=True, return_inverse=True)
                vocab = [b.data[i:j] for i, j in zip(start[first].tolist(), end[first].tolist())]
                doc = np.searchsorted(b.start, start, side="right") - 1
                cell, times = np.unique(doc * max(1, len(vocab)) + inv, return_counts=True)
                where = cell % max(1, len(vocab))
                sizes = np.bincount(cell // max(1, len(vocab)), minlength=b.n)
                keys = [pa.array([c.slice(at, len(group)).to_pylist()], pa.list_(c.type)) for c in ids]
                at += len(group)
                data = [x.astype(np.int32).tobytes() for x in (sizes, where, times)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{made}"]), *keys, *(pa.array([x], pa.binary()) for x in data), pa.array([vocab], pa.list_(pa.string()))],
                    names=["block", *(k for k, _ in kinds), "sizes", "pos", "times", "vocab"],
                )
                made += 1

    fields = ", ".join(f"{k} array<{t}>" for k, t in kinds)
    return src.mapInArrow(run, f"block string, {fields}, sizes binary, pos binary, times binary, vocab array<string>")


def piece_lengths(distinct: DataFrame, ranks: str = RANKS) -> DataFrame:
    """piece, n_tokens of distinct pieces (column piece)."""

    def run(batches):
        for batch in batches:
            enc = encoding(ranks)
            col = batch.column(0)
            yield pa.RecordBatch.from_arrays([col, pa.array([len(x) for x in enc.encode_ordinary_batch(col.to_pylist(), num_threads=1)], pa.int32())], names=["piece", "n_tokens"])

    return distinct.select("piece").mapInArrow(run, "piece string, n_tokens int")


def token_counts(df: DataFrame, id_cols: list[str], text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """One row per input row: ``id_cols``, n_tokens, n_pieces.

    A null or empty text has 0 tokens; repeated rows stay repeated; whole texts are counted.
    """
    blocks = checkpointed(_blocks(df, id_cols, text_col))
    kinds = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema.fields if f.name.startswith("k")}
    used = blocks.select("block", F.posexplode("vocab").alias("at", "piece"))
    lengths = piece_lengths(used.select("piece").distinct(), ranks)
    known = used.join(lengths, "piece").groupBy("block").agg(F.collect_list(F.struct("at", "n_tokens")).alias("known"))
    full = blocks.drop("vocab").join(known, "block", "left").select(*kinds, "sizes", "pos", "times", F.transform("known", lambda x: x["at"]).alias("at"), F.transform("known", lambda x: x["n_tokens"]).alias("len"))

    def run(batches):
        for batch in batches:
            n = len(kinds)
            for r in range(batch.num_rows):
                sizes, pos, times = (np.frombuffer(batch.column(n + i)[r].as_py(), np.int32) for i in range(3))
                lens = np.zeros(int(pos.max()) + 1 if len(pos) else 1, np.int64)
                if len(pos):
                    lens[batch.column(n + 3)[r].values.to_numpy(zero_copy_only=False)] = batch.column(n + 4)[r].values.to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                total = np.bincount(doc, weights=times * lens[pos], minlength=len(sizes)).astype(np.int64)
                count = np.bincount(doc, weights=times, minlength=len(sizes)).astype(np.int64)
                keys = [batch.column(i)[r].values for i in range(n)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(total), pa.array(count)], names=[*kinds, "n_tokens", "n_pieces"])

    out = full.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", n_tokens bigint, n_pieces bigint")
    return out.select(*[F.col(k).alias(c) for k, c in zip(kinds, id_cols)], "n_tokens", "n_pieces")


def token_totals(counts: DataFrame, by: list[str]) -> DataFrame:
    """Documents and tokens of every slice, with subtotals of each single column and the grand total.

    ``level`` names the columns that are set; null values of a column are a slice of their own.
    """
    sets = [by, *[[c] for c in by], []]
    named = [(("+".join(s) or "all"), s) for s in sets]
    hit = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), *[(F.col(c).cast("string") if c in s else F.lit(None).cast("string")).alias(c) for c in by]) for n, s in named])).alias("g")
    fine = counts.groupBy(*by).agg(F.count("*").alias("d"), F.sum("n_tokens").alias("t"), F.sum((F.col("n_tokens") == 0).cast("long")).alias("e"))
    return fine.select(hit, "d", "t", "e").groupBy("g").agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"), F.sum("e").alias("n_empty")).select("g.*", "n_docs", "n_tokens", "n_empty")
