"""Tokenizer training, sequence packing by partition, rewards."""

from __future__ import annotations

import ast
import math
import operator
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import clean

#: Path of a public vocabulary file: a parameter, by environment or argument; on a cluster also a file shipped with the job.
RANKS = os.environ.get("VELLUM_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern published with the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: split pattern with numbers in groups of one or two digits.
SPLIT = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""


def piece_counts(df: DataFrame, text: Column, least: int = 1) -> DataFrame:
    """piece, cnt over all texts: the native part of byte-pair training."""
    return df.select(F.explode(F.regexp_extract_all(text, F.lit(SPLIT), 0)).alias("piece")).groupBy("piece").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def merges(counts: list[tuple[str, int]], n_merges: int) -> list[tuple[bytes, bytes]]:
    """Byte-pair merges of a bounded count table, most frequent pair first, ties by the lesser pair."""
    words = [([bytes([b]) for b in w.encode()], n) for w, n in counts]
    pairs: Counter = Counter()
    where: dict[tuple, set[int]] = defaultdict(set)
    for i, (w, n) in enumerate(words):
        for p in zip(w, w[1:]):
            pairs[p] += n
            where[p].add(i)
    out = []
    while len(out) < n_merges and pairs:
        top = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[top] <= 0:
            break
        out.append(top)
        for i in list(where[top]):
            w, n = words[i]
            for p in zip(w, w[1:]):
                pairs[p] -= n
                where[p].discard(i)
            new, j = [], 0
            while j < len(w):
                if j + 1 < len(w) and (w[j], w[j + 1]) == top:
                    new.append(w[j] + w[j + 1])
                    j += 2
                else:
                    new.append(w[j])
                    j += 1
            words[i] = (new, n)
            for p in zip(new, new[1:]):
                pairs[p] += n
                where[p].add(i)
        pairs.pop(top, None)
    return out


def fill_rows(items: list[tuple], capacity: int, buffer: int, crop: bool) -> list[tuple]:
    """(row, offset, key, start, size) by best fit from a buffer; without a fit the shortest is cropped and its
    rest goes back (crop), or the row is padded (pad, in which longer items are first cut)."""
    queue: list[list] = [[k, 0, n] for k, n in items] if crop else [[k, at, min(capacity, n - at)] for k, n in items for at in range(0, n, capacity)]
    held: list[list] = []
    out: list[tuple] = []
    row, used, nxt = 0, 0, 0
    while held or nxt < len(queue):
        while len(held) < buffer and nxt < len(queue):
            held.append(queue[nxt])
            nxt += 1
        fit = max((x for x in held if x[2] <= capacity - used), key=lambda x: x[2], default=None)
        if fit is not None:
            held.remove(fit)
            out.append((row, used, *fit))
            used += fit[2]
        elif crop and used < capacity:
            short = min(held, key=lambda x: x[2])
            room = capacity - used
            out.append((row, used, short[0], short[1], room))
            short[1] += room
            short[2] -= room
            used = capacity
        else:
            used = capacity
        if used == capacity:
            row, used = row + 1, 0
    return out


def pack_partitions(df: DataFrame, key: str, size: str, capacity: int, parts: int, buffer: int = 1000, crop: bool = True) -> DataFrame:
    """Best-fit rows of each hash partition: part, row, row_offset, key, start, n. Sizes under 1 take no room."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = list(pdf.sort_values(key)[[key, size]].itertuples(index=False, name=None))
        rows = fill_rows(items, capacity, buffer, crop)
        out = pd.DataFrame(rows, columns=["row", "row_offset", key, "start", "n"])
        out.insert(0, "part", pdf["part"].iloc[0])
        return out

    kind = df.schema[key].dataType.simpleString()
    src = df.where(F.col(size) > 0).select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), key, F.col(size).cast("long").alias(size))
    return src.groupBy("part").applyInPandas(run, f"part int, row bigint, row_offset bigint, {key} {kind}, start bigint, n bigint")


def format_reward(c: Column, weight: float = 0.1) -> Column:
    """Half the weight for a reasoning block, half for an answer mark."""
    return F.when(c.rlike(r"(?s)<think>.+?</think>"), weight / 2).otherwise(0.0) + F.when(c.rlike(r"\\answer\{"), weight / 2).otherwise(0.0)


def value_of(s: str) -> float | None:
    """A number, simple fraction or root in plain or TeX notation."""
    s = re.sub(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"((\1)/(\2))", s)
    s = re.sub(r"\\sqrt\s*\{([^{}]*)\}", r"((\1)**0.5)", s).replace("\\pi", str(math.pi)).replace("^", "**").replace("{", "(").replace("}", ")")
    return calculate(s, power=True)


OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def calculate(s: str, power: bool = False) -> float | None:
    """Value of an arithmetic expression of numbers, + - * / and brackets; null for anything else."""
    if len(s) > 200 or not re.fullmatch(r"[0-9eE.+\-*/() ]+", s):
        return None

    def walk(n):
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return n.value
        if isinstance(n, ast.BinOp) and type(n.op) in OPS:
            return OPS[type(n.op)](walk(n.left), walk(n.right))
        if power and isinstance(n, ast.BinOp) and isinstance(n.op, ast.Pow):
            a, b = walk(n.left), walk(n.right)
            if abs(b) > 64 or abs(a) > 1e6:
                raise ValueError
            return a**b
        if isinstance(n, ast.UnaryOp) and type(n.op) in OPS:
            return OPS[type(n.op)](walk(n.operand))
        raise ValueError

    try:
        v = walk(ast.parse(s.strip(), mode="eval").body)
        return float(v) if not isinstance(v, complex) else None
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, TypeError, RecursionError):
        return None


@F.pandas_udf(T.DoubleType())
def numeric_value(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else value_of(x)).astype("float64")


def equivalent(a: Column, b: Column) -> Column:
    """Same text, same text after notation is made plain, or values within 1e-6; null if either is null."""
    x, y = clean.plain_latex(a), clean.plain_latex(b)
    u, v = numeric_value(x), numeric_value(y)
    close = F.abs(u - v) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(u), F.abs(v))
    return F.when(a.isNull() | b.isNull(), None).otherwise((F.trim(a) == F.trim(b)) | (x == y) | F.coalesce(close, F.lit(False)))


#: Special tokens of rendered conversations, numbered after the vocabulary.
SPECIAL = ("<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>")


def rank_file(ranks: str) -> str:
    """The path itself, or where the job shipped the file of that name (``SparkContext.addFile``)."""
    if os.path.exists(ranks):
        return ranks
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(ranks))


def _encoder(ranks: str, pattern: str):
    import base64

    import tiktoken

    with open(rank_file(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vellum-core", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def rendered(df: DataFrame, id_col: str, messages_col: str, ranks: str, limit: int = 2048, pattern: str = "") -> DataFrame:
    """id, ids, mask of conversations: a leading system message joins the first user turn, answers and their end are supervised, cut at ``limit``."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.IntegerType()))])

    def run(batches):
        enc = _encoder(ranks, pattern or PATTERN)
        base = enc.max_token_value + 1
        for convs in batches:
            out = []
            for ms in convs:
                turns = [(m["role"], m["content"] or "") for m in ms] if ms is not None else []
                if len(turns) > 1 and turns[0][0] == "system" and turns[1][0] == "user":
                    turns[:2] = [("user", f"{turns[0][1]}\n\n{turns[1][1]}")]
                ids, mask = [base], [0]
                for role, text in turns:
                    own = int(role == "assistant")
                    body = enc.encode_ordinary(text)
                    ids += [base + (3 if own else 1), *body, base + (4 if own else 2)]
                    mask += [0, *[own] * len(body), own]
                out.append((ids[:limit], mask[:limit]))
            yield pd.DataFrame(out, columns=["ids", "mask"])

    def render(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(batches)

    return df.select(id_col, F.pandas_udf(render, schema)(F.col(messages_col)).alias("r")).select(id_col, "r.ids", "r.mask")


def share_of_golds(answer: Column, golds: Column) -> Column:
    """Share of the gold answers that one answer equals; 0 without an answer or golds."""
    return F.when(answer.isNull() | (F.size(golds) == 0), 0.0).otherwise(F.size(F.filter(golds, lambda g: F.trim(g) == F.trim(answer))) / F.size(golds))


def token_bytes(spark, ranks: str = RANKS, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """token_id, n_bytes of a vocabulary file: bytes of the token as text, where bytes that are no text count as the mark that stands for them; special tokens 0."""
    line = F.split(F.col("value"), " ")
    plain = spark.read.text(rank_file(ranks)).select(line[1].cast("int").alias("token_id"), F.unbase64(line[0]).alias("b"))

    @F.pandas_udf(T.IntegerType())
    def size(b: pd.Series) -> pd.Series:
        return b.map(lambda x: len(bytes(x).decode("utf-8", "replace").encode())).astype("int32")

    rows = plain.select("token_id", size("b").alias("n_bytes"))
    base = rows.agg((F.max("token_id") + 1).alias("base"))
    own = base.select(F.explode(F.sequence(F.col("base"), F.col("base") + len(special) - 1)).alias("token_id"), F.lit(0).alias("n_bytes"))
    return rows.unionByName(own)


def encoded(df: DataFrame, id_col: str, text: Column, ranks: str = RANKS, prepend: int | None = None, append: int | None = None, pattern: str = "") -> DataFrame:
    """id, ids: tokens of each text between an optional first and last id; null texts stay null."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(ranks, pattern or PATTERN)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [*([prepend] if prepend is not None else []), *enc.encode_ordinary(t), *([append] if append is not None else [])])

    return df.select(id_col, run(text).alias("ids"))


def decoded(ids: Column, ranks: str = RANKS) -> Column:
    """Text of an array of ids of the vocabulary; ids outside it are passed over."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(ranks, PATTERN)
        for rows in batches:
            yield rows.map(lambda r: None if r is None else enc.decode([int(i) for i in r if 0 <= i <= enc.max_token_value]))

    return run(ids)


def long_chunks(ids: Column, capacity: int, first_id: int | None = None) -> Column:
    """(chunk_no, own_row, ids) of a rendered conversation: the first chunk packs with others, each further one takes a row
    of its own. With ``first_id`` these begin with it, and what it displaces is dropped, as the row is cut to ``capacity``."""
    n = F.greatest(F.ceil(F.size(ids) / F.lit(capacity)).cast("int"), F.lit(1))
    part = lambda i: F.slice(ids, i * capacity + 1, F.lit(capacity))
    body = lambda i: part(i) if first_id is None else F.when(i == 0, part(i)).otherwise(F.concat(F.array(F.lit(first_id)), F.slice(part(i), 1, capacity - 1)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk_no"), (i > 0).alias("own_row"), body(i).alias("ids")))
