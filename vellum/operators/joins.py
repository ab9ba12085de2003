"""Joins: metadata recovery, lookups, exclusions, substring search, positional zip, fuzzy titles."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import checkpointed, with_index

#: A side is broadcast only if its plan is known to be below this size; else the join shuffles.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """Hint a broadcast if the optimizer's size of the side is below the bound."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(size) <= BROADCAST_BYTES else df


def recover(texts: DataFrame, full: DataFrame, text_col: str, order: list[Column]) -> DataFrame:
    """The first full row, in ``order``, of each text of ``texts``; joined on the text's hash and the text."""
    want = texts.select(F.col(text_col)).where(F.col(text_col).isNotNull()).distinct().withColumn("__h", F.xxhash64(text_col))
    have = full.where(F.col(text_col).isNotNull()).withColumn("__h", F.xxhash64(text_col))
    rows = have.join(want, ["__h", text_col], "left_semi")
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("__h", text_col).orderBy(*order))).where("__r = 1").drop("__r", "__h")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column, last_by: Column) -> DataFrame:
    """Left lookup of one value by key; of duplicate keys the last wins, without one the default."""
    one = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, last_by).alias(value))
    return df.join(small(one), key, "left").withColumn(value, F.coalesce(F.col(value), default))


def missing(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a counterpart: exclusions and resumed work."""
    return df.join(done.select(*on).distinct(), on, "left_anti")


def search(df: DataFrame, specs: DataFrame, title: Column, text: Column, prefix: int = 3000, max_specs: int = 10_000) -> DataFrame:
    """Rows x specs where a title word is in the title, or a title and an author word are in the text's beginning.

    ``specs`` (spec_id, title_words, author_words) is a stated query set of bounded size. All its words are one
    Aho-Corasick automaton, so a row is read once whatever the number of specs and only the specs of words that
    occur are looked at.
    """
    rows = specs.select("spec_id", "title_words", "author_words").orderBy("spec_id").limit(max_specs + 1).collect()
    if len(rows) > max_specs:
        raise ValueError(f"more than {max_specs} specs")
    plan = [(r[0], frozenset(w.lower() for w in r[1] or []), frozenset(w.lower() for w in r[2] or [])) for r in rows]
    shared = df.sparkSession.sparkContext.broadcast(plan)

    @F.pandas_udf(f"array<struct<spec_id:{specs.schema['spec_id'].dataType.simpleString()}, how:string>>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import ahocorasick

        specs_of: dict[str, set[int]] = {}
        machine = ahocorasick.Automaton()
        for n, (_, titles, authors) in enumerate(shared.value):
            for w in titles | authors:
                specs_of.setdefault(w, set()).add(n)
        for w in specs_of:
            if w:
                machine.add_word(w, w)
        machine.make_automaton()
        empty = {n for n in specs_of.get("", ())}

        def words(text: str) -> set[str]:
            return {w for _, w in machine.iter(text)} | ({""} if empty else set()) if len(machine) else set()

        for heads, bodies in batches:
            out = []
            for t, x in zip(heads, bodies):
                in_title, in_text = words(t), words(x)
                hits = []
                for n in sorted({n for w in in_title | in_text for n in specs_of[w]}):
                    spec, titles, authors = shared.value[n]
                    if titles & in_title:
                        hits.append((spec, "title"))
                    elif titles & in_text and authors & in_text:
                        hits.append((spec, "text"))
                out.append([{"spec_id": a, "how": b} for a, b in hits])
            yield pd.Series(out)

    low_title, head = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, prefix))
    return df.withColumn("hit", F.explode(found(low_title, head))).select("*", "hit.*").drop("hit")


def zipped(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Row i with row i of two frames of equal length, which is asserted."""
    a, b = with_index(left, *left_order), with_index(right, *right_order)
    na, nb = a.count(), b.count()
    if na != nb:
        raise ValueError(f"{na} rows against {nb}")
    return a.join(b, "idx")


def merge_best(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """Full outer union on a key with the greater score."""
    other = b.select(key, F.col(score).alias("__s"))
    return a.join(other, key, "full").withColumn(score, F.greatest(score, "__s")).drop("__s")


def best_of_titles(df: DataFrame, id_col: str, key_col: str, score_col: str) -> DataFrame:
    """rep_id, id of the row of the greatest score in each group of alike titles; of equal scores the least id. Null scores count least."""
    groups = fuzzy_titles(df, id_col, key_col)
    ranked = df.select(F.col(id_col), F.coalesce(F.col(score_col), F.lit(-1)).alias("__s")).join(groups, id_col)
    return ranked.groupBy("rep_id").agg(F.max_by(id_col, F.struct("__s", -F.col(id_col))).alias(id_col), F.count("*").alias("n"))


def letter_bits(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """256 bits of each string's letters with their occurrence numbers, and how many of these fell on a bit already set."""
    bits, spare = np.zeros((len(keys), 4), np.uint64), np.zeros(len(keys), np.int64)
    for i, key in enumerate(keys):
        seen: dict[str, int] = {}
        got = 0
        for c in key:
            n = seen[c] = seen.get(c, -1) + 1
            got |= 1 << (ord(c) % 32 * 8 + min(n, 7))
        bits[i] = [got >> at & 0xFFFFFFFFFFFFFFFF for at in (0, 64, 128, 192)]
        spare[i] = len(key) - got.bit_count()
    return bits, spare


def first_alike(keys: list[str], side: np.ndarray, across: bool, floor: float) -> list[int]:
    """Of each key the position of the first earlier one with a ratio of ``floor`` at least, or -1; ``across``: only of the other side.

    Matching blocks are a common subsequence and a common multiset of letters, so the sizes of both bound
    the ratio from above: pairs that either leaves below the floor are not compared, and none else is left out.
    """
    bits, spare = letter_bits(keys)
    size = np.array([len(k) for k in keys], np.int64)
    out = []
    for p, x in enumerate(keys):
        common = np.bitwise_count(bits[:p] & bits[p]).sum(axis=1, dtype=np.int64) + np.minimum(spare[:p], spare[p])
        may = 2.0 * np.minimum(common, np.minimum(size[:p], size[p])) / np.maximum(1, size[:p] + size[p]) >= floor
        if across:
            may &= side[:p] != side[p]
        masks: dict[str, int] = {}
        for i, c in enumerate(x):
            masks[c] = masks.get(c, 0) | 1 << i
        full, to = (1 << len(x)) - 1, -1
        for q in np.flatnonzero(may):
            y, v = keys[q], full
            for c in y:  # the zeros of v count the longest common subsequence so far
                u = v & masks.get(c, 0)
                v = (v + u | v - u) & full
            if 2.0 * (len(x) - v.bit_count()) / (len(x) + len(y)) >= floor and SequenceMatcher(None, x, y).ratio() >= floor:
                to = int(q)
                break
        out.append(to)
    return out


def fuzzy_titles(df: DataFrame, id_col: str, key_col: str, floor: float = 0.75, block: int = 4096) -> DataFrame:
    """id, rep_id: the least id whose key is alike enough, itself at least.

    Keys equal to one another meet once as a key. Every key is compared with every one of lesser id: keys
    are dealt over blocks of about ``block``, and each pair of blocks is one group (see ``first_alike``), so
    nothing is broadcast; the work grows with the square of the distinct keys.
    """
    keys = checkpointed(df.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(F.min(id_col).alias("rep")))
    n = max(8, -(-keys.count() // block))
    dealt = keys.where("rep is not null").select(F.col(key_col).alias("x"), F.col("rep").alias("rx"), F.pmod(F.xxhash64(key_col), F.lit(n)).cast("int").alias("side"))
    cells = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("x", "rx", "side", F.least("side", "j").alias("i"), F.greatest("side", "j").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rx", kind="stable")
        to = np.array(first_alike(list(pdf["x"]), pdf["side"].to_numpy(), bool(pdf["i"].iloc[0] != pdf["j"].iloc[0]), floor), np.int64)
        return pd.DataFrame({"x": pdf["x"].to_numpy()[to >= 0], "ry": pdf["rx"].to_numpy()[to[to >= 0]]})

    kind = keys.schema["rep"].dataType.simpleString()
    near = cells.repartition(n * (n + 1) // 2, "i", "j").groupBy("i", "j").applyInPandas(run, f"x string, ry {kind}").groupBy("x").agg(F.min("ry").alias("to"))
    return df.select(id_col, key_col).join(keys.select(key_col, "rep"), key_col).join(near.withColumnRenamed("x", key_col), key_col, "left").select(id_col, F.least("rep", F.coalesce("to", "rep")).alias("rep_id"))
