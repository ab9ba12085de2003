"""Mixing sources to target token shares by Pfair scheduling of equal blocks.

The mixture is as large as the sources allow: each may be repeated up to its cap, and the scarcest
one, measured against its target, sets the total. Every source's stream (documents in hashed order,
then again for each repeat) is cut into blocks of equal token size. Block j of a source of weight w
is released at floor((j - 1) / w) and due at ceil(j / w); earliest deadline first then keeps every
source within one block of its share at all times. Weights are fractions, so the schedule repeats after
their common denominator: one period is planned, at most ``max_period`` slots whatever the data's size, and a
block's slot follows from its number. Positions inside a source are prefix sums taken in two levels,
so that no source is gathered in one task.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


@dataclass
class Share:
    source: str
    weight: Fraction
    tokens: int  # tokens of one pass over the source
    limit: int  # tokens it gives to the mixture
    max_repeats: int


def sizes(tokens: dict[str, int], targets: list[tuple[str, float, int]]) -> list[Share]:
    """What each source gives. Sources without tokens, target or repeats give nothing; the others' targets are scaled to 1."""
    able = [(s, Fraction(t).limit_denominator(10**6), r) for s, t, r in targets if s is not None and t and t > 0 and r and r > 0 and tokens.get(s, 0) > 0]
    whole = sum((t for _, t, _ in able), Fraction(0))
    if not able:
        return []
    total = min(Fraction(tokens[s] * r) / (t / whole) for s, t, r in able)
    return [Share(s, t / whole, tokens[s], int(total * t / whole), r) for s, t, r in sorted(able)]


def counts_of(weights: dict[str, Fraction], max_period: int) -> dict[str, int]:
    """Blocks of each source in one period: exact for a common denominator of up to ``max_period``.

    Beyond it the period has ``max_period`` slots, dealt by largest remainder, so that a share is off by less than
    1 / max_period.
    """
    period = math.lcm(*(w.denominator for w in weights.values())) if weights else 0
    if period <= max_period:
        return {s: int(w * period) for s, w in weights.items()}
    got = {s: max(1, int(w * max_period)) for s, w in weights.items()}
    for s in sorted(weights, key=lambda s: (got[s] - weights[s] * max_period, s))[: max(0, max_period - sum(got.values()))]:
        got[s] += 1
    return got


def schedule(counts: dict[str, int]) -> tuple[list[tuple[str, int, int]], dict[str, Fraction]]:
    """(source, block number in the period from 0, slot) by earliest deadline first; greatest deviation of each source in blocks."""
    period = sum(counts.values())
    ready: list[tuple[int, str, int]] = []
    coming: list[tuple[int, str, int]] = [(0, s, 1) for s in sorted(counts) if counts[s]]
    heapq.heapify(coming)
    out: list[tuple[str, int, int]] = []
    # deviations in units of 1 / period of a block
    owed, worst = dict.fromkeys(counts, 0), dict.fromkeys(counts, 0)
    for slot in range(period):
        while coming and coming[0][0] <= slot:
            _, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-j * period // counts[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j - 1, slot))
        if j < counts[s]:
            heapq.heappush(coming, (j * period // counts[s], s, j + 1))
        owed[s] -= period
        for x, n in counts.items():
            owed[x] += n
            worst[x] = max(worst[x], abs(owed[x]))
    return out, {s: Fraction(n, period) for s, n in worst.items()}


def key_of(column: str) -> F.Column:
    """Sources differ neither by case nor by blanks around them."""
    return F.lower(F.trim(F.col(column)))


def _ranked(docs: DataFrame, id_col: str, part_docs: int, seed: int) -> tuple[DataFrame, dict[str, int]]:
    """Documents with the tokens before them in their source's hashed order, and tokens by source."""
    n = docs.count()
    parts = max(1, n // part_docs)
    d = docs.withColumn("key", F.xxhash64(F.lit(seed), id_col)).withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    sums = checkpointed(d.groupBy("source", "part").agg(F.sum("n_tokens").alias("sum")))
    tokens = {r[0]: int(r[1]) for r in sums.groupBy("source").agg(F.sum("sum")).collect()}  # at most as many as targets
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("source", "part", F.coalesce(before, F.lit(0)).alias("base"))
    inner = F.sum("n_tokens").over(Window.partitionBy("source", "part").orderBy("key", id_col).rowsBetween(Window.unboundedPreceding, -1))
    out = d.withColumn("inner", F.coalesce(inner, F.lit(0))).join(base, ["source", "part"])
    return out.select(F.col(id_col), "source", "n_tokens", (F.col("base") + F.col("inner")).alias("offset")), tokens


def _plan(counts: DataFrame, targets: DataFrame, id_col: str, source_col: str, part_docs: int, seed: int, max_targets: int):
    goal = [(r[0], r[1], r[2]) for r in targets.select(key_of("source"), "target_share", "max_repeats").limit(max_targets + 1).collect()]
    if len(goal) > max_targets:
        raise ValueError(f"more than {max_targets} target sources")
    names = targets.select(key_of("source").alias("source")).distinct()
    docs = checkpointed(counts.where("n_tokens > 0").select(F.col(id_col), key_of(source_col).alias("source"), "n_tokens").join(F.broadcast(names), "source", "left_semi"))
    ranked, tokens = _ranked(docs, id_col, part_docs, seed)
    return goal, ranked, tokens, sizes(tokens, goal)


def mixture(
    counts: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", block_tokens: int = 4096, max_period: int = 100_000,
    part_docs: int = 20_000, seed: int = 1, max_targets: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """(rows: id, source, repeat_no, slot, source_offset, n_tokens; report by target source).

    ``counts`` has id_col, source_col and n_tokens. Rows read in order of slot, then source_offset.
    Documents of null or unlisted sources, or without tokens, are not mixed. A document belongs to
    the block where it starts, so blocks differ from ``block_tokens`` by part of a document.
    """
    spark = counts.sparkSession
    goal, ranked, tokens, shares = _plan(counts, targets, id_col, source_col, part_docs, seed, max_targets)
    counts_in = counts_of({s.source: s.weight for s in shares}, max_period)
    slots, worst = schedule(counts_in)
    plan = spark.createDataFrame(
        [(s.source, s.tokens, s.limit, -(-s.limit // s.tokens), counts_in[s.source]) for s in shares], "source string, pass_tokens bigint, limit_tokens bigint, passes int, in_period bigint"
    )
    turn = spark.createDataFrame(slots, "source string, turn bigint, place bigint")
    streams = (
        ranked.join(F.broadcast(plan), "source")
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        .withColumn("source_offset", F.col("repeat_no") * F.col("pass_tokens") + F.col("offset"))
        .where("source_offset < limit_tokens")
        .withColumn("block", F.expr(f"source_offset div {block_tokens}"))
        .withColumn("turn", F.pmod("block", "in_period"))
    )
    slot = F.expr(f"block div in_period * {sum(counts_in.values())}") + F.col("place")
    rows = streams.join(F.broadcast(turn), ["source", "turn"]).select(id_col, "source", F.col("repeat_no").cast("int").alias("repeat_no"), slot.alias("slot"), "source_offset", "n_tokens")
    by = {s.source: s for s in shares}
    facts = [
        (s, float(t) if t is not None else None, r, tokens.get(s, 0), -(-by[s].limit // by[s].tokens) if s in by else 0, float(worst.get(s, 0)), block_tokens)
        for s, t, r in goal
    ]
    facts_df = spark.createDataFrame(facts, "source string, target_share double, max_repeats int, source_tokens bigint, passes int, worst_blocks double, block_tokens bigint")
    got = rows.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("mixed_docs"))
    whole = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = facts_df.join(got, "source", "left").join(F.broadcast(whole), F.lit(True), "left").select(
        "source", "target_share", F.round(F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), "max_repeats", "passes",
        "source_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("mixed_docs", F.lit(0)).alias("mixed_docs"), "worst_blocks", "block_tokens",
    )
    return rows, report
