"""Filling fixed-capacity rows with documents: large-item matching, then best fit, on the size histogram.

Only sizes matter for filling, and there are at most ``capacity`` of them, so the plan is made on the
histogram: a bounded driver-side table, whatever the number of documents. Items above a third of the
capacity are matched greedily, at most two to a row (the largest with the largest that still fits);
smaller ones go, largest first, into the tightest gap. The plan is a list of row patterns with
multiplicities; documents take their places in it by their rank among those of their size, ranks
being counted in salted parts so that no size is gathered in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

Pattern = tuple[tuple[int, int], ...]  # (size, copies) in row order


def match_large(hist: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Rows of one or two items above a third of the capacity, with multiplicities."""
    left = {s: n for s, n in hist.items() if 3 * s > capacity and n > 0}
    sizes = sorted(left)
    out: list[tuple[Pattern, int]] = []
    while sizes:
        s = sizes[-1]
        k = bisect_left(sizes, capacity - s + 1) - 1
        if k < 0:
            out.append((((s, 1),), left[s]))
            sizes.pop()
            continue
        p = sizes[k]
        if p == s:
            pairs, rest = divmod(left[s], 2)
            if pairs:
                out.append((((s, 2),), pairs))
            left[s] = rest
            if rest:
                # the odd one may still take the next smaller size
                k -= 1
                if k >= 0:
                    q = sizes[k]
                    out.append((((s, 1), (q, 1)), 1))
                    left[q] -= 1
                    if not left[q]:
                        sizes.pop(k)
                else:
                    out.append((((s, 1),), 1))
            sizes.pop()
            continue
        n = min(left[s], left[p])
        out.append((((s, 1), (p, 1)), n))
        for x in (s, p):
            left[x] -= n
            if not left[x]:
                sizes.remove(x)
    return out


def plan(hist: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Row patterns with multiplicities that hold every item of the histogram (sizes up to capacity)."""
    gaps: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    order: list[int] = []

    def put(pattern: Pattern, n: int) -> None:
        gap = capacity - sum(s * c for s, c in pattern)
        if not gaps[gap]:
            insort(order, gap)
        gaps[gap].append((pattern, n))

    for pattern, n in match_large(hist, capacity):
        put(pattern, n)
    for s in sorted((x for x in hist if 3 * x <= capacity and x > 0), reverse=True):
        n = hist[s]
        while n:
            k = bisect_left(order, s)
            if k == len(order):
                q = capacity // s
                full, rest = divmod(n, q)
                if full:
                    put(((s, q),), full)
                if rest:
                    put(((s, rest),), 1)
                n = 0
                continue
            gap = order[k]
            pattern, rows = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(k)
            q = gap // s
            full = min(rows, n // q)
            if full:
                put((*pattern, (s, q)), full)
                n -= full * q
                rows -= full
            if rows and n and n < q:
                put((*pattern, (s, n)), 1)
                n = 0
                rows -= 1
            if rows:
                put(pattern, rows)
    return [x for gap in order for x in gaps[gap]]


def places(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """Per size an array of (first rank, first row, copies a row, offset in the row), by first rank."""
    used: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    row = 0
    for pattern, n in patterns:
        at = 0
        for s, c in pattern:
            out[s].append((used[s], row, c, at))
            used[s] += n * c
            at += s * c
        row += n
    return {s: np.array(v, np.int64) for s, v in out.items()}


def pieces_of(counts: DataFrame, id_cols: list[str], capacity: int) -> DataFrame:
    """Items: whole documents, or the pieces of a document above the capacity (all but the last full)."""
    n_pieces = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("int")
    return (
        counts.where("n_tokens > 0")
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), n_pieces - 1)))
        .withColumn("start_token", F.col("piece_no").cast("bigint") * capacity)
        .withColumn("size", F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("start_token")).cast("int"))
        .select(*id_cols, "piece_no", "start_token", "size")
    )


def pack(counts: DataFrame, id_cols: list[str], capacity: int, part_rows: int = 20_000) -> DataFrame:
    """Rows of at most ``capacity`` tokens: id_cols, piece_no, start_token, n_tokens, row_id, row_offset.

    ``counts`` has id_cols and n_tokens. Documents of 0 or null tokens take no room and have no row;
    only documents above the capacity are cut; equal ids are separate items.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = checkpointed(pieces_of(counts, id_cols, capacity))
    hist = {int(r[0]): int(r[1]) for r in items.groupBy("size").count().collect()}  # at most `capacity` rows
    salts = max(1, sum(hist.values()) // part_rows)
    items = items.withColumn("salt", F.pmod(F.xxhash64(*id_cols, "piece_no"), F.lit(salts)).cast("int"))
    sums = items.groupBy("size", "salt").count()
    before = F.sum("count").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("size", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("size", "salt").orderBy(*id_cols, "piece_no")) - 1
    ranked = items.withColumn("inner", inner).join(base, ["size", "salt"]).select(*id_cols, "piece_no", "start_token", "size", (F.col("base") + F.col("inner")).alias("rank"))
    where = places(plan(hist, capacity))
    shared = items.sparkSession.sparkContext.broadcast(where)
    n = len(id_cols)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:n])

    def run(batches):
        table = shared.value
        for b in batches:
            size, rank = b.column(n + 2).to_numpy(), b.column(n + 3).to_numpy()
            row = np.zeros(len(size), np.int64)
            off = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                t = table[int(s)]
                k = np.searchsorted(t[:, 0], rank[at], side="right") - 1
                d = rank[at] - t[k, 0]
                row[at] = t[k, 1] + d // t[k, 2]
                off[at] = t[k, 3] + d % t[k, 2] * int(s)
            cols = [b.column(i) for i in range(n + 2)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size.astype(np.int64)), pa.array(row), pa.array(off)], names=[*id_cols, "piece_no", "start_token", "n_tokens", "row_id", "row_offset"])

    return ranked.mapInArrow(run, f"{kinds}, piece_no int, start_token bigint, n_tokens bigint, row_id bigint, row_offset bigint")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Rows by tenth of fill: rows, items, tokens, free tokens."""
    rows = packed.groupBy("row_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return rows.groupBy(F.floor(F.col("tokens") * 10 / capacity).cast("int").alias("fill_tenth")).agg(
        F.count("*").alias("n_rows"), F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.sum(capacity - F.col("tokens")).alias("free_tokens")
    )
