"""Deduplication: exact with first-wins, prefix keys, shortest answer, near duplicates within a group."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import checkpointed, with_rank


def first_by(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key by ascending ``order``, nulls first; null keys are one key.

    An aggregate: each task sends on one row a key, so a key that holds a third of the rows gathers nowhere.
    """
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(key)]).agg(first.alias("__r")).select("__r.*")


def turns_key(messages: Column) -> Column:
    """md5 of the turns joined by a double bar."""
    return F.md5(F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "||"))


def distinct_texts(df: DataFrame, text_col: str) -> DataFrame:
    """Distinct non-null texts, shuffled by hash."""
    return df.where(F.col(text_col).isNotNull()).select(text_col).distinct()


def numbered(row: np.ndarray, value: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, token and the row's count of each value (below ``kinds``) with its occurrence number, and the number of tokens."""
    key = np.sort(row.astype(np.int64) * kinds + value)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    count, kind, most = np.diff(np.r_[start, len(key)]), key[start] % kinds, np.zeros(kinds, np.int64)
    np.maximum.at(most, kind, count)
    nth = np.arange(len(key)) - np.repeat(start, count)
    return key // kinds, np.repeat((np.cumsum(most) - most)[kind], count) + nth, np.repeat(count, count), int(most.sum())


def shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], n_tokens: int) -> np.ndarray:
    """Tokens that each row of a shares with each of b, both as (row, token): frequent tokens by a product, others by postings."""
    (ra, ta), (rb, tb) = a, b
    da, db = np.bincount(ta, minlength=n_tokens), np.bincount(tb, minlength=n_tokens)
    out = np.zeros(shape, np.float32)
    many = da * db > shape[0] * shape[1] / 64
    for part in np.array_split(np.flatnonzero(many), many.sum() // 4096 + 1):
        col = np.full(n_tokens, -1)
        col[part] = np.arange(len(part))
        left, right = np.zeros((shape[0], len(part)), np.float32), np.zeros((shape[1], len(part)), np.float32)
        for to, r, c in ((left, ra, col[ta]), (right, rb, col[tb])):
            to[r[c >= 0], c[c >= 0]] = 1
        out += left @ right.T
    few = ~many & (da > 0) & (db > 0)
    ra, ta = ra[few[ta]], ta[few[ta]]
    posted = rb[np.argsort(tb, kind="stable")]
    start, ends = np.cumsum(db) - db, np.searchsorted(ra, np.arange(shape[0] + 1))
    for i in range(shape[0]):
        t = ta[ends[i] : ends[i + 1]]
        n = db[t]
        out[i] += np.bincount(posted[np.repeat(start[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=shape[1])
    return out


def ratio_over(m: SequenceMatcher, floor: float, most: Callable[[int, int, int, int], int] = lambda alo, ahi, blo, bhi: min(ahi - alo, bhi - blo)) -> bool:
    """Whether m.ratio() > floor; the blocks are found largest gap first, until what is left cannot change the answer.

    ``most`` says how many characters of a gap can match.
    """
    la, lb = len(m.a), len(m.b)
    if la + lb == 0:
        return floor < 1
    done, left = 0, most(0, la, 0, lb)
    todo = [(-left, 0, la, 0, lb)]
    while todo and 2.0 * done / (la + lb) <= floor:
        if 2.0 * (done + left) / (la + lb) <= floor:
            return False
        w, alo, ahi, blo, bhi = heappop(todo)
        left += w
        i, j, k = m.find_longest_match(alo, ahi, blo, bhi)
        if k:
            done += k
            for gap in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if w := most(*gap):
                    left += w
                    heappush(todo, (-w, *gap))
    return 2.0 * done / (la + lb) > floor


def grams(code: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the runs of q codes."""
    out = np.zeros(max(0, len(code) - q + 1), np.uint64)
    for k in range(q if len(out) else 0):
        out = out * GOLDEN + code[k : len(code) - q + 1 + k]
    return out


def common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two multisets, each as sorted values and counts."""
    (u, k), (v, m) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(u):
        return 0
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    return int(np.minimum(k, m[at])[v[at] == u].sum())


def rare_places(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rare characters of b, of 200 and more, with where each begins in the order of places by character and its count; that order."""
    order = np.argsort(b, kind="stable")
    kinds, first, count = np.unique(b[order], return_index=True, return_counts=True)
    rare = count <= len(b) // 100 + 1
    return kinds[rare], first[rare], count[rare], order


def meetings(a: np.ndarray, places: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray] | None:
    """Every place of a and of b that hold the same rare character of b; None if these are too many to list."""
    kinds, first, count, order = places
    if not len(kinds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(kinds, a), len(kinds) - 1)
    x = np.flatnonzero(kinds[at] == a)
    n = count[at[x]]
    if n.sum() > MEETINGS:
        return None
    return np.repeat(x, n), order[np.repeat(first[at[x]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def covered(pairs: list[tuple[np.ndarray, np.ndarray]], met: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair a, b: how many places before each of a, and of b, lie in common stretches that hold a rare character of b or begin both.

    Every block of SequenceMatcher's match lies in such a stretch, for b of 200 codes and more.
    """
    ends, spans = [], []
    for side in (0, 1):
        # texts end to end, between them what equals nothing of the other side
        sizes = np.array([len(p[side]) for p in pairs])
        begin = np.cumsum(sizes + 1) - sizes
        text = np.full(int(sizes.sum()) + len(pairs) + 1, BEYOND + np.uint32(side))
        for at, p in zip(begin, pairs):
            text[at : at + len(p[side])] = p[side]
        # the beginnings of both count as a meeting
        ends.append((text, np.concatenate([begin, *[at + m[side] for at, m in zip(begin, met)]])))
        spans.append((begin, sizes))
    (left, xs), (right, ys) = ends
    xs, ys = xs.astype(np.int64), ys.astype(np.int64)
    reach = []
    for step, whole in ((-1, 0), (1, len(pairs))):
        reach.append(np.zeros(len(xs), np.int64))
        live = np.arange(len(xs)) if whole == 0 else np.r_[np.flatnonzero(left[xs[:whole]] == right[ys[:whole]]), np.arange(whole, len(xs))]
        u, v = xs[live], ys[live]
        while len(live):
            u, v = u + step, v + step
            same = np.flatnonzero(left[u] == right[v])
            live, u, v = live[same], u[same], v[same]
            reach[-1][live] += 1
    # a meeting of unlike beginnings covers nothing
    real = np.r_[left[xs[: len(pairs)]] == right[ys[: len(pairs)]], np.ones(len(xs) - len(pairs), bool)]
    out = []
    for z, (text, _), (begin, sizes) in zip((xs, ys), ends, spans):
        edge = np.bincount(z[real] - reach[0][real], minlength=len(text) + 1) - np.bincount(z[real] + 1 + reach[1][real], minlength=len(text) + 1)
        total = np.r_[0, np.cumsum(np.cumsum(edge) > 0)]
        out.append([total[at : at + n + 1] - total[at] for at, n in zip(begin, sizes)])
    return list(zip(*out))


GOLDEN, BEYOND = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x110000)
CELL_CHARS, MEETINGS = 1_500_000, 2_000_000


def beaten(a: pd.DataFrame, b: pd.DataFrame, floor: float, tries: int = 0) -> np.ndarray:
    """Whether a row of b (columns t, n, id) that is preferred to it has a ratio above ``floor`` with each row of a.

    SequenceMatcher drops from texts b of 200 characters and more the characters above 1 %. Every block of its
    match holds one of the others, except one at the very beginning; so with R of these in common there are
    at most R + 1 blocks, a block of k characters holds k - q + 1 runs of q, and the match is at most
    S + (q - 1) (R + 1), S the runs of q in common (hashed, so rather too many). In a shorter b it is at most the
    characters in common. Only pairs above the floor by these bounds, for q of 4, then of 6, and by ``covered`` are
    compared, so none is lost. The likeliest come first; with ``tries`` a row is compared with that many at most.
    """
    texts = list(a["t"]) if a is b else [*a["t"], *b["t"]]
    own = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    na, code, size = len(a), np.concatenate(own) if own else np.zeros(0, np.uint32), np.array([len(c) for c in own], np.int64)
    nb, row = len(texts) - na if a is not b else na, np.repeat(np.arange(len(texts)), size)
    inside, bits = row[:-3] == row[3:], np.uint64(min(20, max(8, len(row).bit_length())))
    grow, gram, _, n_grams = numbered(row[:-3][inside], ((grams(code, 4)[inside[: max(0, len(code) - 3)]] * GOLDEN) >> (np.uint64(64) - bits)).astype(np.int64), 1 << int(bits))
    place = np.cumsum(np.bincount(code) > 0) - 1
    crow, char, count, n_chars = numbered(row, place[code], int(place[-1]) + 1 if len(code) else 1)
    rare = (size[crow] < 200) | (count <= size[crow] // 100 + 1)
    of_a, of_b = lambda r, t: (r[r < na], t[r < na]), lambda r, t: (r[r >= len(texts) - nb] - (len(texts) - nb), t[r >= len(texts) - nb])
    a_own, b_own, b_texts, la, lb = own[:na], own[len(texts) - nb :], texts[len(texts) - nb :], size[:na][:, None], size[len(texts) - nb :][None, :]
    s = shared(of_a(grow, gram), of_b(grow, gram), (na, nb), n_grams)
    r = shared(of_a(crow, char), of_b(crow[rare], char[rare]), (na, nb), n_chars)
    most = np.minimum(np.where(lb < 200, r, s + 3 * (r + 1)), np.minimum(la, lb)).astype(np.float64)
    most = np.where(la + lb == 0, 1.0, 2.0 * most / np.maximum(1, la + lb))
    (n, ids), (m, others) = ((x["n"].to_numpy(), x["id"].to_numpy()) for x in (a, b))
    may = ((m[None, :] > n[:, None]) | ((m[None, :] == n[:, None]) & (others[None, :] < ids[:, None]))) & (most > floor)
    like = np.where(lb < 200, s / np.maximum(1, la + lb), most)
    out, matchers, kept, places = np.zeros(na, bool), {}, {}, {}

    def sixes(key: tuple[bool, int], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if key not in kept:
            kept[key] = np.unique(grams(c, 6), return_counts=True)
        return kept[key]

    def may_cover(pairs: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray] | None]:
        """Of the pairs of long b those that remain, with their covered places, if these are known."""
        remain, batch, met = {}, [], []
        for k, (x, y) in enumerate(pairs):
            if 2.0 * (common(sixes((True, x), a_own[x]), sixes((False, y), b_own[y])) + 5 * (r[x, y] + 1)) / (len(a_own[x]) + len(b_own[y])) > floor:
                if y not in places:
                    places[y] = rare_places(b_own[y])
                if (m := meetings(a_own[x], places[y])) is None:
                    remain[x, y] = None
                else:
                    batch.append((x, y))
                    met.append(m)
            if batch and (k == len(pairs) - 1 or sum(len(m[0]) for m in met) > 300_000):
                for (v, w), (ca, cb) in zip(batch, covered([(a_own[v], b_own[w]) for v, w in batch], met)):
                    if 2.0 * min(int(ca[-1]), int(cb[-1])) / (len(a_own[v]) + len(b_own[w])) > floor:
                        remain[v, w] = ca, cb
                batch, met = [], []
        return remain

    todo = {x: (hits := np.flatnonzero(may[x]))[np.argsort(-like[x, hits], kind="stable")][: tries or None] for x in np.flatnonzero(may.any(axis=1))}
    step = 1
    while todo:
        now = [(x, y) for x, ys in todo.items() for y in ys[:step]]
        cover = may_cover([(x, y) for x, y in now if len(b_own[y]) >= 200])
        for x, y in now:
            if out[x] or len(b_own[y]) >= 200 and (x, y) not in cover:
                continue
            if y not in matchers:
                matchers[y] = SequenceMatcher()
                matchers[y].set_seq2(b_texts[y])
            matchers[y].set_seq1(texts[x])
            if cover.get((x, y)):
                ca, cb = cover[x, y]
                out[x] = ratio_over(matchers[y], floor, lambda alo, ahi, blo, bhi: min(int(ca[ahi] - ca[alo]), int(cb[bhi] - cb[blo])))  # noqa: B023
            else:
                out[x] = ratio_over(matchers[y], floor)
        todo = {x: ys[step:] for x, ys in todo.items() if not out[x] and len(ys) > step}
        step *= 2
    return out


def near_within(df: DataFrame, group_col: str, id_col: str, text_col: str, size_col: str, floor: float = 0.6, block: int = 1024) -> DataFrame:
    """group, id of the rows of each group to which no alike row of the group is preferred.

    The larger row is preferred, of equal ones that of the lesser id; so the result needs no order of
    visits. Likeness is the matching-block ratio of the whole texts; equal texts meet once. Every pair
    of a group is held against an exact bound (see ``beaten``), but a row that is found worse meets no others: groups
    of more than ``block`` rows are ranked by preference, and their rows tried first on the likeliest of the most preferred
    (``beaten_of_large``), small groups share a task. Null texts count as empty; rows of a null group stay.
    """
    rows = df.select(F.col(group_col).alias("g"), F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"), F.col(size_col).alias("n"))
    best = rows.groupBy("g", "t").agg(F.max(F.struct(F.col("n"), (-F.col("id")).alias("m"))).alias("b")).select("g", "t", "b.n", (-F.col("b.m")).alias("id"))
    sizes = checkpointed(df.groupBy(F.col(group_col).alias("g")).agg(F.count("*").alias("rows")))
    big = sizes.where(F.col("g").isNotNull() & (F.col("rows") > block)).select("g")
    total, n_big = sizes.agg(F.sum("rows")).first()[0] or 0, big.count()
    few = F.broadcast(big) if n_big <= 100_000 else big
    small, bundles = best.join(few, "g", "left_anti") if n_big else best, max(48, total // (2 * block) + 1)
    key = F.xxhash64(F.coalesce(F.col("g").cast("string"), F.col("id").cast("string")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(pdf), bool)
        for at in pdf.groupby("g", sort=False).indices.values():
            if len(at) > 1:
                own = pdf.iloc[at]
                out[at] = beaten(own, own, floor)
        return pd.DataFrame({"g": pdf["g"], "id": pdf["id"], "worse": out})

    kind = {f.name: f.dataType.simpleString() for f in best.schema}
    cells = small.select(F.pmod(key, F.lit(bundles)).alias("cell"), "g", "id", "n", "t").repartition(bundles, "cell")
    seen = cells.groupBy("cell").applyInPandas(run, f"g {kind['g']}, id {kind['id']}, worse boolean")
    if n_big:
        seen = seen.unionByName(beaten_of_large(best.join(few, "g"), floor, block))
    return seen.groupBy("g", "id").agg(F.max("worse").alias("worse")).where("not worse").select(F.col("g").alias(group_col), F.col("id").alias(id_col))


def beaten_of_large(rows: DataFrame, floor: float, block: int) -> DataFrame:
    """g, id, worse of rows (g, id, n, t) of large groups.

    First each row is compared with the four likeliest of the first ``block`` rows of its group. If that leaves few, these are compared
    with the eight likeliest of a wider window, and what is left with all rows before it, in growing windows; else
    all pairs are held against the bound at once. Windows and rows are cut into slices of ranks, and two slices meet in a task unless their lengths rule a likeness out.
    """
    ranked = with_rank(rows.withColumn("m", -F.col("n")), ["g"], ["m", "id"]).drop("m")
    slim = checkpointed(ranked.select("g", "rank", "total", F.length("t").alias("size")))
    longest, n_all = slim.agg(F.max("total"), F.count("*")).first()
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    dead, n_dead, run_of = None, 0, max(1, block // 16)

    def alive(x: DataFrame) -> DataFrame:
        return x if dead is None else x.join(F.broadcast(dead) if n_dead <= 200_000 else dead, ["g", "rank"], "left_anti")

    def run(tries: int):
        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf[pdf["later"]], pdf[~pdf["later"]]
            parts = [a.iloc[k : k + block] for k in range(0, len(a), block)] if len(b) else []
            worse = [p[["g", "rank"]][beaten(p, b, floor, tries)] for p in parts]
            return pd.concat([pdf[["g", "rank"]].iloc[:0], *worse])

        return of

    def sliced(x: DataFrame, name: str, end: str, rows: int) -> tuple[DataFrame, DataFrame]:
        """The slice of each run of ranks, and what each slice spans; a slice has about that many rows, of long texts fewer."""
        runs = x.groupBy("g", F.expr(f"rank div {run_of}").alias("run")).agg(F.count("*").alias("rows"), F.sum("size").alias("chars"), F.min("size").alias("least"), F.max("size").alias("most"), F.min("rank").alias("first"), F.max("rank").alias("last"))
        share = F.greatest(F.col("rows") / rows, F.col("chars") / CELL_CHARS)
        runs = checkpointed(runs.withColumn(name, F.floor(F.sum(share).over(Window.partitionBy("g").orderBy("run")) - share)))
        return runs.select("g", "run", name), runs.groupBy("g", name).agg(*[f(c).alias(f"{end}_{c}") for c, f in (("least", F.min), ("most", F.max), ("first", F.min), ("last", F.max))])

    def hold(lo: int, hi: int, tries: int, rows: int = block) -> None:
        nonlocal dead, n_dead
        of_later, later = sliced(alive(slim), "i", "a", rows)
        of_before, before = sliced(slim.where(F.col("rank").between(lo, hi - 1)), "j", "b", rows)
        # the ratio of two lengths that lie as near as these slices allow
        apart = F.expr("case when a_most < b_least then 2.0D * a_most / (a_most + b_least) when b_most < a_least then 2.0D * b_most / (a_least + b_most) else 1.0D end")
        pairs = checkpointed(later.join(before, "g").where((F.col("a_last") > F.col("b_first")) & (apart > floor)).select("g", "i", "j"))
        if n_pairs := pairs.count():
            # about sixteen runs a slice
            sent = (lambda x: F.broadcast(x)) if n_pairs <= 10_000 else (lambda x: x)
            meet = lambda x, of: x.withColumn("run", F.expr(f"rank div {run_of}")).join(sent(of.join(pairs, ["g", of.columns[-1]])), ["g", "run"])
            side = lambda x, late: x.select("g", "i", "j", "rank", "id", "n", "t", F.lit(late).alias("later"))
            a, b = meet(alive(ranked), of_later), meet(ranked.where(F.col("rank").between(lo, hi - 1)), of_before)
            cells = side(a, True).unionByName(side(b, False)).repartition(min(4 * n_pairs, 10_000), "g", "i", "j")
            found = cells.groupBy("g", "i", "j").applyInPandas(run(tries), f"g {kind['g']}, rank bigint").distinct()
            dead = checkpointed(found if dead is None else found.unionByName(dead))
            n_dead = dead.count()

    hold(0, block, 4)
    if few := 8 * (n_all - n_dead) < n_all:
        hold(block, 16 * block, 8)
    lo, hi = 0, block if few else longest
    while lo < longest:
        # few rows that all meet everything would else lie in a task or two
        hold(lo, hi, 0, run_of if few else block)
        lo, hi = hi, 8 * hi
    marked = ranked.select("g", "id", "rank")
    return marked.join(dead.withColumn("worse", F.lit(True)), ["g", "rank"], "left").select("g", "id", F.coalesce("worse", F.lit(False)).alias("worse")) if dead is not None else marked.select("g", "id", F.lit(False).alias("worse"))
