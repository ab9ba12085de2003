"""Near-duplicate records: ProbMinHash signatures, banding, exact verification, groups.

Each record is the set of its distinct word shingles, all of weight 1, as the verification counts
them. ProbMinHash lets every shingle arrive by a Poisson process, each arrival hitting one register;
a record is done once no further arrival can come before its slowest register (early termination).
Registers agree with the Jaccard likeness of two records. Records of equal content form one class
and only classes are banded: a pair of likeness 0.5 shares a band with chance 0.98. Band rows are
two numbers and are shuffled once, by bucket; a task reads its buckets in order and holds at most ``bucket``
rows. Larger buckets are cut into blocks whose signatures are compared block by block, emitting only
pairs that the signatures support; buckets too large for one task are found by counts over a fixed
number of slots and never meet in one. Every candidate pair is verified on the 64-bit hashes of all
its shingles, fetched only for classes that are in a candidate pair.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import checkpointed

WORD = re.compile(r"[a-z0-9]+")
ROWS, BANDS = 4, 64
REGISTERS = ROWS * BANDS
WORD_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789"
SALT = np.uint64(0xD1B54A32D192ED03)


def content(title: str | None, text: str) -> str:
    return f"{title or ''} {text}".lower()


def shingle_set(words: list[str], k: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(k))))


def _layout(contents: list[str]) -> tuple[tv.Block, np.ndarray, np.ndarray]:
    """Block, word hashes and the record of each word."""
    b = tv.block(contents)
    w0, w1 = tv.runs(tv.char_set(WORD_CHARS)[b.clip])
    doc = np.searchsorted(b.start, w0, side="right") - 1
    return b, tv.range_hash(b.low, w0, w1), doc


def content_keys(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each record's word sequence."""
    first = np.searchsorted(doc, np.arange(n))
    last = np.searchsorted(doc, np.arange(n), side="right")
    return tv.range_hash(words, first, last).view(np.int64), tv.range_hash(tv.mix(words + SALT), first, last).view(np.int64)


def prob_minhash(elem: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures (n x m) of records given their distinct elements; rows without elements are 0."""
    best = np.full(n * m, np.inf)
    sig = np.zeros(n * m, np.uint64)
    at = np.zeros(len(elem))
    act = np.arange(len(elem))
    step = 0
    while len(act):
        step += 1
        e = elem[act]
        a, c = (np.uint64(step * int(x) % (1 << 64)) for x in (tv.HASH_BASE, SALT))
        u = tv.uniform(tv.mix(e + a))
        at[act] -= np.log(u) / weight[act]
        reg = (tv.mix(e ^ c) >> np.uint64(33)).astype(np.int64) % m
        key = doc[act] * m + reg
        h = at[act]
        np.minimum.at(best, key, h)
        won = h == best[key]
        sig[key[won]] = e[won]
        slowest = best.reshape(n, m).max(axis=1)
        act = act[h < slowest[doc[act]]]
    return sig.reshape(n, m)


def signatures(contents: list[str], k: int) -> dict[str, np.ndarray]:
    """Content keys, distinct shingle counts and signatures of a block of records."""
    n = len(contents)
    _, words, doc = _layout(contents)
    hi, lo = content_keys(words, doc, n)
    count = np.zeros(n, np.int64)
    sig = np.zeros((n, REGISTERS), np.uint64)
    if len(words) >= k:
        at = np.arange(len(words) - k + 1)
        at = at[doc[at] == doc[at + k - 1]]
        sh = tv.range_hash(words, at, at + k)
        d = doc[at]
        order = np.lexsort((sh, d))
        sh, d = sh[order], d[order]
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (d[1:] != d[:-1])
        start = np.flatnonzero(new)
        count = np.bincount(d[start], minlength=n)
        sig = prob_minhash(sh[start], np.ones(len(start)), d[start], n)
    return {"hi": hi, "lo": lo, "n_shingles": count, "sig": sig}


def band_hashes(sig: np.ndarray) -> np.ndarray:
    n, m = sig.shape
    flat = tv.range_hash(sig.reshape(-1), np.arange(0, n * m, ROWS), np.arange(ROWS, n * m + 1, ROWS))
    return flat.view(np.int64).reshape(n, m // ROWS)


def records_of(df: DataFrame, id_col: str, title_col: str, text_col: str, min_chars: int) -> DataFrame:
    keep = F.col(f"`{text_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & (F.length(f"`{text_col}`") >= min_chars)
    return df.where(keep).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{title_col}`").alias("title"), F.col(f"`{text_col}`").alias("text"))


def signed(df: DataFrame, id_col: str, title_col: str, text_col: str, k: int, min_chars: int) -> DataFrame:
    """id, hi and lo (hashes of the content: its class), shingle count, band hashes and one signature byte a register."""
    src = records_of(df, id_col, title_col, text_col, min_chars)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            at = 0
            for part in tv.split_by_size(rows, lambda r: len(r[1])):
                s = signatures([content(*r) for r in part], k)
                bands = band_hashes(s["sig"])
                width = bands.shape[1]
                offs = pa.array(np.arange(0, (len(part) + 1) * width, width, dtype=np.int32))
                small = (s["sig"] & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)), pa.array(s["hi"]), pa.array(s["lo"]), pa.array(s["n_shingles"]),
                        pa.ListArray.from_arrays(offs, pa.array(bands.reshape(-1))), pa.array([r.tobytes() for r in small], pa.binary()),
                    ],
                    names=["id", "hi", "lo", "n_shingles", "bands", "sig"],
                )
                at += len(part)

    return src.mapInArrow(run, f"id {kind}, hi bigint, lo bigint, n_shingles bigint, bands array<bigint>, sig binary")


def bucket_rows(rows: DataFrame, bucket: int) -> DataFrame:
    """h, a, b: the pairs a < b of every bucket of up to ``bucket`` classes; of larger buckets each class as a, b null.

    rows: h, hi. The shuffle is by h; a task streams over its sorted rows and holds one bucket at most.
    """

    def run(batches):
        h_open: int | None = None
        held = np.zeros(0, np.int64)
        large = False

        def pairs(h: np.ndarray, x: np.ndarray, size: np.ndarray):
            """All pairs of buckets of two or more, by size."""
            start = np.cumsum(size) - size
            for n in np.unique(size[size > 1]).tolist():
                at = start[size == n]
                i, j = np.triu_indices(n, 1)
                yield np.repeat(h[at], len(i)), x[(at[:, None] + i).ravel()], x[(at[:, None] + j).ravel()]

        def batch_of(parts):
            h, a, b = (np.concatenate(c) for c in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(a), pa.array(b)], names=["h", "a", "b"])

        def crowd(h: int, x: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), h)), pa.array(x), pa.nulls(len(x), pa.int64())], names=["h", "a", "b"])

        def closed():
            if h_open is None or not len(held):
                return
            if large:
                yield crowd(h_open, held)
            elif len(held) > 1:
                yield batch_of(list(pairs(np.full(len(held), h_open), held, np.array([len(held)]))))

        for batch in batches:
            h, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(h):
                continue
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
            h, x = h[fresh], x[fresh]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(first, len(h)))
            begin = 0
            if h_open is not None and h[0] == h_open:
                own = x[: size[0]]
                held = np.concatenate([held, own[own != held[-1]] if len(held) else own])
                begin = 1
                if len(held) > bucket or large:
                    large = True
                    if len(first) == 1:  # the bucket goes on: hold no more of it than needed to tell repeats
                        yield crowd(h_open, held[:-1])
                        held = held[-1:]
                if len(first) == 1:
                    continue
            yield from closed()
            if begin < len(first) - 1:
                lo, hi = first[begin], first[-1]
                sizes = size[begin:-1]
                wide = np.repeat(sizes > bucket, sizes)
                if wide.any():
                    yield pa.RecordBatch.from_arrays([pa.array(h[lo:hi][wide]), pa.array(x[lo:hi][wide]), pa.nulls(int(wide.sum()), pa.int64())], names=["h", "a", "b"])
                got = list(pairs(h[lo:hi][~wide], x[lo:hi][~wide], sizes[sizes <= bucket]))
                if got:
                    yield batch_of(got)
            h_open, held = int(h[-1]), x[first[-1] :]
            large = len(held) > bucket
        yield from closed()

    return rows.repartition("h").sortWithinPartitions("h", "hi").mapInArrow(run, "h bigint, a bigint, b bigint")


SLOTS = 4096
#: Up to so many ids (some MB) are broadcast to fetch their records; beyond, the records are shuffled by id.
FEW = 100_000


def too_large(rows: DataFrame, least: int) -> DataFrame | None:
    """h of the buckets that hold more than half of ``least`` and of eight average slots; null if there is none.

    Slots are counted first, a fixed number; only rows of overfull ones are counted by bucket, so at most SLOTS / 4 can result.
    """
    slots = {r[0]: r[1] for r in rows.groupBy(F.pmod("h", F.lit(SLOTS)).alias("s")).count().collect()}
    limit = max(least, 8 * sum(slots.values()) // SLOTS)
    full = [s for s, n in slots.items() if n > limit]
    if not full:
        return None
    counts = rows.where(F.pmod("h", F.lit(SLOTS)).isin(full)).groupBy("h").count()
    return checkpointed(counts.where(F.col("count") > limit // 2).select("h"))


def _block_pairs(rows: DataFrame, sigs: DataFrame, block: int, floor: float) -> DataFrame:
    """Supported pairs of the large buckets. rows: h, hi; sigs: hi, sig.

    Each bucket's classes are dealt over blocks; a cell compares two blocks. A class travels once to each
    block of its bucket, its signature with it; what leaves a cell are pairs whose registers agree enough.
    """
    sizes = rows.groupBy("h").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    dealt = rows.join(sizes, "h").join(sigs, "hi").withColumn("blk", F.pmod(F.xxhash64("hi"), F.col("n_blocks")).cast("int"))
    # block b meets every block: it goes to the cells (min, max) of b and each other block number
    cells = dealt.select("h", "hi", "sig", "blk", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("j")).select(
        "h", "hi", "sig", "blk", F.least("blk", "j").alias("i"), F.greatest("blk", "j").alias("j")
    )

    def run(pdf):
        import pandas as pd

        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        side, node = pdf["blk"].to_numpy(), pdf["hi"].to_numpy()
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        a, c = sig[left], sig[right]
        need = int(np.ceil(floor * sig.shape[1]))
        out_a, out_b = [], []
        for x in range(len(left)):
            # in the cell of a block with itself each pair once
            to = right if i != j else right[node[right] > node[left[x]]]
            if not len(to):
                continue
            agree = (a[x] == (c if i != j else sig[to])).sum(axis=1)
            hit = to[agree >= need]
            out_a.append(np.full(len(hit), node[left[x]]))
            out_b.append(node[hit])
        p = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        q = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)})

    return cells.groupBy("h", "i", "j").applyInPandas(run, "a bigint, b bigint").where("a < b")


def candidate_pairs(classes: DataFrame, threshold: float, bucket: int = 64, block: int = 512, task_rows: int = 4_000_000) -> DataFrame:
    """Distinct pairs (a < b, by hi) of classes that share a bucket. classes: hi, bands, sig; copies may repeat."""
    rows = classes.select(F.explode("bands").alias("h"), "hi")
    hot = too_large(rows, task_rows)
    usual = rows if hot is None else rows.join(F.broadcast(hot), "h", "left_anti")
    found = checkpointed(bucket_rows(usual, bucket))
    out = found.where("b is not null").select("a", "b")
    crowd = found.where("b is null").select("h", F.col("a").alias("hi"))
    if hot is not None:
        crowd = crowd.unionByName(rows.join(F.broadcast(hot), "h", "left_semi").distinct())
    if not crowd.isEmpty():
        floor = max(0.0, threshold - 4.5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5)
        out = out.unionByName(_block_pairs(crowd, classes.select("hi", "sig").dropDuplicates(["hi"]), block, floor))
    return out.distinct()


def shingles_of(records: DataFrame, k: int) -> DataFrame:
    """hi, lo and the sorted distinct 64-bit shingle hashes of every record (columns id, title, text)."""

    def run(batches):
        for batch in batches:
            for part in tv.split_by_size(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()), lambda r: len(r[1])):
                _, words, doc = _layout([content(*r) for r in part])
                hi, lo = content_keys(words, doc, len(part))
                first = np.searchsorted(doc, np.arange(len(part) + 1))
                grams = []
                for i in range(len(part)):
                    at = np.arange(first[i], first[i + 1] - k + 1)
                    grams.append(np.unique(tv.range_hash(words[first[i] : first[i + 1]], at - first[i], at - first[i] + k)).tobytes() if len(at) else b"")
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(grams, pa.binary())], names=["hi", "lo", "grams"])

    return records.mapInArrow(run, "hi bigint, lo bigint, grams binary")


def verified(pairs: DataFrame, classes: DataFrame, records: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs whose distinct k-word shingles are at least ``threshold`` alike, with the likeness. classes: hi, lo, rep."""
    need = checkpointed(pairs.select(F.col("a").alias("hi")).unionByName(pairs.select(F.col("b").alias("hi"))).distinct())
    reps = checkpointed(classes.join(need, "hi", "left_semi").select(F.col("rep").alias("id")).distinct())
    if reps.count() <= FEW:
        reps = F.broadcast(reps)
    grams = shingles_of(records.join(reps, "id", "left_semi"), k).join(need, "hi", "left_semi").dropDuplicates(["hi", "lo"])
    grams = checkpointed(grams)
    side = lambda c: grams.select(F.col("hi").alias(c), F.col("lo").alias(f"{c}lo"), F.col("grams").alias(f"{c}g"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "alo", "b", "blo", "ag", "bg")

    def run(batches):
        for batch in batches:
            keep, alike = [], []
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(p), len(q)) < threshold * max(len(p), len(q)):
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                likeness = common / max(1, len(p) + len(q) - common)
                if likeness >= threshold:
                    keep.append(i)
                    alike.append(likeness)
            if keep:
                cols = [batch.column(c).take(pa.array(keep)) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(alike, pa.float64())], names=["ahi", "alo", "bhi", "blo", "likeness"])

    got = both.mapInArrow(run, "ahi bigint, alo bigint, bhi bigint, blo bigint, likeness double")
    return got.select(F.struct(F.col("ahi").alias("hi"), F.col("alo").alias("lo")).alias("a"), F.struct(F.col("bhi").alias("hi"), F.col("blo").alias("lo")).alias("b"), "likeness")


def near_duplicate_links(
    df: DataFrame, id_col: str = "doc_id", title_col: str = "title", text_col: str = "text", k: int = 5, threshold: float = 0.8, min_chars: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(members: id, node, n_shingles; links: a, b, likeness between content classes).

    Records with null text, null id or under ``min_chars`` characters are left out; null titles are
    empty. Records of equal word sequence share a node. Records without a k-word run link to none.
    Only the named columns are read, so further columns may have any name.
    """
    sigs = checkpointed(signed(df, id_col, title_col, text_col, k, min_chars))
    members = sigs.select("id", F.struct("hi", "lo").alias("node"), "n_shingles").distinct()
    able = sigs.where("n_shingles > 0")
    pairs = checkpointed(candidate_pairs(able.select("hi", "bands", "sig"), threshold))
    classes = able.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    links = verified(pairs, classes, records_of(df, id_col, title_col, text_col, min_chars), k, threshold)
    return members, links


def duplicate_pairs(members: DataFrame, links: DataFrame, part: int = 1000) -> DataFrame:
    """Every pair of different ids alike enough, smaller id first: between linked classes and within one.

    ``duplicate_groups`` says the same without expanding copies; where all pairs are asked for, a class of more
    than ``part`` copies is dealt over as many tasks as it has parts.
    """
    m = members.where("n_shingles > 0").select("id", "node")
    across = (
        links.select("a", "b").join(m.select(F.col("id").alias("x"), F.col("node").alias("a")), "a").join(m.select(F.col("id").alias("y"), F.col("node").alias("b")), "b")
    )
    sizes = m.groupBy("node").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = m.join(sizes, "node")
    left = copies.select(F.col("id").alias("x"), "node", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    right = copies.select(F.col("id").alias("y"), "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    within = left.join(right, ["node", "part"]).where("x < y")
    both = across.select("x", "y").unionByName(within.select("x", "y")).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Least node of each connected component: node, label. Labels spread to neighbours and jump."""
    edges = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    linked = checkpointed(edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(max_rounds):
        near = edges.join(linked.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        hop = linked.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("other", "label")).alias("label"))
        jump = linked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        step = checkpointed(hop.join(jump, "label", "left").select("node", F.least("label", F.coalesce("root", "label")).alias("label"), "old"))
        changed = not step.where("label <> old").isEmpty()
        linked = step.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("node").distinct().join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per id and class: group_id (least id of the group), group_size, n_links of its class."""
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    labels = components(members, links)
    rows = members.join(labels, "node").join(degree, "node", "left")
    head = rows.groupBy("label").agg(F.min("id").alias("group_id"), F.countDistinct("id").alias("group_size"))
    return rows.join(head, "label").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("group_size").alias("group_size"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))


