"""Language of each document and of each one-language stretch, by error-correcting output codes.

Every language has a codeword; one binary naive Bayes classifier over hashed character n-grams
(one to four characters inside blank-padded words) predicts each bit. Decoding takes the codeword of
least margin-weighted loss; the gap to the next one gives the confidence and marks ambiguity. The
bit scores of a word are computed once and cached, so a document costs one lookup a word. Stretches
come from a Viterbi pass over the words' decoded scores with a penalty for changing language;
stretches under ``min_words`` words count with the text around them (22 by default: three less than the
25 words that a stretch has, for ends misplaced by a word or two).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .quality import QualityModel, measure

BUCKETS = 1 << 15
MAX_N = 4
#: Label spellings that name a language, besides the two-letter code.
LABELS = {
    "en": ("en", "eng", "english"), "fr": ("fr", "fre", "fra", "french"), "de": ("de", "ger", "deu", "german"), "la": ("la", "lat", "latin"),
    "it": ("it", "ita", "italian"), "es": ("es", "spa", "spanish"), "nl": ("nl", "dut", "nld", "dutch"),
}
#: Log score lost at a change of language, and the most that one word can say against a language.
SWITCH, WORD_CLIP = -14.0, -3.5
CACHE_WORDS = 400_000


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    cache_hash: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    cache_score: np.ndarray | None = None


def codewords(n: int, bits: int = 15, tries: int = 400, seed: int = 7) -> np.ndarray:
    """n codewords whose least pairwise Hamming distance is the largest among ``tries`` random draws;
    no bit is the same, or the complement of another, for all languages."""
    rng = np.random.default_rng(seed)
    columns = np.arange(1, 1 << (n - 1)) if n <= 12 else None
    best, best_d = None, -1
    for _ in range(tries):
        if columns is not None:
            take = rng.choice(columns, min(bits, len(columns)), replace=False)
            m = np.array([[(c >> i) & 1 for c in take] for i in range(n)]) * 2 - 1
        else:
            m = rng.integers(0, 2, (n, bits)) * 2 - 1
        d = min((int((m[i] != m[j]).sum()) for i in range(n) for j in range(i)), default=0)
        if d > best_d:
            best, best_d = m, d
    return best.astype(np.float32)


def gram_buckets(low: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of the words low[w0:w1], blank-padded."""
    lens = w1 - w0
    off = np.concatenate([[0], np.cumsum(lens + 2)]).astype(np.int64)
    flat = np.full(int(off[-1]), 32, np.uint32)
    inner = np.ones(len(flat), bool)
    inner[off[:-1]] = False
    inner[off[1:] - 1] = False
    src = np.repeat(w0 - np.concatenate([[0], np.cumsum(lens)])[:-1], lens) + np.arange(int(lens.sum()))
    flat[inner] = low[src]
    word = np.repeat(np.arange(len(lens)), lens + 2)
    end = off[1:][word]
    at = np.arange(len(flat))
    words, buckets = [], []
    for n in range(1, MAX_N + 1):
        ok = at + n <= end
        if n == 1:
            ok &= inner
        s = at[ok]
        words.append(word[ok])
        buckets.append((tv.range_hash(flat, s, s + n) >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(words), np.concatenate(buckets)


def fit(samples: list[tuple[str, str]], bits: int = 15, alpha: float = 2e-5) -> LanguageModel:
    """Binary n-gram classifiers for the bits of each language's codeword, from (language, text)."""
    langs = sorted({lang for lang, _ in samples})
    code = codewords(len(langs), bits)
    freq = np.zeros((len(langs), BUCKETS))
    for k, lang in enumerate(langs):
        b = tv.block([t for name, t in samples if name == lang])
        w0, w1 = tv.words(b)[:2]
        _, g = gram_buckets(b.low, w0, w1)
        freq[k] = np.bincount(g, minlength=BUCKETS)
        freq[k] /= max(1.0, freq[k].sum())
    w = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for j in range(code.shape[1]):
        on = code[:, j] > 0
        w[:, j] = np.log((freq[on].mean(axis=0) + alpha) / (freq[~on].mean(axis=0) + alpha))
    return LanguageModel(langs, code, w)


@lru_cache(maxsize=2)
def fitted(samples: tuple[tuple[str, str], ...]):
    """The model of these samples, fitted once a session."""
    return fit(list(samples))


def fit_from_table(refs: DataFrame, max_refs: int = 5000) -> LanguageModel:
    """Fit on at most ``max_refs`` labelled samples (columns lang, sample), taken in id order."""
    rows = refs.where("lang is not null and sample is not null").orderBy("ref_id").limit(max_refs).select("lang", "sample").collect()
    return fitted(tuple((r[0], r[1]) for r in rows))


def word_scores(model: LanguageModel, b: tv.Block) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words x languages decoded scores, index of each word); cached words are not scored again."""
    w0, w1, h = tv.words(b)
    uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
    if model.cache_score is None or len(model.cache_hash) > CACHE_WORDS:
        model.cache_hash, model.cache_score = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)), np.float32)
    pos = np.searchsorted(model.cache_hash, uniq)
    known = np.zeros(len(uniq), bool)
    inside = pos < len(model.cache_hash)
    known[inside] = model.cache_hash[pos[inside]] == uniq[inside]
    out = np.zeros((len(uniq), len(model.langs)), np.float32)
    out[known] = model.cache_score[pos[known]]
    new = np.flatnonzero(~known)
    if len(new):
        word, g = gram_buckets(b.low, w0[at[new]], w1[at[new]])
        order = np.argsort(word, kind="stable")
        start = np.searchsorted(word[order], np.arange(len(new)))
        score = decode(model, np.add.reduceat(model.weights[g[order]], start, axis=0))
        out[new] = np.maximum(score - score.max(axis=1, keepdims=True), WORD_CLIP)
        all_h = np.concatenate([model.cache_hash, uniq[new]])
        order = np.argsort(all_h, kind="stable")
        model.cache_hash = all_h[order]
        model.cache_score = np.concatenate([model.cache_score, out[new]])[order]
    return out, inv


def decode(model: LanguageModel, bits: np.ndarray) -> np.ndarray:
    """Minus the margin-weighted loss of each codeword: rows x languages, the larger the nearer."""
    return bits @ model.code.T / model.code.shape[1]


def _viterbi(score: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Best language path of each document (n words each, rows in order)."""
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    order = np.argsort(-n, kind="stable")
    longest = int(n.max())
    alive = np.searchsorted(-n[order], -np.arange(1, longest + 1), side="right")
    move = np.zeros(score.shape, bool)
    top = np.zeros(len(score), np.int8)
    best = score[first[order]].copy()
    for step in range(1, longest):
        k = alive[step]
        rows = first[order[:k]] + step
        cur = best[:k]
        arg = cur.argmax(axis=1)
        jump = cur[np.arange(k), arg] + SWITCH
        better = jump[:, None] > cur
        move[rows] = better
        top[rows] = arg
        best[:k] = np.where(better, jump[:, None], cur) + score[rows]
    out = np.zeros(len(score), np.int8)
    state = best.argmax(axis=1).astype(np.int8)
    for step in range(longest - 1, -1, -1):
        k = alive[step]
        rows = first[order[:k]] + step
        out[rows] = state[:k]
        jumped = move[rows, state[:k]]
        state[:k] = np.where(jumped, top[rows], state[:k])
    return out


def _stretches(path: np.ndarray, tok: np.ndarray, min_words: int) -> list[list[int]]:
    """[language, first, past last] runs; runs under ``min_words`` tokens join a neighbour, shortest first."""

    def size(x: list[int]) -> int:
        return int(tok[x[2] - 1] - tok[x[1]]) + 1

    edge = np.flatnonzero(np.diff(path)) + 1
    at = [0, *edge.tolist(), len(path)]
    out = [[int(path[a]), a, z] for a, z in zip(at, at[1:])]
    while len(out) > 1:
        k = min(range(len(out)), key=lambda i: (size(out[i]), i))
        if size(out[k]) >= min_words:
            break
        near = [i for i in (k - 1, k + 1) if 0 <= i < len(out)]
        to = max(near, key=lambda i: (size(out[i]), -i))
        out[to] = [out[to][0], min(out[to][1], out[k][1]), max(out[to][2], out[k][2])]
        del out[k]
        k = 0
        while k + 1 < len(out):
            if out[k][0] == out[k + 1][0]:
                out[k][2] = out[k + 1][2]
                del out[k + 1]
            else:
                k += 1
    return out


def segment(texts: list[str] | tv.Block, model: LanguageModel, min_words: int = 22) -> list[list[tuple[int, str, float, int, int, bool]]]:
    """Per text its stretches (seg_no, lang, confidence, first char, past last char, ambiguous).

    A text in one language has one stretch with seg_no 0; one without a letter has none.
    """
    b = texts if isinstance(texts, tv.Block) else tv.block(texts)
    out: list[list] = [[] for _ in range(b.n)]
    w0, w1, _ = tv.words(b)
    if not len(w0):
        return out
    t = tv.tokens(b)
    tok = np.searchsorted(t.start, w0, side="right") - 1
    per_word, inv = word_scores(model, b)
    score = per_word[inv]
    doc = np.searchsorted(b.start, w0, side="right") - 1
    n = np.bincount(doc, minlength=b.n)
    some = np.flatnonzero(n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    acc = np.zeros((len(score) + 1, score.shape[1]))
    np.cumsum(score, axis=0, out=acc[1:])
    total = acc[first[some] + n[some]] - acc[first[some]]
    top = np.zeros(b.n, np.int64)
    top[some] = total.argmax(axis=1)

    # windows as long as the shortest stretch: a text none of whose windows leans elsewhere is in one language
    step = max(2, min_words)
    lo = np.arange(0, len(score), max(1, step // 4))
    hi = np.minimum(lo + step, len(score))
    win = acc[hi] - acc[lo]
    wdoc = doc[lo]
    stray = (win.argmax(axis=1) != top[wdoc]) & (doc[hi - 1] == wdoc) & (win.max(axis=1) - win[np.arange(len(lo)), top[wdoc]] > 4)
    mixed = np.zeros(b.n, bool)
    mixed[wdoc[stray]] = True
    mixed &= n >= min_words

    paths: dict[int, np.ndarray] = {}
    pick = np.flatnonzero(mixed)
    if len(pick):
        rows = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in pick])
        path = _viterbi(score[rows], n[pick])
        at = np.concatenate([[0], np.cumsum(n[pick])])
        paths = {int(i): path[at[k] : at[k + 1]] for k, i in enumerate(pick)}

    def row(i: int, seg: int, lang: int, a: int, z: int) -> tuple:
        part = acc[first[i] + z] - acc[first[i] + a]
        mean = part / np.sqrt(max(1, z - a))
        p = np.exp(mean - mean.max())
        p /= p.sum()
        rank = np.sort(part)[::-1]
        gap = (rank[0] - rank[1]) / max(1, z - a) if len(rank) > 1 else 9.0
        begin = int(t.start[tok[first[i] + a]] - b.start[i])
        end = int(t.end[tok[first[i] + z - 1]] - b.start[i])
        return seg, model.langs[lang], float(p[lang]), begin, end, bool(gap < 0.15)

    root = np.sqrt(n[some])[:, None]
    mean = total / root
    p_all = np.exp(mean - mean.max(axis=1, keepdims=True))
    sure = p_all.max(axis=1) / p_all.sum(axis=1)
    close = np.zeros(len(some), bool)
    if total.shape[1] > 1:
        two = np.partition(total, -2, axis=1)[:, -2:]
        close = (two[:, 1] - two[:, 0]) / n[some] < 0.15
    begin = (t.start[tok[first[some]]] - b.start[some]).tolist()
    end = (t.end[tok[first[some] + n[some] - 1]] - b.start[some]).tolist()
    for k, i in enumerate(some.tolist()):
        runs_ = _stretches(paths[i], tok[first[i] : first[i] + n[i]], min_words) if i in paths else []
        if len(runs_) > 1:
            out[i] = [row(i, j + 1, lang, a, z) for j, (lang, a, z) in enumerate(runs_)]
        elif runs_ and runs_[0][0] != top[i]:
            out[i] = [row(i, 0, runs_[0][0], 0, int(n[i]))]
        else:
            out[i] = [(0, model.langs[int(top[i])], float(sure[k]), begin[k], end[k], bool(close[k]))]
    return out


def label_map() -> dict[str, str]:
    return {name: code for code, names in LABELS.items() for name in names}


SEGMENT_SCHEMA = "seg_no int, seg_lang string, confidence double, start_char bigint, end_char bigint, ambiguous boolean, label_lang string, kind string, n_chars bigint"


def language_segments(
    df: DataFrame, model: LanguageModel, quality: QualityModel, id_cols: list[str], text_col: str = "text", label_col: str = "lang", min_words: int = 22
) -> DataFrame:
    """One row per document (seg_no 0) or per stretch of a mixed document (seg_no from 1).

    ``label_lang`` is the language that ``label_col`` names, null if it names none; ``kind`` is the
    quality operator's. Null texts and texts without letters have no row.
    """
    sc = df.sparkSession.sparkContext
    shared, shared_q = sc.broadcast(model), sc.broadcast(quality)
    src = df.select(*[F.col(f"`{c}`") for c in id_cols], F.col(f"`{label_col}`").cast("string").alias("__label"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-2])
    names = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
    spellings = label_map()

    def run(batches):
        m = shared.value
        for batch in batches:
            ids = [batch.column(i) for i in range(batch.num_columns - 2)]
            labels = [spellings.get((x or "").strip().lower()) for x in batch.column(batch.num_columns - 2).to_pylist()]
            texts = batch.column(batch.num_columns - 1).to_pylist()
            at = 0
            for part in tv.split_by_size(((x,) for x in texts), lambda x: len(x[0])):
                chunk = [x for (x,) in part]
                b = tv.block(chunk)
                kinds = measure(b, shared_q.value)["kind"]
                found = segment(b, m, min_words)
                take, rows = [], []
                for i, segs in enumerate(found):
                    for s in segs:
                        take.append(at + i)
                        rows.append((*s, labels[at + i], kinds[i], len(chunk[i])))
                at += len(part)
                if rows:
                    types = [pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64()]
                    cols = [c.take(pa.array(take, pa.int64())) for c in ids] + [pa.array(v, ty) for v, ty in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(cols, names=[*id_cols, *names])

    return src.mapInArrow(run, f"{fields}, {SEGMENT_SCHEMA}")


def wrong_labels(segments: DataFrame, id_col: str = "doc_id", min_chars: int = 100) -> DataFrame:
    """Running texts whose label is missing or wrong (seg_no 0), and every stretch of mixed ones."""
    prose = segments.where((F.col("kind") == "prose") & (F.col("n_chars") >= min_chars))
    return prose.where((F.col("seg_no") > 0) | F.col("label_lang").isNull() | (F.col("label_lang") != F.col("seg_lang"))).select(
        id_col, "seg_no", F.col("seg_lang").alias("lang")
    )
