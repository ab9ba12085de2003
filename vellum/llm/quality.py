"""Per-document text quality statistics, with a hidden Markov model that labels every line.

Each line (long lines in stretches of about 200 characters) is described by vectorised statistics:
shares of words, function words, figures, symbols and garbled tokens, cell separators, list marks,
letter-pair likelihood and repetition. A four-state hidden Markov model (prose, list, table, junk)
decodes the most likely state sequence of each document; label shares weigh lines by their
non-white characters. The letter-pair table, the function words, the emissions and the transitions are
fitted on a bounded number of labelled texts and lines (``max_refs`` texts, ``n_docs`` made documents; see
``linemodel``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .linemodel import LineModel, counted, labelled_documents, softmax_weights

LABELS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
ALPHABET = 512
LINE_LIMIT = 300
PIECE = 200

STATS_SCHEMA = """
    n_chars bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double,
    digit_ratio double, upper_ratio double, end_punct_share double, common_word_share double,
    garbled_share double, repeated_share double, letter_pair_score double,
    prose_share double, list_share double, table_share double, junk_share double, kind string
"""


@dataclass
class QualityModel:
    """Letter-pair log likelihoods (folded code points below 512), sorted function-word hashes, and the line model."""

    pairs: np.ndarray
    common: np.ndarray
    lines: LineModel | None = None


def letter_index(low: np.ndarray, cls: np.ndarray) -> np.ndarray:
    letter = (cls == tv.LOWER) | (cls == tv.UPPER)
    return np.where(letter, np.where(low < ALPHABET, low, ALPHABET - 1), 0).astype(np.int32)


def fit(samples: list[tuple[str, str]], words_per_lang: int = 60, n_docs: int = 1200) -> QualityModel:
    """Model from (language, text) samples; each language has the same weight in the letter pairs.

    The line model is fitted on ``n_docs`` made documents, half of the lines with letter pairs and
    function words of the other half of the samples, so that running text is not known by heart.
    """
    total = np.zeros((ALPHABET, ALPHABET))
    common: set[int] = set()
    for lang in sorted({lang for lang, _ in samples}):
        b = tv.block([text for name, text in samples if name == lang])
        idx = letter_index(b.low, b.cls)
        count = np.zeros((ALPHABET, ALPHABET))
        np.add.at(count, (idx[:-1], idx[1:]), 1.0)
        count[0, 0] = 0
        total += count / max(1.0, count.sum())
        start, end, hashes = tv.words(b)
        h, n = np.unique(hashes[end - start >= 2], return_counts=True)
        common.update(h[np.argsort(-n, kind="stable")[:words_per_lang]].tolist())
    row = total.sum(axis=1, keepdims=True)
    smooth = (total + row * 2e-5 + 1e-7) / (row * (1 + 2e-5 * ALPHABET) + 1e-7 * ALPHABET)
    model = QualityModel(np.log(smooth).astype(np.float32), np.array(sorted(common), np.uint64))
    model.lines = fit_lines(model, labelled_documents(samples, n_docs))
    return model


def fit_lines(model: QualityModel, documents: list[list[tuple[str, int]]]) -> LineModel:
    """Emissions and transitions from documents of (line, label); long lines count in their stretches."""
    x, y, paths = [], [], []
    for part in tv.split_by_size(((d,) for d in documents), lambda r: sum(len(t) for t, _ in r[0])):
        docs = [d for (d,) in part]
        b = tv.block(["\n".join(t for t, _ in d) for d in docs])
        seg = segments(b, model)
        if seg is None:
            continue
        line = tv.prefix(b.cls == tv.NEWLINE)
        at = line[seg.start] - line[b.start[seg.doc]]
        label = np.array([docs[i][k][1] for i, k in zip(seg.doc.tolist(), at.tolist())])
        x.append(features(seg.feats))
        y.append(label)
        paths += [p.tolist() for p in np.split(label, np.flatnonzero(np.diff(seg.doc)) + 1)]
    k = len(LABELS)
    if not y:
        even = np.full(k, -np.log(k))
        return LineModel(np.zeros((features_width(), k)), even, even, np.tile(even, (k, 1)))
    xs, ys = np.concatenate(x), np.concatenate(y)
    count = np.bincount(ys, minlength=k)
    w = softmax_weights(xs, ys, (1.0 / np.maximum(count, 1))[ys], k)
    return LineModel(w, np.full(k, -np.log(k)), *counted(paths, k))


@lru_cache(maxsize=2)
def fitted(samples: tuple[tuple[str, str], ...]):
    """The model of these samples, fitted once a session."""
    return fit(list(samples))


def fit_from_table(refs: DataFrame, max_refs: int = 5000) -> QualityModel:
    """Fit on at most ``max_refs`` labelled samples (columns lang, sample), taken in id order."""
    rows = refs.where("lang is not null and sample is not null").orderBy("ref_id").limit(max_refs).select("lang", "sample").collect()
    return fitted(tuple((r[0], r[1]) for r in rows))


@dataclass
class Segments:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    line_end: np.ndarray  # the segment closes its line
    feats: dict[str, np.ndarray]


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def segments(b: tv.Block, model: QualityModel) -> Segments | None:
    """Lines of all texts of a block with their statistics; None if there is no visible character."""
    t = tv.tokens(b)
    if not len(t.start):
        return None
    nl = b.cls == tv.NEWLINE
    line = tv.prefix(nl)[t.start]
    breaks = np.flatnonzero(nl)
    line_start = np.where(line > 0, breaks[np.maximum(line, 1) - 1] + 1, 0)
    line_len = breaks[np.minimum(line, len(breaks) - 1)] - line_start
    part = np.where(line_len > LINE_LIMIT, (t.start - line_start) // PIECE, 0)
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(line)) - 1
    start, end = t.start[first], t.end[last]
    seg_of_tok = np.cumsum(new) - 1
    n = len(first)
    closes = np.ones(n, bool)
    closes[:-1] = line[first[1:]] != line[first[:-1]]
    opens = np.ones(n, bool)
    opens[1:] = closes[:-1]
    doc = np.searchsorted(b.start, start, side="right") - 1

    letter = (b.cls == tv.LOWER) | (b.cls == tv.UPPER)
    digit = b.cls == tv.DIGIT
    symbol = b.cls == tv.SYMBOL
    punct = b.cls == tv.PUNCT
    white = (b.cls == tv.SPACE) | nl
    pre = {k: tv.prefix(v) for k, v in (("letter", letter), ("digit", digit), ("symbol", symbol), ("punct", punct), ("white", white), ("upper", b.cls == tv.UPPER))}
    count = {k: tv.between(p, start, end) for k, p in pre.items()}
    solid = (end - start) - count["white"]

    def per_seg(mask: np.ndarray) -> np.ndarray:
        return np.bincount(seg_of_tok[mask], minlength=n)

    tok = {k: tv.between(pre[k], t.start, t.end) for k in ("letter", "digit", "symbol", "punct")}
    tok_len = t.end - t.start
    n_tok = per_seg(np.ones(len(tok_len), bool))
    last_ch = b.clip[t.end - 1]
    first_ch = b.clip[t.start]
    numeric = (tok["digit"] > 0) & (tok["letter"] == 0)
    dash = (tok["letter"] == 0) & (tok["digit"] == 0) & (tok_len <= 2) & tv.char_set("-–—.")[first_ch]
    comma = last_ch == ord(",")
    inner = np.zeros(len(b.cps), bool)
    joiner = tv.char_set("'’-‐‑–—.")[b.clip]
    semi_mask = b.cps == ord(";")
    inner[1:-1] = (symbol[1:-1] | (punct[1:-1] & ~joiner[1:-1] & ~semi_mask[1:-1])) & letter[:-2] & letter[2:]
    # a figure that touches a letter
    inner[1:] |= (letter[1:] & digit[:-1]) | (digit[1:] & letter[:-1])
    inner_tok = tv.between(tv.prefix(inner), t.start, t.end)
    dots = tv.between(tv.prefix((b.cps == ord(".")) & np.append(letter[1:], False) & np.concatenate([[False], letter[:-1]])), t.start, t.end)
    wordlike = tok["letter"] > 0
    garbled = wordlike & ((tok["symbol"] > 0) | (inner_tok > 0) | ((dots == 1) & (tok["letter"] > 3)))
    clean = wordlike & ~garbled & (tok["letter"] >= 2)
    lone = (tok_len <= 2) & ~numeric & ~dash & (last_ch != ord("|"))
    colon = last_ch == ord(":")

    w0, w1, w_hash = tv.words(b)
    w_seg = np.searchsorted(start, w0, side="right") - 1
    n_words = np.bincount(w_seg, minlength=n)
    odd = np.concatenate([digit | symbol, [False]])
    apart = ~odd[w0 - 1] & ~odd[w1] & (w1 - w0 >= 2)
    common = np.bincount(w_seg[_member(w_hash, model.common) & apart], minlength=n)

    idx = letter_index(b.low, b.cls)
    any_letter = letter[:-1] | letter[1:]
    score = np.where(any_letter, model.pairs[idx[:-1], idx[1:]], 0.0)
    acc = np.zeros(len(score) + 1)
    np.cumsum(score, out=acc[1:])
    n_pairs = tv.prefix(any_letter)
    lo, hi = np.maximum(start - 1, 0), np.minimum(end, len(score))
    pairs = tv.between(n_pairs, lo, hi)
    pair_score = np.where(pairs > 0, (acc[hi] - acc[lo]) / np.maximum(pairs, 1), -9.0)

    # tokens in a run of six that comes four times or more in its document
    tok_doc = doc[seg_of_tok]
    gram = np.zeros(len(tok_doc), bool)
    if len(tok_doc) > 6:
        key = tv.range_hash(tv.range_hash(b.low, t.start, t.end), np.arange(len(tok_doc) - 5), np.arange(6, len(tok_doc) + 1))
        key = tv.mix(key + tok_doc[:-5].astype(np.uint64) * tv.HASH_BASE)
        order = np.argsort(key, kind="stable")
        first_of = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        cnt = np.diff(np.append(np.flatnonzero(first_of), len(key)))
        often = np.zeros(len(key), bool)
        often[order] = np.repeat(cnt >= 4, cnt)
        figures = tv.between(tv.prefix(numeric | dash), np.arange(len(key)), np.arange(6, len(key) + 6))
        often &= (tok_doc[:-5] == tok_doc[5:]) & (figures < 3)
        cover = np.zeros(len(tok_doc) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(often), 1)
        np.add.at(cover, np.flatnonzero(often) + 6, -1)
        gram = np.cumsum(cover)[:-1] > 0
    repeated = per_seg(gram)

    # runs of two or more blanks, tabs and leader dots inside the line
    gap_s, gap_e = tv.runs(b.cls == tv.SPACE)
    tab = b.cps == ord("\t")
    wide = (gap_e - gap_s >= 2) | tab[gap_s]
    gap_seg = np.searchsorted(start, gap_s, side="right") - 1
    inside = wide & (gap_seg >= 0) & (gap_e < end[np.maximum(gap_seg, 0)])
    gaps = np.bincount(gap_seg[inside], minlength=n)
    dot_s, dot_e = tv.runs(b.cps == ord("."))
    leader = dot_e - dot_s >= 3
    dot_seg = np.searchsorted(start, dot_s[leader], side="right") - 1
    leaders = np.bincount(dot_seg[dot_seg >= 0], minlength=n)
    pipe = tv.between(tv.prefix(b.cps == ord("|")), start, end)
    spaced_pipe = per_seg((tok_len == 1) & (first_ch == ord("|")))
    semis = tv.between(tv.prefix(semi_mask), start, end)
    tight = semi_mask & ~np.append(white[1:], True) & ~np.concatenate([[True], white[:-1]])
    tight_semis = tv.between(tv.prefix(tight), start, end)

    f_tok = first
    f_len = tok_len[f_tok]
    f_ch = first_ch[f_tok]
    f_last = last_ch[f_tok]
    bullet = (f_len == 1) & tv.char_set("-*•–—·+○●■□▪§")[f_ch]
    paren = (f_len <= 6) & (f_last == ord(")")) & ((tok["letter"][f_tok] <= 2) | (tok["digit"][f_tok] > 0)) & (tok["letter"][f_tok] + tok["digit"][f_tok] > 0)
    dotted = (f_len <= 6) & (f_last == ord(".")) & (tok["digit"][f_tok] > 0) & (tok["letter"][f_tok] == 0)
    # an entry mark starts its line and something follows it
    mark = (bullet | paren | dotted) & opens & (n_tok >= 2)
    last_tok = last
    end_num = numeric[last_tok] & closes
    end_year = end_num & (tok["digit"][last_tok] == 4)
    end_ch = last_ch[last_tok]
    stop = tv.char_set(".!?”\"’»)")[end_ch] & closes
    caps_start = b.cls[t.start[f_tok]] == tv.UPPER
    initials = per_seg((tok_len == 2) & (last_ch == ord(".")) & (tok["letter"] == 1)) + per_seg((tok_len == 3) & comma & (tok["letter"] == 1))
    second = np.minimum(first + 1, len(tok_len) - 1)
    entry = (f_last == ord(",")) & caps_start & (second <= last) & (tok["letter"][second] == 1) & (tok_len[second] <= 3) & opens
    n_num = per_seg(numeric)
    n_dash = per_seg(dash)
    n_comma = per_seg(comma)
    n_clean = per_seg(clean)
    n_garbled = per_seg(garbled)
    n_lone = per_seg(lone)
    n_colon = per_seg(colon)
    feats = {
        "solid": solid, "n_tok": n_tok, "n_words": n_words, "common": common, "n_num": n_num, "n_dash": n_dash, "n_comma": n_comma,
        "n_clean": n_clean, "n_garbled": n_garbled, "n_lone": n_lone, "n_colon": n_colon, "pair": pair_score, "repeated": repeated, "gaps": gaps,
        "leaders": leaders, "pipe": pipe, "spaced_pipe": spaced_pipe, "semis": semis, "tight_semis": tight_semis, "mark": mark,
        "end_num": end_num, "end_year": end_year, "stop": stop, "caps_start": caps_start, "entry": entry, "initials": initials, "opens": opens,
        **count,
    }
    return Segments(start, end, doc, closes, feats)


def features(f: dict[str, np.ndarray]) -> np.ndarray:
    """What the line model sees of each line: shares, marks, and four sums of them that each speak for one label."""
    tok, words, solid = (np.maximum(f[k], 1).astype(float) for k in ("n_tok", "n_words", "solid"))
    sums = leanings(f) / 4.0
    cols = [
        np.ones(len(tok)), *np.clip(sums - sums.mean(axis=1, keepdims=True), -2.5, 2.5).T, np.log1p(tok) / 3, np.where(f["n_words"] >= 3, f["common"] / words, 0.15) * 3, f["n_words"] < 3,
        (f["n_num"] + f["n_dash"]) / tok, f["symbol"] / solid, f["n_garbled"] / tok, f["n_lone"] / tok, f["repeated"] / tok, np.minimum(f["gaps"], 4) / 4, np.minimum(f["pipe"], 4) / 4,
        np.minimum(1.0, 4.0 * f["semis"] / words), np.minimum(f["tight_semis"], 3) / 3, f["mark"], f["end_num"], f["end_year"], f["stop"], f["caps_start"], f["entry"], f["leaders"] > 0,
        np.minimum(1.0, 3.0 * f["n_comma"] / tok), np.minimum(1.0, 5.0 * f["n_dash"] / tok), f["n_colon"] > 0, f["upper"] / np.maximum(f["letter"], 1), f["digit"] / solid,
        np.clip(f["pair"] + 3.0, -3.0, 1.0), f["n_tok"] <= 8, f["n_tok"] > 25, f["opens"],
    ]
    return np.stack([np.asarray(c, float) for c in cols], axis=1)


def features_width() -> int:
    return 33


def emissions(f: dict[str, np.ndarray], m: LineModel) -> np.ndarray:
    """Log likelihood ratio of each line under the four labels."""
    z = features(f) @ m.weights
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True)) - m.prior


def leanings(f: dict[str, np.ndarray]) -> np.ndarray:
    """Sums of line statistics that speak for each label."""
    tok = np.maximum(f["n_tok"], 1).astype(float)
    solid = np.maximum(f["solid"], 1).astype(float)
    words = np.maximum(f["n_words"], 1).astype(float)
    fw = np.where(f["n_words"] >= 3, f["common"] / words, 0.12)
    num = f["n_num"] / tok
    cells = (f["n_num"] + f["n_dash"]) / tok
    sym = f["symbol"] / solid
    letters = f["letter"] / solid
    garbled = f["n_garbled"] / tok
    clean = f["n_clean"] / tok
    lone = f["n_lone"] / tok
    rep = f["repeated"] / tok
    fluent = np.clip((f["pair"] + 3.1) * 3.0, -4.0, 2.0)
    short = f["n_tok"] <= 8

    prose = 9.0 * np.clip(fw, 0, 0.30) + fluent + 2.5 * (clean - 0.6) + 0.8 * f["stop"] + 0.7 * ((f["n_tok"] > 8) & (cells < 0.4))
    prose -= 6.0 * np.clip(cells - 0.25, 0, 1) + 1.2 * np.minimum(f["gaps"], 4) * (f["n_tok"] < 30) + 1.0 * np.minimum(f["pipe"], 4) + 3.0 * f["mark"]
    prose -= 6.0 * np.clip(garbled - 0.3, 0, 1) + 8.0 * np.clip(sym - 0.1, 0, 1) + 5.0 * rep + 2.0 * f["leaders"] + 1.5 * np.minimum(f["tight_semis"], 3)

    run_in = (f["semis"] >= 3) & (f["n_words"] <= 4.5 * (f["semis"] + 1)) & (f["tight_semis"] == 0) & (num < 0.15) & (garbled < 0.2)
    index_line = f["end_num"] & (f["n_comma"] >= np.maximum(1, f["n_num"] - 1)) & (f["n_num"] >= 1) & (num > 0.12) & (f["n_tok"] <= 14)
    toc_line = (f["leaders"] >= 1) & f["end_num"] & (f["n_num"] <= 1)
    biblio = f["entry"] & f["end_year"]
    listing = 3.8 * f["mark"] + 4.5 * run_in + 3.8 * index_line + 5.0 * toc_line + 6.5 * biblio + 2.0 * f["entry"]
    listing = listing + 0.8 * (short & ~f["stop"] & (f["n_words"] >= 1)) + 0.5 * fluent - 1.5 * num * ~(index_line | toc_line) - 1.0 * (f["n_tok"] > 30)
    listing -= 8.0 * np.clip(garbled - 0.25, 0, 1) + 7.0 * np.clip(sym - 0.25, 0, 1) + 4.0 * rep * ~f["mark"]

    grid = (f["spaced_pipe"] >= 2) & (lone < 0.42) & ((solid > 2.6 * tok) | (f["digit"] * 3 > f["letter"])) | (f["gaps"] >= 2) & (f["n_tok"] >= 3) & (garbled < 0.25) | (f["tight_semis"] >= 2) & (f["semis"] * 9 >= f["n_tok"]) & (garbled < 0.25) & (sym < 0.08) & ((f["pair"] > -4.3) | (f["digit"] * 2 > f["letter"]))
    strange = (f["n_words"] >= 6) & (fw < 0.07) & ~run_in & ~grid & ~f["mark"]
    figures = f["n_num"] + f["n_dash"]
    inline_cells = (f["semis"] >= 2) & (figures >= f["semis"]) & (f["tight_semis"] == 0) | (f["semis"] >= 1) & (f["n_colon"] == 1) & (figures >= 1) & (f["n_tok"] <= 3 * f["semis"] + 5)
    number_row = (f["n_num"] + f["n_dash"] >= 2) & (cells >= 0.55) & (f["n_comma"] == 0)
    leader_row = (f["leaders"] >= 1) & (f["n_num"] >= 2)
    table = 4.2 * grid + 4.0 * inline_cells + 4.2 * number_row + 3.5 * leader_row + 1.5 * np.clip(cells, 0, 1) - 0.5
    table -= 2.0 * toc_line + 3.0 * index_line + 2.5 * (sym > 0.45) * ~(f["spaced_pipe"] >= 2) + 3.0 * np.clip(garbled - 0.5, 0, 1) * ~grid

    junk = 7.0 * np.clip(sym - 0.12, 0, 0.5) + 7.0 * np.clip(garbled - 0.25, 0, 0.5) - 1.0 * fluent + 6.0 * rep * (f["n_tok"] >= 3)
    junk += 2.0 * (letters < 0.3) * (num < 0.3) - 5.0 * np.clip(fw, 0, 0.25) - 0.5
    junk -= 2.5 * number_row + 3.0 * (f["spaced_pipe"] >= 2) * (sym < 0.6) * (solid > 2.2 * tok)
    prose = prose - 4.5 * strange - 4.0 * f["entry"] - 9.0 * np.clip(lone - 0.55, 0, 0.5) - 6.0 * (rep > 0.6)
    junk = junk + 2.0 * strange + 5.0 * np.clip(lone - 0.55, 0, 0.5)
    listing = listing - 9.0 * np.clip(lone - 0.55, 0, 0.5)
    table = table - 9.0 * np.clip(lone - 0.55, 0, 0.5) - 2.0 * (fluent < -2) * (f["digit"] * 2 < f["letter"]) * ~grid
    out = np.stack([prose, listing, table, junk], axis=1)
    return out * np.clip(0.4 + solid / 60.0, 0.4, 1.5)[:, None]


def viterbi(score: np.ndarray, doc: np.ndarray, n_docs: int, m: LineModel) -> np.ndarray:
    """Most likely label sequence of every document; all documents advance one line at a time."""
    n = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    order = np.argsort(-n, kind="stable")
    longest = int(n.max()) if n_docs else 0
    alive = np.searchsorted(-n[order], -np.arange(1, longest + 1), side="right")
    k = score.shape[1]
    back = np.zeros(score.shape, np.int8)
    best = np.zeros((n_docs, k))
    for step in range(longest):
        rows = first[order[: alive[step]]] + step
        if step == 0:
            best = score[rows] + m.start
            continue
        via = best[: alive[step], :, None] + m.trans[None]
        arg = via.argmax(axis=1)
        back[rows] = arg
        best[: alive[step]] = np.take_along_axis(via, arg[:, None, :], axis=1)[:, 0] + score[rows]
    out = np.zeros(len(score), np.int8)
    state = np.zeros(n_docs, np.int8)
    state[: len(best)] = best.argmax(axis=1)
    for step in range(longest - 1, -1, -1):
        rows = first[order[: alive[step]]] + step
        out[rows] = state[: alive[step]]
        if step:
            state[: alive[step]] = back[rows, state[: alive[step]]]
    return out


def measure(texts: list[str] | tv.Block, model: QualityModel) -> dict[str, np.ndarray]:
    """Statistics and label shares of each text."""
    b = texts if isinstance(texts, tv.Block) else tv.block(texts)
    n = b.n
    zero = np.zeros(n)
    out: dict[str, Any] = {"n_chars": (b.end - b.start), "n_words": zero.astype(np.int64), "n_lines": zero.astype(np.int64)}
    ratios = ("mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "end_punct_share", "common_word_share", "garbled_share", "repeated_share", "letter_pair_score")
    out |= {k: zero.copy() for k in ratios} | {f"{k}_share": zero.copy() for k in LABELS}
    out["kind"] = np.array(["empty"] * n, object)
    seg = segments(b, model)
    if seg is None:
        return out
    f = seg.feats
    label = viterbi(emissions(f, model.lines), seg.doc, n, model.lines)

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(seg.doc, weights=x, minlength=n)

    solid, words, toks = (total(f[k]) for k in ("solid", "n_words", "n_tok"))
    lines = total(seg.line_end)
    some, some_words = np.maximum(solid, 1), np.maximum(words, 1)
    out["n_words"], out["n_lines"] = words.astype(np.int64), lines.astype(np.int64)
    out["mean_word_length"] = total(f["letter"]) / some_words
    for name, key in (("symbol_ratio", "symbol"), ("digit_ratio", "digit"), ("upper_ratio", "upper")):
        out[name] = total(f[key]) / some
    out["end_punct_share"] = total(f["stop"] & seg.line_end) / np.maximum(lines, 1)
    out["common_word_share"] = total(f["common"]) / some_words
    out["garbled_share"] = total(f["n_garbled"]) / np.maximum(toks, 1)
    out["repeated_share"] = total(f["repeated"]) / np.maximum(toks, 1)
    out["letter_pair_score"] = total(f["pair"] * f["solid"]) / some
    shares = np.stack([total(f["solid"] * (label == k)) for k in range(4)], axis=1) / some[:, None]
    for k, name in enumerate(LABELS):
        out[f"{name}_share"] = shares[:, k]
    odd = 1 + shares[:, 1:].argmax(axis=1)
    kind = np.where(shares[:, 0] >= 0.5, 0, odd)
    out["kind"] = np.where(solid > 0, np.array(LABELS, object)[kind], "empty")
    return out


def quality_stats(df: DataFrame, model: QualityModel, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_cols`` plus the statistics of STATS_SCHEMA.

    A null text counts as empty: kind 'empty', every figure 0. Texts of any length are measured whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(*[F.col(f"`{c}`") for c in id_cols], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    names = [x.split()[0] for x in STATS_SCHEMA.replace("\n", " ").split(",")]

    def run(batches):
        for batch in batches:
            ids = [batch.column(i) for i in range(batch.num_columns - 1)]
            texts = batch.column(batch.num_columns - 1).to_pylist()
            at = 0
            for part in tv.split_by_size(((t,) for t in texts), lambda x: len(x[0])):
                m = measure([t for (t,) in part], shared.value)
                cols = [c.slice(at, len(part)) for c in ids] + [pa.array(m[k]) if k != "kind" else pa.array(m[k].tolist(), pa.string()) for k in names]
                at += len(part)
                yield pa.RecordBatch.from_arrays(cols, names=[*id_cols, *names])

    return src.mapInArrow(run, f"{fields}, {STATS_SCHEMA}")


def non_prose(stats: DataFrame, min_chars: int = 100) -> DataFrame:
    """Documents of at least ``min_chars`` characters most of which is list, table or junk."""
    return stats.where(F.col("kind").isin("list", "table", "junk") & (F.col("n_chars") >= min_chars))


def source_summary(stats: DataFrame, source_col: str = "source") -> DataFrame:
    """Per source: documents by kind and mean figures."""
    return stats.groupBy(source_col).agg(
        F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.avg("mean_word_length").alias("mean_word_length"),
        F.avg("symbol_ratio").alias("symbol_ratio"), F.avg("end_punct_share").alias("end_punct_share"), F.avg("common_word_share").alias("common_word_share"),
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in (*LABELS, "empty")],
        *[F.avg(f"{k}_share").alias(f"{k}_share") for k in LABELS],
    )

