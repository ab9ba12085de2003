"""Queries that SQL cannot say, against plain Python over the same small tables."""

import itertools
import os
import re
import statistics
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellum.operators import training
from vellum.plans.catalog import oracle_sql, queries
from vellum.plans.cleaning import NOTICES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
needs_ranks = pytest.mark.skipif(not os.path.exists(training.RANKS), reason="no vocabulary file here")
Q = queries()


def read(spark, name):
    return [r.asDict(recursive=True) for r in spark.read.parquet(f"{DIR}/{name}.parquet").collect()]


def got(spark, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in Q[name](spark, DIR).collect()), key=repr)


def md5(x):
    import hashlib

    return hashlib.md5(x.encode()).hexdigest()


def planted(docs):
    return {d["doc_id"]: f"{d['text'] or ''}\n{NOTICES[d['doc_id'] % len(NOTICES)]}\n{d['title'] or ''}" for d in docs}


def answers(spark):
    for r in read(spark, "instruct_pairs"):
        for i, m in enumerate(r["messages"] or []):
            yield r, i, m


def test_every_query_has_rows(spark):
    """Beyond SQL, each gives rows and names them once."""
    for name in sorted(set(Q) - set(oracle_sql())):
        df = Q[name](spark, DIR)
        assert len(set(df.columns)) == len(df.columns) and df.limit(1).count() == 1, name


def test_unicode(spark):
    def plain(x):
        x = unicodedata.normalize("NFKC", x)
        for a, b in (("æ", "ae"), ("œ", "oe"), ("—", "--"), ("–", "-"), ("­", ""), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"')):
            x = x.replace(a, b)
        return x

    want = sorted(((i, md5(plain(t))) for i, t in planted(read(spark, "documents")).items()), key=repr)
    assert got(spark, "c06_unicode", "doc_id", "text_md5") == want


def test_front_matter(spark):
    heads = r"^(?:CHAPTER\s+[IVX\d]+|BOOK\s+[IVX\d]+|PART\s+[IVX\d]+|INTRODUCTION[^\S\n]*$|PREFACE\s*\.?\s*$|CONTENTS\s*$|T\s*H\s*E\s*$|THE\s+PREFACE|TO\s+THE\s+READER|ADVERTISEMENT\s*$|DEDICATION\s*$|PROLOGUE\s*$)"

    def cut(t):
        m = re.search(heads, t[:15000], re.IGNORECASE | re.MULTILINE)
        return t[m.start() :] if m and 200 < m.start() < 15000 else t

    want = sorted(((i, md5(cut(t))) for i, t in planted(read(spark, "documents")).items()), key=repr)
    assert got(spark, "c12_front_matter", "doc_id", "text_md5") == want


def test_casual_prompts_only_shorten_and_lower(spark):
    texts = {(r["conv_id"], i): m["content"] for r, i, m in answers(spark) if m["role"] == "user"}
    rows = got(spark, "c28_casual_prompts", "conv_id", "turn", "prompt")
    squeezed = lambda x: re.sub(r"[^a-z0-9]", "", x.lower())
    low = sum(p is not None and p == p.lower() for _, _, p in rows)
    assert all((p is None) == (texts[c, i] is None) and (p is None or squeezed(texts[c, i])[:1] == squeezed(p)[:1]) for c, i, p in rows) and 0.5 < low / len(rows) <= 1
    hurt = [(texts[c, i], p) for c, i, p in rows if p is not None and squeezed(p)[:60] not in squeezed(texts[c, i])]
    assert 0.03 < len(hurt) / len(rows) < 0.35
    for x, p in hurt:
        words = x.lower().split()
        assert all(abs(len(a) - len(b)) <= 4 for a, b in zip(p.lower().split(), words) if len(p.split()) == len(words))


def test_near_prompts(spark):
    from difflib import SequenceMatcher

    asked = {}
    for r in read(spark, "instruct_pairs"):
        ask = next((m["content"] for m in r["messages"] or [] if m["role"] == "user"), None)
        if ask is not None:
            asked[r["conv_id"], ask] = None
    keys = sorted(asked)
    want = sorted({(c,) for c, x in keys if not any(e < c and SequenceMatcher(None, x, y).ratio() > 0.5 for e, y in keys)}, key=repr)
    assert got(spark, "u06_near_prompts", "conv_id") == want


def test_message_parts_join_to_the_message(spark):
    parts = defaultdict(list)
    for c, t, p, x in got(spark, "x05_message_parts", "conv_id", "turn", "part", "text"):
        parts[c, t].append((p, x))
    squeezed = lambda x: re.sub(r"\s", "", x)
    want = defaultdict(set)
    for r, i, m in answers(spark):
        if m["role"] == "assistant" and (m["content"] or "").strip():
            want[r["conv_id"], i].add(squeezed(m["content"]))
    assert set(parts) == set(want)
    for k, v in parts.items():
        # a conversation delivered again gives its parts again
        runs = Counter(p for p, _ in v)
        assert all(len(x) <= 200 for _, x in v) and len(set(runs.values())) == 1
        assert squeezed("".join(x for _, x in sorted(set(v)))) in want[k]


def test_conversation_parts_join_to_the_answer(spark):
    want = {}
    for r in read(spark, "instruct_pairs"):
        ms = r["messages"] or []
        if len(ms) >= 2 and (ms[1]["content"] or "").strip():
            want.setdefault(r["conv_id"], set()).add((re.sub(r"\s", "", ms[1]["content"]), len(ms[0]["content"]) if ms[0]["content"] is not None else None))
    parts = defaultdict(set)
    for c, p, x, n in got(spark, "x06_conversation_parts", "conv_id", "part", "content", "n_prefix"):
        parts[c].add((p, x, n))
    assert set(parts) == set(want)
    for c, v in parts.items():
        assert all(len(x) <= 250 for _, x, _ in v) and (re.sub(r"\s", "", "".join(x for _, x, _ in sorted(v, key=lambda y: y[0]))), next(iter(v))[2]) in want[c]


def test_windows_and_excerpts(spark):
    books = {b["book_filename"]: b["text"] for b in read(spark, "physics_books")}
    sizes = defaultdict(list)
    for f, _, n in got(spark, "x04_overlapping_windows", "book_filename", "chunk_idx", "n_chars"):
        sizes[f].append(n)
    longest = {f: max(map(len, t.split("\n\n")), default=0) for f, t in books.items() if t}
    assert set(sizes) == {f for f, t in books.items() if t and t.strip()} and all(max(v) <= 6000 + longest[f] for f, v in sizes.items())
    assert all(sum(v) >= len("".join(books[f].split())) for f, v in sizes.items())
    packed = defaultdict(int)
    for f, _, n, _ in got(spark, "x03_packed_paragraphs", "book_filename", "chunk_idx", "n_chars", "chunk_md5"):
        assert n <= 4000
        packed[f] += n
    assert all(packed[f] >= len("".join(t.split())) for f, t in books.items() if t)
    assert all((n is None) == (books[f] is None) and (n is None or n <= max(4000, 0) and n >= min(2000, len(books[f]))) for f, n in got(spark, "x07_excerpts", "book_filename", "n_chars"))


def test_packed_rows_hold_every_token(spark):
    sizes = {d["doc_id"]: d["n_chars"] for d in read(spark, "documents") if (d["n_chars"] or 0) > 0}
    for name in ("t05_cropped_rows", "t06_padded_rows"):
        held, rows = Counter(), defaultdict(int)
        for part, row, off, key, n in got(spark, name, "part", "row", "row_offset", "doc_id", "n"):
            held[key] += n
            rows[part, row] += n
            assert off + n <= 2049
        assert held == Counter(sizes)
    # rows of the padded form hold whole items, or pieces of one above the capacity
    assert max(rows.values()) <= 2049


@needs_ranks
def test_tokens_rendered_and_cut(spark):
    enc = training._encoder(training.RANKS, training.PATTERN)
    base = enc.max_token_value + 1
    want, long = [], []
    for r in read(spark, "instruct_pairs"):
        turns = [(m["role"], m["content"] or "") for m in r["messages"] or []]
        if len(turns) > 1 and turns[0][0] == "system" and turns[1][0] == "user":
            turns[:2] = [("user", f"{turns[0][1]}\n\n{turns[1][1]}")]
        body = [(role == "assistant", len(enc.encode_ordinary(t))) for role, t in turns]
        n = 1 + sum(k + 2 for _, k in body)
        mask = [0, *itertools.chain.from_iterable([0, *[int(own)] * k, int(own)] for own, k in body)]
        want.append((r["conv_id"], min(n, 2048), sum(mask[:2048])))
        long += [(r["conv_id"], i, i > 0, min(512, min(512, n - 512 * i) + (i > 0))) for i in range(max(1, -(-n // 512)))]
    assert got(spark, "t03_rendered", "conv_id", "n_ids", "n_supervised") == sorted(want, key=repr)
    assert got(spark, "t07_long_chunks", "conv_id", "chunk_no", "own_row", "n_ids") == sorted(long, key=repr)
    count = Counter(len(enc.decode_single_token_bytes(i).decode("utf-8", "replace").encode()) for i in range(base) if i in enc._mergeable_ranks.values())
    count[0] += len(training.SPECIAL)
    assert got(spark, "t04_token_bytes", "n_bytes", "n_tokens") == sorted(count.items(), key=repr)
    size = defaultdict(lambda: [0, 0])
    for d in read(spark, "documents"):
        if d["text"] is not None:
            size[d["source"]][0] += len(d["text"].encode())
            size[d["source"]][1] += len(enc.encode_ordinary(d["text"]))
    assert got(spark, "a20_token_compression", "source", "n_bytes", "n_tokens") == sorted(((s, a, b) for s, (a, b) in size.items()), key=repr)


def test_two_components(spark):
    e = [r for r in read(spark, "embeddings") if r["embedding"] is not None]
    x = np.array([r["embedding"] for r in e], float)
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = x @ v[:2].T
    rows = {r[0]: r[1:] for r in got(spark, "a25_two_components", "vec_id", "x", "y")}
    have = np.array([rows[r["vec_id"]] for r in e])
    for k in (0, 1):  # up to the sign of a component
        assert min(abs(have[:, k] - want[:, k]).max(), abs(have[:, k] + want[:, k]).max()) < 0.01


def test_document_gate_counts_every_row(spark):
    raw = read(spark, "raw_documents")
    rows = got(spark, "f01_document_gate", "source", "reason", "n")
    assert sum(n for _, _, n in rows) == len(raw)
    short = Counter(r["source"] for r in raw if r["text"] is None or len(r["text"]) < 500)
    assert {s: n for s, reason, n in rows if reason == "too_short"} == dict(short)


def test_quotes(spark):
    ids = [d["doc_id"] for d in read(spark, "documents")]
    own = Counter(r[0] for r in got(spark, "g01_quotes", "doc_id", "pos") if r[1] < 200)
    assert [own[i] for i in sorted(ids)] == [(2, 2, 2, 0)[i % 4] for i in sorted(ids)]
    s = got(spark, "g03_quote_sessions", "doc_id", "session", "n_quotes", "first_pos")
    assert {r[0] for r in s if r[3] == 0} == {i for i in ids if i % 4 != 3}
    turns = got(spark, "g05_dialogue_turns", "doc_id", "session", "turn", "role", "text")
    assert statistics.mean(len(r[4]) for r in turns) > 10 and {r[0] for r in turns} == {r[0] for r in s}


def test_answers_equal_to_gold(spark):
    rows = got(spark, "r01_equivalence", "conv_id", "i", "answer", "equal")
    for c, _, a, equal in rows:
        if re.fullmatch(r"-?\d+(?:\.\d+)?", a):
            assert equal == (abs(float(a) - c % 400) <= 1e-6 * max(1, abs(float(a)), c % 400))
