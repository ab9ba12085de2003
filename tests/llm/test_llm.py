"""Training-data operators: brute force, round trips, held-out accuracy and awkward input."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("vellum.llm")
from vellum.llm import chunking, instruct, language, linemodel, mixing, neardup, packing, quality, scan, tokens  # noqa: E402
from vellum.llm import textvec as tv  # noqa: E402

DIR = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
#: Columns whose names the operators use inside, with odd values.
CLASH = {"node": "x", "id": "y", "block": "z", "band": "b", "h": "h", "title_": "t", "n_tokens": "q", "kind": "k", "rank": "r", "size": "s"}


def clash(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k not in df.columns})


@pytest.fixture(scope="module")
def refs(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{DIR}/lang_refs.parquet").orderBy("ref_id").select("lang", "sample").collect()]
    return rows


@pytest.fixture(scope="module")
def models(refs):
    return quality.fit(refs), language.fit(refs)


# 1 near duplicates


def brute(rows, k, floor):
    sets = {}
    for i, t, x in rows:
        if x is not None and i is not None:
            sets[i] = neardup.shingle_set(neardup.WORD.findall(neardup.content(t, x)), k)
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= floor}


def found(spark, rows, k=3, floor=0.5, **kw):
    df = clash(spark.createDataFrame(rows, "doc_id string, title string, text string"))
    members, links = neardup.near_duplicate_links(df, k=k, threshold=floor, **kw)
    return members, links, {tuple(r) for r in neardup.duplicate_pairs(members, links).collect()}


def edited(words, rnd, rate):
    return [rnd.choice("alpha beta gamma delta".split()) + str(rnd.random())[:4] if rnd.random() < rate else w for w in words]


def test_pairs_match_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
        for v in range(4):
            rows.append((f"d{g:02}{v}", None if v == 1 else f"T{g}", " ".join(edited(base, rnd, 0.05 * v))))
    rows += [("copy1", "T", rows[0][2]), ("copy2", "t", rows[0][2].upper()), ("none", "x", None), ("empty", None, ""), ("two", None, "a b"), (rows[0][0], rows[0][1], rows[0][2])]
    _, _, got = found(spark, rows)
    assert got == brute(rows, 3, 0.5)


def test_large_bucket_loses_no_pair(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(f"d{i:03}", None, " ".join(base[:30] + [f"x{i}"] + base[30:])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id string, title string, text string")
    sigs = neardup.signed(df, "doc_id", "title", "text", 3, 0)
    classes = sigs.select("hi", "bands", "sig")
    few, many, hot = (neardup.candidate_pairs(classes, 0.5, bucket=b, block=16, task_rows=t) for b, t in ((4, 10**6), (1000, 10**6), (4, 20)))
    want = {tuple(r) for r in many.collect()}
    assert len(want) == 90 * 89 // 2 and {tuple(r) for r in few.collect()} == want and {tuple(r) for r in hot.collect()} == want


def test_buckets_over_batches(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 7, 7]) if rnd.random() < 0.9 else rnd.randint(8, 60), rnd.randint(0, 300)) for _ in range(900)]
    by: dict = {}
    for h, x in rows:
        by.setdefault(h, set()).add(x)
    df = spark.createDataFrame(rows, "h bigint, hi bigint")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "100", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = neardup.bucket_rows(df, 70).collect()
            assert len(got) == len(set(got))
            assert {tuple(r) for r in got if r["b"] is not None} == {(h, a, b) for h, v in by.items() if len(v) <= 70 for a, b in itertools.combinations(sorted(v), 2)}
            assert {(r["h"], r["a"]) for r in got if r["b"] is None} == {(h, a) for h, v in by.items() if len(v) > 70 for a in v}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_many_copies_make_all_pairs(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(f"d{i:02}", None, text) for i in range(30)], "doc_id string, title string, text string")
    members, links = neardup.near_duplicate_links(df, k=3, threshold=0.5)
    assert neardup.duplicate_pairs(members, links, part=7).count() == 30 * 29 // 2
    assert {(r["group_id"], r["group_size"], r["n_links"]) for r in neardup.duplicate_groups(members, links).collect()} == {("d00", 30, 0)}


def test_repetitive_pairs_match_brute_force(spark):
    rows = []
    for g in range(40):
        for side in "ab":
            own = [f"{side}{g}x{i}" for i in range(82)]
            rows.append((f"d{g:02}{side}", None, " ".join([f"c{g}x{i}" for i in range(200)] + own * 3)))
    _, _, got = found(spark, rows)
    assert len(got) == 40 and got == brute(rows, 3, 0.5)


def test_groups_and_empty_table(spark):
    chain = [f"c{i}" for i in range(100)]
    rows = [(f"d{i}", None, " ".join(chain[i * 10 : i * 10 + 50])) for i in range(5)] + [("far", None, " ".join(f"z{i}" for i in range(50)))]
    members, links, pairs = found(spark, rows)
    groups = {r["id"]: r["group_id"] for r in neardup.duplicate_groups(members, links).collect()}
    assert {groups[f"d{i}"] for i in range(5)} == {"d0"} and groups["far"] == "far" and ("d0", "d4") not in pairs
    members, links, pairs = found(spark, [])
    assert not pairs and neardup.duplicate_groups(members, links).count() == 0


def test_signature_estimates_likeness():
    rnd = np.random.default_rng(1)
    a = rnd.integers(1, 1 << 60, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rnd.integers(1, 1 << 60, 100).astype(np.uint64)])
    doc = np.repeat([0, 1], 300)
    sig = neardup.prob_minhash(np.concatenate([a, b]), np.ones(600), doc, 2)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.12


# 2 tokens


def test_counts_equal_direct_tokenizing(spark):
    texts = ["It's the dog's 12 bones, they'll say.", "  two\n\n lines\t ", "çà ½ 😀😀 naïve—x", "", None, "a" * 5000, "don't DON'T 'tis ''s", "same", "same"]
    df = clash(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    got = {r["doc_id"]: (r["n_tokens"], r["n_pieces"]) for r in tokens.token_counts(df, ["doc_id"]).collect()}
    enc = tokens.encoding(tokens.RANKS)
    assert got == {i: (len(enc.encode_ordinary(t or "")), len(tokens.pieces(t or ""))) for i, t in enumerate(texts)}
    assert tokens.token_counts(df.where("false"), ["doc_id"]).count() == 0


def test_pieces_join_and_match_pattern():
    import regex

    pattern = regex.compile(tokens.PATTERN)
    rnd = random.Random(2)
    for _ in range(3000):
        t = "".join(rnd.choice("ab'sStTrRevVmlLd  \n\t.,é²½9—😀_(’") for _ in range(rnd.randint(0, 20)))
        assert tokens.pieces(t) == pattern.findall(t) and "".join(tokens.pieces(t)) == t


def test_totals_add_up(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", None, 2), (None, "x", 0)], "source string, lang string, n_tokens bigint")
    rows = {(r["level"], r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in tokens.token_totals(df, ["source", "lang"]).collect()}
    assert rows["all", None, None] == (3, 5) and rows["source", "a", None] == (2, 5) and rows["source+lang", "a", None] == (1, 2) and rows["lang", None, "x"] == (2, 3)


# 3 chunks


def rebuilt(rows):
    return "".join(r["text"][r["new_from"] - r["start_char"] :] for r in sorted(rows, key=lambda r: r["piece_no"]))


def test_chunks_round_trip(spark):
    rnd = random.Random(3)
    prose = " ".join("".join(rnd.choice("abcdefg ") for _ in range(rnd.randint(20, 120))).strip() + rnd.choice([".", "!”", "?)", ".\r\n\r\n"]) for _ in range(400))
    texts = {"prose": prose, "hard": "x" * 2500, "words": "word " * 700, "short": "a", "blank": "\n \n" * 800, "odd": "😀. " * 900}
    df = clash(spark.createDataFrame([*texts.items(), ("null", None), ("empty", "")], "k string, text string"))
    c = chunking.chunked(df, "k", 1000, 100)
    got = {}
    for r in chunking.pieces(c, "k").collect():
        got.setdefault(r["k"], []).append(r)
    assert {k: rebuilt(v) for k, v in got.items()} == texts
    for v in got.values():
        v.sort(key=lambda r: r["piece_no"])
        assert all(len(r["text"]) <= 1000 for r in v) and all(r["new_from"] - r["start_char"] == 100 for r in v[1:])
    assert all(r["cut"] in ("sentence", "paragraph", "end") for r in got["prose"]) and got["hard"][0]["cut"] == "hard" and got["words"][0]["cut"] == "word"
    assert {(r["k"], r["start_char"]) for r in chunking.stretches(c, "k").collect()} == {("hard", 0), ("words", 0)}


def test_edit_moves_only_near_cuts():
    rnd = random.Random(9)
    text = " ".join("".join(rnd.choice("abcdefgh ") for _ in range(60)) + "." for _ in range(600))
    a = {p for p, _ in chunking.cuts(text, 1500, 50, chunking.boundaries(text))}
    changed = text[:5000] + "New words here. " + text[5000:]
    b = {p - 16 for p, _ in chunking.cuts(changed, 1500, 50, chunking.boundaries(changed)) if p > 5016}
    far = {p for p in a if p > 12000}
    assert len(far & b) >= 0.7 * len(far)


def test_forced_cuts_find_every_stretch():
    """Against a scan of all gaps between boundaries."""
    rnd = random.Random(12)
    for _ in range(400):
        text = "".join(rnd.choice(["word ", "w" * rnd.randint(1, 40), " ", "end. ", "\n \n", "\r\n", "a.b", "?” "] if rnd.random() < 0.2 else ["word ", "some", " "]) for _ in range(rnd.randint(1, 260)))
        found = chunking.boundaries(text)
        limit = rnd.choice([60, 100, 200])
        want, at = [], 0
        for end in [*(p for p, _ in found), len(text)]:
            body = len(text[at:end].strip())
            if body > limit:
                first = at + len(text[at:end]) - len(text[at:end].lstrip())
                want.append((first, first + body))
            at = end
        assert chunking.unbroken(text, found, chunking.cuts(text, limit, rnd.choice([0, 5, 14]), found), limit) == want


def test_crlf_is_no_blank_line():
    assert chunking.boundaries("a\r\nb") == [] and [k for _, k in chunking.boundaries("a\r\n \t\r\nb")] == ["paragraph"]


# 4 pairs


def conversations(spark, rows):
    return spark.createDataFrame([(i, [("user", q), ("assistant", a)]) for i, q, a in rows], "conv_id bigint, messages array<struct<role:string,content:string>>")


def test_refusal_counts_every_clause(spark, models):
    no = "I cannot answer that question; " * 3
    many = no + "one, two, three, four, five, six, seven, eight, nine, but the wheel of the mill is turned by the water of the hill."
    answer = no + " ".join(f"As to the matter {i} of it, the great wheel number {i * 3} of the mill was turned by the water of hill {i * 5}." for i in range(14))
    df = conversations(spark, [(1, "Why?", no), (2, "How many are there?", many), (3, "What?", None), (4, "What turned the wheel of the mill?", answer)])
    assert {r["conv_id"]: r["defect"] for r in instruct.pair_defects(df, models[1]).collect()} == {1: "refusal", 2: None, 3: "empty", 4: None}


def test_refusals_that_restate_the_question_and_copies_with_a_lead(spark, models):
    ask = "What ought one to expect of such a bright place of the office in winter?"
    rows = [(1, ask, "You ask about such a bright place of the office. My apologies, I know nothing that would let me reply to you."), (2, "Name three uses of his comet.", "The question is: Name three uses of his comet."), (3, "Name three uses of his comet.", "Name three uses of his comet. The tail.")]
    got = {r["conv_id"]: r["defect"] for r in instruct.pair_defects(conversations(spark, rows), models[1]).collect()}
    assert got == {1: "refusal", 2: "copied", 3: None}


def test_long_refusals(spark, models):
    parts = ["I must humbly beg that you will not press me for any reply upon this point", "the rules by which I am bound leave me no freedom to treat of it at all", "you would do well to look to some other friend for what you want", "pray take this for all that can be said to you here today"]
    long = ". ".join((parts * 8)[:9]) + "."
    assert len(long.split()) > 115
    df = conversations(spark, [(i, f"What is the use of the wheel number {i} in the mill?", long if i < 30 else f"I must not forget wheel {i}, which was turned by the water of hill {i * 7} and by nothing else, as all who came to house {i * 3} saw.") for i in range(40)])
    got = {r["conv_id"]: r["defect"] for r in instruct.pair_defects(df, models[1]).collect()}
    assert [i for i in range(40) if got[i] == "refusal"] == list(range(30))


def test_defects(spark, models):
    ok = "The engine moved the wheel, and the water rose in the pipe until it was full."
    msgs = lambda q, a: [("user", q), ("assistant", a)]
    rows = [
        (1, msgs("What is the use of the engine in the mill?", ok)), (2, msgs("What is it?", " ​")), (3, msgs("What is the use of the engine in the mill?", "What the use of the engine in the mill?")),
        (4, msgs("Why?", "I am sorry, but I cannot answer that question.")), (5, msgs("What moved the great wheel of the mill?", "La vapeur, qui diminue le pendule, confirme cette expérience du voyageur.")),
        (6, msgs("What moved the wheel of the mill?", "The engine moved the wheel, and the water rose in the")), (7, msgs("Say it in French, what moved the wheel of the mill?", "La vapeur, qui diminue le pendule, confirme cette expérience du voyageur.")),
        (8, [("user", "Alone?")]), (9, msgs("How much?", "388 fathoms")), (10, msgs("Name three uses of the mill.", "Here they are.\n1. The wheel\n2. The stone\n3. The pipe")), (11, msgs("How much?", "therefore \\answer{71")),
        (12, msgs(None, ok)), (13, None), (14, []), (15, [("system", "s"), ("user", None), ("user", "b"), ("assistant", None)]), (1, msgs("What is the use of the engine in the mill?", ok)),
        (16, msgs("What is the use of the engine in the mill?", "What is the use of the engine in the mill? " + ok)), (17, msgs("Why?", "I regret only that the proof is so long: " + ok)),
    ]
    df = clash(spark.createDataFrame(rows, "conv_id bigint, messages array<struct<role:string,content:string>>"))
    got = {(r["conv_id"], r["pair_no"]): r["defect"] for r in instruct.pair_defects(df, models[1]).collect()}
    assert got == {
        (1, 1): None, (2, 1): "empty", (3, 1): "copied", (4, 1): "refusal", (5, 1): "wrong_language", (6, 1): "truncated", (7, 1): None, (8, 1): "empty", (9, 1): None, (10, 1): None,
        (11, 1): "truncated", (12, 1): None, (15, 1): "empty", (15, 2): "empty", (16, 1): None, (17, 1): None,
    }
    assert instruct.pair_defects(df.where("false"), models[1]).count() == 0


# 5 quality


def test_kinds(models):
    prose = "It is to the engine that we owe the motion of the wheel, and the water which was in the pipe."
    texts = {
        "prose": prose * 3, "caps": prose.upper() * 3, "list": "\n".join(f"- the wheel of the mill {i}" for i in range(12)), "toc": "\n".join(f"The Engine ........ {i}" for i in range(10, 22)),
        "table": "\n".join(f"| mill | {i}.5 | {i * 7} |" for i in range(12)), "cols": "\n".join(f"wheel      {i}.25     {i * 3}     0.5" for i in range(12)), "junk": "vxmdcdrj zxlqdhsg pnxw hmvxcg " * 8,
        "rep": "line! " * 60, "empty": "", "white": " \n\t ",
    }
    kinds = dict(zip(texts, quality.measure(list(texts.values()), models[0])["kind"]))
    assert kinds == {"prose": "prose", "caps": "prose", "list": "list", "toc": "list", "table": "table", "cols": "table", "junk": "junk", "rep": "junk", "empty": "empty", "white": "empty"}


@needs_data
def test_line_labels_of_held_out_texts(refs):
    model = quality.fit([r for i, r in enumerate(refs) if i % 2])
    docs = linemodel.labelled_documents([r for i, r in enumerate(refs) if i % 2 == 0], 300, seed=99)
    b = tv.block(["\n".join(t for t, _ in d) for d in docs])
    seg = quality.segments(b, model)
    line = tv.prefix(b.cls == tv.NEWLINE)
    want = np.array([docs[i][k][1] for i, k in zip(seg.doc, line[seg.start] - line[b.start[seg.doc]])])
    score = quality.emissions(seg.feats, model.lines)
    got = quality.viterbi(score, seg.doc, b.n, model.lines)
    assert (got == want).mean() > 0.97
    # the transitions decide lines that their own figures leave open, and decide them rightly
    alone = score.argmax(axis=1)
    changed = got != alone
    assert changed.sum() > 50 and (got[changed] == want[changed]).mean() > 0.8


def test_transitions_change_labels(models):
    rows = "\n".join(f"wheel      {i}.25     {i * 3}     0.5" for i in range(12))
    text = rows[: len(rows) // 2] + "\nditto mill\n" + rows[len(rows) // 2 :]
    b = tv.block([text])
    seg = quality.segments(b, models[0])
    score = quality.emissions(seg.feats, models[0].lines)
    assert set(quality.viterbi(score, seg.doc, 1, models[0].lines)) == {quality.TABLE} and set(score.argmax(axis=1)) != {quality.TABLE}


def test_stats_of_awkward_rows(spark, models):
    df = clash(spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "😀" * 300, "s"), (3, "😀" * 300, "s"), (4, "word " * 50_000, "t")], "doc_id int, text string, source string"))
    s = quality.quality_stats(df, models[0], ["doc_id", "source"])
    rows = {r["doc_id"]: r for r in s.collect()}
    assert s.count() == 5 and rows[1]["kind"] == "empty" and rows[4]["n_words"] == 50_000 and rows[4]["kind"] == "junk"
    assert quality.source_summary(s).count() == 3 and quality.quality_stats(df.where("false"), models[0], ["doc_id"]).count() == 0


# 6 scans


def test_lines_and_repair():
    counts = [("w:", w, n) for w, n in {"the": 900, "calculation": 90, "of": 900, "wheel": 200, "was": 500, "made": 100, "in": 400, "mill": 100, "custom": 90, "house": 90, "and": 500, "water": 80}.items()]
    v = scan.known([*counts, ("h", "customs-house", 40)], 3)
    text = "\n".join(["12", "THE GREAT MILL.   13", "The calculat-", "", "THE GREAT MILL   14", "", "ion of the w¦heel was made in the", "customs-", "house of the mill and tHe water."])
    rows, fixed, n = scan.analyse(text, "The Great Mill", v)
    assert rows == [(1, "page_number"), (2, "header"), (3, "hyphen"), (5, "header"), (7, "misread"), (9, "misread")]
    assert fixed == "The calculation of the wheel was made in the customs-house of the mill and the water." and n == 4
    assert scan.analyse("", None, v) == ([], "", 0)


@pytest.mark.parametrize("line,want", [("— 97 —", True), ("[12]", True), ("Page 153", True), ("xlv", True), ("l99", True), ("1827 was a year", False), ("mill", False), ("", False), ("12345", False)])
def test_page_numbers(line, want):
    assert scan.is_page_number(line) is want


def pages(n, noise=True):
    """A record of n pages: a sentence-case title on even ones, a chapter of its own on odd ones, no numbers, blank lines around."""
    rnd = random.Random(n)
    hurt = lambda h: h[: (k := rnd.randrange(len(h)))] + rnd.choice(".|'0") + h[k + 1 :] if noise and rnd.random() < 0.7 else h
    text, heads = [], []
    for i in range(n):
        text += [f"The wheel of the mill {i} was turned by the water of the", f"hill and the stone number {i * 7} went round in the great house."] * 3
        heads.append(len(text) + 1)
        text += ["", hurt(f"On the quiet motion of Wheel {chr(65 + i // 40 % 26)}{chr(65 + i // 8 % 5) * 3}" if i % 2 else "Lectures upon the brief Law."), ""]
    return text, heads


def test_headers_need_fuzzy_repetition(monkeypatch):
    text, heads = pages(12)
    # most words begin with small letters: such lines stand out by nothing but their coming again
    got = [i for i, k in enumerate(scan.line_kinds(text, None)) if k == "header"]
    assert len(set(got) & set(heads)) >= 11 and not set(got) - set(heads)
    monkeypatch.setattr(scan, "_alike", lambda a, b, floor: a == b)
    assert len([k for k in scan.line_kinds(text, None) if k == "header"]) < 9


def test_page_numbers_rise():
    assert scan.rising([464, 9, 465, 467, 3, 468]) == {0, 2, 3, 5} and scan.rising([]) == set() and scan.rising([5, 5, 4]) == {0}
    assert [scan.number_value(x) for x in ("l99", "xlv", "[12]", "LVIII", "3O", "ab")] == [199, 45, 12, 58, 30, None]
    text = ["The wheel was turned by the water.", "12", "It was made of oak.", "", "40", "", "The stone of the mill was", "41", "new and the house was", "42", "old."]
    assert [i for i, k in enumerate(scan.line_kinds(text, None)) if k == "page_number"] == [4, 7, 9]


def test_header_search_is_linear_in_pages():
    import time

    def seconds(n):
        text, _ = pages(n)
        text = [x.title() if "Law" in x or "Wheel" in x else x for x in text]
        began = time.process_time()
        scan.line_kinds(text, "A Book")
        return time.process_time() - began

    seconds(100)
    assert seconds(3200) < 16 * max(seconds(400), 0.01) and seconds(3200) < 5


def test_index_finds_what_enumeration_finds():
    rnd = random.Random(3)
    table = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 6))): 999 for _ in range(300)}
    v = scan.known([("w:", w, n) for w, n in table.items()], 3)
    for _ in range(300):
        w = "".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 6)))
        one = {t for t in table if t != w and (len(t) == len(w) and sum(a != b for a, b in zip(t, w)) == 1 or t in scan.deletions(w) or w in scan.deletions(t))}
        assert {x for x in scan.near_words(w, table, v.index()) if x in table} >= one


def test_vocabulary_floor_is_of_the_language(spark, monkeypatch):
    counts = spark.createDataFrame([("w:en", "the", 14_000_000), ("w:en", "wheel", 700), ("w:en", "house", 600), ("w:en", "wheal", 20), ("w:de", "mühle", 60), ("w:de", "wheal", 3), ("w:de", "hause", 3), ("h", "mill-wheel", 20)], "kind string, word string, n bigint")
    monkeypatch.setattr(scan, "word_counts", lambda *_: counts)
    v = scan.vocabulary(counts)
    assert "mühle" in v.words and "wheal" not in v.by_lang["en"] and not v.compound
    v.lang = "de"
    assert scan.spelling("mühte", v) == "mühle" and scan.spelling("wheet", v) is None
    v.lang = "en"
    assert scan.spelling("wheal", v) == "wheel" and scan.spelling("hause", v) is None


def test_scan_of_awkward_rows(spark, models):
    df = clash(spark.createDataFrame([("a", None, None, None), ("b", "t", "", -1.0), ("c", None, "mill", 97.0), ("c", None, "mill", 97.0)], "doc_id string, title string, text string, ocr_score double"))
    done = scan.scanned(df, scan.vocabulary(df, model=models[1]), ["doc_id", "ocr_score"], model=models[1])
    assert scan.line_rows(done).count() == 0 and {r["doc_id"]: r["repaired"] for r in scan.repairs(done).collect()} == {"a": None, "b": "", "c": "mill"}
    assert scan.scanned(df.where("false"), scan.vocabulary(df.where("false")), ["doc_id"]).count() == 0


# 7 packing


def test_packing_is_whole(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0, 1, 5, 40, 99, 100, 101, 250, rnd.randint(1, 100)])) for i in range(3000)] + [(5000, None), (7, 33)]
    df = clash(spark.createDataFrame(rows, "doc_id bigint, n bigint").withColumnRenamed("n", "n_tokens"))
    got = packing.pack(df, ["doc_id"], 100, part_rows=200).collect()
    per, room = {}, {}
    for r in got:
        per.setdefault(r["doc_id"], []).append(r["n_tokens"])
        room.setdefault(r["row_id"], []).append((r["row_offset"], r["n_tokens"]))
    want = {}
    for i, n in rows:
        if n:
            want[i] = want.get(i, 0) + n
    assert {i: sum(v) for i, v in per.items()} == want
    assert all(len(v) == 1 for i, v in per.items() if dict(rows).get(i, 0) <= 100 and i != 7)
    for v in room.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and v[-1][0] + v[-1][1] <= 100
    assert sorted(room) == list(range(len(room)))
    assert sum(n for v in room.values() for _, n in v) / (100 * len(room)) > 0.98
    assert packing.pack(df.where("false"), ["doc_id"], 100).count() == 0


def test_at_most_two_large_items_a_row():
    rnd = random.Random(6)
    for _ in range(200):
        hist = {rnd.randint(1, 60): rnd.randint(1, 9) for _ in range(rnd.randint(0, 12))}
        plan = packing.plan(hist, 60)
        used: dict = {}
        for pattern, n in plan:
            assert sum(s * c for s, c in pattern) <= 60 and sum(c for s, c in pattern if 3 * s > 60) <= 2
            for s, c in pattern:
                used[s] = used.get(s, 0) + c * n
        assert used == hist


# 8 mixing


def test_schedule_stays_within_a_block():
    from fractions import Fraction

    rnd = random.Random(13)
    for k in range(60):
        parts = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 9))]
        weights = {f"s{i}": Fraction(n, sum(parts)) for i, n in enumerate(parts)}
        counts = mixing.counts_of(weights, 1000)
        slots, worst = mixing.schedule(counts)
        period = sum(counts.values())
        assert {s: Fraction(n, period) for s, n in counts.items()} == weights and sorted(x[2] for x in slots) == list(range(period))
        assert max(worst.values()) < 1
        done = dict.fromkeys(weights, 0)
        for s, turn, slot in sorted(slots, key=lambda x: x[2]):
            assert turn == done[s]
            done[s] += 1
            assert all(abs(done[x] - weights[x] * (slot + 1)) <= worst[x] for x in weights)


def test_schedule_of_awkward_weights():
    from fractions import Fraction

    weights = {"a": Fraction(333331, 1000003), "b": Fraction(1, 1000003), "c": Fraction(666671, 1000003)}
    counts = mixing.counts_of(weights, 5000)
    assert sum(counts.values()) in (5000, 5001) and all(abs(Fraction(n, sum(counts.values())) - weights[s]) < Fraction(1, 4000) for s, n in counts.items())
    assert mixing.counts_of({}, 10) == {} and mixing.schedule({}) == ([], {})


def test_mixture_reaches_shares(spark):
    docs = [(i, s, 10) for i, s in enumerate(["A "] * 600 + ["b"] * 300 + ["c"] * 20 + [None] * 5 + ["other"] * 9)] + [(9999, "b", 0), (9998, "b", None)]
    df = clash(spark.createDataFrame(docs, "doc_id bigint, source string, n bigint").withColumnRenamed("n", "n_tokens"))
    goal = spark.createDataFrame([("a", 0.5, 1), ("B", 0.4, 2), ("c", 0.1, 4), ("gone", 0.2, 3)], "source string, target_share double, max_repeats int")
    rows, report = mixing.mixture(df, goal, block_tokens=50, part_docs=40)
    got = {r["source"]: r for r in report.collect()}
    assert abs(got["a"]["actual_share"] - 0.5) < 0.01 and abs(got["b"]["actual_share"] - 0.4) < 0.01 and abs(got["c"]["actual_share"] - 0.1) < 0.01
    assert got["gone"]["mixed_docs"] == 0 and got["c"]["passes"] == 4 and max(r["worst_blocks"] for r in got.values()) < 1
    assert rows.groupBy("doc_id", "source", "repeat_no").count().where("count > 1").count() == 0
    # at every slot, each source's tokens are within a block and a document of its share
    by = sorted(rows.collect(), key=lambda r: (r["slot"], r["source_offset"]))
    run = dict.fromkeys("abc", 0)
    for i, r in enumerate(by):
        run[r["source"]] += r["n_tokens"]
        if i + 1 == len(by) or by[i + 1]["slot"] != r["slot"]:
            assert all(abs(run[s] - w * 50 * (r["slot"] + 1)) <= 60 for s, w in (("a", 0.5), ("b", 0.4), ("c", 0.1)))
    empty, report = mixing.mixture(df.where("false"), goal)
    assert empty.count() == 0 and report.count() == 4


# 9 languages


@needs_data
def test_held_out_languages(refs):
    model = language.fit([r for i, r in enumerate(refs) if i % 4])
    held = [r for i, r in enumerate(refs) if i % 4 == 0]
    got = language.segment([t for _, t in held], model)
    right = sum(len(s) == 1 and s[0][1] == lang for (lang, _), s in zip(held, got))
    assert right >= 0.98 * len(held)


@needs_data
def test_stretches_and_quotations(refs, models):
    by = {}
    for lang, t in refs:
        by.setdefault(lang, []).append(t)
    text = lambda lang: " ".join(by[lang][:4])
    mixed = f"{text('en')}\n\n{text('fr')} {text('de')}"
    quote = f"{text('en')} He said: {' '.join(by['la'][0].split()[:8])}. {text('en')}"
    a, b, c, d = language.segment([mixed, quote, "", "123 456"], models[1])
    assert [(s[0], s[1]) for s in a] == [(1, "en"), (2, "fr"), (3, "de")] and [(s[0], s[1]) for s in b] == [(0, "en")] and c == [] and d == []
    assert all(0 < s[2] <= 1 for s in a)


@needs_data
def test_wrong_labels(spark, refs, models):
    fr = " ".join(t for lang, t in refs if lang == "fr")[:600]
    rows = [(1, fr, "fre"), (2, fr, "en"), (3, fr, None), (4, fr, "mul"), (5, None, "en"), (6, "", None), (7, "kurz", "en"), (8, fr, "FRENCH "), (2, fr, "en")]
    df = clash(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    seg = language.language_segments(df, models[1], models[0], ["doc_id"])
    assert {tuple(r) for r in language.wrong_labels(seg).collect()} == {(2, 0, "fr"), (3, 0, "fr"), (4, 0, "fr")}
    assert language.language_segments(df.where("false"), models[1], models[0], ["doc_id"]).count() == 0
