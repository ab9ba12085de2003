"""Small cases of operators that SQL does not cover."""

import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from vellum.functions.runtime import with_index
from vellum.operators import chunk, clean, dedup, dialogue, gates, joins, training
from vellum.sources import writers
from vellum.streaming import logs


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


def test_page_artefacts_break_paragraphs(spark):
    assert one(spark, "abc\n12\ndef", clean.drop_page_artefacts) == "abc\n\ndef"
    assert one(spark, None, clean.drop_page_artefacts) is None


def test_leading_lines(spark):
    text = "UNIVERSITY OF X\n\nHarvard College Library\nIt was a dark and stormy night upon the hills of home.\nMore."
    assert one(spark, text, clean.drop_leading).startswith("It was a dark")
    assert one(spark, "ab\ncd", clean.drop_leading) == "ab\ncd"


def test_front_matter_cut_only_past_200(spark):
    body = "x" * 250 + "\nCHAPTER IV\nbody"
    assert one(spark, body, clean.drop_front_matter) == "CHAPTER IV\nbody"
    assert one(spark, "x\nCHAPTER IV\nbody", clean.drop_front_matter) == "x\nCHAPTER IV\nbody"


def test_clean_text_order(spark):
    got = one(spark, "Digitized by Google\nThe ﬁrst collect-\ning of the great long sentence here\n\n12\n\nNext.", clean.clean_text)
    assert got == "The first collecting of the great long sentence here\n\nNext."


def test_braces(spark):
    assert one(spark, "so \\answer{\\frac{1}{2}} x", clean.braced_answer) == "\\frac{1}{2}"
    assert one(spark, "\\answer{1", clean.braced_answer) is None
    assert one(spark, "\\boxed{3}", clean.braced_answer) == "3"


def test_equivalence(spark):
    df = spark.createDataFrame([("\\frac{1}{2}", "0.5"), ("x = 3", "3"), ("a", "b"), (None, "1"), ("1,000 m", "1000"), ("2^3", "8")], "a string, b string")
    assert [r[0] for r in df.select(training.equivalent(F.col("a"), F.col("b"))).collect()] == [True, True, False, None, True, True]


def test_calculator_refuses_code():
    assert training.calculate("2*(3+4)") == 14
    assert training.calculate("2**3") is None and training.calculate("__import__('os')") is None and training.calculate("1/0") is None


def test_windows_boundaries():
    text = "a" * 26 + "\n\n" + "b" * 100
    assert chunk.greedy_windows(text, 100, 1)[0] == "a" * 26
    assert chunk.greedy_windows("a" * 25 + "\n\n" + "b" * 100, 100, 1)[0] == "a" * 25 + "\n\n" + "b" * 73
    assert chunk.greedy_windows("short", 100, 50) == ["short"] and chunk.greedy_windows("short", 100, 50, True) == []


def test_fill_rows_loses_nothing():
    rnd = random.Random(1)
    items = [(i, rnd.randint(1, 300)) for i in range(200)]
    for crop in (True, False):
        rows = training.fill_rows(items, 128, 20, crop)
        got: dict = {}
        for row, off, key, start, n in rows:
            assert off + n <= 128
            got.setdefault(key, []).append((start, n))
        assert {k: sum(n for _, n in v) for k, v in got.items()} == dict(items)


def test_merges():
    assert training.merges([("abab", 3), ("ab", 1)], 2) == [(b"a", b"b"), (b"ab", b"ab")]


def test_quotes_mid_break():
    q = dialogue.found_quotes('"It is a fine day," said he, "for a long walk." Nothing.')
    assert len(q) == 1 and q[0]["speaker"] == "he" and q[0]["quote"] == "It is a fine day for a long walk"


def test_fused_equals_plain(spark):
    import re

    from vellum.functions.patterns import ALWAYS_REJECT

    samples = ["the photon", "a photonic", "Planck constant", "NMR", "standard model of the particle", "standard model\nparticle", "e = mc2", "nothing", "M-theory", "proton beam", "protonx beam"]
    df = spark.createDataFrame([(s,) for s in samples], "t string").select(gates.any_of(F.col("t"), ALWAYS_REJECT))
    want = [any(re.search(p, s, re.IGNORECASE) for p in ALWAYS_REJECT) for s in samples]
    assert [r[0] for r in df.collect()] == want


def test_index_is_dense(spark):
    df = with_index(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), "k")
    assert df.where("k <> idx").count() == 0 and df.count() == 1000


def test_shards_and_resume(spark, tmp_path):
    path = str(tmp_path / "s")
    writers.shards(spark.range(100).coalesce(1), path, 30)
    assert len([f for f in (tmp_path / "s").iterdir() if f.suffix == ".parquet"]) == 4
    part = str(tmp_path / "p")
    spark.createDataFrame([(1, "a")], "k int, v string").write.partitionBy("k").parquet(part)
    left = writers.missing_partitions(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), part, "k")
    assert [r[0] for r in left.collect()] == [2]
    assert writers.report_section("T", [("a", 0.5), ("b", 12345)]) == "## T\n\n- a: 0.5000\n- b: 12,345\n"


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 20) as ts, 'e' as event_type, double(id) as value from range(50)").write.parquet(src)
    stream = logs.minute_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(src))
    q = stream.writeStream.format("memory").queryName("minutes").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.sql("select sum(n), count(*) from minutes").first()[0] == 50


def test_fuzzy_titles_equal_brute_force(spark):
    rnd = random.Random(5)
    words = "elements of motion light heat wheel treatise upon enquiry nature voyage lectures aether weather volume".split()
    keys = ["principles of light", "prinoiples of light", "principles of light vol ii", "rinciples of light", "abcdefghij", "abcdefghijklmnop", "", "é" * 12, "é" * 11 + "x", "ab " * 80, "ab " * 79 + "c"]
    for _ in range(120):
        k = " ".join(rnd.choices(words, k=rnd.randint(1, 6)))
        i = rnd.randrange(len(k))
        keys += [k, k[:i] + rnd.choice("aeiou ") + k[i + 1 :], k[: len(k) * 2 // 3]]
    ids = list(range(len(keys)))
    rnd.shuffle(ids)
    rows = [*zip(ids, keys), (len(keys), keys[0]), (len(keys) + 1, None)]
    rep: dict = {}
    for i, k in rows:
        if k is not None:
            rep[k] = min(i, rep.get(k, i))
    want = {k: min([r, *(o for y, o in rep.items() if o < r and SequenceMatcher(None, k, y).ratio() >= 0.75)]) for k, r in rep.items()}
    got = joins.fuzzy_titles(spark.createDataFrame(rows, "id bigint, k string"), "id", "k", block=32).collect()
    assert {r["id"]: r["rep_id"] for r in got} == {i: want[k] for i, k in rows if k is not None}


def test_near_within_equals_brute_force(spark):
    rnd = random.Random(7)
    words = "the of and motion light heat wheel Newton Kepler upon query juice vexed nature, voyage; aether x-ray zinc".split()
    say = lambda n: " ".join(rnd.choices(words, k=n))
    notice = "This copy was made from a volume lent by the library. " * 9
    texts = [("g", notice + say(400)), ("g", notice + say(400)), ("h", say(90) + " tail" * 250), ("h", say(80) + " tail" * 240), ("h", ""), ("h", None), (None, "x"), (None, "x y")]
    for k in range(60):
        t = say(rnd.choice([2, 9, 30, 60, 150]))
        cut = [c if rnd.random() > 0.12 else rnd.choice("aeiou.") for c in t]
        texts += [(f"w{k % 3}", t), (f"w{k % 3}", "".join(cut)), (f"w{k % 3}", t[len(t) // 2 :] + say(5))]
    rows = [(g, i, t, rnd.randint(1, 4)) for i, (g, t) in enumerate(texts)]
    rows.append(("w0", len(rows), texts[8][1], 9))

    def alike(x, y):
        return SequenceMatcher(None, x[2] or "", y[2] or "").ratio() > 0.6

    want = {(x[0], x[1]) for x in rows if not any(x[0] == y[0] is not None and (-y[3], y[1]) < (-x[3], x[1]) and alike(x, y) for y in rows)}
    df = spark.createDataFrame(rows, "g string, id bigint, t string, n int")
    for block in (16, 1024):
        assert {tuple(r) for r in dedup.near_within(df, "g", "id", "t", "n", block=block).collect()} == want


def counted(monkeypatch):
    calls, real = [], dedup.ratio_over
    monkeypatch.setattr(dedup, "ratio_over", lambda *x: calls.append(1) or real(*x))
    return calls


def test_few_long_texts_are_compared(monkeypatch):
    import pandas as pd

    rnd, calls = random.Random(5), counted(monkeypatch)
    words = "the of and motion light heat wheel observation particular which whereas upon between their considerable expansion temperature".split()
    say = lambda k: ". ".join(" ".join(rnd.choices(words, k=9)).capitalize() for _ in range(k))
    texts = [say(rnd.randint(10, 14)) for _ in range(60)]
    texts += ["".join(c if rnd.random() > 0.03 else "~" for c in t) for t in texts[:6]] + [texts[7] + "Q" * 90, "Zz" * 200, "", "A" * 5000]
    rows = pd.DataFrame({"t": texts, "n": 0, "id": range(len(texts))})
    want = [any(SequenceMatcher(None, x, y).ratio() > 0.6 for y in texts[:i]) for i, x in enumerate(texts)]
    assert dedup.beaten(rows, rows, 0.6).tolist() == want and sum(want) == 6
    # of 2,415 pairs; the bound by runs of four alone leaves 1,838
    assert len(calls) < 100


def test_alike_prompts_meet_few_others(monkeypatch):
    import pandas as pd

    rnd, calls = random.Random(11), counted(monkeypatch)
    asks = ["What is the cause of the {0}?", "Compute the weight of every {0} if their {1} was 245 yards.", "Which of the two was the greater, the {0} or the {1}?", "Quaero quomodo {0} solis {1} sequitur."]
    texts = [rnd.choice(asks).format(*rnd.sample("axle inertia turnip hedge telescope lever cavern wheat harbour".split(), 2)) + f" {k}" for k in range(200)]
    rows = pd.DataFrame({"t": texts, "n": 0, "id": range(len(texts))})
    got = dedup.beaten(rows, rows, 0.5, tries=4)
    assert sum(got) >= 180 and len(calls) < 260
    assert got.tolist() == [any(SequenceMatcher(None, x, y).ratio() > 0.5 for y in texts[:i]) for i, x in enumerate(texts)]


def test_covered_places_hold_every_block():
    rnd = random.Random(9)
    code = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    pairs = []
    for k in range(20):
        a, b = ("".join(rnd.choices("the quick brown fox, jumps. Over 12", k=n)) for n in (rnd.randint(0, 700), rnd.randint(200, 700)))
        pairs.append((a, a[: 90 * (k % 3)] + b + a[:200] * (k % 2)))
    coded = [(code(a), code(b)) for a, b in pairs]
    got = dedup.covered(coded, [dedup.meetings(a, dedup.rare_places(b)) for a, b in coded])
    for (a, b), (ca, cb) in zip(pairs, got):
        for i, j, k in SequenceMatcher(None, a, b).get_matching_blocks():
            assert ca[i + k] - ca[i] == k == cb[j + k] - cb[j]


def test_terms_after_a_cutoff():
    from vellum.functions import patterns as P

    early, late = P.terms_after(1904), P.terms_after(1914)
    assert (len(P.ALWAYS_REJECT), len(early), len(late), len(P.COMPACT_REJECT)) == (194, 189, 165, 89)
    assert r"\bisotope(?:s|ic)?\b" in early and r"\bisotope(?:s|ic)?\b" not in late and P.NARROWED[2] in late and P.NARROWED[1] in early
    assert P.terms_after(1800) == P.ALWAYS_REJECT


def test_replies_of_several_turns(spark):
    import json

    from vellum.operators import records

    turns = [{"role": r, "content": "x"} for r in ("user", "assistant", "user", "assistant")]
    replies = [json.dumps({"turns": turns}), json.dumps({"turns": turns[:2]}), json.dumps({"turns": turns[1:] + turns[:1]}), json.dumps({"rejected": True}), "not json", None, "```json\n" + json.dumps({"turns": turns}) + "\n```", json.dumps({"turns": [*turns[:3], {"role": "assistant", "content": ""}]})]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, t string").select("i", records.conversation_reply(F.col("t"), True).alias("r")).select("i", F.size("r.messages").alias("n"), "r.reason")
    got = {r["i"]: (r["n"] if (r["n"] or -1) > 0 else None, r["reason"]) for r in df.collect()}
    assert got == {0: (4, None), 1: (None, None), 2: (None, None), 3: (None, "unknown"), 4: (None, None), 5: (None, None), 6: (4, None), 7: (None, None)}


def test_one_group_may_hold_most_rows(spark):
    from vellum.functions.runtime import values_at, with_rank
    from vellum.operators import sampling

    rows = [(None if i % 3 == 0 else "a" if i % 3 == 1 else f"g{i % 50}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int")
    ranked = {(r["v"]): (r["rank"], r["total"]) for r in with_rank(df, ["g"], ["v"]).collect()}
    groups: dict = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert ranked == {v: (k, len(vs)) for vs in groups.values() for k, v in enumerate(sorted(vs))}
    assert values_at(df, "v", [0, 5, 899]) == {0: 0, 5: 5, 899: 899}
    first = {tuple(r) for r in dedup.first_by(df, [F.col("g")], [-F.col("v")]).collect()}
    assert first == {(g, max(vs)) for g, vs in groups.items()}
    split = sampling.group_validation(df, "g", 0.2)
    sides = {r["g"]: r["split"] for r in split.collect()}
    assert split.count() == 900 and sum(len(groups[g]) for g, s in sides.items() if s == "val") >= 180
    empty = df.where("false")
    assert with_rank(empty, ["g"], ["v"]).count() == 0 and dedup.first_by(empty, [F.col("g")], [F.col("v")]).count() == 0


def test_search_by_automaton_equals_tests_of_words(spark):
    specs = spark.createDataFrame([(1, ["mill"], ["water"]), (2, ["MILL wheel", "stone"], []), (3, [], ["x"]), (4, None, None)], "spec_id int, title_words array<string>, author_words array<string>")
    rows = [(1, "The Mill wheel", None), (2, None, "a mill by the water"), (3, "stones", "x"), (4, None, None), (5, "milk", "water")]
    df = spark.createDataFrame(rows, "i int, title string, text string")
    got = {(r["i"], r["spec_id"], r["how"]) for r in joins.search(df, specs, F.col("title"), F.col("text")).collect()}
    assert got == {(1, 1, "title"), (1, 2, "title"), (2, 1, "text"), (3, 2, "title")}


def test_shards_close_on_size_and_multiple(spark):
    rnd = random.Random(3)
    sizes = [rnd.choice([None, 1, 50, 400]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, n int").coalesce(1)
    rows = writers.closed_shards(df, "n", 2000, 16).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["n"] or 0)
    assert len(rows) == 700 and len(by) > 3
    for v in list(by.values())[:-1]:
        assert sum(v) >= 2000 and len(v) % 16 == 0 and (len(v) == 16 or sum(v[:-16]) < 2000)


def test_log_rows_counts_and_pages(spark, tmp_path):
    from vellum.sources import readers

    path = str(tmp_path / "log")
    rows = [(i, f"2026-01-0{1 + i}T00:00:00+00:00", c) for i, c in enumerate(["aaa", "bbb", "aaa"])]
    writers.append_log(spark.createDataFrame(rows, "id bigint, timestamp string, conversation_id string"), path)
    more = [(i, f"2026-01-{10 + i}T00:00:00+00:00", "ccc", "timed out" if i == 5 else None) for i in range(3, 10)]
    writers.append_log(spark.createDataFrame(more, "id bigint, timestamp string, conversation_id string, error string"), path)
    log = readers.log_table(spark, path)
    counts = {r[0]: r[1] for r in logs.by_conversation(log).collect()}
    assert counts == {"aaa": 2, "bbb": 1, "ccc": 7} and "zzz" not in counts
    assert {r[0]: r[1] for r in logs.by_conversation(log, "2026-01-03T00:00:00+00:00").collect()} == {"aaa": 1, "ccc": 7}
    assert logs.by_conversation(log, "2999").count() == 0
    assert [r["id"] for r in logs.page(log, 3, 0).collect()] == [9, 8, 7] and [r["id"] for r in logs.page(log, 3, 1).collect()] == [6, 5, 4]
    assert {r["id"]: r["error"] for r in log.collect()}[5] == "timed out" and {r["id"]: r["error"] for r in log.collect()}[0] is None


def test_best_of_alike_titles(spark):
    rows = [(1, "principles of light", 5), (2, "prinoiples of light", 9), (3, "principles of light", 9), (4, "a voyage", None), (5, None, 3)]
    got = {tuple(r) for r in joins.best_of_titles(spark.createDataFrame(rows, "i int, k string, n int"), "i", "k", "n").select("rep_id", "i", "n").collect()}
    assert got == {(1, 2, 3), (4, 4, 1)}
