"""Queries of conversations: mixing, marking, rewards and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import table
from ..operators import clean, dedup, gates, stats, training
from .registry import query

@query("select phrase, round(avg(cast(contains(lower(coalesce(m.content, '')), phrase) as int)), 6) as rate, count(*) as n from (select unnest(messages) as m from instruct_pairs), (select unnest(['let us suppose', 'in a word', 'i have']) as phrase) where m.role = 'assistant' group by 1")
def a14_phrase_rates(spark, d):
    ms = table(spark, d, "instruct_pairs").select(F.explode("messages").alias("m")).where("m.role = 'assistant'")
    text = F.lower(F.coalesce("m.content", F.lit("")))
    each = ms.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.contains(text, F.lit(p)).cast("int").alias("hit")) for p in ("let us suppose", "in a word", "i have")])).alias("x"))
    return each.groupBy("x.phrase").agg(F.round(F.avg("x.hit"), 6).alias("rate"), F.count("*").alias("n"))


@query("select min(n) as min_turns, max(case when r = k // 2 then n end) as mid_turns, max(n) as max_turns, count(*) as n_rows from (select len(messages) as n, row_number() over (order by len(messages), conv_id) - 1 as r, count(*) over () as k from instruct_pairs where messages is not null)")
def a13_turn_stats(spark, d):
    df = table(spark, d, "instruct_pairs").where("messages is not null").select(F.size("messages").cast("bigint").alias("n"))
    sizes = df.groupBy("n").agg(F.count("*").alias("k"))
    # the upper median from the counts of the few distinct sizes
    every = sizes.agg(F.array_sort(F.collect_list(F.struct("n", "k"))).alias("s"), F.sum("k").alias("all"), F.min("n").alias("min_turns"), F.max("n").alias("max_turns"))
    state = lambda run, mid: F.struct(run.cast("bigint").alias("run"), mid.cast("bigint").alias("mid"))
    fold = F.aggregate("s", state(F.lit(0), F.lit(None)), lambda a, x: state(a["run"] + x["k"], F.when(a["mid"].isNull() & (a["run"] + x["k"] > F.floor(F.col("all") / 2)), x["n"]).otherwise(a["mid"])))
    return every.select("min_turns", fold["mid"].alias("mid_turns"), "max_turns", F.col("all").alias("n_rows"))


@query("select conv_id, i as turn, (case when regexp_matches(t, '(?s)<think>.+?</think>') then 0.05 else 0 end) + (case when contains(t, '\\answer{') then 0.05 else 0 end) as reward from (select conv_id, i, (case when conv_id % 2 = 0 then '<think>so</think> ' else '' end) || coalesce(m.content, '') as t from (select conv_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from instruct_pairs) where m.role = 'assistant')")
def r03_format_reward(spark, d):
    ms = table(spark, d, "instruct_pairs").select("conv_id", F.posexplode("messages").alias("i", "m")).where("m.role = 'assistant'")
    t = F.concat(F.when(F.col("conv_id") % 2 == 0, "<think>so</think> ").otherwise(""), F.coalesce("m.content", F.lit("")))
    return ms.select("conv_id", (F.col("i") + 1).cast("bigint").alias("turn"), training.format_reward(t).alias("reward"))


@query()
def r01_equivalence(spark, d):
    ms = table(spark, d, "instruct_pairs").select("conv_id", F.posexplode("messages").alias("i", "m")).where("m.role = 'assistant'")
    a = clean.simple_answer(F.col("m.content"))
    gold = F.concat(F.lit("\\frac{"), F.col("conv_id") % 400 * 2, F.lit("}{2}"))
    return ms.where(a.isNotNull()).select("conv_id", "i", a.alias("answer"), training.equivalent(a, gold).alias("equal"))


@query("select conv_id, created_at is not null as dated, md5 from (select conv_id, created_at, md5, row_number() over (partition by md5 order by conv_id, created_at nulls first) as r from (select conv_id, created_at, md5(array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), '||')) as md5 from instruct_pairs where messages is not null)) where r = 1")
def u01_distinct_conversations(spark, d):
    df = table(spark, d, "instruct_pairs").where("messages is not null").withColumn("md5", dedup.turns_key(F.col("messages")))
    return dedup.first_by(df, [F.col("md5")], [F.col("conv_id"), F.col("created_at")]).select("conv_id", F.col("created_at").isNotNull().alias("dated"), "md5")


_QA = "(select conv_id, i, messages[i].content as question, coalesce(messages[i + 1].content, '') as answer from (select conv_id, messages, generate_subscripts(messages, 1) as i from instruct_pairs) where messages[i].role = 'user' and messages[i + 1].role = 'assistant')"


@query(f"select question, conv_id, n_chars from (select question, conv_id, length(answer) as n_chars, row_number() over (partition by question order by length(answer), conv_id, i) as r from {_QA}) where r = 1")
def u04_shortest_answer(spark, d):
    df = table(spark, d, "instruct_pairs").where("messages is not null")
    each = df.select("conv_id", F.col("messages").alias("ms"), F.posexplode("messages").alias("i", "m"))
    nxt = F.get("ms", F.col("i") + 1)
    qa = each.where((F.col("m.role") == "user") & (nxt["role"] == "assistant")).select("conv_id", "i", F.col("m.content").alias("question"), F.length(F.coalesce(nxt["content"], F.lit(""))).alias("n_chars"))
    return dedup.first_by(qa, [F.col("question")], [F.col("n_chars"), F.col("conv_id"), F.col("i")]).select("question", "conv_id", "n_chars")


@query("select user_id, event_id, round(value - avg(value) over (partition by user_id), 9) as advantage from events where value is not null")
def a26_advantages(spark, d):
    df = table(spark, d, "events").where("value is not null")
    return df.select("user_id", "event_id", F.round(stats.advantages(df, "user_id", "value"), 9).alias("advantage"))


@query("select coalesce(least(cast(nullif(regexp_extract(trim(x), '^([0-9])', 1), '') as int), 5) / 5.0, 0.0) as score, count(*) as n from (select case when conv_id % 3 = 0 then 'none' else (conv_id % 10)::varchar || ' because' end as x from instruct_pairs) group by 1")
def a27_judge_scores(spark, d):
    x = F.when(F.col("conv_id") % 3 == 0, "none").otherwise(F.concat((F.col("conv_id") % 10).cast("string"), F.lit(" because")))
    return table(spark, d, "instruct_pairs").groupBy(stats.judge_score(x).alias("score")).agg(F.count("*").alias("n"))


@query("select source, round(coalesce(avg(case when domain = 'optics' then k end), 0), 6) as optics, round(coalesce(avg(case when domain = 'heat' then k end), 0), 6) as heat, round((coalesce(avg(case when domain = 'optics' then k end), 0) + coalesce(avg(case when domain = 'heat' then k end), 0)) / 2, 6) as mean from (select source, domain, conv_id % 6 as k from instruct_pairs) group by source")
def a19_judge_pivot(spark, d):
    p = table(spark, d, "instruct_pairs").withColumn("k", F.col("conv_id") % 6).groupBy("source").pivot("domain", ["optics", "heat"]).agg(F.avg("k")).fillna(0)
    return p.select("source", F.round("optics", 6).alias("optics"), F.round("heat", 6).alias("heat"), F.round((F.col("optics") + F.col("heat")) / 2, 6).alias("mean"))


@query("select event_type, round(avg(acc), 6) as accuracy, round((avg(acc) - 0.01 * 25) / (1 - 0.01 * 25), 6) as centered from (select event_type, (event_id % 3 = 0)::int as acc from events) group by 1")
def a17_centered_accuracy(spark, d):
    acc = F.avg((F.col("event_id") % 3 == 0).cast("int"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(acc, 6).alias("accuracy"), F.round(stats.centered(acc, F.lit(25)), 6).alias("centered"))


@query("select user_id, bool_or(event_type = 'error') as any_hit, count(*) as n from events group by 1")
def a18_pass_at_k(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("any_hit"), F.count("*").alias("n"))
