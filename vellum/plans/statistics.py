"""Queries of corpus statistics, logs and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.runtime import table
from ..operators import stats
from ..streaming import logs
from .registry import query

_TOK = "(select doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents)"
_PRI = f"(select token, count(*) as cnt, log2(count(*) / (select count(*) from {_TOK})) as log2_prior from {_TOK} group by token)"


@query(f"select token, cnt, round(log2_prior, 6) as log2_prior from {_PRI}")
def a01_token_priors(spark, d):
    p = stats.priors(stats.exploded(table(spark, d, "documents"), [], F.col("text")))
    return p.select("token", "cnt", F.round("log2_prior", 6).alias("log2_prior"))


def _scores(spark, d):
    df = table(spark, d, "documents")
    return stats.document_scores(df, ["doc_id", "source"], F.col("text"), stats.priors(stats.exploded(df, [], F.col("text"))))


_SC = f"(select doc_id, source, coalesce(n, 0) as n_tokens, coalesce(m, 0) as mean_prior, coalesce(s, 0) as std_prior from documents left join (select doc_id, count(*) as n, avg(log2_prior) as m, stddev_pop(log2_prior) as s from {_TOK} join {_PRI} using (token) group by doc_id) using (doc_id))"


@query(f"select doc_id, n_tokens, round(mean_prior, 4) as mean_prior, round(std_prior, 4) as std_prior from {_SC} where source is not null")
def a02_document_priors(spark, d):
    return _scores(spark, d).where("source is not null").select("doc_id", "n_tokens", F.round("mean_prior", 4).alias("mean_prior"), F.round("std_prior", 4).alias("std_prior"))


@query("select count(*) as n, round(avg(v), 5) as mean, round(stddev_pop(v), 5) as std, min(v) as min, max(v) as max, " + ", ".join(f"quantile_cont(v, {p / 100}) as p{p}" for p in (1, 5, 25, 50, 75, 95, 99)) + " from (select n_chars::double as v from documents where n_chars is not null)")
def a03_length_summary(spark, d):
    s = stats.summary(table(spark, d, "documents"), F.col("n_chars"), [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
    return s.withColumn("mean", F.round("mean", 5)).withColumn("std", F.round("std", 5))


@query("select source, count(*) as n, round(avg(n_chars), 5) as mean_chars, median(n_chars) as median_chars, round(stddev_pop(n_chars), 5) as std_chars from documents group by source")
def a04_source_breakdown(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 5).alias("mean_chars"), F.percentile("n_chars", 0.5).alias("median_chars"), F.round(F.stddev_pop("n_chars"), 5).alias("std_chars"))


@query("select least(floor((v - lo) / ((hi - lo) / 30)) + 1, 30)::int as bin, count(*) as n from (select n_chars::double as v from documents where n_chars is not null), (select min(n_chars)::double as lo, max(n_chars)::double as hi from documents) group by 1")
def a05_length_histogram(spark, d):
    return stats.histogram(table(spark, d, "documents"), F.col("n_chars"))


@query("select p, doc_id from (select doc_id, row_number() over (order by n_chars, doc_id) - 1 as r, count(*) over () as n from documents where n_chars is not null), (select unnest([1, 10, 50, 90, 99]) as p) where r = floor(p * n / 100)")
def a06_rank_examples(spark, d):
    from ..functions.runtime import with_index

    r = with_index(table(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars"), "n_chars", "doc_id")
    n = r.count()
    want = {int(p * n // 100): p for p in (1, 10, 50, 90, 99)}
    return r.where(F.col("idx").isin(list(want))).select(F.element_at(F.create_map(*[F.lit(x) for kv in want.items() for x in kv]), F.col("idx").cast("int")).alias("p"), "doc_id")


@query("select sum(case when v between p1 and p99 then 1 else 0 end) as kept_98, sum(case when v between p5 and p95 then 1 else 0 end) as kept_90, sum(case when v between p10 and p90 then 1 else 0 end) as kept_80, count(*) as n from (select n_chars::double as v from documents where n_chars is not null), (select quantile_cont(n_chars::double, 0.01) as p1, quantile_cont(n_chars::double, 0.99) as p99, quantile_cont(n_chars::double, 0.05) as p5, quantile_cont(n_chars::double, 0.95) as p95, quantile_cont(n_chars::double, 0.1) as p10, quantile_cont(n_chars::double, 0.9) as p90 from documents)")
def a07_filter_what_if(spark, d):
    v = table(spark, d, "documents").where("n_chars is not null").select(F.col("n_chars").cast("double").alias("v"))
    p = stats.summary(v, F.col("v"), [0.01, 0.05, 0.1, 0.9, 0.95, 0.99])
    kept = lambda a, b: F.sum(F.when(F.col("v").between(F.col(a), F.col(b)), 1).otherwise(0))
    return v.join(F.broadcast(p), F.lit(True)).agg(kept("p1", "p99").alias("kept_98"), kept("p5", "p95").alias("kept_90"), kept("p10", "p90").alias("kept_80"), F.count("*").alias("n"))


@query(f"select token, cnt from {_PRI} order by cnt desc, token limit 20")
def a08_top_tokens(spark, d):
    p = stats.priors(stats.exploded(table(spark, d, "documents"), [], F.col("text")))
    return p.orderBy(F.desc("cnt"), "token").limit(20).select("token", "cnt")


@query("select source, lang, count(*) as n, sum(n_chars) as n_chars from documents group by rollup (source, lang)")
def a09_rollup_report(spark, d):
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("select count(*) as n_shards, round(avg(c), 5) as avg_chars, min(c) as min_chars, max(c) as max_chars, round((max(c) - min(c)) / avg(c) * 100, 5) as imbalance_pct, floor(sum(c) / 4.2)::bigint as est_tokens from (select doc_id % 16 as shard, sum(n_chars) as c from documents group by 1)")
def a10_shard_balance(spark, d):
    b = stats.balance(table(spark, d, "documents"), F.pmod("doc_id", F.lit(16)), F.col("n_chars"))
    return b.withColumns({"avg_chars": F.round("avg_chars", 5), "imbalance_pct": F.round("imbalance_pct", 5)})


@query("select coalesce(year, 0) as year, sum(floor(coalesce(n_chars, 0) / 4.2))::bigint as est_tokens from documents group by 1")
def a11_tokens_by_year(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce("year", F.lit(0)).alias("year")).agg(F.sum(F.floor(F.coalesce("n_chars", F.lit(0)) / 4.2)).alias("est_tokens"))


@query("select coalesce(year // 10 * 10, 0) as decade, count(*) as n from documents group by 1")
def a12_decades(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce(F.floor(F.col("year") / 10) * 10, F.lit(0)).alias("decade")).agg(F.count("*").alias("n"))


@query("select event_type, max(n) as n, " + ", ".join(f"max(case when r = least(floor(n * {p} / 100), n - 1) then value end) as p{p}" for p in (50, 95, 99)) + " from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as r, count(*) over (partition by event_type) as n from events where value is not null) group by 1")
def a15_nearest_rank(spark, d):
    return stats.nearest_rank(table(spark, d, "events"), ["event_type"], "value", [50, 95, 99])


@query("select count(*) filter (ts > m - interval 1 minute) as last_1, count(*) filter (ts > m - interval 5 minute) as last_5, count(*) filter (ts > m - interval 60 minute) as last_60, count(*) filter (ts > m - interval 1440 minute) as last_1440, count(*) filter (ts > m - interval 1440 minute and event_type = 'error') as errors, count(*) as total from events, (select max(ts) as m from events)")
def a15_log_windows(spark, d):
    return logs.look_back(table(spark, d, "events"))


@query("select sum(case when event_id % 5 <> 0 and l > 0 then value else 0 end) / (ln(2) * sum(case when event_id % 5 <> 0 and l > 0 then l else 0 end)) as bits_per_byte from (select event_id, coalesce(value, 0) as value, length(event_type) as l from events)")
def a16_bits_per_byte(spark, d):
    df = table(spark, d, "events").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return stats.bits_per_byte(df, F.col("value"), F.octet_length("event_type"), F.when(F.col("event_id") % 5 == 0, -1).otherwise(1))


@query("select l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 5) as slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 4) as intercept, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 5) as r2 from lineitem where l_quantity > 0 and l_extendedprice > 0 group by 1")
def a22_power_law(spark, d):
    y, x = F.log("l_extendedprice"), F.log("l_quantity")
    return table(spark, d, "lineitem").where("l_quantity > 0 and l_extendedprice > 0").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 5).alias("r2"))


@query("select label, count(*) as n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 4) as mean_norm from embeddings group by label")
def a24_vector_norms(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 4).alias("mean_norm"))


@query("select count(*) as n_texts, sum(octet_length(encode(text))) as n_bytes, round(sum(octet_length(encode(text))) / sum(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+'))), 6) as bytes_per_piece from documents where text is not null")
def a20_compression(spark, d):
    pieces = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[0-9]+"), 0))
    return table(spark, d, "documents").where("text is not null").agg(F.count("*").alias("n_texts"), F.sum(F.octet_length("text")).alias("n_bytes"), F.round(F.sum(F.octet_length("text")) / F.sum(pieces), 6).alias("bytes_per_piece"))


@query("select min(octet_length(encode(event_type))) as shortest, max(octet_length(encode(event_type))) as longest, round(avg(octet_length(encode(event_type))), 6) as mean, round(stddev_samp(octet_length(encode(event_type))), 6) as std from events where length(event_type) > 0")
def a21_byte_lengths(spark, d):
    n = F.octet_length("event_type")
    return table(spark, d, "events").where(F.length("event_type") > 0).agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("std"))


@query("with recursive s as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events where value is not null), r as (select user_id, i, 0.1 * value as e from s where i = 1 union all select s.user_id, s.i, 0.9 * r.e + 0.1 * s.value from r join s on s.user_id = r.user_id and s.i = r.i + 1) select user_id, round(arg_max(e, i) / (1 - pow(0.9, max(i))), 5) as ema, max(i) as n from r group by 1")
def w07_smoothed(spark, d):
    e = stats.smoothed(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value")
    return e.select("user_id", F.round("ema", 5).alias("ema"), F.col("n").cast("bigint").alias("n"))


@query("select lang, domain, round(avg(v), 5) as mean_log from (select lang, domain, ln(n_chars) as v from documents where n_chars > 0) group by all")
def a30_log_ratio_table(spark, d):
    return table(spark, d, "documents").where("n_chars > 0").groupBy("lang", "domain").agg(F.round(F.avg(F.log("n_chars")), 5).alias("mean_log"))


@query("select user_id, count(*) as n_sessions, max(k) as longest from (select user_id, s, count(*) as k from (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 30 minute then 1 else 0 end as new from events)) group by 1, 2) group by 1")
def g03_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("new", F.when(F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 minute"), 1).otherwise(0))
    s = e.withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy("user_id", "s").agg(F.count("*").alias("k"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("k").alias("longest"))
