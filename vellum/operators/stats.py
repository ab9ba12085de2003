"""Aggregations: token priors and document scores, summaries, histograms, balance, rewards, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import checkpointed, values_at, with_rank


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0)


def exploded(df: DataFrame, id_cols: list[str], text: Column) -> DataFrame:
    return df.select(*id_cols, F.explode(words(text)).alias("token"))


def priors(tokens: DataFrame) -> DataFrame:
    """token, cnt, log2_prior over all tokens."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("token", "cnt", F.log2(F.col("cnt") / F.col("total")).alias("log2_prior"))


#: A token table of up to so many rows (some ten MB) is sent to the documents; beyond, documents' counts are shuffled by token.
FEW_TOKENS = 200_000


def document_scores(df: DataFrame, id_cols: list[str], text: Column, table: DataFrame) -> DataFrame:
    """Mean and population deviation of the tokens' priors and their number, a row a document; 0, 0, 0 without tokens.

    The token table is made once and counted. If it is small it goes to the documents, and only a row a document is
    shuffled. Else document and token are counted together first, so a frequent token travels once a document, and the
    counts are joined by token, where a token that many documents share is split at run time. The exploded side is
    never broadcast: the table is the inner side of a left join.
    """
    known = checkpointed(table.select("token", "log2_prior"))
    words_of = df.select(*id_cols, F.explode_outer(words(text)).alias("token"))
    if known.count() <= FEW_TOKENS:
        joined = words_of.withColumn("k", F.lit(1)).join(F.broadcast(known), "token", "left")
    else:
        joined = words_of.groupBy(*id_cols, "token").agg(F.count("*").alias("k")).hint("merge").join(known, "token", "left")
    k = F.when(F.col("log2_prior").isNotNull(), F.col("k").cast("bigint")).otherwise(0)
    sums = joined.groupBy(*id_cols).agg(F.sum(k).alias("n_tokens"), F.sum(k * F.col("log2_prior")).alias("s"), F.sum(k * F.col("log2_prior") ** 2).alias("q"))
    mean = F.col("s") / F.col("n_tokens")
    std = F.sqrt(F.greatest(F.col("q") / F.col("n_tokens") - mean * mean, F.lit(0.0)))
    some = F.col("n_tokens") > 0
    return sums.select(*id_cols, "n_tokens", F.when(some, mean).otherwise(0.0).alias("mean_prior"), F.when(some, std).otherwise(0.0).alias("std_prior"))


def prior_verdict(mean: Column, n: Column, low: float = -11.36, high: float = -9.91) -> Column:
    return F.when((n == 0) | (mean < low), "low").when(mean > high, "high").otherwise("keep")


def summary(df: DataFrame, c: Column, points: list[float]) -> DataFrame:
    """Count, mean, population deviation, extremes and linear percentiles; null percentiles without values.

    The percentiles are read off a distributed sort at the few ranks they need, not gathered in one aggregate.
    """
    v = df.select(c.cast("double").alias("v")).where("v is not null")
    base = v.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    n = v.count()
    at = {p: p * (n - 1) for p in points}
    values = values_at(v, "v", [r for x in at.values() for r in (int(x), min(int(x) + 1, n - 1))]) if n else {}

    def linear(p: float) -> float | None:
        if not n:
            return None
        lo, hi = values[int(at[p])], values[min(int(at[p]) + 1, n - 1)]
        return lo + (hi - lo) * (at[p] - int(at[p]))

    return base.select("*", *[F.lit(linear(p)).cast("double").alias(f"p{round(p * 100)}") for p in points])


def histogram(df: DataFrame, c: Column, bins: int = 30) -> DataFrame:
    """Equal-width bins from least to greatest; the last is closed."""
    v = df.select(c.cast("double").alias("v")).where("v is not null")
    edge = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1, F.lit(bins)))
    return v.join(F.broadcast(edge), F.lit(True)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def nearest_rank(df: DataFrame, by: list[str], c: str, points: list[int]) -> DataFrame:
    """Per group sorted[min(floor(n * p / 100), n - 1)]; groups may be few and large, none is gathered in one task."""
    ranked = with_rank(df.where(F.col(c).isNotNull()).select(*by, F.col(c).alias("v")), by, ["v"], "r", "n")
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("r") == F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("v"))).alias(f"p{p}") for p in points])


def balance(df: DataFrame, shard: Column, size: Column) -> DataFrame:
    """Shards, average, least and greatest size, imbalance percent, estimated tokens."""
    per = df.groupBy(shard.alias("shard")).agg(F.sum(size).alias("chars"))
    return per.agg(
        F.count("*").alias("n_shards"), F.avg("chars").alias("avg_chars"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"),
        ((F.max("chars") - F.min("chars")) / F.avg("chars") * 100).alias("imbalance_pct"), F.floor(F.sum("chars") / 4.2).alias("est_tokens"),
    )


def advantages(df: DataFrame, group: str, reward: str, normalised: bool = False) -> Column:
    """Reward less its group's mean, divided by the sample deviation plus 1e-4 if asked."""
    w = Window.partitionBy(group)
    diff = F.col(reward) - F.avg(reward).over(w)
    return diff / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)) + 1e-4) if normalised else diff


def bits_per_byte(df: DataFrame, nats: Column, n_bytes: Column, target: Column) -> DataFrame:
    """Sum of nats of targets with bytes over ln 2 times their bytes; infinite without bytes."""
    use = (target >= 0) & (n_bytes > 0)
    size = F.sum(F.when(use, n_bytes).otherwise(0))
    return df.agg(F.when(size > 0, F.sum(F.when(use, nats).otherwise(0.0)) / (F.log(F.lit(2.0)) * size)).otherwise(float("inf")).alias("bits_per_byte"))


def centered(acc: Column, baseline_pct: Column) -> Column:
    return (acc - 0.01 * baseline_pct) / (1 - 0.01 * baseline_pct)


def judge_score(c: Column) -> Column:
    """First digit of a reply clamped to 0..5, over 5; 0 without one."""
    return F.coalesce(F.least(F.nullif(F.regexp_extract(F.trim(c), r"^([0-9])", 1), F.lit("")).cast("int"), F.lit(5)) / 5.0, F.lit(0.0))


def smoothed(df: DataFrame, group: str, order: list[str], value: str, beta: float = 0.9) -> DataFrame:
    """Debiased exponential mean of an ordered series of each group, at its end."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value])
    state = lambda v, n: F.struct(v.cast("double").alias("v"), n.cast("int").alias("n"))
    folded = F.aggregate(seq, state(F.lit(0.0), F.lit(0)), lambda a, x: state(a["v"] * beta + x * (1 - beta), a["n"] + 1))
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(folded.alias("s")).select(group, (F.col("s.v") / (1 - F.pow(F.lit(beta), F.col("s.n")))).alias("ema"), F.col("s.n").alias("n"))


def ridge(df: DataFrame, group: list[str], x: Column, y: Column, penalty: float) -> DataFrame:
    """Slope, intercept and r2 of y on x with the squared slope penalised by ``penalty``: closed form from five sums."""
    s = df.where(x.isNotNull() & y.isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.covar_pop(x, y) * F.count("*")).alias("sxy"), (F.var_pop(x) * F.count("*")).alias("sxx"), (F.var_pop(y) * F.count("*")).alias("syy"))
    slope = F.col("sxy") / (F.col("sxx") + F.lit(penalty))
    rest = F.col("syy") - 2 * slope * F.col("sxy") + slope * slope * F.col("sxx")
    return s.select(*group, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.when(F.col("syy") > 0, 1 - rest / F.col("syy")).alias("r2"))
