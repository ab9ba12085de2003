"""Deterministic sampling, splits, mixtures and balanced sharding. Chance is md5 of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import with_index, with_rank


def chance(key: Column, seed: int = 0) -> Column:
    """A number in [0, 65536) from the key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 4), 16, 10).cast("int")


def bernoulli_split(df: DataFrame, key: Column, share: float, seed: int = 0) -> DataFrame:
    return df.withColumn("split", F.when(chance(key, seed) < int(share * 65536), "val").otherwise("train"))


def share_split(df: DataFrame, key: Column, share: float, by: list[str] | None = None, small_group: int = 0) -> DataFrame:
    """The first max(1, floor(n * share)) rows in hashed order are validation, per group if given; groups of at most ``small_group`` all train."""
    keyed = df.withColumn("__h", F.md5(key.cast("string"))).withColumn("__k", key)
    if by is None:
        ranked = with_index(keyed, "__h", "__k", name="__i")
        n = ranked.count()
        return ranked.withColumn("split", F.when(F.col("__i") < max(1, int(n * share)), "val").otherwise("train")).drop("__h", "__k", "__i")
    ranked = with_rank(keyed, by, ["__h", "__k"], "__i", "__n").drop("__h", "__k")
    val = (F.col("__n") > small_group) & (F.col("__i") < F.greatest(F.lit(1), F.floor(F.col("__n") * share)))
    return ranked.withColumn("split", F.when(val, "val").otherwise("train")).drop("__i", "__n")


def group_split(df: DataFrame, group: str, share: float) -> DataFrame:
    """Split by group and give every row its group's side."""
    sides = share_split(df.select(group).distinct(), F.col(group), share)
    return df.join(sides, group)


def per_group(df: DataFrame, by: list[str], key: Column, n: int) -> DataFrame:
    """At most n rows of each group, the first in hashed order.

    The limit on the row number makes every task keep its own first n of a group before the shuffle.
    """
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(key.cast("string")), key))).where(F.col("__i") <= n).drop("__i")


def thinned(df: DataFrame, cls: Column, key: Column, shares: dict[str, float]) -> DataFrame:
    """Rows of listed classes kept with their share, others all."""
    keep = F.lit(65536)
    for name, share in shares.items():
        keep = F.when(cls == name, int(share * 65536)).otherwise(keep)
    return df.where(chance(key) < keep)


def balanced_shards(df: DataFrame, size: Column, key: str, n_shards: int) -> DataFrame:
    """Rows dealt round over shards in order of size, so shards have like totals; ``key`` is unique and alone sorted with the size."""
    sized = with_index(df.withColumn("__s", size), "__s", key, name="__i", key=key)
    return sized.withColumn("shard", F.pmod("__i", F.lit(n_shards)).cast("int")).drop("__s", "__i")


def within_budget(df: DataFrame, order: list, size: Column, budget: int, strict: bool = False) -> DataFrame:
    """Rows in order until their sizes exceed the budget; the row that exceeds it is the last, unless strict."""
    ranked = with_index(df.withColumn("__z", size.cast("long")), *order, name="__i")
    per = ranked.withColumn("__b", F.floor(F.col("__i") / 10_000))
    sums = per.groupBy("__b").agg(F.sum("__z").alias("__t"))
    base = sums.select("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    run = F.sum("__z").over(Window.partitionBy("__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = per.withColumn("__run", run).join(base, "__b").withColumn("__run", F.col("__run") + F.col("__base"))
    keep = F.col("__run") <= budget if strict else (F.col("__run") - F.col("__z")) <= budget
    return out.where(keep).drop("__z", "__i", "__b", "__run", "__base")


def sliced(df: DataFrame, order: list, start: int, stop: int, step: int) -> DataFrame:
    """Rows start, start + step, ... below stop of the order."""
    return with_index(df, *order).where((F.col("idx") >= start) & (F.col("idx") < stop) & ((F.col("idx") - start) % step == 0))


def mixed(parts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Union of named parts with a dense position in hashed order: a task mixture."""
    union = None
    for i, (name, df) in enumerate(parts):
        one = df.withColumn("part", F.lit(name)).withColumn("part_no", F.lit(i))
        union = one if union is None else union.unionByName(one)
    return with_index(union.withColumn("__h", F.md5(F.concat_ws("|", F.col("part_no").cast("string"), F.col(key).cast("string")))), "__h", "part_no", key).drop("__h")


def group_validation(df: DataFrame, group: str, share: float, seed: int = 0) -> DataFrame:
    """Whole groups (files, shards) are validation, taken in hashed order until they hold ``share`` of the rows, at least one row.

    The group in which the target is reached is the last. Only group sizes are ordered and summed.
    """
    sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("__g").cast("string"), F.lit(""))))
    picked = within_budget(sizes.withColumn("__h", order), ["__h", "__g"], F.col("__n"), max(1, int(total * share)) - 1)
    marked = picked.select("__g", F.lit(True).alias("__v"))
    out = df.join(marked, F.col(group).eqNullSafe(F.col("__g")), "left")
    return out.withColumn("split", F.when(F.col("__v"), "val").otherwise("train")).drop("__g", "__v")


def block_sample(df: DataFrame, block: Column, keep: Column, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows that pass ``keep``: blocks (row groups) are scanned in hashed order until 2 n rows pass, then n of these are taken in hashed order."""
    blocks = df.withColumn("__blk", block)
    passing = blocks.where(keep)
    sizes = passing.groupBy("__blk").agg(F.count("*").alias("__n")).withColumn("__h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("__blk").cast("string"))))
    scanned = within_budget(sizes, ["__h", "__blk"], F.col("__n"), 2 * n - 1).select("__blk")
    return passing.join(scanned, "__blk", "left_semi").orderBy(F.md5(F.col(key).cast("string")), key).limit(n).drop("__blk")
