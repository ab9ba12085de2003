"""Reliable checkpoints, dense order and other plumbing that operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where it is unset (tests, one machine) a local folder, removed at the end.

    On a cluster ``spark.cleaner.referenceTracking.cleanCheckpoints`` should be true, so that files go with their frames.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if configured is None:
        configured = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder, so that a lost executor costs no recomputation of the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A file scan of few partitions dealt over the cores; a scan of many, as any large one, is left alone.

    Small tables come as one file of one row group, which one task would read and compute.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def with_index(df: DataFrame, *order: str | Column, name: str = "idx", key: str | None = None) -> DataFrame:
    """Dense 0-based position in the given total order, without a single-partition window.

    Rows are range-partitioned and sorted once and kept; each partition's rows then count from the
    number of rows in the partitions before it (one small row a partition). With a unique non-null ``key`` only the
    key and the order travel, and the position is joined to the rows.
    """
    if key is not None:
        slim = [c if isinstance(c, Column) else F.col(c) for c in order]
        ranked = with_index(df.select(key, *[c.alias(f"__o{i}") for i, c in enumerate(slim)]), *[f"__o{i}" for i in range(len(slim))], name=name)
        return df.join(ranked.select(key, name), key)
    mid = F.monotonically_increasing_id()
    kept = checkpointed(df.sort(*order).withColumn("__m", mid))
    part = F.shiftright("__m", 33)
    inner = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("__p")).count()
    before = F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__b"))
    return kept.withColumn("__p", part).join(F.broadcast(base), "__p").withColumn(name, F.col("__b") + inner).drop("__m", "__p", "__b")


FEW_GROUPS = 100_000


def with_rank(df: DataFrame, by: list[str], order: list[str], name: str = "rank", total: str = "total") -> DataFrame:
    """0-based rank of each row within its group, and the group's rows, by the dense position of (group, order).

    No group is gathered in one task, however large; null groups are one group.
    """
    ranked = with_index(df, *by, *order, name="__at")
    keys = [f"__g{i}" for i in range(len(by))]
    groups = ranked.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(F.min("__at").alias("__lo"), F.count("*").alias(total))
    groups = checkpointed(groups)
    cond = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
    # few groups, as large ones mostly are, go to the rows, which then stay where they are
    out = ranked.join(F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups, cond)
    return out.withColumn(name, F.col("__at") - F.col("__lo")).drop("__at", "__lo", *keys)


def values_at(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """Values at the given 0-based ranks of a non-null column: a distributed sort, a value a rank to the driver."""
    ranked = with_index(df.select(column), column)
    return {r["idx"]: r[column] for r in ranked.where(F.col("idx").isin(sorted(set(ranks)))).collect()}


def hash_order(*cols: str) -> Column:
    """A stable pseudo-random order of rows by key: md5, which other engines share."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def lit_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
