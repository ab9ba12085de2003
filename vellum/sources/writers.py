"""Sinks: rolling shards, split JSON lines, resumable partitions, report text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.runtime import with_index


def shards(df: DataFrame, path: str, rows_per_file: int, group_bytes: int = 8 << 20) -> None:
    """Parquet shards of at most ``rows_per_file`` rows; Spark's commit protocol makes them whole or absent."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("parquet.block.size", group_bytes).parquet(path)


def closed_shards(df: DataFrame, size_col: str, least_size: int, multiple: int) -> DataFrame:
    """Rows with ``shard``: in each task's order a shard closes once it holds ``least_size`` and a multiple of ``multiple`` rows.

    Sizes are summed within a task, so shards never span two; null sizes count as 0. The last shard of a task may be short.
    """
    fields = df.schema.fields
    at = df.columns.index(size_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, held, rows = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            sizes = batch.column(at).fill_null(0).to_pylist()
            names = []
            for n in sizes:
                names.append(f"{part:05}-{shard:05}")
                held, rows = held + n, rows + 1
                if held >= least_size and rows % multiple == 0:
                    shard, held, rows = shard + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, "shard"])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField("shard", T.StringType())]))


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log table; new columns may come with them."""
    df.write.mode("append").parquet(path)


def split_lines(df: DataFrame, path: str, split_col: str = "split") -> None:
    """JSON lines, one folder a split (train, val, rejected)."""
    df.write.mode("overwrite").partitionBy(split_col).json(path)


def missing_partitions(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose partition is not yet written: resumed work."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(F.col(key).cast(df.schema[key].dataType)).distinct()
    except Exception:  # noqa: BLE001 - nothing written yet
        return df
    return df.join(done, key, "left_anti")


def remainder(df: DataFrame, order: list[str], group: int) -> DataFrame:
    """The rows after the last full group, which go to validation."""
    rows = with_index(df, *order)
    n = rows.count()
    return rows.where(F.col("idx") >= n - n % group).drop("idx")


def report_value(x: object) -> str:
    """Floats to four places, integers from 10,000 with commas."""
    if isinstance(x, float):
        return f"{x:.4f}"
    return f"{x:,}" if isinstance(x, int) and abs(x) >= 10_000 else str(x)


def report_section(title: str, rows: list[tuple[str, object]]) -> str:
    return "\n".join([f"## {title}", "", *(f"- {k}: {report_value(v)}" for k, v in rows), ""])
