"""Writing that can be repeated: rows merged by key, published as a new version of a table or partition by partition.

A published table is a folder of versions. A writer claims the next number (of two writers one fails), writes the version
and thereby, with its _SUCCESS file, makes it the current one: readers see the old or the new table, never a
part or none. Nothing is renamed, so object stores serve too. A table with partitions is written in place, and
only the partitions that the updates touch are rewritten.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.runtime import checkpoint


def merge_by_key(existing: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing without the rows whose key is in updates, plus updates. Null keys are equal to each other."""
    named = updates.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    kept = existing.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def merge_counts(existing: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many of the updates are new and how many replace a row."""
    named = existing.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_there")).distinct()
    joined = updates.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return joined.agg(F.count_if(F.col("_there").isNull()).alias("created"), F.count("_there").alias("updated"))


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of the table at path, oldest first."""
    hadoop, fs = _folder(spark, path)
    if not fs.exists(hadoop(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop(path))]
    numbers = [int(n[8:]) for n in names if re.fullmatch(r"version-[0-9]+", n)]
    return sorted(n for n in numbers if fs.exists(hadoop(f"{path}/version-{n:09d}/_SUCCESS")))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of the table at path, or its partitions; None if there is none."""
    there = versions(spark, path)
    if there:
        return spark.read.parquet(f"{path}/version-{there[-1]:09d}")
    hadoop, fs = _folder(spark, path)
    files = fs.exists(hadoop(path)) and any("=" in s.getPath().getName() for s in fs.listStatus(hadoop(path)))
    return spark.read.parquet(path) if files else None


def publish(df: DataFrame, path: str, after: int | None = None, keep: int = 2) -> int:
    """Writes df as the next version of the table at path and gives its number; older versions but `keep` are deleted.

    `after` is the version that df was made from: if another writer has published since, this one fails.
    """
    spark = df.sparkSession
    hadoop, fs = _folder(spark, path)
    there = versions(spark, path)
    current = there[-1] if there else 0
    if after is not None and after != current:
        raise RuntimeError(f"{path} has version {current}, not {after}")
    fs.mkdirs(hadoop(f"{path}/_claims"))
    claim = hadoop(f"{path}/_claims/{current + 1}")
    try:
        fs.create(claim, False).close()
    except Exception as e:
        raise RuntimeError(f"another writer has claimed version {current + 1} of {path}; delete {claim.toString()} if it is gone") from e
    try:
        df.write.mode("overwrite").parquet(f"{path}/version-{current + 1:09d}")
    finally:
        fs.delete(claim, False)
    for old in there[: max(0, len(there) + 1 - keep)]:
        fs.delete(hadoop(f"{path}/version-{old:09d}"), True)
    return current + 1


def upsert(updates: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str] = ()) -> None:
    """Merges updates into the table at path by key (null keys are equal); running it again changes nothing.

    Columns that only the table has are kept, null in the updates; columns that only the updates have are added. With
    `partitions`, which must be keys without nulls, only the partitions of the updates are read and rewritten.
    """
    spark = updates.sparkSession
    if not set(partitions) <= set(keys):
        raise ValueError("partitions must be keys, so that no row changes its partition")
    there = versions(spark, path)
    existing = stored(spark, path)
    if not partitions:
        publish(updates if existing is None else merge_by_key(existing, updates, keys), path, there[-1] if there else 0)
        return
    if existing is not None:
        touched = updates.select(*partitions).distinct()
        updates = checkpoint(merge_by_key(existing.join(touched, list(partitions), "left_semi"), updates, keys))
    updates.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def delete_where(path: str, spark: SparkSession, condition: str) -> None:
    """Publishes the table without the rows for which condition is true; null is not true."""
    there = versions(spark, path)
    if there:
        publish(stored(spark, path).where(~F.coalesce(F.expr(condition), F.lit(False))), path, there[-1])
