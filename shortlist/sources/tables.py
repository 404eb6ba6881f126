"""Versioned tables on a shared path: writes, updates by key and deletes, each as a new version.

A version is a folder ``v<number>`` that counts once Spark's writer has committed it
(``_SUCCESS``), so a reader sees the last whole version while the next one is written, and
a failed write leaves no trace in what is read. A table has one writer at a time: two would
take the same number. An update by key or a delete writes the whole table anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from shortlist.operators.lifecycle import update_by_key


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole versions, in order."""
    where, system = _files(spark, path)
    if not system.exists(where):
        return []
    names = [f.getPath().getName() for f in system.listStatus(where)]
    whole = [n for n in names if n[:1] == "v" and n[1:].isdigit() and system.exists(_files(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(int(n[1:]) for n in whole)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The last whole version."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/v{known[-1]}")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> None:
    """``df`` as the next version; of the versions before it the last ``keep`` - 1 stay, so that running readers can end."""
    spark = df.sparkSession
    known = versions(spark, path)
    number = known[-1] + 1 if known else 0
    writer = df.write.mode("overwrite")  # what a failed write left goes
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/v{number}")
    for old in known[: len(known) + 1 - keep]:
        where, system = _files(spark, f"{path}/v{old}")
        system.delete(where, True)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """``df`` as a catalogue table whose files are dealt and sorted by a hash of ``key``; what joins it by that key is shuffled to its
    buckets, and the table stays where it is. Give as many buckets as ``spark.sql.shuffle.partitions`` or more, else both sides may move.
    """
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def update_table(spark: SparkSession, path: str, changes: DataFrame, key: str, rules: dict[str, Column], partition_by: list[str] | None = None) -> None:
    """``update_by_key`` on the table."""
    write_table(update_by_key(read_table(spark, path), changes, key, rules), path, partition_by)


def delete_rows(spark: SparkSession, path: str, condition: Column, partition_by: list[str] | None = None) -> int:
    """Rows that meet ``condition`` go (rows for which it is null stay); returns how many."""
    from pyspark.sql import functions as F

    before = read_table(spark, path)
    gone = F.coalesce(condition, F.lit(False))
    count = before.where(gone).count()
    write_table(before.where(~gone), path, partition_by)
    return count
