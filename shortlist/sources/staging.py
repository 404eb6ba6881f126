"""Tables and row numbers that outlive the plan that made them, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; on a local master, a new temporary folder if neither is set."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if found:
        return found
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="shortlist-")
    context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: the lineage ends there, and lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``df`` with consecutive numbers from 0 in the given order, as column ``name``.

    Rows are dealt by ranges of the order and sorted within each; Spark's own row ids then hold the
    partition and the place in it. The sizes of the partitions, one row each, are added up
    to offsets. No task holds more than its range. Rows that tie in ``order`` are all in
    one range and get numbers in any order: give a total order for numbers that do not change between runs.
    """
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    part, inside = F.shiftright("__row", 33), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("__part")).agg(F.max(inside).alias("last"))
    before, offsets = 0, []
    for r in sorted(sizes.collect()):  # a row for each partition
        offsets.append((r["__part"], before))
        before += r["last"] + 1
    offset = df.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    joined = rows.withColumn("__part", part).join(F.broadcast(offset), "__part")  # a row for each partition
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__offset") + inside).alias(name))
