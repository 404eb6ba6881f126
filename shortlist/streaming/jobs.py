"""Streaming jobs: each runs on a file source until it is drained (``availableNow``) or for good."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from shortlist.operators.dedup import first_per_key
from shortlist.operators.digest import HISTORY, history_rows, split_by_history, with_fingerprints
from shortlist.sources.committed import CommittedLines

SINKS: dict[str, Callable[[DataFrame, str], None]] = {}


def register_sink(name: str):
    """Register a sink (DataFrame, path) for digests, used by batches and by ``foreachBatch`` alike."""

    def keep(f):
        SINKS[name] = f
        return f

    return keep


@register_sink("text")
def to_text(lines: DataFrame, path: str) -> None:
    """Append digest lines as text files in the order of ``place``: what stands in a later part file comes later."""
    lines.repartitionByRange("place").sortWithinPartitions("place").select("line").write.mode("append").text(path)


@register_sink("parquet")
def to_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


@register_sink("committed")
def to_committed(rows: DataFrame, path: str) -> None:
    """Lines that count once the whole write has ended (``CommittedLines``)."""
    rows.sparkSession.dataSource.register(CommittedLines)
    rows.write.format("committed_lines").mode("append").save(path)


def source(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def stored(spark: SparkSession, path: str) -> list[str]:
    """The folders or files at a path, by name; none where there is no such path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint: the same after a restart, another one for a new checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def each_batch(rows: DataFrame, checkpoint: str, step: Callable[[DataFrame, str], None]) -> StreamingQuery:
    """Run ``step`` (batch, name) for each batch until the source is drained.

    A name is made of the stream's id and the number of the batch. So a batch that is replayed
    after a failure has its old name and may replace what it wrote, and the batches of
    another checkpoint never have that name, though their numbers start at 0 again.
    """

    def named(batch: DataFrame, number: int) -> None:
        step(batch, f"{stream_id(batch.sparkSession, checkpoint)}-{number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(named).start()


def enrich_stream(pending: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str | None = None) -> StreamingQuery:
    """Work on pending rows batch by batch until none is left; errors are rows of the result.

    Each batch has a folder of its own (``each_batch``). With ``key``, rows whose key an
    earlier batch or run has worked on are left out, so that a row costs its work once.
    """

    def step(batch: DataFrame, name: str) -> None:
        if key:
            batch = batch.join(_others(batch, path, name, key), key, "left_anti").select(*batch.columns)
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={name}")

    return each_batch(pending, checkpoint, step)


def _others(batch: DataFrame, path: str, name: str, key: str) -> DataFrame:
    """The keys that other batches stored at the path."""
    spark = batch.sparkSession
    kind = T.StructType([batch.schema[key]])
    others = [f"{path}/{x}" for x in stored(spark, path) if x.startswith("batch=") and x != f"batch={name}"]
    return spark.read.schema(kind).parquet(*others) if others else spark.createDataFrame([], kind)


def ingest_deduplicated(rows: DataFrame, key: str, time: str, keep: str = "14 days") -> DataFrame:
    """First row per key within the retention; the state is bounded by the watermark."""
    stamped = rows.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def ingest_exact(rows: DataFrame, path: str, checkpoint: str, key: str, order: list[str], buckets: int = 16) -> StreamingQuery:
    """First row per key over all time: each batch is checked against what earlier ones stored.

    Rows lie in folders by a hash of their key and, in these, by batch (``each_batch``): a
    batch reads the keys of its own buckets alone, replaces its rows when it is replayed,
    and sees what runs with other checkpoints stored. One stream at a time writes to a path.
    """

    def store(batch: DataFrame, name: str) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        fresh = first_per_key(batch, key, order).withColumns({"bucket": bucket, "batch": F.lit(name)})
        if stored(spark, path):
            layout = T.StructType([*batch.schema, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.StringType())])
            met = [r[0] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
            known = spark.read.schema(layout).parquet(path).where(F.col("bucket").isin(met) & (F.col("batch") != name)).select(key)
            fresh = fresh.join(known, key, "left_anti")
        # a bucket of many rows is written by several tasks
        writer = fresh.select(*batch.columns, "bucket", "batch").hint("rebalance", "bucket").write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic")
        writer.mode("overwrite").parquet(path)

    return each_batch(rows, checkpoint, store)


def _log(spark: SparkSession, history_path: str, without: str = "") -> DataFrame:
    """The rows of a history log but for those of one part."""
    parts = [f"{history_path}/{x}" for x in stored(spark, history_path) if x.startswith("part=") and x != f"part={without}"]
    return spark.read.schema(HISTORY_SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], HISTORY_SCHEMA)


def _send(rows: DataFrame, key: str, history_path: str, out_path: str, name: str) -> None:
    """Store what a batch sends, and its history; of postings that share a role the first goes out."""
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c not in ("seen", "primary_fp", "role_fp")]
    first_per_key(rows, "role_fp", [key]).select(*columns).write.mode("overwrite").parquet(f"{out_path}/batch={name}")
    back = spark.read.schema(rows.select(*columns).schema).parquet(f"{out_path}/batch={name}")
    history_rows(back, F.col("scored_at").cast("timestamp")).write.mode("overwrite").parquet(f"{history_path}/part={name}")


def suppress_reposts(rows: DataFrame, history_path: str, out_path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Pass on postings whose fingerprints the durable history does not know, and add them to it.

    The history is a log: every batch adds the rows of what it sent in a part named like the batch
    (``each_batch``), and a fingerprint in any part but its own is known. So a batch that is
    replayed gives the same rows again, and a run with a new checkpoint goes on with what earlier
    ones sent. ``compact_history`` gives one row a fingerprint, and ``rewrite_history`` makes the
    log that short. One stream at a time writes to a history.
    """

    def step(batch: DataFrame, name: str) -> None:
        fresh = split_by_history(batch, _log(batch.sparkSession, history_path, name), key).where(~F.col("seen"))
        _send(fresh, key, history_path, out_path, name)

    return each_batch(rows, checkpoint, step)


DIGEST = 16  # bytes of a fingerprint that the state keeps


def _first(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the rows of each fingerprint the one with the least key, and of those of one key the one with the least hash."""
    return rows.sort_values([c for c in ("key", "hash") if c in rows]).drop_duplicates("fp")


def first_asked(frames: Iterator[pd.DataFrame], most: int = 50_000) -> Iterator[pd.DataFrame]:
    """The rows of a task without those that another one of it beats to its fingerprint, looked for among about ``most`` rows at a time."""
    kept, size = [], 0
    for frame in frames:
        kept.append(_first(frame))
        size += len(kept[-1])
        if size >= most:
            yield _first(pd.concat(kept))
            kept, size = [], 0
    if kept:
        yield _first(pd.concat(kept))


class FirstMet(StatefulProcessor):
    """Of the rows (fp, key, ..) of each fingerprint of a bucket that was not met before, the one with the least key; and the fingerprint is met.

    A bucket is one value: its fingerprints, cut to ``DIGEST`` bytes, and with a lifetime the times they were met.
    So a batch asks the store once for a bucket, however many fingerprints are in it.
    """

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.met = handle.getValueState("met", "prints binary, since binary")

    def _known(self, now: int) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints that still count, and when they were met."""
        prints, since = self.met.get() if self.met.exists() else (b"", b"")
        prints, since = np.frombuffer(prints, f"S{DIGEST}"), np.frombuffer(since, np.int64)
        if self.keep_ms is None:
            return prints, since
        fresh = since + self.keep_ms > now
        return prints[fresh], since[fresh]

    def _add(self, known: tuple[np.ndarray, np.ndarray], prints: np.ndarray, now: int) -> None:
        since = b"" if self.keep_ms is None else np.concatenate([known[1], np.full(len(prints), now, np.int64)]).tobytes()
        self.met.update((np.concatenate([known[0], prints]).tobytes(), since))

    def _now(self, timer_values) -> int:
        return 0 if self.keep_ms is None else timer_values.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows, timer_values):
        frames = [x for x in rows if len(x)]
        if not frames:
            return
        now = self._now(timer_values)
        known = self._known(now)
        every = pd.concat(frames)
        prints = np.frombuffer(b"".join(x[:DIGEST] for x in every["fp"]), f"S{DIGEST}")
        first = _first(every[~np.isin(prints, known[0])])
        if len(first):
            self._add(known, np.frombuffer(b"".join(x[:DIGEST] for x in first["fp"]), f"S{DIGEST}"), now)
            yield first.drop(columns=["bucket", "fp"])

    def handleInitialState(self, key, initial, timer_values) -> None:
        now = self._now(timer_values)
        for prints in initial["prints"]:
            self._add(self._known(now), np.frombuffer(prints, f"S{DIGEST}"), now)

    def close(self) -> None:
        pass


def suppress_with_state(rows: DataFrame, history_path: str, out_path: str, checkpoint: str, key: str, keep: timedelta | None = None, buckets: int = 2048) -> StreamingQuery:
    """As ``suppress_reposts``, with the known fingerprints in the state store, so that a batch reads no history.

    The state starts with the fingerprints of the stored history when the checkpoint is new, and every batch
    still adds to that log, so a later run with another checkpoint knows them too. ``keep`` bounds the state:
    a fingerprint is forgotten so long after it was met. A fingerprint counts as met once a
    posting with it arrives, sent or not; ``suppress_reposts`` counts those of sent postings alone.
    Of postings of one batch that share a fingerprint the one with the least key may go out; tasks leave out what
    loses among their own rows, so a row moves once, with its role, and only if it may be the first with it.
    The store has a value for each of ``buckets`` of fingerprints: a batch reads and writes a bucket that
    it meets as a whole, and one checkpoint stays with one number of buckets.
    """
    spark = rows.sparkSession
    prints = F.array_distinct(F.array("primary_fp", "role_fp"))
    bucket = lambda fp: F.pmod(F.xxhash64(fp), F.lit(buckets)).cast("int").alias("bucket")
    row = T.StructType([f for f in rows.schema if f.name != key])
    made = with_fingerprints(rows).select(F.col(key).cast("string").alias("key"), F.size(prints).cast("int").alias("prints"), F.to_json(F.struct(*row.names)).alias("row"), prints.alias("both"))
    # the posting travels with its role, which fewer postings are the first to have; its hash tells rows of one key apart
    each = made.select("key", "prints", F.hash("row").alias("hash"), "row", F.posexplode("both").alias("place", "print"))
    asked = each.select("key", "prints", "hash", F.when(F.col("place") == F.col("prints") - 1, F.col("row")).alias("row"), F.unhex(F.substring("print", 1, 2 * DIGEST)).alias("fp"), bucket("print"))
    asked = asked.mapInPandas(first_asked, asked.schema)
    fp = F.col("fingerprint")
    known = _log(spark, history_path).select("fingerprint").distinct().groupBy(bucket(fp)).agg(F.unhex(F.array_join(F.collect_list(F.substring(fp, 1, 2 * DIGEST)), "")).alias("prints"))
    millis = None if keep is None else int(keep.total_seconds() * 1000)
    met = asked.groupBy("bucket").transformWithStateInPandas(
        FirstMet(millis), "key string, prints int, hash int, row string", "append", "none" if keep is None else "processingTime", initialState=known.groupBy("bucket")
    )
    schema = rows.schema
    own = F.col("key").cast(schema[key].dataType).alias(key)

    def step(batch: DataFrame, name: str) -> None:
        fresh = batch.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("first"), F.max("prints").alias("prints"), F.max("row").alias("row")).where("first = prints")
        back = fresh.select(own, F.from_json("row", row).alias("row")).select(key, "row.*").select(*schema.names)
        _send(with_fingerprints(back), key, history_path, out_path, name)

    needed = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if keep is not None:  # else a state with a lifetime asks for batch after batch, and the stream is never drained
        needed["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {k: spark.conf.get(k, None) for k in needed}
    try:
        for k, v in needed.items():
            spark.conf.set(k, v)
        return each_batch(met, checkpoint, step)  # a stream keeps the settings that it starts with
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rewrite_history(spark: SparkSession, history_path: str) -> None:
    """Put one part with one row a fingerprint in the place of all parts, while no stream writes.

    The new part is whole before the old ones go; if the job is lost between, rows are there twice, which changes nothing.
    """
    old = [x for x in stored(spark, history_path) if x.startswith("part=")]
    compact_history(spark, history_path).write.parquet(f"{history_path}/part=compact-{uuid.uuid4().hex}")
    for x in old:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{history_path}/{x}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def compact_history(spark: SparkSession, history_path: str) -> DataFrame:
    """One row a fingerprint of a history log: first and last time, and the rest as last sent."""
    log = _log(spark, history_path)
    rest = F.max_by(F.struct(*HISTORY[3:]), F.struct("last_seen_at", "url"))
    both = log.groupBy("fingerprint").agg(F.min("first_notified_at").alias("first_notified_at"), F.max("last_seen_at").alias("last_seen_at"), rest.alias("r"))
    return both.select("fingerprint", "first_notified_at", "last_seen_at", *[F.col(f"r.{c}").alias(c) for c in HISTORY[3:]])


HISTORY_SCHEMA = T.StructType([T.StructField(c, T.TimestampType() if c.endswith("_at") else T.IntegerType() if c == "fit_score" else T.StringType()) for c in HISTORY])


def usage_by_day(calls: DataFrame, late: str = "14 days") -> DataFrame:
    """Ledger totals by day; a batch frame gives the same totals without a watermark."""
    stamped = calls.withColumn("created_at", F.col("created_at").cast("timestamp"))
    if calls.isStreaming:
        stamped = stamped.withWatermark("created_at", late)
    return stamped.groupBy(F.window("created_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")).select(F.col("w.start").cast("date").alias("day"), "calls", "prompt_tokens", "completion_tokens")
