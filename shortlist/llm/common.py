"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.sources.staging import shared_dir

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: The bytes of that white space.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and survives the loss of executors. The folder is
    removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``staged`` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def map_batches(df: DataFrame, run, names: list[str], kinds: list[str]) -> DataFrame:
    """``mapInArrow`` for columns of any name: ``run`` finds and gives columns by position."""
    safe = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds))

    def numbered(batches):
        for batch in run(batches):
            yield batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])

    return safe.mapInArrow(numbered, schema).toDF(*names)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def pieces(column, most_bytes: int = 16 << 20):
    """Slices of an Arrow string column of at most ``most_bytes``, or of one row: (first row, values)."""
    values, start, size = [], 0, 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        values.append(text)
        size += len(text)
        if size >= most_bytes:
            yield start, values
            values, start, size = [], i + 1, 0
    if values:
        yield start, values


def sample_texts(docs: DataFrame, picked: DataFrame, most: int, max_chars: int) -> list[str]:
    """Texts of the rows whose doc_id is ``picked``, for a fit on the driver.

    The first ones by a hash of doc_id, at most ``most`` rows and ``max_chars``
    characters; a text longer than a sixteenth of that is left aside.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_chars // 16)
    sizes = texts.join(F.broadcast(picked), "doc_id").select("doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").alias("size"))
    left, ids = max_chars, set()
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(most).collect():
        left -= r["size"]
        if left < 0:
            break
        ids.add((r["doc_id"], r["text_hash"]))
    wanted = docs.sparkSession.createDataFrame(sorted(ids), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long")
    rows = texts.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "text_hash"]).select("doc_id", "text").distinct().collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))
    return [r["text"] for r in rows]


# --- 64-bit hashes of byte ranges, vectorised -------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class RangeHash:
    """Hash of any byte range of a buffer in constant time, from prefix sums modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        table = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 257, dtype=np.uint64)
        up, down = self._power(seed, int(table[256]) | 1, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[:256][data] * up[: len(data)], out=self.sums[1:])
        self.down = down

    @classmethod
    def _power(cls, seed: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        known = cls._powers.get(seed)
        if known is None or len(known[0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            both = []
            for b in (base, pow(base, -1, 2**64)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                both.append(np.cumprod(steps))
            cls._powers[seed] = known = (both[0], both[1])
        return known

    def every(self, width: int) -> np.ndarray:
        """The hash of each range of ``width`` bytes."""
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int, step: int = 1 << 20) -> np.ndarray:
    """Hashes of the words [begin, end) of a buffer, which stand in order and apart, about ``step`` bytes at a time."""
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + step)))
        base = begin[i]
        out[i:j] = RangeHash(data[base : end[j - 1]], seed).of(begin[i:j] - base, end[i:j] - base)
        i = j
    return mix(out)
