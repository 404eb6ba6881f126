"""Token ids in bit-packed binary files.

Every id takes the least number of bits that holds the vocabulary. A file
holds whole documents in ascending doc_id order:

    8 bytes   magic ``SLTOKEN1``
    6 x 8     int64: bits, ids per block, documents, ids, blocks, bytes of data
    int64[]   doc_id of each document (``null_id`` stands for null)
    int64[]   ids before each document, and in all (documents + 1)
    int64[]   byte offset of each block within the data (blocks + 1)
    data      the blocks; each is padded to whole bytes

All numbers are little-endian. A block is unpacked by itself with numpy, so any
range of ids is read without what stands before it. A file is put together, and
read, by one task; a text lies whole in one file, whatever its length.

Spark commits the files (one per range of doc_ids, through its own file writer,
whose row separator follows the last byte), so that a task that runs twice or
an executor that is lost leaves no half-written file, and any store that Spark
can write to will do. Files are read back with Spark's ``binaryFile`` source.

Null and empty texts give the end id alone. Null doc_ids sort first; documents
with one doc_id are ordered by their text, and repeated rows each have their ids. An
empty table gives no files. Other columns are left alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, shared_dir, word_hashes

MAGIC = b"SLTOKEN1"
BLOCK = 1 << 16
NULL_ID = -(2**63)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` low bits of each id, least significant first."""
    if bits % 8 == 0 and bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits % 8 == 0 and bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def to_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    starts, offsets = np.cumsum([0, *counts]), np.cumsum([0, *map(len, blocks)])
    head = np.array([bits, block, len(doc_ids), len(ids), len(blocks), offsets[-1]])
    return b"".join([MAGIC, *(x.astype("<i8").tobytes() for x in (head, np.asarray(doc_ids), starts, offsets)), *blocks])


class TokenFile:
    """Random access to the bytes of one file; ``data`` may also be a numpy memory map."""

    def __init__(self, data):
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, docs, self.n_ids, blocks, _ = self._ints(8, 6).tolist()
        at = 56
        self.doc_ids, self.starts, self.offsets = self._ints(at, docs), self._ints(at + 8 * docs, docs + 1), self._ints(at + 16 * docs + 8, blocks + 1)
        self.base = at + 16 * docs + 8 + 8 * (blocks + 1)

    def _ints(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.data, "<i8", n, at)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``; only their blocks are unpacked."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            count = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(self.data[self.base + int(self.offsets[b]) : self.base + int(self.offsets[b + 1])], count, self.bits))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def crc32(self) -> np.ndarray:
        """The crc32 of the ids of each document as little-endian unsigned 32-bit integers; each block is unpacked once."""
        out = np.zeros(len(self.doc_ids), np.int64)
        for b in range(len(self.offsets) - 1):
            low = b * self.block
            ids = self.ids(low, min(low + self.block, self.n_ids)).astype("<u4").tobytes()
            k = int(np.searchsorted(self.starts, low, "right")) - 1
            while k < len(out) and self.starts[k] < low + self.block:
                part = ids[4 * max(0, int(self.starts[k]) - low) : 4 * (int(self.starts[k + 1]) - low)]
                out[k] = zlib.crc32(part, int(out[k]))
                k += 1
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class WordEncoder:
    """Encodes texts through a ``tokenizers`` file, each distinct piece between blanks once per worker.

    The file's normaliser and splitter never join characters over a blank or a
    line feed, nor do its special tokens hold one, so the ids of a text are those
    of its pieces, in order. Special tokens in a text get their own ids, as a plain
    call of the library gives. Pieces are found again by a 64-bit hash; up to
    ``memo`` of them are remembered, at 16 bytes and their ids each.
    """

    def __init__(self, path: str, end_id: int, memo: int = 1 << 20):
        self.path, self.end_id, self.memo, self.tokenizer = path, end_id, memo, None

    def __getstate__(self):
        return {"path": self.path, "end_id": self.end_id, "memo": self.memo, "tokenizer": None}

    def _open(self) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    @staticmethod
    def vocabulary(path: str) -> int:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)

    def _look_up(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Where each piece stands in ``start`` and ``size``; new ones are encoded."""
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > self.memo:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        new = first[self.known[at] != distinct] if len(self.known) else first
        if len(new):
            starts, sizes, ids, total = [], [], [self.flat], len(self.flat)
            for i in range(0, len(new), 20_000):
                words = [data[a:b].tobytes().decode() for a, b in zip(begin[new[i : i + 20_000]].tolist(), end[new[i : i + 20_000]].tolist(), strict=True)]
                made = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
                size = np.fromiter(map(len, made), np.int32, len(made))
                sizes.append(size)
                starts.append(total + np.cumsum(size) - size)
                ids.append(np.fromiter(chain.from_iterable(made), np.uint32, int(size.sum())))
                total += len(ids[-1])
            known = np.concatenate([self.known, hashes[new]])
            order = np.argsort(known)
            self.known = known[order]
            self.start = np.concatenate([self.start, *starts])[order].astype(np.int32)
            self.size = np.concatenate([self.size, *sizes])[order]
            self.flat = np.concatenate(ids)
            at = np.searchsorted(self.known, distinct)
        return at[back]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text with its end id, all ids) of some texts."""
        if self.tokenizer is None:
            self._open()
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        edge = np.flatnonzero(np.diff(((data == 32) | (data == 10)).astype(np.int8)))
        begin, end = edge[0::2] + 1, edge[1::2] + 1
        at = self._look_up(data, begin, end, word_hashes(data, begin, end, 43))
        size, start = self.size[at], self.start[at]
        ends = np.cumsum(size, dtype=np.int64)
        body = self.flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.searchsorted(begin, np.cumsum([len(r) + 1 for r in raw]), "right")
        ends = np.concatenate([[0], ends])[stops]
        return np.diff(ends, prepend=0) + 1, np.insert(body, ends, np.uint32(self.end_id))


def write_files(docs: DataFrame, path: str, encoder: WordEncoder, vocabulary: int, file_bytes: int = 16 << 20) -> None:
    """Encode ``docs`` (doc_id, text) and write the token files of ``path``, one for each range of doc_ids.

    A file holds about ``file_bytes`` of text, and is put together in one task.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = size // file_bytes + 1
    bits = bits_for(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, doc_ids, counts, ids = shared.value, [], [], []
        for batch in batches:
            doc_ids.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy())
            for _, texts in pieces(batch.column("text"), 4 << 20):
                n, own = coder.encode(texts)
                counts.append(n)
                ids.append(own.astype(np.uint16) if bits <= 16 else own)
        if counts:
            whole = to_file(np.concatenate(doc_ids), np.concatenate(counts), np.concatenate(ids), bits)
            yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["data"])

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(run, "data binary").select(F.col("data").cast("string")).write.text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                if not len(data):
                    continue
                file = TokenFile(data)
                own = pd.array(file.doc_ids, "Int64")
                own[file.doc_ids == NULL_ID] = pd.NA
                yield pd.DataFrame({"file": name, "doc_id": own, "inside": file.starts[:-1], "n_tokens": np.diff(file.starts), "ids_crc32": file.crc32(), "ids": file.n_ids})

    return raw.select("path", "content").mapInPandas(run, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long, ids long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Turn offsets within files into offsets over all files (one row a file is ordered, not one a document)."""
    totals = rows.where("inside = 0").groupBy("file").agg(F.max("ids").alias("ids"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = F.coalesce(F.sum("ids").over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = totals.select("file", before.alias("before"))
    return rows.join(first, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
