"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere
else, in the same document or another. Only suffixes that can hold such a string
are ordered, only to ``length`` bytes, most significant digit first; a suffix
alone with its digits so far leaves the sort, and what is still together at full
depth is a repeated string.

So that a suffix does not cost a row, suffixes are sorted by the block. Anchors
are places whose 16 bytes hash to 0 modulo ``spacing``; a suffix belongs to the
first anchor at or after its start, and a block is a run of up to ``block``
suffixes of one anchor, aligned by their distance to it. Equal strings have equal
first anchors, so their suffixes lie at the same place of blocks of the same
kind. The passes:

1. First digit: the bytes common to all strings of the block (its core). Second
   digit: the bytes of all strings of the block (its span). Blocks with equal
   core and span repeat as a whole. Blocks with a core of their own leave.
2. Blocks with a shared core but different spans are opened: their suffixes are
   sorted by themselves to full depth.

Strings without any anchor (long runs of few patterns) are sorted by themselves
in the first pass. Digits are compared by two independent 64-bit hashes.

Rows with the same digits that meet in one Arrow batch are combined before the
shuffle (two are enough to prove a repeat), so that a passage that many
documents hold reaches a task once a batch and not once a document; neighbours
in the sorted order decide, so no group is ever gathered.

Null and empty texts, and texts shorter than ``length``, lose nothing. Repeated
rows are repeats of each other. An empty table gives an empty result. Other
columns of the input are left alone. Null and repeated doc_ids are told apart by
a number of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeHash, pieces, staged

GRAM = 16
PIECE = 3 << 18  # characters that are hashed at a time
#: Kinds of rows: a block, a suffix, and a run of suffixes that are known to repeat.
BLOCK, SUFFIX, KNOWN = 0, 1, 2
#: ``at`` packs a run's start (32 bits), its number of suffixes (30) and its kind (2): shuffled rows stay short.
ROWS = "core long, span long, row long, at long"


class Suffixes:
    """Anchors, blocks and hashes over the bytes of some documents, laid end to end."""

    def __init__(self, texts: list[bytes], length: int, spacing: int, block: int):
        self.length, self.block = length, block
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.begins = self.ends - [len(t) for t in texts]
        self.one, self.two = RangeHash(self.data, 11), RangeHash(self.data, 12)
        anchors = np.flatnonzero(self.one.every(GRAM) % np.uint64(spacing) == 0)
        owner = np.searchsorted(self.ends, anchors, "right")
        self.anchors = anchors[anchors + GRAM <= self.ends[owner]] if len(anchors) else anchors

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Per string start: its document's number, and the distance to its first anchor (-1: none inside)."""
        sizes = np.maximum(0, self.ends - self.begins - self.length + 1)
        doc = np.repeat(np.arange(len(self.ends)), sizes)
        starts = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.begins, sizes)
        if not len(self.anchors):
            return starts, np.full(len(starts), -1)
        at = np.searchsorted(self.anchors, starts)
        near = self.anchors[np.minimum(at, len(self.anchors) - 1)]
        away = near - starts
        return starts, np.where((at < len(self.anchors)) & (away <= self.length - GRAM), away, -1)

    def blocks(self, starts: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first start, count, core hash, span hash) of the blocks; starts descend in distance."""
        keep = away >= 0
        s, d = starts[keep], away[keep]
        if not len(s):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        band, anchor = d // self.block, s + d
        edge = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)]))
        count = np.diff(np.append(edge, len(s)))
        first, low = s[edge], anchor[edge] - band[edge] * self.block
        core = self.one.of(low, low - self.block + 1 + self.length)
        core ^= band[edge].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        span = self.two.of(first, first + count - 1 + self.length)
        # blocks cut short by the document or the next anchor differ from whole ones by where they end
        span ^= ((low - first) * 4096 + count).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        return first, count, core, span


def _repeats_here(core: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that repeat within the batch, the rows to send on: one or two of each digit pair)."""
    order = np.lexsort((span, core))
    c, s = core[order], span[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
    group = np.cumsum(new) - 1
    place = np.arange(len(order)) - np.flatnonzero(new)[group]
    repeats = np.bincount(group)[group] > 1
    local = np.zeros(len(order), bool)
    local[order] = repeats
    return local, np.sort(order[place < 2])


def _rows(sfx: Suffixes, first, count, core, span, kind: int, rows: np.ndarray) -> list[pa.RecordBatch]:
    """Rows to sort, and the runs of suffixes that already repeat within the batch; ``rows`` are the documents' keys."""
    if not len(first):
        return []
    local, send = _repeats_here(core, span)
    out = []

    def add(at, size, c, s, k):
        doc = np.searchsorted(sfx.ends, at, "right")
        packed = ((at - sfx.begins[doc]) << 32) | (size << 2) | k
        out.append(pa.RecordBatch.from_arrays([pa.array(x) for x in (c.view(np.int64), s.view(np.int64), rows[doc], packed)], names=["core", "span", "row", "at"]))

    add(first[send], count[send], core[send], span[send], kind)
    if local.any():
        at, size = first[local], count[local]
        order = np.argsort(at, kind="stable")
        at, size = at[order], size[order]
        doc = np.searchsorted(sfx.ends, at, "right")
        edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + size[:-1]) | (doc[1:] != doc[:-1])]))
        total = np.add.reduceat(size, edge)
        spread = at[edge].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        add(at[edge], total, spread, np.zeros(len(edge), np.uint64), KNOWN)
    return out


def _first_pass(docs: DataFrame, length: int, spacing: int, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("row").to_numpy()
            for base, texts in pieces(batch.column("text"), PIECE):
                sfx = Suffixes([t.encode() for t in texts], length, spacing, block)
                rows = keys[base : base + len(texts)]
                starts, away = sfx.runs()
                yield from _rows(sfx, *sfx.blocks(starts, away), BLOCK, rows)
                lone = starts[away < 0]
                if len(lone):
                    yield from _rows(sfx, lone, np.ones(len(lone), np.int64), sfx.one.of(lone, lone + length), sfx.two.of(lone, lone + length), SUFFIX, rows)

    return docs.select("row", "text").mapInArrow(run, ROWS)


def _second_pass(opened: DataFrame, length: int) -> DataFrame:
    """The suffixes of opened blocks; ``opened`` has row, text and a list ``open`` of packed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("row").to_numpy()
            for base, texts in pieces(batch.column("text"), PIECE):
                sfx = Suffixes([t.encode() for t in texts], length, 1 << 62, 1)
                lists = batch.column("open").slice(base, len(texts))
                packed = lists.flatten().to_numpy()
                doc = np.repeat(np.arange(len(texts)), lists.value_lengths().fill_null(0).to_numpy())
                start, size = packed >> 32, (packed >> 2) & (2**30 - 1)
                at = np.repeat(start + sfx.begins[doc] - np.cumsum(size) + size, size) + np.arange(size.sum()) if len(size) else start
                at = np.unique(at)
                yield from _rows(sfx, at, np.ones(len(at), np.int64), sfx.one.of(at, at + length), sfx.two.of(at, at + length), SUFFIX, keys[base : base + len(texts)])

    return opened.mapInArrow(run, ROWS)


def _sorted(rows: DataFrame) -> DataFrame:
    """Order rows by their digits and mark those that repeat (``same``) or share their core alone (``open``)."""
    order = Window.partitionBy("core").orderBy("span")
    before, after = F.lag("span").over(order), F.lead("span").over(order)
    kind = F.col("at").bitwiseAND(F.lit(3))
    found = rows.withColumns({"before": before, "after": after})
    same = (kind == KNOWN) | F.coalesce((F.col("before") == F.col("span")) | (F.col("after") == F.col("span")), F.lit(False))
    # the first and the last row of each run of equal spans see the other spans of their core
    differs = F.coalesce(F.col("before") != F.col("span"), F.lit(False)) | F.coalesce(F.col("after") != F.col("span"), F.lit(False))
    return found.select("row", "at", same.alias("same"), ((kind == BLOCK) & differs).alias("open")).where("same or open")


def _per_document(flags: DataFrame) -> DataFrame:
    return flags.groupBy("row").agg(*[F.collect_list(F.when(F.col(k), F.col("at"))).alias(k) for k in ("same", "open")])


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): doc_id itself is the key where every one is there once, else a number given for the purpose."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole and docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return own.select(F.col("doc_id").cast("long").alias("row"), "doc_id", "text")
    return staged(own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "keyed")


def _cover(n: int, runs: list[tuple[np.ndarray, np.ndarray]], length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for start, size in runs:
        np.add.at(edge, start, 1)
        np.add.at(edge, start + size - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def find_repeats(docs: DataFrame, length: int = 400, spacing: int = 64, block: int = 64) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, removed (list of byte ranges), kept (the remaining bytes or null if all stay), kept_sha256."""
    if not 2 * GRAM <= block + GRAM < length:
        raise ValueError("a string must be longer than a block and an anchor")
    own = _keyed(docs)
    joined = own.join(_per_document(_sorted(_first_pass(own, length, spacing, block))), "row", "left")
    flagged = F.coalesce(F.size("same") + F.size("open"), F.lit(0)) > 0
    # documents without any repeated core are done; only their digest goes on
    first = staged(
        joined.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(flagged, F.col("text")).alias("text"), F.when(~flagged, F.sha2("text", 256)).alias("sha"), F.when(flagged, F.col("same")).alias("same"), F.when(flagged, F.col("open")).alias("open")),
        "repeats",
    )
    opened = first.where(F.size("open") > 0).select("row", "text", "open")
    late = _per_document(_sorted(_second_pass(opened, length))).select("row", F.col("same").alias("late"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "removed", "kept", "kept_sha256"]
        for batch in batches:
            removed, spans, kept, digest = [], [], [], []
            lists = {k: batch.column(k) for k in ("same", "late")}
            for i, (text, sha) in enumerate(zip(batch.column("text"), batch.column("sha"), strict=True)):
                if not text.is_valid:
                    removed.append(0), spans.append([]), kept.append(None), digest.append(sha.as_py())
                    continue
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                packed = [x.values.to_numpy() for x in (lists["same"][i], lists["late"][i]) if x.is_valid and len(x)]
                runs = [(x >> 32, (x >> 2) & (2**30 - 1)) for x in packed]
                gone = _cover(len(data), runs, length)
                step = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                rest = data[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in step.reshape(-1, 2)])
                kept.append(rest if len(rest) < len(data) else None)
                digest.append(hashlib.sha256(rest).hexdigest())
            kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string()]
            made = [pa.array(x, k) for x, k in zip((removed, spans, kept, digest), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made], names)

    out = f"doc_id {kind}, n_bytes long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string"
    return first.drop("open").join(late, "row", "left").mapInArrow(run, out)
