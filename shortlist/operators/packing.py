"""Greedy packing of ordered lines into messages, block by block.

A message takes lines while its characters and one line break between two of them stay within the limit. Where a block
of lines starts in the middle of a message, all that matters of what came before is the size of that
message, at most ``limit``. So a block is summed up as a table from that size to the number of messages that it
ends and the size that it leaves; tables are composed in order, which gives every block its start, and each block
is then packed by itself. A list of any length is packed without one task that holds it.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.sources.staging import numbered


class Block:
    """The lengths of consecutive lines of one list."""

    def __init__(self, sizes: np.ndarray, limit: int):
        self.n, self.limit = sizes.astype(np.int64), limit
        self.ends = np.concatenate([[0], np.cumsum(self.n + 1)])

    def _break(self, first: int, size: int) -> int:
        """The line that no longer fits a message of ``size`` which goes on with line ``first``; the number of lines if all fit."""
        return max(first, int(np.searchsorted(self.ends, self.limit - size + self.ends[first], "right")) - 1)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each size of the open message, 0 for none: messages that end in the block, and the size it leaves (cut at the limit)."""
        m, limit = len(self.n), self.limit
        ended, left = np.zeros(m + 1, np.int32), np.zeros(m + 1, np.int32)  # of a message that starts with line i
        for i in range(m - 1, -1, -1):
            size = int(self.n[i])
            if not size:  # an empty line leaves an empty message
                ended[i], left[i] = ended[i + 1], left[i + 1]
                continue
            j = self._break(i + 1, size)
            ended[i], left[i] = (ended[j] + 1, left[j]) if j < m else (0, min(limit, size + self.ends[m] - self.ends[i + 1]))
        open_ = np.arange(1, limit + 1)
        j = np.searchsorted(self.ends, limit - open_, "right") - 1
        fits = j >= m
        j = np.minimum(j, m)
        out = np.where(fits, 0, ended[j] + 1), np.where(fits, np.minimum(limit, open_ + self.ends[m]), left[j])
        return np.concatenate([ended[:1], out[0]]).astype(np.int32), np.concatenate([left[:1], out[1]]).astype(np.int32)

    def parts(self, size: int) -> list[tuple[int, int, int]]:
        """(message, lines, size) after an open message of ``size``, which is message 0."""
        out, i, k, m = [], 0, 0, len(self.n)
        while i < m:
            first, at = i, size
            if not size:
                full = np.flatnonzero(self.n[i:])
                if not len(full):
                    return [*out, (k, m - i, 0)]
                first = i + int(full[0]) + 1
                at = int(self.n[first - 1])
            j = min(m, self._break(first, at))
            if j > i:
                out.append((k, j - i, int(at + self.ends[j] - self.ends[first])))
            i, size, k = j, 0, k + 1
        return out


def _lists(block: pd.DataFrame) -> Iterator[tuple[bool, object, np.ndarray]]:
    """(whether it is the first, name, sizes) of the lists of a block (place, list, size), in order."""
    block = block.sort_values("place")
    names, sizes = block["list"].to_numpy(object), block["size"].to_numpy(np.int64)
    numbers, _ = pd.factorize(names, use_na_sentinel=False)
    starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(names)] if len(names) else []
    for a, b in itertools.pairwise(starts):
        yield a == 0, None if pd.isna(names[a]) else names[a], sizes[a:b]


def pack_messages(lines: DataFrame, by: str, order: list[str], limit: int = 3800, block: int = 10_000) -> DataFrame:
    """(by, line) -> (by, part, lines, size): greedy parts of at most ``limit`` characters, in order; a longer line is a part of its own.

    Rows are numbered in the order of list, ``order`` and length, and cut in blocks of ``block`` lines; only their
    lengths move, and a worker holds one block at a time. A null line is empty; null is a list like any other.
    """
    kind = lines.schema[by].dataType  # lists travel by their names, which pandas keeps as they are
    length = F.length(F.coalesce("line", F.lit("")))
    rows = numbered(lines.select(F.col(by).cast("string").alias("list"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], length.alias("size")), ["list", *[f"o{i}" for i in range(len(order))], "size"])
    blocks = rows.select(F.floor(F.col("place") / block).alias("block"), "place", "list", "size").groupBy("block")

    def summed(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
        out = []
        for first, name, sizes in _lists(lines):
            ended, left = Block(sizes, limit).table()
            if not first:  # such a list starts here
                ended, left = ended[:1], left[:1]
            out.append((name, key[0], first, zlib.compress(ended.tobytes()), zlib.compress(left.tobytes())))  # most sizes leave the same
        return pd.DataFrame(out, columns=["list", "block", "first", "ended", "left"])

    def started(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, size, before = [], 0, 0
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if name != [r.list]:
                    name, size, before = [r.list], 0, 0
                if r.first:
                    out.append((r.block, size, before))
                ended, left = (np.frombuffer(zlib.decompress(x), np.int32) for x in (r.ended, r.left))
                before += int(ended[size])
                size = int(left[size])
            yield pd.DataFrame(out, columns=["block", "open", "before"])

    def packed(lines: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        out, size, before = [], int(start["open"].iloc[0]), int(start["before"].iloc[0])
        for first, name, sizes in _lists(lines):
            out += [(name, int(first) * before + k + 1, n, most) for k, n, most in Block(sizes, limit).parts(size if first else 0)]
        return pd.DataFrame(out, columns=["list", "part", "lines", "size"], dtype=object)

    tables = blocks.applyInPandas(summed, "list string, block long, first boolean, ended binary, left binary")
    starts = tables.repartition("list").sortWithinPartitions("list", "block").mapInPandas(started, "block long, open int, before int")
    parts = blocks.cogroup(starts.groupBy("block")).applyInPandas(packed, "list string, part int, lines long, size int")
    return parts.groupBy(F.col("list").cast(kind).alias(by), "part").agg(F.sum("lines").alias("lines"), F.max("size").alias("size"))
