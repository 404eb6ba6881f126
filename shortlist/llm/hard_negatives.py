"""Hard-negative mining with rotated one-bit codes.

Vectors become whole numbers (``floor(scale * x)``). Anchors are given rows; an anchor's positives are its
``k`` best other rows of its label by inner product, and for each positive the ``k`` best rows
of other labels whose score is at least ``percent`` % of the positive's and not above it are its
hard negatives. Ties are ordered by vec_id. All anchors are compared with all rows.

* Code: a vector v is turned by a fixed matrix M with orthonormal columns, which also spreads it
  over more dimensions, and each coordinate leaves its sign: b = sign(Mv). The unit vector
  u along M'b stands for v. Stored with the bits: the alignment a = <v, u>, the length r of what u leaves
  of v, and 1 / |M'b|.
* Estimate: the turned anchor is rounded to ``planes`` bit planes, and <anchor, u> comes from popcounts of planes and
  code, up to the rounding error, whose greatest effect d is known: w - d <= <q, u> <= w + d.
* Interval: <q, v> = a <q, u> + <q, v - a u>, and by Cauchy-Schwarz the last term is at most
  r * sqrt(|q|^2 - <q, u>^2). So each score lies in a known interval, with certainty.
* A pair whose interval misses the wanted range, or ends under the k-th best so far, is dropped; the others
  are scored in integers. So the result is exact whatever the codes are worth.

Anchors and rows are dealt to blocks by hashes of their ids; a task holds one block of anchors
(``anchor_block`` at most on average) and streams one block of rows past them, so each needs bounded memory
however many rows there are. Blocks give their k best, which are merged by a window.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows that
share a vec_id count once, as the least (label, vector). Shorter vectors are filled with zeros up to the longest.
Whole numbers beyond +-2**31 / sqrt(dimensions) are cut there, so that scores fit a long. vec_ids and labels are
whole numbers. An empty table, or one without anchors, gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
CODED = ["vec_id", "label", "v", "code", "along", "apart", "inverse"]


@functools.lru_cache(4)
def rotation(dims: int, spread: int, seed: int = 7) -> np.ndarray:
    """The matrix M: bits x dims, with orthonormal columns; bits is a multiple of 64 of at least ``spread`` times dims."""
    bits = -(-spread * dims // 64) * 64
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((bits, dims)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of 64-bit words."""
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def encode(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of v: code, alignment, residual length, 1 / |M'b| (0 where that is 0)."""
    up = v @ turn.T >= 0
    back = np.where(up, 1.0, -1.0) @ turn
    size = np.linalg.norm(back, axis=1)
    inverse = np.divide(1.0, size, out=np.zeros_like(size), where=size > 1e-9)
    along = np.einsum("ij,ij->i", v, back) * inverse
    apart = np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", v, v) - along * along))
    return packed(up), along, apart, inverse


class Anchors:
    """A block of anchors: bit planes, ranges that are wanted, and the best found so far for each range."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, floor: np.ndarray, cap: np.ndarray, turn: np.ndarray, planes: int, k: int):
        self.ids, self.labels, self.v, self.floor, self.cap, self.k = ids, labels, v, floor, cap, k
        self.length = np.sqrt(np.einsum("ij,ij->i", v, v).astype(np.float64))
        shape = (len(ids), floor.shape[1], k)
        self.best, self.who = np.full(shape, LEAST, np.int64), np.full(shape, MOST, np.int64)
        parts = [self._planes(v[i : i + 4096].astype(np.float64) @ turn.T, planes) for i in range(0, len(v), 4096)]
        self.low, self.step, self.sums, self.error, self.planes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(labels, kind="stable")
        names, at = np.unique(labels[order], return_index=True)
        self.by_label = dict(zip(names.tolist(), np.split(order, at[1:]), strict=True))

    @staticmethod
    def _planes(y: np.ndarray, planes: int) -> tuple[np.ndarray, ...]:
        low = y.min(axis=1)
        step = (y.max(axis=1) - low) / ((1 << planes) - 1)
        step[step == 0] = 1.0
        level = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
        about = low[:, None] + step[:, None] * level
        return low, step, about.sum(axis=1), np.abs(y - about).sum(axis=1), np.stack([packed(level >> p & 1) for p in range(planes)], axis=1)

    def intervals(self, i: np.ndarray, code: np.ndarray, ones: np.ndarray, along: np.ndarray, apart: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores of the anchors i with the coded rows."""
        level = np.zeros((len(i), len(code)))
        for p in range(self.planes.shape[1]):
            plane = self.planes[i, p]
            count = np.zeros(level.shape, np.uint16)
            for w in range(code.shape[1]):
                count += np.bitwise_count(plane[:, None, w] & code[None, :, w])
            level += float(1 << p) * count
        about = (2.0 * (self.low[i, None] * ones + self.step[i, None] * level) - self.sums[i, None]) * inverse
        off = self.error[i, None] * inverse
        length = self.length[i, None]
        beside = np.sqrt(np.maximum(0.0, length**2 - np.maximum(0.0, np.abs(about) - off) ** 2))
        half = np.abs(along) * off + apart * beside
        half += 1e-9 * length * (np.abs(along) + apart) + 1e-6  # what floating point may lose
        middle = along * about
        return middle - half, middle + half

    def scan(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, coded: list[np.ndarray], same: bool, chunk: int = 128) -> int:
        """Let the rows compete; the number of pairs that were scored in integers."""
        scored = 0
        code, along, apart, inverse = coded
        ones = np.bitwise_count(code).sum(axis=1).astype(np.float64)
        for label, members in self.by_label.items():
            j = np.flatnonzero((labels == label) == same)
            if not len(j):
                continue
            own = (code[j], ones[j], along[j], apart[j], inverse[j])
            for at in range(0, len(members), chunk):
                i = members[at : at + chunk]
                low, high = self.intervals(i, *own)
                if same:
                    itself = self.ids[i, None] == ids[j]
                    high[itself] = low[itself] = -np.inf
                for p in range(self.floor.shape[1]):
                    scored += self._compete(i, p, low, high, ids[j], v, j)
        return scored

    def _compete(self, i: np.ndarray, p: int, low: np.ndarray, high: np.ndarray, ids: np.ndarray, v: np.ndarray, j: np.ndarray) -> int:
        floor, cap, k = self.floor[i, p, None], self.cap[i, p, None], self.k
        wanted = (high >= floor) & (low <= cap) & (high > -np.inf)
        need = np.where(self.best[i, p, -1] == LEAST, -np.inf, self.best[i, p, -1].astype(np.float64))
        if low.shape[1] > k:  # k rows are sure to reach the k-th greatest lower end of those surely in range
            sure = np.where((low >= floor) & (high <= cap), low, -np.inf)
            need = np.maximum(need, -np.partition(-sure, k - 1, axis=1)[:, k - 1])
        one, two = np.nonzero(wanted & (high >= need[:, None]))
        for at in range(0, len(one), 1 << 15):
            a, b = i[one[at : at + (1 << 15)]], j[two[at : at + (1 << 15)]]
            score = np.einsum("ij,ij->i", self.v[a], v[b])
            who = ids[two[at : at + (1 << 15)]]
            good = (score >= self.floor[a, p]) & (score <= self.cap[a, p])
            self._keep(p, a[good], score[good], who[good])
        return len(one)

    def _keep(self, p: int, a: np.ndarray, score: np.ndarray, who: np.ndarray) -> None:
        """Merge scored rows into the k best of their anchors."""
        met = np.unique(a)
        old = np.repeat(met, self.k)
        a, score, who = np.concatenate([old, a]), np.concatenate([self.best[met, p].ravel(), score]), np.concatenate([self.who[met, p].ravel(), who])
        order = np.lexsort((who, ~score, a))  # ~score falls as score rises, and cannot overflow
        a, score, who = a[order], score[order], who[order]
        place = np.arange(len(a)) - np.repeat(np.searchsorted(a, met), np.diff(np.append(np.searchsorted(a, met), len(a))))
        first = place < self.k
        self.best[a[first], p, place[first]] = score[first]
        self.who[a[first], p, place[first]] = who[first]

    def found(self) -> pa.RecordBatch:
        """(anchor_id, cap, vec_id, score) of what stands."""
        i, p, r = np.nonzero(self.best != LEAST)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[i], self.cap[i, p], self.who[i, p, r], self.best[i, p, r])], names=["anchor_id", "cap", "vec_id", "score"])


# --- on Spark ------------------------------------------------------------------


def whole_vectors(table: DataFrame, scale: int = 256) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, once each, and the greatest number of dimensions."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    dims = max(1, rows.agg(F.max(F.size("x"))).first()[0] or 0)
    most = int(2**31 / math.sqrt(dims)) - 1
    whole = F.transform("x", lambda c: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(scale * c))).cast("int"))
    one = rows.select("vec_id", F.struct("label", whole.alias("v")).alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    return one.select("vec_id", "row.*"), dims


def coded(rows: DataFrame, dims: int, spread: int) -> DataFrame:
    """(vec_id, label, v) with the vector as bytes, and its code."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("code", pa.binary()), ("along", pa.float64()), ("apart", pa.float64()), ("inverse", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims, spread)
        for batch in batches:
            lists = batch.column(2)
            v = np.zeros((len(lists), dims), np.int32)
            size = np.diff(lists.offsets.to_numpy())
            v[np.arange(dims) < size[:, None]] = lists.flatten().to_numpy()
            code, *rest = encode(v.astype(np.float64), turn)
            raw = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (v, code)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *raw, *map(pa.array, rest)], schema=schema)

    return rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, v binary, code binary, along double, apart double, inverse double")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _best(anchors: DataFrame, rows: DataFrame, same: bool, dims: int, spread: int, planes: int, k: int, percent: int, anchor_block: int, row_block: int) -> DataFrame:
    """(anchor_id, cap, vec_id, score): of each block of rows the k best for each anchor and cap.

    ``anchors`` has caps, the scores that rows may not exceed; null ones are no bound.
    """
    n, many = rows.count(), anchors.count()
    rows_in, anchors_in = max(1, min(64, n // 4096), -(-n // row_block)), max(1, -(-many // anchor_block))
    dealt = lambda seed, parts: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = anchors.select("vec_id", "label", "v", "caps", F.lit(0).alias("side"), dealt(1, anchors_in).alias("h"), each(rows_in).alias("g"))
    right = rows.select(*CODED, F.lit(1).alias("side"), dealt(2, rows_in).alias("g"), each(anchors_in).alias("h"))
    both = right.unionByName(left, allowMissingColumns=True).select("h", "g", "side", *CODED, "caps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims, spread)
        key, waiting, block = None, [], None

        def built() -> Anchors | None:
            if not waiting:
                return None
            t = pa.Table.from_batches(waiting)
            caps = t.column("caps").to_pylist()
            wide = max(len(c) if c is not None else 1 for c in caps)
            floor, cap = np.full((len(caps), wide), MOST), np.full((len(caps), wide), LEAST)  # ranges that nothing meets
            for x, c in enumerate(caps):
                cap[x, : len(c) if c is not None else 1] = c if c is not None else MOST
                # the least score s with 100 s >= percent * cap
                floor[x, : len(c) if c is not None else 1] = [-(-percent * y // 100) for y in c] if c is not None else LEAST
            return Anchors(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("v"), "<i4").astype(np.int64), floor, cap, turn, planes, k)

        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if low == high:
                    continue
                h, g, side = marks[:, low].tolist()
                part = batch.slice(low, high - low)
                if (h, g) != key:
                    if block is not None:
                        yield block.found()
                    key, waiting, block = (h, g), [], None
                if side == 0:
                    waiting.append(part)
                    continue
                if block is None:
                    block = built()
                if block is not None:
                    columns = {c: part.column(3 + x) for x, c in enumerate(CODED)}
                    numbers = [columns[c].to_numpy() for c in CODED[4:]]
                    block.scan(columns["vec_id"].to_numpy(), columns["label"].to_numpy(), _matrix(columns["v"], "<i4").astype(np.int64), [_matrix(columns["code"], "<u8"), *numbers], same)
        if block is not None:
            yield block.found()

    ordered = both.repartition("h", "g").sortWithinPartitions("h", "g", "side")
    return ordered.mapInArrow(run, "anchor_id long, cap long, vec_id long, score long")


def mine(table: DataFrame, is_anchor: Column, k: int = 5, percent: int = 80, scale: int = 256, spread: int = 4, planes: int = 6, anchor_block: int = 1 << 15, row_block: int = 1 << 18) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, label, embedding); ``is_anchor`` may use vec_id and label."""
    rows, dims = whole_vectors(table, scale)
    rows = staged(coded(rows, dims, spread), "coded")
    sizes = (dims, spread, planes, k, percent, anchor_block, row_block)
    anchors = rows.where(is_anchor).select("vec_id", "label", "v")
    first = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    found = _best(anchors.withColumn("caps", F.lit(None).cast("array<long>")), rows, True, *sizes)
    positives = staged(found.withColumn("rank", first(["anchor_id"])).where(F.col("rank") <= k).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # equal scores ask for the same negatives: a cap is looked for once
    caps = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("caps"))
    found = _best(anchors.join(caps, "vec_id"), rows, False, *sizes)
    negatives = found.withColumn("rank", first(["anchor_id", "cap"])).where(F.col("rank") <= k)
    named = negatives.select("anchor_id", F.col("cap").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(named, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
