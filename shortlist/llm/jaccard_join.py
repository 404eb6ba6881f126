"""Similarity join on word shingles with signature trees.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
distinct ``width``-word shingles (ASCII lower case, words ``[^\\x20\\x09-\\x0D]+``; a
text with fewer words is one shingle of all its words; a text without words has
an empty set and links with nothing). Shingles are 64-bit hashes.

1. Documents with equal sets form a class; the least doc_id stands for it.
2. Linked sets differ in few shingles, so when hash ranges cut all shingles into
   more parts than that, some part is equal in both: each set gives a signature a
   part that it has shingles in (``part_signatures``). Classes that share none leave;
   passages that many documents hold fill no part, so they bring few together.
3. Rounds: each class goes to the bucket of its first shared signature. A bucket,
   in parts of at most ``part`` classes, is joined with itself by a signature
   tree: leaves hold bitmaps of sets, nodes the OR of their children's bitmaps and
   the range of sizes, and a traversal of node pairs drops a pair when the largest
   overlap that bitmaps and sizes allow is too small. Pairs already connected are
   skipped, the others are compared exactly. One class of each connected part goes
   on to the next round, until every bucket is one part. Up to ``turns`` more rounds
   take classes that still meet other components to another of their buckets, so
   that few links are left for the pairs of the next step.
4. Completion: every shared signature is a bucket again, where its classes still
   differ in component. The same trees, and wide bitmaps where these leave a pair,
   give the pairs across components; their sets are compared exactly. Buckets larger
   than ``part`` are cut by size into tiles, each tile being joined with the tiles of
   reachable sizes, a part with a part at a time.
5. Components come from the links by repeated least-label contraction.

Nothing is capped: every pair that can reach the threshold is in some bucket.
Null texts are empty. Rows with a null doc_id take the component of equal sets
with an id, or else null, and make no other links. Rows that share a doc_id are
one node. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, mix, pieces, release, staged, word_hashes

#: Characters of text that are hashed at a time.
PIECE = 3 << 19


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode().lower() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    blank = BLANK[data]
    word = np.flatnonzero(np.diff(np.concatenate([[1], blank, [1]]).astype(np.int8)))
    begin, end = word[0::2], word[1::2]
    own = word_hashes(data, begin, end, 31)
    stops = np.cumsum([len(r) + 1 for r in raw])
    last = np.searchsorted(begin, stops, "left")
    sets, at = [], 0
    for stop in last.tolist():
        w, at = own[at:stop], stop
        if not len(w):
            sets.append(w)
            continue
        k = min(width, len(w))
        h = w[: len(w) - k + 1].copy()
        for j in range(1, k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j])
        sets.append(np.unique(mix(h + np.uint64(k))))
    return sets


def _run_digests(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each run of values."""
    return np.add.reduceat(mix(values + np.uint64(1)), starts), np.bitwise_xor.reduceat(mix(values * np.uint64(3)), starts)


def bands(most: int) -> np.ndarray:
    """The least size of each band of sizes, each half as large again as the one before."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-3 * out[-1] // 2)))
    return np.array(out)


def part_signatures(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """For each non-empty sorted set signatures of which linked sets share one.

    A pair whose larger set has a size in band k meets in scheme k. With u the
    greatest size of the band, linked sets of a and b differ in at most
    (a + b) (100 - percent) / (100 + percent) <= 2 u (100 - percent) / (100 + percent)
    shingles; the scheme cuts the hashes into more parts, so that some are equal. A
    set with so many empty parts that all equal ones may be empty gives the shingles
    of its prefix instead, in order of hash; so does its partner, and of these
    linked sets share one.
    """
    out: list[list[np.ndarray]] = [[] for _ in sets]
    sizes = np.array([len(x) for x in sets], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.uint64) for _ in sets]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    edge = bands(int(100 * sizes.max() // percent) + 1)
    low = np.searchsorted(edge, sizes, "right") - 1
    high = np.searchsorted(edge, 100 * sizes // percent, "right") - 1
    for step in range(int((high - low)[sizes > 0].max()) + 1):
        band = low + step
        live = (sizes > 0) & (band <= high)
        most = edge[np.minimum(band, len(edge) - 2) + 1] - 1
        apart = 2 * most * (100 - percent) // (100 + percent)
        parts = np.where(apart > 0, apart + apart // 20 + 4 + np.sqrt(apart).astype(np.int64), 1)
        keep = live[owner]
        own, values = owner[keep], flat[keep]
        place = ((values >> np.uint64(32)) * parts[own].astype(np.uint64)) >> np.uint64(32)
        cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (place[1:] != place[:-1])]))
        scheme = mix(band[own[cut]].astype(np.uint64) + np.uint64(101))
        made = mix(np.add.reduceat(mix(values * np.uint64(5) + np.uint64(9)), cut) + scheme + place[cut] * np.uint64(0x9E3779B97F4A7C15))
        filled = np.bincount(own[cut], minlength=len(sets))
        bound = (sizes + np.minimum(most, 100 * sizes // percent)) * (100 - percent) // (100 + percent)
        odd = live & (filled <= bound)
        for k, group in zip(np.flatnonzero(filled).tolist(), np.split(made, np.cumsum(filled[filled > 0])[:-1]), strict=True):
            out[k].append(group)
        for k in np.flatnonzero(odd).tolist():
            n = int(sizes[k])
            out[k].append(mix(sets[k][: n - -(-percent * n // 100) + 1] + mix(np.uint64(band[k] + 7001) * np.ones(1, np.uint64))))
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, 0 for an empty one."""
    sizes = np.array([len(x) for x in sets], np.int64)
    both = np.zeros((2, len(sets)), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        both[:, full] = _run_digests(np.concatenate(sets), starts)
    return both[0].view(np.int64), both[1].view(np.int64)


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, d1, d2, signatures): the size and digests of each set, and its signatures, once for equal sets that meet."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    last = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("signatures", last)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(batch.column("text"), PIECE):
                found = shingle_sets(texts, width)
                digests = _digests(found)
                first = np.zeros(len(found), bool)
                first[np.unique(digests[0], return_index=True)[1]] = True
                made = part_signatures([x if f else x[:0] for x, f in zip(found, first.tolist(), strict=True)], percent)
                flat, sizes = np.concatenate(made).view(np.int64), np.array([len(x) for x in made])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                cols = [pa.array([len(x) for x in found], pa.int64()), *map(pa.array, digests), lists]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), *cols], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n long, d1 long, d2 long, signatures array<bigint>")


def _sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(rep, bucket, reps, n, shingles) of the members (rep, bucket, reps) of buckets, from the texts."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("rep", to_arrow_type(kind)), ("bucket", pa.int64()), ("reps", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(batch.column("text"), PIECE):
                found = shingle_sets(texts, width)
                own = batch.slice(start, len(texts)).select(["rep", "bucket", "reps"])
                cols = [pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own.columns, *cols], schema=schema)

    wanted = docs.select(F.col("doc_id").alias("rep"), "text").join(members, "rep").select("rep", "bucket", "reps", "text")
    return wanted.mapInArrow(run, f"rep {kind.simpleString()}, bucket long, reps long, n long, shingles binary").where("n > 0")


# --- signature trees ---------------------------------------------------------


class SignatureTree:
    """A binary tree over sets in order of size; nodes OR their bitmaps and span their sizes."""

    LEAF = 16

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, excess: np.ndarray, labels: np.ndarray, low: int, high: int):
        self.low, self.high = low, high
        self.least, self.most = int(sizes[low]), int(sizes[high - 1])
        self.excess = int(excess[low:high].max())
        first = labels[low]
        self.label = int(first) if (labels[low:high] == first).all() else None
        self.parts: tuple[SignatureTree, SignatureTree] | None = None
        if high - low > self.LEAF:
            middle = (low + high) // 2
            self.parts = (SignatureTree(bits, sizes, excess, labels, low, middle), SignatureTree(bits, sizes, excess, labels, middle, high))
            self.bits = self.parts[0].bits | self.parts[1].bits
        else:
            self.bits = np.bitwise_or.reduce(bits[low:high], axis=0)


class Bitmaps:
    """Bitmaps of sets, wide enough for twice the largest set, and what collisions hide."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.excess = sizes - np.bitwise_count(words).sum(axis=1).astype(np.int64)

    def can_link(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether the pairs of rows (i, j) may reach the threshold."""
        a, b = self.sizes[i], self.sizes[j]
        shared = np.bitwise_count(self.words[i] & self.words[j]).sum(axis=1).astype(np.int64)
        return _can_link(np.minimum(shared + np.minimum(self.excess[i], self.excess[j]), np.minimum(a, b)), a, b, percent)


def bitmap_words(n: int, bits: int = 2, most: int = 1 << 12) -> int:
    """64-bit words of the bitmap of a set of n: a power of two with ``bits`` bits a shingle, or ``most``."""
    return min(most, max(1, 1 << max(0, math.ceil(bits * n / 64) - 1).bit_length()))


#: Up to so many shingles a bitmap of 2**16 bits travels as the numbers of its bits, two bytes each.
SPARSE = 1 << 13


def wide_bits(values: np.ndarray) -> bytes:
    """A wide bitmap of a set, for a pair that narrow ones do not rule out."""
    return np.unique(values.astype("<u2")).tobytes() if len(values) <= SPARSE else bitmap(values, bitmap_words(len(values), 8)).tobytes()


def wide_bitmap(n: int, raw: bytes) -> np.ndarray:
    if n > SPARSE:
        return np.frombuffer(raw, np.uint64)
    out = np.zeros(1 << 16, np.uint8)
    out[np.frombuffer(raw, "<u2")] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def bitmap(values: np.ndarray, words: int) -> np.ndarray:
    bit = values & np.uint64(words * 64 - 1)
    out = np.zeros(words * 64, np.uint8)
    out[bit.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, to: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    return np.bitwise_or.reduce(words.reshape(-1, to), axis=0)


def _can_link(overlap, a, b, percent: int):
    """Whether sets of sizes a and b with at most this overlap can reach the threshold."""
    return (100 + percent) * overlap >= percent * (a + b)


def tree_pairs(maps: Bitmaps, labels: np.ndarray, percent: int, split: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with different labels that bitmaps and sizes do not rule out, leaf pair by leaf pair.

    Rows are in order of size. With ``split``, only pairs of a row before it and
    a row from it on.
    """
    n = len(maps.sizes)
    if n < 2:
        return
    if split is None:
        root = SignatureTree(maps.words, maps.sizes, maps.excess, labels, 0, n)
        todo = [(root, root)]
    elif 0 < split < n:
        todo = [(SignatureTree(maps.words, maps.sizes, maps.excess, labels, 0, split), SignatureTree(maps.words, maps.sizes, maps.excess, labels, split, n))]
    else:
        return
    while todo:
        x, y = todo.pop()
        if x.label is not None and x.label == y.label:
            continue
        if 100 * x.most < percent * y.least or 100 * y.most < percent * x.least:
            continue
        if x is not y:
            overlap = min(x.most, y.most, int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.excess, y.excess))
            if not _can_link(overlap, x.least, y.least, percent):
                continue
        if x.parts and (y.parts is None or x.high - x.low >= y.high - y.low):
            if x is y:
                todo += [(x.parts[1], x.parts[1]), (x.parts[0], x.parts[1]), (x.parts[0], x.parts[0])]
            else:
                todo += [(p, y) for p in x.parts]
        elif y.parts:
            todo += [(x, p) for p in y.parts]
        else:
            i, j = np.meshgrid(np.arange(x.low, x.high), np.arange(y.low, y.high), indexing="ij")
            i, j = i.ravel(), j.ravel()
            keep = (labels[i] != labels[j]) & ((i < j) if x is y else True)
            a, b = maps.sizes[i], maps.sizes[j]
            keep &= (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
            i, j = i[keep], j[keep]
            if len(i):
                good = maps.can_link(i, j, percent)
                if good.any():
                    yield i[good], j[good]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on two sorted sets."""
    if not len(a) or not len(b):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _connect(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> np.ndarray:
    """The first row (in order of size) of each row's component within one part of a bucket; equal labels are connected."""
    sizes = np.array([len(s) for s in sets])
    words = bitmap_words(int(sizes[-1]))
    maps = Bitmaps(sizes, np.stack([bitmap(s, words) for s in sets]))
    root = np.unique(labels, return_index=True, return_inverse=True)
    root = root[1][root[2]]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for left, right in tree_pairs(maps, labels, percent):
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b and linked(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sets))])


def _grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of frames that come in order of their keys; a group may span frames."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        new[0] = bool(kept) and bool((frame[keys].iloc[0] != kept[-1][keys].iloc[-1]).any())
        done = 0
        for cut in np.flatnonzero(new).tolist():
            if cut > done:
                kept.append(frame.iloc[done:cut])
            yield pd.concat(kept)
            kept, done = [], cut
        kept.append(frame.iloc[done:])
    if kept:
        yield pd.concat(kept)


# --- the join ----------------------------------------------------------------


def _shared(signed: DataFrame) -> DataFrame:
    """(token, d1, reps): rows (token, d1) whose token other sets have too, with the number of its sets; one shuffle, read twice."""
    once = signed.repartition("token").groupBy("token", "d1").agg(F.lit(1).alias("one"))
    counts = once.groupBy("token").agg(F.count(F.lit(1)).alias("reps")).where("reps > 1")
    return once.join(counts.hint("shuffle_hash"), "token").select("token", "d1", "reps")


def _round(sets: DataFrame, percent: int, part: int, turn: int = 0) -> DataFrame:
    """(bucket, reps, rep, label, n, shingles) -> links (label, root) in each part of a bucket, connected by its signature tree."""
    parts = F.ceil(F.col("reps") / part).cast("int")
    rows = sets.where("reps > 1").select("bucket", F.pmod(F.xxhash64("rep", F.lit(turn)), parts).cast("int").alias("part"), "rep", "label", "n", "shingles")
    kind = sets.schema["rep"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(frames, ["bucket", "part"]):
            names, labels = np.unique(group["label"].to_numpy(), return_inverse=True)
            if len(names) < 2:
                continue
            root = _connect([np.frombuffer(b, "<u8") for b in group["shingles"]], labels, percent)
            least: dict[int, int] = {}
            for r, label in zip(root.tolist(), labels.tolist(), strict=True):
                least[r] = min(least.get(r, label), label)
            links = {(label, least[r]) for r, label in zip(root.tolist(), labels.tolist(), strict=True) if least[r] != label}
            if links:
                one, two = map(list, zip(*sorted(links), strict=True))
                yield pd.DataFrame({"label": names[one], "root": names[two]})

    ordered = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "n", "rep")
    return ordered.mapInPandas(run, f"label {kind}, root {kind}").distinct()


def _labelled(shared: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """(token, rep, n, label) of the shared tokens whose classes differ in component, by the links so far."""
    so_far = components(links).withColumnRenamed("node", "rep")
    labels = sets.select("rep", "n").distinct().join(so_far, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    members = shared.select("token", "rep").distinct().join(labels, "rep")
    mixed = members.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    return staged(members.join(mixed.select("token"), "token", "left_semi"), "members")


def _blocks(n: Column) -> Column:
    """The numbers from 0 to before n; none for null."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _placed(members: DataFrame, percent: int, part: int) -> DataFrame:
    """(token, rep, n, label) -> (token, rep, n, label, places), the places in blocks that meet: tile, slot, guest, side.

    A block (side 0) of a tile has about ``part`` reps at most. It meets itself
    (guest -1), each block before it in its tile, and each of the previous tile,
    one guest block (side 1) at a time.
    """
    who = [F.bit_xor(F.xxhash64(F.lit(seed), "rep", "n")).alias(f"who{seed}") for seed in (1, 2)]
    by_label = members.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("reps"), *who).where("a != b")
    # copies share many shingles: of buckets with the same classes one is enough
    by_label = by_label.groupBy("reps", "who1", "who2").agg(F.min("token").alias("token"))
    rows = members.join(by_label.select("token", "reps"), "token")
    step = 1.001 * math.log(100 / percent) if percent < 100 else 1.0  # a little more than the ratio that can link
    tile = F.floor(F.log(F.col("n").cast("double")) / step).cast("long")
    small = F.col("reps") <= part
    rows = rows.withColumn("tile", F.when(small, F.lit(-1)).otherwise(tile))
    tiles = rows.where(~small).groupBy("token", "tile").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    for name, shift in (("next", -1), ("previous", 1)):
        rows = rows.join(tiles.select("token", (F.col("tile") + shift).alias("tile"), F.col("parts").alias(name)), ["token", "tile"], "left")
    rows = rows.join(tiles, ["token", "tile"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    own, parts = F.col("own"), F.col("parts")

    def place(tile: Column, slot: Column, guest: Column, side: int) -> Column:
        return F.struct(tile.alias("tile"), slot.alias("slot"), guest.alias("guest"), F.lit(side).alias("side"))

    met = F.concat(F.array(F.lit(-1)), _blocks(own), F.transform(_blocks(F.col("previous")), lambda p: parts + p))
    home = F.transform(met, lambda p: place(F.col("tile"), own, p, 0))
    sideways = F.transform(F.filter(_blocks(parts), lambda p: p > own), lambda p: place(F.col("tile"), p, own, 1))
    onward = F.transform(_blocks(F.col("next")), lambda p: place(F.col("tile") + 1, p, F.col("next") + own, 1))
    return rows.select("token", "rep", "n", "label", F.concat(home, sideways, onward).alias("places"))


def _across(members: DataFrame, maps: DataFrame, percent: int, part: int) -> DataFrame:
    """(token, rep, n, label) -> pairs (a, b) of reps with different labels that the trees leave.

    A bucket of more than ``part`` reps is cut into tiles of similar size: tile k
    holds sizes from g**k to before g**(k+1), g the ratio of sizes that can link, in
    as many parts as it needs; a tile is joined with itself and the next one, a part
    with a part at a time.
    """
    placed = _placed(members, percent, part).join(maps, "rep").withColumn("place", F.explode("places")).select("token", "place.*", "rep", "n", "label", "bits")
    kind = members.schema["rep"].dataType.simpleString()
    keys = ["token", "tile", "slot", "guest"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(frames, keys):
            if group["label"].nunique() < 2:
                continue
            guests = int((group["side"] == 1).sum())
            split = None
            if group["guest"].iloc[0] >= 0:
                if guests in (0, len(group)):
                    continue
                group, split = pd.concat([group[group["side"] == 1], group[group["side"] == 0]]), guests
            sizes = group["n"].to_numpy()
            raw = [wide_bitmap(n, b) for n, b in zip(sizes.tolist(), group["bits"], strict=True)]
            words = min(map(len, raw))
            wide = Bitmaps(sizes, np.stack([fold(r, words) for r in raw]))
            narrow = bitmap_words(int(sizes.max()))
            narrow = Bitmaps(sizes, np.stack([fold(r, min(narrow, words)) for r in wide.words]))
            reps = group["rep"].to_numpy()
            left = []
            for i, j in tree_pairs(narrow, group["label"].to_numpy(), percent, split):
                good = wide.can_link(i, j, percent)
                left.append((reps[i[good]], reps[j[good]]))
            if left:
                one, two = map(np.concatenate, zip(*left, strict=True))
                yield pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)})

    ordered = placed.repartition(*keys).sortWithinPartitions(*keys, "side", "n", "rep")
    return ordered.mapInPandas(run, f"a {kind}, b {kind}").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, small: int = 500_000) -> DataFrame:
    """The pairs that the exact test links; the ids of few pairs are broadcast, so that only the sets that they need are shuffled."""
    needed = sets.select("rep", "n", "shingles")
    if pairs.count() <= small:
        ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
        needed = needed.join(F.broadcast(ids), "rep", "left_semi")
    left = needed.select(F.col("rep").alias("a"), F.col("shingles").alias("va"))
    right = needed.select(F.col("rep").alias("b"), F.col("shingles").alias("vb"))
    kind = pairs.schema["a"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(frame["va"], frame["vb"], strict=True)]
            yield frame.loc[np.array(good, bool), ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the least node of each component, by least-label contraction."""
    labels = None
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while not edges.isEmpty():
        # every node hooks to its least neighbour; chains of hooks end at roots and are then cut short
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = staged(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to")), "hooks")
        while True:
            jump = staged(hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")), "hooks")
            hook = jump.select("node", "to")
            if jump.where("moved").isEmpty():
                break
        if labels is None:
            labels = hook
        else:
            moved = labels.join(hook.select(F.col("node").alias("to"), F.col("to").alias("root")), "to", "left")
            labels = staged(moved.select("node", F.coalesce("root", "to").alias("to")), "labels")
        up = edges.join(hook.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(hook.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        edges = staged(up.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.select("node", F.col("to").alias("label"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, part: int = 512, turns: int = 3) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, set_first (the doc_id that stands for its set)."""
    signed = staged(profiles(docs, width, percent), "profiles")
    own = staged(signed.drop("signatures"), "digests")
    digest = ["n", "d1", "d2"]
    classes = own.where("n > 0").groupBy(*digest).agg(F.min("doc_id").alias("rep")).where("rep is not null")
    # equal sets have equal d1; the classes of a token are found before their least doc_ids travel
    tokens = staged(_shared(signed.select(F.explode("signatures").alias("token"), "d1")), "tokens")
    release(signed)
    shared = staged(tokens.join(classes.select("d1", "rep"), "d1").select("token", "rep", "reps"), "shared")
    release(tokens)
    # a class goes to its first shared signature; texts are read again rather than all sets kept
    first = shared.groupBy("rep").agg(F.min("token").alias("bucket"))
    counts = first.groupBy("bucket").agg(F.count(F.lit(1)).alias("reps"))
    sets = staged(_sets(docs, first.join(counts, "bucket"), width).withColumn("label", F.col("rep")), "sets")
    found = staged(_round(sets, percent, part), "round")
    joined, large = found, sets.where(F.col("reps") > part)
    while not found.isEmpty() and not large.isEmpty():
        # one class of each connected part of a large bucket goes on
        live = large.drop("reps").join(joined.select(F.col("label").alias("rep")), "rep", "left_anti")
        left = live.groupBy("bucket").agg(F.count(F.lit(1)).alias("reps"))
        live = staged(live.join(left, "bucket"), "live")
        found = staged(_round(live, percent, part), "round")
        joined, large = joined.unionByName(found), live.where(F.col("reps") > part)
    links = joined.select(F.col("label").alias("a"), F.col("root").alias("b"))
    members = _labelled(shared, sets, links)
    for turn in range(1, turns + 1):
        # another bucket for each class that still meets other components
        other = members.groupBy("rep").agg(F.min(F.struct(F.xxhash64("token", F.lit(turn)).alias("chance"), "token"))["token"].alias("bucket"), F.min("label").alias("label"))
        sizes = other.groupBy("bucket").agg(F.count(F.lit(1)).alias("reps"))
        found = staged(_round(sets.select("rep", "n", "shingles").join(other.join(sizes, "bucket"), "rep"), percent, part, turn), "round")
        if found.isEmpty():
            break
        links = links.unionByName(found.select(F.col("label").alias("a"), F.col("root").alias("b")))
        release(members)
        members = _labelled(shared, sets, links)
    pairs = staged(_across(members, _bitmaps(sets).drop("n"), percent, part), "pairs")
    links = links.unionByName(_verified(pairs, sets, percent))
    final = components(links).withColumnRenamed("node", "rep")  # it has read the links
    release(sets, pairs, members, shared)
    of_class = classes.select(*digest, "rep").join(final, "rep", "left").select(*digest, "rep", F.coalesce("label", "rep").alias("component_id"))
    out = own.select("doc_id", *digest).join(of_class, digest, "left")
    ids = {"component_id": "component_id", "set_first": "rep"}
    found = [F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col(c)).alias(name) for name, c in ids.items()]
    return out.select("doc_id", F.col("n").alias("n_shingles"), *found)


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(rep, n, bits) of (rep, n, shingles): the wide bitmaps."""
    kind = sets.schema["rep"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"rep": frame["rep"], "n": frame["n"], "bits": [wide_bits(np.frombuffer(b, "<u8")) for b in frame["shingles"]]})

    return sets.select("rep", "n", "shingles").mapInPandas(run, f"rep {kind}, n long, bits binary")
