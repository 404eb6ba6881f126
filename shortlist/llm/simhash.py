"""SimHash near-duplicates by covering locality-sensitive hashing.

The fingerprint of a document has the bits that are set in over half the XXH64 hashes of its
shingles (``width`` words, repeats included; words ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z,
joined by one space; fewer words are one shingle of all; without words it is zero). Documents
link when their fingerprints differ in at most ``radius`` bits.

Masks: each bit is given one of the 2**(radius + 1) - 1 non-zero vectors of radius + 1 bits, by
turns; for every non-zero vector v one mask keeps the bits whose vector has an odd product with v.
Any ``radius`` vectors leave some v orthogonal to all of them, so that two fingerprints within the
radius agree under that mask: they surely meet in its table, and a mask keeps over half the bits.

1. Equal fingerprints form a class, so that copies are one row of all that follows.
2. A bucket (mask, masked fingerprint) of up to ``part`` classes is linked in one task, which gives
   a spanning forest of its links rather than its pairs.
3. In larger buckets each class is sent to every value that flips at most ceil(radius / 2)
   of its bits outside the mask. Two classes within the radius share such a value, and
   the classes at one value lie within twice that of each other. For an even radius all of them link, so each is linked to the
   least of them; for an odd one the value's classes are linked like a small bucket. A value has
   1 + C(64, 1) + .. classes at most, whatever the table holds, so nothing is capped.
4. Components of all links, by repeated contraction.

Null texts are empty: their fingerprint is zero and links like any other. A row without a doc_id
has the component of its fingerprint; a component without any id has null. Rows that share a
doc_id are judged each by its text, and the component of each holds that id. A text is handled
whole in one task's memory. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .jaccard_join import components

BITS = 64


def fingerprint(text: str, width: int = 3, seed: int = 42, step: int = 1 << 16) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = text.encode().lower().split()
    if not words:
        return 0
    k = min(width, len(words))
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: len(words) - k + 1].tolist()
    end = end[k - 1 :].tolist()
    of, set_bits = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(begin), step):
        hashes = np.array([of(line[a:b], seed) for a, b in zip(begin[at : at + step], end[at : at + step], strict=True)], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(begin), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of each document as a long with the same bits."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py() or "", width, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The masks; for any ``radius`` bits one of them keeps none of these bits."""
    many = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % many + 1) & v).bit_count() & 1) for v in range(1, many + 1)]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, each as (row, row)."""
    left, out = np.arange(len(values)), []
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            at, reached = reached[0], reached[1:]
            near = np.bitwise_count(values[left] ^ values[at]) <= radius
            out += [(int(at), int(x)) for x in left[near]]
            reached, left = np.concatenate([reached, left[near]]), left[~near]
    return out


def _forests(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links (a, b) of the rows (keys, fp), found group by group of the keys; a group fits a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def links(last: bool) -> Iterator[pa.RecordBatch]:
            key, fp = (np.concatenate(x, axis=-1) for x in zip(*kept, strict=True))
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cut.tolist(), *[fp.size] * last]
            a, b = [], []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                for i, j in forest(fp[low:high].view(np.uint64), radius) if high - low > 1 else ():
                    a.append(fp[low + i])
                    b.append(fp[low + j])
            kept[:] = [(key[:, bounds[-1] :], fp[bounds[-1] :])]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                kept.append((np.stack([batch.column(i).to_numpy() for i in range(len(keys))]), batch.column(len(keys)).to_numpy()))
                yield from links(last=False)
        if kept:
            yield from links(last=True)

    ordered = rows.select(*[F.col(k).cast("long").alias(k) for k in keys], "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return ordered.mapInArrow(run, "a long, b long")


def links(classes: DataFrame, radius: int = 2, part: int = 1024) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp), whose components are those of all pairs within ``radius``."""
    masks = covering_masks(radius)
    signed = lambda m: m - (1 << BITS) if m >> BITS - 1 else m
    tables = F.array(*[F.struct(F.lit(t).alias("mask_no"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
    rows = classes.select("fp", F.inline(tables))
    sizes = rows.groupBy("mask_no", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = staged(rows.join(sizes, ["mask_no", "key"]), "met")
    small = _forests(met.where(F.col("size") <= part), ["mask_no", "key"], radius)

    free = [[signed(1 << i) for i in range(BITS) if not m >> i & 1] for m in masks]
    flips = F.get(F.array(*[F.lit(x) for x in free]), F.col("mask_no"))
    values = F.array(F.col("fp"))
    for _ in range((radius + 1) // 2):
        values = F.array_distinct(F.concat(values, F.flatten(F.transform(values, lambda v: F.transform(flips, lambda bit: v.bitwiseXOR(bit))))))
    near = met.where(F.col("size") > part).select("fp", F.explode(values).alias("value")).distinct()
    if radius % 2:
        large = _forests(near, ["value"], radius)
    else:
        least = near.groupBy("value").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        large = least.select(F.explode("all").alias("a"), "b").where("a != b")
    return small.unionByName(large)


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, part: int = 1024) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lower-case hex digits), component_id."""
    own = staged(fingerprints(docs, width), "fingerprints")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("fp"), radius, part)).withColumnsRenamed({"node": "fp", "label": "root"})
    rooted = classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(first, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(of_class, "fp", "left").select("doc_id", digits.alias("fingerprint"), "component_id")
