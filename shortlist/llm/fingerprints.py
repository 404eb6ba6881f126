"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A document is the bag of its lower-cased words, each weighted by how often it
stands there. For each of ``samples`` draws and each word, two Gamma(2, 1)
variables and a uniform one come from hashes of the word; the word whose
gamma-based value is least is sampled, with the step of its weight. Two bags
share a sample with the probability of their generalised Jaccard similarity, the
sum of least weights over the sum of greatest ones.

``neighbours`` pairs each document with the next one in descending order of
doc_id by one shuffle: documents are dealt to buckets by ranges of doc_id, and the
first document of each bucket is sent to the bucket above it as well (the very
first one to the lowest). What the driver sees is one id for each bucket.

doc_ids are whole numbers. Null texts are empty; an empty bag has the empty fingerprint, alike to itself (1)
and unlike any other (0). Null doc_ids come last; repeated ids are ordered by a
hash of their text. A single document is its own neighbour. An empty table gives
an empty result. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

LOWEST = -(2**63)


def neighbours(docs: DataFrame, buckets: int, partitions: int) -> DataFrame:
    """(bucket, place, doc_id, ghost, text, next_text) in descending order; ghosts are the copies sent upwards."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    ids = docs.select(key.alias("key"))
    steps = [i / buckets for i in range(1, buckets)]
    bounds = ids.agg(F.percentile_approx("key", steps, 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(edges, lambda b: b < F.col("key")))
    firsts = ids.select("key", bucket.alias("bucket")).groupBy("bucket").agg(F.max("key").alias("key")).orderBy("bucket").collect()
    own = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = own.withColumns({"bucket": bucket, "ghost": F.lit(False)})
    if firsts:
        above = [r["bucket"] for r in firsts[1:]] + [firsts[0]["bucket"]]
        target = F.create_map(*[F.lit(x) for r, to in zip(firsts, above, strict=True) for x in (r["key"], to)])
        keys = [r["key"] for r in firsts]
        wanted = F.col("doc_id").isin([k for k in keys if k != LOWEST]) | (F.col("doc_id").isNull() if LOWEST in keys else F.lit(False))
        rows = rows.unionByName(own.where(wanted).withColumns({"bucket": target[F.col("key")], "ghost": F.lit(True)}))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("key").desc(), F.xxhash64("text"))
    dealt = rows.repartition(partitions, "bucket")
    return dealt.select("bucket", F.row_number().over(order).alias("place"), "doc_id", "ghost", "text", F.lead("text").over(order).alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by as many first ones of ``other``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(F.coalesce(other, F.lit("")), F.lit(1), half))


def words(text: Column) -> Column:
    """The words of a text; the one word of a blank text is null."""
    parts = F.split(F.lower(F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))), SPACE)
    return parts


def sample(term: Column, log_weight: Column, j: int) -> Column:
    """A number that orders terms by their gamma-based value, with the sampled (term, step) in its low 32 bits."""
    part = lambda x, shift, bits: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(2**bits - 1)).cast("double") + 0.5) / float(2**bits)
    a, b = F.xxhash64(term, F.lit(2 * j)), F.xxhash64(term, F.lit(2 * j + 1))
    r = -F.log(part(a, 0, 31) * part(a, 31, 31))
    c = -F.log(part(b, 0, 24) * part(b, 24, 24))
    beta = part(b, 48, 16)
    step = F.floor(log_weight / r + beta)
    value = F.log(c) - r * (step - beta + 1.0)
    order = F.floor((value + 128.0) * float(2**23)).cast("long")
    return F.shiftleft(order, 32) + F.xxhash64(term, step).bitwiseAND(F.lit(2**32 - 1))


def signatures(bags: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """(keys, term, weight) -> (keys, signature): an array of ``samples`` longs; empty for a bag of the null term alone."""
    logs = bags.select(*keys, "term", F.log(F.col("weight").cast("double")).alias("log_weight"))
    least = logs.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("log_weight"), j)).alias(f"s{j}") for j in range(samples)])
    low = [F.col(f"s{j}").bitwiseAND(F.lit(2**32 - 1)) for j in range(samples)]
    return least.select(*keys, F.when(F.col("s0").isNotNull(), F.array(*low)).otherwise(F.array().cast("array<bigint>")).alias("signature"))


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples, an estimate of the generalised Jaccard similarity."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(same / F.greatest(F.size(a), F.size(b)))


def fingerprint(docs: DataFrame, keys: list[str], samples: int = 32) -> DataFrame:
    """(keys, signature) of each row's text; ``keys`` identify a row."""
    terms = docs.select(*keys, F.explode(words(F.coalesce("text", F.lit("")))).alias("word"))
    bags = terms.groupBy(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term")).agg(F.count(F.lit(1)).alias("weight"))
    return signatures(bags, keys, samples)


def compare_edited(docs: DataFrame, samples: int = 32) -> DataFrame:
    """One row per document with its fingerprint, its edited text's, and the likeness to that and to the next document."""
    partitions = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = neighbours(docs, 2 * partitions, partitions)
    changed = pairs.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    base = changed.where(~F.col("ghost")).select("bucket", "place", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    # ghosts close their bucket: only the text of the first one matters
    sides = F.array(F.col("text"), F.col("edited"))
    # doc_id is in the keys so that both uses of the pairs need the same columns, and share one shuffle
    both = changed.select("bucket", "place", "doc_id", F.posexplode(sides).alias("side", "text"))
    keys = ["bucket", "place", "doc_id", "side"]
    found = fingerprint(both, keys, samples)
    order = Window.partitionBy("bucket").orderBy("place", "side")
    ahead = found.select(*keys, "signature", F.lead("signature", 1).over(order).alias("own"), F.lead("signature", 2).over(order).alias("next")).where("side = 0").drop("side", "doc_id")
    joined = base.join(ahead, ["bucket", "place"])
    return joined.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("own")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("own")).alias("near_edited"), likeness(F.col("signature"), F.col("next")).alias("near_next"),
    )
