"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

A mergeable Misra-Gries summary (``approx_top_k``) names the digests that may
be frequent; an exact count over all rows verifies them. The verified winners,
at most ``max_hot`` rows by construction, are broadcast and resolve their
copies on the map side without a shuffle. All other digests are shuffled as
usual. The summary misses nothing more frequent than rows / ``counters``, but only
its ``max_hot`` first ones are winners: a group outside them has at most rows /
``max_hot`` rows, or may be missed by the summary, and is resolved by the shuffle.

Texts are equal when identical after each run of ASCII white space became one
space. Nulls count as empty texts. Of equal texts the row with the smallest
doc_id stays; a null doc_id sorts last, and of repeated rows with one doc_id a
single one stays. An empty table gives an empty result; other columns of the
input are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, staged


def normalised(name: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(name), F.lit("")), SPACE, " ")


def rank() -> Column:
    """The order in which rows stay: by doc_id, nulls last."""
    return F.struct(F.col("doc_id").isNull(), F.col("doc_id"))


def frequent(digests: DataFrame, measures: list, max_hot: int, counters: int) -> DataFrame:
    """(digest, group_size and the other ``measures``) of at most ``max_hot`` verified frequent digests, staged."""
    summary = digests.agg(F.expr(f"approx_top_k(hex(digest), {max_hot}, {counters})").alias("top"))
    candidates = summary.select(F.explode("top").alias("c")).where(F.col("c.count") > 1).select(F.unhex("c.item").alias("digest"))
    hot = digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*measures).where("group_size > 1")
    return staged(hot, "hot-digests")


def decide(digests: DataFrame, max_hot: int = 1000, counters: int = 20_000) -> DataFrame:
    """(row_key, doc_id, digest) -> the same with keep_id, group_size and kept.

    ``digests`` is read several times: pass a staged table.
    """
    measures = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min_by("row_key", rank()).alias("winner")]
    hot = frequent(digests, measures, max_hot, counters)
    marked = digests.join(F.broadcast(hot), "digest", "left")
    out = ["row_key", "doc_id", "digest", "keep_id", "group_size", (F.col("row_key") == F.col("winner")).alias("kept")]
    alike = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select(
        "*",
        F.min("doc_id").over(alike).alias("keep_id"),
        F.count(F.lit(1)).over(alike).alias("group_size"),
        F.min_by("row_key", rank()).over(alike).alias("winner"),
    )
    return marked.where("winner is not null").select(*out).unionByName(rest.select(*out))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = docs.select(
        F.monotonically_increasing_id().alias("row_key"), "doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest")
    )
    found = decide(staged(digests, "digests"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, max_hot: int = 1000, counters: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies of frequent digests go on the map side, as their winners are broadcast;
    what is left is shuffled once, and of a digest's rows a partial aggregate sends one.
    """
    digest = F.unhex(F.sha2(normalised(), 256))
    digests = staged(docs.select("doc_id", digest.alias("digest")), "digests")
    hot = frequent(digests, [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")], max_hot, counters)
    rows = docs.select("doc_id", digest.alias("digest"), F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]).alias("row"))
    marked = rows.join(F.broadcast(hot), "digest", "left")
    left = marked.where(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return left.groupBy("digest").agg(F.min_by("row", rank()).alias("row")).select("row.*")
