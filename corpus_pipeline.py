"""A corpus pipeline of five stages over ``documents``; each stage's table is written and read again.

The stages read doc_id, text, lang, source and n_chars, and leave any other column behind; an
empty table passes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.llm import byte_bpe, exact_dedup, jaccard_join, mixing, toxicity
from shortlist.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the compression-distance model rejects go.

    Null and empty texts have the score of a text without words; repeated rows and
    rows without an id are judged like others; without labels every text has the same
    score, 0, and all stay. Whole texts count, however long.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: the row with the smallest doc_id of equal texts stays.

    Null texts equal empty ones; of rows that share a doc_id and a text one stays; a
    null doc_id comes last.
    """
    return exact_dedup.drop_exact_copies(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): the smallest doc_id of each component stays.

    Texts without words (null, empty) are no near copies and stay. Rows that share a
    doc_id go or stay together; rows without one stay.
    """
    found = jaccard_join.near_duplicates(docs, width=5, percent=80)
    gone = staged(found.where("component_id is not null and component_id != doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents repeat or rest so that the words of sources meet their target weights.

    The last document of a source is cut where its target is met. A null source is
    the last one; documents without words are drawn by no source, and go; repeated
    rows are drawn each by itself; an empty table gives an empty one.
    """
    # two hashes of its contents name a row
    keyed = docs.withColumns({f"row_{seed}": F.xxhash64(F.lit(seed), *COLUMNS) for seed in (1, 2)})
    mixed = mixing.mix(keyed, ["row_1", "row_2", "doc_id"], order_by=["doc_id"])
    drawn = mixing.repeat_rows(keyed, mixed, ["row_1", "row_2"])
    return drawn.withColumn("n_chars", F.when(F.col("whole"), F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of every text that stays, and the proof that they decode to it.

    Null texts are empty and have no ids; each repeated row has a row of its own.
    """
    bpe = byte_bpe.ByteBPE(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    return byte_bpe.round_trip(docs, bpe)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Toxicity scores and tokens are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
