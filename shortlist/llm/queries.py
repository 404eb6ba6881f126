"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, exact_dedup, filter_audit, fingerprints, hard_negatives, jaccard_join, mixing, quality, simhash, suffix_dedup, token_files, toxicity
from .common import held_out, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _bpe() -> byte_bpe.ByteBPE:
    return byte_bpe.ByteBPE(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find_repeats(_table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), _bpe())


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 sound but toxic, 2 sound; kept from grade 1 on."""
    docs = _table(spark, sf_dir, "documents")
    ratings = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    graded = quality.grade(docs, quality.fit(docs, ratings), at_least=1)
    return graded.select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_probability", "keep")


def with_replies(talks: DataFrame) -> DataFrame:
    """The messages, three of four of them after a quote of the first two lines that stand one to three turns before.

    The table quotes nothing; so quoting replies are made of its own messages, by a
    hash of conversation and turn.
    """
    back = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)).cast("int")
    said = talks.where("conv_id is not null and turn is not null").groupBy(F.col("conv_id").alias("said_in"), F.col("turn").alias("said_at")).agg(F.min("text").alias("said"))
    replies = talks.withColumn("back", back).join(said, (F.col("conv_id") == F.col("said_in")) & (F.col("turn") - F.col("back") == F.col("said_at")) & (F.col("back") > 0), "left")
    quote = F.transform(F.slice(F.split("said", "\n"), 1, 2), lambda line: F.concat(F.lit("> "), line))
    return replies.select("conv_id", "turn", "role", F.when(F.col("said").isNull(), F.col("text")).otherwise(F.concat_ws("\n", F.array_join(quote, "\n"), F.col("text"))).alias("text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotes(with_replies(_table(spark, sf_dir, "conversations")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_files.WordEncoder(vocabulary, end_id=1)
    path = token_files.new_path(spark)
    token_files.write_files(_table(spark, sf_dir, "documents"), path, encoder, encoder.vocabulary(vocabulary))
    return token_files.with_starts(staged(token_files.read_files(spark, path), "read-back"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("places.shard").alias("shards"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every seventh vec_id is moved on by one, so that some rows are near others of a wrong label."""
    rows = _table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("vec_id") % 100 == 0, k=5, percent=80, scale=256)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=2, width=3)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failing(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_suffix_dedup, op3_byte_bpe, op4_jaccard_join, op5_quality,
        op6_chat_format, op7_token_files, op8_mixing, op9_exact_dedup, op10_fingerprints,
        op11_hard_negatives, op12_simhash, op13_filter_audit,
    )
}

ORACLE = {
    "op9_exact_dedup": r"""
        with n as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
        )
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
        from n window w as (partition by t)
    """,
    "op11_hard_negatives": """
        with c as (
            select vec_id, label, embedding, generate_subscripts(embedding, 1) as i, unnest(embedding) as x from embeddings
        ), odd as (
            select distinct vec_id from c where x is null or isnan(x) or isinf(x)
        ), w as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list(cast(floor(256 * cast(x as double)) as double) order by i) as v
            from c where label is not null and vec_id not in (from odd) group by vec_id, label
        ), s as (
            select a.vec_id as anchor_id, w.vec_id, w.label = a.label as same, cast(list_inner_product(a.v, w.v) as bigint) as score
            from w a join w on a.vec_id <> w.vec_id where a.vec_id % 100 = 0
        ), p as (
            select anchor_id, vec_id as positive_id, score as positive_score from s where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
        )
        select anchor_id, positive_id, cast(row_number() over k as int) as rank, vec_id as negative_id, positive_score, score as negative_score
        from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
        window k as (partition by anchor_id, positive_id order by score desc, vec_id)
        qualify row_number() over k <= 5
    """,
    "op13_filter_audit": r"""
        with d as (
            select coalesce(source, '') as part, coalesce(text, '') as t, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
                   exists (select 1 from labels l where l.doc_id = documents.doc_id and l.quality = 1) as good,
                   exists (select 1 from labels l where l.doc_id = documents.doc_id and l.toxic = 1) as toxic
            from documents
        ), f as (
            select part, good, toxic, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
                   100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
                   coalesce(doc_id > min(doc_id) over (partition by t), false) as e
            from d
        ), k as (
            select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end
                   || case when d then 'D' else '' end || case when e then 'E' else '' end as fails,
                   count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
            from f group by all
        ), letters(x) as (
            values ('A'), ('B'), ('C'), ('D'), ('E')
        ), orders as (
            select v.x || w.x || x.x || y.x || z.x as filter_order from letters v, letters w, letters x, letters y, letters z
            where len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5
        ), steps as (
            select filter_order, cast(step as int) as step, filter_order[step] as own, filter_order[1:step - 1] as before from orders, range(1, 6) r(step)
        ), m as (
            select part, filter_order, step, own, n, good, toxic, fails,
                   contains(fails, own) as hit, regexp_matches(fails, '[_' || before || ']') as earlier
            from k, steps
        ), g as (
            select part, filter_order, step, own, cast(sum(case when not hit and not earlier then n else 0 end) as bigint) as kept,
                   cast(sum(case when hit and not earlier then n else 0 end) as bigint) as removed, cast(sum(case when hit and earlier then n else 0 end) as bigint) as redundant,
                   cast(sum(case when fails = own then n else 0 end) as bigint) as unique_fails,
                   cast(sum(case when hit and not earlier then good else 0 end) as bigint) as good_lost, cast(sum(case when hit and not earlier then toxic else 0 end) as bigint) as toxic_lost
            from m group by part, filter_order, step, own
        )
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               cast(sum(removed) over (partition by part, own) as bigint) as shapley from g
    """,
}
