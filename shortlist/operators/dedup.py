"""Deduplication of postings by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark_duplicates(df: DataFrame, order: list[str], min_score: int = 7) -> DataFrame:
    """Add ``dedup_rank`` and ``dedup_status``: of active rows that score enough, the best of each title and company stays.

    Rows without a company compare by title alone. The best is the highest score,
    then the earliest scored, then ``order``. Rows outside the contest keep their
    status and a null rank. One window serves both cases and no join is needed.
    """
    company = F.coalesce(F.lower(F.nullif("company", F.lit(""))), F.lit(""))
    entered = (F.col("status") == "active") & (F.col("fit_score") >= min_score) & F.col("title").isNotNull()
    inside = df.where(entered)
    best = Window.partitionBy(F.lower("title"), company).orderBy(F.col("fit_score").desc(), F.col("scored_at").asc(), *order)
    ranked = inside.withColumn("dedup_rank", F.row_number().over(best))
    ranked = ranked.withColumn("dedup_status", F.when(F.col("dedup_rank") > 1, "duplicate").otherwise(F.col("status")))
    rest = df.where(~F.coalesce(entered, F.lit(False))).withColumns({"dedup_rank": F.lit(None).cast("int"), "dedup_status": F.col("status")})
    return ranked.unionByName(rest)


def digest_best(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per title and company as a digest shows them: best score, then newest scored."""
    tidy = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    key = [F.regexp_replace(tidy(F.col("title")), "/+$", ""), tidy(F.col("company"))]
    best = Window.partitionBy(*key).orderBy(F.col("fit_score").desc(), F.col("scored_at").desc(), *order)
    return df.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by arrival."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn = 1").drop("rn")


def dedup_summary(marked: DataFrame) -> DataFrame:
    no_company = F.coalesce(F.col("company"), F.lit("")) == ""
    gone = F.col("dedup_rank") > 1
    return marked.agg(
        F.count_if(gone & ~no_company).alias("by_title_company"),
        F.count_if(gone & no_company).alias("by_title"),
        F.count_if(F.col("dedup_rank") == 1).alias("remaining"),
    )
