"""Totals, histograms, queues and lists over postings and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.operators.filters import pending


def stages(attempts: int = 5, min_score: int = 7) -> dict[str, Column]:
    """The condition of each stage count."""
    active = F.col("status") == "active"
    has = lambda c: F.col(c).isNotNull()
    no_letter = F.col("cover_letter_path").isNull() | (F.col("cover_letter_path") == "")
    spent = lambda c: F.coalesce(F.col(c), F.lit(0)) >= attempts
    return {
        "total": F.lit(True),
        "inactive": F.col("status") != "active",
        "pending_detail": active & ~has("detail_scraped_at"),
        "with_description": active & has("full_description"),
        "detail_errors": has("detail_error"),
        "scored": active & has("fit_score"),
        "unscored": active & has("full_description") & ~has("fit_score"),
        "tailored": active & has("tailored_resume_path"),
        "untailored_eligible": active & (F.col("fit_score") >= min_score) & has("full_description") & ~has("tailored_resume_path"),
        "tailor_exhausted": active & spent("tailor_attempts") & ~has("tailored_resume_path"),
        "with_cover_letter": active & has("cover_letter_path"),
        "cover_exhausted": active & spent("cover_attempts") & no_letter,
        "applied": active & has("applied_at"),
        "apply_errors": has("apply_error"),
        "ready_to_apply": active & has("cover_letter_path") & ~has("applied_at") & has("application_url"),
    }


def pipeline_stats(df: DataFrame, attempts: int = 5, min_score: int = 7) -> DataFrame:
    """All stage counts in one pass."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in stages(attempts, min_score).items()])


def stats_changes(df: DataFrame, before: Column, attempts: int = 5, min_score: int = 7) -> DataFrame:
    """Stage counts of the rows that were there ``before`` and of all rows, from one pass: stage, before, after, change."""
    counts = stages(attempts, min_score)
    both = df.agg(*[F.count_if(c & when).alias(f"{when_name}_{n}") for n, c in counts.items() for when_name, when in (("b", before), ("a", F.lit(True)))])
    pairs = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"b_{n}").alias("before"), F.col(f"a_{n}").alias("after")) for n in counts])
    return both.select(F.explode(pairs).alias("s")).select("s.*").withColumn("change", F.col("after") - F.col("before"))


def by_site(df: DataFrame) -> DataFrame:
    return df.where("status = 'active'").groupBy("site").agg(F.count(F.lit(1)).alias("postings"))


def score_distribution(df: DataFrame) -> DataFrame:
    return df.where("status = 'active' and fit_score is not null").groupBy("fit_score").agg(F.count(F.lit(1)).alias("postings"))


def score_histogram(df: DataFrame) -> DataFrame:
    """Scores 10 to 1, empty ones as 0, with the share of the fullest one."""
    counts = df.where("fit_score is not null").groupBy("fit_score").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, 11).select(F.col("id").cast("int").alias("fit_score"))
    filled = every.join(counts, "fit_score", "left").select("fit_score", F.coalesce("n", F.lit(0)).alias("postings"))
    most = F.greatest(F.max("postings").over(Window.partitionBy()), F.lit(1))
    return filled.select("fit_score", "postings", F.round(F.col("postings") * 100.0 / most, 1).alias("percent"))


def site_report(df: DataFrame) -> DataFrame:
    s = F.col("fit_score")
    return df.groupBy("site").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s >= 7).alias("high"), F.count_if(s.between(5, 6)).alias("mid"), F.count_if(s < 5).alias("low"),
        F.count_if(s.isNull()).alias("unscored"), F.round(F.avg(s), 1).alias("avg_score"),
    )


def site_shares(report: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.col(c) * 100.0 / F.greatest("total", F.lit(1)), 1).alias(f"{c}_percent")
    return report.select("site", share("high"), share("mid"))


def dashboard_totals(df: DataFrame, high: int = 7) -> DataFrame:
    ready = F.col("full_description").isNotNull() & F.col("application_url").isNotNull()
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(ready).alias("ready"), F.count_if(F.col("fit_score").isNotNull()).alias("scored"), F.count_if(F.col("fit_score") >= high).alias("high_fit"))


def discovery_totals(results: DataFrame, *by: str) -> DataFrame:
    """Sums over searches by source (or ``by``: employer and query, say), and over all (nulls)."""
    return results.rollup(*(by or ["source"])).agg(F.sum("new").alias("new"), F.sum("existing").alias("existing"), F.sum("errors").alias("errors"))


def batch_counts(batch: DataFrame, by: str = "site") -> DataFrame:
    """How many rows of a batch come from each site, the fullest first."""
    return batch.groupBy(by).agg(F.count(F.lit(1)).alias("postings")).orderBy(F.col("postings").desc(), F.col(by).asc_nulls_last())


def usage_totals(ledger: DataFrame, *by: str) -> DataFrame:
    return ledger.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost"), 4).alias("cost"))


def pending_count(df: DataFrame, stage: str, min_score: int = 7) -> DataFrame:
    return df.where(pending(stage, min_score)).agg(F.count(F.lit(1)).alias("pending"))


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows, or all of them where k is not positive; ``order`` should be total."""
    ranked = df.orderBy(*order)
    return ranked.limit(k) if k > 0 else ranked


def by_fit(*ties: str) -> list[Column]:
    return [F.col("fit_score").desc_nulls_last(), F.col("discovered_at").desc_nulls_last(), *map(F.col, ties)]


def dashboard_list(df: DataFrame, min_score: int = 5, preview: int = 300) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for pair in ((10, "perfect"), (9, "excellent"), (8, "strong"), (7, "good"), (6, "fair"), (5, "weak")) for x in pair])
    text = F.coalesce("full_description", "description", F.lit(""))
    return df.where(F.col("fit_score") >= min_score).withColumns({"preview": F.substring(text, 1, preview), "label": labels[F.col("fit_score")]})


def with_breaks(df: DataFrame, order: list[str]) -> DataFrame:
    """Mark where the score changes in a list and how many rows share the score; rows without a score are a section too."""
    counts = df.groupBy(F.col("fit_score").alias("section")).agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(*order)).alias("head"))
    joined = df.join(counts, F.col("fit_score").eqNullSafe(F.col("section")))
    return joined.withColumn("new_section", F.struct(*order) == F.col("head")).drop("head", "section")


def search(df: DataFrame, min_score: int, text: str) -> DataFrame:
    line = F.lower(F.concat_ws(" ", "title", "company", "location", "description"))
    return df.where((F.col("fit_score") >= min_score) & line.contains(text.lower()))
