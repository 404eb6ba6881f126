"""Schema conformance, status changes, retention, merges by key and the run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.operators.key_filter import key_filter, with_may_hold
from shortlist.sources.staging import staged
from pyspark.sql import types as T

#: The columns of the postings table; every one but ``url`` may be null.
POSTINGS = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("url", "title", "company", "location", "site", "strategy", "salary", "description", "full_description", "application_url", "date_posted", "detail_error", "status", "status_reason", "fit_summary", "gap_summary", "keywords", "score_reasoning", "score_error", "tailored_resume_path", "cover_letter_path", "apply_error", "notify_error")],
        *[T.StructField(c, T.TimestampType()) for c in ("discovered_at", "detail_scraped_at", "scored_at", "tailored_at", "cover_letter_at", "applied_at", "notified_at")],
        *[T.StructField(c, T.IntegerType()) for c in ("fit_score", "tailor_attempts", "cover_attempts")],
        *[T.StructField(c, T.LongType()) for c in ("discovery_run_id", "enrich_run_id", "score_run_id", "tailor_run_id")],
    ]
)


def conform(df: DataFrame, schema: T.StructType = POSTINGS, defaults: dict[str, object] | None = None) -> DataFrame:
    """All columns of the schema, missing ones as nulls, defaults filled in, other columns kept; blank status is active."""
    defaults = {"tailor_attempts": 0, "cover_attempts": 0} if defaults is None else defaults
    have, out = set(df.columns), []
    for f in schema:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name == "status":
            c = F.coalesce(F.nullif(c, F.lit("")), F.lit("active"))
        elif f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        out.append(c.alias(f.name))
    known = {f.name for f in schema}
    return df.select(*out, *[c for c in df.columns if c not in known])


def mark_status(df: DataFrame, condition: Column, status: str, reason: Column | str) -> DataFrame:
    """Set status and status_reason where the condition is true."""
    hit = F.coalesce(condition, F.lit(False))
    old = F.col("status_reason") if "status_reason" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"status_reason": F.when(hit, reason if isinstance(reason, Column) else F.lit(reason)).otherwise(old), "status": F.when(hit, status).otherwise(F.col("status"))})


def mark_low_score(df: DataFrame, min_score: int) -> DataFrame:
    low = (F.col("status") == "active") & (F.col("fit_score") < min_score)
    return mark_status(df, low, "low_score", F.concat(F.lit("score "), F.col("fit_score").cast("string"), F.lit(f" is under {min_score}")))


def expire(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """Active rows discovered (or else scored) more than ``days`` before ``as_of`` expire."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    old = F.coalesce("discovered_at", "scored_at").cast("timestamp_ntz") < cutoff
    return mark_status(df, (F.col("status") == "active") & old, "expired", f"older than {days} days")


def prune(df: DataFrame, as_of: str, days: int, statuses: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): inactive rows scored (or else discovered) more than ``days`` before ``as_of`` go."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    kind = F.col("status").isin(statuses) if statuses else F.col("status") != "active"
    gone = F.coalesce(kind & (F.coalesce("scored_at", "discovered_at").cast("timestamp_ntz") < cutoff), F.lit(False))
    return df.where(~gone), df.where(gone)


def update_by_key(df: DataFrame, changes: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """The rows of ``df`` with ``columns`` recomputed where ``changes`` has the key.

    The expressions see ``df``'s columns and those of ``changes`` with the prefix
    ``new_``. ``changes`` has one row a key.
    """
    new = changes.select(*[F.col(c).alias(f"new_{c}") for c in changes.columns])
    joined = df.join(new, F.col(key) == F.col(f"new_{key}"), "left")
    hit = F.col(f"new_{key}").isNotNull()
    made = [F.when(hit, columns[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*made)


def upsert(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Merge ``new`` into ``old``; a rule for each column: keep (old first), replace (new), or fill (new, else old)."""
    a = old.select(*[F.col(c).alias(f"old_{c}") for c in old.columns])
    b = new.select(*[F.col(c).alias(f"new_{c}") for c in new.columns])
    joined = a.join(b, F.col(f"old_{key}") == F.col(f"new_{key}"), "full_outer")
    out = [F.coalesce(f"old_{key}", f"new_{key}").alias(key)]
    for c in old.columns:
        if c == key:
            continue
        was, now = F.col(f"old_{c}"), F.col(f"new_{c}")
        rule = rules.get(c, "fill")
        value = F.coalesce(was, now) if rule == "keep" else F.when(F.col(f"new_{key}").isNotNull(), now).otherwise(was) if rule == "replace" else F.coalesce(now, was)
        out.append(value.alias(c))
    return joined.select(*out)


def insert_new(existing: DataFrame, batch: DataFrame, key: str, order: list[str], stored: DataFrame | None = None, bits: int = 1 << 24) -> DataFrame:
    """The rows of ``batch`` to store: the first of each key that ``existing`` does not have.

    With ``stored``, a filter of the keys of ``existing`` (``key_filter`` with ``bits``), rows whose keys it surely does not hold are
    new without a join. The others meet only those stored keys that a filter of their own lets
    through, so that most of ``existing`` is scanned for its key column and never shuffled.
    """
    from shortlist.operators.dedup import first_per_key

    fresh = first_per_key(batch.where(F.col(key).isNotNull() & (F.col(key) != "")), key, order).select(*batch.columns)
    if stored is None:
        return fresh.join(existing.select(key), key, "left_anti").select(*batch.columns)
    marked = staged(with_may_hold(fresh, key, stored, bits, "__may"), "marked")
    doubtful = marked.where("__may")
    asked = with_may_hold(existing.select(key), key, key_filter(doubtful, key, bits), bits, "__may").where("__may").select(key)
    return marked.where("not __may").unionByName(doubtful.join(asked, key, "left_anti").select(*marked.columns)).select(*batch.columns)


def run_state(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """The current state of runs from their append-only start and finish events."""
    last = finishes.groupBy("run_id").agg(F.max_by(F.struct("status", "finished_at", "summary_json"), "finished_at").alias("f"))
    return starts.join(last, "run_id", "left").select("run_id", "started_at", F.coalesce("f.status", F.lit("running")).alias("status"), F.col("f.finished_at").alias("finished_at"), F.col("f.summary_json").alias("summary_json"))


def run_report(events: DataFrame) -> DataFrame:
    """Per run: stages, failed stages, elapsed time, and its status (error, partial or ok)."""
    return events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("stages"), F.count_if(F.col("status") == "error").alias("failed"), F.sum("elapsed").alias("elapsed"),
        F.when(F.count_if(F.col("status") == "error") == F.count(F.lit(1)), "error").when(F.count_if(F.col("status") != "ok") > 0, "partial").otherwise("ok").alias("status"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "error", F.col("stage")))), ",").alias("errors"),
    )


def stage_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Stage counts of two one-row tables side by side: stage, before, after, change."""
    long = lambda df, name: df.unpivot([], df.columns, "stage", name)
    return long(before, "before").join(long(after, "after"), "stage").select("stage", "before", "after", (F.col("after") - F.col("before")).alias("change"))
