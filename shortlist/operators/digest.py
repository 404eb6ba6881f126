"""Digests of new postings, repost suppression by fingerprints, and message texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.functions.text import canonical, html_escape, short_summary
from shortlist.operators.dedup import digest_best
from shortlist.operators.lifecycle import upsert
from shortlist.operators.packing import pack_messages  # noqa: F401

HISTORY = ["fingerprint", "first_notified_at", "last_seen_at", "url", "application_url", "title", "company", "location", "fit_score"]
HISTORY_RULES = {"first_notified_at": "keep", "last_seen_at": "replace", "fit_score": "replace"}


def with_fingerprints(df: DataFrame) -> DataFrame:
    """Add ``primary_fp`` (apply URL, else URL, else role) and ``role_fp`` (title, company, location)."""
    # the canonical texts are columns first: each is made once, though several branches use it
    named = {"primary_fp": canonical(F.col("application_url")), "role_fp": F.concat(F.lit("role:"), F.concat_ws("|", *[canonical(F.col(c)) for c in ("title", "company", "location")]))}
    apply_url, role = F.col("primary_fp"), F.col("role_fp")
    url = canonical(F.col("url"))
    basis = F.when(apply_url != "", F.concat(F.lit("application_url:"), apply_url)).otherwise(F.coalesce(F.concat(F.lit("url:"), F.nullif(url, F.lit(""))), role))
    return df.withColumns(named).withColumns({"primary_fp": F.sha2(basis, 256), "role_fp": F.sha2(role, 256)})


def threshold(min_score: int, cards: bool) -> int:
    """Cards go out from score 8 at least; other channels use the given score."""
    return max(min_score, 8) if cards else min_score


def digest_candidates(df: DataFrame, min_score: int) -> DataFrame:
    return df.where((F.col("status") == "active") & (F.col("fit_score") >= min_score) & F.col("notified_at").isNull())


def split_by_history(candidates: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Candidates with ``seen``: whether either fingerprint is in the history."""
    printed = with_fingerprints(candidates)
    known = history.select("fingerprint").distinct()
    hits = printed.select(key, F.explode(F.array("primary_fp", "role_fp")).alias("fingerprint")).join(known, "fingerprint", "left_semi").select(key).distinct()
    return printed.join(hits.withColumn("hit", F.lit(True)), key, "left").withColumn("seen", F.coalesce("hit", F.lit(False))).drop("hit")


def history_rows(sent: DataFrame, at: Column) -> DataFrame:
    """Two history rows for each sent posting; of rows with one fingerprint the best scored stays."""
    rows = with_fingerprints(sent).withColumn("at", at)
    both = rows.select(F.explode(F.array("primary_fp", "role_fp")).alias("fingerprint"), "at", *HISTORY[3:])
    best = F.max_by(F.struct(*HISTORY[3:]), F.struct(F.coalesce("fit_score", F.lit(-1)), "url"))
    kept = both.groupBy("fingerprint").agg(F.min("at").alias("first_notified_at"), F.max("at").alias("last_seen_at"), best.alias("r"))
    return kept.select("fingerprint", "first_notified_at", "last_seen_at", *[F.col(f"r.{c}").alias(c) for c in HISTORY[3:]])


def upsert_history(history: DataFrame, sent: DataFrame, at: Column) -> DataFrame:
    return upsert(history.select(*HISTORY), history_rows(sent, at), "fingerprint", HISTORY_RULES)


def backfill_history(df: DataFrame) -> DataFrame:
    """History of rows that were notified before there was one."""
    return history_rows(df.where("notified_at is not null"), F.col("notified_at"))


def digest(df: DataFrame, history: DataFrame, min_score: int, key: str, order: list[str]) -> DataFrame:
    """The rows of a digest: candidates that history does not know, one a posting."""
    fresh = split_by_history(digest_candidates(df, min_score), history, key).where(~F.col("seen"))
    return digest_best(fresh, order).drop("seen", "primary_fp", "role_fp")


def digest_header(rows: DataFrame, urgent: int = 9) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("postings"), F.max("fit_score").alias("top_score"), F.count_if(F.col("fit_score") >= urgent).alias("urgent"))


def link_of(df_apply: Column, url: Column) -> Column:
    """The apply URL unless it is blank or says none, else the URL."""
    return F.when(F.lower(F.coalesce(df_apply, F.lit(""))).isin("none", "null", ""), F.coalesce(url, F.lit(""))).otherwise(df_apply)


def card_text(urgent: int = 9, most: int = 1200) -> Column:
    """One posting as a card of at most ``most`` characters."""
    mark = F.when(F.col("fit_score") >= urgent, "🔥").otherwise("⭐")
    # fixed values: what stands for missing parts
    part = lambda names, empty: html_escape(F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(empty)))
    title, link = part(["title"], "Untitled"), html_escape(link_of(F.col("application_url"), F.col("url")))
    score = F.coalesce("fit_score", F.lit(7)).cast("string")
    head = F.when(link != "", F.concat(mark, F.lit(" <b>["), score, F.lit(']</b> <a href="'), link, F.lit('">'), title, F.lit("</a>"))).otherwise(F.concat(mark, F.lit(" <b>["), score, F.lit("] "), title, F.lit("</b>")))
    place = F.concat(part(["company", "site"], "Unknown company"), F.lit(" · "), part(["location"], "Location unclear"))
    text = html_escape(short_summary(F.coalesce(F.nullif("full_description", F.lit("")), "description")))
    return F.substring(F.concat_ws("\n", head, place, F.lit(""), text), 1, most)


def compact_line(fit: Column) -> Column:
    """A posting on one line: title 60, company 30, location 25, first line of the fit 80 characters."""
    cut = lambda names, n, empty: F.substring(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names], F.lit(empty)), 1, n)
    short = F.trim(F.ltrim(F.trim(F.substring(F.substring_index(F.coalesce(fit, F.lit("")), "\n", 1), 1, 80)), F.lit("•-– ")))
    line = F.concat(F.lit("• <b>["), F.coalesce(F.col("fit_score"), F.lit(7)).cast("string"), F.lit(']</b> <a href="'), html_escape(F.col("url")), F.lit('">'), cut(["title"], 60, "Untitled"), F.lit("</a> — "), cut(["company", "site"], 30, "?"), F.lit(" · "), cut(["location"], 25, "?"))
    return F.concat(line, F.when(short != "", F.concat(F.lit(" — "), short)).otherwise(""))


def delivery_merge(df: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Outcomes (key, outcome, reason, at): sent and closed rows count as notified, failed ones keep an error alone."""
    o = outcomes.select(F.col(key).alias("o_key"), "outcome", "reason", "at")
    joined = df.join(o, F.col(key) == F.col("o_key"), "left")
    done = F.col("outcome").isin("sent", "closed")
    error = F.when(F.col("outcome") == "sent", F.lit(None).cast("string")).when(F.col("outcome") == "closed", F.concat(F.lit("posting closed: "), F.col("reason"))).when(F.col("outcome") == "failed", F.col("reason"))
    return joined.withColumns({"notified_at": F.when(done, F.col("at")).otherwise(F.col("notified_at")), "notify_error": error}).drop("o_key", "outcome", "reason", "at")


def digest_report(outcomes: DataFrame) -> DataFrame:
    """(outcome, closed_reason): counters of one delivery run."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    return outcomes.agg(n("sent").alias("sent"), (n("sent") + n("closed") + n("failed")).alias("fresh"), n("suppressed").alias("suppressed"), n("closed").alias("closed"), n("failed").alias("failed"), (n("closed") + n("suppressed")).alias("marked_without_card"))


def apply_pack_rows(df: DataFrame, letters: DataFrame, k: int, ties: list[str]) -> DataFrame:
    """What an application needs for the k best ready postings; letters (path, letter, resume) by path."""
    ready = (F.col("status") == "active") & F.col("cover_letter_path").isNotNull() & F.col("applied_at").isNull() & F.col("application_url").isNotNull()
    chosen = df.where(ready).orderBy(F.col("fit_score").desc_nulls_last(), F.col("scored_at").desc_nulls_last(), *ties)
    chosen = chosen.limit(k) if k > 0 else chosen
    joined = chosen.join(letters, chosen["cover_letter_path"] == letters["path"], "left")
    return joined.select(*ties, "title", F.coalesce("company", "site").alias("company"), "location", "salary", F.col("application_url").alias("link"), "letter", F.substring("resume", 1, 3000).alias("resume"), F.substring("score_reasoning", 1, 200).alias("reasoning"))
