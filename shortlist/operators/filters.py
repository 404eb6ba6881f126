"""Filters and predicates on postings."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.functions.text import normal_phrase

#: Words that make a location remote, whatever else it says (fixed values).
REMOTE_WORDS = ["remote", "anywhere", "work from home", "wfh", "distributed"]


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def location_ok(location: Column, accept: list[str], reject: list[str], remote: list[str] = REMOTE_WORDS) -> Column:
    """Unknown and remote places pass; then rejected, then accepted substrings decide; others fail."""
    low = F.lower(location)
    has = lambda words: any_of(low.contains(w.lower()) for w in words)
    return F.when(location.isNull() | (location == ""), True).when(has(remote), True).when(has(reject), False).when(has(accept), True).otherwise(False)


def title_excluded(title: Column, phrases: list[str]) -> Column:
    """Whether the title holds one of the phrases as whole words."""
    padded = F.concat(F.lit(" "), normal_phrase(title), F.lit(" "))
    tidy = [" ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in p.lower()).split()) for p in phrases]
    return any_of(padded.contains(f" {p} ") for p in tidy if p)


def _active() -> Column:
    return F.col("status") == "active"


def pending(stage: str, min_score: int = 7, attempts: int = 5) -> Column:
    """Which rows a stage still has to work on."""
    described, fit = F.col("full_description").isNotNull(), F.col("fit_score") >= min_score
    tries = lambda c: F.coalesce(F.col(c), F.lit(0)) < attempts
    no_letter = F.col("cover_letter_path").isNull() | (F.col("cover_letter_path") == "")
    stages = {
        "enrich": _active() & F.col("detail_scraped_at").isNull(),
        "score": _active() & described & F.col("fit_score").isNull(),
        "tailor": _active() & fit & described & F.col("tailored_resume_path").isNull() & tries("tailor_attempts"),
        "cover": _active() & fit & described & no_letter & tries("cover_attempts"),
        "pending_apply": _active() & (F.col("tailored_resume_path").isNotNull() | fit) & F.col("applied_at").isNull() & F.col("application_url").isNotNull(),
    }
    stages |= {f"pending_{new}": stages[old] for new, old in (("detail", "enrich"), ("score", "score"), ("tailor", "tailor"))}
    if stage not in stages:
        raise ValueError(f"unknown stage: {stage}")
    return stages[stage]


def snapshot(stage: str, min_score: int | None = None) -> Column:
    """Which rows have reached a stage; ``min_score`` holds where scores matter."""
    reached = {"enriched": "full_description", "scored": "fit_score", "tailored": "tailored_resume_path", "prepped": "cover_letter_path", "applied": "applied_at"}
    if stage == "discovered":
        return _active()
    if stage not in reached:
        return pending(stage, 7 if min_score is None else min_score)
    found = _active() & F.col(reached[stage]).isNotNull()
    return found & (F.col("fit_score") >= min_score) if min_score is not None and stage in ("scored", "tailored", "applied") else found


def skip_sites(names: list[str]) -> Column:
    """True for rows to keep; a null site is not kept."""
    return ~F.col("site").isin(names)


def blocked(sites: list[str], url_patterns: list[str]) -> Column:
    return F.coalesce(F.col("site").isin(sites) | any_of(F.col("url").ilike(p) for p in url_patterns), F.lit(False))


def host_listed(url: Column, domains: list[str]) -> Column:
    """Whether the URL holds one of the domains (sites that need a hand, sign-in pages)."""
    return F.coalesce(any_of(F.lower(url).contains(d) for d in domains), F.lit(False))


def filter_counts(df: DataFrame, by: str, place_ok: Column, title_bad: Column) -> DataFrame:
    """Per search: total, location_filtered, title_filtered, kept; titles are only looked at where the place passes."""
    flagged = df.select(by, place_ok.alias("ok"), title_bad.alias("bad"))
    out = flagged.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok")).alias("location_filtered"), F.count_if(F.col("ok") & F.col("bad")).alias("title_filtered"), F.count_if(F.col("ok") & ~F.col("bad")).alias("kept"))
    return out
