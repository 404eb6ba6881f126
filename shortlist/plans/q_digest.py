"""Digests and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.operators import digest as D
from shortlist.plans import bindings as B
from shortlist.plans.base import query
from shortlist.plans.q_ingest import CANON
from shortlist.plans.q_rules import ID, ID_SQL
from shortlist.sources import tables
from shortlist.sources.staging import scratch

PRINTS = f"""prints as (select *, sha256(case when {CANON.format(c='application_url')} <> '' then 'application_url:' || {CANON.format(c='application_url')} when {CANON.format(c='url')} <> '' then 'url:' || {CANON.format(c='url')} else 'role' end) as primary_fp,
    sha256('role:' || {CANON.format(c='title')} || '|' || {CANON.format(c='company')} || '|' || {CANON.format(c='location')}) as role_fp from postings)"""
OLD = "discovered_at < timestamp '1996-06-01'"
HISTORY = f"""hist_rows as (select primary_fp as fingerprint, discovered_at as seen_at, fit_score, url from prints where {OLD} union all select role_fp, discovered_at, fit_score, url from prints where {OLD}),
    hist as (select fingerprint, min(seen_at) as first_notified_at, max(seen_at) as last_seen_at, arg_max(fit_score, (coalesce(fit_score, -1), url)) as fit_score from hist_rows group by 1)"""
CANDS = "cands as (select * from prints where status = 'active' and fit_score >= 8 and notified_at is null)"
SEEN = f"{PRINTS}, {HISTORY}, {CANDS}, seen as (select *, primary_fp in (select fingerprint from hist) or role_fp in (select fingerprint from hist) as was_seen from cands)"
BEST = "best as (select *, row_number() over (partition by rtrim(lower(trim(title)), '/'), lower(trim(coalesce(company, ''))) order by fit_score desc, scored_at desc, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as rn from seen where not was_seen)"


def history(spark, d):
    return D.history_rows(B.postings(spark, d).where(OLD), F.col("discovered_at"))


def keyed(spark, d):
    """Postings with a key of their own, as urls repeat."""
    return B.postings(spark, d).withColumn("k", F.xxhash64(*B.K))


@query(f"with {PRINTS} select {ID_SQL}, primary_fp, role_fp from prints")
def d1_fingerprints(spark, d):
    return D.with_fingerprints(B.postings(spark, d)).select(*ID, "primary_fp", "role_fp")


@query(f"with {PRINTS}, {CANDS} select {ID_SQL}, title, fit_score from cands")
def d2_digest_candidates(spark, d):
    return D.digest_candidates(B.postings(spark, d), 8).select(*ID, "title", "fit_score")


@query(f"with {SEEN} select {ID_SQL}, was_seen as seen from seen")
def d3_bucketed_history(spark, d):
    """As below, with the history stored by buckets of its fingerprints, so that it is not shuffled."""
    path = scratch(spark, "history")
    known = tables.write_bucketed(history(spark, d), f"history_{path[-32:]}", "fingerprint", 16, path)
    return D.split_by_history(D.digest_candidates(keyed(spark, d), 8), known, "k").select(*ID, "seen")


@query(f"with {SEEN} select {ID_SQL}, was_seen as seen from seen")
def d3_suppress_history(spark, d):
    return D.split_by_history(D.digest_candidates(keyed(spark, d), 8), history(spark, d), "k").select(*ID, "seen")


@query(f"""with {SEEN}, {BEST}, sent as (select *, scored_at as seen_at from best where rn = 1),
    new_rows as (select primary_fp as fingerprint, seen_at, fit_score, url from sent union all select role_fp, seen_at, fit_score, url from sent),
    fresh as (select fingerprint, min(seen_at) as first_notified_at, max(seen_at) as last_seen_at, arg_max(fit_score, (coalesce(fit_score, -1), url)) as fit_score from new_rows group by 1)
    select coalesce(h.fingerprint, f.fingerprint) as fingerprint, cast(coalesce(h.first_notified_at, f.first_notified_at) as date) as first_day, cast(coalesce(f.last_seen_at, h.last_seen_at) as date) as last_day,
        case when f.fingerprint is not null then f.fit_score else h.fit_score end as fit_score from hist h full join fresh f on h.fingerprint = f.fingerprint""")
def d4_upsert_history(spark, d):
    sent = D.digest(keyed(spark, d), history(spark, d), 8, "k", B.K)
    merged = D.upsert_history(history(spark, d), sent, F.col("scored_at"))
    return merged.select("fingerprint", F.col("first_notified_at").cast("date").alias("first_day"), F.col("last_seen_at").cast("date").alias("last_day"), "fit_score")


@query(f"""with {PRINTS}, r as (select primary_fp as fingerprint, notified_at as seen_at from prints where notified_at is not null union all select role_fp, notified_at from prints where notified_at is not null)
    select fingerprint, cast(min(seen_at) as date) as first_day, cast(max(seen_at) as date) as last_day from r group by 1""")
def d5_backfill_history(spark, d):
    return D.backfill_history(B.postings(spark, d)).select("fingerprint", F.col("first_notified_at").cast("date").alias("first_day"), F.col("last_seen_at").cast("date").alias("last_day"))


@query(f"with {SEEN}, {BEST} select {ID_SQL}, title, company, fit_score from best where rn = 1")
def d6_digest(spark, d):
    return D.digest(keyed(spark, d), history(spark, d), 8, "k", B.K).select(*ID, "title", "company", "fit_score")


@query(f"with {SEEN}, {BEST} select count(*) as postings, max(fit_score) as top_score, count(*) filter (fit_score >= 9) as urgent from best where rn = 1")
def d6_digest_header(spark, d):
    return D.digest_header(D.digest(keyed(spark, d), history(spark, d), 8, "k", B.K))


ESC = "replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
LINK = "case when lower(coalesce(application_url, '')) in ('none', 'null', '') then url else application_url end"


@query(f"""
    select {ID_SQL}, case when fit_score >= 9 then '🔥' else '⭐' end || ' <b>[' || coalesce(fit_score, 7) || ']</b> <a href="' || {ESC.format(c=LINK)} || '">' || title || '</a>' || chr(10) || coalesce(company, site) || ' · ' || location || chr(10) || chr(10) ||
        regexp_replace(case when full_description is null then description else split_part(full_description, '. ', 2) end, '[#_.]', '', 'g') as card from postings""")
def d7_card_text(spark, d):
    return B.postings(spark, d).select(*ID, D.card_text().alias("card"))


@query(f"""select {ID_SQL}, '• <b>[' || coalesce(fit_score, 7) || ']</b> <a href="' || {ESC.format(c='url')} || '">' || substr(title, 1, 60) || '</a> — ' || substr(coalesce(company, site), 1, 30) || ' · ' || substr(location, 1, 25) || ' — knows ' || site as line from postings""")
def d8_compact_line(spark, d):
    from shortlist.operators.responses import parse_reasoning

    none = F.lit(None).cast("string")
    rows = B.postings(spark, d).withColumn("fit", parse_reasoning(F.col("score_reasoning"), none, none, none)["fit"])
    return rows.select(*ID, D.compact_line(F.col("fit")).alias("line"))


@query()
def d9_pack_messages(spark, d):
    """Digest lines of each supplier packed into messages."""
    rows = B.postings(spark, d).select(F.col("l_suppkey").alias("profile"), *[F.col(c).alias(f"o_{c}") for c in B.K], D.compact_line(F.lit("")).alias("line"))
    return D.pack_messages(rows, "profile", [f"o_{c}" for c in B.K], 1000)


@query(f"""
    select {ID_SQL}, cast(case when l_partkey % 4 in (0, 1) then discovered_at else notified_at end as date) as notified, case l_partkey % 4 when 1 then 'posting closed: HTTP 404' when 2 then 'no route' end as notify_error from postings""")
def d10_delivery_merge(spark, d):
    p = keyed(spark, d)
    kind = F.when(F.col("l_partkey") % 4 == 0, "sent").when(F.col("l_partkey") % 4 == 1, "closed").when(F.col("l_partkey") % 4 == 2, "failed")
    outcomes = p.select("k", kind.alias("outcome"), F.when(F.col("l_partkey") % 4 == 1, "HTTP 404").otherwise("no route").alias("reason"), F.col("discovered_at").alias("at")).where("outcome is not null")
    return D.delivery_merge(p, outcomes, "k").select(*ID, F.col("notified_at").cast("date").alias("notified"), "notify_error")


@query(f"select {ID_SQL}, fit_score >= 8 as gets_card, fit_score >= 6 as gets_line from postings where fit_score >= 6")
def d11_threshold(spark, d):
    p = B.postings(spark, d).where(F.col("fit_score") >= D.threshold(6, cards=False))
    return p.select(*ID, (F.col("fit_score") >= D.threshold(6, cards=True)).alias("gets_card"), F.lit(True).alias("gets_line"))


@query(f"""
    select {ID_SQL}, title, coalesce(company, site) as company, application_url as link, 'Letter ' || cover_letter_path as letter, substr(score_reasoning, 1, 200) as reasoning from postings
    where status = 'active' and cover_letter_path is not null and applied_at is null and application_url is not null and cover_letter_path <> '' order by fit_score desc nulls last, scored_at desc nulls last, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 25""")
def d12_apply_pack(spark, d):
    p = B.postings(spark, d).where("cover_letter_path <> '' or cover_letter_path is null")
    letters = p.where("cover_letter_path is not null").select(F.col("cover_letter_path").alias("path")).distinct().select("path", F.concat(F.lit("Letter "), "path").alias("letter"), F.lit("resume").alias("resume"))
    return D.apply_pack_rows(p, letters, 25, ID).select(*ID, "title", "company", "link", "letter", "reasoning")


@query("""
    with o as (select case when l_linenumber = 1 then 'suppressed' when l_partkey % 4 = 0 then 'sent' when l_partkey % 4 = 1 then 'closed' else 'failed' end as outcome from postings where fit_score >= 8)
    select count(*) filter (outcome = 'sent') as sent, count(*) filter (outcome <> 'suppressed') as fresh, count(*) filter (outcome = 'suppressed') as suppressed, count(*) filter (outcome = 'closed') as closed, count(*) filter (outcome = 'failed') as failed, count(*) filter (outcome in ('closed', 'suppressed')) as marked_without_card from o""")
def a12_digest_report(spark, d):
    kind = F.when(F.col("l_linenumber") == 1, "suppressed").when(F.col("l_partkey") % 4 == 0, "sent").when(F.col("l_partkey") % 4 == 1, "closed").otherwise("failed")
    return D.digest_report(B.postings(spark, d).where("fit_score >= 8").select(kind.alias("outcome")))
