"""Model requests, responses, validators, usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.functions import text as X
from shortlist.operators import lifecycle, quality, responses
from shortlist.plans import bindings as B
from shortlist.plans.base import query
from shortlist.plans.q_reports import COSTED, priced
from shortlist.plans.q_rules import ID, ID_SQL, hits


def _candidates(spark):
    return spark.createDataFrame([("a", "widget maker", ["Spark", "SQL"]), ("b", "", [])], "profile string, target_role string, skills array<string>")


@query("""
    with c(profile, candidate) as (values ('a', 'Target role: widget maker' || chr(10) || 'Skills: Spark, SQL'), ('b', 'Target role: not specified' || chr(10) || 'Skills: not specified'))
    select profile, url, candidate || chr(10) || chr(10) || 'TITLE: ' || title || chr(10) || 'COMPANY: ' || coalesce(company, site, 'N/A') || chr(10) || 'LOCATION: ' || location || chr(10) || 'DESCRIPTION: ' || substr(coalesce(full_description, ''), 1, 6000) as request
    from postings, c where fit_score is null and status = 'active'""")
def g1_score_requests(spark, d):
    return responses.score_requests(B.postings(spark, d).where("fit_score is null and status = 'active'"), _candidates(spark), "url")




def _flat(raw):
    """The lines of a response and the marker that each belongs to, in SQL."""
    return f"""lines as (select url, attempt, raw, i, trim(line) as line from (select url, attempt, raw, generate_subscripts(string_split({raw}, chr(10)), 1) as i, unnest(string_split({raw}, chr(10))) as line from responses)),
        marked as (select *, case when starts_with(line, 'SCORE:') then 'SCORE' when starts_with(line, 'FIT:') then 'FIT' when starts_with(line, 'GAP:') then 'GAP' when starts_with(line, 'KEYWORDS:') then 'KEYWORDS' end as m from lines),
        opened as (select *, last_value(m ignore nulls) over (partition by url, attempt order by i rows between unbounded preceding and current row) as k from marked),
        bits as (select url, attempt, raw, i, case when line = '' or k is null then 'remainder' else k end as k, case when m is not null then trim(substr(line, length(m) + 2)) else line end as v from opened),
        fields as (select url, attempt, any_value(raw) as raw, {", ".join(f"coalesce(string_agg(v, chr(10) order by i) filter (k = '{k}' and v <> ''), '') as f_{k.lower()}" for k in ("SCORE", "FIT", "GAP", "KEYWORDS", "remainder"))} from bits group by url, attempt)"""


@query(f"with {_flat('raw')} select url, attempt, f_score as score, f_fit as fit, f_gap as gap, f_keywords as matched, f_remainder as remainder from fields")
def g2_marker_lines(spark, d):
    m = responses.parse_marker_lines(F.col("raw"), ["SCORE", "FIT", "GAP", "KEYWORDS"])
    rows = B.responses(spark, d).select("url", "attempt", m.alias("m"))
    return rows.select("url", "attempt", F.col("m.SCORE").alias("score"), F.col("m.FIT").alias("fit"), F.col("m.GAP").alias("gap"), F.col("m.KEYWORDS").alias("matched"), F.col("m.remainder").alias("remainder"))


@query(rf"""with {_flat('raw')} select url, attempt, case when regexp_extract(f_score, '\d+') <> '' then least(10, greatest(1, cast(regexp_extract(f_score, '\d+') as int))) end as score,
    case when regexp_extract(f_score, '\d+') = '' then 'no score in: ' || substr(raw, 1, 200) end as error from fields""")
def g3_parse_score(spark, d):
    return B.responses(spark, d).withColumn("r", responses.parse_score(F.col("raw"))).select("url", "attempt", F.col("r.score").alias("score"), F.col("r.error").alias("error"))


@query("""
    select url, attempt, case when attempt % 4 < 3 then cast(json_object('n', attempt, 't', raw) as varchar) end as json, case when attempt % 4 = 3 then 'no JSON in response' end as json_error from responses""")
def g4_extract_json(spark, d):
    """JSON in responses: plain, fenced, with text around it, and none."""
    body = F.to_json(F.struct(F.col("attempt").alias("n"), F.col("raw").alias("t")))
    text = F.when(F.col("attempt") % 4 == 0, body).when(F.col("attempt") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\ndone"))).when(F.col("attempt") % 4 == 2, F.concat(F.lit("Here "), body, F.lit(" trailing } brace"))).otherwise("no json")
    return responses.extract_json(B.responses(spark, d).select("url", "attempt", text.alias("response")), "response").select("url", "attempt", "json", "json_error")


@query("select url, attempt, trim(case when position('score' in lower(raw)) > 0 then substr(raw, position('score' in lower(raw))) else raw end) as body from responses")
def g5_strip_preamble(spark, d):
    return B.responses(spark, d).select("url", "attempt", responses.strip_preamble(F.col("raw"), "SCORE").alias("body"))


@query(f"""
    select {ID_SQL}, case when l_partkey % 3 = 0 then cast(l_partkey % 10 + 1 as int) else fit_score end as fit_score, case when l_partkey % 3 = 0 then 'METHOD: model' || chr(10) || 'FIT: f' || l_partkey || chr(10) || 'KEYWORDS: k' else score_reasoning end as score_reasoning,
        case when l_partkey % 3 = 1 then 'bad reply' end as score_error, cast(case when l_partkey % 3 <> 2 then discovered_at else scored_at end as date) as scored from postings""")
def g6_merge_scores(spark, d):
    p = B.postings(spark, d).withColumn("k", F.xxhash64(*B.K))
    good = F.col("l_partkey") % 3 == 0
    results = p.where("l_partkey % 3 <> 2").select("k", F.when(good, (F.col("l_partkey") % 10 + 1).cast("int")).alias("score"), F.concat(F.lit("f"), "l_partkey").alias("fit"), F.lit("").alias("gap"), F.lit("k").alias("keywords"), F.when(~good, "bad reply").alias("error"), F.lit("model").alias("method"))
    merged = responses.merge_scores(p, results, "k", F.col("discovered_at"), F.lit(17))
    return merged.select(*ID, "fit_score", "score_reasoning", "score_error", F.col("scored_at").cast("date").alias("scored"))


@query(f"select {ID_SQL}, case when l_linenumber = 2 then 'own' else 'knows ' || site end as fit, 'no ' || split_part(split_part(score_reasoning, 'GAP: no ', 2), chr(10), 1) as gap from postings")
def g7_parse_reasoning(spark, d):
    own = F.when(F.col("l_linenumber") == 2, " own ").otherwise("")
    none = F.lit(None).cast("string")
    return B.postings(spark, d).withColumn("r", responses.parse_reasoning(F.col("score_reasoning"), own, none, none)).select(*ID, F.col("r.fit").alias("fit"), F.col("r.gap").alias("gap"))


TERMS = ["idiot", "and", "la", "email", "der"]
BANNED_SQL = "array_to_string((" + hits("lower(text)", TERMS) + ")[1:5], ', ')"


@query(f"select doc_id, {BANNED_SQL} as banned from documents")
def g8_banned_terms(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.array_join(quality.banned_terms(F.col("text"), TERMS), ", ").alias("banned"))


FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
N = f"(case when {FLAT} = '' then 0 else len(string_split({FLAT}, ' ')) end)"


@query(rf"""
    with e as (select doc_id, case when contains(text, '—') or contains(text, '–') then 'long dash' end as e1, case when {BANNED_SQL} <> '' then 'banned: ' || {BANNED_SQL} end as e2, case when {N} > 250 then 'too long: ' || {N} end as e3,
        case when contains(lower(text), 'password') then 'self-talk: password' end as e4, case when not starts_with(trim(lower(text)), 'the') then 'no salutation' end as e5 from documents)
    select doc_id, e1 is null and e2 is null and e3 is null and e4 is null and e5 is null as passed, concat_ws('; ', e1, e2, e3, e4, e5) as errors from e""")
def g9_validate_letter(spark, d):
    verdict = quality.validate_letter(F.col("text"), "strict", TERMS, ["password"], "the")
    return B.table(spark, d, "documents").withColumn("v", verdict).select("doc_id", F.col("v.passed").alias("passed"), F.array_join("v.errors", "; ").alias("errors"))


@query(f"select doc_id, not (contains(text, '—') or contains(text, '–')) as passed, case when {BANNED_SQL} <> '' then 'banned: ' || {BANNED_SQL} else '' end as warnings from documents")
def g10_validate_resume_text(spark, d):
    return B.table(spark, d, "documents").withColumn("v", quality.validate_resume_text(F.col("text"), "normal", TERMS)).select("doc_id", F.col("v.passed").alias("passed"), F.array_join("v.warnings", "; ").alias("warnings"))


def _resume_json(spark, d):
    n = F.col("doc_id")
    data = F.struct(F.when(n % 3 != 0, F.col("lang")).alias("title"), F.when(n % 5 != 0, F.col("text")).alias("summary"), F.lit("invented x").alias("skills"), F.col("source").alias("experience"), F.when(n % 2 == 0, F.lit("school")).alias("education"))
    return B.table(spark, d, "documents").select("doc_id", F.to_json(data).alias("data"))


@query("""
    with e as (select doc_id, concat_ws(', ', case when doc_id % 3 = 0 then 'title' end, case when doc_id % 5 = 0 then 'summary' end, case when doc_id % 2 <> 0 then 'education' end) as missing from documents)
    select doc_id, case when missing = '' then '' else 'missing: ' || missing || '; ' end || 'invented: invented' as errors, false as passed from e""")
def g11_validate_resume_json(spark, d):
    return _resume_json(spark, d).withColumn("v", quality.validate_resume_json(F.col("data"), "normal", ["zzz"])).select("doc_id", F.array_join("v.errors", "; ").alias("errors"), F.col("v.passed").alias("passed"))


@query("select doc_id, trim(translate(replace(regexp_replace(text, ' *— *', ', ', 'g'), '–', '-'), '“”‘’', '\"\"''''')) as plain from documents")
def g12_sanitize_text(spark, d):
    return B.table(spark, d, "documents").select("doc_id", X.plain_punctuation(F.col("text")).alias("plain"))


@query()
def g13_assemble_document(spark, d):
    """Resume texts put together from JSON built of the documents."""
    entry = F.struct(F.col("source").alias("header"), F.col("lang").alias("subtitle"), F.split("text", "\n").alias("bullets"))
    data = F.to_json(F.struct(F.col("lang").alias("title"), F.col("text").alias("summary"), F.create_map(F.lit("Tools"), F.col("source")).alias("skills"), F.array(entry).alias("experience"), F.array(entry).alias("projects"), F.lit("School").alias("education")))
    return B.table(spark, d, "documents").select("doc_id", quality.assemble_document(data, F.col("source"), [F.lit("a@example.com"), F.lit("")]).alias("document"))


@query("select url, attempt, contains(upper(raw), 'VERDICT: PASS') as passed, case when contains(upper(raw), 'ISSUES:') then trim(substr(raw, position('ISSUES:' in upper(raw)) + 7)) else 'none' end as issues from responses")
def g14_parse_verdict(spark, d):
    return B.responses(spark, d).withColumn("v", responses.parse_verdict(F.col("raw"))).select("url", "attempt", F.col("v.passed").alias("passed"), F.col("v.issues").alias("issues"))


@query("""
    with a as (select run_id as k, row_number() over (partition by run_id order by call_id) as attempt, call_id % 7 <> 0 as json_ok, success as valid, stage <> 'error' as judged_ok from usage),
    e as (select k, attempt, case when json_ok and valid and (judged_ok or attempt = 4) then case when judged_ok then 'approved' else 'approved_with_judge_warning' end when attempt = 4 and json_ok and not valid then 'failed_validation' end as ending from a where attempt <= 4)
    select k, coalesce(arg_min(ending, attempt) filter (ending is not null), 'exhausted_retries') as outcome, coalesce(min(attempt) filter (ending is not null), max(attempt)) as attempts_used from e group by k""")
def g15_resolve_attempts(spark, d):
    from pyspark.sql import Window

    u = B.usage(spark, d)
    attempts = u.select(F.col("run_id").alias("k"), F.row_number().over(Window.partitionBy("run_id").orderBy("call_id")).alias("attempt"), (F.col("call_id") % 7 != 0).alias("json_ok"), F.col("success").alias("valid"), (F.col("stage") != "error").alias("judged_ok"))
    return responses.resolve_attempts(attempts, "k", 3).withColumn("attempts_used", F.col("attempts_used").cast("long"))


@query(f"""
    select {ID_SQL}, case when l_partkey % 3 = 0 then 'out/' || l_partkey else tailored_resume_path end as tailored_resume_path, case when l_partkey % 3 <> 2 then coalesce(tailor_attempts, 0) + 1 else tailor_attempts end as tailor_attempts from postings""")
def g16_record_attempts(spark, d):
    p = B.postings(spark, d).withColumn("k", F.xxhash64(*B.K))
    outcomes = p.where("l_partkey % 3 <> 2").select("k", F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("out/"), "l_partkey")).alias("path"))
    return responses.record_attempts(p, outcomes, "k", F.col("scored_at")).select(*ID, "tailored_resume_path", "tailor_attempts")


@query(r"select doc_id, regexp_replace(trim(substr(regexp_replace(source, '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), 1, 20)), ' ', '_', 'g') || '_' || regexp_replace(trim(substr(regexp_replace(replace(text, chr(10), ' '), '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), 1, 50)), ' ', '_', 'g') as name from documents")
def g17_artifact_name(spark, d):
    return B.table(spark, d, "documents").select("doc_id", responses.artifact_name(F.col("source"), F.replace(F.col("text"), F.lit("\n"), F.lit(" "))).alias("name"))


@query(f"select {ID_SQL}, 'Write for ' || title || ' at ' || site || ': ' || coalesce(full_description, '') as request from postings where fit_score >= 9 and status = 'active'")
def g18_tailor_requests(spark, d):
    p = B.postings(spark, d).where("fit_score >= 9 and status = 'active'").withColumn("k", F.struct(*ID))
    made = responses.template_requests(p, "Write for {title} at {company}: {text}", {"title": F.col("title"), "company": F.col("site"), "text": F.col("full_description")}, "k")
    return made.select("k.*", "request")


@query(f"""
    select {ID_SQL}, 'Write.' || case when l_linenumber <= 2 then chr(10) || 'AVOID:' || chr(10) || '- too long' || chr(10) || '- ' || site else '' end || chr(10) || chr(10) || 'RESUME:' || chr(10) || 'Spark' || chr(10) || chr(10) || 'TITLE: ' || title || chr(10) || 'COMPANY: ' || site || chr(10) || 'LOCATION: ' || location || chr(10) || 'DESCRIPTION: ' || substr(coalesce(full_description, ''), 1, 6000) as request
    from postings where fit_score >= 9 and status = 'active'""")
def g18_cover_requests(spark, d):
    p = B.postings(spark, d).where("fit_score >= 9 and status = 'active'").withColumn("k", F.struct(*ID))
    notes = F.when(F.col("l_linenumber") <= 2, F.array(F.lit("too long"), F.col("site")))
    return responses.cover_requests(p, "Write.", "Spark", "k", notes).select("k.*", "request")


@query("""
    with a as (select run_id as k, row_number() over (partition by run_id order by call_id) as attempt, success and stage <> 'error' as valid, 'letter ' || call_id as letter from usage),
    f as (select * from a where attempt <= 4)
    select k, coalesce(arg_min(letter, attempt) filter (valid), arg_max(letter, attempt)) as letter, count(*) filter (valid) > 0 as passed, coalesce(min(attempt) filter (valid), max(attempt)) as attempts_used from f group by k""")
def g15_resolve_letters(spark, d):
    from pyspark.sql import Window

    u = B.usage(spark, d)
    attempts = u.select(F.col("run_id").alias("k"), F.row_number().over(Window.partitionBy("run_id").orderBy("call_id")).alias("attempt"), (F.col("success") & (F.col("stage") != "error")).alias("valid"), F.concat(F.lit("letter "), "call_id").alias("letter"))
    return responses.resolve_letters(attempts, "k", 3).withColumn("attempts_used", F.col("attempts_used").cast("long"))


@query("select url, 'ALLOWED SKILLS: Spark' || chr(10) || 'METRICS: N/A' || chr(10) || 'ORIGINAL:' || chr(10) || full_description || chr(10) || 'TAILORED:' || chr(10) || 'New: ' || full_description as request from doc_postings")
def g19_judge_requests(spark, d):
    docs = B.doc_postings(spark, d)
    return responses.judge_requests(docs.select("url", F.col("full_description").alias("original")), docs.select("url", F.concat(F.lit("New: "), "full_description").alias("tailored")), "url", ["Spark"], [])


@query(f"with {COSTED} select call_id, round(cost, 8) as cost, request_count from costed")
def g20_usage_cost(spark, d):
    return priced(spark, d).select("call_id", F.round("cost", 8).alias("cost"), "request_count")


@query("select call_id, run_id, stage, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens as total_tokens, success from usage")
def g21_record_usage(spark, d):
    calls = B.usage(spark, d).select("call_id", F.col("run_id").alias("r"), "stage", "model", F.to_json(F.struct("prompt_tokens", "completion_tokens")).alias("usage"), F.lit(5).alias("elapsed_ms"), F.when(~F.col("success"), "failed").alias("error"), "created_at")
    nested = calls.withColumn("stage", F.concat("stage", F.lit("|"), "call_id"))
    ledger = responses.record_usage(nested, F.col("r"))
    return ledger.select(F.split("stage", r"\|")[1].cast("long").alias("call_id"), "run_id", F.split("stage", r"\|")[0].alias("stage"), "prompt_tokens", "completion_tokens", "total_tokens", "success")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 2 = 0 then 'https://m.example/' || l_partkey else application_url end as application_url from postings")
def j3_update_by_key(spark, d):
    p = B.postings(spark, d).withColumn("k", F.xxhash64(*B.K))
    changes = p.where("l_partkey % 2 = 0").select("k", F.concat(F.lit("https://m.example/"), "l_partkey").alias("link"))
    return lifecycle.update_by_key(p, changes, "k", {"application_url": F.col("new_link")}).select(*ID, "application_url")


