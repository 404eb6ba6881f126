"""Sources, normalisation, sinks, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.functions import text as X
from shortlist.operators import key_filter, lifecycle
from shortlist.plans import bindings as B
from shortlist.plans.base import query
from shortlist.plans.q_rules import ID, ID_SQL
from shortlist.sources import normalise as S
from shortlist.sources import tables
from shortlist.sources.staging import scratch, staged


def _ats_raw(spark, d):
    """Search payloads of employers, one per site, as nested rows derived from the postings."""
    p = B.postings(spark, d)
    one = F.struct(F.col("title").alias("title"), F.col("location").alias("locationsText"), F.col("discovered_at").cast("string").alias("postedOn"), F.concat(F.lit("/job/"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey").alias("externalPath"))
    # one payload per employer and page of its result list, as a portal pages them
    return p.groupBy(F.coalesce("company", F.lit("none")).alias("employer"), (F.col("l_orderkey") % 97).alias("page")).agg(F.collect_list(one).alias("jobPostings"))


@query("select coalesce(company, 'none') as employer, title, location, '/job/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as external_path from postings")
def s1_flatten_ats_search(spark, d):
    return S.flatten_ats_search(_ats_raw(spark, d)).drop("date_posted")


@query("""
    select coalesce(company, 'none') as employer, '/job/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as external_path,
        case when l_partkey % 3 = 0 then '' else coalesce(description, '') end as job_description, case when l_partkey % 3 = 0 then 'detail missing' end as detail_error
    from postings""")
def s2_join_ats_detail(spark, d):
    found = S.flatten_ats_search(_ats_raw(spark, d))
    detail = B.postings(spark, d).where("l_partkey % 3 <> 0").select(F.coalesce("company", F.lit("none")).alias("employer"), F.concat(F.lit("/job/"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey").alias("external_path"), F.col("description").alias("job_description"), F.lit("u").alias("external_url"))
    return S.join_ats_detail(found, detail.dropDuplicates(["employer", "external_path"])).select("employer", "external_path", "job_description", "detail_error")


@query("""
    select 'https://d.example/doc/' || doc_id as url, source as company, substr(text, 1, 500) as description, case when length(text) > 200 then text end as full_description,
        case when length(text) > 200 then lang end as detail_scraped_at from documents where doc_id % 7 <> 0""")
def s3_normalise_ats(spark, d):
    docs = B.table(spark, d, "documents")
    raw = docs.select(F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("https://d.example/doc/"), "doc_id")).alias("external_url"), F.col("lang").alias("title"), F.col("source").alias("employer"), F.col("lang").alias("location"), F.col("text").alias("job_description"), F.col("lang").alias("fetched_at"))
    return S.normalise_ats(raw).select("url", "company", "description", "full_description", "detail_scraped_at")


@query("""
    select title, company, location, l_partkey as salary_start, case when company is null then '' else 'https://board.example/' || l_orderkey || '-' || l_linenumber || '~' || lower(company) end as url
    from postings""")
def s4_flatten_board_docs(spark, d):
    p = B.postings(spark, d)
    company = F.struct(F.col("company").alias("name"), F.lower("company").alias("slug"))
    doc = F.struct(F.col("title").alias("role"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("slug"), company.alias("company"), F.struct(F.col("location").alias("name")).alias("city"), F.struct(F.col("l_partkey").alias("start"), F.col("l_suppkey").alias("end"), F.lit("USD").alias("currency")).alias("salaryRange"))
    raw = p.select(F.struct(F.array(doc).alias("docs")).alias("data"))
    return S.flatten_board_docs(raw, "https://board.example").select("title", "company", "location", "salary_start", "url")


@query(f"select title, coalesce(nullif(trim(company), ''), site, '') as company, coalesce(nullif(trim(application_url), ''), url) as url from postings")
def s5_coalesce_aliases(spark, d):
    return S.coalesce_aliases(B.postings(spark, d), {"title": ["positionName", "title"], "company": ["company", "site"], "url": ["externalApplyLink", "application_url", "url"]})


@query("""
    select url, title, case when l_suppkey % 11 = 0 then null else company end as company, case when l_linenumber = 4 then location || ' (Remote)' else location end as location,
        coalesce(case when l_partkey % 5 <> 0 then site end, 'q-' || l_linenumber) as site, 'board' as strategy,
        case when l_partkey % 4 <> 0 and l_partkey > 0 then 'USD' || printf('%,d', l_partkey) || case when l_suppkey > 0 then '-USD' || printf('%,d', l_suppkey) else '' end || '/yearly' end as salary
    from postings where l_orderkey % 10 <> 3""")
def s6_normalise_board_frame(spark, d):
    p = B.postings(spark, d)
    raw = p.select(
        F.when(F.col("l_orderkey") % 10 != 3, F.col("url")).otherwise("nan").alias("url"), "title", F.coalesce("company", F.lit("nan")).alias("company"), "location",
        F.when(F.col("l_partkey") % 5 != 0, F.col("site")).alias("site"), F.concat(F.lit("q-"), "l_linenumber").alias("query_label"), (F.col("l_linenumber") == 4).alias("is_remote"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey").cast("double")).otherwise(F.lit(float("nan"))).alias("salary_min"), F.col("l_suppkey").cast("double").alias("salary_max"), F.lit("USD").alias("currency"), F.lit("yearly").alias("interval"),
        "application_url", F.lit(None).cast("string").alias("date_posted"), "description",
    )
    return S.normalise_board_frame(raw).select("url", "title", "company", "location", "site", "strategy", "salary")


@query(f"""
    select {ID_SQL}, case when l_linenumber <> 5 and l_extendedprice >= 1 then 'EUR' || printf('%,d', cast(floor(l_extendedprice) as bigint)) || case when l_linenumber <> 6 then '-EUR' || printf('%,d', l_partkey + 1) else '' end || '/monthly' end as salary from postings""")
def s7_format_salary(spark, d):
    low, high = F.when(F.col("l_linenumber") != 5, F.col("l_extendedprice")), F.when(F.col("l_linenumber") != 6, F.col("l_partkey") + 1)
    return B.postings(spark, d).select(*ID, S.format_salary(low, high.cast("double"), F.lit("EUR"), F.lit("monthly")).alias("salary"))


def _short_sql(x: str) -> str:
    return f"case when {x} >= 1e9 then cast(cast(round_even({x} / 1e9, 0) as bigint) as varchar) || 'M' when {x} >= 1e6 then cast(cast(round_even({x} / 1e6, 0) as bigint) as varchar) || 'jt' when {x} >= 1e3 then cast(cast(round_even({x} / 1e3, 0) as bigint) as varchar) || 'K' else cast(cast(round_even({x}, 0) as bigint) as varchar) end"


@query(f"""
    with a as (select *, cast(l_partkey as double) * 1000000 as lo, case when l_linenumber = 3 then null else l_extendedprice * 10 end as hi from postings)
    select {ID_SQL}, trim(case when lo > 0 and hi > 0 then {_short_sql('lo')} || '-' || {_short_sql('hi')} || ' IDR' when lo > 0 then {_short_sql('lo')} || '+ IDR' else '' end) as salary from a""")
def s8_format_salary_compact(spark, d):
    low, high = F.col("l_partkey").cast("double") * 1_000_000, F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") * 10)
    return B.postings(spark, d).select(*ID, S.format_salary_compact(low, high, F.lit("IDR")).alias("salary"))


@query(f"select {ID_SQL}, case when l_partkey % 2 = 0 then case when l_linenumber = 3 then 'Remote' else location || ' (Remote)' end else case when l_linenumber = 3 then '' else location end end as location from postings")
def s9_remote_suffix(spark, d):
    place = F.when(F.col("l_linenumber") == 3, "").otherwise(F.col("location"))
    return B.postings(spark, d).select(*ID, S.remote_suffix(place, F.col("l_partkey") % 2 == 0).alias("location"))


@query("select doc_id, case when length(text) > 200 then text end as full_description, case when length(text) > 200 then source end as detail_scraped_at from documents")
def s10_promote_description(spark, d):
    rows = B.table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("description"))
    return S.promote_description(rows, F.col("source")).select("doc_id", "full_description", "detail_scraped_at")


@query("select url, title, company, cast(null as varchar) as lang from postings union all select url, title, cast(null as varchar), lang from doc_postings")
def s11_union_sources(spark, d):
    a = B.postings(spark, d).select("url", "title", "company")
    return S.union_sources([a, B.doc_postings(spark, d).select("url", "title", "lang")]).select("url", "title", "company", "lang")


MATRIX = "matrix as (select q.query, q.tier, l.location, coalesce(nullif(l.label, ''), l.location) as label from (select distinct p_name as query, coalesce(case when p_name like 'hot%' then null else cast(length(p_name) % 4 as int) end, 0) as tier from part) q, (select n_name as location, case when n_nationkey % 3 = 0 then '' else 'L' || n_nationkey end as label from nation) l)"


def _queries(spark, d):
    name = F.col("p_name")
    return B.table(spark, d, "part").select(name.alias("query"), F.when(~name.startswith("hot"), (F.length(name) % 4).cast("int")).alias("tier")).distinct()


def _places(spark, d):
    return B.table(spark, d, "nation").select(F.col("n_name").alias("location"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("L"), "n_nationkey")).alias("label"))


@query(f"with {MATRIX} select query, tier, location, label from matrix where tier in (0, 1)")
def s12_search_matrix(spark, d):
    return S.search_matrix(_queries(spark, d), _places(spark, d), tiers=[0, 1]).select("query", "tier", "location", "label")


@query(f"with {MATRIX}, n as (select *, row_number() over (order by query, location) - 1 as place from matrix) select query, location from n where place % 5 = 1")
def s13_shard(spark, d):
    return S.shard(S.search_matrix(_queries(spark, d), _places(spark, d)), 5, 2, ["query", "location"]).select("query", "location")


@query("select distinct p_name as query from part where p_name not like 'hot%' and length(p_name) % 4 <= 2")
def s14_tier_cut(spark, d):
    return S.tier_cut(_queries(spark, d)).select("query")


@query(f"""
    select {ID_SQL}, case when l_linenumber % 2 = 0 and company is not null then company else upper(site[1]) || lower(site[2:]) || ' Works' end as company from postings""")
def s15_fill_company(spark, d):
    site = F.col("site")
    rows = B.postings(spark, d).withColumns({"company": F.when(F.col("l_linenumber") % 2 == 0, F.col("company")), "description": F.concat(F.lit("Join us at "), F.upper(F.substring(site, 1, 1)), F.lower(F.substring(site, 2, 99)), F.lit(" Works. Now"))})
    return S.fill_company(rows).select(*ID, "company")


INSERTED = """
    with first as (select *, row_number() over (partition by url order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as rn from postings)
    select url, title, l_partkey from first where rn = 1 and url not in (select url from postings where l_orderkey % 3 = 0)"""


@query(INSERTED)
def s16_insert_new(spark, d):
    p = B.postings(spark, d)
    return lifecycle.insert_new(p.where("l_orderkey % 3 = 0"), p, "url", B.K).select("url", "title", "l_partkey")


@query(INSERTED)
def s16_insert_filtered(spark, d):
    """The same with a filter of the stored keys."""
    # both tables and the filter come from the columns that are stored, made once
    p = staged(B.postings(spark, d).select("url", "title", *B.K), "given")
    stored = p.where("l_orderkey % 3 = 0")
    return lifecycle.insert_new(stored, p, "url", B.K, key_filter.key_filter(stored, "url")).select("url", "title", "l_partkey")


@query(r"""select '• <b>[' || coalesce(fit_score, 7) || ']</b> <a href="' || replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '">' || substr(title, 1, 60) || '</a> — '
    || substr(coalesce(company, site), 1, 30) || ' · ' || substr(location, 1, 25) || ' — ' || trim(substr(split_part(score_reasoning, chr(10), 1), 1, 80)) as value from postings""")
def s17_text_sink(spark, d):
    """Digest lines written as text and read back."""
    from shortlist.operators.digest import compact_line
    from shortlist.streaming.jobs import to_text

    rows = B.postings(spark, d)
    path = scratch(spark, "digest")
    to_text(rows.select(F.col("l_orderkey").alias("place"), compact_line(F.col("score_reasoning")).alias("line")), path)
    return spark.read.text(path)


@query("select l_orderkey as place, title as line from postings")
def s17_committed_lines(spark, d):
    """Lines through the data source that commits whole writes, and back."""
    from shortlist.streaming.jobs import to_committed

    path = scratch(spark, "committed")
    to_committed(B.postings(spark, d).select(F.col("l_orderkey").alias("place"), F.col("title").alias("line")), path)
    return spark.read.format("committed_lines").load(path)


@query("select status, count(*) as postings, count(distinct url) as urls from postings group by status")
def s19_table_sink(spark, d):
    """Postings written as a table partitioned by status, and read back."""
    path = scratch(spark, "postings")
    B.postings(spark, d).select("url", "title", "fit_score", "status").write.partitionBy("status").parquet(path)
    back = spark.read.schema("url string, title string, fit_score int, status string").parquet(path)
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("url").alias("urls"))


@query("""
    with w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 3 = 0 then 'https://m.example/' || l_partkey else application_url end as link, status from postings)
    select status, count(*) as postings, count(link) as links, count(distinct link) as different from w where status <> 'low_score' group by status""")
def s19_table_versions(spark, d):
    """A table written, updated by key, cleared of a status, and read back; each step is a version."""
    path = scratch(spark, "versions")
    p = B.postings(spark, d).select(F.xxhash64(*B.K).alias("k"), "l_partkey", F.col("application_url").alias("link"), "status")
    tables.write_table(p, path, ["status"])
    changes = p.where("l_partkey % 3 = 0").select("k", F.concat(F.lit("https://m.example/"), "l_partkey").alias("link")).dropDuplicates(["k"])
    tables.update_table(spark, path, changes, "k", {"link": F.col("new_link")}, ["status"])
    tables.delete_rows(spark, path, F.col("status") == "low_score", ["status"])
    assert tables.versions(spark, path) == [1, 2]
    return tables.read_table(spark, path).groupBy("status").agg(F.count(F.lit(1)).alias("postings"), F.count("link").alias("links"), F.count_distinct("link").alias("different"))


@query(f"with {MATRIX} select query, location, case when location like '%1%' then 'Country ' || location else 'default' end as country, case when location like '%2%' then 'B' || location else string_split(location, ',')[1] end as board_location from matrix")
def s20_map_search_location(spark, d):
    places = _places(spark, d)
    countries = places.where(F.col("location").contains("1")).select("location", F.concat(F.lit("Country "), "location").alias("country"))
    boards = places.where(F.col("location").contains("2")).select("location", F.concat(F.lit("B"), "location").alias("board_location"))
    return S.map_search_location(S.search_matrix(_queries(spark, d), places), countries, boards, "default").select("query", "location", "country", "board_location")


@query(f"""
    with r as (select *, row_number() over (partition by site, location order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as rn from postings where discovered_at >= timestamp '2000-06-01' - interval 720 hour)
    select {ID_SQL}, site, location from r where rn <= 50""")
def s21_cap_and_recent(spark, d):
    fresh = S.recent(B.postings(spark, d), "discovered_at", 720, "2000-06-01")
    return S.cap_results(fresh, ["site", "location"], 50, B.K).select(*ID, "site", "location")


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from documents")
def x1_collapse(spark, d):
    return B.table(spark, d, "documents").select("doc_id", X.collapse(F.col("text")).alias("flat"))


@query("select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as normal from documents")
def x2_normal_phrase(spark, d):
    return B.table(spark, d, "documents").select("doc_id", X.normal_phrase(F.col("text")).alias("normal"))


CANON = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(coalesce({c}, ''))), 'https?://', '', 'g'), '(?s)[?#].*$', ''), '[^a-z0-9]+', ' ', 'g'))"


@query(f"select page_id, {CANON.format(c='url')} as canon, sha256({CANON.format(c='url')}) as digest from pages")
def x3_canonical(spark, d):
    canon = X.canonical(F.col("url"))
    return B.table(spark, d, "pages").select("page_id", canon.alias("canon"), F.sha2(canon, 256).alias("digest"))


DESCRIBED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '\\-', '-'), '\\*', '*'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), 'https?://[^ \\t\\n\\r]+', '', 'g'), '[`*_>#]+', '', 'g'), '[ \\t\\n\\r]*[-•][ \\t\\n\\r]+', ' ', 'g'), '(?i)\\b(about us|about the company|job description|responsibilities|requirements)\\b[ ]*:?,?', '', 'g'), '[ \\t\\n\\r\\v\\f]+', ' ', 'g'), ' -–—:;,.')"


@query(f"select doc_id, {DESCRIBED} as clean from documents")
def x6_clean_description(spark, d):
    return B.table(spark, d, "documents").select("doc_id", X.clean_description(F.col("text")).alias("clean"))


@query()
def x7_short_summary(spark, d):
    return B.table(spark, d, "documents").select("doc_id", X.short_summary(F.col("text")).alias("summary"))


@query("select page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as safe from pages")
def x5_html_escape(spark, d):
    return B.table(spark, d, "pages").select("page_id", X.html_escape(F.col("url")).alias("safe"))


@query(r"select doc_id, case when trim(regexp_replace(text, '\s+', ' ', 'g')) = '' then 0 else cast(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) as int) end as words from documents")
def x9_word_count(spark, d):
    return B.table(spark, d, "documents").select("doc_id", X.count_words(F.col("text")).alias("words"))


@query()
def f1_registered_sources(spark, d):
    """All registered normalisers over their raw frames, in one union."""
    docs = B.table(spark, d, "documents")
    ats = docs.select(F.concat(F.lit("https://d.example/doc/"), "doc_id").alias("external_url"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("employer"), F.col("lang").alias("location"), F.col("text").alias("job_description"), F.col("lang").alias("fetched_at"))
    board = B.postings(spark, d).select("url", "title", "company", "location", "site", F.lit("q").alias("query_label"), F.lit(False).alias("is_remote"), F.col("l_extendedprice").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"), F.lit("USD").alias("currency"), F.lit("yearly").alias("interval"), "application_url", F.lit(None).cast("string").alias("date_posted"), "description")
    return S.normalise_all({"ats": ats, "board": board}).select("url", "title", "company", "location", "site", "salary")


@query("select unnest(['text', 'parquet', 'committed']) as sink, (select count(*) from postings) as lines")
def f2_registered_sinks(spark, d):
    """A digest through every registered sink, read back and counted."""
    from shortlist.operators.digest import compact_line
    from shortlist.streaming.jobs import SINKS

    lines = staged(B.postings(spark, d).select(F.col("l_orderkey").alias("place"), compact_line(F.col("score_reasoning")).alias("line")), "lines")  # made once for all sinks
    out = None
    for name, sink in SINKS.items():
        path = scratch(spark, name)
        sink(lines, path)
        reader = {"text": spark.read.format("text"), "parquet": spark.read.format("parquet"), "committed": spark.read.format("committed_lines")}[name]
        back = reader.load(path).agg(F.count(F.lit(1)).alias("lines")).select(F.lit(name).alias("sink"), "lines")
        out = back if out is None else out.unionByName(back)
    return out
