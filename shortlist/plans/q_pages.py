"""Detail pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.operators import elements as E
from shortlist.operators import pages as P
from shortlist.plans import bindings as B
from shortlist.plans.base import query
from shortlist.plans.q_rules import ID, ID_SQL

BASES = [("a", "https://a.example/x/y?q=1"), ("b", "https://b.example")]
RELATIVE = "rel as (select page_id, case page_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as site, case page_id % 5 when 0 then url when 1 then regexp_replace(url, '^https?://[^/]*', '') when 2 then 'job/' || page_id || ';jsessionid=77' when 3 then '?p=' || page_id else '../up/' || (page_id % 9) end as url from pages)"


def relative(spark, d):
    url, n = F.col("url"), F.col("page_id")
    made = F.when(n % 5 == 0, url).when(n % 5 == 1, F.regexp_replace(url, "^https?://[^/]*", "")).when(n % 5 == 2, F.concat(F.lit("job/"), "page_id", F.lit(";jsessionid=77"))).when(n % 5 == 3, F.concat(F.lit("?p="), "page_id")).otherwise(F.concat(F.lit("../up/"), n % 9))
    return B.table(spark, d, "pages").select("page_id", F.when(n % 3 == 0, "a").when(n % 3 == 1, "b").otherwise("c").alias("site"), made.alias("url"))


RESOLVED = """resolved as (select *, case when starts_with(url, 'http') then url when site = 'c' then null
    when page_id % 5 = 1 then case site when 'a' then 'https://a.example' else 'https://b.example' end || url
    when page_id % 5 = 2 then case site when 'a' then 'https://a.example/x/' else 'https://b.example/' end || 'job/' || page_id
    when page_id % 5 = 3 then case site when 'a' then 'https://a.example/x/y' else 'https://b.example/' end || url
    else case site when 'a' then 'https://a.example' else 'https://b.example' end || '/up/' || (page_id % 9) end as resolved from rel)"""


def bases(spark):
    return spark.createDataFrame(BASES, "site string, base string")


@query(f"with {RELATIVE}, {RESOLVED} select page_id, resolved from resolved")
def h1_resolve_url(spark, d):
    return P.resolve_url(relative(spark, d), bases(spark)).select("page_id", "resolved")


WINNERS = f"{RELATIVE}, {RESOLVED}, w as (select *, starts_with(url, 'http') as abs, row_number() over (partition by coalesce(resolved, url) order by starts_with(url, 'http') desc, page_id) as rn from resolved), o as (select *, case when abs then 'absolute' when resolved is null then 'failed' when rn > 1 then 'merged' else 'resolved' end as outcome from w)"


@query(f"with {WINNERS} select page_id, case when outcome = 'resolved' then resolved else url end as url, case when outcome = 'merged' then 'url_merged' else 'active' end as status, outcome from o")
def h2_resolve_all(spark, d):
    rows = relative(spark, d).withColumn("status", F.lit("active"))
    return P.resolve_all(rows, bases(spark), ["page_id"]).select("page_id", "url", "status", "outcome")


@query(f"with {WINNERS} select count(*) filter (outcome in ('resolved', 'merged')) as resolved, count(*) filter (outcome = 'failed') as failed, count(*) filter (outcome = 'absolute') as already_absolute from o")
def h2_resolve_counts(spark, d):
    return P.resolve_counts(P.resolve_all(relative(spark, d).withColumn("status", F.lit("active")), bases(spark), ["page_id"]))


def synthetic(spark, d, whole: bool = False):
    """Pages around documents: JSON-LD (plain, in a graph, or broken), patterned markup, or neither.

    Angle brackets and ampersands of the texts are blanks; ``whole`` writes them as HTML does instead.
    """
    n, text = F.col("doc_id"), F.col("text")
    plain = E.escaped(text) if whole else F.regexp_replace(text, "[<>&]", " ")
    marked = text.contains("<") & text.contains(">")  # a description without both is no HTML
    told = F.when(marked, F.concat(F.lit("<p>"), plain, F.lit("</p>"))).otherwise(text) if whole else plain
    posting = F.struct(F.lit("JobPosting").alias("@type"), told.alias("description"), F.when(n % 2 == 0, F.concat(F.lit("https://d.example/apply/"), "doc_id")).alias("url"))
    ld = F.when(n % 5 == 0, F.to_json(posting)).when(n % 5 == 1, F.to_json(F.struct(F.array(posting).alias("@graph")))).when(n % 5 == 2, "{broken")
    script = F.concat(F.lit('<script type="application/ld+json">'), F.replace(ld, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    body = F.when(n % 5 == 3, F.concat(F.lit('<div class="job-description box-1"><p>'), plain, F.lit('</p></div><a class="btn apply-now" href="/go/'), "doc_id", F.lit('">Go</a>'))).otherwise(F.concat(F.lit("<nav>menu</nav><main><p>"), plain, F.lit('</p></main><a href="/x/'), "doc_id", F.lit('">Apply here</a>')))
    return B.table(spark, d, "documents").select("doc_id", "source", F.length(plain).alias("n"), F.concat(F.lit("<html><body>"), F.coalesce(script, F.lit("")), body, F.lit("</body></html>")).alias("html"))


#: ``synthetic`` in SQL: what its pages say, as lines, and which kind they are.
SAID = r"""said as (select doc_id, doc_id % 5 as k, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[<>&]', ' ', 'g'), chr(10)),
    lambda x: regexp_replace(x, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> ''), chr(10)) as t from documents)"""


@query(f"""with {SAID} select doc_id, cast((k in (0, 1)) as int) as ld_blocks, case when k in (0, 1) and length(t) >= 50 then t end as ld_description,
    case when k in (0, 1) and length(t) >= 50 and doc_id % 2 = 0 then 'https://d.example/apply/' || doc_id end as ld_apply_url from said""")
def h3_json_ld(spark, d):
    """Blocks that parse, the posting in them, its description and apply URL."""
    return P.extract_json_ld(synthetic(spark, d).select("doc_id", "html"))


@query("select doc_id, case when doc_id % 5 in (0, 1) then 1 else 0 end as blocks from documents")
def h3_json_ld_blocks(spark, d):
    return P.extract_json_ld(synthetic(spark, d).select("doc_id", "html")).select("doc_id", F.col("ld_blocks").alias("blocks"))


@query(f"""with {SAID} select doc_id, case when k = 3 and length(t) >= 100 then t end as css_description, case when k = 3 then '/go/' else '/x/' end || doc_id as css_apply_url from said""")
def h6_css(spark, d):
    return P.extract_css(synthetic(spark, d).select("doc_id", "html"))


@query("select doc_id, case when doc_id % 5 = 3 then '/go/' || doc_id else '/x/' || doc_id end as css_apply_url from documents")
def h7_apply_css(spark, d):
    return P.extract_css(synthetic(spark, d).select("doc_id", "html")).select("doc_id", "css_apply_url")


#: The entities that the pages hold; tests try others.
DECODE = "regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace({x}, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&apos;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"

_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_ESCAPED = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_NAMES = r"list_filter(regexp_split_to_array(regexp_extract({x}, '(?i)\sclass=\"([^\"]*)\"', 1), '\s+'), lambda n: n <> '' and length(n) < 30 and not regexp_full_match(n, '[a-z]{{1,2}}-[0-9]+'))"
_ATTRIBUTE = rf"' ' || lower(regexp_extract(a, '([\w-]+)=', 1)) || '=\"' || replace({_ESCAPED.format(x=DECODE.format(x="regexp_extract(a, '=" + chr(34) + "(.*)" + chr(34) + "$', 1)"))}, '\"', '&quot;') || '\"'"
#: Pages cut up in SQL: a stack of open elements walks over the tags, and each piece knows what it stands in.
PIECES = rf"""recursive tags as (select page_id, unnest(t) as t, unnest(range(len(t))) as i from (select page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|</?[a-z][^>]*>|[^<]+|<') || ['</*>'] as t from pages)),
    marked as materialized (select page_id, i, t, case when t = '</*>' then 'all' when regexp_matches(t, '(?i)^<(!|script|style)') then 'none' when regexp_matches(t, '^</[A-Za-z]') then 'end' when not regexp_matches(t, '^<[A-Za-z]') then 'text' when lower(regexp_extract(t, '^<([A-Za-z0-9]+)', 1)) in ('br', 'img', 'meta', 'link', 'hr', 'input') then 'void' else 'open' end as kind,
        lower(regexp_extract(t, '^</?([A-Za-z0-9]+)', 1)) as tag,
        array_to_string(list_transform(list_filter(regexp_extract_all(t, '\s[\w-]+="[^"]*"'), lambda a: list_contains({_LIST([x for x in P.KEEP_ATTRS if x != "class"])}, lower(regexp_extract(a, '([\w-]+)=', 1))) or regexp_matches(lower(a), '^\s(data|aria)[-=]')), lambda a: {_ATTRIBUTE}), '')
            || case when len({_NAMES.format(x="t")}) > 0 then ' class="' || array_to_string(({_NAMES.format(x="t")})[1:3], ' ') || '"' else '' end as attrs from tags),
    walk as (
        select page_id, cast(-1 as bigint) as i, cast([] as varchar[]) as stack, cast([] as struct(above varchar[], tag varchar, s varchar)[]) as pieces from pages
        union all
        select page_id, i, case kind when 'open' then list_append(stack, tag) when 'end' then stack[1:cut - 1] else stack end,
            case when kind in ('open', 'void') then [{{'above': stack, 'tag': tag, 's': '<' || tag || attrs || '>'}}]
                when kind = 'text' then [{{'above': stack, 'tag': '', 's': {_ESCAPED.format(x=DECODE.format(x="t"))}}}]
                when kind = 'none' then [] else list_transform(list_reverse(range(cut, len(stack) + 1)), lambda j: {{'above': stack[1:j - 1], 'tag': stack[j], 's': '</' || stack[j] || '>'}}) end
        from (select m.*, w.stack, case when kind = 'all' then 1 when list_contains(w.stack, m.tag) then len(w.stack) + 1 - list_position(list_reverse(w.stack), m.tag) else len(w.stack) + 1 end as cut from walk w join marked m on m.page_id = w.page_id and m.i = w.i + 1)),
    pieces as (select page_id, i, unnest(pieces) as p, unnest(range(len(pieces))) as j from walk),
    kept as (select page_id, i, j, p.above as above, p.s as s from pieces where not list_has_any(list_append(p.above, p.tag), {_LIST(P.NOISE)})),
    cleaned as (select p.page_id, coalesce(string_agg(k.s, '' order by k.i, k.j), '') as content from pages p left join kept k using (page_id) group by p.page_id)"""

#: The main part of the pages is an article; without a long one it is the body.
MAIN = rf"""{PIECES},
    parts as (select page_id, coalesce(string_agg(s, '' order by i, j) filter (list_contains(above, 'article')), '') as article, coalesce(string_agg(s, '' order by i, j) filter (list_contains(above, 'body')), '') as body from kept group by page_id),
    main as (select page_id, case when length(trim(regexp_replace(article, '<[^>]*>', '', 'g'))) > 200 and length(article) < 50000 then article else substr(body, 1, 50000) end as content from parts)"""


@query(f"with {MAIN} select page_id, content from main")
def h8_main_content(spark, d):
    return P.extract_content(B.table(spark, d, "pages").select("page_id", "html"))


@query(f"with {PIECES} select page_id, content from cleaned")
def h9_clean_content_html(spark, d):
    return P.clean_content_html(B.table(spark, d, "pages").select("page_id", "html"))


NO_SCRIPT = "regexp_replace(html, '(?is)<script[^>]*>.*?(</script>|$)|<style[^>]*>.*?(</style>|$)', '', 'g')"


@query(rf"""
    with a as (select page_id, regexp_replace(regexp_replace(regexp_replace({NO_SCRIPT}, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)<li(\s[^>]*)?>', chr(10) || '- ', 'g'), '(?i)</?(p|div|h[1-4]|tr)(\s[^>]*)?>|</li\s*>', chr(10), 'g') as t from pages),
    b as (select page_id, {DECODE.format(x="regexp_replace(t, '(?s)<[^>]*>', '', 'g')")} as t from a)
    select page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11) || chr(160))), lambda x: x <> ''), chr(10)) as lines from b""")
def h10_html_to_lines(spark, d):
    return B.table(spark, d, "pages").select("page_id", P.html_to_lines(F.col("html")).alias("lines"))


@query(rf"""
    with a as (select page_id, regexp_replace(regexp_replace({NO_SCRIPT}, '(?i)<(br|p|div|li|tr|h[1-6])(\s[^>]*)?/?>', chr(10), 'g'), '(?i)</(p|div|li|tr)\s*>', chr(10), 'g') as t from pages),
    b as (select page_id, {DECODE.format(x="regexp_replace(t, '(?s)<[^>]*>', '', 'g')")} as t from a)
    select page_id, trim(regexp_replace(regexp_replace(t, '[ \t\r\f\v' || chr(160) || ']+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as txt from b""")
def h11_strip_html(spark, d):
    return B.table(spark, d, "pages").select("page_id", P.strip_html(F.col("html")).alias("txt"))


@query(f"""
    with {SAID}, t as (select *, case when k in (0, 1) and length(t) >= 50 then 1 when k = 3 and length(t) >= 100 then 2 when k = 4 then 3 end as tier from said)
    select doc_id, case tier when 3 then 'from a model' when 1 then t when 2 then t end as full_description,
        case when tier = 1 and doc_id % 2 = 0 then 'https://d.example/apply/' || doc_id when k = 3 then '/go/' || doc_id else '/x/' || doc_id end as application_url,
        tier, case when tier is null then 'partial' else 'ok' end as status from t""")
def h12_cascade(spark, d):
    model = B.table(spark, d, "documents").where("doc_id % 5 = 4").select("doc_id", F.lit("from a model").alias("full_description"), F.lit(None).cast("string").alias("application_url"))
    return P.cascade(synthetic(spark, d), "doc_id", model)


@query("""
    with t as (select doc_id, case when doc_id % 5 in (0, 1) and length(trim(text)) >= 50 then 1 when doc_id % 5 = 3 and length(trim(text)) >= 100 then 2 when doc_id % 5 = 4 then 3 else 0 end as tier from documents)
    select tier, count(*) as pages from t group by tier""")
def h12_tiers(spark, d):
    model = B.table(spark, d, "documents").where("doc_id % 5 = 4").select("doc_id", F.lit("from a model").alias("full_description"), F.lit(None).cast("string").alias("application_url"))
    return P.cascade(synthetic(spark, d, whole=True), "doc_id", model).groupBy(F.coalesce("tier", F.lit(0)).alias("tier")).agg(F.count(F.lit(1)).alias("pages"))


FETCH = "fetches as (select page_id, url, html, cast(case page_id % 6 when 0 then 404 when 1 then 410 when 2 then 403 when 3 then 500 else 200 end as int) as status, case page_id % 6 when 3 then 'Timeout 30s exceeded' when 5 then 'reset by peer' end as error from pages)"


def fetches(spark, d):
    n = F.col("page_id") % 6
    return B.table(spark, d, "pages").select("page_id", "url", "html", F.when(n == 0, 404).when(n == 1, 410).when(n == 2, 403).when(n == 3, 500).otherwise(200).alias("status"), F.when(n == 3, "Timeout 30s exceeded").when(n == 5, "reset by peer").alias("error"))


@query(f"with {FETCH} select page_id, case when status in (404, 410, 451) then 'HTTP ' || status when lower(error) like '%timeout%' then 'timeout' when error is not null then substr(error, 1, 200) end as kind from fetches")
def h13_classify_fetch(spark, d):
    return fetches(spark, d).select("page_id", P.classify_fetch(F.col("status"), F.col("error")).alias("kind"))


@query(f"""
    select {ID_SQL}, case when l_partkey % 3 = 0 then 'new text' else full_description end as full_description, case when l_partkey % 3 = 0 then null when l_partkey % 3 = 1 then 'timeout' else detail_error end as detail_error, cast(case when l_partkey % 3 <> 2 then discovered_at else detail_scraped_at end as date) as scraped from postings""")
def h14_enrich_merge(spark, d):
    p = B.postings(spark, d).withColumn("k", F.xxhash64(*B.K))
    good = F.col("l_partkey") % 3 == 0
    results = p.where("l_partkey % 3 <> 2").select("k", F.when(good, "new text").alias("full_description"), F.lit("https://x.example").alias("application_url"), F.when(good, "ok").otherwise("error").alias("status"), F.when(~good, "timeout").alias("error"))
    return P.enrich_merge(p, results, "k", F.col("discovered_at")).select(*ID, "full_description", "detail_error", F.col("detail_scraped_at").cast("date").alias("scraped"))


@query(f"""
    with q as (select *, row_number() over (partition by site order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as queue_place from postings where detail_scraped_at is null and site <> 'PROMO')
    select {ID_SQL}, site, cast(queue_place as int) as queue_place, case site when 'LARGE' then 1 when 'SMALL' then 2 else 1000000 end as site_rank from q where queue_place <= 100""")
def h15_enrich_queue(spark, d):
    ranks = spark.createDataFrame([("LARGE", 1), ("SMALL", 2)], "site string, site_rank int")
    return P.enrich_queue(B.postings(spark, d), ["PROMO"], ranks, 100, B.K).select(*ID, "site", "queue_place", "site_rank")


@query("""
    with r as (select source as site, case when doc_id % 4 = 0 then 'error' when doc_id % 4 = 1 then 'partial' else 'ok' end as status, case when doc_id % 4 = 0 then null else doc_id % 3 + 1 end as tier from documents)
    select site, count(*) as processed, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'partial') as partial, count(*) filter (status = 'error') as error, count(*) filter (tier = 1) as tier1, count(*) filter (tier = 2) as tier2, count(*) filter (tier = 3) as tier3,
        round(100.0 * count(*) filter (tier in (1, 2)) / greatest(count(*), 1), 1) as percent_without_model from r group by rollup(site)""")
def h16_enrich_stats(spark, d):
    n = F.col("doc_id")
    results = B.table(spark, d, "documents").select(F.col("source").alias("site"), F.when(n % 4 == 0, "error").when(n % 4 == 1, "partial").otherwise("ok").alias("status"), F.when(n % 4 != 0, n % 3 + 1).alias("tier"))
    return P.enrich_stats(results)


@query(f"with {FETCH} select page_id, case when error is not null or status = 403 then null when status in (404, 410) then 'HTTP ' || status when contains(lower(substr(html, 1, 5000)), 'lichkeit') then 'says: lichkeit' when contains(lower(substr(html, 1, 5000)), 'tionre') then 'says: tionre' end as closed from fetches")
def h17_closed_posting(spark, d):
    f = fetches(spark, d)
    return f.select("page_id", P.closed_posting(F.col("url"), F.col("status"), F.col("html"), F.col("error"), ["lichkeit", "tionre"]).alias("closed"))


PHRASES = "[" + ", ".join(f"'{p}'" for p in P.CLOSED) + "]"


@query(f"""
    with {FETCH}, b as (select *, lower(substr(coalesce(upper({PHRASES}[page_id % 16 + 1]), '') || ' ' || html, 1, 5000)) as low from fetches)
    select page_id, case when error is not null or status = 403 then null when status in (404, 410) then 'HTTP ' || status else 'says: ' || list_filter({PHRASES}, lambda p: contains(low, p))[1] end as closed from b""")
def h17_default_phrases(spark, d):
    """The phrases that are looked for unless others are given; each stands at the head of some pages."""
    said = F.coalesce(F.upper(F.get(F.array(*[F.lit(p) for p in P.CLOSED]), (F.col("page_id") % 16).cast("int"))), F.lit(""))
    f = fetches(spark, d).withColumn("html", F.concat_ws(" ", said, "html"))
    return f.select("page_id", P.closed_posting(F.col("url"), F.col("status"), F.col("html"), F.col("error")).alias("closed"))


@query(f"with {MAIN} select page_id, substr(content, 1, 30000) as content from main")
def h18_model_extract_requests(spark, d):
    return P.model_extract_requests(B.table(spark, d, "pages"), "page_id")
