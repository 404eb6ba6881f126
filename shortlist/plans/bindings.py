"""Operator inputs built from the given tables, with the same expressions for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTINGS = {
    "url": "'https://b.example/job/' || l_orderkey || '-' || l_linenumber",
    "title": "p_name",
    "company": "case when l_suppkey % 11 = 0 then null else s_name end",
    "location": "case when l_linenumber = 1 then 'Remote' else n_name end",
    "site": "p_type",
    "description": "p_brand || ' ' || p_type || ' ' || o_orderpriority",
    "full_description": "case when l_linestatus = 'O' then null else p_brand || ' ' || p_type || ' ' || o_orderpriority || '. Role in ' || n_name || ' for ' || p_name || '.' end",
    "fit_score": "case when l_linenumber = 7 then null else cast(l_partkey % 10 + 1 as int) end",
    "discovered_at": "o_orderdate",
    "scored_at": "l_shipdate",
    "status": "case o_orderstatus when 'F' then 'active' when 'O' then 'expired' else 'low_score' end",
    "application_url": "case when l_linenumber % 2 = 0 then 'https://apply.example/' || l_partkey || '?src=' || l_linenumber when l_linenumber = 3 then '' end",
    "salary": "'USD' || l_suppkey",
    "detail_scraped_at": "case when l_linestatus = 'F' then l_shipdate end",
    "detail_error": "case when l_linestatus = 'O' and l_suppkey % 3 = 0 then 'HTTP 404' end",
    "tailored_resume_path": "case when l_quantity > 40 then 'resume/' || l_orderkey end",
    "tailor_attempts": "case when l_suppkey % 8 = 0 then null else cast(l_suppkey % 8 as int) end",
    "cover_letter_path": "case when l_quantity > 45 then 'letter/' || l_orderkey when l_quantity > 43 then '' end",
    "cover_attempts": "cast(l_partkey % 7 as int)",
    "applied_at": "case when l_discount >= 0.09 then l_shipdate end",
    "apply_error": "case when l_tax >= 0.08 then 'timeout' end",
    "notified_at": "case when l_quantity < 5 then l_shipdate end",
    "score_reasoning": "'FIT: knows ' || p_type || chr(10) || 'GAP: no ' || o_orderpriority || chr(10) || 'KEYWORDS: ' || p_brand",
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "l_partkey": "l_partkey",
    "l_suppkey": "l_suppkey",
    "l_shipdate": "l_shipdate",
    "l_extendedprice": "l_extendedprice",
}

#: A total order of the postings' rows.
K = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]

DOC_POSTINGS = {
    "url": "'https://d.example/doc/' || doc_id",
    "title": "split_part(text, chr(10), 1)",
    "site": "source",
    "lang": "lang",
    "full_description": "text",
    "doc_id": "doc_id",
}

USAGE = {
    "call_id": "event_id",
    "run_id": "user_id",
    "stage": "event_type",
    "model": "case user_id % 4 when 0 then ' Small-1 ' when 1 then 'large-2' when 2 then 'per-call-3' else 'unknown-9' end",
    "prompt_tokens": "case when event_id % 13 = 0 then null else {k} * 100 end",
    "completion_tokens": "cast(floor(value * 100) as bigint)",
    "created_at": "ts",
    "success": "event_id % 5 <> 0",
}

RESPONSES = {
    "url": "'https://c.example/' || conv_id",
    "attempt": "cast(turn as int)",
    "raw": """case turn % 5 when 0 then 'SCORE: ' || (conv_id % 14) || '/10' || chr(10) || 'FIT: ' || {flat} || chr(10) || 'more fit' || chr(10) || 'GAP: none'
        when 1 then 'Sure.' || chr(10) || 'SCORE: high' || chr(10) || 'KEYWORDS: a, , b,c'
        when 2 then 'score 5' || chr(10) || {flat}
        when 3 then '  FIT: first' || chr(10) || 'SCORE:' || chr(10) || '-' || (conv_id % 9 + 1) || chr(10) || chr(10) || 'FIT: second' || chr(10) || 'KEYWORDS: x,y'
        else 'VERDICT: PASS' || chr(10) || 'ISSUES: ' || {flat} end""",
}

USERS = {"profile": "c_custkey", "name": "c_name", "segment": "c_mktsegment", "target_role": "case when c_custkey % 9 = 0 then '' else lower(c_mktsegment) end"}


def _select(df: DataFrame, columns: dict[str, str], **parts: str) -> DataFrame:
    return df.select(*[F.expr(e.format(**parts) if parts else e).alias(n) for n, e in columns.items()])


def _sql(columns: dict[str, str], source: str, **parts: str) -> str:
    return "select " + ", ".join(f"{e.format(**parts) if parts else e} as {n}" for n, e in columns.items()) + f" from {source}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    # orders first: they meet the narrow rows of lineitem, and the long names of the others move no more after their join
    joined = (
        t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("part"), F.expr("l_partkey = p_partkey"))
        .join(t("supplier"), F.expr("l_suppkey = s_suppkey")).join(t("nation"), F.expr("s_nationkey = n_nationkey"))
    )
    return _select(joined, POSTINGS)


def doc_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "documents"), DOC_POSTINGS)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "events"), USAGE, k="cast(get_json_object(props, '$.k') as bigint)")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "conversations").where("role = 'assistant'"), RESPONSES, flat="replace(text, chr(10), ' ')")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "customer"), USERS)


VIEWS = {
    "postings": _sql(POSTINGS, "lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join orders on l_orderkey = o_orderkey"),
    "doc_postings": _sql(DOC_POSTINGS, "documents"),
    "usage": _sql(USAGE, "events", k="cast(json_extract_string(props, '$.k') as bigint)"),
    "responses": _sql(RESPONSES, "conversations where role = 'assistant'", flat="replace(text, chr(10), ' ')"),
    "profiles": _sql(USERS, "customer"),
}


def with_views(sql: str) -> str:
    """The query with the views that it names in front."""
    import re

    names = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} as ({VIEWS[v]})" for v in names)
    body = sql.strip()
    if not names:
        return body
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"
