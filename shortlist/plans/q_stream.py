"""Streaming jobs, drained over files that hold the given tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from shortlist.plans import bindings as B
from shortlist.plans.base import query
from shortlist.plans.q_digest import PRINTS
from shortlist.sources.staging import scratch
from shortlist.streaming import jobs

POSTING = ["url", "title", "company", "location", "application_url", "fit_score", "scored_at"]


def _as_files(rows, path, batches=1):
    """``rows`` as files for a stream: (path for the stream, schema, files per batch).

    Each task writes what it has, a file for each batch, so the files are as many as the rows need and no task
    takes more for there being few batches.
    """
    if batches == 1:
        rows.write.parquet(path)
        return path, rows.schema, None
    rows.withColumn("deal", F.monotonically_increasing_id() % batches).write.partitionBy("deal").parquet(path)
    files = len(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())
    return f"{path}/*", rows.schema, -(-files // batches)


@query("select count(*) as stored, count(distinct url) as urls from (select url from postings where status = 'active' and detail_scraped_at is null)")
def m1_enrich_stream(spark, d):
    """Pending rows worked on in batches until none is left."""
    base = scratch(spark, "m1")
    todo = B.postings(spark, d).where("status = 'active' and detail_scraped_at is null").select("url", "title")
    stream = jobs.source(spark, *_as_files(todo, f"{base}/in", 2))
    jobs.enrich_stream(stream, lambda batch: batch.withColumn("status", F.lit("ok")), f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("url").alias("urls"))


@query("select count(distinct url) as stored from postings")
def m2_ingest_exact(spark, d):
    """First row per URL over all batches."""
    base = scratch(spark, "m2")
    given = _as_files(B.postings(spark, d).select("url", "title", "l_orderkey"), f"{base}/in", 3)
    jobs.ingest_exact(jobs.source(spark, *given), f"{base}/out", f"{base}/cp", "url", ["l_orderkey", "title"]).awaitTermination()
    return spark.read.parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("stored"))


@query("select count(distinct url) as urls from postings")
def m2_ingest_within_watermark(spark, d):
    """First row per URL within the retention, with bounded state; one batch has all rows, so that none is late."""
    base = scratch(spark, "m2w")
    rows = B.postings(spark, d).select("url", "title", F.col("discovered_at").cast("timestamp").alias("discovered_at"))
    given = _as_files(rows, f"{base}/in")
    kept = jobs.ingest_deduplicated(jobs.source(spark, *given), "url", "discovered_at")
    kept.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out").agg(F.count_distinct("url").alias("urls"))


KEYED = "keyed as (select distinct url || '#' || l_partkey || '#' || l_suppkey as k, l_orderkey % 2 as run, url, title, primary_fp, role_fp from prints)"


def _two_runs(spark, d, name, suppress):
    """Postings of even orders, then those of odd ones, by two streams with checkpoints of their own and one history: what both sent."""
    base = scratch(spark, name)
    rows, key = B.postings(spark, d), F.concat_ws("#", "url", "l_partkey", "l_suppkey").alias("k")
    for run in (0, 1):
        # a key holds its order, so runs share none; of rows of one key, which share their fingerprints, a run sends one
        chosen = rows.where(F.col("l_orderkey") % 2 == run).select(key, *POSTING)
        suppress(jobs.source(spark, *_as_files(chosen, f"{base}/in{run}")), f"{base}/history", f"{base}/out", f"{base}/cp{run}", "k").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(f"""
    with {PRINTS}, {KEYED}, one as (select *, row_number() over (partition by role_fp order by k) as n from keyed where run = 0),
    known as (select unnest([primary_fp, role_fp]) as fp from one where n = 1),
    two as (select *, row_number() over (partition by role_fp order by k) as n from keyed where run = 1 and primary_fp not in (from known) and role_fp not in (from known))
    select k, title from one where n = 1 union all select k, title from two where n = 1""")
def m3_suppress_reposts(spark, d):
    """What two runs send; the second one's reposts are held back by the durable history."""
    return _two_runs(spark, d, "m3", jobs.suppress_reposts).select("k", "title")


@query(f"""
    with {PRINTS}, {KEYED}, first as (select run, fp, min(k) as k from (select run, k, unnest([primary_fp, role_fp]) as fp from keyed) group by run, fp),
    met as (select *, k = (select k from first where fp = primary_fp and first.run = keyed.run) and k = (select k from first where fp = role_fp and first.run = keyed.run) as own from keyed),
    known as (select unnest([primary_fp, role_fp]) as fp from met where run = 0 and own)
    select k, title from met where own and (run = 0 or primary_fp not in (from known) and role_fp not in (from known))""")
def m3_suppress_with_state(spark, d):
    """As above with the state store, which counts a fingerprint from the first posting of a run that has it."""
    return _two_runs(spark, d, "m3-state", jobs.suppress_with_state).select("k", "title")


@query("select cast(created_at as date) as day, count(*) as calls, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens from usage group by 1")
def m4_usage_by_day(spark, d):
    """The batch twin of the streaming totals."""
    return jobs.usage_by_day(B.usage(spark, d))


@query("select cast(created_at as date) as day, count(*) as calls, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens from usage group by 1")
def m4_usage_stream(spark, d):
    """Totals by day from the stream itself, in complete mode."""
    base = scratch(spark, "m4")
    totals = jobs.usage_by_day(jobs.source(spark, *_as_files(B.usage(spark, d).select("created_at", "prompt_tokens", "completion_tokens"), f"{base}/in", 3)))
    totals.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")
