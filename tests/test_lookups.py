"""Key filters and bucketed lookups."""

import random
import re

from pyspark.sql import functions as F

from shortlist.operators import digest, lifecycle
from shortlist.operators.key_filter import key_filter, merged, with_may_hold
from shortlist.sources import tables


def test_filter_never_misses_and_seldom_errs(spark):
    some = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
    bits = 1 << 16
    known = merged(key_filter(some.where("key < 'k2'"), "key", bits), key_filter(some.where("key >= 'k2'"), "key", bits))
    assert known.count() <= 2
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, key_filter(some, "key", bits).collect()))
    asked = spark.range(8000).select(F.concat(F.lit("k"), "id").alias("key"), "id").unionByName(spark.createDataFrame([(None, -1)], "key string, id long"))
    got = {r.id: r.may_hold for r in with_may_hold(asked, "key", known, bits).collect()}
    assert len(got) == 8001 and all(got[i] for i in range(4000))
    assert 0 < sum(got[i] for i in range(4000, 8000)) < 4000 * 0.03  # (2 * 4000 / 65536)^2 is 1.5 %
    assert not any(r.may_hold for r in with_may_hold(asked, "key", known.where("false"), bits).collect())


def test_insert_with_a_filter_is_the_same(spark):
    rng = random.Random(3)
    row = lambda: (rng.choice(["", None, *(f"u{i}" for i in range(300))]), rng.randrange(1000))
    old, new = ([row() for _ in range(n)] for n in (200, 400))
    stored, batch = (spark.createDataFrame(x, "url string, n int").withColumn("__x", F.lit(1)) for x in (old, new))
    want = sorted(map(tuple, lifecycle.insert_new(stored, batch, "url", ["n"]).collect()))
    for bits in (1 << 15, 1 << 20):
        assert sorted(map(tuple, lifecycle.insert_new(stored, batch, "url", ["n"], key_filter(stored, "url", bits), bits).collect())) == want
    none = stored.where("false")
    assert lifecycle.insert_new(none, batch, "url", ["n"], key_filter(none, "url")).count() == len({u for u, _ in new if u})


def test_a_bucketed_history_stays_where_it_is(spark, tmp_path):
    rows = [(i, f"https://b.example/{i % 50}", f"t{i % 40}", "c", "l", None) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, url string, title string, company string, location string, application_url string")
    old = digest.with_fingerprints(df.where("k % 7 = 0")).select(F.explode(F.array("primary_fp", "role_fp")).alias("fingerprint")).distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        known = tables.write_bucketed(old, "history_test", "fingerprint", 8, f"{tmp_path}/history")
        found = digest.split_by_history(df, known, "k")
        got = sorted((r.k, r.seen) for r in found.collect())
        lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :|+-"))
        at = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "history_test" in line)
        above, deep = [], depth(lines[at])
        for line in reversed(lines[:at]):
            if depth(line) < deep:
                above.append(line.strip(" :|+-"))
                deep = depth(line)
        join = next(i for i, line in enumerate(above) if re.search("Join.*LeftSemi", line))
        assert "Bucketed: true" in lines[at] and not any("Exchange" in line for line in above[:join]), above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table if exists history_test")
    assert got == sorted((r.k, r.seen) for r in digest.split_by_history(df, old, "k").collect()) and any(s for _, s in got)


def test_stage_changes_come_from_one_pass(spark):
    from shortlist.operators import lifecycle, reports
    from shortlist.plans import bindings as B
    from shortlist.plans.q_reports import l9_stage_changes

    sf = "/root/testdata/sf0.001"
    found = l9_stage_changes(spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
    p = B.postings(spark, sf)
    two = lifecycle.stage_changes(reports.pipeline_stats(p.where("l_linenumber <= 3")), reports.pipeline_stats(p))
    assert sorted(found.collect()) == sorted(two.collect())


def test_filtered_insert_keeps_only_what_is_stored(spark, monkeypatch):
    from shortlist.operators import lifecycle
    from shortlist.plans import q_ingest

    kept, staged = [], lifecycle.staged
    monkeypatch.setattr(lifecycle, "staged", lambda df, name: kept.append(df.columns) or staged(df, name))
    q_ingest.s16_insert_filtered(spark, "/root/testdata/sf0.001")
    assert kept and all("url" in c and "full_description" not in c for c in kept)
