"""Packing against a walk line by line."""

import random

import pytest
from pyspark.sql import functions as F

from shortlist.operators import digest
from shortlist.operators.packing import pack_messages
from shortlist.plans import bindings as B
from shortlist.plans import registry
from shortlist.sources.staging import numbered

SF = "/root/testdata/sf0.001"


def walk(rows, limit):
    """rows: (list, order.., length) -> sorted (list, part, lines, size)."""
    out = {}
    for row in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), *r[1:])):
        name, n = row[0], row[-1]
        part, size = max(((p, v[1]) for (x, p), v in out.items() if x == name), default=(1, 0))
        if size > 0 and size + 1 + n > limit:
            part, size = part + 1, n
        else:
            size = n if size == 0 else size + 1 + n
        lines = out.get((name, part), (0, 0))[0]
        out[name, part] = (lines + 1, size)
    return sorted(((x, p, *v) for (x, p), v in out.items()), key=repr)


def got(df, by="by"):
    return sorted(((r[by], r["part"], r["lines"], r["size"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limit,block", [(1, 3), (10, 1), (50, 7), (50, 10_000)])
def test_against_a_walk(spark, limit, block):
    rng = random.Random(limit)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, "x" * rng.choice([0, 0, 1, 2, 5, limit - 1, limit, limit + 1, 2 * limit])) for i in range(250)]
    rows += [(7, 0, ""), (7, 1, ""), (8, 0, None), (2**60, 0, "a"), (2**60 + 1, 0, "b")]
    df = spark.createDataFrame(rows, "by long, i int, line string").repartition(4).withColumns({c: F.lit("clash") for c in ("list", "size", "block", "place", "part")})
    assert got(pack_messages(df, "by", ["i"], limit, block)) == walk([(b, i, len(t or "")) for b, i, t in rows], limit)
    assert pack_messages(df.where("false"), "by", ["i"], limit, block).count() == 0


def test_query(spark):
    rows = B.postings(spark, SF).select("l_suppkey", *B.K, F.length(digest.compact_line(F.lit(""))).alias("n")).collect()
    assert got(registry.QUERIES["d9_pack_messages"](spark, SF), "profile") == walk([tuple(r) for r in rows], 1000)


def test_numbers_are_consecutive(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 2, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    found = numbered(df, ["a", "b"], "n")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.a, r.b) for r in found.orderBy("n").collect()] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(r.n for r in found.collect()) == list(range(500))
    assert numbered(df.where("false"), ["a", "b"], "n").count() == 0


def test_a_worker_holds_one_block(spark):
    df = spark.createDataFrame([(1, i, "x") for i in range(20)], "by int, i int, line string")
    plan = pack_messages(df, "by", ["i"], 5, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "FlatMapCoGroupsInPandas" in plan
