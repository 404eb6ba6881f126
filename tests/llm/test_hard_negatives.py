"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.llm import hard_negatives as hn
from shortlist.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, percent=80):
    """rows: (vec_id, embedding, label), one row a vec_id."""
    live = {i: (y, [math.floor(256 * x) for x in e]) for i, e, y in rows if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for a, (label, q) in live.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (_, v) in live.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if live[i][0] == label][:k]:
            good = [i for i in order if live[i][0] != label and percent * score[p] <= 100 * score[i] <= 100 * score[p]][:k]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(good, 1)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clusters(n, dims, seed, spread=0.15, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((labels, dims)) / math.sqrt(dims)
    out = []
    for i in range(n):
        v = centre[i % labels] + spread * rng.standard_normal(dims)
        out.append((i * 5, [float(np.float32(x)) for x in v], int(rng.integers(labels)) if i % 3 else i % labels))
    return out


@pytest.mark.parametrize("dims,spread,planes", [(1, 4, 6), (5, 1, 2), (64, 4, 6)])
def test_against_brute_force(spark, dims, spread, planes):
    rows = clusters(500, dims, dims)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(hn.mine(df, F.col("vec_id") % 100 == 0, spread=spread, planes=planes)) == brute(rows)


def test_blocks_give_the_same(spark):
    rows = clusters(400, 8, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(hn.mine(df, F.col("vec_id") % 100 == 0, k=3, percent=60, anchor_block=3, row_block=50)) == brute(rows, 3, 60)


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((40, 64))
    v = np.floor(256 / 8 * (centre[rng.integers(40, size=3000)] + 0.3 * rng.standard_normal((3000, 64)))).astype(np.int64)
    turn = hn.rotation(64, 4)
    assert np.allclose(turn.T @ turn, np.eye(64))
    code, *rest = hn.encode(v.astype(float), turn)
    none, all_ = np.full((30, 1), hn.LEAST), np.full((30, 1), hn.MOST)
    block = hn.Anchors(np.arange(30), np.zeros(30, np.int64), v[:30], none, all_, turn, 6, 5)
    low, high = block.intervals(np.arange(30), code, np.bitwise_count(code).sum(axis=1).astype(float), *rest)
    score = v[:30] @ v.T
    assert (low <= score).all() and (score <= high).all()
    scored = block.scan(np.arange(3000), np.zeros(3000, np.int64), v, [code, *rest], same=True)
    assert scored < 0.1 * score.size
    np.fill_diagonal(score[:, :30], hn.LEAST)
    assert (block.best[:, 0] == np.sort(score, axis=1)[:, :-6:-1]).all()


def test_edges(spark):
    rng = random.Random(4)
    v = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]
    rows = [(i, v(), i % 2) for i in range(0, 400, 20)]  # many ties
    rows += [(7, [float("nan"), 1.0, 0.0], 0), (8, [float("inf"), 1.0, 0.0], 1), (9, None, 1), (10, [None, 1.0, 1.0], 0), (11, v(), None), (12, [0.0, 0.0, 0.0], 1), (500, [0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("v", "row", "code", "side", "caps", "anchor_id")})
    want = brute(rows)
    assert got(hn.mine(df, F.col("vec_id") % 100 == 0)) == want and len(want) >= 10
    odd = spark.createDataFrame([(None, v(), 1), (None, None, None)], SCHEMA)
    again = df.select("vec_id", "embedding", "label")
    assert got(hn.mine(again.unionByName(again).unionByName(odd), F.col("vec_id") % 100 == 0)) == want  # repeated rows count once
    # shorter vectors are filled with zeros, long ones are cut where scores would not fit
    mixed = [(0, [1.0], 0), (1, [1.0, 5.0, 2.0], 0), (2, [0.875], 1), (3, [], 1), (4, [3e38, 0.0, 0.0], 1)]
    assert got(hn.mine(spark.createDataFrame(mixed, SCHEMA), F.col("vec_id") == 0)) == [(0, 1, 1, 2, 65536, 57344)]
    for none in (df.where("false"), df.where("vec_id % 100 != 0"), df.where("vec_id = 0")):
        assert got(hn.mine(none, F.col("vec_id") % 100 == 0)) == []


def test_query(spark, tmp_path):
    rows = [(i // 5, e, y) for i, e, y in clusters(600, 6, 1)]
    spark.createDataFrame([(i, e, y + 5) for i, e, y in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, e, y + 5 if i % 7 else (y + 6) % 10) for i, e, y in rows]
    assert got(queries.op11_hard_negatives(spark, str(tmp_path))) == brute(moved)
