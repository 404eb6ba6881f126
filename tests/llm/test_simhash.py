"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shortlist.llm import queries, simhash


def plain(text, width=3):
    """The fingerprint, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def expected(rows, radius=2):
    """{row: (fingerprint, component)} of rows (doc_id, fingerprint)."""
    component = {fp: {fp} for _, fp in rows}
    fps = list(component)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius and component[a] is not component[b]:
                component[a] |= component[b]
                for x in component[b]:
                    component[x] = component[a]
    ids = {fp: [d for d, f in rows if f in component[fp] and d is not None] for fp in fps}
    return sorted(((d, f"{fp:016x}", min(ids[fp], default=None)) for d, fp in rows), key=repr)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_masks_cover():
    rng = random.Random(5)
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= 32
        for _ in range(3000):
            apart = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(not m & apart for m in masks)


def texts(n=400):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split(" ")
            words[rng.randrange(len(words))] = word().upper()
        else:
            words = [word() for _ in range(rng.choice([1, 2, 3, 20, 200]))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("radius,part", [(2, 1024), (2, 2), (1, 2), (3, 2)])
def test_components_against_brute_force(spark, radius, part):
    rows = list(enumerate([*texts(), "", None, " \t\n", "one", "one two", "ONE  two", "a\x0bb c d", "x" * 3000]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(i, plain(t)) for i, t in rows]
    assert got(simhash.near_duplicates(docs, radius=radius, part=part)) == expected(want, radius)
    assert len({c for _, _, c in expected(want, radius)}) < len({f for _, f in want})


def test_hot_buckets_stay_linear(spark):
    """All values around one centre share buckets; the links that come out are few for each of them."""
    centre, rng = 0x0123456789ABCDEF, random.Random(1)
    values = list({centre ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 6))) for _ in range(3000)})
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(v,) for v in signed], "fp long")
    assert simhash.links(rows, 2, part=64).count() < 70 * len(values)
    found = {r.node: r.label for r in simhash.components(simhash.links(rows, 2, part=64)).collect()}
    want = {f: c for _, f, c in expected([(i, v) for i, v in enumerate(values)])}
    groups = {}
    for v, s in zip(values, signed, strict=True):
        groups.setdefault(want[f"{v:016x}"], set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_edges(spark):
    rows = [(None, "a b c"), (None, None), (4, "a b c"), (4, "d e f"), (9, "a b c"), (3, ""), (7, "solo text here " * 4000), (None, "nobody has this text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("fp", "key", "least", "root", "component_id")})
    assert got(simhash.near_duplicates(docs)) == expected([(i, plain(t)) for i, t in rows])
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {r.component_id for r in simhash.near_duplicates(named).where("doc_id = 'd9'").collect()} == {"d4"}


def test_query(spark, tmp_path):
    rows = list(enumerate(texts(60)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op12_simhash(spark, str(tmp_path))) == expected([(i, plain(t)) for i, t in rows])
