"""The filter audit against a walk through every order."""

import itertools
import random
import re
from math import factorial

from pyspark.sql import functions as F

from shortlist.llm import filter_audit as fa
from shortlist.llm import queries

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    rows = []
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in docs) else set()
        good, toxic = (any(j == i and i is not None and x[k] == 1 for j, *x in labels) for k in (0, 1))
        rows.append((source or "", fails, good, toxic))
    out, every = [], ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in every:
            left = own
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                failing = sum(f in r[1] for r in own)
                steps.append((part, order, k, len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_against_every_order(spark):
    rng = random.Random(8)
    body = lambda n, v: " ".join(rng.choice("abcdefgh") + str(rng.randrange(v)) for _ in range(n))
    texts = [body(rng.choice([10, 199, 200, 300]), rng.choice([2, 500])) + rng.choice(["", " $", " ABCDEFGHIJ" * 5]) for _ in range(40)]
    texts += [None, "", " \t\n", "ÀÉ" * 40, "AB" + "x" * 98, "AB" + "x" * 99, "word " * 30_000]
    docs = [(rng.choice([*range(90), None]), rng.choice(texts), rng.choice(["s1", "s2", "", None])) for _ in range(150)]
    docs += [(5, texts[0], "s1"), (5, texts[0], "s2"), (5, texts[0], "s2"), (None, "only without an id", "s1"), (None, "only without an id", "s1")]
    labels = [(rng.choice([*range(90), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).withColumns({c: F.lit("clash") for c in ("part", "mask", "digest", "salt", "rows", "good", "first", "least")})
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("clash") for c in ("good", "salt", "part")})
    assert got(fa.audit(fa.failing(d, y))) == brute(docs, labels)
    assert fa.audit(fa.failing(d.where("false"), y)).count() == 0
    assert got(fa.audit(fa.failing(d, y.where("false")))) == brute(docs, [])


def test_shapley_by_least_squares_is_the_mean_over_orders():
    rng = random.Random(1)
    for n in (1, 2, 3, 5):
        v = [0, *(rng.randrange(100) for _ in range((1 << n) - 1))]
        want = [0] * n
        for order in itertools.permutations(range(n)):
            met = 0
            for i in order:
                want[i] += v[met | 1 << i] - v[met]
                met |= 1 << i
        assert [sum(w * x for w, x in zip(row, v, strict=True)) for row in fa.shapley_rows(n)] == want
        assert sum(want) == factorial(n) * v[-1]


def test_query(spark, tmp_path):
    docs, labels = [(i, f"text {i % 7} $", "a") for i in range(20)], [(i, i % 2, i % 3 % 2) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert got(queries.op13_filter_audit(spark, str(tmp_path))) == brute(docs, labels)
