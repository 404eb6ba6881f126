"""The automaton against one pattern for each phrase."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shortlist.functions import phrases
from shortlist.functions.text import contains_phrase
from shortlist.operators import rules
from shortlist.operators.rules import Cap, Preferences

PIECES = ["a", "B", "ab", "c++", "é", "É", "\u0301", "ß", "İ", "_", "1", " ", "-", "σ", "ς", "Σ", "\u200d", "ⓐ", "日本", ".", "A b"]


def test_like_patterns(spark):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice(PIECES) for _ in range(rng.randint(1, n)))
    some = sorted({p for p in (make(3).strip() for _ in range(60)) if p})
    texts = [(i, make(12)) for i in range(300)] + [(300, None), (301, ""), (302, "ab " * 20_000)]
    df = spark.createDataFrame(texts, "k int, t string")
    got = {r.k: r.t for r in phrases.with_phrases(df, "k", {"t": some}).collect()}
    want = {r.k: [i for i, x in enumerate(r.x) if x] for r in df.select("k", F.array(*[contains_phrase(F.col("t"), p) for p in some]).alias("x")).collect()}
    assert got == want and sum(map(len, want.values())) > 100
    assert phrases.with_phrases(df, "k", {"t": []}).where("size(t) > 0").count() == 0


@given(st.text(alphabet="abAB c", max_size=30), st.lists(st.text(alphabet="abc ", min_size=1, max_size=3), max_size=6))
@settings(max_examples=200, deadline=None)
def test_nested_phrases(text, some):
    def holds(p):
        t, q = text.lower(), p.lower()
        return any(t[i : i + len(q)] == q and (i == 0 or not t[i - 1].isalnum()) and (i + len(q) == len(t) or not t[i + len(q)].isalnum()) for i in range(len(t) - len(q) + 1))

    assert phrases.Phrases(some).find(text) == [i for i, p in enumerate(some) if holds(p)]


def test_many_profiles_in_one_scan(spark):
    """Thousands of profiles: the rows that score_by_rules gives, and postings are scanned once."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)] + ["c++", "data engineer", "night shift"]
    pick = lambda n: rng.sample(words, n)
    rows = [(i, " ".join(pick(3)), "c" if i % 3 else None, "l", " ".join(pick(8)), " ".join(pick(12))) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, title string, company string, location string, description string, full_description string").repartition(2)
    prefs = {
        f"p{i}": Preferences(target_roles=pick(3), adjacent_roles=pick(3), reject_roles=pick(1), dealbreakers=pick(1), positive_signals=pick(20 if i % 4 else 0), negative_signals=pick(2), hard_caps=[Cap(pick(1), 3, "x"), Cap(pick(1), 7)])
        for i in range(2000)
    }
    found = rules.score_many(df, rules.phrase_table(spark, prefs), "k")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r.profile, r.k): (r.score, r.rule) for r in found.collect()}
    for name in rng.sample(sorted(prefs), 12):
        want = {(name, r.k): (r.r.score, r.r.rule) for r in df.select("k", rules.score_by_rules(prefs[name]).alias("r")).where("r is not null").collect()}
        assert {k: v for k, v in got.items() if k[0] == name} == want


def test_null_and_repeated_texts(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, None), (3, "ab c"), (4, ""), (5, "c, AB")], "k int, t string").coalesce(1)
    got = {r.k: r.t for r in phrases.with_phrases(df, "k", {"t": ["ab", "c", "b"]}).collect()}
    assert got == {1: [0, 1], 2: [], 3: [0, 1], 4: [], 5: [0, 1]}


def test_counts_of_keys_on_several_texts(spark):
    """A key counts for each result that one of its rows has; no shuffle takes the texts."""
    rows = [("a", "widget"), ("a", "rod"), ("a", "rod"), ("b", "widget rod"), ("c", "widget"), (None, "widget"), (None, "ring"), ("d", "none")]
    df = spark.createDataFrame([(k, t, None, "", "role remote", "") for k, t in rows], "k string, title string, company string, location string, description string, full_description string").repartition(3)
    prefs = {
        "p": Preferences(target_roles=["widget"], adjacent_roles=["ring"], reject_roles=["rod"], positive_signals=["role", "remote"]),
        "q": Preferences(adjacent_roles=["ring"], reject_roles=["bolt"], positive_signals=["role", "remote"]),
    }
    counted = rules.count_many(df, rules.phrase_table(spark, prefs), "k")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counted.collect())) == [("p", 2, "reject_role", 2), ("p", 7, "adjacent_role_match", 0), ("p", 8, "target_role_match", 2), ("q", 7, "adjacent_role_match", 0)]
    assert plan.count("MapInArrow") == 1
    assert not any("description" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_r11_key_on_several_texts(spark, tmp_path):
    """Repeated orders give one key several texts; the query counts as its SQL does."""
    import duckdb

    from shortlist.plans import registry

    for name in ("lineitem", "part", "supplier", "nation", "orders"):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "orders":
            table = table.unionByName(table.withColumn("o_orderpriority", F.when(F.col("o_orderpriority") == "5-LOW", "1-URGENT").otherwise("5-LOW")))
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    got = registry.QUERIES["r11_score_many"](spark, str(tmp_path)).select("profile", "score", "rule", "postings").collect()
    duck = duckdb.connect()
    for name in ("lineitem", "part", "supplier", "nation", "orders"):
        duck.execute(f"create view {name} as from '{tmp_path}/{name}.parquet/*.parquet'")
    want = duck.execute(registry.ORACLE["r11_score_many"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
