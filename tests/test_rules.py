from pyspark.sql import functions as F

from shortlist.operators import rules
from shortlist.operators.rules import Boost, Cap, Preferences

PREFS = Preferences(
    target_roles=["data engineer"], adjacent_roles=["analyst"], reject_roles=["intern"], dealbreakers=["unpaid"],
    positive_signals=["spark", "sql", "C++"], negative_signals=["travel"], hard_caps=[Cap(["night shift"], 3, "nights"), Cap(["on call"], 5)],
    location_boosts=[Boost(["Lyon"], 1, 8, 10, "home"), Boost(["France"], 2, 9, 10)],
)


def scored(spark, **row):
    base = {"title": None, "company": None, "location": None, "description": None, "full_description": None}
    df = spark.createDataFrame([tuple({**base, **row}.values())], "title string, company string, location string, description string, full_description string")
    return df, df.select(rules.score_by_rules(PREFS).alias("r")).first().r


def test_cascade(spark):
    assert scored(spark, title="Data Engineer", full_description="Spark, SQL and C++ here")[1].score == 9
    assert scored(spark, title="Data Engineer", full_description="Spark, SQL, C++, travel")[1].score == 8
    assert scored(spark, title="Data Engineer", full_description="Spark only")[1] is None
    assert scored(spark, title="Analyst", full_description="spark sql")[1].score == 7
    assert scored(spark, title="Data Engineer intern")[1].rule == "reject_role"
    assert scored(spark, title="x", description="UNPAID work")[1].score == 2
    low = scored(spark, title="Data Engineer", description="night shift, spark, sql, C++")[1]
    assert (low.score, low.rule, low.keywords) == (3, "hard_cap:nights", "night shift")
    assert scored(spark, title="internal data engineer")[1] is None  # a word, not a part of one


def test_empty_preferences_decide_nothing(spark):
    df = spark.createDataFrame([("a", "b", "c", "d", "e")], "title string, company string, location string, description string, full_description string")
    assert df.select(rules.score_by_rules(Preferences()).alias("r")).first().r is None


def test_caps_and_boosts(spark):
    df, _ = scored(spark, title="t", location="Lyon, France", description="on call")
    given = lambda s: F.struct(F.lit(s).alias("score"), F.lit("f").alias("fit"), F.lit("g").alias("gap"), F.lit("k").alias("keywords"), F.lit(None).cast("string").alias("rule"))
    capped = df.select(rules.apply_hard_caps(given(9), PREFS).alias("r")).first().r
    assert capped.score == 5 and "on call" in capped.gap
    raised = df.select(rules.apply_location_boosts(given(8), PREFS).alias("r")).first().r
    assert raised.score == 10 and raised.keywords == "k, Lyon, France"
    assert df.select(rules.apply_location_boosts(given(6), PREFS).alias("r")).first().r.score == 6


def test_unicode_boundaries(spark):
    df = spark.createDataFrame([("CAFÉ owner",), ("pythonic",), ("C++ dev",), (None,)], "t string")
    got = [tuple(r) for r in df.select(rules.contains_phrase(F.col("t"), "café"), rules.contains_phrase(F.col("t"), "python"), rules.contains_phrase(F.col("t"), "c++")).collect()]
    assert got == [(True, False, False), (False, False, False), (False, False, True), (False, False, False)]


def test_many_profiles_score_as_one_by_one(spark):
    profiles = {
        "all": PREFS,
        "no signals": Preferences(target_roles=["C++ developer", "data engineer"], hard_caps=[Cap(["unpaid"], 0), Cap(["night shift"], 4, "nights"), Cap(["travel"], 6)]),
        "signals": Preferences(target_roles=["C++ developer"], positive_signals=["sql", "spark (core)"], reject_roles=["café owner"]),
    }
    titles = ["Data Engineer", "C++ developer", "C developer", "Analyst", "Café Owner", "intern data engineer", None]
    texts = ["spark, SQL and C++", "unpaid night shift", "Spark (core) / sql", "night shift travel sql spark", None]
    rows = [(i * len(texts) + j, t, None, None, x, None) for i, t in enumerate(titles) for j, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, title string, company string, location string, description string, full_description string")
    many = {(r.profile, r.k): (r.score, r.rule) for r in rules.score_many(df, rules.phrase_table(spark, profiles), "k").collect()}
    for name, prefs in profiles.items():
        one = {r.k: r.r for r in rules.with_rule_result(df, prefs, "r").collect()}
        for k, r in one.items():
            assert many.get((name, k)) == ((r.score, r.rule) if r else None), (name, rows[k])
    assert len(many) > 20


def test_signals_are_looked_for_once_and_only_one_scan_counts_routes(spark):
    from shortlist.operators import rules
    from shortlist.plans import q_rules
    from shortlist.plans.prefs import PREFS

    rows = spark.createDataFrame([("t", "c", "l", "d", "f")], "title string, company string, location string, description string, full_description string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    scored = plan(rules.with_rule_result(rows, PREFS, "r").select("r.score", "r.keywords", "r.rule"))
    assert scored.count("2\\-HIGH(?!\\w)") + scored.count("2\\-HIGH(?<!") <= 2  # in the pattern of all signals and in its own
    assert plan(q_rules.r9_route(spark, "/root/testdata/sf0.001")).count("l_linestatus") <= plan(q_rules.r5_score_by_rules(spark, "/root/testdata/sf0.001")).count("l_linestatus")


def test_phrases_found_by_bytes_first_are_those_of_the_pattern(spark):
    from shortlist.functions import text as X

    texts = ["a rod", "arod", "rods", "ROD.", "rod_", "érod", "rod é", "ſet rod", "ſET", "Key set", "rod́", "", None, "grod rod", "\U0001d400rod", "rodrod rod", "-rod-", "KEY", "c++ x", "xc++", "c++y"]
    phrases = ["rod", "set", "key", "c++", "é"]
    old = [rf"(?iuU)(?<!\w){p.replace('+', chr(92) + '+')}(?!\w)" for p in phrases]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", X.ascii_lower(F.col("t")))
    for given in (phrases, phrases[:-1]):
        plain = F.array_compact(F.array(*[F.when(F.coalesce("t", F.lit("")).rlike(o), F.lit(p)) for p, o in zip(given, old, strict=False)]))
        for r in df.select("t", plain.alias("a"), X.matched_phrases(F.col("t"), given, F.col("low")).alias("b"), X.matched_phrases(F.col("t"), given).alias("c"), X.first_phrase(F.col("t"), given, F.col("low")).alias("d")).collect():
            assert r.a == r.b == r.c and r.d == (r.a[0] if r.a else None), r
    spaces = ["a  b", " a\tb ", "a b", "a\x1cb", "a \n b", "a  b", "", "a b c"]
    same = spark.createDataFrame([(t,) for t in spaces], "t string").select(X.collapse(F.col("t")).alias("a"), F.trim(F.regexp_replace("t", r"(?U)\s+", " ")).alias("b")).collect()
    assert all(r.a == r.b for r in same)
