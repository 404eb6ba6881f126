import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from shortlist.functions import text as X
from shortlist.operators import digest, filters, lifecycle, pages, quality, reports, responses
from shortlist.sources import normalise as S
from shortlist.sources import tables


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def test_location_card(spark):
    rows = [(None, True), ("", True), ("Remote - US", True), ("Paris, India", False), ("Milwaukee", True), ("Rome", False), ("wfh India", True)]
    df = spark.createDataFrame(rows, "loc string, want boolean")
    # substrings count, so that "UK" accepts Milwaukee
    assert df.where(filters.location_ok(F.col("loc"), ["UK", "Paris"], ["india"]) != F.col("want")).count() == 0


def test_title_phrases_are_whole_words(spark):
    bad = filters.title_excluded(F.col("t"), ["intern", "sales-rep"])
    assert one(spark, bad, t="Intern, data") and not one(spark, bad, t="International lead") and one(spark, bad, t="Sales Rep II")


def test_unknown_stage():
    with pytest.raises(ValueError):
        filters.pending("nope")
    with pytest.raises(ValueError):
        filters.snapshot("nope")


def test_salaries(spark):
    c = F.col
    assert one(spark, S.format_salary(c("a"), c("b"), c("u"), c("i")), a=90000.9, b=120000.0, u="USD", i="yearly") == "USD90,000-USD120,000/yearly"
    assert one(spark, S.format_salary(c("a"), c("b"), c("u"), c("i")), a=0.0, b=5.0, u="USD", i="") is None
    assert one(spark, S.format_salary(c("a"), c("b"), c("u"), c("i")), a=float("nan"), b=5.0, u="USD", i="") is None
    assert one(spark, S.format_salary_compact(c("a"), c("b"), c("u")), a=2_500.0, b=3_500_000.0, u="IDR") == "2K-4jt IDR"
    assert one(spark, S.format_salary_compact(c("a"), c("b"), c("u")), a=7_000_000.0, b=0.0, u="IDR") == "7jt+ IDR"


def test_company_from_text(spark):
    df = spark.createDataFrame([(None, "Come work at Blue Sky Labs. Now", "x"), (None, "Acme Corp is hiring", "x"), (None, "", "Cook at Roma Foods"), ("Given", "at Other Inc", "x"), (None, None, None)], "company string, description string, title string")
    assert [r.company for r in S.fill_company(df).collect()] == ["Blue Sky Labs", "Acme Corp", "Roma Foods", "Given", None]


def test_shards(spark):
    df = spark.range(10)
    parts = [[r.id for r in S.shard(df, 3, k, ["id"]).collect()] for k in (1, 2, 3)]
    assert parts == [[0, 3, 6, 9], [1, 4, 7], [2, 5, 8]]
    assert sum(S.shard_by_hash(df, 3, k, "id").count() for k in (1, 2, 3)) == 10
    with pytest.raises(ValueError):
        S.shard(df, 3, 4, ["id"])


@pytest.mark.parametrize(
    ("text", "want"),
    [("SCORE: 8/10\nFIT: a\n\nb\nGAP: c", (8, "a\nb", "c")), ("hello\nSCORE: -5", (5, "", "")), ("SCORE: 40\nFIT: x\nFIT: y", (10, "x\ny", "")), ("nothing", (None, "", "")), (None, (None, "", ""))],
)
def test_marker_lines(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(responses.parse_score(F.col("t")).alias("r")).first().r
    assert (r.score, r.fit, r.gap) == want
    assert (r.error is None) == (want[0] is not None)


def _json_in(text):
    """The same search with Python's parser."""

    def strict(x):
        try:
            json.loads(x, parse_constant=lambda _: 1 / 0, object_pairs_hook=lambda p: dict(p) if len(dict(p)) == len(p) else 1 / 0)
            return x
        except (ValueError, ZeroDivisionError):
            return None

    text = (text or "").strip()
    if strict(text) is not None:
        return text
    for block in text.split("```")[1::2]:
        block = block.strip()
        block = block[4:].strip() if block.lower().startswith("json") else block
        if strict(block) is not None:
            return block
    start = text.find("{")
    return next((text[start : e + 1] for e in range(len(text) - 1, start, -1) if text[e] == "}" and strict(text[start : e + 1]) is not None), None) if start >= 0 else None


def test_json_in_responses(spark):
    rng = random.Random(4)
    whole = ['{"a": 1}', '{"a": [1, {"b": "}"}]}', "7", "-1.5e3", '"x\\"y"', "null", "[1, 2]", '{"a": "\\\\"}', '{"a":1,"a":2}', '{"a": NaN}', "{'a': 1}", '{"a": 01}', "{", "}", "", '"', '{"t": "line\\nx ``` y"}', '{"é": "日本"}', "tru", "[1,]"]
    texts = [*whole, None, "none", "Sure\n```json\n{\"a\": [1]}\n```", 'x {"a": 2} y } z', "```JSON 5```", "``` {} ``` ```{\"b\": 1}```", '{"a": 1} ```{"b": 2}```', '{"k": "' + 'a\\n' * 20_000 + '"} end', "\u00a0{}\u2003"]
    texts += ["".join(rng.choice([*whole, " ", "```", "json", "x", "\n"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    found = responses.extract_json(df, "t")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "Pandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.json for r in found.collect()}
    assert {i: (t, got[i]) for i, t in enumerate(texts)} == {i: (t, _json_in(t)) for i, t in enumerate(texts)}


def test_attempts(spark):
    rows = [("a", 1, False, False, False), ("a", 2, True, True, True), ("b", 1, True, False, False), ("b", 2, True, False, True), ("c", 1, True, True, False), ("c", 2, True, True, False), ("d", 1, True, False, True), ("d", 2, False, False, False)]
    df = spark.createDataFrame(rows, "k string, attempt int, json_ok boolean, valid boolean, judged_ok boolean")
    got = {r.k: (r.outcome, r.attempts_used) for r in responses.resolve_attempts(df, "k", 1).collect()}
    assert got == {"a": ("approved", 2), "b": ("failed_validation", 2), "c": ("approved_with_judge_warning", 2), "d": ("exhausted_retries", 2)}


def test_urls(spark):
    base = "https://h.example/a/b?q#f"
    for url, want in [("//x.example/p", "https://x.example/p"), ("/p/../q", "https://h.example/q"), ("c/./d", "https://h.example/a/c/d"), ("?z=1", "https://h.example/a/b?z=1"), ("../..", "https://h.example/"), ("mailto:x", "mailto:x")]:
        assert one(spark, pages.join_url(F.col("b"), F.col("u")), b=base, u=url) == want


def test_page_tiers(spark):
    ld = json.dumps({"@graph": [{"@type": "Other"}, [{"@type": "JobPosting", "description": "<p>" + "text " * 20 + "</p><li>item</li>", "directApply": True, "url": "u1"}]]})
    rows = [(1, f'<script type="application/ld+json">{ld}</script>'), (2, '<div class="job-description">' + "word " * 40 + '</div><a href="#">Apply</a><a href="/go">Apply now</a>'), (3, "<p>short</p>"), (4, None), (5, '<script type="application/ld+json">{bad</script>')]
    got = {r.k: r for r in pages.cascade(spark.createDataFrame(rows, "k int, html string"), "k").collect()}
    assert (got[1].tier, got[1].application_url, got[1].status) == (1, "u1", "ok") and got[1].full_description.endswith("- item")
    assert (got[2].tier, got[2].application_url) == (2, "/go")
    assert [got[k].status for k in (3, 4, 5)] == ["error"] * 3


def test_html_text(spark):
    df = spark.createDataFrame([("<p>A &amp; B</p><ul><li>x</li><li>y</li></ul><script>no</script>",), ("plain\n\n text",), (None,)], "h string")
    assert [tuple(r) for r in df.select(pages.html_to_lines(F.col("h")), pages.strip_html(F.col("h"))).collect()] == [("A & B\n- x\n- y", "A & B\n\nx\n\ny"), ("plain\ntext", "plain\n\n text"), ("", "")]


def test_history_keeps_first_and_replaces_last(spark):
    schema = "url string, application_url string, title string, company string, location string, fit_score int, at timestamp"
    rows = spark.createDataFrame([("u", None, "T", "C", "L", 9, None)], schema).withColumn("at", F.to_timestamp(F.lit("2001-01-02")))
    first = digest.history_rows(rows.withColumn("at", F.to_timestamp(F.lit("2001-01-01"))), F.col("at"))
    merged = digest.upsert_history(first, rows, F.col("at")).collect()
    assert len(merged) == 2 and all(str(r.first_notified_at) < str(r.last_seen_at) for r in merged)
    assert digest.upsert_history(first.limit(0), rows, F.col("at")).count() == 2
    seen = digest.split_by_history(rows.withColumns({"url": F.lit("other"), "k": F.lit(1)}), first, "k").first().seen
    assert seen  # the role's fingerprint is known


def test_retention_at_the_cutoff(spark):
    df = spark.createDataFrame([("a", "active", "2000-12-18"), ("b", "active", "2000-12-17"), ("c", "expired", "2000-01-01")], "url string, status string, d string").select("url", "status", F.to_timestamp("d").alias("discovered_at"), F.lit(None).cast("timestamp").alias("scored_at"))
    assert {r.url: r.status for r in lifecycle.expire(df, "2001-01-01", 14).collect()} == {"a": "active", "b": "expired", "c": "expired"}
    kept, gone = lifecycle.prune(df, "2001-01-01", 14)
    assert sorted(r.url for r in kept.collect()) == ["a", "b"] and [r.url for r in gone.collect()] == ["c"]


def test_summary_and_packing(spark):
    text = "Welcome here. You lead a team. You write code. " + "Long sentence " * 30 + "."
    got = one(spark, X.short_summary(F.col("t")), t=text)
    assert got == "You lead a team. You write code."
    lines = spark.createDataFrame([("p", i, "x" * 40) for i in range(5)], "by string, i int, line string")
    assert sorted((r.part, r.lines) for r in digest.pack_messages(lines, "by", ["i"], 100).collect()) == [(1, 2), (2, 2), (3, 1)]
    assert one(spark, F.array_join(X.csv_items(F.col("t")), "|"), t=" a, ,b ,") == "a|b"


def test_queue_takes_every_rank(spark):
    n = 12_000  # more sites than a broadcast cap of 10,000 would keep
    site = F.format_string("s%05d", F.col("id"))
    todo = spark.range(n).select("id", site.alias("site"), F.lit(None).cast("timestamp").alias("detail_scraped_at"))
    ranks = spark.range(n - 1).select(site.alias("site"), F.col("id").cast("int").alias("site_rank"))
    got = pages.enrich_queue(todo, [], ranks, 1, ["id"])
    assert got.count() == n and got.where("site_rank <> id").select("id", "site_rank").collect() == [(n - 1, 1_000_000)]


def test_every_claim_pattern_counts(spark):
    claims = [r"\bi built acme\b", r"\bacme i made\b", r"\bmy acme\b"]
    verdict = quality.validate_letter(F.col("t"), claims=claims)
    for said, want in [("I built Acme", ["false claim"]), ("Acme I made", ["false claim"]), ("My Acme", ["false claim"]), ("I built Acme. My Acme", ["false claim"]), ("Acme", [])]:
        got = one(spark, verdict, t=f"Dear team, {said}.")
        assert (got.passed, got.errors) == (not want, want)
    assert one(spark, quality.validate_letter(F.col("t"), claims=[]), t="Dear team, my Acme.").passed


def test_resolving_gives_reasons_and_application_urls(spark):
    rows = [(1, "a", "/p", "apply/1", None), (2, "a", "p", "https://x.example/1", "old"), (3, "c", "q", "/r", None), (4, "a", "https://a.example/z", None, None), (5, "a", "/y", "", None), (6, "a", "/w", "mailto:x", None)]
    df = spark.createDataFrame(rows, "k int, site string, url string, application_url string, status_reason string").withColumn("status", F.lit("active"))
    got = {r.k: r for r in pages.resolve_all(df, spark.createDataFrame([("a", "https://a.example/")], "site string, base string"), ["k"]).collect()}
    assert [got[k].application_url for k in range(1, 7)] == ["https://a.example/apply/1", "https://x.example/1", "/r", None, "", "mailto:x"]
    assert [got[k].status_reason for k in range(1, 7)] == [None, "canonical URL collided with https://a.example/p", None, None, None, None]
    assert [got[k].status for k in (1, 2, 3)] == ["active", "url_merged", "active"] and got[2].url == "p"
    assert "application_url" not in pages.resolve_all(df.drop("application_url"), spark.createDataFrame([], "site string, base string"), ["k"]).columns


def test_entities(spark):
    import html

    for text in ("caf&eacute; &#8217;x &#x1F600; &amp;lt; a & b &nope; &frac12; &#128; &#0; &#xD800; &#1114112; R&D; &&amp;", "plain", "&NotEqualTilde;&#10;y", "&amp &ampx; &copy2024 &notit; &#39x &#x41g &am &#; &#x;"):
        assert one(spark, pages.decode_entities(F.col("t")), t=text) == html.unescape(text)
    assert one(spark, pages.strip_html(F.col("t")), t="<p>caf&eacute;</p><script>let a = 1") == "café"
    assert one(spark, pages.html_to_lines(F.col("t")), t="<li>a&#8217;s<style>p {}") == "- a’s"


def test_closed_phrases(spark):
    closed = pages.closed_posting(F.lit("u"), F.lit(200), F.col("b"), F.lit(None).cast("string"))
    assert one(spark, closed, b="Sorry, this role has been filled.") == "says: this role has been filled"
    assert one(spark, closed, b="Apply now") is None


def test_escapes_of_markdown(spark):
    assert one(spark, X.clean_description(F.col("t")), t="end\\-to\\-end \\*work\\*") == "end-to-end work"


def test_sections_of_rows_without_a_score(spark):
    df = spark.createDataFrame([(1, 9), (2, 9), (3, None), (4, None), (5, 42)], "id int, fit_score int")
    got = {r.id: (r.new_section, r.group_size) for r in reports.with_breaks(df, ["id"]).collect()}
    assert got == {1: (True, 2), 2: (False, 2), 3: (True, 2), 4: (False, 2), 5: (True, 1)}


def test_versions_of_a_table(spark, tmp_path):
    path = f"{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path)
    tables.write_table(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, x string"), path)
    tables.update_table(spark, path, spark.createDataFrame([(2, "c"), (9, "z")], "k int, x string"), "k", {"x": F.col("new_x")})
    assert tables.delete_rows(spark, path, F.col("x") == "a") == 1
    assert sorted(map(tuple, tables.read_table(spark, path).collect())) == [(2, "c"), (3, None)]
    assert tables.versions(spark, path) == [1, 2]
    # a version that was not committed does not count
    spark.range(1).write.parquet(f"{path}/v3")
    (tmp_path / "table" / "v3" / "_SUCCESS").unlink()
    assert sorted(r.k for r in tables.read_table(spark, path).collect()) == [2, 3]


def test_link_beside_a_button(spark):
    lone = "<button data-testid='apply'>Go</button>"
    rows = [(1, "u1", '<div><button data-testid="apply-now">Go</button><a href="/go/1">here</a></div>'), (2, "u2", lone), (3, "u3", None), (4, "u4", f"{lone}<a id='apply_button' href='/go/4'>x</a>"), (5, "u5", "<a class='btn-apply' href='/go/5'>x</a>" + lone)]
    df = spark.createDataFrame(rows, "id int, url string, html string")
    assert {r.id: r.css_apply_url for r in pages.extract_css(df).collect()} == {1: "/go/1", 2: "u2", 3: None, 4: "/go/4", 5: "/go/5"}
    assert {r.id: r.css_apply_url for r in pages.extract_css(df.drop("url")).collect()} == {1: "/go/1", 2: None, 3: None, 4: "/go/4", 5: "/go/5"}
    assert {r.id: r.application_url for r in pages.cascade(df, "id").collect()} == {1: "/go/1", 2: "u2", 3: None, 4: "/go/4", 5: "/go/5"}



def test_a_summary_cleans_its_text_once(spark):
    from shortlist.functions.text import short_summary

    made = spark.createDataFrame([("a",)], "t string").select(short_summary(F.col("t")).alias("s"))
    assert made._jdf.queryExecution().analyzed().expressions().mkString().count("[`*_>#]+") == 1


def test_postings_meet_orders_first(spark):
    from shortlist.plans import bindings

    plan = bindings.postings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "o_orderkey" in [x for x in plan.splitlines() if "Join Inner" in x][-1]


def test_sinks_share_one_join(spark, monkeypatch):
    from shortlist.plans import bindings, q_ingest

    seen, real = [], bindings.postings
    monkeypatch.setattr(q_ingest, "staged", lambda df, name, made=q_ingest.staged: seen.append(name) or made(df, name))
    monkeypatch.setattr(bindings, "postings", lambda *args: real(*args).limit(10))
    assert {r.lines for r in q_ingest.f2_registered_sinks(spark, "/root/testdata/sf0.001").collect()} == {10} and seen == ["lines"]
