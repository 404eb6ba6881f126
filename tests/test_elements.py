"""Pages as tokens: selectors, text and markup as expressions, elements as rows."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shortlist.operators import elements as E
from shortlist.operators import pages

PAGE = (
    "<div class='posting-page x'><div class='posting-categories'>c</div> text <div id='a'>A</div><div id='b'>B</div></div>"
    "<main><section><article class='my-job'>M</article></section></main><article class='other'>O</article><a data-qa='btn-apply' class='q' href='/1'>q</a>"
)


def one(spark, html, column):
    page = E.tokenise(spark.createDataFrame([(html,)], "html string")).withColumn("elements", E.opening(F.col("tokens")))
    return page.select(column).first()[0]


@pytest.mark.parametrize(
    ("selector", "found"),
    [
        (".posting-page .posting-categories + div", ["a"]), (".posting-page .posting-categories + p", []), ("main article", ["my-job"]), ('article[class*="job"]', ["my-job"]),
        ("article", ["my-job", "other"]), ('a[data-qa="btn-apply"]', ["q"]), ('a[data-qa="btn"]', []), ("a[href]", ["q"]), ("div.posting-page", ["posting-page x"]), ("#b", ["b"]), ("#a + div", ["b"]), ("main section article", ["my-job"]),
    ],
)
def test_selectors(spark, selector, found):
    name = lambda e: F.coalesce(E.attribute(e, "id"), E.attribute(e, "class"))
    assert one(spark, PAGE, F.transform(E.select(F.col("elements"), selector), name)) == found


@pytest.mark.parametrize(
    ("html", "written"),
    [
        ("<p>a<b>c</p>d", "<p>a<b>c</b></p>d"), ("<ul><li>x<br>y</ul></div>", "<ul><li>x<br>y</li></ul>"), ("a &amp; b &lt;", "a &amp; b &lt;"), ("<a title='x\"&gt;' href>y", '<a title="x&quot;&gt;" href="">y</a>'),
        ("<!-- c --><!DOCTYPE html>t", "t"), ("", ""), (None, ""), ("<b><b>", "<b><b></b></b>"),
    ],
)
def test_markup_closes_what_is_open(spark, html, written):
    assert one(spark, html, E.markup(F.col("tokens"))) == written


def test_depth_has_no_limit(spark):
    deep = "<div>" * 3000 + "word" + "</div>" * 3000
    page = E.tokenise(spark.createDataFrame([(deep,)], "html string"))
    row = page.select(E.lines(F.col("tokens")).alias("t"), F.size(E.opening(F.col("tokens"))).alias("n"), F.array_max(F.transform("tokens", lambda t: t["mate"])).alias("m")).first()
    assert tuple(row) == ("word", 3000, 6001)


def test_lines_and_noise(spark):
    html = "<nav>menu<p>x</p></nav><h1> T </h1><script>var a = '<p>'</script><ul><li>one<li>two</ul>\u00a0<b>three</b>  four<br>five"
    assert one(spark, html, E.lines(E.without(F.col("tokens"), ["nav"]))) == "T\n- one\n- two\nthree  four\nfive"
    assert one(spark, html, E.markup(E.without(F.col("tokens"), pages.NOISE))).startswith("<h1> T </h1><ul><li>one<li>two")


def test_attributes_that_stay(spark):
    html = f'<a class="one w-12 two {"x" * 30} ab-3 three four" style="s" data-x="1" database="2" id="i">t</a>'
    assert one(spark, html, E.markup(F.col("tokens"), pages.tidy)) == '<a data-x="1" id="i" class="one two three">t</a>'


def test_rows_of_elements_join_by_range(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>a<b>c</b>d</p>"), (3, None)], "id int, html string")
    rows = E.element_rows(df, "id").cache()
    assert sorted((r.tag, r.own_text) for r in rows.where("id = 2").collect()) == [("b", "c"), ("p", "ad")]
    a, b = rows.alias("a"), rows.alias("b")
    inside = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("b.pre") > F.col("a.pre")) & (F.col("b.pre") < F.col("a.last")))
    assert [r.c for r in inside.where("a.tag = 'main' and b.tag = 'article'").select(F.col("b.attrs")["class"].alias("c")).collect()] == ["my-job"]
    after = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("b.before") == F.col("a.pre")))
    assert [r.c for r in after.where("a.attrs['class'] = 'posting-categories'").select(F.col("b.attrs")["id"].alias("c")).collect()] == ["a"]


def test_odd_postings(spark):
    blocks = [{"@type": "JobPosting", "description": "d " * 40, "url": ["no text"], "applicationContact": {"url": ""}}, {"@type": "JobPosting", "description": 7}, {"@type": "JobPosting", "description": None, "url": "u"}]
    rows = [(i, f'<script type="application/ld+json">{json.dumps(b)}</script>') for i, b in enumerate(blocks)]
    got = {r.id: tuple(r)[1:] for r in pages.extract_json_ld(spark.createDataFrame(rows, "id int, html string")).collect()}
    assert got == {0: (1, ("d " * 40).strip(), None), 1: (1, None, None), 2: (1, None, None)}


def test_batches_are_cut_by_tokens(spark):
    df = spark.createDataFrame([(i, "<p>a</p>" * (i % 4)) for i in range(50)], "id int, html string").coalesce(1)
    assert {r.id: r.n for r in E.tokenise(df, most=3).select("id", F.size("tokens").alias("n")).collect()} == {i: 3 * (i % 4) for i in range(50)}


def test_page_columns_stay(spark):
    df = spark.createDataFrame([(1, "x", 2.5, "<main>m</main>")], "`a.b` int, url string, tokens double, html string")
    assert pages.extract_content(df).columns == ["a.b", "url", "tokens", "content"] and pages.extract_css(df).first()["tokens"] == 2.5
    assert pages.extract_css(df.limit(0)).count() == 0


def test_a_long_part_is_measured_without_breaks_and_noise(spark):
    page = lambda said: f"<body><div class='ad'>x</div><article><nav>{'n' * 99}</nav><h1>t</h1><p>{said}</p></article></body>"
    rows = [(1, page("w" * 199)), (2, page("w" * 200)), (3, page("&amp;" + "w" * 195)), (4, page("w" * 49_980))]
    got = {r.id: r.content.startswith("<h1>") for r in pages.extract_content(spark.createDataFrame(rows, "id int, html string")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}


def test_batches_of_long_pages_are_small(spark, monkeypatch):
    caught, df = [], spark.createDataFrame([("x",)], "html string")
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: caught.append(f) or real(self, f, schema))
    E.tokenise(df)
    pages = pa.RecordBatch.from_pydict({"c0": [f"<p>{'a' * 10_000}</p>"] * 1000})
    sizes = [b.num_rows for b in caught[0](iter([pages]))]
    assert sum(sizes) == 1000 and max(sizes) <= 200
