"""Queries on pages whose texts are just long enough, against SQL."""

import duckdb
import pytest

from shortlist.plans import registry


def rows(spark, path, name, table, frame):
    frame.coalesce(1).write.parquet(f"{path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    found = registry.QUERIES[name](spark, str(path))
    order = ", ".join(found.columns)
    return sorted(map(tuple, found.collect()), key=str), sorted(con.execute(f"select {order} from ({registry.ORACLE[name]})").fetchall(), key=str)


@pytest.mark.parametrize("name", ["h8_main_content", "h18_model_extract_requests"])
def test_main_part(spark, tmp_path, name):
    page = lambda n: f'<html><body><div class="ad">ad</div><article><h1>head</h1><p>{"w" * n}</p><ul><li>x</li></ul></article></body></html>'
    got, wanted = rows(spark, tmp_path, name, "pages", spark.createDataFrame([(n, "u", page(n)) for n in range(185, 205)], "page_id long, url string, html string"))
    assert got == wanted


def test_tiers(spark, tmp_path):
    ends = ["", "&&&", "<<", ">>", "<b>", "###"]
    texts = ["w" * (n - len(end)) + end for n in (49, 50, 51, 99, 100, 101) for end in ends]
    docs = [(5 * i + k, text, "s") for i, text in enumerate(texts) for k in range(5)]
    got, wanted = rows(spark, tmp_path, "h12_tiers", "documents", spark.createDataFrame(docs, "doc_id long, text string, source string"))
    assert got == wanted


@pytest.mark.parametrize("name", ["h8_main_content", "h9_clean_content_html", "h18_model_extract_requests"])
def test_entities_cut_off(spark, tmp_path, name):
    """Headings that end within an entity. SQL leaves ``&quot`` without its semicolon as it stands, HTML reads a quote."""
    ends = [e[:n] for e in ("&amp;", "&quot;") for n in range(1, len(e) + 1)]
    page = lambda end: f"<html><head><title>t {end}</title></head><body><article><h1>h {end}</h1><p>{'w' * 300}</p></article></body></html>"
    got, wanted = rows(spark, tmp_path, name, "pages", spark.createDataFrame([(n, "u", page(end)) for n, end in enumerate(ends)], "page_id long, url string, html string"))
    cut = ends.index("&quot")
    assert [r for r in got if cut not in r] == [r for r in wanted if cut not in r]
    assert [r[1 - r.index(cut)].split("<h1>")[1].split("</h1>")[0] for r in got if cut in r] == ['h "']
