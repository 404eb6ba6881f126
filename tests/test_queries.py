"""Every registered query with SQL gives the rows that DuckDB gives."""

import collections
import datetime
import math
import re

import duckdb
import pytest

from shortlist.functions import text as X
from shortlist.plans import registry
from shortlist.plans.bindings import with_views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _assembled(rows, ask):
    docs = {d: (t, s) for d, t, s in ask("select doc_id, text, source from documents")}
    assert len(rows) == len(docs)
    for r in rows:
        text, source = docs[r.doc_id]
        assert text.strip() in r.document and source in r.document and "School" in r.document


def _packed(rows, ask):
    assert sum(r.lines for r in rows) == ask("select count(*) from postings")[0][0]
    parts = collections.defaultdict(list)
    for r in rows:
        assert r.size <= 1000
        parts[r.profile].append(r.part)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in parts.values())


def _summary(text):
    """The summary of one text, step by step."""
    out = re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", text.replace("\\-", "-").replace("\\*", "*"))
    out = re.sub(r"https?://[^ \t\n\r]+", "", out)
    out = re.sub(r"[`*_>#]+", "", out)
    out = re.sub(r"[ \t\n\r]*[-•][ \t\n\r]+", " ", out)
    out = re.sub(rf"(?ai)\b({'|'.join(X.HEADINGS)})\b[ ]*:?,?", "", out)
    out = re.sub(r"[ \t\n\r\x0b\f]+", " ", out).strip(" -–—:;,.")
    if not out:
        return "No description."
    said = [x for x in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", out) if x]
    start = next((i for i, x in enumerate(said[:8]) if re.search(rf"(?ai)\b({'|'.join(X.SIGNALS)})\b", x)), 0)
    chosen = ""
    for x in said[start : start + 3]:
        longer = f"{chosen} {x}" if chosen else x
        if len(longer) > 300 and chosen:
            break
        chosen = longer
        if len(chosen) >= 180:
            break
    return chosen if len(chosen) <= 300 else re.sub(r" [^ ]*$", "", chosen[:300]).rstrip(".,;:") + "…"


def _summaries(rows, ask):
    key = "doc_id" if "doc_id" in rows[0] else "url"
    text = {d if key == "doc_id" else u: t for d, u, t in ask("select doc_id, url, full_description from doc_postings")}
    assert len(rows) == len(text)
    for r in rows:
        assert r.summary == _summary(text[r[key]] or "")


def _sources(rows, ask):
    assert len(rows) == ask("select (select count(*) from documents) + (select count(*) from postings)")[0][0]


#: What the rows of queries without SQL must be.
EXPECTED = {
    "g13_assemble_document": _assembled,
    "x7_short_summary": _summaries,
    "d9_pack_messages": _packed,
    "f1_registered_sources": _sources,
}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in registry.ORACLE:
        EXPECTED[name](df.collect(), lambda q: duck.execute(with_views(q)).fetchall())
        return
    cur = duck.execute(registry.ORACLE[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    assert got == sorted(str([plain(r[at[c]]) for c in cols]) for r in cur.fetchall())


def test_flagship(spark):
    rows = registry.flagship(spark, SF)
    assert rows.columns[:2] == ["url", "title"] and rows.count() > 0
