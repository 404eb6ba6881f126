"""HTML pages as tokens: Python cuts pages up, everything after that is expressions on arrays.

A page is an array of tokens in document order, in which each element that opens also closes, so an
element is the range from its token (``at``) to its end (``mate``), and what is inside lies between
the two. Selectors are filters of that array, text and markup are joined slices of it. Nothing is
shuffled: a row holds its whole page.

``element_rows`` gives the same elements as rows, numbered alike, for joins by range.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}  # fixed values: elements without an end
BLOCKS = ["p", "div", "h1", "h2", "h3", "h4", "li", "tr"]
TEXT, RAW = "#text", "#raw"  # raw: inside script or style

TOKEN = "struct<at:int, mate:int, parent:int, before:int, tag:string, attrs:map<string,string>, text:string>"
TOKENS = f"array<{TOKEN}>"
POSTINGS = f"array<struct<description:{TOKENS}, url:string>>"
SPACES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# --- cutting up (the only part in Python) ------------------------------------


class _Tokens(HTMLParser):
    """Tokens as (at, mate, parent, before, tag, attrs, text); positions count from 1, parent 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.open: list[dict] = []
        self.names: Counter = Counter()
        self.last = {0: None}

    def _add(self, **what) -> dict:
        token = {"at": len(self.out) + 1, "mate": None, "parent": self.open[-1]["at"] if self.open else 0, "before": None, "tag": None, "attrs": None, "text": None} | what
        self.out.append(token)
        return token

    def handle_starttag(self, tag, attrs):
        token = self._add(tag=tag, attrs={k: v or "" for k, v in attrs})
        token["before"], self.last[token["parent"]] = self.last[token["parent"]], token["at"]
        if tag in VOID:
            token["mate"] = token["at"]
        else:
            self.last[token["at"]] = None
            self.open.append(token)
            self.names[tag] += 1

    def _end(self):
        token = self.open.pop()
        self.names[token["tag"]] -= 1
        end = self._add(tag=token["tag"], mate=token["at"], parent=token["parent"])
        token["mate"] = end["at"]
        return token["tag"]

    def handle_endtag(self, tag):
        if self.names[tag]:
            while self._end() != tag:
                pass

    def handle_data(self, data):
        self._add(tag=RAW if self.open and self.open[-1]["tag"] in ("script", "style") else TEXT, text=data)

    def done(self) -> list[dict]:
        self.close()
        while self.open:
            self._end()
        return self.out


def cut(page: str | None) -> list[dict]:
    """The tokens of a page; elements without an end close with the element around them."""
    builder = _Tokens()
    builder.feed(page or "")
    return builder.done()


def find_posting(data) -> dict | None:
    """The first object typed JobPosting in objects, @graph lists and nested lists."""
    todo = [data]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            if x.get("@type") == "JobPosting":
                return x
            if isinstance(x.get("@graph"), list):
                todo = [*x["@graph"], *todo]
        elif isinstance(x, list):
            todo = [*x, *todo]
    return None


def _json_blocks(tokens: list[dict]) -> list:
    out = []
    for t in tokens:
        if t["tag"] == "script" and t["mate"] > t["at"] and t["attrs"].get("type") == "application/ld+json":
            try:
                out.append(json.loads("".join(x["text"] for x in tokens[t["at"] : t["mate"] - 1])))
            except (ValueError, RecursionError):
                continue
    return out


def _posting(block) -> dict | None:
    """Description (as tokens) and apply URL of a block's posting; what is no text counts as missing."""
    posting = find_posting(block)
    if posting is None:
        return None
    said = str(posting.get("description") or "")
    contact = posting.get("applicationContact")
    urls = [posting.get("url") if posting.get("directApply") else None, contact.get("url") if isinstance(contact, dict) else None, posting.get("url")]
    marked = "<" in said and ">" in said
    return {"description": cut(said) if marked else [{"tag": TEXT, "text": said}], "url": next((u for u in urls if u and isinstance(u, str)), None)}


def tokenise(pages: DataFrame, html: str = "html", most: int = 20_000) -> DataFrame:
    """(.., html) -> (.., tokens, ld_blocks, ld_postings), in a row each; a null page has no tokens.

    An Arrow batch holds ``most`` tokens, 100 characters of a page counting as one more, unless a single page
    has more; a worker holds one such batch as Python objects. Columns may have any name.
    """
    at = pages.columns.index(html)
    plain = pages.toDF(*[f"c{i}" for i in range(len(pages.columns))])
    kept = [f for i, f in enumerate(plain.schema) if i != at]
    made = StructType.fromDDL(f"tokens {TOKENS}, ld_blocks int, ld_postings {POSTINGS}")
    types = [to_arrow_type(f.dataType) for f in made]

    def batch(rows: pa.RecordBatch, made_rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, type=t) for c, t in zip(zip(*made_rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([rows.column(f.name) for f in kept] + columns, names=[f.name for f in kept] + made.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ready, first, size = [], 0, 0
            for i, cell in enumerate(rows.column(at)):
                page = cell.as_py()
                tokens = cut(page)
                blocks = _json_blocks(tokens)
                ready.append((tokens, len(blocks), [p for p in map(_posting, blocks) if p]))
                size += len(tokens) + len(page or "") // 100 + sum(len(p["description"]) for p in ready[-1][2])
                if size >= most:
                    made_batch = batch(rows.slice(first, len(ready)), ready)
                    ready, first, size, tokens, blocks = [], i + 1, 0, None, None  # the objects go before the next batch is made
                    yield made_batch
            if ready:
                yield batch(rows.slice(first, len(ready)), ready)

    found = plain.mapInArrow(run, StructType([*kept, *made.fields]))
    return found.toDF(*[c for i, c in enumerate(pages.columns) if i != at], *made.names)


# --- expressions -------------------------------------------------------------


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once, also inside the lambdas of ``use``."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def opening(tokens: Column) -> Column:
    """The tokens that open an element."""
    return F.filter(tokens, lambda t: t["mate"] >= t["at"])


def inside(tokens: Column, element: Column) -> Column:
    """The tokens between an element and its end."""
    return F.when(element.isNotNull(), F.slice(tokens, element["at"] + 1, F.greatest(element["mate"] - element["at"] - 1, F.lit(0))))


def attribute(element: Column, name: str) -> Column:
    return F.try_element_at(element["attrs"], F.lit(name))


_COMPOUND = re.compile(r"\+|(?:\[[^\]]*\]|[^\s\[+])+")
_TEST = re.compile(r"#(?P<id>[\w-]+)|\.(?P<word>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<how>\*?=)\"(?P<value>[^\"]*)\")?\]")


@functools.cache
def compiled(selector: str) -> tuple[tuple[str, str, tuple[dict, ...]], ...]:
    """The steps (' ' for inside or '+' for right after, tag, tests) of a selector of tags, ids, classes and attributes."""
    steps, how = [], " "
    for part in _COMPOUND.findall(selector):
        if part == "+":
            how = "+"
            continue
        steps.append((how, re.match(r"[\w-]*", part)[0], tuple(m.groupdict() for m in _TEST.finditer(part))))
        how = " "
    return tuple(steps)


def _passes(element: Column, tag: str, tests: tuple[dict, ...]) -> Column:
    out = element["tag"] == tag if tag else F.lit(True)
    for t in tests:
        if t["id"]:
            out &= attribute(element, "id") == t["id"]
        elif t["word"]:
            out &= F.array_contains(F.split(attribute(element, "class"), r"(?U)\s+"), t["word"])
        elif not t["how"]:
            out &= attribute(element, t["attr"]).isNotNull()
        else:
            own = attribute(element, t["attr"])
            out &= own == t["value"] if t["how"] == "=" else own.contains(t["value"])
    return out


def select(elements: Column, selector: str) -> Column:
    """The elements (of the opening tokens of a page) that a selector names, in document order."""
    (_, tag, tests), *further = compiled(selector)
    found = F.filter(elements, lambda e: _passes(e, tag, tests))
    for how, tag, tests in further:
        found = let(found, functools.partial(_step, elements, how, tag, tests))
    return found


def _step(elements: Column, how: str, tag: str, tests: tuple[dict, ...], above: Column) -> Column:
    """The elements that pass the tests, inside one of ``above`` or right after it."""
    near = lambda e: F.exists(above, lambda a: a["at"] == e["before"] if how == "+" else (a["at"] < e["at"]) & (e["at"] < a["mate"]))
    return F.filter(elements, lambda e: _passes(e, tag, tests) & near(e))


def first(elements: Column, selector: str) -> Column:
    return F.get(select(elements, selector), F.lit(0))


def text(tokens: Column) -> Column:
    """The text of tokens, with a line for each block and a dash before items; scripts and styles have none."""

    def piece(t: Column) -> Column:
        ends = F.coalesce(t["mate"] < t["at"], F.lit(False))
        block = F.when((t["tag"] == "li") & ~ends, "\n- ").otherwise("\n")
        return F.when(t["tag"] == TEXT, t["text"]).when(t["tag"].isin("br", *BLOCKS), block).otherwise("")

    return F.array_join(F.transform(tokens, piece), "")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, SPACES, "")


def lines(tokens: Column) -> Column:
    """The text of tokens as trimmed lines, none of them empty."""
    return F.array_join(F.filter(F.transform(F.split(text(tokens), "\n"), stripped), lambda x: x != ""), "\n")


def escaped(c: Column, quotes: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else out


def markup(tokens: Column, attrs: Callable[[Column], Column] = lambda a: a) -> Column:
    """Tokens written as HTML again; ``attrs`` chooses what stays of the attributes of an element."""

    def piece(t: Column) -> Column:
        said = F.transform(F.map_entries(attrs(t["attrs"])), lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), escaped(a["value"], quotes=True), F.lit('"')))
        return F.when(t["text"].isNotNull(), escaped(t["text"])).when(t["mate"] < t["at"], F.concat(F.lit("</"), t["tag"], F.lit(">"))).otherwise(F.concat(F.lit("<"), t["tag"], F.array_join(said, ""), F.lit(">")))

    return F.array_join(F.transform(tokens, piece), "")


def without(tokens: Column, tags: list[str]) -> Column:
    """Tokens outside the elements with one of these tags."""
    gone = F.filter(tokens, lambda t: t["tag"].isin(tags) & (t["mate"] >= t["at"]))
    return let(gone, lambda ranges: F.filter(tokens, lambda t: ~F.exists(ranges, lambda r: t["at"].between(r["at"], r["mate"]))))


# --- elements as rows --------------------------------------------------------


def element_rows(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, html) -> a row per element: keys, pre, last, parent, before, tag, attrs, own_text.

    ``pre`` orders the elements of a page; b is inside a if ``b.pre > a.pre and b.pre < a.last``, right after
    it if ``b.before = a.pre``, a child if ``b.parent = a.pre``. ``own_text`` is the text that stands in an
    element but in none inside it.
    """
    t, e = F.col("tokens"), F.col("element")
    found = tokenise(pages.select(*keys, "html")).select(*keys, "tokens", F.explode(opening(t)).alias("element"))
    own = F.filter(inside(t, e), lambda x: x["text"].isNotNull() & (x["parent"] == F.col("element.at")))
    return found.select(
        *keys, e["at"].alias("pre"), e["mate"].alias("last"), e["parent"].alias("parent"), e["before"].alias("before"), e["tag"].alias("tag"), e["attrs"].alias("attrs"),
        F.array_join(F.transform(own, lambda x: x["text"]), "").alias("own_text"),
    )
