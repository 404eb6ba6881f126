"""Detail pages: URL resolution, extraction from HTML in tiers, and merging the results."""

from __future__ import annotations

import html as entities
import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import elements as E

# --- native text functions ---------------------------------------------------

#: All named entities of HTML 5, those that need no semicolon, and what numeric ones below 160 stand for.
NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
BARE = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
NUMBERED = {str(n): entities.unescape(f"&#{n};") for n in range(160)}


def _known(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def decode_entities(c: Column) -> Column:
    """Named and numeric entities as text; what is none stays as it is."""
    numbered, named = _known(NUMBERED), _known(NAMED)
    bare_names = f"^({'|'.join(BARE)})"

    def decoded(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?", 1)
        number = F.when(digits.rlike("^[xX]"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
        odd = number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        by_number = F.when(odd, "\ufffd").when(number < 160, F.try_element_at(numbered, number.cast("string"))).otherwise(letter)
        name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1)
        bare = F.regexp_extract(piece, bare_names, 1)
        rest = lambda n: F.substr(piece, n + 1)
        return F.when(digits != "", F.concat(by_number, rest(F.length(F.regexp_extract(piece, "^#([0-9]+|[xX][0-9a-fA-F]+);?", 0))))).otherwise(
            F.coalesce(
                F.concat(F.try_element_at(named, name), rest(F.length(name) + 1)),
                F.when(bare != "", F.concat(F.try_element_at(named, bare), rest(F.length(bare)))),
                F.concat(F.lit("&"), piece),
            )
        )

    def whole(text: Column) -> Column:
        pieces = F.split(text, "&")
        rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decoded)
        return F.when(text.contains("&"), F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))).otherwise(text)

    return F.element_at(F.transform(F.array(c), whole), 1)  # the argument is evaluated once


def strip_html(c: Column) -> Column:
    """Text of HTML: no scripts or styles, a newline for blocks, single spaces, at most one blank line."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<script[^>]*>.*?(</script>|\z)|<style[^>]*>.*?(</style>|\z)", "")
    out = F.regexp_replace(out, r"(?i)<(br|p|div|li|tr|h[1-6])(\s[^>]*)?/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(p|div|li|tr)\s*>", "\n")
    out = decode_entities(F.regexp_replace(out, "(?s)<[^>]*>", ""))
    out = F.regexp_replace(out, r"[ \t\r\f\x0b ]+", " ")
    return F.btrim(F.regexp_replace(out, "\n{3,}", "\n\n"), F.lit(" \n"))


def html_to_lines(c: Column) -> Column:
    """HTML (only if it has both angle brackets) as trimmed lines without blank ones; list items get a dash."""
    text = F.coalesce(c, F.lit(""))
    out = F.regexp_replace(text, r"(?is)<script[^>]*>.*?(</script>|\z)|<style[^>]*>.*?(</style>|\z)", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)<li(\s[^>]*)?>", "\n- ")
    out = F.regexp_replace(out, r"(?i)</?(p|div|h[1-4]|tr)(\s[^>]*)?>|</li\s*>", "\n")
    out = decode_entities(F.regexp_replace(out, "(?s)<[^>]*>", ""))
    marked = F.when(text.contains("<") & text.contains(">"), out).otherwise(text)
    lines = F.transform(F.split(marked, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\x0b ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


# --- URLs --------------------------------------------------------------------


def join_url(base: Column, url: Column) -> Column:
    """A relative URL against an absolute base; dot segments are folded."""
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(base, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^$", "/")
    query = F.regexp_extract(base, r"(\?[^#]*)", 1)
    tail = F.regexp_extract(url, r"([?#].*)$", 1)
    own = F.regexp_extract(url, "^([^?#]*)", 1)
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), own))
    parts = F.split(F.substr(merged, F.lit(2)), "/")
    start = F.array().cast("array<string>")

    def fold(acc, x):
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(x == ".", acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    last = F.element_at(parts, -1)
    folded = F.array_join(F.aggregate(parts, start, fold), "/")
    ends = F.when(last.isin(".", "..") & (folded != ""), F.lit("/")).otherwise("")
    resolved = F.concat(root, F.lit("/"), folded, ends, tail)
    return F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(scheme, url)).when(url.startswith("?"), F.concat(root, path, url)).when(url.startswith("#"), F.concat(root, path, query, url)).otherwise(resolved)


def resolve_url(df: DataFrame, bases: DataFrame, url: str = "url", never: list[str] | None = None, search: dict[str, str] | None = None, skip: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``resolved``: absolute URLs pass, others join their site's base (site, base: a small table), else null.

    ``never`` lists sites without usable links, ``search`` gives a prefix for bare
    ids of a site, ``skip`` the paths of a site that lead nowhere.
    """
    c, site = F.col(url), F.col("site")
    joined = df.join(bases.select(F.col("site").alias("b_site"), F.col("base").alias("b_base")), site == F.col("b_site"), "left")
    out = F.when(F.coalesce(c, F.lit("")) == "", None).when(c.startswith("http://") | c.startswith("https://"), c)
    if never:
        out = out.when(site.isin(never), None)
    for name, prefix in (search or {}).items():
        out = out.when((site == name) & ~c.contains("/"), F.concat(F.lit(prefix), c))
    for name, paths in (skip or {}).items():
        out = out.when((site == name) & c.isin(paths), None)
    clean = F.substring_index(c, ";jsessionid=", 1)
    out = out.when(F.coalesce("b_base", F.lit("")) == "", None).otherwise(join_url(F.col("b_base"), clean))
    return joined.withColumn("resolved", out).drop("b_site", "b_base")


def resolve_all(df: DataFrame, bases: DataFrame, order: list[str], **rules) -> DataFrame:
    """Rewrite keys to absolute URLs; a row whose new URL is taken keeps its old one and becomes url_merged, with the reason.

    Of rows with one new URL, one that had it already wins, then the first by ``order``.
    Relative application URLs, if there is such a column, are rewritten in the same way.
    """
    found = resolve_url(df, bases, **rules)
    absolute = F.col("url").startswith("http://") | F.col("url").startswith("https://")
    target = F.coalesce("resolved", "url")
    winner = Window.partitionBy("target").orderBy(F.col("absolute").desc(), *order)
    ranked = found.withColumns({"absolute": absolute, "target": target}).withColumn("rn", F.row_number().over(winner))
    outcome = F.when(F.col("absolute"), "absolute").when(F.col("resolved").isNull(), "failed").when(F.col("rn") > 1, "merged").otherwise("resolved")
    out = ranked.withColumn("outcome", outcome)
    merged = F.col("outcome") == "merged"
    old = F.col("status_reason") if "status_reason" in df.columns else F.lit(None).cast("string")
    reason = F.when(merged, F.concat(F.lit("canonical URL collided with "), "resolved")).otherwise(old)
    out = out.withColumns({"status": F.when(merged, "url_merged").otherwise(F.col("status")), "status_reason": reason, "url": F.when(F.col("outcome") == "resolved", F.col("resolved")).otherwise(F.col("url"))}).drop("absolute", "target", "rn", "resolved")
    if "application_url" not in df.columns:
        return out
    own = F.col("application_url")
    return resolve_url(out, bases, **(rules | {"url": "application_url"})).withColumn("application_url", F.when(F.lower(own).startswith("http"), own).otherwise(F.coalesce("resolved", own))).drop("resolved")


def resolve_counts(resolved: DataFrame) -> DataFrame:
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    return resolved.agg(n("resolved", "merged").alias("resolved"), n("failed").alias("failed"), n("absolute").alias("already_absolute"))


# --- documents ---------------------------------------------------------------

NOISE = ["script", "style", "noscript", "svg", "iframe", "nav", "header", "footer"]  # fixed values: what is dropped from content
KEEP_ATTRS = ["id", "href", "class", "role", "aria-label", "data-testid", "name", "for", "type"]  # fixed values: what stays of a tag
# fixed values: class names that a build tool seems to have made, by their length or their form
LONG_CLASS = 30
SHORT_CLASS = r"(?U)^[a-z]{1,2}-\d+$"


def tidy(attrs: Column) -> Column:
    """The attributes that say something: at most three class names, none that a build tool seems to have made."""
    kept = [name for name in KEEP_ATTRS if name != "class"]
    said = F.map_filter(attrs, lambda k, _: k.isin(kept) | F.substring_index(k, "-", 1).isin("data", "aria"))
    names = F.split(F.coalesce(F.try_element_at(attrs, F.lit("class")), F.lit("")), r"(?U)\s+")
    good = F.filter(names, lambda n: (n != "") & (F.char_length(n) < LONG_CLASS) & ~n.rlike(SHORT_CLASS))
    return F.when(F.size(good) == 0, said).otherwise(F.map_concat(said, F.create_map(F.lit("class"), F.array_join(F.slice(good, 1, 3), " "))))


# fixed values: where an apply link and a description are looked for, in order
APPLY_SELECTORS = [
    'a[href*="apply"]',
    'a[data-testid*="apply"]',
    'a[class*="apply"]',
    'a[aria-label*="pply"]',
    'button[data-testid*="apply"]',
    "a#apply_button",
    ".postings-btn-wrapper a",
    "a.ashby-job-posting-apply-button",
    '#grnhse_app a[href*="apply"]',
    'a[data-qa="btn-apply"]',
    'a[class*="btn-apply"]',
    'a[class*="apply-btn"]',
    'a[class*="apply-button"]',
]
DESCRIPTION_SELECTORS = [
    "#job-description",
    "#job_description",
    "#jobDescriptionText",
    ".job-description",
    ".job_description",
    '[class*="job-description"]',
    '[class*="jobDescription"]',
    '[data-testid*="description"]',
    '[data-testid="job-description"]',
    ".posting-page .posting-categories + div",
    "#content .posting-page",
    "#app_body .content",
    "#grnhse_app .content",
    ".ashby-job-posting-description",
    '[class*="posting-description"]',
    '[class*="job-detail"]',
    '[class*="jobDetail"]',
    '[class*="job-content"]',
    '[class*="job-body"]',
    '[role="main"] article',
    "main article",
    'article[class*="job"]',
    ".job-posting-content",
]
# fixed values: where the main part of a page is looked for
MAIN_SELECTORS = ["main", "article", '[role="main"]', "#content", ".content"]

def json_ld_of(postings: Column) -> Column:
    """(description, url) of the first posting whose description has at least 50 characters."""
    said = F.transform(postings, lambda p: F.struct(E.lines(p["description"]).alias("description"), p["url"].alias("url")))
    return F.get(F.filter(said, lambda p: F.char_length(p["description"]) >= 50), F.lit(0))


def description_of(tokens: Column, elements: Column, selectors: list[str]) -> Column:
    """The text of the first element of each selector, the first text with at least 100 characters."""
    candidates = F.array(*[E.first(elements, s) for s in selectors])
    said = F.transform(candidates, lambda e: E.lines(E.inside(tokens, e)))
    return F.get(F.filter(said, lambda x: F.char_length(x) >= 100), F.lit(0))


def apply_url_of(tokens: Column, elements: Column, selectors: list[str]) -> Column:
    """The link to apply by; '' where a button without a link stands for the page itself."""
    goes = lambda href: href.isNotNull() & ~href.isin("", "#")

    def link(e: Column) -> Column:
        href = E.attribute(e, "href")
        around = F.get(tokens, e["parent"] - 1)  # null where the page itself is the parent
        beside = F.get(F.filter(elements, lambda a: (a["tag"] == "a") & (a["at"] > e["parent"]) & (around.isNull() | (a["at"] < around["mate"]))), F.lit(0))
        return F.when(goes(href), href).when(e["tag"] == "button", F.coalesce(E.attribute(beside, "href"), F.lit("")))

    candidates = F.array(*[E.first(elements, s) for s in selectors])
    chosen = F.get(F.filter(F.transform(candidates, link), lambda x: x.isNotNull()), F.lit(0))

    def says_apply(a: Column) -> Column:
        href = E.attribute(a, "href")
        said = E.let(F.lower(E.stripped(E.text(E.inside(tokens, a)))), lambda t: t.contains("apply") & (F.char_length(t) < 50))
        return (a["tag"] == "a") & goes(href) & ~href.contains("javascript:") & said

    return F.coalesce(chosen, E.attribute(F.get(F.filter(elements, says_apply), F.lit(0)), "href"))


def main_content(tokens: Column, elements: Column) -> Column:
    """The markup of the main part, or of the body where no part is found, without noise tags and attributes.

    A part is long enough if what is left of it has more than 200 characters outside its tags, as written in HTML and
    without breaks between blocks, and short enough below 50,000 with them.
    """
    cleaned = lambda inner: E.markup(E.without(inner, NOISE), tidy)

    def part(e: Column) -> Column:
        said = lambda content: F.char_length(F.btrim(F.regexp_replace(content, "<[^>]*>", ""), F.lit(" ")))
        return E.let(cleaned(E.inside(tokens, e)), lambda content: F.when((said(content) > 200) & (F.char_length(content) < 50_000), content))

    body = E.first(elements, "body")
    return F.coalesce(*[part(E.first(elements, s)) for s in MAIN_SELECTORS], F.substring(cleaned(F.when(body.isNull(), tokens).otherwise(E.inside(tokens, body))), 1, 50_000))


def _cut(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` but html, with __tokens, __elements, __ld and __blocks."""
    own = [c for c in pages.columns if c != "html"]
    renamed = E.tokenise(pages).toDF(*own, "__tokens", "__blocks", "__postings")
    return renamed.withColumns({"__elements": E.opening(F.col("__tokens")), "__ld": json_ld_of(F.col("__postings"))})


def _made(found: DataFrame, pages: DataFrame, made: dict[str, Column]) -> DataFrame:
    own = [F.col(f"`{c}`") for c in pages.columns if c != "html" and c not in made]
    return found.select(*own, *[value.alias(name) for name, value in made.items()])


def extract_json_ld(pages: DataFrame) -> DataFrame:
    """(.., html) -> (.., ld_blocks, ld_description, ld_apply_url)."""
    return _made(_cut(pages), pages, {"ld_blocks": F.col("__blocks"), "ld_description": F.col("__ld.description"), "ld_apply_url": F.col("__ld.url")})


def _css(pages: DataFrame, description: list[str], apply: list[str]) -> tuple[Column, Column]:
    tokens, elements = F.col("__tokens"), F.col("__elements")
    found = apply_url_of(tokens, elements, apply)
    own = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    return description_of(tokens, elements, description), E.let(found, lambda x: F.when(x == "", own).otherwise(x))


def extract_css(pages: DataFrame, description: list[str] = DESCRIPTION_SELECTORS, apply: list[str] = APPLY_SELECTORS) -> DataFrame:
    """(.., html) -> (.., css_description, css_apply_url); an apply button without a link gives the page's own ``url``, if there is such a column."""
    text, url = _css(pages, description, apply)
    return _made(_cut(pages), pages, {"css_description": text, "css_apply_url": url})


def extract_content(pages: DataFrame) -> DataFrame:
    """(.., html) -> (.., content): the main part, without noise tags and attributes."""
    return _made(_cut(pages), pages, {"content": main_content(F.col("__tokens"), F.col("__elements"))})


def clean_content_html(pages: DataFrame) -> DataFrame:
    return _made(_cut(pages), pages, {"content": E.markup(E.without(F.col("__tokens"), NOISE), tidy)})


def cascade(pages: DataFrame, key: str, model_rows: DataFrame | None = None) -> DataFrame:
    """(key, full_description, application_url, tier, status): tier 1 JSON-LD, 2 patterns, 3 rows of a model.

    Rows that tier 1 solves never reach the patterns, except for a missing apply URL.
    """
    own = pages.select(key, *[c for c in ("url",) if c in pages.columns and c != key], "html")
    found = _cut(own)
    solved = F.col("__ld.description").isNotNull() & (F.col("__ld.url") != "")
    css, link = _css(own, DESCRIPTION_SELECTORS, APPLY_SELECTORS)
    joined = found.select(key, F.col("__ld.description").alias("ld_description"), F.col("__ld.url").alias("ld_apply_url"), F.when(F.col("__ld.description").isNull(), css).alias("css_description"), F.when(~F.coalesce(solved, F.lit(False)), link).alias("css_apply_url"))
    if model_rows is not None:
        joined = joined.join(model_rows.select(key, F.col("full_description").alias("m_description"), F.col("application_url").alias("m_url")), key, "left")
    else:
        joined = joined.withColumns({"m_description": F.lit(None).cast("string"), "m_url": F.lit(None).cast("string")})
    text = F.coalesce("ld_description", "css_description", "m_description")
    tier = F.when(F.col("ld_description").isNotNull(), 1).when(F.col("css_description").isNotNull(), 2).when(F.col("m_description").isNotNull(), 3)
    url = F.coalesce("ld_apply_url", "css_apply_url", "m_url")
    status = F.when(text.isNotNull() & url.isNotNull(), "ok").when(text.isNotNull() | url.isNotNull(), "partial").otherwise("error")
    return joined.select(key, text.alias("full_description"), url.alias("application_url"), tier.alias("tier"), status.alias("status"))


def model_extract_requests(pages: DataFrame, key: str, cut: int = 30_000) -> DataFrame:
    return extract_content(pages).select(key, F.substring("content", 1, cut).alias("content"))


# --- fetch outcomes and merging ----------------------------------------------

PERMANENT = [404, 410, 451]  # fixed values: pages that will not come back
# fixed values: what pages of closed postings say
CLOSED = [
    "position closed", "no longer accepting", "job has expired", "position has been filled", "listing is no longer available",
    "this position is no longer available", "we are no longer accepting", "job expired", "closed position", "application deadline has passed",
    "application period has ended", "this role has been filled", "this vacancy has been closed", "position is no longer open",
]


def classify_fetch(status: Column, error: Column, permanent: list[int] = PERMANENT) -> Column:
    return F.when(status.isin(permanent), F.concat(F.lit("HTTP "), status.cast("string"))).when(F.lower(error).contains("timeout"), "timeout").when(error.isNotNull(), F.substring(error, 1, 200))


def closed_posting(url: Column, status: Column, body: Column, error: Column, phrases: list[str] = CLOSED) -> Column:
    """Why a posting is closed, or null while it counts as active."""
    low = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 5000))
    said = F.coalesce(*[F.when(low.contains(p), F.lit(f"says: {p}")) for p in phrases])
    return F.when((F.coalesce(url, F.lit("")) == "") | error.isNotNull() | (status == 403), None).when(status.isin(404, 410), F.concat(F.lit("HTTP "), status.cast("string"))).otherwise(said)


def enrich_merge(postings: DataFrame, results: DataFrame, key: str, at: Column) -> DataFrame:
    """ok and partial results set their fields and clear the error; others set it; all stamp the time."""
    r = results.select(F.col(key).alias("r_key"), *[F.col(c).alias(f"r_{c}") for c in ("full_description", "application_url", "status", "error")])
    joined = postings.join(r, F.col(key) == F.col("r_key"), "left")
    hit, good = F.col("r_key").isNotNull(), F.col("r_status").isin("ok", "partial")
    made = {
        "full_description": F.when(good, F.col("r_full_description")).otherwise(F.col("full_description")),
        "application_url": F.when(good, F.col("r_application_url")).otherwise(F.col("application_url")),
        "detail_error": F.when(good, None).when(hit, F.coalesce("r_error", F.lit("unknown"))).otherwise(F.col("detail_error")),
        "detail_scraped_at": F.when(hit, at).otherwise(F.col("detail_scraped_at")),
    }
    return joined.withColumns(made).drop("r_key", "r_full_description", "r_application_url", "r_status", "r_error")


def enrich_queue(postings: DataFrame, skip: list[str], ranks: DataFrame, per_site: int, order: list[str]) -> DataFrame:
    """Pending rows, at most so many per site, with the site's rank (known sites first)."""
    todo = postings.where(F.col("detail_scraped_at").isNull() & ~F.col("site").isin(skip))
    capped = todo.withColumn("queue_place", F.row_number().over(Window.partitionBy("site").orderBy(*order))).where(F.col("queue_place") <= per_site)
    return capped.join(ranks, "site", "left").withColumn("site_rank", F.coalesce("site_rank", F.lit(1_000_000)))


def enrich_stats(results: DataFrame) -> DataFrame:
    """Per site, and over all (a null site): outcomes, tiers, and the share without a model call."""
    n = lambda c: F.count_if(c)
    return results.rollup("site").agg(
        F.count(F.lit(1)).alias("processed"), n(F.col("status") == "ok").alias("ok"), n(F.col("status") == "partial").alias("partial"), n(F.col("status") == "error").alias("error"),
        *[n(F.col("tier") == k).alias(f"tier{k}") for k in (1, 2, 3)],
        F.round(100.0 * n(F.col("tier").isin(1, 2)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("percent_without_model"),
    )
