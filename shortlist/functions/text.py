"""Text functions on Columns."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_non_empty(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*map(blank_to_null, columns))


def collapse(c: Column) -> Column:
    """Runs of (Unicode) white space become one space; the ends are trimmed."""
    # a single space is left alone, so most texts have nothing to replace
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def normal_phrase(c: Column) -> Column:
    """Lower case; whatever is no ASCII letter or digit becomes a space; single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def canonical(c: Column) -> Column:
    """The text that fingerprints are made from: no protocol, query or fragment, letters and digits only."""
    low = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    cut = F.regexp_replace(F.regexp_replace(low, r"https?://", ""), r"(?s)[?#].*$", "")
    return F.trim(F.regexp_replace(cut, "[^a-z0-9]+", " "))


def phrase_pattern(phrase: str) -> str:
    """A pattern for a phrase in any case that no word character touches.

    What stands before it is looked at where the phrase was found, and not at each place of the text.
    """
    safe = re.sub(r"([^\w\s])", r"\\\1", phrase)
    return rf"(?iuU){safe}(?<!\w{safe})(?!\w)"


def ascii_lower(c: Column) -> Column:
    """The text in lower case where it is ASCII, else null: ``low`` for the functions below, worth a column of its own."""
    text = F.coalesce(c, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text))


def _maybe(low: Column, phrases: list[str]) -> Column:
    """False where no phrase stands in the lower-case text; null where that is null."""
    return functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(p.lower())) for p in phrases])


def contains_phrase(c: Column, phrase: str, low: Column | None = None) -> Column:
    """With ``low`` a search for bytes comes before the pattern, for phrases in ASCII."""
    found = F.coalesce(c, F.lit("")).rlike(phrase_pattern(phrase))
    return found if low is None or not phrase.isascii() else F.coalesce(_maybe(low, [phrase]), F.lit(True)) & found


def contains_any(c: Column, phrases: list[str]) -> Column:
    """Whether the text holds one of the phrases: one pattern for all of them."""
    every = "|".join(phrase_pattern(p).removeprefix("(?iuU)") for p in phrases)
    return F.coalesce(c, F.lit("")).rlike(f"(?iuU)(?:{every})")


def _worth_trying(c: Column, phrases: list[str], low: Column | None) -> Column:
    """False only where the text holds none of the phrases."""
    if low is None or not all(p.isascii() for p in phrases):
        return contains_any(c, phrases)
    return F.when(low.isNull(), contains_any(c, phrases)).otherwise(_maybe(low, phrases))


def matched_phrases(c: Column, phrases: list[str], low: Column | None = None) -> Column:
    """The phrases that the text holds, in their order."""
    hits = [F.when(contains_phrase(c, p, low), F.lit(p)) for p in phrases]
    none = F.array().cast("array<string>")
    if len(hits) < 2:
        return F.array_compact(F.array(*hits)) if hits else none
    return F.when(_worth_trying(c, phrases, low), F.array_compact(F.array(*hits))).otherwise(none)


def first_phrase(c: Column, phrases: list[str], low: Column | None = None) -> Column:
    hits = [F.when(contains_phrase(c, p, low), F.lit(p)) for p in phrases]
    if len(hits) < 2:
        return hits[0] if hits else F.lit(None).cast("string")
    return F.when(_worth_trying(c, phrases, low), F.coalesce(*hits))


def first_items(items: Column, n: int) -> Column:
    return F.array_join(F.slice(items, 1, n), ", ")


def csv_items(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def count_words(c: Column) -> Column:
    flat = collapse(c)
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " ")))


def html_escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def plain_punctuation(c: Column) -> Column:
    """Long dashes and curly quotes as ASCII."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), " *— *", ", ")
    out = F.replace(out, F.lit("–"), F.lit("-"))
    return F.trim(F.translate(out, "“”‘’", "\"\"''"))


SIGNALS = ["role", "lead", "manage", "support", "operations", "contract"]
HEADINGS = ["about us", "about the company", "job description", "responsibilities", "requirements"]


def clean_description(c: Column, headings: list[str] = HEADINGS) -> Column:
    """Scraped text without markdown, links, bullets and headings."""
    out = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\-"), F.lit("-")), F.lit("\\*"), F.lit("*"))
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, r"https?://[^ \t\n\r]+", "")
    out = F.regexp_replace(out, "[`*_>#]+", "")
    out = F.regexp_replace(out, r"[ \t\n\r]*[-•][ \t\n\r]+", " ")
    out = F.regexp_replace(out, r"(?i)\b(" + "|".join(headings) + r")\b[ ]*:?,?", "")
    return F.btrim(F.regexp_replace(out, r"[ \t\n\r\x0b\f]+", " "), F.lit(" -–—:;,."))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def short_summary(c: Column, limit: int = 300, enough: int = 180, signals: list[str] = SIGNALS, empty: str = "No description.") -> Column:
    """At most three sentences from the first telling one on, within ``limit`` characters."""
    tells = rf"(?i)\b({'|'.join(signals)})\b"
    state = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

    def picked(said: Column) -> Column:
        start = F.coalesce(F.array_min(F.filter(F.transform(F.slice(said, 1, 8), lambda s, i: F.when(s.rlike(tells), i)), lambda i: i.isNotNull())), F.lit(0))
        return F.slice(said, start + 1, 3)

    def add(acc, s):
        return once(
            F.when(acc["text"] == "", s).otherwise(F.concat(acc["text"], F.lit(" "), s)),
            lambda longer: F.when(acc["done"] | ((F.length(longer) > limit) & (acc["text"] != "")), F.struct(acc["text"].alias("text"), F.lit(True).alias("done"))).otherwise(F.struct(longer.alias("text"), (F.length(longer) >= enough).alias("done"))),
        )

    def shortened(chosen: Column) -> Column:
        short = F.concat(F.rtrim(F.regexp_replace(F.substring(chosen, 1, limit), r" [^ ]*$", ""), F.lit(".,;:")), F.lit("…"))
        return F.when(F.length(chosen) <= limit, chosen).otherwise(short)

    def summary(text: Column) -> Column:
        said = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")
        return F.when(text == "", F.lit(empty)).otherwise(once(F.aggregate(once(said, picked), state, add)["text"], shortened))

    return once(clean_description(c), summary)
