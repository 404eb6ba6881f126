"""Checks of generated texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shortlist.functions.text import count_words, first_items, matched_phrases, plain_punctuation

#: Defaults of our own; callers pass their lists.
BANNED = ["synergy", "passionate", "leverage", "dynamic", "guru", "ninja"]
SELF_TALK = ["as an ai", "here is the letter", "i cannot", "certainly!"]
INVENTED = ["invented", "pioneered", "created from scratch"]
REQUIRED = ["title", "summary", "skills", "experience", "education"]  # fixed values: the keys of a resume


def banned_terms(text: Column, terms: list[str] = BANNED, report: int = 5) -> Column:
    return F.slice(matched_phrases(F.lower(text), terms), 1, report)


def _verdict(errors: list[Column], warnings: list[Column]) -> Column:
    tidy = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    return F.struct((F.size(tidy(errors)) == 0).alias("passed"), tidy(errors).alias("errors"), tidy(warnings).alias("warnings"))


def _dashes(text: Column) -> Column:
    return F.when(text.contains("—") | text.contains("–"), "long dash")


def _banned(text: Column, terms: list[str]) -> Column:
    hits = banned_terms(text, terms)
    return F.when(F.size(hits) > 0, F.concat(F.lit("banned: "), first_items(hits, 5)))


def validate_letter(text: Column, mode: str = "normal", terms: list[str] = BANNED, self_talk: list[str] = SELF_TALK, salutation: str = "dear", claims: list[str] | None = None) -> Column:
    """struct<passed, errors, warnings>; ``mode`` is strict, normal or lenient; ``claims`` are patterns of false ownership."""
    text = F.coalesce(text, F.lit(""))
    low, words = F.lower(text), count_words(text)
    errors, warnings = [_dashes(text)], []
    if mode != "lenient":
        (errors if mode == "strict" else warnings).append(_banned(text, terms))
    if mode == "strict":
        errors.append(F.when(words > 250, F.concat(F.lit("too long: "), words.cast("string"))))
    elif mode == "normal":
        warnings.append(F.when(words > 275, F.concat(F.lit("long: "), words.cast("string"))))
    errors.append(F.coalesce(*[F.when(low.contains(p), F.lit(f"self-talk: {p}")) for p in self_talk]))
    errors.append(F.when(~F.trim(low).startswith(salutation), "no salutation"))
    if claims:
        errors.append(F.coalesce(*[F.when(low.rlike(p), "false claim") for p in claims]))
    return _verdict(errors, warnings)


def validate_resume_text(text: Column, mode: str = "normal", terms: list[str] = BANNED) -> Column:
    text = F.coalesce(text, F.lit(""))
    found = _banned(text, terms)
    return _verdict([_dashes(text), found] if mode == "strict" else [_dashes(text)], [] if mode == "strict" else [found])


def validate_resume_json(data: Column, mode: str = "normal", terms: list[str] = BANNED, watch: list[str] = INVENTED) -> Column:
    """Checks of a resume as JSON text: required keys, invented claims, banned words in the values."""
    keys = F.coalesce(F.json_object_keys(data), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), keys)
    values = F.lower(F.array_join(F.map_values(F.from_json(data, "map<string,string>")), " "))
    invented = F.filter(F.array(*map(F.lit, watch)), lambda w: values.contains(w))
    errors = [F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))), F.when(F.size(invented) > 0, F.concat(F.lit("invented: "), first_items(invented, 3)))]
    found = _banned(values, terms)
    return _verdict([*errors, found] if mode == "strict" else errors, [] if mode == "strict" else [found])


RESUME = "struct<title:string,summary:string,skills:map<string,string>,experience:array<struct<header:string,subtitle:string,bullets:array<string>>>,projects:array<struct<header:string,subtitle:string,bullets:array<string>>>,education:string>"


def assemble_document(data: Column, name: Column, contact: list[Column]) -> Column:
    """A resume's JSON as plain text; the head comes from the profile."""
    d = F.from_json(data, RESUME)
    empty = F.array().cast("array<string>")
    entry = lambda e: F.concat(F.array(plain_punctuation(e["header"])), F.when(F.coalesce(e["subtitle"], F.lit("")) != "", F.array(plain_punctuation(e["subtitle"]))).otherwise(empty), F.transform(F.coalesce(e["bullets"], empty), lambda b: F.concat(F.lit("- "), plain_punctuation(b))), F.array(F.lit("")))
    section = lambda c: F.coalesce(F.flatten(F.transform(c, entry)), empty)
    skills = F.coalesce(F.transform(F.map_entries(d["skills"]), lambda e: F.concat(e["key"], F.lit(": "), plain_punctuation(e["value"]))), empty)
    line = F.nullif(F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in contact]), F.lit(""))
    head = F.array(F.coalesce(name, F.lit("")), plain_punctuation(F.coalesce(d["title"], F.lit(""))))
    parts = [head, F.when(line.isNotNull(), F.array(line)).otherwise(empty), F.array(F.lit(""), F.lit("SUMMARY"), plain_punctuation(d["summary"]), F.lit(""), F.lit("TECHNICAL SKILLS")), skills, F.array(F.lit(""), F.lit("EXPERIENCE")), section(d["experience"]), F.array(F.lit("PROJECTS")), section(d["projects"]), F.array(F.lit("EDUCATION"), plain_punctuation(d["education"]))]
    return F.array_join(F.concat(*parts), "\n")
