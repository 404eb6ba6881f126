"""From source payloads to posting rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.functions.text import first_non_empty
from shortlist.sources.staging import numbered

LONG_ENOUGH = 200  # characters from which a description counts as the full one

NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str):
    """Register a normaliser (DataFrame -> DataFrame) under a source's name."""

    def keep(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        NORMALISERS[name] = f
        return f

    return keep


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with different columns; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def normalise_all(frames: dict[str, DataFrame]) -> DataFrame:
    return union_sources([NORMALISERS[name](df) for name, df in frames.items()])


def flatten_ats_search(raw: DataFrame) -> DataFrame:
    """(employer, jobPostings[]) -> one row per posting."""
    one = raw.select("employer", F.explode_outer("jobPostings").alias("p")).where(F.col("p").isNotNull())
    return one.select("employer", F.col("p.title").alias("title"), F.col("p.locationsText").alias("location"), F.col("p.postedOn").alias("date_posted"), F.col("p.externalPath").alias("external_path"))


def join_ats_detail(found: DataFrame, detail: DataFrame) -> DataFrame:
    """Attach description and apply URL by employer and path; a missing detail is '' with an error."""
    d = detail.select("employer", "external_path", "job_description", "external_url", F.lit(True).alias("got"))
    joined = found.join(d, ["employer", "external_path"], "left")
    return joined.select(*found.columns, F.coalesce("job_description", F.lit("")).alias("job_description"), F.coalesce("external_url", F.lit("")).alias("external_url"), F.when(F.col("got").isNull(), "detail missing").alias("detail_error"))


@register("ats")
def normalise_ats(df: DataFrame) -> DataFrame:
    """Rows of an employer portal; without an apply URL they go."""
    text = F.coalesce("job_description", F.lit(""))
    full = F.length(text) > LONG_ENOUGH
    return df.where(F.coalesce("external_url", F.lit("")) != "").select(
        F.col("external_url").alias("url"), "title", F.col("employer").alias("company"), "location", F.substring(text, 1, 500).alias("description"),
        F.when(full, text).alias("full_description"), F.col("external_url").alias("application_url"), F.when(full, F.col("fetched_at")).alias("detail_scraped_at"),
    )


def flatten_board_docs(raw: DataFrame, base: str) -> DataFrame:
    """data.docs[] with nested company, city and salary -> flat rows; the URL needs both slugs."""
    one = raw.select(F.explode("data.docs").alias("d"))
    slugs = (F.coalesce("d.slug", F.lit("")) != "") & (F.coalesce("d.company.slug", F.lit("")) != "")
    url = F.when(slugs, F.concat(F.lit(f"{base}/"), F.col("d.slug"), F.lit("~"), F.col("d.company.slug"))).otherwise("")
    return one.select(F.col("d.role").alias("title"), F.col("d.company.name").alias("company"), F.col("d.city.name").alias("location"), F.col("d.salaryRange.start").alias("salary_start"), F.col("d.salaryRange.end").alias("salary_end"), F.col("d.salaryRange.currency").alias("currency"), url.alias("url"))


def coalesce_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """For each field the first non-empty of its alternative names, else ''; rows without a title go."""
    have = set(df.columns)
    made = {name: [F.col(c) for c in names if c in have] for name, names in aliases.items()}
    out = df.select(*[F.coalesce(first_non_empty(*cols) if cols else F.lit(None).cast("string"), F.lit("")).alias(name) for name, cols in made.items()])
    return out.where("title != ''")


def number(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c.cast("double")), c)


def format_salary(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """``USD90,000-USD120,000/yearly``; null without a minimum; amounts are cut to whole ones."""
    whole = lambda c: F.concat(F.coalesce(currency, F.lit("")), F.format_number(number(c).cast("bigint"), 0))
    given = lambda c: number(c).isNotNull() & (c != 0)
    tail = F.when(F.coalesce(interval, F.lit("")) != "", F.concat(F.lit("/"), interval)).otherwise("")
    return F.when(given(low), F.concat(whole(low), F.when(given(high), F.concat(F.lit("-"), whole(high))).otherwise(""), tail))


def format_salary_compact(low: Column, high: Column, currency: Column) -> Column:
    """Amounts shortened at thousands, millions and milliards (half even): ``lo-hi CUR``, ``lo+ CUR`` or ''."""

    def short(c: Column) -> Column:
        unit = lambda n: F.bround(c / n, 0).cast("bigint").cast("string")
        return F.when(c >= 1e9, F.concat(unit(1e9), F.lit("M"))).when(c >= 1e6, F.concat(unit(1e6), F.lit("jt"))).when(c >= 1e3, F.concat(unit(1e3), F.lit("K"))).otherwise(F.bround(c, 0).cast("bigint").cast("string"))

    given = lambda c: c.isNotNull() & (c > 0)
    unit = F.coalesce(currency, F.lit(""))
    both = F.concat(short(low), F.lit("-"), short(high), F.lit(" "), unit)
    return F.trim(F.when(given(low) & given(high), both).when(given(low), F.concat(short(low), F.lit("+ "), unit)).otherwise(""))


def remote_suffix(location: Column, is_remote: Column) -> Column:
    """Append `` (Remote)`` to a place, or say Remote without one."""
    place = F.coalesce(location, F.lit(""))
    yes = F.coalesce(is_remote, F.lit(False))
    return F.when(yes & (place != ""), F.concat(place, F.lit(" (Remote)"))).when(yes, "Remote").otherwise(location)


def promote_description(df: DataFrame, stamp: Column) -> DataFrame:
    """A long description becomes the full one and stamps the row as scraped."""
    full = F.length(F.coalesce("description", F.lit(""))) > LONG_ENOUGH
    return df.withColumns({"full_description": F.when(full, F.col("description")), "detail_scraped_at": F.when(full, stamp)})


@register("board")
def normalise_board_frame(df: DataFrame) -> DataFrame:
    """Rows of a board: NaN as null, rows without a URL go, the query label stands for a missing site."""
    text = {c: F.nullif(F.nullif(F.col(c), F.lit("nan")), F.lit("")) for c in ("title", "company", "location", "site", "application_url", "date_posted", "description")}
    return df.where(F.coalesce(F.nullif("url", F.lit("nan")), F.lit("")) != "").select(
        "url", text["title"].alias("title"), text["company"].alias("company"), remote_suffix(text["location"], F.col("is_remote")).alias("location"),
        F.coalesce(text["site"], F.col("query_label")).alias("site"), F.lit("board").alias("strategy"), format_salary(F.col("salary_min"), F.col("salary_max"), F.col("currency"), F.col("interval")).alias("salary"),
        text["application_url"].alias("application_url"), text["date_posted"].alias("date_posted"), text["description"].alias("description"),
    )


def search_matrix(queries: DataFrame, locations: DataFrame, tiers: list[int] | None = None, labels: list[str] | None = None) -> DataFrame:
    """Every query with every location (Spark broadcasts the smaller table if it is small); tier 0 by default, the label falls back to the place."""
    q = queries.withColumn("tier", F.coalesce("tier", F.lit(0)))
    place = locations.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "location"))
    q = q.where(F.col("tier").isin(tiers)) if tiers else q
    place = place.where(F.col("label").isin(labels)) if labels else place
    return q.crossJoin(place)


def map_search_location(matrix: DataFrame, countries: DataFrame, boards: DataFrame, default_country: str) -> DataFrame:
    """Each location's country and the name that boards know it by (else the text before the first comma)."""
    joined = matrix.join(countries, "location", "left").join(boards, "location", "left")
    return joined.select(*matrix.columns, F.coalesce("country", F.lit(default_country)).alias("country"), F.coalesce("board_location", F.substring_index("location", ",", 1)).alias("board_location"))


def shard(df: DataFrame, parts: int, part: int, order: list[str]) -> DataFrame:
    """The rows of one of ``parts`` shards, round robin in a stable order; rows are numbered range by range (``numbered``)."""
    if not 1 <= part <= parts:
        raise ValueError(f"part must be from 1 to {parts}")
    return numbered(df, order, "__place").where(F.col("__place") % parts == part - 1).drop("__place")


def shard_by_hash(df: DataFrame, parts: int, part: int, key: str) -> DataFrame:
    """As ``shard`` for large inputs: rows are dealt by a hash of the key, without an order."""
    if not 1 <= part <= parts:
        raise ValueError(f"part must be from 1 to {parts}")
    return df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part - 1)


def tier_cut(queries: DataFrame, most: int = 2) -> DataFrame:
    return queries.where(F.coalesce("tier", F.lit(99)) <= most)


def fill_company(df: DataFrame) -> DataFrame:
    """A missing company from ``at Xxx`` or ``Xxx is hiring`` in the description's start, or from the title's end."""
    head = F.substring(F.coalesce("description", F.lit("")), 1, 500)
    word = r"[A-Z][a-zA-Z]*[.&]?"
    name = rf"{word}(?:\s*{word}){{0,5}}"
    found = lambda c, p: F.trim(F.nullif(F.regexp_extract(c, p, 1), F.lit("")))
    stop = lambda c: F.rtrim(c, F.lit(".,"))
    # a last word behind a full stop starts the next sentence
    at = stop(F.trim(F.regexp_replace(stop(found(head, rf"\bat\s+({name})")), r"\.\s+[A-Z][a-zA-Z]+$", "")))
    at = F.when(F.length(at) > 2, at)
    leads = found(head, rf"^({name})\s+(?:is hiring|-\s)")
    ends = found(F.coalesce("title", F.lit("")), r"\bat\s+([A-Z][A-Za-z\s.&]{2,30})$")
    return df.withColumn("company", F.coalesce(F.nullif("company", F.lit("")), at, leads, ends))


def cap_results(df: DataFrame, by: list[str], n: int, order: list[str]) -> DataFrame:
    """At most n rows for each source and query, in order."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n).drop("rn")


def recent(df: DataFrame, column: str, hours: int, as_of: str) -> DataFrame:
    return df.where(F.col(column).cast("timestamp_ntz") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours)))
