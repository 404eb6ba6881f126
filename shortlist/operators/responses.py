"""Model requests and responses as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.functions.text import first_non_empty


def listed(items: Column, empty: str = "not specified") -> Column:
    return F.coalesce(F.nullif(F.array_join(items, ", "), F.lit("")), F.lit(empty))


def score_requests(postings: DataFrame, profiles: DataFrame, key: str, cut: int = 6000) -> DataFrame:
    """One request per undecided posting and profile (Spark broadcasts the profiles if they are few)."""
    posting = F.concat_ws("\n", F.concat(F.lit("TITLE: "), F.coalesce("title", F.lit("N/A"))), F.concat(F.lit("COMPANY: "), F.coalesce("company", "site", F.lit("N/A"))), F.concat(F.lit("LOCATION: "), F.coalesce("location", F.lit("N/A"))), F.concat(F.lit("DESCRIPTION: "), F.substring(F.coalesce("full_description", F.lit("")), 1, cut)))
    summary = F.concat(F.lit("Target role: "), first_non_empty_or("target_role"), F.lit("\nSkills: "), listed(F.col("skills")))
    small = profiles.select("profile", summary.alias("candidate"))
    return postings.select(key, posting.alias("posting")).crossJoin(small).select("profile", key, F.concat("candidate", F.lit("\n\n"), "posting").alias("request"))


def first_non_empty_or(*names: str, empty: str = "not specified") -> Column:
    return F.coalesce(first_non_empty(*[F.col(n) for n in names]), F.lit(empty))


def template_requests(rows: DataFrame, template: str, columns: dict[str, Column], key: str) -> DataFrame:
    """Requests from a user's template with ``{name}`` holes (tailoring, letters, judging)."""
    text = F.lit(template)
    for name, value in columns.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return rows.select(key, text.alias("request"))


def cover_requests(rows: DataFrame, instructions: str, resume: str, key: str, notes: Column | None = None, cut: int = 6000) -> DataFrame:
    """Letter requests: instructions (with the last five notes of failed attempts), resume and posting."""
    listed_notes = F.array_join(F.transform(F.slice(notes, F.greatest(F.lit(1), F.size(notes) - 4), 5), lambda n: F.concat(F.lit("- "), n)), "\n") if notes is not None else F.lit("")
    head = F.when(F.coalesce(listed_notes, F.lit("")) != "", F.concat(F.lit(instructions + "\nAVOID:\n"), listed_notes)).otherwise(instructions)
    posting = F.concat_ws("\n", F.concat(F.lit("TITLE: "), F.coalesce("title", F.lit("N/A"))), F.concat(F.lit("COMPANY: "), F.coalesce("site", F.lit("N/A"))), F.concat(F.lit("LOCATION: "), F.coalesce("location", F.lit("N/A"))), F.concat(F.lit("DESCRIPTION: "), F.substring(F.coalesce("full_description", F.lit("")), 1, cut)))
    return rows.select(key, F.concat_ws("\n\n", head, F.lit("RESUME:\n" + resume), posting).alias("request"))


def judge_requests(original: DataFrame, tailored: DataFrame, key: str, skills: list[str], metrics: list[str]) -> DataFrame:
    text = F.concat_ws("\n", F.lit("ALLOWED SKILLS: " + (", ".join(skills) or "N/A")), F.lit("METRICS: " + (", ".join(metrics) or "N/A")), F.lit("ORIGINAL:"), F.col("original"), F.lit("TAILORED:"), F.col("tailored"))
    return original.join(tailored, key).select(key, text.alias("request"))


def parse_marker_lines(text: Column, markers: list[str]) -> Column:
    """map<string,string>: the field of each marker that occurs, and ``remainder``.

    A trimmed line that starts with ``NAME:`` opens (or reopens) a field; further
    lines that are not blank belong to it. Other lines are the remainder.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<struct<k:string,v:string>>").alias("out"))

    def step(acc, line):
        marker = F.coalesce(*[F.when(line.startswith(f"{m}:"), F.lit(m)) for m in markers], F.lit(""))
        body = F.trim(line.substr(F.length(marker) + 2, F.length(line)))
        here = F.when(marker != "", marker).otherwise(acc["open"])
        value = F.when(marker != "", body).otherwise(line)
        stays = F.when((line == "") | ((marker == "") & (acc["open"] == "")), F.struct(F.lit("remainder").alias("k"), line.alias("v"))).otherwise(F.struct(here.alias("k"), value.alias("v")))
        return F.struct(here.alias("open"), F.concat(acc["out"], F.array(stays)).alias("out"))

    pairs = F.aggregate(lines, start, step)["out"]
    field = lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: (p["k"] == k) & (p["v"] != "")), lambda p: p["v"]), "\n")
    return F.create_map(*[x for k in [*markers, "remainder"] for x in (F.lit(k), field(k))])


def parse_score(text: Column) -> Column:
    """struct<score, fit, gap, keywords, error>; the score is the first digit run of SCORE from 1 to 10."""
    fields = parse_marker_lines(text, ["SCORE", "FIT", "GAP", "KEYWORDS"])
    digits = F.regexp_extract(fields["SCORE"], r"\d+", 0)
    score = F.when(digits != "", F.least(F.lit(10), F.greatest(F.lit(1), digits.try_cast("int"))))
    error = F.when(score.isNull(), F.concat(F.lit("no score in: "), F.substring(F.coalesce(text, F.lit("")), 1, 200)))
    return F.struct(score.alias("score"), fields["FIT"].alias("fit"), fields["GAP"].alias("gap"), fields["KEYWORDS"].alias("keywords"), error.alias("error"))


_TOKEN = r"(?s)\\.|[\"{}\[\]]|[^\"{}\[\]\\]+|\\"


def _balanced(text: Column) -> Column:
    """struct<n, tokens>: the tokens of a text, and how many of them make up its first bracketed value (0: it never closes)."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    state = lambda depth, inside, n, end: F.struct(depth.alias("depth"), inside.alias("inside"), n.alias("n"), end.alias("end"))

    def step(s: Column, token: Column) -> Column:
        n, out = s["n"] + 1, ~s["inside"]
        depth = s["depth"] + F.when(out & token.isin("{", "["), 1).when(out & token.isin("}", "]"), -1).otherwise(0)
        closes = (s["end"] == 0) & out & token.isin("}", "]") & (depth == 0)
        return state(depth, F.when(token == '"', out).otherwise(s["inside"]), n, F.when(closes, n).otherwise(s["end"]))

    end = F.aggregate(tokens, state(F.lit(0), F.lit(False), F.lit(0), F.lit(0)), step)["end"]
    return F.struct(end.alias("n"), tokens.alias("tokens"))


def _if_valid(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def _whole(text: Column) -> Column:
    """The text if it is one JSON value and nothing else. The parser alone would let more text follow it."""
    found = _balanced(text)
    bracketed = text.rlike(r"^[{\[]") & (found["n"] == F.size(found["tokens"]))
    plain = text.rlike(r"^(-?[0-9][0-9.eE+-]*|true|false|null)$")
    quotes = F.filter(found["tokens"], lambda t: t == '"')
    quoted = text.rlike(r'^"') & (F.size(quotes) == 2) & (F.element_at(found["tokens"], -1) == '"')
    return F.when(bracketed | plain | quoted, _if_valid(text))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def json_of(text: Column) -> Column:
    """The JSON in a response, as it stands there: the whole text, else a fenced block, else what the first brace opens.

    Strict: no NaN, no comments, no key twice in one object.
    """
    text = _trimmed(F.coalesce(text, F.lit("")))
    parts = F.split(text, "```")
    fenced = F.filter(F.transform(parts, lambda x, i: F.when(i % 2 == 1, _whole(_trimmed(F.regexp_replace(_trimmed(x), "^(?i)json", ""))))), lambda x: x.isNotNull())
    opened = _balanced(F.substr(text, F.instr(text, "{")))
    braced = F.when(F.contains(text, F.lit("{")) & (opened["n"] > 0), _if_valid(F.array_join(F.slice(opened["tokens"], 1, opened["n"]), "")))
    return F.coalesce(_whole(text), F.get(fenced, F.lit(0)), braced)


def extract_json(df: DataFrame, column: str) -> DataFrame:
    """Add ``json`` (text or null) and ``json_error``."""
    return df.withColumn("json", json_of(F.col(column))).withColumn("json_error", F.when(F.col("json").isNull(), "no JSON in response"))


def strip_preamble(text: Column, marker: str) -> Column:
    """The text from the first occurrence of the marker (in any case) on."""
    at = F.locate(marker.lower(), F.lower(text))
    return F.trim(F.when(at > 0, text.substr(at, F.length(text))).otherwise(text))


def reasoning_text(method: Column, fit: Column, gap: Column, keywords: Column) -> Column:
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", line("METHOD", method), line("FIT", fit), line("GAP", gap), line("KEYWORDS", keywords))


def merge_scores(postings: DataFrame, results: DataFrame, key: str, at: Column, run_id: Column) -> DataFrame:
    """Write results (key, score, fit, gap, keywords, error, method) back; a failure sets its error and the time alone."""
    r = results.select(F.col(key).alias("r_key"), *[F.col(c).alias(f"r_{c}") for c in ("score", "fit", "gap", "keywords", "error", "method")])
    joined = postings.join(r, F.col(key) == F.col("r_key"), "left")
    hit, good = F.col("r_key").isNotNull(), F.col("r_score").isNotNull()
    old = lambda c: F.col(c) if c in postings.columns else F.lit(None).cast("string")
    made = {
        "fit_score": F.when(good, F.col("r_score")).otherwise(old("fit_score").cast("int")),
        "score_reasoning": F.when(good, reasoning_text(F.col("r_method"), F.col("r_fit"), F.col("r_gap"), F.col("r_keywords"))).otherwise(old("score_reasoning")),
        "fit_summary": F.when(good, F.coalesce("r_fit", F.lit(""))).otherwise(old("fit_summary")),
        "gap_summary": F.when(good, F.coalesce("r_gap", F.lit(""))).otherwise(old("gap_summary")),
        "keywords": F.when(good, F.coalesce("r_keywords", F.lit(""))).otherwise(old("keywords")),
        "score_error": F.when(hit & ~good, F.coalesce("r_error", F.lit("unknown error"))).otherwise(old("score_error")),
        "scored_at": F.when(hit, at).otherwise(F.col("scored_at")),
        "score_run_id": F.when(hit, run_id).otherwise(old("score_run_id").cast("long")),
    }
    return joined.withColumns(made).drop(*[c for c in joined.columns if c.startswith("r_")])


def parse_reasoning(reasoning: Column, fit: Column, gap: Column, keywords: Column) -> Column:
    """struct<fit, gap, keywords>: the columns, or else the first line of each name in the reasoning."""
    line = lambda name: F.trim(F.regexp_extract(F.coalesce(reasoning, F.lit("")), rf"(?m)^\s*{name}:(.*)$", 1))
    pick = lambda c, name: F.coalesce(F.nullif(F.trim(c), F.lit("")), line(name))
    return F.struct(pick(fit, "FIT").alias("fit"), pick(gap, "GAP").alias("gap"), pick(keywords, "KEYWORDS").alias("keywords"))


def parse_verdict(text: Column) -> Column:
    """struct<passed, issues>."""
    up = F.upper(F.coalesce(text, F.lit("")))
    at = F.locate("ISSUES:", up)
    return F.struct(up.contains("VERDICT: PASS").alias("passed"), F.when(at > 0, F.trim(text.substr(at + 7, F.length(text)))).otherwise("none").alias("issues"))


def resolve_attempts(attempts: DataFrame, key: str, max_retries: int, lenient: bool = False) -> DataFrame:
    """(key, attempt, json_ok, valid, judged_ok) -> (key, outcome, attempts_used); attempts count from 1."""
    last = max_retries + 1
    sound = F.col("json_ok") & F.col("valid")
    done = sound & (F.lit(lenient) | F.col("judged_ok") | (F.col("attempt") == last))
    ending = F.when(done, F.when(F.lit(lenient) | F.col("judged_ok"), "approved").otherwise("approved_with_judge_warning"))
    ending = F.coalesce(ending, F.when((F.col("attempt") == last) & F.col("json_ok") & ~F.col("valid"), "failed_validation"))
    known = attempts.where(F.col("attempt") <= last).withColumn("ending", ending)
    first = F.min_by("ending", F.when(F.col("ending").isNotNull(), F.col("attempt")))
    stop = F.min(F.when(F.col("ending").isNotNull(), F.col("attempt")))
    return known.groupBy(key).agg(F.coalesce(first, F.lit("exhausted_retries")).alias("outcome"), F.coalesce(stop, F.max("attempt")).alias("attempts_used"))


def resolve_letters(attempts: DataFrame, key: str, max_retries: int) -> DataFrame:
    """(key, attempt, valid, letter) -> (key, letter, passed, attempts_used): the first valid letter, else the last one tried."""
    known = attempts.where(F.col("attempt") <= max_retries + 1)
    good = F.when(F.coalesce("valid", F.lit(False)), F.col("attempt"))
    first = F.min(good)
    return known.groupBy(key).agg(F.coalesce(F.min_by("letter", good), F.max_by("letter", "attempt")).alias("letter"), first.isNotNull().alias("passed"), F.coalesce(first, F.max("attempt")).alias("attempts_used"))


def record_attempts(postings: DataFrame, outcomes: DataFrame, key: str, at: Column) -> DataFrame:
    """(key, path or null): success sets path and time; the count of attempts grows either way."""
    o = outcomes.select(F.col(key).alias("o_key"), F.col("path").alias("o_path"))
    joined = postings.join(o, F.col(key) == F.col("o_key"), "left")
    hit, good = F.col("o_key").isNotNull(), F.col("o_path").isNotNull()
    return joined.withColumns({"tailored_resume_path": F.when(good, F.col("o_path")).otherwise(F.col("tailored_resume_path")), "tailored_at": F.when(good, at), "tailor_attempts": F.when(hit, F.coalesce("tailor_attempts", F.lit(0)) + 1).otherwise(F.col("tailor_attempts"))}).drop("o_key", "o_path")


def artifact_name(site: Column, title: Column) -> Column:
    """A file name: word characters, blanks and hyphens; 20 and 50 characters; blanks as underscores."""
    tidy = lambda c, n: F.regexp_replace(F.trim(F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\w\s-]", ""), 1, n)), " ", "_")
    return F.concat(tidy(site, 20), F.lit("_"), tidy(title, 50))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add cost and request_count; ``prices`` (model, price_in, price_out, per_request) is a small table keyed by lower-case names."""
    p = prices.select(F.col("model").alias("p_model"), "price_in", "price_out", "per_request")
    joined = usage.join(p, F.lower(F.trim("model")) == F.col("p_model"), "left")
    cost = F.col("prompt_tokens") / 1e6 * F.col("price_in") + F.col("completion_tokens") / 1e6 * F.col("price_out")
    return joined.withColumns({"cost": cost, "request_count": F.when(F.coalesce("per_request", F.lit(False)), 1)}).drop("p_model", "price_in", "price_out", "per_request")


def record_usage(calls: DataFrame, run_id: Column) -> DataFrame:
    """Nested responses (model, usage as JSON text, elapsed_ms, error) -> ledger rows."""
    u = F.from_json("usage", "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>")
    total = F.coalesce(u["total_tokens"], u["prompt_tokens"] + u["completion_tokens"])
    return calls.select(run_id.alias("run_id"), "stage", "model", u["prompt_tokens"].alias("prompt_tokens"), u["completion_tokens"].alias("completion_tokens"), total.alias("total_tokens"), "elapsed_ms", F.col("error").isNull().alias("success"), "created_at")
