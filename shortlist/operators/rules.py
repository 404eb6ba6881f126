"""Rule scoring: an ordered cascade of preference rules, caps and location boosts, as Columns.

A preference set compiles to one expression for each field of the result, so a
scan scores rows without a join or a Python worker. ``score_many`` scores against
a table of preference sets instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.functions.phrases import with_phrases
from shortlist.functions.text import ascii_lower, collapse, contains_phrase, first_items, first_phrase, matched_phrases


@dataclass(frozen=True)
class Cap:
    patterns: list[str]
    max_score: int | None = None
    name: str | None = None


@dataclass(frozen=True)
class Boost:
    patterns: list[str]
    points: int = 1
    min_base: int = 8
    max_score: int = 10
    name: str | None = None


@dataclass(frozen=True)
class Preferences:
    target_roles: list[str] = field(default_factory=list)
    adjacent_roles: list[str] = field(default_factory=list)
    reject_roles: list[str] = field(default_factory=list)
    dealbreakers: list[str] = field(default_factory=list)
    positive_signals: list[str] = field(default_factory=list)
    negative_signals: list[str] = field(default_factory=list)
    hard_caps: list[Cap] = field(default_factory=list)
    location_boosts: list[Boost] = field(default_factory=list)

    def is_empty(self) -> bool:
        return self == Preferences()

    def cleaned(self) -> Preferences:
        """Phrases trimmed, blank ones dropped."""
        tidy = lambda items: [p.strip() for p in ([items] if isinstance(items, str) else items) if p and p.strip()]
        plain = {k: tidy(v) for k, v in vars(self).items() if k not in ("hard_caps", "location_boosts")}
        return Preferences(**plain, hard_caps=[replace(c, patterns=tidy(c.patterns)) for c in self.hard_caps], location_boosts=[replace(b, patterns=tidy(b.patterns)) for b in self.location_boosts])


def posting_text() -> Column:
    """Title, company, location and both descriptions as one line."""
    parts = ["title", "company", "location", "description", "full_description"]
    return collapse(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in parts]))


def _result(score, fit, gap, keywords, rule) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(score).cast("int").alias("score"), as_col(fit).alias("fit"), as_col(gap).alias("gap"), as_col(keywords).alias("keywords"), as_col(rule).alias("rule"))


def _found(p: Preferences, title: Column, text: Column, title_low: Column | None = None, text_low: Column | None = None) -> dict[str, Column]:
    """What the rules of cleaned preferences look for in a posting."""
    caps = {f"cap{i}": matched_phrases(text, c.patterns, text_low) for i, c in enumerate(p.hard_caps) if _most(c) <= 4}
    titles = {"rejected": p.reject_roles, "target": p.target_roles, "adjacent": p.adjacent_roles}
    texts = {"breakers": p.dealbreakers, "good": p.positive_signals, "bad": p.negative_signals}
    return caps | {k: first_phrase(title, v, title_low) for k, v in titles.items()} | {k: matched_phrases(text, v, text_low) for k, v in texts.items()}


def _most(cap: Cap) -> int:
    return 10 if cap.max_score is None else cap.max_score


def score_by_rules(prefs: Preferences, title: Column | None = None, text: Column | None = None, found: dict[str, Column] | None = None) -> Column:
    """struct<score, fit, gap, keywords, rule>, or null where no rule decides; ``title``, ``text`` and ``found`` may stand for what is made of the columns."""
    p = prefs.cleaned()
    if p.is_empty():
        return F.lit(None).cast("struct<score:int,fit:string,gap:string,keywords:string,rule:string>")
    title, text = title if title is not None else collapse(F.col("title")), text if text is not None else posting_text()
    found = found or _found(p, title, text)
    company = F.coalesce(F.nullif(collapse(F.col("company")), F.lit("")), F.lit("unknown company"))
    rejected, breakers = found["rejected"], found["breakers"]
    rules = [
        F.when(rejected.isNotNull(), _result(2, "", F.concat(F.lit("title is a rejected role: "), rejected), "", "reject_role")),
        F.when(F.size(breakers) > 0, _result(2, "", F.concat(F.lit("dealbreaker: "), first_items(breakers, 5)), first_items(breakers, 5), "dealbreaker")),
    ]
    for i, cap in enumerate(p.hard_caps):
        most = _most(cap)
        if most <= 4:
            hits = found[f"cap{i}"]
            name = F.lit(cap.name) if cap.name else first_items(hits, 5)
            rules.append(F.when(F.size(hits) > 0, _result(max(1, min(10, most)), "", F.concat(F.lit("hard cap: "), name), first_items(hits, 5), f"hard_cap:{cap.name or 'configured'}")))
    target, adjacent, good, bad = (found[k] for k in ("target", "adjacent", "good", "bad"))
    enough = (F.size(good) >= 2) if p.positive_signals else F.lit(True)
    with_role = lambda role: first_items(F.concat(good, F.array(role)), 8)
    rules.append(
        F.when(target.isNotNull() & enough, _result(F.when((F.size(good) >= 3) & (F.size(bad) == 0), 9).otherwise(8), F.concat(title, F.lit(" at "), company, F.lit(" is a target role: "), target), "", with_role(target), "target_role_match"))
    )
    rules.append(
        F.when(adjacent.isNotNull() & (F.size(good) >= 2) & (F.size(bad) == 0), _result(7, F.concat(title, F.lit(" at "), company, F.lit(" is an adjacent role: "), adjacent), "", with_role(adjacent), "adjacent_role_match"))
    )
    return F.coalesce(*rules)


def with_rule_result(df: DataFrame, prefs: Preferences, name: str = "rule_result") -> DataFrame:
    """``df`` with ``score_by_rules`` as a column; title, text and what is found in them are made once, signals only where a role fits."""
    p = prefs.cleaned()
    col = lambda k: F.col(f"__rule_{k}")
    made = df.withColumns({"__rule_title": collapse(F.col("title")), "__rule_text": posting_text()})
    made = made.withColumns({f"__rule_{k}_low": ascii_lower(col(k)) for k in ("title", "text")})
    found = _found(p, col("title"), col("text"), col("title_low"), col("text_low"))
    made = made.withColumns({f"__rule_{k}": v for k, v in found.items() if k not in ("good", "bad")})
    made = made.withColumns({f"__rule_{k}": F.when(col("target").isNotNull() | col("adjacent").isNotNull(), found[k]) for k in ("good", "bad")})
    made = made.withColumn(name, score_by_rules(prefs, col("title"), col("text"), {k: col(k) for k in found}))
    return made.drop(*[f"__rule_{k}" for k in ("title", "text", "title_low", "text_low", *found)])


def apply_hard_caps(result: Column, prefs: Preferences) -> Column:
    """The first cap that matches and lowers the score takes effect, with a note in ``gap``."""
    text, out = posting_text(), []
    for cap in prefs.cleaned().hard_caps:
        if cap.max_score is None:
            continue
        hits = matched_phrases(text, cap.patterns)
        name = F.lit(cap.name) if cap.name else first_items(hits, 2)
        # fixed value: the note of a cap
        note = F.concat(F.lit(" [hard capped by preference '"), name, F.lit("']"))
        lower = (F.size(hits) > 0) & (result["score"] > cap.max_score)
        capped = _result(max(1, min(10, cap.max_score)), result["fit"], F.trim(F.concat(F.coalesce(result["gap"], F.lit("")), note)), result["keywords"], result["rule"])
        out.append(F.when(lower, capped))
    return F.coalesce(*out, result) if out else result


def apply_location_boosts(result: Column, prefs: Preferences) -> Column:
    """Boosts in order; each sees the score that earlier ones left."""
    place = collapse(F.col("location"))
    for boost in prefs.cleaned().location_boosts:
        hits = matched_phrases(place, boost.patterns)
        score = F.greatest(F.lit(1), F.least(F.lit(10), F.lit(boost.max_score), result["score"] + boost.points))
        label = F.lit(boost.name) if boost.name else first_items(hits, 2)
        raised = _result(
            score,
            # fixed value: the note of a boost
            F.trim(F.concat(F.coalesce(result["fit"], F.lit("")), F.lit("\n- location boost: "), label)),
            result["gap"],
            F.btrim(F.concat(F.coalesce(result["keywords"], F.lit("")), F.lit(", "), first_items(hits, 3)), F.lit(" ,")),
            result["rule"],
        )
        applies = (F.size(hits) > 0) & (result["score"] >= boost.min_base) & (score > result["score"])
        result = F.when(applies, raised).otherwise(result)
    return result


def apply_adjustments(result: Column, prefs: Preferences) -> Column:
    return apply_location_boosts(apply_hard_caps(result, prefs), prefs)


def adjusted(df: DataFrame, result: str, prefs: Preferences) -> DataFrame:
    """``apply_adjustments`` step by step, so that the plan stays small with many boosts."""
    df = df.withColumn(result, apply_hard_caps(F.col(result), prefs))
    for boost in prefs.location_boosts:
        df = df.withColumn(result, apply_location_boosts(F.col(result), Preferences(location_boosts=[boost])))
    return df


def route(df: DataFrame, prefs: Preferences) -> tuple[DataFrame, DataFrame]:
    """(rows that a rule decides, with their result; rows that need a model)."""
    scored = with_rule_result(df, prefs)  # what needs both at once reads the column, and not the two frames: each scores anew
    return scored.where(F.col("rule_result").isNotNull()), scored.where(F.col("rule_result").isNull()).drop("rule_result")


def phrase_table(spark: SparkSession, prefs: dict[str, Preferences]) -> DataFrame:
    """Preference sets as rows (profile, kind, ord, phrase, max_score, name) for ``score_many``."""
    rows = []
    for profile, given in prefs.items():
        p = given.cleaned()
        lists = {"reject": p.reject_roles, "dealbreaker": p.dealbreakers, "target": p.target_roles, "adjacent": p.adjacent_roles, "positive": p.positive_signals, "negative": p.negative_signals}
        rows += [(profile, kind, i, phrase, None, None) for kind, phrases in lists.items() for i, phrase in enumerate(phrases)]
        rows += [(profile, "cap", i, phrase, 10 if c.max_score is None else c.max_score, c.name) for i, c in enumerate(p.hard_caps) for phrase in c.patterns]
    return spark.createDataFrame(rows, PHRASE_COLUMNS)


PHRASE_COLUMNS = "profile string, kind string, ord int, phrase string, max_score int, name string"


def match_phrases(postings: DataFrame, phrases: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((key, title[], text[]): the numbers of the phrases that each posting holds; (in_title, phrase, number)).

    Postings are scanned once: an automaton of all different phrases walks through title and
    text, whatever number of profiles a phrase serves.
    """
    text = postings.select(key, collapse(F.col("title")).alias("title"), posting_text().alias("text"))
    wanted = phrases.withColumn("in_title", F.col("kind").isin("target", "adjacent", "reject"))
    # a configuration: its different phrases meet on the driver
    different = wanted.select("in_title", "phrase").distinct().collect()
    lists = {"title": sorted(r["phrase"] for r in different if r["in_title"]), "text": sorted(r["phrase"] for r in different if not r["in_title"])}
    number = phrases.sparkSession.createDataFrame([(c == "title", p, i) for c in lists for i, p in enumerate(lists[c])], "in_title boolean, phrase string, number int")
    return with_phrases(text, key, lists), number


def score_matches(found: DataFrame, number: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """(profile, keys, score, rule) of what ``match_phrases`` found; ``keys`` name each of its rows."""
    wanted = phrases.withColumn("in_title", F.col("kind").isin("target", "adjacent", "reject")).join(number, ["in_title", "phrase"])
    marked = lambda c: F.transform(c, lambda i: F.struct(F.lit(c == "title").alias("in_title"), i.alias("number")))
    hits = found.select(*keys, F.explode(F.concat(marked("title"), marked("text"))).alias("hit")).select(*keys, "hit.*")
    table = wanted.select("profile", "kind", "ord", "number", "in_title", F.coalesce("max_score", F.lit(10)).alias("most"), F.coalesce("name", F.lit("configured")).alias("name"))
    hits = hits.join(table, ["in_title", "number"])
    kinds = ["reject", "dealbreaker", "target", "adjacent", "positive", "negative"]
    low_cap = F.when((F.col("kind") == "cap") & (F.col("most") <= 4), F.struct("ord", "most", "name"))
    counts = hits.groupBy("profile", *keys).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.min(low_cap).alias("cap"))
    signals = phrases.groupBy("profile").agg((F.count_if(F.col("kind") == "positive") == 0).alias("no_signals"))
    n = F.col
    enough = n("no_signals") | (n("positive") >= 2)
    ruled = (
        F.when(n("reject") > 0, F.struct(F.lit(2).alias("score"), F.lit("reject_role").alias("rule")))
        .when(n("dealbreaker") > 0, F.struct(F.lit(2).alias("score"), F.lit("dealbreaker").alias("rule")))
        .when(n("cap").isNotNull(), F.struct(F.greatest(F.lit(1), n("cap.most")).alias("score"), F.concat(F.lit("hard_cap:"), n("cap.name")).alias("rule")))
        .when((n("target") > 0) & enough, F.struct(F.when((n("positive") >= 3) & (n("negative") == 0), 9).otherwise(8).alias("score"), F.lit("target_role_match").alias("rule")))
        .when((n("adjacent") > 0) & (n("positive") >= 2) & (n("negative") == 0), F.struct(F.lit(7).alias("score"), F.lit("adjacent_role_match").alias("rule")))
    )
    return counts.join(signals, "profile").withColumn("ruled", ruled).select("profile", *keys, "ruled.score", "ruled.rule").where("score is not null")


def score_many(postings: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """(profile, key, score, rule) for every profile of ``phrases`` (``PHRASE_COLUMNS``), as ``score_by_rules`` gives them.

    A posting's matches are summed up by profile before anything is shuffled. ``key`` names each posting.
    """
    return score_matches(*match_phrases(postings, phrases, key), phrases, [key])


def count_many(postings: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """(profile, score, rule, postings): how many different keys have each result of ``score_many``.

    A key may stand on several rows, of different texts too: it counts for each result that one of its
    rows has; a null key counts for none. A result depends on the matches alone, so keys are counted by
    their matches, and each combination of these is scored once, however many postings share it.
    """
    found, number = match_phrases(postings, phrases, key)
    by_key = found.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("title", "text"))).alias("all"))
    alike = by_key.groupBy("all").agg(F.count(key).alias("n"))
    each = alike.select("all", "n", F.explode("all").alias("one")).select("all", "n", "one.*")
    scored = score_matches(each, number, phrases, ["all", "n", "title", "text"])
    # rows of one key with the same result count once
    return scored.select("all", "n", "profile", "score", "rule").distinct().groupBy("profile", "score", "rule").agg(F.sum("n").alias("postings"))


def derive_preferences(profiles: DataFrame, most: int = 12) -> DataFrame:
    """(profile, target_role, roles[], skills[]) -> (profile, roles[], signals[]), repeats dropped in any case."""

    def unique(items: Column) -> Column:
        known = F.transform(items, lambda x: F.lower(F.trim(x)))
        numbered = F.transform(items, lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("i")))
        kept = F.filter(numbered, lambda s: (s["x"] != "") & (F.array_position(known, F.lower(s["x"])) == s["i"] + 1))
        return F.transform(kept, lambda s: s["x"])

    roles = F.concat(F.array(F.coalesce("target_role", F.lit(""))), F.coalesce("roles", F.array().cast("array<string>")))
    return profiles.select("profile", unique(roles).alias("roles"), F.slice(unique(F.coalesce("skills", F.array().cast("array<string>"))), 1, most).alias("signals"))


__all__ = [
    "Boost", "Cap", "Preferences", "adjusted", "apply_adjustments", "apply_hard_caps", "apply_location_boosts",
    "PHRASE_COLUMNS", "contains_phrase", "count_many", "derive_preferences", "match_phrases", "phrase_table", "posting_text", "route", "score_by_rules", "score_many", "score_matches", "with_rule_result",
]
