"""Audit of how filters interact (DataFrame functions only).

Each row has a bit mask of the filters that it fails. For each part (a source, say)
all coalitions of filters are tabulated: how many rows, good rows and toxic rows
fail at least one filter of the coalition. A filter
applied after others then removes the difference of two coalitions, so every
order of the filters is read from that one table (32 numbers a measure for five
filters), and no row is visited once for each order.

What a filter removes over all orders is its Shapley value times the number of
orders. It comes from constrained least squares: the additive game that is nearest to the
coalitions' counts under the Shapley kernel, with its values adding up to the whole count. The
normal equations are the same for each part, so they are solved once in rationals, for each
unit count (``shapley_rows``); the solution times the number of orders is whole, and each
part's values are exact sums of its counts.

Texts are whole; null ones are empty. A row fails the copy filter when a row with a smaller
doc_id, of any part, has the same text: rows that share the least doc_id all pass, and a null
doc_id is larger than any other and no smaller than another null. Null parts and empty ones
are one part. A document that has several rows of labels is good, or toxic, if one of
them says so; labels without an id count for none. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, text_or_empty

FILTERS = "ABCDE"
MEASURES = ["rows", "good", "toxic"]


def failed_by_text(text: Column) -> Column:
    """The mask of the filters that judge a text alone: A few words, B repeated words, C capitals, D markup signs."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, rows, good, toxic): counts of the documents by part, text and place among its copies.

    Rows are cut to a digest before they move; one shuffle by doc_id brings the labels, one by
    (digest, part) sums copies up on the map side first, so that a group of copies leaves one row a part.
    """
    text = text_or_empty()
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64(text), F.lit(1 << 20))).otherwise(-1)  # null ids meet no label, so they may go anywhere
    rows = docs.select("doc_id", salt.alias("salt"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failed_by_text(text).cast("byte").alias("mask"))
    flag = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).cast("long")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).withColumn("salt", F.lit(-1).cast("long"))
    counts = [F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES[1:]]]
    keys = ["part", "digest", "mask"]
    by_id = rows.join(known, ["doc_id", "salt"], "left").groupBy("doc_id", "salt", *keys).agg(*counts)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", *MEASURES))
    by_text = by_id.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES], first.alias("first"))
    # a text has one row a part here
    least = F.min(F.struct("first.unknown", "first.doc_id")).over(Window.partitionBy("digest"))
    placed = by_text.withColumn("least", least)
    # of rows without an id none is smaller than another
    own = F.when(F.col("least.unknown"), F.struct(*MEASURES)).when(F.col("first.doc_id") == F.col("least.doc_id"), F.struct(*[F.col(f"first.{m}").alias(m) for m in MEASURES]))
    own = F.coalesce(own, F.struct(*[F.lit(0).cast("long").alias(m) for m in MEASURES]))
    copy = 1 << FILTERS.index("E")
    both = placed.withColumn("own", own).select(
        "part", F.explode(F.array(
            F.struct(F.col("mask").cast("int").alias("mask"), *[F.col("own")[m].alias(m) for m in MEASURES]),
            F.struct((F.col("mask") + copy).cast("int").alias("mask"), *[(F.col(m) - F.col("own")[m]).alias(m) for m in MEASURES]),
        )).alias("x"),
    )
    return both.select("part", "x.*")


def shapley_rows(n: int) -> list[list[int]]:
    """For each of ``n`` filters the weight of each coalition's count in its Shapley value times n!.

    Minimises sum of k(S) (v(S) - sum of x_i in S)^2 over the proper coalitions S, with the Shapley
    kernel k(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)), subject to sum of x_i = v(all), by its normal
    equations with one multiplier, in rationals.
    """
    every = 1 << n
    kernel = [Fraction(n - 1, math.comb(n, s) * s * (n - s)) if 0 < (s := S.bit_count()) < n else Fraction(0) for S in range(every)]
    has = lambda S, i: S >> i & 1
    table = []
    for i in range(n):
        left = [sum((kernel[S] for S in range(every) if has(S, i) and has(S, j)), Fraction(0)) for j in range(n)]
        table.append([*left, Fraction(1), *[kernel[S] if has(S, i) else Fraction(0) for S in range(every)]])
    table.append([*[Fraction(1)] * n, Fraction(0), *[Fraction(S == every - 1) for S in range(every)]])
    size = n + 1
    for c in range(size):
        pivot = next(r for r in range(c, size) if table[r][c])
        table[c], table[pivot] = table[pivot], table[c]
        table[c] = [x / table[c][c] for x in table[c]]
        for r in range(size):
            if r != c and table[r][c]:
                table[r] = [x - table[r][c] * y for x, y in zip(table[r], table[c], strict=True)]
    out = [[x * math.factorial(n) for x in row[size:]] for row in table[:n]]
    assert all(x.denominator == 1 for row in out for x in row)
    return [[int(x) for x in row] for row in out]


def coalitions(failed: DataFrame, n: int) -> DataFrame:
    """(part, total, rows, good, toxic): of each part the number of rows, and an array a measure: at S, what fails a filter of S."""
    few = failed.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])  # at most 2**n rows a part
    met = lambda m: ", ".join(f"sum(if((mask & {S}) != 0, {m}, 0))" for S in range(1 << n))
    return few.groupBy("part").agg(F.sum("rows").alias("total"), *[F.expr(f"array({met(m)})").alias(m) for m in MEASURES])


def audit(failed: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, mask, rows, good, toxic) -> one row for each part, order of the filters and step.

    ``names`` has a letter for each bit of the mask, from the lowest: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    n = len(names)
    every = (1 << n) - 1
    bit = {c: 1 << i for i, c in enumerate(names)}
    steps = [
        f"struct('{''.join(order)}' as filter_order, {k + 1} as step, {sum(bit[c] for c in order[:k])} as before, {bit[order[k]]} as own)"
        for order in itertools.permutations(names) for k in range(n)
    ]
    steps = coalitions(failed, n).select("*", F.inline(F.expr(f"array({', '.join(steps)})")))  # n! n rows a part
    at = lambda m, S: F.get(F.col(m), S)
    after = F.col("before") + F.col("own")
    gone = lambda m: at(m, after) - at(m, F.col("before"))
    total_of = lambda row: " + ".join(f"{w} * rows[{S}]" for S, w in enumerate(row) if w) or "0"
    value = F.expr("case own " + " ".join(f"when {1 << i} then {total_of(row)}" for i, row in enumerate(shapley_rows(n))) + " end")
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - at("rows", after)).alias("kept"),
        gone("rows").alias("removed"),
        (at("rows", F.col("own")) - gone("rows")).alias("redundant"),
        (at("rows", F.lit(every)) - at("rows", F.lit(every) - F.col("own"))).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        value.cast("long").alias("shapley"),
    )
