"""Chat formatting by quotation linking (DataFrame functions only).

Lines that start with ``>`` are quotes; the number of ``>`` is their level. Runs of
lines of one level are passages. A passage is normalised (lower case, white space
collapsed) and its hash looked up among the hashes of whole messages, of their
paragraphs and of their runs of as many lines as the passage has, earlier in the
same conversation. A message replies to the last earlier message that its
outermost linked passage comes from. A message whose
reply skips back starts a branch; the messages after it belong to that branch.

``order_key`` sorts a conversation into reply order: a branch follows the message
it answers, and goes on before that message's own line goes on. Keys are text of
equal-width turns. Windows over the turns of a conversation that has branches sort its messages in one
task, which can spill; texts are not in a window that looks for quotes.

Null texts are empty; rows with a null conv_id or turn link with nothing and keep a
null order key; repeated rows each stay. Quotes without an original are removed
all the same and counted in n_quotes, not in n_linked. An empty table gives an
empty result. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, staged

QUOTE = r"^[ \t]*>[> \t]*"
LINE_END = r"\r?\n"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _turn(column: Column) -> Column:
    return F.lpad(column.cast("string"), 12, "0")


def _passages(lines: DataFrame) -> DataFrame:
    """(row_key, conv_id, turn, at, level, line) -> runs of one level, blank lines ending a run."""
    order = Window.partitionBy("row_key").orderBy("at")
    kind = F.when(~F.col("line").rlike(r"\S"), F.lit(-1)).otherwise(F.col("level"))
    marked = lines.withColumn("kind", kind).withColumn("new", F.coalesce((F.col("kind") != F.lag("kind").over(order)).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(order)).where("kind >= 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ")
    return runs.groupBy("row_key", "conv_id", "turn", "run", "level").agg(_normal(joined).alias("passage"), F.count(F.lit(1)).cast("int").alias("lines"))


def _lines(messages: DataFrame) -> DataFrame:
    prefix = F.regexp_extract("raw", QUOTE, 0)
    split = messages.select("row_key", "conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_END)).alias("at", "raw"))
    return split.select("row_key", "conv_id", "turn", "at", F.length(F.regexp_replace(prefix, "[^>]", "")).alias("level"), F.regexp_replace("raw", QUOTE, "").alias("line"))


def _sums(words: Column) -> list[Column]:
    """Of a list of words: how many, the sum of their hashes, and the sum of hashes times places."""
    whole = lambda x, digits=38: x.cast(f"decimal({digits},0)")
    hashes = F.transform(words, lambda x: whole(F.xxhash64(x), 20))
    added = lambda values: F.aggregate(values, whole(F.lit(0)), lambda total, x: whole(total + x))
    placed = F.transform(hashes, lambda x, i: whole(x * whole(i, 10)))
    return [whole(F.size(words), 10), added(hashes), added(placed)]


def _line_runs(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv_id, from_turn, hash, size): the wanted passages that consecutive lines of a message make, as many as the passage has.

    Running sums over the lines of a message give the sums of any run of them at once, so a run is
    compared by numbers, where it starts with the passage's first word; no run is joined as text.
    """
    lines = F.filter(F.transform(F.split("text", LINE_END), lambda x: F.when(~x.rlike(QUOTE), _normal(x))), lambda x: x != "")
    rows = messages.select("row_key", "conv_id", F.col("turn").alias("from_turn"), F.posexplode(lines).alias("at", "line"))
    n, s, w = _sums(F.split("line", " "))
    summed = rows.select("row_key", "conv_id", "from_turn", "at", F.xxhash64(F.substring_index("line", " ", 1)).alias("first"), n.alias("n"), s.alias("s"), w.alias("w"))
    so_far = Window.partitionBy("row_key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = summed.withColumn("n_to", F.sum("n").over(so_far)).withColumn("w", F.col("w") + (F.col("n_to") - F.col("n")) * F.col("s"))
    sums = staged(counted.withColumns({"s_to": F.sum("s").over(so_far), "w_to": F.sum("w").over(so_far)}), "line sums")
    before = [(F.col(f"{x}_to") - F.col(x)).alias(f"{x}_before") for x in ("n", "s", "w")]
    starts = sums.select("row_key", "conv_id", "from_turn", "first", "at", *before).join(wanted, ["conv_id", "first"])
    ends = sums.select("row_key", F.col("at").alias("end"), "n_to", "s_to", "w_to")
    runs = starts.withColumn("end", F.col("at") + F.col("lines") - 1).join(ends, ["row_key", "end"])
    same = (F.col("n_to") - F.col("n_before") == F.col("n")) & (F.col("s_to") - F.col("s_before") == F.col("s")) & (F.col("w_to") - F.col("w_before") - F.col("n_before") * F.col("s") == F.col("w"))
    return runs.where(same).select("conv_id", "from_turn", "hash", "size")


def _last_before(quoted: DataFrame, originals: DataFrame) -> DataFrame:
    """``quoted`` with from_turn: the last earlier turn with the same passage, without pairing all of its copies."""
    key = ["conv_id", "hash", "size"]
    every = quoted.unionByName(originals.select(*key, F.col("from_turn").alias("turn"), "from_turn"), allowMissingColumns=True)
    earlier = Window.partitionBy(*key).orderBy(F.col("turn").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    return every.withColumn("from_turn", F.max("from_turn").over(earlier)).where("row_key is not null")


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, content, n_quotes, n_linked, reply_to, order_key."""
    own = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    quotes_something = F.col("text").rlike(r"(?m)^[ \t]*>")
    quoting = staged(own.where(quotes_something).withColumn("row_key", F.monotonically_increasing_id()), "quoting")
    plain = own.where(~quotes_something)
    if quoting.isEmpty():
        linked = quoting.select("row_key", F.lit(0).alias("n_quotes"), F.lit(0).alias("n_linked"), F.lit(None).cast("long").alias("reply_to"))
    else:
        passages = _passages(_lines(quoting))
        quoted = passages.where("level > 0 and passage != ''")
        hash_of = [F.xxhash64("passage").alias("hash"), F.length("passage").alias("size")]
        n, s, w = _sums(F.split("passage", " "))
        hashed = staged(quoted.select("row_key", "conv_id", "turn", "level", "run", "lines", *hash_of, F.xxhash64(F.substring_index("passage", " ", 1)).alias("first"), n.alias("n"), s.alias("s"), w.alias("w")), "quoted")
        near = staged(own.join(hashed.select("conv_id").distinct(), "conv_id", "left_semi").withColumn("row_key", F.monotonically_increasing_id()), "near")
        body = F.array_join(F.filter(F.split("text", LINE_END), lambda x: ~x.rlike(QUOTE)), "\n")
        whole = near.select("conv_id", F.col("turn").alias("from_turn"), _normal(body).alias("passage"))
        parts = _passages(_lines(near)).where("level = 0").select("conv_id", F.col("turn").alias("from_turn"), "passage")
        whole_or_part = whole.unionByName(parts).where("passage != ''").select("conv_id", "from_turn", *hash_of)
        wanted = hashed.select("conv_id", "first", "lines", "n", "s", "w", "hash", "size").distinct()
        originals = whole_or_part.unionByName(_line_runs(near, wanted))
        found = _last_before(hashed, originals.join(hashed.select("conv_id", "hash", "size").distinct(), ["conv_id", "hash", "size"], "left_semi").distinct())
        per_run = found.groupBy("row_key", "run", "level").agg(F.max("from_turn").alias("from_turn"))
        rank = F.when(F.col("from_turn").isNotNull(), F.struct(-F.col("level"), F.col("from_turn")))
        linked = per_run.groupBy("row_key").agg(F.count(F.lit(1)).cast("int").alias("n_quotes"), F.count("from_turn").cast("int").alias("n_linked"), F.max(rank)["from_turn"].cast("long").alias("reply_to"))
    content = F.trim(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(QUOTE)), "\n"))
    answered = quoting.join(linked, "row_key", "left").select("conv_id", "turn", "role", content.alias("content"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to")
    silent = plain.select("conv_id", "turn", "role", F.trim("text").alias("content"), F.lit(0).alias("n_quotes"), F.lit(0).alias("n_linked"), F.lit(None).cast("long").alias("reply_to"))
    return _ordered(answered, silent)


def _ordered(answered: DataFrame, silent: DataFrame) -> DataFrame:
    starts = staged(answered.where("reply_to is not null and reply_to < turn - 1").groupBy("conv_id", F.col("turn").alias("branch")).agg(F.max("reply_to").alias("parent")), "branches")
    every = answered.unionByName(silent)
    alone = every.withColumn("order_key", _turn(F.col("turn")))
    if starts.isEmpty():
        return alone
    # each branch gets the branch of the message it answers: the latest start at or before it
    points = starts.select("conv_id", F.col("parent").alias("at"), F.lit(None).cast("long").alias("start"), "branch").unionByName(
        starts.select("conv_id", F.col("branch").alias("at"), F.col("branch").cast("long").alias("start"), F.lit(None).cast(starts.schema["branch"].dataType).alias("branch"))
    )
    so_far = Window.partitionBy("conv_id").orderBy("at", F.col("start").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = points.withColumn("above", F.last("start", ignorenulls=True).over(so_far)).where("branch is not null").select("conv_id", "branch", F.col("at").alias("parent"), "above")
    step = F.concat(_turn(F.col("parent")), F.lit("."), _turn(F.col("branch")), F.lit("."))
    done = staged(above.select("conv_id", "branch", "above", step.alias("path")), "paths")
    # each round doubles how far up a path reaches, so deep nesting takes few rounds, and each plan reads one table
    while not done.where("above is not null").isEmpty():
        up = done.select("conv_id", F.col("branch").cast("long").alias("above"), F.col("above").alias("further"), F.col("path").alias("upper"))
        longer = done.join(up, ["conv_id", "above"], "left").select("conv_id", "branch", F.col("further").alias("above"), F.concat(F.coalesce("upper", F.lit("")), "path").alias("path"))
        shorter, done = done, staged(longer, "paths")
        release(shorter)
    branched = done.select("conv_id").distinct()
    marks = done.select("conv_id", F.col("branch").alias("turn"), "path")
    inside = every.join(branched, "conv_id", "left_semi")
    # the path of the latest branch start at or before a message
    with_path = inside.select("*", F.lit(None).cast("string").alias("path")).unionByName(marks.select("conv_id", "turn", "path"), allowMissingColumns=True)
    latest = Window.partitionBy("conv_id").orderBy("turn", F.col("path").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = with_path.withColumn("at", F.last("path", ignorenulls=True).over(latest)).where("path is null").drop("path")
    keyed = placed.withColumn("order_key", F.concat(F.coalesce("at", F.lit("")), _turn(F.col("turn")))).drop("at")
    return alone.join(branched, "conv_id", "left_anti").select(*alone.columns).unionByName(keyed.select(*alone.columns))
