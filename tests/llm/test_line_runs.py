"""Runs of lines that a quote takes from a message, by running sums."""

from shortlist.llm import chat


def replies(spark, rows):
    return {(r.conv_id, r.turn): r.reply_to for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}


def test_long_log_quoted_at_many_lengths(spark):
    log = [f"line {i % 7} of {i // 7 % 11}" for i in range(20_000)]
    quoting = [(1, 2 + k, "b", "\n".join(f"> {x}" for x in log[100 * k : 100 * k + 3 + k]) + "\nyes") for k in range(40)]
    got = replies(spark, [(1, 1, "a", "\n".join(log)), *quoting])
    assert all(got[1, 2 + k] == 1 for k in range(40))


def test_equal_lines_order_and_breaks(spark):
    rows = [
        (1, 0, "a", "x y\nz w\nx y\nend"),
        (1, 1, "b", "> Z  w\n> x y\nok"),  # a run of two lines
        (1, 2, "b", "> x y\n> end\n> z w\nno"),  # the lines in another order
        (1, 3, "b", "> z\n> w x y\nok"),  # other breaks, as many lines
        (1, 4, "b", "> x y\n> x y\nno"),  # no such run
        (2, 1, "b", "> z w\n> x y\nanother talk"),
        (3, 0, "a", "\n".join(["ok"] * 5000)),
        (3, 1, "b", "\n".join(["> ok"] * 4999) + "\nI see"),
        (3, 2, "b", "\n".join(["> ok"] * 5001) + "\nI do not"),
        (4, 0, "a", None),
        (4, 1, "b", ">\n> \nempty"),
    ]
    got = replies(spark, rows)
    assert {k: v for k, v in got.items() if v is not None} == {(1, 1): 0, (1, 3): 0, (3, 1): 0}
