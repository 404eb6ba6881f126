"""The training-data operators against brute force, round trips, held-out accuracy and edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shortlist.llm import byte_bpe, chat, exact_dedup, fingerprints, jaccard_join, mixing, quality, queries, suffix_dedup, token_files, toxicity
from shortlist.llm.common import staged

#: Other columns whose names the operators use themselves.
EXTRA = ["digest", "row_key", "token", "rep", "n", "bucket", "place", "start", "kept", "label", "words", "score", "mix_row", "exact_row"]
EDGES = [(1, ""), (2, None), (3, "a"), (3, "a"), (4, "a  B\tc"), (5, "A b\nC"), (None, "a b c"), (None, None), (6, "word " * 9000), (7, " \n\t "), (8, "ünï ©𝄞 日本語"), (9, "x" * 3000)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en", None if k % 5 == 0 else f"s{k % 3}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("clash") for c in EXTRA}) if extra else df


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, EDGES).repartition(3)


@pytest.fixture(scope="module")
def empty(edges):
    return edges.where("false")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


# 1


def _toxic_corpus(n, seed):
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "ou", "ti", "en"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        own = [word() for _ in range(rng.randint(20, 60))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            own[rng.randrange(len(own))] = rng.choice(["zumpolk", "quaxib", "vrendig"]) + rng.choice(["", "en", "on"])
        rows.append((i, " ".join(own), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = _toxic_corpus(600, 1)
    docs = frame(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [(y, got[i].predicted) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([y == p for y, p in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for given in (labels, labels.where("toxic = 0"), labels.where("false")):
        model = toxicity.fit(edges, given)
        assert toxicity.score(edges, model).count() == len(EDGES)
        assert toxicity.score(empty, model).count() == 0
        assert toxicity.reject(edges, model).columns == edges.columns


# 2


def _repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffix_dedup_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(20)]
    texts = []
    for i in range(120):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, k = rng.randint(0, len(p)), rng.randint(0, len(t))
            t = t[:k] + p[a : a + rng.randint(0, 600)] + t[k:]
        texts.append("ab" * rng.randint(0, 500) if i % 37 == 0 else t + t if i % 41 == 0 else t)
    texts += [texts[5], texts[5], "", None, "x" * 2000]
    docs = frame(spark, list(enumerate(texts))).repartition(5)
    for length, spacing, block in ((400, 128, 64), (60, 8, 16)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in suffix_dedup.find_repeats(docs, length, spacing, block).collect()}
        assert [got[i] for i in range(len(texts))] == _repeats(texts, length)


def test_suffix_dedup_edges(edges, empty):
    assert suffix_dedup.find_repeats(edges).count() == len(EDGES)
    assert suffix_dedup.find_repeats(empty).count() == 0


def test_suffix_dedup_query_counts_bytes_not_words(spark, tmp_path):
    rng = random.Random(12)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    passage = lambda words, n, letters="abcdefgh": " ".join(word(letters, n) for _ in range(words))
    exact = passage(100, 3)  # 399 bytes
    shared = [passage(60, 5), passage(60, 7), exact, exact[:-1] + "ab", passage(60, 5, "éüß")]  # 359, 479, 399, 400 and 659 bytes; the third and fourth have 398 in common
    # capitals and digits stand around the passages and in no passage, so that shared runs are no longer than these
    texts = [f"{word(top, 300)}{p}{word(low, 300)}" for p in shared for top, low in (("ABCD", "0123"), ("EFGH", "4567"))]
    frame(spark, list(enumerate(texts))).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == _repeats(texts, 400)
    assert [got[i].n_removed for i in range(0, len(texts), 2)] == [0, 479, 0, 400, 659]
    assert all(got[i].n_kept == got[i].n_bytes - got[i].n_removed for i in got)


# 3


def test_bpe_like_tiktoken(bpe):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x250)] + list("  \n\t\r\x1c\x85\xa0'''stremvld 日本語한½²٣ 　\U0001f600é") * 8
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        ids = bpe.encode(text)
        assert ids.tolist() == own.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.find(keys).tolist()) == list(range(5000))
    assert table.find([b"no such key"]).tolist() == [-1]


def test_bpe_frames(edges, empty, bpe):
    coded = byte_bpe.decode(byte_bpe.encode(edges, bpe), bpe)
    assert set(edges.columns) < set(coded.columns)
    for r in coded.collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert all(r.exact for r in byte_bpe.round_trip(edges, bpe).collect())
    assert byte_bpe.round_trip(empty, bpe).count() == 0


def test_columns_of_any_name(spark, bpe):
    docs = frame(spark, [(1, "a b"), (2, None), (3, "a  b")]).withColumnsRenamed({"n": "a.b", "rep": "__text", "kept": "c`d"})
    coded = byte_bpe.decode(byte_bpe.encode(docs, bpe), bpe)
    assert coded.columns == [*docs.columns, "token_ids", "decoded"]
    assert {r.doc_id: bytes(r.decoded) for r in coded.collect()} == {1: b"a b", 2: b"", 3: b"a  b"}
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.reject(docs, model).columns == docs.columns and toxicity.reject(docs, model).count() == 3
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {1, 2}
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(named).collect()} == {"d1": "d1", "d2": "d2", "d3": "d1"}


# 4


def _components(docs, width, percent):
    sets = []
    for _, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        k = min(width, len(w))
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if k else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)}


def test_jaccard_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]) for _ in range(60)]
    rows = list(enumerate([*texts, "", None, "A b", "a  B", "\n"]))
    docs = frame(spark, rows).repartition(4)
    for width, percent, part in ((3, 90, 8), (5, 80, 16)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, width, percent, part).collect()}
        assert got == _components(rows, width, percent)


def test_jaccard_groups_are_bounded(spark):
    part, sizes = 32, [100 + k % 40 for k in range(1000)]  # several tiles of many parts in one bucket
    members = spark.createDataFrame([(7, k, n, k) for k, n in enumerate(sizes)], "token long, rep long, n long, label long")
    placed = jaccard_join._placed(members, 90, part).select("rep", F.explode("places").alias("p")).select("rep", "p.*")
    assert placed.groupBy("tile", "slot", "guest").count().agg(F.max("count")).first()[0] <= 4 * part
    met = collections.Counter()
    for _, group in placed.toPandas().groupby(["tile", "slot", "guest"]):
        own, guests = (group[group.side == k].rep.tolist() for k in (0, 1))
        itself = group.guest.iloc[0] == -1
        met.update(frozenset(x) for x in (itertools.combinations(own, 2) if itself else itertools.product(own, guests)))
    wanted = {frozenset((i, j)) for i, j in itertools.combinations(range(len(sizes)), 2) if 100 * min(sizes[i], sizes[j]) >= 90 * max(sizes[i], sizes[j])}
    assert wanted <= met.keys() and set(met.values()) == {1}


def test_jaccard_ids_with_two_sets_do_not_cancel(spark):
    rows = [(1, 5, 10), (1, 5, 11), (1, 7, 10), (2, 6, 10), (2, 6, 11), (2, 7, 10)]
    members = spark.createDataFrame([(*r, r[1]) for r in rows], "token long, rep long, n long, label long")
    bits = jaccard_join.wide_bits(np.arange(10, dtype=np.uint64))
    maps = spark.createDataFrame([(k, bits) for k in (5, 6, 7)], "rep long, bits binary")
    assert {tuple(r) for r in jaccard_join._across(members, maps, 80, 512).collect()} == {(5, 7), (6, 7)}


def test_jaccard_edges(edges, empty):
    got = jaccard_join.near_duplicates(edges, 3, 90).collect()
    assert len(got) == len(EDGES)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (4, 5, None)} == {(4, 4), (5, 4), (None, 4), (None, None)}
    assert jaccard_join.near_duplicates(empty, 3, 90).count() == 0


# 5


def test_quality_held_out(spark):
    rng = random.Random(2)
    rows, grades = [], []
    for i in range(500):
        g = i % 3
        rows.append((i, " ".join(("!!!" if rng.random() < (0.5, 0.2, 0.02)[g] else "word" + str(rng.randint(0, 50))) for _ in range(60))))
        grades.append((i, g))
    docs, ratings = frame(spark, rows), spark.createDataFrame(grades, "doc_id long, grade int")
    model = quality.fit(docs, ratings)
    assert len(model.cuts) == 2 and model.cuts[0] < model.cuts[1]
    got = {r.doc_id: r for r in quality.grade(docs, model, at_least=2).collect()}
    held = [(g, got[i]) for i, g in grades if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([abs(r.expected_grade - g) < 0.5 for g, r in held]) > 0.9
    assert np.mean([r.keep == (g == 2) for g, r in held]) > 0.9


def test_quality_edges(spark, edges, empty):
    ratings = spark.createDataFrame([(1, 0), (5, 2), (None, 1)], "doc_id long, grade int")
    for given in (ratings, ratings.where("grade = 0"), ratings.where("false")):
        model = quality.fit(edges, given)
        assert quality.grade(edges, model, 1).count() == len(EDGES)
        assert quality.grade(empty, model, 1).count() == 0


# 6


def test_quotes_link_and_order(spark):
    rows = [
        (1, 0, "user", "How do I sort?\n\nAnd how do I group?"),
        (1, 1, "assistant", "Use order by."),
        (1, 2, "user", "> Use   ORDER by.\nThanks."),
        (1, 3, "assistant", "> And how do I group?\n> > deeper\n\nUse group by."),
        (1, 4, "user", "> nobody said this\nok"),
        (2, 0, "user", None),
        (None, 0, "user", "> x"),
        (1, 5, "user", ">> Use order by.\nStill there?"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("row_key", F.lit("clash"))
    got = {(r.conv_id, r.turn): r for r in chat.link_quotes(df).collect()}
    assert len(got) == len(rows)
    assert got[1, 2].reply_to == 1 and got[1, 2].content == "Thanks."
    assert (got[1, 3].reply_to, got[1, 3].n_quotes, got[1, 3].n_linked) == (0, 2, 1)
    assert (got[1, 4].reply_to, got[1, 4].n_quotes, got[1, 4].content) == (None, 1, "ok")
    assert got[1, 5].reply_to == 1
    order = sorted((r for k, r in got.items() if k[0] == 1), key=lambda r: r.order_key)
    assert [r.turn for r in order] == [0, 3, 4, 1, 5, 2]
    assert chat.link_quotes(df.where("false")).count() == 0


def test_quoted_lines_link(spark):
    rows = [
        (1, 0, "one\ntwo  x\nthree\nfour\n\nfive"),
        (1, 1, "other\r\ntext\r\n\r\nlast words"),
        (1, 2, "> Two x\nyes"),  # one line
        (1, 3, "> two x\n> three\nyes"),  # consecutive lines
        (1, 4, "> one\n> three\nno"),  # not consecutive
        (1, 5, "> other\r\n> text\r\nyes"),  # a paragraph with carriage returns
        (1, 6, "> four\n> five\nyes"),  # over the end of a paragraph
        (1, 7, "> last words\n\n> two x\n> > one\nyes"),
        (1, 8, "> later\nno"),
        (1, 9, "later"),
        (2, 3, "> one\nanother conversation"),
        (3, 1, "ok"), (3, 2, "ok"), (3, 5, "> ok"), (3, 5, "ok"), (3, 6, "ok"),
        (None, 2, "> one"), (1, None, "> one"), (1, None, "one"),
    ]
    df = spark.createDataFrame([(*r[:2], "user", r[2]) for r in rows], "conv_id long, turn long, role string, text string")
    got = chat.link_quotes(df).collect()
    assert len(got) == len(rows)
    found = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.reply_to) for r in got if r.n_quotes}
    assert found == {
        (1, 2): (1, 1, 0), (1, 3): (1, 1, 0), (1, 4): (1, 0, None), (1, 5): (1, 1, 1), (1, 6): (1, 1, 0), (1, 7): (3, 3, 1),
        (1, 8): (1, 0, None), (2, 3): (1, 0, None), (3, 5): (1, 1, 2), (None, 2): (1, 0, None), (1, None): (1, 0, None),
    }


def _linked(rows):
    """What link_quotes says of (conv_id, turn, text) rows, one message after the other."""
    quote = re.compile(r"^[ \t]*>[> \t]*")
    normal = lambda t: re.sub(r"\s+", " ", t.lower()).strip(" ")

    def runs(text):
        out, last = [], None
        for line in re.split(r"\r?\n", text):
            mark = quote.match(line)
            rest = line[mark.end() :] if mark else line
            kind = -1 if not re.search(r"\S", rest) else mark.group().count(">") if mark else 0
            if kind != last:
                out.append((kind, []))
            out[-1][1].append(rest)
            last = kind
        return [(k, normal(" ".join(x)), len(x)) for k, x in out if k >= 0]

    own, lengths = collections.defaultdict(set), collections.defaultdict(set)
    for c, t, text in rows:
        if c is not None and t is not None:
            lengths[c] |= {n for k, p, n in runs(text or "") if k and p}
    for c, t, text in rows:
        if c is None or t is None:
            continue
        plain = [x for x in re.split(r"\r?\n", text or "") if not quote.match(x)]
        told = [x for x in map(normal, plain) if x]
        found = {normal("\n".join(plain))} | {p for k, p, _ in runs(text or "") if not k}
        found |= {" ".join(told[a : a + n]) for n in lengths[c] for a in range(len(told) - n + 1)}
        own[c] |= {(t, p) for p in found if p}
    out = []
    for c, t, text in rows:
        quoted = [(k, p) for k, p, _ in runs(text or "") if k and p]
        hits = [(-k, max(x)) for k, p in quoted if c is not None and t is not None and (x := [u for u, q in own[c] if q == p and u < t])]
        content = "\n".join(x for x in (text or "").split("\n") if not quote.match(x)).strip(" ")
        out.append((str(c), str(t), content, len(quoted), len(hits), str(max(hits)[1] if hits else None)))
    return sorted(out)


def test_quotes_against_brute_force(spark):
    rng = random.Random(9)
    lines = ["yes", "no  way", "Some longer line", "a", "", "it is so", "\t", "why?", "ünï code", "x" * 5000]
    rows = []
    for c, n in ((1, 12), (2, 40), (3, 150), (4, 3), (None, 5)):
        said = []
        for t in range(n):
            text = [rng.choice(lines) for _ in range(rng.randint(0, 6))]
            for _ in range(rng.choice([0, 1, 1, 2])):
                old = rng.choice(said) if said and rng.random() < 0.8 else [rng.choice(lines)]
                a = rng.randint(0, max(0, len(old) - 1))
                mark = rng.choice(["> ", ">", "> > ", " >> "])
                text = [mark + x for x in old[a : a + rng.randint(1, 3)]] + text if rng.random() < 0.7 else text + [mark + x for x in old[a : a + 2]]
            said.append(text)
            body = rng.choice(["\n", "\n", "\r\n"]).join(text)
            rows += [(c, None if rng.random() < 0.03 else t, None if rng.random() < 0.03 else body)] * rng.choice([1, 1, 1, 2])
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(4)
    got = chat.link_quotes(df.withColumns({"hash": F.lit("clash"), "lines": F.lit("clash"), "a.b": F.lit(1)})).collect()
    assert sorted((str(r.conv_id), str(r.turn), r.content, r.n_quotes, r.n_linked, str(r.reply_to)) for r in got) == _linked(rows)
    assert sum(r.n_linked for r in got) > 50


# 7


def test_token_files(spark, edges, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdéß, ") for _ in range(rng.randint(1, 9))) for _ in range(600_000))
    rows = [(i, t) for i, t in EDGES if i is not None and i != 3] + [(20, "İ Σας <|endoftext|> don't\x1cstop"), (10, "é́ e\n\nf"), (15, long)]
    out = token_files.new_path(spark)
    token_files.write_files(frame(spark, rows), out, token_files.WordEncoder(path, 1), token_files.WordEncoder.vocabulary(path), 1 << 20)
    got = {r.doc_id: r for r in token_files.with_starts(staged(token_files.read_files(spark, out), "back")).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for df, n in ((edges, len(EDGES)), (empty, 0)):
        out = token_files.new_path(spark)
        token_files.write_files(df, out, token_files.WordEncoder(path, 1), token_files.WordEncoder.vocabulary(path), 1 << 14)
        assert token_files.with_starts(token_files.read_files(spark, out)).count() == n


def test_query_gives_the_ids_of_a_plain_call(spark, tmp_path):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, "a <|endoftext|> b"), (2, "x<|startoftext|>y\n<|EndOfText|>"), (3, "plain")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_token_files(spark, str(tmp_path)).collect()}
    start = 0
    for i, t in rows:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("bits", [1, 5, 11, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.Generator(np.random.PCG64(bits)).integers(0, 2**bits, 1000).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), 1000, bits) == ids).all()
    file = token_files.TokenFile(token_files.to_file(np.arange(4), np.array([0, 10, 900, 90]), ids, bits, block=64))
    assert (file.document(2) == ids[10:910]).all() and len(file.document(0)) == 0
    assert file.crc32().tolist() == [zlib.crc32(file.document(k).astype("<u4").tobytes()) for k in range(4)]


def test_word_encoder_forgets():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, coder = Tokenizer.from_file(path), token_files.WordEncoder(path, 1, memo=50)
    for part in range(5):
        texts = [f"w{part}{i} again  x{i % 7}\n" for i in range(30)] + ["", " "]
        counts, ids = coder.encode(texts)
        want = [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == list(itertools.chain(*want))


# 8


def _targets(sizes, share=1.5, most=2.0, weights=(5.0, 2.0, 1.0)):
    total, open_, fixed = share * sum(sizes), set(range(len(sizes))), {}
    while True:
        left, w = total - sum(fixed.values()), sum(weights[i % 3] for i in open_)
        over = [i for i in open_ if weights[i % 3] / w * left > most * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, weights[i % 3] / w * left if w else 0) for i in range(len(sizes))]
        for i in over:
            fixed[i] = most * sizes[i]
            open_.discard(i)


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60)) for i in range(400)]
    docs = frame(spark, rows).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") < 200, "big").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    got = mixing.mix(docs.repartition(3), ["doc_id"]).collect()
    again = mixing.mix(docs.repartition(5), ["doc_id"]).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}
    by = collections.defaultdict(list)
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    names = [*sorted(k for k in by if k is not None), None]
    for name, want in zip(names, _targets([sum(r.size for r in by[n]) for n in names]), strict=True):
        assert abs(by[name][0].target - want) < 1e-6
        assert abs(sum(r.taken for r in by[name]) - want) <= 1
    drawn = collections.Counter(p.shard for r in got for p in r.places)
    assert set(drawn) <= set(range(16))


def test_repeated_rows_are_in_shard_order(spark):
    docs = frame(spark, [(i, "w " * (1 + i % 50)) for i in range(300)], extra=False).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    mixed = staged(mixing.mix(docs, ["doc_id"], words_per_block=200), "mixed")
    out = mixing.repeat_rows(docs, mixed, ["doc_id"]).withColumn("part", F.spark_partition_id()).collect()
    order = [(r.part, r.shard, r.position) for r in out]
    assert order == sorted(order) and [x[1:] for x in order] == sorted(x[1:] for x in order)
    rows = mixed.collect()
    draws = [(r.doc_id, p.shard, p.position) for r in rows for p in r.places]
    words = collections.Counter()
    for x in mixing.repeat_rows(docs, mixed, ["doc_id"]).collect():
        words[x.doc_id] += len(x.text.split())
    assert words == {r.doc_id: r.taken for r in rows if r.taken}
    # the shards are disjoint parts of the tree's size: blocks of a source go to them by its counts
    assert all(len({(p.shard, p.position) for p in r.places}) == len(r.places) for r in rows)
    assert sorted((r.doc_id, r.shard, r.position) for r in out) == sorted(draws) and len({x[1] for x in draws}) > 1


def test_splitting_tree_keeps_counts():
    quotas = np.array([100, 7, 0, 31])
    counts = mixing.split_quotas(quotas, 5, 1)
    assert (counts.sum(0) == quotas).all() and (counts >= 0).all() and counts.sum(1).max() - counts.sum(1).min() <= 2


def test_mixing_edges(edges, empty):
    assert mixing.mix(edges, ["doc_id"]).count() == len(EDGES)
    assert mixing.mix(empty, ["doc_id"]).count() == 0


# 9


def test_exact_dedup(spark, edges, empty):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot  text", f"t {rng.randint(0, 60)}", f"t\n{rng.randint(0, 60)}", f"only {i}", None, ""])) for i in range(400)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    groups = collections.defaultdict(list)
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[plain(t)].append(i)
    for i, t in rows:
        g = groups[plain(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(g), len(g), i == min(g), hashlib.sha256(plain(t).encode()).hexdigest())
    kept = exact_dedup.drop_exact_copies(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(1, ""), (3, "a"), (4, "a  B\tc"), (5, "A b\nC"), (-1, "a b c"), (6, "word " * 9000), (7, " \n\t "), (8, "ünï ©𝄞 日本語"), (9, "x" * 3000)])
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


# 10


def test_fingerprints(spark, edges, empty):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = [(3 * i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    rows += [(500, rows[3][1]), (501, "")]
    got = {r.doc_id: r for r in fingerprints.compare_edited(frame(spark, rows), 64).collect()}
    order = sorted(rows, reverse=True)
    bag = lambda t: collections.Counter(t.lower().split())

    def alike(a, b):
        both = set(a) | set(b)
        return sum(min(a[w], b[w]) for w in both) / sum(max(a[w], b[w]) for w in both) if both else 1.0

    errors = []
    for k, (i, t) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [got[i].near_edited - alike(bag(t), bag(edited)), got[i].near_next - alike(bag(t), bag(other))]
    assert np.abs(errors).mean() < 0.06 and abs(np.mean(errors)) < 0.02
    assert got[500].fingerprint == got[9].fingerprint
    assert fingerprints.compare_edited(edges).count() == len(EDGES)
    assert fingerprints.compare_edited(empty).count() == 0
    assert fingerprints.compare_edited(frame(spark, [(1, "one two")])).first().near_next == 1.0


# the pipeline


def test_pipeline_stages(spark, tmp_path, bpe):
    import corpus_pipeline

    rows = [(i, t) for i, t, _ in _toxic_corpus(300, 8)]
    rng = random.Random(9)
    rows += [(1000 + i, rows[i][1].replace(" ", "  ")) for i in range(1, 40)]
    for i in range(41, 80):
        own = (rows[i][1] * 3).split()
        rows[i] = (rows[i][0], " ".join(own))
        own[rng.randrange(len(own))] = "changed"
        rows.append((2000 + i, " ".join(own)))
    docs = frame(spark, rows, extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in _toxic_corpus(300, 8)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    kept = []
    for name, f in corpus_pipeline.STAGES:
        stage = staged(f(spark, stage, str(tmp_path)), name)
        names.append(name)
        kept.append(stage)
        if name != "byte_bpe":
            assert stage.columns == docs.columns
    assert names == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "byte_bpe"]
    clean = {r.doc_id: r.text for r in kept[0].collect()}
    bad = {i for i, _, y in _toxic_corpus(300, 8) if y}
    assert len(bad & set(clean)) < 0.1 * len(bad) and len(clean) > 0.95 * (len(rows) - 2 * len(bad))
    plain = collections.defaultdict(list)
    for i, t in clean.items():
        plain[re.sub(r"\s+", " ", t)].append(i)
    first = {min(g) for g in plain.values()}
    assert {r.doc_id for r in kept[1].collect()} == first
    left = [(i, clean[i]) for i in sorted(first)]
    want = {i for i, (_, c) in _components(left, 5, 80).items() if i == c}
    assert {r.doc_id for r in kept[2].collect()} == want
    mixed = collections.Counter(r.doc_id for r in kept[3].collect())
    assert set(mixed) <= want and max(mixed.values()) <= 2
    drawn = kept[3].collect()
    # only the last draw of a source is cut
    cut = collections.Counter(r.source for r in drawn if r.text != clean[r.doc_id])
    assert not cut or max(cut.values()) == 1
    assert all(clean[r.doc_id].split()[: len(r.text.split())] == r.text.split() and r.n_chars == len(r.text) for r in drawn)
    got = kept[4].collect()
    ids = [(r.doc_id, bpe.encode(r.text)) for r in drawn]
    want = [(i, len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest()) for i, x in ids]
    assert all(r.exact for r in got) and sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == sorted(want)


def test_registered_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
