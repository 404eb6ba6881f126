"""Streams over restarts, replays and new checkpoints."""

import datetime
import functools
import os
import shutil
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shortlist.streaming import jobs

POSTING = "url string, title string, company string, location string, application_url string, fit_score int, discovered_at timestamp, scored_at timestamp"


def posting(n, role="r", apply=None):
    return (f"https://b.example/{n}", role, "c", "l", apply, 8, datetime.datetime(2024, 1, n + 1), datetime.datetime(2024, 2, n + 1))


def files(spark, path, batches, schema):
    """One file for each batch, in order of their times."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for f in (p for p in path_files(path) if p.name not in SEEN):
            SEEN.add(f.name)
            stamp = 1_600_000_000 + 10 * k
            os.utime(f, (stamp, stamp))
    return jobs.source(spark, path, spark.read.parquet(path).schema, files=1)


SEEN: set[str] = set()


def path_files(path):
    return sorted(Path(path).glob("part-*.parquet"))


@pytest.mark.parametrize("run", [jobs.suppress_reposts, jobs.suppress_with_state])
def test_two_checkpoints_send_once_and_keep_the_history(spark, tmp_path, run):
    given = {"one": [[posting(1, "a")], [posting(2, "b"), posting(5, "a")]], "two": [[posting(1, "a"), posting(3, "b"), posting(4, "d")]]}
    for name, batches in given.items():
        run(files(spark, f"{tmp_path}/{name}", batches, POSTING), f"{tmp_path}/history", f"{tmp_path}/out", f"{tmp_path}/cp-{name}", "url").awaitTermination()
    sent = sorted(r.url[-1] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert sent == ["1", "2", "4"]  # 3 has the role of 2, 5 that of 1
    history = jobs.compact_history(spark, f"{tmp_path}/history")
    assert history.count() == history.select("fingerprint").distinct().count() == 6
    before = sorted(map(tuple, history.collect()))
    jobs.rewrite_history(spark, f"{tmp_path}/history")
    assert len(jobs.stored(spark, f"{tmp_path}/history")) == 1
    assert sorted(map(tuple, jobs.compact_history(spark, f"{tmp_path}/history").collect())) == before


@pytest.mark.parametrize("run", [jobs.suppress_reposts, jobs.suppress_with_state])
def test_a_batch_lost_halfway_is_replayed(spark, tmp_path, run, monkeypatch):
    batches = [[posting(1, "a")], [posting(2, "b"), posting(3, "a", "https://x.example/3")], [posting(4, "b")]]
    stream = files(spark, f"{tmp_path}/in", batches, POSTING)
    paths = (f"{tmp_path}/history", f"{tmp_path}/out", f"{tmp_path}/cp", "url")
    real, calls = jobs.history_rows, []

    def lost(sent, at):
        calls.append(1)
        if len(calls) == 2:  # the rows are out, their history is not
            raise RuntimeError("lost")
        return real(sent, at)

    monkeypatch.setattr(jobs, "history_rows", lost)
    with pytest.raises(Exception, match="lost"):
        run(stream, *paths).awaitTermination()
    assert spark.read.parquet(paths[1]).count() == 2
    run(stream, *paths).awaitTermination()
    assert sorted(r.url[-1] for r in spark.read.parquet(paths[1]).collect()) == ["1", "2"]
    assert jobs.compact_history(spark, paths[0]).count() == 4


def test_state_is_forgotten(spark, tmp_path):
    args = (f"{tmp_path}/history", f"{tmp_path}/out", f"{tmp_path}/cp", "url", datetime.timedelta(milliseconds=1))
    jobs.suppress_with_state(files(spark, f"{tmp_path}/in", [[posting(1, "a")]], POSTING), *args).awaitTermination()
    jobs.suppress_with_state(files(spark, f"{tmp_path}/in", [[posting(2, "a")]], POSTING), *args).awaitTermination()
    assert spark.read.parquet(args[1]).count() == 2


@pytest.mark.parametrize("buckets", [1, 4])
def test_ingest_keeps_the_first_row_of_all_runs(spark, tmp_path, buckets):
    runs = {"one": [[("a", 1), ("a", 2)], [("b", 3), ("a", 0)]], "two": [[("b", 4), ("c", 5), ("a", -1)]]}
    for name, batches in runs.items():
        jobs.ingest_exact(files(spark, f"{tmp_path}/{name}", batches, "url string, n int"), f"{tmp_path}/out", f"{tmp_path}/cp-{name}", "url", ["n"], buckets=buckets).awaitTermination()
        # a run that is started again has nothing to do
        jobs.ingest_exact(jobs.source(spark, f"{tmp_path}/{name}", spark.read.parquet(f"{tmp_path}/{name}").schema, 1), f"{tmp_path}/out", f"{tmp_path}/cp-{name}", "url", ["n"], buckets=buckets).awaitTermination()
    assert sorted((r.url, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 1), ("b", 3), ("c", 5)]


def test_a_replayed_ingest_replaces_its_rows(spark, tmp_path):
    stream = files(spark, f"{tmp_path}/in", [[("a", 1)], [("b", 2), ("a", 3)]], "url string, n int")
    args = (f"{tmp_path}/out", f"{tmp_path}/cp", "url", ["n"], 1)
    jobs.ingest_exact(stream, *args).awaitTermination()
    shutil.rmtree(tmp_path / "cp" / "commits")  # as if it had been lost before the commits: the last batch runs again
    jobs.ingest_exact(stream, *args).awaitTermination()
    assert sorted((r.url, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 1), ("b", 2)]


def test_enrichment_keeps_every_run(spark, tmp_path):
    worked = []

    def work(batch):
        worked.extend(sorted(r.url for r in batch.collect()))
        return batch.withColumn("status", F.lit("ok"))

    for name, rows in (("one", [("a",), ("b",)]), ("two", [("a",), ("c",)])):
        jobs.enrich_stream(files(spark, f"{tmp_path}/{name}", [rows], "url string"), work, f"{tmp_path}/out", f"{tmp_path}/cp-{name}", key="url").awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]
    assert worked == ["a", "b", "c"]  # no row is worked on twice
    for name, rows in (("three", [("a",)]), ("four", [("a",)])):
        jobs.enrich_stream(files(spark, f"{tmp_path}/{name}", [rows], "url string"), lambda b: b, f"{tmp_path}/all", f"{tmp_path}/cp-{name}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/all").count() == 2


def test_watermark_drops_what_is_late_and_keeps_what_comes_again(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    batches = [[("a", day(0)), ("a", day(1)), ("b", day(0))], [("c", day(40))], [("f", day(41))], [("d", day(3)), ("a", day(42)), ("c", day(42))], [("e", day(60))]]
    stream = files(spark, f"{tmp_path}/in", batches, "url string, at timestamp")
    kept = jobs.ingest_deduplicated(stream, "url", "at", "14 days")
    kept.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.url, (r.at - day(0)).days) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # d is older than the watermark (day 26) and gone; a is new again after its 14 days; c at day 42 is a repeat
    assert [x for x in got if x[0] != "a"] == [("b", 0), ("c", 40), ("e", 60), ("f", 41)]
    assert [x[1] for x in got if x[0] == "a"] in ([0, 42], [1, 42])


class Store:
    """A state store of one key that counts what it is asked."""

    def __init__(self):
        self.value, self.asked = None, 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        self.asked += 1
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value


def test_the_state_is_asked_by_buckets(spark):
    store = Store()
    met = jobs.FirstMet(None)
    met.init(store)
    prints = [n.to_bytes(32, "big")[::-1] for n in range(500)]
    frame = lambda keys, fps: pd.DataFrame({"bucket": 0, "key": keys, "fp": fps})
    met.handleInitialState((0,), pd.DataFrame({"prints": [b"".join(p[: jobs.DIGEST] for p in prints[:100])]}), None)
    first = pd.concat(met.handleInputRows((0,), iter([frame([f"b{n}" for n in range(500)], prints), frame([f"a{n}" for n in range(500)], prints)]), None))
    assert sorted(first["key"]) == sorted(f"a{n}" for n in range(100, 500))
    assert not list(met.handleInputRows((0,), iter([frame(["0"] * 500, prints)]), None))
    assert store.asked < 10


def test_a_bucket_keeps_fingerprints_apart(spark, tmp_path):
    batches = [[posting(1, "a"), posting(2, "b")], [posting(3, "c"), posting(4, "b"), posting(6, "a", "https://x.example/6")], [posting(5, "c"), posting(7, "d")]]
    jobs.suppress_with_state(files(spark, f"{tmp_path}/in", batches, POSTING), f"{tmp_path}/history", f"{tmp_path}/out", f"{tmp_path}/cp", "url", buckets=1).awaitTermination()
    assert sorted(r.url[-1] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1", "2", "3", "7"]


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_inputs_are_written_by_all_tasks(spark, tmp_path, batches):
    from shortlist.plans.q_stream import _as_files

    path, schema, files = _as_files(spark.range(0, 8000, 1, 8), f"{tmp_path}/in", batches)
    assert len(list(tmp_path.rglob("part-*.parquet"))) == 8 * batches
    assert files == (None if batches == 1 else 8)
    met = []
    jobs.each_batch(jobs.source(spark, path, schema, files), f"{tmp_path}/cp", lambda batch, name: met.append((batch.columns, batch.agg(F.count_distinct("id")).first()[0]))).awaitTermination()
    assert len(met) == batches and sum(n for _, n in met) == 8000 and all(c == ["id"] for c, _ in met)


@pytest.mark.parametrize("run", [jobs.suppress_reposts, functools.partial(jobs.suppress_with_state, buckets=3)])
def test_rows_of_one_key_send_one(spark, tmp_path, run):
    at = lambda n: datetime.datetime(2024, 2, 1) + datetime.timedelta(hours=n)
    rows = [(*posting(k, f"role {k}")[:7], at((7 * k + 5 * n) % 40)) for n in range(40) for k in range(20)]
    run(files(spark, f"{tmp_path}/in", [rows], POSTING), f"{tmp_path}/history", f"{tmp_path}/out", f"{tmp_path}/cp", "url").awaitTermination()
    sent = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.url for r in sent) == sorted(posting(k)[0] for k in range(20)) and all(r.title for r in sent)


def test_what_loses_in_a_task_does_not_move(spark):
    frame = lambda n: pd.DataFrame({"key": [f"{k:03}" for k in range(n, n + 100)] * 2, "hash": 0, "fp": [b"r%d" % (k % 3) for k in range(100)] + [b"p%d" % (n + k) for k in range(100)]})
    (first,) = jobs.first_asked(iter([frame(300), frame(0), frame(600)]))
    assert len(first) == 303 and sorted(k for k, fp in zip(first["key"], first["fp"]) if fp[:1] == b"r") == ["000", "001", "002"]
    parts = list(jobs.first_asked(iter([frame(0), frame(300), frame(600)]), most=150))
    assert [len(x) for x in parts] == [203, 103]
