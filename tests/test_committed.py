"""The data source of committed lines, by batch and by stream."""

import datetime
import json
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, DataSourceStreamArrowWriter

from shortlist.sources.committed import CommittedLines, LinesWriter

ROWS = [(i, f"line {i}\n\"é\"") for i in range(50)] + [(50, None), (51, "")]


@pytest.fixture(scope="module")
def lines(spark):
    spark.dataSource.register(CommittedLines)
    return spark.createDataFrame(ROWS, "place long, line string").repartition(4)


def back(spark, path, schema="place long, line string"):
    return sorted(map(tuple, spark.read.format("committed_lines").schema(schema).load(str(path)).collect()))


def test_round_trip(spark, lines, tmp_path):
    path = f"{tmp_path}/out"
    lines.write.format("committed_lines").mode("append").save(path)
    assert back(spark, path) == sorted(ROWS)
    lines.limit(0).write.format("committed_lines").mode("append").save(path)
    lines.where("place < 2").write.format("committed_lines").mode("append").save(path)
    assert back(spark, path) == sorted([*ROWS, *ROWS[:2]])
    lines.where("place = 7").write.format("committed_lines").mode("overwrite").save(path)
    assert back(spark, path) == [ROWS[7]] and len(list((tmp_path / "out" / "data").iterdir())) == 1
    assert back(spark, f"{tmp_path}/none") == []
    nested = spark.createDataFrame([(1, [1, None], {"a": 2}, datetime.date(2024, 1, 2))], "k int, xs array<int>, m map<string,int>, d date")
    nested.write.format("committed_lines").mode("append").save(f"{tmp_path}/nested")
    assert back(spark, f"{tmp_path}/nested", "k int, xs array<int>, m map<string,int>, d string") == [(1, [1, None], {"a": 2}, "2024-01-02")]


def test_a_failed_task_leaves_nothing_to_read(spark, lines, tmp_path):
    path = f"{tmp_path}/out"
    lines.where("place < 3").write.format("committed_lines").mode("append").save(path)
    fails = F.udf(lambda i: 1 // (i - 40) and i, "long")
    with pytest.raises(Exception, match="ZeroDivision"):
        lines.withColumn("place", fails("place")).write.format("committed_lines").mode("append").save(path)
    assert back(spark, path) == ROWS[:3]


def test_stream_and_replay(spark, lines, tmp_path):
    path = f"{tmp_path}/out"
    for run in ("a", "b"):
        lines.write.parquet(f"{tmp_path}/in-{run}")

        def drain(run=run):
            stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in-{run}")
            stream.writeStream.format("committed_lines").option("checkpointLocation", f"{tmp_path}/cp-{run}").trigger(availableNow=True).start(path).awaitTermination()

        drain()
        shutil.rmtree(tmp_path / f"cp-{run}" / "commits")  # the last batch runs again
        drain()
    assert back(spark, path) == sorted([*ROWS, *ROWS])  # two runs, no batch twice


ODD = ["a", None, "", 'q"\\', "\x00\x01\n\r\t\u2028\x85", "é😀", "null", "2024-01-02", "x" * 3_000_000, "a"]


def test_plain_columns_go_by_batches(tmp_path):
    """The lines of the row writer, without a Python row for each, whole for lines longer than a block."""
    schema = T.StructType().add("place", "long").add("line", "string").add("n", "short").add('o"k', "boolean")
    source = CommittedLines({"path": f"{tmp_path}/out", "checkpointLocation": f"{tmp_path}/cp"})
    writer = source.writer(schema, False)
    assert isinstance(writer, DataSourceArrowWriter) and isinstance(source.streamWriter(schema, False), DataSourceStreamArrowWriter)
    kinds = pa.schema([("place", pa.int64()), ("line", pa.string()), ("n", pa.int16()), ('o"k', pa.bool_())])
    rows = [(2**62 + i if i % 4 else None, t, i if i % 3 else None, [True, False, None][i % 3]) for i, t in enumerate(ODD)]
    batch = pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)
    by_batches = b"".join(x for _, x in writer.lines(iter([batch.slice(3), batch.slice(0, 0), batch.slice(0, 3)])))
    by_rows = b"".join(x for _, x in LinesWriter(f"{tmp_path}/x", schema, False).lines(Row(*kinds.names)(*r) for r in [*rows[3:], *rows[:3]]))
    assert by_batches == by_rows
    writer.commit([writer.write(iter([batch]))])
    reader = source.reader(schema)
    found = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(isinstance(b, pa.RecordBatch) for b in found)
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == rows


def test_other_types_and_old_manifests_are_read_by_rows(spark, lines, tmp_path):
    path = f"{tmp_path}/out"
    lines.write.format("committed_lines").mode("append").save(path)
    some = spark.read.format("committed_lines").schema("line string, none int").load(path).collect()
    assert {tuple(r) for r in some} == {(t, None) for _, t in ROWS}
    assert sorted(r.place for r in spark.read.format("committed_lines").schema("place string").load(path).collect()) == sorted(str(i) for i, _ in ROWS)
    (manifest,) = (tmp_path / "out" / "_manifests").glob("*.json")
    manifest.write_text(json.dumps({"files": json.loads(manifest.read_text())["files"]}))
    assert back(spark, path) == sorted(ROWS)
