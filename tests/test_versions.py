"""Later versions of documents in a stream: out of order, repeated, after a restart, after expiry."""

import datetime as dt

from pyspark.sql import functions as F

from chronoweave.streaming import versions

DAY = dt.datetime(2026, 1, 1)
ROW = "doc_id string, version long, content string, ts timestamp"


def _batch(spark, folder, rows):
    at = [(d, v, c, DAY + dt.timedelta(hours=h)) for d, v, c, h in rows]
    spark.createDataFrame(at, ROW).coalesce(1).write.mode("append").json(str(folder))


def _run(spark, source, out, checkpoint):
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(str(source))
    query = versions.latest(stream, "ts", "1 hour", 10 * 3_600_000).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    found = spark.read.schema(versions.CHANGES).parquet(str(out)).collect() if any(out.glob("*.parquet")) else []
    return sorted((r.doc_id, r.version, r.op, r.content) for r in found)


def test_later_versions_retract_earlier_ones(spark, tmp_path):
    versions.prepare(spark)
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    _batch(spark, source, [("a", 2, "two", 0), ("a", 1, "one", 0), ("b", 1, "x", 0), (None, 1, "no", 0), ("c", None, "no", 0)])
    first = _run(spark, source, out, checkpoint)
    assert first == [("a", 2, "insert", "two"), ("b", 1, "insert", "x")]
    _batch(spark, source, [("a", 1, "late", 1), ("a", 2, "again", 1), ("b", 2, "x", 1)])  # nothing new, or the same content
    assert _run(spark, source, out, checkpoint) == first
    _batch(spark, source, [("a", 5, "five", 2), ("a", 4, "four", 2)])  # the query starts again from its checkpoint
    second = _run(spark, source, out, checkpoint)
    assert [x for x in second if x not in first] == [("a", 2, "retract", "two"), ("a", 5, "insert", "five")]
    assert _run(spark, source, out, checkpoint) == second
    _batch(spark, source, [("z", 1, "clock", 40)])  # lets the others expire
    _batch(spark, source, [("z", 2, "clock", 41)])
    _run(spark, source, out, checkpoint)
    _batch(spark, source, [("a", 1, "new life", 42)])
    last = _run(spark, source, out, checkpoint)
    assert ("a", 1, "insert", "new life") in last and sum(x[2] == "retract" and x[0] == "a" for x in last) == 1
