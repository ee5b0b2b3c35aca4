"""Keyed tables and streams: merges, replays, restarts, and files that stay few."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evspark.operators import docfilter
from evspark.sources.keyed import bucket_of, manifests, merge_keyed, read_keyed
from evspark.streaming import results

SCHEMA = "k int, ord int, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def held(spark, path):
    return sorted(map(tuple, read_keyed(spark, path, frame(spark, []).schema).collect()), key=str)


def parts(path):
    return sorted(str(p) for p in Path(path).rglob("part-*"))


def test_merge(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert held(spark, path) == [] and not os.path.exists(path)  # a reader leaves nothing behind
    merge_keyed(frame(spark, [(1, 1, "a"), (2, 2, "b"), (2, 1, "z"), (None, 1, "n")]), path, ["k"], 0, buckets=8)
    assert held(spark, path) == sorted([(1, 1, "a"), (2, 2, "b"), (None, 1, "n")], key=str)
    merge_keyed(frame(spark, [(1, 3, "c"), (None, 2, "m"), (5, 1, "e")]), path, ["k"], 1, buckets=99)
    want = sorted([(1, 3, "c"), (2, 2, "b"), (None, 2, "m"), (5, 1, "e")], key=str)
    assert held(spark, path) == want
    merge_keyed(frame(spark, [(1, 3, "c"), (None, 2, "m"), (5, 1, "e")]), path, ["k"], 1)  # again
    merge_keyed(frame(spark, []), path, ["k"], 2)
    assert held(spark, path) == want
    merge_keyed(frame(spark, [(5, 9, "x"), (6, 2, "late"), (6, 1, "first")]), path, ["k"], 3, only_new=True)
    assert held(spark, path) == sorted([*want, (6, 1, "first")], key=str)


def test_first_and_last_of_text_order(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-02", "b"), (1, "2024-01", "a"), (1, "2024-03", "c")], "k int, at string, v string")
    merge_keyed(rows, f"{tmp_path}/new", ["k"], 0, ord_col="at", only_new=True, buckets=2)
    merge_keyed(rows, f"{tmp_path}/old", ["k"], 0, ord_col="at", buckets=2)
    assert [read_keyed(spark, f"{tmp_path}/{p}", rows.schema).first().v for p in ("new", "old")] == ["a", "c"]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/t"
    merge_keyed(frame(spark, [(k, 0, "x") for k in range(50)]), path, ["k"], 0, buckets=8)
    one = frame(spark, [(7, 1, "y")])
    bucket = one.select(bucket_of(["k"], 8).alias("b")).first().b
    merge_keyed(one, path, ["k"], 1)
    assert {b: v for b, (v, _) in manifests(spark, path)[1].items()} == {b: int(b == bucket) for b in range(8)}
    assert os.listdir(f"{path}/data/version=1") and [p for p in os.listdir(f"{path}/data/version=1") if p.startswith("bucket")] == [f"bucket={bucket}"]


def test_many_batches_of_the_same_keys_leave_few_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in range(40):
        merge_keyed(frame(spark, [(k, n, f"v{n}") for k in range(6)]), path, ["k"], n, buckets=4)
    assert held(spark, path) == [(k, 39, "v39") for k in range(6)]
    table = len({p for p in parts(f"{path}/data/version=39")})
    assert table <= 4 and len(parts(f"{path}/data")) <= 2 * table and len(parts(f"{path}/manifest")) <= 2


def test_a_batch_that_failed_before_its_manifest_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    merge_keyed(frame(spark, [(1, 1, "a")]), path, ["k"], 0, buckets=2)
    frame(spark, [(1, 2, "half")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/data/version=1")
    assert held(spark, path) == [(1, 1, "a")]
    merge_keyed(frame(spark, [(1, 2, "b")]), path, ["k"], 1)
    assert held(spark, path) == [(1, 2, "b")]


def test_stream_upsert(spark, tmp_path):
    schema = frame(spark, []).schema
    for i, rows in enumerate([[(1, 1, "a"), (2, 2, "b"), (2, 1, "z")], [(1, 3, "c")], []]):
        frame(spark, rows).write.parquet(f"{tmp_path}/in/{i}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        results.stream_results_upsert(source, f"{tmp_path}/out", ["k"], f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, results.read_results(spark, f"{tmp_path}/out", ["k"], schema).collect())) == [(1, 3, "c"), (2, 2, "b")]


DOCS = "question_id long, idx int, uri string, doc_id string, final_label string, gated boolean, doc_filter_min_keep int"


def run(session, tmp_path, trigger=None):
    source = session.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    results.stream_reuse_throttle(source, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()


def test_streamed_throttle_sees_what_had_arrived(spark, tmp_path):
    """Each lot starts the stream again from its checkpoint; the state goes on."""
    session, everything = results.state_session(spark), []
    lots = [[1], [2, 3], [4]]
    for lot in lots:
        rows = [(q, i, f"u{i % 3}" if i < 4 else None, f"{q}{i}" if i < 5 else None, "full" if i != 3 or q != 2 else "drop", q != 3, 0) for q in lot for i in range(6)]
        everything += rows
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(session, tmp_path)
    want = docfilter.reuse_throttle(spark.createDataFrame(everything, DOCS)).select("question_id", "idx", "throttled", "final_label").collect()
    out = spark.read.parquet(f"{tmp_path}/out")
    got = out.select("question_id", "idx", "throttled", "final_label").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r.throttled for r in got) > 4
    assert set(out.columns) == {*[c.split()[0] for c in DOCS.split(", ")], "throttled", "batch"}
    run(session, tmp_path)  # nothing new: nothing changes
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(everything)


def test_state_needs_its_store(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError, match="state_session"):
        results.stream_first_uses(spark.readStream.schema(DOCS).parquet(f"{tmp_path}/in"))
