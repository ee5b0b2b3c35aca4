"""A table of one row for each key, in buckets, that batches are merged into.

Under ``path``: ``data/version=n/bucket=b`` has the rows of a bucket as batch n left them; ``manifest/batch=n`` has, for every
bucket that has rows, the version that holds after that batch. A batch rewrites the buckets of its own keys, then its
manifest, which is one file and so appears at once: until then the table is as before. A batch that runs again begins from the
manifest before it and puts the same in place. Readers follow the newest manifest and write nothing. What neither the newest
manifest nor the one before it names is deleted, so that a reader that has just begun still finds its files.

All goes through Spark and its file systems, so the folder may be wherever those of the inputs are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

MANIFEST = "bucket int, version long, buckets int, batch long"


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket of a row, by its keys as text."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def latest(rows: DataFrame, keys: list[str], ord_col: str, *, first: bool = False) -> DataFrame:
    """For each key the last row by ``ord_col``, or the first; of several such any."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.asc(ord_col) if first else F.desc(ord_col)))
    return rows.withColumn("__last", last).where(F.col("__last") == 1).drop("__last")


def manifests(spark: SparkSession, path: str) -> dict[int, dict[int, tuple[int, int]]]:
    """For each kept batch, bucket -> (version, number of buckets); at most a few times as many rows as buckets."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in rows:
        found.setdefault(r["batch"], {})[r["bucket"]] = (r["version"], r["buckets"])
    return found


def _rows(spark: SparkSession, path: str, versions: dict[int, tuple[int, int]], schema: StructType) -> DataFrame:
    places = [f"{path}/data/version={v}/bucket={b}" for b, (v, _) in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read_keyed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table as the newest batch left it; no rows before the first batch."""
    known = manifests(spark, path)
    return _rows(spark, path, known[max(known)] if known else {}, schema)


def merge_keyed(rows: DataFrame, path: str, keys: list[str], number: int, *, ord_col: str = "ord", buckets: int = 64, only_new: bool = False) -> None:
    """Puts the last row of each key of ``rows`` into the table, as batch ``number``; numbers rise.

    Only the buckets of these keys are read and written. With ``only_new``, keys that are there stay as they are and
    of the new ones the first row counts. Null keys are keys like others. The number of buckets is that of the first batch.
    """
    spark, schema = rows.sparkSession, rows.schema
    known = manifests(spark, path)
    before = max((b for b in known if b < number), default=None)
    current = known[before] if before is not None else {}
    if current:
        buckets = next(iter(current.values()))[1]
    fresh = latest(rows, keys, ord_col, first=only_new)
    fresh = fresh.withColumn("__bucket", bucket_of(keys, buckets)).persist()
    try:
        touched = [r["__bucket"] for r in fresh.select("__bucket").distinct().collect()]  # at most the number of buckets
        if not touched:
            return
        old = _rows(spark, path, {b: current[b] for b in touched if b in current}, schema).withColumn("__bucket", bucket_of(keys, buckets))
        same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in ("__bucket", *keys)]
        if only_new:
            merged = old.unionByName(fresh.join(old.select("__bucket", *keys), same(fresh, old), "left_anti"))
        else:
            merged = old.join(fresh.select("__bucket", *keys), same(old, fresh), "left_anti").unionByName(fresh)
        merged = merged.repartition("__bucket").withColumnRenamed("__bucket", "bucket")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
    finally:
        fresh.unpersist()
    now = current | {b: (number, buckets) for b in touched}
    listed = spark.createDataFrame([(b, v, n) for b, (v, n) in sorted(now.items())], "bucket int, version long, buckets int").coalesce(1)
    listed.write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")
    _drop_unused(spark, path, known | {number: now}, keep=[b for b in (before, number) if b is not None])


def _drop_unused(spark: SparkSession, path: str, known: dict, keep: list[int]) -> None:
    """Deletes manifests besides ``keep`` and the bucket folders that only they named."""
    needed = {(v, b) for n in keep for b, (v, _) in known[n].items()}
    gone = [n for n in known if n not in keep and n < max(keep)]
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n in gone:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/batch={n}"), True)
    for v, b in {(v, b) for n in gone for b, (v, _) in known[n].items()} - needed:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/data/version={v}/bucket={b}"), True)
        if all(used != v for used, _ in needed):
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/data/version={v}"), True)
