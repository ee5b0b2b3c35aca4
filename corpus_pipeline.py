"""From documents to packed sequences: quality, near duplicates, repeated passages, benchmarks, packing.

Each stage takes the rows that the one before kept and returns rows with the columns of documents; the
last one returns packed pieces. Between stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.llm import decontaminate, jaccard, packing, quality, suffix_dedup
from evspark.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    A row is known by its id and a hash of what is judged, so null and repeated ids do no harm.
    """
    row = F.struct(F.col("doc_id"), F.xxhash64("text", "lang", "source"))
    keyed = docs.withColumn("__row", row)
    rejected = quality.quality_rules(keyed.select("__row", "text", "lang", "source"), "__row").where(~F.col("kept")).select("__row")
    return keyed.join(rejected.distinct(), "__row", "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of the least id, of several such the one whose text has the least hash.

    Rows without an id stay. Rows that repeat an id are told apart by a hash of the text, so that different texts
    of one id are judged apart; of equal rows with one id one stays. Null and empty texts are one class. An
    empty table gives no rows; other columns are carried along, names with two underscores are reserved.
    """
    keyed = docs.withColumn("__row", F.xxhash64("text"))
    classes = written(jaccard.near_duplicates(keyed.select("doc_id", "text", "__row"), row_col="__row").where(F.col("doc_id").isNotNull()))
    row = F.struct("doc_id", "__row")
    best = classes.groupBy("class_key").agg(F.min(row).alias("best"))
    same = classes.groupBy("class_key", "doc_id", "__row").agg(F.count(F.lit(1)).alias("n"))
    fates = same.join(best, "class_key").select("doc_id", "__row", (row == F.col("best")).alias("__stays"), "n")
    fates = fates.where(~F.col("__stays") | (F.col("n") > 1)).groupBy("doc_id", "__row").agg(F.max("__stays").alias("__stays"))
    judged = keyed.join(fates, ["doc_id", "__row"], "left")
    alone = judged.where(F.col("__stays").isNull()).select(*docs.columns)
    return alone.unionByName(judged.where("__stays").dropDuplicates(["doc_id", "__row"]).select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that an earlier document has in a run of 50.

    A changed text has a new n_chars. Null and empty texts, and all others in which nothing repeats, stay as
    they are; rows without an id, or of one id, never cut each other; an empty table gives no rows.
    """
    found = suffix_dedup.deduplicate(docs.withColumnRenamed("removal", "__given"), kept="text")
    changed = F.col("removal.n_removed") > 0
    text = F.when(changed, F.col("removal.kept_text")).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    found = found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*[F.col("__given").alias(c) if c == "removal" else c for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no run of ten words of a benchmark item occurs.

    Each row is judged by its own text, whatever others have the same id or none; null and empty texts stay; an
    empty benchmark or table changes nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; a null or empty text is its closing token alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_free", benchmark_free),
    ("packing", packed),
]

#: Chosen paths, suffix sorting and tokenization can't be said in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
