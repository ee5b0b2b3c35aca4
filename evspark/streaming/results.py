"""Streaming forms: keyed results upserted batch by batch, and the reuse throttle as questions arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from evspark.operators.docfilter import demote_reused, document_key
from evspark.sources.keyed import merge_keyed, read_keyed

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTING = "spark.sql.streaming.stateStore.providerClass"


def stream_results_upsert(rows: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Merges the last row by ord of each key of a batch into the keyed table at ``path``.

    A batch rewrites only the buckets that its keys fall into; one that runs again leaves the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        merge_keyed(batch, path, keys, number, buckets=buckets)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def read_results(spark: SparkSession, path: str, keys: list[str], schema: StructType) -> DataFrame:
    """The table: for each key the row of the latest batch that has it; no rows before the first batch."""
    return read_keyed(spark, path, schema)


def state_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one whose streams keep their state in RocksDB, as keyed state needs."""
    session = spark.newSession()
    session.conf.set(STATE_SETTING, STATE_STORE)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return session


class FirstUse(StatefulProcessor):
    """Keeps, for each document, the first question that had it in full, and tells every use of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", StructType([StructField("question_id", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.first.exists():  # from an earlier batch: later questions can't come before it
            first = self.first.get()[0]
            for part in rows:
                yield part.assign(first_question=first)
            return
        parts = list(rows)  # once in the life of a document
        users = [int(q) for part in parts for q in part["question_id"][part["uses"]]]
        if users:
            self.first.update((min(users),))
        for part in parts:
            yield part.assign(first_question=pd.array([min(users, default=None)] * len(part), "Int64"))

    def close(self) -> None:
        pass


def stream_first_uses(docs: DataFrame) -> DataFrame:
    """A stream of candidates with first_question: the first question, so far, that had the document in full.

    Only full documents with a key are looked up, in a state store by key, so a batch reads what it brings and nothing of what
    came before; all others pass with null.
    """
    if docs.sparkSession.conf.get(STATE_SETTING, "") != STATE_STORE:
        raise ValueError("use a session of state_session(spark): keyed state needs RocksDB")
    keyed = docs.withColumn("__key", document_key())
    asks = (F.col("final_label") == "full") & F.col("__key").isNotNull()
    known = F.coalesce(asks, F.lit(False))
    used = keyed.where(known).withColumn("uses", F.coalesce(F.col("gated"), F.lit(False)))
    schema = StructType([f for f in used.schema.fields if f.name != "__key"] + [StructField("first_question", LongType())])
    told = used.groupBy("__key").transformWithStateInPandas(FirstUse(), schema, "Append", "None")
    rest = keyed.where(~known).withColumn("first_question", F.lit(None).cast("long"))
    return told.drop("uses").unionByName(rest.drop("__key"))


def stream_reuse_throttle(docs: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Judges each batch of questions by the documents that earlier batches, and earlier questions of its own, had in full.

    A question arrives whole, with larger ids than all before. First uses are in the stream's state, beside the
    checkpoint: a new checkpoint begins with none, and a stream that starts again goes on with them. Judged rows go to
    ``path/batch=n``; a batch that runs again replaces its own.
    """

    def judge(batch: DataFrame, number: int) -> None:
        demote_reused(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream_first_uses(docs).writeStream.outputMode("append").foreachBatch(judge).option("checkpointLocation", checkpoint)
