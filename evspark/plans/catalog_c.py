"""The flagship query, from questions to excerpts, and the streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.functions.text import with_profile
from evspark.operators import chunks as C
from evspark.operators import docfilter, retrieve, route
from evspark.plans.catalog_a import lines, longs, table
from evspark.plans.catalog_b import THROTTLE_SQL, guarded, shared_uris
from evspark.sources.demo import demo
from evspark.sources.scratch import cut_lineage, shared_folder, written
from evspark.streaming import results

QUERIES, ORACLES = {}, {}


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Questions to excerpts: BM25 hits, route, lexical filter, sections, chunks, scores, budgets."""
    questions, pairs = demo(spark, d, "questions"), demo(spark, d, "av_pairs")
    asked = with_profile(questions.select("question_id", "question"), "question")
    routed = route.route(asked).where(F.col("top_k_per_doc") > 0)
    settings = routed.select("question_id", "rule_hit", "doc_filter_min_keep", "top_k_per_doc", "per_doc_budget", "global_budget")
    docs = demo(spark, d, "candidates").drop("question_id", "idx")
    hits = retrieve.bm25_topk(routed.select("question_id", "question"), docs, 16)
    found = hits.select("question_id", "doc_id", (F.col("rank") - 1).alias("idx")).join(docs, "doc_id").join(settings, "question_id")
    full = docfilter.lexical_fallback(docfilter.lexical_score(found, pairs)).where(F.col("fallback_label") == "full")
    full = written(full.select("question_id", "doc_id", F.col("idx").alias("doc_index")))  # at most k rows a question, and Spark knows how few
    wanted = lines(spark, d).join(full.select("doc_id").distinct(), "doc_id", "left_semi")
    pieces = C.chunk(C.sectionize(wanted)).join(full, "doc_id")
    scored = C.score_chunks(pieces, C.query_terms(questions, pairs)).join(settings.drop("rule_hit", "doc_filter_min_keep"), "question_id")
    got = C.global_budget_select(C.topk_under_budget(scored))
    return got.select("question_id", "excerpt_no", "doc_index", "doc_id", "section", "page", "chunk_no", "tokens", "score", "text")


def latest_events(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, upserted by a stream over written events."""
    out = shared_folder(spark, "results")
    given = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("ord"), "event_type")
    given.write.parquet(f"{out}-in")
    rows = spark.readStream.schema(given.schema).parquet(f"{out}-in")
    results.stream_results_upsert(rows, out, ["k"], f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return results.read_results(spark, out, ["k"], given.schema)


def streamed_throttle(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that arrive in three lots of questions, each judged by what was known when it came."""
    out = shared_folder(spark, "throttle")
    docs = shared_uris(guarded(spark, d)).select("question_id", "idx", "doc_id", "uri", "final_label", "gated", "doc_filter_min_keep")
    docs = cut_lineage(docs)
    low, high = docs.agg(F.min("question_id"), F.max("question_id")).first()
    session = results.state_session(spark)
    for lot in range(3):
        arrived = F.floor((F.col("question_id") - low) * 3 / (high - low + 1)) == lot
        docs.where(arrived).write.mode("append").parquet(f"{out}/in")
        rows = session.readStream.schema(docs.schema).parquet(f"{out}/in")
        results.stream_reuse_throttle(rows, f"{out}/rows", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("question_id", "doc_id", "throttled")


QUERIES["flagship_evidence"] = lambda spark, d: longs(evidence(spark, d))
QUERIES["ev78_stream_reuse_throttle"] = lambda spark, d: longs(streamed_throttle(spark, d))
QUERIES["ev79_stream_results_upsert"] = lambda spark, d: longs(latest_events(spark, d))
ORACLES["ev79_stream_results_upsert"] = "SELECT user_id AS k, event_id AS ord, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
ORACLES["ev78_stream_reuse_throttle"] = THROTTLE_SQL
