"""Sections, chunks, chunk scores and selection under token budgets.

Null and empty lines and texts give no section and no chunk; ties go to the earlier place; an empty table gives no
rows. Selections carry other columns along; names that begin with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evspark.functions.terms import term_places
from evspark.functions.text import detect_heading, est_tokens, numeric_count, section_weight, tokens, unit_hits


def sectionize(lines: DataFrame) -> DataFrame:
    """(doc_id, section_no, heading, text, page_start, page_end) from lines of (doc_id, page, line_no, line).

    A heading opens a section and is no part of its text; lines before the first one are "unknown".
    """
    order = W.partitionBy("doc_id").orderBy("page", "line_no")
    marked = lines.withColumn("name", detect_heading(F.trim("line")))
    marked = marked.withColumn("section_no", F.sum(F.col("name").isNotNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    marked = marked.withColumn("next_page", F.lead("page").over(order))
    body = F.when(F.col("name").isNull() & (F.trim("line") != ""), F.struct("page", "line_no", F.trim("line").alias("line")))
    out = marked.groupBy("doc_id", "section_no").agg(
        F.max("name").alias("heading"),
        F.array_sort(F.collect_list(body)).alias("body"),
        F.min("page").alias("page_start"),
        F.max(F.coalesce("next_page", "page")).alias("page_end"),
    )
    text = F.array_join(F.transform("body", lambda b: b["line"]), " ")
    start = F.when(F.col("section_no") == 0, F.lit(1)).otherwise(F.col("page_start"))
    out = out.select("doc_id", "section_no", F.coalesce("heading", F.lit("unknown")).alias("heading"), text.alias("text"), start.alias("page_start"), "page_end")
    return out.where(F.col("text") != "")


def chunk(sections: DataFrame, target: int = 600, overlap: int = 60) -> DataFrame:
    """Chunks of whole sentences of about ``target`` tokens, each beginning with the tail of the last.

    A fold over the sentences' sizes, within the section's row, that keeps only where chunks begin and end; texts
    are cut once at the end. The tail is the longest run of closing sentences of at most ``overlap``
    tokens; a sentence over the target makes one long chunk. Null and empty sections give no chunk.
    """
    rows = sections.where(F.coalesce("text", F.lit("")) != "").select(
        "doc_id", "section_no", F.lower("heading").alias("section"), F.col("page_start").alias("page"), F.split("text", r"(?<=[.!?])\s+(?=[A-Z0-9])").alias("__s")
    )
    rows = rows.withColumn("__t", F.transform("__s", est_tokens))
    size, sizes = F.size("__t"), F.col("__t")

    def begin_of_tail(first: Column, at: Column) -> Column:
        """Where the sentences before ``at`` that fit the overlap begin, not before ``first``."""
        start = F.struct(at.alias("j"), F.lit(0).alias("n"), F.lit(True).alias("open"))
        back = F.when(at > first, F.reverse(F.slice(sizes, first + 1, at - first))).otherwise(F.array().cast("array<int>"))

        def step(a, t):
            fits = a["open"] & (a["n"] + t <= overlap)
            return F.struct(F.when(fits, a["j"] - 1).otherwise(a["j"]).alias("j"), F.when(fits, a["n"] + t).otherwise(a["n"]).alias("n"), fits.alias("open"))

        return F.aggregate(back, start, step, lambda a: F.struct(a["j"], a["n"]))

    kind = "array<struct<a:int,b:int>>"

    def add(acc, t):
        full = (acc["n"] + t > target) & (acc["i"] > acc["first"])
        tail = F.when(full, begin_of_tail(acc["first"], acc["i"])).otherwise(F.struct(acc["first"].alias("j"), acc["n"].alias("n")))
        done = F.when(full, F.concat(acc["done"], F.array(F.struct(acc["first"].alias("a"), acc["i"].alias("b"))))).otherwise(acc["done"])
        return F.struct(tail["j"].alias("first"), (tail["n"] + t).alias("n"), (acc["i"] + 1).alias("i"), done.alias("done"))

    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast(kind).alias("done"))
    spans = F.aggregate("__t", start, add, lambda a: F.concat(a["done"], F.array(F.struct(a["first"].alias("a"), a["i"].alias("b")))))
    cut = rows.withColumn("__c", spans).select("*", F.posexplode("__c").alias("chunk_no", "c")).where(size > 0)
    piece = lambda col: F.slice(col, F.col("c.a") + 1, F.col("c.b") - F.col("c.a"))
    total = F.aggregate(piece("__t"), F.lit(0), lambda a, t: a + t)
    return cut.select("doc_id", "section_no", "chunk_no", "section", "page", F.trim(F.array_join(piece("__s"), " ")).alias("text"), total.alias("tokens"))


def query_terms(questions: DataFrame, av_pairs: DataFrame) -> DataFrame:
    """(question_id, keywords, literals) in order of first occurrence."""
    fields = F.array("attribute", "value", "description")
    per = av_pairs.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", fields.alias("f")))).alias("pairs"))
    flat = F.filter(F.flatten(F.transform("pairs", lambda p: p["f"])), lambda x: x.isNotNull())
    joined = questions.select("question_id", "question").join(per, "question_id", "left")
    flat = F.coalesce(flat, F.array().cast("array<string>"))
    words = F.concat(tokens(F.col("question")), F.flatten(F.transform(flat, tokens)))
    short = F.filter(F.transform(flat, lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= 40))
    return joined.select(
        "question_id",
        F.filter(F.array_distinct(words), lambda w: F.length(w) >= 3).alias("keywords"),
        F.array_distinct(F.transform(short, lambda x: F.lower(x))).alias("literals"),
    )


def score_chunks(chunks: DataFrame, terms: DataFrame, *, many_terms: bool = False) -> DataFrame:
    """Adds score to chunks that carry question_id; ``terms`` holds one row for each question.

    With ``many_terms`` a question's literals are found by one automaton, in one reading of each chunk.
    """
    low = F.lower("text")
    found = F.size(F.filter("literals", lambda x: F.instr(low, x) > 0))
    if many_terms:
        chunks = term_places(chunks, "question_id", low, terms.select("question_id", F.col("literals").alias("terms")), "__found")
        found, terms = F.size("__found"), terms.withColumn("literals", F.array().cast("array<string>"))
    joined = chunks.join(terms, "question_id")
    words = tokens(F.col("text"))
    hits = F.size(F.array_intersect("keywords", words)) / (F.sqrt(F.size("keywords").cast("double")) + 1e-6)
    literal = 0.25 * found
    numbers = F.least(F.lit(0.6), 0.05 * numeric_count(F.col("text")))
    units = F.least(F.lit(0.3), 0.05 * unit_hits(F.col("text")))
    score = F.when(F.size(words) == 0, 0.0).otherwise((hits + literal + numbers + units) * section_weight(F.col("section")))
    return joined.withColumn("score", score).drop("keywords", "literals", "__found")


def _fold(rows: Column, budget: Column, most: Column) -> Column:
    """Rows taken in order; one that would pass the budget is skipped, not the end."""
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).alias("n"))

    def step(a, x):
        fits = (a["n"] + x["tokens"] <= budget) & (F.size(a["kept"]) < most)
        return F.struct(
            F.when(fits, F.concat(a["kept"], F.array(x["place"]))).otherwise(a["kept"]).alias("kept"), F.when(fits, a["n"] + x["tokens"]).otherwise(a["n"]).alias("n")
        )

    return F.aggregate(rows, start, step)["kept"]


def _selected(head: DataFrame, by: list[str], budget: str, most: Column) -> DataFrame:
    """The rows of each group that the fold keeps, in one pass: rows travel in the group's array."""
    rest = [c for c in head.columns if c not in by]
    rows = F.array_sort(F.collect_list(F.struct("place", *[c for c in rest if c != "place"]))).alias("rows")
    grouped = head.groupBy(*by).agg(rows, F.first(budget).alias("__b"), F.first(most).alias("__k"))
    sizes = F.transform("rows", lambda r: F.struct(r["place"].alias("place"), r["tokens"].cast("int").alias("tokens")))
    grouped = grouped.withColumn("__kept", _fold(sizes, F.col("__b"), F.coalesce(F.col("__k"), F.size("rows"))))
    return grouped.select(*by, F.explode(F.filter("rows", lambda r: F.array_contains("__kept", r["place"]))).alias("r")).select(*by, "r.*").select(*head.columns)


def topk_under_budget(scored: DataFrame, budget: str = "per_doc_budget", top_k: str = "top_k_per_doc") -> DataFrame:
    """Per question and document the best chunks under a token budget, of the first three times top_k.

    Ties go to the earlier chunk; a chunk that would pass the budget is skipped; an empty table gives no rows.
    """
    by = ["question_id", "doc_id"]
    order = W.partitionBy(*by).orderBy(F.desc("score"), "section_no", "chunk_no")
    head = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 3 * F.col(top_k))
    return _selected(head, by, budget, F.col(top_k)).drop("place")


def global_budget_select(kept: DataFrame, budget: str = "global_budget") -> DataFrame:
    """Per question the best of the kept chunks under a token budget, ordered by document and page."""
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "doc_index", "section_no", "chunk_no")
    got = _selected(kept.withColumn("place", F.row_number().over(order)), ["question_id"], budget, F.lit(None).cast("int"))
    out = W.partitionBy("question_id").orderBy("doc_index", "page", "place")
    return got.withColumn("excerpt_no", F.row_number().over(out)).withColumn("score", F.bround("score", 3)).drop("place")


#: States of a fetch that mean no access.
NO_ACCESS = ("already_failed", "pdf_download_failed", "no_oa_pdf")


def document_excerpts(docs: DataFrame, chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """Per question and document of ``docs``: status, its bucket, chunks, and those kept under the document's budget with their tokens.

    ``docs`` has question_id, doc_id and status (null: unknown); documents without chunks count none.
    """
    by = ["question_id", "doc_id"]
    n = chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("n_chunks"))
    own = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("kept"), F.sum("tokens").alias("kept_tokens"))
    got = docs.select(*by, F.coalesce("status", F.lit("unknown")).alias("status")).join(n, by, "left").join(own, by, "left").na.fill(0, ["n_chunks", "kept", "kept_tokens"])
    return got.withColumn("bucket", F.when(F.col("status") == "ok", "ok").when(F.col("status").isin(*NO_ACCESS), "paywalled").otherwise("other"))


def excerpt_stats(per_doc: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Per question: documents, those with kept chunks, excerpts and their tokens, buckets of status, and whether
    less than half of the documents have chunks. ``per_doc`` comes from ``document_excerpts``."""
    docs = per_doc.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("kept") > 0).alias("docs_with_chunks"),
        *[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in ("ok", "paywalled", "other")],
    )
    kept = excerpts.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_excerpts"), F.sum("tokens").alias("total_tokens"))
    got = docs.join(kept, "question_id", "left").na.fill(0)
    return got.withColumn("low_coverage", F.col("docs_with_chunks") < 0.5 * F.col("n_docs"))
