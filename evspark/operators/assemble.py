"""Contexts, blocks of documents and reference lines as ordered string aggregation.

Null and empty parts of a block are left out or have the default that a function states; order is by the given
places, and of equal places by the text; a question without rows has no block; an empty table gives no rows.
Names that begin with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _joined(order, line, sep: str):
    """Lines of a group in order, joined; null lines vanish."""
    rows = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(*order, line.alias("__line")))))
    return F.array_join(F.transform(rows, lambda x: x["__line"]), sep)


# Fixed values in the two blocks below: the frames of documents, sections and notes.


def documents_block(docs: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(question_id, block, n_docs, n_excerpts, n_chars, n_lines): full documents, then abstracts.

    ``docs`` has question_id, idx, doc_id, title, abstract, uri, final_label, download_status;
    ``excerpts`` question_id, doc_id, page, excerpt_no, section, text.
    """
    kept = docs.where(F.col("final_label").isin("full", "abstract")).withColumn("__later", (F.col("final_label") != "full").cast("int"))
    kept = kept.withColumn("number", F.row_number().over(W.partitionBy("question_id").orderBy("__later", "idx")))
    part = F.concat(F.lit("\n<<< Section: "), F.coalesce("section", F.lit("unknown")), F.lit(" | p. "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(" >>>\n"), F.coalesce("text", F.lit("")))
    by_doc = excerpts.groupBy("question_id", "doc_id").agg(_joined([F.col("page"), F.col("excerpt_no")], part, "\n").alias("__body"), F.count(F.lit(1)).alias("__n"))
    joined = kept.join(by_doc, ["question_id", "doc_id"], "left")
    full = F.col("final_label") == "full"
    failed = F.coalesce(F.col("download_status").isin("already_failed", "failed"), F.lit(False))
    suffix = F.when(full, "").when(failed, " [abstract only: no full text]").otherwise(" (abstract)")
    title = F.coalesce("title", F.concat(F.lit("Document "), F.col("number").cast("string")))
    head = F.concat(F.lit("\n=== Document ["), F.col("number").cast("string"), F.lit("]: "), title, suffix, F.lit(" ==="))
    abstract = F.when(F.coalesce("abstract", F.lit("")) != "", F.col("abstract"))
    note = F.when(abstract.isNotNull(), F.concat(F.lit("\n[abstract only: no excerpt]\n"), abstract))
    body = F.when(full, F.coalesce("__body", note)).otherwise(abstract)
    uri = F.when(F.coalesce("uri", F.lit("")) != "", F.concat(F.lit("URI: "), F.col("uri")))
    got = joined.withColumn("__text", F.concat_ws("\n", head, uri, body))
    out = got.groupBy("question_id").agg(
        _joined([F.col("number")], F.col("__text"), "\n").alias("block"),
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum(F.when(full, F.col("__n"))), F.lit(0)).alias("n_excerpts"),
    )
    return out.withColumns({"n_chars": F.length("block"), "n_lines": F.size(F.split("block", "\n", -1))})


def cited_block(docs: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(question_id, block): documents with authors and excerpts, full ones first, and a list of references at the end.

    ``docs`` has question_id, idx, title, abstract, uri, year, authors (array) and final_label; ``excerpts``
    question_id, doc_index (number among the full ones), page, excerpt_no, section, text. Missing titles and
    authors have a default; a question without kept documents has no row.
    """
    kept = docs.where(F.col("final_label").isin("full", "abstract")).withColumn("__later", (F.col("final_label") != "full").cast("int"))
    kept = kept.withColumn("number", F.row_number().over(W.partitionBy("question_id").orderBy("__later", "idx")))
    piece = F.concat(F.lit("  <<< Section: "), F.coalesce("section", F.lit("unknown")), F.lit(" | p. "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(" >>>\n  "), F.coalesce("text", F.lit("")))
    found = excerpts.groupBy("question_id", F.col("doc_index").alias("number")).agg(_joined([F.col("page"), F.col("excerpt_no")], piece, "\n").alias("__found"))
    given = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other))
    names = F.when(F.size("authors") > 2, F.concat(F.get("authors", F.lit(0)), F.lit(" et al."))).when(F.size("authors") > 0, F.array_join("authors", ", "))
    n, uri, title = F.col("number").cast("string"), given("uri", ""), given("title", "Unknown")
    got = kept.join(found, ["question_id", "number"], "left").withColumn("__names", names)
    head = F.concat(F.lit("=== Document ["), n, F.lit(']: "'), title, F.lit('" ==='))
    by = F.concat(F.lit("Authors: "), F.coalesce("__names", F.lit("")), F.lit(" ("), given("year", ""), F.lit(")"), F.when(uri != "", F.concat(F.lit(" | "), uri)).otherwise(""))
    body = F.when((F.col("final_label") == "full") & F.col("__found").isNotNull(), F.concat(F.lit("Full-text excerpts:\n"), F.col("__found")))
    text = F.concat_ws("\n", head, by, F.concat(F.lit("Abstract: "), F.coalesce("abstract", F.lit(""))), F.coalesce(body, F.lit("(Abstract only)")), F.lit(""))
    line = F.concat(F.lit("["), n, F.lit("] "), F.coalesce("__names", F.lit("Unknown")), F.lit(" ("), given("year", "n.d."), F.lit("). "), title, F.when(uri != "", F.concat(F.lit(". "), uri)).otherwise(""))
    got = got.withColumns({"__text": text, "__line": line})
    blocks = got.groupBy("question_id").agg(_joined([F.col("number")], F.col("__text"), "\n").alias("__a"), _joined([F.col("number")], F.col("__line"), "\n").alias("__b"))
    return blocks.select("question_id", F.concat(F.col("__a"), F.lit("\n\n[VALIDATED REFERENCES]\n"), F.col("__b")).alias("block"))


def context_views(assessments: DataFrame) -> DataFrame:
    """(question_id, full_view, slim_view, score_view) over the included assessments, best first as given by idx."""
    title = F.coalesce(F.when(F.trim("title") != "", F.trim("title")), F.lit("Untitled"))
    rel = F.format_number("relevance_score", 2)
    head = F.concat(F.lit("["), (F.col("idx") + 1).cast("string"), F.lit("] "), title)
    full = F.concat_ws("\n", head, F.concat(F.lit("relevance: "), rel), F.when(F.trim("abstract") != "", F.concat(F.lit("text: "), F.col("abstract"))), F.concat(F.lit("uri: "), F.col("uri")))
    slim = F.concat_ws("\n", head, F.concat(F.lit("text: "), F.substring("abstract", 1, 200)))
    score = F.concat(head, F.lit(": "), rel)
    rows = assessments.where("include")
    order = [F.col("idx")]
    return rows.groupBy("question_id").agg(_joined(order, full, "\n\n").alias("full_view"), _joined(order, slim, "\n\n").alias("slim_view"), _joined(order, score, "\n").alias("score_view"))


#: Fixed value: what stands for an empty title in a citation.
NO_TITLE = "[No title \u2014 see URI]"


def reference_lines(works: DataFrame) -> DataFrame:
    """Adds reference ([n] authors (year). title. uri, without the last part where there is no address) and cited (one author, starred title)."""
    none = F.coalesce(F.size("authors"), F.lit(0)) <= 0
    names = F.when(none, "Unknown").when(F.size("authors") > 2, F.concat(F.get("authors", F.lit(0)), F.lit(" et al."))).otherwise(F.array_join("authors", ", "))
    n = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "))
    year = F.coalesce(F.col("year").cast("string"), F.lit("n.d."))
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("[No title]"))
    first = F.coalesce(F.get("authors", F.lit(0)), F.lit("No author"))
    named = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit(NO_TITLE))
    return works.withColumns(
        {
            "reference": F.concat(n, names, F.lit(" ("), year, F.lit("). "), title, F.when(F.col("uri") != "", F.concat(F.lit(". "), F.col("uri"))).otherwise("")),
            "cited": F.concat(n, first, F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("No year")), F.lit("). *"), named, F.lit("*. "), F.coalesce("uri", F.lit("")), F.lit(".")),
        }
    )


def relevance_view(assessments: DataFrame) -> DataFrame:
    """Included assessments with their rank by relevance."""
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("relevance_score"), "idx"))
    return assessments.where("include").withColumn("rank", rank)


def fallback_context(contexts: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, context, status): the enriched context, else the abstracts, else an error."""
    lines = docs.groupBy("question_id").agg(_joined([F.col("idx")], F.when(F.trim("abstract") != "", F.col("abstract")), "\n\n").alias("__abstracts"))
    joined = contexts.join(lines, "question_id", "left")
    own, other = F.nullif(F.trim("enriched"), F.lit("")), F.nullif(F.col("__abstracts"), F.lit(""))
    status = F.when(own.isNotNull(), "enriched").when(other.isNotNull(), "abstracts").otherwise("error")
    return joined.select("question_id", F.when(own.isNotNull(), F.col("enriched")).otherwise(other).alias("context"), status.alias("status"))


def doc_key():
    return F.coalesce(F.nullif(F.col("uri"), F.lit("")), F.nullif(F.col("doc_id").cast("string"), F.lit("")), F.col("title"))


def alignment_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """(question_id, n_before, n_after, first_difference, aligned): do both have the same documents in order?

    Positions count from 0; a difference of length shows as the first place that only one side has.
    """
    a = before.select("question_id", "position", doc_key().alias("a"))
    b = after.select("question_id", "position", doc_key().alias("b"))
    both = a.join(b, ["question_id", "position"], "full")
    got = both.groupBy("question_id").agg(F.count("a").alias("n_before"), F.count("b").alias("n_after"), F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("position"))).alias("first_difference"))
    return got.withColumn("aligned", F.col("first_difference").isNull())
