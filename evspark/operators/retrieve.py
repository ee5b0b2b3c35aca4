"""Ranked retrieval, graph expansion and similarity over tables keyed by question.

Null texts count as empty, ids are taken as given (null ids meet nothing), other columns are ignored, and an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evspark.functions.text import tokens, word_counts
from evspark.sources.scratch import cut_lineage, written

K1, B = 1.2, 0.75


def postings(queries: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((question_id, term) of the queries, (term, doc_id, part, df) of the documents that have a query term).

    ``part`` is what a term adds to a document's score, over title and abstract, each by its own statistics; ``df`` is in how
    many documents the term is, in the field in which it is more common.
    """
    terms = queries.select("question_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    mark = F.lit("")  # stands once in each field, so that one pass over the texts gives sizes as well
    wanted = written(terms.select("term").union(terms.sparkSession.range(1).select(mark.alias("term"))).distinct())
    title, abstract = (F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("title", "abstract"))
    fields = docs.select("doc_id", F.explode(F.array(title, abstract)).alias("f")).select("doc_id", "f.field", tokens(F.col("f.text")).alias("words"))
    found = word_counts(fields.withColumn("words", F.array_append("words", mark)), "words").join(wanted, "term")
    found = found.select("term", "field", "doc_id", (F.col("len") - 1).alias("len"), "c").groupBy("term", "field", "doc_id", "len").agg(F.sum("c").alias("tf"))
    found = written(found)
    marks, found = found.where(F.col("term") == ""), found.where(F.col("term") != "")
    size = marks.groupBy("field").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("len")) / F.sum("tf")).alias("avg_len"))
    df = written(found.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df")))  # a row for each query term and field: Spark knows how small
    weighted = found.join(df, ["term", "field"]).join(F.broadcast(size), "field")  # two fields
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    one = weighted.withColumn("part", part).select("term", "doc_id", "part", "df").repartition("doc_id")  # serves the blocks as well
    return terms, one.groupBy("term", "doc_id").agg(F.sum("part").alias("part"), F.max("df").alias("df"))


def block_postings(parts: DataFrame, size: int) -> DataFrame:
    """(block, term, list, most, docs): the documents of a block that have a term, with their parts, and the greatest part.

    A document goes to a block of the term that is common and yet weighs most in it (its part times its documents), so that
    documents of one language or subject meet and the greatest parts of a block say much about all of it; a word of all
    documents weighs next to nothing. Such a term has as many blocks as make ``size`` documents each at most, on average.
    """
    common = (F.col("df") >= size / 2).alias("common")  # else blocks would be many and small
    weight = F.when(common, F.col("part") * F.col("df")).otherwise(F.col("df")).alias("weight")
    home = F.max(F.struct(common, weight, "term", "df")).alias("home")
    per_doc = parts.groupBy("doc_id").agg(home, F.collect_list(F.struct("term", "part")).alias("own"))
    number = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("home.df") / size))
    dealt = per_doc.select(F.concat_ws(" ", "home.term", number).alias("block"), "doc_id", "own").repartition("block")  # a row for each document
    dealt = dealt.select("block", "doc_id", F.inline("own"))
    lists = dealt.groupBy("block", "term").agg(F.collect_list(F.struct("doc_id", "part")).alias("list"), F.max("part").alias("most"))
    return lists.withColumn("docs", F.max(F.size("list")).over(W.partitionBy("block")))  # all of a block have its term


def block_scores(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(question_id, doc_id, score) of all documents of the blocks (question_id, block, terms) that have one of the terms."""
    asked = blocks.select("question_id", F.col("block").alias("at"), "terms")
    met = index.select("block", "term", "list").join(asked, (F.col("block") == F.col("at")) & F.array_contains("terms", F.col("term")))
    one = met.select("question_id", "block", F.inline("list"))  # lists of a block go to one place once, not once for each question
    return one.groupBy("question_id", "block", "doc_id").agg(F.sum("part").alias("score")).drop("block")


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 16, lead: int = 8, size: int = 1024) -> DataFrame:
    """(question_id, doc_id, score, rank): documents whose title or abstract has a query token, best first.

    Each field is scored by its own statistics and the scores add up. Documents meet only the terms of the queries, and
    only as blocks: a question's terms meet the heads of the blocks that have them, and the sum of their greatest parts
    bounds every score in the block. The blocks of the greatest bounds, with about ``lead`` times k documents, are scored in
    full; the k-th best of these scores is a threshold that every result reaches. Of the other blocks only those whose bound
    reaches it are scored. The result is that of scoring everything. Ties go to the smaller id; rows that repeat an id count
    as one longer document in each term; questions without a token have no rows.
    """
    terms, parts = postings(queries, docs)
    index = written(block_postings(parts, size))
    of = W.partitionBy("question_id")
    met = terms.join(index.select("term", "block", "most", "docs"), "term").groupBy("question_id", "block")
    bounds = met.agg(F.sum("most").alias("bound"), F.max("docs").alias("docs"), F.collect_list("term").alias("terms"))
    before = F.sum("docs").over(of.orderBy(F.desc("bound"), "block").rowsBetween(W.unboundedPreceding, -1))
    bounds = written(bounds.withColumn("leads", F.coalesce(before, F.lit(0)) < lead * k))
    place = F.row_number().over(of.orderBy(F.desc("score"), "doc_id"))
    first = block_scores(bounds.where("leads"), index).withColumn("place", place).where(F.col("place") <= k)
    first = cut_lineage(first)  # at most k rows for each question
    threshold = first.where(F.col("place") == k).select("question_id", F.col("score").alias("least"))
    open_ = bounds.where(~F.col("leads")).join(threshold, "question_id", "left")
    open_ = open_.where(F.col("bound") + 1e-5 >= F.coalesce("least", F.lit(0.0)))
    scored = first.drop("place").unionByName(block_scores(open_, index)).withColumn("score", F.round("score", 6))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def kg_expand(hits: DataFrame, docs: DataFrame, keywords: DataFrame, edges: DataFrame, *, phi: int = 3, psi: int = 2, theta: float = 0.3, exclude_self: bool = False) -> DataFrame:
    """Keywords of each hit and further documents of each keyword, with scores.

    Only edges of at least ``theta`` count. A document keeps its ``phi`` best keywords; a keyword
    has its ``psi`` best documents with title and abstract, ranked once per keyword before any join.
    A hit may be among its own secondary documents unless ``exclude_self``. Ties go to the smaller id.
    """
    strong = edges.where(F.col("score") >= theta)
    first = hits.select("question_id", "doc_id").join(strong, "doc_id")
    first = first.withColumn("rank", F.row_number().over(W.partitionBy("question_id", "doc_id").orderBy(F.desc("score"), "keyword_id"))).where(F.col("rank") <= phi)
    full = docs.where(F.col("title").isNotNull() & F.col("abstract").isNotNull()).select("doc_id")
    per_keyword = W.partitionBy("keyword_id").orderBy(F.desc("score"), "doc_id")
    second = strong.join(full, "doc_id").withColumn("place", F.row_number().over(per_keyword)).where(F.col("place") <= psi + bool(exclude_self))
    second = second.select("keyword_id", F.col("doc_id").alias("other_id"), F.col("score").alias("other_score"), "place")
    joined = first.withColumnRenamed("score", "keyword_score").join(keywords, "keyword_id").join(second, "keyword_id", "left")
    if exclude_self:
        joined = joined.where(F.col("other_id").isNull() | (F.col("other_id") != F.col("doc_id")))
        again = W.partitionBy("question_id", "doc_id", "keyword_id").orderBy("place")
        joined = joined.withColumn("place", F.row_number().over(again)).where(F.col("place") <= psi)
    other = F.when(F.col("other_id").isNotNull(), F.struct("place", F.col("other_id").alias("doc_id"), F.col("other_score").alias("score")))
    return joined.groupBy("question_id", "doc_id", "rank", "keyword_id", "name", "keyword_score").agg(F.array_sort(F.collect_list(other)).alias("secondary"))


def tfidf_cosine(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(question_id, idx, similarity) of each candidate to its question, to 3 places.

    The corpus of a question is its candidates and itself; every key has the question's id. A text
    without terms has norm 1, hence similarity 0.
    """
    text = F.concat_ws(" ", F.coalesce("abstract", F.lit("")), F.coalesce("title", F.lit("")))
    docs = candidates.select("question_id", "idx", tokens(text).alias("words"))
    own = questions.select("question_id", F.lit(-1).cast(candidates.schema["idx"].dataType).alias("idx"), tokens(F.col("question")).alias("words"))
    size = docs.select("question_id").unionAll(own.select("question_id")).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    size = written(size)  # its true size tells Spark how to join it
    tf = word_counts(docs.unionByName(own), "words").repartition("question_id", "term")  # the one shuffle of words, which both sides below read
    tf = tf.groupBy("question_id", "term", "idx", "len").agg(F.sum("c").alias("c"))
    df = tf.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("idx") == -1, F.col("c") / F.col("len"))).alias("q_tf"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    d = F.col("c") / F.col("len") * idf
    w = tf.join(df, ["question_id", "term"]).join(size, "question_id")
    per = w.groupBy("question_id", "idx").agg(F.sum(d * F.coalesce("q_tf", F.lit(0.0)) * idf).alias("dot"), F.sqrt(F.sum(d * d)).alias("norm"))
    per = written(per)  # one row for each text
    q = per.where(F.col("idx") == -1).select("question_id", F.col("norm").alias("q_norm"))
    out = docs.select("question_id", "idx").join(per, ["question_id", "idx"], "left").join(q, "question_id", "left")
    one = F.coalesce(F.col("dot") / (F.col("norm") * F.col("q_norm")), F.lit(0.0))
    return out.select("question_id", "idx", F.round(one, 3).alias("similarity"))
