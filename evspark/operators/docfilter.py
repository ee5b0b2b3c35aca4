"""Filtering and ordering of candidate documents before evidence is read.

Rows carry all other columns along; names that begin with two underscores are reserved, and columns that a
function adds replace those of the same name. Null titles, abstracts and states count as empty, null labels as
missing; repeated rows are counted one by one; an empty table gives no rows. Functions that rank or count the documents of a
question take ``spread``: a question then is no task of its own, for tables in which some have a large share of all rows;
its documents have different idx. Functions that look up a question's terms in texts take ``many_terms``: then one automaton for
each question finds them all in one reading, for lists of hundreds of terms and more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evspark.functions.terms import term_places
from evspark.functions.text import any_contains, tokens
from evspark.operators.running import ranked, with_totals

#: Fixed values.
RETRACTION_TOKENS = ("retracted", "retraction", "retraction notice", "withdrawn", "expression of concern")
RETRACTION_TOPICS = ("retract", "withdrawn", "expression of concern")
ADVERSE_WORDS = ("inexplicable", "implausible", "no evidence", "absence of", "refutes", "unlikely", "challenges", "contradicts")
QUESTION_STOP_WORDS = (
    "what which where when does this that with from have been their there about over into under between through during earth these those "
    "other such more also both each than then"
).split()
GENEROUS_TIERS = ("tier-3", "tier-2a", "safety-tier3")
BY_DOC = ("question_id", "idx")


def is_retracted(title: Column, status: Column) -> Column:
    low, state = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(status, F.lit("")))
    pattern = r"(^|[\s:\-])(" + "|".join(RETRACTION_TOKENS) + ")"
    return low.rlike(pattern) | any_contains(state, RETRACTION_TOKENS)


def drop_retracted(docs: DataFrame, questions: DataFrame, *, gated: bool = True) -> DataFrame:
    """Candidates without retracted ones; a question about retraction keeps all of its own.

    With ``gated``, only questions whose candidates outnumber doc_filter_min_keep are checked.
    """
    about = any_contains(F.lower("question"), RETRACTION_TOPICS).alias("__about")
    extra = [F.col("doc_filter_min_keep").alias("__least")] if gated else []
    joined = docs.join(questions.select("question_id", about, *extra), "question_id")
    skip = F.col("__about")
    if gated:
        skip = skip | (F.count(F.lit(1)).over(W.partitionBy("question_id")) <= F.col("__least"))
    joined = joined.withColumn("__keep", skip | ~is_retracted(F.col("title"), F.col("status")))
    return joined.where("__keep").select(*docs.columns)


def title_flags(docs: DataFrame, questions: DataFrame, av_pairs: DataFrame, *, many_terms: bool = False) -> DataFrame:
    """Adds title_match, retain_adversarial and question_term_match to the candidates."""
    pair = av_pairs.where(F.col("centrality") >= 0.5).groupBy("question_id").agg(F.collect_set(F.lower(F.trim("value"))).alias("v"), F.collect_set(F.lower(F.trim("attribute"))).alias("a"))
    names = F.filter(F.array_union(F.coalesce("v", F.array().cast("array<string>")), F.coalesce("a", F.array().cast("array<string>"))), lambda x: F.length(x) >= 4)
    content = F.filter(
        F.regexp_extract_all(F.lower("question"), F.lit("[a-z]{5,}"), F.lit(0)), lambda w: ~w.isin(QUESTION_STOP_WORDS)
    )
    per = questions.select("question_id", content.alias("__words")).join(pair, "question_id", "left").select("question_id", "__words", names.alias("__names"))
    title = F.lower(F.coalesce("title", F.lit("")))
    match, joined = F.exists("__names", lambda n: title.contains(n)), docs.join(per, "question_id")
    if many_terms:
        found = term_places(docs, "question_id", title, per.select("question_id", F.col("__names").alias("terms")), "__found")
        match, joined = F.size("__found") > 0, found.join(per.select("question_id", "__words"), "question_id")
    got = joined.withColumns(
        {
            "title_match": match,
            "retain_adversarial": any_contains(title, ADVERSE_WORDS),
            "question_term_match": F.size(F.filter("__words", lambda w: title.contains(w))) >= 2,
        }
    )
    return got.drop("__names", "__words", "__found")


def lexical_score(docs: DataFrame, av_pairs: DataFrame, *, spread: bool = False, many_terms: bool = False) -> DataFrame:
    """Adds lexical (terms of the pairs in the text, literals counted by half each) and its rank."""
    f = F.array("attribute", "value", "description")
    per = av_pairs.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", f.alias("f")))).alias("p"))
    flat = F.filter(F.flatten(F.transform("p", lambda p: p["f"])), lambda x: x.isNotNull())
    words = F.filter(F.array_distinct(F.flatten(F.transform(flat, tokens))), lambda w: F.length(w) >= 3)
    literals = F.transform(F.filter(F.transform(flat, lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= 40)), lambda x: F.lower(x))
    per = per.select("question_id", words.alias("__w"), literals.alias("__l"))
    text = F.lower(F.concat_ws(" ", F.coalesce("abstract", F.lit("")), F.coalesce("title", F.lit(""))))
    none = F.array().cast("array<string>")
    low = F.col("__low")  # a column of its own, so that it is made once a row and not once a literal
    lit = F.size(F.filter(F.coalesce("__l", none), lambda x: F.instr(low, x) > 0))
    if many_terms:
        docs = term_places(docs, "question_id", text, per.select("question_id", F.col("__l").alias("terms")), "__found")
        per, lit = per.withColumn("__l", none), F.size("__found")
    joined = docs.join(per, "question_id", "left").withColumn("__low", text)
    hits = F.size(F.array_intersect(F.coalesce("__w", none), tokens(low)))
    got = joined.withColumn("lexical", hits + 0.5 * lit).drop("__w", "__l", "__low", "__found")
    return ranked(got, ["question_id"], [F.desc("lexical"), "idx"], "lexical_rank", spread=spread)


def filter_gate(docs: DataFrame, *, spread: bool = False) -> DataFrame:
    """Adds n_docs and gated: whether there are more documents than must be kept."""
    counted = with_totals(docs, ["question_id"], {"n_docs": F.count(F.lit(1))}, spread=spread)
    return counted.withColumn("gated", F.col("n_docs") > F.col("doc_filter_min_keep"))


def lexical_fallback(docs: DataFrame, *, spread: bool = False) -> DataFrame:
    """Adds fallback_label from the lexical rank: the first few full, then abstract, then drop."""
    counted = with_totals(docs, ["question_id"], {"__n": F.count(F.lit(1))}, spread=spread)
    return counted.withColumn("fallback_label", _fallback_label()).drop("__n")


def _least_full() -> Column:
    return F.when(F.col("rule_hit").isin("tier-1", "tier-1-def"), 2).otherwise(3)


def _least() -> Column:
    return F.greatest("doc_filter_min_keep", F.floor(F.col("__n") / 3))


def _fallback_label() -> Column:
    return F.when(F.col("lexical_rank") <= _least_full(), "full").when(F.col("lexical_rank") <= _least(), "abstract").otherwise("drop")


def classify_guardrail(docs: DataFrame, *, spread: bool = False) -> DataFrame:
    """Final label of each candidate from the given ones, within limits.

    Needs label, similarity, lexical_rank, rule_hit and doc_filter_min_keep. Too few full documents,
    a missing label or still too few in all: the lexical fallback. Too few in all: the best dropped
    ones by similarity become abstract, at most 3 in generous tiers and 2 elsewhere.
    """
    known = F.when(F.col("label").isin("full", "abstract", "drop"), F.col("label")).when(F.col("label").isNotNull(), "abstract")
    totals = {
        "__n": F.count(F.lit(1)),
        "__full": F.count_if(F.col("__given") == "full"),
        "__kept": F.count_if(F.col("__given").isin("full", "abstract")),
        "__known": F.count("__given"),
    }
    got = with_totals(docs.withColumn("__given", known), ["question_id"], totals, spread=spread)
    got = ranked(got.withColumn("__class", F.coalesce("__given", F.lit(""))), ["question_id", "__class"], [F.desc("similarity"), "idx"], "__drop", spread=spread)
    cap = F.when(F.col("rule_hit").isin(*GENEROUS_TIERS), 3).otherwise(2)
    promoted = F.least(_least() - F.col("__kept"), cap, F.col("__n") - F.col("__kept"))
    few = (F.col("__full") < _least_full()) | (F.col("__kept") + F.greatest(promoted, F.lit(0)) < _least())
    lexical = (F.col("__known") < F.col("__n")) | few
    raised = (F.col("__given") == "drop") & (F.col("__drop") <= promoted)
    label = F.when(lexical, _fallback_label()).when(raised, "abstract").otherwise(F.col("__given"))
    got = got.withColumns({"fallback_label": _fallback_label(), "final_label": label, "used_fallback": lexical})
    return got.drop("__given", "__class", "__known", "__drop", *list(totals)[:3])


def abstracts_topup(docs: DataFrame, *, spread: bool = False) -> DataFrame:
    """In abstracts mode, makes the best dropped documents by lexical rank abstract up to the least number."""
    got = with_totals(docs, ["question_id"], {"__kept": F.count_if(F.col("final_label") != "drop")}, spread=spread)
    got = ranked(got, ["question_id", "final_label"], ["lexical_rank"], "__rank", spread=spread)
    rise = (F.col("evidence_mode") == "abstracts") & (F.col("final_label") == "drop") & (F.col("__rank") <= F.col("doc_filter_min_keep") - F.col("__kept"))
    return got.withColumn("final_label", F.when(rise, "abstract").otherwise(F.col("final_label"))).drop("__kept", "__rank")


def document_key() -> Column:
    """The address, or the id where there is none; null where both lack."""
    return F.coalesce(F.nullif(F.col("uri"), F.lit("")), F.nullif(F.col("doc_id").cast("string"), F.lit("")))


def first_uses(docs: DataFrame) -> DataFrame:
    """(doc_key, first_question) of full documents of filtered questions; documents without a key are left out."""
    used = docs.where((F.col("final_label") == "full") & F.col("gated")).select(document_key().alias("doc_key"), "question_id")
    return used.where(F.col("doc_key").isNotNull()).groupBy("doc_key").agg(F.min("question_id").alias("first_question"))


def reuse_throttle(docs: DataFrame, known: DataFrame | None = None, *, spread: bool = False) -> DataFrame:
    """Demotes, in document order, the surplus of full documents that earlier questions had in full.

    The surplus is what goes beyond doc_filter_min_keep + 2. Only filtered questions count as users. Documents
    are known by address, else by id; those with neither are never demoted. ``known`` holds first uses from
    before these rows; repeated documents of one question are demoted one by one.
    """
    first = first_uses(docs)
    if known is not None:
        first = first.unionByName(known).groupBy("doc_key").agg(F.min("first_question").alias("first_question"))
    got = docs.withColumn("__key", document_key()).join(first.withColumnRenamed("doc_key", "__key"), "__key", "left")
    return demote_reused(got.drop("__key"), spread=spread)


def demote_reused(docs: DataFrame, *, spread: bool = False) -> DataFrame:
    """Whole questions with first_question, the first that had each document in full, to rows with throttled and the new label."""
    full = F.col("final_label") == "full"
    got = with_totals(docs, ["question_id"], {"__full": F.count_if(full)}, spread=spread)
    seen = full & F.col("gated") & (F.col("first_question") < F.col("question_id"))
    got = ranked(got.withColumn("__seen", F.coalesce(seen, F.lit(False))), ["question_id", "__seen"], ["idx"], "__place", spread=spread)
    surplus = F.greatest(F.col("__full") - F.col("doc_filter_min_keep") - 2, F.lit(0))
    got = got.withColumn("throttled", F.col("__seen") & (F.col("__place") <= surplus))
    label = F.when(F.col("throttled"), "abstract").otherwise(F.col("final_label"))
    return got.withColumn("final_label", label).drop("first_question", "__seen", "__full", "__place")


def filter_summary(docs: DataFrame) -> DataFrame:
    """Counts and first titles (80 characters, in document order) by class, and flags of odd outcomes.

    Null titles are left out of the lists; a question without documents has no row.
    """
    classes = {"full": "full", "abstract": "abstract", "drop": "drop"}
    aggs = [F.count(F.lit(1)).alias("n_docs")]
    for name, label in classes.items():
        own = F.col("final_label") == label
        title = F.when(own, F.struct("idx", F.substring("title", 1, 80).alias("t")))
        aggs.append(F.count_if(own).alias(f"n_{name}"))
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(title)), lambda x: x["t"]), " | ").alias(f"{name}_titles"))
    got = docs.groupBy("question_id").agg(*aggs)
    return got.withColumns(
        {"high_drop": F.col("n_drop") > 0.5 * F.col("n_docs"), "all_full": F.col("n_full") == F.col("n_docs"), "none_kept": F.col("n_drop") == F.col("n_docs")}
    )


def ontology_select(av_pairs: DataFrame) -> DataFrame:
    """One pair per attribute, the most central (first on ties), with its order and class."""
    best = F.row_number().over(W.partitionBy("question_id", "attribute").orderBy(F.desc("centrality"), "pos"))
    got = av_pairs.withColumn("__best", best).where(F.col("__best") == 1).drop("__best")
    place = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("centrality"), "pos"))
    return got.withColumns({"place": place, "critical": F.col("centrality") >= 0.8, "contextual": F.col("centrality") >= 0.4})


def reorder_by_ontology(docs: DataFrame, av_pairs: DataFrame, *, spread: bool = False, many_terms: bool = False) -> DataFrame:
    """Adds position: documents with more critical attribute names in their text come first, else as they were."""
    names = av_pairs.where(F.col("centrality") >= 0.8).groupBy("question_id").agg(F.collect_set(F.lower("attribute")).alias("__names"))
    text = F.lower(F.concat_ws(" ", F.coalesce("abstract", F.lit("")), F.coalesce("title", F.lit(""))))
    if many_terms:
        found = term_places(docs, "question_id", text, names.withColumnRenamed("__names", "terms"), "__found")
        got = found.withColumn("attribute_hits", F.size("__found")).drop("__found")
    else:
        hits = F.coalesce(F.size(F.filter("__names", lambda n: F.instr(text, n) > 0)), F.lit(0))
        got = docs.join(names, "question_id", "left").withColumn("attribute_hits", hits).drop("__names")
    return ranked(got, ["question_id"], [F.desc("attribute_hits"), "idx"], "position", spread=spread)
