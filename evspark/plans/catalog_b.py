"""Queries on ingestion, filtering, assembly, citations and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evspark.operators import assemble, cite, docfilter, evaluate, ingest
from evspark.plans.catalog_a import PAIRS_SQL, TOKENS, longs, table
from evspark.plans.rules import CONFIG
from evspark.sources import files
from evspark.sources.demo import CRITERIA, demo, with_tables
from evspark.sources.scratch import cut_lineage, shared_folder

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: longs(f(spark, d))
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- filtering -------------------------------------------------------------------------------

TIERS = ("tier-1-def", "tier-2b", "tier-3", "tier-2a", "tier-m", "tier-1", "fallback")
_TIER = "CASE question_id % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TIERS)) + " END"
_LEAST = "CASE question_id % 7 WHEN 0 THEN 3 WHEN 2 THEN 7 ELSE 6 END"
_MODE = "CASE question_id % 7 WHEN 0 THEN 'abstracts' WHEN 5 THEN 'abstracts' WHEN 6 THEN 'abstracts' WHEN 2 THEN 'excerpts_full' ELSE 'excerpts_narrow' END"
assert {r[0]: r[6] for r in CONFIG}["tier-3"] == 7

CONTENT = "regexp_extract_all(lower(question), '[a-z]{{5,}}')"
LEX_SQL = f"""flt AS (SELECT question_id, flatten({PAIRS_SQL}) AS f FROM av_pairs GROUP BY 1),
lt AS (SELECT question_id, list_filter(list_distinct(flatten(list_transform(f, lambda x: {TOKENS.format('x')}))), lambda w: len(w) >= 3) AS w,
    list_transform(list_filter(list_transform(f, lambda x: trim(x)), lambda x: x <> '' AND len(x) <= 40), lambda x: lower(x)) AS l
  FROM flt),
lexed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY lexical DESC, idx) AS lexical_rank
  FROM (SELECT c.*, len(list_intersect(w, list_distinct({TOKENS.format("abstract || ' ' || title")}))) + 0.5 * len(list_filter(l,
    lambda x: contains(lower(abstract || ' ' || title), x))) AS lexical
  FROM candidates c JOIN lt USING (question_id))),
given AS (SELECT lexed.*, {_TIER} AS rule_hit, {_LEAST} AS doc_filter_min_keep, {_MODE} AS evidence_mode,
    CASE WHEN toxic = 1 THEN 'drop' WHEN quality = 1 THEN 'full' WHEN quality = 0 THEN 'abstract' ELSE 'drop' END AS label,
    (doc_id * 29 % 101) / 100.0 AS similarity
  FROM lexed LEFT JOIN labels USING (doc_id))"""
GUARD_SQL = LEX_SQL + """, g1 AS (SELECT *, count(*) OVER q AS n, count(*) FILTER (label = 'full') OVER q AS nf,
    count(*) FILTER (label <> 'drop') OVER q AS nk,
    CASE WHEN rule_hit IN ('tier-1', 'tier-1-def') THEN 2 ELSE 3 END AS lf, row_number() OVER (PARTITION BY question_id, label
    ORDER BY similarity DESC, idx) AS dr,
    CASE WHEN rule_hit IN ('tier-3', 'tier-2a', 'safety-tier3') THEN 3 ELSE 2 END AS cap
  FROM given WINDOW q AS (PARTITION BY question_id)),
g2 AS (SELECT *, greatest(doc_filter_min_keep, n // 3) AS least FROM g1), g3 AS (SELECT *, least(least - nk, cap, n - nk) AS promo FROM g2),
g4 AS (SELECT *, nf < lf OR nk + greatest(promo, 0) < least AS used_fallback,
    CASE WHEN lexical_rank <= lf THEN 'full' WHEN lexical_rank <= least THEN 'abstract' ELSE 'drop' END AS fallback_label
  FROM g3),
guarded AS (SELECT *, n > doc_filter_min_keep AS gated, n AS n_docs,
    CASE WHEN used_fallback THEN fallback_label WHEN label = 'drop' AND dr <= promo THEN 'abstract' ELSE label END AS final_label
  FROM g4)"""
PRE = with_tables("candidates", "av_pairs").rstrip() + ", "


def lexed(spark, d):
    return docfilter.lexical_score(demo(spark, d, "candidates"), demo(spark, d, "av_pairs"))


def given(spark, d):
    return with_labels(spark, d, lexed(spark, d))


def with_labels(spark, d, scored):
    got = scored.join(table(spark, d, "labels"), "doc_id", "left")
    label = F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "full").when(F.col("quality") == 0, "abstract").otherwise("drop")
    return got.withColumns({"rule_hit": F.expr(_TIER), "doc_filter_min_keep": F.expr(_LEAST), "evidence_mode": F.expr(_MODE), "label": label, "similarity": (F.col("doc_id") * 29 % 101) / F.lit(100.0)})


def guarded(spark, d):
    return docfilter.filter_gate(docfilter.classify_guardrail(given(spark, d)))


def judged(spark, d):
    """Ids and labels of the guarded candidates, written once; what needs texts joins them by id, so that none passes through the ranks."""
    return cut_lineage(guarded(spark, d).select("question_id", "idx", "doc_id", "final_label"))


def with_texts(spark, d, rows):
    return rows.join(demo(spark, d, "candidates").drop("question_id", "idx"), "doc_id")


_RET = "|".join(docfilter.RETRACTION_TOKENS)
RET_SQL = f"(regexp_matches(lower(title), '(^|[\\s:\\-])({_RET})') OR coalesce(regexp_matches(lower(status), '{_RET}'), false))"


@query("ev38_drop_retracted", with_tables("candidates") + f"""SELECT question_id, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS n
    FROM candidates)
  JOIN (SELECT item_id AS question_id, lower(text) AS q FROM benchmark) USING (question_id)
  WHERE n <= {_LEAST} OR contains(q, 'retract') OR contains(q, 'withdrawn') OR contains(q, 'expression of concern') OR NOT {RET_SQL}""")
def _(spark, d):
    asked = demo(spark, d, "questions").withColumn("doc_filter_min_keep", F.expr(_LEAST))
    return docfilter.drop_retracted(demo(spark, d, "candidates"), asked).select("question_id", "doc_id")


_ADV = " OR ".join(f"contains(lower(title), '{w}')" for w in docfilter.ADVERSE_WORDS)
_STOP = ", ".join(f"'{w}'" for w in docfilter.QUESTION_STOP_WORDS)


@query("ev40_title_flags", with_tables("candidates", "av_pairs", "questions").rstrip() + f""", p AS (SELECT question_id,
    list_distinct(list_concat(list(lower(trim(value))), list(lower(trim(attribute))))) AS names FROM av_pairs
  WHERE centrality >= 0.5 GROUP BY 1),
w AS (SELECT question_id, list_filter(regexp_extract_all(lower(question), '[a-z]{{5,}}'), lambda x: x NOT IN ({_STOP})) AS words FROM questions)
SELECT c.question_id, doc_id, len(list_filter(coalesce(names, []), lambda x: len(x) >= 4 AND contains(lower(title), x))) > 0 AS title_match,
    {_ADV} AS retain_adversarial, len(list_filter(words, lambda x: contains(lower(title), x))) >= 2 AS question_term_match
FROM candidates c JOIN w USING (question_id) LEFT JOIN p USING (question_id)""")
def _(spark, d):
    got = docfilter.title_flags(demo(spark, d, "candidates"), demo(spark, d, "questions"), demo(spark, d, "av_pairs"))
    return got.select("question_id", "doc_id", "title_match", "retain_adversarial", "question_term_match")


@query("ev41_lexical_score", PRE + LEX_SQL + " SELECT question_id, doc_id, CAST(lexical AS DOUBLE) AS lexical, lexical_rank FROM lexed")
def _(spark, d):
    return lexed(spark, d).select("question_id", "doc_id", F.col("lexical").cast("double").alias("lexical"), "lexical_rank")


@query("ev41_lexical_by_automaton", PRE + LEX_SQL + " SELECT question_id, doc_id, CAST(lexical AS DOUBLE) AS lexical, lexical_rank FROM lexed")
def _(spark, d):
    """As ev41, with one automaton for each question's literals."""
    got = docfilter.lexical_score(demo(spark, d, "candidates"), demo(spark, d, "av_pairs"), many_terms=True)
    return got.select("question_id", "doc_id", F.col("lexical").cast("double").alias("lexical"), "lexical_rank")


@query("ev42_classify_guardrail", PRE + GUARD_SQL + " SELECT question_id, doc_id, final_label, used_fallback FROM guarded")
def _(spark, d):
    return guarded(spark, d).select("question_id", "doc_id", "final_label", "used_fallback")


@query("ev42_guardrail_in_ranges", PRE + GUARD_SQL + " SELECT question_id, doc_id, final_label, used_fallback, lexical_rank FROM guarded")
def _(spark, d):
    """As ev42, with ranks and counts that give no question a task of its own."""
    scored = docfilter.lexical_score(demo(spark, d, "candidates"), demo(spark, d, "av_pairs"), spread=True)
    got = docfilter.classify_guardrail(with_labels(spark, d, scored), spread=True)
    return got.select("question_id", "doc_id", "final_label", "used_fallback", "lexical_rank")


@query("ev43_lexical_fallback", PRE + GUARD_SQL + " SELECT question_id, doc_id, fallback_label FROM guarded")
def _(spark, d):
    return docfilter.lexical_fallback(given(spark, d)).select("question_id", "doc_id", "fallback_label")


TOP_SQL = GUARD_SQL + """, topped AS (SELECT * EXCLUDE (final_label), CASE WHEN evidence_mode = 'abstracts' AND final_label = 'drop'
    AND r <= doc_filter_min_keep - k THEN 'abstract'
    ELSE final_label END AS final_label

  FROM (SELECT *, count(*) FILTER (final_label <> 'drop') OVER (PARTITION BY question_id) AS k, row_number() OVER (PARTITION BY question_id,
    final_label ORDER BY lexical_rank) AS r
  FROM guarded))"""


@query("ev44_abstracts_topup", PRE + TOP_SQL + " SELECT question_id, doc_id, final_label FROM topped")
def _(spark, d):
    return docfilter.abstracts_topup(guarded(spark, d)).select("question_id", "doc_id", "final_label")


@query("ev45_filter_gate", PRE + GUARD_SQL + " SELECT question_id, doc_id, n_docs, gated FROM guarded")
def _(spark, d):
    return guarded(spark, d).select("question_id", "doc_id", "n_docs", "gated")


def shared_uris(df):
    """Addresses that several documents share; some are null or empty."""
    shared = F.concat(F.lit("u"), (F.col("doc_id") % 97).cast("string"))
    return df.withColumn("uri", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 11 == 0, "").otherwise(shared))


THROTTLE_SQL = PRE + GUARD_SQL + """, u AS (SELECT *, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN CAST(doc_id AS VARCHAR)
    ELSE 'u' || (doc_id % 97) END AS u
  FROM guarded), f AS (SELECT *, min(question_id) FILTER (final_label = 'full' AND gated) OVER (PARTITION BY u) AS first,
    count(*) FILTER (final_label = 'full') OVER (PARTITION BY question_id) AS nfull
  FROM u),
s AS (SELECT *, final_label = 'full' AND gated AND first < question_id AS seen
  FROM f), t AS (SELECT *, row_number() OVER (PARTITION BY question_id, seen ORDER BY idx) AS place FROM s)
SELECT question_id, doc_id, coalesce(seen AND place <= CASE WHEN nfull > doc_filter_min_keep + 2 THEN nfull - doc_filter_min_keep - 2 ELSE 0 END,
    false) AS throttled
  FROM t"""


@query("ev46_reuse_throttle", THROTTLE_SQL)
def _(spark, d):
    return docfilter.reuse_throttle(shared_uris(guarded(spark, d))).select("question_id", "doc_id", F.coalesce("throttled", F.lit(False)).alias("throttled"))


@query("ev47_filter_summary", PRE + GUARD_SQL + """ SELECT *, n_drop > 0.5 * n_docs AS high_drop, n_full = n_docs AS all_full,
    n_drop = n_docs AS none_kept
  FROM (SELECT question_id, count(*) AS n_docs, count(*) FILTER (final_label = 'full') AS n_full,
    count(*) FILTER (final_label = 'abstract') AS n_abstract,
 count(*) FILTER (final_label = 'drop') AS n_drop, coalesce(string_agg(left(title, 80), ' | ' ORDER BY idx) FILTER (final_label = 'full'),
    '') AS full_titles,
 coalesce(string_agg(left(title, 80), ' | ' ORDER BY idx) FILTER (final_label = 'abstract'), '') AS abstract_titles,
 coalesce(string_agg(left(title, 80), ' | ' ORDER BY idx) FILTER (final_label = 'drop'), '') AS drop_titles FROM guarded GROUP BY 1)""")
def _(spark, d):
    return docfilter.filter_summary(guarded(spark, d))


@query("ev48_ontology_select", with_tables("av_pairs") + """SELECT question_id, attribute, CAST(pos AS BIGINT) AS pos,
    row_number() OVER (PARTITION BY question_id ORDER BY centrality DESC, pos) AS place,
    centrality >= 0.8 AS critical, centrality >= 0.4 AS contextual
  FROM (SELECT *, row_number() OVER (PARTITION BY question_id, attribute ORDER BY centrality DESC, pos) AS best FROM av_pairs)
  WHERE best = 1""")
def _(spark, d):
    return docfilter.ontology_select(demo(spark, d, "av_pairs")).select("question_id", "attribute", "pos", "place", "critical", "contextual")


@query("ev49_reorder_by_ontology", with_tables("candidates", "av_pairs").rstrip() + """, n AS (SELECT question_id,
    list_distinct(list(lower(attribute))) AS names FROM av_pairs WHERE centrality >= 0.8 GROUP BY 1)
SELECT question_id, doc_id, hits AS attribute_hits, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, idx) AS position
  FROM (SELECT c.*, coalesce(len(list_filter(names, lambda x: contains(lower(abstract || ' ' || title), x))), 0) AS hits FROM candidates c
  LEFT JOIN n USING (question_id))""")
def _(spark, d):
    return docfilter.reorder_by_ontology(demo(spark, d, "candidates"), demo(spark, d, "av_pairs")).select("question_id", "doc_id", "attribute_hits", "position")


# --- assembly --------------------------------------------------------------------------------


@query("ev50_documents_block", PRE + GUARD_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY question_id
    ORDER BY CAST(final_label <> 'full' AS INT), idx) AS number FROM guarded
  WHERE final_label <> 'drop'),
b AS (SELECT question_id, number, final_label, chr(10) || '=== Document [' || number || ']: ' || title || CASE WHEN final_label = 'full' THEN ''
    WHEN download_status IN ('already_failed', 'failed') THEN ' [abstract only: no full text]'
    ELSE ' (abstract)' END || ' ===' || chr(10) || 'URI: ' || uri || CASE
    WHEN final_label = 'full' THEN CASE WHEN contains(abstract,
    chr(10)) THEN chr(10) || chr(10) || '<<< Section: unknown | p. ? >>>' || chr(10) || title || chr(10) || chr(10) || '<<< Section: results | p. 1 >>>' || chr(10) || abstract
    WHEN abstract <> '' THEN chr(10) || chr(10) || '[abstract only: no excerpt]' || chr(10) || abstract ELSE '' END
    WHEN abstract <> '' THEN chr(10) || abstract ELSE '' END AS t
  FROM k)
SELECT question_id, md5(block) AS block_md5, n_docs, n_excerpts, len(block) AS n_chars, len(string_split(block, chr(10))) AS n_lines
  FROM (SELECT question_id, string_agg(t, chr(10) ORDER BY number) AS block, count(*) AS n_docs FROM b GROUP BY 1)
  JOIN (SELECT question_id, 2 * count(*) FILTER (final_label = 'full' AND contains(abstract, chr(10))) AS n_excerpts FROM k
  GROUP BY 1) USING (question_id)""")
def _(spark, d):
    docs = with_texts(spark, d, judged(spark, d))
    broken = demo(spark, d, "candidates").where(F.col("abstract").contains("\n")).select("question_id", "doc_id", "abstract", "title")
    first = F.struct(F.lit(1).alias("page"), F.lit(1).alias("excerpt_no"), F.lit("results").alias("section"), F.col("abstract").alias("text"))
    second = F.struct(F.lit(None).cast("int").alias("page"), F.lit(2).alias("excerpt_no"), F.lit(None).cast("string").alias("section"), F.col("title").alias("text"))
    got = assemble.documents_block(docs, broken.select("question_id", "doc_id", F.explode(F.array(first, second)).alias("e")).select("question_id", "doc_id", "e.*"))
    return got.select("question_id", F.md5(F.col("block").cast("binary")).alias("block_md5"), "n_docs", "n_excerpts", "n_chars", "n_lines")


_NAMES = "CASE n_authors WHEN 0 THEN NULL WHEN 1 THEN lead || '-1' WHEN 2 THEN lead || '-1, ' || lead || '-2' ELSE lead || '-1 et al.' END"


@query("ev50_cited_block", PRE + GUARD_SQL + ", " + with_tables("works")[5:].rstrip() + f""", k AS (SELECT *,
    row_number() OVER (PARTITION BY question_id ORDER BY CAST(final_label <> 'full' AS INT), idx) AS number FROM guarded
  WHERE final_label <> 'drop'),
w AS (SELECT 'W' || k.doc_id AS work_id, k.*, CAST(w.year AS VARCHAR) AS y, {_NAMES} AS names, CASE WHEN k.title = '' THEN 'Unknown'
    ELSE k.title END AS t
  FROM k JOIN works w ON w.work_id = 'W' || k.doc_id),
b AS (SELECT question_id, number, '=== Document [' || number || ']: "' || t || '" ===' || chr(10) || 'Authors: ' || coalesce(names,
    '') || ' (' || coalesce(y,
    '') || ') | ' || uri || chr(10) || 'Abstract: ' || abstract || chr(10)
 || CASE WHEN final_label = 'full' AND contains(abstract, chr(10))
    THEN 'Full-text excerpts:' || chr(10) || '  <<< Section: results | p. 1 >>>' || chr(10) || '  ' || abstract
    ELSE '(Abstract only)' END || chr(10) AS x,
 '[' || number || '] ' || coalesce(names, 'Unknown') || ' (' || coalesce(y, 'n.d.') || '). ' || t || '. ' || uri AS r FROM w)
SELECT question_id, md5(block) AS block_md5, len(block) AS n_chars
  FROM (SELECT question_id, string_agg(x, chr(10) ORDER BY number) || chr(10) || chr(10) || '[VALIDATED REFERENCES]' || chr(10) || string_agg(r,
    chr(10) ORDER BY number) AS block
  FROM b GROUP BY 1)""")
def _(spark, d):
    known = works(spark, d).select(F.col("number").alias("doc_id"), "year", "authors")
    rows = judged(spark, d)
    docs = with_texts(spark, d, rows.join(known, "doc_id"))
    numbers = rows.where("final_label = 'full'").select("question_id", "doc_id", F.row_number().over(W.partitionBy("question_id").orderBy("idx")).alias("doc_index"))
    parts = with_texts(spark, d, numbers).where(F.col("abstract").contains("\n"))
    parts = parts.select("question_id", "doc_index", F.lit(1).alias("page"), F.lit(1).alias("excerpt_no"), F.lit("results").alias("section"), F.col("abstract").alias("text"))
    return assemble.cited_block(docs, parts).select("question_id", F.md5(F.col("block").cast("binary")).alias("block_md5"), F.length("block").alias("n_chars"))


@query("ev51_context_views", with_tables("assessed").rstrip() + """, r AS (SELECT *, '[' || (idx + 1) || '] ' || CASE
    WHEN trim(title) <> '' THEN trim(title) ELSE 'Untitled' END AS head, printf('%.2f',
    CAST(relevance_score AS DOUBLE)) AS rel
  FROM assessed WHERE include)
SELECT question_id, md5(string_agg(head || chr(10) || 'relevance: ' || rel || CASE WHEN trim(abstract) <> '' THEN chr(10) || 'text: ' || abstract
    ELSE '' END || chr(10) || 'uri: ' || uri, chr(10) || chr(10) ORDER BY idx)) AS full_md5,
    md5(string_agg(head || chr(10) || 'text: ' || left(abstract, 200),
    chr(10) || chr(10) ORDER BY idx)) AS slim_md5, string_agg(head || ': ' || rel, chr(10) ORDER BY idx) AS score_view
  FROM r GROUP BY 1""")
def _(spark, d):
    got = assemble.context_views(demo(spark, d, "assessed"))
    return got.select("question_id", F.md5(F.col("full_view").cast("binary")).alias("full_md5"), F.md5(F.col("slim_view").cast("binary")).alias("slim_md5"), "score_view")


def works(spark, d):
    w = demo(spark, d, "works")
    authors = F.transform(F.sequence(F.lit(1), F.col("n_authors")), lambda i: F.concat(F.col("lead"), F.lit("-"), i.cast("string")))
    link = lambda pdf, page: F.struct(F.col(pdf).alias("pdf_url") if pdf else F.lit(None).cast("string").alias("pdf_url"), F.col(page).alias("landing_page_url") if page else F.lit(None).cast("string").alias("landing_page_url"))
    return w.withColumns({
        "authors": F.when(F.col("n_authors") > 0, authors).otherwise(F.array().cast("array<string>")), "best_oa": link("best_pdf", "best_page"), "primary": link("primary_pdf", "best_page"),
        "locations": F.array(link("best_pdf", "oa_url")), "number": F.substring("work_id", 2, 20).cast("long"),
    })


_AUTHORS = "CASE n_authors WHEN 0 THEN 'Unknown' WHEN 1 THEN lead || '-1' WHEN 2 THEN lead || '-1, ' || lead || '-2' ELSE lead || '-1 et al.' END"


@query("ev52_reference_lines", with_tables("works") + f"""SELECT work_id,
    '[' || substr(work_id, 2) || '] ' || {_AUTHORS} || ' (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || '). '
    || CASE WHEN title <> '' THEN title ELSE '[No title]' END || CASE WHEN uri <> '' THEN '. ' || uri ELSE '' END AS reference,
    '[' || substr(work_id, 2) || '] ' || CASE WHEN n_authors = 0 THEN 'No author' ELSE lead || '-1' END
    || ' (' || coalesce(CAST(year AS VARCHAR), 'No year') || '). *' || CASE WHEN trim(title) <> '' THEN trim(title) ELSE '{assemble.NO_TITLE}' END
    || '*. ' || uri || '.' AS cited
  FROM works""")
def _(spark, d):
    return assemble.reference_lines(works(spark, d)).select("work_id", "reference", "cited")


@query("ev53_relevance_view", with_tables("assessed") + """SELECT question_id, idx, CAST(relevance_score AS DOUBLE) AS relevance_score,
    row_number() OVER (PARTITION BY question_id ORDER BY relevance_score DESC, idx) AS rank
  FROM assessed WHERE include""")
def _(spark, d):
    return assemble.relevance_view(demo(spark, d, "assessed")).select("question_id", "idx", F.col("relevance_score").cast("double").alias("relevance_score"), "rank")


@query("ev54_fallback_context", with_tables("questions", "assessed") + """SELECT q.question_id, md5(coalesce(CASE
    WHEN q.question_id % 3 = 0 THEN question ELSE a END, '')) AS context_md5,
    CASE WHEN q.question_id % 3 = 0 THEN 'enriched' WHEN coalesce(a, '') <> '' THEN 'abstracts' ELSE 'error' END AS status
  FROM questions q LEFT JOIN (SELECT question_id, string_agg(abstract, chr(10) || chr(10) ORDER BY idx) FILTER (trim(abstract) <> '') AS a
  FROM assessed GROUP BY 1) USING (question_id)""")
def _(spark, d):
    enriched = demo(spark, d, "questions").select("question_id", F.when(F.col("question_id") % 3 == 0, F.col("question")).otherwise("  ").alias("enriched"))
    got = assemble.fallback_context(enriched, demo(spark, d, "assessed"))
    return got.select("question_id", F.md5(F.coalesce("context", F.lit("")).cast("binary")).alias("context_md5"), "status")


@query("ev55_alignment_check", with_tables("candidates").rstrip() + """, b AS (SELECT question_id, idx AS position, CASE
    WHEN doc_id % 113 = 5 THEN 'x' ELSE uri END AS k FROM candidates
  WHERE doc_id % 211 <> 3), a AS (SELECT question_id, idx AS position, uri AS k FROM candidates)
SELECT question_id, count(a.k) AS n_before, count(b.k) AS n_after, min(position) FILTER (a.k IS DISTINCT
  FROM b.k) AS first_difference, min(position) FILTER (a.k IS DISTINCT FROM b.k) IS NULL AS aligned FROM a FULL
  JOIN b USING (question_id, position) GROUP BY 1""")
def _(spark, d):
    a = demo(spark, d, "candidates").withColumnRenamed("idx", "position")
    b = a.where("doc_id % 211 <> 3").withColumn("uri", F.when(F.col("doc_id") % 113 == 5, "x").otherwise(F.col("uri")))
    return assemble.alignment_check(a, b)


# --- citations -------------------------------------------------------------------------------

ANS = with_tables("answers")


def answers(spark, d):
    return demo(spark, d, "answers")


@query("ev56_strip_references", ANS + """SELECT answer_id, md5(CASE WHEN conv_id % 3 = 0 THEN regexp_replace(split_part(text,
    chr(10) || '## References', 1), '\\s+$', '') ELSE text END) AS body_md5
  FROM answers""")
def _(spark, d):
    return answers(spark, d).select("answer_id", F.md5(cite.strip_references(F.col("text")).cast("binary")).alias("body_md5"))


@query("ev56_strip_references_loose", ANS + """SELECT answer_id, md5(CASE WHEN conv_id % 3 = 0 THEN regexp_replace(split_part(text,
    chr(10) || '## References' || chr(10), 1), '\\s+$', '') ELSE text END) AS body_md5
  FROM answers""")
def _(spark, d):
    return answers(spark, d).select("answer_id", F.md5(cite.strip_references_loose(F.col("text")).cast("binary")).alias("body_md5"))


CITED_SQL = (
    "list_sort(list_distinct(list_transform(list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '\\[([0-9,\\s]+)\\]', 1), "
    "lambda g: string_split(g, ','))), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: regexp_matches(x, '^[0-9]{1,18}$')), lambda n: CAST(n AS BIGINT))))"
)


@query("ev57_cited_indices", ANS + f"SELECT answer_id, coalesce(array_to_string({CITED_SQL}, ','), '') AS cited FROM answers")
def _(spark, d):
    return answers(spark, d).select("answer_id", F.array_join(cite.cited_indices(F.col("text")).cast("array<string>"), ",").alias("cited"))


def _lists_sql(least: int) -> str:
    """A bare list of numbers of two digits; a number that can be a mark is the first, second ... of it."""
    ways = (f"(?:[0-9]{{1,2}}\\s*,\\s*){{{j}}}(?:0?[1-9]|[12][0-9]|30)(?:\\s*,\\s*[0-9]{{1,2}}){{{max(0, least - 1 - j)},{4 - j}}}" for j in range(5))
    return "(?:" + "|".join(ways) + ")"


_MARKS = "array_to_string(list_transform({n}, lambda n: '[' || n || ']'), '')"
_ALL_NUMBERS = "regexp_extract_all(x, '[0-9]+')"
_SOME_NUMBERS = f"list_filter({_ALL_NUMBERS}, lambda n: CAST(n AS HUGEINT) BETWEEN 1 AND 30)"
_REST = "regexp_extract(x, '[0-9]([^0-9]*)$', 1)"
#: Passes over the text, as borders are consumed: brackets, lists at a line's start, and lists after a word, twice.
MARK_PASSES = (
    (r"\[[0-9]+(?:\s*,\s*[0-9]+)+\]", _MARKS.format(n=_ALL_NUMBERS)),
    ("(?m)^" + _lists_sql(2) + r"\s+[A-Za-z]", _MARKS.format(n=_SOME_NUMBERS) + " || " + _REST),
    *2 * ((r"[)\]%A-Za-z] " + _lists_sql(1) + r"(?:\s*\n|\s*$|\s*[,;\[]|\s*--|\s*\.$|\s*\.[^0-9])", "left(x, 2) || " + _MARKS.format(n=_SOME_NUMBERS) + " || " + _REST),),
)


def marks_sql() -> str:
    steps, last = [], "answers"
    for i, (pattern, marks) in enumerate(MARK_PASSES):
        cut = f"SELECT answer_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS m FROM {last}"
        made = f"SELECT answer_id, g, list_transform(m, lambda x: {marks}) AS k FROM ({cut})"
        last = f"pass{i}"
        steps.append(f"{last} AS (SELECT answer_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(k[i], '')), '') AS text FROM ({made}))")
    return ", ".join(steps) + f" SELECT answer_id, text FROM {last}"


@query("ev58_normalize_citations", ANS.rstrip() + ", " + marks_sql())
def _(spark, d):
    return answers(spark, d).select("answer_id", cite.normalize_citations(F.col("text")).alias("text"))


def numbered(spark, d):
    return demo(spark, d, "candidates").select("question_id", (F.col("idx") + 1).alias("number"), F.expr("CASE WHEN idx % 9 = 3 THEN '' ELSE title END").alias("title"), "uri")


VERIFIED_SQL = ANS.rstrip() + ", " + with_tables("candidates")[5:].rstrip() + f""", n AS (SELECT question_id, idx + 1 AS old, CASE
    WHEN idx % 9 = 3 THEN '' ELSE title END AS title, uri FROM candidates),
c AS (SELECT answer_id, question_id, unnest({CITED_SQL}) AS old FROM answers), v AS (SELECT answer_id, question_id, old FROM c
  JOIN n USING (question_id, old)),
e AS (SELECT * FROM v UNION ALL SELECT answer_id, question_id, old FROM answers JOIN n USING (question_id)
  WHERE answer_id NOT IN (SELECT answer_id FROM v)),
f AS (SELECT answer_id, old, title, uri, trim(regexp_replace(lower(left(title, 100)), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS norm FROM e
  JOIN n USING (question_id, old)),
g AS (SELECT *, min(old) OVER (PARTITION BY answer_id, norm, CASE WHEN norm = '' THEN old END) AS kept_idx FROM f),
verified AS (SELECT answer_id, CAST(old AS BIGINT) AS old, dense_rank() OVER (PARTITION BY answer_id ORDER BY kept_idx) AS new, title, uri,
    CAST(kept_idx AS BIGINT) AS kept_idx
  FROM g)"""


@query("ev59_verify_references", VERIFIED_SQL + " SELECT answer_id, old, new, title, uri, kept_idx FROM verified")
def _(spark, d):
    return cite.verify_references(answers(spark, d), numbered(spark, d))


@query("ev60_renumber_citations", VERIFIED_SQL + """, per AS (SELECT answer_id, map_from_entries(list(DISTINCT {'k': CAST(old AS VARCHAR),
    'v': CAST(new AS VARCHAR)})) AS m FROM verified GROUP BY 1),
 lin AS (SELECT answer_id, string_agg('[' || new || '] ' || coalesce(title, uri), chr(10) ORDER BY new) AS lines
  FROM (SELECT DISTINCT answer_id, new, title, uri FROM verified WHERE old = kept_idx) GROUP BY 1),
 cut AS (SELECT answer_id, m, lines, string_split_regex(text, '\\[[0-9]+\\]') AS g, regexp_extract_all(text, '\\[([0-9]+)\\]', 1) AS k
  FROM answers LEFT JOIN per USING (answer_id) LEFT JOIN lin USING (answer_id)),
 body AS (SELECT answer_id, lines, regexp_replace(array_to_string(list_transform(range(1, len(g) + 1),
    lambda i: CASE WHEN i = 1 THEN '' ELSE '[' || coalesce(m[k[i - 1]], k[i - 1]) || ']' END || g[i]), ''), '(?:\\s*\\[[0-9]+\\])+\\s*$', '') AS b
  FROM cut)
 SELECT answer_id, md5(t) AS text_md5, len(t) AS n_chars
  FROM (SELECT answer_id, CASE WHEN lines IS NULL THEN b ELSE b || chr(10) || chr(10) || '## References' || chr(10) || lines END AS t
  FROM body)""")
def _(spark, d):
    a = answers(spark, d)
    return cite.renumber_citations(a, cite.verify_references(a, numbered(spark, d))).select("answer_id", F.md5(F.col("renumbered").cast("binary")).alias("text_md5"), F.length("renumbered").alias("n_chars"))


@query("ev61_numeric_faithfulness", ANS.rstrip() + """, found AS (
  SELECT answer_id, context, list_filter(regexp_extract_all(regexp_replace(regexp_replace(text, '\\[[0-9]+\\]', '', 'g'), '[\\p{L}\\p{No}\\p{Nl}]',
    'x', 'g'),
    '\\b-?[0-9]+(?:\\.[0-9]+)?\\b'), lambda n: contains(n, '.') OR NOT (CAST(n AS DOUBLE) BETWEEN 1900 AND 2100
    OR abs(CAST(n AS DOUBLE)) < 10)) AS numbers
  FROM answers)
SELECT answer_id, array_to_string(numbers, ' ') AS numbers, array_to_string(list_filter(numbers, lambda n: NOT contains(context, n)),
    ' ') AS unmatched FROM found""")
def _(spark, d):
    got = cite.numeric_faithfulness(answers(spark, d))
    return got.select("answer_id", F.array_join("numbers", " ").alias("numbers"), F.array_join("unmatched", " ").alias("unmatched"))


AUDIT_SQL = ANS.rstrip() + """, a1 AS (SELECT *, regexp_replace(split_part(text, '## References', 1), '^\\s+|\\s+$', '', 'g') AS body,
    split_part(text, '## References', 2) AS blk
  FROM answers),
a2 AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(body, '\\[([0-9]+)\\]', 1), lambda n: CAST(n AS BIGINT)))) AS inl,
    list_sort(list_transform(regexp_extract_all(blk, '(?m)^\\[([0-9]+)\\]', 1), lambda n: CAST(n AS BIGINT))) AS refs,
 list_filter(list_transform(string_split(blk, chr(10)), lambda s: trim(s)), lambda s: starts_with(s, '[') AND (contains(lower(s), 'unknown')
    OR contains(lower(s),
    '[no title') OR regexp_matches(s, '^\\[[0-9]+\\]\\s*\\.'))) AS bad
  FROM a1),
audited AS (SELECT *, len(body) AS body_len, ends_with(body, ']') AS ends_on_mark, len(bad) AS bad_refs, trim(blk) <> '' AS has_block,
    len(body) < 500 AS short_body,
    len(inl) = 0 OR (inl[1] = 1 AND inl[-1] = len(inl)) AS sequential, CASE WHEN len(inl) > 0 THEN inl = refs ELSE len(refs) = 0 END AS refs_match
  FROM a2)"""


@query("ev62_structural_audit", AUDIT_SQL + " SELECT answer_id, body_len, ends_on_mark, bad_refs, has_block, short_body, sequential, refs_match FROM audited")
def _(spark, d):
    return cite.structural_audit(answers(spark, d)).select("answer_id", "body_len", "ends_on_mark", "bad_refs", "has_block", "short_body", "sequential", "refs_match")


@query("ev62_audit_groups", AUDIT_SQL + """ SELECT unnest(['ends_on_mark', 'short_body', 'bad_refs', 'numbering', 'no_block']) AS problem,
    unnest([count(*) FILTER (ends_on_mark), count(*) FILTER (short_body),
    count(*) FILTER (bad_refs > 0), count(*) FILTER (NOT sequential OR NOT refs_match), count(*) FILTER (NOT has_block)]) AS n
  FROM audited""")
def _(spark, d):
    return cite.audit_groups(cite.structural_audit(answers(spark, d)))


def _any(words):
    return "(" + " OR ".join(f"contains(lb, '{w}')" for w in words) + ")"


_SUM = "(" + " + ".join(f"CAST(contains(lb, '{w}') AS INT)" for w in cite.REASONING) + ")"
CARD_SQL = AUDIT_SQL + f""", cards AS (SELECT answer_id, rule_hit, coalesce(context, '') <> '' AS refine_guard,
    body_len >= CASE rule_hit WHEN 'tier-3' THEN 2000 WHEN 'tier-m' THEN 1000 ELSE 500 END AS body_length, NOT ends_on_mark AS sentence_ending,
    sequential AND refs_match AS seq_refs,
 CASE WHEN rule_hit IN ('tier-1-def', 'tier-1', 'fallback') THEN use_draft ELSE NOT use_draft END AS draft_flag, NOT (contains(lb, 'hydrogel')
    OR contains(lb,
    'photovoltaic') OR contains(lb, 'superconductor')) AS bleed_check, bad_refs = 0 AS ref_sanity,
 len(coalesce(context, '')) >= CASE WHEN rule_hit IN ('tier-m', 'tier-2a', 'tier-2b', 'tier-3') THEN 2000 ELSE 0 END AS context_size,
 CASE WHEN contains(rule_hit, 'tier-1-def') THEN {_any(cite.DEFINING)} AND {_any(cite.WORKING)} WHEN rule_hit = 'tier-m' THEN {_SUM} >= 2
    WHEN rule_hit = 'tier-3'
    THEN len(regexp_extract_all(body, '(?m)^#{{2,3}} ')) >= 2 ELSE true END AS answer_quality
  FROM (SELECT *, lower(body) AS lb FROM audited))"""


@query("ev63_answer_scorecard", CARD_SQL + " SELECT * EXCLUDE (rule_hit) FROM cards")
def _(spark, d):
    return cite.answer_scorecard(answers(spark, d)).select("answer_id", *cite.DIMENSIONS)


@query("ev63_scorecard_summary", CARD_SQL + """ SELECT dimension, count(*) FILTER (ok) AS n_pass, count(*) FILTER (NOT ok) AS n_fail,
    count(*) FILTER (ok IS NULL) AS n_skip
  FROM (UNPIVOT (SELECT * EXCLUDE (answer_id, rule_hit) FROM cards) ON COLUMNS(*) INTO NAME dimension VALUE ok) GROUP BY 1""")
def _(spark, d):
    return cite.scorecard_summary(cite.answer_scorecard(answers(spark, d)))


@query("ev64_needs_retry", ANS + "SELECT answer_id, n_references = 0 AND regexp_matches(text, '\\[[0-9]+\\]') AND NOT starts_with(text, 'ERROR') AS retry FROM answers")
def _(spark, d):
    return cite.needs_retry(answers(spark, d)).select("answer_id", "retry")


@query("ev65_validate_answers", ANS + """SELECT answer_id, problem
  FROM (SELECT answer_id, unnest([CASE WHEN trim(question) = '' THEN 'empty question' END, CASE WHEN trim(text) = '' THEN 'empty answer' END,
    CASE WHEN starts_with(upper(text), 'ERROR') THEN 'error answer' END]) AS problem
  FROM answers) WHERE problem IS NOT NULL""")
def _(spark, d):
    return cite.validate_answers(answers(spark, d)).select("answer_id", "problem")


@query("ev39_retraction_check", ANS.rstrip() + ", " + with_tables("works")[5:].rstrip() + """ SELECT answer_id, work_id
  FROM (SELECT answer_id, unnest(list_distinct(regexp_extract_all(split_part(text, '## References', 2), 'W[0-9]+'))) AS work_id
  FROM answers) JOIN works USING (work_id) WHERE is_retracted""")
def _(spark, d):
    return cite.retraction_check(answers(spark, d), demo(spark, d, "works"))


# --- evaluation ------------------------------------------------------------------------------

_ALL = " AND ".join(f"{c} IS NOT NULL" for c in CRITERIA)
LOADED = with_tables("judged").rstrip() + f", loaded AS (SELECT *, round_even(({' + '.join(CRITERIA)}) / 8.0, 2) AS overall FROM judged WHERE {_ALL})\n"


def loaded(spark, d):
    return evaluate.load_scores(demo(spark, d, "judged"))


@query("ev66_load_scores", LOADED + "SELECT question_id, pipeline, CAST(overall AS DOUBLE) AS overall FROM loaded")
def _(spark, d):
    return loaded(spark, d).select("question_id", "pipeline", "overall")


@query("ev66_null_scores", with_tables("judged") + f"SELECT pipeline, count(*) AS n FROM judged WHERE NOT ({_ALL}) GROUP BY 1")
def _(spark, d):
    return evaluate.null_scores(demo(spark, d, "judged"))


@query("ev67_summary", LOADED + "SELECT pipeline, count(*) AS n, " + ", ".join(f"round(avg({m}), 2) AS {m}_mean, round(stddev_samp({m}), 2) AS {m}_std" for m in evaluate.MEASURES) + " FROM loaded GROUP BY 1")
def _(spark, d):
    return evaluate.summary(loaded(spark, d))


PAIRS = [("zero_shot", "two_step"), ("zero_shot", "no_ontology"), ("zero_shot", "ontology"), ("two_step", "no_ontology"), ("two_step", "ontology"), ("no_ontology", "ontology")]
RANK_SQL = """ranked AS (SELECT *, rank() OVER (PARTITION BY a, b, c ORDER BY ad) + (count(*) OVER (PARTITION BY a, b, c, ad) - 1) / 2.0 AS r
  FROM (SELECT *, round(y - x, 6) AS dd, abs(round(y - x, 6)) AS ad FROM paired) WHERE dd <> 0),
w AS (SELECT a, b, c, least(coalesce(sum(r) FILTER (dd > 0), 0), coalesce(sum(r) FILTER (dd < 0), 0)) AS w, count(*) AS n_nonzero
  FROM ranked GROUP BY ALL), m AS (SELECT a, b, c, count(*) AS n, avg(x) AS ma, avg(y) AS mb FROM paired GROUP BY ALL)"""
OUT_SQL = "n, CAST(coalesce(w, 0) AS DOUBLE) AS w, round(1 - 2 * coalesce(w, 0) / (n * (n + 1) / 2), 3) AS effect_r, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round(round(mb, 4) - round(ma, 4), 4) AS diff, coalesce(n_nonzero, 0) AS n_nonzero"


@query("ev68_wilcoxon_pairs", LOADED.rstrip() + ", pairs(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + f"""),
    paired AS (SELECT a, b, '' AS c, CAST(l.overall AS DOUBLE) AS x, CAST(r.overall AS DOUBLE) AS y FROM pairs
  JOIN loaded l ON l.pipeline = a
  JOIN loaded r ON r.pipeline = b AND r.question_id = l.question_id), {RANK_SQL} SELECT a AS pipeline_a, b AS pipeline_b, {OUT_SQL} FROM m
  LEFT JOIN w USING (a, b, c)""")
def _(spark, d):
    return evaluate.wilcoxon_pairs(loaded(spark, d), PAIRS).drop("p_value", "sig")


@query("ev68_wilcoxon_p_values")
def _(spark, d):
    return evaluate.wilcoxon_pairs(loaded(spark, d), PAIRS).select("pipeline_a", "pipeline_b", F.round("p_value", 8).alias("p_value"), "sig")


_CRIT = "[" + ", ".join(f"'{m}'" for m in evaluate.MEASURES) + "]"
_VALS = "[" + ", ".join(f"CAST({m} AS DOUBLE)" for m in evaluate.MEASURES) + "]"


@query("ev69_wilcoxon_by_criterion", LOADED.rstrip() + f""", long AS (SELECT question_id, pipeline, unnest({_CRIT}) AS c, unnest({_VALS}) AS v
  FROM loaded), paired AS (SELECT r.pipeline AS a, '' AS b, r.c, l.v AS x, r.v AS y FROM long r JOIN long l USING (question_id, c)
  WHERE l.pipeline = 'no_ontology' AND r.pipeline <> 'no_ontology'), {RANK_SQL}, s AS (SELECT pipeline AS a, c, count(*) AS k FROM long
  GROUP BY ALL) SELECT s.a AS pipeline, s.c AS criterion, CASE WHEN k = bk THEN n END AS n, CASE WHEN k = bk THEN w END AS w,
    CASE WHEN k = bk THEN effect_r END AS effect_r, CASE WHEN k = bk THEN mean_a END AS mean_a, CASE WHEN k = bk THEN mean_b END AS mean_b,
    CASE WHEN k = bk THEN diff END AS diff, CASE WHEN k = bk THEN n_nonzero END AS n_nonzero
  FROM s JOIN (SELECT c, k AS bk FROM s WHERE a = 'no_ontology') USING (c) LEFT JOIN (SELECT a, c, {OUT_SQL} FROM m LEFT
  JOIN w USING (a, b, c)) t ON t.a = s.a AND t.c = s.c WHERE s.a <> 'no_ontology'""")
def _(spark, d):
    return evaluate.wilcoxon_by_criterion(loaded(spark, d), "no_ontology").drop("p_value", "sig")


EXPECTED = [("zero_shot", 5.5), ("two_step", 5.49), ("ontology", 5.5), ("extra", 7.48)]


@query("ev70_validate_summary", LOADED.rstrip() + ", e(pipeline, expected) AS (VALUES " + ", ".join(f"('{p}', CAST({v} AS DOUBLE))" for p, v in EXPECTED) + """),
    c AS (SELECT pipeline, round(avg(overall), 2) AS computed FROM loaded
  GROUP BY 1) SELECT pipeline, computed, expected, round(computed - expected, 4) AS delta,
    CASE WHEN computed IS NULL THEN 'missing' WHEN expected IS NULL THEN 'new' WHEN abs(round(computed - expected, 4)) > 0.01 THEN 'differs'
    ELSE 'ok' END AS status
  FROM c FULL JOIN e USING (pipeline)""")
def _(spark, d):
    return evaluate.validate_summary(evaluate.summary(loaded(spark, d)), spark.createDataFrame(EXPECTED, "pipeline string, overall_mean double"))


@query("ev71_score_distribution", LOADED + """SELECT pipeline, CAST(min(overall) AS DOUBLE) AS least, quantile_cont(CAST(overall AS DOUBLE),
    0.25) AS p25, quantile_cont(CAST(overall AS DOUBLE), 0.5) AS p50,
    quantile_cont(CAST(overall AS DOUBLE), 0.75) AS p75, CAST(max(overall) AS DOUBLE) AS most, """ + ", ".join(f"round(avg({m}), 4) AS {m}_mean" for m in evaluate.MEASURES) + " FROM loaded GROUP BY 1")
def _(spark, d):
    return evaluate.score_distribution(loaded(spark, d))


@query("ev72_worst_cases", LOADED + """SELECT pipeline, question_id, CAST(overall AS DOUBLE) AS overall, rank, coalesce(nullif(concat_ws('; ',
    CASE WHEN quantitative_precision <= 4 THEN 'Low quantitative precision' END, CASE WHEN directness <= 4 THEN 'Low directness' END,
    CASE WHEN scope_awareness <= 4 THEN 'Low scope awareness' END), ''), 'Marginal across metrics') AS issue
  FROM (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY overall, question_id) AS rank FROM loaded) WHERE rank <= 10""")
def _(spark, d):
    return evaluate.worst_cases(loaded(spark, d))


FIVE = [f"s{k}" for k in range(5)]


@query("ev73_score_anomalies", with_tables("fives") + """SELECT doc_id, round(sd, 4) AS std, sev AS severity, sev IN ('info', 'none') AS valid
  FROM (SELECT *, CASE WHEN len(g) <> 5 THEN 'high' WHEN sd > 1.5 THEN 'medium' WHEN sd < 0.5 AND m = 5 THEN 'info' WHEN sd < 0.5 THEN 'low'
    WHEN abs(m - 3) > 1.5
    THEN 'medium' ELSE 'none' END AS sev
  FROM (SELECT doc_id, g, CASE WHEN len(g) = 5 THEN list_avg(g) END AS m, CASE WHEN len(g) = 5 THEN list_stddev_samp(g) END AS sd
  FROM (SELECT doc_id, list_filter([s0, s1, s2, s3, s4], lambda s: s BETWEEN 1 AND 5) AS g FROM fives)))""")
def _(spark, d):
    return evaluate.score_anomalies(demo(spark, d, "fives"), FIVE).select("doc_id", "std", "severity", "valid")


@query("ev73_anomaly_summary", with_tables("fives") + """SELECT sev AS severity, count(*) AS n
  FROM (SELECT CASE WHEN len(g) <> 5 THEN 'high' WHEN sd > 1.5 THEN 'medium' WHEN sd < 0.5 AND m = 5 THEN 'info' WHEN sd < 0.5 THEN 'low'
    WHEN abs(m - 3) > 1.5
    THEN 'medium' ELSE 'none' END AS sev
  FROM (SELECT g, list_avg(g) AS m, list_stddev_samp(g) AS sd
  FROM (SELECT list_filter([s0, s1, s2, s3, s4], lambda s: s BETWEEN 1 AND 5) AS g FROM fives))) GROUP BY 1""")
def _(spark, d):
    return evaluate.score_anomalies(demo(spark, d, "fives"), FIVE).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("ev74_judge_overall", with_tables("fives") + "SELECT doc_id, round((s0 + s1 + s2 + s3 + s4) / 5.0, 4) AS overall_score FROM fives")
def _(spark, d):
    return evaluate.judge_overall(demo(spark, d, "fives"), FIVE).select("doc_id", "overall_score")


_FILL = ", ".join(
    f"CASE WHEN m{k} < 0 THEN coalesce(avg(CASE WHEN m{k} > 0 AND m{k} <= 1 AND m{k} <> 0.5 THEN CAST(m{k} AS DOUBLE) END) OVER w, 0.5) ELSE CAST(m{k} AS DOUBLE) END AS f{k}" for k in range(3)
)


@query("ev75_metric_quality", with_tables("metrics") + f"""SELECT ord, pipeline, round(f0, 5) AS m0_filled, round(f1, 5) AS m1_filled, round(f2,
    5) AS m2_filled, round((f0 + f1 + f2) / 3, 3) AS quality
  FROM (SELECT *, {_FILL} FROM metrics WINDOW w AS (PARTITION BY pipeline ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def _(spark, d):
    m = demo(spark, d, "metrics")
    m = m.select("ord", "pipeline", *[F.col(f"m{k}").cast("double").alias(f"m{k}") for k in range(3)])
    got = evaluate.metric_quality(m, ["m0", "m1", "m2"])
    return got.select("ord", "pipeline", *[F.round(f"m{k}_filled", 5).alias(f"m{k}_filled") for k in range(3)], F.round("quality", 3).alias("quality"))


@query("ev75_metric_switched_off", with_tables("metrics") + """SELECT ord, pipeline, coalesce(sum(CAST(failed AS INT)) OVER (PARTITION BY pipeline
    ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3 AS off
  FROM metrics""")
def _(spark, d):
    return evaluate.metric_switched_off(demo(spark, d, "metrics")).select("ord", "pipeline", "off")


@query("ev76_run_stats", with_tables("runs") + """SELECT pipeline, count(*) AS total, count(*) FILTER (status = 'ok') AS ok,
    count(*) FILTER (status <> 'ok') AS failed, round(avg(seconds) FILTER (status = 'ok'),
    4) AS mean_seconds
  FROM runs GROUP BY 1""")
def _(spark, d):
    return evaluate.run_stats(demo(spark, d, "runs"))


@query("ev76_health_flags", ANS + """SELECT answer_id, len(context) = 0 AS empty_context, len(context) > 0 AND len(context) < 500 AS thin_context,
    len(context) / 4 > 70000 AS huge_context,
    len(context) > 307200 AS over_cap, len(text) < 100 AS short_answer, NOT regexp_matches(text, '\\[[0-9]+\\]') AS uncited
  FROM answers""")
def _(spark, d):
    return evaluate.health_flags(answers(spark, d)).select("answer_id", "empty_context", "thin_context", "huge_context", "over_cap", "short_answer", "uncited")


def _has(tokens):
    return "(" + " OR ".join(f"contains(lower(message), '{t}')" for t in tokens) + ")"


@query("ev77_classify_errors", with_tables("errors") + f"""SELECT CASE WHEN {_has(evaluate.CODE_TOKENS)} THEN 'code' WHEN coalesce(status, 0) = 429
    OR coalesce(status,
    0) BETWEEN 500 AND 599 OR {_has(evaluate.TRANSIENT_TOKENS)} THEN 'transient' ELSE 'other' END AS kind,
    {_has(evaluate.END_OF_RUN_TOKENS)} AS retry_later,
    count(*) AS n
  FROM errors GROUP BY ALL""")
def _(spark, d):
    return evaluate.classify_errors(demo(spark, d, "errors")).groupBy("kind", "retry_later").agg(F.count(F.lit(1)).alias("n"))


# --- ingestion -------------------------------------------------------------------------------

ASKED = "SELECT doc_id AS ord, CASE WHEN doc_id % 12 = 0 THEN '  ' ELSE text END AS question FROM documents"


@query("ev01_load_questions", f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS index FROM ({ASKED})) SELECT ord, index, question
  FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY ord) AS f FROM r WHERE trim(question) <> '') WHERE f = 1""")
def _(spark, d):
    asked = spark.sql(ASKED.replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents"))
    return ingest.load_questions(asked.withColumnRenamed("question", "Query"), ignore_case=True).select("ord", "index", "question")


@query("ev01_judge_tasks", ANS + """SELECT answer_id, question_id, 'Q' || question_id || '_s' || turn AS task_id
  FROM (SELECT * FROM answers ORDER BY question_id, answer_id LIMIT 500) WHERE question_id <= 500""")
def _(spark, d):
    rows = answers(spark, d).withColumns({"ord": F.col("answer_id"), "set": F.concat(F.lit("s"), F.col("turn").cast("string"))})
    return ingest.judge_tasks(rows, 500).select("answer_id", "question_id", "task_id")


def raw_results(spark, d):
    """JSON with keys of its own, Python literals, blanks and junk made from the documents."""
    t = F.regexp_replace("text", "[\"'\\\\\\\\\\x00-\\x1F]", " ")
    i, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 7
    inner = F.concat(F.lit('"nested": {"_id": '), i, F.lit(', "none": null}'))
    js = F.concat(F.lit('[{"title": "'), t, F.lit('", "_id": 1, "abstract": null, "science_keywords": [{"name": "k", "_rev": "x", "own": [{"_key": 1, "deep": [[{"embedding": 2, "n": '), i, F.lit("}]]}]}], "))
    js = F.concat(js, F.when(kind == 5, inner).otherwise(F.concat(F.lit('"nested": {"m": '), i, F.lit("}"))), F.lit(', "year": '), i, F.lit("}, null, 3]"))
    py = F.concat(F.lit("[{'title': '"), t, F.lit("', 'embedding': [1.0], 'abstract': None, 'year': "), i, F.lit(", 'open': True}, {'title': 'b'}]"))
    raw = F.when(kind.isin(0, 5), js).when(kind == 1, py).when(kind == 2, F.lit(" ")).when(kind == 3, F.lit("[{broken")).otherwise(F.lit('{"a": 1}'))
    return table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), raw.alias("kg_results"))


_PLAIN = "regexp_replace(text, '[\"''\\\\\\x00-\\x1F]', ' ', 'g')"


@query("ev02_parse_kg_results", f"""WITH k AS (SELECT *, doc_id % 7 AS kind, CAST(doc_id AS VARCHAR) AS i FROM documents)
SELECT doc_id AS question_id, CAST(CASE WHEN kind IN (0, 5) THEN 3 WHEN kind = 1 THEN 2 ELSE 0 END AS BIGINT) AS n_docs, kind <> 3 AS parsed,
    CASE WHEN kind IN (0, 1, 5) THEN md5({_PLAIN}) END AS title_md5, CASE WHEN kind IN (0, 1, 5) THEN doc_id END AS year,
    CASE WHEN kind IN (0, 5) THEN '[{{"name":"k","own":[{{"deep":[[{{"n":' || i || '}}]]}}]}}]' END AS keywords,
    CASE kind WHEN 0 THEN 'nested,science_keywords,title,year' WHEN 5 THEN 'nested,science_keywords,title,year'
    WHEN 1 THEN 'open,title,year' END AS keys,
    CASE kind WHEN 0 THEN '{{"m":' || i || '}}' WHEN 5 THEN '{{"_id":' || i || ',"none":null}}' WHEN 1 THEN 'true' END AS own
  FROM k""")
def _(spark, d):
    first = F.get("docs", F.lit(0))
    field = lambda name, kind="string": F.try_variant_get(first, f"$.{name}", kind)
    keys = F.array_join(F.array_sort(F.map_keys(ingest.object_fields(first))), ",")
    got = ingest.parse_kg_results(raw_results(spark, d))
    own = F.coalesce(F.to_json(field("nested", "variant")), F.to_json(field("open", "variant")))
    return got.select(
        "question_id", F.size("docs").alias("n_docs"), "parsed", F.md5(field("title").cast("binary")).alias("title_md5"), field("year", "bigint").alias("year"),
        F.to_json(field("science_keywords", "variant")).alias("keywords"), keys.alias("keys"), own.alias("own"),
    )


FILE_COLUMNS = {"question_id": "bigint", "question": "string", "score": "double"}


@query("ev01_questions_from_json_lines", """SELECT doc_id AS question_id, 'row' AS kind, md5(text) AS question_md5, CASE
    WHEN doc_id % 4 <> 1 THEN doc_id / 4.0 END AS score,
    CASE WHEN doc_id % 2 = 0 THEN '{"lang":"' || lang || '"}' END AS rest
  FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0
  UNION ALL SELECT NULL, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'no object' ELSE 'type: question_id' END, NULL, NULL, NULL FROM documents
  WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0""")
def _(spark, d):
    """Questions written as JSON lines, some broken off, some no objects, some with an id that is no number, and read again."""
    i = F.col("doc_id")
    fields = [i.alias("question_id"), F.col("text").alias("question"), F.when(i % 4 == 1, F.lit("none")).otherwise((i / 4).cast("string")).alias("score"), F.when(i % 2 == 0, F.col("lang")).alias("lang")]
    line, named = F.to_json(F.struct(*fields)), F.to_json(F.struct(F.concat(F.lit("q"), i.cast("string")).alias("question_id"), *fields[1:]))
    text = F.when(i % 11 == 0, F.left(line, F.length(line) - 1)).when(i % 13 == 0, F.lit("[1, 2]")).when(i % 17 == 0, named).otherwise(line)
    place = shared_folder(spark, "lines")
    table(spark, d, "documents").select(text.alias("value")).write.text(place)
    rows, rejects = files.read_json_lines(spark, place, FILE_COLUMNS, lenient=("score",))
    none = F.lit(None).cast("string")
    good = rows.select("question_id", F.lit("row").alias("kind"), F.md5(F.col("question").cast("binary")).alias("question_md5"), "score", F.to_json("rest").alias("rest"))
    return good.unionByName(rejects.select(F.lit(None).cast("long").alias("question_id"), F.col("reason").alias("kind"), none.alias("question_md5"), F.lit(None).cast("double").alias("score"), none.alias("rest")))


@query("ev01_questions_from_csv", """SELECT doc_id AS question_id, 'row' AS kind, md5(text) AS question_md5, CAST(doc_id % 9 AS BIGINT) AS score
    FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 9 <> 8
  UNION ALL SELECT NULL, CASE WHEN doc_id % 10 = 0 THEN 'fields' ELSE 'type: score' END, NULL, NULL FROM documents WHERE doc_id % 10 = 0
    OR doc_id % 9 = 8""")
def _(spark, d):
    """Questions written as CSV under other names, with line ends in them, records of too many values and scores that are no numbers."""
    place, docs = shared_folder(spark, "csv"), table(spark, d, "documents")
    score = F.when(F.col("doc_id") % 9 == 8, "high").otherwise((F.col("doc_id") % 9).cast("string"))
    good = docs.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("question_id"), F.col("text").alias("Query"), score.alias("score"))
    good.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(place)
    long = docs.where("doc_id % 10 = 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(",a,1,more")).alias("value"))
    head = spark.range(1).select(F.lit("question_id,Query,score").alias("value"))
    head.withColumn("o", F.lit(0)).unionByName(long.withColumn("o", F.lit(1))).coalesce(1).sortWithinPartitions("o").select("value").write.mode("append").text(place)
    rows, rejects = files.read_csv(spark, place, {"question_id": "bigint", "score": "bigint"})
    good = rows.select("question_id", F.lit("row").alias("kind"), F.md5(F.coalesce("question", F.lit("")).cast("binary")).alias("question_md5"), "score")
    none = F.lit(None).cast("long")
    return good.unionByName(rejects.select(none.alias("question_id"), F.col("reason").alias("kind"), F.lit(None).cast("string").alias("question_md5"), none.alias("score")))


@query("ev03_kg_result_stats", """SELECT doc_id AS question_id, CAST(doc_id % 3 AS BIGINT) AS n_docs, CAST(doc_id % 3 * 2 AS BIGINT) AS n_keywords,
    CAST(doc_id % 3 * 2 * (doc_id % 2) AS BIGINT) AS n_secondary,
    CAST(doc_id % 3 + doc_id % 3 * 2 + doc_id % 3 * 2 * (doc_id % 2) AS BIGINT) AS n_nodes
  FROM documents""")
def _(spark, d):
    second = F.slice(F.array(F.struct(F.col("source").alias("title"))), 1, (F.col("doc_id") % 2).cast("int"))
    keys = F.array(*[F.struct(F.lit(f"k{i}").alias("name"), second.alias("secondary_nodes")) for i in range(2)])
    docs = F.slice(F.array(*[F.struct(F.col("source").alias("title"), keys.alias("science_keywords")) for _ in range(2)]), 1, (F.col("doc_id") % 3).cast("int"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), docs.alias("docs"), F.col("text").alias("kg_results"))
    return ingest.kg_result_stats(rows).select("question_id", "n_docs", "n_keywords", "n_secondary", "n_nodes")


_CUT = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("ev04_parse_structured_context", with_tables("contexts").rstrip() + f""", parts AS (
  SELECT question_id, string_split(string_split(string_split(context, 'RELATED DOCUMENTS')[2], 'RELATED TOPICS')[1], '---') AS b FROM contexts
), blocks AS (SELECT question_id, position, {_CUT.format("b[position]")} AS block FROM parts, unnest(range(1, len(b) + 1)) AS t(position)),
labelled AS (
  SELECT *, CASE WHEN regexp_matches(block,
    'Title[:\\s]+[^\\n]+') THEN {_CUT.format("regexp_extract(block, '[#\\s]*Title[:\\s]+([^\\n]+)', 1)")} END AS t,
    CASE WHEN regexp_matches(block, '(?s)Content[:\\s]+.') THEN {_CUT.format("regexp_extract(block, '(?ms)[#\\s]*Content[:\\s]+(.+?)$', 1)")} END AS c
  FROM blocks WHERE block <> '' AND NOT starts_with(block, '#')
)
SELECT question_id, position, left(coalesce(c, left(block, 500)), 3000) AS content,
  coalesce(t, 'EO Study on ' || left(nullif(string_split(c, '.')[1], ''), 50) || '...', 'Document ' || position) AS title
FROM labelled""")
def _(spark, d):
    return ingest.parse_structured_context(demo(spark, d, "contexts"))


@query("ev07_metadata_enrich", with_tables("candidates", "works") + """SELECT doc_id, CASE WHEN w.work_id IS NULL OR n_authors = 0 THEN 'No author'
    ELSE lead || '-1' END AS author, coalesce(CAST(year AS VARCHAR),
    'No year') AS year_text, w.title AS work_title
  FROM candidates c LEFT JOIN works w ON w.work_id = 'W' || c.doc_id""")
def _(spark, d):
    from evspark.functions.text import work_id

    docs = demo(spark, d, "candidates").withColumn("work_id", work_id(F.col("uri")))
    return ingest.metadata_enrich(docs, works(spark, d)).select("doc_id", "author", "year_text", "work_title")


_BARE = "rtrim(regexp_replace(u, '[#?].*$', ''), '/')"
_ARTICLE = "'^(https?://([^/.]+)[^/]*/articles/([0-9]+)/([0-9]+)/([0-9]+)/)'"
_NAMED = " || '-' || ".join(f"regexp_extract(u, {_ARTICLE}, {k})" for k in (2, 3, 4, 5))
REWRITES_SQL = f"""list_filter([
  CASE WHEN contains(lower(u), 'mdpi.com/') AND NOT ends_with(rtrim(lower(u), '/'), '/pdf') AND NOT ends_with({_BARE},
    '.pdf') THEN {_BARE} || '/pdf' END,
  CASE WHEN contains(lower(u), '.copernicus.org/articles/') AND NOT ends_with(lower(u), '.pdf') AND regexp_matches(u, {_ARTICLE})
    THEN regexp_extract(u, {_ARTICLE}, 1) || {_NAMED} || '.pdf' END], lambda x: x IS NOT NULL)"""


@query("ev08_link_candidates", with_tables("works").rstrip() + f""", given AS (
  SELECT work_id, list_filter([best_pdf, best_page, primary_pdf, best_page, best_pdf, oa_url, oa_url], lambda x: coalesce(x, '') <> '') AS g,
    trim(replace(doi, 'https://doi.org/', '')) AS d FROM works
), ordered AS (
  SELECT work_id, d, list_concat(list_filter(g, lambda x: ends_with(lower(x), '.pdf')), list_filter(g, lambda x: NOT ends_with(lower(x),
    '.pdf'))) AS o FROM given
), tried AS (
  SELECT work_id, d, i, unnest(list_concat({REWRITES_SQL}, [u])) AS url, generate_subscripts(list_concat({REWRITES_SQL}, [u]), 1) AS j
  FROM (SELECT work_id, d, i, o[i] AS u FROM ordered, unnest(range(1, len(o) + 1)) AS t(i))
), every AS (
  SELECT work_id, i, j, url FROM tried UNION ALL
  SELECT work_id, 99, 0, 'https://export.arxiv.org/pdf/' || regexp_extract(d, '(?i)^10\\.48550/arXiv\\.(.+)', 1) FROM ordered WHERE regexp_matches(d,
    '(?i)^10\\.48550/arXiv\\..')
), firsts AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY work_id, url ORDER BY i, j) = 1)
SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY i, j) - 1 AS place, url FROM firsts""")
def _(spark, d):
    return ingest.link_candidates(works(spark, d))


def _whole(pattern):
    u = f"trim(regexp_extract(html, '{pattern}', 1))"
    root = "array_to_string(string_split(url, '/')[1:3], '/')"
    return f"CASE WHEN starts_with({u}, '//') THEN 'https:' || {u} WHEN starts_with({u}, '/') AND contains(url, '://') THEN {root} || {u} WHEN starts_with({u}, 'http') THEN {u} END"


@query("ev09_html_pdf_links", with_tables("paged") + "SELECT page_id, url, coalesce(" + ", ".join(map(_whole, (*ingest.FILE_METADATA, ingest.FILE_LINK))) + ") AS pdf_url FROM paged")
def _(spark, d):
    return ingest.html_pdf_links(demo(spark, d, "paged"))


@query("ev10_fetch_status_report", with_tables("candidates", "fetches") + """SELECT coalesce(f.status, 'not_fetched') AS status, count(*) AS n
    FROM (SELECT DISTINCT uri FROM candidates) LEFT JOIN fetches f USING (uri)
  GROUP BY 1""")
def _(spark, d):
    return ingest.fetch_status_report(demo(spark, d, "candidates"), demo(spark, d, "fetches"))


@query("ev10_fetch_counters", with_tables("candidates", "fetches") + """SELECT count(*) FILTER (status NOT IN ('meta_failed',
    'not_openalex')) AS meta_ok,
    count(*) FILTER (status = 'ok' OR starts_with(status, 'extract_failed')) AS pdf_ok, count(*) FILTER (status = 'ok') AS extract_ok
  FROM (SELECT DISTINCT uri FROM candidates) JOIN fetches USING (uri) WHERE status IS NOT NULL""")
def _(spark, d):
    return ingest.fetch_counters(ingest.fetch_status_report(demo(spark, d, "candidates"), demo(spark, d, "fetches")))


@query("ev11_cache_audit", """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN 0 ELSE n_chars END AS b FROM documents WHERE source <> 'src3'),
    t AS (SELECT doc_id
  FROM documents WHERE lang <> 'de'), f AS (SELECT doc_id FROM documents WHERE lang = 'de') SELECT (SELECT count(*)
  FROM p) AS n_pdfs, (SELECT count(*) FROM p WHERE b = 0) AS empty_pdfs, (SELECT count(*) FROM t) AS n_texts, (SELECT count(*)
  FROM f) AS n_failures, (SELECT count(*) FROM t ANTI JOIN p USING (doc_id)) AS texts_without_pdf, (SELECT count(*) FROM p ANTI
  JOIN t USING (doc_id)) AS pdfs_without_text, round(100.0 * (SELECT count(*) FROM t) / ((SELECT count(*) FROM t) + (SELECT count(*)
  FROM f)), 1) AS success_percent""")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("work_id", F.col("doc_id"))
    pdfs = docs.where("source <> 'src3'").select("work_id", F.when(F.col("doc_id") % 41 == 0, 0).otherwise(F.col("n_chars")).alias("bytes"))
    return ingest.cache_audit(pdfs, docs.where("lang <> 'de'").select("work_id"), docs.where("lang = 'de'").select("work_id"))


@query("ev11_failure_reasons", with_tables("errors") + "SELECT left(message, 60) AS reason, count(*) AS n FROM errors GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
def _(spark, d):
    return ingest.failure_reasons(demo(spark, d, "errors").withColumnRenamed("message", "reason"))


_ROWS = "SELECT CAST(o_custkey AS BIGINT) AS k, o_orderkey AS ord, o_totalprice AS v FROM orders WHERE (o_orderstatus = 'F') = {0}"


def _halves(spark, d):
    return [spark.sql(_ROWS.format(bool(i)).replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")) for i in (0, 1)]


def _keys(df):
    return df.withColumn("k", F.floor(F.col("k") / 3).cast("long"))


_A, _B = (f"(SELECT CAST(floor(k / 3) AS BIGINT) AS k, ord, v FROM ({_ROWS.format(bool(i))}))" for i in (0, 1))


@query("ev12_upsert", f"""WITH a AS {_A}, b AS (SELECT * FROM {_B} QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord DESC) = 1) SELECT k, ord, v
    FROM a ANTI
  JOIN b USING (k) UNION ALL SELECT k, ord, v FROM b""")
def _(spark, d):
    a, b = (_keys(x) for x in _halves(spark, d))
    return ingest.upsert(a, b, ["k"])


@query("ev13_insert_if_absent", f"""WITH a AS {_A}, b AS (SELECT * FROM {_B} QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord) = 1) SELECT k,
    ord, v FROM a
  UNION ALL SELECT k, ord, v FROM b ANTI JOIN a USING (k)""")
def _(spark, d):
    a, b = (_keys(x) for x in _halves(spark, d))
    return ingest.insert_if_absent(a, b, ["k"])


_CONV = "SELECT DISTINCT conv_id AS question_id FROM conversations"


@query("ev14_pending_long", ANS.rstrip() + f""", done AS (SELECT DISTINCT conv_id FROM answers WHERE len(text) >= 200 AND NOT starts_with(text,
    'ERROR')) SELECT question_id FROM ({_CONV})
  WHERE question_id NOT IN (SELECT conv_id FROM done)""")
def _(spark, d):
    asked = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id")).distinct()
    return ingest.pending_work(asked, answers(spark, d).drop("question_id").withColumnRenamed("conv_id", "question_id"))


@query("ev14_pending_scored", with_tables("fives") + """SELECT doc_id AS question_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM fives
  WHERE s0 <> -1 AND s1 <> -1 AND s2 <> -1 AND s3 <> -1 AND s4 <> -1)""")
def _(spark, d):
    scored = demo(spark, d, "fives").select(F.col("doc_id").alias("question_id"), F.col("doc_id").alias("ord"), F.array(*FIVE).alias("scores"), F.lit("x").alias("text"))
    return ingest.pending_work(table(spark, d, "documents").select(F.col("doc_id").alias("question_id")), scored, rule="scored")


@query("ev15_export_results", ANS + """SELECT answer_id AS question_id, 'a' || n_references || ' | b' AS references, round(turn / 3.0, 2) AS seconds,
    CASE WHEN n_references > 0 THEN n_references ELSE CAST(len(list_filter(string_split(text, '##'),
    lambda s: trim(s) <> '')) AS BIGINT) END AS documents_parsed
  FROM answers""")
def _(spark, d):
    rows = answers(spark, d).select(F.col("answer_id").alias("question_id"), "text", F.array(F.concat(F.lit("a"), F.col("n_references").cast("string")), F.lit("b")).alias("references"), (F.col("turn") / F.lit(3.0)).alias("seconds"), F.col("text").alias("context"), F.col("n_references").alias("kg_docs"))
    return ingest.export_results(rows).drop("text")


def raw_scores(spark, d):
    """Scores as JSON, some of it in fences and some broken off."""
    body = F.to_json(F.struct(F.struct(*CRITERIA).alias("scores")))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    raw = F.when(F.col("ord") % 9 == 0, F.concat(F.substring(body, 1, 11), F.lit('"scientifi'))).when(F.col("ord") % 2 == 0, fenced).otherwise(body)
    return demo(spark, d, "judged").select("ord", raw.alias("raw"))


@query("ev16_parse_llm_responses", with_tables("judged") + "SELECT ord, ok, " + ", ".join(f"CAST(CASE WHEN ok THEN {c} END AS BIGINT) AS {c}" for c in CRITERIA) + f" FROM (SELECT *, ord % 9 <> 0 AND {_ALL} AS ok FROM judged)")
def _(spark, d):
    return ingest.parse_judge_scores(raw_scores(spark, d), CRITERIA).select("ord", "ok", *CRITERIA)


@query("ev16_rejected_responses", with_tables("judged") + f"""SELECT ord, CASE WHEN ord % 9 = 0 THEN 'no json' ELSE 'missing' END AS reason, md5(CASE
    WHEN ord % 9 = 0 THEN '{{\"scores\":{{\"scientifi' END) AS raw_md5
  FROM judged WHERE ord % 9 = 0 OR NOT ({_ALL})""")
def _(spark, d):
    rejected = ingest.split_responses(raw_scores(spark, d), CRITERIA)[1]
    return rejected.select("ord", "reason", F.when(F.col("reason") == "no json", F.md5(F.col("raw").cast("binary"))).alias("raw_md5"))


@query("ev16_parse_profiles", with_tables("profiles") + """SELECT question_id, CASE WHEN question_id % 4 = 0 THEN 'continuous'
    ELSE question_type END AS question_type,
    CASE WHEN question_id % 4 = 0 THEN 0.5 ELSE CAST(complexity AS DOUBLE) END AS complexity,
    CASE WHEN question_id % 4 = 0 THEN NULL ELSE CAST(confidence AS DOUBLE) END AS confidence
  FROM profiles""")
def _(spark, d):
    p = demo(spark, d, "profiles")
    body = F.to_json(F.struct(F.struct(F.concat(F.lit(" "), F.upper("question_type")).alias("question_type"), "complexity", "confidence").alias("profile")))
    raw = F.when(F.col("question_id") % 4 == 0, F.lit("no json")).otherwise(body)
    return ingest.parse_profiles(p.select("question_id", raw.alias("raw"))).select("question_id", "question_type", "complexity", "confidence")
