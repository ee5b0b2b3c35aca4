"""Queries on routing, retrieval, text features and chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.functions import text as T
from evspark.operators import chunks as C
from evspark.operators import retrieve, route
from evspark.plans.rules import CONFIG
from evspark.sources.demo import demo, with_tables
from evspark.sources.scratch import written

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: longs(f(spark, d))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that both engines agree on types."""
    return df.select(*[F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: In the SQL, lower-casing as Spark does it: the dotted capital I gives two signs. Blanks are trimmed by name, as other spaces stay.
LOWER = "lower(replace({0}, chr(304), 'i' || chr(775)))"
TOKENS = f"regexp_extract_all({LOWER}, '[a-z][a-z0-9\\-]{{{{1,}}}}')"
KIND_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(q, '{p.replace(chr(39), chr(39) * 2)}')" + (" AND (" + " OR ".join(f"contains(q, '{w}')" for w in T.ACTING) + ")" if n == "mechanism" else "") + f" THEN '{n}'" for n, p in T.TYPE_PATTERNS
) + " ELSE 'continuous' END"
PROFILE_SQL = f"""p0 AS (SELECT doc_id, lower(text) AS q FROM documents), p1 AS (SELECT doc_id, q, {KIND_SQL} AS question_type FROM p0),
p2 AS (SELECT doc_id, question_type,
  round_even(least(1.0, 0.25 + 0.015 * len(list_filter(regexp_split_to_array(q, '[ \\t\\n\\x0B\\f\\r]+'),
    lambda w: w <> '')) + 0.1 * ({" + ".join(f"len(regexp_extract_all(q, '{w}'))" for w in T.JOINERS)})), 2) AS complexity,
  round_even(least(1.0, 0.15 + 0.25 * (CAST(regexp_matches(q, '\\b[0-9]{{2,4}}\\b') AS INT) + CAST(regexp_matches(q,
    '%|percent|percentage|fraction|rate|trend|magnitude|amount|volume') AS INT) + CAST(question_type = 'quantitative' AS INT))), 2) AS quantitativity,
  round_even(least(1.0, 0.1 + 0.25 * ({" + ".join(f"CAST(contains(q, '{w}') AS INT)" for w in T.PLACES)})), 2) AS spatial_specificity,
  round_even(least(1.0, 0.1 + CASE WHEN regexp_matches(q, '\\b(19|20)[0-9]{{2}}\\b') THEN 0.4 ELSE 0.0 END + CASE WHEN regexp_matches(q,
    '\\b(decade|past [0-9]+ years|since|between [0-9]{{4}})\\b') THEN 0.3 ELSE 0.0 END), 2) AS temporal_specificity,
  round_even(CASE WHEN {" OR ".join(f"contains(q, '{w}')" for w in T.METHODS)} THEN 0.5 ELSE 0.1 END + CASE
    WHEN {" OR ".join(f"contains(q, '{w}')" for w in T.CHECKS)} THEN 0.3 ELSE 0.0 END, 2) AS methodological_depth,
  0.85 AS confidence FROM p1)"""


def profiled(spark, d):
    return T.with_profile(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


@query("ev25_heuristic_profile", f"""WITH {PROFILE_SQL} SELECT doc_id, question_type, CAST(complexity AS DOUBLE) AS complexity,
    CAST(quantitativity AS DOUBLE) AS quantitativity,
    CAST(spatial_specificity AS DOUBLE) AS spatial_specificity, CAST(temporal_specificity AS DOUBLE) AS temporal_specificity,
    CAST(methodological_depth AS DOUBLE) AS methodological_depth, CAST(confidence AS DOUBLE) AS confidence
  FROM p2""")
def _(spark, d):
    got = profiled(spark, d)
    return got.select(*[F.col(c).cast("double").alias(c) if t.startswith(("dec", "dou")) else F.col(c) for c, t in got.dtypes])


RULE_SQL = """CASE WHEN (confidence IS NULL OR confidence < 0.6) AND question_type IN ('definition', 'factual') AND quantitativity < 0.45
    AND complexity < 0.60 THEN 'tier-1-def-parse-rescue'
 WHEN confidence IS NULL OR confidence < 0.6 THEN 'safety-tier3'
 WHEN question_type IN ('definition', 'factual') AND quantitativity < 0.45 AND complexity < 0.60 THEN 'tier-1-def'
 WHEN quantitativity >= 0.60 AND (spatial_specificity >= 0.60 OR temporal_specificity >= 0.60) THEN 'tier-2b'
 WHEN question_type IN ('mechanism', 'method_eval', 'comparison') AND (methodological_depth >= 0.55 OR (complexity >= 0.75
    AND methodological_depth >= 0.45)
   OR (question_type IN ('comparison', 'method_eval') AND methodological_depth >= 0.40) OR (question_type = 'mechanism'
    AND methodological_depth >= 0.45 AND complexity >= 0.60)) THEN 'tier-3'
 WHEN quantitativity >= 0.55 AND methodological_depth < 0.55 THEN 'tier-2a' WHEN complexity >= 0.40 THEN 'tier-m' WHEN complexity < 0.40 THEN 'tier-1'
    ELSE 'fallback' END"""
CONFIG_SQL = "config(rule_hit, model_name, evidence_mode, top_k_per_doc, per_doc_budget, global_budget, doc_filter_min_keep, use_draft, max_output_tokens) AS (VALUES " + ", ".join(
    "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in CONFIG
) + ")"
ROUTED_SQL = with_tables("profiles").rstrip() + f", {CONFIG_SQL}, routed AS (SELECT * FROM (SELECT *, {RULE_SQL} AS rule_hit FROM profiles) LEFT JOIN config USING (rule_hit))\n"


def routed(spark, d):
    return route.route(demo(spark, d, "profiles"))


@query("ev33_route", ROUTED_SQL + """SELECT question_id, rule_hit, model_name, evidence_mode, CAST(top_k_per_doc AS BIGINT) AS top_k_per_doc,
    CAST(global_budget AS BIGINT) AS global_budget, use_draft
  FROM routed""")
def _(spark, d):
    return routed(spark, d).select("question_id", "rule_hit", "model_name", "evidence_mode", "top_k_per_doc", "global_budget", "use_draft")


@query("ev34_route_histogram", ROUTED_SQL + """SELECT 'rule_hit' AS dimension, rule_hit AS value, count(*) AS n FROM routed GROUP BY ALL
  UNION ALL SELECT 'evidence_mode', evidence_mode, count(*) FROM routed GROUP BY ALL UNION ALL SELECT 'model_name', model_name, count(*)
  FROM routed GROUP BY ALL""")
def _(spark, d):
    return route.route_histogram(routed(spark, d))


@query("ev34_heuristic_histogram", f"WITH {PROFILE_SQL}, {CONFIG_SQL} SELECT rule_hit, count(*) AS n FROM (SELECT {RULE_SQL} AS rule_hit FROM p2) GROUP BY 1")
def _(spark, d):
    return route.route(profiled(spark, d)).groupBy("rule_hit").agg(F.count(F.lit(1)).alias("n"))


@query("ev34_route_health", ROUTED_SQL + """SELECT *, n_rules >= 3 AND n_fallback < 0.5 * total AND n_meaningful >= 2 AS healthy
  FROM (SELECT count(DISTINCT rule_hit) AS n_rules, count(*) AS total, count(*) FILTER (rule_hit = 'fallback') AS n_fallback,
    count(DISTINCT rule_hit) FILTER (rule_hit NOT IN ('fallback', 'safety-tier3')) AS n_meaningful
  FROM routed)""")
def _(spark, d):
    return route.route_health(routed(spark, d))


TARGETS = {"tier-1-def": 4, "tier-2b": 6, "tier-3": 5, "tier-2a": 3, "tier-m": 8, "tier-1": 7}
SCALED = route.scaled_targets(TARGETS, 60)


@query("ev35_probe_sample", with_tables("questions", "candidates") + """SELECT question_id, probe, rank FROM (SELECT *,
    max(CAST(chosen AS INT)) OVER () AS hit
  FROM (SELECT *, (probe = 'many' AND rank <= 2) OR (probe = 'few' AND rank = 1) AS chosen FROM
 (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY ord, question_id) AS rank
  FROM (SELECT question_id, ord, CASE WHEN n >= 24 THEN 'many' WHEN n BETWEEN 1 AND 20 THEN 'few' ELSE 'other' END AS probe
 FROM questions LEFT JOIN (SELECT question_id, count(*) AS n FROM candidates WHERE title <> '' GROUP BY 1) USING (question_id))))
  WHERE rank <= 3) WHERE CASE WHEN hit = 1 THEN chosen ELSE true END""")
def _(spark, d):
    n = demo(spark, d, "candidates").where("title <> ''").groupBy("question_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    return route.probe_sample(demo(spark, d, "questions").join(n, "question_id", "left"), many=24, few=20).select("question_id", "probe", "rank")


@query("ev35_tier_sample", ROUTED_SQL + ", t(rule_hit, target) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in SCALED.items()) + """)
    SELECT question_id, rule_hit, rank FROM (SELECT *, row_number() OVER (PARTITION BY rule_hit ORDER BY ord, question_id) AS rank FROM routed
  JOIN t USING (rule_hit)) WHERE rank <= target""")
def _(spark, d):
    return route.tier_sample(routed(spark, d), TARGETS, 60).select("question_id", "rule_hit", "rank")


@query("ev36_route_flags", ROUTED_SQL + """SELECT question_id, rule_hit = 'safety-tier3' AS is_safety, coalesce(confidence >= 0.6
    AND confidence < 0.7, false) AS is_borderline,
    CASE WHEN rule_hit IN ('tier-1-def', 'tier-1', 'fallback', 'tier-1-def-parse-rescue') THEN 'small' WHEN rule_hit IN ('tier-3',
    'safety-tier3') THEN 'large' ELSE 'medium' END AS bucket
  FROM routed""")
def _(spark, d):
    return route.route_flags(routed(spark, d)).select("question_id", "is_safety", "is_borderline", "bucket")


_R = [r.replace("'", "''") for r in route.QUALITY_RULES]
_NUM = "(quantitativity >= 0.5 OR needs_numeric_emphasis)"


@query("ev37_quality_rules", ROUTED_SQL + f"""SELECT question_id, len(r) AS n_answer_rules, coalesce(array_to_string(list_transform(r, lambda x,
    i: i || '. ' || x), chr(10)), '') AS answer_rules,
 question || CASE WHEN {_NUM} THEN ' [numbers]' ELSE '' END || CASE WHEN methodological_depth > 0.6 THEN ' [methods]' ELSE '' END AS query_hint

  FROM (SELECT *, list_filter([CASE WHEN evidence_mode IN ('excerpts_narrow', 'excerpts_full') THEN '{_R[0]}' END, CASE
    WHEN {_NUM} THEN '{_R[1]}' END,
    CASE WHEN {_NUM} THEN '{_R[2]}' END, CASE WHEN spatial_specificity >= 0.5 THEN '{_R[3]}' END, CASE
    WHEN temporal_specificity >= 0.5 THEN '{_R[4]}' END,
    CASE WHEN methodological_depth >= 0.6 THEN '{_R[5]}' END], lambda x: x IS NOT NULL) AS r
  FROM routed)""")
def _(spark, d):
    return route.quality_rules(routed(spark, d)).select("question_id", "n_answer_rules", "answer_rules", "query_hint")


UNIT_LIST = "[" + ", ".join(f"'{u}'" for u in T.UNITS) + "]"


@query("ev17_tokens", f"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct,
    md5(coalesce(array_to_string(list_sort(list_distinct(t)), ' '), '')) AS tokens_md5
  FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)""")
def _(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.md5(F.array_join(F.array_sort(F.array_distinct(t)), " ").cast("binary")).alias("tokens_md5"))


@query("ev18_19_24_text_columns", with_tables("candidates") + """SELECT doc_id, CAST(greatest(1, len(abstract) // 4) AS BIGINT) AS tokens,
    'W' || doc_id AS work_id, CASE WHEN len(abstract) > 1400 THEN left(abstract,
    1400) || '...' ELSE abstract END AS preview
  FROM candidates""")
def _(spark, d):
    return demo(spark, d, "candidates").select("doc_id", T.est_tokens(F.col("abstract")).alias("tokens"), T.work_id(F.col("uri")).alias("work_id"), T.abstract_preview(F.col("abstract")).alias("preview"))


def numbers_sql(text: str) -> str:
    """How many numbers a text has (null: none), without looking around: borders are marked in the digits instead.

    A digit after a letter can begin no number and becomes chr(2), or chr(3) where a letter follows as well; any other digit before a letter
    becomes chr(1). So a run of plain digits never ends at a letter, and a chr(1) is in a number only where an exponent follows it; of
    that, the last digit is left for the next number where a letter follows. A sign changes no count, so it is left out.
    """
    text = f"translate(coalesce({text}, ''), chr(1) || chr(2) || chr(3), '   ')"
    for pattern, left in (("'([A-Za-z_])[0-9]'", "'\\1' || chr(2)"), ("'[0-9]([A-Za-z_])'", "chr(1) || '\\1'"), ("chr(2) || '([A-Za-z_])'", "chr(3) || '\\1'")):
        text = f"regexp_replace({text}, {pattern}, {left}, 'g')"
    exponent = r"[eE](?:[+-][0-9]+|\x02[0-9]*)"
    return f"len(regexp_extract_all({text}, '(?:[0-9]+[.,])?[0-9]*\\x01{exponent}|[0-9]+(?:[.,][0-9]+)?'))"


_COUNTED = "replace(text, 'e', 'e5 1.5e3, x7 7-') || ' -3,1e5 12km 3.14 2e5x'"


@query("ev20_numeric_count", f"SELECT doc_id, {numbers_sql('text')} AS n_numbers, {numbers_sql('(' + _COUNTED + ')')} AS n_more FROM documents")
def _(spark, d):
    more = F.expr(_COUNTED)
    return table(spark, d, "documents").select("doc_id", T.numeric_count(F.col("text")).alias("n_numbers"), T.numeric_count(more).alias("n_more"))


@query("ev21_unit_hits", f"SELECT doc_id, len(list_intersect(list_distinct({TOKENS.format('text')}), {UNIT_LIST})) AS n_units FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.unit_hits(F.col("text")).alias("n_units"))


HEADS = ("Methods", "2. Results", "STUDY AREA", "Discussion:", "3.1 Conclusions and outlook", "References", "INTRODUCTION", "Data and methods", "appendix")
_H = "CASE CAST(floor(line_no / 7) AS BIGINT) % 9 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS)) + " END"


def lines(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    line = F.expr(f"CASE WHEN line_no % 7 = 6 THEN {_H} ELSE raw END")
    return rows.select("doc_id", (F.floor(F.col("line_no") / 40) + 1).cast("int").alias("page"), "line_no", line.alias("line"))


LINES_SQL = f"""lines AS (SELECT doc_id, CAST(floor(line_no / 40) AS BIGINT) + 1 AS page, line_no, CASE WHEN line_no % 7 = 6 THEN {_H}
    ELSE raw END AS line
  FROM (SELECT doc_id, unnest(range(0, len(s))) AS line_no, unnest(s) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS s
  FROM documents)))"""
_LOW = "trim(" + LOWER.format("coalesce(nullif(regexp_extract(core, '^(?:[0-9IVX]+\\.?[0-9\\.]*)[ \\t\\n\\x0B\\f\\r]+([A-Z][A-Za-z /\\\\-]{2,60})(?:\\r\\n|[\\n\\r\\x{85}\\x{2028}\\x{2029}])?$', 1), ''), core)") + ", ' ')"
_LONGER = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1)  # letters whose capitals are several signs
HEAD_SQL = "CASE WHEN len(line) = 0 OR len(line) > 90 THEN NULL " + " ".join(f"WHEN starts_with({_LOW}, '{n}') THEN '{n}'" for n, _ in T.SECTION_WEIGHTS if n != "unknown") + " " + " ".join(
    f"WHEN core = upper(core) AND NOT regexp_matches(core, '[{_LONGER}]') AND core <> lower(core) AND len(core) BETWEEN 3 AND 60 AND NOT ends_with(core, '.') AND contains({LOWER.format('core')}, '{n}') THEN '{n}'" for n, _ in T.SECTION_WEIGHTS
) + " END"


@query("ev22_detect_heading", f"""WITH {LINES_SQL} SELECT heading, count(*) AS n FROM (SELECT {HEAD_SQL} AS heading FROM (SELECT line, trim(line,
    ' .:') AS core FROM lines))
  WHERE heading IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return lines(spark, d).select(T.detect_heading(F.col("line")).alias("heading")).where("heading IS NOT NULL").groupBy("heading").agg(F.count(F.lit(1)).alias("n"))


SECTIONS_SQL = f"""{LINES_SQL}, marked AS (SELECT *, {HEAD_SQL} AS name FROM (SELECT *, trim(line, ' .:') AS core
  FROM (SELECT doc_id, page, line_no, trim(line, ' ') AS line FROM lines))),
numbered AS (SELECT *, CAST(sum(CAST(name IS NOT NULL AS INT)) OVER w AS BIGINT) AS section_no, lead(page) OVER w AS next_page
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY page, line_no)),
sections AS (SELECT *
  FROM (SELECT doc_id, section_no, coalesce(max(name), 'unknown') AS heading, coalesce(string_agg(line, ' ' ORDER BY page,
    line_no) FILTER (name IS NULL AND line <> ''), '') AS text,
 CASE WHEN section_no = 0 THEN 1 ELSE min(page) END AS page_start, max(coalesce(next_page, page)) AS page_end FROM numbered
  GROUP BY doc_id, section_no) WHERE text <> '')"""


@query("ev23_sectionize", f"WITH {SECTIONS_SQL} SELECT doc_id, section_no, heading, text, page_start, page_end FROM sections")
def _(spark, d):
    return C.sectionize(lines(spark, d))


def chunks_sql(target: int, overlap: int) -> str:
    """Sentences by a mark put where they part (a mark that the text has is kept apart), then one step of the fold for each sentence."""
    return f"""{SECTIONS_SQL},
sents AS (SELECT doc_id, section_no, heading, page_start, list_transform(string_split(regexp_replace(replace(text, chr(1), chr(1) || 'a'),
    '([.!?])[ \\t\\n\\x0B\\f\\r]+([A-Z0-9])', '\\1' || chr(1) || 'b\\2', 'g'), chr(1) || 'b'), lambda x: replace(x, chr(1) || 'a', chr(1))) AS s
  FROM sections),
sized AS (SELECT *, list_transform(s, lambda x: CAST(greatest(1, len(x) // 4) AS BIGINT)) AS t FROM sents),
fold AS (SELECT doc_id, section_no, t, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS first, CAST(0 AS HUGEINT) AS n, CAST(NULL AS BIGINT) AS a,
    CAST(NULL AS BIGINT) AS b
  FROM sized
  UNION ALL
  SELECT doc_id, section_no, t, i + 1, CASE WHEN f THEN j ELSE first END, CASE WHEN f THEN coalesce(list_sum(t[j + 1:i]), 0) ELSE n END + t[i + 1],
    CASE WHEN f THEN first END, CASE WHEN f THEN i END
  FROM (SELECT *, n + t[i + 1] > {target} AND i > first AS f,
    CASE WHEN n + t[i + 1] > {target} THEN list_min(list_filter(range(first, i + 1), lambda q: coalesce(list_sum(t[q + 1:i]),
    0) <= {overlap})) END AS j
  FROM fold WHERE i < len(t))),
closed AS (SELECT doc_id, section_no, a, b FROM fold WHERE a IS NOT NULL UNION ALL SELECT doc_id, section_no, first, i FROM fold WHERE i = len(t)),
chunks AS (SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY b) - 1 AS chunk_no, lower(heading) AS section,
    page_start AS page,
  trim(array_to_string(s[a + 1:b], ' '), ' ') AS text, CAST(list_sum(t[a + 1:b]) AS BIGINT) AS tokens FROM closed JOIN sized USING (doc_id, section_no))"""


@query("ev26_chunk", f"WITH RECURSIVE {chunks_sql(600, 60)} SELECT doc_id, section_no, chunk_no, section, page, text, tokens FROM chunks")
def _(spark, d):
    return C.chunk(C.sectionize(lines(spark, d)))


PAIRS_SQL = "list_transform(list_sort(list({'pos': pos, 'f': [attribute, value, description]})), lambda p: p.f)"

@query("ev27_query_terms", with_tables("questions", "av_pairs").rstrip() + f""", flat AS (SELECT question_id, question, flatten(p) AS f FROM questions
    JOIN (SELECT question_id, {PAIRS_SQL} AS p FROM av_pairs
  GROUP BY 1) USING (question_id))
SELECT question_id, array_to_string(list_sort(list_filter(list_distinct(list_concat({TOKENS.format('question')}, flatten(list_transform(f,
    lambda x: {TOKENS.format('x')})))), lambda w: len(w) >= 3)), ' ') AS keywords,
array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(f, lambda x: trim(x, ' ')), lambda x: x <> '' AND len(x) <= 40),
    lambda x: {LOWER.format('x')}))),
    '|') AS literals
  FROM flat""")
def _(spark, d):
    got = C.query_terms(demo(spark, d, "questions"), demo(spark, d, "av_pairs"))
    return got.select("question_id", F.array_join(F.array_sort("keywords"), " ").alias("keywords"), F.array_join(F.array_sort("literals"), "|").alias("literals"))


def scored_chunks(spark, d):
    asked = demo(spark, d, "candidates").select("doc_id", "question_id", F.col("idx").alias("doc_index"))
    chunks = C.chunk(C.sectionize(lines(spark, d)), 120, 20).join(asked, "doc_id")
    return C.score_chunks(chunks, C.query_terms(demo(spark, d, "questions"), demo(spark, d, "av_pairs")))


@query("ev28_score_chunks")  # its SQL is below
def _(spark, d):
    return scored_chunks(spark, d).withColumn("score", F.round("score", 6)).drop("text")


BUDGETS = {"per_doc_budget": 400, "top_k_per_doc": 4, "global_budget": 3000}


def ranked_chunks(spark, d):
    """Chunks with a score of words and literals alone, and budgets."""
    asked = demo(spark, d, "candidates").select("doc_id", "question_id", F.col("idx").alias("doc_index"))
    chunks = C.chunk(C.sectionize(lines(spark, d)), 120, 20).join(asked, "doc_id")
    joined = chunks.join(C.query_terms(demo(spark, d, "questions"), demo(spark, d, "av_pairs")), "question_id")
    words = F.size(F.array_intersect("keywords", T.tokens(F.col("text"))))
    score = words + 0.25 * F.size(F.filter("literals", lambda x: F.instr(F.lower("text"), x) > 0))
    return joined.withColumn("score", score).drop("keywords", "literals").withColumns({k: F.lit(v) for k, v in BUDGETS.items()})


def kept_chunks(spark, d):
    return C.topk_under_budget(ranked_chunks(spark, d))


RANKED_SQL = "WITH RECURSIVE " + with_tables("questions", "av_pairs", "candidates")[5:].rstrip() + f""", {chunks_sql(120, 20)},
flat AS (SELECT question_id, question, flatten(p) AS f FROM questions JOIN (SELECT question_id, {PAIRS_SQL} AS p FROM av_pairs
  GROUP BY 1) USING (question_id)),
terms AS (SELECT question_id, list_filter(list_distinct(list_concat({TOKENS.format('question')}, flatten(list_transform(f,
    lambda x: {TOKENS.format('x')})))),
    lambda w: len(w) >= 3) AS w,
  list_distinct(list_transform(list_filter(list_transform(f, lambda x: trim(x, ' ')), lambda x: x <> '' AND len(x) <= 40), lambda x: {LOWER.format('x')})) AS l
  FROM flat),
ranked AS (SELECT k.*, c.question_id, idx AS doc_index, len(list_intersect(w, list_distinct({TOKENS.format('k.text')}))) + 0.25 * len(list_filter(l,
    lambda x: contains({LOWER.format('k.text')}, x))) AS score
  FROM chunks k JOIN candidates c USING (doc_id) JOIN terms USING (question_id)),
head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY score DESC, section_no, chunk_no) AS place
  FROM ranked) WHERE place <= {3 * BUDGETS['top_k_per_doc']}),
pick AS (SELECT DISTINCT question_id, doc_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS used, 0 AS n, false AS took FROM head
  UNION ALL SELECT question_id, doc_id, h, used + CASE WHEN fits THEN tokens ELSE 0 END, n + CAST(fits AS INT), fits
 
  FROM (SELECT p.question_id, p.doc_id, h.place AS h, used, n, tokens, used + tokens <= {BUDGETS['per_doc_budget']}
    AND n < {BUDGETS['top_k_per_doc']} AS fits
    FROM pick p JOIN head h ON h.question_id = p.question_id AND h.doc_id = p.doc_id AND h.place = p.place + 1)),
kept AS (SELECT head.* EXCLUDE (place) FROM head JOIN pick USING (question_id, doc_id, place) WHERE took)"""
_WEIGHT = "CASE " + " ".join(f"WHEN starts_with(section, '{n}') THEN {w}" for n, w in T.SECTION_WEIGHTS) + " ELSE 1.0 END"
SCORED_SQL = "WITH RECURSIVE " + with_tables("questions", "av_pairs", "candidates")[5:].rstrip() + f""", {chunks_sql(120, 20)},
flat AS (SELECT question_id, question, flatten(p) AS f FROM questions JOIN (SELECT question_id, {PAIRS_SQL} AS p FROM av_pairs GROUP BY 1) USING (question_id)),
terms AS (SELECT question_id,
    list_filter(list_distinct(list_concat({TOKENS.format('question')}, flatten(list_transform(f, lambda x: {TOKENS.format('x')})))), lambda w: len(w) >= 3) AS w,
    list_distinct(list_transform(list_filter(list_transform(f, lambda x: trim(x, ' ')), lambda x: x <> '' AND len(x) <= 40), lambda x: {LOWER.format('x')})) AS l
  FROM flat),
parts AS (SELECT k.* EXCLUDE (text), question_id, idx AS doc_index, list_distinct({TOKENS.format('k.text')}) AS words, w,
    len(list_filter(l, lambda x: contains({LOWER.format('k.text')}, x))) AS literals, {numbers_sql('k.text')} AS numbers
  FROM chunks k JOIN candidates c USING (doc_id) JOIN terms USING (question_id))
SELECT * EXCLUDE (words, w, literals, numbers), CASE WHEN len(words) = 0 THEN 0 ELSE round((
    len(list_intersect(w, words)) / (sqrt(CAST(len(w) AS DOUBLE)) + CAST(0.000001 AS DOUBLE)) + CAST(0.25 AS DOUBLE) * literals
    + least(CAST(0.6 AS DOUBLE), CAST(0.05 AS DOUBLE) * numbers) + least(CAST(0.3 AS DOUBLE), CAST(0.05 AS DOUBLE) * len(list_intersect(words, {UNIT_LIST})))
  ) * CAST({_WEIGHT} AS DOUBLE), 6) END AS score FROM parts"""
ORACLES["ev28_score_chunks"] = SCORED_SQL
CHOSEN_SQL = RANKED_SQL + f""", queue AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_index, section_no,
    chunk_no) AS place FROM kept),
taken AS (SELECT DISTINCT question_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS used, false AS took FROM queue
  UNION ALL SELECT question_id, h, used + CASE WHEN fits THEN tokens ELSE 0 END, fits
  FROM (SELECT p.question_id, q.place AS h, used, tokens, used + tokens <= {BUDGETS['global_budget']} AS fits FROM taken p
  JOIN queue q ON q.question_id = p.question_id AND q.place = p.place + 1)),
chosen AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY doc_index, page, place) AS excerpt_no FROM queue
  JOIN taken USING (question_id, place) WHERE took)"""


@query("ev29_topk_under_budget", RANKED_SQL + " SELECT question_id, doc_id, section_no, chunk_no, tokens, CAST(score AS DOUBLE) AS score FROM kept")
def _(spark, d):
    return kept_chunks(spark, d).select("question_id", "doc_id", "section_no", "chunk_no", "tokens", F.col("score").cast("double").alias("score"))


def excerpts(spark, d):
    return C.global_budget_select(kept_chunks(spark, d))


@query("ev30_global_budget_select", CHOSEN_SQL + " SELECT question_id, excerpt_no, doc_id, section_no, chunk_no, page, tokens, round(CAST(score AS DOUBLE), 3) AS score FROM chosen")
def _(spark, d):
    return excerpts(spark, d).select("question_id", "excerpt_no", "doc_id", "section_no", "chunk_no", "page", "tokens", F.col("score").cast("double").alias("score"))


PER_DOC_SQL = """, per AS (SELECT question_id, doc_id, coalesce(download_status, 'unknown') AS status, coalesce(m, 0) AS n_chunks, coalesce(kn,
    0) AS kept, coalesce(kt, 0) AS kept_tokens,
  CASE WHEN download_status = 'ok' THEN 'ok' WHEN download_status IN ('already_failed', 'pdf_download_failed', 'no_oa_pdf') THEN 'paywalled'
    ELSE 'other' END AS bucket
  FROM candidates LEFT JOIN (SELECT doc_id, count(*) AS m FROM ranked GROUP BY 1) USING (doc_id) LEFT
  JOIN (SELECT doc_id, count(*) AS kn, CAST(sum(tokens) AS BIGINT) AS kt FROM kept GROUP BY 1) USING (doc_id))"""


def per_document(spark, d):
    """(a row for each document, the kept chunks): chunks are made and scored once and written without their texts."""
    docs = demo(spark, d, "candidates").select("question_id", "doc_id", F.col("download_status").alias("status"))
    ranked = written(ranked_chunks(spark, d).drop("text"))
    kept = written(C.topk_under_budget(ranked))
    return C.document_excerpts(docs, ranked, kept), kept


@query("ev31_document_excerpts", RANKED_SQL + PER_DOC_SQL + " SELECT question_id, doc_id, status, bucket, n_chunks, kept, kept_tokens FROM per")
def _(spark, d):
    return per_document(spark, d)[0].select("question_id", "doc_id", "status", "bucket", "n_chunks", "kept", "kept_tokens")


@query("ev31_excerpt_stats", CHOSEN_SQL + PER_DOC_SQL + """ SELECT *, docs_with_chunks < 0.5 * n_docs AS low_coverage
  FROM (SELECT question_id, count(*) AS n_docs, count(*) FILTER (kept > 0) AS docs_with_chunks,
  count(*) FILTER (bucket = 'ok') AS n_ok, count(*) FILTER (bucket = 'paywalled') AS n_paywalled, count(*) FILTER (bucket = 'other') AS n_other
  FROM per GROUP BY 1)
  JOIN (SELECT p.question_id, count(c.doc_id) AS n_excerpts, CAST(coalesce(sum(c.tokens), 0) AS BIGINT) AS total_tokens
  FROM (SELECT DISTINCT question_id FROM per) p LEFT JOIN chosen c ON c.question_id = p.question_id GROUP BY 1) USING (question_id)""")
def _(spark, d):
    per_doc, kept = per_document(spark, d)
    return C.excerpt_stats(per_doc, C.global_budget_select(kept))


def _bm25_sql(k: int) -> str:
    return with_tables("questions", "candidates").rstrip() + f""", qt AS (SELECT DISTINCT question_id, unnest({TOKENS.format('question')}) AS term
    FROM questions),
fields AS (SELECT doc_id, 'title' AS field, {TOKENS.format('title')} AS words FROM candidates
  UNION ALL SELECT doc_id, 'abstract', {TOKENS.format('abstract')} FROM candidates),
size AS (SELECT field, count(*) AS n, avg(len(words)) AS al FROM fields GROUP BY 1),
post AS (SELECT doc_id, field, len(words) AS l, unnest(words) AS term FROM fields), tf AS (SELECT doc_id, field, l, term, count(*) AS tf
  FROM post WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
bt AS (SELECT term, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))) AS part FROM tf
  JOIN df USING (field, term) JOIN size USING (field) GROUP BY ALL),
sc AS (SELECT question_id, doc_id, round(sum(part), 6) AS score FROM qt JOIN bt USING (term) GROUP BY ALL)
SELECT question_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank
  FROM sc) WHERE rank <= {k}"""


def hits(spark, d):
    return retrieve.bm25_topk(demo(spark, d, "questions"), demo(spark, d, "candidates"), 16)


@query("ev06_bm25_topk", _bm25_sql(16))
def _(spark, d):
    return hits(spark, d)


def graph(spark, d):
    orders, parts, items = (table(spark, d, t) for t in ("orders", "part", "lineitem"))
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("abstract"))
    keywords = parts.select(F.col("p_partkey").alias("keyword_id"), F.col("p_name").alias("name"))
    edges = items.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("keyword_id")).agg((F.max("l_quantity") / 50).alias("score"))
    return docs, keywords, edges


@query("ev05_kg_expand", """WITH edges AS (SELECT l_orderkey AS doc_id, l_partkey AS keyword_id, max(l_quantity) / 50 AS score FROM lineitem
  GROUP BY ALL HAVING max(l_quantity) / 50 >= 0.3),
first AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword_id) AS rank FROM edges QUALIFY rank <= 3),
second AS (SELECT keyword_id, doc_id AS other_id, score AS s2, row_number() OVER (PARTITION BY keyword_id ORDER BY score DESC, doc_id) AS place
  FROM edges JOIN orders ON o_orderkey = doc_id WHERE o_orderkey % 7 <> 0 QUALIFY place <= 2)
SELECT o_custkey AS question_id, first.doc_id, rank, keyword_id, p_name AS name, score AS keyword_score,
    coalesce(string_agg(place || ':' || other_id || ':' || round(s2, 4), ' ' ORDER BY place), '') AS secondary
FROM first JOIN orders ON o_orderkey = first.doc_id JOIN part ON p_partkey = keyword_id LEFT JOIN second USING (keyword_id) GROUP BY ALL""")
def _(spark, d):
    docs, keywords, edges = graph(spark, d)
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("doc_id"))
    got = retrieve.kg_expand(asked, docs, keywords, edges)
    line = F.transform("secondary", lambda s: F.concat_ws(":", s["place"].cast("string"), s["doc_id"].cast("string"), F.round(s["score"], 4).cast("string")))
    return got.withColumn("secondary", F.array_join(line, " "))


@query("ev32_tfidf_cosine", with_tables("questions", "candidates").rstrip() + f""", docs AS (SELECT question_id, idx,
    {TOKENS.format("abstract || ' ' || title")} AS w FROM candidates
  UNION ALL SELECT question_id, -1, {TOKENS.format('question')} FROM questions),
size AS (SELECT question_id, count(*) AS n FROM docs GROUP BY 1), tf AS (SELECT question_id, idx, term, count(*) / l AS tf
  FROM (SELECT question_id, idx, len(w) AS l, unnest(w) AS term FROM docs) GROUP BY question_id, idx, term, l),
df AS (SELECT question_id, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf JOIN size USING (question_id) GROUP BY question_id, term, n),
v AS (SELECT question_id, idx, term, tf * idf AS x FROM tf
  JOIN df USING (question_id, term)), nrm AS (SELECT question_id, idx, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL),
dot AS (SELECT a.question_id, a.idx, sum(a.x * b.x) AS dot FROM v a
  JOIN v b ON a.question_id = b.question_id AND a.term = b.term AND b.idx = -1 WHERE a.idx >= 0 GROUP BY ALL)
SELECT c.question_id, c.idx, round(coalesce(dot / (n.norm * q.norm), 0), 3) AS similarity FROM candidates c LEFT
  JOIN dot USING (question_id, idx) LEFT JOIN nrm n USING (question_id, idx) LEFT JOIN nrm q ON q.question_id = c.question_id AND q.idx = -1""")
def _(spark, d):
    return retrieve.tfidf_cosine(demo(spark, d, "questions"), demo(spark, d, "candidates"))
