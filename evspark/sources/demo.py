"""The given tables as questions, candidates, pairs, profiles, lines, answers, scores and logs.

Each table is a select of expressions that Spark and DuckDB read alike, so the same text serves as
the query's input and as a common table expression of its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KINDS = ("definition", "mechanism", "comparison", "quantitative", "method_eval", "application", "continuous", "factual")


def _case(index: str, values) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_N = "(SELECT count(*) FROM benchmark)"
_TITLE = "left(split_part(text, chr(10), 1), 100)"
_SCORE = "CASE WHEN (doc_id * {k} + 3) % 97 = 0 THEN NULL ELSE CAST((doc_id * {m} + {sq}) % 10 + 1 AS INT) END"
CRITERIA = (
    "scientific_accuracy", "relevance", "completeness", "directness", "quantitative_precision", "response_structure", "scope_awareness", "helpfulness",
)

TABLES = {
    "questions": "SELECT item_id AS question_id, item_id AS ord, text AS question FROM benchmark",
    "candidates": f"""SELECT doc_id % {_N} AS question_id, CAST(floor(doc_id / {_N}) AS BIGINT) AS idx, doc_id,
      CASE WHEN doc_id % 13 = 0 THEN 'RETRACTED: ' WHEN doc_id % 17 = 0 THEN 'Trend unlikely: ' ELSE '' END || CASE WHEN doc_id % 19 = 4 THEN ''
    ELSE {_TITLE} END AS title, text AS abstract,
      'https://openalex.org/W' || CAST(doc_id AS STRING) AS uri, CASE WHEN doc_id % 11 = 0 THEN 'withdrawn' END AS status,
      CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 5 = 1 THEN 'already_failed' ELSE 'ok' END AS download_status
      FROM documents""",
    "av_pairs": """SELECT item_id AS question_id, pos, split_part(text, ' ', 1 + pos) AS attribute, split_part(text, ' ', 4 + pos) AS value,
      split_part(text, ' ', 7 + pos) || ' ' || split_part(text, ' ', 8 + pos) AS description, ((item_id * 7 + pos * 13) % 21) / 20.0 AS centrality
      FROM benchmark, (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS p""",
    "profiles": f"""SELECT doc_id AS question_id, doc_id AS ord, text AS question, {_case("doc_id % 8", KINDS)} AS question_type,
      (doc_id * 7 % 101) / 100.0 AS complexity, (doc_id * 11 % 101) / 100.0 AS quantitativity, (doc_id * 13 % 101) / 100.0 AS spatial_specificity,
      (doc_id * 17 % 101) / 100.0 AS temporal_specificity, (doc_id * 19 % 101) / 100.0 AS methodological_depth,
    doc_id % 9 = 0 AS needs_numeric_emphasis,
      CASE WHEN doc_id % 23 = 0 THEN NULL ELSE 0.5 + (doc_id * 3 % 51) / 100.0 END AS confidence FROM documents""",
    "answers": f"""SELECT conv_id * 1000 + turn AS answer_id, conv_id % {_N} AS question_id, conv_id, turn, turn AS ord,
      CASE WHEN turn % 7 = 6 THEN '' ELSE 'question ' || CAST(conv_id AS STRING) END AS question,
      CASE WHEN conv_id % 19 = 0 THEN 'ERROR: '
    ELSE '' END || text || ' [' || CAST(turn % 5 + 1 AS STRING) || '][' || CAST((turn + conv_id) % 7 + 1 AS STRING) || ', '
      || CAST(conv_id % 40 + 1 AS STRING) || '] with 42.7 and 2020, 3, 77. PM10 and CO15 rose by 2.5, 0.83 or -4.5 of 10-20 [' || CAST(turn % 3 + 1 AS STRING) || ' 2] é7 ['
      || CAST(turn % 4 + 2 AS STRING) || ' , 1]; 12.50 is 1999.5 but not 5é.' || CASE WHEN conv_id % 3 = 0
    THEN chr(10) || '## References' || chr(10) || '[1] A (2001). T. https://openalex.org/W'
      || CAST(conv_id AS STRING) || chr(10) || '[2] Unknown (n.d.). T.' ELSE '' END AS text, CASE
    WHEN conv_id % 2 = 0 THEN text || ' 77. A 142.75 of 2.50 and x-20' ELSE text || ' 0.835' END AS context,
      {_case("turn % 7", ("tier-1-def", "tier-2b", "tier-3", "tier-2a", "tier-m", "tier-1", "fallback"))} AS rule_hit, turn % 2 = 0 AS use_draft,
    conv_id % 4 AS n_references
      FROM conversations WHERE role = 'assistant'""",
    "judged": f"""SELECT CAST(floor(doc_id / 4) AS BIGINT) AS question_id,
    {_case("doc_id % 4", ("zero_shot", "two_step", "no_ontology", "ontology"))} AS pipeline, doc_id AS ord,
      {", ".join(_SCORE.format(k=k + 5, m=2 * k + 3, sq=k * k) + " AS " + c for k, c in enumerate(CRITERIA))} FROM documents""",
    "fives": f"""SELECT doc_id,
    {", ".join(f"CAST(CASE WHEN doc_id % 29 = {k} THEN -1 WHEN doc_id % 6 = 0 THEN 5 WHEN doc_id % 6 = 1 THEN 4 ELSE (doc_id * {2 * k + 3} + {k * k}) % 5 + 1 END AS INT) AS s{k}" for k in range(5))}
  FROM documents""",
    "metrics": f"""SELECT doc_id AS ord, {_case("doc_id % 4", ("a", "b", "c", "d"))} AS pipeline,
      {", ".join(f"CASE WHEN doc_id % {7 + k} = 0 THEN -1.0 ELSE (doc_id * {3 + 2 * k} % 11) / 10.0 END AS m{k}" for k in range(3))},
    doc_id % 10 = 3 AS failed
  FROM documents""",
    "runs": """SELECT event_id, CAST(user_id % 5 AS STRING) AS pipeline, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
    value AS seconds
  FROM events""",
    "errors": f"""SELECT event_id,
    {_case("event_id % 8", ("Rate limit hit", "TypeError: x", "Bad Gateway", "weird", "Read timeout", "Invalid API key, timeout", "EOF", "502"))} AS message,
      CAST(CASE WHEN event_id % 31 = 0 THEN 429 WHEN event_id % 37 = 0 THEN 503 END AS INT) AS status FROM events""",
    "works": """SELECT 'W' || CAST(doc_id AS STRING) AS work_id, CASE WHEN doc_id % 31 = 7 THEN ' ' ELSE left(split_part(text, chr(10), 1), 100) END AS title,
    CAST(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1990 + doc_id % 35 END AS INT) AS year,
      doc_id % 4 AS n_authors, 'Author' || CAST(doc_id % 50 AS STRING) AS lead, doc_id % 10 = 0 AS is_retracted,
    CASE WHEN doc_id % 29 = 5 THEN '' ELSE 'https://openalex.org/W' || CAST(doc_id AS STRING) END AS uri,
      CASE WHEN doc_id % 3 = 0 THEN 'https://a.org/' || CAST(doc_id AS STRING) || '.pdf'
    WHEN doc_id % 3 = 1 THEN 'https://a.org/x.pdf?v=' || CAST(doc_id AS STRING) END AS best_pdf,
      'https://www.mdpi.com/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 4 = 1 THEN '/?a=b#c' WHEN doc_id % 4 = 2 THEN '/pdf/'
    ELSE '' END AS best_page,
      CASE WHEN doc_id % 4 = 0 THEN 'https://b.org/x.PDF' WHEN doc_id % 4 = 1 THEN 'http://mdpi.com/1/2#3' END AS primary_pdf,
      CASE WHEN doc_id % 5 = 0 THEN 'https://www.mdpi.com/' || CAST(doc_id AS STRING)
      WHEN doc_id % 5 = 1 THEN 'https://acp.copernicus.org/articles/20/' || CAST(doc_id AS STRING) || '/2020/acp-x.html'
      WHEN doc_id % 5 = 2 THEN 'https://os.copernicus.org/articles/7/8/' END AS oa_url,
      CASE WHEN doc_id % 6 = 0 THEN 'https://doi.org/10.48550/ARXIV.' || CAST(doc_id AS STRING) || 'v1'
    WHEN doc_id % 6 = 1 THEN '10.1000/x' END AS doi
  FROM documents""",
    "fetches": """SELECT 'https://openalex.org/W' || CAST(doc_id AS STRING) AS uri,
    CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 8 = 0 THEN 'not_openalex' WHEN doc_id % 8 = 1 THEN 'meta_failed'
    WHEN doc_id % 8 = 2 THEN 'no_oa_pdf'
      WHEN doc_id % 8 = 3 THEN 'already_failed' WHEN doc_id % 8 = 4 THEN 'pdf_download_failed' WHEN doc_id % 8 = 5 THEN 'extract_failed:no_text'
      WHEN doc_id % 16 = 6 THEN 'extract_failed:encrypted' ELSE 'ok' END AS status FROM documents""",
    "contexts": """SELECT doc_id AS question_id, CASE WHEN doc_id % 7 = 0 THEN text
    ELSE 'Title: none' || chr(10) || '---' || chr(10) || 'RELATED DOCUMENTS' || chr(10)
      || '## Title: T' || CAST(doc_id AS STRING) || chr(10) || 'Content:' || chr(10) || text || chr(10) || '---' || chr(10) || text || chr(10) || '---' || chr(10)
      || 'Content: ' || CASE WHEN doc_id % 3 = 0 THEN '. '
    ELSE '' END || text || chr(10) || 'more' || '--- --- Subject Title ' || lang || ' of Content' || chr(10) || ' --- a' || chr(10)
      || 'Title:' || chr(10) || ' next line ' || CASE WHEN doc_id % 4 = 1 THEN 'RELATED DOCUMENTS --- late'
    ELSE '' END || ' --- RELATED TOPICS --- topic' END AS context FROM documents""",
    "paged": """SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'pages/' || CAST(page_id AS STRING) ELSE url END AS url, CASE page_id % 8
      WHEN 0 THEN '<meta name="citation_pdf_url" content="rel.pdf"><META content="//x.org/a.pdf" name="citation_pdf_url">'
      WHEN 1 THEN '<meta content="https://x.org/alt.pdf" name="citation_pdf_url"><meta  name="citation_pdf_fulltext_url" content=" /full.pdf ">'
      WHEN 2 THEN '<meta class="c" name="citation_pdf_url" lang="x" content="/b.pdf?x=1">'
    WHEN 3 THEN '<a href="c.pdf">c</a><a href="https://x.org/d.pdf">d</a>'
      WHEN 4 THEN '<a HREF="/e.PDF#p">e</a>' WHEN 5 THEN '<meta name="citation_pdf_fulltext_url" content="f"><a href="http://x.org/f.pdf?y">f</a>'
    WHEN 6 THEN '<a href=".pdf">' ELSE ''
      END || html AS html FROM pages""",
    "assessed": f"""SELECT doc_id % {_N} AS question_id, CAST(floor(doc_id / {_N}) AS BIGINT) AS idx, {_TITLE} AS title, text AS abstract,
    'https://openalex.org/W' || CAST(doc_id AS STRING) AS uri,
      (doc_id * 31 % 101) / 100.0 AS relevance_score, doc_id % 3 <> 0 AS include FROM documents""",
}


def demo(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark", "conversations", "events", "pages") if f"FROM {t}" in TABLES[name]}
    sql = TABLES[name]
    for t in given:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **given)


def with_tables(*names: str) -> str:
    """The opening WITH of an SQL text that uses these tables."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in names) + "\n"
