"""The operators of this subpackage as queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.llm import bpe_automaton, centroid_codes, decontaminate, divergence, html_main, jaccard, langid, packing, quality, suffix_dedup, suffix_tree_lm, token_edits, toxicity
from evspark.llm.common import fold, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = docs.join(labels.where(fold(F.col("doc_id"), 3) != 1), "doc_id").withColumnRenamed("doc_id", "key")
    model = spark.sparkContext.broadcast(toxicity.train(rows))
    return toxicity.score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_edits.edit_counts(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), 5) == 1
    scored = suffix_tree_lm.score(table(spark, sf_dir, "documents"), ~held, group_col="lang")
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), kept=None)
    return found.select("doc_id", "removal.n_bytes", "removal.n_removed", "removal.n_spans", "removal.kept_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    rows = docs.where(~held).select(F.col("doc_id").alias("key"), "lang", "text")
    model = spark.sparkContext.broadcast(langid.train(rows))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_codes.with_digest(*centroid_codes.cluster(table(spark, sf_dir, "embeddings")))


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_automaton.digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def queries() -> dict:
    return {
        name: f
        for name, f in (
            ("op1_packing", op1_packing),
            ("op2_decontamination", op2_decontamination),
            ("op3_html_extraction", op3_html_extraction),
            ("op4_jaccard_join", op4_jaccard_join),
            ("op5_toxicity", op5_toxicity),
            ("op6_quality_rules", op6_quality_rules),
            ("op7_token_counts", op7_token_counts),
            ("op8_lm_scoring", op8_lm_scoring),
            ("op9_suffix_dedup", op9_suffix_dedup),
            ("op10_language_id", op10_language_id),
            ("op11_source_divergence", op11_source_divergence),
            ("op12_centroid_clustering", op12_centroid_clustering),
            ("op13_bpe_automaton", op13_bpe_automaton),
        )
    }


_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH items AS (
  SELECT item_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + 9), ' ') AS gram
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
  FROM docs, sizes, unnest(range(1, len(w) - k + 2)) AS t(i)
), hits AS (
  SELECT r, i, places.k, item_id FROM places JOIN windows ON places.k = windows.k AND places.gram = windows.gram
), words AS (
  SELECT DISTINCT r, i + j AS at FROM hits, unnest(range(0, k)) AS t(j)
), n AS (SELECT r, count(*) AS n_hit FROM words GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN n USING (r) LEFT JOIN found USING (r)
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_SHARE = "(1 + (CAST(1000000000 AS HUGEINT) * ({n} + 5)) // ({all} + 5 * v))"

OP11_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents
), words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30),
vocabulary AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_all FROM kept GROUP BY lang),
sums AS (SELECT lang, source, sum(n) AS n_all FROM counts JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(n_all, 0) AS n_all, coalesce(v, 0) AS v, coalesce(lang_all, 0) AS lang_all
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sums USING (lang, source) LEFT JOIN vocabulary USING (lang)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format(n="coalesce(c.n, 0)", all="g.n_all")} AS p,
    {_SHARE.format(n="k.lang_n", all="g.lang_all")} AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _op12_sql(dims: int = 64, k: int = 16, rounds: int = 3) -> str:
    """One table of centroids and one of assignments for each round."""
    near = """
d{i} AS (
  SELECT r, c, sum((x - y) * (x - y)) AS d FROM parts JOIN c{i} USING (j) GROUP BY ALL
), a{i} AS (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
    move = """
s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM a{last} JOIN parts USING (r) GROUP BY ALL),
c{i} AS (
  SELECT c, j, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{last} LEFT JOIN s{i} USING (c, j)
)"""
    steps = [near.format(i=0)] + [t.format(i=i, last=i - 1) for i in range(1, rounds + 1) for t in (move, near)]
    return f"""
WITH given AS (
  SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
), parts AS (SELECT r, j, CAST(floor(64 * CAST(e[j] AS DOUBLE)) AS BIGINT) AS x FROM given, unnest(range(1, {dims + 1})) AS t(j)),
starts AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM given),
c0 AS (SELECT c, j, x AS y FROM starts JOIN parts USING (r) WHERE c < {k}),{",".join(steps)},
hashes AS (SELECT c, sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN given USING (r) JOIN hashes USING (c)
"""


OP12_SQL = _op12_sql()


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op11_source_divergence": OP11_SQL, "op12_centroid_clustering": OP12_SQL}
