"""Loading, parsing and keyed upkeep of tables.

Null and blank questions are dropped, null raw results count as empty, keys with a null match nothing; of rows with equal
keys the first or the last by ord counts, as a function says; an empty table gives no rows (counts are
zero). Other columns are carried along where rows are; two underscores are reserved.
"""

from __future__ import annotations

import ast
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evspark.operators.running import sums_before

ALIASES = {
    "question": ("question", "Question", "query", "Query"),
    "answer": ("answer", "generation"),
    "context": ("context", "final_context"),
}
DROPPED_KEYS = ("_rev", "_id", "_key", "embedding")


def normalise_columns(df: DataFrame) -> DataFrame:
    """Renames the first alias of each known column that is present."""
    for name, aliases in ALIASES.items():
        found = next((a for a in aliases if a in df.columns), None)
        if found and found != name:
            df = df.withColumnRenamed(found, name)
    return df


def load_questions(df: DataFrame, num: int | None = None, indices: list[int] | None = None, *, ord_col: str = "ord", ignore_case: bool = False) -> DataFrame:
    """Adds index (from 0 by ``ord_col``), drops blank questions, keeps the first of equal ones, then picks.

    The index counts before anything is dropped. It is a running count over ranges of the order
    column, so no task holds all rows.
    """
    df = with_index(normalise_columns(df), ord_col)
    key = F.trim("question")
    key = F.lower(key) if ignore_case else key
    first = F.row_number().over(W.partitionBy(key).orderBy(ord_col))
    got = df.where(F.trim(F.coalesce("question", F.lit(""))) != "").withColumn("__first", first).where(F.col("__first") == 1).drop("__first")
    if indices is not None:
        got = got.where(F.col("index").isin(indices))
    return got.orderBy("index").limit(num) if num is not None else got


def with_index(df: DataFrame, ord_col: str, name: str = "index") -> DataFrame:
    """Position by ``ord_col`` from 0, whatever its values are: counts of ranges, then places within them."""
    return sums_before(df, [], [ord_col], {name: F.lit(1)}).withColumn(name, F.col(name).cast("long"))


def judge_tasks(answers: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows by id (then ord) that have an id up to ``most``, with task_id; null ids are left out."""
    rows = answers.where(F.col("question_id").isNotNull()).orderBy("question_id", "ord").limit(most)
    task = F.concat(F.lit("Q"), F.col("question_id").cast("string"), F.lit("_"), F.col("set"))
    return rows.where(F.col("question_id") <= most).withColumn("task_id", task)


def _clean(value):
    if isinstance(value, dict):
        return {k: _clean(v) if isinstance(v, list) else v for k, v in value.items() if k not in DROPPED_KEYS and v is not None}
    if isinstance(value, list):
        return [_clean(v) for v in value]
    return value


def _parsed(text: str | None) -> str | None:
    """A list as JSON without dropped keys and nulls, "[]" for other values, null where nothing can be parsed."""
    for parse in (json.loads, ast.literal_eval):
        try:
            value = parse(text)
            break
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    else:
        return None
    return json.dumps(_clean(value), ensure_ascii=False) if isinstance(value, list) else "[]"


def _cleaned_json(raw: Column) -> Column:
    @F.pandas_udf("string")
    def each(raw: pd.Series) -> pd.Series:
        return raw.map(_parsed)

    return each(raw)


def object_fields(v: Column) -> Column:
    """The fields of a variant that is an object, else null."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def list_items(v: Column) -> Column:
    """The items of a variant that is a list, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


#: Lists within lists that are cleaned as variants; what is deeper goes the slow way.
LEVELS = 4


def _cleaned(v: Column, levels: int = LEVELS) -> Column:
    """A variant without dropped keys and nulls in objects, through lists of lists; objects within objects stay as they are."""
    if not levels:
        return v
    wanted = F.map_filter(object_fields(v), lambda k, x: ~k.isin(*DROPPED_KEYS) & ~F.is_variant_null(x))
    fields = F.transform_values(wanted, lambda k, x: F.when(list_items(x).isNotNull(), _cleaned(x, levels - 1)).otherwise(x))
    return F.coalesce(F.to_variant_object(F.transform(list_items(v), lambda x: _cleaned(x, levels - 1))), F.to_variant_object(fields), v)


def parse_kg_results(df: DataFrame, col: str = "kg_results") -> DataFrame:
    """Adds docs (array of variants, with all keys that were there), parsed and original_size.

    JSON or a Python literal; a blank or null is empty, anything but a list is empty, and a failure gives no documents
    with parsed false. JSON is parsed and cleaned as variants. Rows that are no JSON, or where a dropped key or a null is left
    (it may be in a deeper list, or rightly in an object within an object), are the only ones that go to a Python function.
    """
    text = F.trim(F.coalesce(F.col(col), F.lit("")))
    given = df.withColumns({"__text": text, "original_size": F.length(F.coalesce(F.col(col), F.lit("")))})
    given = given.withColumn("__v", _cleaned(F.try_parse_json("__text")))
    left = '"(?:' + "|".join(DROPPED_KEYS) + ')":|:null'
    slow = (F.col("__text") != "") & (F.col("__v").isNull() | F.to_json("__v").rlike(left))
    none = F.array().cast("array<variant>")
    fast = given.where(~slow).withColumns({"docs": F.coalesce(list_items(F.col("__v")), none), "parsed": F.lit(True)})
    rest = given.where(slow).withColumn("__json", _cleaned_json(F.col("__text")))
    rest = rest.withColumns({"docs": F.coalesce(list_items(F.try_parse_json("__json")), none), "parsed": F.col("__json").isNotNull()})
    return fast.drop("__text", "__v").unionByName(rest.drop("__text", "__v", "__json"))


def kg_result_stats(df: DataFrame, col: str = "docs", raw: str = "kg_results") -> DataFrame:
    """Sizes before and after, reduction in percent, and counts of documents, keywords and secondary nodes.

    ``col`` is an array of structs with science_keywords, each with secondary_nodes.
    """
    keys = F.flatten(F.transform(F.col(col), lambda d: F.coalesce(d["science_keywords"], F.array().cast(dict(df.select(F.col(col)[0]["science_keywords"].alias("k")).dtypes)["k"]))))
    n_second = F.aggregate(keys, F.lit(0), lambda a, k: a + F.coalesce(F.size(k["secondary_nodes"]), F.lit(0)))
    original, parsed = F.length(raw), F.length(F.to_json(col))
    got = df.withColumns({"original_size": original, "parsed_size": parsed, "n_docs": F.size(col), "n_keywords": F.size(keys), "n_secondary": n_second})
    reduction = F.when(F.col("original_size") > 0, F.round(100 * (1 - F.col("parsed_size") / F.col("original_size")), 1)).otherwise(0.0)
    return got.withColumns({"reduction": reduction, "n_nodes": F.col("n_docs") + F.col("n_keywords") + F.col("n_secondary")})


#: Marks of a structured context, its labels, and the title of a block that has none.
DOCUMENTS_MARK, TOPICS_MARK, BLOCK_MARK = "RELATED DOCUMENTS", "RELATED TOPICS", "---"
TITLE_LABEL = r"[#\s]*Title[:\s]+([^\n]+)"
CONTENT_LABEL = r"(?msd)[#\s]*Content[:\s]+(.+?)(?:---|$)"
STUDY_TITLE = ("EO Study on ", "...")


def parse_structured_context(df: DataFrame, col: str = "context") -> DataFrame:
    """(question_id, position, title, content) for each block of related documents.

    Blocks stand between the first mark of documents and the next one, or that of topics; a text without the first mark has
    none. Positions count blocks from 1, also those left out as blank or headings. Without a title label the title is made
    from the first sentence of the labelled content, else from the position; without a content label the content is
    the block's first 500 characters.
    """
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    after = F.get(F.split(F.col(col), DOCUMENTS_MARK, -1), F.lit(1))
    part = F.get(F.split(after, TOPICS_MARK, -1), F.lit(0))
    blocks = df.select("question_id", F.posexplode(F.split(part, BLOCK_MARK, -1)).alias("position", "block"))
    blocks = blocks.select("question_id", (F.col("position") + 1).alias("position"), trimmed(F.col("block")).alias("block"))
    blocks = blocks.where((F.col("block") != "") & ~F.col("block").startswith("#"))
    labelled = lambda p: F.when(F.col("block").rlike(p), trimmed(F.regexp_extract("block", p, 1)))
    blocks = blocks.withColumns({"__title": labelled(TITLE_LABEL), "__content": labelled(CONTENT_LABEL)})
    sentence = F.nullif(F.get(F.split("__content", r"\.", -1), F.lit(0)), F.lit(""))
    named = F.concat(F.lit(STUDY_TITLE[0]), F.substring(sentence, 1, 50), F.lit(STUDY_TITLE[1]))
    title = F.coalesce("__title", named, F.concat(F.lit("Document "), F.col("position").cast("string")))
    content = F.substring(F.coalesce("__content", F.substring("block", 1, 500)), 1, 3000)
    return blocks.select("question_id", "position", title.alias("title"), content.alias("content"))


def metadata_enrich(docs: DataFrame, works: DataFrame) -> DataFrame:
    """Adds first author, year and known title by work; absent ones get their defaults."""
    w = works.select("work_id", F.get("authors", F.lit(0)).alias("__author"), F.col("year").alias("__year"), F.col("title").alias("work_title"))
    joined = docs.join(w, "work_id", "left")
    return joined.withColumns({"author": F.coalesce("__author", F.lit("No author")), "year_text": F.coalesce(F.col("__year").cast("string"), F.lit("No year"))}).drop("__author", "__year")


#: Prefixes of identifiers, an archive's file address, and the path of an article at one publisher.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/")
ARXIV_DOI, ARXIV_FILES = r"(?i)^10\.48550/arXiv\.(.+)", "https://export.arxiv.org/pdf/"
ARTICLE = r"^(https?://([^/.]+)[^/]*/articles/([0-9]+)/([0-9]+)/([0-9]+)/)"


def link_candidates(works: DataFrame) -> DataFrame:
    """(work_id, place, url): addresses to try in order, each once.

    Those that end in .pdf come first, the others after them, both in the order best, primary, other locations, open
    access. Each follows the addresses that rules for hosts make of it; last comes the archive's file, by the identifier.
    """
    pair = lambda s: F.array(s["pdf_url"], s["landing_page_url"])
    places = F.coalesce("locations", F.array().cast("array<struct<pdf_url:string,landing_page_url:string>>"))
    every = F.concat(pair(F.col("best_oa")), pair(F.col("primary")), F.flatten(F.transform(places, pair)), F.array("oa_url"))
    given = F.filter(every, lambda u: F.coalesce(u, F.lit("")) != "")
    is_file = lambda u: F.lower(u).endswith(".pdf")
    ordered = F.array_distinct(F.concat(F.filter(given, is_file), F.filter(given, lambda u: ~is_file(u))))
    tried = F.flatten(F.transform(ordered, lambda u: F.array_append(host_rewrites(u), u)))
    doi = normalise_doi(F.col("doi"))
    archived = F.when(doi.rlike(ARXIV_DOI), F.concat(F.lit(ARXIV_FILES), F.trim(F.regexp_extract(doi, ARXIV_DOI, 1))))
    links = F.array_distinct(F.concat(tried, F.filter(F.array(archived), lambda u: u.isNotNull())))
    return works.select("work_id", F.posexplode(links).alias("place", "url"))


def normalise_doi(doi: Column) -> Column:
    for prefix in DOI_PREFIXES:
        doi = F.replace(doi, F.lit(prefix), F.lit(""))
    return F.nullif(F.trim(doi), F.lit(""))


def host_rewrites(url: Column) -> Column:
    """Addresses of files that stand behind the pages of two publishers, to be tried before the page itself."""
    low, slash = F.lower(url), F.lit("/")
    bare = F.rtrim(F.regexp_replace(url, "[#?].*$", ""), slash)
    paged = low.contains("mdpi.com/") & ~F.rtrim(low, slash).endswith("/pdf") & ~bare.endswith(".pdf")
    found = lambda k: F.regexp_extract(url, ARTICLE, k)
    article = low.contains(".copernicus.org/articles/") & ~low.endswith(".pdf") & url.rlike(ARTICLE)
    name = F.concat(found(1), F.concat_ws("-", found(2), found(3), found(4), found(5)), F.lit(".pdf"))
    made = F.array(F.when(paged, F.concat(bare, F.lit("/pdf"))), F.when(article, name))
    return F.filter(made, lambda u: u.isNotNull())


#: Where a page names its file, in the order in which they are tried.
FILE_METADATA = (
    r'(?i)<meta\s+[^>]*name="citation_pdf_url"[^>]*content="([^"]+)"',
    r'(?i)<meta\s+[^>]*name="citation_pdf_fulltext_url"[^>]*content="([^"]+)"',
    r'(?i)<meta\s+[^>]*content="([^"]+)"[^>]*name="citation_pdf_url"',
)
FILE_LINK = r'(?i)href="([^"]+\.pdf[^"]*)"'


def html_pdf_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pdf_url): the first file address in a page's metadata that can be made whole, else its first link to one."""
    h = F.coalesce("html", F.lit(""))
    base = F.coalesce("url", F.lit(""))
    root = F.concat_ws("/", F.slice(F.split(base, "/", -1), 1, 3))

    def whole(pattern: str) -> Column:
        u = F.trim(F.regexp_extract(h, pattern, 1))
        return F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/") & base.contains("://"), F.concat(root, u)).when(u.startswith("http"), u)

    return pages.select("page_id", "url", F.coalesce(*map(whole, (*FILE_METADATA, FILE_LINK))).alias("pdf_url"))


def fetch_status_report(docs: DataFrame, log: DataFrame) -> DataFrame:
    """(status, n) over the distinct addresses of all questions."""
    uris = docs.where(F.col("uri").isNotNull()).select("uri").distinct()
    state = F.coalesce("status", F.lit("not_fetched"))
    return uris.join(log, "uri", "left").groupBy(state.alias("status")).agg(F.count(F.lit(1)).alias("n"))


#: States of a fetch without metadata, and how states with a file but no text begin.
NO_METADATA, NO_TEXT = ("meta_failed", "not_openalex"), "extract_failed"


def fetch_counters(report: DataFrame) -> DataFrame:
    """meta_ok, pdf_ok and extract_ok from counts by status; what was never fetched counts nowhere."""
    tried, ok = F.col("status") != "not_fetched", F.col("status") == "ok"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    stages = {"meta_ok": tried & ~F.col("status").isin(*NO_METADATA), "pdf_ok": ok | F.col("status").startswith(NO_TEXT), "extract_ok": ok}
    return report.agg(*[total(c).alias(name) for name, c in stages.items()])


def cache_audit(pdfs: DataFrame, texts: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: sizes of the inventories, empty files, orphans on both sides, success in percent."""
    parts = {
        "n_pdfs": pdfs, "empty_pdfs": pdfs.where(F.col("bytes") == 0), "n_texts": texts, "n_failures": failures,
        "texts_without_pdf": texts.join(pdfs, "work_id", "left_anti"), "pdfs_without_text": pdfs.join(texts, "work_id", "left_anti"),
    }
    counts = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name, df in parts.items()])
    one = counts.groupBy().pivot("name", list(parts)).agg(F.first("n"))
    total = F.col("n_texts") + F.col("n_failures")
    return one.withColumn("success_percent", F.when(total > 0, F.round(100 * F.col("n_texts") / total, 1)).otherwise(0.0))


def failure_reasons(failures: DataFrame, width: int = 60, top: int = 10) -> DataFrame:
    """The commonest beginnings of failure messages."""
    by = failures.groupBy(F.substring("reason", 1, width).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return by.orderBy(F.desc("n"), "reason").limit(top)


def upsert(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys (as text) are not in ``new``, and all of ``new``; the last of equal keys of ``new`` by ord wins."""
    latest = F.row_number().over(W.partitionBy(*[F.col(k).cast("string") for k in keys]).orderBy(F.desc("ord")))
    fresh = new.withColumn("__latest", latest).where(F.col("__latest") == 1).drop("__latest")
    return df.join(fresh.select(*keys), _same(df, fresh, keys), "left_anti").unionByName(fresh)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].cast("string").eqNullSafe(b[k].cast("string"))
    return out


def insert_if_absent(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` and the first row by ord of each key of ``new`` that it lacks."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy("ord"))
    fresh = new.withColumn("__first", first).where(F.col("__first") == 1).drop("__first")
    return df.unionByName(fresh.join(df.select(*keys), keys, "left_anti").select(*df.columns))


def pending_work(questions: DataFrame, answers: DataFrame, *, rule: str = "long") -> DataFrame:
    """Questions still to be answered.

    Done is, by ``rule``: "long" an answer of 200 characters that does not begin with ERROR; "present" any
    that begins with neither Error: nor ERROR:; "scored" a first row by ord whose scores lack -1.
    """
    text = F.coalesce("text", F.lit(""))
    if rule == "long":
        done = answers.where((F.length(text) >= 200) & ~text.startswith("ERROR"))
    elif rule == "present":
        done = answers.where(F.col("text").isNotNull() & ~text.startswith("Error:") & ~text.startswith("ERROR:"))
    else:
        first = answers.withColumn("__first", F.row_number().over(W.partitionBy("question_id").orderBy("ord"))).where(F.col("__first") == 1)
        done = first.where(~F.exists("scores", lambda s: s == -1))
    return questions.join(done.select("question_id").distinct(), "question_id", "left_anti")


def export_results(answers: DataFrame) -> DataFrame:
    """Flat rows for files: references joined, seconds to 2 places, documents counted."""
    refs = F.array_join(F.coalesce("references", F.array().cast("array<string>")), " | ")
    parts = F.size(F.filter(F.split(F.coalesce("context", F.lit("")), "##"), lambda s: F.trim(s) != ""))
    docs = F.when(F.coalesce("kg_docs", F.lit(0)) > 0, F.col("kg_docs")).otherwise(parts)
    return answers.select("question_id", "text", refs.alias("references"), F.round("seconds", 2).alias("seconds"), docs.cast("long").alias("documents_parsed"))


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes csv (with a header, quotes doubled), json or parquet in place of what was there."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if kind == "csv" else getattr(writer, kind)(path)


def strip_fences(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def parse_llm_responses(responses: DataFrame) -> DataFrame:
    """Adds body: the JSON text without fences, a bare list wrapped as assessments, null where it is no JSON."""
    text = strip_fences(F.coalesce("raw", F.lit("")))
    valid = F.try_parse_json(text)
    wrapped = F.when(text.startswith("["), F.concat(F.lit('{"assessments":'), text, F.lit("}"))).otherwise(text)
    return responses.withColumn("body", F.when((text != "") & valid.isNotNull(), wrapped))


def parse_judge_scores(responses: DataFrame, criteria) -> DataFrame:
    """Adds the scores; all null unless every one is a whole number from 1 to 10.

    ``reason`` tells why a row has none: "empty", "no json", "missing" or "range"; it is null for good rows.
    """
    got = parse_llm_responses(responses)
    v = F.try_parse_json("body")
    raw = {c: F.try_variant_get(v, f"$.scores.{c}", "string") for c in criteria}
    ok = F.lit(True)
    for c in criteria:
        ok = ok & F.coalesce(raw[c].rlike("^(?:[1-9]|10)$"), F.lit(False))
    lacking = F.lit(False)
    for c in criteria:
        lacking = lacking | raw[c].isNull()
    empty = strip_fences(F.coalesce("raw", F.lit(""))) == ""
    reason = F.when(empty, "empty").when(F.col("body").isNull(), "no json").when(lacking, "missing").when(~ok, "range")
    return got.withColumns({c: F.when(ok, raw[c].try_cast("int")) for c in criteria}).withColumns({"ok": ok, "reason": reason})


def split_responses(responses: DataFrame, criteria) -> tuple[DataFrame, DataFrame]:
    """(rows with scores, rejected rows with their raw text and reason)."""
    got = parse_judge_scores(responses, criteria)
    return got.where("ok").drop("reason", "body"), got.where(~F.col("ok")).drop("ok", "body", *criteria)


def parse_profiles(responses: DataFrame) -> DataFrame:
    """Adds profile columns with their defaults; a failed parse has no confidence, which routes to safety."""
    v = F.try_parse_json("body")
    num = lambda k, d: F.coalesce(F.try_variant_get(v, f"$.profile.{k}", "double"), F.lit(d))
    got = parse_llm_responses(responses)
    return got.withColumns(
        {
            "question_type": F.coalesce(F.lower(F.trim(F.try_variant_get(v, "$.profile.question_type", "string"))), F.lit("continuous")),
            "complexity": num("complexity", 0.5),
            "quantitativity": num("quantitativity", 0.3),
            "spatial_specificity": num("spatial_specificity", 0.1),
            "temporal_specificity": num("temporal_specificity", 0.1),
            "methodological_depth": num("methodological_depth", 0.1),
            "confidence": F.try_variant_get(v, "$.profile.confidence", "double"),
        }
    )
