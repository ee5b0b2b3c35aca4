"""Literal outcomes of the rules for citations, numbers, contexts, links and fetch states."""

import pytest
from pyspark.sql import functions as F

from evspark.operators import assemble, cite, docfilter, ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("a [1] b [3, 2]", [1, 2, 3]), ("[1 2]", []), ("[1 2, 7]", [7]), ("[ 4 ,\n5,]", [4, 5]), ("[4-6] [x]", []), ("[99999999999999999999]", []), (None, []), ("", []), ("[2][2]", [2])],
)
def test_cited_indices(spark, text, want):
    assert one(spark, cite.cited_indices(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "text, context, numbers, unmatched",
    [
        ("rose by 2.5 and 0.83", "2.50", ["2.5", "0.83"], ["0.83"]),
        ("PM10 and CO15, é7 and 5é", "", [], []),
        ("in 2020, 3 of 1899 and 2101.0 or 1999.5", "1899", ["1899", "2101.0", "1999.5"], ["2101.0", "1999.5"]),
        ("seen [12] but not [1, 2] or [40, 41]", "", ["40", "41"], ["40", "41"]),
        ("10-20 and -4.5", "x-20 4.5", ["10", "-20", "4.5"], ["10"]),
        ("42.7 and 42.7", "142.75", ["42.7", "42.7"], []),
        ("1.2.3", "1.2", ["1.2"], []),
        ("9" * 400, "", [], []),
        ("77", "7 7 7-7", ["77"], ["77"]),
        (None, None, [], []),
    ],
)
def test_numeric_faithfulness(spark, text, context, numbers, unmatched):
    df = spark.createDataFrame([(text, context)], "text string, context string")
    assert tuple(cite.numeric_faithfulness(df).select("numbers", "unmatched").first()) == (numbers, unmatched)


def test_titles_are_cut_before_they_are_compared(spark):
    long = "x, " * 40  # 120 characters, equal in the first 100
    titles = [long + "a", long + "b", "", "", "!!", "??", "Same title", "same, TITLE", None]
    docs = spark.createDataFrame([(1, n, t, "u") for n, t in enumerate(titles, 1)] + [(1, 10, "", "")], "question_id int, number int, title string, uri string")
    answers = spark.createDataFrame([(5, 1, "none")], "answer_id int, question_id int, text string")
    got = {r.old: r.new for r in cite.verify_references(answers, docs).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 6, 9: 7}


def test_structured_context(spark):
    body = (
        "Title: before\n---\nRELATED DOCUMENTS\n## Title: A study\nContent:\nFirst line. Rest.\nSecond line.\n---\n\n---\n# skipped\n---\nContent: One. Two\n---\n"
        + "z" * 600 + "\n---\nSubtitle Title x\nContent: . y\nRELATED TOPICS\n---\nTitle: topic RELATED DOCUMENTS Title: late"
    )
    df = spark.createDataFrame([(1, body), (2, "Title: x\nContent: y"), (3, None), (4, ""), (5, "RELATED DOCUMENTS Content: " + "w" * 4000)], "question_id int, context string")
    got = {(r.question_id, r.position): (r.title, r.content) for r in ingest.parse_structured_context(df).collect()}
    assert got == {  # the first block begins with a sign of headings
        (1, 4): ("EO Study on One...", "One. Two"),
        (1, 5): ("Document 5", "z" * 500),
        (1, 6): ("x", ". y"),
        (5, 1): ("EO Study on " + "w" * 50 + "...", "w" * 3000),
    }


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://acp.copernicus.org/articles/20/123/2020/", ["https://acp.copernicus.org/articles/20/123/2020/acp-20-123-2020.pdf"]),
        ("https://acp.copernicus.org/articles/20/123/2020/acp-x.html", ["https://acp.copernicus.org/articles/20/123/2020/acp-20-123-2020.pdf"]),
        ("https://acp.copernicus.org/articles/20/123/", []),
        ("https://www.mdpi.com/1/2", ["https://www.mdpi.com/1/2/pdf"]),
        ("http://MDPI.com/1/2/?a=b#c", ["http://MDPI.com/1/2/pdf"]),
        ("https://www.mdpi.com/1/2/pdf/", []),
        ("https://www.mdpi.com/1/2.pdf", []),
        ("https://a.org/x", []),
    ],
)
def test_host_rewrites(spark, url, want):
    assert one(spark, ingest.host_rewrites(F.col("u")), u=url) == want


def test_link_candidates(spark):
    schema = (
        "work_id string, doi string, best_oa struct<pdf_url:string,landing_page_url:string>, primary struct<pdf_url:string,landing_page_url:string>, "
        "locations array<struct<pdf_url:string,landing_page_url:string>>, oa_url string"
    )
    rows = [
        ("a", "https://doi.org/10.48550/arXiv.2101.1", ("https://x.org/f.pdf?v=1", "https://www.mdpi.com/1/2"), (None, ""), [("http://y.org/g.PDF", None), ("https://x.org/f.pdf?v=1", None)], "https://www.mdpi.com/1/2"),
        ("b", None, None, None, None, None),
    ]
    got = {}
    for r in ingest.link_candidates(spark.createDataFrame(rows, schema)).orderBy("place").collect():
        got.setdefault(r.work_id, []).append(r.url)
    assert got == {"a": ["http://y.org/g.PDF", "https://x.org/f.pdf?v=1", "https://www.mdpi.com/1/2/pdf", "https://www.mdpi.com/1/2", "https://export.arxiv.org/pdf/2101.1"]}


@pytest.mark.parametrize(
    "url, html, want",
    [
        ("https://p.org/q/r", '<meta content="https://x.org/alt.pdf" name="citation_pdf_url"><meta name="citation_pdf_fulltext_url" content="/full.pdf">', "https://p.org/full.pdf"),
        ("https://p.org/q", '<meta name="citation_pdf_url" content="rel.pdf"><META content="//x.org/a.pdf" name="citation_pdf_url">', "https://x.org/a.pdf"),
        ("https://p.org/q", '<a href="rel.pdf">a</a><a href="https://x.org/b.pdf">b</a>', None),
        ("p.org/q", '<a href="/b.pdf">', None),
        ("https://p.org", '<A HREF="/b.PDF?x=1">', "https://p.org/b.PDF?x=1"),
        ("https://p.org", '<a href=".pdf">', None),
        (None, None, None),
    ],
)
def test_html_pdf_links(spark, url, html, want):
    pages = spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")
    assert ingest.html_pdf_links(pages).first().pdf_url == want


def test_fetch_counters(spark):
    states = ["no_oa_pdf", "already_failed", "pdf_download_failed", "extract_failed:no_text", "ok", "meta_failed", "not_openalex", None]
    docs = spark.createDataFrame([(f"u{i}",) for i in range(len(states) + 1)] + [("u0",), (None,)], "uri string")
    log = spark.createDataFrame([(f"u{i}", s) for i, s in enumerate(states)], "uri string, status string")
    assert tuple(ingest.fetch_counters(ingest.fetch_status_report(docs, log)).first()) == (5, 2, 1)


def test_judge_tasks(spark):
    rows = [(3, 1, "s"), (1, 2, "s"), (1, 1, "s"), (None, 0, "s"), (9, 1, "s"), (2, 1, "s")]
    df = spark.createDataFrame(rows, "question_id int, ord int, `set` string")
    assert sorted(r.task_id for r in ingest.judge_tasks(df, 3).collect()) == ["Q1_s", "Q1_s", "Q2_s"]
    assert sorted(r.task_id for r in ingest.judge_tasks(df, 9).collect()) == ["Q1_s", "Q1_s", "Q2_s", "Q3_s", "Q9_s"]


def test_labels_and_separators_of_any_blank(spark):
    strip = cite.strip_references(F.col("t"))
    assert one(spark, strip, t="a\r\nReferences\r\n[1] x") == "a"
    assert one(spark, strip, t="a\n\t## References \t\n[1] x") == "a"
    flag = docfilter.is_retracted(F.col("t"), F.lit(None).cast("string")).cast("string")
    assert [one(spark, flag, t=t) for t in ("On x:\tretracted", "On x\nwithdrawn work", "unretracted", "pre-Retracted")] == ["true", "true", "false", "true"]


def test_reference_lines(spark):
    rows = [(1, 2001, ["A", "B", "C"], "T", "u"), (2, None, [], "", ""), (3, 1999, ["A", "B"], " ", None)]
    works = spark.createDataFrame(rows, "number int, year int, authors array<string>, title string, uri string")
    got = [tuple(r) for r in assemble.reference_lines(works).orderBy("number").select("reference", "cited").collect()]
    assert got == [
        ("[1] A et al. (2001). T. u", "[1] A (2001). *T*. u."),
        ("[2] Unknown (n.d.). [No title]", "[2] No author (No year). *[No title \u2014 see URI]*. ."),
        ("[3] A, B (1999).  ", "[3] A (1999). *[No title \u2014 see URI]*. ."),
    ]
