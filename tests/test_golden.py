"""Golden rows by hand for the operators that SQL can't check, and for boundaries."""

import pytest
from pyspark.sql import functions as F

from evspark.functions import text as T
from evspark.operators import assemble, chunks, cite, docfilter, evaluate, ingest, retrieve, route
from evspark.plans import rules
from tests.marks_by_hand import normalize_one

P = dict(question_type="continuous", complexity=0.2, quantitativity=0.2, spatial_specificity=0.0, temporal_specificity=0.0, methodological_depth=0.0, confidence=0.85)
CASES = [
    ({}, "tier-1"),
    ({"complexity": 0.40}, "tier-m"),
    ({"complexity": 0.39}, "tier-1"),
    ({"question_type": "definition"}, "tier-1-def"),
    ({"question_type": "definition", "quantitativity": 0.45}, "tier-1"),
    ({"question_type": "definition", "complexity": 0.60}, "tier-m"),
    ({"question_type": "factual"}, "tier-1-def"),
    ({"question_type": "definition", "confidence": None}, "tier-1-def-parse-rescue"),
    ({"question_type": "mechanism", "confidence": 0.59}, "safety-tier3"),
    ({"question_type": "mechanism", "confidence": 0.60}, "tier-1"),
    ({"confidence": None}, "safety-tier3"),
    ({"quantitativity": 0.60, "spatial_specificity": 0.60}, "tier-2b"),
    ({"quantitativity": 0.60, "temporal_specificity": 0.60}, "tier-2b"),
    ({"quantitativity": 0.59, "spatial_specificity": 0.60}, "tier-2a"),
    ({"quantitativity": 0.55}, "tier-2a"),
    ({"quantitativity": 0.55, "methodological_depth": 0.55}, "tier-1"),
    ({"question_type": "mechanism", "methodological_depth": 0.55}, "tier-3"),
    ({"question_type": "mechanism", "complexity": 0.60, "methodological_depth": 0.45}, "tier-3"),
    ({"question_type": "mechanism", "complexity": 0.59, "methodological_depth": 0.45}, "tier-m"),
    ({"question_type": "comparison", "methodological_depth": 0.40}, "tier-3"),
    ({"question_type": "method_eval", "methodological_depth": 0.39}, "tier-1"),
    ({"question_type": "mechanism", "complexity": 0.75, "methodological_depth": 0.45}, "tier-3"),
    ({"question_type": "application", "complexity": 0.9, "methodological_depth": 0.9}, "tier-m"),
    ({"complexity": None}, "fallback"),
]


def test_routes(spark):
    names = list(P)
    rows = [(i, *[{**P, **c}[n] for n in names]) for i, (c, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "question_id int, question_type string, " + ", ".join(f"{n} double" for n in names[1:]))
    got = {r.question_id: (r.rule_hit, r.evidence_mode) for r in route.route(df).collect()}
    assert [got[i][0] for i in range(len(CASES))] == [want for _, want in CASES]
    assert all(mode for _, mode in got.values())


def test_scaled_targets():
    assert route.scaled_targets({"tier-1": 5, "tier-m": 5}, 5) == {"tier-1": 2, "tier-m": 3}
    assert {r[0] for r in rules.CONFIG} == {n for n, _ in rules.RULES} | {"safety-tier3", "tier-1-def-parse-rescue"}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("5.2 and -3,1e5 in 2020", 3), ("x5 5x _7 7_ a7b", 0), ("naïve 12", 1), (None, 0), ("", 0), ("3.14.15", 2)],
)
def test_numeric_count(spark, text, want):
    assert one(spark, T.numeric_count(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "line, want",
    [("2. Methods", "methods"), ("3.1 Study area", "study area"), ("RESULTS AND OUTLOOK", "results"), ("A prose line about methods", None), ("", None), (None, None),
     ("OUR DATA ANALYSIS", "analysis"), ("Method", "method"), ("x" * 91, None), ("Acknowledgements", "acknowledg")],
)
def test_headings(spark, line, want):
    assert one(spark, T.detect_heading(F.col("t")), t=line) == want


def test_preview_and_ids(spark):
    assert one(spark, T.abstract_preview(F.col("t")), t="A" * 1900) == "A" * 1400 + "..."
    assert one(spark, T.abstract_preview(F.col("t")), t=None) == "No abstract"
    assert one(spark, T.work_id(F.col("t")), t="https://openalex.org/W12/") == "W12"
    assert one(spark, T.work_id(F.col("t")), t="https://a.org/W12") is None
    assert one(spark, T.tokens(F.col("t")), t="Naïve a b2 x-1 10km") == ["na", "ve", "b2", "x-1", "km"]


def chunks_by_hand(text, target, overlap):
    import re

    size = lambda s: max(1, len(s) // 4)
    out, cur = [], []
    for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text):
        if cur and sum(map(size, cur)) + size(s) > target:
            out.append((" ".join(cur).strip(), sum(map(size, cur))))
            tail = []
            for x in reversed(cur):
                if sum(map(size, tail)) + size(x) > overlap:
                    break
                tail.insert(0, x)
            cur = tail
        cur.append(s)
    return out + [(" ".join(cur).strip(), sum(map(size, cur)))]


def test_chunks(spark):
    import random

    r = random.Random(3)
    texts = [" ".join("X" + "y" * r.randint(1, 90) + r.choice([".", "!", "?", ","]) for _ in range(n)) for n in (1, 2, 5, 30, 80)]
    df = spark.createDataFrame([(i, 0, "Results", t, 3) for i, t in enumerate(texts)] + [(9, 0, "x", "", 1), (10, 0, "x", None, 1)], "doc_id long, section_no long, heading string, text string, page_start int")
    got = {}
    for row in chunks.chunk(df, 60, 15).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(row.doc_id, []).append((row.text, row.tokens))
        assert (row.section, row.page) == ("results", 3)
    assert got == {i: chunks_by_hand(t, 60, 15) for i, t in enumerate(texts)}


def test_budgets_skip_and_do_not_stop(spark):
    rows = [(1, 7, 0, i, s, t, 0, 8, 5, 9, 1) for i, (s, t) in enumerate([(0.9, 5), (0.8, 4), (0.7, 3)])]
    df = spark.createDataFrame(rows, "question_id long, doc_id long, section_no long, chunk_no int, score double, tokens int, doc_index int, per_doc_budget int, top_k_per_doc int, global_budget int, page int")
    kept = chunks.topk_under_budget(df)
    assert sorted(r.chunk_no for r in kept.collect()) == [0, 2]
    out = chunks.global_budget_select(kept.repartition(3)).collect()
    assert sum(r.tokens for r in out) <= 9 and [r.chunk_no for r in sorted(out, key=lambda r: r.excerpt_no)] == [0, 2]


@pytest.mark.parametrize(
    "text, want",
    [("a [5,6,7].", "a [5][6][7]."), ("at 4.85 mas/yr", "at 4.85 mas/yr"), ("word 3, 7.", "word [3][7]."), ("3, 7 confirm it", "[3][7] confirm it"), ("in 2019.", "in 2019."),
     ("word 31.", "word 31."), (None, None), ("", ""), ("2.16 Ma", "2.16 Ma"), ("x [2] y", "x [2] y")],
)
def test_normalize_citations(spark, text, want):
    assert normalize_one(text) == want
    assert one(spark, cite.normalize_citations(F.col("t")), t=text) == want


def test_references(spark):
    docs = spark.createDataFrame([(1, n, f"Title {n}" if n != 14 else "title: 3", f"u{n}") for n in range(1, 16)], "question_id int, number int, title string, uri string")
    answers = spark.createDataFrame([(1, 1, "A [7] b [3] c [14], [99]. [3][7]"), (2, 1, "none")], "answer_id int, question_id int, text string")
    verified = cite.verify_references(answers, docs)
    assert {(r.old, r.new) for r in verified.where("answer_id = 1").collect()} == {(3, 1), (7, 2), (14, 1)}
    got = {r.answer_id: r.renumbered for r in cite.renumber_citations(answers, verified).collect()}
    assert got[1] == "A [2] b [1] c [1], [99].\n\n## References\n[1] Title 3\n[2] Title 7"
    assert got[2].startswith("none\n\n## References\n[1] Title 1")


def test_strip_references(spark):
    strip = cite.strip_references(F.col("t"))
    assert one(spark, strip, t="a\nb\n## References\n[1] x") == "a\nb"
    assert one(spark, strip, t="a\n**References**\nx") == "a"
    assert one(spark, strip, t="a\nsources\nx") == "a\nsources\nx"
    assert one(spark, strip, t="This references x") == "This references x"


def test_faithfulness(spark):
    df = spark.createDataFrame([("It is 42.7 in 2020, or 3 [12].", "none"), ("It is 42.7", "42.7"), (None, None)], "text string, context string")
    assert [r.unmatched for r in cite.numeric_faithfulness(df).collect()] == [["42.7"], [], []]


def test_retractions(spark):
    asked = spark.createDataFrame([(1, "What is x?", 0), (2, "Which were retracted?", 0)], "question_id int, question string, doc_filter_min_keep int")
    rows = [(q, i, t, s) for q in (1, 2) for i, (t, s) in enumerate([("RETRACTED: Effects", None), ("On unretracted work", None), ("Fine", "Withdrawn"), (None, None)])]
    docs = spark.createDataFrame(rows, "question_id int, idx int, title string, status string")
    kept = {(r.question_id, r.idx) for r in docfilter.drop_retracted(docs, asked).collect()}
    assert kept == {(1, 1), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3)}


def test_alignment(spark):
    a = spark.createDataFrame([(1, i, i, "t", f"u{i}") for i in range(3)], "question_id int, position int, doc_id int, title string, uri string")
    b = a.withColumn("uri", F.when(F.col("position") == 1, "z").otherwise(F.col("uri")))
    assert assemble.alignment_check(a, b).first().first_difference == 1
    assert assemble.alignment_check(a, a).first().aligned
    assert assemble.alignment_check(a, a.where("position < 2")).first().first_difference == 2


def test_scores(spark):
    names = evaluate.CRITERIA
    df = spark.createDataFrame([(1, "a", *[6] * 7, 7), (2, "a", *[6] * 7, None)], "question_id int, pipeline string, " + ", ".join(f"{n} int" for n in names))
    assert [r.overall for r in evaluate.load_scores(df).collect()] == [6.12]
    assert evaluate.null_scores(df).first().n == 1
    fives = [(5, 5, 5, 5, 5), (4, 4, 4, 4, 4), (1, 5, 5, 1, 5), (-1, 4, 4, 4, 4), (3, 4, 3, 4, 2), (5, 5, 5, 5, 4)]
    df = spark.createDataFrame(fives, ", ".join(f"s{i} int" for i in range(5)))
    assert [r.severity for r in evaluate.score_anomalies(df, [f"s{i}" for i in range(5)]).collect()] == ["info", "low", "medium", "high", "none", "low"]


def test_signed_rank():
    assert round(1 - 2 * 172 / (70 * 71 / 2), 3) == 0.862
    assert evaluate.signed_rank_p(0, 5, []) == pytest.approx(0.0625)
    assert evaluate.signed_rank_p(0, 0, []) == 1.0
    assert evaluate.signed_rank_p(172, 60, [4]) == pytest.approx(evaluate.signed_rank_p(172, 60, [2, 2]), abs=1e-4)


def test_parsing(spark):
    rows = ['[{"title": "a", "_id": 1, "x": null, "k": [{"_rev": 1, "n": 2}]}]', "[{'title': 'b', 'embedding': [1]}]", "", None, "[broken", '{"a": 1}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, kg_results string")
    got = ingest.parse_kg_results(df).orderBy("i").collect()
    shown = {r.i: r.d for r in ingest.parse_kg_results(df).select("i", F.transform("docs", lambda v: F.to_json(v)).alias("d")).collect()}
    assert shown == {0: ['{"k":[{"n":2}],"title":"a"}'], 1: ['{"title":"b"}'], 2: [], 3: [], 4: [], 5: []}
    assert [r.parsed for r in got] == [True, True, True, True, False, True]
    links = '<meta content="//x.org/a.pdf" name="citation_pdf_url">'
    pages = spark.createDataFrame([(1, "https://p.org/q", links), (2, "https://p.org/q", '<a href="/b.pdf?x=1">'), (3, "u", None)], "page_id int, url string, html string")
    assert [r.pdf_url for r in ingest.html_pdf_links(pages).collect()] == ["https://x.org/a.pdf", "https://p.org/b.pdf?x=1", None]


def test_upsert_twice_changes_nothing(spark):
    a = spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "k int, ord int, v string")
    b = spark.createDataFrame([(2, 3, "z"), (3, 4, "w"), (3, 5, "v")], "k int, ord int, v string")
    once = ingest.upsert(a, b, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, 1, "x"), (2, 3, "z"), (3, 5, "v")] == sorted(map(tuple, ingest.upsert(once, b, ["k"]).collect()))
    assert sorted(map(tuple, ingest.insert_if_absent(a, b, ["k"]).collect())) == [(1, 1, "x"), (2, 2, "y"), (3, 4, "w")]


def test_expand_without_self(spark):
    docs = spark.createDataFrame([(i, "t", "a") for i in range(4)], "doc_id int, title string, abstract string")
    keys = spark.createDataFrame([(1, "k")], "keyword_id int, name string")
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 1, 0.8), (2, 1, 0.7), (3, 1, 0.1)], "doc_id int, keyword_id int, score double")
    hits = spark.createDataFrame([(1, 0)], "question_id int, doc_id int")
    with_self = retrieve.kg_expand(hits, docs, keys, edges).first().secondary
    without = retrieve.kg_expand(hits, docs, keys, edges, exclude_self=True).first().secondary
    assert [s.doc_id for s in with_self] == [0, 1] and [s.doc_id for s in without] == [1, 2]


def test_throttle_with_null_addresses_and_known_uses(spark):
    rows = [(q, i, None if i % 2 else "", f"d{q}{i}", "full", True, 1) for q in (1, 2) for i in range(5)]
    rows += [(3, i, "u1", f"x{i}", "full", True, 1) for i in range(5)] + [(4, i, "u1" if i < 3 else None, "x9" if i == 3 else None, "full", True, 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "question_id long, idx int, uri string, doc_id string, final_label string, gated boolean, doc_filter_min_keep int")
    got = docfilter.reuse_throttle(docs).where("throttled").select("question_id", "idx").collect()
    assert sorted(map(tuple, got)) == [(4, 0), (4, 1)]  # no document without an address is the same as another
    known = spark.createDataFrame([("d10", 0), ("x9", 0)], "doc_key string, first_question long")
    got = docfilter.reuse_throttle(docs, known).where("throttled").select("question_id", "idx").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (4, 0), (4, 1)]


def test_bounded_bm25_equals_scoring_everything(spark):
    import random

    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randint(0, 6))), " ".join(r.choices(words, weights, k=r.randint(0, 40)))) for i in range(300)]
    queries = [(q, " ".join(r.choices(words, weights, k=8) + r.choices(words[30:], k=2 * (q % 2)))) for q in range(12)] + [(50, "w0 w1"), (51, "absent"), (52, None)]
    docs = spark.createDataFrame(docs, "doc_id long, title string, abstract string")
    queries = spark.createDataFrame(queries, "question_id long, question string")
    terms, parts = retrieve.postings(queries, docs)
    want = terms.join(parts, "term").groupBy("question_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    for k, lead, size in ((5, 1, 4), (5, 8, 1), (16, 2, 20), (400, 1, 1000), (2, 1, 1)):
        best = {}
        for x in sorted(want.collect(), key=lambda x: (-x.score, x.doc_id)):
            best.setdefault(x.question_id, []).append((x.doc_id, x.score))
        got = {}
        for x in sorted(retrieve.bm25_topk(queries, docs, k, lead, size).collect(), key=lambda x: x["rank"]):
            got.setdefault(x.question_id, []).append((x.doc_id, x.score))
        assert got == {q: v[:k] for q, v in best.items()}


def test_blocks_that_cannot_matter_are_skipped(spark, monkeypatch):
    """Two languages of 40 documents: a question in one of them scores no block of the other."""
    docs = [(i, "", ("the of " if i < 40 else "der und ") + f"word{i} word{i // 2} shared") for i in range(80)]
    docs = spark.createDataFrame(docs, "doc_id long, title string, abstract string")
    asked = spark.createDataFrame([(1, "the of word1 word0 word2 word3 shared"), (2, "und der")], "question_id long, question string")
    terms, parts = retrieve.postings(asked, docs)
    index = retrieve.block_postings(parts, 10).collect()
    sizes = {x.block: x.docs for x in index}
    assert sum(sizes.values()) == 80 and len({(x.block, x.term) for x in index}) == len(index)  # every document is in one block
    assert all(x.most == max(d.part for d in x.list) and x.docs >= len(x.list) for x in index)
    seen, score = [], retrieve.block_scores
    monkeypatch.setattr(retrieve, "block_scores", lambda blocks, index: seen.append(blocks.where("question_id = 1").select("block")) or score(blocks, index))
    top = [tuple(x) for x in retrieve.bm25_topk(asked, docs, 3, 1, 10).where("question_id = 1").orderBy("rank").select("doc_id", "score").collect()]
    everything = terms.join(parts, "term").where("question_id = 1").groupBy("doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    assert top == [tuple(x) for x in everything.orderBy(F.desc("score"), "doc_id").limit(3).collect()]
    scored = {x.block for df in seen for x in df.collect()}
    assert scored and all(b.split()[0] in ("the", "of") for b in scored) and len(scored) < len(sizes)


def test_a_question_of_most_rows_is_ranked_by_all_tasks(spark):
    import random

    from evspark.operators.running import ranked

    r = random.Random(8)
    tiers, labels = ["tier-1", "tier-m", "tier-3"], ["full", "abstract", "drop", "odd", "drop", "full"]
    rows = []
    for q in range(12):
        kinds = labels if q % 4 else [*labels, None]
        for i in range(400 if q == 5 else r.randint(1, 12)):
            used = r.randint(0, 3) if r.random() < 0.8 else None
            rows.append((q, i, f"d{q}-{i}", r.choice(kinds), r.choice([0.1, 0.5, r.random()]), i + 1, tiers[q % 3], 3, "abstracts" if q % 2 else "x", f"u{used}" if used is not None else None))
    schema = "question_id long, idx int, doc_id string, label string, similarity double, lexical_rank int, rule_hit string, doc_filter_min_keep int, evidence_mode string, uri string"
    docs = spark.createDataFrame(rows, schema).repartition(3)

    def judged(spread):
        got = docfilter.filter_gate(docfilter.classify_guardrail(docs, spread=spread), spread=spread)
        got = docfilter.abstracts_topup(docfilter.lexical_fallback(got, spread=spread), spread=spread)
        return sorted(map(tuple, docfilter.reuse_throttle(got, spread=spread).select(*sorted(got.columns), "throttled").collect()), key=str)

    plain = judged(False)
    assert judged(True) == plain and len(plain) == len(rows) and {x[-1] for x in plain} == {True, False}
    places = ranked(docs, ["question_id"], [F.desc("similarity"), "idx"], "place", spread=True)
    assert sorted(x.place for x in places.where("question_id = 5").collect()) == list(range(1, 401))
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "windowspecdefinition" in line]
    assert windows and all("__range" in w for w in windows)  # no window over a question alone


def test_sums_before_any_order(spark):
    from evspark.operators.running import sums_before

    rows = [("a" if i % 5 else "b", (i * 7919) % 1_000_003 - 500_000, i % 3 or None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, ord long, v long").repartition(3)
    got = {r.ord: r.s for r in sums_before(df, ["g"], ["ord"], {"s": F.col("v")}).collect()}
    for g, o, _ in rows:
        assert got[o] == sum(v or 0 for h, p, v in rows if h == g and p < o)
    assert [r["index"] for r in ingest.with_index(df, "ord").orderBy("ord").collect()] == list(range(400))
    assert sums_before(df.limit(0), ["g"], ["ord"], {"s": F.col("v")}).count() == 0


def test_probe_sample(spark):
    def picked(counts):
        rows = spark.createDataFrame([(i, i, n) for i, n in enumerate(counts)], "question_id int, ord int, n_candidates int")
        return sorted(r.question_id for r in route.probe_sample(rows).collect())

    assert picked([0, 7, 5, 2, 6, 9, 1]) == [1, 3, 4]
    assert picked([4, 5, None, 0]) == [0, 1, 2]
    assert picked([2]) == [0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""), ("a\n**References**\nb", "a"), ("References", ""), ("a\n## REFERENCES \nx", "a"), ("a\nreferences:\nx", "a"), ("a\nreferences\nx", "a\nreferences\nx"),
        ("a\n\n### References\n[1] b", "a"), ("a References", "a References"),
    ],
)
def test_strip_references_loose(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(cite.strip_references_loose(F.col("t")).alias("x")).first().x == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("3, 7 confirm that", "[3][7] confirm that"), ("\n3, 45 show", "\n[3] show"), ("40, 45 show", "40, 45 show"), ("see [3, 7, 9].", "see [3][7][9]."), ("[2020, 31]", "[2020][31]"),
        ("word 3, 7.", "word [3][7]."), ("rate 4.85 mas", "rate 4.85 mas"), ("size 2.16 Ma", "size 2.16 Ma"), ("rose 3, 4 abc", "rose [3], 4 abc"), ("in 2020, it", "in 2020, it"),
        ("was 5; then", "was [5]; then"), ("[1] 4\nnext", "[1] [4]\nnext"), ("a 31.", "a 31."), ("a 7--b", "a [7]--b"), ("50% 8 [2]", "50% [8] [2]"), ("x 345.", "x 345."), ("é 5.", "é 5."), ("end 9", "end [9]"),
    ],
)
def test_marks_of_lists(spark, text, want):
    assert normalize_one(text) == want
    assert one(spark, cite.normalize_citations(F.col("t")), t=text) == want


def test_marks_against_a_scan(spark):
    import random

    r = random.Random(21)
    signs = ["1", "2", "3", "07", "30", "31", "45", "100", ", ", ",", " ,", " ", "  ", "\n", "[", "]", ".", ";", "--", "-", "%", ")", "a", "Word", "é", "4.5", ", 7", ", 40", "[3, 7]"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(30_000)] + ["word 40,\n50, 6 Foo", "a 1, 2, 3, 4, 5, 6.", "1, 2, 3, 4, 5, 6 Foo"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.m for x in df.select("i", cite.normalize_citations(F.col("t")).alias("m")).collect()}
    assert [t for i, t in enumerate(texts) if got[i] != normalize_one(t)] == []
    assert "Python" not in df.select(cite.normalize_citations(F.col("t")))._jdf.queryExecution().executedPlan().toString()


def test_numbers_against_python(spark):
    """Counts and scores against Python's own engine, over words, signs, exponents and glued letters."""
    import random
    import re

    r = random.Random(9)
    texts = ["".join(r.choice(["1", "2", "34", "e", "E", "x", "_", ".", ",", "-", "+", " ", "km", "é"]) for _ in range(r.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.n for x in df.select("i", T.numeric_count(F.col("t")).alias("n")).collect()}
    assert got == {i: len(re.findall(T.NUMBER, t)) for i, t in enumerate(texts)}
    pieces = spark.createDataFrame([(i, 1, 1, "results", 1, t, 3, 1) for i, t in enumerate(texts)], "doc_id int, section_no int, chunk_no int, section string, page int, text string, tokens int, question_id int")
    terms = spark.createDataFrame([(1, ["km", "xe"], ["e"])], "question_id int, keywords array<string>, literals array<string>")
    scores = {x.doc_id: x.score for x in chunks.score_chunks(pieces, terms).collect()}
    for i, t in enumerate(texts):
        words = re.findall("[a-z][a-z0-9\\-]{1,}", t.lower())
        units = sum(u in words for u in T.UNITS)
        hits = len({"km", "xe"} & set(words)) / (2**0.5 + 1e-6) + 0.25 * ("e" in t.lower()) + min(0.6, 0.05 * got[i]) + min(0.3, 0.05 * units)
        assert scores[i] == pytest.approx(1.5 * hits if words else 0.0, abs=1e-9), t


def test_numbers_of_the_sql_against_python():
    """The SQL's count against Python's engine, with runs of exponents and letters that share digits (as in hexadecimal keys)."""
    import random
    import re

    import duckdb

    from evspark.plans.catalog_a import numbers_sql

    r = random.Random(5)
    texts = ["f16e3741e8 2", "3e456e78x", "12e34e56", "1e23e45e67e89e1", "5.2e6e7", "1,2e+34x 4e-5x", "-7e1", "\x01e5 \x021", "e5", "x6e35"]
    for alphabet in ("0123456789abcdef", "12e", "1e+-.,x ", "7eE_\x01\x02\x03 "):
        texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(1000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, text VARCHAR)")
    con.execute("INSERT INTO t SELECT unnest(?), unnest(?)", [list(range(len(texts))), texts])
    got = dict(con.execute(f"SELECT i, {numbers_sql('text')} FROM t").fetchall())
    assert [x for i, x in enumerate(texts) if got[i] != len(re.findall(T.NUMBER, x))] == []
    assert con.execute(f"SELECT {numbers_sql('NULL')}").fetchone() == (0,)


def test_chunk_scores_of_hexadecimal_keys(spark, tmp_path):
    """ev28 against its SQL on texts in which one number's exponent holds the first digit of the next."""
    import duckdb

    import __spark_entry__ as entry

    texts = ["Key f16e3741e8 is known. Some 3e456e78x more", 'token = "37b82ad0dab34e35e3" of 5 km', "1e23e45e67e89e1. And 12 or 7e1f"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(3)) AS doc_id, unnest(?) AS text, 'en' AS lang, 's' AS source", [texts])
    con.execute("CREATE TABLE benchmark AS SELECT unnest([0::BIGINT, 1]) AS item_id, unnest(['Which key is known and how many more', 'token of some']) AS text")
    for name in ("documents", "benchmark"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    got = {(x.doc_id, x.section_no, x.chunk_no): x.score for x in entry.queries()["ev28_score_chunks"](spark, str(tmp_path)).collect()}
    want = con.execute(f"SELECT doc_id, section_no, chunk_no, score FROM ({entry.oracle_sql()['ev28_score_chunks']})").fetchall()
    assert got == {tuple(x[:3]): pytest.approx(x[3], abs=1e-9) for x in want} and len(got) == 3


def test_chunk_scores_of_odd_signs(spark, tmp_path):
    """ev28 against its SQL on other spaces, line ends, marks and letters whose capitals or small letters are several signs."""
    import duckdb

    import __spark_entry__ as entry

    texts = ["\u00a0Key one.\u00a0Two\u2003\nmore\x01signs. And 5", "a\n2. Methods\r\nkey\x0b\r\nRESULTS \u00df\nb\nDISCUSSION \ufb01\nknown", "\u0130many key\n3\x0bResults\u2028\nmore"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(3)) AS doc_id, unnest(?) AS text, 'en' AS lang, 's' AS source", [texts])
    con.execute("CREATE TABLE benchmark AS SELECT unnest([0::BIGINT, 1]) AS item_id, unnest(['Which key is known and how many more', 'imany of many']) AS text")
    for name in ("documents", "benchmark"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    for name in ("ev26_chunk", "ev28_score_chunks"):
        got = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 4


def test_similarity_shuffles_words_once(spark, monkeypatch):
    """Words are counted within their rows and go through one shuffle, which counts and join share."""
    from evspark.functions.text import word_counts

    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["z"])], "i int, w array<string>")
    assert sorted(map(tuple, word_counts(rows, "w").collect())) == [(1, 3, "a", 1), (1, 3, "b", 2), (3, 1, "z", 1)]
    plans = []

    def kept(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return df

    monkeypatch.setattr(retrieve, "written", kept)
    docs = spark.createDataFrame([(1, 0, "one two", "three"), (1, 1, "one", ""), (1, 2, None, None), (2, 0, "four", "x")], "question_id long, idx long, abstract string, title string")
    asked = spark.createDataFrame([(1, "one three"), (2, "none")], "question_id long, question string")
    got = {(x.question_id, x.idx): x.similarity for x in retrieve.tfidf_cosine(asked, docs).collect()}
    assert got == {(1, 0): 0.712, (1, 1): 0.629, (1, 2): 0.0, (2, 0): 0.0}
    shuffles = [x for x in "\n".join(plans).split("\n") if "Exchange hashpartitioning" in x and "term#" in x and "ReusedExchange" not in x]
    assert len(shuffles) == 1, shuffles


def test_blocks_are_not_shuffled_for_each_question(spark):
    """Postings go to the place of their block, whatever the number of questions."""
    docs = spark.createDataFrame([(i, "", f"the of word{i} word{i // 2}") for i in range(40)], "doc_id long, title string, abstract string")
    asked = spark.createDataFrame([(q, f"the word{q}") for q in range(5)], "question_id long, question string")
    index = retrieve.written(retrieve.block_postings(retrieve.postings(asked, docs)[1], 10))
    blocks = index.select("block").distinct().crossJoin(asked.select("question_id")).selectExpr("question_id", "block", "array('the', 'word3') AS terms")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many questions
    try:
        scores = retrieve.block_scores(retrieve.written(blocks), index)
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(question_id" not in plan, plan
        assert scores.count() == 5 * 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_excerpts_read_lines_without_a_shuffle(spark, monkeypatch):
    """The flagship query picks the lines of its few documents where they are read."""
    from evspark.plans import catalog_c

    plans, sectionize = [], catalog_c.C.sectionize

    def seen(lines):
        lines.collect()
        plans.append(lines._jdf.queryExecution().executedPlan().toString())
        return sectionize(lines)

    monkeypatch.setattr(catalog_c.C, "sectionize", seen)
    assert catalog_c.evidence(spark, "/root/testdata/sf0.001").count() > 0
    final = plans[0].split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final


def test_excerpt_stats_cut_chunks_once(spark, monkeypatch):
    from evspark.plans import catalog_a

    calls, chunk = [], catalog_a.C.chunk
    monkeypatch.setattr(catalog_a.C, "chunk", lambda *a: calls.append(1) or chunk(*a))
    catalog_a.QUERIES["ev31_excerpt_stats"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


@pytest.mark.parametrize("n", range(1, 9))
def test_exact_p_values_by_enumeration(n):
    from itertools import product

    sums = [sum(k for k, up in zip(range(1, n + 1), signs, strict=True) if up) for signs in product([0, 1], repeat=n)]
    for w in range(n * (n + 1) // 4 + 1):
        assert evaluate.signed_rank_p(w, n, []) == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 2**n))


def test_empty_tables(spark):
    """Every operator on tables without rows."""
    import os

    from evspark.plans import catalog_a, catalog_b
    from evspark.sources.demo import demo

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the given tables are not here")
    none = lambda name: demo(spark, d, name).limit(0)
    docs, pairs, asked, answers = none("candidates"), none("av_pairs"), none("questions"), none("answers")
    given = catalog_b.given(spark, d).limit(0)
    judged = docfilter.filter_gate(docfilter.classify_guardrail(given))
    lines = catalog_a.lines(spark, d).limit(0)
    ranked = catalog_a.ranked_chunks(spark, d).limit(0)
    kept = chunks.topk_under_budget(ranked)
    per_doc = chunks.document_excerpts(docs.withColumnRenamed("download_status", "x").withColumn("status", F.lit("ok")), ranked, kept)
    numbered = docs.select("question_id", (F.col("idx") + 1).alias("number"), "title", "uri")
    loaded = evaluate.load_scores(none("judged"))
    tables = [
        docfilter.drop_retracted(docs, asked.withColumn("doc_filter_min_keep", F.lit(3))), docfilter.title_flags(docs, asked, pairs), docfilter.lexical_score(docs, pairs),
        docfilter.abstracts_topup(judged), docfilter.reuse_throttle(judged), docfilter.filter_summary(judged), docfilter.ontology_select(pairs), docfilter.reorder_by_ontology(docs, pairs),
        chunks.sectionize(lines), chunks.chunk(chunks.sectionize(lines)), kept, chunks.global_budget_select(kept), per_doc, chunks.excerpt_stats(per_doc, kept), chunks.query_terms(asked, pairs),
        assemble.documents_block(judged, docs.select("question_id", "doc_id", F.lit(1).alias("page"), F.lit(1).alias("excerpt_no"), F.lit("s").alias("section"), F.col("title").alias("text"))),
        assemble.context_views(none("assessed")), assemble.alignment_check(docs.withColumnRenamed("idx", "position"), docs.withColumnRenamed("idx", "position")),
        cite.verify_references(answers, numbered), cite.renumber_citations(answers, cite.verify_references(answers, numbered)), cite.answer_scorecard(answers), cite.validate_answers(answers),
        retrieve.bm25_topk(asked, docs), retrieve.tfidf_cosine(asked, docs), evaluate.summary(loaded), evaluate.wilcoxon_pairs(loaded, [("ontology", "two_step")]), evaluate.worst_cases(loaded),
        evaluate.metric_quality(none("metrics"), ["m0"]), evaluate.metric_switched_off(none("metrics")), evaluate.run_stats(none("runs")), route.route(none("profiles")),
        route.tier_sample(route.route(none("profiles")), {"tier-3": 2}), ingest.load_questions(asked), ingest.parse_kg_results(asked.withColumn("kg_results", F.lit("[]"))),
    ]
    assert [t.count() for t in tables] == [0] * len(tables)


def test_profile_reads_each_text_once(spark):
    """Small letters are made once a row, and types and flags are those of the patterns as they are written."""
    texts = [
        "", None, "By 2020x by 2020", "aby how. by howl", "what is", "xwhat is,", "redefine defined define", "a vs. b", "vs.c", "vsx", "how do 5 and and and b or x",
        "past 12 years", "between 1999", "since1", "1999a 1999", "119 2020", "x19 a1999 12345 7", "Why does it work", "why does it", "ésince decadeé", "used foŕ", "9٣99 12",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = T.with_profile(rows, "text")
    q = F.lower(F.coalesce("text", F.lit("")))
    kind = F
    for name, pattern in T.TYPE_PATTERNS:
        kind = kind.when(q.rlike(pattern) & (T.any_contains(q, T.ACTING) if name == "mechanism" else F.lit(True)), name)
    years = F.when(q.rlike(r"\b(19|20)[0-9]{2}\b"), 0.4).otherwise(0.0) + F.when(q.rlike(r"\b(decade|past [0-9]+ years|since|between [0-9]{4})\b"), 0.3).otherwise(0.0)
    hits = q.rlike(r"\b[0-9]{2,4}\b").cast("int") + q.rlike("%|percent|percentage|fraction|rate|trend|magnitude|amount|volume").cast("int") + (F.col("k") == "quantitative").cast("int")
    size = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) * 0.015 + 0.1 * sum((F.regexp_count(q, F.lit(w)) for w in T.JOINERS), F.lit(0))
    least = lambda x: F.bround(F.least(F.lit(1.0), x), 2)
    want = rows.withColumn("k", kind.otherwise("continuous")).select("i", "k", least(0.25 + size), least(0.15 + 0.25 * hits), least(0.1 + years))
    columns = ["i", "question_type", "complexity", "quantitativity", "temporal_specificity"]
    near = lambda x: (*x[:2], *[round(float(v), 2) for v in x[2:]])
    assert sorted(map(near, got.select(*columns).collect())) == sorted(map(near, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("CASE WHEN") < 8


def test_candidates_are_scored_once(spark):
    """The text of a candidate is made once a row, not once a literal, and the blocks start from written labels (ev50, ev78)."""
    import __spark_entry__ as entry

    docs = spark.createDataFrame([(1, 0, "A b key", "T"), (1, 1, None, None), (2, 0, "x", "Y")], "question_id long, idx long, abstract string, title string")
    pairs = spark.createDataFrame([(1, 0, "key", "a B", "t")], "question_id long, pos int, attribute string, value string, description string")
    got = docfilter.lexical_score(docs, pairs)
    assert {(r.question_id, r.idx): r.lexical for r in got.collect()} == {(1, 0): 2.5, (1, 1): 0.0, (2, 0): 0.0}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(got).count("concat_ws(") == 1
    for name in ("ev50_cited_block", "ev50_documents_block"):
        assert "array_intersect" not in plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
