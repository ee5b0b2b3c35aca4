"""Terms in texts by one automaton: against looking each one up, and in time linear in the text."""

import random
import time

from pyspark.sql import functions as F

from evspark.functions.terms import TermAutomaton, term_places
from evspark.operators import chunks, docfilter

R = random.Random(31)
WORDS = ["a", "ab", "abc", "b", "bca", "é", "é b", "c c", "\n", "x.y", "a*", "ba ", "caba"]


def text():
    return "".join(R.choice(WORDS) + R.choice(["", " "]) for _ in range(R.randint(0, 12)))


def test_places(spark):
    lists = [(k, [R.choice([*WORDS, "", None, "zz"]) for _ in range(R.randint(0, 9))]) for k in range(5)] + [(5, None), (None, ["a"])]
    rows = [(R.choice([0, 1, 2, 3, 4, 5, 6, None]) if i % 3 else 1, i, text() if i % 17 else None, 7) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, i int, t string, found int").repartition(3)
    terms = spark.createDataFrame(lists, "k int, terms array<string>")
    got = term_places(df, "k", F.col("t"), terms, "found", salts=3)
    assert got.columns == ["k", "i", "t", "found"]
    by_key = {k: v or [] for k, v in lists if k is not None}
    want = {i: [n for n, x in enumerate(by_key.get(k, [])) if t is not None and x is not None and x in t] for k, i, t, _ in rows}
    assert {r.i: r.found for r in got.collect()} == want
    assert term_places(df.limit(0), "k", F.col("t"), terms, "found").count() == 0


def test_operators_agree_with_single_lookups(spark):
    pairs = [(q, p, R.choice(WORDS), R.choice([*WORDS, "long value of some kind"]), R.choice([None, "x.y"]), R.random()) for q in range(6) for p in range(5)]
    pairs = spark.createDataFrame(pairs, "question_id int, pos int, attribute string, value string, description string, centrality double")
    docs = spark.createDataFrame([(q, i, text().upper() if i % 5 else None, text()) for q in range(8) for i in range(12)], "question_id int, idx int, title string, abstract string")
    asked = spark.createDataFrame([(q, "Which large bridges cross rivers?") for q in range(7)], "question_id int, question string")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    for f in (lambda m: docfilter.lexical_score(docs, pairs, many_terms=m), lambda m: docfilter.reorder_by_ontology(docs, pairs, many_terms=m), lambda m: docfilter.title_flags(docs, asked, pairs, many_terms=m)):
        assert same(f(False), f(True))
    pieces = docs.select("question_id", "idx", F.lit("results").alias("section"), F.col("abstract").alias("text"))
    terms = chunks.query_terms(asked, pairs)
    assert same(chunks.score_chunks(pieces, terms), chunks.score_chunks(pieces, terms, many_terms=True))


def test_ten_thousand_terms_take_one_reading():
    terms = ["".join(R.choice("abcdefgh") for _ in range(R.randint(5, 12))) for _ in range(10_000)]
    automaton = TermAutomaton(terms)

    def took(n):
        t = "".join(R.choice("abcdefgh") for _ in range(n))
        began = time.process_time()
        automaton.places(t)
        return time.process_time() - began

    short, long = min(took(200_000) for _ in range(3)), min(took(1_600_000) for _ in range(3))
    assert long < 24 * max(short, 0.005)
