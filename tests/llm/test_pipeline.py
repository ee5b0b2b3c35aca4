"""The stages of the pipeline one after another, against brute force."""

import corpus_pipeline
from tests.llm.test_operators import PASSAGE, prose, spans_by_force


def test_stages(spark, tmp_path):
    texts = [prose(200 + i, 40 + i) for i in range(30)]
    texts += [texts[3], texts[4].replace(" ", "  ", 1), prose(80, 90) + texts[5][:400] + prose(80, 91), prose(90, 92) + PASSAGE + prose(90, 93), "short", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
    assert {r.doc_id for r in kept["quality_rules"]} == set(range(34))
    assert {r.doc_id for r in kept["near_duplicates"]} == set(range(34)) - {30, 31}
    want = {i: (n - m) for i, n, m, _, _ in spans_by_force([(r.doc_id, r.text) for r in kept["near_duplicates"]], 50)}
    assert {r.doc_id: len(r.text.encode()) for r in kept["repeated_passages"]} == want and want[32] < len(texts[32].encode())
    assert {r.doc_id for r in kept["benchmark_free"]} == {r.doc_id for r in kept["repeated_passages"]} - {33}
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["benchmark_free"]}
    assert sum(r.length for r in kept["packing"]) == sum(r.doc_tokens for r in kept["packing"] if r.start == 0)
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted((r.doc_id, r.start + r.length) for r in whole)[-1][0] == max(r.doc_id for r in kept["packing"])


def test_rows_of_one_id_are_judged_apart(spark, tmp_path):
    """Two different texts under a null id and under a repeated id, in each stage."""
    a, b, c, d, e = (prose(200, 700 + i) for i in range(5))
    same = prose(60, 710)
    hit, clean = a[:400] + "\n" + same + "\n" + b[:400], c[:400] + "\n" + prose(60, 711) + "\n" + d[:400]  # the same offsets
    copy, bench = e.replace(" ", "  ", 1), " ".join(f"leak{i}" for i in range(12))
    columns = "doc_id long, text string, lang string, source string, n_chars long"

    def frame(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], columns)

    def out(stage, rows):
        return sorted(((r.doc_id, r.text) for r in stage(spark, frame(rows), str(tmp_path)).collect()), key=str)

    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for i in (7, None):
        assert out(corpus_pipeline.quality_rules, [(i, clean), (i, "short")]) == [(i, clean)]
        got = out(corpus_pipeline.near_duplicates, [(1, e), (i, copy), (i, clean), (i, "")])
        assert got == sorted([(1, e), (i, clean), (i, "")] + [(i, copy)] * (i is None), key=str)
        rows = [(1, prose(30, 712) + "\n" + same), (i, hit), (i, clean), (i, clean)]
        kept = out(corpus_pipeline.repeated_passages, rows)
        assert kept.count((i, clean)) == 2 and (i, hit) not in kept and len(kept) == 4
        assert sum(len(t) for _, t in kept) <= sum(len(t) for _, t in rows) - len(same)
        got = out(corpus_pipeline.benchmark_free, [(i, clean), (i, hit + " " + bench), (3, a)])
        assert got == sorted([(i, clean), (3, a)], key=str)


def test_stages_on_odd_tables(spark, tmp_path):
    """Null and empty texts, null ids, equal rows, extra columns with names of the stages' own, and no rows at all."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b = prose(200, 801), prose(200, 802)
    columns = "doc_id long, text string, lang string, source string, n_chars long, removal string, key string, id long, row int, salt int, spans string"
    rows = [(3, a), (3, a), (None, a), (None, None), (4, None), (5, ""), (5, "short"), (1, b), (7, a.replace(" ", "  ", 1)), (7, prose(200, 803)), (9, prose(200, 803))]
    docs = spark.createDataFrame([(i, t, None if i == 4 else "en", "s", 0, "r", "k", 1, 2, 3, "x") for i, t in rows], columns)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        got = stage(spark, docs, str(tmp_path))
        out[name] = got.collect()
        if name != "packing":
            assert got.columns == docs.columns and {r.removal for r in out[name]} == {"r"} and {r.spans for r in out[name]} == {"x"}
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert sorted(((r.doc_id, r.text) for r in out["quality_rules"]), key=str) == sorted(((i, t) for i, t in rows if t and len(t) > 50), key=str)
    kept = sorted(out["near_duplicates"], key=key)
    assert [(r.doc_id, r.text) for r in kept if r.doc_id is not None] == [(1, b), (3, a), (4, None), (5, "short"), (7, prose(200, 803))]
    assert sum(r.doc_id is None for r in kept) == 2
    assert len(out["repeated_passages"]) == len(out["benchmark_free"]) == len(rows)
    lost = [r.doc_id for r, (_, t) in zip(sorted(out["repeated_passages"], key=key), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), strict=True) if (r.text or "") != (t or "")]
    assert set(lost) <= {7, 9, None} and lost
    assert sum(r.length for r in out["packing"] if r.doc_id == 4) == 1
