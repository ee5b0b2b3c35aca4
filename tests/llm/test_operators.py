"""The text operators against brute force on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evspark.llm import decontaminate, html_main, jaccard, langid, packing, quality, queries, suffix_dedup, token_edits, toxicity
from evspark.llm.common import ID_MASK, ChunkTokens, default_tokenizer, split_chunks
from evspark.llm.components import components

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abdeiknorstu") for _ in range(R.randint(1, 7))) for _ in range(300)] + ["Éa", "naïve", "x²", "a1"]


def prose(words, seed):
    r = random.Random(seed)
    return "".join(r.choice(VOCABULARY) + r.choice([" ", " ", " ", ", ", ". ", ".\n"]) for _ in range(words))


LONG = prose(9000, 1)
PASSAGE = prose(40, 2)
TEXTS = [
    None, "", "   \n", "One.", prose(200, 3), prose(200, 3), prose(200, 3).replace("a", "e", 2), LONG, LONG[:-300] + prose(20, 4),
    PASSAGE, prose(60, 5) + PASSAGE + prose(60, 6), "éé" * 40 + PASSAGE.upper(), "a" * 120, "a" * 300, "ab " * 200, prose(3, 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, words string, hash string, at int, `row` int, own string, id string, sig string, doc string, spans string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s", None) + ("x",) * 3 + (1, 1) + ("x",) * 5 + (1,) for i, t in enumerate(TEXTS)]
    rows.append((None, PASSAGE) + rows[0][2:])
    rows.append(rows[4])
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    got = packing.pack(docs, window=256, exact=(256, 128), block=3000).collect()
    for i, text in enumerate(TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted((p for p in got if p.doc_id == i), key=lambda p: p.start)
        if i == 4:  # the row that comes twice
            assert sum(p.length for p in pieces) == 2 * len(ids)
            continue
        at = 0
        for p in pieces:
            part = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32, bytes(p.ids)) == (at, len(ids), zlib.crc32(part), part)
            at += p.length
        assert at == len(ids)
    for s in {p.sequence_id for p in got}:
        pieces = sorted((p for p in got if p.sequence_id == s), key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()]
        assert sum(p.length for p in pieces) <= 256
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(seed):
    r = random.Random(seed)
    at = [0]
    while at[-1] < 60:
        at.append(at[-1] + r.randint(1, 5))
    penalty = [r.choice([0.0, 1.0, 3.0]) for _ in at]
    best = [0.0] + [1e9] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            if (n := at[j] - at[i]) <= 16:
                best[j] = min(best[j], best[i] + penalty[j] + (0 if n in (4, 8) else 16 - n))
    cuts = packing.choose_cuts(at, penalty, 16, (4, 8))
    cost = sum(penalty[at.index(b)] + (0 if b - a in (4, 8) else 16 - b + a) for a, b in zip([0, *cuts], cuts, strict=False))
    assert cuts[-1] == at[-1] and cost == pytest.approx(best[-1])


def test_chunk_tokens_equal_the_tokenizer():
    cache = ChunkTokens(default_tokenizer(), limit=50)
    for text in ["H\u0331o", "T\u0308", "W\u030a", "Y\u030a", "J\u030c", "T\u0324\u0308", LONG[:3000], "A.. b ... C's don't\n\nÉcole. x!? 3.14 a_b İ K é , .\x1cz\xa0y\t<|endoftext|>", "Word\nword,\nWORD."]:
        assert (cache.flagged([text])[0] & ID_MASK).tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids
    r = random.Random(8)
    signs = [*"abzABZéÉİıßǅΣς.,!?:;'\"-1½٣你😀ﬁŉⅧªა ", *" \n\t\r  ", "\u0301", "\u0307", "\u0331", "\u0308", "\u030a", "\u030c", "\u0324", *"HJTWY", "İ:", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x85", "\u2003"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(5000)]
    for text, ids in zip(texts, cache.flagged(texts), strict=True):
        assert (ids & ID_MASK).tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids


def test_plain_words_go_to_the_model_at_once(monkeypatch):
    """With the ids of the whole tokenizer, and only once where a mark follows; other chunks go through all of it."""
    cache, seen = ChunkTokens(default_tokenizer(), limit=100_000), []
    encode = cache._encode
    monkeypatch.setattr(cache, "_encode", lambda chunks: (seen.extend(chunks), encode(chunks)))
    r = random.Random(5)
    letters = [*"abcdefghijklmnopqrstuvwxyz" * 3, *map(chr, range(0xDF, 0x100))]
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(4000)]
    words += [*map(chr, range(0xDF, 0x100)), "x" * 3000, "ß", "straße", "don't", "ﬁn", "ŝi", "e\u0301t", "a×b"]
    text = " ".join(w + r.choice(["", "", ".", ",\n", "\n"]) for w in words)
    assert (cache.flagged([text])[0] & ID_MASK).tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids
    assert seen and not [c for c in seen if re.fullmatch(r"[a-zß-öø-ÿ]+", c)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_decontamination(spark, docs, none):
    items = [(1, PASSAGE), (2, "ab ab"), (3, None), (10, "  "), (4, prose(12, 9)), (5, prose(200, 3)[:300]), (1, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.decontaminate(docs, bench).collect()}
    for i, text in enumerate(TEXTS):
        words, hit, found = WORD.findall(lowered(text)), set(), set()
        for item, t in items:
            w = WORD.findall(lowered(t))
            for a in range(max(1, len(w) - 9) if w else 0):
                gram = w[a : a + 10]
                for k in range(len(words) - len(gram) + 1):
                    if words[k : k + len(gram)] == gram:
                        hit |= set(range(k, k + len(gram)))
                        found.add(str(item))
        r = got[i, len(words)]
        assert (r.n_hit, r["items"], r.contaminated) == (len(hit), sorted(found), bool(hit)), i
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert clean == {i for (i, _), r in got.items() if not r.contaminated}
    cut = decontaminate.remove_spans(docs, decontaminate.decontaminate(docs, bench)).where("doc_id = 10").first().text
    assert len(WORD.findall(lowered(cut))) == got[10, len(WORD.findall(lowered(TEXTS[10])))].n_words - got[10, len(WORD.findall(lowered(TEXTS[10])))].n_hit
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    shuffled = decontaminate.decontaminate(docs, bench, max_broadcast_bytes=0)
    assert {(r.doc_id, r.n_words): r for r in shuffled.collect()} == got


def test_decontamination_of_rows_with_null_and_repeated_ids_equals_its_sql(spark, tmp_path):
    import duckdb

    hit, clean = prose(30, 31) + PASSAGE, prose(60, 32)
    rows = [(None, hit), (None, clean), (None, None), (7, hit), (7, clean), (7, clean), (8, "ab ab"), (9, "x AB ab y"), (9, hit + " " + hit)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, "ab AB"), (None, None), (11, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op2_decontamination(spark, str(tmp_path))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(queries.OP2_SQL).fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and got.count() == len(rows)
    docs, bench = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    kept = Counter(map(tuple, decontaminate.drop_contaminated(docs, bench).collect()))
    assert kept == Counter([(None, clean), (None, None), (7, clean), (7, clean)])
    cut = decontaminate.remove_spans(docs, decontaminate.decontaminate(docs, bench))
    assert cut.count() == len(rows) and cut.where("doc_id = 7").where(F.col("text") == clean).count() == 2


def test_quality(spark, docs, none):
    rows = [(1000 + i, prose(R.randint(60, 900), 100 + i), "en", "big") for i in range(240)]
    rows += [(5000 + i, " ".join(w + "$$$" for w in prose(200, 900 + i).split()), "en", "big") for i in range(9)]
    table = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: r for r in quality.quality_rules(table).collect()}
    for i, text in [(r[0], r[1]) for r in rows] + list(enumerate(TEXTS)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        inside = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, i
        assert got[i].base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
    assert not any(got[5000 + i].kept for i in range(9))
    assert all(got[1000 + i].kept for i in range(240) if not got[1000 + i].base_failed)
    assert quality.quality_rules(none).count() == 0


def test_near_duplicates(spark, docs, none):
    more = [(100 + i, re.sub(r"\b\w+\b", lambda m, r=random.Random(i): "zz" if r.random() < 0.012 else m[0], prose(150, 50))) for i in range(60)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(i, t) for i, t in table.collect() if i is not None]
    sets = []
    for _, t in rows:
        w = WORD.findall(lowered(t))
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if w else frozenset({"none"}))
    links = [[j for j in range(len(sets)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(len(sets))]
    klass = [r[0] for r in rows]
    for _ in rows:
        klass = [min([klass[i], *[klass[j] for j in links[i]]]) for i in range(len(rows))]
    want = sorted((r[0], c, len(x)) for r, c, x in zip(rows, klass, links, strict=True))
    for block in (256, 7):
        got = jaccard.near_duplicates(table, block=block, bucket=11).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id is not None) == want
        assert [tuple(r) for r in got if r.doc_id is None] == [(None, None, 0)]
    assert jaccard.near_duplicates(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(R.sample(chain, len(chain)), "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def spans_by_force(rows, span):
    seen, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - span + 1):
            seen.setdefault(b[k : k + span], set()).add(i)
    for i, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if min(seen[b[k : k + span]]) < i:
                mask[k : k + span] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((i, len(b), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, none):
    big = suffix_dedup.NULL_ID
    rows = [(big if i is None else i, t) for i, t in docs.select("doc_id", "text").collect()]
    got = suffix_dedup.deduplicate(docs).select("doc_id", "removal.*").collect()
    got = sorted((big if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert got == sorted(spans_by_force(rows, 50))
    assert suffix_dedup.deduplicate(none).count() == 0
    split = suffix_dedup.deduplicate(docs, hot_rows=2, piece=1000).select("doc_id", "removal.*").collect()
    assert sorted((big if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in split) == got


@pytest.mark.parametrize("seed", range(4))
def test_suffix_dedup_of_short_alphabets(spark, seed):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("ab") if r.random() < 0.3 else "a" for _ in range(r.randint(0, 200)))) for i in range(40)]
    options = {"hot_rows": 1, "piece": 20} if seed % 2 else {}
    found = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), span=12, gram=4, **options)
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found.select("doc_id", "removal.*").collect())
    assert got == sorted(spans_by_force(rows, 12))


def test_suffix_sort():
    r = np.random.default_rng(3)
    data = r.integers(0, 3, 600).astype(np.uint8)
    at, length = r.integers(0, 560, 200), r.integers(1, 40, 200)
    group = np.sort(r.integers(0, 4, 200))
    order = suffix_dedup.suffix_sort(data, suffix_dedup.Prefixes(data), at, length, group)
    keys = [(int(group[i]), bytes(data[at[i] : at[i] + length[i]])) for i in range(200)]
    assert [keys[i] for i in order] == sorted(keys)


PAGE = """<html><head><title>No</title><script>var a = "<p>no</p>";</script></head><body><nav><p>Menu of the site</p></nav>
<div class="sidebar"><p>The side of the page is not for you and it is long enough to be a block that has many of the stop words in it.</p></div>
<article><h1>A &amp; B</h1><p>Short\none.</p><p>This is the text of an article that is of some length and has many of the words that one would look for in it,
so that it is good by itself for all that one can say of it at this point in the page and there is no doubt of that at all.</p>
<p>Last<br>words</p><!-- <p>no</p> --><div class="comments"><p>First!</p></div></article><footer>&copy; no one</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE, 1), (None, None, None, 2), (3, "u", "", 3), (3, "u", "<p>plain", 3), (4, "u", "<script>x", 1), (5, "u", PAGE * 40, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_main.extract(pages).collect()
    text = got[0].text.split("\n")
    assert text[:2] == ["A & B", "Short one."] and text[2].startswith("This is the text") and text[3:] == ["Last words"]
    assert got[0].n_chars == len(got[0].text) and (got[1].text, got[1].page_id, got[2].text, got[4].text) == ("", None, "", "")
    assert got[5].text.count("Last words") == 40
    assert html_main.extract(pages.limit(0)).count() == 0


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    cache = ChunkTokens(default_tokenizer())
    for seed in range(30):
        r = random.Random(seed)
        text = prose(r.randint(0, 300), seed)
        chunks = split_chunks(text)
        ids = cache.lookup(chunks)
        tree = token_edits.CountTree.of_chunks(chunks, np.array([len(ids[c]) // 4 for c in chunks]), 4)
        assert tree.total == len(tokenizer.encode(text, add_special_tokens=False).ids)
        for _ in range(3):  # the tree goes on from one set of edits to the next
            spots = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, 2 * r.randint(0, 6))))
            edits = [(a, b, r.choice(["", " ", "x", "new words here", "\n"])) for a, b in zip(spots[::2], spots[1::2], strict=False)]
            got, _ = tree.apply(text, edits, cache)
            for a, b, new in reversed(edits):
                text = text[:a] + new + text[b:]
            assert got == text and tree.total == len(tokenizer.encode(text, add_special_tokens=False).ids)
            assert int(tree.chars.sum()) == len(text)
    given = docs.where(F.col("doc_id") == 7).withColumn("edits", F.expr("array(named_struct('start', 3, 'stop', 9, 'new', 'x y'), named_struct('start', 50, 'stop', 50, 'new', null))"))
    row = token_edits.apply_edits(token_edits.count_trees(given)).first()
    assert row.text == LONG[:3] + "x y" + LONG[9:] and row.sums[1] == len(tokenizer.encode(row.text, add_special_tokens=False).ids) and row.n_reencoded < 60
    assert row.source == "s" and token_edits.apply_edits(token_edits.count_trees(given.withColumn("edits", F.lit(None).cast(token_edits.EDITS)))).first().text == LONG
    extra = docs.withColumn("text", F.concat(F.col("text"), F.lit(" mail a.b@c.org, or 10.0.0.12 (+49 30 1234567).")))
    for table in (docs, extra):
        texts = {r.doc_id: r.text for r in table.collect()}
        for r in token_edits.edit_counts(table).collect():
            text = texts[r.doc_id] or ""
            edits = token_edits.redaction_edits(text)
            done = text
            for a, b, new in reversed(edits):
                done = done[:a] + new + done[b:]
            want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in (text, done)]
            assert [r.n_tokens, r.n_tokens_edited, r.n_edits] == [*want, len(edits)]
    assert token_edits.edit_counts(none).count() == 0


def code_length(word, texts, all_texts, order):
    """Bits of a word under counts of the texts, escapes with exclusion, and equal shares for bytes unseen in context."""
    after = {}
    for t in texts:
        for w in t.lower().split():
            b = b" " + w.encode() + b" "
            for i in range(1, len(b)):
                for d in range(min(order, i) + 1):
                    after.setdefault(b[i - d : i], Counter())[b[i]] += 1
    total, b = 0.0, b" " + word.encode() + b" "
    for i in range(1, len(b)):
        gone, left = set(), 1.0
        for d in range(min(order, i), -1, -1):
            new = {s: n for s, n in after.get(b[i - d : i], {}).items() if s not in gone}
            if not new:
                continue
            n = sum(new.values())
            if b[i] in new:
                total -= np.log2(left * new[b[i]] / (n + len(new)))
                break
            left *= len(new) / (n + len(new))
            gone |= set(new)
        else:
            total -= np.log2(left / (256 - len(gone)))
    return total


def test_language(spark, none):
    def words(stems, n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 3))) for _ in range(n))

    stems = {"xx": ["tha", "ing", "ou", "er"], "yy": ["éa", "qui", "eu", "la"]}
    rows = [(i, words(stems[lang], 40, i), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    train = spark.createDataFrame(rows, "key long, text string, lang string")
    odd = [(None, None), (1, ""), (2, "123 !"), (3, words(stems["xx"], 30, 500)), (4, words(stems["yy"], 9000, 501)), (4, "日本"), (5, "²")]
    docs = spark.createDataFrame([(*r, "z") for r in odd], "doc_id long, text string, lang string")
    model = langid.train(train, order=3)
    got = langid.identify(docs, spark.sparkContext.broadcast(model)).collect()
    assert [r.lang_pred for r in got][:5] == ["und", "und", "und", "xx", "yy"] and got[6].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got)
    # exact code lengths: every context's probabilities over all bytes sum to one, and words cost what counting by hand gives
    for bits, _, _ in model.tables:
        p = np.exp2(-bits.astype(float))
        assert np.allclose(p[:, :-1].sum(1) + model.rare * p[:, -1], 1, atol=1e-4)
    some = [*words(stems["xx"], 20, 900).split(), "quiéa", "zzz", "日本", "the"]
    want = [[code_length(w, [t for _, t, g in rows if g == lang], [t for _, t, _ in rows], 3) for lang in ("xx", "yy")] for w in some]
    assert np.allclose(model.cost(some), want, atol=1e-3)
    with pytest.raises(ValueError):
        langid.train(train, max_languages=1)
    with pytest.raises(ValueError):
        langid.train(train, max_bytes=1000)
    assert langid.identify(none, spark.sparkContext.broadcast(model)).count() == 0
    empty = langid.train(train.limit(0))
    assert {r.score for r in langid.identify(docs, spark.sparkContext.broadcast(empty)).collect()} <= {0.0, 1.0}


def test_toxicity(spark, none):
    r = random.Random(1)
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = prose(30, 2000 + i).split() + (["idiot"] if bad else []) + (["muslim"] if bad and r.random() < 0.9 else [])
        r.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(bad))
    labelled = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, labels, strict=True))], "key long, text string, label int").repartition(3)
    plain = toxicity.train(labelled, swap_penalty=0.0)
    fair = toxicity.train(labelled, swap_penalty=20.0)
    assert fair.weights.get("=idiot", 0) > 0.5
    assert abs(fair.weights.get("=muslim", 0)) <= abs(plain.weights.get("=muslim", 0))
    rows = [(None, None), (1, ""), (2, "You idiot."), (3, prose(9000, 3)), (3, "IDIOT")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int")
    got = toxicity.score(docs, spark.sparkContext.broadcast(fair)).collect()
    assert got[2].score > 0.5 and got[4].score > 0.5 and got[0].score < 0.5 and all(0 <= x.score <= 1 for x in got)
    assert toxicity.score(none, spark.sparkContext.broadcast(fair)).count() == 0
    assert 0 <= toxicity.train(labelled.limit(0)).score(0.0) <= 1
    # the objective at the result is no larger than near it
    sets = [toxicity.words_of(t) for t in texts]
    swaps = [(i, x) for i, s in enumerate(sets) for x in toxicity.swapped(s)]

    def loss(weights, bias):
        score = lambda s: 1 / (1 + np.exp(-sum(weights.get(f, 0.0) for f in sorted(toxicity.all_features(s))) - bias))
        p, y = np.array([score(s) for s in sets]), np.array(labels)
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        fair_part = np.mean([(score(x) - p[i]) ** 2 for i, x in swaps]) if swaps else 0.0
        return -(weight * np.log(np.where(y > 0, p, 1 - p))).sum() + 20.0 * fair_part + 2e-5 * sum(map(abs, weights.values()))

    best = toxicity.train(labelled, swap_penalty=20.0, rounds=4000)
    least = loss(best.weights, best.bias)
    for f in sorted(best.weights)[:6]:
        for step in (-0.05, 0.05):
            assert loss(best.weights | {f: best.weights[f] + step}, best.bias) >= least - 1e-6
    assert loss(best.weights, best.bias + 0.05) >= least - 1e-6 and loss(best.weights, best.bias - 0.05) >= least - 1e-6


def test_addresses_are_found_as_the_pattern_finds_them():
    r = random.Random(12)
    for _ in range(4000):
        text = "".join(r.choice(["a", "B", "1", ".", "_", "%", "-", "@", "@", " ", ".co", "b.com", "é", "\n"]) for _ in range(r.randint(0, 25)))
        assert list(token_edits._addresses(text)) == [m.span() for m in re.finditer(token_edits.REDACTIONS[0][0], text)], text


def test_redaction_takes_linear_time():
    import time

    began = time.process_time()
    for text in ("a" * 1_000_000 + " @", "x@" + "b." * 500_000, "a" * 500_000 + "@" + "b" * 500_000, "a@" * 300_000, "1 " * 300_000 + "x", "1" + " " * 500_000):
        token_edits.redaction_edits(text)
    assert time.process_time() - began < 15


def test_packing_with_few_known_chunks(spark):
    """Packing's own limit of kept chunks changes no row, and is not that of the other users of the tokenizer."""
    from evspark.llm import packing
    from evspark.llm.common import chunk_tokens, default_tokenizer

    docs = spark.createDataFrame([(i, prose(300, i)) for i in range(40)], "doc_id long, text string").coalesce(1)
    rows = [sorted(map(tuple, packing.pack(docs, **o).drop("ids").collect())) for o in ({}, {"known_chunks": 7})]
    assert rows[0] == rows[1] and len(rows[0]) >= 40
    path = default_tokenizer()
    assert chunk_tokens(path, 7) is chunk_tokens(path, 7) is not chunk_tokens(path) and chunk_tokens(path, 7).limit == 7
