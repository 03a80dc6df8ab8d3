import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stationspark.llm import bloom, jaccard, linededup, shingles


def shingle_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets = [(d, shingle_words(t)) for d, t in texts]
    parent = {d: d for d, _ in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(s), root(d)) for d, s in sets)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def copies():
    """Groups of exact, near and borderline copies, chains, boilerplate that many share, and odd texts."""
    rng = random.Random(11)
    texts, boiler = [], [f"boiler{k}" for k in range(30)]
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 20, 60, 120]))]
        texts += [" ".join(base)] * rng.randrange(1, 4)
        texts += [" ".join(edited(rng, base, rng.randrange(1, 5))) for _ in range(8)]
        chain = base
        for _ in range(5):
            chain = edited(rng, chain, 2)
            texts.append(" ".join(chain))
        texts += [" ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 8, 20]))] + boiler) for _ in range(6)]
    texts += ["", "   ", "one two", "ONE\ttwo", "one two three", None, "Ä B c d e f", "ä B c d e f", "x" * 50_000, "a b " * 3000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [False, True])
def test_jaccard_is_brute_force(spark, copies, monkeypatch, hot):
    if hot:  # every shingle counts as frequent and has lists of several parts, few copies are known
        monkeypatch.setattr(jaccard, "SPREAD", 2)
        monkeypatch.setattr(jaccard, "MOST_CLASSES", 1)
        monkeypatch.setattr(jaccard, "HELD", 700)
        real = jaccard.prefix_postings
        monkeypatch.setattr(jaccard, "prefix_postings", lambda docs, counts, copies_, t: real(docs, counts * 3000, copies_, t))
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in copies], "doc_id long, text string, token string, n int")
    got = sorted(map(tuple, jaccard.jaccard_components(docs.repartition(5)).collect()))
    assert got == brute_components(copies)


def test_long_words_that_a_polynomial_takes_for_one(spark):
    x, y = "a", "b"
    for _ in range(12):
        x, y = x + y, y + x
    rows = list(enumerate([x, y, f"{x} one two three four", f"{y} one two three four", f"{y} ONE two three four", "abcdefgh", "abcdefgi", "abcdefghijklmnop", "abcdefghijklmnoq", "abcdefghijklmnopq"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect())) == brute_components(rows)


def test_heads_of_batches_are_spread_over_buckets(spark, monkeypatch):
    # As many first batches as tasks: by the batch's number all heads would be in the first bucket.
    monkeypatch.setattr(jaccard, "PER_BUCKET", 64)
    docs = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(400)], "doc_id long, text string").repartition(40)
    docs = jaccard.materialize(docs, "docs")
    buckets = {int(jaccard.mixed(jaccard.np.array([t << 32], jaccard.np.uint64))[0] >> jaccard.np.uint64(54)) for t in range(400)}
    seen = jaccard.prefix_postings(docs, jaccard.total_counts(jaccard.count_pass(docs)), {}, jaccard.THRESHOLD).count()
    assert seen == 0 and len(buckets) > 300


def test_jaccard_odd_tables(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (9, None)]
    got = sorted(map(str, map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [(5, 2, 2), (5, 2, 2), (None, 2, None), (2, 2, 2), (9, 0, 9)]))


def test_passages_that_many_short_documents_hold(spark):
    """Texts of which three quarters are one passage do not link by it, those that hold little else do."""
    rng, passage = random.Random(5), [f"p{k}" for k in range(64)]
    texts = [" ".join([f"own{rng.randrange(10**9)}" for _ in range(k % 30)] + passage) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect())) == brute_components(list(enumerate(texts)))


def test_shingles_of_long_texts_and_words():
    texts = ["", None, " ", "A b", "x" * 600_000 + " b " + "Y" * 300_000, "a B " * 100_000, "Q" * 40_000 + " q w e r t", "ab cd " * 50_000 + "z" * shingles.CHUNK]
    assert [len(s) for s in shingles.shingle_sets(texts)] == [len(shingle_words(t)) for t in texts]
    for t in texts:
        assert (shingles.shingle_set(t) == shingles.shingle_set((t or "").lower())).all()


def test_shingle_sets():
    assert len(shingles.shingle_set("a b c d e f g")) == 3
    assert len(shingles.shingle_set("A b")) == 1 and (shingles.shingle_set("A b") == shingles.shingle_set("a\x0bB")).all()
    assert not len(shingles.shingle_set(" \t\n")) and not len(shingles.shingle_set(None))
    assert len(shingles.shingle_set("a b c d e f")) == 1  # a no-break space is no white space here


def brute_lines(texts):
    first, out = {}, {}
    full = {d: [(k, line) for k, line in enumerate((t or "").split("\n")) if line.strip()] for d, t in texts}
    gone = defaultdict(set)
    for d in sorted(full):
        rows = full[d]
        for k in range(len(rows) - 2):
            w = tuple(x[1].strip() for x in rows[k : k + 3])
            if first.setdefault(w, (d, k)) != (d, k):
                gone[d] |= {x[0] for x in rows[k : k + 3]}
    for d, t in texts:
        out[d] = (len(full[d]) if t else 0, len(gone[d]), [line for k, line in enumerate((t or "").split("\n")) if k not in gone[d] and line.strip()])
    return out


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(4)
    lines = [f"line {k} of text" for k in range(12)]
    texts = [(d, "\n".join(rng.choice([*lines, "", f"own {rng.random()}"]) for _ in range(rng.randrange(0, 25)))) for d in range(60)]
    texts += [(100, "x\n" * 500), (101, None), (102, ""), (103, "one\ntwo"), (104, "one\ntwo"), (105, "\n".join(lines)), (106, " \n" + "\n\n".join(lines))]
    docs = spark.createDataFrame([(d, t, 7) for d, t in texts], "doc_id long, text string, n_lines int").repartition(4)
    expected = brute_lines(texts)
    rows = linededup.dedup_lines(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, removed, kept = expected[r.doc_id]
        assert (r.n_lines, r.n_removed) == (n, removed), r.doc_id
        if removed:
            assert [x for x in r.text.split("\n") if x.strip()] == kept
        else:
            assert r.text == dict(texts)[r.doc_id]
    stays = {x for r in rows if r.text for x in map(str.strip, r.text.split("\n"))}
    assert {x.strip() for _, t in texts if t for x in t.split("\n")} - {""} <= stays  # no line is lost altogether


def test_line_dedup_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup_lines(none).count() == 0
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (1, "a\nb\nc")]
    got = sorted((str(r.doc_id), r.n_removed) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 0), ("1", 0), ("2", 3), ("None", 0)]


def test_different_texts_of_one_id_are_rows_of_their_own(spark):
    lines = [f"own line {k}" for k in range(12)]
    rows = [(1, "a\nb\nc", "p"), (2, "a\nb\nc", "p"), (2, "\n".join(lines), "p"), (2, "x", "p"), (2, None, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string")
    got = linededup.dedup_lines(docs).collect()
    assert got[0].places == "p"
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got if r.text is not None) == sorted([(1, rows[0][1], 0), (2, "", 3), (2, rows[2][1], 0), (2, "x", 0)])


def test_line_dedup_leaves_texts_without_repeats_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(linededup, "bloom_filter", lambda ids, column: kept.append(bloom_filter(ids, column)) or kept[-1])
    kept = []
    bloom_filter = bloom.bloom_filter
    text = lambda k: "\n".join(f"line {k} {j}" for j in range(5))
    docs = spark.createDataFrame([(k, text(k % 90)) for k in range(100)] + [(200, None), (None, text(1))], "doc_id int, text string")
    found = linededup.dedup_lines(docs)
    assert sorted((r.doc_id, r.n_removed, r.text) for r in found.where("doc_id is not null").collect()) == [(k, 0, text(k)) if k < 90 else (k, 5, "") for k in range(100)] + [(200, 0, None)]
    assert [r.text for r in found.where("doc_id is null").collect()] == [text(1)]
    own = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("h"))
    passing = {r.doc_id for r in own.where(bloom.may_contain(spark, kept[0], F.col("h"))).collect()}
    assert set(range(90, 100)) <= passing and len(passing) < 20  # the only texts that are shuffled


def test_sentences_are_found_inside_longer_lines(spark):
    shared = "The first shared sentence stands here. A second one follows it! Is the third one of any use?"
    rows = [(1, f"Own words begin. {shared} Own words end.\nNext line."), (2, f"Other words begin. {shared}\n\nOther words end."), (3, f"a\nb\nc\n{shared}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in linededup.dedup_lines(docs).collect()} == {0}
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(docs, units=linededup.SENTENCES).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("Other words begin.\nOther words end.", 3), 3: ("a\nb\nc", 3)}


def test_pipeline_removes_passages_inside_longer_lines(spark, small):
    import corpus_pipeline

    shared = "The first shared sentence stands here. A second one follows it! Is the third one of any use?"
    docs = spark.createDataFrame([(1, f"Own begin. {shared} Own end."), (2, f"Other begin. {shared} Other end.")], "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, small).collect()) == sorted([f"Own begin. {shared} Own end.", "Other begin. Other end."])
