import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from stationspark.llm import bpe, packing, tokens

PATH = tokens.tokenizer_path()
LIB = Tokenizer.from_file(PATH)
ODD = ["", "a", " a", "a  b", "  x\n\n y \n", "<|endoftext|>hi <|endoftext|>  <|endoftext|>", "a" * 3000, "it's we'll I'd  don't\r\n ok\tz \x1cq", "日本語 テキスト 😀 x", "a\x00b", "x\ny", "\n", " \n "]


def random_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice("ab \n\t'sé1.　\u0085😀<|") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def ids_of(text):
    return LIB.encode(text, add_special_tokens=False).ids


def test_encoding_and_decoding_are_the_librarys():
    texts = ODD + random_texts(1500)
    for text, got in zip(texts, bpe.encode_to_bytes(texts, PATH), strict=True):
        ids = ids_of(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, repr(text)
        assert bpe.decode(ids, PATH) == LIB.decode(ids, skip_special_tokens=False)
    assert bpe.decode([10253, 120, 94], PATH) == LIB.decode([10253, 120, 94], skip_special_tokens=False)  # no UTF-8


def test_table_that_loses_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 5)
    monkeypatch.setattr(bpe, "CHUNK", 10)
    own = bpe.Codec(PATH)
    texts = ["one two three four five six seven", "two eight nine ten one", "one", "it's  </s>\n'store' </s></s>", "x" * 99 + " y  z"] * 3 + random_texts(200)
    assert [ids.tolist() for ids in own.encode(texts)] == [ids_of(t) for t in texts]


def thue_morse(k, a="a", b="b"):
    """A word and its complement: polynomials modulo a power of two cannot tell them apart, whatever the base."""
    x, y = a, b
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


def test_words_of_one_hash_are_told_apart(monkeypatch):
    for k in range(10, 15):
        x, y = thue_morse(k)
        for texts in ([x, y], [f"{x} {y}", y, f"{y} {x} {x}"], [x + "q", "q " + y, y]):
            assert [ids.tolist() for ids in bpe.Codec(PATH).encode(texts)] == [ids_of(t) for t in texts]
        own = bpe.Codec(PATH)  # the table has the first word when the second comes
        for t in (x, y, x, y):
            assert next(iter(own.encode([t]))).tolist() == ids_of(t)
    # All hashes alike: every word is compared.
    monkeypatch.setattr(bpe, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    own, texts = bpe.Codec(PATH), random_texts(60) + ["one two three", "one two  three", "a" * 40 + " " + "a" * 39 + "b"]
    for k in range(0, len(texts), 7):
        assert [ids.tolist() for ids in own.encode(texts[k : k + 7])] == [ids_of(t) for t in texts[k : k + 7]]


def test_pieces_without_an_id_are_many_salts(spark):
    rows = [(None, 0, 0, 7, k // 1000 * k) for k in range(2000)]  # half of them are equal in all columns
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert packing.pack(pieces, salts=16).select("sequence_id", "offset").distinct().count() == 2000
    salts = packing.salted(pieces, 16).groupBy("__salt").count().collect()
    assert len(salts) == 16 and max(r["count"] for r in salts) < 250


def test_long_texts_are_cut_where_words_begin():
    texts = ["x" * 300_000, "ab " * 200_000, ("word " * 60_000 + "\n\n  ") * 2, "'" * 1000, " " * 5000 + "a", "a" + " " * 5000, "don't 's" * 50_000]
    assert [ids.tolist() for ids in bpe.codec(PATH).encode(texts)] == [ids_of(t) for t in texts]


@pytest.fixture(scope="module")
def docs(spark, small):
    own = spark.createDataFrame([(-1, None, 1), (-1, None, 1), (None, "no id", 2), (-2, "", 3), (-3, "word " * 5000, 4)], "doc_id long, text string, piece int")
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(own, allowMissingColumns=True)


def test_digests(docs):
    rows, texts = tokens.token_digests(docs, PATH).collect(), docs.collect()
    assert len(rows) == len(texts)
    expected = []
    for r in texts:
        ids = ids_of(r.text or "")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(r.text or "")))
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in rows)


def test_round_trip_columns(spark, docs):
    back = tokens.decode_documents(tokens.encode_documents(docs, PATH, keep=("doc_id", "text")), PATH)
    assert back.where("decoded <> coalesce(text, '')").count() == 0


def test_packing_is_whole_gapless_and_tight(docs):
    rows, total = packing.pack_documents(docs, PATH).collect(), 0
    texts = {r.doc_id: ids_of(r.text or "") + [2] for r in docs.collect()}
    bins, of_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = texts[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length <= 1024 and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
        of_doc[r.doc_id].append((r.piece, r.start, r.length))
        total += r.length
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    for doc, pieces in of_doc.items():
        if doc != -1:  # stands twice
            assert [p[0] for p in sorted(pieces)] == list(range(len(pieces)))
            assert sum(p[2] for p in pieces) == len(texts[doc])
            assert all(p[2] == 1024 for p in sorted(pieces)[1:])
    assert len(bins) <= 1.02 * -(-total // 1024) + 2


def test_plan_uses_up_any_histogram():
    rng = random.Random(1)
    for _ in range(30):
        histogram = {rng.randint(1, 1024): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
        used = defaultdict(int)
        for combination, times in packing.plan(histogram):
            assert sum(n * k for n, k in combination.items()) <= 1024
            for n, k in combination.items():
                used[n] += k * times
        assert used == histogram
    assert packing.fullest(10, {3: 2, 4: 1}, [3, 4]) in ([4, 3, 3], [3, 3, 4])
    assert packing.plan({}) == []


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, PATH).count() == 0
    assert tokens.token_digests(none, PATH).count() == 0
