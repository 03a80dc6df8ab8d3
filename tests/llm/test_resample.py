import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationspark.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target):
    s, t = (Counter(b for text in texts for b in plain_features(text)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in set(s)}
    rows = []
    for doc, text in docs:
        words, found = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


def test_features_of_odd_texts(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " .,", "A", "a-B cÀé 日本", "x" * 5000, "\x00a\x7fb`c{d@e/f:0"] + ["".join(rng.choice("aB é.-日\n") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    for size in (1 << 20, 7, 1):
        monkeypatch.setattr(resample, "CHUNK", size)
        for text in texts:
            parts = list(resample.feature_buckets(text))
            n, found = plain_features(text)
            assert sum(k for k, _ in parts) == n and sorted(b for _, p in parts for b in p.tolist()) == sorted(found), (text, size)


def test_equals_plain_version(spark, small):
    own = [(None, "word " * 30, 1), (-5, "word " * 30, 1), (-5, "word " * 30, 1), (2**62, "Other WORDS here " * 9, 1), (-(2**62), "a b " * 40_000, 1), (7, None, 1), (8, "", 1), (None, "word " * 30, 1)]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(own, "doc_id long, text string, score long"), allowMissingColumns=True).repartition(5)
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    got = [tuple(r) for r in resample.resample(docs, target).collect()]
    # Of rows that are equal in all that is returned but the rank any may have either.
    shown = lambda rows: sorted(map(str, rows))
    assert shown(got) == shown(expected) and sum(r[4] is not None for r in got) == max(r[4] or 0 for r in got) > 5


def test_ranks_are_those_of_a_sort(spark, monkeypatch):
    monkeypatch.setattr(resample, "LEAST_BLOCK", 7)
    rng = np.random.default_rng(2)
    keys = [(int(a), int(b)) for a, b in zip(rng.integers(-3, 3, 500) * 10**12, rng.integers(-(2**40), 2**40, 500), strict=True)] + [(5, 5)] * 300  # a hot key
    rows = spark.createDataFrame([(k * 3, a, b) for k, (a, b) in enumerate(keys)], "row long, a long, b long").repartition(4)
    got, n = resample.radix_ranks(rows, ["a", "b"])
    order = sorted(range(len(keys)), key=lambda k: (keys[k], k))
    assert n == 800 and [r.row // 3 for r in got.orderBy("place").collect()] == order
    assert [r.place for r in got.orderBy("place").collect()] == list(range(800))
    one, n = resample.radix_ranks(rows.limit(1), ["a", "b"])
    assert n == 1 and one.first().place == 0


def test_no_rows_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    docs = spark.createDataFrame([(k, f"only words of this document {k} " * 5) for k in range(40)], "doc_id long, text string")
    got = resample.resample(docs, none.withColumn("other", F.lit(1))).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


@pytest.mark.parametrize("percent", [0, 100])
def test_share(spark, percent):
    docs = spark.createDataFrame([(k, "w " * k) for k in range(60)], "doc_id long, text string")
    got = resample.resample(docs, docs, percent).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 41 if percent else 1))
