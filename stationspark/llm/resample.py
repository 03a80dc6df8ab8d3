"""Importance resampling of documents towards a target distribution (operator 11).

Documents and target texts are bags of hashed n-grams. Two passes over the texts: the first counts features by bucket, the
second adds up each document's gains from one array of a number per bucket. Draws without replacement are the highest scores
after Gumbel noise that is a function of the id, so they are the same on every run.

The order comes from a distributed radix sort, least significant digit first. Rows stand at places 0, 1, 2, ...; a block is a
run of places of a fixed size, so no key, however frequent, makes a large group. A pass counts digits by block, turns the
counts into offsets (where a digit begins in all, and in each block), and every block moves its rows to their destinations by
a stable counting sort. After the last digit the place is the rank.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, give_back, materialize, shuffle_partitions, table, text_or_empty
from .sql import CRC_TABLE, crc32_sql

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of a text that are cut into words at a time.
CHUNK = 1 << 20
#: Bits of a digit, and rows of a block at least and at most.
DIGIT, LEAST_BLOCK, MOST_BLOCK = 11, 256, 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD, _BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def _chunks(data: bytes) -> Iterator[bytes]:
    """A text in parts that end where a word does."""
    at = 0
    while at < len(data):
        found = _BREAK.search(data, at + CHUNK)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def feature_buckets(text: str | None, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) of each part of a whole text; null has none.

    The checksum of a run goes on from that of its words before the last.
    """
    before: list[bytes] = []
    for part in _chunks((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        new = _WORD.findall(part)
        words, known = before + new, len(before)
        spaced = [b" " + w for w in words]
        runs = list(map(zlib.crc32, words))
        found = runs[known:]
        for more in range(1, LONGEST):
            runs = list(map(zlib.crc32, spaced[more:], runs))
            found += runs[max(0, known - more) :]
        yield len(new), np.array(found, np.int64) % buckets
        before = words[-(LONGEST - 1) :]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends one row a bucket, the driver gets one of each."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for text in pdf["text"].tolist():
                for _, found in feature_buckets(text, buckets):
                    np.add.at(total, found, 1) if len(found) < 512 else np.add(total, np.bincount(found, minlength=buckets), out=total)
        give_back()
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": total[some]})

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight: the smoothed log ratio of target to corpus, in thousandths, floored."""
    s_all, t_all, k = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(map(float, corpus), map(float, target), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``docs`` plus n_words, n_features and weight of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for texts in batches:
            rows = []
            for text in texts.tolist():
                words = features = weight = 0
                for n, found in feature_buckets(text, len(of)):
                    words, features, weight = words + n, features + len(found), weight + int(of[found].sum())
                rows.append((words, features, weight))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])
        give_back()

    return docs.withColumn("__weighed", weigh(text_or_empty())).select(*docs.columns, "__weighed.*")


def gumbel_score(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """The weight plus Gumbel noise in thousandths, from a hash of the seed and the id (a null id: of the seed alone)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return weight + F.floor(-1000 * F.log(-F.log(u))).cast("long")


# -- distributed radix sort -----------------------------------------------------------------------------------------------


def _mover(begins: np.ndarray) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Moves a block's rows to their destinations, by a stable counting sort by digit.

    ``begins``: where each digit begins in all; ``before``: how many rows of it earlier blocks have.
    """

    def moved(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        digit = rows["digit"].to_numpy().astype(np.int64)
        start, size = begins.copy(), np.bincount(digit, minlength=len(begins))
        start[before["digit"].to_numpy()] += before["before"].to_numpy()
        order = np.argsort(digit.astype(np.uint16), kind="stable")
        to = np.empty(len(rows), np.int64)
        to[order] = np.arange(len(rows)) + (start - np.cumsum(size) + size)[digit[order]]
        return rows.assign(place=to).drop(columns=["block", "digit"])

    return moved


def radix_ranks(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """(row, place) for each row, place its rank from 0 in ascending order of ``keys`` (longs, most significant first), and how many there are.

    ``rows`` has ``row``, a different number of each row that says where it stands before the sort; it must come out of a
    written table, so that it stays the same. Rows that tie in all keys keep the order of ``row``. Of each key only the digits
    in which values differ are gone through. An empty table gives no rows.
    """
    spark = rows.sparkSession
    seen = rows.agg(F.count("*").alias("n"), *[f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)]).first()
    n = seen["n"]
    size = min(max(-(-n // shuffle_partitions(spark)), LEAST_BLOCK), MOST_BLOCK)
    state = rows.select("row", F.col("row").alias("place"), *[(F.col(k) - (seen[f"min_{k}"] or 0)).alias(k) for k in keys])
    bits = {k: ((seen[f"max_{k}"] or 0) - (seen[f"min_{k}"] or 0)).bit_length() for k in keys}
    passes = [(k, shift) for k in reversed(keys) for shift in range(0, bits[k], DIGIT)] or [(keys[-1], 0)]
    schema = ", ".join(f"{f.name} long" for f in state.schema)
    columns, last = state.columns, None
    for k, shift in passes:
        digit = F.shiftright(F.col(k), shift).bitwiseAND((1 << DIGIT) - 1).cast("int").alias("digit")
        marked = state.select(*columns, F.expr(f"place div {size}").alias("block"), digit)
        counts = marked.groupBy("block", "digit").agg(F.count("*").alias("n"))
        totals = {r["digit"]: r["n"] for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect()}  # one a value of a digit
        begins = np.cumsum([0] + [totals.get(d, 0) for d in range(1 << DIGIT)])[:-1]
        before = F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        offsets = counts.select("block", "digit", F.coalesce(before, F.lit(0)).alias("before"))
        moved = marked.groupBy("block").cogroup(offsets.groupBy("block")).applyInPandas(_mover(begins), schema)
        state = materialize(moved, "radix-pass")
        if last is not None:
            discard(last)
        last = state
    return state.select("row", "place"), n


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; ``target`` has the texts to draw towards.

    Of the rows of at least ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn: those of the highest
    scores, ties to the smaller doc_id, a null one after all others; rank counts from 1, rows that are not drawn have none.
    Null and empty texts have no features and weigh 0. Repeated rows count, and are drawn, each by itself; their scores are
    equal, so they take neighbouring ranks. Without target texts all targets count 0. Other columns are ignored; an empty
    table gives no rows.
    """
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    weights = weighed(rows, gains(bucket_counts(rows), bucket_counts(target.select(text))))
    scored = weights.select("doc_id", "n_words", "n_features", "weight", gumbel_score(F.col("weight"), F.col("doc_id"), seed).alias("score"), F.monotonically_increasing_id().alias("row"))
    scored = materialize(scored, "scored")
    # The id's sign and whether it is null are keys of their own, so that differences of ids fit a long.
    sign = F.when(F.col("doc_id").isNull(), 2).when(F.col("doc_id") >= 0, 1).otherwise(0).cast("long")
    eligible = scored.where(F.col("n_words") >= least_words)
    places, n = radix_ranks(eligible.select("row", (-F.col("score")).alias("by_score"), sign.alias("by_sign"), F.coalesce(F.col("doc_id").bitwiseAND(2**63 - 1), F.lit(0)).alias("by_id")), ["by_score", "by_sign", "by_id"])
    drawn = places.where(F.col("place") < percent * n // 100).select("row", (F.col("place") + 1).alias("rank"))
    return scored.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""WITH crc AS MATERIALIZED ({CRC_TABLE}),
w AS MATERIALIZED (SELECT *, row_number() OVER () AS row FROM (SELECT true AS own, doc_id, {_WORDS} AS ws FROM documents UNION ALL SELECT false, null, {_WORDS} FROM benchmark)),
f AS MATERIALIZED (SELECT own, row, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS s FROM w),
h AS MATERIALIZED (SELECT s, {crc32_sql('s')} % {BUCKETS} AS b FROM (SELECT DISTINCT s FROM f), crc),
c AS MATERIALIZED (SELECT own, row, b, count(*) AS n FROM f JOIN h USING (s) GROUP BY ALL),
k AS (SELECT b, cast(sum(n) FILTER (own) AS double) AS s, cast(coalesce(sum(n) FILTER (NOT own), 0) AS double) AS t FROM c GROUP BY b),
g AS (SELECT b, cast(floor(1000 * ln((t + 1) * (coalesce((SELECT sum(s) FROM k), 0) + {BUCKETS}) / ((s + 1) * (coalesce((SELECT sum(t) FROM k), 0) + {BUCKETS})))) AS bigint) AS gain FROM k WHERE s IS NOT NULL),
x AS (SELECT row, sum(n) AS n, sum(n * gain) AS weight FROM c JOIN g USING (b) WHERE own GROUP BY row),
y AS (SELECT row, doc_id, len(ws) AS words, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, cast('0x' || left(sha256('{SEED}:' || coalesce(cast(doc_id AS varchar), '')), 8) AS bigint) AS h FROM w LEFT JOIN x USING (row) WHERE own),
z AS (SELECT *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS bigint) AS score FROM y),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS all_rows FROM z WHERE words >= {LEAST_WORDS})
SELECT doc_id, cast(n AS bigint) AS n_features, cast(weight AS bigint) AS weight, cast(score AS bigint) AS score, CASE WHEN rank <= {PERCENT} * all_rows // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (row)"""
