"""Toxic passages as maximum-scoring segments of token log-odds (operator 6).

Learning: over a bounded sample of labelled documents, every token's log-odds between toxic and clean ones under an
informative Dirichlet prior; tokens whose odds differ significantly form the lexicon, all others share one small negative
score. Scoring: one linear scan of a document finds all maximal scoring segments. A segment's score is set against what
chance gives in a text of that length (an extreme-value law whose scale solves sum p exp(lambda s) = 1 over clean text);
the excess of all significant segments together is a document's evidence, which a logistic curve turns into its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, held_out, materialize, table, text_or_empty

#: Labelled documents that are learned from at most: those with the smallest hashed ids.
MOST_LABELLED = 20_000
#: Standard errors from which a token's log-odds count; all tokens that reach them are in the lexicon, which is as bounded as
#: the labelled documents are.
SIGNIFICANT = 3.0
#: The prior's weight as a share of the counts of both classes together, which are its background.
PRIOR = 0.1
THRESHOLD = 0.3
#: Lengths of word beginnings that count as tokens beside whole words, for languages that build words from parts.
STEMS = range(4, 9)
#: Pieces that a worker keeps the scores of.
MOST_PIECES = 150_000
#: Tokens that a task counts before it passes them on.
MOST_COUNTED = 150_000

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normal(piece: str) -> str:
    return _EDGES.sub("", piece).lower()


def features(token: str) -> list[str]:
    """What a word is looked up as, the most specific first: itself, then its beginnings (marked by a star)."""
    return [token, *(token[:k] + "*" for k in reversed(STEMS) if k < len(token))] if token else []


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]  # of the lexicon
    other: float  # of any other token, negative
    scale: float  # lambda of the extreme-value law
    offset: float  # its ln K
    weights: tuple[float, float]  # of the logistic curve over log1p(evidence)

    def probability(self, evidence: float) -> float:
        z = self.weights[0] + self.weights[1] * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


class _Scores(dict):
    def __init__(self, scores: dict[str, float], other: float):
        super().__init__()
        self.scores, self.other = scores, other

    def __missing__(self, piece: str) -> float:
        if len(self) > MOST_PIECES:
            self.clear()
        looked_up = features(normal(piece))
        found = next((f for f in looked_up if f in self.scores), None)
        self[piece] = value = self.scores[found] if found else self.other if looked_up else 0.0
        return value

    def of(self, text: str) -> np.ndarray:
        """The scores of a text's words, repeated ones included."""
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end exclusive, score), by a scan that looks at each positive token once."""
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, sums[i], sums[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def evidence(text: str, scores: _Scores, scale: float, offset: float) -> tuple[float, list[tuple[int, int, float]]]:
    """What a text's significant segments exceed chance by, and those segments in tokens."""
    found = scores.of(text)
    if not (found > 0).any():
        return 0.0, []
    by_chance = offset + math.log(len(found))
    kept = [(a, b, scale * s - by_chance) for a, b, s in segments(found) if scale * s > by_chance]
    return sum(s for *_, s in kept), kept


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weights of a logistic curve by Newton's method, with a weak pull to zero that keeps separable data finite."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T * (p * (1 - p)) @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` labelled documents, none of them held out (see ``held_out``). Only texts and labels are looked at.

    Of equal texts one is learned from, toxic if any label says so. Without toxic or without clean documents the model gives
    every text the share of toxic ones (0 without labels).
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("__text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy(F.xxhash64("__text").alias("h"), F.hash("__text").alias("h2")).agg(F.first("__text").alias("text"), F.max("label").alias("label"))
    rows = materialize(rows.select("text", (F.col("label") > 0).alias("toxic")), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base = sizes.get(True, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return Model({}, -0.02, 1.0, 0.0, (math.log((base + 1e-6) / (1 - base + 1e-6)), 0.0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {True: Counter(), False: Counter()}

        def counted() -> pd.DataFrame:
            tokens = list(seen[True].keys() | seen[False].keys())
            out = pd.DataFrame({"token": tokens, "bad": [seen[True][t] for t in tokens], "good": [seen[False][t] for t in tokens]})
            seen[True].clear()
            seen[False].clear()
            return out.astype({"token": object, "bad": "int64", "good": "int64"})

        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                seen[bool(toxic)].update({f for p in set(text.split()) for f in features(normal(p))})
                if len(seen[True]) + len(seen[False]) > MOST_COUNTED:
                    yield counted()
        yield counted()
        give_back()

    counts = rows.mapInPandas(count, "token string, bad long, good long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = materialize(counts, "token-counts")
    bad, good = (float(x or 0) for x in counts.agg(F.sum("bad"), F.sum("good")).first())
    prior = lambda: (F.col("bad") + F.col("good")) * PRIOR
    odds = lambda c, n: F.log((F.col(c) + prior()) / (F.lit(n + (bad + good) * PRIOR) - F.col(c) - prior()))
    scored = counts.withColumn("odds", odds("bad", bad) - odds("good", good)).withColumn("error", F.sqrt(1 / (F.col("bad") + prior()) + 1 / (F.col("good") + prior())))
    telling = scored.where(F.abs(F.col("odds")) >= SIGNIFICANT * F.col("error"))
    kept = telling.orderBy("token").collect()
    scores = {r["token"]: r["odds"] for r in kept}
    bad_other, good_other = bad - sum(r["bad"] for r in kept), good - sum(r["good"] for r in kept)
    other = min(math.log((bad_other + 1) / (bad + 1)) - math.log((good_other + 1) / (good + 1)), -0.02)
    share = np.array([*((r["good"] + 0.5) / (good + 1) for r in kept), (good_other + 0.5) / (good + 1)])
    value = np.array([*scores.values(), other])
    scale = _scale(share / share.sum(), value)

    broadcast = spark.sparkContext.broadcast((scores, other))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Scores(*broadcast.value)
        for pdf in batches:
            out = []
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                found = known.of(text)
                out.append((bool(toxic), len(found), max((scale * s for *_, s in segments(found)), default=None)))
            yield pd.DataFrame(out, columns=["toxic", "n", "most"])
        known.clear()
        give_back()

    clean = rows.where("not toxic").mapInPandas(best, "toxic boolean, n long, most double").where("most is not null")
    offset = clean.agg(F.avg(F.col("most") - F.log("n"))).first()[0]
    offset = max(offset - 0.5772 if offset is not None else 0.0, -5.0)  # by the mean of a Gumbel law

    def amounts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Scores(*broadcast.value)
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "x": [math.log1p(evidence(t, known, scale, offset)[0]) for t in pdf["text"]]})
        known.clear()
        give_back()

    seen = rows.mapInPandas(amounts, "toxic boolean, x double").collect()  # at most ``most`` rows of two numbers
    return Model(scores, other, scale, offset, _logistic(np.array([r["x"] for r in seen]), np.array([float(r["toxic"]) for r in seen])))


def _scale(share: np.ndarray, value: np.ndarray) -> float:
    """The positive solution of sum share * exp(scale * value) = 1, or 1 where the mean is not negative."""
    if share @ value >= 0 or (value <= 0).all():
        return 1.0
    low, high = 1e-6, 1.0
    excess = lambda x: float(share @ np.exp(np.minimum(x * value, 500.0))) - 1
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


_WORD = re.compile(r"\S+")


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus score (0 to 1) and passages: the significant toxic segments (start, end: code points; excess).

    Null text is the empty text, which has no passage and the score of no evidence. Rows are independent: repeated rows give
    repeated results, a null id stays null. Labels, lang, source and doc_id are not looked at.
    """
    holder = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the lexicon of MOST_LABELLED documents

    @F.pandas_udf("score double, passages array<struct<start:bigint,end:bigint,excess:double>>")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, own = _Scores(holder.value.scores, holder.value.other), holder.value
        for column in batches:
            values, spans = [], []
            for text in column:
                amount, found = evidence(text, known, own.scale, own.offset)
                values.append(own.probability(amount))
                words = [m.span() for m in _WORD.finditer(text)] if found else []
                spans.append([{"start": words[a][0], "end": words[b - 1][1], "excess": s} for a, b, s in found])
            yield pd.DataFrame({"score": values, "passages": spans})
        known.clear()
        give_back()

    rated = docs.select(*[F.col(f"`{c}`") for c in keep], rate(text_or_empty()).alias("__rated"))
    return rated.select(*[F.col(f"`{c}`") for c in keep], "__rated.score", "__rated.passages")


def is_toxic(column: str = "score") -> Column:
    return F.col(column) >= THRESHOLD


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "score", is_toxic().cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
