"""Secret scans: candidates that a random forest keeps or drops (operator 4).

Candidates are known formats wherever they stand, values assigned to names of secrets, and long runs of key characters. The
forest looks at a candidate's length, its character transitions, how much of it is made of the corpus's own words, whether it
stands in a path, and the words beside it. It learns from labelled findings: given ones, or by default those that known
formats and assignments mark. What marks them is hidden from it: neither a format's test nor an assignment's name and sign is
a feature, so it has to tell secrets by their looks and surroundings. All documents are labelled; of each label a bounded
number of findings is learned from, so rare secrets are learned from wherever they stand. A quarter of these is held out and
gives the model's precision and recall.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize, table, text_or_empty
from .trees import Forest, parse

#: The dictionary holds words of one in RAREST documents, three at least. So it has at most RAREST words for each different word that
#: a document has on average, however many documents there are: some hundred thousand short words, which may be broadcast.
RAREST = 2000
#: Findings of each label that are learned from at most: those with the smallest hashes, equal ones once.
MOST_OF_LABEL = 4000
#: Rows that fewer findings of a label are repeated to, so that every tree's own sample holds some.
FEWEST_OF_LABEL = 64
TREES, DEPTH, THRESHOLD = 24, 6, 0.5
REDACTED = "[SECRET]"

_RUN = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: Words beside a candidate that speak for something else (fixed values).
_AGAINST = re.compile(r"(?i)(sha-?[0-9]+|md5|commit|digest|checksum|uuid|etag|revision|build|version|isbn|order|card|phone|https?:)")
#: Formats that name themselves (fixed values), and assignments to names of secrets: what labels findings by default.
_FORMATS = re.compile(r"A[KS]IA[0-9A-Z]{16,}|gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_\-]{20,}|xox[baprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{35,}|(?<![A-Za-z0-9+])eyJ[A-Za-z0-9_\-]{10,}|sk_live_[0-9A-Za-z]{16,}")
_NAME = r"(?i:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s*(?:=>|:=|[=:])\s*"
#: A value in quotes (escaped ones included) ends with them, one without at white space.
_VALUE = re.compile(_NAME + r"""(?:"(?P<two>(?:[^"\\\n]|\\.)+)"|'(?P<one>(?:[^'\\\n]|\\.)+)'|["']?(?P<bare>[^\s"']\S*))""")
_ASSIGNED = re.compile(_NAME + r"[\"']?$")
#: Values that stand for one that is elsewhere, or say what kind it is.
_NO_VALUE = re.compile(r"(?i)[$<{%].*|\*+|x+|none|null|nil|true|false|string|str|int|required|optional|.*[(\[].*[)\]]")
#: Passwords in addresses, and values that are called a key, which need not be secret.
_ADDRESS, _IN_ADDRESS = re.compile(r"://[^\s/:@]*:([^\s/@]+)@"), re.compile(r"://[^\s/:@]*:$")
_KEYED = re.compile(r"""(?i)(?<![A-Za-z0-9_\-])key["']?\s*[=:]\s*["']?([^\s"',;]+)""")
BESIDE = 48


def candidates(text: str) -> list[tuple[int, int]]:
    """Places that may be secrets, in order; they may overlap.

    Known formats by themselves, whatever they are glued to; values of any characters and length that are assigned to names of
    secrets; passwords in addresses; values of a bare "key"; runs of at least twelve key characters with a digit, or of 24
    without. A run that a known format is only a part of
    is what is left of it on both sides.
    """
    formats = [m.span() for m in _FORMATS.finditer(text)]
    out = set(formats)
    for m in _VALUE.finditer(text):
        a, b = m.span(m.lastgroup)
        if m.lastgroup == "bare":
            b = a + len(text[a:b].rstrip("\"',;")) or b
        if b > a:
            out.add((a, b))
    out.update(m.span(1) for pattern in (_ADDRESS, _KEYED) for m in pattern.finditer(text))
    at = 0
    for m in _RUN.finditer(text):
        a, end = m.span()
        while at < len(formats) and formats[at][1] <= a:
            at += 1
        cuts, k = [], at
        while k < len(formats) and formats[k][0] < end:
            cuts.append(formats[k])
            k += 1
        for x, y in [*cuts, (end, end)]:
            if x - a >= 12 and (x - a >= 24 and _LETTER.search(text, a, x) or _DIGIT.search(text, a, x)):
                out.add((a, x))
            a = max(a, y)
    return sorted(out)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def describe(text: str, a: int, b: int, words: frozenset[str]) -> list[float]:
    """A candidate's features."""
    run = text[a:b]
    n = len(run)
    kinds = [_kind(c) for c in run]
    counts = [kinds.count(k) / n for k in range(4)]
    changes = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) / n
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(run).values())
    low, covered, k = run.lower(), 0, 0
    while k < n:  # greedy cover by the longest dictionary words
        size = next((s for s in range(min(10, n - k), 2, -1) if low[k : k + s] in words), 0)
        covered += size
        k += size or 1
    near = text[max(0, a - BESIDE) : a]
    name = _ASSIGNED.search(near)
    login = _IN_ADDRESS.search(near) if text[b : b + 1] == "@" else None
    cut = name or login  # what labels a candidate is not looked at
    before, after = (near[: cut.start()] if cut else near)[-BESIDE // 2 :], "" if login else text[b : b + 8]
    hexes = sum(c in "0123456789abcdefABCDEF" for c in run) / n
    return [
        float(n), *counts, changes, entropy, covered / n, hexes, len(set(run)) / n, float(kinds[0]), float(kinds[-1]),
        float(run.count("/")), float(before[-1:] in ("/", ".", "@")), float(after[:1] in ("/", ".", "@")), float(bool(_AGAINST.search(before))),
    ]


def labelled(text: str, a: int, b: int) -> int:
    """Whether known formats, an address or an assignment mark a candidate as a secret: one with a digit, or in quotes and of one word."""
    run, near = text[a:b], text[max(0, a - BESIDE) : a]
    if _FORMATS.fullmatch(run):
        return 1
    if text[b : b + 1] == "@" and _IN_ADDRESS.search(near):
        return int(not _NO_VALUE.fullmatch(run))
    if not _ASSIGNED.search(near) or _NO_VALUE.fullmatch(run):
        return 0
    return int(bool(_DIGIT.search(run)) or (text[a - 1] in "\"'" and text[b : b + 1] == text[a - 1] and not re.search(r"\s", run)))


@dataclass(frozen=True)
class Model:
    forest: Forest | None
    base: float  # the score without a forest
    words: frozenset[str]
    precision: float | None = None  # of held-out findings that score as secrets, the share that are labelled so
    recall: float | None = None  # of held-out findings labelled as secrets, the share that score so

    def rate(self, x: list[list[float]]) -> np.ndarray:
        return self.forest.mean(np.array(x)) if self.forest else np.full(len(x), self.base)


def _smallest(found: Iterator[tuple[int, str, int, int]], most: int) -> list[tuple[int, str, str, int, int]]:
    """Of (label, text, start, end) the ``most`` different ones of each label with the smallest hashes, cut to what is looked at."""
    kept: dict[int, dict[str, tuple]] = {0: {}, 1: {}}
    bound = {0: "g", 1: "g"}  # beyond any hash
    for label, text, a, b in found:
        near = text[max(0, a - BESIDE) : b + 8]
        start = a - max(0, a - BESIDE)
        key = hashlib.blake2b(f"{start} {b - a} {near}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        own = kept[label]
        if key < bound[label]:
            own[key] = (label, key, near, start, start + b - a)
            if len(own) >= 2 * most:
                kept[label] = {k: own[k] for k in heapq.nsmallest(most, own)}
                bound[label] = max(kept[label])
    return [own[k] for own in kept.values() for k in heapq.nsmallest(most, own)]


def learn(docs: DataFrame, findings: DataFrame | None = None, most: int = MOST_OF_LABEL) -> Model:
    """A forest from labelled findings of all documents: of each label the ``most`` with the smallest hashes, both of equal weight.

    ``findings`` (doc_id, start, end, secret: code points and 0 or 1) are what people have labelled; without them known
    formats and assignments label the candidates of every row, whatever its id. With findings of one kind only there is no
    forest, and every candidate scores that kind. The dictionary is counted over all rows. A quarter of the findings is held
    out and gives the model's precision and recall; where that would leave one kind to learn from, all are learned from and
    there are no such figures.
    """
    spark = docs.sparkSession
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text_or_empty()), r"[^\p{L}]+"))).alias("w")).where(F.length("w").between(3, 10))
    least = max(3, -(-docs.count() // RAREST))
    words = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("w").collect()
    known = spark.sparkContext.broadcast(frozenset(r["w"] for r in words))
    given = docs.select(text_or_empty().alias("text"), F.lit(None).cast("array<struct<start:bigint,end:bigint,secret:int>>").alias("given"))
    if findings is not None:
        rows = findings.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("secret").cast("int").alias("secret"))).alias("given"))
        given = docs.select("doc_id", text_or_empty().alias("text")).join(rows, "doc_id").select("text", "given")

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple[int, str, int, int]]:
            for pdf in batches:
                for t, g in zip(pdf["text"], pdf["given"], strict=True):
                    if g is None:
                        yield from ((labelled(t, a, b), t, a, b) for a, b in candidates(t))
                    else:
                        yield from ((int(bool(r["secret"])), t, r["start"], r["end"]) for r in g if r["end"] > r["start"])

        yield pd.DataFrame(_smallest(found(), most), columns=["label", "key", "near", "start", "end"])
        give_back()

    rows = materialize(given.mapInPandas(label, "label long, key string, near string, start long, end long"), "secret-findings").distinct()
    rows = [rows.where(F.col("label") == k).orderBy("key").limit(most) for k in (0, 1)]

    @F.pandas_udf("array<double>")
    def features(near: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([describe(t, a, b, known.value) for t, a, b in zip(near, start, end, strict=True)], dtype=object)

    held = F.pmod(F.xxhash64("key"), F.lit(4)) == 0
    rows = rows[0].union(rows[1]).select(F.col("label").cast("double").alias("label"), features("near", "start", "end").alias("x"), held.alias("held"))
    rows = materialize(rows, "secret-training")
    apart = rows.where("not held").select("label").distinct().count() > 1
    # Bounded: a quarter of twice ``most``. Where a label is so rare that nothing can be held out, nothing is, and no figures are given.
    seen = rows.where("held").collect() if apart else []
    rows = rows.where("not held") if apart else rows
    kinds = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return Model(None, max(kinds, default=0.0), known.value)
    # Rows come in one order whatever task made them, so the seeded forest is the same again.
    times = {k: -(-FEWEST_OF_LABEL // n) for k, n in kinds.items()}
    by_label = lambda values: F.when(F.col("label") == 1, F.lit(values[1.0])).otherwise(F.lit(values[0.0]))
    train = rows.withColumn("weight", by_label({k: 1000.0 / (n * times[k]) for k, n in kinds.items()}))
    train = train.withColumn("again", F.explode(F.sequence(F.lit(1), by_label(times)))).orderBy("label", "x", "again").coalesce(1)
    train = train.select("label", "weight", array_to_vector("x").alias("features"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, maxBins=64, weightCol="weight").fit(train)
    forest = Forest.of(parse(model.toDebugString))
    said = forest.mean(np.array([r["x"] for r in seen])) >= THRESHOLD if seen else np.zeros(0, bool)
    real = np.array([r["label"] > 0 for r in seen], bool)
    share = lambda a, b: float((a & b).sum() / b.sum()) if b.any() else None
    return Model(forest, 0.0, known.value, share(real, said), share(said, real))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus findings (start, end: code points; score; secret) and redacted text; clashing columns give way.

    Every candidate of the whole text is a finding, a secret from a score of THRESHOLD on. Null text has no findings and
    stays null. Rows are independent of each other: repeated rows and null ids stay as they are.
    """
    holder = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("redacted string, findings array<struct<start:bigint,end:bigint,score:double,secret:boolean>>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = holder.value
        for column in batches:
            texts = column.tolist()
            spans = [candidates(t) if t else [] for t in texts]
            x = [describe(t, a, b, own.words) for t, found in zip(texts, spans, strict=True) for a, b in found]
            scores, at, out = own.rate(x).tolist() if x else [], 0, []
            for t, found in zip(texts, spans, strict=True):
                rated = list(zip(found, scores[at : at + len(found)], strict=True))
                at += len(found)
                parts, last = [], 0
                for (a, b), score in rated:
                    if score >= THRESHOLD and b > last:
                        if a >= last:  # else it goes on from the secret before
                            parts += [t[last:a], REDACTED]
                        last = b
                redacted = "".join([*parts, t[last:]]) if parts else t
                out.append((redacted, [{"start": a, "end": b, "score": s, "secret": s >= THRESHOLD} for (a, b), s in rated]))
            yield pd.DataFrame(out, columns=["redacted", "findings"])
        give_back()

    rows = docs.drop("redacted", "findings").withColumn("__look", look(F.col("text")))
    return rows.select(*[c for c in rows.columns if c != "__look"], "__look.findings", "__look.redacted")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, learn(docs))
    secrets = F.filter("findings", lambda f: f["secret"])
    spans = F.array_join(F.transform(secrets, lambda f: F.concat_ws(":", f["start"], f["end"])), ",")
    return found.select("doc_id", F.size("findings").alias("n_candidates"), F.size(secrets).alias("n_secrets"), spans.alias("spans"), F.sha2("redacted", 256).alias("redacted_sha256"))
