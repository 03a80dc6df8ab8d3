"""Toxicity's model and scores, and the pipeline's stage, held against plain loops over all texts."""

import math
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from stationspark.llm import toxicity
from stationspark.llm.common import table


#: The least tables on which any word tells toxic texts from clean ones.
TABLES = "/root/testdata/sf0.01"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def looked_up(piece):
    """A word without what stands at its edges, then its beginnings of 8 to 4 characters."""
    word = re.sub(r"^[\W_]+|[\W_]+$", "", piece).lower()
    return [word, *[word[:k] + "*" for k in (8, 7, 6, 5, 4) if k < len(word)]] if word else []


def best_segments(x):
    """Scores of the segment with the most, and of those on both sides of it by the same rule."""
    best, low, at = (0.0, 0, 0), 0.0, 0
    total = 0.0
    for j, v in enumerate(x):
        if total <= low:
            low, at = total, j
        total += v
        if total - low > best[0] + 1e-12:
            best = (total - low, at, j + 1)
    return [*best_segments(x[: best[1]]), best[0], *best_segments(x[best[2] :])] if best[0] > 0 else []


class Plain:
    """The model of (doc_id, text) rows and (doc_id, toxic) labels, step by step."""

    def __init__(self, docs, labels):
        known = {}
        for i, toxic in labels:
            if i is not None and toxic is not None and not held(i):
                known[i] = max(known.get(i, 0), toxic)
        texts = {}
        for i, text in docs:
            if i in known:
                texts[text or ""] = max(texts.get(text or "", 0), known[i])
        counts = {1: Counter(), 0: Counter()}
        for text, toxic in texts.items():
            counts[int(toxic > 0)].update({f for piece in text.split() for f in looked_up(piece)})
        bad, good = (sum(counts[k].values()) for k in (1, 0))
        self.lexicon, in_lexicon = {}, [0, 0]
        for token in sorted(counts[1].keys() | counts[0].keys()):
            b, g = counts[1][token], counts[0][token]
            prior, of_all = 0.1 * (b + g), 0.1 * (bad + good)
            odds = math.log((b + prior) / (bad + of_all - b - prior)) - math.log((g + prior) / (good + of_all - g - prior))
            if abs(odds) >= 3 * math.sqrt(1 / (b + prior) + 1 / (g + prior)):
                self.lexicon[token] = odds
                in_lexicon = [in_lexicon[0] + b, in_lexicon[1] + g]
        left = bad - in_lexicon[0], good - in_lexicon[1]
        self.other = min(-0.02, math.log((left[0] + 1) / (bad + 1)) - math.log((left[1] + 1) / (good + 1)))
        chance = [(counts[0][t] + 0.5, odds) for t, odds in self.lexicon.items()] + [(left[1] + 0.5, self.other)]
        whole = sum(p for p, _ in chance)
        self.chance = [(p / whole, odds) for p, odds in chance]
        self.texts = texts

    def of(self, text):
        found = []
        for piece in text.split():
            names = looked_up(piece)
            found.append(next((self.lexicon[f] for f in names if f in self.lexicon), self.other) if names else 0.0)
        return found

    def offset(self, scale):
        """By the mean of the best segments of clean texts."""
        tops = []
        for text, toxic in self.texts.items():
            found = self.of(text)
            if not toxic and (segments := best_segments(found)):
                tops.append(scale * max(segments) - math.log(len(found)))
        return max(-5.0, sum(tops) / len(tops) - 0.5772) if tops else -5.0

    def evidence(self, text, scale, offset):
        found = self.of(text)
        return sum(max(0.0, scale * s - offset - math.log(len(found))) for s in best_segments(found))


@pytest.fixture(scope="module")
def given(spark):
    docs = table(spark, TABLES, "documents").select("doc_id", "text")
    labels = table(spark, TABLES, "labels").select("doc_id", "toxic")
    rows = [tuple(r) for r in docs.collect()]
    # Equal texts of two ids, a label twice, labels that are missing, and texts without words.
    toxic = next(t for i, t in rows if i in {r.doc_id for r in labels.where("toxic = 1").collect()} and not held(i))
    rows += [(10**9 + 1, toxic), (10**9 + 4, toxic), (10**9 + 5, ""), (10**9 + 6, None), (10**9 + 7, "... -- !"), (None, toxic)]
    said = [tuple(r) for r in labels.collect()] + [(10**9 + 1, 0), (10**9 + 1, 1), (10**9 + 5, 0), (10**9 + 6, None), (None, 1)]
    return rows, [(i, None if t is None else int(t)) for i, t in said]


def test_model_and_scores_are_those_of_plain_loops(spark, given):
    rows, said = given
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.learn(docs, spark.createDataFrame(said, "doc_id long, toxic int"))
    plain = Plain(rows, said)
    assert plain.lexicon and model.scores == pytest.approx(plain.lexicon)
    assert model.other == pytest.approx(plain.other)
    # The scale solves its equation, the offset is the mean law's, and the curve's weights leave no slope.
    assert model.scale > 0 and sum(p * math.exp(model.scale * s) for p, s in plain.chance) == pytest.approx(1, abs=1e-6)
    assert model.offset == pytest.approx(plain.offset(model.scale))
    slope = [-1e-3 * w for w in model.weights]
    for text, toxic in plain.texts.items():
        x = math.log1p(plain.evidence(text, model.scale, model.offset))
        miss = int(toxic > 0) - 1 / (1 + math.exp(-model.weights[0] - model.weights[1] * x))
        slope = [slope[0] + miss, slope[1] + miss * x]
    assert slope == pytest.approx([0, 0], abs=1e-5)
    expected = [(i, t, 1 / (1 + math.exp(-model.weights[0] - model.weights[1] * math.log1p(plain.evidence(t or "", model.scale, model.offset))))) for i, t in rows]
    scored = toxicity.score(docs, model, keep=("doc_id", "text")).collect()
    by_place = lambda r: (str(r[0]), str(r[1]))
    got = sorted(((r.doc_id, r.text, r.score) for r in scored), key=by_place)
    assert [g[:2] for g in got] == [e[:2] for e in sorted(expected, key=by_place)]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in sorted(expected, key=by_place)])
    assert len({round(e[2], 6) for e in expected}) > 2


def test_pipeline_drops_what_plain_loops_rate_as_toxic(spark):
    docs = table(spark, TABLES, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    labels = [tuple(r) for r in table(spark, TABLES, "labels").select("doc_id", "toxic").collect()]
    plain, model = Plain(rows, labels), toxicity.learn(docs, table(spark, TABLES, "labels"))
    rated = {i: model.weights[0] + model.weights[1] * math.log1p(plain.evidence(t or "", model.scale, model.offset)) for i, t in rows}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, TABLES).collect()}
    assert kept == {i for i, z in rated.items() if 1 / (1 + math.exp(-z)) < 0.3} and 0 < len(kept) < len(rows)
