"""N-gram Jaccard join by rare-first prefix filtering (operator 8).

All shingles have one global order, by the number of documents that hold them, rare ones first. Documents are counted exactly:
every shingle goes to the bucket of its hash, packed by batches of documents, and what stands in several documents comes back
to its batch. Two sets of Jaccard similarity t or more share a shingle in the first n - ceil(t n) + 1 of each, and at the
first one they share a bound on what can follow holds (positional filter); their sizes are close (length filter). A document
whose prefix is all its own has no partner and is left there. Postings of the other prefixes meet by shingle. Pairs that
pass are verified once, by their whole sets, after a filter that compares how many shingles each has in parts of the hash
range (suffix filter).

What is asked for is which documents hang together, so links inside what hangs together already need not be found: each list
first links its members to one of them, then components of a list to members of its largest one. What is left is exact: in
every list that still has several components, all members outside its largest one are compared with all others of other
components. No link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .bloom import bloom_filter, may_contain
from .common import discard, give_back, materialize, table
from .graph import connected_components
from .hashing import mixed
from .shingles import COUNTERS, count_pass, set_key, shingle_sets, total_counts

THRESHOLD = Fraction(3, 4)
#: Sets with the most copies whose later copies emit no postings: a bounded table. Copies of other sets go as any near copy.
MOST_CLASSES = 50_000
#: Shingles that a bucket is to hold, and shingles and documents (a power of two) of a batch.
PER_BUCKET, HELD, DOCS_BITS = 1 << 17, 1 << 20, 12
#: Bits of a shingle's hash that identify it in a bucket, and in all. Where hashes share them, shingles count as one more
#: frequent shingle: a worse place in the order, which all documents share all the same.
REST_BITS, MOST_BITS = 36, 52
#: List members that share one to be linked to, members of a list's largest component that others are compared with, a
#: component's comparisons in a turn, and turns. They set how much work there is, not what is found.
SPREAD, SAMPLED, TRIES, TURNS = 4096, 16, 32, 2
#: Parts of the hash range in the suffix filter.
PARTS = 16


def _overlap_needed(n, m, t: Fraction):
    """Twice-scaled form of |x & y| >= t / (1 + t) * (n + m): (factor of the overlap, what it must reach)."""
    return t.numerator + t.denominator, t.numerator * (n + m)


def _may_link(n: Column, i: Column, m: Column, j: Column, t: Fraction) -> Column:
    """Length filter, and positional filter at a shingle that is at places i and j: exact for the first one that both have."""
    factor, least = _overlap_needed(n, m, t)
    sizes = F.least(n, m) * t.denominator >= F.greatest(n, m) * t.numerator
    return sizes & (factor * (n - i) >= least) & (factor * (m - j) >= least)


def _prefix(n, t: Fraction):
    return n - -(-n * t.numerator // t.denominator) + 1


def _frequency_class(n: np.ndarray) -> np.ndarray:
    """Counts in steps of an eighth of a doubling, so that they take one byte."""
    return np.minimum(8 * np.log2(n), 255).astype(np.uint64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(x))[: len(starts)]


def prefix_postings(docs: DataFrame, counts: np.ndarray, copies: dict[tuple[int, int], int], t: Fraction) -> DataFrame:
    """token, doc, n, pos: the places of shingles in rare-first prefixes, but for shingles that stand in one document only.

    A shingle whose counter in the sketch is very high never enters a bucket: it is frequent by its counter's count, which is
    above any exact count, so a shingle of a third of all documents makes no large bucket. Batches of documents are numbered
    by task, so rows must come in one order whenever they are read, as those of a table do.
    """
    spark = docs.sparkSession
    total = int(counts.sum())
    mean = total / COUNTERS  # what chance adds to a counter stays near it
    hot_from = int(mean + 8 * mean**0.5) + 1024
    bits = min(24, max(10, (total // PER_BUCKET).bit_length()))
    identity = min(MOST_BITS, REST_BITS + bits)
    rest = identity - bits
    shared = spark.sparkContext.broadcast((counts, copies))  # bounded: COUNTERS numbers and MOST_CLASSES keys
    u8 = np.uint64

    def packed(batch: int, held: list[np.ndarray], ids: list[int], seen_by: np.ndarray) -> pd.DataFrame:
        sizes = np.array([len(s) for s in held], np.int64)
        all_of = np.concatenate(held)
        place = np.repeat(np.arange(len(held), dtype=np.uint64), sizes)
        seen = seen_by[(all_of & u8(COUNTERS - 1)).astype(np.int64)]
        token = all_of >> u8(64 - identity)
        hot = seen > hot_from
        head = (token[hot].tobytes(), (_frequency_class(seen[hot]) << u8(DOCS_BITS) | place[hot]).astype(np.uint32).tobytes())
        value = np.sort(token[~hot] << u8(DOCS_BITS) | place[~hot])
        bucket = (value >> u8(rest + DOCS_BITS)).astype(np.int64)
        starts, ends = _runs(bucket)
        raw = np.ascontiguousarray((value & u8((1 << rest + DOCS_BITS) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
        out = pd.DataFrame({"bucket": bucket[starts], "values": [raw[6 * a : 6 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], "marks": None, "docs": None, "sizes": None})
        # A head is dealt by a hash of its batch: numbers of batches have the task in their high bits, which no bucket would see.
        own = {"bucket": [int(mixed(np.array([batch], np.uint64))[0] >> u8(64 - bits))], "values": [head[0]], "marks": [head[1]], "docs": [np.array(ids, np.int64).tobytes()], "sizes": [sizes.tobytes()]}
        return pd.concat([out, pd.DataFrame(own)], ignore_index=True).assign(batch=batch)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen_by, copies_ = shared.value
        batch = TaskContext.get().partitionId() << 32
        held, ids, size = [], [], 0
        for pdf in batches:
            for doc, s in zip(pdf["doc_id"].tolist(), shingle_sets(pdf["text"].tolist()), strict=True):
                if not len(s) or copies_.get(set_key(s), doc) != doc:
                    continue
                held.append(s)
                ids.append(doc)
                size += len(s)
                if size >= HELD or len(held) == 1 << DOCS_BITS:
                    yield packed(batch, held, ids, seen_by)
                    batch, held, ids, size = batch + 1, [], [], 0
        if held:
            yield packed(batch, held, ids, seen_by)
        give_back()

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        """A bucket: the shingles that stand more than once go back to their batches, with how often they do."""
        heads = pdf["docs"].notna()
        own = pdf[~heads]
        sizes = [len(v) // 6 for v in own["values"]]
        raw = np.zeros((sum(sizes), 8), np.uint8)
        raw[:, :6] = np.frombuffer(b"".join(own["values"]), np.uint8).reshape(-1, 6)
        value, row = raw.view("<u8").ravel(), np.repeat(np.arange(len(own)), sizes)
        token = value >> u8(DOCS_BITS)
        order = np.argsort(token)
        starts, ends = _runs(token[order])
        times = ends - starts
        each = np.repeat(times, times)
        some = order[each > 1]
        back = _frequency_class(each[each > 1]) << u8(48) | value[some]
        by_row = np.argsort(row[some], kind="stable")
        back, row = back[by_row], row[some][by_row]
        starts, ends = _runs(row)
        out = own.iloc[row[starts]].assign(values=[back[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])
        return pd.concat([pdf[heads], out], ignore_index=True)[["batch", "bucket", "values", "marks", "docs", "sizes"]]

    def prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
        """A batch: the documents' repeated shingles in order, and which of them are in the prefix."""
        heads = pdf["docs"].notna()
        head, own = pdf[heads].iloc[0], pdf[~heads]
        docs_, n, marks = np.frombuffer(head["docs"], np.int64), np.frombuffer(head["sizes"], np.int64), np.frombuffer(head["marks"], np.uint32)
        value = np.frombuffer(b"".join(own["values"]), np.uint64)
        bucket = np.repeat(own["bucket"].to_numpy().astype(np.uint64), [len(v) // 8 for v in own["values"]])
        low = u8((1 << DOCS_BITS) - 1)
        token = np.concatenate([bucket << u8(rest) | value >> u8(DOCS_BITS) & u8((1 << rest) - 1), np.frombuffer(head["values"], np.uint64)])
        place = np.concatenate([value & low, marks & low]).astype(np.int64)
        level = np.concatenate([value >> u8(48), marks >> DOCS_BITS]).astype(np.int64)
        unique, prefix = n - np.bincount(place, minlength=len(n)), _prefix(n, t)
        some = (unique < prefix)[place]
        token, place, level = token[some], place[some], level[some]
        order = np.lexsort((token, level, place))
        token, place = token[order], place[order]
        pos = unique[place] + np.arange(len(place)) - np.searchsorted(place, place)
        keep = pos < prefix[place]
        token, place, pos = token[keep], place[keep], pos[keep]
        give_back()
        return pd.DataFrame({"token": token.view(np.int64), "doc": docs_[place], "n": n[place].astype(np.int32), "pos": pos.astype(np.int32)})

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    columns = "batch long, bucket int, values binary, marks binary, docs binary, sizes binary"
    sent = rows.mapInPandas(emit, columns)
    back = sent.groupBy("bucket").applyInPandas(repeated, columns)
    return back.groupBy("batch").applyInPandas(prefixes, "token long, doc long, n int, pos int")


def _lists(postings: DataFrame) -> DataFrame:
    """Postings of shingles that several documents have in their prefixes, with a part of the list (``part``) for each."""
    several = postings.groupBy("token").agg(F.count("*").alias("size"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
    part = F.pmod(F.xxhash64("doc"), F.floor(F.col("size") / SPREAD) + 1).cast("int")
    return postings.join(several.select("token", "size"), "token").select("token", "doc", "n", "pos", part.alias("part"))


def _sets(docs: DataFrame, concerned: DataFrame) -> DataFrame:
    """doc and shingles (sorted, packed) of the documents in ``concerned``."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["doc"].to_numpy(), "shingles": [s.tobytes() for s in shingle_sets(pdf["text"].tolist())]})
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where(F.col("doc").isNotNull())
    # The filter keeps most other texts out of the join's shuffle; the join is exact. Written before sets are made of them, so that
    # a task has one Python worker at a time.
    rows = rows.where(may_contain(docs.sparkSession, bloom_filter(concerned, "doc"), F.col("doc"))).join(concerned, "doc", "left_semi")
    rows = materialize(rows, "concerned-texts")
    out = materialize(rows.mapInPandas(sets, "doc long, shingles binary"), "sets")
    discard(rows)
    return out


def verified(sets: DataFrame, pairs: DataFrame, t: Fraction) -> DataFrame:
    """Those of ``pairs`` (u, v) whose whole sets link."""
    bounds = np.array([k << 60 for k in range(1, PARTS)], np.uint64)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = sorted((np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y)), key=len)
                factor, least = _overlap_needed(len(a), len(b), t)
                parts = [np.diff(np.concatenate([[0], np.searchsorted(s, bounds), [len(s)]])) for s in (a, b)]
                if not len(a) or factor * np.minimum(*parts).sum() < least:
                    good.append(False)
                    continue
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                good.append(factor * int((b[at] == a).sum()) >= least)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
        give_back()

    x, y = (sets.select(F.col("doc").alias(k), F.col("shingles").alias(c)) for k, c in (("u", "x"), ("v", "y")))
    return materialize(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(check, "u long, v long"), "links")


def _best(pairs: DataFrame, of: str, most: int, turn: int) -> DataFrame:
    """u, v: for each ``of`` the ``most`` pairs (a, b) that meet most often."""
    pairs = pairs.groupBy(of, "a", "b").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy(of).orderBy(F.desc("times"), F.xxhash64("a", "b", F.lit(turn))))
    pairs = pairs.withColumn("place", place).where(F.col("place") <= most)
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _star_pairs(found: DataFrame, t: Fraction) -> DataFrame:
    """For each document the two members of parts of lists, one of each part, that it meets most often."""
    one = found.groupBy("token", "part").agg(F.min(F.struct(F.xxhash64("doc"), "doc", "n", "pos")).alias("one"))
    met = found.join(one, ["token", "part"]).where(F.col("doc") != F.col("one.doc"))
    met = met.where(_may_link(F.col("n"), F.col("pos"), F.col("one.n"), F.col("one.pos"), t))
    return _best(met.select(F.col("doc").alias("a"), F.col("one.doc").alias("b"), F.col("doc").alias("of")), "of", 2, 0)


def _mixed(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Postings with their documents' components and their lists' largest component, of lists of several components."""
    mine = found.select("token", "doc", "n", "pos").join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left")
    mine = materialize(mine.withColumn("component", F.coalesce("component", "doc")), "labelled-postings")
    sizes = mine.groupBy("token", "component").agg(F.count("*").alias("size"))
    lists = sizes.groupBy("token").agg(F.count("*").alias("several"), F.max(F.struct("size", "component")).alias("top")).where("several > 1")
    return materialize(mine.join(lists.select("token", F.col("top.component").alias("largest")), "token"), "mixed-postings")


def _turn_pairs(lists: DataFrame, turn: int, t: Fraction) -> DataFrame:
    """A member of every component of a list with some of its largest one; which ones changes with the turn."""
    member = F.struct(F.xxhash64("doc", "token", F.lit(turn)).alias("hash"), "doc", "n", "pos")
    mine = lists.select("token", "component", "largest", member.alias("m"))
    few = mine.where("component <> largest").groupBy("token", "component").agg(F.min("m").alias("m"))
    tops = mine.where("component = largest").groupBy("token", F.pmod("m.hash", F.lit(SAMPLED)).alias("slot")).agg(F.min("m").alias("top"))
    pairs = few.join(tops, "token").where(_may_link(F.col("m.n"), F.col("m.pos"), F.col("top.n"), F.col("top.pos"), t))
    return _best(pairs.select("component", F.col("m.doc").alias("a"), F.col("top.doc").alias("b")), "component", TRIES, turn)


def _rest(lists: DataFrame, t: Fraction) -> DataFrame:
    """Pairs of different components that may link.

    Sizes in bands of the threshold's ratio are part of the join's key, and the length and positional filters of its
    condition. A pair that passes at a shingle is then held against all that both prefixes share: what two documents share
    besides comes after the end of one of the prefixes, so there is a bound on it.
    """
    n, m = F.col("n"), F.col("n_")
    band = F.floor(F.log(n) / F.log(F.lit(float(1 / t)))).cast("int")
    few = lists.where("component <> largest").select("token", *[F.col(c).alias(f"{c}_") for c in ("doc", "n", "pos", "component")], band.alias("near"))
    few = few.withColumn("band", F.explode(F.array(F.col("near") - 1, F.col("near"), F.col("near") + 1))).drop("near")
    both = few.join(lists.withColumn("band", band), ["token", "band"])
    both = both.where("component <> component_ and (component = largest or doc > doc_)").where(_may_link(n, F.col("pos"), m, F.col("pos_"), t))
    pairs = both.select(F.greatest("doc", "doc_").alias("u"), F.least("doc", "doc_").alias("v")).distinct()
    prefix = lists.groupBy("doc").agg(F.collect_list("token").alias("tokens"), F.max("n").alias("n"))
    prefix = materialize(prefix, "prefixes")
    x, y = (prefix.select(F.col("doc").alias(k), F.col("tokens").alias(f"{k}_tokens"), F.col("n").alias(f"{k}_n")) for k in ("u", "v"))
    held = pairs.join(x, "u").join(y, "v")
    shared = F.size(F.array_intersect("u_tokens", "v_tokens")) + F.size("u_tokens") - F.size(F.array_distinct("u_tokens"))
    factor, least = _overlap_needed(F.col("u_n"), F.col("v_n"), t)
    beyond = F.ceil(F.greatest("u_n", "v_n") * t.numerator / t.denominator) - 1  # of the larger set, after its prefix
    return held.where(factor * (shared + beyond) >= least).select("u", "v")


def jaccard_components(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Documents link when |x & y| >= threshold * |x | y| over their sets of five-word shingles. Without words or text a set is
    empty and links with nothing. Rows of one doc_id are one vertex: each gets its row, and the links of any of them count.
    A row with a null doc_id has a null component. Other columns are ignored; an empty table gives no rows.
    """
    passed = materialize(count_pass(docs), "shingle-pass")
    ids = passed.where("block = -1").select("doc_id", "n", "h1", "h2")
    sets = ids.where("n > 0 and doc_id is not null")
    classes = sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    classes = materialize(classes, "set-classes")
    hot = classes.orderBy(F.desc("copies"), "h1", "h2").limit(MOST_CLASSES).collect()
    postings = materialize(prefix_postings(docs, total_counts(passed), {(r["h1"], r["h2"]): r["rep"] for r in hot}, threshold), "postings")
    found = materialize(_lists(postings), "lists")
    discard(postings)
    whole = _sets(docs, materialize(found.select("doc").distinct(), "concerned"))
    copies = sets.join(classes, ["h1", "h2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = copies.union(verified(whole, _star_pairs(found, threshold), threshold))
    parts = materialize(connected_components(links), "components")
    open_lists = _mixed(found, parts)
    for turn in range(1, TURNS + 1):
        new = verified(whole, _turn_pairs(open_lists, turn, threshold), threshold)
        if new.isEmpty():
            break
        parts = materialize(connected_components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).union(new)), "components")
        open_lists = _mixed(open_lists, parts)  # a list of one component stays one
    new = verified(whole, _rest(open_lists, threshold), threshold)
    parts = materialize(connected_components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).union(new)), "components")
    discard(found, whole, open_lists, classes)
    out = ids.join(parts, ids["doc_id"] == parts["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
