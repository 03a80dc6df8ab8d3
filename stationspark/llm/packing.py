"""Best-fit packing of documents into sequences by minimum bin slack (operator 10).

What is planned is the histogram of piece lengths, which has at most ``capacity`` entries whatever the corpus holds: the
longest length left opens a sequence, a bitset dynamic programme finds the fullest feasible rest over the available lengths,
and that combination is removed as often as the counts allow. Pieces find their places by their rank among pieces of their
length; ranks come from counts by (length, salt), so that a length which a third of all pieces have is many groups.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, shuffle_partitions, table, text_or_empty
from .tokens import tokenizer_path

CAPACITY = 1024
END_ID = 2


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document is its ids and the end id. Up to ``capacity`` ids are one piece; longer ones are cut into whole pieces, of which
    the first takes what is over. Null and empty texts are the end id alone; a null doc_id stays null.
    """

    @F.pandas_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        end = np.array([end_id], "<u4").tobytes()
        for text in batches:
            out = []
            for ids in bpe.encode_to_bytes(text.tolist(), path):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out.append([{"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])} for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
            yield pd.Series(out, dtype=object)
        bpe.release(path)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(cut(text_or_empty())))


def fullest(room: int, counts: dict[int, int], lengths: list[int]) -> list[int]:
    """The combination of available lengths with the largest sum up to ``room``: reachable sums are the bits of one number."""
    reach, steps, goal = 1, [], 1 << room
    mask = (1 << room + 1) - 1
    for n in reversed(lengths[: bisect.bisect_right(lengths, room)]):
        left, k = min(counts[n], room // n), 1
        while left:  # a multiplicity as powers of two, so that few shifts cover it
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= reach << n * k & mask
            left -= k
            k *= 2
            if reach & goal:
                break
        if reach & goal:
            break
    at, taken = reach.bit_length() - 1, []
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken += [n] * k
            at -= n * k
    return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many sequences each fills, in order; they use up the histogram exactly."""
    counts = {n: c for n, c in histogram.items() if c}
    lengths, out = sorted(counts), []
    while lengths:
        top = lengths[-1]
        counts[top] -= 1
        used = defaultdict(int)
        for n in [top, *fullest(capacity - top, counts, lengths)]:
            used[n] += 1
        counts[top] += 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
            if not counts[n]:
                lengths.pop(bisect.bisect_left(lengths, n))
        out.append((dict(used), times))
    return out


def places(combinations: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rank intervals: first rank, pieces of it in a sequence, first sequence id, first offset in a sequence."""
    rows, taken, first = defaultdict(list), defaultdict(int), 0
    for used, times in combinations:
        offset = 0
        for n, k in used.items():
            rows[n].append((taken[n], k, first, offset))
            taken[n] += k * times
            offset += n * k
        first += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def salted(pieces: DataFrame, salts: int) -> DataFrame:
    """``pieces`` with a salt of all that tells them apart and of where they stand, so those without an id, and repeated ones, have many.

    ``pieces`` must come in one order whenever they are read, as the rows of a table do.
    """
    return pieces.withColumn("__at", F.monotonically_increasing_id()).withColumn("__salt", F.pmod(F.xxhash64(*pieces.columns, "__at"), F.lit(salts))).drop("__at")


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """``pieces`` (with length) plus sequence_id and offset: as few sequences of at most ``capacity`` as the plan finds.

    Pieces of one length are alike, so which of them takes which place is settled by (doc_id, piece); repeated rows tie and
    take neighbouring places. An empty table gives no rows. Lengths must lie between 1 and ``capacity``.
    """
    spark = pieces.sparkSession
    salts = salts or shuffle_partitions(spark)
    rows = salted(pieces, salts)
    sizes = rows.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    # Bounded: at most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("length").alias("__length"), F.col("__salt").alias("__s"), F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", *pieces.columns))
    ranked = rows.withColumn("__rank", within.cast("long") - 1)
    ranked = ranked.join(starts, (F.col("length") == F.col("__length")) & (F.col("__salt") == F.col("__s")))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.empty((2, len(lengths)), np.int64)
        for n in np.unique(lengths):
            mine = np.flatnonzero(lengths == n)
            starts, per, first, offset = where.value[n]
            r = ranks[mine]
            at = np.searchsorted(starts, r, "right") - 1
            deep = r - starts[at]
            out[0, mine] = first[at] + deep // per[at]
            out[1, mine] = offset[at] + deep % per[at] * n
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    placed = ranked.withColumn("__place", place("length", F.col("__before") + F.col("__rank")))
    return placed.select(*pieces.columns, "__place.sequence_id", "__place.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize once, keep the small rows of pieces in the shared folder, plan and place them. Other columns are ignored."""
    return pack(materialize(pieces_of(docs, path, capacity, end_id), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
