"""Sets of five-word shingles as sorted 64-bit hashes, and one pass that describes the set of every document."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, shuffle_partitions
from .hashing import SHORT, mixed, short_hashes

WORDS = 5
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 18
#: Counters of the frequency sketch (a power of two) and of one block of it: a fixed size whatever the corpus holds.
COUNTERS, BLOCK = 1 << 18, 1 << 12

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WHITE = re.compile(rb"[\x09-\x0D\x20]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _long_word(word: bytes) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(word.translate(_LOWER)))


def _hash_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of at most CHUNK bytes begin, and their hashes."""
    data = data.translate(_LOWER)
    b = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = short_hashes(b, start, end)
    for k in np.flatnonzero(end - start > SHORT).tolist():
        h[k] = _long_word(data[start[k] : end[k]])
    return start, h


def _hash_long(data: bytes) -> np.ndarray:
    """The hashes of the words of a text of any length, cut at white space."""
    out, at = [], 0
    while at < len(data):
        piece = data[at : at + CHUNK]
        if len(piece) == CHUNK:
            white = np.flatnonzero(_SPACE[np.frombuffer(piece, np.uint8)])
            if not len(white):  # one word is longer than that
                found = _WHITE.search(data, at + CHUNK)
                end = found.start() if found else len(data)
                out.append(np.array([_long_word(data[at:end])], np.uint64))
                at = end
                continue
            piece = piece[: white[-1] + 1]
        out.append(_hash_chunk(piece)[1])
        at += len(piece)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _STEP + h[k : k + n]
    return mixed(out)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _sets_together(parts: list[bytes]) -> list[np.ndarray]:
    """The sets of several texts of at most CHUNK bytes in all, white space between them."""
    start, h = _hash_chunk(b"\n".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts])
    first = [0, *np.searchsorted(start, ends).tolist()]
    rolled, out = _rolled(h, WORDS), []
    for a, b in zip(first, first[1:], strict=False):
        out.append(_distinct(rolled[a : b - WORDS + 1]) if b - a >= WORDS else _rolled(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each whole text its distinct shingles as ascending 64-bit hashes.

    A-Z become lower case; words are what stands between the six ASCII white-space characters. A text of fewer than five
    words is one shingle; one without words has none.
    """
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if size + len(data) + 1 > CHUNK:
            yield from _sets_together(held)
            held, size = [], 0
        if len(data) >= CHUNK:
            h = _hash_long(data)
            yield _distinct(_rolled(h, WORDS)) if len(h) >= WORDS else _rolled(h, len(h)) if len(h) else np.zeros(0, np.uint64)
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        yield from _sets_together(held)


def shingle_set(text: str | None) -> np.ndarray:
    return next(shingle_sets([text]))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    return tuple(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64).tolist())


def count_pass(docs: DataFrame) -> DataFrame:
    """One pass over all texts: a row (doc_id, n, h1, h2) per document, and rows (block, counts) with the task's sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, np.uint32)
        for pdf in batches:
            rows, places, held = [], [], 0
            for s in shingle_sets(pdf["text"].tolist()):
                rows.append((len(s), *set_key(s)))
                places.append((s & np.uint64(COUNTERS - 1)).astype(np.uint32))
                held += len(s)
                if held >= COUNTERS:
                    counts += np.bincount(np.concatenate(places), minlength=COUNTERS).astype(np.uint32)
                    places, held = [], 0
            if held:
                counts += np.bincount(np.concatenate(places), minlength=COUNTERS).astype(np.uint32)
            out = pd.DataFrame(rows, columns=["n", "h1", "h2"])
            out["doc_id"], out["no_id"] = pdf["doc_id"].to_numpy(), pdf["no_id"].to_numpy()
            out["block"], out["counts"] = -1, None
            yield out
        give_back()
        some = [k for k in range(COUNTERS // BLOCK) if counts[k * BLOCK : (k + 1) * BLOCK].any()]
        yield pd.DataFrame({"doc_id": 0, "no_id": True, "n": -1, "h1": 0, "h2": 0, "block": some, "counts": [counts[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in some]})

    # A null id crosses as a number and a flag: a column of whole numbers with nulls would cross as floats.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    found = rows.mapInPandas(run, "doc_id long, no_id boolean, n long, h1 long, h2 long, block int, counts binary")
    return found.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def total_counts(passed: DataFrame) -> np.ndarray:
    """The sketches of all tasks together. Blocks are summed where they meet; COUNTERS numbers come to the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, counts in zip(pdf["block"].tolist(), pdf["counts"], strict=True):
                if block not in sums:
                    sums[block] = np.zeros(BLOCK, np.int64)
                sums[block] += np.frombuffer(counts, np.uint32)
        yield pd.DataFrame({"block": list(sums), "counts": [x.tobytes() for x in sums.values()]})

    parts = passed.where("block >= 0").select("block", "counts").repartition(shuffle_partitions(passed.sparkSession), "block")
    out = np.zeros(COUNTERS, np.int64)
    for r in parts.mapInPandas(add, "block int, counts binary").where(F.col("block").isNotNull()).collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int64)
    return out
