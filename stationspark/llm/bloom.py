"""A Bloom filter of fixed size over a column of ids, built by all tasks and small enough to be sent to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits in all (8 MiB), in one block, and set for an id. With more ids more rows pass; none is ever lost.
BITS, BLOCK, HASHES = 1 << 26, 1 << 19, 4


def _places(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return np.stack([(x + np.uint64(k) * step) % np.uint64(BITS) for k in range(HASHES)]).astype(np.int64)


def bloom_filter(ids: DataFrame, column: str) -> np.ndarray:
    """The filter's bits of all ids (not null): each task sets its own, blocks are joined where they meet."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, size = np.zeros(BITS // 8, np.uint8), BLOCK // 8
        for pdf in batches:
            at = _places(pdf["id"].to_numpy()).ravel()
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        some = [k for k in range(BITS // BLOCK) if bits[k * size : (k + 1) * size].any()]
        yield pd.DataFrame({"block": some, "bits": [bits[k * size : (k + 1) * size].tobytes() for k in some]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(BLOCK // 8, np.uint8)
        for bits in pdf["bits"]:
            out |= np.frombuffer(bits, np.uint8)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [out.tobytes()]})

    parts = ids.select(F.col(column).alias("id")).mapInPandas(mark, "block int, bits binary")
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts.groupBy("block").applyInPandas(join, "block int, bits binary").collect():  # BITS / BLOCK rows
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_contain(spark: SparkSession, bits: np.ndarray, column: Column) -> Column:
    """Whether an id may be in the filter: true for all that are."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def found(ids: pd.Series) -> pd.Series:
        at = _places(ids.to_numpy())
        return pd.Series(((shared.value[at >> 3] >> (7 - (at & 7))) & 1).all(axis=0))

    return found(column)
