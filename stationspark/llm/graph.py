"""Connected components of an edge table: forests of bounded chunks first, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges that a task joins by itself: a fixed size, so a larger graph is more tasks.
CHUNK = 1 << 16


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a chunk as stars: every vertex to the smallest one that it reaches within the chunk."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in list(parent)]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"]).astype("int64")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _stars(edges: DataFrame) -> DataFrame:
    """Edges to stars, each vertex to its component's smallest; rounds are logarithmic in practice.

    A large star links a vertex's larger neighbours to its smallest one, a small star its smaller ones. Each join is of
    plain tables, so that a vertex with a great many neighbours is split by the adaptive skew join.
    """
    now, state = edges, _state(edges)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            return now


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) to (node, component): the smallest vertex reachable, for every vertex that has an edge.

    Self-loops, repeated edges and edges with a null are ignored; no edges give no rows. Edges are dealt to chunks of a
    fixed size, each of which becomes stars; where there is more than one chunk, their stars are joined over the cluster.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    chunks = -(-now.count() // CHUNK) or 1
    now = materialize(now.repartition(chunks).mapInPandas(_forest, "u long, v long"), "forests")
    if chunks > 1:
        now = _stars(materialize(now.distinct(), "edges"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
