"""Tree ensembles trained by Spark ML, as expressions for the JVM and as arrays for batches of candidates."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = re.compile(r"If \(feature (\d+) <= ([-+0-9.eE]+|Infinity)\)")
_LEAF = re.compile(r"Predict: ([-+0-9.eE]+)")


@dataclass(frozen=True)
class Node:
    value: float = 0.0  # of a leaf
    feature: int = -1  # of a split; -1: a leaf
    threshold: float = 0.0
    low: Node | None = None  # where the feature is at most the threshold
    high: Node | None = None


def parse(description: str) -> list[Node]:
    """The trees of an ensemble from its description (continuous features only)."""
    trees, lines = [], []
    for line in description.splitlines():
        if re.match(r"\s*Tree \d+", line):
            lines.append([])
        elif lines:
            lines[-1].append(line.strip())

    def read(rows: list[str]) -> Node:
        head = rows.pop(0)
        if leaf := _LEAF.match(head):
            return Node(value=float(leaf[1]))
        feature, threshold = _SPLIT.match(head).groups()
        low = read(rows)
        if not rows.pop(0).startswith("Else"):
            raise ValueError("not a binary tree")
        return Node(feature=int(feature), threshold=float(threshold.replace("Infinity", "inf")), low=low, high=read(rows))

    for rows in lines:
        trees.append(read([r for r in rows if r]))
    return trees


def as_column(node: Node, features: list[Column]) -> Column:
    """A tree as nested conditions over columns."""
    if node.feature < 0:
        return F.lit(node.value)
    return F.when(features[node.feature] <= node.threshold, as_column(node.low, features)).otherwise(as_column(node.high, features))


@dataclass(frozen=True)
class Forest:
    """All nodes of an ensemble in flat arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    @classmethod
    def of(cls, trees: list[Node]) -> Forest:
        rows: list[list] = []

        def add(node: Node) -> tuple[int, int]:
            at = len(rows)
            rows.append([max(node.feature, 0), node.threshold, at, at, node.value])
            if node.feature < 0:
                return at, 0
            (low, a), (high, b) = add(node.low), add(node.high)
            rows[at][2:4] = low, high
            return at, 1 + max(a, b)

        roots = [add(t) for t in trees]
        f, t, low, high, v = zip(*rows, strict=True)
        return cls(np.array(f), np.array(t, float), np.array(low), np.array(high), np.array(v, float), np.array([r for r, _ in roots]), max((d for _, d in roots), default=0))

    def mean(self, x: np.ndarray) -> np.ndarray:
        """The mean of the trees' values for each row of features."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.low[at], self.high[at])
            total += self.value[at]
        return total / max(1, len(self.roots))
