"""Removal of repeated passages by overlapping windows of three lines (operator 2).

Every three consecutive lines of a document are hashed. Where a window stands in several places of the corpus, the first
(smallest doc_id, then place) stays and the lines of all others go; covered positions of overlapping windows merge. A line
goes only if its text stays in an earlier place: following windows to their first places leads strictly backwards.

The units of windows may be sentences in place of lines, which end at line ends too. Three equal lines are at least three equal
sentences, so all that windows of lines find is found, and passages inside longer lines as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import bloom_filter, may_contain
from .common import discard, give_back, materialize, table

WINDOW = 3
#: What ends a unit: the end of a line, and for sentences the space after a full stop or its like (none needed after wide ones).
LINES, SENTENCES = re.compile(r"(\n)"), re.compile(r"(\n|(?<=[.!?…。！？])[^\S\n]+|(?<=[。！？])(?=[^\s。！？]))")


def full_lines(text: str, units: re.Pattern = LINES) -> tuple[list[str], list[str], list[int]]:
    """The lines (or other units) of a text, the end of each, and which of them are not blank: windows are made of these."""
    parts = units.split(text)
    lines = parts[::2]
    return lines, [*parts[1::2], ""], [k for k, line in enumerate(lines) if line and not line.isspace()]


def windows(docs: DataFrame, size: int = WINDOW, units: re.Pattern = LINES) -> DataFrame:
    """doc_id, text_hash, pos (place among the lines that are not blank), and 128 bits of each window's trimmed lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, own, places, hashes = [], [], [], []
            for doc, text_hash, text in zip(pdf["doc_id"].tolist(), pdf["text_hash"].tolist(), pdf["text"], strict=True):
                lines, _, full = full_lines(text, units)
                kept = [lines[k].strip() for k in full]
                n = len(kept) - size + 1
                if n > 0:
                    ids += [doc] * n
                    own += [text_hash] * n
                    places += range(n)
                    hashes += [hashlib.blake2b("\n".join(kept[k : k + size]).encode("utf-8", "surrogatepass"), digest_size=16).digest() for k in range(n)]
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "text_hash": np.array(own, np.int64), "pos": np.array(places, np.int32), "h1": h[:, 0], "h2": h[:, 1]})
        give_back()

    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInPandas(run, "doc_id long, text_hash long, pos int, h1 long, h2 long")


def repeated(found: DataFrame) -> DataFrame:
    """doc_id, text_hash and the places at which windows begin that stand earlier in the corpus."""
    place = F.struct("doc_id", "text_hash", "pos")
    first = found.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1")
    first = materialize(first.select("h1", "h2", "first"), "first-windows")  # a plain table: hot windows are split in the join
    later = found.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("__places"))


def dedup_lines(docs: DataFrame, size: int = WINDOW, units: re.Pattern = LINES) -> DataFrame:
    """``docs`` with text without repeated lines, n_lines (not blank) and n_removed; an input's columns of these names give way.

    Texts of fewer than ``size`` lines that are not blank have no window and stay, as do null texts (n_lines 0) and rows with
    a null doc_id. Blank lines are in no window; one goes with the text before it. Equal windows in one document count by
    place as in different ones. Rows that repeat a doc_id and text stand at one place: what is first in one is so in all.
    Different texts of one doc_id are different rows, in the order of their hashes. An empty table gives no rows. With SENTENCES as ``units`` all this holds for sentences in place of lines.
    """
    found = materialize(windows(docs, size, units), "windows")
    gone = materialize(repeated(found), "repeated-windows")
    discard(found)  # the largest table by far
    gone = gone.withColumnsRenamed({"doc_id": "__doc", "text_hash": "__hash"})

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, places in batches:
            yield cut_batch(text, places)
        give_back()

    def cut_batch(text: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for one, at in zip(text, places, strict=True):
            if one is None:
                out.append((None, 0, 0))
                continue
            lines, ends, full = full_lines(one, units)
            if at is None or not len(at):
                out.append((one, len(full), 0))
                continue
            covered = np.zeros(len(full), bool)
            for k in range(size):
                covered[np.asarray(at) + k] = True
            dropped = {full[k] for k in np.flatnonzero(covered)}
            kept, after = [], False
            for k, line in enumerate(lines):
                if k in dropped or after and (not line or line.isspace()):
                    after = True
                    if kept and ends[k] == "\n":  # what is left of a line ends as the line did
                        kept[-1] = (kept[-1][0], "\n")
                else:
                    kept.append((line, ends[k]))
                    after = False
            if kept:  # nothing follows the last one
                kept[-1] = (kept[-1][0], "")
            out.append(("".join(line + end for line, end in kept), len(full), len(dropped)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    # Texts are large: those that surely hold nothing repeated stay where they are, and only the others meet their places.
    row_hash = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    held = F.coalesce(may_contain(docs.sparkSession, bloom_filter(gone.select(F.xxhash64("__doc", "__hash").alias("id")), "id"), row_hash), F.lit(False))
    marked = docs.withColumn("__held", held)
    some = marked.where("__held").drop("__held").withColumn("__own", F.xxhash64("text"))
    some = some.join(gone.hint("merge"), (F.col("doc_id") == F.col("__doc")) & (F.col("__own") == F.col("__hash")), "left").drop("__own", "__doc", "__hash")
    rest = marked.where("not __held").drop("__held").withColumn("__places", F.lit(None).cast(gone.schema["__places"].dataType))
    rows = some.unionByName(rest).withColumn("__cut", cut(F.col("text"), F.col("__places")))
    keep = [F.col("__cut.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*keep, F.col("__cut.n_lines").alias("n_lines"), F.col("__cut.n_removed").alias("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same over the table documents in DuckDB's SQL; windows are compared as texts.
OP2_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos FROM lines WHERE NOT regexp_full_match(line, '\s*')),
w AS (SELECT doc_id, pos, trim(line) || chr(10) || trim(lead(line, 1) OVER d) || chr(10) || trim(lead(line, 2) OVER d) AS w FROM full_lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
again AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM w WHERE w IS NOT NULL) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM again),
marked AS (SELECT l.doc_id, l.k, l.line, f.pos IS NOT NULL AS is_full, c.pos IS NOT NULL AS gone FROM lines l LEFT JOIN full_lines f USING (doc_id, k) LEFT JOIN covered c ON c.doc_id = f.doc_id AND c.pos = f.pos),
seen AS (SELECT *, coalesce(last_value(CASE WHEN is_full THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k), false) AS after FROM marked)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT after), '') AS text, count(*) FILTER (is_full) AS n_lines, count(*) FILTER (gone) AS n_removed
FROM seen GROUP BY doc_id
"""
