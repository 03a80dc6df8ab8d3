"""A corpus made ready for training: toxic documents go, then repeated lines, near-duplicates and secrets; the rest is packed.

Stages follow each other over whole tables. Each takes (spark, docs, sf_dir), where docs is what the one before has kept, and
returns a DataFrame; all but the last have the columns of docs, with their values but for text and, where there is one, n_chars.

In every stage a row is judged by its text alone, which may be null, empty or very long, and by its doc_id where copies need an
order. Null and empty texts are clean, hold no line, no n-gram and no secret, and stay; packed they are an end of text. A null
doc_id stands after all others. Rows that repeat in all columns are rows as any other, so of them one stays in the Jaccard join.
Other columns may have any names but those that begin with two underscores. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationspark.llm import jaccard, linededup, packing, secrets, toxicity
from stationspark.llm.common import bounded_batches, materialize, table
from stationspark.llm.tokens import tokenizer_path


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the stage's input, n_chars counted anew from the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """The rows as a written table with a key of their own, ``__row``, whatever repeats among them.

    Keys ascend by doc_id (null last), a hash of the text and one of the whole row; among rows equal in all columns, which are
    interchangeable, in any order. Once written they are the same for all readers.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.xxhash64(*docs.columns), "__place"]
    rows = docs.withColumn("__place", F.monotonically_increasing_id()).orderBy(*order)  # __place splits large groups of equal rows
    return materialize(rows.drop("__place").withColumn("__row", F.monotonically_increasing_id()), name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rated toxic go; rows without text or id are rated as any other, equal texts alike."""
    bounded_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    rated = toxicity.score(docs.select(F.struct(*docs.columns).alias("__row"), "text"), model, keep=("__row",))
    return rated.where(~toxicity.is_toxic()).select("__row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of three sentences go, lines included; a document of nothing else goes with them.

    Every row stands for itself, also where ids or whole rows repeat or ids are null; of equal ones the first stays whole.
    Texts of fewer than three sentences, null and empty ones among them, stay as they are.
    """
    bounded_batches(spark)
    rows = _keyed(docs, "line-rows")
    found = linededup.dedup_lines(rows.select(F.col("__row").alias("doc_id"), "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("__all")), units=linededup.SENTENCES)
    found = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return _measured(found.select(*[F.col(f"__all.`{c}`") for c in docs.columns if c != "text"], "text"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that hang together by n-gram similarity one stays, that with the smallest id (null last).

    Rows are told apart by keys of their own, so of repeated rows and of those without id one stays as well, and different
    texts of one id are judged each by itself. Rows without words hang together with none.
    """
    bounded_batches(spark)
    rows = _keyed(docs, "near-rows")
    later = jaccard.jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("__row"))
    return rows.join(materialize(later, "near-duplicates"), "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all rows stay. Null texts stay null, equal texts are treated alike."""
    bounded_batches(spark)
    found = secrets.scan(docs.select("text", F.struct(*docs.columns).alias("__all")), secrets.learn(docs))
    kept = [F.col(f"__all.`{c}`") for c in docs.columns if c != "text"]
    return _measured(found.select(*kept, F.col("redacted").alias("text")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces in sequences of at most 1024 tokens. A row without text is an end of text, a null id stays null."""
    bounded_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: SQL cannot express the learned stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
