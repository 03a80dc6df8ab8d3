"""Encoding of document texts and its digest (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import table, text_or_empty

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer file lies; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns plus ``ids`` (array of int): the whole text's ids. Null text is the empty text, which has no ids.

    Rows are independent: no shuffle, repeated rows give repeated results, and a very long text is one row as any other.
    """

    @F.pandas_udf("array<int>")
    def encoded(column: pd.Series) -> pd.Series:
        return pd.Series(list(bpe.codec(path).encode(column.tolist())), dtype=object)

    return docs.select(*keep, encoded(text_or_empty(text)).alias("ids"))


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with ``decoded`` (string) for their ids; null ids decode to the empty text."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        return pd.Series([bpe.decode([] if x is None else x.tolist(), path) for x in column], dtype=object)

    return encoded.withColumn("decoded", decoded(F.col(ids)))


def token_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 of the ids in decimal joined by commas, decoded_sha256 of the decoded text.

    Null text is the empty text (no ids, digests of nothing). Rows with a null id, repeated rows and ties stay as they are,
    one result row for each; other columns are ignored; an empty table gives no rows.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = bpe.codec(path)
        for column in batches:
            rows = []
            for ids in map(np.ndarray.tolist, own.encode(column.tolist())):
                said = ",".join(map(own.decimal.__getitem__, ids))
                decoded = b"".join(map(own.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
                rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.release(path)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(text_or_empty(text)).alias("d"))
    return rows.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), tokenizer_path())
