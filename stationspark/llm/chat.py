"""Formatting of conversations for training, in DataFrame functions only (operator 7).

A turn's content is a list of typed parts. A visitor goes over them once: text is escaped, an image, audio or document part
becomes a placeholder in its place, its reference is recorded under the placeholder's number, and its expanded tokens are
counted. Turns are marked by control strings; any of them inside a text is escaped by a backslash after its first
character, and one that looks escaped gets one more, so unescaping gives every text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, HEAD, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Placeholders of the part types that are attachments, and the tokens that one expands to unless the part says how many.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
EXPANDED = {"image": 576, "audio": 750, "document": 1024}
#: What stands between the brackets of control strings that texts may not hold as such: those above and other templates'.
_CONTROL = r"\|(?:im_start|im_sep|im_end|image|audio|document|endoftext)\|>|/?s>|</?SYS>>|/?INST\]"

PARTS = "array<struct<type:string,text:string,ref:string,n_tokens:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_CONTROL})", r"$1$2")


def text_parts(text: Column) -> Column:
    """A plain text as its one part; null text is empty."""
    one = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("n_tokens"))
    return F.array(one).cast(PARTS)


def visit(parts: Column) -> tuple[Column, Column, Column]:
    """The rendered content of a turn, its attachments in order (type, ref, tokens), and their expanded tokens together.

    A part of an unknown type counts as text; null text is empty; null parts are skipped; a null reference is recorded as null.
    A placeholder ends no control string that a text before it begins: what is escaped is each text between placeholders.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    kinds = F.create_map(*[F.lit(x) for k, v in PLACEHOLDERS.items() for x in (k, v)])
    sizes = F.create_map(*[F.lit(x) for k, v in EXPANDED.items() for x in (k, v)])
    is_text = lambda p: F.coalesce(~p["type"].isin(*PLACEHOLDERS), F.lit(True))
    text = lambda p: F.coalesce(p["text"], F.lit(""))
    # Neighbouring texts are one text before they are escaped, as a control string could lie across them.
    zero = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
    content = F.aggregate(
        parts,
        zero,
        lambda a, p: F.when(is_text(p), F.struct(a["done"].alias("done"), F.concat(a["open"], text(p)).alias("open"))).otherwise(
            F.struct(F.concat(a["done"], escape(a["open"]), F.try_element_at(kinds, p["type"])).alias("done"), F.lit("").alias("open"))
        ),
        lambda a: F.concat(a["done"], escape(a["open"])),
    )
    files = F.transform(
        F.filter(parts, lambda p: ~is_text(p)),
        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["n_tokens"], F.try_element_at(sizes, p["type"]).cast("long")).alias("n_tokens")),
    )
    return content, files, F.aggregate(files, F.lit(0).cast("long"), lambda total, x: total + x["n_tokens"])


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), parts: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, n_attachment_tokens.

    ``turns`` has conv_id, turn, role and text, or typed content in the column ``parts``. Turns go by number, null first;
    equal numbers go by role, then escaped content, so repeated rows stand next to each other and all stay. A null role or text is
    empty. Rows with a null conv_id form one conversation. loss_spans are the places (start, length in code points of
    ``formatted``) of what the model is trained on: the contents of ``loss_roles``. attachments are numbered in the order
    of their placeholders. Other columns are ignored; an empty table gives no rows.
    """
    content, files, tokens = visit(F.col(parts) if parts else text_parts(F.col("text")))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), content.alias("content"), files.alias("files"), tokens.alias("tokens"))
    rows = rows.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(HEAD)))
    rows = rows.withColumn("whole", F.concat("head", "content", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", F.to_json(F.struct("files")))
    before = F.coalesce(F.sum(F.char_length("whole")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", (before + F.char_length("head")).cast("long")).withColumn("at", F.row_number().over(order))
    span = F.when(F.col("role").isin(*loss_roles), F.struct("start", F.char_length("content").cast("long").alias("length")))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "whole", "files", span.alias("span")))).alias("turns"), F.sum("tokens").alias("n_attachment_tokens"))
    numbered = F.transform(F.flatten(F.transform("turns", lambda t: t["files"])), lambda f, i: F.struct(i.cast("long").alias("number"), f["type"].alias("type"), f["ref"].alias("ref"), f["n_tokens"].alias("n_tokens")))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        numbered.alias("attachments"),
        "n_attachment_tokens",
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; placeholders stay where attachments stood."""
    chunks = F.split(formatted, rf"\Q{END}\E", -1)
    turns = F.filter(F.transform(chunks, lambda c, i: F.when(i < F.size(chunks) - 1, c)), lambda c: c.isNotNull())
    return F.transform(
        turns,
        lambda c: F.struct(
            unescape(F.substring_index(F.substring(c, len(START) + 1, 2**31 - 1), HEAD, 1)).alias("role"),
            unescape(F.substring(c, F.instr(c, HEAD) + len(HEAD), F.lit(2**31 - 1))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted rows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversation_digests(format_conversations(turns.unionByName(extra)))
