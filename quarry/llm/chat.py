"""Chat formatting with Spark expressions only.

A conversation becomes one string. Neighbouring turns of one role share a message:

    <|turn|>role<|text|>first text<|part|>second text<|end|>

The markers, and those of other common templates, may occur in a text. There a backslash goes after
their first character, and after any backslashes that stand there already, so that each text is read back
unchanged and no text can open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_of

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
# What may follow the first character of a control string. <|...|>, <s>, </s>, [INST],
# [/INST] and <<SYS>>, <</SYS>>.
CONTROL_TAIL = r"(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL_TAIL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL_TAIL, "$1$2$3")


def format_chat(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, mask``.

    ``mask`` has an entry ``(skip, length, loss)`` for each turn: ``skip`` code points of markers, then
    ``length`` code points of escaped text, which count for the loss if ``loss`` says so. An end marker
    follows the last one.

    Turns go by ``turn``, null first; equal turns by role and text. Null roles and texts count as empty,
    a null ``conv_id`` is a conversation like others, repeated rows are turns of their own. An empty table
    gives an empty result. A conversation is one output row and so has to fit into one task.
    """
    row = F.struct(F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"))
    collected = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(
        F.sort_array(F.collect_list(row)).alias("t")
    )
    sorted_turns = collected.withColumn(
        "t",
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), escaped(x["text"]).alias("text"))),
    )
    # Places where a message begins, then the messages as slices between them.
    begins = F.filter(
        F.sequence(F.lit(0), F.size("t") - 1),
        lambda i: (i == 0) | (F.col("t")[i]["role"] != F.col("t")[F.greatest(i - 1, F.lit(0))]["role"]),
    )
    placed = sorted_turns.withColumn("b", begins)
    messages = placed.select(
        "conv_id",
        F.transform(
            "b",
            lambda start, k: F.slice(
                F.col("t"), start + 1, F.coalesce(F.get(F.col("b"), k + 1), F.size("t")) - start
            ),
        ).alias("m"),
    )

    def header(part: Column) -> Column:
        return F.concat(F.lit(TURN), escaped(part["role"]), F.lit(TEXT))

    def merged(parts: Column) -> Column:
        texts = F.array_join(F.transform(parts, lambda part: part["text"]), PART)
        return F.concat(header(parts[0]), texts, F.lit(END))

    def entries(parts: Column, k: Column) -> Column:
        opening = F.length(header(parts[0])) + F.when(k > 0, len(END)).otherwise(0)
        return F.transform(
            parts,
            lambda part, i: F.struct(
                F.when(i == 0, opening).otherwise(len(PART)).alias("skip"),
                F.length(part["text"]).alias("length"),
                (part["role"] == loss_role).alias("loss"),
            ),
        )

    return messages.select(
        F.col("conv_id").alias(conv_id),
        F.array_join(F.transform("m", merged), "").alias("formatted"),
        F.flatten(F.transform("m", entries)).alias("mask"),
    )


def read_chat(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns``, read back from ``formatted``: ``array<struct<role, text, length>>``.

    ``length`` is that of the text as it stands in ``formatted``, to be held against ``mask``.
    """
    messages = F.filter(F.split("formatted", r"<\|end\|>"), lambda m: m != "")

    def parts(message: Column) -> Column:
        head = F.split(message, r"<\|text\|>", 2)
        role = unescaped(F.substring(head[0], len(TURN) + 1, 2**31 - 1))
        return F.transform(
            F.split(head[1], r"<\|part\|>"),
            lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"), F.length(t).alias("length")),
        )

    return chats.withColumn("turns", F.flatten(F.transform(messages, parts)))


def chat_digest(chats: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Counts and digests of what a reader of ``formatted`` and ``mask`` gets."""
    pairs = F.zip_with(
        "turns",
        "mask",
        lambda t, m: F.struct(
            t["role"].alias("role"),
            t["text"].alias("text"),
            (m["loss"] & (m["length"] == t["length"])).alias("loss"),
        ),
    )
    read = read_chat(chats).withColumn("p", pairs)
    learnt = F.array_join(
        F.transform(F.filter("p", lambda p: p["loss"]), lambda p: p["text"]), ""
    )
    said = F.array_join(
        F.transform("p", lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n"))), ""
    )

    def sha(text):
        return F.sha2(F.encode(text, "UTF-8"), 256)

    return read.withColumn("learnt", learnt).select(
        conv_id,
        F.size("p").cast("long").alias("n_turns"),
        sha(said).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        sha(F.col("learnt")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
