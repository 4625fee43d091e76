"""Chat formatting with Spark expressions only.

Rows of (conv_id, turn, role, text) become one string per conversation. Turns are collected as structs and
sorted; adjacent turns of one role share a header. Control strings start with ``<``; texts and roles never hold
one, because backslash, ``<``, ``#`` and ``:`` are escaped, so the string can be read back turn by turn.

Defined results: a null text or role is the empty string; null turn numbers come first; rows with one turn number
are ordered by role, then text; repeated rows are turns of their own; rows with a null conv_id form one
conversation with a null id; no rows give no conversations; other columns are ignored. A conversation is one output
string, so its length is bounded by Spark's string type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, NEXT, CLOSE = "<turn>### ", ": ", "<and>", "</turn>\n"
#: Escaped character and the letter that stands for it after a backslash; backslash first when escaping, last when reading.
ESCAPES = (("\\", "b"), ("<", "l"), ("#", "h"), (":", "c"))
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    for char, letter in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescaped(text: Column) -> Column:
    for char, letter in reversed(ESCAPES):
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return text


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted, n_turns, n_blocks, loss_spans (array of [start, end) code points of each loss text)."""
    blank = F.lit("")
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", blank).alias("role"),
            F.coalesce("text", blank).alias("text"),
        ).alias("item"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("turns"))
    size = F.size("turns")
    starts = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    merged = sorted_turns.withColumn("starts", starts).withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda at, k: F.struct(
                F.get("turns", at)["role"].alias("role"),
                F.transform(
                    F.slice("turns", at + 1, F.coalesce(F.get("starts", k + 1), size) - at),
                    lambda t: escaped(t["text"]),
                ).alias("texts"),
            ),
        ),
    )
    # Each text as a piece with what stands before it, so that spans come from running lengths.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b, k: F.transform(
                b["texts"],
                lambda t, j: F.struct(
                    F.when(
                        j == 0,
                        F.concat(F.when(k > 0, F.lit(CLOSE)).otherwise(""), F.lit(OPEN), escaped(b["role"]), F.lit(HEAD)),
                    ).otherwise(NEXT).alias("before"),
                    t.alias("text"),
                    (b["role"] == loss_role).alias("loss"),
                ),
            ),
        )
    )
    none = F.array().cast("array<struct<start:long,end:long>>")
    empty = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["before"])
        end = start + F.length(p["text"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            end.cast("long").alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    laid = merged.withColumn("pieces", pieces)
    return laid.select(
        "conv_id",
        F.concat(
            F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(CLOSE)
        ).alias("formatted"),
        size.cast("long").alias("n_turns"),
        F.size("blocks").cast("long").alias("n_blocks"),
        F.aggregate("pieces", empty, step)["spans"].alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, both parsed from the string and its spans alone."""
    body = F.substring(F.col("formatted"), F.lit(1), F.length("formatted") - len(CLOSE))
    blocks = F.split(body, f"\\Q{CLOSE}\\E")

    def turns_of(block: Column) -> Column:
        inner = F.substring(block, F.lit(len(OPEN) + 1), F.length(block))
        role = F.substring_index(inner, HEAD, 1)
        texts = F.split(F.substring(inner, F.length(role) + len(HEAD) + 1, F.length(inner)), f"\\Q{NEXT}\\E")
        return F.transform(texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    masked = F.transform(
        "loss_spans",
        lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns_of))).withColumn(
        "loss_text", F.array_join(masked, "")
    )
