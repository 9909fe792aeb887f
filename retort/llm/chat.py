"""Chat formatting in Spark expressions: one string a conversation, reversible, with the spans that bear loss.

Turns of a conversation are collected as structs, sorted, and adjacent turns of one role merged into a block by
array aggregation. The template is

    <s>[ROLE user]text[NEXT]text[/ROLE]<s>[ROLE assistant]text[/ROLE]</s>

Every control string begins with ``<`` or ``[``. In texts and roles the backslash, ``<`` and ``[`` are written as a backslash
and ``b``, ``l`` or ``k``, so no text can spell a control string and the texts can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT, HEAD, FINISH = "<s>[ROLE ", "[/ROLE]", "[NEXT]", "]", "</s>"
#: Role whose texts bear loss.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\k"))


def unescape(text: Column) -> Column:
    # each backslash begins one of three pairs, and the first two don't make a backslash
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\k"), F.lit("["))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _role_head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("]"), F.lit("\\r")), F.lit(HEAD))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, n_blocks) from rows (conv_id, turn, role, text).

    loss_spans are (start from 0, length) in code points of ``formatted``, one for each learned text. Null text and
    role count as empty. Rows of one turn number are put in order of role and text, nulls first; repeated rows are
    repeated turns. Rows without a conversation id form a conversation of their own. One conversation is one
    string, so its turns meet in one task.
    """
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("row"),
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    count = F.size("rows")
    # a row's strings carry the control strings around it, so that merging is one pass and not a growing array
    pieces = F.transform(
        "rows",
        lambda row, i: F.struct(
            F.when((i > 0) & (F.get(F.col("rows"), i - 1)["role"] == row["role"]), F.lit(NEXT)).otherwise(_role_head(row["role"])).alias("before"),
            escape(row["text"]).alias("body"),
            F.when((i < count - 1) & (F.get(F.col("rows"), i + 1)["role"] == row["role"]), F.lit("")).otherwise(F.lit(CLOSE)).alias("after"),
            (row["role"] == LEARNED).alias("learned"),
        ),
    )
    laid = gathered.withColumn("pieces", pieces)
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,learned:boolean>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"])).alias("at"),
            F.array_append(acc["spans"], F.struct((acc["at"] + F.length(p["before"])).alias("start"), F.length(p["body"]).alias("length"), p["learned"].alias("learned"))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), ""), F.lit(FINISH))
    return laid.select(
        "conv_id",
        formatted.alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
        F.size(F.filter("pieces", lambda p: p["before"] != NEXT)).alias("n_blocks"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role and text, as they went in) and loss_text to rows (formatted, loss_spans)."""
    body = F.replace(F.col("formatted"), F.lit(FINISH), F.lit(""))
    blocks = F.filter(F.split(body, "<s>\\[ROLE "), lambda b: b != "")
    parts = F.transform(
        blocks,
        lambda b: F.struct(
            F.substring_index(b, HEAD, 1).alias("role"),
            F.split(F.replace(F.substring(b, F.length(F.substring_index(b, HEAD, 1)) + 2, F.length(b)), F.lit(CLOSE), F.lit("")), "\\[NEXT\\]").alias("texts"),
        ),
    )
    turns = F.flatten(
        F.transform(
            parts,
            lambda b: F.transform(b["texts"], lambda t: F.struct(unescape(F.replace(b["role"], F.lit("\\r"), F.lit("]"))).alias("role"), unescape(t).alias("text"))),
        )
    )
    learned = F.array_join(F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["length"])), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", unescape(learned))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row a conversation, read back from its formatted string: counts and SHA-256 digests of turns and learned text."""
    back = read_back(format_conversations(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("n_blocks").cast("long").alias("n_blocks"),
    )
