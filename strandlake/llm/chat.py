"""Chat formatting of typed content parts, in DataFrame functions only.

A turn's content is a list of parts (text, image, audio, document). Flattening visits the parts in order: texts are escaped, other
parts become placeholders, whose references and token counts are recorded in the order in which the placeholders stand.

    <turn:ROLE>
    BODY</turn>

``\\``, ``<`` and ``>`` inside roles and texts are written ``\\b``, ``\\l`` and ``\\g``, so no text holds a control string and every
text can be had back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
#: Tokens that stand in for one unit of a part: an image's tile, a second of audio, a document's page. No units count as one.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 800}
PART = "array<struct<type:string,text:string,ref:string,units:long>>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A content list of one text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))).cast(PART)


def _is_media(p: Column) -> Column:
    return F.coalesce(p["type"].isin(*UNIT_TOKENS), F.lit(False))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row per conversation: its id, n_turns, formatted, loss_mask (start and length in code points of what assistants say, without
    control strings) and attachments (turn, type, ref, tokens, in the order of their placeholders).

    Rows go by turn, then role and text; ties are equal rows. A null text, role or part list is empty; a part of another type than those
    known counts as text. A null conversation id is a conversation. A conversation of any length is one row; an empty table gives none;
    other columns play no part. With ``parts_col`` (an array as ``PART``) the content is read from there.
    """
    parts = F.coalesce(F.col(parts_col).cast(PART), F.array().cast(PART)) if parts_col else text_part(F.col(text_col))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    flat = F.transform("parts", lambda p: F.when(_is_media(p), F.concat(F.lit("<"), p["type"], F.lit("/>"))).otherwise(escape(F.coalesce(p["text"], F.lit("")))))
    tokens = lambda p: F.coalesce(p["units"], F.lit(1).cast("long")) * F.create_map(*[F.lit(x) for kv in UNIT_TOKENS.items() for x in kv])[p["type"]]
    media = F.transform(F.filter("parts", _is_media), lambda p: F.struct(F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).cast("long").alias("tokens")))
    rows = rows.select("conv", "turn", "role", F.array_join(flat, "").alias("body"), media.alias("media"))
    head = F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">\n"))
    rows = rows.withColumns({"head": F.length(head).cast("long"), "piece": F.concat(head, "body", F.lit("</turn>\n"))})

    order = Window.partitionBy("conv").orderBy("turn", "role", "body", F.to_json("media"))
    before = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(before, F.lit(0).cast("long")))
    mask = F.when(F.col("role") == ASSISTANT, F.struct((F.col("at") + F.col("head")).alias("start"), F.length("body").cast("long").alias("length")))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "piece", mask.alias("mask"), "media"))).alias("all"))
    return whole.select(
        F.col("conv").alias(conv_col),
        F.size("all").cast("long").alias("n_turns"),
        F.array_join("all.piece", "").alias("formatted"),
        F.filter("all.mask", lambda m: m.isNotNull()).alias("loss_mask"),
        F.flatten("all.media").alias("attachments"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: role and text (placeholders as they stand in it)."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")
    body = lambda p: F.substr(p, F.instr(p, ">\n") + 2)
    role = lambda p: F.substr(p, F.lit(7), F.instr(p, ">\n") - 7)
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    own = F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return F.array_join(own, "")
