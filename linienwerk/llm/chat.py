"""Chat formatting with a grammar round trip.

A turn is rendered as ``### <Role>: <text> </turn>`` and a line end. Control
strings inside a text are escaped by a backslash, but only where the plain
rendering would not be read back as it was: rendered text is parsed again, and
what differs from its source is rendered anew at the next level of escaping.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HEAD, COLON, TAIL = "### ", ": ", " </turn>\n"
#: Escapes, in order, each undone by dropping the backslash that it adds.
ESCAPES = (("\\", "\\\\"), ("#", "\\#"), ("</turn>", "<\\/turn>"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\:"))


def escape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for plain, safe in pairs:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(COLON), text, F.lit(TAIL))


_HEADER = r"(?s)^### ((?:[^\\:]|\\.|:(?! ))*): "


def parse_turn(piece: Column) -> tuple[Column, Column]:
    """Role and text of one rendered turn, unescaped; nulls where it breaks the grammar."""
    head = F.regexp_extract(piece, _HEADER, 0)
    body = F.substr(piece, F.length(head) + 1, F.greatest(F.length(piece) - F.length(head) - len(TAIL), F.lit(0)))
    # within a turn no control string may stand unescaped, and no lone backslash
    bare = F.regexp_replace(body, r"(?s)\\.", "x")
    once = F.length(F.replace(piece, F.lit("</turn>"), F.lit(""))) == F.length(piece) - len("</turn>")
    good = (head != "") & F.endswith(piece, F.lit(TAIL)) & once & ~F.contains(bare, F.lit("###")) & ~F.contains(bare, F.lit("\\"))
    return F.when(good, unescape(F.regexp_extract(piece, _HEADER, 1))), F.when(good, unescape(body))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, turn, role, text) → (conv_id, n_turns, formatted, spans)``, a row per conversation.

    ``spans`` has, for each turn in order, its role as parsed, the place and
    length in ``formatted`` of its text in code points (place from 1), and
    whether it is under the loss mask. Turns are in the order of turn, role,
    text, nulls first; equal rows are turns of their own; a null role or text
    is empty; rows with a null conv_id are one conversation. Other columns are
    ignored; an empty table gives no rows. Raises where even escaped text isn't
    read back as it was.
    """
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = render(F.col("role"), F.col("text"))
    # a text without any character of the grammar is read back as it is; the others are parsed
    t = t.withColumn("plain", plain)
    role, text = parse_turn(F.col("plain"))
    same = F.coalesce((role == F.col("role")) & (text == F.col("text")), F.lit(False))
    suspect = F.contains(F.col("plain"), F.lit("\\")) | F.contains(F.col("text"), F.lit("###")) | F.contains(F.col("text"), F.lit("</turn>")) | F.contains(F.col("role"), F.lit("###")) | F.contains(F.col("role"), F.lit("</turn>")) | F.contains(F.col("role"), F.lit(": ")) | F.endswith("role", F.lit(":"))
    t = t.withColumn("raw", ~suspect | same)
    t = t.withColumn("r", F.when(F.col("raw"), F.col("role")).otherwise(escape(F.col("role"), ROLE_ESCAPES)))
    t = t.withColumn("x", F.when(F.col("raw"), F.col("text")).otherwise(escape(F.col("text"), ESCAPES))).withColumn("piece", render(F.col("r"), F.col("x")))
    role, text = parse_turn(F.col("piece"))
    back = F.col("raw") | ((role == F.col("role")) & (text == F.col("text")))
    t = t.withColumn("piece", F.when(F.coalesce(back, F.lit(False)), F.col("piece")).otherwise(F.raise_error(F.lit("a turn isn't read back as it was"))))
    # where a turn begins is a running sum, so that a conversation of many turns isn't copied turn by turn
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "piece").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int"))
    turn = F.struct("turn", "role", "text", "piece", "at", (F.length(F.lit(HEAD + COLON)) + F.length("r")).alias("lead"), F.length("x").alias("n"))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    spans = F.transform("t", lambda x: F.struct(x["role"].alias("role"), (x["at"] + x["lead"] + 1).alias("start"), x["n"].alias("length"), (x["role"] == loss_role).alias("loss")))
    return c.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("spans"))


def parse_chat(formatted: Column) -> Column:
    """``formatted → array<struct<role, text>>`` by the grammar alone."""
    pieces = F.filter(F.split(formatted, r"(?<= </turn>\n)"), lambda x: x != "")

    def one(p: Column) -> Column:
        role, text = parse_turn(p)
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(pieces, one)


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, in order. In code of four bytes each a place is found without reading what stands before it."""

    def said(x: Column) -> Column:
        part = lambda s: unescape(F.decode(F.substr(x["code"], s["start"] * 4 - 3, s["length"] * 4), "UTF-32"))
        return F.array_join(F.transform(F.filter(x["spans"], lambda s: s["loss"]), part), "")

    return F.transform(F.array(F.struct(F.encode(formatted, "UTF-32").alias("code"), spans.alias("spans"))), said)[0]
