"""Operator 3 [native]: chat formatting of typed content parts.

A turn's content is an array of parts (type, value, ref, tokens).  A visitor flattens them
in order: text is escaped; image, audio and document parts become placeholders with their
place among the turn's attachments (`<|image:0|>`), and their references and expanded token
counts (`tokens` of the part, or DEFAULT_TOKENS of its type) are recorded.  Template, turn
by turn: `<|role|>content</s>`.

Escape: each of < [ | \\ in a text is followed by a backslash, so neither template marks
nor control strings of other templates (`</s>`, `[INST]`, `<|...|>`) occur inside texts;
unescape() takes the backslashes out again and is exact for every text.  A placeholder is
not escaped, so read_back() never takes a text for one: it gives the parts in order, and
as a turn's text its text parts alone.

Turns are rendered row by row before they meet; a conversation is one row of the result,
so its rendered turns meet in one task by definition.  Turns come in order of turn, then
role, then content (nulls first).

Defined cases: null text counts as empty, null role as ''; an unknown part type is taken
as text, null parts are none; negative or null token counts stand for the type's; repeated rows are repeated turns; rows with null conv_id form one conversation;
columns beside conv_id, turn, role and the content are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, scan

DEFAULT_TOKENS = {"image": 576, "audio": 300, "document": 1024}
END = "</s>"
PLACEHOLDER = rf"<\|(?:{'|'.join(DEFAULT_TOKENS)}):\d+\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[|\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[|\\])\\", "$1")


def text_part(text: Column) -> Column:
    """The content of a plain text turn."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("value"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")
    ))


def _visit(parts: Column) -> Column:
    """content string, attachments array and expanded tokens of a turn's parts."""
    media = lambda x: F.coalesce(x["type"].isin(*DEFAULT_TOKENS), F.lit(False))
    cost = lambda x: F.coalesce(F.when(x["tokens"] >= 0, x["tokens"]), *[F.when(x["type"] == k, F.lit(v)) for k, v in DEFAULT_TOKENS.items()])

    def flat(own: Column) -> Column:
        places = scan(F.transform(own, lambda x: media(x).cast("int")), F.lit(0), lambda a, b: a + b)
        mark = lambda x, i: F.concat(F.lit("<|"), x["type"], F.lit(":"), i.cast("string"), F.lit("|>"))
        content = F.array_join(F.zip_with(own, places, lambda x, i: F.when(media(x), mark(x, i)).otherwise(escape(x["value"]))), "")
        facts = F.transform(F.filter(own, media), lambda x, i: F.struct(x["type"].alias("type"), x["ref"].alias("ref"), cost(x).alias("tokens"), i.alias("place")))
        return F.struct(content.alias("content"), facts.alias("attachments"))

    return let(F.filter(parts, lambda x: x.isNotNull()), flat)


def format_chats(turns: DataFrame, parts: str = "parts", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss, attachments, attached_tokens), one row per conversation.

    loss has a span (s, e) of code points per turn, end exclusive, empty where the turn
    bears no loss; attachments carry turn number (from 0) and place within the turn.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    row = turns.select("conv_id", "turn", role.alias("role"), _visit(F.coalesce(F.col(parts), F.array())).alias("v"))
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>"))
    row = row.select("conv_id", F.struct(
        "turn", "role", F.concat(head, "v.content", F.lit(END)).alias("text"),
        F.char_length(head).alias("head"), F.char_length("v.content").alias("body"), F.col("v.attachments").alias("attachments"),
    ).alias("t"))
    chat = row.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    starts = scan(F.transform("t", lambda t: t["head"] + t["body"] + len(END)), F.lit(0), lambda a, x: a + x)
    span = lambda t, s: F.struct(
        (s + t["head"]).alias("s"), (s + t["head"] + F.when(t["role"].isin(*loss_roles), t["body"]).otherwise(0)).alias("e")
    )
    attached = F.flatten(F.transform("t", lambda t, i: F.transform(t["attachments"], lambda x: F.struct(
        i.alias("turn"), x["place"].alias("place"), x["type"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens")
    ))))
    return chat.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["text"]), "").alias("formatted"),
        F.zip_with("t", starts, span).alias("loss"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attached_tokens"),
    )


def _parts(content: Column) -> Column:
    """Parts of a turn's content in order: texts unescaped, and placeholders by type and place."""
    texts, marks = F.split(content, PLACEHOLDER, -1), F.regexp_extract_all(content, F.lit(f"({PLACEHOLDER})"), 1)
    part = lambda kind, value, place: F.struct(kind.alias("type"), value.alias("value"), place.alias("place"))
    null = F.lit(None)
    said = lambda t: part(F.lit("text"), unescape(t), null.cast("int"))
    meant = lambda m: part(F.regexp_extract(m, r"^<\|(\w+):", 1), null.cast("string"), F.regexp_extract(m, r":(\d+)", 1).cast("int"))
    both = F.flatten(F.zip_with(texts, marks, lambda t, m: F.when(m.isNull(), F.array(said(t))).otherwise(F.array(said(t), meant(m)))))
    return F.filter(both, lambda x: (x["type"] != "text") | (x["value"] != ""))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<role, text, parts>, loss_text) from formatted texts and spans."""
    pieces = F.split("formatted", END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    said = lambda x: unescape(F.regexp_replace(x, PLACEHOLDER, ""))

    def parse(c: Column) -> Column:
        starts = scan(F.transform(c, lambda x: F.char_length(x) + len(END)), F.lit(0), lambda a, x: a + x)
        body = lambda x: F.regexp_extract(x, r"(?s)^<\|.*?\|>(.*)$", 1)
        read = F.transform(c, lambda x: F.struct(
            unescape(F.regexp_extract(x, r"(?s)^<\|(.*?)\|>", 1)).alias("role"), said(body(x)).alias("text"), _parts(body(x)).alias("parts"),
        ))
        # Of each piece the part under its span: positions are within the piece, so linear in all.
        shifted = F.zip_with("loss", starts, lambda l, s: F.struct((l["s"] - s).alias("s"), (l["e"] - l["s"]).alias("n")))
        under = F.zip_with(c, shifted, lambda x, l: said(x.substr(l["s"] + 1, l["n"])))
        return F.struct(read.alias("turns"), F.array_join(under, "").alias("loss_text"))

    return chats.withColumn("\x01r", let(pieces, parse)).select("conv_id", "formatted", "\x01r.turns", "\x01r.loss_text")
