"""Chat formatting with typed content parts, in DataFrame operations only.

A message holds a list of parts.  A visitor flattens them in order: a text part becomes its
escaped text, an image, audio or document part a placeholder that names its attachment.
Each attachment is recorded with its reference and the number of tokens its placeholder
stands for.  A turn is ``<turn role>``, a line feed, the body, ``</turn>`` and a line feed.

Escaping is reversible and leaves no ``<`` in a body: ``\\`` becomes ``\\b``, then ``<``
becomes ``\\l`` and, in a role, ``>`` becomes ``\\g``; in a part's type ``:`` becomes ``\\c``.  So neither a marker nor a placeholder
can be forged by a text, and what is formatted can be split and read back exactly.

Null texts and roles count as empty.  A message without parts has an empty body.  Turns of
equal number are ordered by role, then by their parts; repeated rows are all kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OPEN, MID, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def text_part(text: Column) -> Column:
    """A message's parts if it is a plain text."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def part_tokens(p: Column, *, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens that an attachment's placeholder expands to: one at least; 0 for a text."""
    side = lambda x: F.ceil(F.coalesce(x, F.lit(patch)) / F.lit(patch))
    return (
        F.when(p.type == "image", F.greatest(F.lit(1), side(p.width) * side(p.height)))
        .when(p.type == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(p.seconds, F.lit(0.0)) * audio_rate)))
        .when(p.type == "document", F.greatest(F.lit(1), F.coalesce(p.pages, F.lit(1)) * page_tokens))
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(p: Column, tokens: Column) -> Column:
    """What stands for a part in the formatted text; a part of unknown type is kept as a placeholder of that type."""
    holder = F.concat(F.lit("<"), F.replace(escape_role(p.type), F.lit(":"), F.lit("\\c")), F.lit(":"), escape_role(p.ref), F.lit(":"), tokens.cast("string"), F.lit(">"))
    return F.when(F.coalesce(p.type, F.lit("text")) == "text", escape(p.text)).otherwise(holder)


def format_chats(
    messages: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    loss_role: str = "assistant",
    patch: int = 14,
    audio_rate: float = 25.0,
    page_tokens: int = 256,
) -> DataFrame:
    """One row a conversation: conv, formatted, loss_spans (code points of the learned bodies, end
    exclusive), attachments (turn_no, part_no, type, ref, tokens) and attachment_tokens.

    A conversation's text is one value, so it is put together in one task; each partition's
    turns of a conversation are gathered before they are shuffled.
    """
    size = lambda p: part_tokens(p, patch=patch, audio_rate=audio_rate, page_tokens=page_tokens)
    listed = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    one = messages.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.array_join(F.transform(listed, lambda p: visit(p, size(p))), "").alias("body"),
            F.transform(listed, lambda p, i: F.struct(i.alias("part_no"), p.type.alias("type"), p.ref.alias("ref"), size(p).alias("tokens"))).alias("parts"),
        ).alias("t"),
    )
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    head = lambda t: F.concat(F.lit(OPEN), escape_role(t.role), F.lit(MID))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(st: Column, t: Column) -> Column:
        begin = st.at + F.length(head(t))
        end = begin + F.length(t.body)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(t.role == loss_role, F.concat(st.spans, span)).otherwise(st.spans).alias("spans"))

    files = F.flatten(F.transform("t", lambda t, i: F.transform(F.filter(t.parts, lambda p: F.coalesce(p.type, F.lit("text")) != "text"), lambda p: F.struct(i.alias("turn_no"), p.part_no.alias("part_no"), p.type.alias("type"), p.ref.alias("ref"), p.tokens.alias("tokens")))))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: F.concat(head(t), t.body, F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("t", start, step, lambda st: st.spans).alias("loss_spans"),
        files.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x.tokens))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda s: s != "")

    def one(piece: Column) -> Column:
        cut = F.instr(piece, MID)
        return F.struct(
            unescape_role(piece.substr(F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"),
            unescape(piece.substr(cut + len(MID), F.length(piece))).alias("text"),
        )

    return F.transform(pieces, one)


def read_parts(body: Column) -> Column:
    """The parts (type, text, ref, tokens) of a formatted body, in order; texts side by side are one, and empty ones none."""
    pieces = F.regexp_extract_all(body, F.lit("<[^>]*+>|[^<]++"), F.lit(0))
    null = lambda kind: F.lit(None).cast(kind)

    def one(piece: Column) -> Column:
        inner = piece.substr(F.lit(2), F.length(piece) - 2)
        kind, tokens = F.substring_index(inner, ":", 1), F.substring_index(inner, ":", -1)
        ref = inner.substr(F.length(kind) + 2, F.length(inner) - F.length(kind) - F.length(tokens) - 2)
        text = F.struct(F.lit("text").alias("type"), unescape(piece).alias("text"), null("string").alias("ref"), F.lit(0).cast("long").alias("tokens"))
        part = F.struct(unescape_role(F.replace(kind, F.lit("\\c"), F.lit(":"))).alias("type"), null("string").alias("text"), unescape_role(ref).alias("ref"), tokens.cast("long").alias("tokens"))
        return F.when(piece.startswith("<"), part).otherwise(text)

    return F.transform(pieces, one)


def read_bodies(formatted: Column) -> Column:
    """The turns (role, body) of a formatted conversation, bodies as formatted."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda s: s != "")

    def one(piece: Column) -> Column:
        cut = F.instr(piece, MID)
        role = unescape_role(piece.substr(F.lit(len(OPEN) + 1), cut - len(OPEN) - 1))
        return F.struct(role.alias("role"), piece.substr(cut + len(MID), F.length(piece)).alias("body"))

    return F.transform(pieces, one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s.start + 1, s.end - s.start))), "")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    chats = format_chats(told.unionByName(extra).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
