"""Chat formatting with typed content parts.

A turn's content is an array of parts of type text, image, audio or document. The visitor goes through the parts in
order: text is escaped, any other part becomes a numbered placeholder, and its reference and its expanded token count
are recorded. A text part that begins with ``|`` and is not a turn's first part gets a ``\\`` before it, so that parts which
are harmless alone cannot make a control string together. The template marks turns with three control strings, all of which begin with ``<|``; inside texts and
roles ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so ``<|`` stands in the output only where the template put it,
and dropping each ``\\`` that stands before another character gives the text back.

Defined results: a null text is an empty one, a null role an empty role, a null or empty list of parts an empty turn;
turns of one conversation with equal numbers go by role, then text, and repeated turns stay; a null conversation id is
one conversation, a null turn number comes first; a part of an unknown or null type is a placeholder ``other`` with no
tokens; a part without its measure has no tokens. A conversation is one row of output, as long as its turns together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_PER_SECOND, PAGE_TOKENS = 14, 25, 256
KINDS = ("image", "audio", "document")
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A list with one text part."""
    empty = {name: F.lit(None).cast(kind) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(c.alias(n) for n, c in empty.items())))


def kind_of(part: Column) -> Column:
    kind = F.coalesce(part["type"], F.lit("other"))
    return F.when(kind.isin("text", *KINDS), kind).otherwise("other")


def expanded_tokens(part: Column) -> Column:
    """Tokens that take the placeholder's place in the model: patches, audio frames or pages."""
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    kind = kind_of(part)
    count = (
        F.when(kind == "image", patches)
        .when(kind == "audio", F.ceil(part["seconds"] * AUDIO_PER_SECOND))
        .when(kind == "document", part["pages"].cast("long") * PAGE_TOKENS)
    )
    return F.coalesce(count.cast("long"), F.lit(0))


def visit(parts: Column) -> tuple[Column, Column]:
    """Of a list of parts: the flattened text, and the attachments (place, kind, ref, tokens) in order."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>"))

    def flatten(part: Column, place: Column) -> Column:
        kind = kind_of(part)
        mark = F.concat(F.lit("<|"), kind, F.lit(":"), place.cast("string"), F.lit("|>"))
        body = escape(part["text"])
        # the part before may end in "<"
        body = F.when((place > 0) & F.startswith(body, F.lit("|")), F.concat(F.lit("\\"), body)).otherwise(body)
        return F.when(kind == "text", body).otherwise(mark)

    def record(part: Column, place: Column) -> Column:
        return F.struct(place.alias("place"), kind_of(part).alias("kind"), part["ref"].alias("ref"), expanded_tokens(part).alias("tokens"))

    attachments = F.filter(F.transform(parts, record), lambda a: a["kind"] != "text")
    return F.array_join(F.transform(parts, flatten), ""), attachments


def format_conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learned: str = LEARNED_ROLE
) -> DataFrame:
    """One row per conversation: formatted, loss_spans (start and length in UTF-8 bytes), attachments, n_turns."""
    content, attachments = visit(F.col(f"`{parts}`"))
    role_name = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    marked = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        role_name.alias("role"),
        F.concat(F.lit(TURN), escape(role_name), F.lit(TEXT)).alias("head"),
        content.alias("content"),
        attachments.alias("attachments"),
    )
    place = "partition by conv_id order by turn, role, content rows unbounded preceding"
    laid = marked.selectExpr(
        "*",
        f"row_number() over ({place}) as nth",
        f"sum(octet_length(head) + octet_length(content) + {len(END)}) over ({place}) - octet_length(content) - {len(END)} as start",
    )
    gathered = laid.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "start", "role", "head", "content", "attachments"))).alias("t"))
    learned_turns = F.filter("t", lambda x: x["role"] == learned)
    return gathered.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["content"], F.lit(END))), "").alias("formatted"),
        F.transform(learned_turns, lambda x: F.struct(x["start"].alias("start"), F.octet_length(x["content"]).cast("long").alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: F.transform(x["attachments"], lambda a: a.withField("turn", x["nth"] - 1)))).alias("attachments"),
    )


def read_parts(content: Column) -> Column:
    """The parts of one turn's formatted content: (type, place or null, text or null)."""

    def piece(text: Column, i: Column) -> Column:
        mark = F.substring_index(text, "|>", 1)
        rest = F.when(i == 0, text).otherwise(F.substr(text, F.length(mark) + 3))
        body = F.struct(F.lit("text").alias("type"), F.lit(None).cast("int").alias("place"), unescape(rest).alias("text"))
        placed = F.struct(F.substring_index(mark, ":", 1).alias("type"), F.substring_index(mark, ":", -1).cast("int").alias("place"), F.lit(None).cast("string").alias("text"))
        return F.filter(F.array(F.when(i > 0, placed), F.when(F.length(rest) > 0, body)), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.split(content, r"<\|", -1), piece))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, parts)."""

    def turn(text: Column) -> Column:
        role = F.substring_index(text, TEXT, 1)
        content = F.substr(text, F.length(role) + len(TEXT) + 1)
        content = F.substr(content, F.lit(1), F.length(content) - len(END))
        return F.struct(unescape(role).alias("role"), read_parts(content).alias("parts"))

    pieces = F.split(formatted, r"<\|turn\|>", -1)
    return F.transform(F.slice(pieces, 2, F.size(pieces)), turn)


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, without placeholders."""
    data = F.encode(formatted, "UTF-8")

    def under(span: Column) -> Column:
        content = F.decode(F.substr(data, (span["start"] + 1).cast("int"), span["length"].cast("int")), "UTF-8")
        return F.array_join(F.transform(read_parts(content), lambda p: F.coalesce(p["text"], F.lit(""))), "")

    return F.array_join(F.transform(loss_spans, under), "")
