"""Chat formatting with typed content parts; DataFrame functions only.

A message has a role and parts ``struct<type, text, uri, amount>``. A visitor over the parts turns
text into escaped text and every image, audio and document part into an ordered placeholder; the
attachment's ordinal, type, reference and expanded token count are recorded beside the text.

Template: ``<turn>`` role newline content ``</turn>`` newline, placeholders ``<part image 1>``.
Escape: in content and roles, a control string ``<turn>``, ``</turn>`` or ``<part `` gets a backslash
after its ``<``, and one that already has backslashes there gets one more, so that unescaping takes
exactly one away. A line break in a role is written ``<line>``, a control string of roles alone that is
escaped in the same way. Other text, control strings of other templates included, stays as it is.

A conversation becomes one row, so its text has to fit a task; running lengths come from a window
and turns are put together in one grouped step on the same partitioning.

Defined results. A null role, text or list of parts is empty. Turns are ordered by turn, null first, then by
role and parts, texts by their bytes. A null conv_id is a conversation of its own. Repeated rows are
turns of their own. Extra columns, whatever their names, are ignored; an empty table gives no row. The loss mask covers the content of ``assistant`` turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
_CONTROL = r"<(\\*)(/?turn>|part )"
_ESCAPED = r"<\\(\\*)(/?turn>|part )"
LINE = "<line>"
_ROLE_CONTROL, _ROLE_ESCAPED = _CONTROL.replace("|part ", "|part |line>"), _ESCAPED.replace("|part ", "|part |line>")
#: Tokens that a unit of an attachment expands to: an image tile, a second of audio, a document page.
EXPANSION = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,uri:string,amount:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"<$1$2")


def escape_role(role: Column) -> Column:
    """A role in one line."""
    return F.replace(F.regexp_replace(role, _ROLE_CONTROL, r"<\\$1$2"), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit(LINE), F.lit("\n")), _ROLE_ESCAPED, r"<$1$2")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("bigint").alias("amount")))


def expanded(part: Column) -> Column:
    """Tokens that an attachment stands for."""
    each = F.lit(0)
    for kind, tokens in EXPANSION.items():
        each = F.when(part["type"] == kind, tokens).otherwise(each)
    return (each * F.coalesce(part["amount"], F.lit(1))).cast("bigint")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"] == "text", F.lit(True))


def flatten(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to one row per turn: content, attachments, first ordinal.

    Ordinals count the attachments of a conversation in order of turns and parts.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "parts"]
    none = F.array().cast(messages.schema["parts"].dataType)
    keyed = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", none).alias("parts"))
    files = F.filter("parts", lambda p: ~_is_text(p))
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = keyed.withColumn("_before", F.coalesce(F.sum(F.size(files)).over(before), F.lit(0)))
    number = lambda i: F.col("_before") + F.size(F.filter(F.slice("parts", 1, i + 1), lambda q: ~_is_text(q)))
    content = F.array_join(F.transform("parts", lambda p, i: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit(""))))
                                       .otherwise(F.concat(F.lit("<part "), p["type"], F.lit(" "), number(i).cast("string"), F.lit(">")))), "")
    attached = F.transform(files, lambda p, i: F.struct((F.col("_before") + i + 1).alias("ordinal"), p["type"].alias("type"), p["uri"].alias("uri"), expanded(p).alias("tokens")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    return seen.select("conv_id", place.alias("place"), escape_role(F.col("role")).alias("role"),
                       (F.col("role") == "assistant").alias("learned"), content.alias("content"), attached.alias("attachments"))


def format_chats(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in code points), attachments, expanded_tokens."""
    turns = flatten(messages)
    head = F.concat(F.lit(OPEN), "role", F.lit("\n"))
    piece = F.concat(head, "content", F.lit(CLOSE))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(piece)).over(before), F.lit(0)) + F.length(head)
    cut = turns.select("conv_id", "place", piece.alias("piece"), "attachments",
                       F.when(F.col("learned"), F.struct(start.alias("start"), F.length("content").cast("bigint").alias("length"))).alias("span"))
    rows = cut.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "span", "attachments"))).alias("turns"))
    attachments = F.flatten(F.col("turns.attachments"))
    return rows.select("conv_id", F.array_join(F.col("turns.piece"), "").alias("formatted"),
                       F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"), attachments.alias("attachments"),
                       F.aggregate(attachments, F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """The turns (role, text) and the learned texts of formatted chats, unescaped."""
    pieces = F.filter(F.split("formatted", r"</turn>\n", -1), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substring(p, len(OPEN) + 1, 1 << 30))
    turns = F.transform(body, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
                                                 unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")))
    learned = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return chats.select("conv_id", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("bigint").alias("formatted_chars"),
                        "attachments", "expanded_tokens")
