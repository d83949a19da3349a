r"""Chat formatting with a round trip: a rendered conversation parses back to exactly its turns.

Grammar of a rendered conversation, read from the left:

    conversation := turn*
    turn         := "### " role ": " text "</turn>\n"

Inside a text a control string (``### `` or ``</turn>``) gets one more backslash than it has behind its first character, so
``</turn>`` is written ``<\/turn>`` and ``<\/turn>`` is written ``<\\/turn>``; no control string is left in a text, and taking
one backslash away gives the text back. Roles are percent-encoded where they hold one of ``% : < #`` or a line end.

A conversation is first rendered as it is and parsed. Where the parse differs from the source, or a text holds a control string,
it is rendered again with those texts escaped and parsed again; ``identical`` tells that the last parse equals the source.

Rows: a null text or role counts as empty; a null turn number sorts first; turns with equal numbers, and repeated rows, are all kept,
ordered by role and text; null conversation ids together are one conversation; an empty table gives no rows; extra columns are
ignored. A conversation is one value, so its length is bounded by what one value of a column can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "### ", "</turn>"
# Characters of a role that would be read as grammar, and how each is written. The first must stay first.
ROLE_CODES = {"%": "%25", ":": "%3A", "\n": "%0A", "<": "%3C", "#": "%23"}
# A control string with the backslashes behind its first character, and what stands before and after them.
CONTROLS = [("#", "## "), ("<", "/turn>")]


def escape(text: Column) -> Column:
    for head, tail in CONTROLS:
        text = F.regexp_replace(text, rf"{head}(\\*){tail}", rf"{head}\\$1{tail}")
    return text


def unescape(text: Column) -> Column:
    for head, tail in CONTROLS:
        text = F.regexp_replace(text, rf"{head}\\(\\*){tail}", rf"{head}$1{tail}")
    return text


def role_name(role: Column) -> Column:
    for mark, code in ROLE_CODES.items():
        role = F.replace(role, F.lit(mark), F.lit(code))
    return role


def role_from(name: Column) -> Column:
    for mark, code in reversed(ROLE_CODES.items()):
        name = F.replace(name, F.lit(code), F.lit(mark))
    return name


def has_conflict(text: Column) -> Column:
    """Whether a text, left as it is, would read back as something else or holds a control string."""
    return text.rlike("|".join(rf"{head}\\*{tail}" for head, tail in CONTROLS))


def render(turns: Column, escaped: bool) -> Column:
    """The text of a conversation from its ordered array of (role, text)."""
    def one(t: Column) -> Column:
        body = F.when(has_conflict(t["text"]), escape(t["text"])).otherwise(t["text"]) if escaped else t["text"]
        return F.concat(F.lit(OPEN), role_name(t["role"]), F.lit(": "), body, F.lit(CLOSE + "\n"))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a rendered conversation: cut at the closing marks, then at the first colon of each."""
    pieces = F.split(formatted, CLOSE + "\n")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(piece: Column) -> Column:
        head = F.substring_index(piece, ": ", 1)
        return F.struct(role_from(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
                        unescape(F.substr(piece, F.length(head) + 3)).alias("text"))
    return F.transform(turns, one)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): the rendered text, the turns read back from it, the text
    under the loss mask and whether the turns read back equal the source."""
    blank = F.lit("")
    rows = turns.select(F.col("conv_id"), F.struct(F.col("turn").alias("turn"), F.coalesce("role", blank).alias("role"),
                                                   F.coalesce("text", blank).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    convs = convs.withColumn("plain", render(F.col("source"), False))
    clean = ~F.exists("source", lambda t: has_conflict(t["text"])) & (parse(F.col("plain")) == F.col("source"))
    convs = convs.withColumn("formatted", F.when(clean, F.col("plain")).otherwise(render(F.col("source"), True)))
    convs = convs.withColumn("read_back", parse(F.col("formatted")))
    return convs.select(
        "conv_id", "formatted", "read_back",
        F.array_join(F.transform(F.filter("read_back", lambda t: t["role"] == loss_role), lambda t: t["text"]), "").alias("loss_text"),
        (F.col("read_back") == F.col("source")).alias("identical"))


def digests(convs: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations."""
    lines = F.array_join(F.transform("read_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select(
        "conv_id", F.size("read_back").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "identical")
