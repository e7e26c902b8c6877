"""Chat formatting with a grammar round trip, in built-in functions only.

Grammar of the output, read by a deterministic parser::

    conversation := "<s>" turn* "</s>"
    turn         := "[INST" mark ":" role "]" text "[/INST]"
    mark         := "" (the text is raw) | "+" (the text is escaped)

A turn is first rendered raw and parsed again.  If the parser does not give back the very turn
(some control string stands in its text), the turn is rendered escaped; escaped text holds no
"<" and no "[", so no control string can begin in it, and parsing it is the identity.  Then the whole
conversation is parsed and compared to its source; ``identical`` tells the outcome.

Escapes: ``\\s`` for the backslash, ``\\l`` for "<", ``\\b`` for "[", and in roles ``\\r`` for "]".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, TURN, END = "<s>", "</s>", "[INST", "[/INST]"
#: Strings that mark structure here or in other common chat templates; none may stand in a raw text.
CONTROL = (OPEN, CLOSE, TURN, END, "<<SYS>>", "<</SYS>>", "<|")
_PIECE = r"(?s)^\[INST(\+?):([^\]]*)\](.*)$"


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\s"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("\\", "\\s"), ("[", "\\b"), ("<", "\\l"))[::-1]:
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("]"), F.lit("\\r"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\r"), F.lit("]")))


def render_turn(role: Column, text: Column, escaped: Column) -> tuple[Column, Column, Column]:
    """Head, body and tail of a turn."""
    head = F.concat(F.lit(TURN), F.when(escaped, F.lit("+")).otherwise(F.lit("")), F.lit(":"), _escape_role(role), F.lit("]"))
    return head, F.when(escaped, escape(text)).otherwise(text), F.lit(END)


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text); null if it isn't one.

    A raw text that holds a control string is no text of the grammar, and its conversation parses to null.
    """
    pieces = F.split(formatted, r"\[/INST\]", -1)
    n = F.size(pieces)
    first = F.get(pieces, F.lit(0))
    good = F.startswith(first, F.lit(OPEN)) & (F.get(pieces, n - 1) == F.when(n == 1, F.lit(OPEN + CLOSE)).otherwise(F.lit(CLOSE)))

    def turn(piece: Column, i: Column) -> Column:
        piece = F.when(i == 0, F.substr(piece, F.lit(len(OPEN) + 1))).otherwise(piece)
        body = F.regexp_extract(piece, _PIECE, 3)
        plus = F.regexp_extract(piece, _PIECE, 1) == "+"
        wrong = ~piece.rlike(_PIECE)
        for c in CONTROL:
            wrong = wrong | body.contains(c)
        return F.when(~wrong, F.struct(_unescape_role(F.regexp_extract(piece, _PIECE, 2)).alias("role"), F.when(plus, unescape(body)).otherwise(body).alias("text")))

    turns = F.transform(F.slice(pieces, F.lit(1), F.greatest(n - 1, F.lit(0))), turn)
    return F.when(good & ~F.exists(turns, lambda t: t.isNull()), turns)


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv, n_turns, source, formatted, loss_mask, turns``.

    ``source`` and ``turns`` are arrays of (role, text), before rendering and parsed back from
    ``formatted``; ``loss_mask`` has (start, length, escaped), in code points of ``formatted``, of every assistant text.

    Turns are ordered by ``turn`` (null first), ties by role and text; repeated rows are turns of
    their own; a null role or text is empty; rows of a null conversation id form one conversation.
    An empty table gives no rows; other columns are not read.  A conversation is one value, so it
    must fit a task, as any text must.
    """
    rows = df.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    alone = F.concat(F.lit(OPEN), *render_turn(F.col("role"), F.col("text"), F.lit(False)), F.lit(CLOSE))
    same = F.col("back").isNotNull() & (F.size("back") == 1) & (F.get("back", F.lit(0))["text"] == F.col("text")) & (F.get("back", F.lit(0))["role"] == F.col("role"))
    rows = rows.withColumn("back", parse(alone)).withColumn("esc", ~F.coalesce(same, F.lit(False))).drop("back")

    head, body, tail = render_turn(F.col("role"), F.col("text"), F.col("esc"))
    by = Window.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), "role", "text")
    rows = rows.select("*", head.alias("head"), body.alias("body"), tail.alias("tail"))
    length = F.char_length("head") + F.char_length("body") + F.char_length("tail")
    before = F.sum(length).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("*", F.row_number().over(by).alias("pos"), (F.lit(len(OPEN)) + F.coalesce(before, F.lit(0)) + F.char_length("head")).alias("start"))
    out = rows.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text", "head", "body", "tail", "start", "esc"))).alias("p"))
    out = out.select(
        "c",
        F.transform("p", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
        F.concat(F.lit(OPEN), F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), ""), F.lit(CLOSE)).alias("formatted"),
        F.transform(
            F.filter("p", lambda x: x["role"] == "assistant"),
            lambda x: F.struct(x["start"].cast("long").alias("start"), F.char_length(x["body"]).cast("long").alias("length"), x["esc"].alias("escaped")),
        ).alias("loss_mask"),
    ).withColumn("turns", parse(F.col("formatted")))
    return out.select(
        F.col("c").alias(conv), F.size("turns").cast("long").alias("n_turns"), "source", "formatted", "turns", "loss_mask",
        F.coalesce(F.col("turns") == F.col("source"), F.lit(False)).alias("identical"),
    )


def loss_text(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between the pieces."""

    def piece(m: Column) -> Column:
        raw = F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int"))
        return F.when(m["escaped"], unescape(raw)).otherwise(raw)

    return F.array_join(F.transform(mask, piece), "")
