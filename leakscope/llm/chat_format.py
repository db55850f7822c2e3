r"""Chat formatting with a grammar round trip.

A turn is written as START role LF text END LF. Control strings inside a text are escaped by
one more backslash between `<` and `|` (`<|` to `<\|`, `<\|` to `<\\|`, and so on), which the
parser takes back; role names also escape backslash and line feed. A turn is first written as
it is; the parser reads it back, and only if it does not find the same turn the next, more
careful way of writing is taken. The formatted conversation is parsed again as a whole and
compared with its source. DataFrame functions only; the rows of a conversation meet once, in
the row that holds its formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Role whose texts are trained on.
TRAINED = "assistant"
TURN = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def render(role: Column, text: Column, level: int) -> Column:
    """One turn: as it is (0), with its text escaped (1), with its role escaped as well (2)."""
    return F.concat(F.lit(START), escape_role(role) if level > 1 else role, F.lit("\n"),
                    escape(text) if level else text, F.lit(END + "\n"))


def pieces(formatted: Column) -> Column:
    """The written turns without their START, in order."""
    return F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p, i: i > 0)


def body(piece: Column) -> Column:
    """What stands between the line feed after the role and the END, still escaped; null if the
    piece does not end as a turn must, or holds another control string."""
    head = F.char_length(F.substring_index(piece, "\n", 1)) + 1
    bare = F.substr(piece, F.lit(1), F.char_length(piece) - len(END) - 1)
    right = F.endswith(piece, F.lit(END + "\n")) & ~F.contains(bare, F.lit("<|"))
    return F.when(right, F.substr(bare, head + 1))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text); a text is null where the
    grammar is not kept."""
    return F.transform(pieces(formatted), lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(body(p)).alias("text")))


def format_turns(turns: DataFrame) -> DataFrame:
    """`turns` with `written`: each turn in the first way of writing that the parser reads back."""
    source = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    out = turns
    for level in (0, 1, 2):
        out = out.withColumn(f"w{level}", render(F.col("role"), F.col("text"), level))
    same = lambda c: parse(F.col(c)).eqNullSafe(source)
    return out.withColumn("written", F.when(same("w0"), F.col("w0")).when(same("w1"), F.col("w1")).otherwise(F.col("w2"))).drop("w0", "w1", "w2")


def format_conversations(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """conv_id, formatted, mask, identical for every conversation.

    `conversations` has conv_id, turn, role, text. Rows are taken by turn (null first; equal
    turns by role, then text; repeated rows all count). Null role or text: empty. Rows without
    conv_id are one conversation. `mask` has, for each turn in order, (start, loss_start,
    loss_end) in code points of `formatted`: from where it stands and what of it is trained on
    (an empty range for other roles). `identical`: parsing `formatted` gives the source turns.
    An empty table gives no rows; other columns are not looked at.
    """
    turns = format_turns(conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    piece = F.expr(f"substr(written, {len(START) + 1})")
    placed = (turns.withColumn("length", F.char_length("written")).withColumn("inner", F.char_length(body(piece)))
              .withColumn("at", F.row_number().over(order))
              .withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0))))
    end = F.col("start") + F.col("length") - len(END) - 1
    span = F.struct(F.col("start").cast("long").alias("start"),
                    F.when(F.col("role") == trained, end - F.col("inner")).otherwise(F.col("start")).cast("long").alias("loss_start"),
                    F.when(F.col("role") == trained, end).otherwise(F.col("start")).cast("long").alias("loss_end"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("at", "written", span.alias("span"), F.struct("role", "text").alias("source")))).alias("t"))
    made = whole.select("conv_id", F.array_join(F.col("t.written"), "").alias("formatted"),
                        F.col("t.span").alias("mask"), F.col("t.source").alias("source"))
    return made.select("conv_id", "formatted", "mask", parse(F.col("formatted")).eqNullSafe(F.col("source")).alias("identical"))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order. Spans are read from their own turn's piece,
    so that a long conversation is walked once."""
    cut = F.zip_with(pieces(formatted), mask, lambda p, m: F.substr(
        p, (m["loss_start"] - m["start"] - len(START) + 1).cast("int"), (m["loss_end"] - m["loss_start"]).cast("int")))
    empty = F.zip_with(cut, mask, lambda c, m: F.when(m["loss_end"] > m["loss_start"], unescape(c)).otherwise(F.lit("")))
    return F.array_join(empty, "")
