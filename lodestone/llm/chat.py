r"""Chat formatting whose output a grammar reads back to the same turns.

The grammar, read by `parsed` without any choice:

    conversation := "<s>" turn*
    turn         := "[INST]" role "[/INST]" text "</s>"

A role or text holds none of the four control strings. In a conflicting one a
backslash is put after the first sign of each control string, and of each that
already has backslashes there; the reader takes one backslash out. `</s>`
becomes `<\/s>`, `<\/s>` becomes `<\\/s>`, so all texts come back.

`formatted` goes round: each turn is rendered as it is and reparsed; where what
is read differs from the source, the content is escaped and read again, and after
that no turn can differ. The turns are then joined and the conversation is
reparsed as a whole: `identical` tells that this gave the source.

The loss mask is a span for each assistant turn, in code points of the formatted
text, and null for the other turns. A conversation is one training example and so one row: it must fit a
row, as must the string that its digest covers. All work on it is linear in its length.

Only built-in functions run here.

Defined results: turns go by turn number, null first; ties by role and text.
Null roles and texts are empty. Repeated rows are turns of their own. Rows
without a conv_id form the conversation null. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
LOSS_ROLE = "assistant"


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def escaped(text: Column) -> Column:
    """With one backslash more in each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"(\[)(\\*/?INST\])", r"$1\\$2"), r"(<)(\\*/?s>)", r"$1\\$2")


def unescaped(text: Column) -> Column:
    taken = F.regexp_replace(F.regexp_replace(text, r"(\[)\\(\\*/?INST\])", "$1$2"), r"(<)\\(\\*/?s>)", "$1$2")
    return F.when(text.contains("\\"), taken).otherwise(text)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def _plain(text: Column) -> Column:
    """Whether it holds no control string."""
    return ~(text.contains(BEGIN) | text.contains(OPEN) | text.contains(MIDDLE) | text.contains(CLOSE))


def segments(formatted: Column) -> Column:
    """The turns of a formatted conversation as they stand, without their close; null if it is not one."""
    parts = F.split(F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted)), F.lit(CLOSE), F.lit(-1))
    whole = lambda p: formatted.startswith(F.lit(BEGIN)) & (F.element_at(p, -1) == "")
    return bound(parts, lambda p: F.when(whole(p), F.slice(p, F.lit(1), F.size(p) - 1)))


def _turn(segment: Column) -> Column:
    """role and text of a segment, null if the grammar has no such turn."""

    def cut(middle: Column) -> Column:
        role = F.substring(segment, F.lit(len(OPEN) + 1), middle - F.lit(len(OPEN) + 1))
        text = F.substring(segment, middle + F.lit(len(MIDDLE)), F.length(segment))
        valid = segment.startswith(F.lit(OPEN)) & (middle > F.lit(len(OPEN)))
        return F.when(valid, F.struct(role.alias("role"), text.alias("text")))

    def read(turn: Column) -> Column:
        plain = _plain(turn["role"]) & _plain(turn["text"])
        return F.when(plain, F.struct(unescaped(turn["role"]).alias("role"), unescaped(turn["text"]).alias("text")))

    return bound(bound(F.instr(segment, MIDDLE), cut), read)


def parsed(formatted: Column) -> Column:
    """The turns read from a formatted conversation: array<struct<role, text>>, null if the grammar refuses it."""
    refused = lambda turns: F.exists(turns, lambda t: t.isNull())
    return bound(F.transform(segments(formatted), _turn), lambda turns: F.when(~refused(turns), turns))


def survives(role: Column, text: Column, as_role: Column, as_text: Column) -> Column:
    """Whether a turn rendered so is read as the one turn (role, text)."""
    read = parsed(F.concat(F.lit(BEGIN), rendered(as_role, as_text)))
    return F.coalesce(read == F.array(F.struct(role.alias("role"), text.alias("text"))), F.lit(False))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans, n_escaped and identical of each conversation of (conv_id, turn, role, text).

    loss_spans: for each turn null, or struct<at, start, chars>: where the turn
    begins in the formatted text, and where its text under the mask does, of so many code points.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("conflict", ~survives(F.col("role"), F.col("text"), F.col("role"), F.col("text")))
    for made, of in (("said_role", "role"), ("said", "text")):
        rows = rows.withColumn(made, F.when(F.col("conflict"), escaped(F.col(of))).otherwise(F.col(of)))
    width = F.length(rendered(F.col("said_role"), F.col("said")))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.lit(len(BEGIN)).cast("long") + F.coalesce(F.sum(width).over(before), F.lit(0)))
    one = F.struct("at", "role", "text", "said_role", "said", "conflict")
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    source = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    joined = F.concat(F.lit(BEGIN), F.array_join(F.transform("t", lambda t: rendered(t["said_role"], t["said"])), ""))
    convs = convs.withColumn("source", source).withColumn("formatted", joined)
    convs = convs.withColumn("identical", F.coalesce(parsed(F.col("formatted")) == F.col("source"), F.lit(False)))
    head = lambda t: F.length(t["said_role"]) + F.lit(len(OPEN) + len(MIDDLE))
    span = lambda t: F.struct(
        t["at"].alias("at"), (t["at"] + head(t)).alias("start"), F.length(t["said"]).cast("long").alias("chars")
    )
    return convs.select(
        "conv_id",
        "formatted",
        F.transform("t", lambda t: F.when(t["role"] == LOSS_ROLE, span(t))).alias("loss_spans"),
        F.size(F.filter("t", lambda t: t["conflict"])).alias("n_escaped"),
        "identical",
    )


def masked(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped, cut out of the formatted text span by span."""
    cut = lambda turn, s: F.substring(turn, (s["start"] - s["at"] + F.lit(1)).cast("int"), s["chars"].cast("int"))
    said = F.zip_with(segments(formatted), loss_spans, lambda turn, s: bound(cut(turn, s), unescaped))
    return F.array_join(said, "")  # null outside the mask


def digests(done: DataFrame) -> DataFrame:
    """What the formatted text gives back: turns, their digest, and the text under the loss mask."""
    read = done.withColumn("_turns", parsed(F.col("formatted"))).withColumn("_loss", masked(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("n_escaped").cast("long").alias("n_escaped"),
        "identical",
    )
