"""Chat formatting with DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, PART = "</turn>\n", "<part/>"
PARTS = 256  # turns whose spans are summed up in one go


def escaped(c: Column) -> Column:
    """No '<' is left in an escaped text, so it cannot hold a marker; '%' escapes itself."""
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C"))


def unescaped(c: Column) -> Column:
    """Undo :func:`escaped`: every '%' in an escaped text starts an escape, so the order is safe."""
    return F.replace(F.replace(c, F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    Turns are sorted by (turn, role, text). Neighbours of one role are merged into one block
    ``<turn ROLE>text<part/>text</turn>\\n``; texts and roles are escaped, so the string reads
    back exactly. ``loss_spans`` are (start, chars) of the assistant texts, 0-based code points.

    A null text or role counts as empty; a null turn sorts first; rows without a conv_id form
    one conversation with a null id; repeated rows are kept; other columns are ignored; an
    empty table gives no rows.
    """
    rows = conversations.select(
        "conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def piece(t: Column, i: Column) -> Column:
        ts = F.col("ts")
        before, after = F.get(ts, i - 1)["role"], F.get(ts, i + 1)["role"]
        head = F.when(before.eqNullSafe(t["role"]), F.lit("")).otherwise(
            F.concat(F.lit("<turn "), F.replace(escaped(t["role"]), F.lit(">"), F.lit("%3E")), F.lit(">")))
        tail = F.when(after.eqNullSafe(t["role"]), F.lit(PART)).otherwise(F.lit(END))
        return F.struct(head.alias("head"), escaped(t["text"]).alias("body"), tail.alias("tail"), (t["role"] == "assistant").alias("loss"))

    chats = chats.select("conv_id", F.transform("ts", piece).alias("ps"))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["head"])
        own = F.struct(at.alias("start"), F.length(p["body"]).alias("chars"))
        return F.struct(
            (at + F.length(p["body"]) + F.length(p["tail"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"]).alias("spans"))

    def chain(acc: Column, part: Column) -> Column:
        own = F.transform(part["spans"], lambda s: F.struct((acc["at"] + s["start"]).alias("start"), s["chars"].alias("chars")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["spans"], F.array(own)).alias("spans"))

    # an array that grows turn by turn costs the square of its length, so a long conversation is taken in parts
    numbers = F.sequence(F.lit(0), F.floor((F.size("ps") - 1) / PARTS).cast("int"))
    parts = F.transform(numbers, lambda k: F.aggregate(F.slice("ps", k * PARTS + 1, F.lit(PARTS)), start, step))
    none = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<array<struct<start:int,chars:int>>>").alias("spans"))
    return chats.select("conv_id", "ps", parts.alias("parts")).select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.flatten(F.aggregate("parts", none, chain)["spans"]).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse :func:`format_chats` output: conv_id, turns array<struct<role, text>>, loss_text, formatted_chars."""
    blocks = F.filter(F.split("formatted", END), lambda b: F.length(b) > 0)

    def turns(b: Column) -> Column:
        close = F.position(F.lit(">"), b)
        role = unescaped(F.replace(F.substring(b, F.lit(7), close - 7), F.lit("%3E"), F.lit(">")))
        body = F.substring(b, close + 1, F.length(b))
        return F.transform(F.split(body, PART), lambda p: F.struct(role.alias("role"), unescaped(p).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["chars"])))
    return formatted.select(
        "conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(loss, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"))
