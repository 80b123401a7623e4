"""Chat formatting: event logs folded into final messages, rendered with reversible marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Events of one partial fold: a long stream is folded in pieces of so many sequence numbers.
PIECE = 256


def escape(text: Column) -> Column:
    """Puts one more backslash between `<` and `|` wherever only backslashes (or nothing) stand between them.

    No escaped text holds `<|`, so a mark can't be forged, and unescape() gives back every string exactly.
    """
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _fold(items: Column) -> Column:
    """Folds ordered (reset, text) parts: text after and with the last part that resets, and whether one did."""
    n = F.size(items)
    last = F.array_max(F.transform(F.filter(F.transform(items, lambda x, i: F.struct(x["reset"].alias("reset"), i.alias("i"))), lambda x: x["reset"]), lambda x: x["i"]))
    tail = F.when(last.isNull(), items).otherwise(F.slice(items, last + 1, n - last))
    return F.struct(last.isNotNull().alias("reset"), F.array_join(F.transform(tail, lambda x: x["text"]), "").alias("text"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, seq, role, text): final messages of event logs.

    `events`: conv_id, message (any orderable id), seq, role, kind, text. Kinds: `delta` appends its text
    to its message, `edit` replaces the message's text, `regenerate` empties it, `delete` removes the message.
    A message stands where its first event stood. Folding is associative, so a long stream is folded in
    pieces of sequence numbers before its pieces meet, and a hot conversation is not gathered here: only one message's
    events of one piece of sequence numbers are.
    Null texts are empty, other kinds count as delta, null roles are empty; equal seqs are ordered by kind, then text.
    """
    kind = F.coalesce("kind", F.lit("delta"))
    parts = events.select(
        "conv_id", "message", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"),
        kind.isin("edit", "regenerate", "delete").alias("reset"), kind.alias("kind"),
        F.when(kind.isin("regenerate", "delete"), "").otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    )
    pieces = parts.groupBy("conv_id", "message", F.floor(F.col("seq") / PIECE).alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "reset"))).alias("e"), F.min(F.struct("seq", "role")).alias("first")
    )
    pieces = pieces.withColumns({"f": _fold(F.col("e")), "gone": F.element_at("e", -1)["kind"] == "delete"}).drop("e")
    whole = pieces.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(F.struct("piece", F.col("f.reset").alias("reset"), F.col("f.text").alias("text"), "gone"))).alias("e"),
        F.min("first").alias("first"),
    )
    return whole.filter(~F.element_at("e", -1)["gone"]).select(
        "conv_id", "message", F.col("first.seq").alias("seq"), F.col("first.role").alias("role"), _fold(F.col("e"))["text"].alias("text")
    )


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans): one string for each conversation, with the code-point spans under the loss mask.

    A turn is `<|im_start|>role\\ntext<|im_end|>\\n`, role and text escaped (line ends of a role too). Messages of equal
    sequence numbers stand by role, then text. Messages are joined in pieces of their conversation first, so the last step gathers a few long strings, not every message.
    A conversation's text must fit a row, as the result is a row.
    """
    some = messages.groupBy("conv_id", F.floor(F.col("seq") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text", "message"))).alias("e"))

    def shown(x: Column) -> Column:
        role = F.replace(F.replace(escape(x["role"]), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
        return F.struct(F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), x["role"].isin(*trained).alias("loss"))

    some = some.select("conv_id", "piece", F.transform("e", shown).alias("e"))
    some = some.select(
        "conv_id", "piece", F.array_join(F.transform("e", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "").alias("t"),
        F.transform("e", lambda x: F.struct(F.length(x["head"]).alias("h"), F.length(x["body"]).alias("b"), x["loss"].alias("loss"))).alias("p"),
    )
    whole = some.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "t", "p"))).alias("e"))
    whole = whole.select("conv_id", F.array_join(F.transform("e", lambda x: x["t"]), "").alias("formatted"), F.flatten(F.transform("e", lambda x: x["p"])).alias("p"))
    tail = len(END) + 1
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(z: Column, x: Column) -> Column:
        span = F.struct((z["at"] + x["h"]).alias("start"), x["b"].cast("long").alias("length"))
        return F.struct((z["at"] + x["h"] + x["b"] + tail).alias("at"), F.when(x["loss"], F.concat(z["spans"], F.array(span))).otherwise(z["spans"]).alias("spans"))

    return whole.select("conv_id", "formatted", F.aggregate("p", begin, step)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted string, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        end = F.locate("\n", x)
        role = F.replace(F.replace(x.substr(F.lit(len(START) + 1), end - len(START) - 1), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
        return F.struct(unescape(role).alias("role"), unescape(x.substr(end + 1, F.length(x))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, read from the formatted string and unescaped, in order."""
    return F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))


def format_chats(events: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Event logs -> (conv_id, formatted, loss_spans). Null conversation ids form one conversation; no events, no rows."""
    return render(fold_events(events), trained)


def row_events(rows: DataFrame) -> DataFrame:
    """The event log of a table of whole turns (conv_id, turn, role, text), as a streaming writer would have left it.

    Every row is a message of its own: a draft that is regenerated, a wrong beginning that an edit replaces by the first half
    of the text, and a delta with the rest. Folding gives back the text exactly. Equal rows stay separate messages, whose
    names are unlike; rows with equal turns are ordered by role, then text. Null turns come first; null roles and texts
    are empty.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    steps = [("delta", F.lit("a draft, ")), ("delta", F.substring(text, 1, 3)), ("regenerate", F.lit("")), ("delta", F.lit("wrong ")), ("edit", first), ("delta", rest)]
    log = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"), told.alias("text")) for i, (kind, told) in enumerate(steps)])
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "text", F.monotonically_increasing_id().alias("message"))
    events = named.select("conv_id", "turn", "role", "message", F.explode(log).alias("e"))
    # a turn's events have the sequence numbers from 8 times its number on; turns without a number come before all
    seq = F.coalesce(F.col("turn") * 8, F.lit(-(1 << 40)).cast("long")) + F.col("e.step")
    return events.select("conv_id", seq.alias("seq"), "message", "role", "e.kind", "e.text")
