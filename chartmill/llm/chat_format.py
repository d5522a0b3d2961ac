"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A conversation is a log of events ``(conv_id, seq, turn, role, kind, text)``:

* ``delta`` appends its text to the message of its turn,
* ``edit`` replaces the message so far by its text,
* ``regenerate`` discards the message so far and starts again with its text,
* ``retract`` removes the message; later deltas may start it anew.

Logs are partitioned by conversation and turn, sorted by sequence and folded into final messages; a second grouping
brings the messages of a conversation together and renders them. Events are folded per turn before the conversation is
gathered, so a task holds streams of single turns first and then only final messages. The rendered conversation is one
value by its nature, so one row must hold it.

Defined cases: a null text counts as empty, a null role as the empty role, a null sequence sorts first, a null
conversation is a conversation of its own, a null turn is a message that comes first. Events that tie on the sequence
are applied in the order of kind and text, so repeated rows give a result that doesn't depend on the partitioning.
Conversations without a message left give no row. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn role=\"", "</turn>\n"


def escape(text: Column) -> Column:
    """Control strings all need ``<`` (or, in a role, the quote), so texts without them can't be read as markup."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text."""
    event = F.struct(
        F.col("seq").alias("seq"), F.col("kind").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")
    )
    log = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("log"))
    reset = F.array_max(
        F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate", "retract"), i).otherwise(F.lit(0)))
    )
    tail = log.withColumn("tail", F.slice("log", reset + 1, F.size("log")))
    text = F.array_join(F.transform("tail", lambda e: F.when(e["kind"] == "retract", F.lit("")).otherwise(e["text"])), "")
    alive = F.exists("tail", lambda e: e["kind"] != "retract")
    return tail.where(alive).select("conv_id", "turn", F.element_at("tail", -1)["role"].alias("role"), text.alias("text"))


def streamed(messages: DataFrame) -> DataFrame:
    """The log that leaves just these messages (conv_id, turn, role, text, copy): each comes in two deltas, and its first half was sent once
    before and then edited or, by the assistant, generated anew. The turn of an event is the message's (turn, role, text's hash, copy)."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    left, right = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.char_length("text"))
    again = F.when(F.col("role") == "assistant", "regenerate").otherwise("edit")
    event = lambda seq, kind, text: F.struct(F.lit(seq).cast("long").alias("seq"), kind.alias("kind"), text.alias("text"))
    log = F.array(event(0, F.lit("delta"), left), event(1, again, left), event(2, F.lit("delta"), right))
    turn = F.struct("turn", "role", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"), "copy")
    return messages.select("conv_id", turn.alias("turn"), "role", F.explode(log).alias("e")).select("conv_id", "turn", "role", "e.*")


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted."""
    body = lambda m: F.concat(F.lit(OPEN), escape(m["role"]), F.lit('">'), escape(m["text"]), F.lit(CLOSE))
    return messages.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), body), "").alias("formatted")
    )


def format_conversations(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse rendered conversations: conv_id, formatted, turns array<struct<role, text>>."""
    pattern = r'<turn role="([^"<]*)">([^<]*)</turn>'
    found = lambda group: F.transform(F.regexp_extract_all("formatted", F.lit(pattern), F.lit(group)), unescape)
    return formatted.withColumn("turns", F.arrays_zip(found(1).alias("role"), found(2).alias("text")))


def digest(parsed: DataFrame) -> DataFrame:
    """Per conversation, what the parsed text says: counts and digests of all turns and of the text under the loss mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
