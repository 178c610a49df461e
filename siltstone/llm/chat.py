"""Chat formatting by event-sourced reconstruction, with DataFrame functions alone.

A conversation is a log of events.  Logs are dealt by conversation, sorted by
sequence number and folded into final messages, which a template renders::

    ### User: <escaped text></turn>\\n### Assistant: <escaped text></turn>\\n

Event kinds: ``message`` starts a message or writes it anew, ``delta`` appends to
it, ``edit`` replaces its text, ``regenerate`` empties it and drops every later
turn as logged until then.  Any other kind counts as ``message``.

Inside texts and role names the backslash and whatever could pass for a control
string are escaped reversibly, so neither ``###`` nor ``</turn>`` ever comes from
a text.  The loss mask gives, for every turn, the span of the rendered text that is
an assistant's own words (code points), or null.

A conversation's rendered text is one value, so all its turns meet in one task;
windows and sorts of a long conversation spill to disk, and offsets are running
sums, so the work is proportional to its length.

Edge cases: null texts and roles are empty; equal sequence numbers are folded in
the order of their texts; a null conv_id is a conversation of its own; repeated
rows of a table of turns are turns each; an empty log gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "</turn>"
#: Labels of the roles that have one; other roles are written after an equals sign.
LABELS = {"user": "User", "assistant": "Assistant", "system": "System"}
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Reversible: afterwards every backslash is followed by a digit, and no ``###``, ``</turn>`` is left."""
    text = F.replace(text, F.lit("\\"), F.lit("\\0"))
    text = F.replace(text, F.lit(END), F.lit("\\1" + END[1:]))
    return F.replace(text, F.lit("###"), F.lit("\\2"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\2"), F.lit("###"))
    return F.replace(F.replace(text, F.lit("\\1"), F.lit(END[0])), F.lit("\\0"), F.lit("\\"))


def _label(role: Column) -> Column:
    # A colon would end the header early.
    out = F.concat(F.lit("="), F.replace(escape(role), F.lit(":"), F.lit("\\3")))
    for name, label in LABELS.items():
        out = F.when(role == name, F.lit(label)).otherwise(out)
    return out


def _role(label: Column) -> Column:
    out = unescape(F.replace(F.substring(label, F.lit(2), F.length(label)), F.lit("\\3"), F.lit(":")))
    for name, known in LABELS.items():
        out = F.when(label == known, F.lit(name)).otherwise(out)
    return out


def turn_events(turns: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as an event log: one ``message`` event a row, in turn order."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", "turn", "role", "text").withColumn("seq", F.row_number().over(order).cast("long")).select("conv_id", "seq", F.col("seq").alias("turn"), F.lit("message").alias("kind"), "role", "text")


def streamed_events(turns: DataFrame) -> DataFrame:
    """A table of finished turns as the log of a chat that was streamed and corrected.

    An assistant's turn is a draft that is generated anew and then streamed in two deltas; any other
    one is a message that is edited and then goes on.  Folding gives the turns back.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("turn", F.row_number().over(order).cast("long")).withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    first, second = F.left("text", F.col("half")), F.substring(F.col("text"), F.col("half") + 1, F.length("text"))
    event = lambda step, kind, role, text: F.struct((F.col("turn") * 4 + step).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    role, none, draft = F.col("role").cast("string"), F.lit(None).cast("string"), F.lit("draft")
    spoken = F.array(event(0, "message", role, draft), event(1, "regenerate", none, none), event(2, "delta", none, first), event(3, "delta", none, second))
    written = F.array(event(0, "message", role, second), event(1, "edit", none, first), event(2, "delta", none, second))
    log = F.when(F.col("role") == TRAINED_ROLE, spoken).otherwise(written)
    return rows.select("conv_id", "turn", F.explode(log).alias("e")).select("conv_id", "e.seq", "turn", "e.kind", "e.role", "e.text")


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold events (conv_id, seq, turn, kind, role, text) into final messages (conv_id, turn, role, text)."""
    message = Window.partitionBy("conv_id", "turn")
    earlier_turns = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("role").cast("string")
    log = events.select("conv_id", "seq", F.col("turn").cast("long").alias("turn"), F.coalesce("kind", F.lit("message")).alias("kind"), role.alias("role"), text.alias("text"))
    log = log.withColumn("cut", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier_turns))
    # A later event may leave the role out: the last one named counts, whatever became of its text.
    named = F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(message)
    log = log.withColumn("named", named).withColumn("reset", F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(message))
    valid = log.where("(reset is null or seq >= reset) and (cut is null or seq > cut)")
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    folded = valid.groupBy("conv_id", "turn").agg(parts.alias("parts"), F.first("named").alias("named"))
    return folded.select("conv_id", "turn", F.coalesce("named.role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, and mask, aligned with its turns: struct(start, chars) where an assistant speaks, else null."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    head, body = F.concat(F.lit("### "), _label(F.col("role")), F.lit(": ")), escape(F.col("text"))
    rows = messages.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n"))).withColumn("n", F.length("piece").cast("long"))
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(order), F.lit(0).cast("long")))
    span = F.when(F.col("role") == TRAINED_ROLE, F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("chars")))
    turns = F.array_sort(F.collect_list(F.struct("turn", "piece", span.alias("span"))))
    whole = rows.groupBy("conv_id").agg(turns.alias("turns"))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.transform("turns", lambda t: t["span"]).alias("mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns read from the rendered text and its mask: conv_id, turn (from 0), role, text, loss (the unmasked words or null), chars (of the whole text)."""
    pieces = F.slice(F.split("formatted", END + "\n"), F.lit(1), F.size("mask"))
    rows = rendered.select("conv_id", F.length("formatted").cast("long").alias("chars"), F.posexplode(F.arrays_zip(pieces.alias("piece"), F.col("mask").alias("span"))))
    rows = rows.select("conv_id", "chars", F.col("pos").alias("turn"), "col.piece", "col.span")
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece") + len(END) + 1).over(order), F.lit(0))
    colon = F.instr("piece", ": ")
    loss = F.when(F.col("span").isNotNull(), unescape(F.substring(F.col("piece"), (F.col("span.start") - F.col("at") + 1).cast("int"), F.col("span.chars").cast("int"))))
    rows = rows.withColumn("at", at).withColumn("colon", colon)
    label = F.substring(F.col("piece"), F.lit(5), F.col("colon") - 5)
    text = unescape(F.substring(F.col("piece"), F.col("colon") + 2, F.length("piece")))
    return rows.select("conv_id", "turn", _role(label).alias("role"), text.alias("text"), loss.alias("loss"), "chars")


def summary(rendered: DataFrame) -> DataFrame:
    """Digests of what read_back() finds, and the length of the whole text, per conversation."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "loss")))
    whole = read_back(rendered).groupBy("conv_id").agg(turns.alias("turns"), F.first("chars").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
