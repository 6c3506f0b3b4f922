"""Chat formatting from event logs, with DataFrame functions only.

A log row is (conv_id, seq, message, kind, role, text). In order of ``seq``:

- ``delta`` appends its text to the message (the first one starts it);
- ``edit`` replaces the message's text with its own; later deltas append to that;
- ``regenerate`` empties the message and drops every later message of the log so
  far; later events write them anew.

An event is void if a later regenerate of the same or an earlier message, or a
later edit of its message, follows; what is left is joined in order. That needs
two running windows over one partitioning by conversation, no state kept by hand.

Rendering: ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. Inside texts and
roles a run ``<\\...\\|`` gets one more backslash, so no text can hold a marker, and
taking one away is exact; in roles %, < and newlines are percent-coded. The loss mask
lists spans of assistants' texts, each as (message, start, end) in code points
of that message's block, so reading it back costs time linear in the output.

A formatted conversation is one value, so one conversation must fit a row; that is
the result asked for, not a limit of the plan.

Nulls and odd cases: null text and role are empty; null conv_id is a conversation;
events with one seq go by message, kind, role, text, and exact repeats all count; a
message whose events are all void is not in the output, one of empty text is; an
unknown kind is taken as delta. Empty input, empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Characters of a streamed delta when a table of whole turns is played as a log.
DELTA = 400


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def turns_to_log(turns: DataFrame, drafts: int = 4) -> DataFrame:
    """Play whole turns (conv_id, turn, role, text) as a log of streamed deltas.

    Rows go by turn, nulls first, then role and text, so repeated turns stay apart.
    Of ``drafts`` messages, by a hash, one is streamed in part, then regenerated, and
    one starts with a draft that an edit replaces by its first part; 0 for none.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long"))
    text = F.coalesce("text", F.lit(""))
    parts = F.when(F.length(text) <= DELTA, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % DELTA), F.lit(0)))
    event = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    plain = F.transform("parts", lambda x: event("delta", x))
    mode = F.pmod(F.xxhash64("conv_id", "message"), F.lit(drafts)) if drafts else F.lit(-1)
    events = (
        F.when(mode == 0, F.concat(F.array(event("delta", F.get("parts", F.lit(0))), event("regenerate", F.lit(""))), plain))
        .when(mode == 1, F.concat(F.array(event("delta", F.lit("a draft")), event("edit", F.get("parts", F.lit(0)))), F.slice(plain, 2, F.size("parts"))))
        .otherwise(plain)
    )
    rows = rows.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    return rows.select("conv_id", "message", "role", F.posexplode(events).alias("part", "event")).select(
        "conv_id", (F.col("message") * F.lit(1 << 32) + F.col("part")).alias("seq"), "message", "event.kind", "role", "event.text"
    )


def fold_log(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of an event log."""
    events = log.select("conv_id", "seq", "message", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ("seq", "message", "kind", "role", "text")
    later = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    same = Window.partitionBy("conv_id", "message").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    live = (
        events.withColumn("undone", F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later) <= F.col("message"))
        .withColumn("edited", F.max(F.col("kind") == "edit").over(same))
        .where(~F.coalesce("undone", F.lit(False)) & ~F.coalesce("edited", F.lit(False)))
    )
    item = F.struct("seq", "kind", "role", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text"))
    folded = live.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(item)).alias("events"))
    return folded.select("conv_id", "message", F.element_at("events", -1)["role"].alias("role"), F.array_join(F.col("events.text"), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask of final messages."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    rows = messages.select("conv_id", "message", F.concat(head, body, F.lit(END + "\n")).alias("block"), (F.col("role") == "assistant").alias("loss"), F.length(head).alias("start"), (F.length(head) + F.length(body)).alias("end"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "block", "loss", "start", "end"))).alias("m"))
    spans = F.filter(F.transform("m", lambda x, i: F.struct(i.alias("message"), x["start"].alias("start"), x["end"].alias("end"), x["loss"].alias("loss"))), lambda x: x["loss"])
    return whole.select("conv_id", F.array_join(F.col("m.block"), "").alias("formatted"), F.transform(spans, lambda x: F.struct(x["message"].alias("message"), x["start"].alias("start"), x["end"].alias("end"))).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted_chars, turns (array of role, text) and loss_texts, from the rendered string and its mask alone."""
    marker = r"<\|im_start\|>"
    blocks = formatted.select("conv_id", F.length("formatted").alias("formatted_chars"), F.slice(F.split("formatted", marker), 2, F.lit(1 << 30)).alias("blocks"), "loss_mask")
    role = lambda b: F.substring_index(b, "\n", 1)
    text = lambda b: F.substr(b, F.length(role(b)) + 2, F.length(b) - F.length(role(b)) - F.lit(len(END) + 2))
    return blocks.select(
        "conv_id", "formatted_chars",
        F.transform("blocks", lambda b: F.struct(unescape_role(role(b)).alias("role"), unescape(text(b)).alias("text"))).alias("turns"),
        # a mask counts from the block's marker, which the split has taken away
        F.transform("loss_mask", lambda s: unescape(F.substr(F.get("blocks", s["message"]), s["start"] + F.lit(1 - len(START)), s["end"] - s["start"]))).alias("loss_texts"),
    )


def digest(read: DataFrame) -> DataFrame:
    """The digest columns of a formatted conversation."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
