"""Chat formatting by event sourcing, in DataFrame operations only.

A log has one row per event: conversation, sequence number, message, kind and text. Kinds: `message` (or null) opens a
message with a text, `delta` appends streamed text to it, `edit` replaces its text, `regenerate` throws its text away and
starts anew. Events are dealt once by conversation; both folds (events to messages, messages to conversation) run on
that partitioning. A conversation becomes one row, so the longest one must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """No control string is left in the result; unescape() gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def final_messages(events: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text in order) from rows (conv_id, seq, message, kind, role, text).

    Within a message, events are folded by sequence: what stood before the last `message`, `edit` or `regenerate` is
    gone, later `delta` texts follow in order. Two `message` events of one message are two turns. A message stands
    where its first event stands; its role is the first that isn't null, else empty. Null text is empty; ties of
    sequence are ordered by kind, role and text; null numbers come first; unknown kinds count as `message`. Long texts and
    long logs are folded in time that grows with their length. Other columns are ignored; an empty log gives no rows.
    """
    kind = F.coalesce(F.lower("kind"), F.lit("message"))
    rows = events.select(
        "conv_id", "seq", "message",
        F.when(kind.isin("delta", "edit", "regenerate"), kind).otherwise("message").alias("kind"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).repartition("conv_id")
    log = F.sort_array(F.collect_list(F.struct("seq", F.when(F.col("kind") == "message", 0).otherwise(1).alias("rank"), "kind", "role", "text")))
    folded = rows.groupBy("conv_id", "message").agg(log.alias("log"))
    # One run of events for each `message` event, up to the next one; events before the first belong to its run.
    opens = F.filter(F.transform("log", lambda e, i: F.when(e["kind"] == "message", i + 1)), lambda i: i.isNotNull())
    starts = F.concat(F.array(F.lit(1)), F.slice(opens, 2, F.greatest(F.size(opens) - 1, F.lit(0))))
    stops = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size("log") + 1))
    single = F.size(F.filter("log", lambda e: e["kind"] == "message")) <= 1
    runs = F.when(single, F.array(F.col("log"))).otherwise(F.zip_with(starts, stops, lambda a, b: F.slice("log", a, b - a)))
    role = lambda es: F.coalesce(F.get(F.filter(es, lambda e: e["role"].isNotNull()), 0)["role"], F.lit(""))
    last = lambda es: F.greatest(F.coalesce(F.array_max(F.transform(es, lambda e, i: F.when(e["kind"] != "delta", i + 1))), F.lit(1)), F.lit(1))
    text = lambda es: F.array_join(F.transform(F.slice(es, last(es), F.size(es)), lambda e: e["text"]), "")
    turns = folded.select("conv_id", "message", F.posexplode(runs).alias("at", "es")).select("conv_id", F.struct(F.col("es")[0]["seq"].alias("seq"), "message", "at", role(F.col("es")).alias("role"), text(F.col("es")).alias("text")).alias("turn"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, spans: the template's text, and what the loss is taken on: start and length in code points from
    0, the turn (from 0), and `at`, the start within the turn's own part of the text. Each assistant text is one span;
    markers, roles and other texts are under none. conv_id is unique. Places are running sums over the turns as rows, so
    time grows with the conversation's length."""
    turn = F.col("t")
    rows = conversations.select("conv_id", F.posexplode("turns").alias("turn", "t")).select(
        "conv_id", "turn", F.concat(F.lit(OPEN), escape_role(turn["role"]), F.lit("\n")).alias("head"), escape(turn["text"]).alias("body"), (turn["role"] == "assistant").alias("loss"),
    )
    at, length = F.char_length("head"), F.char_length("body")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(at + length + len(CLOSE) + 1).over(before), F.lit(0)).cast("int") + at
    span = F.struct(start.alias("start"), length.alias("length"), "turn", at.alias("at"))
    placed = rows.select("conv_id", "turn", F.concat("head", "body", F.lit(CLOSE + "\n")).alias("part"), F.when(F.col("loss"), span).alias("span"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "part"))).alias("parts"), F.sort_array(F.collect_list("span")).alias("spans"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), "spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns, loss_text from render()'s output alone. The text is split once; spans are cut from their turn's part,
    so that no look-up walks the text from its beginning."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.lit(1 << 30))  # what stands before the first marker is empty
    turn = lambda s: F.struct(
        unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
        unescape(F.substring(s, F.instr(s, F.lit("\n")) + 1, F.char_length(s) - F.instr(s, F.lit("\n")) - len(CLOSE) - 1)).alias("text"),
    )
    # The pieces are bound to a variable: named in the inner function itself, they would be split anew for each span.
    loss = F.transform(F.array(pieces), lambda own: F.array_join(F.transform(F.col("spans"), lambda x: unescape(F.substring(F.get(own, x["turn"]), x["at"] - len(OPEN) + 1, x["length"]))), ""))[0]
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"), "formatted")


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, formatted, spans of each conversation of an event log (see final_messages). An empty log gives no rows."""
    return render(final_messages(events))
