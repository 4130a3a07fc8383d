"""Per-channel state over a table of chat events.

Events are rows ``(channel, event_id, ts, kind, text, bot_id, response)`` with kind ``message``,
``clear`` or ``end``; their order is ``(ts, event_id)``. `citeflow.streaming.channels` does the same
for a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.operators.completion import is_answered
from citeflow.operators.running import running_totals
from citeflow.settings import DELETIONS_PER_PAGE
from citeflow.sizes import broadcast_if_small

CLEARED = "The history of this conversation is empty again."
NOTHING_TO_CLEAR = "There is no history to clear yet."
ENDED = "The session has ended and its history is gone."
NOT_ENDED = "The session could not be ended. Please try again."
BOT_CREDENTIAL = "bot"
USER_CREDENTIAL = "user"


def message_filter(events: DataFrame) -> DataFrame:
    """Messages of people: no bot id, and a text, which may be empty."""
    return events.filter(is_accepted())


def is_accepted() -> Column:
    return (F.col("kind") == "message") & F.col("bot_id").isNull() & F.col("text").isNotNull()


def is_reset() -> Column:
    return F.col("kind").isin("clear", "end")


def relevant_events(events: DataFrame) -> DataFrame:
    """Accepted messages and resets: the events that change or ask for state."""
    return events.filter(is_accepted() | is_reset())


def channel_history_state(events: DataFrame, **slicing) -> DataFrame:
    """``(channel, event_id, kind, epoch, history_len)`` after each accepted message and reset.

    An epoch starts with every clear or end. An answered message adds two entries; the history holds
    those that came after the latest reset.
    """
    entries = F.when(is_accepted() & is_answered(F.col("response")), 2).otherwise(0)
    counted = running_totals(
        relevant_events(events),
        ["channel"],
        "ts",
        "event_id",
        {"_entries": entries, "epoch": F.when(is_reset(), 1).otherwise(0)},
        {"_at_reset": ("_entries", is_reset())},
        **slicing,
    )
    length = (F.col("_entries") - F.col("_at_reset")).alias("history_len")
    return counted.select("channel", "event_id", "kind", "epoch", length)


def first_contact(events: DataFrame) -> DataFrame:
    """``(channel, event_id, ts)`` of each channel's first accepted message, which earns a welcome.
    Clearing or ending does not bring a second one."""
    first = F.min(F.struct("ts", "event_id")).alias("_first")
    seen = message_filter(events).groupBy("channel").agg(first)
    return seen.select("channel", "_first.event_id", "_first.ts")


def _with_known(actions: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``known``: the channel had an accepted message strictly earlier."""
    first = first_contact(events).select(
        "channel", F.struct("ts", "event_id").alias("_first")
    )
    joined = actions.join(broadcast_if_small(first), "channel", "left")
    earlier = F.col("_first") < F.struct("ts", "event_id")
    return joined.withColumn("known", F.coalesce(earlier, F.lit(False))).drop("_first")


def clear_notice(known: Column) -> Column:
    return F.when(known, F.lit(CLEARED)).otherwise(F.lit(NOTHING_TO_CLEAR))


def clear_history(events: DataFrame) -> DataFrame:
    """``(channel, event_id, known, notice)`` per clear action. A channel stays known once it had an
    accepted message, also when its history is empty."""
    actions = events.filter(F.col("kind") == "clear")
    return _with_known(actions, events).select(
        "channel", "event_id", "known", clear_notice(F.col("known")).alias("notice")
    )


def end_session(events: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """``(channel, event_id, known, notice)`` per end action; the history of a known channel is
    emptied, and the notice is the same either way. ``failed`` lists the ``event_id`` of actions whose
    deletions broke off; they get a notice of their own."""
    actions = _with_known(events.filter(F.col("kind") == "end"), events)
    notice = F.lit(ENDED)
    if failed is not None:
        broken = failed.select("event_id").distinct().withColumn("_failed", F.lit(True))
        actions = actions.join(broadcast_if_small(broken), "event_id", "left")
        notice = F.when(F.col("_failed"), F.lit(NOT_ENDED)).otherwise(notice)
    return actions.select("channel", "event_id", "known", notice.alias("notice"))


def self_join_filter(joins: DataFrame, bot_user: str) -> DataFrame:
    """Join events of the bot itself."""
    return joins.filter(F.col("user") == bot_user)


def active_channels(events: DataFrame) -> DataFrame:
    """Channels with an accepted message."""
    return message_filter(events).select("channel").dropDuplicates(["channel"])


def _in_pages(messages: DataFrame, keys: list[str], per_page: int, **slicing) -> DataFrame:
    """Add ``page_no`` from 0 within the keys, newest messages first."""
    numbered = running_totals(
        messages, keys, "ts", "event_id", {"_row": F.lit(1)}, descending=True, **slicing
    )
    page = F.floor((F.col("_row") - 1) / per_page).cast("int")
    return numbered.withColumn("page_no", page).drop("_row")


def _sessions(events: DataFrame, **slicing) -> DataFrame:
    """Messages and ends with ``_epoch``, the ends of the channel before them; an end closes its own epoch."""
    kept = events.filter(F.col("kind").isin("message", "end"))
    ends = F.when(F.col("kind") == "end", 1).otherwise(0)
    counted = running_totals(kept, ["channel"], "ts", "event_id", {"_ends": ends}, **slicing)
    return counted.withColumn("_epoch", F.col("_ends") - ends).drop("_ends")


def _credential(has_user_credential: bool) -> Column:
    from_bot = F.coalesce("bot_id", F.lit("")) != ""
    credential = F.when(from_bot, BOT_CREDENTIAL)
    return credential.otherwise(USER_CREDENTIAL) if has_user_credential else credential


def deletion_plan(
    events: DataFrame,
    has_user_credential: bool = True,
    per_page: int = DELETIONS_PER_PAGE,
    **slicing,
) -> DataFrame:
    """``(channel, end_event_id, event_id, page_no, credential)``: the messages each end deletes.

    An end lists what its channel holds at that moment: a message goes with the first end after it, and
    messages after the last end stay. Bot messages go with the bot's credential, others with the user's, or are
    left if there is none. Pages count from the newest message of the channel at that end, also those that are
    left; what earlier ends left is older and moves no page.
    """
    told = _sessions(events, **slicing)
    ends = told.filter(F.col("kind") == "end").select(
        "channel", "_epoch", F.col("event_id").alias("end_event_id")
    )
    messages = told.filter(F.col("kind") == "message").join(broadcast_if_small(ends), ["channel", "_epoch"])
    paged = _in_pages(messages, ["channel", "_epoch"], per_page, **slicing)
    return (
        paged.withColumn("credential", _credential(has_user_credential))
        .filter(F.col("credential").isNotNull())
        .select("channel", "end_event_id", "event_id", "page_no", "credential")
    )


def purge_all(
    events: DataFrame,
    has_user_credential: bool = True,
    per_page: int = DELETIONS_PER_PAGE,
    **slicing,
) -> DataFrame:
    """``(channel, event_id, page_no, credential)`` for the messages that active channels still hold after all
    events, all with one credential. What an end has deleted is gone."""
    active = broadcast_if_small(active_channels(events))
    told = _sessions(events, **slicing)
    ended = told.filter(F.col("kind") == "end").select("channel", "_epoch", F.lit(True).alias("_gone"))
    held = told.filter(F.col("kind") == "message").join(broadcast_if_small(ended), ["channel", "_epoch"], "left")
    deleted = F.col("_gone") & _credential(has_user_credential).isNotNull()
    present = held.filter(~F.coalesce(deleted, F.lit(False))).join(active, "channel", "left_semi")
    paged = _in_pages(present, ["channel"], per_page, **slicing)
    return paged.select("channel", "event_id", "page_no", F.lit(BOT_CREDENTIAL).alias("credential"))


def purge_resets(events: DataFrame) -> DataFrame:
    """``(channel, entries)``: the stored history a purge empties, for channels that hold any."""
    latest = F.max_by("history_len", F.struct("ts", "event_id")).cast("bigint").alias("entries")
    told = channel_history_state(events).join(events.select("channel", "event_id", "ts"), ["channel", "event_id"])
    return told.groupBy("channel").agg(latest).filter(F.col("entries") > 0)
