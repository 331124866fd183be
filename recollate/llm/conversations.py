"""Conversations from message rows.

Rows are an event log: all versions of a message (same session and key) fold into its final state, then the turns are
ordered and the sessions validated.

No session is ever collected or sorted in one task: turns are range-partitioned by (session, position), so that a session with a
third of all rows spreads over many segments; what a segment does to the order rules is summarised in one row, and the
summaries of a session, at most one per partition, are folded with a window.

A session is dropped if a message has no readable speaker or time or a broken line; if it has no user or no assistant
turn; if its first turn other than system isn't the user's; or if a run of user turns gets no assistant turn before
the next run or the end. Rows without session are ignored; an empty input gives no turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollate.session import cut

# Usual names of speakers in chat APIs and help desks, lower case.
SPEAKERS = {
    "user": ("user", "human", "customer", "client", "end_user", "end-user", "enduser", "requester", "visitor", "person", "contact"),
    "assistant": ("assistant", "ai", "bot", "model", "agent", "chatbot", "gpt", "llm", "claude", "gemini", "support", "representative", "operator", "ai_assistant", "chatgpt"),
    "system": ("system", "developer", "sys", "system_prompt"),
    "tool": ("tool", "function", "tool_result", "tool_response", "function_call", "function_response", "tool_call", "ipython", "observation", "plugin"),
}
_WHITE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def speaker_of(role: Column) -> Column:
    """user, assistant, system or tool, or null if the role can't be read."""
    name = F.lower(F.regexp_replace(role, f"^[{_WHITE}]+|[{_WHITE}]+$", ""))
    out = F.lit(None).cast("string")
    for speaker, names in SPEAKERS.items():
        out = F.when(name.isin(*names), F.lit(speaker)).otherwise(out)
    return out


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[^{_WHITE}]"), F.lit(False))


def fold_log(events: DataFrame) -> DataFrame:
    """The final state of each message, one row each.

    events: origin, session_id, message_key, version (long), instant (long), line (long), op, speaker, filled. The highest version
    is the final one (ties: the later instant, then the greatest values, so the choice never depends on row order); the
    position is the first instant and the lowest line; a message whose final op is delete disappears. Copies fold before the shuffle.
    """
    state = F.struct("version", "instant", "op", "speaker", "filled")
    folded = events.groupBy("origin", "session_id", "message_key").agg(
        F.max(state).alias("s"), F.min("line").alias("line"), F.min("instant").alias("instant"), F.max(F.col("broken").cast("int")).alias("broken")
    )
    live = folded.filter(F.coalesce(F.col("s.op") != "delete", F.lit(True)))
    return live.select("origin", "session_id", "message_key", "instant", "line", F.col("s.speaker").alias("speaker"), F.col("s.filled").alias("filled"), (F.col("broken") > 0).alias("broken"))


def conversations(events: DataFrame) -> DataFrame:
    """origin, session_id, turn_no, message_key, speaker of all turns of the sessions that hold. events as in fold_log, with a flag broken."""
    messages = cut(fold_log(events.filter(F.col("session_id").isNotNull())))
    bad = messages.filter(F.col("broken") | F.col("speaker").isNull() | F.col("instant").isNull()).select("origin", "session_id").distinct()
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["origin", "session_id", "instant", "line", "message_key"]
    turns = messages.filter("filled AND speaker IS NOT NULL AND instant IS NOT NULL").select(*order, "speaker")
    # The segment must not change between its uses: it is written with the turns.
    turns = cut(turns.repartitionByRange(parts, *order).withColumn("segment", F.spark_partition_id()))
    here = Window.partitionBy("origin", "session_id", "segment").orderBy("instant", "line", "message_key")
    either = F.when(F.col("speaker").isin("user", "assistant"), F.col("speaker"))
    placed = turns.select(
        "*",
        F.row_number().over(here).alias("at"),
        F.lag("speaker").over(here).alias("before"),
        F.last(either, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1)).alias("said"),
    )
    unanswered = (F.col("speaker") == "user") & (F.col("before") != "user") & (F.col("said") == "user")
    other_first = F.when(F.col("speaker") != "system", F.col("at"))
    segments = placed.groupBy("origin", "session_id", "segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce(unanswered, F.lit(False))).alias("unanswered"),
        F.min_by("speaker", other_first).alias("opens"),
        F.min_by(either, F.when(either.isNotNull(), F.col("at"))).alias("first_said"),
        F.min(F.when(either.isNotNull(), F.col("at"))).alias("first_at"),
        F.max_by(either, F.when(either.isNotNull(), F.col("at"))).alias("last_said"),
        F.max_by("speaker", "at").alias("last"),
        F.max(F.col("speaker") == "user").alias("asked"),
    )
    along = Window.partitionBy("origin", "session_id").orderBy("segment")
    so_far = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("origin", "session_id")
    joined = segments.select(
        "*",
        F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("offset"),
        F.last("last_said", ignorenulls=True).over(so_far).alias("said_before"),
        F.lag("last").over(along).alias("last_before"),
    )
    crossing = (F.col("first_said") == "user") & (F.col("said_before") == "user") & ((F.col("first_at") > 1) | (F.col("last_before") != "user"))
    flagged = joined.withColumn("fails", F.col("unanswered") | F.coalesce(crossing, F.lit(False)))
    judged = flagged.select(
        "origin", "session_id", "segment", "offset",
        F.max("fails").over(whole).alias("fails"),
        F.max("asked").over(whole).alias("asked"),
        F.min_by("opens", F.when(F.col("opens").isNotNull(), F.col("segment"))).over(whole).alias("opens"),
        F.max_by("last_said", F.when(F.col("last_said").isNotNull(), F.col("segment"))).over(whole).alias("closes"),
    )
    held = judged.filter("NOT fails AND asked AND opens = 'user' AND closes = 'assistant'").join(bad, ["origin", "session_id"], "left_anti")
    kept = placed.join(held.select("origin", "session_id", "segment", "offset"), ["origin", "session_id", "segment"])
    return kept.select("origin", "session_id", (F.col("offset") + F.col("at") - 1).cast("int").alias("turn_no"), "message_key", "speaker")


def with_text(turns: DataFrame, events: DataFrame) -> DataFrame:
    """turns with the text of each: that of the version which fold_log takes for final. events as in fold_log, with text."""
    key = ["origin", "session_id", "message_key"]
    state = F.struct("version", "instant", "op", "speaker", "filled", "text")
    final = events.filter(F.col("session_id").isNotNull()).join(turns.select(*key), key, "left_semi").groupBy(*key).agg(F.max(state)["text"].alias("text"))
    return turns.join(final, key).select("origin", "session_id", "turn_no", "message_key", "speaker", "text")
