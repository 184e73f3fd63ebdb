"""Chat formatting: event logs folded to final messages, rendered, with loss spans; in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings, ours and other templates': none is left whole inside a text.
CONTROL = r"(<|\[)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    """Undoes escape(): of each backslash and one that may follow it, the second stays."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): the final messages of an event log.

    events(conv_id, seq, kind, msg, role, text) has kinds
      message     opens message msg with a role and text,
      delta       appends text to msg,
      edit        replaces the text of msg so far,
      regenerate  empties msg and drops the messages that opened after it and before this event,
      delete      removes msg.
    Events of a conversation are taken by seq; ties go by msg, kind and text, so the result does not
    depend on input order. Unknown kinds and rows without kind count as message. Null texts are empty;
    the role is the first that msg has; seq is where msg opened. All steps are windows and aggregates
    over (conversation, message), which spill, so one long conversation needs no more memory.
    """
    e = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "msg", "role", F.coalesce("text", F.lit("")).alias("text"))
    own = Window.partitionBy("conv_id", "msg").orderBy("seq", "kind", "text")
    e = e.withColumn("reset", F.sum(F.when(F.col("kind") == "delta", 0).otherwise(1)).over(own)).withColumn("opened", F.min("seq").over(Window.partitionBy("conv_id", "msg")))
    last = Window.partitionBy("conv_id", "msg")
    live = e.withColumn("final", F.max("reset").over(last)).withColumn("again", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(last)).withColumn("gone", F.max(F.when(F.col("kind") == "delete", 1)).over(last)).withColumn("first_role", F.first("role", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    messages = (
        live.groupBy("conv_id", "msg", "opened", "again", "gone", "first_role")
        .agg(F.sort_array(F.collect_list(F.when((F.col("reset") == F.col("final")) & (F.col("kind") != "regenerate"), F.struct("seq", "kind", "text")))).alias("parts"))
        .withColumn("text", F.array_join(F.transform("parts", lambda p: p["text"]), ""))
    )
    earlier = Window.partitionBy("conv_id").orderBy("opened", "msg").rowsBetween(Window.unboundedPreceding, -1)
    kept = messages.withColumn("cut_at", F.max("again").over(earlier)).where("gone IS NULL AND (cut_at IS NULL OR opened > cut_at)")
    return kept.select("conv_id", F.col("opened").alias("seq"), F.col("first_role").alias("role"), "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) for each conversation of messages(conv_id, seq, role, text).

    A turn is START, role, MIDDLE, text, END, with role and text escaped; a null role is an empty one.
    loss_spans lists (start, length) in code points of each assistant text, escaped as it stands in
    formatted. Turns go by seq; ties by role and text. No messages give no rows.
    """
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    turns = (
        messages.select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
        .withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE)))
        .withColumn("place", F.row_number().over(order))
        .withColumn("before", F.coalesce(F.sum((F.char_length("head") + F.char_length("text") + len(END)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    span = F.when(F.col("role") == "assistant", F.struct((F.col("before") + F.char_length("head")).cast("int").alias("start"), F.char_length("text").cast("int").alias("length")))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", F.concat("head", "text", F.lit(END)).alias("turn")))).alias("turns"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id with n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from render()'s output alone."""
    marks = F.split("formatted", r"<\|im_end\|>\n")
    turns = F.transform(F.slice(marks, 1, F.size(marks) - 1), lambda t: F.split(F.substr(t, F.lit(len(START) + 1)), r"<\|im_sep\|>", 2))
    text = F.array_join(F.transform("turns", lambda t: F.concat(unescape(t[0]), F.lit("\n"), unescape(t[1]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), "")
    return formatted.withColumn("turns", turns).withColumn("loss", loss).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The conversations table as an event log: each row opens a message of its own.

    Rows that repeat a turn number are messages of their own too; equal rows are told apart by a count.
    """
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    numbered = conversations.select("conv_id", F.col("turn").alias("seq"), "role", "text", F.row_number().over(same).alias("copy"))
    return numbered.select("conv_id", "seq", F.lit("message").alias("kind"), F.struct("seq", "copy").alias("msg"), "role", "text")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -1, whose texts are control strings."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return read_back(render(fold_events(conversation_events(own.unionByName(extra)))))


QUERIES = {"op3_chat_formatting": op3_chat_formatting}
_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '(<|\[)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g')"
SQL = {
    "op3_chat_formatting": f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({len(START) + len(MIDDLE) + len(END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g"""
}
