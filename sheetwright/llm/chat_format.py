"""Chat formatting by prefix-target expansion: every reply becomes an example of its own.

An example is a prefix, the conversation's formatted text before one reply, and a target, that reply with its end; only the target is
trainable. Examples are written out with their whole prefixes, so a conversation of n turns writes n^2 / 2 of them by nature. Prefixes grow
along a window, so a task holds one example at a time besides the turns of its part.

The template. A conversation begins with <s>. A reply is its text and </s>; any other turn is [INST], its role, a new line,
its text and [/INST]. Inside roles and texts each of these four strings gets a backslash after its bracket, and
one that has backslashes there already one more, so that taking one away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import cut

REPLY = "assistant"
BEGIN, ASK, ASKED, END = "<s>", "[INST]", "[/INST]", "</s>"
#: The bracket of a control string or of one that has backslashes; and with its first backslash.
CONTROL = r"(<(?=\\*/?s>)|\[(?=\\*/?INST\]))"
ESCAPED = r"(<(?=\\+/?s>)|\[(?=\\+/?INST\]))\\"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


def _role_line(role: Column) -> Column:
    r"""The role without new lines: \ as \b, a new line as \n."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role_back(line: Column) -> Column:
    return F.replace(F.replace(line, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def expand(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example, turn, prefix, target, loss_start, loss_stop: a row an example, in the shared folder; its text is the prefix and the target.

    example: its number in the conversation, from 0. loss_start to loss_stop, code points of that text, is what it trains. A conversation whose
    last turn is no reply has one more example, all of it prefix; its target is empty and its loss span null.

    Null texts and roles count as empty. Turns go by number, nulls first, equal ones by role and formatted text; repeated rows
    stay. A null conv_id is one more conversation. Extra columns don't matter; an empty table gives an empty result.

    Rows are dealt by ranges of (conversation, turn), so that a conversation of any length lies in several partitions: prefixes are made in
    each, and what the partitions before hold is put before them.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    reply = role == REPLY
    piece = F.when(reply, F.concat(escaped(text), F.lit(END))).otherwise(F.concat(F.lit(ASK), escaped(_role_line(role)), F.lit("\n"), escaped(text), F.lit(ASKED)))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), piece.alias("piece")).withColumn("key", F.struct("conv_id"))  # never null, so that joins take it
    order = ["turn", "role", "piece"]
    dealt = cut(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "chat-pieces")
    before = W.partitionBy("key", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    is_reply = F.col("role") == REPLY
    joined = lambda pieces: F.array_join(pieces, "")
    within = dealt.withColumns({"b_pieces": F.collect_list("piece").over(before), "b_rows": F.count("*").over(before), "b_replies": F.count_if(is_reply).over(before)})
    over = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy("key", "part").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x["piece"])).alias("p_text"), F.count("*").alias("p_rows"), F.count_if(is_reply).alias("p_replies"))
    parts = parts.select(
        "key", "part", joined(F.collect_list("p_text").over(over)).alias("s_text"), F.coalesce(F.sum("p_rows").over(over), F.lit(0)).alias("s_rows"),
        F.coalesce(F.sum("p_replies").over(over), F.lit(0)).alias("s_replies"), F.sum("p_rows").over(W.partitionBy("key")).alias("all_rows"),
    )
    placed = within.join(parts.hint("merge"), ["key", "part"]).filter(is_reply | (F.col("s_rows") + F.col("b_rows") + 1 == F.col("all_rows")))
    context = F.concat(F.lit(BEGIN), "s_text", joined(F.col("b_pieces")))
    made = placed.select("conv_id", (F.col("s_replies") + F.col("b_replies")).alias("example"), "turn", F.when(is_reply, context).otherwise(F.concat(context, "piece")).alias("prefix"), F.when(is_reply, F.col("piece")).otherwise("").alias("target"), is_reply.alias("trained"))
    start = F.when(F.col("trained"), F.char_length("prefix").cast("long"))
    return cut(made.select("conv_id", "example", "turn", "prefix", "target", start.alias("loss_start"), (start + F.char_length("target") - len(END)).alias("loss_stop")), "chat-examples")


def examples(expanded: DataFrame) -> DataFrame:
    """conv_id, example, context_chars, chars, loss_start, loss_stop: the examples without their texts."""
    context = F.char_length("prefix").cast("long")
    return expanded.select("conv_id", "example", context.alias("context_chars"), (context + F.char_length("target")).alias("chars"), "loss_start", "loss_stop")


def whole_texts(expanded: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (rows of examples) with text."""
    of = expanded.select(F.col("conv_id").alias("of_conv"), F.col("example").alias("of_example"), F.concat("prefix", "target").alias("text"))
    return wanted.join(of, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("example") == F.col("of_example"))).select(*wanted.columns, "text")


def read_back(expanded: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, replies array<string>, formatted_chars, n_examples, read from the examples' texts alone and their loss spans.

    The last example holds all turns; each reply is what its own example trains. formatted_chars: code points of all examples' texts. A
    conversation's longest text and its replies come together as one value (2 GB at most).
    """
    read = expanded.select("conv_id", "example", F.concat("prefix", "target").alias("text"), "loss_start", "loss_stop")
    trained = F.when(F.col("loss_start").isNotNull(), F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int")))
    of = read.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"), F.array_sort(F.collect_list(F.when(trained.isNotNull(), F.struct("example", trained.alias("said"))))).alias("trained"),
        F.sum(F.char_length("text")).alias("formatted_chars"), F.count("*").alias("n_examples"),
    )
    said = F.filter(F.split(F.substr("whole", F.lit(len(BEGIN) + 1)), r"(?<=</s>|\[/INST\])"), lambda s: s != "")
    replied = lambda s: s.endswith(END)
    inner = lambda s: F.substr(s, F.lit(len(ASK) + 1), F.char_length(s) - len(ASK) - len(ASKED))

    def turn(s: Column) -> Column:
        asked = inner(s)
        line = F.substring_index(asked, "\n", 1)
        role = F.when(replied(s), F.lit(REPLY)).otherwise(_role_back(unescaped(line)))
        body = F.when(replied(s), F.substr(s, F.lit(1), F.char_length(s) - len(END))).otherwise(F.substr(asked, F.char_length(line) + 2))
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    return of.select("conv_id", F.transform(said, turn).alias("turns"), F.transform("trained", lambda x: unescaped(x["said"])).alias("replies"), "formatted_chars", "n_examples")


def digests(back: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples of what read_back gives."""
    turns, loss = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), F.array_join("replies", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_examples")
