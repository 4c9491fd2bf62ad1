"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one training example: all turns before it are context and only its
own text is trainable.  A conversation whose last turn is not an assistant's gets one more
example without a trainable part, so every turn of the input can be read back.

Template, one turn: ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``.  In roles and texts a
backslash is doubled, and a control string gets a backslash after its first character, so no
control string stands in escaped text; ``unescape`` drops each escaping backslash again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common chat templates; none may come out of a text as it is.  Fixed values.
CONTROL = [START, SEP, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _regex_quote(s: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}" else c for c in s)


def control_pattern() -> str:
    """Regex for the first character of a control string, the rest seen ahead."""
    return "|".join(f"{_regex_quote(c[0])}(?={_regex_quote(c[1:])})" for c in CONTROL)


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({control_pattern()})", "$1\\\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(role), F.lit(SEP), escape(text), F.lit(END))


def examples(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, example, formatted, loss_from, loss_to``: one row per assistant turn (and a last one without target).

    ``loss_from`` and ``loss_to`` are code-point positions in ``formatted``; the text between them is
    the (escaped) reply and the only trainable part.  They are equal in an example without a target.
    Rows of a conversation are ordered by turn, then role and text (null first).  A null text or
    role counts as empty.  Rows with a null conv_id form one conversation.  Repeated rows are repeated
    turns.  An empty table gives no rows; other columns are not read.  A conversation's examples
    hold its prefixes, as the method asks, so one task holds one conversation.
    """
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    formatted = turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), format_turn(x["role"], x["text"]).alias("s"), F.char_length(escape(x["text"])).alias("n"))).alias("t"))
    one = formatted.select("conv_id", "t", F.posexplode("t").alias("p", "x")).where((F.col("x.role") == "assistant") | (F.col("p") == F.size("t") - 1))
    whole = F.concat_ws("", F.transform(F.slice("t", 1, F.col("p") + 1), lambda x: x["s"]))
    out = one.select("conv_id", F.col("p").alias("example"), whole.alias("formatted"), F.col("x.role").alias("role"), F.col("x.n").alias("n"))
    end = F.char_length("formatted") - len(END)
    return out.select("conv_id", "example", "formatted", F.when(F.col("role") == "assistant", end - F.col("n")).otherwise(end).cast("long").alias("loss_from"), end.cast("long").alias("loss_to"))


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted example."""
    parts = F.filter(F.split(formatted, _regex_quote(END)), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(START) + 1, 1 << 30), SEP, 1)).alias("role"),
        unescape(F.substring_index(x, SEP, -1)).alias("text"),
    ))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation, from the formatted examples alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``: the turns come from
    the longest example, the trained text from the loss spans of all examples in order.
    """
    span = F.expr("substring(formatted, cast(loss_from as int) + 1, cast(loss_to - loss_from as int))")
    per = formatted.select("conv_id", "example", "formatted", unescape(span).alias("loss"), F.char_length("formatted").cast("long").alias("n"))
    conv = per.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted")).getField("formatted").alias("whole"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"])).alias("loss"),
        F.sum("n").alias("formatted_chars"),
    )
    turns = parse_turns(F.col("whole"))
    lines = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return conv.withColumn("turns", turns).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
