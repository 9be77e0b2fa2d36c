r"""Chat examples by prefix-target expansion: one example per assistant turn, trainable only in that reply.

Template: a turn is ``<|turn|>role<|says|>text<|end|>``. Roles and texts are escaped: ``\`` becomes ``\\`` and ``<|`` becomes
``<\|``. So ``<|`` occurs in control strings only, and dropping the backslash before each escaped character restores
every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
TARGET_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chat_examples(turns: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_length`` from ``turns(conv_id, turn, role, text)``.

    Example n of a conversation ends with its n-th assistant turn; all earlier turns are context. The loss mask is the
    span of code points [loss_start, loss_start + loss_length) of ``text``: the escaped reply. Turns after the last
    reply, or a conversation without one, form a last example with an empty mask, so that no turn is lost.

    An example holds its whole context, so its size and the number of examples grow with the conversation: a conversation
    is the unit of work. Turns are ordered by turn, role and text, nulls first; repeated rows are repeated turns. A null
    role or text is empty, and a null ``conv_id`` is a conversation. No rows give no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = turns.select("conv_id", F.struct(
        "turn", role.alias("role"), text.alias("text")).alias("t"))
    whole = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def rendered(t: Column) -> Column:
        return F.concat(F.lit(TURN), escaped(t["role"]), F.lit(SAYS), escaped(t["text"]), F.lit(END))

    n = F.size("t")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("t", i)["role"] == TARGET_ROLE) | (i == n))
    parts = whole.select("conv_id", "t", F.transform("t", rendered).alias("parts"), ends.alias("ends"))
    cut = parts.select("conv_id", "t", "parts", F.posexplode("ends").alias("example", "k"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("k") - 1), "")
    cut = cut.select("conv_id", F.col("example").cast("long"), context.alias("context"),
                     F.element_at("parts", F.col("k")).alias("reply"), F.element_at("t", F.col("k"))["role"].alias("role"))
    trained = F.col("role") == TARGET_ROLE
    start = F.length("context") + len(TURN) + len(TARGET_ROLE) + len(SAYS)
    whole_text = F.length("context") + F.length("reply")
    return cut.select(
        "conv_id", "example", F.concat("context", "reply").alias("text"),
        F.when(trained, start).otherwise(whole_text).alias("loss_start"),
        F.when(trained, whole_text - len(END) - start).otherwise(0).alias("loss_length"))


def read_back(examples: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, parsed from the examples' texts.

    The turns come from the last example of a conversation, which has them all, and the trained text from every mask.
    """
    masked = F.substring("text", F.col("loss_start") + 1, F.col("loss_length"))
    by_conv = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"),
        F.sort_array(F.collect_list(F.struct("example", unescaped(masked).alias("said")))).alias("said"),
        F.sum(F.length("text")).alias("formatted_chars"))
    pieces = F.filter(F.split("last", r"<\|end\|>", -1), lambda x: x != "")

    def turn(piece: Column) -> Column:
        pair = F.split(piece, r"<\|says\|>", 2)
        return F.concat(unescaped(F.substring(pair[0], len(TURN) + 1, 1 << 30)), F.lit("\n"), unescaped(pair[1]), F.lit("\n"))

    loss = F.array_join(F.transform("said", lambda s: s["said"]), "")
    parsed = by_conv.select("conv_id", pieces.alias("pieces"), loss.alias("loss"), "formatted_chars")
    return parsed.select(
        "conv_id", F.size("pieces").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("pieces", turn), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
