"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only
its text is trainable. Turns after the last assistant turn, or all turns where there is none,
form one last example without a target. Built from DataFrame functions only.

Template, a turn: ``<|im_start|>`` role ``\\n`` text ``<|im_end|>\\n``. Escaping inside texts and
roles: a backslash follows every ``<`` and every ``[``, so that no control string of this template
or of the usual others (``</s>``, ``[INST]``, ``<<SYS>>``) is left in them; in roles a line break is
``<n``. Removing the one backslash after each gives the text back.

Defined results: null text or role counts as empty; turns go by turn (null first), then role, then
text; repeated rows are turns of their own; a null conversation is one conversation; a very long
conversation has as many characters of context as all its prefixes together; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<n"), F.lit("\n")))


def expand(conversations: DataFrame) -> DataFrame:
    """An example per assistant turn: conv_id, example, n_turns, context, target, trained, closing, last.

    The formatted example is context || target || closing; only ``target`` is under the loss
    mask, and ``trained`` says whether the example has one. ``last``: it holds the whole conversation's end.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    marked = F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END)))
    # An example's row has its own turn and the marked turns before it, not the conversation twice.
    size = F.size("turns")
    numbered = F.transform("turns", lambda t, i: F.struct((i + 1).alias("at"), t["role"].alias("role"), t["text"].alias("text")))
    targets = F.filter(numbered, lambda t: t["role"] == TRAINED_ROLE)
    none = F.struct((size + 1).alias("at"), F.lit("").alias("role"), F.lit("").alias("text"))
    tail = F.when(F.element_at("turns", -1)["role"] == TRAINED_ROLE, F.slice(F.array(none), 1, 0)).otherwise(F.array(none))
    cut = whole.select("conv_id", size.alias("n_turns"), marked.alias("marked"), F.explode(F.concat(targets, tail)).alias("own"))
    cut = cut.select("conv_id", "n_turns", F.slice("marked", F.lit(1), F.col("own.at") - 1).alias("marked"), "own", F.col("own.at").alias("at"))
    turn, trained = F.col("own"), F.col("at") <= F.col("n_turns")
    before = F.array_join("marked", "")
    return cut.select(
        "conv_id",
        F.col("at").alias("example"),
        "n_turns",
        F.when(trained, F.concat(before, head(turn))).otherwise(before).alias("context"),
        F.when(trained, escape(turn["text"])).otherwise("").alias("target"),
        trained.alias("trained"),
        F.when(trained, F.lit(END)).otherwise("").alias("closing"),
        (F.col("at") >= F.col("n_turns")).alias("last"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text)."""
    pieces = F.filter(F.split(formatted, "<\\|im_start\\|>"), lambda s: s != "")
    body = lambda s: F.substring_index(s, END, 1)
    role = lambda s: F.substring_index(body(s), "\n", 1)
    return F.transform(
        pieces,
        lambda s: F.struct(unescape_role(role(s)).alias("role"), unescape(F.substring(body(s), F.length(role(s)) + 2, F.length(s))).alias("text")),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: the turns, the loss text and the sizes."""
    formatted = F.concat("context", "target", "closing")
    per = examples.select(
        "conv_id",
        "example",
        F.when(F.col("last"), parse(formatted)).alias("turns"),
        F.when(F.col("trained"), unescape(F.col("target"))).alias("loss"),
        F.length(formatted).cast("long").alias("chars"),
    )
    own = per.groupBy("conv_id").agg(
        F.max_by("turns", F.when(F.col("turns").isNotNull(), F.col("example"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return own.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
