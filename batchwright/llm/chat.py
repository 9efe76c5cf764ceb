r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn has a role and an ordered list of parts: text, image, audio or document. A visitor flattens them in order:
a text part gives its text, any other a placeholder ``<|type|>`` and an attachment record (turn, part, type,
reference, tokens). A conversation is written as

    <|turn|>role<|says|>content<|end|>  ...

Control strings inside roles and texts can't be mistaken for the template's: ``\`` is written ``\e``, ``<`` is
``\l`` and ``[`` is ``\k`` (so neither ``<|...|>`` nor ``</s>``, ``[INST]`` and the like stay), undone by replacing
``\l``, ``\k`` and last ``\e``. The loss mask is the list of spans of assistant contents in the output.

Expanded tokens: a placeholder stands for as many tokens as its part says (``n_tokens``; null: none).

Defined cases: a null text is empty, a null role is ''; turns are ordered by turn (nulls last), then role, then
content, so repeated turns all stay in a fixed order; turns with a null conv_id form one conversation; an empty
table gives no rows; other columns are ignored. A conversation is one output row, so its turns meet in one task;
its size is that of its own text, and no other conversation shares its fate. Time is linear in the number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<type:string,text:string,ref:string,n_tokens:bigint>>"
#: The types of parts besides text.
ATTACHED = ("image", "audio", "document")
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\k"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\k"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("n_tokens"))).cast(PARTS)


def visit(part: Column) -> Column:
    """What a part gives to the content."""
    return F.when(part["type"].isin(*ATTACHED), F.concat(F.lit("<|"), part["type"], F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", train_on: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans (start from 0, length; in characters), attachments, expanded_tokens."""
    shown = turns.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).isNull().alias("unnumbered"),
            F.col(turn).cast("long").alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.concat_ws("", F.transform(F.coalesce(F.col(parts), F.array().cast(PARTS)), visit)).alias("content"),
            F.filter(F.transform(F.coalesce(F.col(parts), F.array().cast(PARTS)), lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens"))), lambda p: p["type"].isin(*ATTACHED)).alias("attached"),
        ).alias("t"),
    )
    heads = F.concat(F.lit(TURN), escape(F.col("t.role")), F.lit(SAYS))
    sized = shown.select("conv_id", "t", heads.alias("head")).withColumn("size", (F.char_length("head") + F.char_length("t.content") + len(END)).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("start", F.sum("size").over(before) - F.char_length("t.content") - len(END))
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t", "head", "start"))).alias("turns"))
    trained = F.filter("turns", lambda x: x["t"]["role"].isin(*train_on))
    spans = F.transform(trained, lambda x: F.struct(x["start"].cast("int").alias("start"), F.char_length(x["t"]["content"]).alias("length")))
    attachments = F.flatten(F.transform("turns", lambda x, i: F.transform(x["t"]["attached"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    return gathered.select(
        "conv_id",
        F.concat_ws("", F.transform("turns", lambda x: F.concat(x["head"], x["t"]["content"], F.lit(END)))).alias("formatted"),
        spans.alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + F.coalesce(a["n_tokens"], F.lit(0))))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text, formatted: parsed from the formatted strings alone. A placeholder
    comes back as itself."""
    blocks = F.filter(F.split("formatted", r"<\|turn\|>"), lambda _, i: i > 0)
    turns = F.transform(blocks, _turn)
    # Four bytes a character, so that a span is found without counting characters from the start; bound once by a lambda.
    wide = F.array(F.encode("formatted", "UTF-32"))
    loss = F.transform(wide, lambda w: F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(w, 4 * s["start"] + 1, 4 * s["length"]), "UTF-32")))))[0]
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def _turn(block: Column) -> Column:
    """The role and text of a block ``role<|says|>content<|end|>``."""
    role = F.substring_index(block, SAYS, 1)
    content = F.substring(block, F.char_length(role) + len(SAYS) + 1, F.char_length(block) - F.char_length(role) - len(SAYS) - len(END))
    return F.struct(unescape(role).alias("role"), unescape(content).alias("text"))


def digests(read: DataFrame) -> DataFrame:
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
