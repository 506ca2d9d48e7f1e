"""Chat formatting of typed content parts.

A turn is a list of parts: text, image, audio, document. A visitor flattens them in order: text is
escaped, each other part becomes a placeholder that repeats for the tokens it expands to, and its
reference is recorded with its place. Control strings inside texts are escaped reversibly, so a turn
can never be forged; what was formatted can be read back exactly. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template: fixed values.
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def escape(text: Column) -> Column:
    """Backslashes are doubled, then every '<|' becomes '<\\|': no control string remains."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As text; a line end, which would end the role, becomes '<\\n'."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """The parts of a turn that is only text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))).cast(PARTS)


def _is_text(part: Column) -> Column:
    return ~F.coalesce(part["type"].isin(*PLACEHOLDERS), F.lit(False))


def flatten(parts: Column) -> Column:
    """The visitor: parts in order as one string. Null and unknown types count as text, null text as empty."""

    def visit(part: Column) -> Column:
        out = escape(F.coalesce(part["text"], F.lit("")))
        for kind, mark in PLACEHOLDERS.items():
            out = F.when(part["type"] == kind, F.repeat(F.lit(mark), F.greatest(F.lit(1), F.coalesce(part["tokens"], F.lit(1))))).otherwise(out)
        return out

    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(PARTS)), visit), "")


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per conversation: conv_id, n_turns, formatted, spans, attachments.

    turns: conv_id, turn, role, parts. Turns go by turn (null first), then role, then content. spans
    has per turn: at (where it begins), start and length of its text under the loss mask (length 0: none), in
    code points of formatted. attachments: turn's place, type, ref, tokens, in order. Null role or
    text is empty; a null conv_id is a conversation of its own; repeated rows are turns of their own. Very
    long texts are kept whole. Other columns of turns are ignored, so they may have any name. An empty
    table gives an empty result.
    """
    role, body = F.coalesce(F.col("role").cast("string"), F.lit("")), flatten(F.col("parts"))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    files = F.transform(F.filter(F.coalesce(F.col("parts"), F.array().cast(PARTS)), lambda p: ~_is_text(p)), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.greatest(F.lit(1), F.coalesce(p["tokens"], F.lit(1))).alias("tokens")))
    rows = turns.select("conv_id", F.col("turn"), head.alias("head"), body.alias("body"), role.isin(*loss_roles).alias("loss"), files.alias("files"))
    rows = rows.withColumn("chars", F.length("head") + F.length("body") + len(END) + 1)
    order = Window.partitionBy("conv_id").orderBy("turn", "head", "body")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("at", (F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars")).cast("long"))
    every = F.sort_array(F.collect_list(F.struct("n", "at", "head", "body", "loss", "files")))
    got = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), every.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    spans = F.transform("turns", lambda t: F.struct(t["at"].alias("at"), (t["at"] + F.length(t["head"])).alias("start"), F.when(t["loss"], F.length(t["body"])).otherwise(0).alias("length")))
    attached = F.flatten(F.transform("turns", lambda t: F.transform(t["files"], lambda f: F.struct(t["n"].alias("turn"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return got.select("conv_id", "n_turns", formatted.alias("formatted"), spans.alias("spans"), attached.alias("attachments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss (texts under the mask), parsed from formatted and spans alone."""
    pieces = F.slice(F.split(F.col("formatted"), r"<\|im_start\|>", -1), 2, 1 << 30)
    rows = formatted.withColumn("pieces", pieces)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        tail = F.length(role) + 2
        text = piece.substr(tail, F.length(piece) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    masked = F.zip_with("pieces", "spans", lambda p, s: F.when(s["length"] > 0, unescape(p.substr((s["start"] - s["at"] - len(START) + 1).cast("int"), s["length"].cast("int")))).otherwise(F.lit("")))
    return rows.select("conv_id", "n_turns", "formatted", F.transform("pieces", turn).alias("turns"), F.array_join(masked, "").alias("loss"))
