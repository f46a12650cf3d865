"""Chat formatting with typed content parts, in SQL functions only.

A message is a list of parts (kind, text, ref, units). A visitor turns the list into one string: texts are escaped, image,
audio and document parts become placeholders in the order of the parts, and every placeholder has one row in the list of
attachments (message, part, kind, reference, tokens it expands to). The template is

    <|turn|>ROLE<|text|>BODY<|end|>

per message. Inside texts and roles every control string (`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`) gets one more `~`
after its first character, and one fewer when read back, so a formatted conversation holds control strings only where the
template put them. The loss mask has one span (piece, start, length, in code points) per message of a trained role.

One shuffle by conversation. A conversation is one string by definition, so its turns meet in one task; no other group does.

Defined results: null text or no parts: empty body; null role: empty role; turns are ordered by (turn, role, body), null
first; repeated rows are kept; a null conversation id is a conversation of its own; an empty table gives an empty table;
other columns do not matter. Parts of an unknown kind are attachments of one token per unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: control strings of the template and of common other ones; tokens per unit of an attachment
CONTROL = [(r"<", r"\|"), (r"<", r"/?s>"), (r"\[", r"/?INST\]")]
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}  # per tile, second, page
TRAINED = ("assistant",)


def escape(text: Column) -> Column:
    for head, tail in CONTROL:
        text = F.regexp_replace(text, f"({head})(~*)({tail})", "$1$2~$3")
    return text


def unescape(text: Column) -> Column:
    for head, tail in reversed(CONTROL):
        text = F.regexp_replace(text, f"({head})(~*)~({tail})", "$1$2$3")
    return text


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    kind = "array<struct<kind:string,text:string,ref:string,units:bigint>>"
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(kind)


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def body(parts: Column) -> Column:
    """The visitor: parts to one string with placeholders."""
    known = F.array(*[F.lit(k) for k in TOKENS_PER_UNIT])
    shown = lambda p: F.when(F.array_contains(known, p["kind"]), p["kind"]).otherwise("attachment")
    visit = lambda p: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), shown(p), F.lit("|>")))
    return F.coalesce(F.array_join(F.transform(parts, visit), ""), F.lit(""))


def attachments(parts: Column) -> Column:
    """One row per placeholder of a message, in order: part, kind, ref, tokens."""
    tokens = F.lit(1)
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["units"], F.lit(1)).alias("units")))

    def entry(x: Column) -> Column:
        each = tokens
        for kind, n in TOKENS_PER_UNIT.items():
            each = F.when(x["kind"] == kind, F.lit(n)).otherwise(each)
        return F.struct(x["part"].alias("part"), x["kind"].alias("kind"), x["ref"].alias("ref"), (x["units"] * each).cast("bigint").alias("tokens"))

    kept = F.filter(numbered, lambda x: F.coalesce(x["kind"], F.lit("text")) != "text")
    return F.coalesce(F.transform(kept, entry), F.array().cast("array<struct<part:int,kind:string,ref:string,tokens:bigint>>"))


def format_conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained: tuple[str, ...] = TRAINED
) -> DataFrame:
    """Per conversation: formatted, n_turns, loss (piece, start, length, offset in the whole), attachments, expanded_tokens."""
    role, parts = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.col(parts_col)
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), body(parts).alias("body"), attachments(parts).alias("files")
    )
    head = F.concat(F.lit("<|turn|>"), escape(F.col("role")), F.lit("<|text|>"))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", "body", F.lit("<|end|>")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("body")]
    in_order = Window.partitionBy("conv").orderBy(*order)
    rows = rows.select(
        "conv", "piece", "files", (F.row_number().over(in_order) - 1).alias("k"),
        F.coalesce(F.sum(F.char_length("piece")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.col("role").isin(*trained).alias("trained"), F.char_length("head").cast("bigint").alias("start"), F.char_length("body").cast("bigint").alias("length"),
    )
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("k", "before", "start", "length", "trained", "piece", "files"))).alias("turns"))
    span = lambda t: F.struct(t["k"].alias("piece"), t["start"].alias("start"), t["length"].alias("length"), (t["before"] + t["start"]).alias("offset"))
    file = lambda t: F.transform(t["files"], lambda f: F.struct(t["k"].alias("piece"), f["part"].alias("part"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))
    out = whole.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.transform(F.filter("turns", lambda t: t["trained"]), span).alias("loss"),
        F.flatten(F.transform("turns", file)).alias("attachments"),
    )
    total = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"])
    return out.withColumn("expanded_tokens", total)


def pieces(formatted: Column) -> Column:
    """The formatted messages of a conversation."""
    return F.filter(F.split(formatted, r"(?<=<\|end\|>)"), lambda p: p != "")


def read_turns(formatted: Column) -> Column:
    """Read a formatted conversation back: array of (role, text). Placeholders stay in the text."""
    fields = F.transform(pieces(formatted), lambda p: F.split(p, r"<\|turn\|>|<\|text\|>|<\|end\|>"))
    return F.transform(fields, lambda x: F.struct(unescape(x[1]).alias("role"), unescape(x[2]).alias("text")))


def read_loss(parts: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order; ``parts``: a column of `pieces`. Linear in the conversation."""

    def text(span: Column) -> Column:
        piece = F.element_at(parts, (span["piece"] + 1).cast("int"))
        return unescape(F.substring(piece, (span["start"] + 1).cast("int"), span["length"].cast("int")))

    return F.transform(loss, text)


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Contract columns, from the formatted output alone."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = formatted.select(
        conv_col, F.char_length("formatted").cast("bigint").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"),
        F.col("loss"), pieces(F.col("formatted")).alias("pieces"), "expanded_tokens", "attachments",
    )
    back = back.withColumn("under", F.array_join(read_loss(F.col("pieces"), F.col("loss")), ""))
    return back.select(
        conv_col, F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("under").cast("bigint").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), "formatted_chars",
        F.size("attachments").cast("bigint").alias("n_attachments"), "expanded_tokens",
    )
