"""Chat formatting with typed content parts, in DataFrame functions alone.

A turn's content is an array of parts (kind, text, uri, units). A visitor flattens
it in order: text is escaped, an image, audio or document part becomes one
placeholder, its reference is recorded with the place of the placeholder, and it
counts ``units`` times the tokens of its kind. A turn is written

    <|turn|>role<|text|>content<|end|>

In roles and texts, ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so that no control
string can come from a text, and the original is got back by one replacement.

Turns are ordered by turn number (null first), ties by role, then content; repeated
rows are turns of their own. Null roles, texts and uris are empty; null units are 0;
parts of an unknown kind are text. A null conversation id is a conversation like others.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART = "struct<kind:string,text:string,uri:string,units:bigint>"
#: Tokens for each unit: image patches, audio frames of 40 ms, document pages.
TOKENS_PER_UNIT = {"image": 1, "audio": 1, "document": 256}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit("<|"), kind, F.lit("|>"))


def as_parts(text: Column) -> Column:
    """A plain text as content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("units"))).cast(f"array<{PART}>")


def visit(parts: Column, tokens_per_unit: dict | None = None) -> Column:
    """Each part as struct(shown, kind, uri, tokens); kind is null for text."""
    costs = tokens_per_unit or TOKENS_PER_UNIT

    def one(part: Column) -> Column:
        known = part["kind"].isin(*costs)
        cost = F.coalesce(*[F.when(part["kind"] == k, F.lit(v)) for k, v in costs.items()], F.lit(0))
        return F.struct(
            F.when(known, placeholder(part["kind"])).otherwise(escape(F.coalesce(part["text"], F.lit("")))).alias("shown"),
            F.when(known, part["kind"]).alias("kind"),
            F.when(known, F.coalesce(part["uri"], F.lit(""))).alias("uri"),
            F.when(known, F.coalesce(part["units"], F.lit(0)) * cost).otherwise(F.lit(0)).cast("long").alias("tokens"),
        )

    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), one)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """turns (conv_id, turn, role, parts) to one row for each conversation.

    conv_id, n_turns, formatted, loss_spans (start from 0 and length in code points of
    formatted), attachments (turn from 0, kind, uri, start of the placeholder in formatted,
    tokens) and expanded_tokens, the sum of the attachments' tokens.
    """
    seen = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), visit(F.col("parts")).alias("seen"))
    seen = seen.withColumn("body", F.array_join(F.transform("seen", lambda p: p["shown"]), ""))
    seen = seen.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "body")
    size = F.char_length("head") + F.char_length("body") + F.lit(len(END))
    placed = seen.withColumn("number", F.row_number().over(order) - 1).withColumn("at", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Places of the parts within a turn: few, so that summing those before each is cheap.
    within = lambda p, i: F.aggregate(F.slice("seen", F.lit(1), i), F.lit(0), lambda a, q: a + F.char_length(q["shown"]))
    files = F.filter(
        F.transform("seen", lambda p, i: F.struct(F.col("number").alias("turn"), p["kind"].alias("kind"), p["uri"].alias("uri"), (F.col("at") + F.char_length("head") + within(p, i)).cast("long").alias("start"), p["tokens"].alias("tokens"))),
        lambda p: p["kind"].isNotNull(),
    )
    span = F.when(F.col("role") == loss_role, F.struct((F.col("at") + F.char_length("head")).cast("long").alias("start"), F.char_length("body").cast("long").alias("length")))
    rows = placed.select("conv_id", F.struct("number", F.concat("head", "body", F.lit(END)).alias("shown"), span.alias("span"), files.alias("files")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    spans = F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull())
    attachments = F.flatten(F.transform("t", lambda t: t["files"]))
    out = grouped.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda t: t["shown"]), "").alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, f: a + f["tokens"]))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>; placeholders stay as they are."""
    pieces = F.split(formatted, r"<\|end\|>")
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def one(piece: Column) -> Column:
        cut = F.instr(piece, TEXT)
        role = F.substring(piece, F.lit(len(TURN) + 1), cut - 1 - len(TURN))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, cut + len(TEXT), F.char_length(piece))).alias("text"))

    return F.transform(whole, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    read = formatted.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
