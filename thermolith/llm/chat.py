r"""Chat formatting of typed content parts, in DataFrame operations only.

A conversation's rows are its turns; a turn has a role and a list of parts
(text, image, audio, document). The visitor turns each part into text: a text
part into itself with control characters escaped, any other into a placeholder
``<image:3>`` whose number counts the conversation's attachments, and notes the
attachment's reference and the tokens that it expands to. A turn is written

    <turn:role>content</turn>

Control strings begin with ``<``, which escaped text never holds: ``\`` becomes
``\s``, ``<`` becomes ``\l`` and ``>`` becomes ``\g``, in roles too. Undoing it
in the opposite order restores every text.

Each row is flattened where it stands; running sums over the conversation give
its place, so offsets need no loop over the whole. Rows of one conversation
meet once in one task, since they become one string: a conversation is as large
as a task can hold, and rows without conv_id are one conversation.

Cases: a null text is an empty one and a null role an empty role; null turns
come first; rows with equal turn numbers follow by role, then content; a null
conv_id is a conversation of its own; repeated rows are repeated turns; texts of
any length are kept whole; a part without type is text, and one of unknown type
a placeholder of no tokens; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, OPEN_END, CLOSE = "<turn:", ">", "</turn>"
LOSS_ROLES = ("assistant",)

#: Tokens that attachments expand to: side of an image patch, audio tokens a second, tokens of a document page.
PATCH, AUDIO_RATE, PAGE = 14, 25, 512

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\s"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for coded, plain in (("\\g", ">"), ("\\l", "<"), ("\\s", "\\")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def expanded_tokens(part: Column) -> Column:
    """Tokens that stand in for an attachment: image patches, audio frames, document pages; 0 for text."""

    def per(n: Column, size: int) -> Column:
        return F.ceil(F.coalesce(n, F.lit(0)).cast("double") / size)

    return (
        F.when(part["type"] == "image", per(part["width"], PATCH) * per(part["height"], PATCH))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def text_part(text: Column) -> Column:
    """A list with one text part."""
    fields = {"type": F.lit("text"), "text": text} | {n: F.lit(None) for n in ("ref", "width", "height", "seconds", "pages")}
    return F.array(F.struct(*(c.alias(n) for n, c in fields.items())).cast(PART))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in code points), attachments, attachment_tokens."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", F.col("parts").cast("string"))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)

    def so_far(n: Column) -> Column:
        return F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long")

    rows = rows.withColumns({"at": F.row_number().over(in_order), "files": F.filter("parts", lambda p: ~_is_text(p))})
    rows = rows.withColumn("first_file", so_far(F.size("files")))

    def flat(part: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(F.col("parts"), F.lit(1), i), lambda p: ~_is_text(p)))
        mark = F.concat(F.lit("<"), escape(part["type"]), F.lit(":"), (F.col("first_file") + earlier).cast("string"), F.lit(">"))
        return F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)

    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(OPEN_END))
    rows = rows.withColumns({"head": head, "body": F.array_join(F.transform("parts", flat), "")})
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    rows = rows.withColumn("start", so_far(F.char_length("piece")))
    span = F.struct((F.col("start") + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length"))
    files = F.transform(
        "files",
        lambda p, i: F.struct((F.col("first_file") + i).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
    )
    rows = rows.select("conv_id", F.struct("at", "piece", F.when(F.col("role").isin(*LOSS_ROLES), span).alias("loss"), files.alias("files")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    out = whole.select(
        "conv_id",
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.filter(F.col("t.loss"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten("t.files").alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as a list of role and text; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p.startswith(OPEN))

    def turn(piece: Column) -> Column:
        inside = F.substring(piece, F.lit(len(OPEN) + 1), F.char_length(piece))
        cut = F.instr(inside, OPEN_END)
        return F.struct(
            unescape(F.substring(inside, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(inside, cut + 1, F.char_length(inside))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op5_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    chats = format_chat(turns.unionByName(extra).withColumn("parts", text_part(F.coalesce(F.col("text"), F.lit("")))))
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(role) + length(text)
         + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + length('<turn:></turn>') AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _part(kind: str, when: Column, **fields: Column) -> Column:
    """A list with one part where ``when`` holds, else an empty one."""
    names = "text", "ref", "width", "height", "seconds", "pages"
    part = F.struct(F.lit(kind).alias("type"), *(fields.get(n, F.lit(None)).alias(n) for n in names)).cast(PART)
    return F.when(when, F.array(part)).otherwise(F.array().cast(f"array<{PART}>"))


def chat_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with documents, images and audio put beside their texts by a rule on conv_id and turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    conv, turn = F.col("conv_id"), F.col("turn")

    def named(kind: str, end: str) -> Column:
        return F.concat(F.lit(f"{kind}-"), conv.cast("string"), F.lit("-"), turn.cast("string"), F.lit(end))

    parts = F.concat(
        _part("document", (conv % 7 == 2) & (turn % 3 == 0), ref=named("doc", ".pdf"), pages=turn % 4),
        text_part(F.coalesce(F.col("text"), F.lit(""))),
        _part("image", (conv + turn) % 3 == 0, ref=named("img", ".png"), width=turn * 10 + 100, height=F.lit(60)),
        _part("audio", turn % 5 == 4, ref=named("aud", ".wav"), seconds=turn * 0.75 + 0.5),
    )
    chats = format_chat(turns.withColumn("parts", parts))
    loss = read_loss(F.col("formatted"), F.col("loss_spans"))
    return chats.select(
        "conv_id",
        F.sha2("formatted", 256).alias("formatted_sha256"),
        F.size("attachments").cast("long").alias("n_files"),
        F.array_join("attachments.ref", ",").alias("refs"),
        "attachment_tokens",
        F.char_length(loss).cast("long").alias("loss_chars"),
    )


TYPED_PARTS_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         CASE WHEN conv_id % 7 = 2 AND turn % 3 = 0 THEN 1 ELSE 0 END AS d,
         CASE WHEN (conv_id + turn) % 3 = 0 THEN 1 ELSE 0 END AS i,
         CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END AS a
  FROM conversations),
n AS (
  SELECT *, coalesce(sum(d + i + a) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f
  FROM t),
e AS (
  SELECT *, CASE WHEN d = 1 THEN '<document:' || f || '>' ELSE '' END AS before,
         replace(replace(replace(text, '\', '\s'), '<', '\l'), '>', '\g') AS body,
         CASE WHEN i = 1 THEN '<image:' || (f + d) || '>' ELSE '' END
         || CASE WHEN a = 1 THEN '<audio:' || (f + d + i) || '>' ELSE '' END AS after,
         concat_ws(',', CASE WHEN d = 1 THEN 'doc-' || conv_id || '-' || turn || '.pdf' END,
                   CASE WHEN i = 1 THEN 'img-' || conv_id || '-' || turn || '.png' END,
                   CASE WHEN a = 1 THEN 'aud-' || conv_id || '-' || turn || '.wav' END) AS refs,
         d * (turn % 4) * 512 + i * ceil((100 + 10 * turn) / 14.0) * 5 + a * ceil((turn * 0.75 + 0.5) * 25) AS tokens
  FROM n)
SELECT conv_id,
       sha256(string_agg('<turn:' || role || '>' || before || body || after || '</turn>', '' ORDER BY turn NULLS FIRST, role, text)) AS formatted_sha256,
       CAST(sum(d + i + a) AS BIGINT) AS n_files,
       coalesce(string_agg(nullif(refs, ''), ',' ORDER BY turn NULLS FIRST, role, text), '') AS refs,
       CAST(sum(tokens) AS BIGINT) AS attachment_tokens,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(before || text || after) ELSE 0 END) AS BIGINT) AS loss_chars
FROM e GROUP BY conv_id
"""
