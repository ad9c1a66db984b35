"""Chat formatting with typed content parts, in built-in expressions only.

A conversation is a set of rows (conversation, turn, role, content) where content is an ordered array of typed parts:
text, image, audio or document. A visitor flattens each part into the turn's text: text is escaped, every other part
becomes a placeholder ``<kind:turn.part>`` and leaves an attachment reference with the tokens it will expand to.

Format of a turn: ``<turn>### role: body</turn>`` and a line feed. Raw ``<`` and ``###`` occur in control strings only:
inside texts and roles a backslash is written ``\\b``, ``<`` is ``\\l``, ``###`` is ``\\h`` (and ``:`` in a role is
``\\c``), so that every text can be read back exactly and no text can imitate a control string.

Defined cases: a null text or role is empty; a null or empty content array gives an empty body; a null part is skipped;
a part of unknown kind is an attachment of kind ``other``; rows of one conversation are ordered by (turn, role, body),
nulls first, so that ties and repeated rows have one order and repeated rows stay. Rows with a null conversation id form
one conversation. Other columns are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
KINDS = ("image", "audio", "document")
#: Tokens that an attachment expands to when its part does not say.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512, "other": 0}
PART_TYPE = "array<struct<kind:string,text:string,ref:string,n_tokens:bigint>>"


def escape(c: Column) -> Column:
    for raw, coded in (("\\", "\\b"), ("<", "\\l"), ("###", "\\h")):
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for coded, raw in (("\\h", "###"), ("\\l", "<"), ("\\b", "\\")):
        c = F.replace(c, F.lit(coded), F.lit(raw))
    return c


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(":"), F.lit("\\c"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\c"), F.lit(":")))


def text_parts(text: Column) -> Column:
    """The content array of a plain text: one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                    F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("n_tokens"))
    return F.array(part).cast(PART_TYPE)


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin("text", *KINDS), part["kind"]).otherwise(F.lit("other"))


def _tokens(part: Column) -> Column:
    out = F.lit(DEFAULT_TOKENS["other"])
    for k in KINDS:
        out = F.when(part["kind"] == k, F.lit(DEFAULT_TOKENS[k])).otherwise(out)
    return F.coalesce(part["n_tokens"], out.cast("bigint"))


def flatten_parts(content: Column, turn: Column) -> tuple[Column, Column]:
    """(body, attachments): the parts as escaped text and placeholders in order, and the references they stand for."""
    name = F.coalesce(turn.cast("string"), F.lit(""))
    parts = F.coalesce(content, F.array().cast(PART_TYPE))
    visit = F.transform(parts, lambda p, i: F.when(p.isNull(), F.lit("")).when(
        p["kind"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<"), _kind(p), F.lit(":"), name, F.lit("."), i.cast("string"), F.lit(">"))))
    placed = F.transform(parts, lambda p, i: F.struct(
        F.concat(name, F.lit("."), i.cast("string")).alias("slot"), F.when(p.isNotNull(), _kind(p)).alias("kind"),
        p["ref"].alias("ref"), _tokens(p).alias("n_tokens")))
    return F.array_join(visit, ""), F.filter(placed, lambda a: a["kind"].isNotNull() & (a["kind"] != "text"))


def format_conversations(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         content: str = "content", learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: formatted string, its segments with the loss flag, the loss mask, attachments and their tokens.

    `loss_mask` are the places (code points, ends exclusive) of the learned texts in the formatted string.

    Turns are rendered row by row before the one shuffle; a conversation is one string by nature of the format, so its
    rows meet in one group of that conversation's own size and nothing else does.
    """
    body, attachments = flatten_parts(F.col(content), F.col(turn))
    turns = rows.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), body.alias("body"),
        attachments.alias("attachments")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(OPEN + "### "), escape_role(t["role"]), F.lit(": ")).alias("text"), F.lit(False).alias("loss")),
        F.struct(t["body"].alias("text"), t["role"].isin(*learn_roles).alias("loss")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))))
    attached = F.flatten(F.transform("turns", lambda t: t["attachments"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("got"))

    def place(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s["text"])
        span = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["loss"], F.concat(acc["got"], span)).otherwise(acc["got"]).alias("got"))

    return grouped.select("conv_id", segments.alias("segments"), attached.alias("attachments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
        F.aggregate("segments", start, place, lambda acc: acc["got"]).alias("loss_mask"), "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["n_tokens"]).alias("attachment_tokens"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted string; attachments stay as placeholders."""
    pieces = F.split(formatted, OPEN)
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(
        unescape_role(F.substring_index(F.substring(p, 5, 1 << 30), ":", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, ":") + 2, F.length(p) - F.instr(p, ":") - 1 - len(CLOSE))).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output: turns, their digest, and the text that the loss mask cuts out of the string."""
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))), "")
    back = formatted.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), loss.alias("loss"), "attachment_tokens")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "attachment_tokens")


#: The extra conversation that the contract adds: control strings inside texts.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op10(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    both = rows.unionByName(probe)
    return digest(format_conversations(both.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("content"))))


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '###', '\h') AS et,
             replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '###', '\h'), ':', '\c') AS er FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, et)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, et), '')) AS loss_sha256,
       sum(length('<turn>### ' || er || ': ' || et || '</turn>' || chr(10)))::BIGINT AS formatted_chars,
       0::BIGINT AS attachment_tokens
FROM e GROUP BY conv_id
"""
