"""Chat formatting with typed content parts, as DataFrame expressions.

A turn is written `<|start|>role<|body|>content<|end|>`. The visitor walks a turn's parts in order: a text
part gives its escaped text, an image, audio or document part gives a placeholder and an attachment record
with its reference and the number of tokens it will expand to. Control strings inside roles and texts are
broken by a backslash after their first character, and backslashes are doubled, so that reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.common import table

START, BODY, END = "<|start|>", "<|body|>", "<|end|>"

#: What a tokenizer may read as control; no text may hold one unescaped. `<|` opens every mark here.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

#: Kinds of attachment and their placeholders.
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

#: Pixels along a patch (a token each), tokens a second of audio, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    control = "|".join(f"\\Q{c[0]}\\E(?=\\Q{c[1:]}\\E)" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), control, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content list of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("ref"), null.alias("width"), null.alias("height"), null.alias("seconds"), null.alias("pages"))).cast(PARTS)


def tokens(part: Column) -> Column:
    """Tokens that an attachment expands to: 1 at least, also where its measures are missing."""
    image = F.ceil(part.width / F.lit(PATCH)) * F.ceil(part.height / F.lit(PATCH))
    n = F.when(part.type == "image", image).when(part.type == "audio", F.ceil(part.seconds * AUDIO_RATE)).otherwise(part.pages * PAGE_TOKENS)
    return F.greatest(F.lit(1), F.coalesce(n.cast("long"), F.lit(1)))


def visit(part: Column) -> Column:
    """struct(piece, is_text) of one part; parts of unknown kinds count as text, null parts as empty text."""
    text = F.struct(escape(F.coalesce(part.text, F.lit(""))).alias("piece"), F.lit(True).alias("is_text"))
    out = None
    for kind, mark in PLACEHOLDER.items():
        hit = F.struct(F.lit(mark).alias("piece"), F.lit(False).alias("is_text"))
        out = F.when(part.type == kind, hit) if out is None else out.when(part.type == kind, hit)
    return out.otherwise(text)


def format_chats(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    Input: conv_id, turn, role, parts (PARTS). Turns are ordered by turn, then role and content, nulls first.
    loss_spans: array of (start, end) in code points of `formatted`, one for each text part of `learn_role`.
    attachments: (turn, kind, ref, tokens) in order. Null role, text or parts: empty. Repeated turns are all
    kept. Rows with a null conv_id form one conversation. A conversation is one value of the result and so has
    to fit a row; there is no other bound on turns or lengths. Other columns are ignored.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(PARTS)).alias("parts"))
    t = t.withColumn("pieces", F.transform("parts", visit)).withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(BODY)))
    t = t.withColumn("rendered", F.concat("head", F.array_join(F.col("pieces.piece"), ""), F.lit(END)))
    none = F.array().cast("array<struct<start:long,end:long>>")

    def span(s: Column, p: Column) -> Column:
        end = s.pos + F.length(p.piece)
        mark = F.when(p.is_text, F.array(F.struct(s.pos.alias("start"), end.alias("end")))).otherwise(none)
        return F.struct(end.alias("pos"), F.concat(s.spans, mark).alias("spans"))

    walk = F.aggregate("pieces", F.struct(F.length("head").cast("long").alias("pos"), none.alias("spans")), span)
    t = t.withColumn("spans", F.when(F.col("role") == learn_role, walk.spans).otherwise(none))
    held = F.filter("parts", lambda p: F.coalesce(p.type.isin(list(PLACEHOLDER)), F.lit(False)))
    t = t.withColumn("attached", F.transform(held, lambda p: F.struct(F.col("turn"), p.type.alias("kind"), p.ref.alias("ref"), tokens(p).alias("tokens"))))
    order = "PARTITION BY conv_id ORDER BY turn, role, rendered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    t = t.withColumn("at", F.coalesce(F.expr(f"sum(length(rendered)) OVER ({order})"), F.lit(0)))
    t = t.withColumn("spans", F.transform("spans", lambda s: F.struct((s.start + F.col("at")).alias("start"), (s.end + F.col("at")).alias("end"))))
    one = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "rendered", "at", "spans", "attached"))).alias("t"))
    one = one.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.col("t.rendered"), "").alias("formatted"), F.flatten(F.col("t.spans")).alias("loss_spans"), F.flatten(F.col("t.attached")).alias("attachments"))
    return one.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a.tokens))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted conversation; placeholders are left out of the text."""
    placeholder = "|".join(f"\\Q{p}\\E" for p in PLACEHOLDER.values())

    def turn(seg: Column) -> Column:
        head = F.substring_index(seg, BODY, 1)
        body = F.substring(seg, F.length(head) + len(BODY) + 1, F.length(seg) - F.length(head) - len(BODY + END))
        return F.struct(unescape(head).alias("role"), unescape(F.regexp_replace(body, placeholder, "")).alias("text"))

    segs = F.split(formatted, f"\\Q{START}\\E")
    return F.transform(F.slice(segs, F.lit(2), F.greatest(F.size(segs) - 1, F.lit(0))), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


#: The conversation that the query adds, as (conv_id, roles, text of every turn).
ADDED = (-1, ["user", "assistant"], "</s>[INST] ok [/INST]")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.lit(ADDED[0]).cast("long").alias("conv_id"), F.posexplode(F.array(*map(F.lit, ADDED[1]))).alias("turn", "role"), F.lit(ADDED[2]).alias("text"))
    rows = rows.unionByName(extra.withColumn("turn", F.col("turn").cast("long")))
    chats = format_chats(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    chats = chats.select("conv_id", "n_turns", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_length(c: str) -> str:
    count = lambda s: f"(length({c}) - length(replace({c}, '{s}', ''))) // {len(s)}"
    return f"(length({c}) + " + " + ".join(count(s) for s in ["\\", *CONTROL]) + ")"


OP3_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ADDED[2]}' UNION ALL SELECT -1, 1, 'assistant', '{ADDED[2]}'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({len(START + BODY + END)} + {_escaped_length("role")} + {_escaped_length("text")}) AS n
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(n AS BIGINT) AS formatted_chars FROM g
"""
