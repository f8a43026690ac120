"""Chat formatting with typed content parts.

A turn's content is a list of typed parts (text, image, audio, document). The visitor ``flatten``
walks the parts in order: text is escaped, every other part becomes a numbered placeholder, its
reference goes to an attachment list and its expanded token count is worked out from its size.
Turns are then wrapped in the template

    <turn role="ROLE">BODY</turn>\n

and joined. Escaping writes ``\\`` as ``\\b``, ``<`` as ``\\l`` and (in attributes) ``"`` as ``\\q``,
so a formatted text holds ``<`` only where the template or a placeholder put it, and undoing the
escapes one kind after the other gives back the text exactly. The loss mask is a list of code point
intervals of the formatted text, one per turn, with a flag for turns that are trained on.

Only built-in functions run. There is one shuffle, by conversation; a formatted conversation is one
value, so its turns meet in one row by definition of the result.

Defined results: a null text, role or part list counts as empty. Turns are ordered by turn (null
first), then role, then body; repeated rows are repeated turns. A row with a null conversation id is
a conversation of its own, so such rows never gather. An empty table gives no conversations. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tauframe.llm.text import table, whole

#: amount: code points of nothing (text), pixels wide x high, milliseconds, pages.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,millis:bigint,pages:int>"
PATCH = 28
AUDIO_TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 512
TURN_END = "</turn>\n"
TRAINED_ROLE = "assistant"
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escape_attribute(text: Column) -> Column:
    return F.replace(escape(text), F.lit('"'), F.lit("\\q"))


def unescape(text: Column) -> Column:
    """Undo both escapes: after escaping, each backslash begins a two-character code."""
    for code, plain in (("\\q", '"'), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_parts(text: Column | str) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), whole(text).alias("text"), F.lit(None).cast("string").alias("ref"),
        *(F.lit(None).cast(t).alias(n) for n, t in
          (("width", "int"), ("height", "int"), ("millis", "bigint"), ("pages", "int")))).cast(PART))


def expanded_tokens(part: Column) -> Column:
    """Tokens a placeholder stands for; 0 for text and for parts of unknown size."""
    up = lambda a, b: F.ceil(a / b)
    n = (F.when(part["kind"] == "image", up(part["width"], PATCH) * up(part["height"], PATCH))
         .when(part["kind"] == "audio", up(part["millis"] * AUDIO_TOKENS_PER_SECOND, 1000))
         .when(part["kind"] == "document", part["pages"].cast("long") * TOKENS_PER_PAGE))
    return F.coalesce(n.cast("long"), F.lit(0).cast("long"))


def is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def attachments(parts: Column) -> Column:
    """``place, kind, ref, tokens`` of the parts that are not text, numbered by place from 0."""
    return F.transform(
        F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("place"), p.alias("p"))),
                 lambda x: ~is_text(x["p"])),
        lambda x: F.struct(x["place"].alias("place"), x["p"]["kind"].alias("kind"),
                           whole(x["p"]["ref"]).alias("ref"),
                           expanded_tokens(x["p"]).alias("tokens")))


def flatten(parts: Column) -> Column:
    """The body of a turn: escaped text and ``<part kind=".." n="place"/>`` in their order."""
    return F.array_join(F.transform(parts, lambda p, i: F.when(
        is_text(p), escape(whole(p["text"]))).otherwise(F.concat(
            F.lit('<part kind="'), escape_attribute(whole(p["kind"])), F.lit('" n="'),
            i.cast("string"), F.lit('"/>')))), "")


def format_conversations(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """From rows ``conv_id, turn, role, parts``: one row per conversation with ``formatted``,
    ``mask`` (``start, end, trained`` of each turn's body), ``attachments`` and ``n_tokens`` (what
    the placeholders expand to)."""
    parts = F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    rows = turns.select(
        "conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("_own"),
        "turn", whole("role").alias("role"), parts.alias("parts"))
    rows = rows.select(
        "conv_id", "_own", "turn", "role",
        F.concat(F.lit('<turn role="'), escape_attribute(F.col("role")), F.lit('">')).alias("head"),
        flatten(F.col("parts")).alias("body"), attachments(F.col("parts")).alias("att"))
    rows = rows.withColumn("n", F.char_length("head") + F.char_length("body") + len(TURN_END))
    so_far = Window.partitionBy("conv_id", "_own").orderBy("turn", "role", "body")
    begin = F.coalesce(F.sum("n").over(so_far.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0)) + F.char_length("head")
    rows = rows.select("conv_id", "_own", F.struct(
        F.row_number().over(so_far).alias("k"), F.concat("head", "body", F.lit(TURN_END)).alias("piece"),
        F.struct(begin.alias("start"), (begin + F.char_length("body")).alias("end"),
                 (F.col("role") == trained_role).alias("trained")).alias("mask"), "att").alias("t"))
    got = rows.groupBy("conv_id", "_own").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return got.select(
        "conv_id", F.array_join("t.piece", "").alias("formatted"), F.col("t.mask").alias("mask"),
        F.flatten(F.transform("t", lambda t: F.transform(t["att"], lambda a: F.struct(
            t["k"].alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"),
            a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    ).withColumn("n_tokens", F.aggregate("attachments", F.lit(0).cast("long"),
                                         lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (``role, text, trained``), read from ``formatted`` and ``mask`` alone.

    Placeholders carry no text. A mask that does not fit the turns in the text raises an error.
    """
    rows = formatted.withColumn("_piece", F.split("formatted", TURN_END))
    rows = rows.withColumn("_piece", F.slice("_piece", 1, F.size("_piece") - 1))
    rows = rows.withColumn("_turn", F.zip_with("_piece", "mask", lambda s, m: F.struct(
        F.regexp_extract(s, '^<turn role="([^"]*)">', 1).alias("role"), s.alias("s"), m.alias("m"))))
    rows = rows.withColumn("_turn", F.transform("_turn", lambda t, i: F.struct(
        unescape(t["role"]).alias("role"),
        F.substring(t["s"], F.char_length(t["role"]) + 15, F.char_length(t["s"])).alias("body"),
        t["m"].alias("m"),
        (t["m"]["start"] == F.coalesce(F.get("mask", i - 1)["end"] + len(TURN_END), F.lit(0))
         + F.char_length(t["role"]) + 14).alias("fits"))))
    sound = F.forall("_turn", lambda t: F.coalesce(t["fits"] & (
        t["m"]["end"] - t["m"]["start"] == F.char_length(t["body"])), F.lit(False)))
    turns = F.transform("_turn", lambda t: F.struct(
        t["role"].alias("role"), unescape(F.regexp_replace(t["body"], "<[^>]*>", "")).alias("text"),
        t["m"]["trained"].alias("trained")))
    return rows.select(*formatted.columns, F.when(sound, turns).otherwise(
        F.raise_error(F.lit("the loss mask does not fit the formatted text"))).alias("turns"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"))
    turns = given.unionByName(extra).select("conv_id", "turn", "role", text_parts("text").alias("parts"))
    rows = read_back(format_conversations(turns))
    rows = rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.array_join(F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: t["text"]), "")
        .alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"))
    return rows.select("conv_id", "n_turns", "turns_sha256",
                       F.char_length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_attachments")


SQL = {"op6_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations UNION ALL
           SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum(length('<turn role="">' || replace(replace(role, '\', '\b'), '<', '\l')
      || replace(replace(text, '\', '\b'), '<', '\l') || '</turn>') + 1)::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments
FROM c GROUP BY conv_id"""}
