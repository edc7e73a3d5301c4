r"""Chat formatting in Spark expressions only.

Template: a block per run of turns with one role, ``<role>text</turn>text</turn></role>``, where ``role`` is the
escaped role. Texts and roles are escaped so that neither ``<`` nor a bare backslash is left in them
(backslash -> ``\b``, ``<`` -> ``\l``), and no ``>`` in roles (-> ``\g``); thus every ``<`` of the output starts a mark, the next ``>``
ends it, and no text or role can forge one. The loss mask has a span for each assistant text, without the marks around it.

Turns are collected in chunks of ``CHUNK`` turns first and chunks are joined afterwards, so a conversation that
holds a large share of all rows is sorted and formatted by many tasks; the last task sees one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .fingerprints import let

#: Turns that one task formats at a time; array entries whose running sums are taken together.
CHUNK, GROUP = 256, 256
END_TURN, END_BLOCK = "</turn>", "</role>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def sums_before(sizes: Column) -> Column:
    """Of each entry of a non-empty array of numbers, the sum of those before it.

    Summed in groups, and over groups, as growing an array by one entry copies it: n entries cost n * GROUP + (n / GROUP)**2.
    """

    def running(numbers: Column) -> Column:
        return F.aggregate(numbers, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("s")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["s"], F.array(a["at"])).alias("s")))

    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / GROUP).cast("int")), lambda g: F.slice(sizes, g * GROUP + 1, F.lit(GROUP)))
    inner = F.transform(groups, running)
    return let(inner, lambda own: F.flatten(F.zip_with(own, running(F.transform(own, lambda g: g["at"]))["s"], lambda g, base: F.transform(g["s"], lambda x: x + base))))


def merged(turns: Column) -> Column:
    """Array of (role, array of texts) from an array of such blocks: adjacent blocks of one role become one.

    Starts of runs are found by comparing neighbours and each run is one slice, so the work is linear in the turns.
    """
    starts = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))
    ends = F.concat(F.transform(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda i: i - 1), F.array(F.size(turns)))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda r: F.struct(F.get(turns, r["a"] - 1)["role"].alias("role"), F.flatten(F.transform(F.slice(turns, r["a"], r["b"] - r["a"] + 1), lambda t: t["texts"])).alias("texts")),
    )


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv, formatted string, mask (a span for each assistant text in it, 1-based start and length in code points).

    Turns are ordered by turn number, then role, then text, so rows that repeat a number have one order; repeated rows stay.
    Null text and null role count as empty, a null turn number sorts first, null conversation ids form one conversation.
    Texts of any length are formatted whole; a conversation's output is one string, which Spark holds up to 2 GB. An empty table gives
    an empty result. Columns besides the four named are not looked at.
    """
    shared.fresh(turns, conv, turn, role, text)
    rows = turns.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    )
    one = F.struct(F.col("_turn").alias("turn"), F.col("_role").alias("role"), F.col("_text").alias("text"))
    part = F.coalesce(F.floor(F.col("_turn") / CHUNK), F.lit(-1 << 62)).alias("_part")
    chunks = rows.groupBy("_conv", part).agg(F.sort_array(F.collect_list(one)).alias("_t"))
    blocks = chunks.select("_conv", "_part", F.transform("_t", lambda t: F.struct(escaped_role(t["role"]).alias("role"), F.array(escaped(t["text"])).alias("texts"))).alias("_b"))
    chunked = blocks.select("_conv", F.struct("_part", merged(F.col("_b")).alias("b")).alias("_c"))
    whole = chunked.groupBy("_conv").agg(F.flatten(F.transform(F.sort_array(F.collect_list("_c")), lambda c: c["b"])).alias("_b"))
    blocked = whole.select("_conv", merged(F.col("_b")).alias("_b"))
    written = F.array_join(
        F.transform("_b", lambda b: F.concat(F.lit("<"), b["role"], F.lit(">"), F.array_join(F.transform(b["texts"], lambda x: F.concat(x, F.lit(END_TURN))), ""), F.lit(END_BLOCK))), ""
    )
    # a text with the marks that its block puts around it; lengths laid end to end give the places
    def pieces(b: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            lead = F.when(i == 0, F.length(b["role"]) + 2).otherwise(0)
            tail = len(END_TURN) + F.when(i == F.size(b["texts"]) - 1, len(END_BLOCK)).otherwise(0)
            return F.struct((lead + F.length(x) + tail).cast("long").alias("size"), lead.alias("lead"), F.length(x).alias("length"), (b["role"] == "assistant").alias("own"))

        return F.transform(b["texts"], piece)

    laid = blocked.select("_conv", written.alias("_written"), F.flatten(F.transform("_b", pieces)).alias("_p"))
    placed = F.zip_with("_p", sums_before(F.transform("_p", lambda p: p["size"])), lambda p, at: F.struct(p["own"].alias("own"), (at + p["lead"] + 1).cast("int").alias("start"), p["length"].alias("length")))
    mask = F.transform(F.filter(placed, lambda p: p["own"]), lambda p: F.struct(p["start"], p["length"]))
    return laid.select(F.col("_conv").alias(conv), F.col("_written").alias("formatted"), mask.alias("mask"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted string, in order: array of struct(role, text), read from its marks alone."""
    blocks = F.split(formatted, END_BLOCK)
    whole = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        close = F.instr(block, ">")
        role = unescaped(F.substring(block, F.lit(2), close - 2))
        texts = F.split(F.substring(block, close + 1, F.length(block)), END_TURN)
        return F.transform(F.slice(texts, 1, F.greatest(F.size(texts) - 1, F.lit(0))), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(whole, turns))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The texts that the mask covers, unescaped and concatenated: the spans hold nothing else."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(formatted, m["start"], m["length"]))), "")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    done = format_chats(turns.unionByName(extra))
    read = done.select("conv_id", "formatted", parsed(F.col("formatted")).alias("_turns"), under_mask(F.col("formatted"), F.col("mask")).alias("_loss"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, coalesce(role <> lag(role) OVER w, true) AS opens,
    length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) AS role_len,
    length(replace(replace(text, '\', '\b'), '<', '\l')) AS text_len
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_len + 7 + CASE WHEN opens THEN role_len + 2 + 7 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
