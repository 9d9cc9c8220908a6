"""Multi-party dialogues from every participant's point of view, with DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.session import cut

# Turns of one rendered row; a longer dialogue goes on in the next part.
PART_TURNS = 1_000
SETTINGS = ("system",)
# Characters of a text by which rows with one turn and role are ordered; texts that share them go by their SHA-256.
SORT_CHARS = 100
ORDER = ("turn", "role", "_start", "_sha")
START, END = "<|start|>", "<|end|>"


def plain(text: Column) -> Column:
    """A text that cannot be taken for a marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def parts_by_rank(t: DataFrame, part_turns: int) -> DataFrame:
    """``t`` with ``part`` from the row's rank in its dialogue. Rows are dealt by ranges, repeated ones too, and the
    ranges of a dialogue carry their counts forward, so no window group is longer than a range."""
    # Numbers that tell repeated rows apart are written first: a task done again then deals them alike.
    numbered = cut(t.withColumn("_row", F.monotonically_increasing_id()), "chat-rows")
    order = [*ORDER, "_row"]
    dealt = cut(numbered.repartitionByRange("conv_id", *order).withColumn("_range", F.spark_partition_id()), "chat-ranges")
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("conv_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id", "_range").orderBy(*order)))
    ranked = ranked.join(cut(before, "chat-before"), ranked["conv_id"].eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_r")))
    return ranked.withColumn("part", F.floor((F.col("_before") + F.col("_k") - 1) / part_turns).cast("bigint")).select(*t.columns, "part")


def rotate_perspectives(
    turns: DataFrame, settings: tuple[str, ...] = SETTINGS, part_turns: int = PART_TURNS,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per dialogue, participant and part: (conv_id, speaker, part, n_turns, n_chars, text, spans).

    Every role but those of ``settings`` is a participant. For each of them the dialogue is rendered
    with its own turns as ``assistant``, the turns of others as ``user:<name>`` and settings under their own
    name. ``spans`` marks what is learned: start and length, in characters of ``text``, of the participant's own
    contents with their end markers. Turns are ordered by turn, role, the first 100 characters of the text and its SHA-256,
    nulls first; a part holds ``part_turns`` of them, the next part goes on, so every row of the result is bounded. Most
    dialogues have only part 0.

    Repeated rows are repeated turns. A null text is empty. A null role speaks as ``user:unknown`` and is no participant. Rows with a null
    conv_id are one dialogue. A dialogue without participants gives no row, other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    t = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.substring(text, 1, SORT_CHARS).alias("_start"), F.sha2(text, 256).alias("_sha"), text.alias("text"),
    )
    speakers = t.where(F.col("role").isNotNull() & ~F.col("role").isin(*settings)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    # A dialogue of one part has no need of ranks.
    longer = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_turns)
    longer = cut(longer.select(F.col("conv_id").alias("_conv")), "chat-longer")
    is_longer = t["conv_id"].eqNullSafe(longer["_conv"])
    short = t.join(longer, is_longer, "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    t = short.unionByName(parts_by_rank(t.join(longer, is_longer, "left_semi"), part_turns))
    parts = t.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct(*ORDER, "text"))).alias("_turns"))
    # Written first, so that both sides of the join are plain tables and a hot dialogue can be split.
    parts, speakers = cut(parts, "chat-parts"), cut(speakers, "chat-speakers")
    each = parts.join(speakers.hint("merge"), parts["conv_id"].eqNullSafe(speakers["_conv"]))

    def head(x: Column) -> Column:
        name = F.coalesce(F.translate(plain(x["role"]), "\n\r", "  "), F.lit("unknown"))
        who = F.when(x["role"] == F.col("speaker"), "assistant").when(x["role"].isin(*settings), name).otherwise(F.concat(F.lit("user:"), name))
        return F.concat(F.lit(START), who, F.lit("\n"))

    body = F.transform("_turns", lambda x: F.struct(
        head(x).alias("head"), F.concat(plain(F.coalesce(x["text"], F.lit(""))), F.lit(END)).alias("body"),
        F.coalesce(x["role"] == F.col("speaker"), F.lit(False)).alias("own"),
    ))
    each = each.withColumn("_body", body)
    empty = F.array().cast("array<struct<start:int,length:int>>")
    spans = F.aggregate(
        "_body", F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + 1).alias("at"),
            F.when(x["own"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    rendered = F.array_join(F.transform("_body", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    return each.select(
        "conv_id", "speaker", "part", F.size("_turns").cast("bigint").alias("n_turns"), rendered.alias("text"), spans.alias("spans")
    ).withColumn("n_chars", F.length("text").cast("bigint"))


ORACLE = r"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, left(text, 100) NULLS FIRST, sha256(text) NULLS FIRST) AS n FROM conversations),
t AS (SELECT conv_id, (n - 1) // 1000 AS part, n, role, coalesce(replace(text, '<|', '< |'), '') || '<|end|>' AS body,
  coalesce(translate(replace(role, '<|', '< |'), chr(10) || chr(13), '  '), 'unknown') AS name FROM r),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
e AS (SELECT t.*, speaker, coalesce(role = speaker, false) AS own, '<|start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN name ELSE 'user:' || name END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e)
SELECT conv_id, speaker, part, count(*) AS n_turns, sum(length(head) + length(body) + 1)::BIGINT AS n_chars, string_agg(head || body || chr(10), '' ORDER BY n) AS text,
  string_agg((pos + length(head))::BIGINT || ':' || length(body), ',' ORDER BY n) FILTER (WHERE own) AS spans
FROM o GROUP BY 1, 2, 3
"""
