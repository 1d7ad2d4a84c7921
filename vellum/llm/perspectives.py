"""Chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant, the other
speakers as named users and system turns as they are; the mask gives the characters that the assistant contributed. Turns
stand in order of turn number, speaker and text. A long dialogue is stored in parts of PART_TURNS entries that follow each
other: the parts of a dialogue, joined in order, are the whole rendering, masks count from its first character, and n_parts
says how many there are.

Entries are put in order by range partitioning, so the order is exact however long one conversation is, and no row or task
ever holds an unbounded conversation. Turns that repeat are counted before they move; an entry is up to PART_TURNS of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import STEP, cut, sized, stored

PART_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"
KEY = ("key", "turn", "speaker", "text", "chunk")


def _safe(c: Column) -> Column:
    """A text or name cannot open a control token: ``<|`` is written ``< |``."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def entries(conversations: DataFrame) -> DataFrame:
    """(key, turn, speaker, text, chunk, times, rank): the turns of each conversation, numbered in order.

    An entry is ``times`` equal turns, PART_TURNS at most; key is a struct, so that a null conversation is one as well.
    """
    clean = lambda c, other: _safe(F.coalesce(F.col(c).cast("string"), F.lit(other)))
    rows = conversations.select(F.struct(F.col("conv_id").alias("id")).alias("key"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), clean("role", UNKNOWN).alias("speaker"), clean("text", "").alias("text"))
    counted = rows.groupBy(*KEY[:4]).agg(F.count(F.lit(1)).alias("n"))
    chunks = F.expr(f"(n - 1) div {PART_TURNS}")
    many = counted.withColumn("high", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(chunks / STEP))))
    many = many.withColumn("chunk", F.explode(F.sequence(F.col("high") * STEP, F.least((F.col("high") + 1) * STEP - 1, chunks))))
    many = many.select(*KEY, F.least(F.lit(PART_TURNS).cast("long"), F.col("n") - PART_TURNS * F.col("chunk")).cast("int").alias("times"))
    dealt = cut(many.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("pid", F.spark_partition_id()))
    counts = dealt.groupBy("key", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    bases = cut(counts.select("key", "pid", before.alias("base")).where("base > 0"))  # only a partition's first conversation has one
    here = F.row_number().over(Window.partitionBy("key", "pid").orderBy(*KEY[1:])) - 1
    return dealt.withColumn("here", here).join(sized(bases), ["key", "pid"], "left").select(*KEY, "times", (F.col("here") + F.coalesce("base", F.lit(0))).alias("rank"))


def _head(speaker: Column, assistant: Column) -> Column:
    """The line that opens a turn; a line break in a name is a space there."""
    role = F.when(speaker == SYSTEM, F.lit(SYSTEM)).when(assistant, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.translate(speaker, "\r\n", "  ")))
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


TAIL = CLOSE + "\n"


def viewers(parts: DataFrame) -> DataFrame:
    """(key, part, viewer, n_parts, offset): who sees each part, and at which character of the dialogue it begins for them."""
    length = lambda e: e.times * (F.length(_head(e.speaker, F.lit(False))) + F.length(e.text) + len(TAIL))
    plain = parts.select("key", "part", F.aggregate("es", F.lit(0).cast("long"), lambda a, e: a + length(e)).alias("chars"))
    own = parts.select("key", "part", F.explode("es").alias("e")).groupBy("key", "part", F.col("e.speaker").alias("viewer")).agg(F.sum("e.times").alias("own")).where(F.col("viewer") != SYSTEM)
    sized_ = plain.groupBy("key").agg((F.max("part") + 1).alias("n_parts"))
    before = lambda c, *keys: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = plain.select("key", "part", before("chars", "key").alias("begun")).join(own.select("key", "viewer").distinct(), "key").join(own, ["key", "part", "viewer"], "left")
    spoken = before("own", "key", "viewer")
    shift = F.length(_head(F.col("viewer"), F.lit(True))) - F.length(_head(F.col("viewer"), F.lit(False)))
    return seen.select("key", "part", "viewer", (F.col("begun") + spoken * shift).alias("offset")).join(sized_, "key")


def rotate(conversations: DataFrame) -> DataFrame:
    """(conv_id, speaker, part, n_parts, n_turns, rendered, mask, n_masked) for every participant and part.

    mask lists the assistant's character ranges in the whole dialogue as ``start-end`` pairs joined by commas, end exclusive;
    n_masked is their total length in this part. A null role is the participant ``unknown``; a null text is empty; a row
    without a turn number counts as turn -1. Rows that agree in all four columns are turns that repeat, and all are rendered.
    Turns that share a number follow each other by speaker and text. System turns are no participant's, so a conversation of
    system turns only gives no rows; nor does an empty table. A null conv_id is a conversation like any other. A very long text
    is one turn, never cut. Other columns do not matter.
    """
    item = F.struct("rank", "speaker", "text", "times")
    grouped = entries(conversations).groupBy("key", F.expr(f"rank div {PART_TURNS}").alias("part")).agg(F.sort_array(F.collect_list(item)).alias("es"))
    parts = stored(grouped, "dialogues")
    seen = parts.join(viewers(parts), ["key", "part"])
    turns = F.flatten(F.transform("es", lambda e: F.array_repeat(F.struct(e.speaker.alias("speaker"), e.text.alias("text")), e.times)))
    seen = seen.withColumn("ps", F.transform(turns, lambda t: F.struct(_head(t.speaker, t.speaker == F.col("viewer")).alias("head"), t.text.alias("text"), (t.speaker == F.col("viewer")).alias("own"))))
    zero = F.struct(F.col("offset").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, p: Column) -> Column:
        start = acc.at + F.length(p.head)
        end = start + F.length(p.text)
        spans = F.when(p.own, F.array_append(acc.spans, F.concat_ws("-", start.cast("string"), end.cast("string")))).otherwise(acc.spans)
        return F.struct((end + len(TAIL)).alias("at"), spans.alias("spans"), (acc.n + F.when(p.own, end - start).otherwise(0)).alias("n"))

    seen = seen.withColumn("m", F.aggregate("ps", zero, step))
    rendered = F.array_join(F.transform("ps", lambda p: F.concat(p.head, p.text, F.lit(TAIL))), "")
    return seen.select(F.col("key.id").alias("conv_id"), F.col("viewer").alias("speaker"), "part", "n_parts", F.size("ps").cast("long").alias("n_turns"), rendered.alias("rendered"), F.array_join("m.spans", ",").alias("mask"), F.col("m.n").alias("n_masked"))


#: DuckDB twin.
SQL = """
WITH r AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations),
u AS (SELECT conv_id, turn, speaker, body, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT *, unnest(range((n + 63) // 64)) AS chunk FROM u),
k AS (
  SELECT *, least(64, n - 64 * chunk) AS times,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, body, chunk) - 1 AS rank
  FROM c),
t AS (SELECT conv_id, speaker, body, rank, rank // 64 AS part, unnest(range(times)) AS i FROM k),
p AS (SELECT DISTINCT conv_id, speaker AS viewer FROM r WHERE speaker <> 'system'),
j AS (
  SELECT t.*, viewer, max(part) OVER (PARTITION BY t.conv_id) + 1 AS n_parts,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = viewer THEN 'assistant'
                                ELSE 'user name=' || translate(speaker, chr(13) || chr(10), '  ') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 11) OVER (
      PARTITION BY conv_id, viewer ORDER BY rank, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + length(head) AS place
  FROM j)
SELECT conv_id, viewer AS speaker, part, n_parts, count(*) AS n_turns,
       string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY rank, i) AS rendered,
       coalesce(string_agg(CAST(place AS BIGINT) || '-' || CAST(place + length(body) AS BIGINT), ',' ORDER BY rank, i) FILTER (speaker = viewer), '') AS mask,
       coalesce(sum(length(body)) FILTER (speaker = viewer), 0)::BIGINT AS n_masked
FROM s GROUP BY conv_id, viewer, part, n_parts
"""
