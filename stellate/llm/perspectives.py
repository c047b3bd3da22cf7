"""Multi-party dialogues from every speaker's point of view, in DataFrame operations only.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant and all
others as named users; the mask covers what the assistant says, with the end mark. System turns keep their
role, take no perspective and are never in the mask. A perspective is cut into parts of PART_TURNS turns, told
by their place in the order of turns and not by their numbers, so no task gathers a whole conversation, however
long and however its turns are numbered; texts of the parts joined in order are the dialogue, and part_start is
where a part's text begins in it. Places come from a range sort: those within a range, after the turns of the
conversation in earlier ranges.

Defined cases: a null role is the speaker ``unknown``; a null text is empty; null turns come first; turns of
equal number are ordered by role, then text; repeated rows are repeated turns; conversations with a null id
are one; a conversation of system turns only has no participant and gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stellate.llm.common import checkpointed

#: Turns of a part.
PART_TURNS = 128
SYSTEM = "system"
HEADS = {"system": "<|system|>\n", "own": "<|assistant|>\n", "other": "<|user name=", "after": "|>\n"}
END = "<|end|>\n"


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, part_start, n_turns, text, mask (``start:end`` of masked characters, comma-joined), mask_chars."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00"))
    own = turns.select(
        "conv_id", key.alias("c"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("body"),
    )
    dealt = checkpointed(own.repartitionByRange("c", "turn", "role", "body").withColumn("range", F.spark_partition_id()))
    ranges = dealt.groupBy("c", "range").count()  # a row for each range that a conversation reaches
    earlier = Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("c", "range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("range", "c").orderBy("turn", "role", "body"))
    own = dealt.withColumn("within", within).join(ranges, ["c", "range"])
    own = own.withColumn("part", F.expr(f"(earlier + within - 1) div {part_turns}")).drop("range", "within", "earlier")

    def head(role):
        return F.when(role == SYSTEM, HEADS["system"]).when(role == F.col("speaker"), HEADS["own"]).otherwise(F.concat(F.lit(HEADS["other"]), role, F.lit(HEADS["after"])))

    # sizes only: where each part begins for each speaker, so that texts move once
    sums = own.groupBy("c", "part", "role").agg(F.count("*").alias("n"), F.sum(F.length("body") + len(END)).alias("chars"))
    speakers = sums.where(F.col("role") != SYSTEM).select("c", F.col("role").alias("speaker")).distinct()
    sizes = sums.join(speakers, "c").groupBy("c", "speaker", "part").agg(F.sum(F.col("chars") + F.col("n") * F.length(head(F.col("role")))).alias("size"))
    before = Window.partitionBy("c", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("part_start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    views = sizes.groupBy("c", "part").agg(F.collect_list(F.struct("speaker", "part_start")).alias("views"))
    parts = own.groupBy("c", "part").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "role", "body"))).alias("turns"))
    views = parts.join(views, ["c", "part"]).select("conv_id", "part", "turns", F.explode("views").alias("v")).select("conv_id", "part", "turns", "v.speaker", "v.part_start")

    said = F.transform("turns", lambda t: F.struct(head(t["role"]).alias("head"), F.concat(t["body"], F.lit(END)).alias("body"), ((t["role"] == F.col("speaker")) & (t["role"] != SYSTEM)).alias("own")))
    views = views.select("conv_id", "speaker", "part", "part_start", said.alias("said"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("spans"), F.lit(0).cast("long").alias("chars"))

    def step(acc, t):
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"]) - 1  # the line break after the end mark stays out
        spans = F.when(t["own"], F.array_append(acc["spans"], F.concat_ws(":", start, end))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"), F.when(t["own"], acc["chars"] + end - start).otherwise(acc["chars"]).alias("chars"))

    views = views.select("conv_id", "speaker", "part", "part_start", F.size("said").cast("long").alias("n_turns"), F.array_join(F.transform("said", lambda t: F.concat(t["head"], t["body"])), "").alias("text"), F.aggregate("said", zero, step).alias("m"))
    return views.select("conv_id", "speaker", "part", "part_start", "n_turns", "text", F.array_join("m.spans", ",").alias("mask"), F.col("m.chars").alias("mask_chars"))


ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body,
                  (row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, -1), coalesce(role, 'unknown'), coalesce(text, '')) - 1) // {PART_TURNS} AS part FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
v AS (SELECT t.*, s.speaker, CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head,
             body || '<|end|>' || chr(10) AS said FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, role, body) AS k,
             sum(length(head) + length(said)) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, role, body ROWS UNBOUNDED PRECEDING) AS upto FROM v),
p AS (SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || said, '' ORDER BY k) AS text, max(upto) AS size,
             coalesce(string_agg((upto - length(said))::BIGINT || ':' || (upto - 1)::BIGINT, ',' ORDER BY k) FILTER (role = speaker), '') AS mask,
             coalesce(sum(length(said) - 1) FILTER (role = speaker), 0)::BIGINT AS mask_chars FROM w GROUP BY ALL)
SELECT conv_id, speaker, part, coalesce(sum(size) OVER (PARTITION BY conv_id, speaker ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part_start,
       n_turns, text, mask, mask_chars FROM p
"""
