"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, all others as named
users and system turns as they are; spans say which characters (texts and end marks of the assistant's turns) are learnt from.

A conversation comes in parts of ``PART`` consecutive turn numbers, one for nearly all conversations, whose texts follow one
another; so no row gathers a conversation without bound. A part with more than ``CROWD`` turns (many turns of one number) is cut into runs of
about so many turns that follow one another in dialogue order. Every part after the conversation's first system turn begins with that turn again.
Participants meet parts in an equi-join on the conversation, whose result is the output itself: participants times parts.

A null text is empty, a null role is the participant "unknown", null turns come first (as turn -1), rows without a
conversation id are one conversation. Turns of one number follow in order of a hash of their text and role; repeated rows (same
conversation, turn, role and text) are one turn. Conversations of system turns only have no participant and no row. Marks
inside texts and names are broken up by a blank. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

PART, CROWD = 256, 1024
SYSTEM, UNKNOWN, END = "system", "unknown", "<|end|>\n"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """conversation, perspective, part, n_turns and n_learnt (without a repeated system turn), text, spans (array of start and end, from 0, end exclusive)."""
    said = turns.select(
        F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"), F.coalesce(speaker_col, F.lit(UNKNOWN)).alias("speaker"), F.coalesce(text_col, F.lit("")).alias("said")
    ).withColumns({"block": F.floor(F.col("turn") / PART), "order": F.xxhash64("said", "speaker")})
    numbers = said.select("conv", "block", "turn", "order").distinct().groupBy("conv", "block", "turn").agg(F.count("*").alias("same"))
    inside = Window.partitionBy("conv", "block")  # at most PART turn numbers
    before = F.coalesce(F.sum("same").over(inside.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crowded = numbers.withColumns({"before": before, "all": F.sum("same").over(inside)}).where(F.col("all") > CROWD).select(F.col("conv").alias("full_conv"), F.col("turn").alias("full_turn"), "before", "same")
    crowded = written(crowded, "crowded")
    rank = F.shiftrightunsigned("order", 33).bitwiseXOR(F.lit(1 << 30)) / float(1 << 31)  # 0 to 1 in the order of turns of one number
    placed = said.join(crowded, F.col("conv").eqNullSafe(F.col("full_conv")) & (F.col("turn") == F.col("full_turn")), "left").withColumn("run", F.floor((F.col("before") + rank * F.col("same")) / CROWD))
    parts = placed.groupBy("conv", "block", "run").agg(F.array_sort(F.collect_set(F.struct("turn", "order", "speaker", "said"))).alias("own_turns"))
    first = said.where(F.col("speaker") == SYSTEM).groupBy(F.col("conv").alias("first_conv")).agg(F.min(F.struct("turn", "order", "speaker", "said")).alias("first"))
    people = said.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    late = F.get("own_turns", F.lit(0)) > F.col("first")
    seen = parts.join(first, F.col("conv").eqNullSafe(F.col("first_conv")), "left").join(people, F.col("conv").eqNullSafe(F.col("of"))).withColumn("turns", F.when(late, F.concat(F.array("first"), F.col("own_turns"))).otherwise(F.col("own_turns")))

    def head(t: Column) -> Column:
        return (
            F.when(t["speaker"] == SYSTEM, F.lit("<|system|>\n"))
            .when(t["speaker"] == F.col("perspective"), F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), _plain(t["speaker"]), F.lit("|>\n")))
        )

    drawn = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(_plain(t["said"]), F.lit(END)).alias("body"), (t["speaker"] == F.col("perspective")).alias("own")))
    pieces = seen.withColumn("drawn", drawn)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(t["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate("drawn", start, step)["spans"]
    return pieces.select(
        F.col("conv").alias(conv_col), "perspective", F.concat_ws(".", "block", "run").alias("part"), F.size("own_turns").cast("long").alias("n_turns"), F.size(F.filter("drawn", lambda t: t["own"])).cast("long").alias("n_learnt"),
        F.array_join(F.transform("drawn", lambda t: F.concat(t["head"], t["body"])), "").alias("text"), spans.alias("spans"),
    )


#: Parts of more than CROWD turns do not occur in the tables; DuckDB lists the turns of one number by the text instead of its hash, so they must differ in number.
ORACLE = r"""
WITH said AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
drawn AS (
    SELECT s.conv_id, perspective, floor(turn / 256)::BIGINT::VARCHAR AS part, turn, said, speaker, speaker = perspective AS own,
        CASE WHEN speaker = 'system' THEN E'<|system|>\n' WHEN speaker = perspective THEN E'<|assistant|>\n' ELSE '<|user name=' || replace(speaker, '<|', '< |') || E'|>\n' END AS head, said || E'<|end|>\n' AS body
    FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
parts AS (SELECT conv_id, floor(turn / 256)::BIGINT::VARCHAR AS part, min(turn) AS low FROM said GROUP BY ALL),
first AS (SELECT conv_id, turn, said FROM said WHERE speaker = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, said) = 1),
heads AS (SELECT p.conv_id, part, CASE WHEN p.low > f.turn THEN E'<|system|>\n' || f.said || E'<|end|>\n' ELSE '' END AS opening FROM parts p LEFT JOIN first f ON p.conv_id IS NOT DISTINCT FROM f.conv_id),
placed AS (
    SELECT d.*, opening, length(opening) + sum(length(head) + length(body)) OVER (PARTITION BY d.conv_id, perspective, d.part ORDER BY turn, said, speaker ROWS UNBOUNDED PRECEDING) AS stop
    FROM drawn d JOIN heads h ON d.conv_id IS NOT DISTINCT FROM h.conv_id AND d.part = h.part)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (own) AS n_learnt, opening || string_agg(head || body, '' ORDER BY turn, said, speaker) AS text,
    coalesce(string_agg((stop - length(body))::BIGINT::VARCHAR || '-' || stop::BIGINT::VARCHAR, ',' ORDER BY turn, said, speaker) FILTER (own), '') AS spans
FROM placed GROUP BY conv_id, perspective, part, opening
"""
