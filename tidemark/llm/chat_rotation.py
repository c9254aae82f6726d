"""Chat formatting: a conversation seen by each of its participants."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Turn numbers that share a part: a dialogue is one row up to here, and a longer one goes on in further parts, so that no row is unbounded.
TURNS = 1024
#: The marks around a turn, and what they start with; in names and texts that is written with a space, so that nobody can forge a turn.
OPEN, SHUT = "<|im_start|>", "<|im_end|>\n"
MARK, PLAIN = "<|", "< |"


def _segment(own: Column, role: Column, text: Column) -> tuple[Column, Column, Column]:
    """Rendered turn, and where its text begins and ends (which only counts if it is the assistant's own)."""
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), role, F.lit("\n")))
    return F.concat(head, text, F.lit(SHUT)), F.length(head), F.length(head) + F.length(text)


def rotate(turns: DataFrame, width: int = TURNS) -> DataFrame:
    """conv_id, participant, part, n_turns, n_own, text, mask: every participant's view of every part.

    ``turns`` has conv_id, turn, role and text. In a participant's view its own turns are the
    assistant's, all others those of users named by their role. ``mask`` holds begin:end (code points in the
    part's text, end exclusive) of the assistant's texts with their closing mark, the places to learn from.
    A part holds the turns whose number divided by ``width`` gives the same whole number; participants without a turn in
    a part still see it. Parts in order make up the conversation.

    In roles and texts ``<|`` is written ``< |``, and in roles a line break as a space: only rendered turns hold marks.
    Turns go by number, then role, then text; a row that is there more than once is rendered once. Every participant sees all
    turns, so the result is as large as the table times the participants of a conversation.
    A null role is a participant named ``unknown``, null text is empty, a null turn comes first in
    part 0. Rows with a null conv_id belong to no conversation and are left out.
    """
    plain = lambda x, null: F.replace(F.coalesce(x, F.lit(null)), F.lit(MARK), F.lit(PLAIN))
    role, text = F.replace(plain("role", "unknown"), F.lit("\n"), F.lit(" ")).alias("role"), plain("text", "").alias("text")
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", role, text).distinct()
    rows = rows.withColumn("part", F.coalesce(F.expr(f"cast(floor(turn / {width}) as bigint)"), F.lit(0)))
    people = rows.select("conv_id", F.col("role").alias("participant")).distinct()
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    seen = parts.join(people, "conv_id")
    own = lambda t: t["role"] == F.col("participant")

    def render(t: Column) -> Column:
        seg, lo, hi = _segment(own(t), t["role"], t["text"])
        return F.struct(seg.alias("seg"), lo.alias("lo"), (hi + len(SHUT) - 1).alias("hi"), own(t).alias("own"))

    seen = seen.withColumn("segs", F.transform("turns", render))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("mask"))

    def step(acc: Column, s: Column) -> Column:
        span = F.concat_ws(":", acc["at"] + s["lo"], acc["at"] + s["hi"])
        return F.struct((acc["at"] + F.length(s["seg"])).alias("at"), F.when(s["own"], F.array_append(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    mask = F.array_join(F.aggregate("segs", start, step)["mask"], ",")
    n_own = F.size(F.filter("segs", lambda s: s["own"]))
    return seen.select("conv_id", "participant", "part", F.size("segs").cast("long").alias("n_turns"), n_own.cast("long").alias("n_own"), F.array_join(F.transform("segs", lambda s: s["seg"]), "").alias("text"), mask.alias("mask"))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, seen by each of their participants."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP6_SQL = """
WITH r AS (SELECT DISTINCT conv_id, turn, replace(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10), ' ') AS role, replace(coalesce(text, ''), '<|', '< |') AS text, coalesce(CAST(floor(turn / 1024) AS BIGINT), 0) AS part FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS participant FROM r),
s AS (SELECT r.*, participant, role = participant AS own, CASE WHEN role = participant THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || role || chr(10) END AS head FROM r JOIN p USING (conv_id)),
q AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS seg FROM s),
o AS (SELECT *, sum(length(seg)) OVER w - length(seg) AS at_, row_number() OVER w AS nth FROM q WINDOW w AS (PARTITION BY conv_id, participant, part ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, participant, part, count(*) AS n_turns, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_own, string_agg(seg, '' ORDER BY nth) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(at_ + length(head) AS BIGINT) || ':' || CAST(at_ + length(head) + length(text) + 10 AS BIGINT) END, ',' ORDER BY nth), '') AS mask
FROM o GROUP BY conv_id, participant, part
"""
