"""Chat formatting: logged snapshots of growing conversations collapse to the longest, which are then rendered.

Turns are put in order (turn, role, text; exact repeats of a row once). Every turn has the running hash of the turns up
to it: 128 bits, the exclusive or of hashes of (position, role, text). A conversation goes if its last hash, at its length,
is also one inside another conversation; of equal conversations the smallest id stays. Anti-joins do both.

Positions and running hashes come from two short windows, over blocks of BLOCK turn numbers and over a conversation's
blocks, so a conversation of any length is spread over many tasks. Its rendering comes in parts of BLOCK turns.

A null conv_id is a conversation of its own, a null turn comes first, a null role reads `unknown`, a null text is empty.
An empty table gives an empty table. Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderstream.llm.common import read

BLOCK = 256
TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls meet; the right side's key columns go."""
    renamed = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_{k}" for k in keys])


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, a, b): ordered turns with their running hashes."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.distinct().withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    along = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    keys = ["conv_id", "block"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    rows = matched(rows.withColumn("r", F.row_number().over(inside)), sizes, keys)
    rows = rows.withColumn("pos", (F.col("before") + F.col("r")).cast("long"))
    rows = rows.select(*keys, "turn", "pos", "role", "text", *[F.xxhash64("pos", "role", "text", F.lit(s)).alias(n) for n, s in (("x", 1), ("y", 2))])
    sums = rows.groupBy(*keys).agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"))
    sums = sums.select(*keys, *[F.coalesce(F.bit_xor(c).over(along), F.lit(0)).cast("long").alias(c) for c in ("bx", "by")])
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = matched(rows.withColumns({"rx": F.bit_xor("x").over(upto), "ry": F.bit_xor("y").over(upto)}), sums, keys)
    return rows.select("conv_id", "pos", "role", "text", F.col("rx").bitwiseXOR(F.col("bx")).alias("a"), F.col("ry").bitwiseXOR(F.col("by")).alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n): the conversations no other one continues or repeats."""
    last = turns.groupBy("conv_id").agg(F.max(F.struct("pos", "a", "b")).alias("z")).select("conv_id", "z.pos", "z.a", "z.b")
    ends = last.select("conv_id", F.col("pos").alias("n"))
    inner = matched(turns.select("conv_id", "pos", "a", "b"), ends, ["conv_id"]).filter("pos < n").select("pos", "a", "b").distinct()
    first = last.groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    return first.join(inner, ["pos", "a", "b"], "left_anti").select("conv_id", F.col("pos").alias("n"))


def rendered(conversations: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """(conv_id, part, n_turns, text) of the maximal conversations."""
    turns = hashed(conversations)
    kept = matched(turns.select("conv_id", "pos", "role", "text"), maximal(turns), ["conv_id"])
    before, between, after = map(F.lit, template)
    line = F.concat(before, F.col("role"), between, F.col("text"), after)
    part = F.floor((F.col("pos") - 1) / BLOCK).cast("long").alias("part")
    parts = kept.groupBy("conv_id", part).agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return parts.select("conv_id", "part", F.size("lines").cast("long").alias("n_turns"), F.array_join(F.col("lines")["line"], "").alias("text"))


def query(spark, folder: str) -> DataFrame:
    return rendered(read(spark, folder, "conversations"))


SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), o AS (
  SELECT conv_id, row_number() OVER w AS pos, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), h AS (
  SELECT conv_id, pos, line, md5(string_agg(md5(line), '' ) OVER (PARTITION BY conv_id ORDER BY pos)) AS h,
         count(*) OVER (PARTITION BY conv_id) AS n FROM o
), l AS (
  SELECT n, h, min(conv_id) AS conv_id FROM h WHERE pos = n GROUP BY n, h
), m AS (
  SELECT conv_id FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.pos = l.n AND h.h = l.h AND h.pos < h.n)
)
SELECT conv_id, (pos - 1) // {BLOCK} AS part, count(*) AS n_turns, string_agg(line, '' ORDER BY pos) AS text
FROM h JOIN m USING (conv_id) GROUP BY ALL
"""
