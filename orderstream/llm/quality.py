"""Quality rules: a table of thresholds compiled into one projection.

Each rule bounds one measure of a text; the measures are ratios of lengths, symbols, stop words and lines. The
whole table becomes boolean columns of a single projection of built-in functions: no shuffle, no user function,
and every text is judged by itself.

Null text counts as a text without words. Repeated rows are judged each. An empty table gives an empty table.
Only the named id and text columns are read, so further columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderstream.llm.common import SPACE, WORD, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are as with by at be this from or an not but have had his her they which you "
    "de la le et les des en un une du que est pour dans par sur au qui ne pas "
    "der die und den von zu das mit sich im nicht ein eine auf für ist dem als auch "
    "el los se del las por con no su para es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes while low <= measure <= high; a missing bound is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def passes(self, value: Column) -> Column:
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= self.low)
        if self.high is not None:
            ok = ok & (value <= self.high)
        return ok


RULES = (
    Rule("few_letters_a_word", "word_length", low=2.5),
    Rule("many_letters_a_word", "word_length", high=12.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("shouting", "upper_ratio", high=0.3),
    Rule("exclamations", "exclamation_ratio", high=0.3),
    Rule("no_stop_words", "stop_ratio", low=0.05),
    Rule("repeated_lines", "dup_line_ratio", high=0.3),
)

SYMBOLS = r"[^#*$%&|<>]+"


def without(text: Column, pattern: str) -> Column:
    """Characters left once the pattern's runs are gone."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts and ratios the rules look at.

    Words in repeated 3-word windows: the windows are sorted with their positions, so equal ones are neighbours;
    the positions of those with an equal neighbour, sorted again, cover up to three words each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    base = base.select(
        "*",
        words(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
        F.split("_text", "\n").alias("_all_lines"),
    )
    n = F.size("_words")
    window = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(
            F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")
        ),
    )
    base = base.withColumn("_sorted", F.when(n >= 4, F.sort_array(window)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, y: (x["h"] == y["h"])
    twice = F.filter(
        "_sorted",
        lambda x, j: F.coalesce(same(x, F.get("_sorted", j - 1)), F.lit(False))
        | F.coalesce(same(x, F.get("_sorted", j + 1)), F.lit(False)),
    )
    base = base.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    counted = base.select(
        "_id",
        n.cast("long").alias("n_words"),
        without(F.col("_text"), f"[{SPACE}]+").alias("word_chars"),
        without(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        without(F.col("_text"), "[^A-Z]+").alias("n_upper"),
        without(F.col("_text"), "[^!]+").alias("n_exclamations"),
        F.size(F.filter("_words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(STOP_WORDS))).cast("long").alias("n_stop"),
    )
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.select(
        F.col("_id").alias(id_col),
        *[c for c in counted.columns if c != "_id"],
        ratio("word_chars", "n_words").alias("word_length"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_exclamations", "n_words").alias("exclamation_ratio"),
        ratio("n_stop", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every document, base_failed, the names of the broken rules, and kept.

    base_failed: under 50 words, or more than half of the words lie in repeated windows.
    """
    found = measured(docs, id_col, text_col)
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    broken = F.filter(
        F.array(*[F.when(~r.passes(F.col(r.measure)), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    return found.select(
        "*",
        base_failed.alias("base_failed"),
        F.array_join(broken, ",").alias("broken_rules"),
        (~base_failed & (F.size(broken) == 0)).alias("kept"),
    )


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rules")


def query(spark, folder: str) -> DataFrame:
    from orderstream.llm.common import read

    return judged(read(spark, folder, "documents")).select(*COLUMNS)


def _ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / greatest({b}, 1))"


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    measure = {
        "word_length": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "upper_ratio": _ratio("n_upper", "word_chars"),
        "exclamation_ratio": _ratio("n_exclamations", "n_words"),
        "stop_ratio": _ratio("n_stop", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
    }
    broken = ", ".join(
        "CASE WHEN NOT ("
        + " AND ".join([f"{measure[r.measure]} {op} {b}" for op, b in ((">=", r.low), ("<=", r.high)) if b is not None])
        + f") THEN '{r.name}' END"
        for r in rules
    )
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[{SPACE}]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), w AS (
  SELECT doc_id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM d
), trio AS (
  SELECT doc_id, i, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w1, w2, w3) > 1 AS r FROM trio
), covered AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM (
    SELECT doc_id, bool_or(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM twice
  ) WHERE c GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[{SPACE}]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
         length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations,
         len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({stop}))) AS n_stop
  FROM d LEFT JOIN covered USING (doc_id)
), j AS (
  SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed, concat_ws(',', {broken}) AS broken_rules FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken_rules = '' AS kept, broken_rules FROM j
"""
