"""Runs of digit groups, however long: cards are found group by group, and a run's groups are worked out once."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from orderstream.llm import private


def _valid(d):
    weighed = [int(c) if i % 2 == 0 else int(c) * 2 % 10 + int(c) // 5 for i, c in enumerate(reversed(d))]
    return 13 <= len(d) <= 19 and sum(weighed) % 10 == 0


def _parts(run):
    """By hand: groups that are cards alone, then from the left the longest valid sequence."""
    groups = re.findall(r"[ -]?\d+", run)
    bare = [re.sub(r"\D", "", g) for g in groups]
    out, i = [], 0
    while i < len(groups):
        n = 1 if _valid(bare[i]) else 0
        for k in range(min(len(groups) - i, 19), 0, -1) if not n else ():
            if not any(map(_valid, bare[i : i + k])) and _valid("".join(bare[i : i + k])):
                n = k
                break
        out.append(("".join(groups[i : i + max(n, 1)]), "card" if n else None))
        i += max(n, 1)
    return out


def test_parts_of_runs_by_hand(spark):
    rng = random.Random(4)
    group = lambda: "".join(rng.choice("0123456789") for _ in range(rng.choice([1, 1, 2, 4, 4, 4, 6, 13, 16])))
    runs = ["".join([group(), *(rng.choice(" -") + group() for _ in range(rng.randrange(12)))]) for _ in range(60)]
    runs += ["4539578763621486", "4539 5787 6362 1486 05", "12 4539578763621486"]
    rows = spark.createDataFrame(list(enumerate(runs)), "i int, x string").select("i", private.card_parts(F.col("x")).alias("parts"))
    assert {r["i"]: [tuple(p) for p in r["parts"]] for r in rows.collect()} == {i: _parts(x) for i, x in enumerate(runs)}


def test_groups_of_a_run_are_worked_out_once(spark):
    rows = spark.createDataFrame([("1 2",)], "x string").select(private.card_parts(F.col("x")).alias("parts"))
    tree = rows._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("regexp_extract_all") == 1
