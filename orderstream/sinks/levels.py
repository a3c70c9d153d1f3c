"""Tables that grow by one run per batch and merge their runs in levels.

Every batch adds a run. Once `fanout` runs of a level stand side by side, they become one run of the
next level, so a table of n batches has at most (fanout - 1) * log(n) live runs, and a row is
rewritten log(n) times. The manifest of a batch names the live runs. It is the last thing a batch
writes and replaces nothing: a reader takes the newest manifest, and a batch that ended before its
manifest was there has changed nothing. A repeated batch finds its manifest, or writes the same runs.

The newest `keep` manifests stay, with all runs they name; what only older ones name is removed. A
reader must finish within that many batches.

A correction voids what the table says about some keys up to a batch, and says it anew. It is a run
between two batches. Voided keys are marked by tombstone rows; a row counts if its `seq` is not below
the newest tombstone of its key. A correction is registered once under its name, against the newest
batch; the next batch takes it in, until then readers add it. One that another batch has overtaken
before it was registered has no effect and is to be repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderstream.sinks.files import get_text, names_in, put_text, remove

# Room for corrections between two batches in a row's `seq`.
STEPS = 1 << 20


@dataclass(frozen=True)
class Run:
    """A folder with the rows of consecutive batches; `voids` if there are tombstones among them."""

    name: str
    seq: int
    level: int
    voids: bool = False
    info: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Manifest:
    batch_id: int
    runs: tuple[Run, ...]
    applied: tuple[str, ...]

    def text(self) -> str:
        return json.dumps({"runs": [asdict(r) for r in self.runs], "applied": self.applied})


@dataclass(frozen=True)
class Levels:
    """`merge` adds up rows of equal keys, or leaves rows as they are; `sort` clusters a run's files."""

    root: str
    schema: str
    merge: Callable[[DataFrame], DataFrame]
    sort: str
    void_key: str | None = None
    fanout: int = 4
    keep: int = 8

    # Manifests

    def batches(self, spark: SparkSession) -> list[int]:
        """The batches whose manifest is kept."""
        return sorted(int(n.removesuffix(".json")) for n in names_in(spark, f"{self.root}/manifests"))

    def manifest(self, spark: SparkSession, before: int | None = None) -> Manifest | None:
        """The newest one, or the newest one of the batches before one."""
        kept = self.batches(spark)
        known = [b for b in kept if before is None or b < before]
        if not known and any(b > before for b in kept):
            raise ValueError(f"batch {before} is older than the manifests that are kept")
        return self._read_manifest(spark, known[-1]) if known else None

    def _read_manifest(self, spark: SparkSession, batch_id: int) -> Manifest | None:
        text = get_text(spark, f"{self.root}/manifests/{batch_id}.json")
        if text is None:
            return None
        data = json.loads(text)
        return Manifest(batch_id, tuple(Run(**r) for r in data["runs"]), tuple(data["applied"]))

    # Writing

    def write(self, rows: DataFrame, run: Run) -> Run:
        """Writes a run's rows, in merged runs near ones together, so that readers skip files and row groups by `sort`."""
        ranged = rows.repartitionByRange(self.sort) if run.level else rows
        ranged.sortWithinPartitions(self.sort).write.mode("overwrite").parquet(f"{self.root}/runs/{run.name}")
        return run

    def rows_of(self, spark: SparkSession, runs: list[Run]) -> DataFrame:
        if not runs:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.root}/runs/{r.name}" for r in runs])

    def add(self, rows: DataFrame, batch_id: int) -> Manifest:
        """Adds the rows of a batch, with what corrections came before it, and merges full levels."""
        spark = rows.sparkSession
        done = self._read_manifest(spark, batch_id)
        if done is not None:
            return done
        last = self.manifest(spark, before=batch_id)
        runs, applied = (list(last.runs), list(last.applied)) if last else ([], [])
        for name, run in self.pending(spark, last):
            runs.append(run)
            applied.append(name)
        seq = batch_id * STEPS
        written = [self.write(self.stamped(rows, seq), Run(f"{batch_id}-0", seq, 0))]
        runs.append(written[0])
        while len(runs) >= self.fanout and len({r.level for r in runs[-self.fanout :]}) == 1:
            written.append(self._merged(spark, runs[-self.fanout :], oldest=len(runs) == self.fanout, batch_id=batch_id))
            runs[-self.fanout :] = written[-1:]
        new = Manifest(batch_id, tuple(runs), tuple(applied))
        put_text(spark, f"{self.root}/manifests/{batch_id}.json", new.text())
        for run in written[:-1]:  # merged on at once, so no manifest ever names them
            remove(spark, f"{self.root}/runs/{run.name}")
        self._expire(spark)
        return new

    def stamped(self, rows: DataFrame, seq: int) -> DataFrame:
        if self.void_key is None:
            return rows
        return rows.withColumns({"seq": F.lit(seq).cast("bigint"), "tombstone": F.lit(False)})

    def _merged(self, spark: SparkSession, runs: list[Run], oldest: bool, batch_id: int) -> Run:
        rows, voids = self.rows_of(spark, runs), any(r.voids for r in runs)
        run = Run(f"{batch_id}-{runs[0].level + 1}", runs[-1].seq, runs[0].level + 1, voids and not oldest)
        both = self.stamped(self.resolved(rows, voids), run.seq)
        if run.voids:
            # They still void older runs; what is in this run has been settled among itself.
            tombstones = rows.where("tombstone").select(self.void_key).distinct()
            both = both.unionByName(
                tombstones.withColumns({"seq": F.lit(run.seq).cast("bigint"), "tombstone": F.lit(True)}), allowMissingColumns=True
            )
        return self.write(both, run)

    def _expire(self, spark: SparkSession) -> None:
        batches = self.batches(spark)
        old, kept = batches[: -self.keep], batches[-self.keep :]
        if not old:
            return
        manifests = {b: self._read_manifest(spark, b) for b in batches}
        live = {r.name for b in kept if manifests[b] for r in manifests[b].runs}
        for b in old:
            for run in manifests[b].runs if manifests[b] else ():
                if run.name not in live:
                    remove(spark, f"{self.root}/runs/{run.name}")
            remove(spark, f"{self.root}/manifests/{b}.json")

    # Reading

    def resolved(self, rows: DataFrame, voids: bool) -> DataFrame:
        """The rows that count, added up. Only where there are tombstones do rows meet them."""
        if self.void_key is None:
            return self.merge(rows)
        if not voids:
            return self.merge(rows.where(~F.col("tombstone")).drop("seq", "tombstone"))
        key = self.void_key
        cuts = rows.where("tombstone").groupBy(F.col(key).alias("voided")).agg(F.max("seq").alias("cut"))
        valid = rows.where(~F.col("tombstone")).join(cuts, F.col(key).eqNullSafe(F.col("voided")), "left")
        valid = valid.where(F.col("cut").isNull() | (F.col("seq") >= F.col("cut")))
        return self.merge(valid.drop("seq", "tombstone", "voided", "cut"))

    def live_runs(self, spark: SparkSession) -> list[Run]:
        last = self.manifest(spark)
        return [*(last.runs if last else ()), *(run for _, run in self.pending(spark, last))]

    def current(self, spark: SparkSession) -> DataFrame:
        """The table as of its newest batch and correction."""
        runs = self.live_runs(spark)
        return self.resolved(self.rows_of(spark, runs), any(r.voids for r in runs))

    # Corrections

    def pending(self, spark: SparkSession, last: Manifest | None) -> list[tuple[str, Run]]:
        """Corrections registered against this manifest, in order."""
        if self.void_key is None or last is None:
            return []
        found = []
        for file in names_in(spark, f"{self.root}/corrections"):
            name, data = file.removesuffix(".json"), json.loads(get_text(spark, f"{self.root}/corrections/{file}"))
            if data["after"] == last.batch_id and name not in last.applied:
                found.append((name, Run(data["run"], data["seq"], 0, True)))
        return sorted(found, key=lambda x: x[1].seq)

    def state_of(self, spark: SparkSession, name: str) -> str:
        """`absent`, `pending` (registered, readers add it), `applied` or `overtaken`."""
        if get_text(spark, f"{self.root}/corrections/{name}.json") is None:
            return "absent"
        last = self.manifest(spark)
        if last is not None and name in last.applied:
            return "applied"
        return "pending" if name in [n for n, _ in self.pending(spark, last)] else "overtaken"

    def correct(self, spark: SparkSession, name: str, keys: DataFrame, rows: DataFrame, last: Manifest) -> str:
        """Voids the keys up to the batch of `last` and puts the rows in their place; a name that is in is left alone."""
        state = self.state_of(spark, name)
        if state in ("pending", "applied"):
            return state
        seq = max([last.batch_id * STEPS, *(run.seq for _, run in self.pending(spark, last))]) + 1
        run = Run(f"correction-{name}-{last.batch_id}", seq, 0, True)
        stamp = lambda df, dead: df.withColumns({"seq": F.lit(seq).cast("bigint"), "tombstone": F.lit(dead)})
        self.write(stamp(rows, False).unionByName(stamp(keys.select(self.void_key).distinct(), True), allowMissingColumns=True), run)
        put_text(spark, f"{self.root}/corrections/{name}.json", json.dumps({"after": last.batch_id, "run": run.name, "seq": seq}))
        return self.state_of(spark, name)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_info(run: Run, **info) -> Run:
    return replace(run, info=run.info | info)
