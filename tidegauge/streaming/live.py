"""A streamed table whose days are compacted while streams go on writing.

Streams leave one folder per batch and day. ``LiveTable.compact`` rewrites all
folders of chosen days as sorted facts and then records, in a ledger, which
folders it covered. Readers take what no compaction covers and, of compactions,
what no later one covers: every row is read once before, during and after.

* Only batches that ended (their ``_SUCCESS`` is there) are covered: a batch that
  is written again after a failure is not lost.
* A compaction that died before its ledger entry was written does not exist for
  readers; run again under its name it starts over, and once recorded a second
  run of that name does nothing.
* Late rows come in folders that no ledger names; the next compaction of the day
  takes them together with the day's compacted rows.
* ``drop_covered`` deletes what is covered, when no reader needs it any more.

What is read is decided by folder names, so covered files are neither opened nor
joined away. The ledger has a line per folder covered, about what a driver
holds anyway to list them. Run one compaction of a table at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.writers import write_facts
from tidegauge.streaming.jobs import BATCH, DAY, RUN, SOURCE, TARGET

COMPACTION = "compaction"
LEDGER = "day date, folder string"


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, below the folder they are asked for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


@dataclass(frozen=True)
class LiveTable:
    """A table at ``root``: streams write to ``batches``, compactions and ledger lie beside it.

    ``schema`` (DDL) is that of the stored rows without day and target; ``merge``
    may fold the rows of a compaction, as partial sums allow.
    """

    root: str
    schema: str
    time: str = "timestamp"
    sort: Sequence[str] = ("request_host",)
    target: str | None = None
    merge: Callable[[DataFrame], DataFrame] | None = None

    @property
    def batches(self) -> str:
        return f"{self.root}/batches"

    @property
    def compacted(self) -> str:
        return f"{self.root}/compacted-{self.target or 'all'}"

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger-{self.target or 'all'}"

    def read(self, spark: SparkSession) -> DataFrame:
        """Every row once, with its day."""
        return self._rows(spark, self.folders(spark))

    def folders(self, spark: SparkSession) -> list[str]:
        """The day folders that hold the table now, relative to the root."""
        recorded = self._recorded(spark)
        covered = set(spark.read.schema(LEDGER).parquet(self.ledger).select("folder").toPandas()["folder"]) if recorded else set()
        each = f"{self.batches}/{SOURCE}=*/{RUN}=*/{BATCH}=*"
        ended = {p.rsplit("/", 1)[0] for p in _matches(spark, f"{each}/_SUCCESS")}
        split = f"/{TARGET}={self.target}" if self.target else ""
        depth = 2 if self.target else 1
        found = [p for p in _matches(spark, f"{each}{split}/{DAY}=*") if p.rsplit("/", depth)[0] in ended]
        found += [p for name in recorded for p in _matches(spark, f"{self.compacted}/{COMPACTION}={name}/{DAY}=*")]
        start = len(_matches(spark, self.root)[0]) + 1 if found else 0
        return sorted({p[start:] for p in found} - covered)

    def compact(self, spark: SparkSession, days: Sequence[date], name: str) -> list[str]:
        """Rewrites the rows of some days as one set of sorted files; gives the folders that this covers.

        ``name`` is the run's own: a run that is repeated under it counts once.
        """
        if name in self._recorded(spark):
            return []
        wanted = {f"{DAY}={day}": day for day in days}
        chosen = [f for f in self.folders(spark) if f.rsplit("/", 1)[1] in wanted]
        fresh = {f.rsplit("/", 1)[1] for f in chosen if not f.startswith(f"{self.compacted[len(self.root) + 1:]}/")}
        chosen = [f for f in chosen if f.rsplit("/", 1)[1] in fresh]  # other days are compact already
        if not chosen:
            return []
        rows = self._rows(spark, chosen).drop(DAY)
        write_facts(self.merge(rows) if self.merge else rows, f"{self.compacted}/{COMPACTION}={name}", time=self.time, sort=self.sort, mode="overwrite")
        entry = spark.createDataFrame([(wanted[f.rsplit("/", 1)[1]], f) for f in chosen], LEDGER)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.ledger}/{COMPACTION}={name}")
        return chosen

    def drop_covered(self, spark: SparkSession) -> list[str]:
        """Deletes covered folders and gives their names. The ledger stays as it is."""
        gone = []
        for name in self._recorded(spark):
            entry = spark.read.schema(LEDGER).parquet(f"{self.ledger}/{COMPACTION}={name}")
            for folder in [r["folder"] for r in entry.select("folder").collect()]:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
                if path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True):
                    gone.append(folder)
        return sorted(gone)

    def _recorded(self, spark: SparkSession) -> list[str]:
        found = _matches(spark, f"{self.ledger}/{COMPACTION}=*/_SUCCESS")
        return sorted(p.rsplit("/", 2)[1].split("=", 1)[1] for p in found)

    def _rows(self, spark: SparkSession, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema).withColumn(DAY, F.lit(None).cast("date"))
        names = [f.name for f in spark.createDataFrame([], self.schema).schema]
        parts = []
        for base in (self.batches, self.compacted):  # folders of either kind have columns of their own
            own = [f"{self.root}/{f}" for f in folders if f"{self.root}/{f}".startswith(f"{base}/")]
            if own:
                read = spark.read.schema(f"{self.schema}, {DAY} date").option("basePath", base)
                parts.append(read.parquet(*own).select(*names, DAY))
        return reduce(DataFrame.unionByName, parts)
