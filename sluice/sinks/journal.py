"""A journal of a pipeline's epochs whose closed epochs are merged in levels, so that readers open few files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

FAN = 8

# How the rows of a kind are merged; kinds without an entry stay where their epoch wrote them.
Merge = Callable[[DataFrame], DataFrame]


def covering(found: Iterable[tuple[int, int]], fan: int = FAN) -> list[tuple[int, int]]:
    """Of folders (level, first epoch) those that have every epoch once: the highest level wins."""
    kept: set[tuple[int, int]] = set()
    top = 0
    for level, first in sorted(found, reverse=True):
        top = max(top, level)
        if not any((up, first // fan**up * fan**up) in kept for up in range(level + 1, top + 1)):
            kept.add((level, first))
    return sorted(kept, key=lambda f: f[1])


@dataclass
class Journal:
    """Rows of several kinds, one write an epoch, below ``path/level=L/epoch=first/kind=K``.

    An epoch is written again as a whole when it is replayed. Before epoch e all earlier ones are closed, so whenever e is a
    multiple of ``fan`` the last ``fan`` epochs are merged into one folder of the next level, and so on upwards; a level that
    is complete counts instead of what it was made of, which goes at the next merge, so that a reader has time to end.
    """

    path: str
    schema: str
    merges: Mapping[str, Merge]
    fan: int = FAN

    def _folder(self, level: int, first: int) -> str:
        return f"{self.path}/level={level}/epoch={first}"

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Replace what was written for this epoch; earlier ones are merged first when their turn has come."""
        self.merge_before(rows.sparkSession, epoch)
        self._write(rows.withColumn("epoch", F.lit(epoch).cast("bigint")), 0, epoch)

    def _write(self, rows: DataFrame, level: int, first: int) -> None:
        rows.write.mode("overwrite").partitionBy("kind").parquet(self._folder(level, first))

    def merge_before(self, spark: SparkSession, epoch: int) -> None:
        if epoch <= 0 or epoch % self.fan:
            return
        found = set(self.folders(spark))
        self._without_merged(spark, found)
        level, width = 0, 1
        while epoch % (width * self.fan) == 0:
            target = (level + 1, epoch - width * self.fan)
            parts = [(level, epoch - width * i) for i in range(self.fan, 0, -1)]
            level, width = level + 1, width * self.fan
            if target in found:  # of a replayed epoch
                continue
            rows = [merge(self._read(spark, kind, parts)).withColumn("kind", F.lit(kind)) for kind, merge in self.merges.items()]
            whole = rows[0]
            for more in rows[1:]:
                whole = whole.unionByName(more)
            self._write(whole, *target)

    def _without_merged(self, spark: SparkSession, found: set[tuple[int, int]]) -> None:
        """Delete the merged kinds of folders that a higher level held before this merge begins."""
        for level, first in found - set(covering(found, self.fan)):
            for kind in self.merges:
                self._files(spark).delete(self._path(spark, f"{self._folder(level, first)}/kind={kind}"), True)
            if level:
                self._files(spark).delete(self._path(spark, self._folder(level, first)), True)

    def _path(self, spark: SparkSession, folder: str):
        return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)

    def _files(self, spark: SparkSession):
        return self._path(spark, self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        files, path = self._files(spark), self._path(spark, folder)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def folders(self, spark: SparkSession) -> list[tuple[int, int]]:
        """Complete folders, as (level, first epoch)."""
        out = []
        for level in self._names(spark, self.path):
            for epoch in self._names(spark, f"{self.path}/{level}"):
                out.append((int(level.partition("=")[2]), int(epoch.partition("=")[2])))
        return [f for f in out if self._files(spark).exists(self._path(spark, f"{self._folder(*f)}/_SUCCESS"))]

    def _read(self, spark: SparkSession, kind: str, folders: Iterable[tuple[int, int]]) -> DataFrame:
        schema = f"{self.schema}, epoch bigint"
        wanted = [f"{self._folder(*f)}/kind={kind}" for f in folders if f"kind={kind}" in self._names(spark, self._folder(*f))]
        return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        """All rows of a kind with their ``epoch``; of a merged kind as merged so far."""
        found = self.folders(spark)
        return self._read(spark, kind, covering(found, self.fan) if kind in self.merges else [f for f in found if f[0] == 0])
