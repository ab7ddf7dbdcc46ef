"""An append log of a stream's batches that is compacted as it grows.

Every batch is a folder ``batch=n`` and every compaction a folder ``base=n`` that stands for all batches up to n. A folder
counts once its writer has committed it (``_SUCCESS``), so these names are the manifest: a batch that is run again overwrites
its own folder, a compaction that breaks off leaves nothing. A reader opens the newest base and the batches after it,
fewer than ``every`` plus what is in flight. Folders are removed one compaction late, so a reader that has just looked can finish.

``merge`` must give the same rows whether it sees all batches at once or merged ones again (newest per key, sums, ranges).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FOLDER = re.compile(r"(batch|base)=(\d+)$")


def newest(keys: Sequence[str], order: Sequence[Column | str]) -> Callable[[DataFrame], DataFrame]:
    """Merge by the newest row per key."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)

    return merge


@dataclass
class ChangeLog:
    spark: SparkSession
    path: str
    schema: str
    keys: Sequence[str]
    merge: Callable[[DataFrame], DataFrame]
    every: int = 16
    merged: bool = True  # whether a batch is merged before it is written: not where it would be moved and hardly shrink

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def folders(self) -> dict[str, list[int]]:
        """Numbers of the committed folders by kind, ascending."""
        jvm, root, fs = self._files()
        out: dict[str, list[int]] = {"batch": [], "base": []}
        for entry in fs.listStatus(root) if fs.exists(root) else []:
            named = FOLDER.fullmatch(entry.getPath().getName())
            if named and fs.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                out[named[1]].append(int(named[2]))
        return {kind: sorted(numbers) for kind, numbers in out.items()}

    def live(self) -> list[str]:
        """What a reader opens: the newest base and the batches after it."""
        have = self.folders()
        base = have["base"][-1:]
        return [f"{self.path}/base={b}" for b in base] + [f"{self.path}/batch={n}" for n in have["batch"] if not base or n > base[0]]

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def all_rows(self) -> DataFrame:
        """What is live, not merged."""
        return self._rows(self.live())

    def read(self) -> DataFrame:
        return self.merge(self.all_rows())

    def append(self, rows: DataFrame, number: int) -> None:
        """Write one batch; every ``every`` batches the log is compacted."""
        (self.merge(rows) if self.merged else rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batch={number}")
        if sum("/batch=" in f for f in self.live()) >= self.every:
            self.compact()

    def compact(self) -> None:
        """Merge what is live into a new base, in ranges of the keys (a read of some keys skips the other files)."""
        have = self.folders()
        if not have["batch"]:
            return
        last, before = have["batch"][-1], have["base"][-1:]
        if before and before[0] >= last:
            return
        self.read().repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/base={last}")
        jvm, root, fs = self._files()
        done = before[0] if before else -1
        for kind, numbers in have.items():
            for n in numbers:
                if n < done or (kind == "batch" and n == done):
                    fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"{kind}={n}"), True)
