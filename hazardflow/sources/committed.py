"""Tables written by numbered batches, of which only committed ones count.

A batch writes its rows to a folder of its own and then makes an empty file whose name ties the batch number to that
folder. That file is the commit: a batch that fails before it leaves nothing that readers see, and a batch that is
run again after it is skipped. Works on any file system Hadoop can open; one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_DIGITS = 15


class CommittedTable:
    """``data/<batch>-<attempt>`` folders and ``commits/<batch>~<folder>`` marks below ``path``.

    With ``replaces`` a batch is a whole new version of the table: readers see the newest one, and versions before the
    last ``keep`` are removed, as are folders of failed attempts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, replaces: bool = False, keep: int = 2) -> None:
        self._spark, self._path, self._schema = spark, path.rstrip("/"), schema
        self._replaces, self._keep = replaces, max(1, keep)

    def _hadoop(self, name: str = ""):
        place = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}" if name else self._path)
        return place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), place

    def _names(self, folder: str) -> list[str]:
        system, place = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []

    def commits(self) -> dict[int, str]:
        """Committed batches and their folders, in order."""
        marks = [name.split("~") for name in self._names("commits")]
        return {int(batch): folder for batch, folder in marks}

    def has(self, batch: int) -> bool:
        """Whether a batch is committed. Versions come in order, so an older one than the newest is, even if it is removed by now."""
        commits = self.commits()
        return batch in commits or (self._replaces and any(batch < other for other in commits))

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Write and commit a batch; False if it has been committed before."""
        if self.has(batch):
            return False
        folder = f"{batch:0{_DIGITS}}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self._path}/data/{folder}")
        system, mark = self._hadoop(f"commits/{batch:0{_DIGITS}}~{folder}")
        system.create(mark, False).close()
        if self._replaces:
            self._clean(batch)
        return True

    def _clean(self, newest: int) -> None:
        """Remove what no reader of the last versions can need. Marks go first, so that none points to nothing."""
        commits = self.commits()
        old = sorted(commits)[: -self._keep]
        for batch in old:
            system, mark = self._hadoop(f"commits/{batch:0{_DIGITS}}~{commits[batch]}")
            system.delete(mark, False)
        kept = {folder for batch, folder in commits.items() if batch not in old}
        for folder in self._names("data"):
            if folder not in kept and int(folder.split("-")[0]) <= newest:
                system, place = self._hadoop(f"data/{folder}")
                system.delete(place, True)

    def read(self) -> DataFrame:
        """All committed rows, or the newest version; no rows before the first commit."""
        folders = list(self.commits().values())
        if not folders:
            return self._spark.createDataFrame([], self._schema)
        chosen = folders[-1:] if self._replaces else folders
        return self._spark.read.schema(self._schema).parquet(*[f"{self._path}/data/{f}" for f in chosen])


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends every micro-batch once, also if it is handed over again."""

    def write(rows: DataFrame, batch: int) -> None:
        CommittedTable(rows.sparkSession, path, rows.schema).write(rows, batch)

    return write


def upsert_batches(
    path: str, schema: StructType | str, merge: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 2
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that folds micro-batches into a small table by ``merge(current, rows)``.

    A repeated batch changes nothing. The table is one file, so it must be small.
    """

    def write(rows: DataFrame, batch: int) -> None:
        held = CommittedTable(rows.sparkSession, path, schema, replaces=True, keep=keep)
        if not held.has(batch):
            held.write(merge(held.read(), rows).coalesce(1), batch)

    return write
