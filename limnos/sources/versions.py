"""Tables that readers see whole: published versions, and logs of changes with compaction.

`VersionedTable`: a write goes to a staged folder that no reader knows; one small
file, created only if it is not there, publishes it under the next number.  A
reader takes the newest published number and reads that folder, so during a
rewrite it sees one whole version, before or after.  Of two writers that finish
at once one gets the number and the other the next.  `keep` versions stay for
readers that have begun; older ones and abandoned stagings are removed.

`ChangeLog`: the changed rows of each epoch of a stream, a folder an epoch, written
again as it was when the epoch is executed again.  The newest row of a key is its
state.  When the changes since the last base have more bytes than the base (or are
very many), they are merged into a new one, so what is written follows the changes:
every byte is merged about twice, whatever the size of the state.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _fs, path_exists, remove


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path, max(keep, 1)
        self.published = posixpath.join(path, "_published")

    def versions(self) -> list[tuple[int, str]]:
        """(number, folder) of the published versions, oldest first."""
        return sorted((int(n.partition("-")[0]), posixpath.join(self.path, n.partition("-")[2])) for n in _names(self.spark, self.published) if "-" in n)

    def current(self) -> str | None:
        """The folder of the newest version."""
        found = self.versions()
        return found[-1][1] if found else None

    def read(self, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.current())

    def stage(self, write) -> str:
        """Run write(folder) on a new folder, and return the folder."""
        folder = posixpath.join(self.path, f"data.{uuid.uuid4().hex}")
        write(folder)
        return folder

    def publish(self, folder: str, first_only: bool = False) -> str:
        """Make a staged folder the newest version and return the current one; with first_only only if there is none."""
        while True:
            found = self.versions()
            if first_only and found:
                remove(self.spark, folder)
                return found[-1][1]
            number = found[-1][0] + 1 if found else 1
            # the number is taken by creating its lock file; the pointer's name has the folder
            fs, lock = _fs(self.spark, posixpath.join(self.published, f"{number}.lock"))
            if fs.createNewFile(lock):
                fs.createNewFile(_fs(self.spark, posixpath.join(self.published, f"{number}-{posixpath.basename(folder)}"))[1])
                break
            self._settle(number)
        self.clean()
        return folder

    def _settle(self, number: int, tries: int = 100) -> None:
        """Wait for the writer that holds a number; one that died between its two files gives it up."""
        import time
        for _ in range(tries):
            if any(n == number for n, _ in self.versions()):
                return
            time.sleep(0.05)
        remove(self.spark, posixpath.join(self.published, f"{number}.lock"))

    def write(self, df: DataFrame, partition_by=()) -> DataFrame:
        by = [partition_by] if isinstance(partition_by, str) else list(partition_by)
        folder = self.publish(self.stage(lambda p: df.write.partitionBy(*by).parquet(p)))
        return self.spark.read.parquet(folder)

    def clean(self) -> None:
        """Remove all but the newest `keep` versions, and stagings that were finished before the newest version and not published."""
        found = self.versions()
        live = {posixpath.basename(f) for _, f in found[-self.keep:]}
        for number, folder in found[:-self.keep]:
            remove(self.spark, folder)
            remove(self.spark, posixpath.join(self.published, f"{number}-{posixpath.basename(folder)}"))
            remove(self.spark, posixpath.join(self.published, f"{number}.lock"))
        fs, p = _fs(self.spark, self.path)
        newest = fs.getFileStatus(_fs(self.spark, found[-1][1])[1]).getModificationTime() if found else 0
        for s in fs.listStatus(p) if fs.exists(p) else []:
            name = s.getPath().getName()
            if name.startswith("data.") and name not in live and s.getModificationTime() < newest and path_exists(self.spark, posixpath.join(self.path, name)):
                remove(self.spark, posixpath.join(self.path, name))

    def drop(self) -> None:
        remove(self.spark, self.path)


class ChangeLog:
    """Rows of `keys` with their newest values; least, most: bytes of changes, and epochs, from which a merge is worth a job."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], least: int = 1 << 20, most: int = 100):
        self.spark, self.path, self.keys, self.least, self.most = spark, path, keys, least, most

    def _folders(self, kind: str) -> list[int]:
        names = [n for n in _names(self.spark, self.path) if n.startswith(f"{kind}=")]
        return sorted(int(n.partition("=")[2]) for n in names if path_exists(self.spark, posixpath.join(self.path, n)))

    def _at(self, kind: str, epoch: int) -> str:
        return posixpath.join(self.path, f"{kind}={epoch}")

    def _size(self, kind: str, epochs) -> int:
        total = 0
        for e in epochs:
            fs, p = _fs(self.spark, self._at(kind, e))
            total += fs.getContentSummary(p).getLength()
        return total

    def append(self, changed: DataFrame, epoch: int) -> None:
        """Write an epoch's changes; an epoch that a base already has is left as it is."""
        bases = self._folders("base")
        if bases and epoch <= bases[-1]:
            return
        changed.withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(self._at("epoch", epoch))
        self.compact(epoch)

    def compact(self, epoch: int) -> None:
        """Merge all epochs before `epoch` (which may be executed again) into a base, once they outweigh it."""
        bases, epochs = self._folders("base"), [e for e in self._folders("epoch") if e < epoch]
        base = bases[-1] if bases else -1
        fresh = [e for e in epochs if e > base]
        if fresh and (len(fresh) >= self.most or self._size("epoch", fresh) > max(self.least, self._size("base", bases[-1:]))):
            self._newest(fresh, base).write.mode("overwrite").parquet(self._at("base", fresh[-1]))
            bases, base = [*bases, fresh[-1]], fresh[-1]
        for e in epochs:
            if e <= base:
                remove(self.spark, self._at("epoch", e))
        for b in bases[:-2]:  # readers that began before the last merge still have theirs
            remove(self.spark, self._at("base", b))

    def _newest(self, epochs, base: int) -> DataFrame:
        paths = [self._at("epoch", e) for e in epochs if e > base] + ([self._at("base", base)] if base >= 0 else [])
        rows = self.spark.read.parquet(paths[0])
        rows = self.spark.read.schema(rows.schema).parquet(*paths)
        rest = [c for c in rows.columns if c not in self.keys and c != "_epoch"]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_r"), F.max("_epoch").alias("_epoch"))
        return newest.select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in rest], "_epoch")

    def read(self) -> DataFrame:
        """The newest row of every key."""
        bases = self._folders("base")
        return self._newest(self._folders("epoch"), bases[-1] if bases else -1).drop("_epoch")
