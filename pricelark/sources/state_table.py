"""A stored table of one row per key, of which an update rewrites only the buckets that hold its keys.

Layout: ``data/v=N/bucket=K`` holds the rows of bucket K as written by version N, ``versions/v=N`` the
manifest of version N: which version every bucket was last written by, and the number of the last part
applied. The manifest is one small file that appears whole when its job commits, so it is the pointer:
readers take the newest committed one, and an update that dies before it leaves nothing to be seen.
A part that was applied is not applied again. There is one writer at a time.

Keys are dealt to buckets by hash; choose ``buckets`` so that one bucket's rows fit a task. The
manifest has at most that many rows, and only it is read by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.sources import folders

BUCKET = "bucket"
_NAME = "v={:09d}"


@dataclass(frozen=True)
class Version:
    number: int
    part: int
    buckets: dict[int, int]


@dataclass(frozen=True)
class StateTable:
    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _versions(self) -> list[str]:
        """Names of the committed versions, oldest first."""
        top = f"{self.folder}/versions"
        return [n for n in folders.names(self.spark, top) if folders.exists(self.spark, f"{top}/{n}/{folders.DONE}")]

    def _manifest(self, name: str) -> Version:
        rows = self.spark.read.parquet(f"{self.folder}/versions/{name}").collect()  # a row a bucket at most
        part = next(r["written"] for r in rows if r["bucket"] < 0)
        return Version(int(name[2:]), part, {r["bucket"]: r["written"] for r in rows if r["bucket"] >= 0})

    def version(self) -> Version:
        """The newest committed version; number 0 before the first."""
        found = self._versions()
        return self._manifest(found[-1]) if found else Version(0, -1, {})

    def read(self, only: Iterable[int] | None = None, version: Version | None = None) -> DataFrame | None:
        """The rows, or those of some buckets; None if there are none. Only folders of the version are listed."""
        held = (version or self.version()).buckets
        wanted = sorted(held if only is None else set(held) & set(only))
        paths = [f"{self.folder}/data/{_NAME.format(held[b])}/{BUCKET}={b}" for b in wanted]
        return self.spark.read.parquet(*paths) if paths else None

    def apply(self, part: int, keys: DataFrame, step: Callable[[DataFrame | None], DataFrame]) -> bool:
        """Part number ``part`` of a sequence: ``step`` makes the new rows of all buckets that hold one of
        the ``keys`` from their old ones. False if the part, or a later one, was applied before."""
        now = self.version()
        if part <= now.part:
            return False
        touched = [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # at most `buckets`
        number, place = now.number + 1, f"{self.folder}/data/{_NAME.format(now.number + 1)}"
        if touched:
            rows = step(self.read(touched, now)).withColumn(BUCKET, self.bucket())
            rows = rows.repartition(len(touched), BUCKET)
            rows.write.mode("overwrite").partitionBy(BUCKET).parquet(place)
        written = [int(b) for b in folders.values(self.spark, place, BUCKET)]
        held = {b: v for b, v in now.buckets.items() if b not in touched} | dict.fromkeys(written, number)
        manifest = self.spark.createDataFrame([(-1, part), *held.items()], "bucket int, written long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/{_NAME.format(number)}")
        return True

    def upsert(self, part: int, rows: DataFrame) -> bool:
        """Rows take the place of those with equal keys."""

        def step(old: DataFrame | None) -> DataFrame:
            return rows if old is None else old.join(rows, list(self.keys), "left_anti").unionByName(rows)

        return self.apply(part, rows, step)

    def vacuum(self, keep: int = 2) -> None:
        """Drop what the newest ``keep`` versions do not refer to. Readers of older versions lose their files."""
        found = self._versions()
        kept = [self._manifest(n) for n in found[-keep:]]
        used = {_NAME.format(v) for m in kept for v in m.buckets.values()}
        for name in folders.names(self.spark, f"{self.folder}/data"):
            if name not in used and (not kept or name <= _NAME.format(kept[-1].number)):
                folders.drop(self.spark, f"{self.folder}/data/{name}")
        for name in found[:-keep]:
            folders.drop(self.spark, f"{self.folder}/versions/{name}")
