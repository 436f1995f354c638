"""Tables kept in blocks: a change rewrites the blocks it touches and nothing else.

A version of a table is a manifest, (block, data version) rows; the rows themselves lie
in ``data/v=<version>/<column>=<block>``.  A writer first writes the rows of the blocks
it changes under its own version and then publishes a manifest that names them beside
the untouched ones.  Readers see a version only once its manifest is complete, older
versions stay readable, and a repeated write of a version starts from the same older
manifest and gives the same table.

Blocks are few (two-degree squares, or hash buckets), so their names may be listed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.sources import files


@dataclass(frozen=True)
class BlockTable:
    spark: SparkSession
    root: str
    name: str
    column: str = "block_id"

    @property
    def _data(self) -> str:
        return f"{self.root}/{self.name}/data"

    def versions(self) -> list[tuple[int, str]]:
        """Complete versions, oldest first, with the paths of their manifests."""
        return files.versions(self.spark, f"{self.root}/{self.name}/manifest")

    def manifest(self, before: int | None = None) -> list[tuple[str, int]]:
        """(block, data version) of the newest version (older than ``before`` if given)."""
        done = [path for v, path in self.versions() if before is None or v < before]
        if not done:
            return []
        return sorted((r["block"], r["v"]) for r in self.spark.read.schema("block string, v long").parquet(done[-1]).collect())

    def _publish(self, version: int, rows: list[tuple[str, int]]) -> None:
        table = self.spark.createDataFrame(sorted(rows), "block string, v long").coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.root}/{self.name}/manifest/v={version:012d}")

    def _read(self, entries: list[tuple[str, int]]) -> DataFrame | None:
        paths = [f"{self._data}/v={v}/{self.column}={block}" for block, v in entries]
        if not paths:
            return None
        rows = self.spark.read.option("basePath", self._data).parquet(*paths)
        return rows.withColumn(self.column, F.col(self.column).cast("string")).drop("v")

    def read(self, blocks: list[str] | None = None, before: int | None = None) -> DataFrame | None:
        """The table, or only some of its blocks; None where there is nothing."""
        wanted = None if blocks is None else set(blocks)
        return self._read([e for e in self.manifest(before) if wanted is None or e[0] in wanted])

    def read_version(self, version: int) -> DataFrame | None:
        """The rows that one version wrote."""
        return self._read([(block, version) for block in self._written(version)])

    def _written(self, version: int) -> list[str]:
        """Blocks that have data of one version."""
        head = f"{self.column}="
        return [leaf[len(head):] for leaf in files.leaves(self.spark, f"{self._data}/v={version}") if leaf.startswith(head)]

    def _write(self, rows: DataFrame, version: int) -> list[str]:
        writer = rows.repartition(self.column).write.mode("overwrite").partitionBy(self.column)
        writer.parquet(f"{self._data}/v={version}")
        return self._written(version)

    def append(self, rows: DataFrame, version: int) -> list[str]:
        """Add rows; the blocks of old rows are not read.  Returns the blocks written."""
        written = self._write(rows, version)
        self._publish(version, self.manifest(version) + [(block, version) for block in written])
        return written

    def replace(self, rows: DataFrame, version: int, blocks: list[str]) -> list[str]:
        """Put ``rows`` in place of all rows of ``blocks``.  Returns the blocks written."""
        gone, written = set(blocks), self._write(rows, version)
        self._publish(version, [e for e in self.manifest(version) if e[0] not in gone] + [(block, version) for block in written])
        return written

    def upsert(self, new: DataFrame, version: int, merge) -> list[str]:
        """Merge rows into the blocks they lie in: ``merge(old rows or None, new rows)`` gives these blocks' rows."""
        blocks = sorted(r[0] for r in new.select(self.column).distinct().collect())
        return self.replace(merge(self.read(blocks, version), new), version, blocks)

    def compact(self, version: int, most: int) -> list[str]:
        """Write blocks that lie in more than ``most`` pieces anew as one.  Returns these blocks."""
        entries = self.manifest(version)
        pieces: dict[str, int] = {}
        for block, _ in entries:
            pieces[block] = pieces.get(block, 0) + 1
        crowded = sorted(b for b, n in pieces.items() if n > most)
        if crowded:
            self.replace(self._read([e for e in entries if e[0] in set(crowded)]), version, crowded)
        return crowded

    def drop_old(self, keep: int) -> None:
        """Delete all but the newest manifests, and data that none of these names."""
        done = self.versions()
        for _, path in done[:-keep]:
            files.remove(self.spark, path)
        named = set()
        for v, _ in done[-keep:]:
            named |= set(self.manifest(v + 1))
        newest = done[-1][0] if done else 0
        for leaf in files.leaves(self.spark, self._data):
            v = int(leaf[2:])
            own = self._written(v)
            # A version without a manifest yet may still be at work.
            for block in own if v <= newest else []:
                if (block, v) not in named:
                    files.remove(self.spark, f"{self._data}/v={v}/{self.column}={block}")
            if v <= newest and not any((block, v) in named for block in own):
                files.remove(self.spark, f"{self._data}/v={v}")
