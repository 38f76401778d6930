"""A store of vectors in shards, which changes by one manifest at a time.

A shard is what one source file gives. Publishing writes the shards that have changed to a folder of
their own, and then a manifest that says of every shard where it lies, how many rows it has and
what they amount to. The manifest is what counts: a writer that dies before it leaves the old state
readable, and a reader that has chosen a manifest keeps its files until ``vacuum``. Shards whose
sources are gone are in no newer manifest.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a manifest may lead to; beyond that all shards are written anew.
MOST_FOLDERS = 64
FACTS = "shard string, n bigint, digest string, folder string"


def _digest(columns: list[str]) -> list[Column]:
    """Number of rows of a group, and a digest of them in any order."""
    rows = [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]
    sums = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in rows]
    return [F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("digest")]


class VectorStore:
    """Shards below ``path``. Rows have ``shard``, the name of their source, beside any other columns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the manifests that are there in full."""
        where, files = self._files()
        if not files.exists(where):
            return []
        found = [(s.getPath(), re.fullmatch(r"manifest-(\d+)", s.getPath().getName())) for s in files.listStatus(where)]
        return sorted(int(m[1]) for path, m in found if m and files.exists(path.suffix("/_SUCCESS")))

    def manifest(self, version: int | None = None) -> DataFrame:
        """(shard, n, digest, folder) of one version, by default the newest; empty before the first."""
        there = self.versions()
        if version is None and not there:
            return self.spark.createDataFrame([], FACTS)
        return self.spark.read.schema(FACTS).parquet(f"{self.path}/manifest-{there[-1] if version is None else version}")

    def publish(self, rows: DataFrame) -> int:
        """Make ``rows`` the store's content; shards that have not changed stay where they are. Returns the new version."""
        there = self.versions()
        columns = sorted(c for c in rows.columns if c != "shard")
        now = rows.where("shard IS NOT NULL").groupBy("shard").agg(*_digest(columns))
        old = self.manifest()
        if old.select("folder").distinct().count() >= MOST_FOLDERS:
            old = old.limit(0)
        folder = f"data-{uuid.uuid4().hex}"
        facts = now.join(old.select("shard", "digest", "folder"), ["shard", "digest"], "left")
        changed = facts.where("folder IS NULL").select("shard")
        # Sorted by shard within files, so that a reader of few shards reads few of their parts.
        rows.join(changed, "shard", "left_semi").withColumn("folder", F.lit(folder)).sortWithinPartitions("shard").write.mode("errorifexists").parquet(f"{self.path}/{folder}")
        version = there[-1] + 1 if there else 0
        facts.select("shard", "n", "digest", F.coalesce("folder", F.lit(folder)).alias("folder")).write.mode("errorifexists").parquet(f"{self.path}/manifest-{version}")
        return version

    def read(self, version: int | None = None, skip_broken: bool = False) -> DataFrame | None:
        """The rows of one version; None before the first. Files that cannot be read stop a reader, or are skipped: ``broken`` tells what they held."""
        facts = self.manifest(version)
        folders = sorted(r[0] for r in facts.select("folder").distinct().collect())  # MOST_FOLDERS at most
        if not folders:
            return None
        rows = self.spark.read.option("ignoreCorruptFiles", skip_broken).parquet(*[f"{self.path}/{x}" for x in folders])
        return rows.join(facts.select("shard", "folder"), ["shard", "folder"], "left_semi").drop("folder")

    def broken(self, version: int | None = None) -> DataFrame:
        """(shard, n, found) of the shards whose rows are not all there, or not as they were published."""
        facts, rows = self.manifest(version), self.read(version, skip_broken=True)
        if rows is None:
            return facts.select("shard", "n", F.lit(0).cast("bigint").alias("found"))
        found = rows.groupBy("shard").agg(*_digest(sorted(c for c in rows.columns if c != "shard"))).withColumnRenamed("n", "found").withColumnRenamed("digest", "seen")
        both = facts.join(found, "shard", "left").where(~F.col("seen").eqNullSafe(F.col("digest")))
        return both.select("shard", "n", F.coalesce("found", F.lit(0)).alias("found"))

    def vacuum(self, keep: int = 2) -> None:
        """Delete all manifests but the newest ``keep``, and the folders that only those lead to."""
        there = self.versions()
        gone, kept = there[:-keep], there[-keep:]
        if not gone:
            return
        folders = lambda versions: {r[0] for v in versions for r in self.manifest(v).select("folder").distinct().collect()}
        where, files = self._files()
        for name in [*[f"manifest-{v}" for v in gone], *sorted(folders(gone) - folders(kept))]:
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, name), True)


def routed(rows: DataFrame, lang: str = "lang") -> DataFrame:
    """Rows with ``route``: en for those marked as English, zh for all others, as each has a model of its own."""
    return rows.withColumn("route", F.when(F.col(lang) == "en", "en").otherwise("zh"))
