"""Incremental maintenance: shards by content, full and delta packs, multiset differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that name its block.
BLOCK_DIGITS = 3


def shard_manifest(docs: DataFrame, shard: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(shard, hash, n): a shard's hash covers its rows' ids and texts, in whatever order they come.

    Rows are hashed where they are and counted by digest. The digests of a shard are hashed in 4096
    blocks by their first BLOCK_DIGITS digits, then the blocks, so that no task gathers a whole shard.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.col(id_col).cast("string"), F.coalesce("text", F.lit(""))), 256)
    rows = docs.select(F.col(shard).alias("shard"), digest.alias("d")).groupBy("shard", "d").agg(F.count("*").alias("n"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    block = F.substring("d", 1, BLOCK_DIGITS).alias("block")
    blocks = rows.groupBy("shard", block).agg(joined(F.concat_ws(":", "d", F.col("n").cast("string"))).alias("d"), F.sum("n").alias("n"))
    return blocks.groupBy("shard").agg(joined(F.concat("block", "d")).alias("hash"), F.sum("n").alias("n"))


def shard_diff(new: DataFrame, base: DataFrame) -> DataFrame:
    """(shard, change): added, changed, removed or same."""
    both = new.select("shard", F.col("hash").alias("new_hash")).join(base.select("shard", F.col("hash").alias("old_hash")), "shard", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("new_hash") != F.col("old_hash"), "changed").otherwise("same")
    return both.select("shard", change.alias("change"))


def delta_pack(rows: DataFrame, diff: DataFrame) -> DataFrame:
    """The rows of added and changed shards."""
    return rows.join(diff.where(F.col("change").isin("added", "changed")).select("shard"), "shard", "left_semi")


def install(installed: DataFrame, pack: DataFrame, removed: DataFrame, full: bool) -> DataFrame:
    """What is installed after a pack: its shards replace those of the same name, removed ones go.

    A full pack leaves nothing else; a delta keeps what it does not name.
    """
    if full:
        return pack
    gone = pack.select("shard").union(removed.select("shard")).distinct()
    return installed.join(gone, "shard", "left_anti").unionByName(pack)


def choose_pack(installed_version: str | None, installed_shards: int, manifest: dict) -> str:
    """skip, repair, delta or full, from the versions and the number of shards."""
    if installed_version == manifest["version"]:
        return "skip" if installed_shards == manifest["total_after"] else "repair"
    return "delta" if installed_version is not None and installed_version == manifest.get("base") else "full"


def multiset_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(columns, change, n): rows that one side has more often, and by how many. One aggregation."""
    cols = new.columns
    signed = new.withColumn("by", F.lit(1)).unionByName(old.withColumn("by", F.lit(-1)))
    sums = signed.groupBy(*cols).agg(F.sum("by").alias("by")).where("by <> 0")
    return sums.select(*cols, F.when(F.col("by") > 0, "insert").otherwise("remove").alias("change"), F.abs("by").alias("n"))


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    return multiset_diff(a, b).isEmpty()


def cache_misses(wanted: DataFrame, cached: DataFrame, key: str = "snippet") -> DataFrame:
    """Distinct texts for which there is no vector yet."""
    return wanted.select(key).distinct().join(cached.select(key), key, "left_anti")


def with_vectors(wanted: DataFrame, cached: DataFrame, embed: Column, key: str = "snippet") -> DataFrame:
    """Vectors of all texts: kept ones where there are any, new ones for the rest only."""
    new = cache_misses(wanted, cached, key).select(key, embed.alias("embedding"))
    return wanted.join(cached.select(key, "embedding").unionByName(new), key)
