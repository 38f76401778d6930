"""Near-duplicates by the similarity of their word sequences, checked exactly.

A text is the set of its hashed sequences of WORDS words. Candidates come from the grid join of
``simhash``, over segment popcounts of the set's fingerprint. That finds what is within 2 bits, and
texts of similarity 0.8 are about 10 bits apart, so candidates are as well texts that agree in a band
of ROWS minimum hashes; with BANDS bands, two of similarity 0.8 meet with a probability of 0.99997.
Each candidate pair is then held against the two whole sets.

A cell of more than ``crowd`` texts is not compared pair by pair at first. Its texts are held against
LEADS of them, and are dealt again by FINE further bands within the cell, where small cells are
compared pair by pair and crowded ones again with LEADS of theirs. Texts that are linked by then need
no look at each other any more; all other pairs of the crowded cells are compared, in tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, materialize, without
from .components import stars
from .simhash import SEED, blocks_for, grouped, majority
from .simhash import links as grid_links

WORDS = 5
SIMILARITY = 0.8
BANDS, FINE, ROWS = 20, 6, 4
CROWD = 64
#: Members of a crowded cell that all others are held against.
LEADS = 8
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, ((BANDS + FINE) * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, ((BANDS + FINE) * ROWS, 1), np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of all sequences of WORDS words, sorted; of all words if there are fewer."""
    words = (text or "").encode().translate(LOWER_ASCII).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    first, last = (ends - lens)[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first)))


def bands(found: np.ndarray) -> np.ndarray:
    """BANDS + FINE hashes, each of ROWS minimum hashes of a set."""
    least = np.full((BANDS + FINE) * ROWS, ~np.uint64(0))
    for at in range(0, len(found), 1024):
        least = np.minimum(least, ((found[None, at : at + 1024] ^ _MASKS) * _FACTORS).min(1))
    return np.array([xxhash.xxh64_intdigest(part.tobytes()) for part in least.reshape(-1, ROWS)], np.uint64).view(np.int64)


def _signatures(batches):
    for batch in batches:
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        prints = [np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0) for s in sets]
        names = [n for n in batch.schema.names if n != "text"]
        cells = [bands(s) if len(s) else None for s in sets]
        near = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64)
        more = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(near.view(np.int64)), pa.array(cells, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *more], names=[*names, "fp", "sim", "bands"])


def _sets(batches):
    for batch in batches:
        sets = [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "items"])


def met(rows: DataFrame, crowd: int, lead: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ``rows(fp, cell)`` that share a cell, and (fp, cell) of the crowded cells.

    Those of a crowded cell are paired with LEADS of them, or with none without ``lead``.
    """
    # One member of each of LEADS parts of a cell, so that no cell is ever gathered.
    part = F.pmod(F.xxhash64("fp", "cell"), F.lit(LEADS))
    parts = rows.groupBy("cell", part.alias("part")).agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("cell", "fp")).alias("first"))
    size = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.collect_list("first").alias("firsts")).where("n > 1")
    # Written first, so that Spark can split a crowded cell.
    met = materialize(rows.join(materialize(size, "sizes"), "cell"), "met")
    few = met.where(F.col("n") <= crowd).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    pairs = few.select("fps", F.explode("fps").alias("a")).select("a", F.explode(F.filter("fps", lambda b: b > F.col("a"))).alias("b"))
    many = met.where(F.col("n") > crowd)
    led = many.select("fp", F.explode("firsts").alias("first")).where("fp <> first").select(F.least("fp", "first").alias("a"), F.greatest("fp", "first").alias("b"))
    return pairs.union(led) if lead else pairs, many.select("fp", "cell")


def unlinked(many: DataFrame, links: DataFrame, tile: int = CROWD) -> DataFrame:
    """Pairs (a, b) of ``many(fp, cell)`` that share a cell and are in different components of ``links(a, b)``.

    A cell is dealt into parts of about ``tile`` rows, and each two parts meet in a tile of their own,
    so no task holds a whole cell. Cells of one component are left out.
    """
    root = stars(links)
    rooted = many.join(root, many.fp == root.node, "left").select("fp", "cell", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    size = rooted.groupBy("cell").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    # Written first, so that Spark can split a crowded cell.
    rows = rooted.join(materialize(size.select("cell", F.ceil(F.col("n") / tile).alias("parts")), "sizes"), "cell")
    rows = rows.withColumn("k", F.pmod(F.xxhash64("cell", "fp"), "parts")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    tiles = rows.groupBy("cell", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j")).agg(F.collect_list(F.struct("fp", "root", "k")).alias("all"))
    one = tiles.select("i", "j", "all", F.explode("all").alias("x"))
    others = F.filter("all", lambda y: (y.fp > F.col("x.fp")) & (y.root != F.col("x.root")) & ((F.col("i") == F.col("j")) | (y.k != F.col("x.k"))))
    return one.select(F.col("x.fp").alias("a"), F.explode(F.transform(others, lambda y: y.fp)).alias("b")).distinct()


def alike(pairs: DataFrame, distinct: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` whose whole sets are similar enough."""
    asked = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(distinct.select("fp", "h"), "fp")
    # Copies are put together before the shuffle.
    once = texts.groupBy("h").agg(F.first("text").alias("text"))
    sets = materialize(once.join(asked, "h").select("fp", "text").mapInArrow(_sets, "fp long, items array<long>"), "sets")
    own = lambda x: sets.select(F.col("fp").alias(x), F.col("items").alias(f"{x}_items"))
    both = pairs.join(own("a"), "a").join(own("b"), "b")
    shared = F.size(F.array_intersect("a_items", "b_items"))
    return both.where(shared >= similarity * (F.size("a_items") + F.size("b_items") - shared)).select("a", "b")


def grid_cells(every: DataFrame) -> DataFrame:
    """(fp, cell) of the texts whose fingerprints ``simhash`` links: a cell for each link, and for each fingerprint."""
    sims = materialize(every.select(F.col("sim").alias("fp")).distinct(), "sims")
    near = grid_links(sims, blocks_for(sims.count()))
    ends = near.select(F.explode(F.array("a", "b")).alias("sim"), F.xxhash64("a", "b").alias("cell"))
    return every.select("fp", F.xxhash64(F.lit(-1), "sim").alias("cell")).union(every.join(ends, "sim").select("fp", "cell"))


def links(distinct: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(a, b) of ``distinct(fp, h, sim, bands)`` whose sets have a Jaccard similarity of ``similarity`` or more; ``texts`` is (h, text).

    Of the texts in a crowded cell only as many as keep what is reachable the same.
    """
    every = distinct.where("bands IS NOT NULL")
    coarse = every.select("fp", F.posexplode(F.slice("bands", 1, BANDS)).alias("k", "v")).select("fp", F.xxhash64("k", "v").alias("cell"))
    pairs, many = met(coarse.union(grid_cells(every)), crowd)
    again = many.join(every.select("fp", F.slice("bands", BANDS + 1, FINE).alias("fine")), "fp")
    fine = again.select("fp", "cell", F.posexplode("fine").alias("k", "v")).select("fp", F.xxhash64("cell", "k", "v").alias("cell"))
    pairs = materialize(pairs.union(met(fine, crowd)[0]).distinct(), "pairs")
    found = alike(pairs, distinct, texts, similarity)
    if many.isEmpty():
        return found
    found = materialize(found, "found")
    # The pairs that were compared and are not alike are known already.
    more = materialize(unlinked(many, found, crowd).join(pairs, ["a", "b"], "left_anti"), "more")
    return found if more.isEmpty() else found.union(alike(more, distinct, texts, similarity))


def components(docs: DataFrame, id_col: str = "doc_id", similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """All columns of ``docs`` but ``text``, with ``fp``, ``component_id`` and ``root_fp``, as ``simhash.components`` has them.

    ``fp`` is the hash of the set of word sequences. Texts without a word have 0 and are one group.
    """
    docs = without(docs, "fp", "sim", "bands", "h", "component_id", "root_fp")
    h = F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    rest = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    signed = docs.select("*", h).mapInArrow(_signatures, f"{rest}, h long, fp long, sim long, bands array<long>")
    prints = materialize(signed, "prints")
    per = prints.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.first("h").alias("h"), F.first("sim").alias("sim"), F.first("bands").alias("bands"))
    distinct = materialize(per, "distinct")
    return grouped(prints.drop("h", "sim", "bands"), distinct.select("fp", "least_id"), links(distinct, docs.select(h, "text"), similarity, crowd))
