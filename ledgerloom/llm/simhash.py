"""SimHash near-duplicates by a grid join over segment popcounts.

A fingerprint of 64 bits is mapped to the number of set bits in each of its 32 two-bit segments.
The Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints, so only vectors within that distance need an exact look. The grid: the 32
segments form ``blocks`` blocks; if the Manhattan distance is at most r, at least ``blocks - r``
blocks are equal, and the fingerprints meet in the cell of such a choice of blocks.

A count of 0, 1 or 2 is written in unary (00, 01, 11), so a whole vector is one long and the
Manhattan distance is the bit count of an exclusive or.

Cells of more than ``cell_cap`` fingerprints are not compared pair by pair. There, fingerprints
at distance 2 or less are found by the point between them: each is sent to itself and to its 64
one-bit neighbours, and all that meet at a point are linked. That is exact for a radius of 2 and
linear in the size of the cell.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, materialize, without
from .components import stars

RADIUS = 2
SHINGLE = 3
SEED = 42
BLOCKS = 4
CELL_CAP = 128
_LOW = 0x5555555555555555


def fingerprint(text: str | None) -> int:
    """Unsigned SimHash of the whole text; 0 if it has no word."""
    words = (text or "").encode().translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    first, last = (ends - lens)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), "<u8", len(first))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
        keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(prints)], names=[*names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The other columns of ``docs`` and ``fp``, the fingerprint as a signed long, in place of ``text``."""
    rest = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    return docs.mapInArrow(_fingerprints, f"{rest}, fp long")


def embedding(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments, each in unary, in one long."""
    high = F.shiftrightunsigned(fp, 1)
    low = F.lit(_LOW)
    some = fp.bitwiseOR(high).bitwiseAND(low)
    both = fp.bitwiseAND(high).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _cells(vector: Column, blocks: int, radius: int) -> Column:
    """An array with the cell of every choice of ``blocks - radius`` blocks."""
    edge = [64 * i // blocks // 2 * 2 for i in range(blocks)] + [64]
    cells = []
    for k, some in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum((1 << edge[i + 1]) - (1 << edge[i]) for i in some)
        mask -= (mask >> 63) << 64
        cells.append(F.struct(F.lit(k).alias("k"), vector.bitwiseAND(F.lit(mask)).alias("v")))
    return F.array(*cells)


def blocks_for(n: int, cell_cap: int = CELL_CAP) -> int:
    """Blocks so that of ``n`` random fingerprints a cell holds a quarter of ``cell_cap`` at most, on average."""
    b = BLOCKS
    # Two random segments have equal popcounts in 3 of 8 cases.
    while b < 16 and n * (3 / 8) ** (32 * (b - RADIUS) // b) > cell_cap / 4:
        b += 1
    return b


def links(prints: DataFrame, blocks: int = BLOCKS, cell_cap: int = CELL_CAP) -> DataFrame:
    """(a, b) so that all pairs of ``prints(fp)`` within 2 bits are connected.

    ``prints`` holds distinct fingerprints. In ordinary cells every such pair is returned; in
    crowded cells enough of them to keep what is reachable the same.
    """
    if blocks <= RADIUS:
        raise ValueError("more blocks than differing bits are needed")
    cells = prints.select("fp", F.explode(_cells(embedding(F.col("fp")), blocks, RADIUS)).alias("cell"))
    size = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # Written first, so that Spark can split a crowded cell.
    met = materialize(cells.join(materialize(size, "sizes"), "cell"), "cells")
    few = met.where(F.col("n") <= cell_cap).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    a = F.col("a")
    near = F.filter(
        "fps",
        lambda b: (b > a)
        & (F.bit_count(embedding(a).bitwiseXOR(embedding(b))) <= RADIUS)  # Manhattan, the lower bound
        & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS),
    )
    pairs = few.select("fps", F.explode("fps").alias("a")).select("a", F.explode(near).alias("b"))
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(x)) for x in bits])
    crowd = met.where(F.col("n") > cell_cap).select("fp").distinct()
    meeting = (
        crowd.select("fp", F.explode(points).alias("point")).groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    )  # at most 65 fingerprints are within one bit of a point
    linked = meeting.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(linked).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", blocks: int | None = None, cell_cap: int = CELL_CAP) -> DataFrame:
    """All columns of ``docs`` but ``text``, with ``fp`` and ``component_id``.

    ``component_id`` is the smallest id reachable over links, the own one included. Null and
    empty texts have fingerprint 0 and are linked like any other. Rows whose id is null belong to
    their group as well; a group without any id has the null component. Repeated rows stay. An
    empty table gives an empty result. Columns called fp, component_id or root_fp make way. The
    number of blocks follows that of the fingerprints unless it is given.
    """
    docs = without(docs, "fp", "component_id", "root_fp")
    prints = materialize(fingerprints(docs), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")), "distinct")
    blocks = blocks_for(distinct.count(), cell_cap) if blocks is None else blocks
    return grouped(prints, distinct, links(distinct.select("fp"), blocks, cell_cap))


def grouped(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``prints`` with ``component_id`` and ``root_fp``, from ``distinct(fp, least_id)`` and ``edges(a, b)``."""
    root = stars(edges)
    # Only what has a link needs the detour over its root.
    member = root.join(distinct, root.node == distinct.fp).select("fp", "root", "least_id")
    group = member.groupBy("root").agg(F.min("least_id").alias("group_id"))
    grouped = member.join(group, "root").select("fp", "root", "group_id")
    table = distinct.join(grouped, "fp", "left").select(
        "fp", F.coalesce("group_id", "least_id").alias("component_id"), F.coalesce("root", "fp").alias("root_fp")
    )
    # Written first, so that this join has exchanges of its own and Spark can split a large group of copies.
    return prints.join(materialize(table, "groups"), "fp")


def deduplicate(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = components) -> DataFrame:
    """One row of each group of near-duplicates that ``find`` tells, with the columns of ``docs``.

    The row with the smallest doc_id stays (null ids come last); of rows with the same id, the one
    with the smallest hash of its text; of rows with the same id and text, one. All columns stay.
    """
    key = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    found = find(key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("w")
    best = found.groupBy("root_fp").agg(first)
    same = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    best = (
        best.select(F.col("w.doc_id").alias("w_id"), F.col("w.text_hash").alias("w_hash"))
        .join(same, F.col("w_id").eqNullSafe(F.col("doc_id")) & (F.col("w_hash") == F.col("text_hash")))
        .select("w_id", "w_hash", "copies")
    )
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    hashed = docs.select(whole, "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    kept = hashed.join(best, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_hash")))
    repeated = kept.where("copies > 1").dropDuplicates(["doc_id", "h"])
    return kept.where("copies = 1").select("row.*").union(repeated.select("row.*"))
