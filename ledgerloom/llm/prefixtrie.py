"""The trie of conversation prefixes, with sums over subtrees by heavy-path decomposition.

A node is known by 128 bits: the exclusive or of a hash of every turn of the prefix with its place.
Prefixes are then running sums, which are taken in blocks, so a conversation of any length is spread
over many tasks, and nodes are one grouped aggregation, summed before the shuffle.

Each node's largest child carries on its path; the other children begin paths of their own. A path ends
in a leaf and is a stretch of the leaf's first conversation, from the last turn on that begins a path, so
paths are found by one aggregation, not by following pointers. Paths are summed as wholes. Those with
the most path beginnings above them come first and are attached to the node that they hang on; each
beginning at least halves the members, so the rounds are logarithmic in the conversations. At
last every path is summed from its leaf upwards, its attached paths included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: A conversation begins with the first h turns of the first of its hundred; h is below SHARED.
HUNDRED, SHARED = 100, 6
#: Depths in a block of running sums, and ids in a piece of a list of members (a power of two).
BLOCK, PIECE = 4096, 8192
KEY = ["k1", "k2"]


def _numbered(turns: DataFrame) -> DataFrame:
    """(part, conv_id, at, a, b, chars): turns in order; ``at`` counts those of a conversation within its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            numbers = []
            for conv in batch.column("conv_id").to_pylist():
                now, at = conv, at + 1 if conv == now else 0
                numbers.append(at)
            names = ["conv_id", "a", "b", "chars"]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(numbers), pa.int64()), pa.array(numbers, pa.int64()), *[batch.column(n) for n in names]], names=["part", "at", *names])

    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, role, F.lit(1)).alias("b"),
        F.length(text).cast("long").alias("chars"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "a", "b"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "part long, at long, conv_id long, a long, b long, chars long")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, total, depth, a, b, chars) of the turns of every rebuilt conversation; one row of depth 0 for each."""
    turns = materialize(_numbered(turns), "turns")
    held = materialize(turns.groupBy("part", "conv_id").agg(F.count("*").alias("n")), "held")
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # A part has one conversation at most that began before it, so there are no more rows than parts.
    carried = held.select("part", "conv_id", before.alias("before")).where("before > 0")
    placed = turns.join(F.broadcast(carried), ["part", "conv_id"], "left").withColumn("at", F.col("at") + F.coalesce("before", F.lit(0)))
    convs = held.groupBy("conv_id").agg(F.sum("n").alias("n"))
    plan = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("lender"), (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"))
    lent = convs.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("lender"), F.col("n").alias("lent"))
    plan = plan.join(lent, "lender", "left").withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0))))
    # Written first, so that Spark can split a conversation with very many turns.
    plan = materialize(plan.withColumn("total", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "plan")
    own = placed.join(plan.select("conv_id", "h", "lent", "total"), "conv_id").where("at >= h")
    own = own.select("conv_id", "total", (F.col("lent") + F.col("at") - F.col("h") + 1).alias("depth"), "a", "b", "chars")
    first = placed.where((F.col("at") < SHARED - 1) & (F.col("conv_id") % HUNDRED == 0)).withColumnRenamed("conv_id", "lender")
    shared = first.join(plan.select("conv_id", "lender", "lent", "total"), "lender").where("at < lent")
    shared = shared.select("conv_id", "total", (F.col("at") + 1).alias("depth"), "a", "b", "chars")
    zero = F.lit(0).cast("long")
    roots = plan.select("conv_id", "total", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("chars"))
    return own.union(shared).union(roots)


def _running(df: DataFrame, key: str, sums: dict[str, Column], back: bool, block: int) -> DataFrame:
    """``df`` with an aggregate over the rows up to each one, by depth, or from each one on with ``back``.

    ``sums`` are aggregates under their names, for which the same function joins two of them: the exclusive or, the sum.
    """
    order = F.desc("depth") if back else F.asc("depth")
    rows = df.withColumn("block", F.floor(F.col("depth") / block))
    inside = W.partitionBy(key, "block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select("*", *[agg.over(inside).alias(name) for name, agg in sums.items()])


def _prefixes(turns: DataFrame, block: int) -> DataFrame:
    """``turns`` with the key of each prefix and of the one before it."""
    root = F.col("depth") == 0
    z1 = F.when(root, F.lit(0)).otherwise(F.xxhash64("depth", "a", "b")).alias("z1")
    z2 = F.when(root, F.lit(0)).otherwise(F.xxhash64("b", "depth", "a")).alias("z2")
    rows = turns.select("conv_id", "total", "depth", "chars", z1, z2)
    rows = materialize(_running(rows, "conv_id", {"x1": F.bit_xor("z1"), "x2": F.bit_xor("z2")}, False, block), "blocks")
    # The last prefix of a block is what all later blocks take over.
    ends = rows.where(F.col("depth") % block == block - 1).select("conv_id", (F.col("block") + 1).alias("block"), "x1", "x2")
    over = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = ends.select("conv_id", "block", F.bit_xor("x1").over(over).alias("c1"), F.bit_xor("x2").over(over).alias("c2"))
    carried = materialize(carried, "carried")
    later = rows.where("block > 0").join(carried, ["conv_id", "block"])
    later = later.withColumn("x1", F.col("x1").bitwiseXOR(F.col("c1"))).withColumn("x2", F.col("x2").bitwiseXOR(F.col("c2")))
    cols = ["conv_id", "depth", "chars", (F.col("depth") == F.col("total")).alias("last"), F.col("x1").alias("k1"), F.col("x2").alias("k2")]
    cols += [F.col("x1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("z2")).alias("p2")]
    return rows.where("block = 0").select(*cols).union(later.select(*cols))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order; never more than one piece is held."""
    now, digest = None, None

    def told(rows: list[tuple]) -> pa.RecordBatch:
        k1, k2, ends = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ends, pa.string())], names=["k1", "k2", "ends"])

    for batch in batches:
        done = []
        for key, ids in zip(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()), batch.column("ids")):
            if key == now:
                digest.update(b",")
            else:
                if digest is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            digest.update(ids.as_py().encode())
        yield told(done)
    if digest is not None:
        yield told([(*now, digest.hexdigest())])


def _ends(prefixes: DataFrame, piece: int) -> DataFrame:
    """(k1, k2, ends): a digest of the conversations that end in a node, in order of their ids.

    Ids are joined to pieces in parallel; the digest itself has to take the pieces one after another.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = prefixes.where("last").groupBy(*KEY, F.shiftright("conv_id", piece.bit_length() - 1).alias("piece")).agg(ids.alias("ids"))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInArrow(_digests, "k1 long, k2 long, ends string")


def _paths(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``nodes`` with ``path`` (the first conversation of its leaf), ``head`` (the depth at which it begins) and ``level``."""
    leaves = materialize(nodes.where("n_children = 0").select("conv_id"), "leaves")
    along = materialize(prefixes.where("depth > 0").join(leaves, "conv_id").select("conv_id", "depth", *KEY), "along")
    begins = materialize(nodes.where("light AND depth > 0").select(*KEY), "begins")
    heads = along.join(begins, KEY).groupBy("conv_id").agg(F.max("depth").alias("head"), F.count("*").alias("level"))
    zero = F.lit(0).cast("long")
    paths = leaves.join(heads, "conv_id", "left").select(F.col("conv_id").alias("path"), F.coalesce("head", zero).alias("head"), F.coalesce("level", zero).alias("level"))
    paths = materialize(paths, "paths")
    stretch = along.withColumnRenamed("conv_id", "path").join(paths, "path").where("depth >= head").select(*KEY, "path", "head", "level")
    top = paths.where("head = 0").select(zero.alias("k1"), zero.alias("k2"), "path", "head", "level")
    return nodes.join(stretch.union(top), KEY)


def _attached(placed: DataFrame) -> DataFrame | None:
    """(path, depth, leaves, saved): sums of the paths that hang on a node."""
    sums = [F.sum("leaf").alias("leaves"), F.sum("own").alias("saved")]
    whole = placed.groupBy("path").agg(*sums)
    above = placed.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("path").alias("up"), F.col("depth").alias("at"))
    hung = placed.where("depth = head AND depth > 0").select("p1", "p2", "path", "level").join(above, ["p1", "p2"])
    paths = materialize(hung.join(whole, "path").select("path", "level", "up", "at", "leaves", "saved"), "sums")
    done: list[DataFrame] = []
    for level in range(paths.agg(F.max("level")).first()[0] or 0, 0, -1):
        now = paths.where(F.col("level") == level)
        if done:
            below = done[-1].groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
            now = now.join(below, "path", "left").withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0)))
            now = now.withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0)))
        done.append(materialize(now.select("up", "at", "leaves", "saved"), "attached"))
    if not done:
        return None
    every = reduce(DataFrame.union, done)
    return every.groupBy(F.col("up").alias("path"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def trie(conversations: DataFrame, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256, as the
    module says. Turns are ordered by ``turn``, null first; ties by role, then by a hash of the text, and
    repeated rows are turns like others. Null roles and texts are empty. Rows without a conversation id
    belong to none and are left out. A conversation of which nothing is left ends in the root; an
    empty table has no node. Other columns are not read.
    """
    prefixes = materialize(_prefixes(rebuilt(conversations), block), "prefixes")
    facts = [F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2")]
    nodes = materialize(prefixes.groupBy(*KEY).agg(*facts), "nodes")
    largest = F.max_by(F.struct(*KEY), F.struct("n_convs", "conv_id")).alias("heavy")
    kids = nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), largest)
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")).join(kids, ["p1", "p2"])
    # Written first, so that Spark can split a node with very many children.
    above = materialize(above, "parents")
    below = nodes.where("depth > 0").join(above.drop("n_children"), ["p1", "p2"])
    below = below.select(*nodes.columns, "parent_conv_id", (F.struct(*KEY) != F.col("heavy")).alias("light"))
    root = nodes.where("depth = 0").select(*nodes.columns, F.lit(None).cast("long").alias("parent_conv_id"), F.lit(True).alias("light"))
    counts = above.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    linked = below.union(root).join(counts, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    placed = _paths(materialize(linked, "linked"), prefixes)
    placed = placed.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    placed = materialize(placed, "placed")
    hung = _attached(placed)
    if hung is not None:
        placed = placed.join(hung, ["path", "depth"], "left")
        placed = placed.withColumn("leaf", F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).withColumn("own", F.col("own") + F.coalesce("more_saved", F.lit(0)))
    summed = materialize(_running(placed, "path", {"n_leaves": F.sum("leaf"), "saved_tokens": F.sum("own")}, True, block), "summed")
    # The uppermost node of a block has all of it; blocks above take that over.
    tops = summed.where((F.col("depth") % block == 0) & (F.col("block") > 0) & (F.col("depth") > F.col("head")))
    over = W.partitionBy("path").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, W.currentRow)
    tops = tops.select("path", (F.col("block") - 1).alias("block"), F.sum("n_leaves").over(over).alias("l"), F.sum("saved_tokens").over(over).alias("s"))
    whole = summed.join(materialize(tops, "tops"), ["path", "block"], "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("l", F.lit(0)))
    whole = whole.withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("s", F.lit(0)))
    none = F.sha2(F.lit(b""), 256)
    whole = whole.join(_ends(prefixes, piece), KEY, "left").withColumn("ends_sha256", F.coalesce("ends", none))
    longs = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return whole.select(*[F.col(c).cast("long").alias(c) for c in longs], "ends_sha256")


def oracle_sql() -> str:
    """The trie over the ``conversations`` table in SQL for DuckDB: prefixes are texts, and every node counts for all above it."""
    # CRC-32 of the decimal digits, bit by bit.
    step = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    digits = "list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: {step}), 4294967295)"
    return f"""
WITH ranked AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS at
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS n FROM ranked GROUP BY conv_id),
plan AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % {HUNDRED} AS lender, c.h, least(c.h, coalesce(l.n, 0)) AS lent
  FROM (SELECT *, {crc} % {SHARED} AS h FROM convs) c LEFT JOIN convs l ON l.conv_id = c.conv_id - c.conv_id % {HUNDRED}),
rows_of AS (
  SELECT p.conv_id, p.lent + r.at - p.h + 1 AS depth, r.role, r.text FROM plan p JOIN ranked r ON r.conv_id = p.conv_id AND r.at >= p.h
  UNION ALL
  SELECT p.conv_id, r.at + 1, r.role, r.text FROM plan p JOIN ranked r ON r.conv_id = p.lender AND r.at < p.lent),
lists AS (
  SELECT p.conv_id, coalesce(list(sha256(length(r.role) || ',' || r.role || r.text) ORDER BY depth) FILTER (r.depth IS NOT NULL), []) AS turns,
    coalesce(list(length(r.text) ORDER BY depth) FILTER (r.depth IS NOT NULL), []) AS chars
  FROM plan p LEFT JOIN rows_of r ON r.conv_id = p.conv_id GROUP BY p.conv_id),
steps AS (SELECT conv_id, turns, chars, unnest(range(0, len(turns) + 1)) AS depth FROM lists),
prefixes AS (
  SELECT conv_id, depth, array_to_string(turns[:depth], ',') AS node, array_to_string(turns[:depth - 1], ',') AS above,
    CASE WHEN depth > 0 THEN chars[depth] ELSE 0 END AS chars, depth = len(turns) AS ends
  FROM steps),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth),
children AS (SELECT above, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.above = n.node AND c.depth = n.depth),
ancestors AS (
  SELECT own, n_children, unnest(list_transform(range(0, depth + 1), lambda d: {{'depth': d, 'node': left(node, greatest(65 * d - 1, 0))}})) AS a FROM full_nodes),
sums AS (
  SELECT a.node AS node, a.depth AS depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved_tokens FROM ancestors GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.node = n.node AND s.depth = n.depth
LEFT JOIN full_nodes p ON p.node = n.above AND p.depth = n.depth - 1 AND n.depth > 0
"""
