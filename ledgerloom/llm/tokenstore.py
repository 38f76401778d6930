"""A table of token ids in fixed-width bit packing, with random access.

Ids are written in ascending order of the document ids. Each row of the store is a block of some
documents: the ids in the fewest bits that hold the vocabulary, highest bit first, where each
document begins, and the least and greatest document id (null if none has one). ``read`` needs the blocks asked for only; unpacking is one numpy operation.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import wordpieces
from .common import keep_until_end, shared_dir, text_or_empty

END_ID = 2
BLOCK_TOKENS = 1 << 16
#: Bytes of text for a shard, about.
SHARD_BYTES = 128 << 20
SCHEMA = (
    "shard int, block int, bits int, n_docs int, n_tokens long, first_token long, first_doc long, last_doc long, "
    "doc_ids array<long>, doc_starts array<long>, packed binary"
)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, highest first, and zero bits up to a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits")
    if bits in (8, 16, 32):  # the same layout, without taking bits apart
        return ids.astype(f">u{bits // 8}").tobytes()
    out = [((ids[a : a + 65536, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1).astype(np.uint8).ravel() for a in range(0, len(ids), 65536)]
    return np.packbits(np.concatenate(out) if out else np.zeros(0, np.uint8)).tobytes()


def unpack_bits(packed: bytes, bits: int, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (not included) as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f">u{bits // 8}", last - first, first * bits // 8).astype("<u4")
    start = first * bits // 8
    raw = np.unpackbits(np.frombuffer(packed, np.uint8, (last * bits + 7) // 8 - start, start))
    raw = raw[first * bits - 8 * start :][: (last - first) * bits].reshape(-1, bits)
    return (raw.astype("<u4") << np.arange(bits - 1, -1, -1, dtype=np.uint32)).sum(1, dtype="<u4")


def blocks(docs: DataFrame, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, shards: int | None = None) -> DataFrame:
    """The rows of a store. Null ids come first; rows of one id are ordered by their texts' hashes.

    An empty table gives no row; columns beyond doc_id and text are left out.
    """
    if shards is None:
        total = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wordpieces.encoder(path)
        bits = bits_for(words.vocabulary())
        end = array("I", [end_id]).tobytes()
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        data: list[bytes] = []

        def row() -> pa.RecordBatch:
            starts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in data]))).tolist()
            packed = pack_bits(np.frombuffer(b"".join(data), "<u4"), bits)
            given = [d for d in ids if d is not None] or [None]
            cells = [shard, block, bits, len(ids), starts[-1], first, min(given), max(given), ids, starts, packed]
            kinds = [pa.int32()] * 4 + [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        held = 0
        for batch in batches:
            names = batch.schema.names
            for doc_id, x in zip(batch.column(names.index("doc_id")).to_pylist(), words.encode(batch.column(names.index("text")), end, 4 << 20)):
                ids.append(doc_id)
                data.append(x)
                held += len(x) // 4
                if held >= block_tokens:
                    yield row()
                    block, first, held = block + 1, first + held, 0
                    ids, data = [], []
        if ids:
            yield row()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(text_or_empty())]
    # Equal rows may go to several shards: they are told apart by their places in the input.
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    return ordered.mapInArrow(write, SCHEMA)


def write(docs: DataFrame, path: str, to: str | None = None, **options) -> str:
    """Write a store and return its folder, by default a new one in the shared folder that goes with the application.

    Spark's writer commits whole tasks, so a lost executor leaves no half-written shard.
    """
    own, to = to is None, to or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    blocks(docs, path, **options).write.option("compression", "zstd").parquet(to)
    if own:
        keep_until_end(docs.sparkSession, to)
    return to


def read(spark: SparkSession, store: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents, or of those with ids in a range.

    ``start`` counts the ids of all documents before. Shards are one row each of the sums that
    this takes; which blocks hold a range is read from the Parquet statistics. Documents without
    an id are in no range.
    """
    table = spark.read.schema(SCHEMA).parquet(store)
    sums = table.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if first_doc is not None:
        table = table.where(F.col("last_doc") >= first_doc)
    if last_doc is not None:
        table = table.where(F.col("first_doc") <= last_doc)
    inside = lambda d: (first_doc is None or d is not None and d >= first_doc) and (last_doc is None or d is not None and d <= last_doc)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, base = r["doc_starts"], r["before"] + r["first_token"]
                rows = [(d, base + a, b - a, unpack_bits(r["packed"], r["bits"], a, b).tobytes()) for d, a, b in zip(r["doc_ids"], at, at[1:]) if inside(d)]
                cols = list(zip(*rows)) or [()] * 4
                kinds = [pa.int64()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "n_tokens", "ids"])

    cols = ["before", "bits", "first_token", "doc_ids", "doc_starts", "packed"]
    return table.join(shards, "shard").select(cols).mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


