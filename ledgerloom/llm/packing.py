"""Packing documents into training sequences by best-fit decreasing.

Documents longer than a sequence are first cut into full windows. Of the rest, the longest comes
first, and each goes into the open sequence that it fills best; a segment tree over the remaining
capacities finds that sequence in a few steps. The pieces are dealt into groups by a hash; the
number of groups follows the size of the input, so each stays small and is packed by itself,
while a group of some thousand documents already packs almost without padding. Equal rows are told
apart by where they come up in the input, so they are dealt to all groups like others.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordpieces
from .common import small, text_or_empty

WINDOW = 2048
END_ID = 1
#: Bytes of text dealt to a group, about.
GROUP_BYTES = 10_000_000
#: Pieces in a batch: with their ids, 8 MB at most.
PIECES = 1000
#: Bytes of text to a partition, at most about; the session's number of partitions counts below that.
PARTITION_BYTES = 128 << 20


class OpenSequences:
    """Open sequences by remaining capacity, under a segment tree that counts them."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, capacity: int, by: int) -> None:
        node = self.size + capacity
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, sequence: int, capacity: int) -> None:
        if capacity:
            self.at[capacity].append(sequence)
            self._count(capacity, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the sequence with the least capacity that is enough: (sequence, capacity)."""
        node = self.size + length
        tree = self.tree
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._count(capacity, -1)
        return self.at[capacity].pop(), capacity


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; the order of ``lengths`` settles ties."""
    if len(lengths) and not 0 < lengths.min() <= lengths.max() <= window:
        raise ValueError("lengths from 1 to the window are needed")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, n = OpenSequences(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        if found := room.tightest(length):
            k, capacity = found
        else:
            k, capacity, n = n, window, n + 1
        sequence[i], offset[i] = k, window - capacity
        room.put(k, capacity - length)
    return sequence, offset


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """(doc_id, start, length, doc_tokens, salt, ids): whole windows and what is left of each document.

    A document is its ids and ``end_id``, so null and empty texts have one id. Without ``ids`` their
    crc32 is given instead, as ``ids_crc32``. ``salt`` is 0 but for rows that have come up before in
    the same batch of a task.
    """
    last = ("ids", pa.binary()) if ids else ("ids_crc32", pa.int64())
    names = ["doc_id", "start", "length", "doc_tokens", "salt", last[0]]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 5 + [last[1]])], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wordpieces.encoder(path)
        end = array("I", [end_id]).tobytes()
        given = ids
        for k, batch in enumerate(small(batches)):
            cols = batch.schema.names
            doc_ids, out = batch.column(cols.index("doc_id")).to_pylist(), []
            seen: Counter = Counter()
            for doc_id, data in zip(doc_ids, words.encode(batch.column(cols.index("text")), end)):
                n, crc = len(data) // 4, zlib.crc32(data)
                again = seen[doc_id, crc]
                seen[doc_id, crc] += 1
                salt = hash((TaskContext.get().partitionId(), k, again)) if again else 0
                for a in range(0, n, window):
                    part = data[4 * a : 4 * (a + window)]
                    out.append((doc_id, a, min(window, n - a), n, salt, part if given else zlib.crc32(part)))
                if len(out) >= PIECES:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id long, start long, length long, doc_tokens long, salt long, {last[0]} {'binary' if ids else 'long'}")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, group_bytes: int = GROUP_BYTES, ids: bool = True) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: where each is placed, gapless from 0.

    Equal rows are packed each by itself. An empty table gives no piece. Columns beyond doc_id
    and text are left out. Without ``ids`` only their crc32 is moved.
    """
    total = docs.agg(F.sum(F.octet_length(text_or_empty()) + 64)).first()[0] or 0
    groups = max(1, round(total / group_bytes))
    # Partitions follow the input: beyond the session's number each takes PARTITION_BYTES of text.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    last = "ids" if ids else "ids_crc32"
    dealt = pieces(docs, path, window, end_id, ids).withColumn("g", F.pmod(F.xxhash64("doc_id", "start", last, "salt"), F.lit(groups)))
    dealt = dealt.repartition(parts, "g")

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", last)])
        sequence, offset = best_fit(table.column("length").to_numpy(), window)
        first = table.column("g")[0].as_py() << 32
        return table.drop_columns(["g", "salt"]).append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))

    schema = f"doc_id long, start long, length long, doc_tokens long, {last} {'binary' if ids else 'long'}, sequence_id long, offset long"
    return dealt.groupBy("g").applyInArrow(place, schema)
