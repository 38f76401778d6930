"""Repeated passages by fixed-block anchors.

Every text is cut into blocks of half a window and one word, side by side. Any window of WINDOW words
holds exactly one such block of its own text that begins in its first BLOCK words. So if a window
occurs twice, that block occurs as a stretch of words at the other place as well: the blocks are the
index, every stretch of BLOCK words is held against it, and only round blocks found at two places are
windows looked at whole. A block found is extended over all windows around it; windows that recur
are merged to maximal repeats.

No pair of places is ever made. Texts are dealt into batches; a batch tells each shard of the hash
range what it holds, each hash at most twice, so a passage in a third of all texts is a few numbers for
each batch. A shard answers each batch with those of its hashes that occur at two places.
The texts lie in a bucketed table, so both answers come to them without moving them again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_until_end, shared_dir, text_or_empty, without

WINDOW = 35
#: Bytes of text in a batch, and hashes in a shard, at most about.
BATCH_BYTES, SHARD_HASHES = 8 << 20, 4 << 20
#: Bytes of answers that a task holds before it sends them.
ANSWER_BYTES = 32 << 20
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
COLUMNS = ("n_words", "n_removed", "kept_sha256")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Batch:
    """The words of some texts, side by side, with hashes of stretches of them."""

    def __init__(self, texts: list[str | None], window: int):
        self.window = window
        self.words = [(t or "").encode().split() for t in texts]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        digest = xxhash.xxh64_intdigest
        self.hash = np.fromiter((digest(w) for words in self.words for w in words), np.uint64, total)
        self.end = np.repeat(self.begin + self.n, self.n)
        self.place = np.arange(total) - np.repeat(self.begin, self.n)

    def starts(self, width: int) -> np.ndarray:
        """Where a stretch of ``width`` words begins, in texts that hold a window."""
        at = np.arange(len(self.hash))
        return at[(at + width <= self.end) & (self.end - at + self.place >= self.window)]

    def stretches(self, at: np.ndarray, width: int, stream: int = 0) -> np.ndarray:
        """Hashes of the stretches at ``at``: a polynomial modulo 2**64, kept as sums from the left, and mixed."""
        n = len(self.hash)
        base = _ODD[stream]
        power = np.ones(n + 1, np.uint64)
        power[1:] = np.uint64(base)
        inverse = np.ones(n + 1, np.uint64)
        inverse[1:] = np.uint64(pow(base, -1, 1 << 64))
        power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        own = self.hash if stream == 0 else _mixed(self.hash ^ np.uint64(base))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power[:n], dtype=np.uint64)])
        return _mixed((sums[at + width] - sums[at]) * inverse[at])


def _twice(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The keys, sorted, each as often as it occurs but at most twice."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    keys = tuple(k[order] for k in keys)
    third = np.zeros(len(order), bool)
    third[2:] = np.logical_and.reduce([k[2:] == k[:-2] for k in keys])
    return tuple(k[~third] for k in keys)


def _sliced(first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the shards in sorted hashes, and the shards that have any."""
    edges = np.searchsorted(first, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
    edges = np.concatenate([[0], edges, [len(first)]])
    return edges, np.flatnonzero(np.diff(edges))


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _low(first: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of a hash behind those that name its shard."""
    return (first << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)


def _by_batch(batches: Iterator[pa.RecordBatch], bytes_at_once: int = 4 * BATCH_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of one batch after another; a batch may come in several parts."""
    now, held, size = None, [], 0
    for batch in batches:
        for label, text in zip(batch.column("batch").to_pylist(), batch.column("text")):
            text = text.as_py()
            if held and (label != now or size > bytes_at_once):
                yield now, held
                held, size = [], 0
            now, size = label, size + len(text or "")
            held.append(text)
    if held:
        yield now, held


def _block(window: int) -> int:
    return (window + 1) // 2


def _index(bits: int, window: int) -> Callable:
    """Each batch's blocks and other stretches by shard, as 32-bit hashes."""
    width = _block(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, texts in _by_batch(batches):
            batch = Batch(texts, window)
            at = batch.starts(width)
            hashes, own = batch.stretches(at, width), batch.place[at] % width == 0
            (blocks,), (others,) = _twice(hashes[own]), _twice(hashes[~own])
            edges, shards = _sliced(np.sort(np.concatenate([blocks, others])), bits)
            cuts = [_sliced(x, bits)[0] for x in (blocks, others)]
            low = [_low(x, bits) for x in (blocks, others)]
            cols = [_binary([x[c[s] : c[s + 1]] for s in shards]) for x, c in zip(low, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array([label] * len(shards), pa.int64()), *cols], names=["shard", "batch", "blocks", "others"])

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["shard"] != now:
                yield now, rows
                rows = []
            now = row["shard"]
            rows.append(row)
    if rows:
        yield now, rows


class _Answers:
    """What a task has found for each batch, told in few rows."""

    def __init__(self):
        self.found: dict[int, list[np.ndarray]] = defaultdict(list)
        self.bytes = 0

    def add(self, label: int, hits: np.ndarray) -> None:
        if len(hits):
            self.found[label].append(hits)
            self.bytes += hits.nbytes

    def told(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """All of it, if it is so many bytes."""
        if self.found and self.bytes >= least:
            hits = _binary([np.concatenate(x) for x in self.found.values()])
            yield pa.RecordBatch.from_arrays([pa.array(self.found, pa.int64()), hits], names=["batch", "hits"])
            self.found, self.bytes = defaultdict(list), 0


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch those of its blocks that occur at two places."""
    answers = _Answers()
    for shard, rows in _by_shard(batches):
        blocks = [np.frombuffer(r["blocks"], np.uint32) for r in rows]
        every = np.sort(np.concatenate([*blocks, *[np.frombuffer(r["others"], np.uint32) for r in rows]]))
        index = np.unique(np.concatenate(blocks))
        hits = index[np.searchsorted(every, index, "right") - np.searchsorted(every, index, "left") > 1]
        for r, b in zip(rows, blocks):
            answers.add(r["batch"], (np.uint64(shard) << np.uint64(32)) | np.unique(b[np.isin(b, hits)]).astype(np.uint64))
        yield from answers.told(ANSWER_BYTES)
    yield from answers.told()


_ANSWER = "batch long, hits binary"


def _windows(bits: int, shard_bits: int, window: int) -> Callable:
    """A batch's windows round the blocks found, by shard, as 64 and 32 bits of two hashes."""
    width = _block(window)

    def run(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        hits = [np.frombuffer(h, np.uint64) for h in found.column("hits").to_pylist()]
        at = np.empty(0, np.int64)
        if hits and texts.num_rows:
            batch = Batch(texts.column("text").to_pylist(), window)
            own = batch.starts(width)
            own = own[batch.place[own] % width == 0]
            full = batch.stretches(own, width)
            short = full >> np.uint64(64 - bits) << np.uint64(32) if bits else np.zeros(len(full), np.uint64)
            block = np.zeros(len(batch.hash) + width, bool)
            block[own[np.isin(short | _low(full, bits), np.concatenate(hits))]] = True
            at = batch.starts(window)
            at = at[block[at - batch.place[at] % -width]]
        if not len(at):
            return pa.table({"shard": pa.array([], pa.int64()), "batch": pa.array([], pa.int64()), "first": pa.array([], pa.binary()), "second": pa.array([], pa.binary())})
        first, second = _twice(batch.stretches(at, window), batch.stretches(at, window, 1).astype(np.uint32))
        edges, shards = _sliced(first, shard_bits)
        cols = [_binary([x[edges[s] : edges[s + 1]] for s in shards]) for x in (first, second)]
        return pa.table([pa.array(shards, pa.int64()), pa.array([key[0].as_py()] * len(shards), pa.int64()), *cols], names=["shard", "batch", "first", "second"])

    return run


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The two hashes of a window as one value of 96 bits that can be compared."""
    out = np.empty(len(first), [("a", np.uint64), ("b", np.uint32)])
    out["a"], out["b"] = first, second
    return out


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch those of its windows that occur at two places."""
    answers = _Answers()
    for _, rows in _by_shard(batches):
        each = [(np.frombuffer(r["first"], np.uint64), np.frombuffer(r["second"], np.uint32)) for r in rows]
        first, second = (np.concatenate(x) for x in zip(*each))
        batch = np.repeat(np.arange(len(rows)), [len(a) for a, _ in each])
        order = np.lexsort((second, first))
        a, b, batch = first[order], second[order], batch[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        twice = np.append(same, False) | np.append(False, same)
        a, b, batch = a[twice], b[twice], batch[twice]
        order = np.argsort(batch, kind="stable")
        cuts = np.searchsorted(batch[order], np.arange(len(rows) + 1))
        pairs = _pairs(a[order], b[order])
        for k, r in enumerate(rows):
            answers.add(r["batch"], np.unique(pairs[cuts[k] : cuts[k + 1]]))
        yield from answers.told(ANSWER_BYTES)
    yield from answers.told()


def _removal(names: list[str], window: int) -> Callable:
    """The texts of a batch without the words that a recurring window covers."""

    def run(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        batch = Batch(texts.column("text").to_pylist(), window)
        gone = np.zeros(len(batch.hash) + 1, np.int64)
        if found.num_rows:
            at = batch.starts(window)
            hits = np.concatenate([np.frombuffer(h, _pairs(np.empty(0), np.empty(0)).dtype) for h in found.column("hits").to_pylist()])
            first = batch.stretches(at, window)
            near = np.isin(first, hits["a"])
            at, first = at[near], first[near]
            at = at[np.isin(_pairs(first, batch.stretches(at, window, 1).astype(np.uint32)), hits)]
            np.add.at(gone, at, 1)
            np.subtract.at(gone, at + window, 1)
        gone = np.cumsum(gone[:-1]) > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), batch.begin) * (batch.n > 0) if len(batch.n) else np.empty(0, np.int64)
        digests = []
        for words, begin, lost in zip(batch.words, batch.begin.tolist(), removed.tolist()):
            kept = [words[i] for i in np.flatnonzero(~gone[begin : begin + len(words)]).tolist()] if lost else words
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        more = [pa.array(batch.n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        return pa.table([*[texts.column(n) for n in names], *more], names=[*names, *COLUMNS])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without ``text``, with the number of its words, of those removed, and a digest of the others.

    Removed is each word that a window of ``window`` words covers whose word sequence also begins
    anywhere else, in the same document as well; all windows are judged on the texts as they come.
    Windows are told apart by 96 bits of hashes of their words.

    Null and empty texts have no words, repeated rows are copies of each other like any others, and null
    ids pass through. A text of any length is one row of one batch. An empty table gives an empty
    result. Columns with the names of the results make way.
    """
    spark = docs.sparkSession
    docs = without(docs, *COLUMNS, "batch")
    names = [n for n in docs.columns if n != "text"]
    rows, total = docs.agg(F.count("*"), F.sum(F.octet_length(text_or_empty()))).first()
    total = total or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 * BATCH_BYTES)))
    # Batches follow the input; each holds BATCH_BYTES at most on average. Batches and shards meet, so there are no more than needed.
    batches = max(2 * parts, -(-total // BATCH_BYTES))
    each = max(1, rows // batches)
    bits = (max(2 * parts, -(-total // SHARD_HASHES)) - 1).bit_length()
    label = F.xxhash64(F.floor(F.monotonically_increasing_id() / each)).alias("batch")
    name, path = f"passages_{uuid.uuid4().hex}", f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}"
    dealt = docs.select("*", label).repartition(parts, "batch")
    dealt.write.bucketBy(parts, "batch").sortBy("batch").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    keep_until_end(spark, path)
    texts = spark.table(name)
    own = texts.select("batch", "text")
    meet = lambda told, answer: told.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(answer, _ANSWER)
    index = own.mapInArrow(_index(bits, window), "shard long, batch long, blocks binary, others binary")
    anchors = meet(index, _anchors)
    told = own.groupBy("batch").cogroup(anchors.groupBy("batch")).applyInArrow(_windows(bits, bits, window), "shard long, batch long, first binary, second binary")
    recurring = meet(told, _recurring)
    schema = [f"`{n}` {t}" for n, t in docs.dtypes if n != "text"] + ["n_words long", "n_removed long", "kept_sha256 string"]
    result = texts.groupBy("batch").cogroup(recurring.groupBy("batch")).applyInArrow(_removal(names, window), ", ".join(schema))
    # The table's files stay, its name is needed no more.
    spark.sql(f"DROP TABLE {name}")
    return result


def oracle_sql(window: int = WINDOW) -> str:
    """The same in SQL for DuckDB, with every window as a text."""
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM docs),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + {window - 1}], ' ') AS text FROM places),
recurring AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY text) > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, {window})) AS i FROM recurring),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
