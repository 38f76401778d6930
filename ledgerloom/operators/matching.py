"""Passages in documents and words in words, by rolling hashes: no text is copied for its parts.

A stretch of length n is known by its first and its last 2**j elements, where 2**j is the largest power
of two up to n: two stretches that agree in both are equal. So a text needs hashes of few lengths,
each taken for all its places at once, and hashes of 128 bits stand for the stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Words of documents that are held against passages at once, about.
AT_ONCE = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class Sequence:
    """Elements by their hashes; hashes of any stretch of them in constant time."""

    def __init__(self, elements: np.ndarray):
        n = len(elements)
        self.sums, self.inverse = [], []
        for base in _ODD:
            power, back = np.full(n + 1, np.uint64(base)), np.full(n + 1, np.uint64(pow(base, -1, 1 << 64)))
            power[0] = back[0] = 1
            power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
            own = _mixed(elements ^ np.uint64(base))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power[:n], dtype=np.uint64)]))
            self.inverse.append(back)

    def hash(self, at: np.ndarray, length: np.ndarray | int, which: int) -> np.ndarray:
        """One of the two signed hashes of 64 bits for each stretch."""
        sums, back = self.sums[which], self.inverse[which]
        return _mixed((sums[at + length] - sums[at]) * back[at]).view(np.int64)

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        return self.hash(at, length, 0), self.hash(at, length, 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def word_sequence(words: list[bytes]) -> Sequence:
    return Sequence(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))


def letter_sequence(word: str) -> Sequence:
    return Sequence(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))


def half(n: int) -> int:
    """The largest power of two up to n."""
    return 1 << (n.bit_length() - 1)


_ENDS = ["n", "h1", "h2", "t1", "t2"]
_ENDS_SCHEMA = ", ".join(f"{c} long" for c in _ENDS)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a passage is known by; those without a word are left out."""
    for batch in batches:
        rows, keep = [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            words = words_of(text)
            if words:
                n, sequence = len(words), word_sequence(words)
                first, last = sequence.hashes(np.zeros(1, np.int64), half(n)), sequence.hashes(np.array([n - half(n)]), half(n))
                rows.append((n, *(int(x[0]) for x in (*first, *last))))
                keep.append(k)
        cols = list(zip(*rows)) or [()] * 5
        ids = batch.column("item_id").take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in cols]], names=["item_id", *_ENDS])


def _in_place(table: dict[str, np.ndarray]):
    """Which of the known passages are in a document, where the document lies."""
    sizes = np.array([half(int(n)) for n in table["n"]], np.int64)
    kind = np.dtype([(c, np.int64) for c in ["h1", "h2", "n"]])
    whole = np.dtype([(c, np.int64) for c in ["h1", "h2", "n", "t1", "t2"]])
    levels = []
    for size in np.unique(sizes).tolist():
        own = {c: x[sizes == size] for c, x in table.items()}
        heads, ends = np.empty(len(own["n"]), kind), np.empty(len(own["n"]), whole)
        for c in ends.dtype.names:
            ends[c] = own[c]
        for c in heads.dtype.names:
            heads[c] = own[c]
        heads = np.unique(heads)  # by beginning, then length: many passages with one beginning count once for each length
        levels.append((size, heads, np.unique(ends)))

    def found(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, passage), once each, of texts side by side."""
        ends = np.cumsum([len(words) for words in texts])
        sequence = word_sequence([w for words in texts for w in words])
        n = int(ends[-1])
        end = np.repeat(ends, np.diff(ends, prepend=0))
        docs, out = [np.empty(0, np.int64)], [np.empty(0, whole)]
        for size, heads, known in levels:
            at = np.arange(n - size + 1)
            h1 = sequence.hash(at, size, 0)
            near = np.flatnonzero(heads["h1"][np.minimum(np.searchsorted(heads["h1"], h1), len(heads) - 1)] == h1)
            near = near[near + size <= end[near]]
            h1, h2 = h1[near], sequence.hash(near, size, 1)
            low, high = np.searchsorted(heads["h1"], h1, "left"), np.searchsorted(heads["h1"], h1, "right")
            for k in range(int((high - low).max(initial=0))):  # one length after another
                some = low + k < high
                head, place = heads[low[some] + k], near[some]
                fits = (head["h2"] == h2[some]) & (place + head["n"] <= end[place])
                place, head = place[fits], head[fits]
                hit = np.empty(len(place), whole)
                hit["h1"], hit["h2"], hit["n"] = head["h1"], head["h2"], head["n"]
                hit["t1"], hit["t2"] = sequence.hashes(place + head["n"] - size, size)
                right = np.isin(hit, known)
                docs.append(np.searchsorted(ends, place[right], "right"))
                out.append(hit[right])
        doc, hits = np.concatenate(docs), np.concatenate(out)
        pairs = np.empty(len(doc), [("doc", np.int64), ("hit", whole)])
        pairs["doc"], pairs["hit"] = doc, hits
        pairs = np.unique(pairs)
        return pairs["doc"], pairs["hit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, texts, since = batch.column("doc_id"), 0, [], 0
            for k, text in enumerate(batch.column("text")):
                texts.append(words_of(text.as_py()))
                held += len(texts[-1])
                if held >= AT_ONCE or k + 1 == batch.num_rows:
                    if held and levels:
                        doc, hits = found(texts)
                        own = ids.take(pa.array(doc + since, pa.int64()))
                        yield pa.RecordBatch.from_arrays([own, *[pa.array(np.ascontiguousarray(hits[c])) for c in _ENDS]], names=["doc_id", *_ENDS])
                    held, texts, since = 0, [], k + 1

    return run


def _places(sizes: list[int]):
    """(doc_id, h, at, size, h1, h2): every stretch of the given sizes; h is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (h, text) in enumerate(zip(batch.column("h").to_pylist(), batch.column("text"))):
                words = words_of(text.as_py())
                if not words:
                    continue
                sequence = word_sequence(words)
                for size in sizes:
                    for a in range(0, len(words) - size + 1, AT_ONCE):
                        at = np.arange(a, min(a + AT_ONCE, len(words) - size + 1))
                        n = len(at)
                        same = lambda x: pa.array(np.full(n, x, np.int64))  # noqa: B023, E731
                        ids = batch.column("doc_id").take(pa.array(np.full(n, k, np.int64)))
                        yield pa.RecordBatch.from_arrays([ids, same(h), pa.array(at), same(size), *map(pa.array, sequence.hashes(at, size))], names=["doc_id", "h", "at", "size", "h1", "h2"])

    return run


def contained(docs: DataFrame, passages: DataFrame, most: int) -> DataFrame:
    """(doc_id, item_id), once each: the words of ``passages(item_id, text)`` stand in ``docs(doc_id, text)`` one after another.

    Words are what white space parts, in lower case. Up to ``most`` different passages go to every
    task, 40 bytes for each however long it is, and documents are searched where they lie. More meet
    the documents by a shuffle of hashes and places. Either way time is linear in the words. Null
    and empty texts hold nothing, and empty passages are in no text.
    """
    lower = F.lower("text").alias("text")
    known = passages.select("item_id", lower).mapInArrow(_passages, f"item_id {dict(passages.dtypes)['item_id']}, {_ENDS_SCHEMA}")
    kind = dict(docs.dtypes)["doc_id"]
    few = known.select(*_ENDS).distinct().limit(most + 1).toArrow()  # numbers, ``most`` rows at most
    if few.num_rows <= most:
        table = {c: few.column(c).to_numpy() for c in _ENDS}
        hits = docs.select("doc_id", lower).mapInArrow(_in_place(table), f"doc_id {kind}, {_ENDS_SCHEMA}")
    else:
        size = F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long")
        exact = F.when(size * 2 <= F.col("n"), size * 2).when(size > F.col("n"), (size / 2).cast("long")).otherwise(size)
        wanted = known.select(*_ENDS).distinct().withColumn("size", exact)
        sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())  # powers of two
        places = docs.select("doc_id", F.xxhash64("text").alias("h"), lower).mapInArrow(_places(sizes), f"doc_id {kind}, h long, at long, size long, h1 long, h2 long")
        begun = places.join(wanted, ["size", "h1", "h2"]).withColumn("at", F.col("at") + F.col("n") - F.col("size"))
        begun = begun.select("doc_id", "h", "at", "size", "n", "h1", "h2", "t1", "t2")
        ends = places.select(F.col("doc_id").alias("d"), "h", "at", "size", F.col("h1").alias("t1"), F.col("h2").alias("t2")).distinct()
        hits = begun.join(ends, ["h", "at", "size", "t1", "t2"]).where(F.col("d").eqNullSafe(F.col("doc_id"))).select("doc_id", *_ENDS)
    return hits.join(known, _ENDS).select("doc_id", "item_id").distinct()


def parts_of_words(words: DataFrame, lengths: list[int]) -> DataFrame:
    """(n, h1, h2, best) of every part of ``words(word, best)`` that has one of the lengths; of equal parts the least ``best``.

    Hashes are taken for all places of a word at once, so a word of any length costs its length for each of ``lengths``.
    """
    kind = words.schema["best"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = batch.column("best")
            for k, word in enumerate(batch.column("word").to_pylist()):
                sequence = letter_sequence(word)
                for n in lengths:
                    if n > len(sequence.sums[0]) - 1:
                        break
                    found = np.unique(np.stack(sequence.hashes(np.arange(len(sequence.sums[0]) - n), n)), axis=1)
                    count = found.shape[1]
                    cols = [pa.array(np.full(count, n)), pa.array(found[0]), pa.array(found[1]), best.take(pa.array(np.full(count, k)))]
                    yield pa.RecordBatch.from_arrays(cols, names=["n", "h1", "h2", "best"])

    return words.mapInArrow(run, f"n long, h1 long, h2 long, best {kind}").groupBy("n", "h1", "h2").agg(F.min("best").alias("best"))


def whole_words(words: DataFrame) -> DataFrame:
    """(word, n, h1, h2) of ``words(word)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                sequence = letter_sequence(word)
                n = len(sequence.sums[0]) - 1
                rows.append((n, *(int(x[0]) for x in sequence.hashes(np.zeros(1, np.int64), n))))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("word"), *[pa.array(c, pa.int64()) for c in cols]], names=["word", "n", "h1", "h2"])

    return words.mapInArrow(run, "word string, n long, h1 long, h2 long")
