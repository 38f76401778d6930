"""A log-bilinear language model, trained by noise-contrastive estimation in numpy.

A token's probability has three parts. The first is that of its class: the end of a text, one of the
most frequent words, or the bucket of all other words with its ending. The vectors of the two classes
before, each through a matrix of its own, add up to a prediction whose product with each class's
vector is its score. The second part is that of the word within its bucket, by the vector of the
word before: words from LEAST_COUNT occurrences on, at most OWN_WORDS, have vectors of their own
there, and all others of the bucket share one. The third, for those, is a word's smoothed share,
for which the counts of all distinct words are used. Each part is normalised by products of whole
matrices, so the probabilities of all words add up to one.

All the model needs from the corpus are counts: of words, of classes with the two before, and of
words with the one before. Spark takes all three over every training document. With the second, at
most (classes + 1)**2 * classes rows however large the corpus is, the driver optimises the exact
expectation of the noise-contrastive objective. The third stays in Spark: each bucket is trained by
a task of its own against sampled noise.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, materialize, small, without
from .lexicon import frequent_words

FOLDS, HELD_OUT = 7, 2
TOP_WORDS, BUCKETS, DIMENSIONS, NOISE, STEPS = 79, 48, 24, 16, 200
#: Words with a vector within their bucket: from so many occurrences on, and at most so many, as every
#: task holds a table of their square.
LEAST_COUNT, OWN_WORDS = 20, 3000
#: Sizes of the model within a bucket; noise is drawn PAIR_DRAWS times; PRIOR holds the vectors of rare words back.
PAIR_DIMENSIONS, PAIR_NOISE, PAIR_STEPS, PAIR_DRAWS, PRIOR = 16, 8, 40, 8, 3.0
#: Words whose counts every task holds; rarer ones are looked up by a join. Bounds what is broadcast.
DICTIONARY = 1 << 17
COUNTER_WORDS = 200_000
#: Tokens whose pairs a task holds, and words whose buckets it keeps.
GATHER, CACHE_WORDS = 500_000, 150_000
#: Stands for the end of a text; no word is empty.
END = b""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER_ASCII).split()


def bucket_of(word: bytes, buckets: int = BUCKETS) -> int:
    return zlib.crc32(word[-2:]) % buckets


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts, ends included; counted within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            seen[END] += batch.num_rows
            for text in batch.column("text").to_pylist():
                seen.update(words_of(text))
                if len(seen) > COUNTER_WORDS:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


class Symbols:
    """Words to numbers, and numbers to classes.

    Number 0 is the end, then come the words with a vector, then what is left of each bucket. The end
    and the ``single`` first words are classes of their own; all others are in that of their bucket.
    """

    def __init__(self, own: list[bytes], single: int = TOP_WORDS, buckets: int = BUCKETS):
        self.number = {END: 0} | {w: i for i, w in enumerate(own, 1)}
        self.first, self.buckets = len(own) + 1, buckets
        self.words = self.first + buckets
        self.single = min(single, len(own)) + 1
        self.size = self.single + buckets
        in_bucket = [self.single + bucket_of(w, buckets) for w in own[self.single - 1 :]]
        self.class_of = np.array([*range(self.single), *in_bucket, *range(self.single, self.size)], np.int64)
        self.cache: dict[bytes, int] = {}

    def members(self, bucket: int) -> np.ndarray:
        return np.flatnonzero(self.class_of == self.single + bucket)

    def of(self, words: list[bytes]) -> np.ndarray:
        get, cache = self.number.get, self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        out = []
        for w in words:
            if (s := get(w)) is None and (s := cache.get(w)) is None:
                s = cache[w] = self.first + bucket_of(w, self.buckets)
            out.append(s)
        return np.array(out, np.int64)

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        """Each class with the two before it as one number; before the text stands class ``size``."""
        base, classes = self.size + 1, self.class_of[numbers]
        one = np.concatenate(([self.size], classes[:-1]))
        two = np.concatenate(([self.size], one[:-1]))
        return (two * base + one) * self.size + classes

    def pairs(self, numbers: np.ndarray) -> np.ndarray:
        """Each word with the one before it as one number; before the text stands word ``words``."""
        return np.concatenate(([self.words], numbers[:-1])) * self.words + numbers


def context_counts(docs: DataFrame, symbols: Symbols) -> DataFrame:
    """(bucket, code, n) over all texts, counted within tasks before the shuffle.

    Bucket -1 has the codes of classes; the others have the pairs whose second word is in them.
    """
    size = (symbols.size + 1) ** 2 * symbols.size

    def rows(bucket: np.ndarray, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(code), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[part].astype(np.int32)), pa.array(code[part]), pa.array(n[part])], names=["bucket", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, numbers = np.zeros(size, np.int64), 0, []

        def gathered() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Add the classes of what is held to the total; its pairs, each once, with their numbers.

            Pairs go on at once, as Spark adds equal ones up before its shuffle, so a task holds few.
            """
            total[:] += np.bincount(np.concatenate([symbols.codes(x) for x in numbers]), minlength=size)
            pairs, n = np.unique(np.concatenate([symbols.pairs(x)[symbols.class_of[x] >= symbols.single] for x in numbers]), return_counts=True)
            return symbols.class_of[pairs % symbols.words] - symbols.single, pairs, n

        for part in small(batches):
            for text in part.column("text").to_pylist():
                numbers.append(symbols.of([*words_of(text), END]))
                held += len(numbers[-1])
                if held > GATHER:
                    yield from rows(*gathered())
                    held, numbers = 0, []
        if numbers:
            yield from rows(*gathered())
        some = np.flatnonzero(total)
        yield from rows(np.full(len(some), -1), some, total[some])

    return docs.select("text").mapInArrow(run, "bucket int, code long, n long").groupBy("bucket", "code").agg(F.sum("n").alias("n"))


def train_pairs(counts: np.ndarray, seed: int, dims: int = PAIR_DIMENSIONS, noise: int = PAIR_NOISE, steps: int = PAIR_STEPS, rate: float = 0.1, prior: float = PRIOR) -> np.ndarray:
    """Normalised log10 probabilities of a bucket's words (columns) after each word (rows).

    Noise is drawn anew every few steps: for each word before, ``noise`` times as many words as were
    seen after it, by their shares. Words before that were never seen get the shares themselves.
    """
    rng = np.random.default_rng(seed)
    m = counts.shape[1]
    rows = np.flatnonzero(counts.sum(1))
    n = counts[rows].astype(np.float32)
    share = (n.sum(0) + 1) / (n.sum() + m)
    expected = (noise * n.sum(1, keepdims=True) * share).astype(np.float32)
    base = np.log(noise * share).astype(np.float32)
    p = {"R": np.zeros((len(rows), dims)), "Q": rng.normal(0, 0.3, (m, dims)), "b": np.log(share)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        if (step - 1) % max(1, steps // PAIR_DRAWS) == 0:
            drawn = rng.poisson(expected).astype(np.float32)
        real = 1 / (1 + np.exp(np.clip(base - p["R"] @ p["Q"].T - p["b"], -60, 60)))  # that it is data, not noise
        pull = n * (1 - real) - drawn * real
        grads = {"R": pull @ p["Q"] - prior * p["R"], "Q": pull.T @ p["R"] - prior * p["Q"], "b": pull.sum(0)}
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            p[k] += rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    score = np.broadcast_to(np.log(share), counts.shape).astype(np.float32)
    score[rows] = p["R"] @ p["Q"].T + p["b"]
    score -= score.max(1, keepdims=True)
    return ((score - np.log(np.exp(score).sum(1, keepdims=True))) / np.log(10)).astype(np.float32)


def pair_tables(counted: DataFrame, symbols: Symbols) -> np.ndarray:
    """(words + 1) x words log10 probabilities of each word within its bucket, 0 for classes of their own.

    One task trains one bucket, out of at most (words + 1) * members rows; the driver receives the
    tables, which are as large whatever the corpus is.
    """
    rows = symbols.words + 1

    def fit_bucket(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        members = symbols.members(bucket)
        code = table.column("code").to_numpy()
        counts = np.zeros((rows, len(members)), np.int64)
        counts[code // symbols.words, np.searchsorted(members, code % symbols.words)] = table.column("n").to_numpy()
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "logs": pa.array([train_pairs(counts, bucket).tobytes()], pa.binary())})

    out = np.zeros((rows, symbols.words), np.float32)
    for b in range(symbols.buckets):  # where nothing was seen, all are alike
        out[:, symbols.members(b)] = -np.log10(len(symbols.members(b)))
    found = counted.where("bucket >= 0").groupBy("bucket").applyInArrow(fit_bucket, "bucket int, logs binary").toArrow()
    for bucket, logs in zip(found["bucket"].to_pylist(), found["logs"].to_pylist()):
        members = symbols.members(bucket)
        out[:, members] = np.frombuffer(logs, np.float32).reshape(rows, len(members))
    return out


def train(counts: np.ndarray, dims: int = DIMENSIONS, noise: int = NOISE, steps: int = STEPS, rate: float = 0.05) -> np.ndarray:
    """Normalised log10 probabilities, by the two symbols before and the symbol.

    ``counts`` is (symbols + 1) x (symbols + 1) x symbols. Noise is drawn from the smoothed shares
    of the symbols, ``noise`` times as often as data; both expectations are exact sums.
    """
    s = counts.shape[2]
    n = counts.reshape(-1, s).astype(np.float32)
    total = max(1.0, float(n.sum()))
    n /= total
    seen = n.sum(1, keepdims=True)
    share = (n.sum(0) * total + 1) / (total + s)
    base = np.log(noise * share).astype(np.float32)
    rng = np.random.default_rng(1)
    p = {
        "R": rng.normal(0, 0.1, (s + 1, dims)),
        "A": np.eye(dims) + rng.normal(0, 0.05, (dims, dims)),
        "B": np.eye(dims) / 2 + rng.normal(0, 0.05, (dims, dims)),
        "Q": rng.normal(0, 0.1, (s, dims)),
        "b": np.log(share),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def predicted() -> np.ndarray:
        return ((p["R"] @ p["B"])[:, None, :] + (p["R"] @ p["A"])[None, :, :]).reshape(-1, dims)

    for step in range(1, steps + 1):
        r = predicted()
        real = 1 / (1 + np.exp(np.clip(base - r @ p["Q"].T - p["b"], -60, 60)))  # that it is data, not noise
        pull = n * (1 - real) - seen * (noise * share).astype(np.float32) * real
        back = (pull @ p["Q"]).reshape(s + 1, s + 1, dims)
        two, one = back.sum(1), back.sum(0)
        grads = {
            "Q": pull.T @ r,
            "b": pull.sum(0),
            "R": two @ p["B"].T + one @ p["A"].T,
            "A": p["R"].T @ one,
            "B": p["R"].T @ two,
        }
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            p[k] += rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    score = predicted() @ p["Q"].T + p["b"]
    score -= score.max(1, keepdims=True)
    return ((score - np.log(np.exp(score).sum(1, keepdims=True))) / np.log(10)).astype(np.float32).reshape(counts.shape)


@dataclass
class Model:
    symbols: Symbols
    table: np.ndarray  # log10 probabilities of classes by code
    pairs: np.ndarray  # log10 probabilities of words within their buckets, by the word before
    within: np.ndarray  # log10 of the denominator of what is left of a bucket, by number; 0 for words with a vector
    counts: DataFrame  # (word, n), all distinct training words
    dictionary: dict[bytes, int]  # the counts of the most frequent
    tokens: int
    distinct: int
    ends: int  # training documents


def fit(docs: DataFrame) -> Model:
    """Learn from all of ``docs``. An empty table gives equal probabilities."""
    counts = materialize(word_counts(docs), "words")
    at_end = F.when(F.octet_length("word") == 0, F.col("n")).otherwise(0)
    tokens, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(at_end), F.lit(0))).first()
    frequent = frequent_words(counts.where(F.octet_length("word") > 0), DICTIONARY).select("word", "n").toArrow()
    top = sorted(zip(frequent["word"].to_pylist(), frequent["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
    symbols = Symbols([w for k, (w, n) in enumerate(top[:OWN_WORDS]) if k < TOP_WORDS or n >= LEAST_COUNT])
    bucket = F.crc32(F.substring("word", -2, 2)) % BUCKETS
    own = docs.sparkSession.createDataFrame([(bytearray(w),) for w in symbols.number], "word binary")  # at most OWN_WORDS + 1
    sums = counts.join(F.broadcast(own), "word", "left_anti").groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    within = np.zeros(symbols.words)
    for r in sums:
        within[symbols.first + r["b"]] = np.log10(r["n"] + r["v"] + 1)
    size = symbols.size
    counted = materialize(context_counts(docs, symbols), "contexts")
    grid = np.zeros((size + 1) ** 2 * size, np.int64)
    found = counted.where("bucket < 0").select("code", "n").toArrow()  # columns of numbers, no object for each row
    grid[found["code"].to_numpy()] = found["n"].to_numpy()
    table = train(grid.reshape(size + 1, size + 1, size)).reshape(-1)
    return Model(symbols, table, pair_tables(counted, symbols), within, counts, dict(top), int(tokens), int(distinct), int(ends))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text``, with n_tokens, n_known, base_score and score.

    Scores are log10 probabilities of whole texts with their end; null counts as empty. Counts of
    words in the dictionary are at hand; all others are joined, one row for each distinct word of
    a text. Other columns pass through, but for those with the names of the results; repeated
    rows get equal scores.
    """
    docs = without(docs, "n_tokens", "n_known", "base_score", "score")
    rest = [(n, t) for n, t in docs.dtypes if n != "text"]
    symbols, within = model.symbols, model.within
    logs = docs.sparkSession.sparkContext.broadcast({w: float(np.log10(n + 1)) for w, n in model.dictionary.items()})
    tables = docs.sparkSession.sparkContext.broadcast((model.table, model.pairs.reshape(-1)))
    ends = float(np.log10(model.ends + 1))
    total, first = float(np.log10(model.tokens + model.distinct + 1)), symbols.first
    know_end = int(model.ends > 0)

    def one(text: str | None) -> tuple:
        words = words_of(text)
        s = symbols.of([*words, END])
        classes, pairs = tables.value
        lm = float(classes[symbols.codes(s)].sum(dtype=np.float64) + pairs[symbols.pairs(s)].sum(dtype=np.float64) - within[s].sum())
        get, known, base, inside, rare = logs.value.get, know_end, ends, 0.0, Counter()
        for w, k in zip(words, s.tolist()):
            if (x := get(w)) is None:
                rare[w] += 1
            else:
                known += 1
                base += x
                if k >= first:
                    inside += x
        return len(s), known, base - len(s) * total, lm + inside, [{"word": w, "tf": n} for w, n in rare.items()]

    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [one(t) for t in part.column("text").to_pylist()]
                more = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n, _ in rest], *more], names=[*[n for n, _ in rest], "n_tokens", "__known", "__base", "__lm", "__rare"]
                )

    schema = ", ".join([*[f"`{n}` {t}" for n, t in rest], "n_tokens long, __known long, __base double, __lm double, __rare array<struct<word: binary, tf: int>>"])
    # Written with a number for each row, so that the number stays the same for both uses below.
    rows = materialize(docs.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("__row", F.inline("__rare"))
    per_row = (
        rare.join(model.counts, "word")
        .groupBy("__row")
        .agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("__sum"), F.sum("tf").alias("__more"))
    )
    add = F.coalesce("__sum", F.lit(0.0))
    return rows.drop("__rare").join(per_row, "__row", "left").select(
        *[n for n, _ in rest],
        "n_tokens",
        (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"),
        (F.col("__base") + add).alias("base_score"),
        (F.col("__lm") + add).alias("score"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is left out of training: by the crc32 of its id, null as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
