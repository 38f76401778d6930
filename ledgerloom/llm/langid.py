"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier over hashed byte n-grams predicts each bit.
Decoding sums, for each language, the logistic loss of the bits against its codeword, weighted by
how well each bit did in training, and takes the least. Two languages that come out close flag
the document as ambiguous.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import without

BUCKETS = 4096
#: The classifiers are fitted on about this many labelled documents, shared evenly by the languages.
SAMPLE = 4000
#: So many documents of each language are taken at least, where there are as many.
LEAST = 8
#: A table with more labels than this is refused; labels are then hardly languages.
MAX_LANGUAGES = 1000
AMBIGUOUS_MARGIN = 0.02
FOLDS, HELD_OUT = 4, 2


def fold(folds: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


_LETTERS = np.full(256, 32, np.uint32)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[128:] = np.arange(128, 256)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1-, 2- and 3-grams of the bytes of the lower-cased text."""
    b = _LETTERS[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]  # runs of non-letters are one gap
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(257) + b[2:]
    mixed = np.concatenate((b, two + np.uint32(1 << 20), three + np.uint32(1 << 25))) * np.uint32(2654435761)
    counts = np.bincount(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return np.sqrt(counts / len(mixed)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # (buckets + 1) x bits
    trust: np.ndarray  # of each bit, summing to 1


def codewords(n: int) -> np.ndarray:
    """n x bits of -1 and 1: all ways to part up to 7 languages, else random columns, spread out."""
    if n <= 7:
        cols = [[(k >> i & 1) * 2 - 1 for i in range(n)] for k in range(1, 2 ** max(n - 1, 0))]
        return np.array(cols, np.float32).T.reshape(n, -1)
    rng, bits, best = np.random.default_rng(7), 10 * int(np.ceil(np.log2(n))), (-1, None)
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > best[0] and (np.abs(code.sum(0)) < n).all():
            best = (apart.min(), code)
    return best[1]


def _matrix(labels: list[str], packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The vectors, each with a constant behind it; the places of their languages in the list that comes last.

    They are ordered, so that the model is the same whatever the order of arrival. There is one copy in
    single precision; beside it only the vectors of one language are unpacked at a time.
    """
    of: dict[str, list[bytes]] = {}
    for name, vector in zip(labels, packed):
        of.setdefault(name, []).append(vector)
    x, at = np.empty((len(labels), BUCKETS + 1), np.float32), 0
    x[:, BUCKETS] = 0.1
    for name in sorted(of):
        for vector in sorted(map(zlib.decompress, of[name])):
            x[at, :BUCKETS] = np.frombuffer(vector, np.float16)
            at += 1
    return x, np.repeat(np.arange(len(of)), [len(of[name]) for name in sorted(of)]), sorted(of)


def _train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 200, rate: float = 40.0, decay: float = 1e-5) -> Model:
    """Logistic regression for each bit. The last column of ``x`` is constant."""
    code = codewords(len(languages))
    target = code[y]
    counts = np.bincount(y, minlength=len(languages))
    row = (1 / counts[y] / len(languages)).astype(np.float32)[:, None]  # languages count alike
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    speed = np.zeros_like(w)
    for _ in range(steps):
        pull = row * target / (1 + np.exp(np.clip(target * (x @ w), -30, 30)))
        speed = 0.9 * speed + (x.T @ pull - decay * w)
        w += rate / 10 * speed
    right = ((x @ w) * target > 0).mean(0)
    trust = np.maximum(right - 0.5, 1e-3)
    return Model(languages, code, w, (trust / trust.sum()).astype(np.float32))


def fit(docs: DataFrame, held_out: Column | None = None, sample: int = SAMPLE) -> Model | None:
    """Learn from ``text`` and non-null ``lang``, except where ``held_out``; None if there is nothing to learn from.

    Labels are counted over all documents with a letter; a pair of id and text counts once. The
    MAX_LANGUAGES most frequent are learned, ties by name.
    Features are taken from whole texts inside the tasks and packed. The driver receives those of at most
    ``sample`` documents, or LEAST of each language if that is more, chosen by a hash of id and text.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if held_out is not None:
        known = known.where(~held_out)
    known = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("rank"))
    per = known.select("lang", "rank").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    counts = sorted((r["lang"], r["n"]) for r in per.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect())
    if not counts:
        return None
    most = max(LEAST, sample // len(counts))
    # A few more than needed are drawn by the hash, so that the exact limit is taken over few rows.
    share = F.lit(0.0)
    for name, n in counts:
        share = F.when(F.col("lang") == name, min(1.0, (2 * most + 40) / n)).otherwise(share)
    drawn = known.where(F.pmod("rank", F.lit(1 << 40)) < share * (1 << 40)).groupBy("lang", "rank").agg(F.first("text").alias("text"))
    chosen = drawn.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("rank"))).where(F.col("k") <= most)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(g, features(t)) for g, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in rows], pa.string()), pa.array([zlib.compress(v.astype(np.float16).tobytes(), 1) for _, v in rows], pa.binary())], names=["lang", "x"]
            )

    got = chosen.select("lang", "text").mapInArrow(vectors, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    return _train(*_matrix(got["lang"].to_pylist(), got["x"].to_pylist()))


def decide(model: Model | None, text: str | None) -> tuple[str, float, bool]:
    """Language, score from 0 to 1, and whether a second language is close."""
    if model is None or not has_letter(text):
        return "und", 0.0, False
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False
    x = features(text)
    f = x @ model.weights[:-1] + 0.1 * model.weights[-1]
    loss = (np.logaddexp(0, -model.code * f) * model.trust).sum(1)
    p = np.exp(-(loss - loss.min()) * model.code.shape[1])
    p /= p.sum()
    order = np.argsort(-p, kind="stable")
    return model.languages[order[0]], float(min(1.0, p[order[0]])), bool(p[order[0]] - p[order[1]] < AMBIGUOUS_MARGIN)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred``, ``score`` and ``ambiguous``.

    ``und`` is predicted for null texts and for those without a letter. Only ``text`` is looked at.
    Other columns pass through, but for those with the names of the answers; repeated rows get equal
    answers; an empty table stays empty.
    """
    docs = without(docs, "lang_pred", "score", "ambiguous")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decide(model, t) for t in batch.column("text").to_pylist()]
            keep = [n for n in batch.schema.names if n != "text"]
            more = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *more], names=[*keep, "lang_pred", "score", "ambiguous"])

    rest = [f"`{n}` {t}" for n, t in docs.dtypes if n != "text"]
    return docs.mapInArrow(run, ", ".join([*rest, "lang_pred string", "score double", "ambiguous boolean"]))


def reject_unknown(docs: DataFrame) -> DataFrame:
    """``docs`` without those of no language or of two that cannot be told apart. All columns stay.

    The stage learns from the non-null ``lang`` of its own input.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    judged = identify(whole, fit(docs))
    return judged.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select("row.*")
