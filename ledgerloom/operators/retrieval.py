"""Search by keywords and by exact vector similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def keyword_search(docs: DataFrame, query: str, top: int = 3, min_score: int = 2, name: str = "doc_id") -> DataFrame:
    """The documents with most occurrences of the query's terms; ties go to the smaller name.

    The score is one codegen'd expression over the scan, and only the best few are sorted.
    """
    words = tx.terms(query)
    rows = docs.select(name, "text", (tx.term_score("text", words) if words else F.lit(0).cast("long")).alias("score"))
    # Texts are cut to their snippets before they are ranked, so no whole text travels.
    rows = rows.where(F.col("score") >= max(min_score, 1)).select(name, "score", (tx.snippet("text", words) if words else F.lit("")).alias("snippet"))
    return rows.orderBy(F.desc("score"), name).limit(top)


def context_block(hits: DataFrame, title: str = "doc_id") -> DataFrame:
    """One text that cites the hits, best first; empty without any."""
    line = F.concat(F.lit("- 来源："), F.col(title).cast("string"), F.lit("\n  "), F.col("snippet"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(title), line.alias("l"))))
    texts = F.transform(rows, lambda r: r.l)
    head = F.lit("【知识库参考】（仅作参考、以官方现行规定为准；引用请标注来源）")
    return hits.agg(F.when(F.count("*") == 0, "").otherwise(F.concat_ws("\n", head, F.array_join(texts, "\n"))).alias("context"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / F.when(norms == 0, 1.0).otherwise(norms))


def vector_search(vectors: DataFrame, query: list[float], top: int = 20, unit: bool = True) -> DataFrame:
    """The nearest rows of (vec_id, embedding): each task keeps its best ``top``, no full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = dot("embedding", q) if unit else cosine("embedding", q)
    return vectors.select("vec_id", F.round(sim, 4).alias("score"), sim.alias("raw")).orderBy(F.desc("score"), "vec_id").limit(top).drop("raw")


#: How soon more occurrences of a word stop to count, and how much a text's length does.
K1, B = 1.2, 0.75


def corpus_facts(docs: DataFrame, words: list[str]) -> DataFrame:
    """One row: the number of documents with a text, their mean length in words, and ``df``, how many have each of ``words``."""
    own = _tokens("text")
    have = [F.count_if(F.array_contains("w", w)) for w in words]
    rows = docs.where("text IS NOT NULL").select(own.alias("w"))
    return rows.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"), (F.array(*have) if have else F.array().cast("array<bigint>")).alias("df"))


def _tokens(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bm25(text: Column | str, words: list[str], facts: Column) -> Column:
    """How well a text fits words, by how often it has each of them, its length, and how seldom they are in the corpus."""
    own = _tokens(text)
    out = F.lit(0.0)
    for k, word in enumerate(words):
        tf = F.size(F.filter(own, lambda w: w == word)).cast("double")  # noqa: B023
        df = F.get(facts["df"], F.lit(k)).cast("double")
        rarity = F.log(1 + (facts["n"] - df + 0.5) / (df + 0.5))
        out = out + rarity * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(own) / facts["mean"]))
    return out


def two_stage(vectors: DataFrame, docs: DataFrame, query: list[float], words: list[str], recall: int = 20, top: int = 3) -> DataFrame:
    """Recall by vector, then order by ``bm25`` of the words; the vector settles ties.

    ``vectors`` and ``docs`` share an id. At most ``recall`` rows reach the second stage; what it knows of
    the corpus is one row, counted in one pass.
    """
    found = vector_search(vectors, query, recall).select(F.col("vec_id").alias("doc_id"), F.col("score").alias("similarity"))
    words = [w.lower() for w in words]
    both = found.join(docs.select("doc_id", "text"), "doc_id").crossJoin(F.broadcast(corpus_facts(docs, words).select(F.struct("*").alias("facts"))))  # one row
    score = F.round(F.coalesce(bm25("text", words, F.col("facts")), F.lit(0.0)), 6)
    return both.select("doc_id", "similarity", score.alias("rank_score")).orderBy(F.desc("rank_score"), F.desc("similarity"), "doc_id").limit(top)


def routed_search(vectors: DataFrame, query: list[float], language: Column, english_query: bool, has_reranker: bool, top: int = 20) -> DataFrame:
    """Only English rows for a query without Chinese, unless a reranker can compare both; all others else."""
    if english_query and not has_reranker:
        vectors = vectors.where(language == "en")
    elif not english_query:
        vectors = vectors.where(language == "zh")
    return vector_search(vectors, query, top)


def search_or_keyword(vectors: DataFrame | None, docs: DataFrame, query: str, query_vector: list[float] | None, top: int = 3) -> DataFrame:
    """Vectors where there are any, keywords else."""
    if vectors is None or query_vector is None:
        return keyword_search(docs, query, top).select(F.col("doc_id").alias("id"), F.col("score").cast("double").alias("score"))
    return vector_search(vectors, query_vector, top).select(F.col("vec_id").alias("id"), "score")


#: What goes before a query, not before a passage, when it is embedded.
QUERY_PREFIX = "为这个句子生成表示以用于检索相关文章："
QUERY_PREFIX_EN = "Represent this sentence for searching relevant passages:"


def has_chinese(text: Column | str) -> Column:
    return F.coalesce(F.rlike(text, F.lit("[一-鿿]")), F.lit(False))


def query_text(query: Column | str) -> Column:
    """A query as it is embedded: behind the instruction in its language."""
    return F.concat(F.when(has_chinese(query), QUERY_PREFIX).otherwise(QUERY_PREFIX_EN), query)


def mean_pooled(tokens: Column | str, mask: Column | str) -> Column:
    """The mean of the token vectors that the mask keeps, at unit length; zeros if it keeps none."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("v"), (F.col(mask) if isinstance(mask, str) else mask).alias("m")), lambda x: x.m > 0), lambda x: x.v)
    size = F.size(F.get(tokens, F.lit(0)))
    zeros = F.transform(F.sequence(F.lit(1), size), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zeros, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    mean = F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-9)))
    norm = F.greatest(F.sqrt(dot(mean, mean)), F.lit(1e-9))
    return F.transform(mean, lambda x: x / norm)


#: Models by name, in each Python worker.
_MODELS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def _model(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[list[str]], np.ndarray]:
    """The model of that name, which the first call in a worker loads."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def embed(rows: DataFrame, name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", at_once: int = 64) -> DataFrame:
    """``rows`` with ``embedding``: what a model makes of their texts, at unit length; null for null texts.

    ``load`` gives a function from texts to a matrix with a row for each. A Python worker calls it once
    for each ``name`` and keeps the model for all its tasks. Texts go to it ``at_once`` at a time, in
    order of length within a batch, so that a model which pads them pads little.
    """
    rows = rows.drop("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = _model(name, load)
            texts = batch.column(text).to_pylist()
            order = sorted((k for k, t in enumerate(texts) if t is not None), key=lambda k: len(texts[k]))
            vectors: list = [None] * len(texts)
            for at in range(0, len(order), at_once):
                some = order[at : at + at_once]
                made = np.asarray(model([texts[k] for k in some]), np.float32)
                made = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
                for k, vector in zip(some, made):
                    vectors[k] = vector
            column = pa.array(vectors, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "embedding"])

    return rows.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in rows.dtypes], "embedding array<float>"]))


def pooled(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, n, mean) of rows of vectors: the mean of each group's vectors, at unit length; zeros stay zeros.

    Each batch of a task is summed before anything is moved, so a group is a few sums for each task,
    however many vectors it has. Null vectors are left out; vectors of a group are equally long.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector)
            parts: dict = {}
            for k, (key, there) in enumerate(zip(batch.column(group).to_pylist(), column.is_valid().to_pylist())):
                if there:
                    own = column[k].values.to_numpy(zero_copy_only=False).astype(np.float64)
                    total, n = parts.get(key, (0.0, 0))
                    parts[key] = (total + own, n + 1)
            cols = [pa.array(parts, batch.column(group).type), pa.array([n for _, n in parts.values()], pa.int64()), pa.array([t for t, _ in parts.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[group, "n", "total"])

    parts = vectors.select(group, vector).mapInArrow(sums, f"`{group}` {dict(vectors.dtypes)[group]}, n long, total array<double>")
    places = parts.select(group, "n", F.posexplode("total").alias("pos", "x")).groupBy(group, "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = places.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("x") / F.col("n")).alias("m")))), lambda p: p.m).alias("mean"))
    norm = F.sqrt(dot("mean", "mean"))
    return whole.select(group, "n", F.transform("mean", lambda x: x / F.greatest(norm, F.lit(1e-9))).alias("mean"))


def cli_search(docs: DataFrame, query: str, top: int = 5, name: str = "doc_id") -> DataFrame:
    """(name, score) of the best documents with any term; of equals the greater name comes first."""
    words = tx.terms(query)
    rows = docs.select(name, (tx.term_score("text", words) if words else F.lit(0).cast("long")).alias("score"))
    return rows.where("score > 0").orderBy(F.desc("score"), F.desc(name)).limit(top)


def compared(vectors: DataFrame, docs: DataFrame, query: str, query_vector: list[float], top: int = 5) -> DataFrame:
    """(way, place, id, score): what vectors and what keywords find for one query, side by side."""
    by_vector = vector_search(vectors, query_vector, top).select(F.lit("semantic").alias("way"), F.col("vec_id").alias("id"), F.col("score").cast("double").alias("score"))
    by_word = keyword_search(docs, query, top).select(F.lit("keyword").alias("way"), F.col("doc_id").alias("id"), F.col("score").cast("double").alias("score"))
    order = W.partitionBy("way").orderBy(F.desc("score"), "id")  # at most ``top`` rows a way
    return by_vector.union(by_word).select("way", F.row_number().over(order).alias("place"), "id", "score")
