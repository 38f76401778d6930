"""Line deduplication by a tree of log templates.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, where
a token with a digit counts as a variable field. Lines that end in the same leaf and agree in
most places share a template; places in which they differ are variable fields too. Templates
that recur in several documents are dropped, but for their first occurrence, so that one copy of
every text stays.

The tree is never built in one place. A leaf is a hash; leaves, lines and templates are counted
by grouping, with sums before the shuffle, and only one line of each distinct kind is looked at
token by token. The template of a leaf has in each place the token found in most documents; the
lines near it go, and the leaf votes anew until a template has no line near it, ROUNDS times at most.
The lines left by then are compared with each other where they agree in a block of tokens, and
those linked share a template; so a leaf of very many families takes no more rounds than others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, with_text, without
from .components import stars
from .similar import met, unlinked

DEPTH = 3
#: Shorter lines are left alone; only lines from GENERAL_TOKENS on are generalised beyond digits.
MIN_TOKENS, GENERAL_TOKENS = 4, 8
MIN_DOCS = 2
SIMILARITY = 0.8
#: Votes of a leaf; families that are left are found by comparison.
ROUNDS = 4
#: Kinds of lines in a cell that are compared pair by pair; larger cells are split once more.
CROWD = 64
#: Kinds of lines of a leaf whose votes are counted together before they are summed by token.
BALLOT = 256
#: Numbers of cells that are made at once.
_CELLS = 1 << 18
_GOLD, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_DIGIT = re.compile(rb"[0-9]")


def masked(line: bytes) -> list[bytes]:
    """Tokens of a line; those with a digit become a field."""
    tokens = line.split()
    return [b"<*>" if not t.isalpha() and _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def _signed(data: bytes) -> int:
    h = xxhash.xxh64_intdigest(data)
    return h - (h >> 63 << 64)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line_no, n, leaf, line) of every line of MIN_TOKENS or more; h is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nos, sizes, leaves, own = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                before = len(nos)
                for k, line in enumerate((text or "").encode().split(b"\n")):
                    tokens = masked(line)
                    if len(tokens) >= MIN_TOKENS:
                        nos.append(k)
                        sizes.append(len(tokens))
                        leaves.append(xxhash.xxh64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:DEPTH])))
                        own.append(xxhash.xxh64_intdigest(b" ".join(tokens)))
                counts.append(len(nos) - before)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            cols = [batch.column(c).cast(pa.int64()).take(rows) for c in ("doc_id", "h")]
            cols += [pa.array(np.array(x, np.int32)) for x in (nos, sizes)]
            cols += [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (leaves, own)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "line_no", "n", "leaf", "line"])

    return docs.mapInArrow(run, "doc_id long, h long, line_no int, n int, leaf long, line long")


def _tokens(asked: DataFrame) -> DataFrame:
    """(leaf, line, n_docs, parts, tokens) of the lines that ``asked`` (text, wanted) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                lines = text.encode().split(b"\n")
                out += [(w["leaf"], w["line"], w["n_docs"], w["parts"], [t.decode() for t in masked(lines[w["line_no"]])]) for w in wanted]
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["leaf", "line", "n_docs", "parts", "tokens"])

    return asked.select("text", "wanted").mapInArrow(run, "leaf long, line long, n_docs long, parts long, tokens array<string>")


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The template of a leaf that has one part; of others the votes of each part, (pos, token, n)."""
    for batch in small(batches):
        groups, whole = batch.column("lines"), batch.column("parts").to_numpy() == 1
        kinds, group = groups.flatten(), np.repeat(np.arange(batch.num_rows), pc.list_value_length(groups).to_numpy())
        lines, tokens = kinds.field("line").to_numpy(), kinds.field("tokens")
        # Repeated rows of a document bring the same kind twice.
        once = np.zeros(len(lines), bool)
        once[np.unique(lines, return_index=True)[1]] = True
        sizes = pc.list_value_length(tokens).to_numpy()
        size = np.zeros(batch.num_rows, np.int64)
        size[group] = sizes
        # A place of a leaf is a slot; tokens are numbered in their order.
        base, start = np.cumsum(size) - size, np.cumsum(sizes) - sizes
        slot = np.repeat(base[group] - start, sizes) + np.arange(sizes.sum())
        words = tokens.flatten().dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        known = words.dictionary.take(pa.array(order))
        mine = np.repeat(once, sizes)
        key = slot[mine] * len(order) + rank[words.indices.to_numpy()[mine]]
        by = np.argsort(key)
        key, weights = key[by], np.repeat(kinds.field("n_docs").to_numpy(), sizes)[mine][by]
        at = _runs(key)
        slots, codes = np.divmod(key[at], len(order))
        n = np.add.reduceat(weights, at)
        ends = _runs(slots)
        most = n == np.repeat(np.maximum.reduceat(n, ends), np.diff(np.append(ends, len(n))))
        best = codes[np.maximum.reduceat(np.where(most, np.arange(len(n)), -1), ends)]
        templates = _lists(np.where(whole, size, 0), known.take(pa.array(best[np.repeat(whole, size)])))
        owner = np.repeat(np.arange(batch.num_rows), size)[slots]
        split = ~whole[owner]
        pos = pa.array((slots - base[owner])[split].astype(np.int32))
        votes = pa.StructArray.from_arrays([pos, known.take(pa.array(codes[split])), pa.array(n[split])], ["pos", "token", "n"])
        votes = _lists(np.bincount(owner[split], minlength=batch.num_rows), votes)
        yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("parts"), templates, votes], names=["leaf", "parts", "template", "votes"])


def _templates(rest: DataFrame) -> DataFrame:
    """(leaf, template) of ``rest(leaf, line, n_docs, parts, tokens)``: in each place the token of most documents, the greatest of several."""
    part = F.pmod(F.xxhash64("line"), "parts").alias("part")
    ballots = rest.groupBy("leaf", "parts", part).agg(F.collect_list(F.struct("line", "n_docs", "tokens")).alias("lines"))
    kinds = "leaf long, parts long, template array<string>, votes array<struct<pos:int,token:string,n:bigint>>"
    tallies = materialize(ballots.select("leaf", "parts", "lines").mapInArrow(_tally, kinds), "tallies")
    votes = tallies.where("parts > 1").select("leaf", F.inline("votes")).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n"))
    modes = votes.groupBy("leaf", "pos").agg(F.max_by("token", F.struct("n", "token")).alias("token"))
    placed = modes.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("template"))
    return tallies.where("parts = 1").select("leaf", "template").union(placed.select("leaf", F.col("template.token")))


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "line_no")


def _kinds(lines: DataFrame) -> DataFrame:
    """(leaf, line, n, n_docs, h, line_no, who) of every kind of line; the last three say where one such line is."""
    once = lines.groupBy("leaf", "line", "doc_id", "h").agg(F.min("line_no").alias("line_no"), F.min("n").alias("n"))
    # Numbers only, so that Spark sums in hash tables. Of copies of a text any will do, as the line has the same number in each.
    at = [F.min("h").alias("h"), F.min_by("line_no", "h").alias("line_no"), F.min_by(F.xxhash64("doc_id"), "h").alias("who")]
    return once.groupBy("leaf", "line").agg(F.min("n").alias("n"), F.count("*").alias("n_docs"), *at)


def _generalised(kinds: DataFrame, keyed: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """(leaf, line, template) of the lines that share a generalised template."""
    kinds = kinds.where(F.col("n") >= GENERAL_TOKENS)
    leaves = kinds.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("n_docs").alias("docs"))
    # Leaves and templates are written before they are joined, so that Spark can split a crowded leaf.
    parts = F.ceil(F.col("kinds") / BALLOT).alias("parts")
    open_leaves = materialize(leaves.where((F.col("kinds") > 1) & (F.col("docs") >= min_docs)).select("leaf", parts), "leaves")
    reps = kinds.join(open_leaves, "leaf").select("h", "who", F.struct("leaf", "line", "n_docs", "parts", "line_no").alias("w"))
    # The few rows asked for are hashed, so that no text is sorted.
    wanted = reps.groupBy("h", "who").agg(F.collect_list("w").alias("wanted")).hint("shuffle_hash")
    asked = keyed.select("h", F.xxhash64(F.col("doc_id").cast("long")).alias("who"), "text").join(wanted, ["h", "who"])
    rest = materialize(_tokens(asked), "tokens")
    placed, left = [], []
    for k in range(ROUNDS):
        same = F.size(F.filter(F.zip_with("tokens", "template", lambda t, m: t == m), lambda x: x))
        judged = materialize(rest.join(materialize(_templates(rest), "templates"), "leaf").withColumn("near", same >= similarity * F.size("tokens")).drop("template"), "judged")
        # A leaf goes on only if its vote has found something; each round has fewer lines than the one before.
        moved = materialize(judged.where("near").select("leaf").distinct(), "moved")
        placed.append(judged.where("near").select("leaf", "line", F.xxhash64("leaf", F.lit(k)).alias("template")))
        others = judged.where(~F.col("near")).drop("near")
        left.append(others.join(moved, "leaf", "left_anti"))
        rest = others.join(moved, "leaf", "left_semi")
        if moved.isEmpty():
            break
        rest = materialize(rest, "rest")
    left.append(rest)
    unplaced = materialize(reduce(DataFrame.union, left), "unplaced")
    alike = stars(_alike(unplaced, similarity))
    own = unplaced.join(alike, unplaced.line == alike.node).select("leaf", "line", F.xxhash64("leaf", "root", F.lit("alike")).alias("template"))
    return reduce(DataFrame.union, placed).union(own).distinct()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, stirred one to one."""
    x = (x ^ (x >> np.uint64(33))) * _MIX_A
    x = (x ^ (x >> np.uint64(33))) * _MIX_B
    return x ^ (x >> np.uint64(33))


def _blocks(leaf: int, tokens: list[str], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of a line, one for each block of nearly equal length, some empty if there are fewer tokens.

    And the edges of the blocks, and the sums of the tokens' hashes up to each token behind the leading ones.
    """
    behind = len(tokens) - DEPTH
    n = len(tokens) - math.ceil(similarity * len(tokens)) + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in tokens[DEPTH:]), np.uint64, behind)
    sums = np.zeros(behind + 1, np.uint64)
    np.cumsum(_mixed(hashes + np.arange(1, behind + 1, dtype=np.uint64) * _GOLD), out=sums[1:])
    edges = np.arange(n + 1) * behind // n
    where = _mixed(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + np.uint64(leaf & (1 << 64) - 1))
    return _mixed(where + sums[edges[1:]] - sums[edges[:-1]]), edges, sums


def _batch(fps: list[np.ndarray], cells: list[np.ndarray]) -> pa.RecordBatch:
    none = [np.empty(0, np.uint64)]
    both = np.concatenate(fps or [np.empty(0, np.int64)]), np.concatenate(cells or none).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["fp", "cell"])


def _coarse(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(fp, cell) for each block of a line."""
    for batch in batches:
        fps, cells = [], []
        for leaf, fp, tokens in zip(*(batch.column(c).to_pylist() for c in ("leaf", "fp", "tokens"))):
            cells.append(_blocks(leaf, tokens, similarity)[0])
            fps.append(np.full(len(cells[-1]), fp, np.int64))
        yield _batch(fps, cells)


def _fine(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(fp, cell) for each block of the other tokens of a line, within each of its ``cells``."""
    for batch in batches:
        fps, cells, made = [], [], 0
        for leaf, fp, tokens, crowded in zip(*(batch.column(c).to_pylist() for c in ("leaf", "fp", "tokens", "cells"))):
            own, edges, sums = _blocks(leaf, tokens, similarity)
            n, blocks = len(own), np.flatnonzero(np.isin(own, np.array(crowded, np.int64).view(np.uint64)))
            for at in range(0, len(blocks), step := max(1, _CELLS // n)):
                j = blocks[at : at + step, None]
                first, last = edges[j], edges[j + 1]
                cut = np.arange(n + 1) * (len(sums) - 1 - (last - first)) // n
                # Sums of the tokens without block j, up to each cut.
                upto = np.where(cut <= first, sums[cut], sums[np.minimum(cut + last - first, len(sums) - 1)] - (sums[last] - sums[first]))
                cell = _mixed(_mixed(own[j] + np.arange(1, n + 1, dtype=np.uint64) * _GOLD) + upto[:, 1:] - upto[:, :-1]).ravel()
                cells.append(cell)
                fps.append(np.full(len(cell), fp, np.int64))
                made += len(cell)
                if made >= _CELLS:
                    yield _batch(fps, cells)
                    fps, cells, made = [], [], 0
        yield _batch(fps, cells)


def _alike(rest: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the lines of a leaf that agree in enough places.

    Lines that differ in at most d places agree in one of d + 1 blocks of the tokens behind the
    leading ones, and meet in that block's cell. Within a crowded cell the other tokens are cut into
    d + 1 blocks again, by the same reasoning. Cells that even then are crowded hold lines that agree
    in two blocks and more; each is held against LEADS of them, and those that this leaves unlinked
    against each other, in tiles.
    """
    lines = rest.select("leaf", F.col("line").alias("fp"), "tokens")
    coarse = materialize(lines.mapInArrow(partial(_coarse, similarity=similarity), "fp long, cell long"), "coarse")
    pairs, many = met(coarse, CROWD, lead=False)
    again = lines.join(many.groupBy("fp").agg(F.collect_set("cell").alias("cells")), "fp")
    fine = materialize(again.mapInArrow(partial(_fine, similarity=similarity), "fp long, cell long"), "fine")
    near, crowded = met(fine, CROWD)
    pairs = materialize(pairs.union(near).distinct(), "alike")
    own = lambda x: rest.select(F.col("line").alias(x), F.col("tokens").alias(f"{x}_tokens"))
    same = F.size(F.filter(F.zip_with("a_tokens", "b_tokens", lambda t, m: t == m), lambda x: x))
    linked = lambda pairs: pairs.join(own("a"), "a").join(own("b"), "b").where(same >= similarity * F.size("a_tokens")).select("a", "b")
    if crowded.isEmpty():
        return linked(pairs)
    found = materialize(linked(pairs), "found")
    more = unlinked(crowded, found).join(pairs, ["a", "b"], "left_anti")
    return found.union(linked(materialize(more, "more")))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, dropped) with the numbers of the lines to drop; h is xxhash64 of the text."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    lines = materialize(_lines(keyed), "lines")
    kinds = materialize(_kinds(lines), "kinds")
    general = _generalised(kinds, keyed, min_docs, similarity)
    # A line of a template of its own that is in too few documents stays, so only others are looked at again.
    own = kinds.where(F.col("n_docs") >= min_docs).select("leaf", "line").join(general, ["leaf", "line"], "left_anti")
    placed = materialize(lines.join(general.union(own.withColumn("template", F.col("line"))), ["leaf", "line"]).select("doc_id", "h", "line_no", "template"), "placed")
    once = placed.groupBy("template", "doc_id", "h").agg(F.min("line_no").alias("line_no"))
    recurring = once.groupBy("template").agg(F.count("*").alias("n_docs"), F.min(_first()).alias("at")).where(F.col("n_docs") >= min_docs)
    # Written first, so that this join has exchanges of its own and Spark can split a very common template.
    again = placed.join(materialize(recurring.select("template", "at"), "recurring"), "template").where(_first() != F.col("at"))
    return again.groupBy("doc_id", "h").agg(F.collect_set("line_no").alias("dropped"))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with recurring lines gone from ``text``, and ``n_lines`` and ``n_dropped``.

    A document is a pair of id and text, so repeated rows count once and are treated alike. Of a
    recurring template the occurrence in the smallest doc_id stays (null ids come last; then the
    smaller hash of the text, then the earlier line). Null texts stay null, with 0 lines; lines
    under four tokens stay. Other columns pass through; the two counts take the place of columns
    with their names.
    """
    docs = without(docs, "n_lines", "n_dropped")
    names = docs.columns
    gone = dropped_lines(docs, min_docs, similarity).select(F.struct("doc_id", "h").alias("key"), "dropped").hint("shuffle_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("key"))
    both = rows.join(gone, "key", "left").select("row", "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = batch.column("row"), []
            for text, drop in zip(row.field("text").to_pylist(), batch.column("dropped").to_pylist()):
                n, drop = (text.count("\n") + 1 if text else 0), set(drop or ())
                out.append(("\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop) if drop else text, n, len(drop)))
            cols = [pa.array([x[0] for x in out], pa.string()) if n == "text" else row.field(n) for n in names]
            more = [pa.array([x[k] for x in out], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*cols, *more], names=[*names, "n_lines", "n_dropped"])

    return both.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in docs.dtypes], "n_lines long", "n_dropped long"]))


def keep_new(docs: DataFrame) -> DataFrame:
    """``docs`` without recurring lines; a document of which nothing else is left goes.

    All columns stay, whatever their names; ``n_chars``, where there is one, follows the text.
    """
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    judged = drop_recurring(kept)
    empty = F.trim(F.translate("text", "\t\n\x0b\x0c\r ", " " * 6)) == ""
    judged = judged.where((F.col("n_dropped") == 0) | ~empty)
    return judged.select(*[with_text(c) for c in docs.columns])
