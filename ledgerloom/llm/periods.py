"""Periodic runs of words, by Crochemore's partition refinement.

Positions of a text are classed by the factor of p words that starts there. From p to p + 1 a class
splits by the classes of its members' right neighbours; only neighbours in the smaller parts of the
last split can split anything, which bounds all moves by n log n. The members of a class are kept
as a linked list in order of position. Two neighbours of a list at distance p, in a class for
length p, are the halves of a square whose root is no repetition itself; squares with equal roots
at consecutive positions make up a run, and the root's length is the run's smallest period.

A list's gap from one member to the next lives from the length at which it came up to that at which
one of the two leaves, so it needs a look only when it ends: it is a square if its distance is one of
those lengths. All texts of a batch are refined together, each up to a quarter of its length, as a
run has four periods at least.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small, without

#: A run has REPEATS periods and LEAST words at least.
REPEATS, LEAST = 4, 6
#: Words refined together, about; a longer text is refined by itself.
BATCH_WORDS = 1 << 20
COLUMNS = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}


def with_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """``words`` with the periodic tail that the id of every tenth document or so brings; without an id as they are."""
    if doc_id is None or not words:
        return words
    g, tenth = divmod(zlib.crc32(b"%d" % doc_id), 10)
    if tenth:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


class _Classes:
    """Classes of positions by equal factors, with each class's members as a linked list."""

    def __init__(self, first: np.ndarray):
        """``first`` holds the class of each position for length 1."""
        n = len(first)
        self.of = first
        self.size = np.bincount(first).astype(np.int64)
        self.count = len(self.size)
        order = np.argsort(first, kind="stable")
        same = first[order[1:]] == first[order[:-1]]
        self.next, self.prev = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.next[order[:-1][same]] = order[1:][same]
        self.prev[order[1:][same]] = order[:-1][same]
        self.born = np.ones(n, np.int32)
        self.squares: list[np.ndarray] = []

    def ended(self, at: np.ndarray, length: int | np.ndarray) -> None:
        """Note the squares among the gaps behind ``at``, which lived up to ``length``."""
        gap = self.next[at] - at
        found = (gap >= self.born[at]) & (gap <= length)
        if found.any():
            self.squares.append(np.stack([gap[found], at[found]]))

    def others(self, at: np.ndarray, moving: np.ndarray) -> np.ndarray:
        """The members of the classes of ``at``, one for each, that are not in ``moving``."""
        out = []
        for step in (self.prev, self.next):
            now = step[at]
            while len(now := now[now >= 0]):
                out.append(now)
                now = step[now]
        found = np.concatenate(out) if out else np.empty(0, np.int64)
        return found[~np.isin(found, moving)]

    def split(self, changed: np.ndarray, length: int) -> np.ndarray:
        """Split by what follows: ``changed`` are right neighbours that got new classes; returns the positions that leave."""
        at = np.sort(changed - 1)
        key = self.of[at] * np.int64(self.count) + self.of[at + 1]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        parts = np.diff(np.append(begin, len(at)))
        owner = self.of[at[begin]]
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        kinds = np.diff(np.append(head, len(owner)))
        # The largest part stays where it is: one of those found, or all members that did not come up.
        largest = np.maximum.reduceat(parts, head)
        rest = self.size[owner[head]] - np.add.reduceat(parts, head)
        stays = (parts == np.repeat(largest, kinds)) & np.repeat(largest > rest, kinds)
        if stays.any():
            firsts = np.flatnonzero(stays)
            firsts = firsts[np.concatenate([[True], np.diff(np.repeat(np.arange(len(head)), kinds)[firsts]) > 0])]
            stays[:] = False
            stays[firsts] = True
        group = np.repeat(np.arange(len(begin)), parts)
        leaves = ~np.repeat(stays, parts)
        small_rest = (largest > rest) & (rest > 0)
        if small_rest.any():
            more = np.sort(self.others(at[begin[head[small_rest]]], at))
            classes = owner[head]
            at, group = np.concatenate([at[leaves], more]), np.concatenate([group[leaves], len(begin) + np.searchsorted(classes, self.of[more])])
            order = np.argsort(group, kind="stable")
            at, group = at[order], group[order]
        else:
            at, group = at[leaves], group[leaves]
        if len(at):
            self._move(at, group, length)
        return at

    def _move(self, at: np.ndarray, group: np.ndarray, length: int) -> None:
        """``at``, ordered by group and position, leave their lists; each group becomes a class."""
        old = self.of[at]
        order = np.lexsort((at, old))
        listed = at[order]
        # What stands side by side in a list leaves it in one piece.
        joined = self.next[listed[:-1]] == listed[1:]
        left = self.prev[listed[np.concatenate([[True], ~joined])]]
        right = self.next[listed[np.concatenate([~joined, [True]])]]
        inside = left >= 0
        self.ended(listed[self.next[listed] >= 0], length)
        self.ended(left[inside], length)
        self.next[left[inside]] = right[inside]
        self.born[left[inside]] = length + 1
        after = right >= 0
        self.prev[right[after]] = left[after]
        np.subtract.at(self.size, old, 1)
        new = np.concatenate([[True], group[1:] != group[:-1]])
        names = self.count + np.cumsum(new) - 1
        self.next[at] = np.append(np.where(new[1:], -1, at[1:]), -1)
        self.prev[at] = np.append(-1, np.where(new[1:], -1, at[:-1]))
        self.born[at] = length + 1
        self.of[at] = names
        sizes = np.bincount(names - self.count)
        if self.count + len(sizes) > len(self.size):
            self.size = np.concatenate([self.size, np.zeros(self.count + len(sizes), np.int64)])
        self.size[self.count : self.count + len(sizes)] = sizes
        self.count += len(sizes)


def runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start and then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    long = [k for k, words in enumerate(texts) if len(words) >= LEAST]
    if not long:
        return found
    first, at, base = [], [], 0
    for k in long:  # a mark behind each text, found nowhere else, ends its factors
        of: dict[bytes, int] = {}
        codes = np.array([of.setdefault(w, len(of)) for w in texts[k]], np.int64) + base
        base += len(of) + 1
        first += [codes, np.array([base - 1])]
        at.append(len(codes) + 1)
    begin = np.concatenate([[0], np.cumsum(at)])
    most = np.repeat(np.array(at) // REPEATS, at).astype(np.int32)  # a text with its mark: no less than a quarter
    classes = _Classes(np.concatenate(first))
    head = np.zeros(begin[-1] + 1, bool)
    head[begin] = True
    changed, length = np.arange(begin[-1]), 1
    while len(changed):
        before = changed[~head[changed]] - 1
        before = before[(classes.size[classes.of[before]] > 1) & (most[before] > length)]
        if not len(before):
            break
        changed = classes.split(before + 1, length)
        length += 1
    alive = np.flatnonzero(classes.next >= 0)
    classes.ended(alive, most[alive])
    if not classes.squares:
        return found
    gap, pos = np.concatenate(classes.squares, axis=1)
    order = np.lexsort((pos, gap))
    gap, pos = gap[order], pos[order]
    new = np.flatnonzero(np.concatenate([[True], (gap[1:] != gap[:-1]) | (pos[1:] != pos[:-1] + 1)]))
    last = np.append(new[1:], len(pos)) - 1
    start, period = pos[new], gap[new]
    length = pos[last] - start + 2 * period
    keep = length >= np.maximum(LEAST, REPEATS * period)
    start, length, period = start[keep], length[keep], period[keep]
    text = np.searchsorted(begin, start, side="right") - 1
    order = np.lexsort((period, start))
    for k, s, n, q in zip(text[order].tolist(), (start - begin[text])[order].tolist(), length[order].tolist(), period[order].tolist()):
        found[long[k]].append((s, n, q))
    return found


def _row(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """What is told of one text."""
    listed = hashlib.sha256(b"".join(b"%d,%d,%d\n" % run for run in found)).hexdigest()
    if not found:
        return 0, None, None, None, None, listed, hashlib.sha256(b" ".join(words)).hexdigest()
    start, length, period = min(found, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]))
    kept = np.ones(len(words), bool)
    for s, n, q in found:
        kept[s + q : s + n] = False
    collapsed = b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])
    return len(found), start, length, period, 1000 * length // period, listed, hashlib.sha256(collapsed).hexdigest()


def detect(docs: DataFrame, batch_words: int = BATCH_WORDS) -> DataFrame:
    """``docs`` without ``text``, with the number of its runs, the strongest run, and digests of all runs and of the collapsed text.

    A run is a stretch of words with smallest period q, of four periods and six words at least, that
    no neighbouring word extends. The strongest has the greatest exact exponent; ties go to the
    smaller start, then period. The collapsed text lacks what a run repeats after its first period.

    Every document is read with the periodic tail of ``with_period``. Null and empty texts have no
    words and no runs, and repeated rows are judged alike; a document without an id has no such tail.
    A text of any length is refined whole, in memory that grows with it. An empty table gives an
    empty result. Columns with the names of the results make way.
    """
    docs = without(docs, *COLUMNS)
    names = [n for n in docs.columns if n != "text"]

    def judge(batch: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        rows = [_row(words, found) for words, found in zip(texts, runs(texts))]
        kinds = [pa.string() if kind == "string" else pa.int64() for kind in COLUMNS.values()]
        more = [pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *more], names=[*names, *COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 10_000):
            ids, texts, since, held = batch.column("doc_id").to_pylist(), [], 0, 0
            for k, text in enumerate(batch.column("text")):
                words = with_period((text.as_py() or "").encode().split(), ids[k])
                texts.append(words)
                held += len(words)
                if held >= batch_words or k + 1 == batch.num_rows:
                    yield judge(batch.slice(since, len(texts)), texts)
                    texts, since, held = [], k + 1, 0

    schema = [f"`{n}` {t}" for n, t in docs.dtypes if n != "text"] + [f"{n} {t}" for n, t in COLUMNS.items()]
    return docs.mapInArrow(run, ", ".join(schema))


def oracle_sql() -> str:
    """The same in SQL for DuckDB: stretches of words equal to those a period later, for each period."""
    step = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: {step}), 4294967295)"
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc} AS h FROM documents),
places AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS turned, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS k FROM words),
periodic AS (SELECT *, 1 + (n - a) // (3 + k) AS p FROM places),
spread AS (SELECT doc_id, w, n, turned, a, p, unnest(range(0, n)) AS i FROM periodic),
docs AS (SELECT doc_id, n, i, w[1 + CASE WHEN turned AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM spread),
equal_pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM docs x JOIN docs y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND {REPEATS} * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal_pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest({LEAST}, {REPEATS} * q) GROUP BY doc_id, start, length),
listed AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY doc_id),
strongest AS (
  SELECT doc_id, start, length, period FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
kept AS (
  SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM docs d
  WHERE NOT EXISTS (FROM runs r WHERE r.doc_id = d.doc_id AND d.i >= r.start + r.period AND d.i < r.start + r.length) GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, s.start::BIGINT AS start, s.length::BIGINT AS length, s.period::BIGINT AS period,
  (1000 * s.length // s.period)::BIGINT AS exponent_milli, coalesce(l.runs_sha256, sha256('')) AS runs_sha256, coalesce(k.collapsed_sha256, sha256('')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l USING (doc_id) LEFT JOIN strongest s USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
