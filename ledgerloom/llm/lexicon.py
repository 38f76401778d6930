"""Byte-level BPE through a minimal acyclic transducer over frequent words.

The frequent words of the corpus are compiled, with their token ids, into an automaton that
shares prefixes and suffixes. Along the way from its start to a final state the transitions add
up to the word's number, which leads to its ids. The automaton is a few flat arrays in one file;
Spark brings one copy to each executor and its Python workers memory-map it. Words that are not
in it are merged exactly, by rank.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_until_end, materialize, shared_dir, small, without

#: Words in the automaton.
WORDS = 1 << 16
#: Only words up to so many bytes go in.
WORD_BYTES = 32
#: Parts of words that a worker keeps beside the automaton; beyond that those go that the last texts did not need.
CACHE_WORDS = 200_000
CACHE_BYTES = 64
#: Bytes of text that are encoded together, and counted together.
SLICE_BYTES, COUNT_BYTES = 2 << 20, 8 << 20
#: Longest word that is merged beside others in one matrix.
MATRIX = 32
#: Classes of counts to each doubling; whole classes of frequent words go in.
CLASSES = 16

#: White space as Unicode has it; Python's own class has four characters more.
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the space before it, or white space; no token crosses such a border.
CHUNK = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: Letters and what punctuation follows them, two pre-tokens at most; the usual kind of chunk.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: The same for Arrow, which cuts the punctuation off first.
LETTERS, BEHIND = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed value: how the byte-level tokenizer splits a text.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")


#: Rank of a pair that does not merge.
NEVER = 1 << 40


def pretokens(chunk: str) -> list[str] | tuple[str, ...]:
    """Where the tokenizer cuts a chunk; tokens never reach across."""
    if m := PLAIN.fullmatch(chunk):
        return m.groups() if m[2] else (m[1],)
    return PRETOKEN.findall(chunk)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Vocabulary and merge ranks of a byte-level BPE file; exact encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        of = byte_alphabet()
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.texts_of = pa.array(self.bytes_of, pa.large_binary())
        self.byte_id = [0] * 256
        for c, b in of.items():
            self.byte_id[b] = vocab[c]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = rank, vocab[a + b]
        order = sorted((a << 32 | b, *m) for (a, b), m in self.merge.items())
        self.pairs, self.rank_of = (np.array([x[k] for x in order], np.int64) for k in (0, 1))
        self.id_of_rank = np.array([x[2] for x in sorted(order, key=lambda x: x[1])], np.int64)
        self.byte_ids = np.array(self.byte_id, np.int64)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """Ids of one pre-token: always the merge of lowest rank next, the leftmost of equals."""
        ids: list[int] = [self.byte_id[b] for b in word]
        merge, n = self.merge, len(ids)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged otherwise
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (m := merge.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NEVER where it does not merge, so too where one id is -1."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank_of[at], NEVER)

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """``merged`` of many words as little-endian unsigned 32-bit ids.

        Words of similar length are columns of a matrix; each round merges in every column the
        pair of lowest rank, the topmost of equals, until no column has one.
        """
        out: list[bytes] = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 6), (6, 10), (10, 16), (16, MATRIX)):
            some = np.flatnonzero((lens > low) & (lens <= high))
            if len(some):
                for k, x in zip(some.tolist(), self._columns([words[k] for k in some.tolist()], lens[some], high)):
                    out[k] = x
        for k in np.flatnonzero(lens > MATRIX).tolist():
            out[k] = array("I", self.merged(words[k])).tobytes()
        return out

    def _columns(self, words: list[bytes], lens: np.ndarray, high: int) -> list[bytes]:
        n = len(words)
        # The last row stays -1: it is what lies below the last token and, as row -1, above the first.
        ids = np.full((high + 1, n), -1, np.int64)
        col = np.repeat(np.arange(n), lens)
        ids[np.arange(len(col)) - np.repeat(np.cumsum(lens) - lens, lens), col] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rows = np.arange(high + 1)[:, None]
        after = np.where(rows + 1 < lens, rows + 1, high)
        before = np.broadcast_to(rows - 1, ids.shape).copy()
        rank = np.full(ids.shape, NEVER, np.int64)
        rank[:high] = self._ranks(ids[:high], ids[1:])
        result, where = np.full((n, high), -1, np.int64), np.arange(n)
        while True:
            i = rank.argmin(0)
            least = rank[i, np.arange(len(where))]
            busy = np.flatnonzero(least < NEVER)
            if 2 * len(busy) <= len(where):  # those that are done leave the matrix
                done = np.flatnonzero(least == NEVER)
                result[where[done]] = ids[:high, done].T
                if not len(busy):
                    break
                ids, after, before, rank = (x[:, busy] for x in (ids, after, before, rank))
                where, i, least = where[busy], i[busy], least[busy]
                busy = np.arange(len(where))
            i, new = i[busy], self.id_of_rank[least[busy]]
            j = after[i, busy]
            k, h = after[j, busy], before[i, busy]
            ids[i, busy], ids[j, busy] = new, -1
            after[i, busy], before[k, busy] = k, i
            rank[j, busy] = NEVER
            rank[i, busy] = self._ranks(new, ids[k, busy])
            rank[h, busy] = self._ranks(ids[h, busy], new)
        kept = result >= 0
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        data = result[kept].astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def word_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for token in pretokens(chunk):
            out += self.merged(token.encode())
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_all(self, rows: pa.BinaryArray) -> pa.Array:
        """``decode`` of each row of little-endian unsigned 32-bit ids; null as null. Arrow puts all bytes together."""
        rows = rows.cast(pa.large_binary())
        at = np.frombuffer(rows.buffers()[1], np.int64, len(rows) + 1, rows.offset * 8)
        ids = np.frombuffer(rows.buffers()[2] or b"", "<u4")[at[0] // 4 : at[-1] // 4]
        found = self.texts_of.take(pa.array(ids))
        cuts = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[(at - at[0]) // 4].copy()
        nulls = None if not rows.null_count else pa.array(rows.is_valid().to_numpy(zero_copy_only=False)).buffers()[1]
        whole = pa.Array.from_buffers(pa.large_binary(), len(rows), [nulls, pa.py_buffer(cuts), found.buffers()[2] or pa.py_buffer(b"")])
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:  # the ids of a row are not those of whole characters
            return pa.array([None if x is None else x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


class Transducer:
    """A minimal acyclic automaton over words, with the ids of each; flat arrays, memory-mapped."""

    NAMES = ("keys", "targets", "skips", "final", "starts", "ids")
    KINDS = ("<i8", "<i4", "<i4", "u1", "<i8", "<u4")

    def __init__(self, arrays: list[np.ndarray]):
        self.keys, self.targets, self.skips, self.final, self.starts, self.ids = arrays

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Transducer:
        """Insert the words in order; what no later word can change is merged with its equal at once."""
        order = sorted(w for w in words if w)
        register: dict[tuple, int] = {}
        done: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []  # final, (byte, state)..., words below
        path: list[list] = [[False, []]]  # states on the current word's way: final, [(byte, state)...]

        def close(down_to: int, word: bytes) -> None:
            while len(path) > down_to + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(done)
                    done.append((*key, final + sum(done[t][2] for _, t in arcs)))
                path[-1][1].append((word[len(path) - 1], state))

        last = b""
        for word in order:
            same = len(os.path.commonprefix([last, word]))
            close(same, last)
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        close(0, last)
        done.append((path[0][0], tuple(path[0][1]), len(order)))
        keys, targets, skips = [], [], []
        for state, (final, arcs, _) in enumerate(done):
            passed = int(final)
            for byte, t in arcs:
                keys.append(state * 256 + byte)
                targets.append(t)
                skips.append(passed)
                passed += done[t][2]
        lists = [words[w] for w in order]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        arrays = [keys, targets, skips, [f for f, _, _ in done], starts, [i for x in lists for i in x]]
        return cls([np.array(a, k) for a, k in zip(arrays, cls.KINDS)])

    def dump(self) -> bytes:
        arrays = [getattr(self, n) for n in self.NAMES]
        return np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.dump())

    @classmethod
    def load(cls, path: str) -> Transducer:
        """Map the file; pages are read when they are looked at and shared by all that map it."""
        raw = np.memmap(path, np.uint8, "r")
        sizes, at, arrays = raw[:48].view("<i8"), 48, []
        for n, kind in zip(sizes.tolist(), cls.KINDS):
            width = np.dtype(kind).itemsize * n
            arrays.append(raw[at : at + width].view(kind))
            at += width + -width % 8
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 if it is not in; all words take their next step at once."""
        if not words or not len(self.keys):
            return np.full(len(words), -1)
        state = np.full(len(words), len(self.final) - 1, np.int64)
        number, alive = np.zeros(len(words), np.int64), np.arange(len(words))
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat, first = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens
        out, k = np.full(len(words), -1), 0
        while len(alive):
            ended = alive[lens[alive] == k]
            ended = ended[self.final[state[ended]] > 0]
            out[ended] = number[ended]
            alive = alive[lens[alive] > k]
            key = state[alive] * 256 + flat[first[alive] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            alive, at = alive[there], at[there]
            number[alive] += self.skips[at]
            state[alive] = self.targets[at]
            k += 1
        return out


def _table(found: Iterable[int]) -> np.ndarray:
    return np.isin(np.arange(256), list(found))


#: Bytes that are white space; that may begin other white space; that stand in it before its last byte.
_SPACE, _LEADS, _INNER = _table([*range(9, 14), 32]), _table([0xC2, 0xE1, 0xE2, 0xE3]), _table([0x80, 0x81, 0x9A, 0xC2])


def stretches(texts: pa.LargeStringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The stretches of texts without nulls, and the number of the first one of each text.

    A text is cut before a blank and around a line feed that stand alone between other characters. No
    chunk reaches across such a cut, and none looks behind it, so a stretch means the same wherever it is.
    """
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data, base = texts.buffers()[2], at[0]
    d = np.frombuffer(data, np.uint8, at[-1] - base, base) if data and at[-1] > base else np.empty(0, np.uint8)
    p = np.flatnonzero((d == 32) | (d == 10))
    p = p[(p > 1) & (p < len(d) - 1)]
    before, behind = d[p - 1], d[p + 1]
    p = p[~(_SPACE[before] | _SPACE[behind] | _LEADS[behind] | (before > 127) & _INNER[d[p - 2]])]
    cut = np.zeros(len(d) + 1, bool)
    cut[p] = cut[p[d[p] == 10] + 1] = cut[at - base] = True
    cuts = np.flatnonzero(cut)
    every = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts + base), data or pa.py_buffer(b"")])
    return every.dictionary_encode(), np.searchsorted(cuts, at - base)


def halves(found: pa.LargeStringArray, special: Iterable[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Two for each stretch: its letters and the punctuation behind them; else the stretch and nothing.

    Also which of the distinct ones may be more than one pre-token.
    """
    n = len(found)
    letters = pc.ascii_rtrim(found, BEHIND)
    plain = pc.match_substring_regex(letters, LETTERS)
    for w in special:
        plain = pc.and_not(plain, pc.match_substring(found, w))
    plain = plain.to_numpy(zero_copy_only=False)
    at = np.frombuffer(found.buffers()[1], np.int64, n + 1, found.offset * 8)
    cuts = np.empty(2 * n + 1, np.int64)
    cuts[::2] = at
    cuts[1::2] = np.where(plain, at[:-1] + pc.binary_length(letters).to_numpy(), at[1:])
    parts = pa.Array.from_buffers(pa.large_string(), 2 * n, [None, pa.py_buffer(cuts), found.buffers()[2] or pa.py_buffer(b"")]).dictionary_encode()
    odd = np.zeros(len(parts.dictionary), bool)
    odd[parts.indices.to_numpy()[::2][~plain]] = True
    return parts, odd


def _bytes(found: pa.LargeStringArray) -> list[bytes]:
    at = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8).tolist()
    data = found.buffers()[2].to_pybytes() if found.buffers()[2] else b""
    return [data[a:b] for a, b in zip(at, at[1:])]


def _joined(values: list[bytes]) -> pa.LargeBinaryArray:
    cuts = np.zeros(len(values) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, values), np.int64, len(values)), out=cuts[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(cuts), pa.py_buffer(b"".join(values))])


def slices(texts: pa.Array, most: int) -> Iterator[pa.LargeStringArray]:
    """Texts of about ``most`` bytes at a time; null as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    total, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, to - at)
        at = to


class Encoder:
    """Whole texts to ids: the automaton first, exact merging for what it has not.

    Arrow cuts the texts, finds the distinct stretches and their parts, and puts the ids together.
    """

    def __init__(self, bpe: ByteBpe, transducer: Transducer):
        self.bpe, self.transducer = bpe, transducer
        self.special = {w.encode(): array("I", [i]).tobytes() for w, i in bpe.special.items()}
        if any(" " in w or "\n" in w for w in bpe.special):
            raise ValueError("a special token with a blank in it could be cut")
        self.known: dict[bytes, bytes] = {b"": b"", **self.special}

    def _learn(self, fresh: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pre-tokens."""
        numbers = self.transducer.numbers(fresh)
        inside, unseen = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers < 0).tolist()
        data, starts = memoryview(self.transducer.ids).cast("B"), self.transducer.starts
        spans = zip(inside.tolist(), (starts[numbers[inside]] * 4).tolist(), (starts[numbers[inside] + 1] * 4).tolist())
        found = {fresh[k]: bytes(data[a:b]) for k, a, b in spans}
        found.update(zip([fresh[k] for k in unseen], self.bpe.merged_all([fresh[k] for k in unseen])))
        return found

    def _split(self, part: str) -> list[bytes]:
        """Pre-tokens and special tokens of any stretch."""
        special = self.bpe.special
        parts = self.bpe.split_special.split(part) if self.bpe.split_special else [part]
        return [w.encode() for p in parts for w in ([p] if p in special else [w for c in CHUNK.findall(p) for w in pretokens(c)])]

    def _ids(self, parts: pa.LargeStringArray, odd: np.ndarray) -> pa.LargeBinaryArray:
        """The ids of each distinct part."""
        asked, known = _bytes(parts), self.known
        ids = list(map(known.get, asked))
        new = [i for i, x in enumerate(ids) if x is None]
        is_odd = odd[new].tolist()
        split = {i: self._split(asked[i].decode()) for i, x in zip(new, is_odd) if x}
        fresh = {asked[i]: None for i, x in zip(new, is_odd) if not x}
        fresh.update((w, None) for ws in split.values() for w in ws if w not in known)
        found = self._learn(list(fresh))
        for i in new:
            ws = split.get(i)
            ids[i] = found[asked[i]] if ws is None else b"".join([found[w] if w in found else known[w] for w in ws])
        if len(known) + len(new) > CACHE_WORDS:
            stay = {w: known[w] for w in asked if w in known}
            self.known = known = {b"": b"", **self.special} | (stay if len(stay) <= CACHE_WORDS // 2 else {})
        known.update((asked[i], ids[i]) for i in new if len(asked[i]) <= CACHE_BYTES)
        return _joined(ids)

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers; null as empty."""
        for some in slices(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), SLICE_BYTES):
            found, first = stretches(some)
            parts, odd = halves(found.dictionary, self.bpe.special)
            ids = self._ids(parts.dictionary, odd).take(parts.indices)
            whole = pa.py_buffer(np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[::2].copy())
            ids = pa.Array.from_buffers(pa.large_binary(), len(ids) // 2, [None, whole, ids.buffers()[2]]).take(found.indices)
            cuts = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[first].tolist()
            data = memoryview(ids.buffers()[2])
            for a, b in zip(cuts, cuts[1:]):
                yield bytes(data[a:b])


@lru_cache(maxsize=2)
def bpe(path: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(path)


@lru_cache(maxsize=1)
def encoder(path: str, lexicon: str) -> Encoder:
    """One for each Python worker: Spark uses workers for many tasks, and known words stay known.

    Only the last one is kept, as its words take the most memory of all.
    """
    return Encoder(bpe(path), Transducer.load(SparkFiles.get(lexicon)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the pre-tokens of all whole texts, with the space before them. Counted within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch.column("text"), COUNT_BYTES):
                found, _ = stretches(some)
                parts, odd = halves(found.dictionary, ())
                times = np.repeat(np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)), 2)
                n = np.zeros(len(parts.dictionary), np.int64)
                np.add.at(n, parts.indices.to_numpy(), times)
                words: Counter = Counter()
                for part, k in zip(parts.dictionary.filter(pa.array(odd)).to_pylist(), n[odd].tolist()):
                    for w in [w for c in CHUNK.findall(part) for w in pretokens(c)]:
                        words[w] += k
                kept = ~odd & (pc.binary_length(parts.dictionary).to_numpy() > 0)
                names = pa.concat_arrays([parts.dictionary.filter(pa.array(kept)).cast(pa.string()), pa.array(words.keys(), pa.string())])
                out = pa.RecordBatch.from_arrays([names, pa.array(np.append(n[kept], np.array(list(words.values()), np.int64)))], names=["word", "n"])
                yield out.filter(pc.less_equal(pc.binary_length(names), WORD_BYTES))

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = WORDS) -> DataFrame:
    """At most ``most`` of the most frequent words of ``counts``: whole classes of counts, from the top.

    A class holds counts up to a factor of 2 ** (1 / CLASSES) apart. The driver sees how many words
    each class has, some hundred numbers however large the corpus, and where to cut; no task sends
    words that are not kept.
    """
    counts = counts.withColumn("__class", F.floor(F.log2("n") * CLASSES))
    room, least = most, None
    for r in counts.groupBy("__class").count().orderBy(F.desc("__class")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["__class"]
    return counts.where(F.lit(False) if least is None else F.col("__class") >= least).drop("__class")


def _share(spark: SparkSession, data: bytes, name: str) -> None:
    """Write a file to the shared folder and let Spark bring it to every executor."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()
    keep_until_end(spark, path.toString())
    spark.sparkContext.addFile(path.toString())


def compile_lexicon(docs: DataFrame, path: str, words: int = WORDS) -> str:
    """Build the automaton of the most frequent words and hand it to all executors; its name there.

    The driver holds at most ``words`` words of up to WORD_BYTES bytes.
    """
    counts = materialize(word_counts(docs).where(F.octet_length("word") <= WORD_BYTES), "words")
    top = frequent_words(counts, words).select("word").toArrow().column("word").to_pylist()
    own = bpe(path)
    machine = Transducer.build({w.encode(): own.word_ids(w) for w in top if w not in own.special})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    _share(docs.sparkSession, machine.dump(), name)
    return name


def encode(docs: DataFrame, path: str, lexicon: str) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) in place of ``text``.

    Null and empty texts have no ids. Special tokens' strings in a text become their ids, as the
    tokenizer does. Other columns pass through, but for one called ids.
    """
    docs = without(docs, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, lexicon)
        for batch in small(batches):
            keep = [n for n in batch.schema.names if n != "text"]
            ids = pa.array(list(own.encode(batch.column("text"))), pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], ids], names=[*keep, "ids"])

    return docs.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in docs.dtypes if n != "text"], "ids binary"]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text that its ``ids`` stand for; null ids give null."""
    encoded = without(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, own.decode_all(batch.column("ids"))], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in encoded.dtypes], "decoded string"]))
