"""Token ids of whole texts, each distinct word of some megabytes of text looked up once.

For tokenizers that drop white space, as that of ``word_bpe_49k.json`` does: its normalizer and
pre-tokenizer never look across ASCII white space, so the ids of a text are those of its words,
one after the other. Arrow splits the texts, finds the distinct words and puts the ids together.
A word of plain letters between punctuation is cut there, as the pre-tokenizer does, and its
letters go to the library's merging without the costly patterns; so "On", "on" and "on," are one
entry of the cache.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import single_threaded

#: Parts of words kept, about 150 bytes each. Beyond that those go that were not asked for again.
CACHE_PARTS = 150_000
#: Parts longer than this are not kept.
CACHE_BYTES = 64
#: Bytes of text that are encoded together: more are faster and take more memory.
SLICE_BYTES = 1 << 20

#: Letters such that lower-casing keeps their length and composing leaves them alone, and letters to
#: every version of Unicode. Not among them: the sharp s, a byte of which has no Latin-1 shape.
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00e0-\u00f6\u00f8-\u00ff]+$"
#: What may stand behind such letters, and before them: an apostrophe may begin a pre-token with letters.
BEHIND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BEFORE = BEHIND.replace("'", "")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes with the tokenizers library; ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        two = self._whole(["ab", "cd"])
        gaps = [f"ab{gap}cd" for gap in " \t\n\x0b\x0c\r"] + [f"{gap}ab{gap}cd{gap}" for gap in " \n"]
        if any(x != b"".join(two) for x in self._whole(gaps)) or any(t.split() != [t] for t in self.added):
            raise ValueError(f"the tokenizer of {path} does not drop white space")
        # Merging alone, for words of plain letters; each word's last token says that it ends one.
        self.merging = Tokenizer(self.tokenizer.model)
        self.merging.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.vocabulary(), bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if suffix and w.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {b"": b""}
        self.again: set[bytes] = set()
        probes = ["Straße,", "(Niño)", "ÉLÈVE...", "ab###", "a'", "a's,", "'s", "İab", "encoding", *(t.decode() for t in self.added)]
        probes += [f"a{chr(c)}b" for c in [*range(97, 123), *range(0xE0, 0x100)]]
        self.plain = bool(suffix)
        self.plain = self.plain and list(self.encode(probes)) == self._whole(probes)
        self.known, self.again = {b"": b""}, set()

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _whole(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of plain letters in lower case: all in one text, cut where a word ends."""
        # The vocabulary spells bytes as Latin-1 characters, but for two that have no shape.
        text = b" ".join(words).decode("latin-1").replace("\xa0", "\u0142").replace("\xad", "\u0143")
        ids = np.array(self.merging.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _parts(self, words: pa.LargeStringArray) -> pa.DictionaryArray:
        """Three for each word: what stands before its letters, these in lower case, what stands behind; else the word and twice nothing."""
        n = len(words)
        headless = pc.ascii_ltrim(words, BEFORE)
        letters = pc.ascii_rtrim(headless, BEHIND)
        plain = pc.match_substring_regex(letters, PLAIN) if self.plain else pa.array(np.zeros(n, bool))
        for t in self.added:
            plain = pc.and_not(plain, pc.match_substring(words, t.decode()))
        words = pc.if_else(plain, pc.utf8_lower(words), words)
        at = np.frombuffer(words.buffers()[1], np.int64, n + 1, words.offset * 8)
        cuts = np.empty(3 * n + 1, np.int64)
        cuts[::3] = at
        is_plain = plain.to_numpy(zero_copy_only=False)
        cuts[1::3] = np.where(is_plain, at[1:] - pc.binary_length(headless).to_numpy(), at[1:])
        cuts[2::3] = np.where(is_plain, cuts[1::3] + pc.binary_length(letters).to_numpy(), at[1:])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), 3 * n, [None, pa.py_buffer(cuts), words.buffers()[2]]).dictionary_encode()

    def _ids(self, parts: pa.DictionaryArray) -> pa.LargeBinaryArray:
        """The ids of each distinct part."""
        found = pc.binary_join(pa.ListArray.from_arrays([0, len(parts.dictionary)], parts.dictionary.cast(pa.binary())), b" ")
        asked = found[0].as_buffer().to_pybytes().split(b" ")[: len(parts.dictionary)]  # none has a blank
        ids = list(map(self.known.get, asked))
        new = [i for i, x in enumerate(ids) if x is None]
        middle = np.zeros(len(asked), bool)
        middle[parts.indices.to_numpy()[1::3]] = True
        for some, learn in ((True, self._merged), (False, lambda them: self._whole([w.decode() for w in them]))):
            which = [i for i, is_middle in zip(new, middle[new].tolist()) if is_middle == some]
            for k in range(0, len(which), 2000):
                for i, x in zip(which[k : k + 2000], learn([asked[i] for i in which[k : k + 2000]])):
                    ids[i] = x
        self._keep(asked, ids, new)
        cuts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)), out=cuts[1:])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts), pa.py_buffer(b"".join(ids))])

    def _keep(self, asked: list[bytes], ids: list[bytes], new: list[int]) -> None:
        known = self.known
        self.again.update(asked)
        self.again.difference_update([asked[i] for i in new])
        if len(known) + len(new) > CACHE_PARTS:
            # If too many were asked for again, those of the last texts stay, most of which the next ones need as well.
            stay = self.again if len(self.again) <= CACHE_PARTS * 3 // 4 else set(asked).intersection(known)
            stay.add(b"")
            self.known = known = {w: known[w] for w in stay}
            self.again = set()
        known.update((asked[i], ids[i]) for i in new if len(asked[i]) <= CACHE_BYTES)

    def encode(self, texts: pa.Array | list[str | None], end: bytes = b"", together: int | None = None) -> Iterator[bytes]:
        """The ids of each text, null as empty, followed by ``end``; ``together`` bytes of text at a time."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = texts.fill_null("")
        total = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (together or SLICE_BYTES), "right")))
            split = pc.ascii_split_whitespace(texts.slice(at, to - at))
            words = split.flatten().dictionary_encode()
            parts = self._parts(words.dictionary)
            ids = self._ids(parts).take(parts.indices)
            by_word = pa.py_buffer(np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[::3].copy())
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids) // 3, [None, by_word, ids.buffers()[2]]).take(words.indices)
            cuts = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
            data = memoryview(ids.buffers()[2])
            for a, b in zip(cuts, cuts[1:]):
                yield bytes(data[a:b]) + end
            at = to


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker: Spark uses workers for many tasks, and known words stay known."""
    return WordEncoder(path)
