"""Packing, the token store and byte-level BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import lexicon, packing, queries, tokenstore, wordpieces
from ledgerloom.llm.wordpieces import WordEncoder, public_path


@pytest.fixture(scope="module")
def texts(spark, tiny):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def word_ids(texts):
    tokenizer = Tokenizer.from_file(public_path(queries.WORD_BPE))
    return {d: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4") for d, t in texts.items()}


def test_packing_query(spark, tiny, word_ids):
    rows = queries.op1_packing(spark, tiny).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == word_ids.keys()
    for d, pieces in by_doc.items():
        ids = np.append(word_ids[d], np.uint32(1)).astype("<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= packing.WINDOW
    tokens = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1 + 1.02 * tokens / packing.WINDOW


@given(st.lists(st.integers(1, 40), max_size=120))
def test_best_fit_is_the_plain_one(lengths):
    got, offsets = packing.best_fit(np.array(lengths, np.int64), 40)
    room: list[int] = []
    want = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [k for k, r in enumerate(room) if r >= lengths[i]]
        if fits:
            least = min(room[k] for k in fits)
            k = next(k for k in fits if room[k] == least)
        else:
            k = len(room)
            room.append(40)
        room[k] -= lengths[i]
        want[i] = k
    used = lambda of: sorted(sum(n for n, k in zip(lengths, of) if k == s) for s in set(of))
    assert used(got.tolist()) == used(want)  # which of two equally full ones is taken may differ
    assert all(0 <= o <= 40 - n for o, n in zip(offsets.tolist(), lengths))


def test_store_query(spark, tiny, word_ids):
    rows = {r["doc_id"]: r for r in queries.op2_tokenstore(spark, tiny).collect()}
    at = 0
    for d in sorted(word_ids):
        ids = np.append(word_ids[d], np.uint32(2)).astype("<u4")
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert rows.keys() == word_ids.keys()


@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, 2**b - 1), max_size=300), st.data())))
@settings(deadline=None)
def test_bits_come_back_from_anywhere(case):
    bits, ids, data = case
    packed = tokenstore.pack_bits(np.array(ids, "<u4"), bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert tokenstore.unpack_bits(packed, bits, a, b).tolist() == ids[a:b]


def test_store_reads_ranges_and_keeps_odd_rows(spark):
    rows = [(7, "seven words are here"), (None, None), (3, ""), (3, "three"), (3, "three"), (2**40, "far " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    store = tokenstore.write(docs, public_path(queries.WORD_BPE), block_tokens=4)
    whole = tokenstore.read(spark, store).collect()
    assert sorted(r["n_tokens"] for r in whole) == [1, 1, 2, 2, 5, 3001]
    starts = sorted((r["start"], r["n_tokens"]) for r in whole)
    assert [a for a, _ in starts] == np.cumsum([0] + [n for _, n in starts])[:-1].tolist()
    part = tokenstore.read(spark, store, 3, 7).collect()
    assert sorted(r["doc_id"] for r in part) == [3, 3, 3, 7]
    assert {(r["start"], r["ids"]) for r in part} <= {(r["start"], r["ids"]) for r in whole}
    assert tokenstore.read(spark, tokenstore.write(docs.limit(0), public_path(queries.WORD_BPE))).count() == 0


def test_packing_keeps_odd_rows(spark):
    rows = [(None, None, 1), (3, "", 2), (3, "same text", 3), (3, "same text", 3), (4, "long " * 9000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    got = packing.pack(docs, public_path(queries.WORD_BPE), group_bytes=1000).collect()
    assert sum(r["length"] for r in got) == 1 + 1 + 3 + 3 + 9001
    assert packing.pack(docs.limit(0), public_path(queries.WORD_BPE)).count() == 0


@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab ’' 　\n\tÀß1,.", max_size=40)), max_size=6))
@settings(deadline=None, max_examples=200)
def test_words_encode_as_whole_texts_do(samples):
    tokenizer, encoder = Tokenizer.from_file(public_path(queries.WORD_BPE)), WORD_ENCODER
    for text, got in zip(samples, encoder.encode(samples)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_of_the_same_letters_are_looked_up_once():
    tokenizer, encoder = Tokenizer.from_file(public_path(queries.WORD_BPE)), WordEncoder(public_path(queries.WORD_BPE))
    samples = ["On on, (ON) on. ÉTÉ été", None, "", " on!\n ", "'son <|endoftext|> <|ENDOFTEXT|> İl Straße STRASSE \u212aelvin a\u0301\x00b \u2028x"]
    for whole in (samples, samples[:3], samples[1:3], samples[:0]):
        for given in (whole, pa.array(whole, pa.string()), pa.array(["gone", *whole], pa.string()).slice(1)):
            got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(given, b"\2\0\0\0")]
            assert got == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in whole]
    assert {b"on", "été".encode(), b",", b"(", b")", b".", b"!"} <= encoder.known.keys()
    assert not {b"On", b"on,", b"(ON)", b"on.", b"on!"} & encoder.known.keys()


@pytest.mark.parametrize("kept", [2, 8, 40])
def test_a_small_cache_of_words_changes_nothing(monkeypatch, kept):
    monkeypatch.setattr(wordpieces, "CACHE_PARTS", kept)
    monkeypatch.setattr(wordpieces, "SLICE_BYTES", 30)
    tokenizer, encoder = Tokenizer.from_file(public_path(queries.WORD_BPE)), WordEncoder(public_path(queries.WORD_BPE))
    samples = [f"the word{'s' * (i % 7)} of, No. {i} {'long' * (i % 30)}; the Of" for i in range(60)]
    for text, got in zip(samples, encoder.encode(samples)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) <= kept + 20 and max(map(len, encoder.known)) <= wordpieces.CACHE_BYTES


WORD_ENCODER = WordEncoder(public_path(queries.WORD_BPE))
BPE = lexicon.ByteBpe(public_path(queries.BYTE_BPE))
LIBRARY = Tokenizer.from_file(public_path(queries.BYTE_BPE))
FREQUENT = {w.encode(): BPE.word_ids(w) for w in [" the", "the", " of", "\n", " ", " word", " words", "don't", " don't"]}


@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab 'tsdon 　​\x1c\x85\n\t1,.é<|endoftext|>", max_size=60)), max_size=6))
@settings(deadline=None, max_examples=300)
def test_transducer_encoding_equals_the_library(samples):
    samples = [*samples, "the words don't<|endoftext|> end  here \n\n x"]
    tokenizer = Tokenizer.from_file(public_path(queries.BYTE_BPE))
    encoder = lexicon.Encoder(BPE, lexicon.Transducer.build(FREQUENT))
    for text, got in zip(samples, encoder.encode(samples)):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
        assert BPE.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_transducer_knows_its_words_and_no_others(tmp_path):
    words = {w: [len(w), i] for i, w in enumerate([b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b"x"])}
    machine = lexicon.Transducer.build(words)
    machine.save(str(tmp_path / "m"))
    loaded = lexicon.Transducer.load(str(tmp_path / "m"))
    asked = [*words, b"", b"ta", b"tapsx", b"zzz"]
    numbers = loaded.numbers(asked)
    assert (numbers[-4:] == -1).all()
    for w, n in zip(words, numbers.tolist()):
        assert loaded.ids[loaded.starts[n] : loaded.starts[n + 1]].tolist() == words[w]
    assert len(loaded.final) < sum(map(len, words))  # suffixes are shared


def test_bpe_query(spark, tiny, texts):
    tokenizer = Tokenizer.from_file(public_path(queries.BYTE_BPE))
    rows = {r["doc_id"]: r for r in queries.op8_bpe(spark, tiny).collect()}
    assert rows.keys() == texts.keys()
    for d, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert rows[d]["n_tokens"] == len(ids)
        assert rows[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[d]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_keeps_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (2, "x" * 50_000, "c"), (2, "x" * 50_000, "c")], "doc_id long, text string, ids string")
    path = public_path(queries.BYTE_BPE)
    both = lexicon.decode(lexicon.encode(docs, path, lexicon.compile_lexicon(docs, path)), path).collect()
    assert sorted(len(r["decoded"]) for r in both) == [0, 0, 50_000, 50_000]
    empty = docs.limit(0)
    assert lexicon.encode(empty, path, lexicon.compile_lexicon(empty, path)).count() == 0


def test_store_range_finds_documents_beside_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "c"), (5, "d e f"), (7, None), (7, "z")], "doc_id long, text string")
    store = tokenstore.write(docs, public_path(queries.WORD_BPE), shards=1)
    every = sorted((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in tokenstore.read(spark, store).collect())
    assert [x[0] for x in every] == [0, 3, 5, 7, 7]
    assert sorted(r["doc_id"] for r in tokenstore.read(spark, store, 3, 5).collect()) == [3, 5]
    assert sorted(r["doc_id"] for r in tokenstore.read(spark, store, first_doc=5).collect()) == [5, 7, 7]
    assert sorted(r["doc_id"] for r in tokenstore.read(spark, store, last_doc=3).collect()) == [3]


def test_store_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ids binary, start int")
    store = tokenstore.write(docs, public_path(queries.WORD_BPE))
    assert tokenstore.read(spark, store).count() == 0
    assert tokenstore.read(spark, store, 1, 2).count() == 0


def test_word_encoder_refuses_a_tokenizer_that_keeps_white_space():
    with pytest.raises(ValueError, match="white space"):
        WordEncoder(public_path(queries.BYTE_BPE))


@given(st.lists(st.binary(min_size=1, max_size=45), max_size=40))
@settings(deadline=None, max_examples=100)
def test_words_merged_in_a_matrix_equal_those_merged_one_by_one(words):
    words = [*words, b"x", b"aaaa" * 7, b" encoding", b"abc" * 30, b""]
    assert [np.frombuffer(x, "<u4").tolist() for x in BPE.merged_all(words)] == [BPE.merged(w) for w in words]


def test_frequent_words_are_whole_classes_from_the_top(spark):
    counts = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([1000, 900, 50, 50, 50, 2, 2, 1])], "word string, n long")
    kept = lambda most: sorted(r["n"] for r in lexicon.frequent_words(counts, most).collect())
    assert kept(2) == [900, 1000]
    assert kept(4) == [900, 1000]  # three words of one class do not fit
    assert kept(5) == [50, 50, 50, 900, 1000]
    assert len(kept(100)) == 8 and kept(0) == []


def test_plain_words_are_cut_by_arrow_alone(monkeypatch):
    asked = []
    monkeypatch.setattr(lexicon, "pretokens", lambda chunk, cut=lexicon.pretokens: asked.append(chunk) or cut(chunk))
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}é{'.' * (i % 3)}" for i in range(600)]
    text = "\n".join(" ".join(words[i : i + 20]) for i in range(0, 600, 20))
    encoder = lexicon.Encoder(BPE, lexicon.Transducer.build(FREQUENT))
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([text, None, "", text[:50]])]
    tokenizer = Tokenizer.from_file(public_path(queries.BYTE_BPE))
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", "", text[:50])]
    assert len(asked) <= 2


@given(st.lists(st.one_of(st.text(alphabet="ab \n\t\u0085\u00a0\u2003\u2029\u205f\u3000\u1680é’", max_size=40), st.text(max_size=20)), max_size=6), st.integers(1, 40))
@settings(deadline=None, max_examples=300)
def test_cut_texts_encode_as_whole_ones_in_slices_of_any_size(samples, most):
    encoder, kept = lexicon.Encoder(BPE, lexicon.Transducer.build(FREQUENT)), (lexicon.SLICE_BYTES, lexicon.CACHE_WORDS)
    lexicon.SLICE_BYTES, lexicon.CACHE_WORDS = most, most
    try:
        got = list(encoder.encode(pa.array(["skipped", *samples], pa.string()).slice(1)))
    finally:
        lexicon.SLICE_BYTES, lexicon.CACHE_WORDS = kept
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in samples]


@given(st.lists(st.one_of(st.none(), st.lists(st.integers(0, len(BPE.bytes_of) - 1), max_size=8)), max_size=8), st.integers(0, 2))
@settings(deadline=None, max_examples=200)
def test_rows_decoded_together_equal_those_decoded_alone(rows, at):
    data = pa.array([None if x is None else np.array(x, "<u4").tobytes() for x in rows], pa.binary()).slice(at)
    assert BPE.decode_all(data).to_pylist() == [None if x is None else BPE.decode(x) for x in rows[at:]]


def test_words_are_counted_as_pretokens(spark):
    texts = ["the word, the  word\n\nthe words' end ", None, "", " the don't\nword,", "x1 ’the’ <|endoftext|> a\u2003b " * 3, "y" * 50 + " the"]
    want = Counter(w for t in texts if t for c in lexicon.CHUNK.findall(t) for w in lexicon.pretokens(c) if len(w.encode()) <= lexicon.WORD_BYTES)
    got = lexicon.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r["word"]: r["n"] for r in got} == want
