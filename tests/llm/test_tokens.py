"""Token counts, packing and wavelet shards against the library, piece by piece."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from odd_rows import LONG, ROWS
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeworks.llm import packing, token_counts, wavelet
from tapeworks.llm.encode import Encoder, pieces


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def enc(bpe):
    return Encoder(bpe)


def test_encoder_equals_library(enc, library, documents):
    assert enc.by_word
    texts = [r.text for r in documents.select("text").collect()]
    for text, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcXYZ '’.<|>\n\t éßÖ½²\xa0\x85\x1c\x1fΣσİ́​中"), st.characters(codec="utf-8")), max_size=60))
def test_encoder_any_text(bpe, library, text):
    got = _shared(bpe).encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == library(text)


def _shared(path, made={}):  # noqa: B006
    return made.setdefault(path, Encoder(path))


def test_pieces_are_safe(library):
    text = "don't stop, <|endoftext|> é½ " * 50
    assert "".join(pieces(text, 40)) == text
    assert sum((library(p) for p in pieces(text, 40)), []) == library(text)
    assert pieces("x" * 500, 40) == ["x" * 500]


def test_small_memo(enc, library, monkeypatch):
    monkeypatch.setattr("tapeworks.llm.encode.MEMO_WORDS", 5)
    for text in ("one two three four five six seven eight one two", "two, nine! ten; Two? one's don't-stop", "nine one 中文 two: naïve ÉTÉ. 中文 (x)"):
        for _ in range(2):
            assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == library(text)


def test_memo_keeps_what_is_in_use(monkeypatch):
    from tapeworks.llm.encode import Memo

    monkeypatch.setattr("tapeworks.llm.encode.MEMO_WORDS", 20)
    asked = []
    memo = Memo(lambda words: [asked.append(w) or w.encode() for w in words])
    for k in range(30):
        words = ["hot", "hot", *[f"w{k}-{i}" for i in range(9)]]
        assert memo.of(words) == [w.encode() for w in words]
        assert len(memo.new) + len(memo.old) <= 2 * (20 + len(words))
    assert asked.count("hot") == 1 and len(asked) == 1 + 30 * 9


def test_counts(odd, empty, bpe, library):
    got = sorted(map(tuple, token_counts.counts(odd, bpe, batch_bytes=100).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(library(t))) for i, t, *_ in ROWS), key=str)
    assert got == want
    assert token_counts.counts(empty, bpe).count() == 0


def test_counts_sentencepiece(odd):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = SentencePieceProcessor(model_file=path)
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.counts(odd, path).collect()), key=str)
    assert got == sorted(((i, len(model.encode(t or ""))) for i, t, *_ in ROWS), key=str)


def check_packing(rows, texts, library, size, end_id):
    """Every document's ids once, in order; every sequence gapless and within the size."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for key, own in texts.items():
        want = sorted([(k, at, len(ids[at:at + size]), crc(ids[at:at + size]))
                       for ids in ([*library(t), end_id] for t in own) for k, at in enumerate(range(0, len(ids), size))])
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in docs.pop(key)) == want
    assert not docs
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return seqs


def test_packing(odd, empty, bpe, library):
    texts = defaultdict(list)
    for i, t, *_ in ROWS:
        texts[i].append(t)
    for most in (1, 4, 512):
        rows = packing.digest(packing.pack(odd, bpe, size=64, open_bins=most)).collect()
        check_packing(rows, texts, library, 64, 1)
    assert packing.pack(empty, bpe).count() == 0


def test_packing_is_tight(documents, bpe, library):
    rows = packing.digest(packing.pack(documents.coalesce(1), bpe)).collect()
    seqs = check_packing(rows, {r.doc_id: [r.text] for r in documents.collect()}, library, 4096, 1)
    tokens = sum(r.length for r in rows)
    assert len(seqs) <= 1.05 * tokens / 4096 + 1


def test_best_fit_closes_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # the least space that fits, and full
    assert bins.place(8) == (2, 0)
    assert bins.place(9) == (3, 0)  # three open bins: the one with 1 free closes
    assert bins.place(1) == (2, 8)
    assert bins.place(2) == (0, 6)
    assert bins.place(10) == (4, 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 7, 300, 70_000, 2**32 - 1]), max_size=200))
def test_wavelet_block(ids):
    a = np.array(ids, "<u4")
    block = wavelet.Block(wavelet.build(a))
    assert block.all().tolist() == ids
    assert block.access(np.arange(len(ids))).tolist() == ids if ids else True
    for token in {*ids, 5}:
        at = [i for i, x in enumerate(ids) if x == token]
        assert block.count(token) == len(at)
        assert block.count(token, len(ids) // 2) == sum(i < len(ids) // 2 for i in at)
        assert block.places(token).tolist() == at


@pytest.mark.parametrize("block_tokens", [1, 50, 1 << 20])
def test_wavelet_files(spark, odd, bpe, library, tmp_path, block_tokens):
    path = f"{tmp_path}/w"
    wavelet.write(odd, path, bpe, block_tokens=block_tokens, shards=3)
    files = spark.read.parquet(path)
    got = sorted(wavelet.digest(wavelet.documents(files)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, *_ in ROWS), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted([(i, len(library(t)) + 1, crc([*library(t), 2])) for i, t, *_ in ROWS], key=str)
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=str) == want
    word = library("word")[0]
    where = [(i, k) for i, t, *_ in ROWS for k, x in enumerate([*library(t), 2]) if x == word]
    assert sorted((r.id, r.place) for r in wavelet.occurrences(files, [word]).collect()) == sorted(where)
    assert wavelet.counts(files, [word, 2, 7]).where("token <> 7").orderBy("token").collect() == [(2, len(ROWS)), (word, len(where))]


def test_wavelet_empty(spark, empty, bpe, tmp_path):
    wavelet.write(empty, f"{tmp_path}/e", bpe)
    assert wavelet.documents(spark.read.schema(wavelet.FIELDS).parquet(f"{tmp_path}/e")).count() == 0
    assert len(LONG) > 100_000
