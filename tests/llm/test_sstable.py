import io
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldlake.llm import sstable as S
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
VOCABULARY = PLAIN.to_str()
ENCODER = S.Encoder(VOCABULARY, 2)


def ids(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab '.,\n\t\r\x00é日😀1<|endoftext|> \xa0"), max_size=30))
def test_pieces_encode_as_the_whole(t):
    assert np.frombuffer(ENCODER([t])[0], "<u2").tolist() == ids(t)


def test_special_token_strings_are_what_the_library_gives():
    assert np.frombuffer(ENCODER(["hello <|endoftext|> world"])[0], "<u2").tolist() == [31373, 220, 50256, 995]


def test_letters_are_letters_for_the_tokenizer():
    """Each letter that the fast way takes does not end a word of the tokenizer's pattern."""
    letters = [c for c in map(chr, range(ord(S.Encoder.LETTERS))) if c.isalpha()]
    for c in letters:
        assert len(PLAIN.pre_tokenizer.pre_tokenize_str(f" a{c}a")) == 1, c
    assert [np.frombuffer(b, "<u2").tolist() for b in ENCODER([f"a{c} b{c}c" for c in letters])] == [ids(f"a{c} b{c}c") for c in letters]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab '.,\n\té日1<|endoftext|> "), max_size=30), max_size=6))
def test_counts(texts):
    assert ENCODER.count(texts).tolist() == [len(ids(t)) for t in texts]


def test_other_tokenizers_encode_whole():
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    e = S.Encoder(other.to_str(), 2)
    assert not e.pieces and np.frombuffer(e(["Some words, here."])[0], "<u2").tolist() == other.encode("Some words, here.", add_special_tokens=False).ids


def test_encoder_cache_limit():
    e = S.Encoder(VOCABULARY, 4)
    e.CACHE = 2
    texts = ["a b c d e f", "g h i j\nk l", "a b c", "m n o p q r s"]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in e(texts)] == [ids(t) for t in texts]


def shard(entries, block=64, width=2):
    out = io.BytesIO()
    w = S.Writer(out, width, block)
    for k, v in entries:
        w.add(S.key_of(k), np.array(v, f"<u{width}").tobytes())
    w.close()
    return S.Reader(io.BytesIO(out.getvalue())), out.getvalue()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 60000), max_size=40)), max_size=40), st.sampled_from([16, 64, 4096]))
def test_round_trip_and_lookup(entries, block):
    entries.sort(key=lambda e: S.key_of(e[0]))
    r, _ = shard(entries, block)
    assert [(i, v.tolist()) for i, v in r] == entries
    for key in {e[0] for e in entries}:
        assert sorted(v.tolist() for v in r.lookup(key)) == sorted(v for i, v in entries if i == key)
    assert r.lookup(12345678901) == [] or any(i == 12345678901 for i, _ in entries)
    assert r.entries == len(entries) and r.ids == sum(len(v) for _, v in entries)


def test_bloom_filter_and_damage():
    r, data = shard([(i, [i % 7]) for i in range(0, 20000, 2)], 4096)
    assert len(r.blocks) > 10 and all(r.may_have(i) for i in range(0, 20000, 2))
    assert sum(r.may_have(i) for i in range(1, 20000, 2)) / 10000 < 0.03
    bad = bytearray(data)
    bad[10] ^= 255
    with pytest.raises(ValueError):
        list(S.Reader(io.BytesIO(bytes(bad))))
    for junk in (b"", b"x" * 200):
        with pytest.raises(ValueError):
            S.Reader(io.BytesIO(junk))


def expected(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        v = [*ids(t or ""), 0]
        out.append((i, start, len(v), crc32(np.array(v, "<u4").tobytes())))
        start += len(v)
    return out


def test_odd_documents(spark, make):
    folder = S.new_folder(spark, "sst-test")
    m = S.build(make(ODD), PATH, folder, shard_bytes=100_000)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in S.read(m).collect()), key=lambda r: r[1])
    assert got == expected(ODD)
    assert S.lookup(m, 7)[0].tolist() == [*ids("é😀 ñ ß"), 0] and S.lookup(m, 999) == [] and len(S.lookup(m, 5)) == 3
    assert S.read(S.build(make([]), PATH, folder)).count() == 0


def test_runs_of_one_id_are_cut(spark, make):
    """A third of the rows have no id and one text; they go to several shards and keep the order."""
    rows = [(None, "the same words " * 20)] * 200 + [(7, f"text {i} " * 30) for i in range(200)] + [(i, "x y z") for i in range(100, 300)]
    m = S.build(make(rows), PATH, S.new_folder(spark, "sst-test"), shard_bytes=4000)
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in S.read(m).collect()))
    assert m.count() > 20 and m.agg(F.max("entries")).first()[0] < 300
    assert [g[1] for g in got] == [None] * 200 + [7] * 200 + list(range(100, 300))
    assert all(a + n == b for (a, _, n), (b, _, _) in zip(got, got[1:], strict=False))
    assert sorted(map(tuple, S.starts(m, 4).select("place", "start").collect())) == sorted(map(tuple, S.starts(m).select("place", "start").collect()))
    assert len(S.lookup(m, 7)) == 200


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in S.op4_token_ids(spark, sf).collect()) == expected(docs)
