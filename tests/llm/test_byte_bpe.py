"""Byte-level BPE by a serialised sentencepiece model against the tiktoken library, and back to bytes."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from mediaseries.llm import byte_bpe, queries
from mediaseries.llm.byte_bpe import Codec, codec, decode, encode, read_ranks

RANKS, MULTI = (public_tokenizers.path(f"byte_bpe_{n}50k.tiktoken") for n in ("", "multi_"))
DOCS = "doc_id long, text string, decoded string, extra string"
TEXTS = [
    None,
    "",
    " ",
    "<|endoftext|> is ordinary",
    "don't we'LL",
    "a" * 5000,
    "\x00\x01\x1c \x85  　 x �",
    "日本語テキスト ١٢٣ 🎉🎉 ✋🏽",
    " \n \n  end  ",
    "same",
    "same",
]


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(None if k == 3 else k // 2, t, "d", "e") for k, t in enumerate(TEXTS)], DOCS)


@pytest.mark.parametrize("path", [RANKS, MULTI])
def test_ids_are_those_of_the_library(docs, path):
    want = library(path)
    got = decode(encode(docs, path, public_tokenizers.PATTERN), path).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in got) == sorted(
        (str(r["doc_id"]), want.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in docs.collect()
    )


def test_registered_query(spark):
    sf, want = "/root/testdata/sf0.001", library(RANKS)
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op12_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = want.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_every_entry_of_the_vocabulary_is_its_own_id():
    for path in (RANKS, MULTI):
        ranks = read_ranks(path)
        own, data = codec(path), list(ranks)
        merged = own._merged(data)
        assert all(own.whole.get(t, ids).tolist() == [ranks[t]] for t, ids in zip(data, merged))


def test_entries_that_merges_miss_and_ranks_with_holes():
    ranks = {bytes([b]): 3 * b for b in range(256)} | {b"abcd": 900, b"bc": 901, b"ab": 903}
    own = Codec(ranks)
    want = tiktoken.Encoding("own", pat_str=r"[a-e]+|[^a-e]+", mergeable_ranks={k: n for n, k in enumerate(sorted(ranks, key=ranks.get))}, special_tokens={})
    order = sorted(ranks.values())
    rng = random.Random(1)
    texts = ["abcd", "abcde", "abc", *("".join(rng.choices("abcde", k=rng.randrange(1, 12))) for _ in range(300))]
    assert [ids.tolist() for ids in own.encode(texts)] == [[order[k] for k in want.encode_ordinary(t)] for t in texts]
    assert bytes(own.decode(own.encode(["abcd"])[0])[0]) == b"abcd"


@pytest.mark.parametrize("ranks", [{b"a": 0}, {bytes([b]): 0 for b in range(256)}, {bytes([b]): b + (1 << 24) for b in range(256)}])
def test_other_vocabularies_are_refused(ranks):
    with pytest.raises(ValueError):
        byte_bpe.serialise(ranks)


def test_memory_begins_anew_and_long_texts_are_cut(docs, monkeypatch):
    """The same ids when little is remembered and texts are worked on alone."""
    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    monkeypatch.setattr(byte_bpe, "HELD", 7)
    texts = ["one two three four five " * 9, None, "x", "six seven eight nine", ""] * 3
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = [ids for b in byte_bpe._encoder(RANKS, public_tokenizers.PATTERN)(iter([batch])) for ids in b.column("ids").to_pylist()]
    assert got == [library(RANKS).encode_ordinary(t or "") for t in texts]


def test_empty_table_null_ids_and_unknown_ids(spark, docs):
    assert decode(encode(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [0])], "k int, ids array<int>")
    assert [r["decoded"] for r in decode(ids, RANKS).orderBy("k").collect()] == [None, bytearray(b""), bytearray(b"!")]
    with pytest.raises(Exception, match="an id that the vocabulary lacks"):
        decode(spark.createDataFrame([(1, [50256])], "k int, ids array<int>"), RANKS).collect()
    with pytest.raises(ValueError):
        encode(docs.withColumnRenamed("extra", "ids"), RANKS, public_tokenizers.PATTERN, ["ids"])
