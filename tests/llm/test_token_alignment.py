"""Alignment of two tokenizers against a plain version over all pairs of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from mediaseries.llm import queries
from mediaseries.llm.token_alignment import aligned, byte_level, overlaps, pieces

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


def plain(texts):
    """Rows in the order of ``texts``."""
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    docs, counts = [], Counter()
    for text in texts:
        text = text or ""
        sides = [tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)]
        ranges = []
        for side, ids in zip((byte_level(A), pieces(B)), sides):
            ends = np.cumsum([len(side.tokens[k]) for k in ids]).tolist()
            ranges.append([(k, e - len(side.tokens[k]), e) for k, e in zip(ids, ends)])
            if not text or b"".join(side.tokens[k] for k in ids) != (" " + text).encode():
                break
        else:
            links = [(a, b) for a, a0, a1 in ranges[0] for b, b0, b1 in ranges[1] if a0 < b1 and b0 < a1]
            counts.update(links)
            cuts = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
            groups, low = [], 0
            for cut in cuts:
                groups.append("|".join(",".join(str(k) for k, s, e in r if low <= s and e <= cut) for r in ranges))
                low = cut
            docs.append((len(sides[0]), len(sides[1]), ";".join(groups), len(cuts), links))
            continue
        docs.append((0, 0, "", 0, []))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(na, nb, ng, len(ls), g, sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls)) for na, nb, g, ng, ls in docs]


TEXTS = [
    None,
    "",
    " ",
    "Plain words, twice over. Plain words, twice over.",
    "Plain words, twice over. Plain words, twice over.",
    "Ünïcode déjà vu — 日本語テキスト 🎉🎉 ✋🏽 ١٢٣",
    "two  blanks   and\n\nlines\t ",
    "<s> </s> <|endoftext|> <0x41> ▁ stay text",
    "▁low bar of the pieces",
    "x" * 3000,
    "ＦＵＬＬ width and ﬁ ligature",
    "\x00\x01 controls",
]


def rows_of(frame):
    return sorted(tuple(str(r[c]) for c in ["doc_id", *RESULTS]) for r in frame.collect())


@pytest.mark.parametrize("chunk", [20, 8_000_000])
def test_against_all_pairs(spark, chunk):
    texts = TEXTS + [r["text"] for r in queries.table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").limit(40).collect()]
    want = plain(texts)
    assert sum(w[0] > 0 for w in want) > 30 and [w for w in want[:3]][0][:2] == (0, 0)
    docs = spark.createDataFrame([(None if k == 4 else k // 2, t, "c", "s", "p") for k, t in enumerate(texts)], "doc_id long, text string, chunk string, slot string, pair string")
    got = rows_of(aligned(docs.repartition(3), A, B, chunk=chunk))
    assert got == sorted(tuple(map(str, (None if k == 4 else k // 2, *w))) for k, w in enumerate(want))


def test_registered_query(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").collect()
    want = plain([r["text"] for r in docs])
    got = {r["doc_id"]: r for r in queries.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r, w in zip(docs, want):
        digest = hashlib.sha256(w[4].encode()).hexdigest() if w[0] else ""
        assert tuple(got[r["doc_id"]][c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")) == (*w[:4], digest, *w[5:])


def test_overlaps_of_random_cuts():
    rng = random.Random(4)
    for _ in range(50):
        docs = [(sorted({0, *rng.choices(range(n), k=rng.randrange(n))}), sorted({0, *rng.choices(range(n), k=rng.randrange(n))}), n) for n in (3, 9, 20)]
        base = np.cumsum([0, *(n for _, _, n in docs)])
        sides = [(np.repeat(range(3), [len(d[s]) for d in docs]), np.concatenate([b + np.array(d[s]) for b, d in zip(base, docs)])) for s in (0, 1)]
        ends = [np.append(start[1:], base[-1]) for _, start in sides]
        got = sorted(zip(*map(np.ndarray.tolist, overlaps(*sides[0], *sides[1]))))
        want = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if sides[0][1][i] < ends[1][j] and sides[1][1][j] < ends[0][i]]
        assert got == want


def test_empty_tables_and_clashing_keys(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert aligned(empty, A, B).count() == 0 and aligned(empty, A, B).columns == ["doc_id", *RESULTS]
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(aligned(only, A, B)) == [(str(k), "0", "0", "0", "0", "", "0", "0") for k in (1, 2)]
    with pytest.raises(ValueError):
        aligned(empty.withColumnRenamed("doc_id", "groups"), A, B, ["groups"])
