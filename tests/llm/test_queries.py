"""Every registered query against its SQL, over the smallest whole tables; those without SQL against plain versions."""

import zlib

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from mediaseries.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(oracles.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, con, name):
    assert difference(queries.QUERIES[name](spark, SF), con, oracles.ORACLES[name]) is None


def test_token_counts_of_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    got = queries.op10_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), want, want > 512)


def test_toxicity_on_held_out_labels(spark):
    """Measured on the larger table, as the smallest has too few labels to learn from."""
    large = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, large).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in queries.table(spark, large, "labels").collect()}
    assert len(got) == queries.table(spark, large, "documents").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1
    held = [(got[i]["predicted"], t) for i, t in labels.items() if got[i]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.93
    assert sum(p for p, t in held if not t) <= 2
