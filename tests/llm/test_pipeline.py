"""The pipeline's stages against plain versions, each on what the one before it kept."""

import pytest

import corpus_pipeline
from mediaseries.llm import queries
from mediaseries.llm.decontamination import cut_words
from mediaseries.llm.mixing import mix_sources
from mediaseries.llm.words import split_words
from mediaseries.session import stage

SF = "/root/testdata/sf0.001"
COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns, by its name."""
    docs, found = queries.table(spark, SF, "documents"), {}
    found["documents"] = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF), f"test-{name}")
        found[name] = [tuple(r) for r in docs.collect()]
    return found


def test_order_and_columns(spark, kept):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "mixing"]
    assert all(len(r) == len(COLUMNS) for name in names[:-1] for r in kept[name])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=str) == sorted(kept["mixing"], key=str)


def test_toxicity_keeps_the_rest_as_it_is(spark, kept):
    predicted = {r["doc_id"]: r["predicted"] for r in queries.op5_toxicity(spark, SF).collect()}
    assert sorted(kept["toxicity"]) == sorted(r for r in kept["documents"] if not predicted[r[0]])


def test_one_document_of_each_group(kept):
    from test_bagminhash import plain_groups

    groups = plain_groups([(r[0], r[1]) for r in kept["toxicity"]])
    assert sorted(kept["near_dedup"]) == sorted(r for r in kept["toxicity"] if groups[r[0]] == r[0])


def test_documents_of_one_id_are_told_apart(spark):
    """Rows alike in id and text are one; an id's other text, and texts without an id, are documents of their own."""
    one, other, third = (" ".join(f"{name}{k}" for k in range(40)) for name in "abc")
    rows = [(1, one, "x"), (2, one, "x"), (2, other, "x"), (3, third, "z"), (3, third, "y"), (None, "d " + third, "x"), (None, "only here", "x"), (None, "only here", None), (4, None, "x"), (5, "", "x"), (5, "", "x")]
    docs = spark.createDataFrame([(k, t, "en", s, 1) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    kept = [(1, one, "x"), (2, other, "x"), (None, "only here", None), (4, None, "x"), (5, "", "x")]
    assert sorted(str(g) for g in got if third not in (g[1] or "")) == sorted(map(str, kept))
    assert [g for g in got if third in (g[1] or "")] == [(3, third, "y")]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_repeated_strings_are_cut(kept):
    seen, want = set(), []
    for row in sorted(kept["near_dedup"]):
        data = row[1].encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(data[at : at + 100])
        text = bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore")
        if text.strip() or not any(gone):
            want.append((row[0], text, *row[2:4], len(text)))
    assert sorted(kept["suffix_dedup"]) == want


def test_benchmark_passages_are_cut(spark, kept):
    windows = set()
    for item in queries.table(spark, SF, "benchmark").collect():
        words = split_words(item["text"])
        windows |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))}
    sizes, want, cut = {len(w) for w in windows}, [], 0
    for row in kept["suffix_dedup"]:
        words = split_words(row[1])
        hits = sorted((k, k + n) for n in sizes for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows)
        spans = []
        for low, high in hits:
            if spans and low <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], high))
            else:
                spans.append((low, high))
        text = cut_words(row[1], spans)
        cut += bool(spans)
        want.append((row[0], text, *row[2:4], len(text)))
    assert sorted(kept["decontamination"]) == sorted(want) and cut


def test_mix(spark, kept):
    docs = spark.createDataFrame(kept["decontamination"], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, mix_sources(docs).collect()), key=str) == sorted(kept["mixing"], key=str)
    assert {r[:5] for r in kept["mixing"]} <= set(kept["decontamination"])
