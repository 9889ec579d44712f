"""Decontamination, toxicity, license scan, token counts and mixing on hand-made rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from mediaseries.llm import decontamination, licenses, mixing, token_counts as counting, toxicity
from mediaseries.llm.decontamination import FMIndex, WaveletTree, contamination_report, cut_words, remove_contamination, suffix_array
from mediaseries.llm.licenses import BASE, GATES, license_report, rules, scan_licenses
from mediaseries.llm.mixing import mix_sources, repetition_rates
from mediaseries.llm.token_counts import count_spliced, pieces, stable, token_counts
from mediaseries.llm.toxicity import folded, learn, score
from mediaseries.llm.words import split_words

DOCS = "doc_id long, text string, source string, copy string, n_words string, score string, hit_words string"
CLASH = ("s", "c", "w", "x", "h")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], DOCS)


# --- decontamination


def test_suffix_array_and_wavelet_tree():
    rng = np.random.default_rng(1)
    for size, kinds in ((1, 1), (50, 2), (400, 9)):
        symbols = np.r_[0, rng.integers(0, kinds + 1, size), 0]
        unique = symbols.astype(float) + np.where(symbols == 0, np.cumsum(symbols == 0) / 1000 - 1, 0)
        assert suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda k: unique[k:].tolist())
        tree = WaveletTree(symbols)
        at = np.arange(len(symbols))
        assert (tree.access(at) == symbols).all()
        for s in range(kinds + 1):
            assert tree.rank(np.full(len(at), s), at).tolist() == [int((symbols[:k] == s).sum()) for k in at]


def test_search_and_locate():
    rng = np.random.default_rng(2)
    symbols = np.r_[0, rng.integers(0, 4, 500), 0]
    index = FMIndex(symbols)
    for length in (1, 2, 3):
        for _ in range(20):
            phrase = rng.integers(1, 5, length)
            low, high = index.search(np.r_[np.zeros(3 - length, int), phrase][None])
            want = [k for k in range(len(symbols) - length + 1) if (symbols[k : k + length] == phrase).all()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def plain_hits(text, items):
    words = split_words(text)
    hit, names = set(), set()
    for name, item in items:
        own = split_words(item)
        for s in range(max(1, len(own) - 9) if own else 0):
            window = own[s : s + 10]
            for k in range(len(words) - len(window) + 1):
                if words[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    names |= {name} - {None}
    return len(words), len(hit), len(names), bool(hit)


def test_contamination_against_a_scan(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_SYMBOLS", 150)
    rng = random.Random(3)
    word = lambda: "wörd%d" % rng.randrange(30)
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 12, 30])))) for k in range(9)]
    items += [(20, None), (None, " ".join(word() for _ in range(14))), (items[5][0], items[5][1]), (21, "  ... ")]
    rows = []
    for k in range(60):
        text = [word() for _ in range(rng.choice([0, 4, 40, 90]))]
        for _ in range(rng.randint(0, 2)):
            own = rng.choice([t for _, t in items if t]).split()
            cut = rng.randrange(len(own)) if own and rng.random() < 0.5 else 0
            text[len(text) // 2 : len(text) // 2] = [w.upper().replace("Ö", "ö") for w in own[cut:]]
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(text)))
    rows += [(98, None), (99, ""), (3, rows[3][1]), (None, rows[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(None if i is None else str(i), t) for i, t in items]
    for block_chars in (1 << 20, 60):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", block_chars)
        got = contamination_report(frame(spark, rows), bench).collect()
        want = sorted((str(i), *plain_hits(t, named)) for i, t in rows)
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == want


def test_contamination_is_cut(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    rows = [(1, "Keep this: a b c d e f g h i j, K! l. And this."), (2, "a b c d e f g h i"), (3, None)]
    got = {r["doc_id"]: r for r in remove_contamination(frame(spark, rows), bench).collect()}
    assert got[1]["text"] == "Keep this: . And this." and got[2]["text"] == rows[1][1] and got[3]["text"] is None
    assert got[1]["hit_words"] == "h" and list(got[1].asDict()) == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert cut_words("é a b", [(0, 1)]) == " a b"
    assert contamination_report(frame(spark, []), bench).count() == 0
    assert {r["n_hit"] for r in contamination_report(frame(spark, rows), bench.limit(0)).collect()} == {0}


# --- toxicity


def test_folding():
    assert folded("You 1D10T! $tupid l0s3r іdіоt id​iot. 12 abc2") == " you idiot stupid loser idiot idiot 12 abc2 "
    assert folded("") == "  " and folded(" ,") == "  "


def test_learned_lexicon(spark):
    rng = random.Random(5)
    plain = lambda: " ".join(rng.choice(["tree", "river", "stone", "cloud", "house"]) for _ in range(rng.randint(5, 60)))
    rows, labels = [], []
    for k in range(300):
        toxic = k % 3 == 0
        rows.append((k, plain() + (" you " + rng.choice(["vile", "grubber", "snark"]) + " " + rng.choice(["vile", "snark"]) if toxic else "")))
        labels.append((k, int(toxic)))
    labels += [(0, 1), (None, 1), (1, None), (5000, 1)]
    docs = frame(spark, rows)
    model = learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {" vile ", " snark "} <= set(model.weights) and not any("tree" in e for e in model.weights)
    tests = [(1, "v1le snаrk"), (2, plain()), (3, None), (4, ""), (4, ""), (None, "vile vile vile"), (6, "word " * 300_000 + "vile")]
    got = {(r["doc_id"], r["toxic_words"]): r["score"] for r in score(frame(spark, tests), model, ["doc_id", "source"]).collect()}
    assert got[1, 2] >= 0.7 > 0.3 > got[2, len(tests[1][1].split())]
    assert got[3, 0] == got[4, 0] < 0.3 and got[None, 3] >= 0.7 and got[6, 300_001] < 0.3
    assert score(frame(spark, []), model, ["doc_id"]).count() == 0


def test_exceptions_spare_words(spark):
    docs = frame(spark, [(k, "trash" if k < 20 else "tidy") for k in range(60)])
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(60)], "doc_id long, toxic int")
    model = learn(docs, labels, exceptions=("trash can",))
    found = {r["doc_id"]: r["toxic_weight"] for r in score(frame(spark, [(1, "the trash-can here"), (2, "the trash here")]), model, ["doc_id"]).collect()}
    assert found[1] == 0 < found[2]
    none = learn(docs, labels.where("toxic = 0"))
    assert {r["score"] < 0.3 for r in score(docs, none, ["doc_id"]).collect()} == {True}


# --- licenses


def test_rules_are_gated():
    assert len(rules()) >= 200
    for rule in rules():
        assert any(word in rule["pattern"].replace("[cs]", "c") for word in ("licenc", "license")) or any(
            g in rule["pattern"] for g in (*GATES, "cc  by", "wtfpl", "rail", "mulan", "mit  no")
        ), rule


def test_every_spelling_holds_its_keyword(spark):
    texts = [
        ("released under the GNU GPL v3", "gpl", 0.85),
        ("PSF license", "psf-2.0", 0.85),
        ("openrail license", "openrail", 0.85),
        ("CreativeML OpenRAIL-M License", "openrail", 0.85),
        ("responsible ai license", "openrail", 0.85),
        ("open rail license", "openrail", 0.85),
        ("you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl", 0.9),
    ]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_report(frame(spark, [(k, t) for k, (t, _, _) in enumerate(texts)])).collect()}
    assert [got[k] for k in range(len(texts))] == [(label, weight) for _, label, weight in texts]


def test_license_report(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."),
        (2, "Mit License mit-license"),
        (3, "CC\nBY-NC 4.0 and cc by"),
        (4, "the license of nobody"), (5, None), (6, ""), (6, ""), (None, "mit license"),
        (8, "x " * 200_000 + "GNU General Public License"),
        (9, "gnu general public licenses; mit licensed; İ mit license"),
    ]
    got = [r.asDict() for r in license_report(frame(spark, rows)).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert (by[1]["base_labels"], by[1]["labels"], by[1]["n_base"], by[1]["first_word"]) == ("apache", "apache,apache-2.0", 1, 3)
    assert (by[2]["n_base"], by[2]["first_word"], by[2]["last_word"], by[2]["n_words"]) == (2, 0, 2, 4)
    assert (by[3]["base_labels"], by[3]["labels"], by[3]["n_base"], by[3]["last_word"]) == ("cc-by", "cc-by,cc-by-nc-4.0", 2, 6)
    assert (by[4]["n_base"], by[4]["first_word"], by[4]["score"]) == (0, None, 0.0)
    assert (by[5]["n_words"], by[5]["labels"]) == (0, "") and by[None]["base_labels"] == "mit"
    assert (by[8]["first_word"], by[8]["base_labels"], by[8]["n_words"]) == (200_000, "gpl", 200_004)
    assert by[9]["base_labels"] == "mit" and by[9]["n_base"] == 1
    assert set(BASE.values()) == {"gpl", "apache", "cc-by", "mit"} and license_report(frame(spark, [])).count() == 0


def plain_detections(text):
    """All rules on the spaced words, without keywords, and what stays of them."""
    spaced = " " + "  ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) + " "
    found = sorted(
        (m.start(), -m.end(), r["tier"], r["label"], r["weight"]) for r in rules() for m in re.finditer(r["pattern"], spaced)
    )
    kept, ends = [], [-1] * 6
    for low, back, tier, label, weight in found:
        if max(ends[: tier + 1]) < -back:
            kept.append((low, -back, tier, label, weight))
        ends[tier] = max(ends[tier], -back)
    return kept


@pytest.mark.parametrize("block", [3, 128])
def test_many_detections_in_one_text(spark, monkeypatch, block):
    """Positions and suppression over block after block, against all rules in a plain loop."""
    monkeypatch.setattr(licenses, "BLOCK", block)
    rng = random.Random(4)
    parts = ["MIT License", "mit", "licensed under the Apache License, Version 2.0", "GNU General Public License", "GPL", "cc by", "CC BY-SA 4.0", "the", "license", "free software"]
    rows = [(k, " ".join(rng.choices(parts, k=n))) for k, n in enumerate([0, 1, 2, 3, 4, 9, 40, 128, 129, 700])]
    for r in scan_licenses(frame(spark, rows)).collect():
        text = rows[r["doc_id"]][1]
        assert [tuple(d) for d in r["license_found"]] == plain_detections(text)
        words = re.findall(r"[a-z0-9]+", text.lower())
        base = sorted((k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert sorted(tuple(b) for b in r["license_base"]) == base


def test_a_text_of_many_licenses_takes_no_square(spark):
    """32,000 phrases in one text; folding them one by one into a growing array took minutes."""
    n = 32_000
    begin = time.perf_counter()
    r = license_report(frame(spark, [(1, "mit license and the " * n)])).first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["n_words"]) == (n, 0, 4 * n - 4, 4 * n) and time.perf_counter() - begin < 60


# --- token counts


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts():
    rng = random.Random(6)
    letters = "aabcdeé ñ  \n\t.,'’<|>1漢字 日 \x1c\x85"
    texts = ["", " ", "a", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "it's we'll  they're", "x" * 3000, "é" * 2000, "a b " * 900 + "  "]
    return texts + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 900))) for _ in range(60)] + ["漢" * 500 + " " + "b" * 900]


def test_spliced_counts_are_whole_counts(tokenizer):
    ends = lambda t: [e for _, e in tokenizer.encode(t, add_special_tokens=False).offsets]
    for text in odd_texts():
        want = len(tokenizer.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((40, 8), (100, 30), (64, 64), (7, 3)):
            if len(text) > chunk:
                assert count_spliced(ends, text, chunk, overlap) == want, (text, chunk, overlap)


def test_overlaps_are_widened_until_the_encodings_meet():
    """An encoding that goes wrong for so many characters behind a cut, up to the whole chunk and beyond."""
    text = "some words of a text that is cut " * 30
    right = [k for k, c in enumerate(text) if c == " " and k] + [len(text)]

    def ends(reach):
        def encode(part):
            at = text.find(part) if part != text else 0
            own = [k for k, c in enumerate(part) if c == " " and k] + [len(part)]
            return own if part == text or at == 0 else [k for k in own if k > reach]

        return encode

    for reach in (0, 20, 90, 150, 10_000):
        for chunk, overlap in ((200, 10), (100, 40), (400, 3)):
            assert count_spliced(ends(reach), text, chunk, overlap) == len(right), (reach, chunk, overlap)


def test_the_sample_of_the_lexicon_is_bounded(spark):
    """Few ids with many rows each: the sample has no more rows than asked for."""
    docs = spark.createDataFrame([(k % 4, f"idiot {k} words" if k % 4 == 1 else f"kind {k} words") for k in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(4)], "doc_id long, toxic int")
    seen = []
    inner = toxicity.stage

    def staged(df, name):
        out = inner(df, name)
        seen.append(out.count())
        return out

    toxicity.stage = staged
    try:
        model = learn(docs, labels, sample_rows=3000)
    finally:
        toxicity.stage = inner
    assert seen == [4000, 3000] and "idiot" in str(model.weights)


def test_pieces_join_to_the_text():
    for text in odd_texts():
        cut = pieces(text)
        assert " ".join(cut) == text
        at = 0
        for piece in cut[:-1]:
            at += len(piece)
            assert stable(text, at)
            at += 1


def test_counts_in_spark(spark, tokenizer, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(counting, "REMEMBERED", 50)
    rows = [*enumerate(odd_texts()), (500, None), (None, "null id"), (3, "again"), (700, "word " * 30_000)]
    got = token_counts(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), chunk_chars=500, overlap_chars=50).collect()
    want = sorted((str(i), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)


# --- mixing


def test_rates_and_copies(spark):
    rows = [(k, "text", "big" if k % 3 else "small", "old") for k in range(6000)] + [(k, None, None, "old") for k in range(6000, 6020)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string")
    targets = spark.createDataFrame([("big", 1.0), ("small", 2.0), ("small", 1.0), (None, 1.0), ("absent", 5.0)], "source string, weight double")
    rates = {r["__source"]: r["__rate"] for r in repetition_rates(docs, targets).collect()}
    assert rates == pytest.approx({"big": 6020 / 5 / 4000, "small": 6020 * 3 / 5 / 2000, None: 6020 / 5 / 20})
    mixed = mix_sources(docs, targets)
    got = mixed.collect()
    assert [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got) and mixed.columns == ["doc_id", "text", "source", "copy", "copy_", "shuffle_key"]
    counts = Counter(r["source"] for r in got)
    for source, want in (("big", 1204), ("small", 3612), (None, 1204)):
        assert abs(counts[source] - want) < 5 * math.sqrt(want)
    times = Counter(r["doc_id"] for r in got if r["source"] == "small")
    share = sum(1 for k in range(0, 6000, 3) if times[k] == 0) / 2000
    assert abs(share - math.exp(-rates["small"])) < 0.04
    assert {r["copy"] for r in got} == {"old"}
    assert sorted((r["doc_id"], r["copy_"]) for r in mix_sources(docs.repartition(5), targets).collect()) == sorted((r["doc_id"], r["copy_"]) for r in got)


def test_mix_keeps_columns_of_any_name(spark):
    names = ["__source", "__rate", "__count", "__draws", "__cdf", "__row", "__block", "__copy", "__order", "doc", "Copy", "shuffle_key", "copy_"]
    rows = [(k, "s" if k % 2 else None, *(f"{n} {k}" for n in names)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"`{n}` string" for n in names))
    for targets in (None, spark.createDataFrame([("s", 1.0)], "source string, weight double")):
        mixed = mix_sources(docs, targets)
        assert mixed.columns == [*docs.columns, "copy__", "shuffle_key_"]
        got = mixed.collect()
        assert got and all(tuple(r)[:-2] == rows[r["doc_id"]] for r in got)
        plain = mix_sources(docs.select("doc_id", "source"), targets).collect()
        assert [(r["doc_id"], r["copy__"], r["shuffle_key_"]) for r in got] == [(r["doc_id"], r["copy"], r["shuffle_key"]) for r in plain]


def test_copies_of_a_rare_source_are_dealt_out(spark):
    """A source of one document among 8,001 has the rate 4,000.5: its draws are made in blocks, and add up as in one row."""
    docs = spark.createDataFrame([(k, "much" if k else "rare") for k in range(8001)], "doc_id long, source string")
    rate = next(r for r in repetition_rates(docs, None).collect() if r["__source"] == "rare")
    assert rate["__rate"] == pytest.approx(4000.5) and rate["__draws"] == 501 > mixing.BLOCK
    want = sum(sum(c <= int(hashlib.md5(f"mix|0|{draw}".encode()).hexdigest()[:13], 16) / 2**52 for c in rate["__cdf"]) for draw in range(1, 502))
    got = [r["copy"] for r in mix_sources(docs).where("source = 'rare'").collect()]
    assert sorted(got) == list(range(1, want + 1)) and abs(want - 4000.5) < 5 * math.sqrt(4000.5)


def test_blocks_of_draws_change_nothing(spark, monkeypatch):
    rows = [(k, "much") for k in range(400)] + [(k, "rare") for k in (7, 7, 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    whole = mix_sources(docs).collect()
    monkeypatch.setattr(mixing, "BLOCK", 3)
    assert mix_sources(docs).collect() == whole and sum(r["source"] == "rare" for r in whole) > 100


def test_mix_of_odd_rows(spark):
    rows = [(1, "a", "s"), (1, "a", "s"), (None, None, "s"), (2, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = Counter((r["doc_id"], r["source"]) for r in mix_sources(docs).collect())
    assert times[1, "s"] % 2 == 0
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs, spark.createDataFrame([("s", 0.0), (None, None)], "source string, weight double")).count() == 0
