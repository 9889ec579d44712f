"""Repeated byte strings against a plain scan over all strings."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from mediaseries.llm import suffix_dedup
from mediaseries.llm.suffix_dedup import anchors, multikey_quicksort, remove_repeats, repeat_report

SCHEMA = "doc_id long, text string, extra int"


def plain(rows, length):
    """kept bytes, removed, spans of each distinct (doc_id, text), in their order."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if (doc_id, text) in out:
            continue
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            string = data[at : at + length]
            if string in seen:
                gone[at : at + length] = True
            seen.add(string)
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id, text] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def documents(seed, length):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñ ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    passage = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            text = rng.choice(passage)
            cut = rng.randint(0, len(text) // 3)
            parts += [text[cut : len(text) - rng.randint(0, 20)], rng.choice(words)]
        rows.append((k, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "ab" * 400), (103, "x" * 350), (104, "x" * 99), (105, None), (106, "")]
    rows += [(107, rows[5][1]), (107, rows[5][1]), (None, rows[6][1] + " tail"), (108, "x" * 100)]
    return rows


@pytest.mark.parametrize("seed, length, gram", [(1, 100, 24), (2, 30, 8), (3, 16, 11), (4, 400, 24)])
@pytest.mark.parametrize("parts", [1, 7])
def test_against_all_strings(spark, seed, length, gram, parts):
    rows = documents(seed, length)
    want = plain(rows, length)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA).repartition(parts)
    got = repeat_report(docs, length=length, gram=gram).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(
        (i is None, i or 0, *want[i, t]) for i, t in rows
    )


def test_long_strings_and_copies_over_many_buckets(spark, monkeypatch):
    """Strings of 400 bytes in passages of 1500, and a third of all rows copies of one text, dealt out by their ids."""
    monkeypatch.setattr(suffix_dedup, "ROWS_A_BUCKET", 5)
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, copied = letters(1500), letters(900)
    rows = [(k, copied if k % 3 == 0 else letters(200) + (passage if k % 3 == 1 else "") + letters(100)) for k in range(60)]
    want = plain(rows, 400)
    got = repeat_report(spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA).repartition(6), length=400).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted((i, *want[i, t]) for i, t in rows)
    ids, hashes = np.arange(3000), np.full(3000, 7)
    assert np.bincount(suffix_dedup.bucket_of(ids, hashes, 10)).max() < 400
    for length in (10, 20_000):
        with pytest.raises(ValueError):
            repeat_report(spark.createDataFrame([], SCHEMA), length=length)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    at = np.array([0, 20, 4200, 4200, 5000])
    text, place, _, first, last = anchors(data, at, 100, 24)
    starts = sorted((int(t), s) for t, a, b in zip(text, first, last) for s in range(a, b + 1))
    assert starts == [(1, s) for s in range(4180 - 99)] + [(3, s) for s in range(800 - 99)]
    assert ((first <= place) & (last <= place) & (place - first <= 76)).all()


def test_multikey_quicksort_orders_bytes():
    rows = np.random.default_rng(2).integers(0, 3, (4000, 20)).astype(np.uint8)
    in_order = [rows[i].tobytes() for i in multikey_quicksort(rows)]
    assert in_order == sorted(in_order)


def test_removal_keeps_rows_and_columns(spark):
    passage = "the same passage of more than one hundred bytes that stands in two documents of this table, é at its end é"
    rows = [(1, "first " + passage, 7), (2, passage + " second", 8), (3, passage, 9), (4, "", None), (5, None, 1)]
    got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[1]["text"] == rows[0][1] and got[2]["text"].endswith(" second") and "passage" not in got[2]["text"]
    assert got[4]["text"] == "" and got[5]["text"] is None and got[2]["extra"] == 8


def test_empty_table(spark):
    assert repeat_report(spark.createDataFrame([], SCHEMA)).count() == 0


def peak(work, *args):
    """Bytes that ``work`` takes at most, beside its arguments."""
    tracemalloc.start()
    try:
        work(*args)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_beside_held_suffixes():
    """Suffixes are compared without copies of the bytes around them, and hashes of a text lie there for one piece at a time."""
    n, rng = 60_000, np.random.default_rng(3)
    around = np.tile(rng.integers(97, 123, (n // 2, 176)).astype(np.uint8), (2, 1))
    ids, back = np.arange(n), np.full(n, 76)
    assert peak(suffix_dedup.repeated, ids, ids, ids, back - 20, back, around) < 2.2 * around.nbytes
    data = rng.integers(97, 123, 1 << 22).astype(np.uint8)
    assert peak(anchors, data, np.array([0, len(data)])) < 12 * len(data)


@pytest.mark.parametrize("length, limit", [(100, 500), (400, 113)])
def test_a_task_holds_no_more_suffixes_than_it_may(monkeypatch, length, limit):
    """Whatever lies in a batch, and the fewer the longer their strings are; none is left out or compared twice."""
    monkeypatch.setattr(suffix_dedup, "HELD_SUFFIXES", 500)
    seen, compare = [], suffix_dedup.repeated

    def watched(ids, hashes, places, nearest, furthest, around, length):
        seen.append((len(ids), len(around), list(zip(ids.tolist(), places.tolist()))))
        return compare(ids, hashes, places, nearest, furthest, around, length)

    monkeypatch.setattr(suffix_dedup, "repeated", watched)
    texts = ["".join(random.Random(k).choices("abcdefgh ", k=4000)) for k in range(8)]
    marks, want = [], []
    for k, text in enumerate(texts):
        _, place, _, first, last = anchors(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), length)
        mark = np.empty(len(place), suffix_dedup._PLACE)
        mark["place"], mark["back"], mark["span"] = place, place - first, last - first
        marks.append(mark.tobytes())
        want += [(k, p) for p in place.tolist()]
    rows = pa.array([{"text": t} for t in texts])
    batch = pa.record_batch([pa.array(range(8), pa.int64()), pa.array(range(8), pa.int64()), rows, pa.array(marks, pa.binary())], ["__id", "__hash", "row", "marks"])
    sent = list(suffix_dedup._send_suffixes([], length, 24)(batch.slice(k, 1) for k in range(8)))
    assert [x for _, _, held in seen for x in held] == want and len(seen) > 1
    assert all(n == m <= limit for n, m, _ in seen)
    assert sum(len(x) for b in sent for x in b.column(1).to_pylist()) == 40 * len(want)
