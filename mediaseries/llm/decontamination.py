"""Benchmark decontamination by an FM-index over each shard of the training texts.

A shard is a bounded run of documents inside one task. Its words become symbols (words of no test item are one
separator, and runs shorter than the shortest phrase hold no match), a suffix array gives the Burrows-Wheeler
transform, a wavelet tree answers rank queries, and test phrases are searched backwards, all together. Occurrences are
located by walking to sampled suffix positions. Nothing is shuffled: documents stay where they are read, and the test
items come to them in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import FOLD_ARRAY, split_words

WINDOW = 10
#: Symbols of one shard's index, and characters of one block of test items.
SHARD_SYMBOLS = 1 << 20
BLOCK_CHARS = 4 << 20
SAMPLED = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of ``symbols`` in order, by prefix doubling. Each 0 is a separator unlike any other, ordered by place."""
    n = len(symbols)
    separators = symbols == 0
    rank = symbols.astype(np.int64) + int(separators.sum())
    rank[separators] = np.arange(int(separators.sum()))
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - step)] = rank[step:] + 1
        pair = rank * (n + 2 + int(rank.max(initial=0))) + follow
        order = np.argsort(pair, kind="stable")
        placed = pair[order]
        fresh = np.concatenate([[0], np.cumsum(placed[1:] != placed[:-1])]) if n else np.zeros(0, np.int64)
        rank[order] = fresh
        if not n or fresh[-1] == n - 1:
            return order
        step *= 2


class WaveletTree:
    """Rank and access over a sequence of symbols, one bit vector per level, the highest bit first."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = (current >> level & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int64))
            self.zeros.append(int(len(bits) - bits.sum()))
            current = np.concatenate([current[~bits], current[bits]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before ``at`` in a level's bit vector."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low, high = np.zeros_like(at), at
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            ones_low, ones_high = self._ones(k, low), self._ones(k, high)
            low = np.where(one, self.zeros[k] + ones_low, low - ones_low)
            high = np.where(one, self.zeros[k] + ones_high, high - ones_high)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for k in range(self.levels):
            ones = self._ones(k, at)
            one = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            symbol = symbol * 2 + one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return symbol


class FMIndex:
    """Count and locate over symbols > 0 with 0 as separator; the sequence must begin and end with a separator."""

    def __init__(self, symbols: np.ndarray, sampled: int = SAMPLED):
        order = suffix_array(symbols)
        self.tree = WaveletTree(symbols[order - 1].astype(np.int64))
        self.largest = int(symbols.max(initial=0))
        counts = np.bincount(symbols, minlength=self.largest + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.size = len(symbols)
        # Behind a separator a walk must stop: separators differ, but the transform writes all of them as 0.
        kept = (order % sampled == 0) | (symbols[order - 1] == 0)
        self.kept, self.kept_before, self.positions = kept, np.concatenate([[0], np.cumsum(kept)]), order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase; a row of ``phrases`` is one phrase, padded with 0 at its front."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for symbol in phrases.T[::-1]:
            live = np.flatnonzero((symbol > 0) & (low < high))
            known = symbol[live] <= self.largest
            high[live[~known]] = low[live[~known]]
            live = live[known]
            s = symbol[live]
            low[live], high[live] = self.first[s] + self.tree.rank(s, low[live]), self.first[s] + self.tree.rank(s, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, given their places in the order."""
        found, walked = np.zeros(len(rows), np.int64), 0
        waiting = np.arange(len(rows))
        while len(waiting):
            here = self.kept[rows]
            found[waiting[here]] = self.positions[self.kept_before[rows[here]]] + walked
            waiting, rows = waiting[~here], rows[~here]
            symbol = self.tree.access(rows)
            rows = self.first[symbol] + self.tree.rank(symbol, rows)
            walked += 1
        return found


class Phrases:
    """The windows of a block of items as symbols, and which items hold each."""

    def __init__(self, items: Sequence[tuple[str | None, str | None]], window: int = WINDOW):
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        self.symbols: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            words = tuple(self.symbols.setdefault(w, len(self.symbols) + 1) for w in split_words(text))
            for at in range(max(1, len(words) - window + 1) if words else 0):
                holders.setdefault(words[at : at + window], set()).update([number[name]] if name is not None else [])
        self.lengths = np.array([len(p) for p in holders], np.int64)
        self.shortest = int(self.lengths.min(initial=window))
        self.rows = np.zeros((len(holders), window), np.int64)
        for row, phrase in zip(self.rows, holders):
            row[window - len(phrase) :] = phrase
        self.holders = [sorted(h) for h in holders.values()]

    def read(self, words: Sequence[bytes]) -> np.ndarray:
        """A text's words as symbols, 0 for words of no item."""
        return np.fromiter(map(self.symbols.get, words, repeat(0)), np.int32, len(words))


def _shard_hits(phrases: Phrases, texts: Sequence[np.ndarray]) -> tuple[list[list[tuple[int, int]]], list[set[int]]]:
    """Merged spans of hit words and the items of each text, given as symbols."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    pieces, owner, first_word, at = [np.zeros(1, np.int32)], [], [], [1]
    for k, ids in enumerate(texts):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if high - low >= phrases.shortest:
                pieces += [ids[low:high], np.zeros(1, np.int32)]
                owner.append(k)
                first_word.append(low)
                at.append(at[-1] + high - low + 1)
    if not owner or not len(phrases.rows):
        return spans, items
    index = FMIndex(np.concatenate(pieces))
    low, high = index.search(phrases.rows)
    found = np.flatnonzero(high > low)
    sizes = (high - low)[found]
    phrase = np.repeat(found, sizes)
    rows = np.repeat(low[found], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = index.locate(rows)
    run = np.searchsorted(np.array(at), place, "right") - 1
    doc = np.array(owner)[run] if len(run) else run
    begin = np.array(first_word)[run] + place - np.array(at)[run] if len(run) else run
    for k, p in set(zip(doc.tolist(), phrase.tolist())):
        items[k].update(phrases.holders[p])
    order = np.lexsort((begin, doc))
    for k, low_word, high_word in zip(doc[order].tolist(), begin[order].tolist(), (begin + phrases.lengths[phrase])[order].tolist()):
        if spans[k] and low_word <= spans[k][-1][1]:
            spans[k][-1] = (spans[k][-1][0], max(spans[k][-1][1], high_word))
        else:
            spans[k].append((low_word, high_word))
    return spans, items


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _scan(block: Sequence[tuple[str | None, str | None]], window: int, columns: list[str], add: str):
    def scan(batches):
        phrases = Phrases(block, window)
        held, texts, symbols = [], [], 0

        def flush():
            spans, items = _shard_hits(phrases, texts)
            at = 0
            for batch in held:
                old = batch.column(batch.schema.get_field_index(f"{add}spans")).to_pylist()
                old_items = batch.column(batch.schema.get_field_index(f"{add}items")).to_pylist()
                n = batch.num_rows
                new = [merged([(s["low"], s["high"]) for s in o or []] + s) for o, s in zip(old, spans[at : at + n])]
                named = [sorted({*(o or []), *(phrases.names[i] for i in i_s)}) for o, i_s in zip(old_items, items[at : at + n])]
                yield pa.record_batch(
                    [*[batch.column(batch.schema.get_field_index(c)) for c in columns],
                     pa.array([len(t) for t in texts[at : at + n]], pa.int64()),
                     pa.array([[{"low": low, "high": high} for low, high in s] for s in new], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
                     pa.array(named, pa.list_(pa.string()))],
                    [*columns, f"{add}words", f"{add}spans", f"{add}items"],
                )
                at += n

        for batch in batches:
            at, texts_in = 0, batch.column(batch.schema.get_field_index("text"))
            for k, text in enumerate(texts_in):
                words = split_words(text.as_py())
                texts.append(phrases.read(words))
                symbols += len(words)
                if symbols >= SHARD_SYMBOLS:
                    held.append(batch.slice(at, k + 1 - at))
                    at = k + 1
                    yield from flush()
                    held, texts, symbols = [], [], 0
            if at < batch.num_rows:
                held.append(batch.slice(at))
        yield from flush()

    return scan


def find_contamination(docs: DataFrame, items: DataFrame, columns: Sequence[str], window: int = WINDOW, prefix: str = "hit_") -> DataFrame:
    """``columns`` of every row of docs(text, ...) with where phrases of items(item_id, text) stand in its text.

    A phrase is any ``window`` consecutive words of an item, or all words of a shorter one. Adds ``hit_words`` (words
    of the text), ``hit_spans`` (merged runs of hit words, [low, high)) and ``hit_items`` (item_ids as sorted texts).
    NULL and empty texts have no words and no hits; items without words hit nothing; items with equal ids count as
    one, and items without id hit words but are not listed. Repeated documents each give a row; an empty table on either
    side gives no rows or no hits. Columns of ``docs`` with the names of the new ones are left out.
    """
    added = [f"{prefix}words", f"{prefix}spans", f"{prefix}items"]
    columns = [c for c in dict.fromkeys(columns) if c not in added]
    carried = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, "text"])])
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    chars = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    types = {f.name: f.dataType.simpleString() for f in carried.schema.fields}
    tail = f"`{added[0]}` long, `{added[1]}` array<struct<low:long,high:long>>, `{added[2]}` array<string>"
    found = carried.withColumn(added[1], F.lit(None).cast("array<struct<low:long,high:long>>")).withColumn(
        added[2], F.lit(None).cast("array<string>")
    )
    for k in range(blocks):
        block = [tuple(r) for r in sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        keep = list(dict.fromkeys([*columns, "text"])) if k < blocks - 1 else columns
        schema = "".join(f"`{c}` {types[c]}, " for c in keep) + tail
        found = found.mapInArrow(_scan(block, window, keep, prefix), schema)
    return found


def contamination_report(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, n_words, n_hit, n_items, items_sha256 (of the comma-joined sorted ids), contaminated."""
    found = find_contamination(docs, items, [key])
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s["high"] - s["low"])
    return found.select(
        key,
        F.col("hit_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def cut_words(text: str | None, spans: Sequence[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``spans`` and what stands between the words of one span."""
    if not text or not spans:
        return text
    data = text.encode()
    inside = np.concatenate([[False], FOLD_ARRAY[np.frombuffer(data, np.uint8)] != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for low, high in spans:
        out.append(data[at : starts[low]])
        at = int(ends[high - 1])
    return b"".join([*out, data[at:]]).decode()


def remove_contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with every hit span cut from ``text``; other texts, rows and columns stay as they are."""
    columns = docs.columns
    found = find_contamination(docs, items, columns, prefix="__hit_")
    at = columns.index("text")

    def cut(batches):
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("__hit_spans")).to_pylist()
            texts = [cut_words(t.as_py(), [(s["low"], s["high"]) for s in s_]) for t, s_ in zip(batch.column(at), spans)]
            kept = [batch.column(i) for i in range(len(columns))]
            kept[at] = pa.array(texts, pa.string())
            yield pa.record_batch(kept, columns)

    return found.mapInArrow(cut, docs.schema)
