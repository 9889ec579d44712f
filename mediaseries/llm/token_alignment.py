"""Tokens of two tokenizers over the same texts, aligned by their bytes.

Each task cuts its texts into tokens with both tokenizers, as byte ranges of the same string (a blank and the text). Where no
token of either can reach over a blank behind a non-blank, texts are encoded in parts between such blanks, and parts that occur again once. Two
as-of merges keyed by document give for each token's begin the other side's token that covers it; both directions together are
the overlaps. Where both sides end, a group ends. A chunk of texts then keeps each id pair once and its texts' counts of them;
pairs are counted over all chunks, and every chunk asks for the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .token_counts import byte_letters, pieces as parts_of
from .words import pack, slices, unpack

#: Characters whose texts are cut and merged together.
TOGETHER = 200_000
#: Characters of a chunk, whose pairs are asked for together.
CHUNK = 8_000_000
#: Characters of the parts a task remembers; beyond that it begins anew.
REMEMBERED = 4_000_000
#: A text's count of a pair: the pair's place in its chunk (as distance from the one before, in the same text), and the count.
_USES = np.dtype([("low", "u1"), ("mid", "u1"), ("high", "u2"), ("count", "<u4")])
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Side:
    """A tokenizer: ids of texts, and the bytes of each id.

    ``cuts`` says that a text has the ids of its parts one after the other, where parts begin at single blanks behind
    non-blanks and are encoded with a blank before them.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: dict[int, bytes], cuts: bool):
        self.encode, self.tokens, self.cuts = encode, tokens, cuts
        self.lengths = np.zeros(max(tokens) + 1, np.int64)
        self.lengths[list(tokens)] = [len(t) for t in tokens.values()]


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """A byte-level BPE file of the tokenizers library; it is given a blank and the text.

    Its own splitting pattern takes a blank only behind blanks or at a unit's begin, so that with it alone texts can be cut.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_padding()
    tokenizer.no_truncation()
    letters = {letter: byte for byte, letter in byte_letters().items()}
    tokens = {k: bytes(letters[c] for c in entry) if set(entry) <= letters.keys() else entry.encode() for entry, k in tokenizer.get_vocab().items()}
    made = json.loads(tokenizer.to_str())
    splits = made["pre_tokenizer"] or {}
    alone = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space")
    cuts = bool(alone and not made["normalizer"] and all(t["special"] for t in made["added_tokens"]))

    def whole(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(texts: list[str]) -> list[list[int]]:
        """Where the pattern is known, a blank and Latin letters are one unit of it, so the merges alone decide, and
        full stops and commas behind them are another."""
        out, rest, words, marks = [[]] * len(texts), [], {}, {}
        for k, text in enumerate(texts):
            word = text.rstrip(".,")
            if not cuts or not word.isalpha() or max(word) >= "\u0250":
                rest.append(k)
                continue
            ids = words.get(word)
            if ids is None:
                words[word] = ids = [t.id for t in merge(blank + word.encode().decode("latin-1").translate(byte_letter))]
            if len(word) < len(text):
                mark = text[len(word) :]
                if mark not in marks:
                    marks[mark] = whole([mark])[0]
                ids = ids + marks[mark]
            out[k] = ids
        for k, ids in zip(rest, whole([" " + texts[k] for k in rest])):
            out[k] = ids
        return out

    byte_letter, merge = byte_letters(), tokenizer.model.tokenize
    blank = byte_letter[32]
    return Side(encode, tokens, cuts)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """A sentencepiece model; it adds the blank itself.

    Where it normalises nothing, and no piece holds a blank behind another character, no merge reaches over such a blank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    tokens = {
        k: bytes([int(byte[1], 16)]) if (byte := _BYTE_PIECE.fullmatch(e)) else e.replace("▁", " ").encode() for k, e in enumerate(entries)
    }
    kept = {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}  # name, table, blank before, fewer blanks, blanks as U+2581: the last three are on unless set
    kept |= dict(_fields(dict(_fields(model.serialized_model_proto())).get(3, b"")))
    cuts = kept[1] == b"identity" and not kept[2] and (kept[3], kept[4], kept[5]) == (1, 0, 1) and not any("▁" in e.lstrip("▁") for e in entries)
    return Side(lambda texts: model.encode(texts, out_type=int, num_threads=1), tokens, cuts)


class Encoded:
    """Ids of the parts of texts on both sides, as far as they are remembered."""

    def __init__(self, *sides: Side):
        self.sides, self.cuts = sides, all(s.cuts for s in sides)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.size, self.good = 0, np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int64) for _ in self.sides]
        self.counts = [np.zeros(0, np.int64) for _ in self.sides]

    def parts(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        parts = parts_of(text)
        if len(parts) > 1 and not parts[-1]:  # a blank at the end stays with what it follows
            parts[-2:] = [parts[-2] + " "]
        return parts

    def places(self, parts: list[str]) -> np.ndarray:
        fresh = list(set(parts).difference(self.known))
        if fresh:
            want = [b" " + p.encode() for p in fresh]
            self.known.update(zip(fresh, range(len(self.good), len(self.good) + len(fresh))))
            good = np.ones(len(fresh), bool)
            for k, side in enumerate(self.sides):
                ids, at = side.encode(fresh), side.tokens.__getitem__
                good &= np.fromiter((b"".join(map(at, i)) == w for i, w in zip(ids, want)), bool, len(fresh))
                self.counts[k] = np.concatenate([self.counts[k], np.fromiter(map(len, ids), np.int64, len(ids))])
                self.ids[k] = np.concatenate([self.ids[k], np.fromiter(chain.from_iterable(ids), np.int64)])
            self.good = np.concatenate([self.good, good])
            self.size += sum(map(len, fresh))
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def tokens(self, k: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts on a side one after the other, and the number of each."""
        counts = self.counts[k][places]
        behind, starts = np.cumsum(counts), np.cumsum(self.counts[k]) - self.counts[k]
        return self.ids[k][np.arange(behind[-1]) + np.repeat(starts[places] - behind + counts, counts)], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which texts have tokens, and for both sides the ids of those texts and the number of each."""
        parts = [self.parts(t) for t in texts]
        places = self.places(list(chain.from_iterable(parts)))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.cumsum(sizes) - sizes
        good = np.logical_and.reduceat(self.good[places], at) & np.fromiter(map(bool, texts), bool, len(texts))
        found = []
        if good.any():
            places, sizes = places[np.repeat(good, sizes)], sizes[good]
            for k in range(len(self.sides)):
                ids, counts = self.tokens(k, places)
                found.append((ids, np.add.reduceat(counts, np.cumsum(sizes) - sizes)))
        if self.size > REMEMBERED:
            self.clear()
        return np.flatnonzero(good), found


def covering(doc: np.ndarray, start: np.ndarray, other_doc: np.ndarray, other_start: np.ndarray) -> np.ndarray:
    """For each token of one side the place of the other side's token of its text that covers its begin.

    Begins are counted over all texts, so that both sides are sorted by them, and rise within a side.
    """
    left = pd.DataFrame({"start": start, "doc": doc})
    right = pd.DataFrame({"start": other_start, "doc": other_doc, "place": np.arange(len(other_start))})
    return pd.merge_asof(left, right, on="start", by="doc")["place"].to_numpy(np.int64)


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of tokens of the two sides whose ranges overlap, each once.

    The later begin of an overlapping pair lies in the other token, so the two directions find all; tokens that begin
    together are found by both and taken from the first.
    """
    in_b = covering(doc_a, start_a, doc_b, start_b)
    in_a = covering(doc_b, start_b, doc_a, start_a)
    later = start_a[in_a] != start_b
    return np.concatenate([np.arange(len(start_a)), in_a[later]]), np.concatenate([in_b, np.flatnonzero(later)])


def _ends(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts of all ids, where they begin and end over all texts."""
    end = np.cumsum(lengths[ids])
    return np.repeat(np.arange(len(counts)), counts), end - lengths[ids], end


class Names:
    """Ids as they are written in groups: followed by a comma, or as the last of their side by a bar (A) or a semicolon (B)."""

    def __init__(self, a: Side, b: Side):
        self.kinds = np.cumsum([0, len(a.lengths), len(a.lengths), len(b.lengths)])
        names = [b"%d%s" % (k, end) for side, end in ((a, b","), (a, b"|"), (b, b","), (b, b";")) for k in range(len(side.lengths))]
        self.lengths = np.fromiter(map(len, names), np.int64, len(names))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(names), np.uint8)

    def write(self, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The names one after the other, and where each ends."""
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[codes] - ends + lengths, lengths)].tobytes(), ends


def _grouped(a: np.ndarray, end_a: np.ndarray, doc_a: np.ndarray, b: np.ndarray, end_b: np.ndarray, names: Names, texts: int) -> tuple[list[bytes], np.ndarray]:
    """The groups of each text, written out, and their number. Ends are counted over all texts; a text ends in a group's end."""
    last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    before = np.cumsum(size_b) - size_b  # tokens of B in earlier groups
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + before[group_a]] = a + names.kinds[last_a.astype(int)]
    codes[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = b + names.kinds[2 + last_b.astype(int)]
    groups = np.bincount(doc_a[last_a], minlength=texts)
    tokens = np.cumsum(size_a + size_b)[np.cumsum(groups) - 1]
    data, ends = names.write(codes)
    at = [0, *ends[tokens - 1].tolist()]
    return [data[low : high - 1] for low, high in zip(at, at[1:])], groups


def _chunks(a_path: str, b_path: str, digest: bool, chunk: int):
    """Rows of documents to one row per chunk: its documents, its distinct pairs with their counts, its texts' uses of them."""

    def run(batches):
        a_side, b_side = byte_level(a_path), pieces(b_path)
        encoded, names, ids_b = Encoded(a_side, b_side), Names(a_side, b_side), len(b_side.lengths)
        task, made = TaskContext.get().partitionId(), 0
        held, codes, counts, of, size = [], [], [], [], 0

        def align(rows):
            """Appends the documents of ``rows`` (their kept columns, text)."""
            good, tokens = encoded.encode([t or "" for _, t in rows])
            facts = {}
            if tokens:
                (a, n_a), (b, n_b) = tokens
                doc_a, start_a, end_a = _ends(a, n_a, a_side.lengths)
                doc_b, start_b, end_b = _ends(b, n_b, b_side.lengths)
                at_a, at_b = overlaps(doc_a, start_a, doc_b, start_b)
                written, groups = _grouped(a, end_a, doc_a, b, end_b, names, len(good))
                links = np.bincount(doc_a[at_a], minlength=len(good))
                uses = np.sort((doc_a[at_a] * len(a_side.lengths) + a[at_a]) * ids_b + b[at_b])
                first = np.flatnonzero(np.r_[True, uses[1:] != uses[:-1]])
                counts.append(np.diff(np.append(first, len(uses))))
                left, right = np.divmod(uses[first], ids_b)
                doc, left = np.divmod(left, len(a_side.lengths))
                codes.append(left << 32 | right)
                of.append(len(held) + good[doc])
                for k, text, *numbers in zip(good.tolist(), written, n_a, n_b, groups, links):
                    facts[k] = (*map(int, numbers), hashlib.sha256(text).hexdigest() if digest else text.decode())
            held.extend((*kept, *facts.get(k, (0, 0, 0, 0, ""))) for k, (kept, _) in enumerate(rows))

        def flush():
            nonlocal made, size
            code, count, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, counts, of))
            pairs, slot = np.unique(code, return_inverse=True)
            total = np.bincount(slot, count, len(pairs)).astype(np.int64)
            rank = np.empty(len(pairs), np.int64)  # frequent pairs come first, so that places take few bytes
            by_use = np.argsort(-total, kind="stable")
            rank[by_use] = np.arange(len(pairs))
            slot = rank[slot]
            order = np.lexsort((slot, doc))
            slot, count, doc = slot[order], count[order], doc[order]
            step = np.diff(slot, prepend=0)
            begins = np.flatnonzero(np.diff(doc, prepend=-1))
            step[begins] = slot[begins]
            uses = np.empty(len(step), _USES)
            uses["low"], uses["mid"], uses["high"], uses["count"] = step & 255, step >> 8 & 255, step >> 16, count
            row = {
                "chunk": [task << 32 | made],
                "docs": [held[:]],
                "used": [np.bincount(doc, minlength=len(held)).tolist()],
                "uses": [pack(uses)],
                "pairs": [pairs[by_use]],
                "counts": [total[by_use]],
            }
            made, size = made + 1, 0
            for x in (held, codes, counts, of):
                x.clear()
            return row

        group, chars = [], 0
        for batch in slices(batches):
            kept = [n for n in batch.schema.names if n != "text"]
            for row in zip(zip(*(batch.column(n).to_pylist() for n in kept)), batch.column("text").to_pylist()):
                n = len(row[1] or "") + 16
                if group and chars + n > TOGETHER:
                    align(group)
                    group, chars = [], 0
                if size and size + n > chunk:
                    if group:
                        align(group)
                    group, chars = [], 0
                    yield flush()
                group.append(row)
                chars, size = chars + n, size + n
        if group:
            align(group)
        if held:
            yield flush()

    return run


def _answers(names: list[str], kinds: pa.Schema):
    """Chunks with the answers to their pairs, to a row for each document."""

    def run(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            docs, answers = row["docs"], batch.column("answers")[0].values
            if answers is not None and len(answers):
                slot = answers.field("slot").to_numpy()
                total, best = np.empty(len(slot), np.int64), np.empty(len(slot), np.int64)
                total[slot], best[slot] = answers.field("total").to_numpy(), answers.field("best").to_numpy(zero_copy_only=False)
                uses = unpack(row["uses"], _USES)
                count = uses["count"].astype(np.int64)
                step = uses["low"].astype(np.int64) | uses["mid"].astype(np.int64) << 8 | uses["high"].astype(np.int64) << 16
                ends = np.cumsum(row["used"])
                at = np.cumsum(step)
                begins = ends - row["used"]
                at -= np.repeat(np.concatenate([[0], at])[begins], row["used"])
                n_best = np.concatenate([[0], np.cumsum(count * best[at])])
                sums = np.concatenate([[0], np.cumsum(count * total[at])])
                n_best, sums = n_best[ends] - n_best[begins], sums[ends] - sums[begins]
            else:
                n_best = sums = np.zeros(len(docs), np.int64)
            found = [{**d, "n_best": int(n), "count_sum": int(s)} for d, n, s in zip(docs, n_best, sums)]
            yield pa.RecordBatch.from_pylist(found, kinds)

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, keep: list[str] = ["doc_id"], digest: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links, groups, n_best, count_sum for every row of ``docs``.

    ``a_path`` is a byte-level BPE file of the tokenizers library, ``b_path`` a sentencepiece model; workers have both. ``groups``
    is the alignment written out, ``a1,a2|b1;a3|b2,b3`` in decimal ids (with ``digest`` its SHA-256 in hex, which keeps
    what is staged small). n_links counts overlapping pairs of tokens; n_best of them are links whose id pair is corpus-wide the most
    frequent of its B id (ties included); count_sum adds up the corpus-wide counts of their id pairs.

    NULL and empty texts, and texts whose tokens are not the bytes of a blank and the text, have zeros and an empty
    ``groups``. Rows with equal or NULL keys each give a row and all count in the corpus; an empty table gives none.
    Columns beside ``keep`` and text are ignored; a kept column must not bear a result's name. Nothing is broadcast.
    Python holds a chunk's pairs (of ``chunk`` characters, or of one text that is longer).
    """
    results = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    if {"text", *results} & set(keep):
        raise ValueError("a kept column bears the name of a result")
    kinds = [(f"`{k}`", docs.schema[k].dataType.simpleString()) for k in keep]
    facts = [*kinds, *((n, "string" if n == "groups" else "long") for n in results[:5])]
    names = [n.strip("`") for n, _ in facts]
    doc = "struct<" + ", ".join(f"{n}: {t}" for n, t in facts) + ">"
    spec = f"chunk long, docs array<{doc}>, used array<int>, uses binary, pairs array<long>, counts array<long>"
    kind = pa_schema(docs.sparkSession, spec)

    def cut(batches, run=_chunks(a_path, b_path, digest, chunk)):
        for row in run(batches):
            row["docs"] = [[dict(zip(names, d)) for d in row["docs"][0]]]
            yield pa.RecordBatch.from_pydict(row, kind)

    chunks = stage(docs.select(*[k for k, _ in kinds], "text").mapInArrow(cut, spec), "aligned-chunks")
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("slot", "p")).select(
        "chunk", "slot", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n")
    )
    counted = stage(asked.groupBy("pair").agg(F.sum("n").alias("total")), "aligned-pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counted.groupBy(b_id.alias("b")).agg(F.max("total").alias("most"))
    counted = counted.join(most, b_id == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    answers = asked.select("chunk", "slot", "pair").join(counted, "pair")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("slot", "total", "best")).alias("answers"))
    met = chunks.select("chunk", "docs", "used", "uses").join(answers, "chunk", "left")
    out = ", ".join(f"{n} {t}" for n, t in [*facts, ("n_best", "long"), ("count_sum", "long")])
    return met.select("docs", "used", "uses", "answers").mapInArrow(_answers(names, pa_schema(docs.sparkSession, out)), out)


def pa_schema(spark, spec: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(spec))
