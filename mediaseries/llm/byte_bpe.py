"""Byte-level BPE encoding and decoding by a sentencepiece model that is written straight from a vocabulary of ranks.

A rank file lists byte strings with their ranks. Each becomes a piece of a BPE model: its bytes as printing letters, scored
by its negative rank, so that the model's best merge is the one of lowest rank. The model normalises nothing and adds no
blank. Texts are cut into pre-tokens by the pattern of the vocabulary, each is encoded by itself, and decoding looks the
ids' bytes up.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .token_counts import byte_letters
from .words import slices

#: Characters whose texts are encoded together, and of the pre-tokens a task remembers; beyond that it begins anew.
TOGETHER = 250_000
REMEMBERED = 16_000_000
#: Pre-tokens of one text that are held as strings at once.
HELD = 200_000
#: Ids decoded at once.
DECODED = 1_000_000
UNKNOWN = "<unk>"


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a rank file (base64, blank, rank) and their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, body: bytes) -> bytes:
    """A length-delimited field of a protocol buffer."""
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model: piece 0 is unknown, the others follow by rank.

    Field numbers are those of sentencepiece's published model format. Scores are 32-bit floats, exact below 2^24.
    """
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary holds every single byte")
    if len(set(ranks.values())) < len(ranks) or max(ranks.values()) >= 1 << 24 or min(ranks.values()) < 0:
        raise ValueError("ranks are distinct and from 0 to 2^24")
    letters = byte_letters()
    out = [_field(1, _field(1, UNKNOWN.encode()) + _flag(3, 2))]  # a piece of type unknown
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        piece = token.decode("latin-1").translate(letters).encode()
        out.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank)))
    trainer = _flag(3, 2) + _flag(4, len(ranks) + 1)  # model type BPE, size of the vocabulary
    normaliser = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)  # no blank before, none removed, none escaped
    return b"".join([*out, _field(2, trainer), _field(3, normaliser)])


class Codec:
    """Pre-tokens to ids and ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.letters = byte_letters()
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = np.array([-1, *(ranks[t] for t in tokens)], np.int32)  # by the model's index
        self.lengths = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.lengths[self.ids[1:]] = [len(t) for t in tokens]
        self.starts = np.zeros(len(self.lengths), np.int64)
        self.starts[self.ids[1:]] = np.cumsum([0, *(len(t) for t in tokens)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        found = self._merged(tokens)
        #: Entries of the vocabulary that merges of ranks do not reach; as a whole pre-token they are their own id.
        self.whole = {t: np.array([ranks[t]], np.int32) for t, ids in zip(tokens, found) if len(ids) != 1}

    def _merged(self, tokens: list[bytes]) -> list[np.ndarray]:
        found = self.model.encode([t.decode("latin-1").translate(self.letters) for t in tokens], out_type=int, num_threads=1)
        return [self.ids[f] for f in found]

    def encode(self, pretokens: list[str]) -> list[np.ndarray]:
        tokens = [p.encode() for p in pretokens]
        found = self._merged(tokens)
        return [self.whole.get(t, f) for t, f in zip(tokens, found)] if self.whole else found

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids`` one after the other, and the number of each."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or self.lengths[ids].min() < 0):
            raise ValueError("an id that the vocabulary lacks")
        lengths = self.lengths[ids]
        behind = np.cumsum(lengths)
        at = np.arange(behind[-1] if len(ids) else 0) + np.repeat(self.starts[ids] - behind + lengths, lengths)
        return self.bytes[at], lengths


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """Written and loaded once in a worker process."""
    return Codec(read_ranks(path))


class _Remembered:
    """Ids of the pre-tokens seen so far, one after the other in an array."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.store, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.size = 0

    def places(self, pretokens: list[str]) -> np.ndarray:
        fresh = list(set(pretokens).difference(self.known))
        if fresh:
            ids = self.codec.encode(fresh)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self.known.update(zip(fresh, range(len(self.counts), len(self.counts) + len(fresh))))
            self.starts = np.concatenate([self.starts, len(self.store) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.store = np.concatenate([self.store, *ids])
            self.size += sum(map(len, fresh))
        return np.fromiter(map(self.known.__getitem__, pretokens), np.int64, len(pretokens))

    def ids(self, places: np.ndarray) -> np.ndarray:
        counts = self.counts[places]
        behind = np.cumsum(counts)
        return self.store[np.arange(behind[-1] if len(places) else 0) + np.repeat(self.starts[places] - behind + counts, counts)]


def _encoder(path: str, pattern: str):
    def run(batches):
        import regex

        cut, held = regex.compile(pattern), _Remembered(codec(path))

        def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """All ids, and the number of each text's."""
            parts = [cut.findall(t) for t in texts]
            places = held.places(list(chain.from_iterable(parts)))
            each = np.concatenate([[0], np.cumsum(held.counts[places])])
            counts = np.diff(each[np.cumsum([0, *map(len, parts)])])
            return held.ids(places), counts

        def encoded_alone(text: str) -> tuple[np.ndarray, np.ndarray]:
            found, matches = [], (m.group() for m in cut.finditer(text))
            while part := list(islice(matches, HELD)):
                found.append(held.ids(held.places(part)))
                if held.size > REMEMBERED:
                    held.clear()
            ids = np.concatenate(found)
            return ids, np.array([len(ids)])

        def rows(batch, texts):
            ids, counts = encoded_alone(texts[0]) if len(texts[0]) > HELD else encoded(texts)
            if held.size > REMEMBERED:
                held.clear()
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
            return pa.record_batch([*(c for _, c in kept), column], [*(n for n, _ in kept), "ids"])

        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            low, size = 0, 0
            for at, text in enumerate(texts):
                if at > low and (size > HELD or size + len(text) > TOGETHER or len(text) > HELD):
                    yield rows(batch.slice(low, at - low), texts[low:at])
                    low, size = at, 0
                size += len(text)
            if texts:
                yield rows(batch.slice(low), texts[low:])

    return run


def _decoder(path: str):
    def run(batches):
        held = codec(path)
        for batch in slices(batches):
            lists = batch.column("ids")
            low, n = 0, batch.num_rows
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            while low < n:
                high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), DECODED, "right")))
                part, counts = lists.slice(low, high - low), sizes[low:high]
                data, lengths = held.decode(part.flatten().to_numpy(zero_copy_only=False))
                each = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
                column = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(each.astype(np.int64)), pa.py_buffer(data)])
                column = pc.if_else(pc.is_valid(part), column, None).cast(pa.binary())
                yield pa.record_batch([*batch.slice(low, high - low).columns, column], [*batch.schema.names, "decoded"])
                low = high

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] = ["doc_id"]) -> DataFrame:
    """The columns ``keep`` and ids array<int> for every row of ``docs``: the ranks of its text's tokens.

    ``ranks_path`` names a rank file in a place where every worker has it, ``pattern`` is the vocabulary's pattern for the regex
    library. Special tokens are not known: their strings are ordinary text. A NULL text counts as empty, with no ids; rows
    with equal or NULL keys each give a row; an empty table gives none; columns beside ``keep`` and text are ignored, and
    ``keep`` holds neither "text" nor "ids". A narrow map: nothing is shuffled. Texts beyond 200,000 characters are
    worked on alone, 200,000 pre-tokens at a time.
    """
    if {"text", "ids"} & set(keep):
        raise ValueError("keep holds neither text nor ids")
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ", ids array<int>"
    return docs.select(*[f"`{k}`" for k in keep], "text").mapInArrow(_encoder(ranks_path, pattern), schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (ids array<int> and any other columns) with decoded binary, the bytes of each row's ids.

    NULL ids give NULL, no ids no bytes. An id that the vocabulary lacks, or a NULL among ids, ends the job with an error:
    such ids are no encoding. A column named "decoded" is replaced. A narrow map.
    """
    held = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    return held.mapInArrow(_decoder(ranks_path), schema + ", decoded binary")
