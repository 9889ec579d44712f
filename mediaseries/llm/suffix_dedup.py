"""Exact removal of repeated byte strings with a sparse, range-partitioned suffix array.

Every string of ``length`` bytes has an anchor: where the smallest hash of its short grams stands. Equal strings have
their anchors at the same place, so only suffixes that begin at anchors matter. One pass finds the grams that occur
twice anywhere; only their suffixes go on, with the bytes around them. Splitters taken from a sample of suffixes
range-partition them by their leading bytes. Each bucket sorts the bytes behind the anchors, and those before them read
backwards, by multikey quicksort; the common prefixes of neighbours then tell exactly which strings are equal, and
of equal strings all but the earliest are repeats.

Suffixes of one map task meet first: what repeats inside it is decided there, and only the earliest of equal strings
are sent on to be compared across tasks. So a passage that a third of all documents share reaches its bucket
once per task, however often it occurs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import give_back, mix, pack, slices, text_buffer, unpack

#: Bytes of a string that must not occur again, and of the grams that choose anchors.
LENGTH = 100
GRAM = 24
#: Bytes whose grams are hashed at a time; about a hundred bytes of memory each.
PIECE = 1 << 18
#: Anchors, and suffixes with their bytes, that a task holds at a time. Suffixes of longer strings are fewer, of the same size.
HELD_ANCHORS = 1_500_000
HELD_SUFFIXES = 150_000
#: Suffixes whose bytes, or rows of a matrix, are copied at a time.
BLOCK = 20_000
SAMPLE_TEXTS = 2000
SAMPLE_ANCHORS = 32
SMALL = 256
#: Documents whose anchors or suffixes meet in one group, on average; there are at least as many groups as shuffle partitions.
ROWS_A_BUCKET = 5_000
#: The span of an anchor that only stands for its hash; strings are shorter than this by far.
STAND_IN = (1 << 16) - 1
LONGEST = 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WANTED = np.dtype([("id", "<i8"), ("hash", "<i8"), ("place", "<u4"), ("back", "<u2"), ("span", "<u2")])
_PLACE = np.dtype([("place", "<u4"), ("back", "<u2"), ("span", "<u2")])
_SPAN = np.dtype([("id", "<i8"), ("hash", "<i8"), ("first", "<i8"), ("last", "<i8")])


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every place on, by doubling."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, at = np.zeros(n, np.uint64), 0, 0
    power, factor, width = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    with np.errstate(over="ignore"):
        while done < gram:
            if gram & width:
                total = total * factor + power[at : at + n]
                done += width
                at += width
            if done < gram:
                power = power[:-width] * factor + power[width:]
                factor, width = factor * factor, width * 2
    return mix(total)


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The anchors of all strings of ``length`` bytes inside the texts that ``at`` divides ``data`` into.

    Returns text, place in the text, hash, and the first and last string (by where it begins) whose anchor it is.
    Texts over ``PIECE`` bytes are worked on in overlapping pieces, so memory is bounded.
    """
    found: list[tuple[np.ndarray, ...]] = []
    texts, begins, ends = [], [], []
    for text, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        while high - low >= length:
            end = min(high, low + PIECE)
            texts.append(text)
            begins.append(low)
            ends.append(end)
            if end == high:
                break
            low = end - length + 1
    k = 0
    while k < len(texts):
        last = k
        while last + 1 < len(texts) and ends[last + 1] - begins[k] <= 2 * PIECE and begins[last + 1] >= begins[last]:
            last += 1
        found.append(_anchors_of(data, at, np.array(texts[k : last + 1]), np.array(begins[k : last + 1]), np.array(ends[k : last + 1]), length, gram))
        k = last + 1
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none, none
    return tuple(np.concatenate(part) for part in zip(*found))


def _anchors_of(data, at, texts, begins, ends, length, gram):
    base = int(begins[0])
    grams = gram_hashes(data[base : int(ends[-1])], gram)
    bits = np.uint64((1 << 22) - 1)
    lowest = (grams & ~bits) | np.arange(len(grams), dtype=np.uint64)
    width, window = 1, length - gram + 1
    while width * 2 <= window:
        lowest = np.minimum(lowest[:-width], lowest[width:])
        width *= 2
    if width < window:
        lowest = np.minimum(lowest[: len(lowest) - (window - width)], lowest[window - width :])
    sizes = ends - begins - length + 1
    starts = np.repeat(begins - base, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    place = (lowest[starts] & bits).astype(np.int64)
    fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    edge = np.flatnonzero(fresh)
    final = np.append(edge[1:], len(place)) - 1
    owner = texts[text[edge]]
    shift = base - at[owner]
    return owner, place[edge] + shift, grams[place[edge]], starts[edge] + shift, starts[final] + shift


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """The order of equally long byte strings: three-way partition by eight bytes at a time, equal ones by the next eight."""
    n, length = rows.shape
    width = -(-length // 8)
    padded = np.zeros((n, width * 8), np.uint8)
    padded[:, :length] = rows
    words = padded.view(">u8")
    out, filled, stack = np.empty(n, np.int64), 0, [(np.arange(n), 0)]
    while stack:
        part, depth = stack.pop()
        if depth == width or len(part) < 2:
            out[filled : filled + len(part)] = part
            filled += len(part)
        elif len(part) <= SMALL:
            text = padded[part].view(f"S{width * 8}").ravel()
            out[filled : filled + len(part)] = part[np.argsort(text, kind="stable")]
            filled += len(part)
        else:
            word = words[part, depth].astype(np.uint64)
            pivot = np.sort(word[[0, len(word) // 4, len(word) // 2, 3 * len(word) // 4, -1]])[2]
            less, more = word < pivot, word > pivot
            stack += [(part[more], depth), (part[~less & ~more], depth + 1), (part[less], depth)]
    return out


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each string in order shares with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int16)
    for low in range(1, len(order), BLOCK):
        high = min(low + BLOCK, len(order))
        same = rows[order[low:high]] == rows[order[low - 1 : high - 1]]
        out[low:high] = np.where(same.all(1), rows.shape[1], np.argmin(same, 1))
    return out


def repeated(ids, hashes, places, nearest, furthest, around, length: int = LENGTH) -> np.ndarray:
    """Which strings have an equal one that begins earlier (by id, hash, place).

    A suffix stands for the strings that begin ``nearest`` to ``furthest`` bytes before it; ``around`` holds for each
    the bytes before its place and behind it. Returns a matrix: suffix, bytes before.
    """
    n, reach = len(ids), around.shape[1] - length
    repeats = np.zeros((n, reach + 1), bool)
    if n < 2:
        return repeats
    turn, rank = np.lexsort((places, hashes, ids)), np.zeros(n, np.int64)
    same = np.logical_and.reduce([x[turn[1:]] == x[turn[:-1]] for x in (ids, hashes, places)])
    rank[turn[1:]] = np.cumsum(~same)
    behind, before = around[:, reach:], around[:, :reach][:, ::-1]
    by_behind, by_before = multikey_quicksort(behind), multikey_quicksort(before)
    behind_common, before_common = common_prefixes(behind, by_behind), common_prefixes(before, by_before)
    group_behind, group_before = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(reach + 1):
        some = np.flatnonzero((nearest <= back) & (back <= furthest))
        if len(some) < 2:
            continue
        group_behind[by_behind] = np.cumsum(behind_common < length - back)
        group_before[by_before] = np.cumsum(before_common < back)
        string = group_behind[some] * (n + 1) + group_before[some]
        by_string = np.argsort(string, kind="stable")
        sorted_strings, ranks = string[by_string], rank[some[by_string]]
        first = np.concatenate([[True], sorted_strings[1:] != sorted_strings[:-1]])
        earliest = np.minimum.reduceat(ranks, np.flatnonzero(first))[np.cumsum(first) - 1]
        repeats[some[by_string], back] = ranks > earliest
    return repeats


def spans_of(ids, hashes, places, repeats: np.ndarray) -> np.ndarray:
    """Repeats as runs of beginnings, merged where they touch."""
    found = []
    for begin in range(0, max(1, len(repeats)), BLOCK):
        edge = np.diff(np.pad(repeats[begin : begin + BLOCK], ((0, 0), (1, 1))).astype(np.int8), axis=1)
        suffix, low = np.nonzero(edge == 1)
        found.append((suffix + begin, low, np.nonzero(edge == -1)[1]))
    suffix, low, high = (np.concatenate(x) for x in zip(*found))
    spans = np.empty(len(suffix), _SPAN)
    spans["id"], spans["hash"] = ids[suffix], hashes[suffix]
    spans["first"], spans["last"] = places[suffix] - high + 1, places[suffix] - low
    spans = spans[np.lexsort((spans["first"], spans["hash"], spans["id"]))]
    if len(spans) < 2:
        return spans
    alike = (spans["id"][1:] == spans["id"][:-1]) & (spans["hash"][1:] == spans["hash"][:-1])
    begins = np.flatnonzero(np.concatenate([[True], ~(alike & (spans["first"][1:] <= spans["last"][:-1] + 1))]))
    merged = spans[begins]
    merged["last"] = np.maximum.reduceat(spans["last"], begins)
    return merged


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _numbers(array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(np.int64)


_MARK = np.dtype([("key", "<u8"), ("text", "<u4"), ("place", "<u4"), ("back", "<u2"), ("span", "<u2")])


def bucket_of(ids: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document. Copies of a text are dealt out by their ids."""
    ids, hashes = np.ascontiguousarray(ids).view(np.uint64), np.ascontiguousarray(hashes).view(np.uint64)
    return (mix(hashes ^ mix(ids)) % np.uint64(buckets)).astype(np.int64)


def _send_anchors(buckets: int, length: int, gram: int):
    """Anchors of a task's texts by bucket of their hash. Those that recur inside the task are candidates already;
    they travel as known ones, dealt by text, and one of them stands for their hash."""

    def rows(ids, hashes, marks):
        _, inverse, count = np.unique(marks["key"], return_inverse=True, return_counts=True)
        often = (count > 1)[inverse]
        del inverse, count
        known = marks[often]
        one = known[np.unique(known["key"], return_index=True)[1]].copy()
        one["span"] = STAND_IN  # a stand-in: it makes its hash a repeated one and is no candidate itself
        sent = np.concatenate([marks[~often], one])
        del marks, often
        parts = [(0, sent, sent["key"] % np.uint64(buckets)), (1, known, bucket_of(ids[known["text"]], hashes[known["text"]], buckets))]
        for kind, some, bucket in parts:
            bucket = bucket.astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    here = some[order[edges[b] : edges[b + 1]]]
                    texts, local = np.unique(here["text"], return_inverse=True)
                    here["text"] = local
                    yield b, kind, ids[texts].tobytes(), hashes[texts].tobytes(), pack(here)

    def send(batches):
        ids, hashes, marks, held, base = [], [], [], 0, 0

        def taken(parts):
            whole = np.concatenate(parts)
            parts.clear()
            return whole

        def flush():
            if held:
                out = list(rows(taken(ids), taken(hashes), taken(marks)))
                yield pa.record_batch(
                    [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                    ["bucket", "kind", "ids", "hashes", "marks"],
                )

        for batch in slices(batches):
            data, at = text_buffer(_column(batch, "text"))
            text, place, key, first, last = anchors(data, at, length, gram)
            mark = np.empty(len(text), _MARK)
            mark["key"], mark["text"], mark["place"] = key, text + base, place
            mark["back"], mark["span"] = place - first, last - first
            ids.append(_numbers(_column(batch, "__id")))
            hashes.append(_numbers(_column(batch, "__hash")))
            marks.append(mark)
            base += batch.num_rows
            held += len(mark)
            if held > HELD_ANCHORS:
                yield from flush()
                held, base = 0, 0
        yield from flush()
        give_back()

    return send


def _find_candidates(buckets: int):
    """Anchors of one bucket whose hash occurs twice, packed by the bucket of their text."""

    def find(table: pa.Table) -> pa.Table:
        give_back()
        ids, hashes, marks, kinds, base = [], [], [], [], 0
        for row in table.select(["kind", "ids", "hashes", "marks"]).to_pylist():
            mark = unpack(row["marks"], _MARK)
            ids.append(np.frombuffer(row["ids"], np.int64))
            hashes.append(np.frombuffer(row["hashes"], np.int64))
            mark["text"] += base
            base += len(ids[-1])
            marks.append(mark)
            kinds.append(np.full(len(mark), row["kind"]))
        ids, hashes, marks, known = np.concatenate(ids), np.concatenate(hashes), np.concatenate(marks), np.concatenate(kinds) == 1
        sent = np.flatnonzero(~known)
        _, inverse, count = np.unique(marks["key"][sent], return_inverse=True, return_counts=True)
        known[sent] = (count[inverse] > 1) & (marks["span"][sent] != STAND_IN)
        marks = marks[known]
        wanted = np.empty(len(marks), _WANTED)
        wanted["id"], wanted["hash"] = ids[marks["text"]], hashes[marks["text"]]
        for name in _PLACE.names:
            wanted[name] = marks[name]
        wanted = wanted[np.lexsort((wanted["place"], wanted["hash"], wanted["id"]))]
        bucket = bucket_of(wanted["id"], wanted["hash"], buckets)
        order = np.argsort(bucket, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
        return pa.table(
            {
                "bucket": pa.array([int(bucket[p[0]]) for p in parts], pa.int32()),
                "wanted": pa.array([pack(wanted[p]) for p in parts], pa.binary()),
            }
        )

    return find


def _gather_candidates(table: pa.Table) -> pa.Table:
    """The candidates of one bucket of texts, one row per text."""
    wanted = np.concatenate([unpack(w, _WANTED) for w in table.column("wanted").to_pylist()])
    wanted = wanted[np.lexsort((wanted["place"], wanted["hash"], wanted["id"]))]
    fresh = (wanted["id"][1:] != wanted["id"][:-1]) | (wanted["hash"][1:] != wanted["hash"][:-1])
    begins = np.concatenate([[0], np.flatnonzero(fresh) + 1])
    ends = np.append(begins[1:], len(wanted))
    places = np.empty(len(wanted), _PLACE)
    for name in _PLACE.names:
        places[name] = wanted[name]
    return pa.table(
        {
            "__id": pa.array(np.ascontiguousarray(wanted["id"][begins])),
            "__hash": pa.array(np.ascontiguousarray(wanted["hash"][begins])),
            "marks": pa.array([places[low:high].tobytes() for low, high in zip(begins, ends)], pa.binary()),
        }
    )


def _send_suffixes(splitters: list[bytes], length: int, gram: int):
    """Suffixes of a task's candidates by bucket of their leading bytes, without those that repeat inside the task;
    the repeats found here travel along as spans."""
    reach = length - gram
    limit = max(1, min(HELD_SUFFIXES, HELD_SUFFIXES * (2 * LENGTH - GRAM) // (reach + length)))
    edges = np.array(splitters or [b""], f"S{gram}")

    def rows(ids, hashes, places, nearest, furthest, around):
        repeats = repeated(ids, hashes, places, nearest, furthest, around, length)
        spans = spans_of(ids, hashes, places, repeats)
        back = np.arange(reach + 1)
        left = np.logical_not(repeats, out=repeats)
        left &= nearest[:, None] <= back
        left &= back <= furthest[:, None]
        some = np.flatnonzero(left.any(1))
        left = left[some]
        low, high = np.argmax(left, 1), reach - np.argmax(left[:, ::-1], 1)
        lead = np.ascontiguousarray(around[some, reach : reach + gram]).view(f"S{gram}").ravel()
        bucket = np.searchsorted(edges, lead, "right") if splitters else np.zeros(len(some), np.int64)
        order = np.argsort(bucket, kind="stable")
        for k in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            s = some[k]
            yield int(bucket[k[0]]), np.stack([ids[s], hashes[s], places[s], low[k], high[k]]).tobytes(), pa.compress(around[s].tobytes(), codec="zstd", asbytes=True), None
        for k, part in enumerate(np.array_split(spans, max(1, len(spans) // 20_000))):
            if len(part):
                yield int((abs(int(part["hash"][0])) + k) % (len(splitters) + 1)), None, None, part.tobytes()

    def send(batches):
        held: list[list[np.ndarray]] = []
        around, size = np.empty((limit, reach + length), np.uint8), 0

        def flush():
            if held:
                out = list(rows(*(np.concatenate(x) for x in zip(*held)), around[:size]))
                yield pa.record_batch(
                    [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                    ["bucket", "places", "around", "spans"],
                )

        for batch in slices(batches):
            data, at = text_buffer(_field(batch, "text"))
            data = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(length, np.uint8)])
            windows = np.lib.stride_tricks.sliding_window_view(data, reach + length)
            ids, hashes = _numbers(_column(batch, "__id")), _numbers(_column(batch, "__hash"))
            marks = [np.frombuffer(x, _PLACE) for x in _column(batch, "marks").to_pylist()]
            text = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
            mark = np.concatenate(marks) if marks else np.zeros(0, _PLACE)
            low = 0
            while low < len(mark):
                high = min(low + BLOCK, low + limit - size)
                t, m = text[low:high], mark[low:high]
                place, back = m["place"].astype(np.int64), m["back"].astype(np.int64)
                around[size : size + len(t)] = windows[at[t] + place]
                held.append([ids[t], hashes[t], place, back - m["span"].astype(np.int64), back])
                low, size = high, size + len(t)
                if size == limit:
                    yield from flush()
                    held, size = [], 0
        yield from flush()
        del around
        give_back()

    return send


def _compare_bucket(length: int, gram: int):
    """Repeats among one bucket's suffixes, as spans."""
    reach = length - gram

    def compare(table: pa.Table) -> pa.Table:
        give_back()
        spans = [np.frombuffer(x, _SPAN) for x in table.column("spans").to_pylist() if x is not None]
        columns = [np.frombuffer(x, np.int64).reshape(5, -1) for x in table.column("places").to_pylist() if x is not None]
        if columns:
            ids, hashes, places, nearest, furthest = (np.concatenate([c[i] for c in columns]) for i in range(5))
            around, at = np.empty((len(ids), reach + length), np.uint8), 0
            for packed in table.column("around"):
                if packed.is_valid:
                    n = columns.pop(0).shape[1]
                    data = pa.decompress(packed.as_buffer(), n * (reach + length), codec="zstd")
                    around[at : at + n] = np.frombuffer(data, np.uint8).reshape(n, -1)
                    at += n
            spans.append(spans_of(ids, hashes, places, repeated(ids, hashes, places, nearest, furthest, around, length)))
        found = np.concatenate(spans) if spans else np.zeros(0, _SPAN)
        names = {"__id": "id", "__hash": "hash", "first": "first", "last": "last"}
        return pa.table({name: pa.array(np.ascontiguousarray(found[field]), pa.int64()) for name, field in names.items()})

    return compare


def _sample_leads(length: int, gram: int):
    def sample(batches):
        for batch in batches:
            data, at = text_buffer(_column(batch, "text"))
            leads = []
            for low, high in zip(at[:-1], at[1:]):
                text = data[low : min(high, low + 64 * length)]
                _, place, _, _, _ = anchors(text, np.array([0, len(text)]), length, gram)
                leads += [text[p : p + gram].tobytes() for p in place[:SAMPLE_ANCHORS]]
            yield pa.record_batch([pa.array(leads, pa.binary())], ["lead"])

    return sample


def identified(docs: DataFrame, key: str) -> DataFrame:
    """Each row of ``docs`` as a struct, with __id (``key`` as long, NULL behind all others) and __hash, which tell documents apart.

    Both joins with documents take this frame whole, so the texts move through one exchange that Spark uses twice.
    """
    there = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit((1 << 63) - 1)).alias("__id"),
        F.xxhash64(there).alias("__hash"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )


def _field(batch, name):
    """A column of the documents that a batch carries as structs."""
    rows = _column(batch, "row")
    return rows.field(rows.type.get_field_index(name))


def find_repeats(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Where strings of ``length`` bytes begin that begin earlier too: __id, __hash and runs of beginnings [first, last].

    ``length`` is at most 16,384. Earlier means in a document with a smaller ``key`` (an integer), or in the same one before. Runs of a document may overlap.
    Rows equal in key and text are one document. NULL texts are empty; a NULL key comes after all others; rows with equal
    keys and different texts are ordered by a hash of the text. Empty tables and short texts give no rows.
    """
    if not gram <= length <= LONGEST:
        raise ValueError(f"strings of {gram} to {LONGEST} bytes can be looked for")
    spark = docs.sparkSession
    texts = identified(docs, key)
    rows = docs.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_BUCKET))
    sample = docs.select("text").sample(min(1.0, SAMPLE_TEXTS / max(1, rows)), seed=7).limit(2 * SAMPLE_TEXTS)
    leads = sorted(r[0] for r in sample.mapInArrow(_sample_leads(length, gram), "lead binary").collect())
    splitters = sorted({bytes(leads[k * len(leads) // parts]) for k in range(1, parts)}) if leads else []
    sent = texts.select("__id", "__hash", "row.text").mapInArrow(_send_anchors(parts, length, gram), "bucket int, kind int, ids binary, hashes binary, marks binary")
    candidates = sent.groupBy("bucket").applyInArrow(_find_candidates(parts), "bucket int, wanted binary")
    wanted = candidates.groupBy("bucket").applyInArrow(_gather_candidates, "__id long, __hash long, marks binary")
    suffixes = (
        texts.join(wanted, ["__id", "__hash"])
        .select("__id", "__hash", "row", "marks")
        .mapInArrow(_send_suffixes(splitters, length, gram), "bucket int, places binary, around binary, spans binary")
    )
    return suffixes.groupBy("bucket").applyInArrow(_compare_bucket(length, gram), "__id long, __hash long, first long, last long")


def covered(spans, length: int) -> list[tuple[int, int]]:
    """The bytes that repeated strings cover, as maximal runs [low, high)."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(low, high) for low, high in out]


def keep(data: bytes, runs) -> bytes:
    at, out = 0, []
    for low, high in runs:
        out.append(data[at:low])
        at = high
    return b"".join([*out, data[at:]])


def _with_runs(docs: DataFrame, key: str, length: int, gram: int) -> DataFrame:
    """``docs`` with __runs, the repeated beginnings of each text (NULL where there are none)."""
    runs = find_repeats(docs, key, length, gram).groupBy("__id", "__hash").agg(F.collect_list(F.struct("first", "last")).alias("__runs"))
    return identified(docs, key).join(runs, ["__id", "__hash"], "left")


def repeat_report(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For every row of ``docs``: ``key``, n_bytes, n_removed, n_spans and kept_sha256, as bytes covered by repeats go."""

    def report(batches):
        for batch in slices(batches):
            rows = []
            for text, runs in zip(_field(batch, "text").to_pylist(), _column(batch, "__runs").to_pylist()):
                data = (text or "").encode()
                cut = covered([(r["first"], r["last"]) for r in runs or []], length)
                rows.append((len(data), sum(h - low for low, h in cut), len(cut), hashlib.sha256(keep(data, cut)).hexdigest()))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.record_batch([_field(batch, key), *columns], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _with_runs(docs.select(key, "text"), key, length, gram).select("row", "__runs")
    kind = docs.schema[key].dataType.simpleString()
    return found.mapInArrow(report, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated bytes cut from ``text`` (parts of characters left at a cut go too).

    Rows of whose text nothing is left are dropped; rows that were empty before stay.
    """
    columns = docs.columns

    def cut(batches):
        for batch in slices(batches):
            texts = []
            for text, runs in zip(_field(batch, "text").to_pylist(), _column(batch, "__runs").to_pylist()):
                if runs:
                    text = keep(text.encode(), covered([(r["first"], r["last"]) for r in runs], length)).decode(errors="ignore")
                texts.append(text)
            kept = [pa.array(texts, pa.string()) if c == "text" else _field(batch, c) for c in columns]
            some = pa.array([t is None or bool(t.strip()) or not r for t, r in zip(texts, _column(batch, "__runs").to_pylist())], pa.bool_())
            yield pa.record_batch(kept, columns).filter(some)

    found = _with_runs(docs, key, length, gram).select("row", "__runs")
    return found.mapInArrow(cut, docs.schema)
