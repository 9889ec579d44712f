"""Near-duplicate documents by BagMinHash signatures, bands and an exact check of multiset overlap.

A document is the multiset of its runs of five words. For each distinct run, Poisson processes over the weight levels
0-1, 1-2, 2-4, 4-8, ... throw points at the components of a signature, at rates as wide as the levels; a point counts if
its place inside the level, read bit by bit from a hash, is below the run's weight. Each component keeps its earliest
point, so two signatures agree in a component with the probability of the weighted Jaccard similarity. Points are made
only up to the time at which all components have one.

Copies of the same words are one node. Nodes that share a band meet its smallest node and are compared exactly, run
by run. Only buckets that still hold several components are looked into further, in pairs of blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from ..session import stage
from .components import components
from .words import CHUNK_BYTES, chunks, mix, shingle_hashes, slices, text_buffer, word_hashes

SHINGLE = 5
SIMILAR = 0.8
BANDS = 32
ROWS = 4
#: Nodes of a bucket that are compared in one block.
BLOCK = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hopeless(similar: float, components: int) -> float:
    """Agreement of signatures below which a similarity of ``similar`` is out of the question: five deviations."""
    return similar - 5 * math.sqrt(similar * (1 - similar) / components)


def weigh(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of each text: text, hash, how often."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    if not len(text):
        return text, hashes, np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])]))
    return text[edge], hashes[edge], np.diff(np.append(edge, len(text)))


def bagminhash(text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Signatures of ``size`` components with 24 bits each; 0 throughout for texts without runs."""
    best = np.full(texts * size, np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(text, weights, texts)
    levels = 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    element = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = mix(hashes[element] + level.astype(np.uint64) * _STEP)
    owner, weight = text[element], weights[element]
    horizon = np.where(total > 0, (np.log(size) + 5) * size / np.maximum(total, 1), 0)
    waiting = total > 0
    if not len(element):
        return np.zeros((texts, size), np.uint64)
    time, live = np.zeros(len(element)), np.arange(len(element))
    paused: list[np.ndarray] = []
    number, scale = np.zeros(len(element), np.uint64), float(1 << 38)
    while len(live):
        number[live] += np.uint64(1)
        draw = mix(seed[live] + number[live] * _STEP)
        time[live] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[live]
        inside = time[live] <= horizon[owner[live]]
        paused.append(live[~inside])
        live, draw = live[inside], draw[inside]
        place = mix(draw ^ _STEP)
        height = low[live] + ((place >> np.uint64(32)).astype(np.int64) & (width[live] - 1))
        hit = height < weight[live]
        here = live[hit]
        slot = owner[here] * size + (place[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
        moment = (time[here] / horizon[owner[here]] * scale).astype(np.uint64)
        np.minimum.at(best, slot, (moment << np.uint64(24)) | (mix(place[hit]) & np.uint64(0xFFFFFF)))
        if not len(live):
            empty = (best.reshape(texts, size) == np.iinfo(np.uint64).max).any(1) & waiting
            if empty.any():  # some components have no point yet: these texts' processes go on, from where they stopped
                stopped = np.concatenate(paused)
                going = empty[owner[stopped]]
                stopped, paused = stopped[going], []
                old = horizon.copy()
                late = best.reshape(texts, size)
                grown = np.flatnonzero(empty)
                filled = late[grown] != np.iinfo(np.uint64).max
                late[grown] = np.where(filled, ((late[grown] >> np.uint64(25)) << np.uint64(24)) | (late[grown] & np.uint64(0xFFFFFF)), late[grown])
                horizon = np.where(empty, old * 2, old)
                # the point that overran the old horizon is still to be placed
                number[stopped] -= np.uint64(1)
                back = mix(seed[stopped] + (number[stopped] + np.uint64(1)) * _STEP)
                time[stopped] += np.log(((back >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[stopped]
                live = stopped
    return np.where(waiting[:, None], best.reshape(texts, size) & np.uint64(0xFFFFFF), 0).astype(np.uint64)


def band_buckets(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket per band."""
    parts = signatures.reshape(len(signatures), bands, rows)
    bucket = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for k in range(rows):
        bucket = mix(bucket * _STEP + parts[:, :, k])
    return bucket


def _sign(bands: int, rows: int, shingle: int):
    def sign(batches):
        for batch in slices(batches):
            data, at = text_buffer(batch.column(batch.schema.get_field_index("text")))
            ids = batch.column(batch.schema.get_field_index("id"))
            for low, high, part, edges in chunks(data, at, 2 * CHUNK_BYTES):
                words, word_at = word_hashes(part, edges)
                runs, run_at = shingle_hashes(words, word_at, shingle)
                n = high - low
                signatures = bagminhash(*weigh(runs, run_at), n, bands * rows)
                place = np.arange(len(words)) - np.repeat(word_at[:-1], np.diff(word_at))
                owner = np.repeat(np.arange(n), np.diff(word_at))
                twins = []
                for salt in (1, 2):
                    value = mix(words + mix((place * 2 + salt).astype(np.uint64)))
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, owner, value)
                    twins.append(total.view(np.int64))
                buckets = band_buckets(signatures, bands, rows).astype(">u8")
                yield pa.record_batch(
                    [ids.slice(low, n), pa.array(np.diff(word_at)), *[pa.array(t) for t in twins], pa.array(np.diff(run_at)),
                     pa.Array.from_buffers(pa.binary(bands * rows), n, [None, pa.py_buffer((signatures & np.uint64(0xFF)).astype(np.uint8).tobytes())]).cast(pa.binary()),
                     pa.Array.from_buffers(pa.binary(bands * 8), n, [None, pa.py_buffer(buckets.tobytes())]).cast(pa.binary())],
                    ["id", "words", "twin1", "twin2", "runs", "signature", "buckets"],
                )

    return sign


def _shingle_sets(shingle: int):
    """Each text's runs as a sorted set: the k-th occurrence of a run is an element of its own."""

    def sets(batches):
        for batch in slices(batches):
            data, at = text_buffer(batch.column(batch.schema.get_field_index("text")))
            ids = batch.column(batch.schema.get_field_index("id"))
            for low, high, part, edges in chunks(data, at):
                runs, run_at = shingle_hashes(*word_hashes(part, edges), shingle)
                blobs = []
                for k in range(high - low):
                    own = np.sort(runs[run_at[k] : run_at[k + 1]])
                    first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
                    start = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0)) if len(own) else own
                    again = (np.arange(len(own)) - start).astype(np.uint64)
                    blobs.append(np.sort(np.where(again > 0, mix(own + again * _STEP), own)).tobytes())
                yield pa.record_batch([ids.slice(low, high - low), pa.array(blobs, pa.binary())], ["id", "runs"])

    return sets


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two texts, from their sorted sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 0.0
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return common / (len(x) + len(y) - common)


def _similar_pairs(similar: float):
    def pairs(batches):
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "runs_a", "runs_b"))
            found = [overlap(p.as_py(), q.as_py()) >= similar for p, q in zip(x, y)]
            yield pa.record_batch([a, b], ["a", "b"]).filter(pa.array(found, pa.bool_()))

    return pairs


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The two sides of a block pair, which are one and the same inside a block."""
    if table.column("same")[0].as_py():
        every = np.arange(table.num_rows)
        return every, every, True
    left = table.column("left").to_numpy(zero_copy_only=False)
    return np.flatnonzero(left), np.flatnonzero(~left), False


def _fixed(table: pa.Table, name: str, kind) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(table.num_rows, -1)


def _partners(table: pa.Table, similar: float, hopeless: float):
    """For each row of a block pair, the rows of other components that may be similar to it.

    Sizes and signatures must allow it, and this must be the first bucket that both have in common, so that a pair turns
    up once only.
    """
    rows, columns, same = _sides(table)
    own, runs, node = (table.column(c).to_numpy() for c in ("component", "runs", "node"))
    signature, buckets = _fixed(table, "signature", np.uint8), _fixed(table, "buckets", ">i8")
    band = int(np.flatnonzero(buckets[0] == table.column("bucket")[0].as_py())[0])
    for r in rows:
        some = columns[(own[columns] != own[r]) & (np.minimum(runs[columns], runs[r]) >= similar * np.maximum(runs[columns], runs[r]))]
        if same:
            some = some[node[some] > node[r]]
        some = some[(signature[some] == signature[r]).mean(1) >= hopeless]
        if len(some):
            some = some[~(buckets[some, :band] == buckets[r, :band]).any(1)]
        if len(some):
            yield r, some


def _open_rows(similar: float, hopeless: float):
    """The rows of a block pair that have a partner in it."""

    def rows(table: pa.Table) -> pa.Table:
        wanted = np.zeros(table.num_rows, bool)
        for r, some in _partners(table, similar, hopeless):
            wanted[r] = True
            wanted[some] = True
        return table.filter(pa.array(wanted))

    return rows


def _compare_blocks(similar: float, hopeless: float):
    """Links between the components of a block pair, by exact comparison; none between what is already connected."""

    def compare(table: pa.Table) -> pa.Table:
        sets, own = table.column("sets").to_pylist(), table.column("component").to_numpy()
        top = {c: c for c in own.tolist()}
        links = []

        def find(c):
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        for r, some in _partners(table, similar, hopeless):
            for k in some.tolist():
                one, other = find(int(own[r])), find(int(own[k]))
                if one != other and overlap(sets[r], sets[k]) >= similar:
                    top[max(one, other)] = min(one, other)
                    links.append((int(own[r]), int(own[k])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return compare


def node_ids(key: str) -> F.Column:
    """``key`` as long; a NULL one counts as a negative number made from the text."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return F.coalesce(F.col(f"`{key}`").cast("long"), -2 - F.pmod(text_hash, F.lit(1 << 62)))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE
) -> DataFrame:
    """id, class_id (the smallest id of the document's group), n_words, n_runs for each row of docs(``key``, text).

    Documents of the same words, and documents whose multisets of five-word runs have a weighted Jaccard similarity of at
    least ``similar``, are linked; a group is all that links connect. A pair of exactly 0.8 shares no band of the
    default 32 with a probability of 5e-8. A text of fewer than five words is one run; NULL texts and texts without
    words are in no group but their own. Rows of one id are one document; a NULL id counts as a negative number
    made from the text. An empty table gives no rows.
    """
    texts = docs.select(node_ids(key).alias("id"), "text")
    kind = "id long, words long, twin1 long, twin2 long, runs long, signature binary, buckets binary"
    signed = stage(texts.mapInArrow(_sign(bands, rows, shingle), kind), "signatures")
    full = signed.where("words > 0")
    nodes = stage(
        full.groupBy("twin1", "twin2").agg(
            F.min("id").alias("node"), F.first("runs").alias("runs"), F.first("signature").alias("signature"), F.first("buckets").alias("buckets")
        ),
        "nodes",
    )
    at = F.sequence(F.lit(1), F.lit(16 * bands - 15), F.lit(16))
    places = F.transform(at, lambda k: F.conv(F.substring(F.hex("buckets"), k, F.lit(16)), 16, -10).cast("long"))
    banded = nodes.select("node", F.explode(places).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = stage(banded.join(shared, "bucket"), "members")
    pairs = members.where("node > pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    sizes = nodes.select("node", "runs")
    reach = pairs.join(sizes.toDF("a", "x"), "a").join(sizes.toDF("b", "y"), "b").where(F.least("x", "y") >= F.lit(similar) * F.greatest("x", "y"))

    # The texts meet their ids by a shuffle at any size, as they do when the ids are many.
    wanted = members.select(F.col("node").alias("id")).distinct()
    sets = texts.hint("merge").join(wanted, "id", "left_semi").mapInArrow(_shingle_sets(shingle), "id long, runs binary")
    held = stage(sets.groupBy("id").agg(F.min("runs").alias("sets")), "sets")
    both = reach.select("a", "b").join(held.toDF("a", "runs_a").hint("merge"), "a").join(held.toDF("b", "runs_b").hint("merge"), "b")
    similar_pairs = both.mapInArrow(_similar_pairs(similar), "a long, b long")
    # Copies lead to their node, and rows of one id that differ in their words meet in that id.
    copies = full.join(nodes.select("twin1", "twin2", "node"), ["twin1", "twin2"]).where("id <> node").select("id", "node")
    found = stage(components(similar_pairs.union(copies)), "components")

    # Buckets of three or more nodes that are not yet all connected: the pairs that did not meet by way of the pivot.
    placed = members.where("n > 2").join(found.withColumnRenamed("component", "c"), "node", "left").select(
        "bucket", "node", "pivot", F.coalesce("c", "node").alias("component")
    )
    placed = stage(placed, "placed")
    split = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where(
        "low < high"
    )
    blocks = F.ceil(F.col("size") / BLOCK)
    shape = StructType(
        [StructField(c, IntegerType()) for c in ("first", "second")]
        + [StructField(c, BooleanType()) for c in ("left", "same")]
        + [StructField(c, LongType()) for c in ("bucket", "node", "component", "runs")]
        + [StructField(c, BinaryType()) for c in ("signature", "buckets")]
    )
    dealt = (
        placed.join(split, "bucket")
        .where("node <> pivot")
        .withColumns({"blocks": blocks.cast("int"), "block": F.pmod(F.xxhash64("node"), blocks).cast("int")})
        .join(nodes.select("node", "runs", "signature", "buckets"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns(
            {
                "first": F.least("block", "other"),
                "second": F.greatest("block", "other"),
                "left": F.col("block") < F.col("other"),
                "same": F.col("block") == F.col("other"),
            }
        )
        .select(*shape.names)
    )
    keys = ["bucket", "first", "second"]
    undecided = dealt.groupBy(*keys).applyInArrow(_open_rows(similar, hopeless(similar, bands * rows)), shape)
    rest = (
        undecided.join(held.withColumnRenamed("id", "node").hint("merge"), "node")
        .groupBy(*keys)
        .applyInArrow(_compare_blocks(similar, hopeless(similar, bands * rows)), "a long, b long")
    )
    final = components(found.toDF("a", "b").union(rest))
    return signed.join(final.toDF("id", "component"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("class_id"), F.col("words").alias("n_words"), F.col("runs").alias("n_runs")
    )
