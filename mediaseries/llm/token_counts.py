"""Token counts of whole texts, as the tokenizer's own library gives them.

Huge texts are encoded in overlapping chunks with offsets, and neighbouring chunks are spliced at a boundary that both
share and that is proven stable: before a blank that follows a non-blank. The splitting pattern of byte-level BPE has no
alternative that takes a blank behind anything but blanks, and special strings hold no blanks, so in the whole text too
a piece ends and another begins there, whatever stands around. Where the overlap holds no such place, it is widened,
in the end to the whole text. Other texts are cut at the same places, and pieces that occur again are counted once.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Distinct pieces a task remembers; beyond that it begins anew.
REMEMBERED = 1_000_000
#: Characters whose texts are learned together.
TOGETHER = 250_000
AFTER_SPACE = re.compile(r"\s |^ ")


def stable(text: str, at: int) -> bool:
    """Whether a token ends before ``at`` and another begins there in any encoding of ``text`` or a part around it."""
    return 0 < at < len(text) and text[at] in " \t\n\r" and not text[at - 1].isspace()


def last_stable(text: str, low: int, high: int) -> int | None:
    """The last stable place in [low, high)."""
    return next((at for at in range(high - 1, low - 1, -1) if stable(text, at)), None)


def count_spliced(encode, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text from overlapping chunks. ``encode`` gives the sorted ends of a text's tokens, in characters.

    Each chunk takes over from the one before it at a common boundary in their overlap. A chunk begins anywhere,
    also inside a word; only its tokens behind the boundary count. Where the overlap holds no stable place, or the two encodings
    have no boundary at it, the overlap is widened.
    """
    total, low, high, held = 0, 0, min(len(text), chunk), 0
    ends = encode(text[low:high])
    while high < len(text):
        width, joined = overlap, False
        while not joined:
            begin = max(held, high - width)
            splice = last_stable(text, begin + 1, high - 1)
            if splice is not None:
                after = max(min(len(text), begin + chunk), min(len(text), high + 1))
                following = encode(text[begin:after])
                cut, join = bisect_right(ends, splice - low), bisect_right(following, splice - begin)
                joined = bool(cut and join) and ends[cut - 1] == splice - low and following[join - 1] == splice - begin
            if begin == held:
                break
            width *= 2
        if not joined:  # no common boundary however wide the overlap: the chunk itself grows, in the end to the whole text
            high = min(len(text), high + max(chunk, high - low))
            ends = encode(text[low:high])
            continue
        total += cut - bisect_right(ends, held - low)
        low, high, held, ends = begin, after, splice, following
    return total + len(ends) - bisect_right(ends, held - low)


def pieces(text: str) -> list[str]:
    """The text cut at its stable blanks. Each piece but the first lacks the blank it begins with."""
    parts = text.split(" ")
    if not AFTER_SPACE.search(text):
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself where it prints, else the next one from 256 up."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _counter(path: str, chunk: int, overlap: int):
    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        known: dict[str, int] = {}
        marks: dict[str, int] = {}

        def ends(text: str) -> list[int]:
            return [end for _, end in tokenizer.encode(text, add_special_tokens=False).offsets]

        def lengths(texts: list[str]) -> list[int]:
            return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        letters, merge = byte_letters(), tokenizer.model.tokenize
        blank = letters[32]

        def learn(fresh: set[str]) -> None:
            """Counts pieces. A blank and Latin letters are one unit of the splitting pattern, so the model's merges alone
            decide; full stops and commas behind letters are a unit of their own."""
            other = []
            for piece in fresh:
                word = piece.rstrip(".,")
                if word.isalpha() and max(word) < "\u0250":
                    count = known.get(word)
                    if count is None:
                        known[word] = count = len(merge(blank + word.encode().decode("latin-1").translate(letters)))
                    if len(word) < len(piece):
                        mark = piece[len(word) :]
                        if mark not in marks:
                            marks[mark] = lengths([mark])[0]
                        known[piece] = count + marks[mark]
                else:
                    other.append(piece)
            known.update(zip(other, lengths([" " + piece for piece in other])))

        def counted(texts: list[str]) -> list[int]:
            cut = [pieces(t) if len(t) <= chunk else None for t in texts]
            fresh = {p for c in cut if c for p in c[1:]}.difference(known)
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = {p for c in cut if c for p in c[1:]}
            learn(fresh)
            heads = iter(lengths([c[0] for c in cut if c]))
            return [
                next(heads) + sum(map(known.__getitem__, c[1:])) if c else count_spliced(ends, t, chunk, overlap)
                for c, t in zip(cut, texts)
            ]

        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            found, group, size = [], [], 0
            for text in texts:
                group.append(text.as_py())
                size += len(group[-1])
                if size > TOGETHER:
                    found += counted(group)
                    group, size = [], 0
            found += counted(group)
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "text"]
            yield pa.record_batch(
                [*columns, pc.fill_null(pc.binary_length(texts.cast(pa.binary())), 0).cast(pa.int64()), pa.array(found, pa.int64())],
                [*[n for n in batch.schema.names if n != "text"], "n_bytes", "n_tokens"],
            )

    return count


def token_counts(
    docs: DataFrame, tokenizer_path: str, keep: str = "doc_id", chunk_chars: int = 32_768, overlap_chars: int = 256, limit: int = 512
) -> DataFrame:
    """``keep``, n_bytes (UTF-8), n_tokens, over_limit for every row of ``docs`` (``keep``, text; other columns are ignored).

    Texts beyond ``chunk_chars`` are encoded in chunks. ``tokenizer_path`` names a file of the tokenizers library with a
    byte-level BPE, in a place where every worker has it. A NULL text counts as empty, with 0 tokens; rows with
    equal or NULL ids each give a row; an empty table gives none. A narrow map: nothing is shuffled.
    """
    schema = f"{keep} {docs.schema[keep].dataType.simpleString()}, n_bytes long, n_tokens long"
    counted = docs.select(keep, "text").mapInArrow(_counter(tokenizer_path, chunk_chars, overlap_chars), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
