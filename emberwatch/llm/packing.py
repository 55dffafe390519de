"""Packing of token sequences: shortest pack first over the histogram of piece lengths.

Documents become token ids closed by id 0 and are cut into full pieces and a rest. The histogram of lengths, never longer
than a sequence, goes to the driver. Lengths are placed longest first, each into the packs with most room, and equal packs
are one pattern with a count, so the number of patterns is bounded by the sequence length too. Patterns are joined back to
pieces by their rank within a length.

Null and empty texts are the closing id alone. Repeated rows are packed each. Pieces of equal length are ordered by doc_id
(missing first), start, checksum and tokens and spread by all four, so no doc_id, also none, is one task. Columns are found by
their exact names; others are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import pick
from emberwatch.llm.slices import numbered, ranged
from emberwatch.plans.durable import durable

LENGTH = 1024
CLOSING = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """Byte-level BPE of a tokenizers file, run by tiktoken, which gives the same ids several times faster.

    In such a file the order of the vocabulary is that of the merges, and bytes are written as printable characters:
    those that print stand for themselves, the others follow from U+0100 on.
    """
    import public_tokenizers
    import tiktoken

    model = json.loads(open(vocabulary, encoding="utf-8").read())
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def library(vocabulary: str):
    """The file as a tokenizer of its own library, for texts that the faster one refuses."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(vocabulary)
    out.no_truncation()
    out.no_padding()
    return out


def token_ids(text: str, vocabulary: str) -> list[int]:
    """tiktoken's pattern gives up on runs of about a million blanks; its library's own does not."""
    try:
        return encoder(vocabulary).encode(text, allowed_special="all")
    except ValueError:
        return library(vocabulary).encode(text, add_special_tokens=False).ids


def _pieces(vocabulary: str, length: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                source, starts, sizes, sums, totals, kept = [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.array([*token_ids(text or "", vocabulary), CLOSING], np.uint32)
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length]
                        source.append(i)
                        starts.append(start)
                        sizes.append(len(piece))
                        sums.append(zlib.crc32(piece.astype("<u4").tobytes()))
                        totals.append(len(ids))
                        kept.append(piece.astype(np.int32) if keep_ids else None)
                longs = [pa.array(x, pa.int64()) for x in (starts, sizes, sums, totals)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(source, pa.int64())), *longs, pa.array(kept, pa.list_(pa.int32()))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return run


def token_pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, keep_ids: bool = True) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, ids`` per piece; ids are null unless they are kept."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
    return rows.mapInArrow(_pieces(vocabulary or default_vocabulary(), length, keep_ids), schema)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """Packs as (count, {piece length: pieces}): longest lengths first, each into the packs with most room."""
    by_room: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        for room in sorted((r for r in by_room if r >= size), reverse=True):
            while left and by_room[room]:
                count, pack = by_room[room].pop()
                used = min(left, count)
                if used < count:
                    by_room[room].append((count - used, pack))
                # Several pieces at once where all packs of the pattern can take them.
                fill = max(1, min(room // size, left // used)) if used == count else 1
                by_room[room - size * fill].append((used, {**pack, size: pack.get(size, 0) + fill}))
                left -= used * fill
        if left:
            fill = max(1, min(length // size, left))
            full, rest = divmod(left, fill)
            by_room[length - size * fill].append((full, {size: fill}))
            if rest:
                by_room[length - size * rest].append((1, {size: rest}))
    return [(n, p) for room in sorted(by_room) for n, p in by_room[room] if n]


def _placer(packs: list[tuple[int, dict[int, int]]]):
    """Finds sequence and offset of a piece from its length and rank."""
    tables: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    first = 0
    for count, pack in packs:
        offset = 0
        for size in sorted(pack, reverse=True):
            tables[size].append((taken[size], first, pack[size], offset))
            taken[size] += count * pack[size]
            offset += size * pack[size]
        first += count
    arrays = {size: np.array(rows, np.int64) for size, rows in tables.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                rows, of = arrays[size], np.flatnonzero(sizes == size)
                row = rows[np.searchsorted(rows[:, 0], ranks[of], side="right") - 1]
                inside = ranks[of] - row[:, 0]
                sequence[of] = row[:, 1] + inside // row[:, 2]
                offset[of] = row[:, 3] + inside % row[:, 2] * size
            keep = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names)

    return run


def pack_documents(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece of ``docs(doc_id, text)``."""
    pieces = token_pieces(docs, vocabulary, length, keep_ids=False).drop("ids")
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    pieces = ranged(durable(pieces, "pack-ids"), order, "pack-pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `length` rows
    ranked = numbered(pieces, "length", order, "rank")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return ranked.mapInArrow(_placer(patterns(histogram, length)), ", ".join(f"{n} long" for n in names))


def packed_sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids``: placed pieces and their ids put together; a sequence is bounded by its length."""
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = pieces.select(*keys, "ids").dropDuplicates(keys)
    same = [placed[k].eqNullSafe(pieces[k]) for k in keys]
    rows = placed.join(pieces, same).select("sequence_id", "offset", "ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
