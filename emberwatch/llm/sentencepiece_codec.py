"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; normaliser, whitespace marker, BPE or unigram scores and byte fallback are rebuilt
as a tokenizers pipeline that encodes batches on as many threads as a task has cores. Parity with the sentencepiece
library is verified for every row.

A BPE model's pieces carry scores instead of merges: each way to make a piece of two others becomes a merge, best score
first. sentencepiece takes the leftmost of equal scores, so longer left sides, which only leftmost merges have, go first.
A text is not cut into words first: merging it as a whole is faster here than looking its words up.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each. Columns are found by their exact
names; others are not looked at.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import pick

MARK = "▁"
# Fixed values of the format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protobuf message; nested ones stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class PieceModel:
    kind: int
    pieces: list[tuple[str, float, int]]
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    one_space: bool


def parse_model(data: bytes) -> PieceModel:
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    byte_fallback = any(kind == BYTE for _, _, kind in pieces)
    return PieceModel(
        trainer.get(3, UNIGRAM), pieces, byte_fallback, normaliser.get(2, b""), bool(normaliser.get(3, 1)),
        bool(normaliser.get(4, 1)),
    )


def _merges(model: PieceModel, ids: dict[str, int]) -> list[tuple[str, str]]:
    usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in usable and right in usable:
                    found.append((-score, -cut, ids[piece], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(model: PieceModel):
    """The model as a tokenizer of the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == BPE:
        core = models.BPE(
            vocab=ids, merges=_merges(model, ids), unk_token=model.pieces[unknown][0], fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    elif model.kind == UNIGRAM:
        least = min((s for _, s, kind in model.pieces if kind == NORMAL), default=0.0)
        # Pieces that must not be chosen keep their id and get a score out of reach.
        scores = [(p, s if kind in (NORMAL, USER_DEFINED) else least - 1e6) for p, s, kind in model.pieces]
        core = models.Unigram(scores, unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("word and character models are not supported")
    out = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.one_space:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence(steps)
    out.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED])
    # The library's own decoder of marks would drop all marks of the first token.
    back = [decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " ")]
    out.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return out


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return parse_model(f.read())


@lru_cache(maxsize=4)
def codec(path: str, threads: int = 1, marked: bool = False):
    """Tokenizer of a model file, once per Python worker; ``marked``: for texts from ``mark``."""
    from tokenizers import normalizers

    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    out = build(load(path))
    if marked:
        out.normalizer = normalizers.Sequence([])
    return out


def only_marks(model: PieceModel) -> bool:
    """Whether setting marks is all that the model does to a text before it is encoded, and to the text as a whole."""
    return not model.charsmap and not model.one_space and all(kind != USER_DEFINED for _, _, kind in model.pieces)


def mark(text: str, model: PieceModel) -> str:
    """The text with its marks. The library's normalisers do the same, but keep the origin of every byte."""
    text = text.replace(" ", MARK)
    return MARK + text if text and model.dummy_prefix else text


@lru_cache(maxsize=4)
def checker(path: str):
    """The sentencepiece library's own codec."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


GROUP = 64  # texts encoded together


def task_threads(df: DataFrame) -> int:
    """Cores of a task."""
    return int(df.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, threads: int, parity: bool):
    """Slices of the batches with their texts, the ids of each text, and whether sentencepiece gives the same ids."""
    model, other = load(path), checker(path) if parity else None
    marked = only_marks(model)
    own = codec(path, threads, marked)
    for batch in batches:
        for lo in range(0, batch.num_rows, GROUP):
            part = batch.slice(lo, GROUP)
            texts = [t or "" for t in part.column("text").to_pylist()]
            given = [mark(t, model) for t in texts] if marked else texts
            ids = [e.ids for e in own.encode_batch_fast(given, add_special_tokens=False)]
            same = [a == b for a, b in zip(ids, other.encode(texts, num_threads=threads))] if parity else [None] * len(ids)
            yield part, texts, ids, same


def encode(docs: DataFrame, model: str | None = None, threads: int | None = None, parity: bool = True) -> DataFrame:
    """``doc_id, ids, parity`` per row of ``docs(doc_id, text)``; parity: sentencepiece gives the same ids.

    ``threads``: by default as many as a task has cores.
    """
    path, threads = model or default_model(), threads or task_threads(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, ids, same in _encoded(batches, path, threads, parity):
            columns = [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "parity"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, parity boolean")


def decode(encoded: DataFrame, model: str | None = None, threads: int | None = None) -> DataFrame:
    """``doc_id, text`` per row of ``encoded(doc_id, ids)``; null ids: empty text."""
    path, threads = model or default_model(), threads or task_threads(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, threads)
        for batch in batches:
            texts = own.decode_batch([x or [] for x in batch.column("ids").to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = pick(encoded, "doc_id", "ids").select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return rows.mapInArrow(run, "doc_id long, text string")


def codec_digests(docs: DataFrame, model: str | None = None, threads: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, decoded_crc32, round_trip, parity`` per document, from one pass over the texts.

    ids_crc32 covers the ids as little-endian 32-bit numbers; round_trip: decoding gives the text back; parity: ids and
    decoded text are those of sentencepiece.
    """
    path, threads = model or default_model(), threads or task_threads(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = codec(path, threads, only_marks(load(path))), checker(path)
        for part, texts, ids, same in _encoded(batches, path, threads, True):
            back = own.decode_batch(ids, skip_special_tokens=False)
            same = [a and b == c for a, b, c in zip(same, back, other.decode(ids, num_threads=threads))]
            flat = np.fromiter(chain.from_iterable(ids), "<u4", sum(map(len, ids))).tobytes()
            ends = np.cumsum([0, *map(len, ids)]) * 4
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])]
            again = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in back]
            longs = [pa.array(x, pa.int64()) for x in (list(map(len, ids)), crc, again)]
            whole = pa.array([a == b for a, b in zip(texts, back)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *longs, whole, pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip", "parity"],
            )

    rows = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean, parity boolean"
    )
