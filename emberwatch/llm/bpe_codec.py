"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

The tree of a word holds, per place, the rank of the merge of the two symbols that meet there, and the least of each span
above. Its root is the leftmost merge of lowest rank; a merge changes at most three places, so a word of n symbols takes
n log n steps, also one of a million letters. Words repeat, so the ids of short ones are remembered, up to a bound.

A file of the tokenizers library says how texts become words: added tokens are found in the raw text, the rest is composed
(NFC), blanks are made one space, letters small, and the words of a pattern stay. The library lower-cases letter by letter
and has its own version of Unicode; its classes of letters, digits and blanks are read off it once per Python process, and
texts with a character that Python does not know, or lower-cases otherwise, pass through its normaliser.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each. Columns are found by their
exact names; others are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import pick

WIDE = 1 << 20  # more than any id
GROUP = 64  # texts in memory at once
KEPT_WORDS, KEPT_CHARS = 200_000, 64  # remembered words of a generation, and their greatest length
# The layout of files that this module reads.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {
    "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed", "invert": True,
}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
ALL = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ranges(codes: Iterable[int]) -> str:
    """Inside of a character class with these code points, which ascend."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _class(pattern: str) -> list[int]:
    """Code points of a one-character pattern of the library."""
    from tokenizers import Regex, normalizers

    strip = normalizers.Replace(Regex(pattern), "")
    out = []
    for lo in range(0, len(ALL), 4096):
        part = ALL[lo : lo + 4096]
        left = set(map(ord, strip.normalize_str("".join(map(chr, part)))))
        out += [c for c in part if c not in left]
    return out


@lru_cache(maxsize=1)
def word_patterns() -> tuple[re.Pattern, re.Pattern]:
    """The pattern for all texts, and for those of Latin-1 alone, whose classes are small tables."""
    classes = [_class(p) for p in (r"\p{L}", r"\p{N}", r"\s")]

    def pattern(limit: int) -> re.Pattern:
        letters, digits, blanks = (_ranges(c for c in codes if c < limit) for codes in classes)
        return re.compile(f"[{letters}]+|[{digits}]|'(?:s|t|re|ve|m|ll|d)|[^{blanks}{letters}{digits}]+")

    return pattern(sys.maxunicode + 1), pattern(256)


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def strangers() -> re.Pattern:
    """Characters whose treatment must be left to the library."""
    from tokenizers import normalizers

    lower = normalizers.Lowercase()
    known = lambda c: unicodedata.category(c) != "Cn" and lower.normalize_str(c) == c.lower()
    return re.compile(f"[{_ranges(c for c in ALL if not known(chr(c)))}]")


def segment_tree(leaves: list[int], nothing: int) -> list[int]:
    """Least values of spans: of cell k the least of 2k and 2k + 1; the second half of the cells are the leaves."""
    size = 1 << (len(leaves) - 1).bit_length()
    cells = [nothing] * size + leaves + [nothing] * (size - len(leaves))
    for k in range(size - 1, 0, -1):
        a, b = cells[2 * k], cells[2 * k + 1]
        cells[k] = a if a < b else b
    return cells


def put(cells: list[int], k: int, value: int) -> None:
    """Writes a leaf and the cells above it, up to the first that stays as it is."""
    cells[k] = value
    while k > 1:
        other = cells[k ^ 1]
        if other < value:
            value = other
        k >>= 1
        if cells[k] == value:
            return
        cells[k] = value


class WordBPE:
    """Words to ids and ids to tokens, after a file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, steps = file["model"], (file["normalizer"] or {}).get("normalizers")
        plain = not (model["continuing_subword_prefix"] or model["dropout"] or model["ignore_merges"] or file["decoder"])
        if steps != NORMALISERS or file["pre_tokenizer"]["pretokenizers"] != [SPLIT, BYTES] or not plain:
            raise ValueError("this layout of tokenizers file is not supported")
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        # Bytes are written as printable characters: those that print as themselves, the others from U+0100 on.
        printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = (b for b in range(256) if b not in set(printing))
        shown = {b: chr(b) for b in printing} | {b: chr(0x100 + i) for i, b in enumerate(others)}
        self.inner = [vocab[shown[b]] for b in range(256)]
        self.last = [vocab[shown[b] + self.suffix] for b in range(256)]
        self.ranks: dict[int, int] = {}  # by left id * WIDE + right id
        self.merged = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] * WIDE + vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.library = None
        self.path = path

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode()
        inner = self.inner
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        if n == 1:
            return ids
        # A leaf is rank * n + place, so the least one is the leftmost of lowest rank.
        find, merged = self.ranks.get, self.merged
        nothing = (len(merged) + 1) * n
        leaves = []
        for i in range(n - 1):
            rank = find(ids[i] * WIDE + ids[i + 1])
            leaves.append(nothing if rank is None else rank * n + i)
        cells = segment_tree(leaves, nothing)
        first = len(cells) // 2
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while (least := cells[1]) < nothing:
            rank, i = divmod(least, n)
            own = ids[i] = merged[rank]
            j = after[i]
            k = after[i] = after[j]
            ids[j] = -1
            value = nothing
            if k < n:
                put(cells, first + j, nothing)
                before[k] = i
                rank = find(own * WIDE + ids[k])
                if rank is not None:
                    value = rank * n + i
            put(cells, first + i, value)
            h = before[i]
            if h >= 0:
                rank = find(ids[h] * WIDE + own)
                value = nothing if rank is None else rank * n + h
                if cells[first + h] != value:
                    put(cells, first + h, value)
        return [x for x in ids if x >= 0]

    def words(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        every, small = word_patterns()
        if latin(text):  # Python and the library agree on these characters
            return small.findall(unicodedata.normalize("NFC", text).lower())
        if strangers().search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).normalizer
            return every.findall(self.library.normalize_str(text))
        # The library has no final sigma; blanks need no care, as no word has one.
        return every.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Words (with None) and added tokens (with their ids) of a text, in order."""
        at = 0
        for hit in self.specials.finditer(text) if self.specials else ():
            yield from ((w, None) for w in self.words(text[at : hit.start()]))
            yield hit.group(), self.added[hit.group()]
            at = hit.end()
        yield from ((w, None) for w in self.words(text[at:]))


class Memory(dict):
    """Results of a function by word. When it is full, the older half goes; long words are not kept."""

    def __init__(self, function):
        super().__init__()
        self.function, self.old = function, {}

    def __missing__(self, word: str):
        if word in self.old:
            out = self.old[word]
        else:
            out = self.function(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class Codec:
    """Texts to ids and back, with ids and tokens written in one text, joined by a space."""

    def __init__(self, path: str):
        self.bpe = WordBPE(path)
        self.encoded = Memory(lambda word: " ".join(map(str, self.bpe.merge(word))))
        self.decoded = Memory(self.decode)

    def encode(self, text: str) -> list[str]:
        """Ids of each word or added token, joined by a space."""
        of = self.encoded.__getitem__
        if self.bpe.specials and self.bpe.specials.search(text):
            return [of(word) if number is None else str(number) for word, number in self.bpe.pieces(text)]
        return list(map(of, self.bpe.words(text)))

    def decode(self, ids: str) -> str:
        """Tokens of ids, special ones too. Without a decoder in the file, tokens are joined by a space."""
        tokens = self.bpe.tokens
        return " ".join([tokens[int(i)] for i in ids.split(" ")]) if ids else ""


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """Once per Python worker."""
    return Codec(path)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, GROUP):
            part = batch.slice(lo, GROUP)
            yield part, [t or "" for t in part.column("text").to_pylist()]


def _documents(docs: DataFrame, column: str) -> DataFrame:
    return pick(docs, "doc_id", column).select(F.col("doc_id").cast("long").alias("doc_id"), column)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids`` per row of ``docs(doc_id, text)``."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = codec(path).encode
        for part, texts in _texts(batches):
            ids = [[int(i) for word in to_ids(t) for i in word.split(" ")] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _documents(docs, "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text`` per row of ``encoded(doc_id, ids)``; null ids: empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_text = codec(path).decode
        for batch in batches:
            texts = [to_text(" ".join(map(str, ids or []))) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _documents(encoded, "ids").mapInArrow(run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row of ``docs(doc_id, text)``, from one pass over the texts."""
    path = vocabulary or default_vocabulary()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part, texts in _texts(batches):
            counts, ids_sha, text_sha = [], [], []
            for words in map(own.encode, texts):
                ids = " ".join(words)
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(sha(ids))
                text_sha.append(sha(" ".join(map(own.decoded.__getitem__, words))))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _documents(docs, "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
