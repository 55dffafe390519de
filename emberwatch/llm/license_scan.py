"""Licence scan: passages of whole texts against licence templates by the Dice coefficient over word bigrams.

Texts are normalised to lower-case words of letters, digits and underscores. A passage runs from one bigram of the template
to another; with h distinct bigrams of the template in w places, and m distinct bigrams in the template, its Dice
coefficient is 2 h / (w + m). Size bounds prune templates: a coefficient of t needs h >= t m / (2 - t) bigrams in the text, and
only passages of up to m (2 - t) / t places can reach it.

Null and empty texts and texts of one word match nothing. Of equal coefficients the template of more bigrams wins, then the
earlier passage, then the earlier template. Repeated rows are scanned each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import pick
from emberwatch.llm.license_templates import TEMPLATES

LEAST = 0.8
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass(frozen=True)
class Index:
    """Templates as sets of bigram codes, and the templates of each code."""

    names: list[str]
    ids: dict[str, int]
    codes: np.ndarray
    owners: list[np.ndarray]
    sizes: list[int]


def index(templates: list[tuple[str, str]]) -> Index:
    words = [words_of(text) for _, text in templates]
    ids = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    sets = [{ids[a] * len(ids) + ids[b] for a, b in zip(ws, ws[1:])} for ws in words]
    codes = np.array(sorted(set().union(*sets)), np.int64)
    owners = [np.searchsorted(codes, np.array(sorted(s), np.int64)) for s in sets]
    return Index([n for n, _ in templates], ids, codes, owners, [len(s) for s in sets])


def _best_passage(places: np.ndarray, codes: np.ndarray, size: int, least: float) -> tuple[float, int, int] | None:
    """Best coefficient, first and last place among passages that reach ``least``."""
    longest = math.floor(size * (2 - least) / least + 1e-9)
    best = None
    for i in range(len(places)):
        seen: set[int] = set()
        for j in range(i, len(places)):
            width = int(places[j] - places[i]) + 1
            if width > longest:
                break
            seen.add(int(codes[j]))
            value = 2 * len(seen) / (width + size)
            if value >= least and (best is None or value > best[0]):
                best = (value, int(places[i]), int(places[j]))
    return best


def find_licenses(text: str | None, of: Index, least: float = LEAST) -> list[tuple[str, float, int, int]]:
    """(name, coefficient, first word, last word) of the best passage of each licence, best first; of passages that
    overlap only the best counts."""
    words = words_of(text)
    if len(words) < 2:
        return []
    ids = np.fromiter(map(of.ids.get, words, repeat(-1)), np.int64, len(words))
    both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    if not len(both):
        return []
    codes = ids[both] * len(of.ids) + ids[both + 1]
    at = np.minimum(np.searchsorted(of.codes, codes), len(of.codes) - 1)
    known = of.codes[at] == codes
    both, at = both[known], at[known]
    present = np.zeros(len(of.codes), bool)
    present[at] = True
    found: dict[str, tuple] = {}
    for t, (name, own, size) in enumerate(zip(of.names, of.owners, of.sizes)):
        if size and present[own].sum() >= least * size / (2 - least) - 1e-9:
            mine = np.isin(at, own)
            if best := _best_passage(both[mine], at[mine], size, least):
                key = (-best[0], -size, best[1], t, best[2])
                if name not in found or key < found[name]:
                    found[name] = key
    out: list[tuple[str, float, int, int]] = []
    for name, key in sorted(found.items(), key=lambda x: x[1]):
        first, last = key[2], key[4] + 1
        if all(last < b or first > e for _, _, b, e in out):
            out.append((name, -key[0], first, last))
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``doc_id, license, dice, first_word, last_word, licenses`` per row of ``docs(doc_id, text)``.

    The first four describe the best passage and are null where there is none; licenses names all that were found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = index(templates)
        for batch in batches:
            rows = [find_licenses(t, of, least) for t in batch.column("text").to_pylist()]
            first = [r[0] if r else (None,) * 4 for r in rows]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            columns = [pa.array([x[k] for x in first], kind) for k, kind in enumerate(kinds)]
            names = pa.array([[x[0] for x in r] for r in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, names],
                ["doc_id", "license", "dice", "first_word", "last_word", "licenses"],
            )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, license string, dice double, first_word long, last_word long, licenses array<string>"
    return rows.mapInArrow(run, schema)
