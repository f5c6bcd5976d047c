"""Word hashes of many texts at once, by columns of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tesserae.llm.fingerprints import mix

#: Characters of texts that are looked at together.
PART_CHARS = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _LENGTH = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * n, _BASE, np.uint64)])
    return _powers


@dataclass
class Words:
    """Of texts laid end to end: each word's 64-bit hash, first and last byte's place and last byte, the words of each text (first to first of the next), and the lines before each word."""

    hashes: np.ndarray
    starts: np.ndarray
    last: np.ndarray
    first: np.ndarray
    lines: np.ndarray


def words_of(texts: list[str], lines: bool = False) -> Words:
    """Words are runs of bytes other than ASCII white space, with A-Z lowered; a text ends the line."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw).lower()
    lens = np.array([len(r) + 1 for r in raw])
    buf = np.frombuffer(joined, np.uint8)
    space = _SPACE[buf]
    word = ~space
    starts = np.flatnonzero(word & np.r_[True, space[:-1]]) if len(buf) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & np.r_[space[1:], True]) if len(buf) else np.zeros(0, np.int64)
    first = np.append(np.searchsorted(starts, np.cumsum(lens) - lens), len(starts))
    if not len(starts):
        return Words(np.zeros(0, np.uint64), starts, np.zeros(0, np.uint8), first, np.zeros(0, np.int64))
    size = ends - starts + 1
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    hashes = mix(np.add.reduceat(_BYTE[buf[word]] * powers(int(size.max()))[place], begin) + size.astype(np.uint64) * _LENGTH)
    return Words(hashes, starts, buf[ends], first, np.cumsum(buf == 10)[starts] if lines else np.zeros(0, np.int64))


def shingles_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words."""
    n = len(hashes) - width + 1
    out = hashes[:n].copy()
    for j in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n + j]
    return mix(out + np.uint64(width))


def parts_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of a batch, about PART_CHARS characters at a time, with the first one's row; null counts as empty."""
    at, chars, texts = 0, 0, []
    for i, text in enumerate(batch.column(column)):
        texts.append(text.as_py() or "")
        chars += len(texts[-1])
        if chars >= PART_CHARS or i == batch.num_rows - 1:
            yield at, texts
            at, chars, texts = i + 1, 0, []
