"""Vectorised text primitives for Arrow batches: code points, character classes, tokens and word hashes.

A batch of texts is laid out as one array of code points with a line feed between texts, so every
per-character, per-token and per-line figure is one numpy pass instead of a Python loop.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

SPACE, NEWLINE, LOWER, UPPER, DIGIT, PUNCT, SYMBOL = range(7)
#: Marks of ordinary printed prose; every other non-alphanumeric mark counts as a symbol.
PROSE_MARKS = set(".,;:!?'\"()-‐‑–—“”‘’«»¿¡&…")
HASH_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
HASH_INV = np.uint64(pow(int(HASH_BASE), -1, 1 << 64))
BATCH_CHARS = 1_000_000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Character class of each BMP code point; the last entry stands for all higher planes."""
    out = np.full(65537, SYMBOL, np.uint8)
    for cp in range(65536):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if ch == "\n":
            out[cp] = NEWLINE
        elif ch.isspace() or cat == "Zs":
            out[cp] = SPACE
        elif cat in ("Lu", "Lt"):
            out[cp] = UPPER
        elif cat[0] == "L" or cat[0] == "M":
            out[cp] = LOWER
        elif cat[0] == "N":
            out[cp] = DIGIT
        elif ch in PROSE_MARKS:
            out[cp] = PUNCT
    return out


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Lower case of each BMP code point where that is a single BMP code point."""
    out = np.arange(65537, dtype=np.uint32)
    for cp in range(65536):
        low = chr(cp).lower()
        if len(low) == 1 and ord(low) < 65536:
            out[cp] = ord(low)
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, HASH_BASE, np.uint64)
    down = np.full(n, HASH_INV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: equal inputs give equal, well spread outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


@dataclass
class Block:
    """Texts of one block as flat arrays. Text i covers code points [start[i], end[i])."""

    cps: np.ndarray  # uint32 code points, line feed after every text
    clip: np.ndarray  # the same, higher planes as 65536
    cls: np.ndarray  # uint8 classes
    low: np.ndarray  # folded code points, clipped to 65536
    start: np.ndarray
    end: np.ndarray
    data: str
    made: dict = field(default_factory=dict)

    @property
    def n(self) -> int:
        return len(self.start)


def block(texts: list[str]) -> Block:
    data = "\n".join(texts) + "\n"
    cps = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
    clip = np.minimum(cps, 65536)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    start = np.concatenate([[0], np.cumsum(lens + 1)])[:-1].astype(np.int64)
    return Block(cps, clip, class_table()[clip], fold_table()[clip], start, start + lens, data)


def split_by_size(items: Iterable[tuple], size_of, limit: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Lists of items whose sizes add up to about ``limit``; one larger item stands alone."""
    out: list[tuple] = []
    total = 0
    for item in items:
        out.append(item)
        total += size_of(item) + 1
        if total >= limit:
            yield out
            out, total = [], 0
    if out:
        yield out


def prefix(mask: np.ndarray) -> np.ndarray:
    """Prefix counts, one longer than the mask."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:], dtype=np.int32)
    return out


def between(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return pre[end] - pre[start]


@lru_cache(maxsize=64)
def char_set(chars: str) -> np.ndarray:
    """Membership table of BMP characters, indexed by ``Block.clip``."""
    out = np.zeros(65537, bool)
    out[[ord(c) for c in chars]] = True
    return out


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray


def tokens(b: Block) -> Tokens:
    """Maximal runs of non-white characters."""
    if "tokens" not in b.made:
        b.made["tokens"] = Tokens(*runs(b.cls > NEWLINE))
    return b.made["tokens"]


def words(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the maximal runs of letters."""
    if "words" not in b.made:
        w0, w1 = runs((b.cls == LOWER) | (b.cls == UPPER))
        b.made["words"] = (w0, w1, range_hash(b.low, w0, w1))
    return b.made["words"]


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash (mod 2**64, odd base) of values[start:end] for each range, length included."""
    up, down = powers(len(values) + 1)
    acc = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=acc[1:])
    h = (acc[end] - acc[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_hash(word: str) -> int:
    """The hash ``range_hash`` gives for this word's folded code points."""
    cps = np.array([ord(c) for c in word.lower()], np.uint32)
    return int(range_hash(np.minimum(cps, 65536), np.array([0]), np.array([len(cps)]))[0])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask``."""
    m = mask.view(np.int8)
    change = np.flatnonzero(m[1:] != m[:-1]) + 1
    if len(m) and m[0]:
        change = np.concatenate([[0], change])
    if len(m) and m[-1]:
        change = np.append(change, len(m))
    return change[::2], change[1::2]
