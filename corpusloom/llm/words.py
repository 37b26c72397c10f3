"""Vectorised word splitting and hashing over batches of texts.

Words are maximal runs of bytes outside a separator set (by default the six
ASCII white-space bytes, i.e. the pattern ``[^\\x20\\x09-\\x0D]+``).  A word's
64-bit hash is a polynomial over mixed byte values, finished by a bit mixer;
all words of a block come from one prefix sum, without a Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
BLOCK = 1 << 18
GROUP_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return table


_SPACE_TABLE = separators(SPACES)


class Words(NamedTuple):
    """Words of a group of texts; text i has words first[i] to first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    beginnings: np.ndarray  # one row per length asked for: hash of the word's first bytes, 0 if it is not longer


def word_spans(buf: np.ndarray, table: np.ndarray = _SPACE_TABLE) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~table[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def hash_words(data: bytes, offsets: np.ndarray, table: np.ndarray = _SPACE_TABLE, lengths: tuple[int, ...] = ()) -> Words:
    """Spans and hashes of all words of ``data``; ``offsets`` has each text's first byte and the end.

    ``lengths`` asks for the hashes of words' beginnings of so many bytes, too.

    Blocks of about 256 kB keep the temporary arrays small for any length of text.
    """
    buf = np.frombuffer(data, dtype=np.uint8)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(buf):
        stop = min(len(buf), at + BLOCK)
        while stop < len(buf):
            gaps = np.flatnonzero(table[buf[stop : stop + BLOCK]])
            if len(gaps):
                stop += int(gaps[0])
                break
            stop = min(len(buf), stop + BLOCK)
        block = buf[at:stop]
        starts, ends = word_spans(block, table)
        up, down = _powers(max(len(block) + 1, BLOCK + 1))
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[block] * up[: len(block)], out=sums[1:])
        heads = np.zeros((len(lengths), len(starts)), dtype=np.uint64)
        for head, n in zip(heads, lengths):
            longer = np.flatnonzero(ends - starts > n)
            head[longer] = mix((sums[starts[longer] + n] - sums[starts[longer]]) * down[starts[longer]] + np.uint64(n))
        parts.append((starts + at, ends + at, mix((sums[ends] - sums[starts]) * down[starts]), heads))
        at = stop
    if not parts:
        parts.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((len(lengths), 0), np.uint64)))
    starts, ends, hashes, heads = (np.concatenate(x, axis=-1) for x in zip(*parts))
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets), heads)


def groups(texts, lower: bool = False) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as UTF-8) of runs of about GROUP_BYTES; null is empty.

    ``lower`` folds A-Z only, as bytes.lower does.
    """
    run: list[bytes] = []
    begin = total = 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        raw = raw.lower() if lower else raw
        if run and total + len(raw) > GROUP_BYTES:
            yield begin, run
            run, begin, total = [], i, 0
        run.append(raw)
        total += len(raw)
    if run:
        yield begin, run


def words_of(run: list[bytes], table: np.ndarray = _SPACE_TABLE, lengths: tuple[int, ...] = ()) -> Words:
    """Words of a run of texts, which a line feed keeps apart."""
    sizes = np.fromiter(map(len, run), dtype=np.int64, count=len(run)) + 1
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return hash_words(b"\n".join([*run, b""]), offsets, table, lengths)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (k = 1: the word); empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += hashes[j : n + j]
    return mix(out)
