"""Word hashes of many whole texts at once, in numpy.

Texts are joined to chunks of about a megabyte (a longer text is a chunk of its own) and their words are hashed
together: a prefix sum of byte values times powers of an odd base gives the hash of any word in constant time,
64 bits wide and the same wherever the word stands.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE_BYTES = bytes((9, 10, 11, 12, 13))

#: Byte tables: white space to blanks; letters folded and all else in ASCII to blanks; classes of characters.
SPACES = bytes(32 if b in _SPACE_BYTES else b for b in range(256))
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHAPES = bytes(
    32 if b in _SPACE_BYTES else 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
    for b in range(256)
)

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        tables = tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))]) for x in (_BASE, _INVERSE)
        )
        if size > 4 * CHUNK:
            return tables  # of one very long text, not kept
        _powers = tables
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words(NamedTuple):
    """Word hashes in order, the index of each word's text, and byte bounds of words in the joined chunk."""

    hashes: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def hash_words(buffer: np.ndarray, lengths: np.ndarray) -> Words:
    """Words of texts that lie one after the other in `buffer`, each followed by a blank that `lengths` counts too."""
    inside = np.empty(len(buffer) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(buffer, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(buffer) + 1)
    prefix = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[: len(buffer)], out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * inverse[starts])
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return Words(hashes, owner, starts, ends)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, with the position of the first of them."""
    count = len(words.hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total = total * np.uint64(_BASE) + words.hashes[j : j + count]
    at = np.flatnonzero(words.owner[:count] == words.owner[n - 1 :])
    return mix(total[at]), at


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last + 1, joined bytes, lengths) of runs of texts of about a megabyte."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        piece = (text or "").encode("utf-8", "surrogatepass") + b" "
        if held and size + len(piece) > CHUNK:
            yield first, k, b"".join(held), np.array([len(x) for x in held])
            first, held, size = k, [], 0
        held.append(piece)
        size += len(piece)
    if held:
        yield first, first + len(held), b"".join(held), np.array([len(x) for x in held])


def folded(joined: bytes, table: bytes) -> np.ndarray:
    return np.frombuffer(joined.translate(table), np.uint8)
