"""Vectorised text kernels used inside Arrow tasks.

Words are maximal runs of characters other than U+0020 and U+0009..U+000D, with
A-Z lower-cased; those bytes never occur inside a multi-byte UTF-8 sequence, so
everything works on bytes. A word's hash is its polynomial value modulo 2^64,
read off prefix sums, and a shingle's hash is a mixed multilinear sum of word
hashes. Hashes depend on the text alone, so they agree across machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# An odd multiplier that is 5 modulo 8, and the constants of the 64-bit finaliser and sequence.
BASE = 0x5851F42D4C957F2D
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

#: Bytes hashed at once; longer texts are cut at separators.
CHUNK = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACES = b" \t\n\x0b\x0c\r"

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1024)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_1)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(33))


def sequence64(n: int, start: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers, the same everywhere."""
    return mix64(np.arange(start + 1, start + n + 1, dtype=np.uint64) * np.uint64(GOLDEN))


def _chunk_word_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~_SEPARATOR[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(GOLDEN))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text, in order."""
    if len(data) <= CHUNK:
        return _chunk_word_hashes(data)
    found, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        found.append(_chunk_word_hashes(data[at:end]))
        at = end
    return np.concatenate(found)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k``-word shingles, repeats included.

    With fewer than ``k`` words the whole sequence is one shingle; without words there is none.
    """
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    factors = sequence64(width, start=1000) | np.uint64(1)
    total = np.full(n - width + 1, GOLDEN * width & MASK, dtype=np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * factors[i]
    return mix64(total)


def shingle_set(text: str | bytes | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return np.unique(shingle_hashes(word_hashes(data), k))


def utf8_values(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string column as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.view(kind) if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().view(kind):
        yield value.as_py()
