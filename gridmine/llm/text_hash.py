"""Vectorised hashing of words and word runs for a batch of texts (inside tasks)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=U64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=U64)
    return _powers["up"], _powers["down"]


def words_of(texts: list[bytes], blank: np.ndarray = _BLANK, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(hashes, lengths, first word of each text and the end, hashes of the first bytes of words).

    Words are runs of bytes that are not ``blank``; A-Z count as a-z. A hash is a sum of random numbers
    per byte times powers of an odd base, mod 2**64, mixed with the length; words of equal bytes have
    equal hashes wherever they stand. ``heads`` asks for hashes of so many first bytes (0 for words
    that are not longer).
    """
    raw = b"\n" + b"\n".join(texts) + b"\n"
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)
    up, down = _power_table(len(data) + 1)
    off = blank[data]
    starts = np.flatnonzero(off[:-1] & ~off[1:]) + 1
    ends = np.flatnonzero(~off[:-1] & off[1:]) + 1
    values = _BYTE[data] * up[: len(data)]
    values[off] = 0
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(values, out=sums[1:])
    lengths = ends - starts

    def hashed(last: np.ndarray) -> np.ndarray:
        own = (sums[last] - sums[starts]) * down[starts]
        return mix(own ^ ((last - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))

    firsts = [np.where(lengths > k, hashed(np.minimum(starts + k, ends)), U64(0)) for k in heads]
    offsets = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return hashed(ends), lengths, np.searchsorted(starts, offsets), firsts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every blank-separated word of every text, and the words before each text (n + 1 numbers)."""
    hashes, _, at, _ = words_of(texts)
    return hashes, at


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n neighbouring words."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * U64(0xA0761D6478BD642F) + words[k : len(words) - n + 1 + k])
    return out


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word runs of every text, sorted inside each text, and where each text's begin.

    A text of fewer words, but not none, is one run.
    """
    words, at = word_hashes(texts)
    runs = run_hashes(words, n)
    parts, sizes = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(runs[a : b - n + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            own = mix(run_hashes(words[a:b], b - a) + U64(b - a))
        else:
            own = runs[:0]
        parts.append(own)
        sizes.append(len(own))
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
