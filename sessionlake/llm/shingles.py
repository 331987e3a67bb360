"""Word shingle sets of whole texts as 64-bit values, in numpy.

A word is a run of bytes outside the six ASCII white space characters; A-Z count
as a-z. Texts of any length are hashed in pieces cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def _hash_piece(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word: a polynomial in the word's bytes, from
    differences of running sums modulo 2**64."""
    up, down = _powers_up_to(max(len(piece), PIECE_BYTES + 1))
    inside = np.zeros(len(piece) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[piece]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(piece) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[piece].astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte's place of every word of `data`."""
    raw = np.frombuffer(data, dtype=np.uint8)
    found, at = [], 0
    while at < len(raw):
        end = min(at + PIECE_BYTES, len(raw))
        if end < len(raw):  # back to white space, or on to it when a word fills the piece
            near = np.flatnonzero(_SPACE[raw[at:end]])
            if len(near):
                end = at + int(near[-1]) + 1
            else:
                while end < len(raw) and not _SPACE[raw[end]]:
                    ahead = np.flatnonzero(_SPACE[raw[end:end + PIECE_BYTES]])
                    end = end + int(ahead[0]) if len(ahead) else min(end + PIECE_BYTES, len(raw))
        h, s = _hash_piece(raw[at:end])
        found.append((h, s + at))
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([s for _, s in found])


def _chain(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter input is one run."""
    width = min(width, len(words))
    h = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        h = mix(h * np.uint64(0xA0761D6478BD642F) + words[j: len(words) - width + 1 + j])
    return h


def blocks(texts: list[str | None], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about `limit` characters; a longer text is a run by itself."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; null and wordless texts have none."""
    encoded = [(t or "").encode("utf-8", "replace") for t in texts]
    starts = np.cumsum([0] + [len(e) + 1 for e in encoded])
    words, places = word_hashes(b"\n".join(encoded))
    cut = np.searchsorted(places, starts)
    return [
        np.unique(_chain(words[a:b], width)) if b > a else np.zeros(0, np.uint64)
        for a, b in zip(cut[:-1], cut[1:])
    ]
