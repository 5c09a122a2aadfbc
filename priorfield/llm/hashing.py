"""Vectorised 64-bit hashes of the words of a text, for use inside tasks."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII characters but letters and digits, for words without punctuation.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: Encoders of a worker process with their caches, by file; work on words lets them go, so that a worker holds one kind of cache.
ENCODERS: dict[str, object] = {}
#: Texts of so many bytes leave enough free memory behind to give back.
MUCH = 1 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
_BASE = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.ones(1, dtype=np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        out.append(p[:n])
    return out[0], out[1]


_STEP = 1 << 16
_POWERS = _powers(_STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of an UTF-8 text, see _hash_words."""
    return _hash_words(text)[0]


def _hash_words(text: bytes, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (run of bytes that are not white space) of an UTF-8 text, A-Z lower-cased.

    A word's hash is a polynomial of its bytes modulo 2**64, mixed with its length. It is taken
    from running sums, so the cost per byte is a few numpy operations. Returns the hashes and where
    the words begin; both are empty for a text without words."""
    raw = np.frombuffer(text.lower(), dtype=np.uint8)
    word = ~between[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    if not len(edge):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS
    terms = raw.astype(np.uint64) + np.uint64(1)
    if len(raw) <= _STEP:
        terms *= up[:len(raw)]
    else:  # the power restarts in each block of a long text; a word over a block's edge is put together below
        blocks = -(-len(raw) // _STEP)
        terms *= np.tile(up, blocks)[:len(raw)]
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
    block = start // _STEP
    edge_at = np.minimum(end, (block + 1) * _STEP)
    out = (total[edge_at] - total[start]) * down[start % _STEP]
    for i in np.flatnonzero(end > edge_at):  # at most one word for each 65,536 bytes
        out[i] = np.sum((raw[start[i]:end[i]].astype(np.uint64) + np.uint64(1)) * _powers(int(end[i] - start[i]))[0], dtype=np.uint64)
    return mix(out ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def give_back():
    """Return free memory to the system. Workers are kept from stage to stage; without this each of them
    stays as large as its largest batch was."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def word_groups(texts: list[bytes], group: int = 60_000, between: np.ndarray = WHITE):
    """Hash the words of many texts, some at a time: yields (first text, starts, words), where the
    words of text ``first + i`` are ``words[starts[i]:starts[i + 1]]``. Texts are never cut; a
    group has one text or at most ``group`` bytes, which makes short texts cheap. ``between`` marks
    the bytes that are not part of words. Memory that is free again is given back before and after."""
    much = sum(map(len, texts)) >= MUCH
    if ENCODERS or much:
        ENCODERS.clear()
        give_back()
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < group:
            size += len(texts[end]) + 1
            end += 1
        lengths = np.fromiter((len(t) + 1 for t in texts[at:end]), dtype=np.int64, count=end - at)
        hashes, begins = _hash_words(b"\n".join(texts[at:end]), between)
        yield at, np.searchsorted(begins, np.concatenate([[0], np.cumsum(lengths)])), hashes
        at = end
        del hashes, begins
    if much:
        give_back()


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, in the order of the text."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(_BASE) + words[i:i + n]
    return mix(out)


def shingle_sets(texts: list[bytes], size: int):
    """Of each text in turn: the distinct hashes, ascending, of all its runs of `size` words; of the
    whole sequence of words if it is shorter; an empty array for a text without words."""
    for _, starts, words in word_groups(texts):
        every = runs(words, size)
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a >= size:
                yield np.unique(every[a:b - size + 1])
            else:
                yield runs(words[a:b], int(b - a)) if b > a else words[:0]
